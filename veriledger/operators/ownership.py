"""Ownership policy: is each cited artifact, method, file and literal one the subject declared?

Policy is a long table ``(subject, axis, key, value)``; every rule is an anti-join or a
set difference on full keys, so a subject with very many rows still spreads over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledger.functions import urls
from veriledger.operators.validation import Ledger, broken_dependency, violations
from veriledger.session import cut_lineage
from veriledger.sources import registry

KEY = ["subject", "axis"]


def declared_method(cells: DataFrame) -> Column:
    """The method a cell is settled by: the check's, else the bound's."""
    check = F.nullif(F.col("check_method"), F.lit(""))
    return F.coalesce(check, F.nullif(F.col("bound_method"), F.lit("")), F.lit(""))


def asserted_method() -> Column:
    """The method of the block a cell asserts: the bound's when there is a bound (opposite order)."""
    return F.when(F.col("has_bound"), F.col("bound_method")).otherwise(F.col("check_method"))


def asserted_fields() -> Column:
    return F.when(F.col("has_bound"), F.col("bound_fields")).otherwise(F.col("check_fields"))


def settled_blocks(cells: DataFrame) -> DataFrame:
    return cells.filter("has_check or has_bound").select(
        "cell_no", "subject", "axis", declared_method(cells).alias("declared_method"), asserted_method().alias("asserted_method")
    )


def gated_cells(led: Ledger) -> DataFrame:
    """Cells that must pass the gate: scored above zero, or carrying a bound."""
    return led.cells.filter(F.coalesce(F.col("score") != 0, F.lit(False)) | F.col("has_bound"))


def annotate(led: Ledger) -> DataFrame:
    """Cells with everything the policy declares for them, one row per cell.

    Subject status and per-axis policy are each aggregated to one row per key first, so
    all single-row ownership rules share two joins.
    """
    status = (
        led.subjects.select("subject", F.lit(1).alias("d"), F.lit(0).alias("s"))
        .unionByName(led.sources.select("subject", F.lit(0).alias("d"), F.lit(1).alias("s")))
        .groupBy("subject").agg((F.max("d") == 1).alias("declared"), (F.max("s") == 1).alias("sourced"))
    )

    def has(key: str) -> Column:
        return (F.count_if(F.col("key") == key) > 0).alias(f"has_{key}")

    def value(key: str) -> Column:
        return F.max(F.when(F.col("key") == key, F.col("value"))).alias(f"want_{key}")

    single = ("axis_method", "axis_file", "axis_evidence_sha256")
    wide = led.policy.groupBy(*KEY).agg(
        *[has(k) for k in ("axis_sources", "axis_documents", "axis_literals", *single)], *[value(k) for k in single]
    )
    cells = led.cells.select(
        "cell_no", *KEY, "score", "has_check", "has_bound", "check_method", "bound_method", "check_expect",
        F.try_element_at("check_fields", F.lit("expect_file")).alias("got_file"),
        F.try_element_at("check_fields", F.lit("expect_evidence_sha256")).alias("got_sha256"),
    )
    out = cells.join(status, "subject", "left").join(wide, KEY, "left")
    flags = ["declared", "sourced", *[c for c in wide.columns if c.startswith("has_axis")]]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in flags})
    positive = F.coalesce(F.col("score") != 0, F.lit(False))
    return out.withColumns({
        "positive": positive,
        "gated": positive | F.col("has_bound"),
        "passed": F.col("declared") & F.col("sourced") & (~positive | F.col("has_axis_sources")),
    })


def _finding(rule: str, cond: Column, detail: Column) -> Column:
    return F.when(cond, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))


def row_rules(annotated: DataFrame) -> DataFrame:
    """O1, O2 and O5-O8 in one pass over the annotated cells."""
    c = F.col
    policed = c("passed") & c("positive")

    def differs(rule: str, key: str, got: str) -> Column:
        want = c(f"want_{key}")
        text = F.concat_ws(" not ", F.coalesce(c(got), F.lit("None")), F.coalesce(want, F.lit("None")))
        return _finding(rule, policed & c(f"has_{key}") & ~c(got).eqNullSafe(want), text)

    found = F.array(
        _finding("O1", c("gated") & ~c("declared"), F.lit("undeclared")),
        _finding("O1", c("gated") & c("declared") & ~c("sourced"), F.lit("no sources")),
        _finding("O2", c("positive") & c("declared") & c("sourced") & ~c("has_axis_sources"), c("score")),
        _finding("O5", policed & ~c("has_axis_method"), F.lit("axis_method")),
        _finding("O5", policed & ~c("has_axis_literals"), F.lit("axis_literals")),
        differs("O6", "axis_method", "check_method"),
        differs("O7", "axis_evidence_sha256", "got_sha256"),
        differs("O8", "axis_file", "got_file"),
    )
    return annotated.select(*KEY, F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f")).select(
        "f.rule", F.col("subject").cast("string").alias("subject"), "axis", "f.detail"
    )


def _policy(led: Ledger, key: str, name: str = "value") -> DataFrame:
    return led.policy.filter(F.col("key") == key).select("subject", "axis", F.col("value").alias(name))


def source_rule(led: Ledger, annotated: DataFrame) -> DataFrame:
    """O3: sources cited outside the subject's list, or inside it but declared for other axes."""
    own = annotated.filter("gated and passed").filter(~declared_method(annotated).isin(registry.THIRD_PARTY_METHODS))
    used = (
        led.evidence.select("cell_no", urls.source_key(F.col("url")).alias("source"))
        .join(own.select("cell_no", *KEY, "has_axis_sources"), "cell_no")
        .select(*KEY, "source", "has_axis_sources").distinct()
    )
    foreign = used.join(led.sources, ["subject", "source"], "left_anti").select(*KEY, F.concat(F.col("source"), F.lit(" undeclared")).alias("d"))
    entries = _policy(led, "axis_sources", "source")
    inside = used.filter("has_axis_sources").join(led.sources, ["subject", "source"], "left_semi")
    elsewhere = entries.groupBy("subject", "source").agg(
        F.array_sort(F.collect_set("axis")).alias("axes")  # at most 22 axes
    )
    wrong = inside.join(elsewhere, ["subject", "source"], "left").filter(
        ~F.coalesce(F.array_contains("axes", F.col("axis")), F.lit(False))
    )
    names = F.coalesce(F.array_join(F.col("axes").cast("array<string>"), ","), F.lit("none"))
    wrong = wrong.select(*KEY, F.concat(F.col("source"), F.lit(" for axes "), names).alias("d"))
    return violations(foreign.unionByName(wrong), "O3", "subject", "axis", "d")


def set_difference(left: DataFrame, right: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per key: how many items only one side has, and the first of each.

    Both sides are united and counted per (key, item), so the shuffle key includes the
    item and no key's items are ever collected.
    """
    sides = left.select(*keys, item, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, item, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_item = sides.groupBy(*keys, item).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    only_left, only_right = F.col("l") > F.col("r"), F.col("r") > F.col("l")
    return per_item.filter("l <> r").groupBy(*keys).agg(
        F.count_if(only_left).alias("n_extra"), F.min(F.when(only_left, F.col(item))).alias("extra"),
        F.count_if(only_right).alias("n_missing"), F.min(F.when(only_right, F.col(item))).alias("missing"),
    )


def _difference_detail() -> Column:
    return F.concat_ws(" ", F.lit("extra"), F.col("n_extra").cast("string"), F.coalesce("extra", F.lit("-")),
                       F.lit("missing"), F.col("n_missing").cast("string"), F.coalesce("missing", F.lit("-")))


def document_rule(led: Ledger, annotated: DataFrame) -> DataFrame:
    """O4: cited documents must be exactly the declared ones."""
    passed = annotated.filter("passed").select("cell_no", *KEY, "positive", "has_bound", "has_axis_documents")
    cited = led.evidence.select("cell_no", "url").distinct()
    bare = passed.filter("not has_axis_documents")
    undeclared = bare.filter("positive").unionByName(
        bare.filter("not positive and has_bound").join(cited.select("cell_no"), "cell_no", "left_semi")
    )
    declared = passed.join(_policy(led, "axis_documents", "url").filter("url is not null").distinct(), KEY).select("cell_no", *KEY, "url")
    used = passed.filter("has_axis_documents").join(cited, "cell_no").select("cell_no", *KEY, "url")
    unequal = set_difference(used, declared, ["cell_no", *KEY], "url")
    return violations(undeclared, "O4", "subject", "axis", F.lit("no axis_documents")).unionByName(
        violations(unequal, "O4", "subject", "axis", _difference_detail())
    )


def literal_rule(led: Ledger, annotated: DataFrame) -> DataFrame:
    """O9: literals of the check against the declared list, as multisets, both ways."""
    cells = annotated.filter("passed and positive and has_axis_literals").select("cell_no", *KEY, "check_expect")
    got = cells.select("cell_no", *KEY, F.explode("check_expect").alias("literal"))
    literals = _policy(led, "axis_literals", "literal").filter("literal is not null")
    want = cells.select("cell_no", *KEY).join(literals, KEY)
    unequal = set_difference(got, want, ["cell_no", *KEY], "literal")
    return violations(unequal, "O9", "subject", "axis", _difference_detail())


ROW_RULES = ["O1", "O2", "O5", "O6", "O7", "O8"]
SET_RULES = {"O3": source_rule, "O4": document_rule, "O9": literal_rule}


def ownership_rule(led: Ledger, rule: str) -> DataFrame:
    annotated = annotate(led)
    if rule in SET_RULES:
        return SET_RULES[rule](led, annotated)
    return row_rules(annotated).filter(F.col("rule") == rule)


def foreign_evidence(led: Ledger) -> DataFrame:
    """Every ownership violation; the annotated cells are computed once for all rules."""
    annotated = cut_lineage(annotate(led))
    return reduce(DataFrame.unionByName, [fn(led, annotated) for fn in SET_RULES.values()], row_rules(annotated))


def gate(led: Ledger) -> DataFrame:
    """Ordered first-failure verdict per gated cell.

    ``verdict`` is 'fail' with the first failing reason, 'pass' for a clean asserted cell,
    or 'execute' when only the method's own check over the bytes remains.
    """
    cells = gated_cells(led)
    owned = foreign_evidence(led).select("subject", "axis").distinct().select(
        F.col("subject").alias("_s"), F.col("axis").alias("_a"), F.lit(True).alias("foreign")
    )
    shared = broken_dependency(led.evidence.select("sha256", "url"), "sha256", "url").select("sha256").distinct()
    doubled = led.evidence.select("cell_no", "sha256").join(shared, "sha256", "left_semi").select("cell_no").distinct().withColumn("doubled", F.lit(True))
    method = declared_method(cells)
    required = registry.required_method(F.col("axis"))
    absent = F.filter(
        registry.required_fields(method),
        lambda f: ~F.coalesce(F.map_contains_key(asserted_fields(), f), F.lit(False)),
    )
    reason = (
        F.when(F.col("foreign"), "ownership")
        .when(F.col("doubled"), "digest under two urls")
        .when(F.col("score") == 1, F.lit(None))
        .when(required.isNotNull() & (method != required), "required method")
        .when(F.size(absent) > 0, F.concat(F.lit("missing "), F.get(absent, F.lit(0))))
        .when(~registry.is_permitted(method, F.col("axis")), "method not permitted")
        .when(~registry.has_executor(method), "no executor")
    )
    joined = cells.join(owned, (F.col("subject").cast("string") == F.col("_s")) & (F.col("axis") == F.col("_a")), "left").join(doubled, "cell_no", "left")
    return joined.select("cell_no", "subject", "axis", "score", reason.alias("reason")).withColumn(
        "verdict", F.when(F.col("reason").isNotNull(), "fail").when(F.col("score") == 1, "pass").otherwise("execute")
    )


def cited_by(evidence: DataFrame) -> DataFrame:
    """Which subjects cite an address, as rows (descriptive only; never an ownership source)."""
    return evidence.select("url", "subject").distinct()
