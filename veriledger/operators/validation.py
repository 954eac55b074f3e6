"""Ledger validation rules: every rule yields ``violations(rule, subject, axis, detail)``.

Rules that look at one cell (or one evidence record) only are conditions of a single
pass: validating the whole ledger scans ``cells`` once and the evidence join once,
however many such rules there are.  Rules over sets are anti-joins and combinable
aggregates; none of them collects a group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledger.functions import content, urls
from veriledger.functions.ranking import ordinals
from veriledger.session import cut_lineage
from veriledger.sources import registry


@dataclass(frozen=True)
class Ledger:
    """The ledger as tables.

    ``subjects(subject, kind, repo)``, ``sources(subject, source)``, ``cells(cell_no, …)``,
    ``evidence(cell_no, subject, axis, pos, url, …)``, ``cited(label, url, sha256)``,
    ``policy(subject, axis, key, value)``, ``warrants(subject, source, document)``,
    ``superseded(subject, address, grp, superseded_by, still_valid_for)``,
    ``records(subject, record)`` with the raw subject JSON.
    """

    subjects: DataFrame
    cells: DataFrame
    evidence: DataFrame
    sources: DataFrame | None = None
    cited: DataFrame | None = None
    policy: DataFrame | None = None
    warrants: DataFrame | None = None
    superseded: DataFrame | None = None
    records: DataFrame | None = None
    as_of: str = ""
    bounded_zero_floor: int | Column = 0


Rule = Callable[[Ledger], DataFrame]
RULES: dict[str, Rule] = {}


def register_rule(name: str, fn: Rule) -> Rule:
    """Add a rule; users register their own the same way."""
    RULES[name] = fn
    return fn


def _rule(name: str):
    return lambda fn: register_rule(name, fn)


def violations(df: DataFrame, rule: str, subject, axis, detail) -> DataFrame:
    def as_col(value, kind):
        value = value if isinstance(value, Column) else (F.lit(None) if value is None else F.col(value))
        return value.cast(kind)

    return df.select(
        F.lit(rule).alias("rule"), as_col(subject, "string").alias("subject"),
        as_col(axis, "int").alias("axis"), as_col(detail, "string").alias("detail"),
    )


# ------------------------------------------------------------------ one-row conditions
# Each entry gives an array of details; an empty or null array means the row is clean.

def _when(cond: Column, detail: Column | str = "") -> Column:
    detail = detail if isinstance(detail, Column) else F.lit(detail)
    return F.when(F.coalesce(cond, F.lit(False)), F.coalesce(detail.cast("string"), F.lit("")))


def _details(*entries: Column) -> Column:
    return F.filter(F.array(*entries), lambda d: d.isNotNull())


def _cell_rules(as_of: str) -> dict[str, Column]:
    c = F.col
    axis, score, method, bound = c("axis"), c("score"), c("check_method"), c("bound_method")
    known = registry.is_axis(axis)
    scored = known & score.isin(0, 1, 2)
    has_check, has_bound = scored & c("has_check"), scored & c("has_bound")
    required = registry.required_method(axis)
    # a cell's block is its bound, else its check
    block_as_of = F.when(c("has_bound"), c("bound_as_of")).otherwise(F.try_element_at(c("check_fields"), F.lit("as_of")))

    def missing(method_col: Column, fields: Column, prefix: str, cond: Column) -> Column:
        absent = F.filter(
            registry.required_fields(method_col),
            lambda f: content.is_absent(F.try_element_at(fields, f), "json"),
        )
        return F.when(F.coalesce(cond, F.lit(False)), F.transform(absent, lambda f: F.concat(F.lit(prefix), f)))

    none = F.array().cast("array<string>")
    return {
        "V4": _details(
            _when(~content.is_absent(block_as_of, "text") & ~content.is_iso_date(block_as_of), block_as_of),
        ),
        "V6": _details(_when(~known)),
        "V9": _details(_when(known & score.isNotNull() & ~score.isin(0, 1, 2), score)),
        "V10": _details(_when(known & score.isNull() & ~axis.isin(registry.NA_AXES), registry.axis_name(axis))),
        "V11": _details(_when(known & score.isNull() & content.is_blank(c("na_reason")))),
        "V20": _details(_when(scored & (score == 2) & ~c("has_check"))),
        "V21": _details(
            _when(has_check & ~registry.is_registered(method), method),
            _when(has_check & registry.is_registered(method) & ~registry.has_executor(method),
                  F.concat(method, F.lit(" has no executor"))),
        ),
        "V22": _details(_when(has_check & registry.is_registered(method) & ~registry.is_permitted(method, axis), method)),
        "V23": _details(_when(has_check & (score == 2) & required.isNotNull() & ~method.eqNullSafe(required), required)),
        "V24": F.concat(
            F.coalesce(missing(method, c("check_fields"), "check.", has_check), none),
            F.coalesce(missing(bound, c("bound_fields"), "bound.", has_bound), none),
        ),
        "V25": _details(_when(has_check & method.isin("grep_retrieved", "count_in_retrieved")
                              & content.is_absent(c("check_expect"), "container"), method)),
        "V26": _details(_when(has_check & content.is_blank(c("check_asserts")), "asserts"),
                        _when(has_check & content.is_blank(c("check_observed")), "observed")),
        "V27": _details(
            _when(has_bound & (score != 0), "score"),
            _when(has_bound & ~registry.is_registered(bound), "unregistered"),
            _when(has_bound & registry.is_registered(bound) & ~registry.is_permitted(bound, axis), "not permitted"),
            _when(has_bound & content.is_blank(c("bound_asserts")), "asserts"),
            _when(has_bound & content.is_blank(c("bound_observed")), "observed"),
            _when(has_bound & content.is_blank(c("bound_as_of")), "as_of"),
        ),
        "V28": _details(
            _when(has_bound & content.is_absent(c("bound_archived"), "container"), "nothing archived"),
            _when(has_bound & c("bound_legacy"), "legacy searched"),
        ),
    }


def _evidence_rules(as_of: str) -> dict[str, Column]:
    c = F.col
    positive = registry.is_axis(c("axis")) & c("score").isin(1, 2)
    volatile = positive & F.coalesce(c("volatile"), F.lit(False))
    return {
        "V13": _details(_when(positive & ~urls.is_web_url(c("url")), c("url"))),
        "V14": _details(_when(positive & ~content.is_real_past_date(c("retrieved"), F.try_to_date(F.lit(as_of), "yyyy-MM-dd")), c("retrieved"))),
        "V15": _details(_when(volatile & (c("score") == 2)
                              & ~F.coalesce(c("check_method").isin(registry.REPLAYABLE_METHODS), F.lit(False)), c("url"))),
        "V16": _details(_when(volatile & content.is_blank(c("volatile_reason")), c("url"))),
        "V17": _details(_when(positive & ~content.is_sha256(c("sha256")), c("sha256"))),
        "V19": _details(_when(positive & (c("score") == 2) & urls.is_mutable_ref(c("url")), c("url"))),
    }


CELL_RULES = ["V4", "V6", "V9", "V10", "V11", "V20", "V21", "V22", "V23", "V24", "V25", "V26", "V27", "V28"]
EVIDENCE_RULES = ["V13", "V14", "V15", "V16", "V17", "V19"]


def _apply_row_rules(df: DataFrame, rules: dict[str, Column], wanted: list[str]) -> DataFrame:
    """All wanted one-row rules in one pass: an array of findings per row, then exploded."""
    def tagged(rule: str) -> Column:
        return F.transform(rules[rule], lambda d: F.struct(F.lit(rule).alias("rule"), d.alias("detail")))

    found = F.flatten(F.array(*[tagged(r) for r in wanted]))
    return df.select("subject", "axis", F.explode(found).alias("f")).select(
        F.col("f.rule").alias("rule"), F.col("subject").cast("string").alias("subject"), F.col("axis").cast("int").alias("axis"),
        F.col("f.detail").alias("detail"),
    )


def cell_violations(led: Ledger, wanted: list[str] | None = None) -> DataFrame:
    return _apply_row_rules(led.cells, _cell_rules(led.as_of), wanted or CELL_RULES)


def evidence_with_cell(led: Ledger) -> DataFrame:
    cells = led.cells.select("cell_no", "score", "has_check", "has_bound", "check_method", "bound_method")
    return led.evidence.select("cell_no", "subject", "axis", "pos", "url", "retrieved", "sha256", "volatile", "volatile_reason").join(cells, "cell_no")


def evidence_violations(led: Ledger, wanted: list[str] | None = None) -> DataFrame:
    return _apply_row_rules(evidence_with_cell(led), _evidence_rules(led.as_of), wanted or EVIDENCE_RULES)


for _name in CELL_RULES:
    if _name != "V28":
        register_rule(_name, lambda led, n=_name: cell_violations(led, [n]))
for _name in EVIDENCE_RULES:
    register_rule(_name, lambda led, n=_name: evidence_violations(led, [n]))


# --------------------------------------------------------------------------- set rules

def _axis_cells(led: Ledger) -> DataFrame:
    return led.cells.filter(registry.is_axis(F.col("axis")))


@_rule("V1")
def undeclared_axis_source(led: Ledger) -> DataFrame:
    used = led.policy.filter("key = 'axis_sources' and value is not null").select("subject", "axis", F.col("value").alias("source"))
    bare = used.join(led.sources, ["subject", "source"], "left_anti").join(led.warrants, ["subject", "source"], "left_anti")
    return violations(bare, "V1", "subject", "axis", "source")


def _superseded_known(led: Ledger) -> tuple[DataFrame, DataFrame]:
    axis_sources = led.policy.filter("key = 'axis_sources'").select("subject", F.col("value").alias("address"))
    addresses = led.sources.select("subject", F.col("source").alias("address")).unionByName(axis_sources)
    return (
        led.superseded.join(addresses, ["subject", "address"], "left_semi"),
        led.superseded.join(addresses, ["subject", "address"], "left_anti"),
    )


@_rule("V2")
def superseded_names_nothing(led: Ledger) -> DataFrame:
    return violations(_superseded_known(led)[1], "V2", "subject", None, "address")


@_rule("V3")
def draws_on_superseded(led: Ledger) -> DataFrame:
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(g).alias("g")) for a, g, _, _ in registry.AXES])
    affected = _superseded_known(led)[0].select(
        "subject", "address", "still_valid_for", "grp", F.explode(axes).alias("ax")
    ).filter((F.col("ax.g") == F.col("grp")) & ~F.array_contains("still_valid_for", F.col("ax.axis"))).select(
        "subject", "address", F.col("ax.axis").alias("axis")
    )
    per_axis = led.policy.filter("key = 'axis_sources' and value is not null").select("subject", "axis", F.col("value").alias("address"))
    direct = affected.join(per_axis, ["subject", "axis", "address"], "left_semi")
    fallback = affected.join(per_axis.select("subject", "axis"), ["subject", "axis"], "left_anti").join(
        led.sources.select("subject", F.col("source").alias("address")), ["subject", "address"], "left_semi"
    )
    return violations(direct.unionByName(fallback), "V3", "subject", "axis", "address")


@_rule("V5")
def duplicate_subject(led: Ledger) -> DataFrame:
    twice = led.subjects.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return violations(twice, "V5", "subject", None, "n")


@_rule("V7")
def undeclared_subject(led: Ledger) -> DataFrame:
    stray = _axis_cells(led).select("subject", "axis", "cell_no").join(led.subjects.select("subject"), "subject", "left_anti")
    return violations(stray, "V7", "subject", "axis", "cell_no")


@_rule("V8")
def duplicate_cell(led: Ledger) -> DataFrame:
    """One row for every later cell of a pair, naming it and the one before it.

    Only cells of pairs that occur twice are put in order; a cell meets its predecessor by its ordinal.
    """
    cells = _axis_cells(led).select("subject", "axis", "cell_no")
    twice = cells.groupBy("subject", "axis").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    placed = ordinals(cells.join(twice, ["subject", "axis"], "left_semi"), F.asc("subject"), F.asc("axis"), F.asc("cell_no"), out="at")
    before = placed.select("subject", "axis", (F.col("at") + 1).alias("at"), F.col("cell_no").alias("before"))
    later = placed.join(before, ["subject", "axis", "at"])
    return violations(later, "V8", "subject", "axis", F.concat_ws(" ", F.col("cell_no").cast("string"), F.lit("after"), F.col("before").cast("string")))


@_rule("V12")
def positive_without_evidence(led: Ledger) -> DataFrame:
    positive = _axis_cells(led).filter(F.col("score").isin(1, 2)).select("cell_no", "subject", "axis", "score")
    return violations(positive.join(led.evidence.select("cell_no"), "cell_no", "left_anti"), "V12", "subject", "axis", "score")


@_rule("V18")
def above_cap(led: Ledger) -> DataFrame:
    kinds = led.subjects.groupBy("subject").agg(F.min("kind").alias("kind"))
    scored = _axis_cells(led).filter(F.col("score").isin(1, 2)).select("subject", "axis", "score").join(kinds, "subject", "left")
    cap = registry.max_for(F.col("axis"), F.col("kind"))
    return violations(scored.withColumn("cap", cap).filter("score > cap"), "V18", "subject", "axis", F.concat_ws(">", F.col("score").cast("string"), F.col("cap").cast("string")))


@_rule("V28")
def bound_locations(led: Ledger) -> DataFrame:
    bounded = _axis_cells(led).filter(F.col("score").isin(0, 1, 2) & F.col("has_bound"))
    cited = led.evidence.select("cell_no", "url")

    def listed(column: str) -> DataFrame:
        return bounded.select("cell_no", "subject", "axis", F.explode(F.array_distinct(column)).alias("url"))

    no_record = listed("bound_archived").join(cited, ["cell_no", "url"], "left_anti").withColumn("d", F.concat(F.lit("not archived: "), F.col("url")))
    both = listed("bound_live").join(cited, ["cell_no", "url"], "left_semi").withColumn("d", F.concat(F.lit("live and archived: "), F.col("url")))
    bare = bounded.select("cell_no", "subject", "axis").join(cited.select("cell_no"), "cell_no", "left_anti").withColumn("d", F.lit("no evidence"))
    parts = [violations(p, "V28", "subject", "axis", "d") for p in (no_record, both, bare)]
    return reduce(DataFrame.unionByName, parts, cell_violations(led, ["V28"]))


def broken_dependency(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Every (key, value) of a key with more than one value; values are rows, no set is held."""
    values = pairs.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n_rows"))
    broken = values.groupBy(key).agg(F.count(F.lit(1)).alias("n_values")).filter("n_values > 1")
    return values.join(broken, key)


@_rule("V29")
def url_two_digests(led: Ledger) -> DataFrame:
    return violations(broken_dependency(led.cited, "url", "sha256"), "V29", None, None, F.concat_ws(" ", "url", "sha256"))


@_rule("V30")
def digest_two_urls(led: Ledger) -> DataFrame:
    return violations(broken_dependency(led.cited, "sha256", "url"), "V30", None, None, F.concat_ws(" ", "sha256", "url"))


def _scored(led: Ledger) -> DataFrame:
    return led.cells.filter(F.col("score") != 0)


@_rule("V31")
def no_sources(led: Ledger) -> DataFrame:
    bare = _scored(led).select("subject", "axis", "score").join(led.sources.select("subject"), "subject", "left_anti")
    return violations(bare, "V31", "subject", "axis", "score")


def undeclared_evidence(led: Ledger) -> DataFrame:
    """Distinct (subject, axis, source) cited outside the subject's declared sources."""
    return (
        evidence_with_cell(led).filter(F.col("score") != 0)
        .select("subject", "axis", urls.source_key(F.col("url")).alias("source")).distinct()
        .join(led.sources.select("subject"), "subject", "left_semi")
        .join(led.sources, ["subject", "source"], "left_anti")
    )


def foreign_owners(led: Ledger) -> DataFrame:
    """``source, owner``: who declares each source that somebody else cites; once per source, not once per use."""
    cited = undeclared_evidence(led).select("source").distinct()
    return led.sources.select("source", F.col("subject").alias("owner")).distinct().join(cited, "source", "left_semi")


@_rule("V32")
def foreign_source(led: Ledger) -> DataFrame:
    """Each use names the first owner of its source and how many more there are; ``foreign_uses`` names them all."""
    owners = led.sources.select("source", "subject").distinct().groupBy("source").agg(F.min("subject").alias("owner"), F.count(F.lit(1)).alias("n_owners"))
    more = F.when(F.col("n_owners") > 1, F.concat(F.lit(" and "), (F.col("n_owners") - 1).cast("string"), F.lit(" more")))
    named = F.concat(F.lit(" of "), F.col("owner").cast("string"), F.coalesce(more, F.lit("")))
    detail = F.concat(F.col("source"), F.coalesce(named, F.lit("")))
    return violations(undeclared_evidence(led).join(owners, "source", "left"), "V32", "subject", "axis", detail)


DEAL, BLOCK = 10_000, 512
TASK_OWNERS, TASK_ROWS = 8_000, 1_000_000


def foreign_uses(led: Ledger) -> DataFrame:
    """V32 with a row for every owner of the source of each use; a use of a source that nobody declares has one row.

    A source's uses are dealt into parts of about ``DEAL``, its owners come in blocks of ``BLOCK``, and each part meets each block, so a widely
    cited or declared source spreads over tasks.  The rows of a part and a block follow one another, the same owners in the same order for each
    use: files with dictionaries keep them in a fraction of a byte a row (a multiple of 8, so repeats fall on whole bytes).
    A task gets about ``TASK_ROWS`` rows, or more where ``TASK_OWNERS`` owners have more.
    """
    used = cut_lineage(undeclared_evidence(led))
    owners = led.sources.select("source", F.col("subject").alias("owner")).distinct().join(used.select("source").distinct(), "source", "left_semi")
    owners = ordinals(owners, F.asc("source"), F.asc("owner"), out="at")
    n_uses = used.groupBy("source").agg(F.count(F.lit(1)).alias("n_uses"))
    n_owners = owners.groupBy("source").agg(F.count(F.lit(1)).alias("n_owners"), F.min("at").alias("first"))
    n_tiles = {"n_parts": F.ceil(F.col("n_uses") / DEAL), "n_blocks": F.ceil(F.col("n_owners") / BLOCK)}
    counts = cut_lineage(n_uses.join(n_owners, "source").withColumns(n_tiles))
    tasks = F.least(F.col("n_parts") / TASK_OWNERS * F.col("n_owners"), F.col("n_uses") / TASK_ROWS * F.col("n_owners"))
    n_tasks = counts.agg(F.ceil(F.sum(tasks))).first()[0] or 1

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    part, block = F.pmod(F.xxhash64("subject", "axis"), F.col("n_parts")), F.floor((F.col("at") - F.col("first")) / BLOCK)
    detail = F.concat(F.col("source"), F.coalesce(F.concat(F.lit(" of "), F.col("owner").cast("string")), F.lit("")))
    tile = ["source", "part", "block"]
    uses = used.join(counts, "source").select("source", F.col("subject").cast("string"), "axis", part.alias("part"), each("n_blocks").alias("block"))
    blocks = owners.join(counts, "source").groupBy("source", "n_parts", block.alias("block")).agg(F.collect_list(detail).alias("details"))
    blocks = blocks.select("source", each("n_parts").alias("part"), "block", "details")
    # merged, so that the rows of a tile stay together, in tasks that are counted here: adaptive execution would join them by their few bytes
    met = uses.repartition(n_tasks, *tile).hint("merge").join(blocks.repartition(n_tasks, *tile), tile)
    named = violations(met.select("subject", "axis", F.explode("details").alias("detail")), "V32", "subject", "axis", "detail")
    return named.unionByName(violations(used.join(counts, "source", "left_anti"), "V32", "subject", "axis", "source"))


@_rule("V33")
def missing_pair(led: Ledger) -> DataFrame:
    """Every subject x axis must exist: axes present are a bit mask per subject, no cross join."""
    present = _axis_cells(led).groupBy("subject").agg(F.bit_or(F.expr("shiftleft(1, axis)")).alias("mask"))
    declared = led.subjects.select("subject").distinct().join(present, "subject", "left")
    every = F.array(*[F.lit(a) for a in registry.AXIS_IDS])
    mask = F.coalesce(F.col("mask"), F.lit(0))
    absent = declared.select("subject", F.explode(F.filter(every, lambda a: mask.bitwiseAND(F.call_function("shiftleft", F.lit(1), a)) == 0)).alias("axis"))
    return violations(absent, "V33", "subject", "axis", registry.axis_name(F.col("axis")))


@_rule("V34")
def bounded_zeros_fell(led: Ledger) -> DataFrame:
    counts = led.cells.filter("score = 0").agg(F.count(F.lit(1)).alias("zeros"), F.count_if("has_bound").alias("bounded"))
    floor = led.bounded_zero_floor if isinstance(led.bounded_zero_floor, Column) else F.lit(led.bounded_zero_floor)
    fell = counts.withColumn("floor", floor).filter("bounded < floor")
    detail = F.concat_ws(" ", F.col("bounded").cast("string"), F.lit("of"), F.col("zeros").cast("string"), F.lit("floor"), F.col("floor").cast("string"))
    return violations(fell, "V34", None, None, detail)


@_rule("V37")
def determined_yet_positive(led: Ledger) -> DataFrame:
    kinds = led.subjects.groupBy("subject").agg(F.min("kind").alias("kind"))
    cond = reduce(lambda a, b: a | b, [(F.col("axis") == a) & (F.col("kind") == k) for a, k in registry.DETERMINED])
    axes = [a for a, _ in registry.DETERMINED]
    hit = led.cells.filter(F.col("axis").isin(axes) & (F.col("score") > 0)).select("subject", "axis", "score").join(kinds, "subject").filter(cond)
    return violations(hit, "V37", "subject", "axis", "score")


@_rule("V39")
def unknown_subject_field(led: Ledger) -> DataFrame:
    known = F.array(*[F.lit(f) for f in registry.SUBJECT_FIELDS])
    extra = led.records.select("subject", F.explode(F.array_except(F.json_object_keys("record"), known)).alias("field"))
    return violations(extra, "V39", "subject", None, "field")


@_rule("V40")
def two_volatility_flags(led: Ledger) -> DataFrame:
    flags = led.evidence.select("url", F.coalesce(F.col("volatile").cast("string"), F.lit("None")).alias("flag"))
    return violations(broken_dependency(flags, "url", "flag"), "V40", None, None, F.concat_ws(" ", "url", "flag"))


# ------------------------------------------------------------------------ whole ledger

def ledger_date(led: Ledger) -> DataFrame:
    """V4 on the ledger's own date: one row when it has not the shape of a date; an empty one is none."""
    row = led.subjects.agg(F.lit(led.as_of).alias("as_of"))
    return violations(row.filter(~content.is_absent(F.col("as_of"), "text") & ~content.is_iso_date(F.col("as_of"))), "V4", None, None, "as_of")


def validate(led: Ledger) -> DataFrame:
    """Every violation of every registered rule and of the ownership policy; one-row rules share one pass."""
    from veriledger.operators import ownership  # which itself builds on this module

    shared = set(CELL_RULES + EVIDENCE_RULES) - {"V28"}
    parts = [cell_violations(led, [r for r in CELL_RULES if r != "V28"]), evidence_violations(led), ledger_date(led), ownership.foreign_evidence(led)]
    parts += [fn(led) for name, fn in RULES.items() if name not in shared]
    return reduce(DataFrame.unionByName, parts)


def report(found: DataFrame, n: int) -> DataFrame:
    """For display: the first ``n`` defects in a stable order (a top-k, never a full sort)."""
    return found.orderBy("rule", "subject", "axis", "detail").limit(n)


def scoreable(found: DataFrame) -> bool:
    """Any defect at all means that nothing may be scored."""
    return found.isEmpty()
