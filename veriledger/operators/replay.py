"""Replay from end to end: gate, the method's own check over archived bytes, verdicts by cell, summary.

``EXECUTORS`` maps a method to a check frame: given the cells that settle by it, their evidence and the store, it returns
``(cell_no, verdict, reason)``, where a null verdict means that the bytes are not there to read.  Verdicts are three-valued
throughout: a cell fails if the gate or its check refuses it, passes if both accept it, and is unreplayable otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledger.functions import urls
from veriledger.operators import content_checks, ownership, probes
from veriledger.operators.validation import Ledger
from veriledger.session import cut_lineage

Executor = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
EXECUTORS: dict[str, Executor] = {}
POSITIVE, ASSERTED, BOUNDED = "positive", "asserted", "bounded negative"


def executor(method: str):
    """Register the check frame of a method; users add their own the same way."""
    def register(fn: Executor) -> Executor:
        EXECUTORS[method] = fn
        return fn

    return register


def _field(name: str, kind: str = "string") -> Column:
    value = F.try_element_at("fields", F.lit(name))
    return value if kind == "string" else value.try_cast(kind)


def _settled(led: Ledger) -> DataFrame:
    """``cell_no, method, fields, literals`` of the block that each cell asserts."""
    literals = F.when(F.col("has_bound"), F.from_json(F.try_element_at("bound_fields", F.lit("expect")), "array<string>")).otherwise(F.col("check_expect"))
    return led.cells.where("has_check or has_bound").select(
        "cell_no", ownership.asserted_method().alias("method"), ownership.asserted_fields().alias("fields"), literals.alias("literals"))


def _cited(cells: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of the cells; columns that a ledger does not record are null."""
    more = [F.col(c) if c in evidence.columns else F.lit(None).cast("string").alias(c) for c in ("range", "pinned_commit")]
    return evidence.select("cell_no", "url", "sha256", *more).join(cells.select("cell_no"), "cell_no", "left_semi")


def _every(cells: DataFrame, found: DataFrame, otherwise: str) -> DataFrame:
    """A row for each cell; one that the check could not even begin fails for that reason."""
    joined = cells.select("cell_no").join(found.select("cell_no", "verdict", "reason", F.lit(True).alias("_found")), "cell_no", "left")
    begun = F.coalesce("_found", F.lit(False))
    return joined.select("cell_no", F.when(begun, F.col("verdict")).otherwise(False).alias("verdict"), F.when(begun, F.col("reason")).otherwise(otherwise).alias("reason"))


@executor("grep_retrieved")
def grep(cells: DataFrame, evidence: DataFrame, store: DataFrame) -> DataFrame:
    checks = cells.select(F.col("cell_no").alias("cell"), "literals", _field("expect_artifacts", "bigint").alias("expect_artifacts"))
    cites = _cited(cells, evidence).select(F.col("cell_no").alias("cell"), "sha256")
    return content_checks.grep_all_in_one(checks, cites, store).select(F.col("cell").alias("cell_no"), "verdict", "reason")


@executor("count_in_retrieved")
def count(cells: DataFrame, evidence: DataFrame, store: DataFrame) -> DataFrame:
    checks = cells.select(F.col("cell_no").alias("cell"), "literals", _field("expect_count", "bigint").alias("expect_count"))
    cites = _cited(cells, evidence).select(F.col("cell_no").alias("cell"), "sha256")
    found = content_checks.count_in_retrieved(checks, cites, store)
    return found.select(F.col("cell").alias("cell_no"), "verdict", F.when(~F.col("verdict"), "count differs").alias("reason"))


@executor("http_range")
def ranges(cells: DataFrame, evidence: DataFrame, store: DataFrame) -> DataFrame:
    cited = _cited(cells, evidence).join(cells.select("cell_no", "fields"), "cell_no")
    spec = _field("enumeration")
    ranged = cited.where("range is not null").select(
        F.col("cell_no").alias("cell"), "url", "range", "sha256", _field("enumerated_index", "int").alias("index"))
    listings = cited.where("range is null").select(
        F.col("cell_no").alias("cell"), F.coalesce(F.try_variant_get(F.try_parse_json(spec), "$.kind", "string"), spec).alias("kind"),
        F.try_variant_get(F.try_parse_json(spec), "$.base", "string").alias("base"), "sha256")
    found = content_checks.range_check(ranged, listings, store).select(F.col("cell").alias("cell_no"), "verdict", "reason")
    return _every(cells, found, "no ranged artifact")


@executor("hf_probe.weight_object")
def weights(cells: DataFrame, evidence: DataFrame, store: DataFrame) -> DataFrame:
    cited = _cited(cells, evidence)
    ranged = cited.where("range is not null").groupBy("cell_no").agg(
        F.count(F.lit(1)).alias("n_ranged"), F.min(F.struct("url", "range", "sha256", "pinned_commit")).alias("r"))
    listed = cited.where("range is null").where(urls.parse_pinned_url(F.col("url"))["shape"] == "model_revision")
    listed = listed.groupBy("cell_no").agg(F.min(F.struct("url", "sha256")).alias("l"))
    rows = cells.join(ranged, "cell_no").join(listed, "cell_no").select(
        F.col("cell_no").alias("cell"), _field("expect_repo").alias("subject_repo"), "n_ranged", "r.url", "r.range", "r.sha256", "r.pinned_commit",
        F.col("l.url").alias("listing_url"), F.col("l.sha256").alias("listing_sha256"), _field("expect_file").alias("expect_file"),
        _field("expect_range_bytes", "bigint").alias("expect_range_bytes"), _field("expect_evidence_sha256").alias("expect_evidence_sha256"))
    found = content_checks.weight_object(rows, store).select(F.col("cell").alias("cell_no"), "verdict", "reason")
    return _every(cells, found, "not a range beside its enumeration")


TREE_URL = r"^https://api\.github\.com/repos/([^/]+/[^/]+)/git/trees/([0-9a-f]{40})(?:\?.*)?$"


@executor("repo_tree_probe")
def tree(cells: DataFrame, evidence: DataFrame, store: DataFrame) -> DataFrame:
    cited = _cited(cells, evidence).where(F.col("url").rlike(TREE_URL)).groupBy("cell_no").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("url", "sha256")).alias("t"))
    rows = cells.join(cited, "cell_no").select(
        "cell_no", "n", "t.sha256", F.regexp_extract("t.url", TREE_URL, 1).alias("repo"), F.regexp_extract("t.url", TREE_URL, 2).alias("at"), "fields")
    want = probes.arg_of(paths=_field("expect_paths"), manifest=_field("expect_manifest"))
    answers = probes.measure(probes.probe(rows, "tree", "sha256", want), store, ["tree"])
    read = probes.answered(rows, answers, "tree", "sha256", want, "tree")
    reason = (
        F.when(F.col("n") != 1, "not one tree").when(~F.col("repo").eqNullSafe(_field("expect_repo")), "other repository")
        .when(~F.col("at").eqNullSafe(_field("expect_commit")), "other commit")
        .when(~F.col("sha256").eqNullSafe(_field("expect_evidence_sha256")), "other evidence")
    )
    unread = reason.isNull() & ~F.col("tree_read")
    reason = F.coalesce(reason, F.col("tree_text"))
    found = read.select("cell_no", F.when(~unread, reason.isNull()).alias("verdict"), F.when(unread, "not archived").otherwise(reason).alias("reason"))
    return _every(cells, found, "not one tree")


def executed(cells: DataFrame, evidence: DataFrame, store: DataFrame, executors: dict[str, Executor] | None = None) -> DataFrame:
    """``cell_no, verdict, reason`` of ``cells(cell_no, method, fields, literals)``; no verdict where no executor is registered."""
    executors = EXECUTORS if executors is None else executors
    parts = [fn(cells.where(F.col("method") == method), evidence, store).select("cell_no", "verdict", "reason") for method, fn in executors.items()]
    other = cells.where(~F.coalesce(F.col("method").isin(list(executors)), F.lit(False)))
    return reduce(DataFrame.unionByName, parts, other.select("cell_no", F.lit(None).cast("boolean").alias("verdict"), F.lit("no check frame").alias("reason")))


def replay(led: Ledger, store: DataFrame, executors: dict[str, Executor] | None = None) -> DataFrame:
    """``cell_no, subject, axis, class, verdict, reason``: every scored cell above zero once, every bounded cell once more.

    Cells scored 1 assert and are not executed; a positive and a bounded cell are executed when the gate lets them through.
    """
    gated = cut_lineage(ownership.gate(led))
    bounded = led.cells.where("has_bound").select("cell_no", F.lit(True).alias("bounded"))
    gated = gated.join(bounded, "cell_no", "left").withColumn("bounded", F.coalesce("bounded", F.lit(False)))
    live = gated.where("verdict <> 'fail'").where((F.col("verdict") == "execute") | F.col("bounded")).select("cell_no")
    done = executed(_settled(led).join(live, "cell_no", "left_semi"), led.evidence, store, executors)
    done = done.select("cell_no", F.col("verdict").alias("ran"), F.col("reason").alias("why"))
    scored = F.coalesce(F.col("score") != 0, F.lit(False))
    classes = F.filter(F.array(F.when(scored & (F.col("score") == 1), ASSERTED), F.when(scored & (F.col("score") != 1), POSITIVE), F.when(F.col("bounded"), BOUNDED)), lambda c: c.isNotNull())
    rows = gated.join(done, "cell_no", "left").withColumn("class", F.explode(classes))
    refused, asserted = F.col("verdict") == "fail", F.col("class") == ASSERTED
    return rows.select(
        "cell_no", "subject", "axis", "class", F.when(refused, False).when(asserted, True).otherwise(F.col("ran")).alias("verdict"),
        F.when(refused, F.col("reason")).when(~asserted, F.col("why")).alias("reason"))


def summary(verdicts: DataFrame, cells: DataFrame) -> DataFrame:
    """``class, passed, failed, unreplayable, n, coverage_pct``; coverage: the share of zeros that carry a bound, for bounded negatives."""
    zeros = cells.where("score = 0").agg(F.count(F.lit(1)).alias("z"), F.count_if("has_bound").alias("b"))
    share = zeros.select(F.round(F.try_divide(F.col("b") * 100.0, F.col("z")), 1)).scalar()
    counted = content_checks.replay_summary(verdicts.select("class", "verdict"))
    return counted.withColumn("coverage_pct", F.when(F.col("class") == BOUNDED, share))
