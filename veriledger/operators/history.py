"""Selection frames and run history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledger.functions.digests import SEGMENT_ROWS, segment_hashes
from veriledger.functions.ranking import global_rank, ordinals

RUN_FIELDS = ["round", "controls_total", "watched", "never_executes", "source_fingerprint", "inputs_fingerprint"]
ROW_FIELDS = ["round", "controls_total", "watched", "never_executes"]


def rank_check(frame: DataFrame, claims: DataFrame, value: str, row_id: str) -> DataFrame:
    """Position of every claimed row in the ranked frame against the claim (absent = null)."""
    ranked = global_rank(frame.select(value, row_id), value, row_id).select(F.col(row_id).alias("id"), "rank")
    return claims.join(ranked, "id", "left").select("id", "claimed", "rank", F.col("claimed").eqNullSafe(F.col("rank")).alias("agrees"))


def first_per_org_topk(frame: DataFrame, org: str, value: str, row_id: str, k: int = 4) -> DataFrame:
    """First row of each organisation in rank order, then the first k of those."""
    best = frame.groupBy(org).agg(F.min(F.struct((-F.col(value)).alias("v"), F.col(row_id).alias("id"))).alias("b"))
    return best.select(F.col(org).alias("org"), "b.id", "b.v").orderBy("v", "id").limit(k).select("org", "id")


def selected_overlap(selected: DataFrame, claimed: DataFrame) -> DataFrame:
    """Rows the literal rule selects although they were claimed (must be empty)."""
    return selected.join(claimed.select("id"), "id", "left_semi")


def shared_signer(commits: DataFrame) -> DataFrame:
    """Distinct signing keys against signed subjects."""
    signed = commits.filter("fingerprint is not null")
    return signed.agg(F.countDistinct("fingerprint").alias("n_keys"), F.countDistinct("subject").alias("n_subjects")).withColumn(
        "shared", F.col("n_keys") < F.col("n_subjects")
    )


def _previous(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Each run next to its predecessor by ordinal: an equi-join, not an ordered window."""
    before = runs.select((F.col("run") + 1).alias("run"), F.lit(True).alias("has_prev"), *[F.col(c).alias(f"prev_{c}") for c in columns])
    return runs.join(before, "run", "left")


def _same(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"prev_{c}")) for c in columns])


def run_history(runs: DataFrame, fields: list[str] = RUN_FIELDS) -> DataFrame:
    """Runs with consecutive repeats collapsed and renumbered; ``run`` is the dense input ordinal."""
    kept = _previous(runs, fields).filter(F.col("has_prev").isNull() | ~_same(fields)).select(*runs.columns)
    return ordinals(kept, F.asc("run"), out="ordinal")


def previous_round(runs: DataFrame) -> DataFrame:
    """For every round: the last run of the latest earlier round (null when there is none).

    Runs are reduced to one row per round, rounds get exact ordinals, and a round meets the one before by an equi-join.
    """
    last = ordinals(runs.groupBy("round").agg(F.max("run").alias("last_run")), F.asc_nulls_first("round"), out="at")
    before = last.select((F.col("at") + 1).alias("at"), F.col("round").alias("previous_round"), F.col("last_run").alias("previous_run"))
    return last.join(before, "at", "left").select("round", "previous_round", "previous_run")


def history_anomalies(runs: DataFrame) -> DataFrame:
    """Runs measured over less than half of the current total, and runs where the total fell."""
    current = runs.agg(F.max_by("controls_total", "run")).scalar()
    marked = _previous(runs.select("run", "controls_total"), ["controls_total"])
    narrow = F.col("controls_total") < F.floor(current / 2)
    fell = F.coalesce(F.col("controls_total") < F.col("prev_controls_total"), F.lit(False))
    return marked.select("run", "controls_total", narrow.alias("narrow"), fell.alias("fell")).filter("narrow or fell")


def inputs_manifest_diff(here: DataFrame, there: DataFrame) -> DataFrame:
    """``(name, digest)`` manifests: same, differing, only here, only there."""
    joined = here.select("name", F.col("digest").alias("h")).join(there.select("name", F.col("digest").alias("t")), "name", "full_outer")
    status = (
        F.when(F.col("t").isNull(), "only here").when(F.col("h").isNull(), "only there")
        .when(F.col("h") == F.col("t"), "same").otherwise("differing")
    )
    return joined.select("name", status.alias("status"))


def multiset_diff(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows (with multiplicity) that only one side has."""
    columns = stored.columns
    counted = stored.withColumn("_d", F.lit(1)).unionByName(recomputed.withColumn("_d", F.lit(-1)))
    net = counted.groupBy(*columns).agg(F.sum("_d").alias("_d")).filter("_d <> 0")
    return net.select(
        F.when(F.col("_d") > 0, "stored").otherwise("recomputed").alias("only_in"), *columns, F.abs("_d").alias("n")
    )


def segment_agreement(stored: DataFrame, recomputed: DataFrame, fields: list[str] = RUN_FIELDS, span: int = SEGMENT_ROWS) -> DataFrame:
    """``segment, n_stored, n_recomputed, agrees, prefix_agrees``: the stored history against the recomputed one, range by range.

    Rows are compared by an order-sensitive hash of each range of ``span`` ordinals; recomputed rows after the last stored one
    are what the history may gain.  ``prefix_agrees``: this range and all before it agree.
    """
    last = stored.agg(F.max("run")).scalar()
    theirs = segment_hashes(recomputed.where(F.col("run") <= last), "run", ["run", *fields], span)
    mine = segment_hashes(stored, "run", ["run", *fields], span)
    theirs = theirs.select("segment", F.col("n").alias("n_recomputed"), F.col("h0").alias("t0"), F.col("h1").alias("t1"))
    both = mine.join(theirs, "segment", "full_outer")
    agrees = (F.col("n") == F.col("n_recomputed")) & (F.col("h0") == F.col("t0")) & (F.col("h1") == F.col("t1"))
    both = both.select("segment", F.coalesce("n", F.lit(0)).alias("n_stored"), F.coalesce("n_recomputed", F.lit(0)).alias("n_recomputed"),
                       F.coalesce(agrees, F.lit(False)).alias("agrees"))
    bad = both.agg(F.min(F.when(~F.col("agrees"), F.col("segment")))).scalar()
    return both.select("segment", "n_stored", "n_recomputed", "agrees", (bad.isNull() | (F.col("segment") < bad)).alias("prefix_agrees"))


def append_only_check(stored: DataFrame, recomputed: DataFrame, predecessor: DataFrame, fields: list[str] = RUN_FIELDS, span: int = SEGMENT_ROWS) -> DataFrame:
    """The stored history must be an unchanged prefix; its predecessor must be one of its rows.

    Ranges whose hashes agree are done; only the rows of the others are shuffled and compared.
    ``predecessor`` holds the row the record names as the one before (may be empty).
    """
    suspect = segment_agreement(stored, recomputed, fields, span).where("not agrees").select("segment")

    def of_suspects(rows: DataFrame) -> DataFrame:
        return rows.withColumn("segment", F.floor(F.col("run") / span)).join(suspect, "segment", "left_semi").drop("segment")

    new = of_suspects(recomputed).select("run", F.lit(True).alias("has_prev"), *[F.col(c).alias(f"prev_{c}") for c in fields])
    joined = of_suspects(stored).join(new, "run", "left")
    changed = joined.filter(F.col("has_prev").isNotNull() & ~_same(fields)).select(F.lit("row changed").alias("why"), "run")
    lost = joined.filter("has_prev is null").select(F.lit("row lost").alias("why"), "run")
    missing = reduce(lambda a, b: a & b, [predecessor[c].eqNullSafe(stored[c]) for c in ROW_FIELDS])
    orphan = predecessor.join(stored, missing, "left_anti").select(F.lit("predecessor not in history").alias("why"), F.col("run"))
    return changed.unionByName(lost).unionByName(orphan)


def partition_check(counts: DataFrame, totals: DataFrame, parts: list[str]) -> DataFrame:
    """Per group: category counts must sum to the total, and the named parts must equal it too.

    ``counts(grp, category, n)``, ``totals(grp, total)``.
    """
    sums = counts.groupBy("grp").agg(
        F.sum("n").alias("summed"), F.coalesce(F.sum(F.when(F.col("category").isin(parts), F.col("n"))), F.lit(0)).alias("parts")
    )
    return totals.join(sums, "grp", "left").select(
        "grp", "total", F.coalesce("summed", F.lit(0)).alias("summed"), F.coalesce("parts", F.lit(0)).alias("parts")
    ).withColumns({"is_partition": F.col("summed") == F.col("total"), "parts_cover": F.col("parts") == F.col("total")})
