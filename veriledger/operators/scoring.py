"""Scores with their mandatory sensitivity band, pivots and fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledger.functions.digests import close_digest, digest_sums, multiset_digest, row_digest
from veriledger.sources import registry


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def score(cells: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row per subject: as-coded, both N/A readings, ceiling and the counts behind them.

    Cells are aggregated before subjects are joined, so the join runs on one row per
    subject and reuses the partitioning of the aggregation.
    """
    s = F.col("score")
    live_axis = F.when(s.isNotNull(), F.col("axis"))
    ceilings = {"": F.lit(None).cast("string")} | {k: F.lit(k) for k in registry.STRATUM_MAX}
    totals = cells.groupBy("subject").agg(
        F.coalesce(F.sum(s), F.lit(0)).cast("long").alias("total"),
        F.count(s).alias("n_scored"),
        F.count_if(s.isNull()).alias("n_na"),
        F.count_if(s == 2).alias("n_2"),
        F.count_if(s == 1).alias("n_1"),
        F.count_if(s == 0).alias("n_0"),
        *[
            F.coalesce(F.sum(F.when(live_axis.isNotNull(), registry.max_for(live_axis, kind))), F.lit(0))
            .cast("long").alias(f"_ceiling_{name}")
            for name, kind in ceilings.items()
        ],
    )
    attainable = F.col("_ceiling_")
    for name in registry.STRATUM_MAX:
        attainable = F.when(F.col("kind").eqNullSafe(name), F.col(f"`_ceiling_{name}`")).otherwise(attainable)
    n_all = F.col("n_scored") + F.col("n_na")
    return totals.join(subjects.select("subject", "kind"), "subject", "left").select(
        "subject", "kind", "total", "n_scored", "n_na", "n_2", "n_1", "n_0",
        attainable.alias("attainable"),
        _ratio(F.col("total"), 2 * F.col("n_scored")).alias("as_coded"),
        _ratio(F.col("total"), 2 * n_all).alias("na_as_0"),
        _ratio(F.col("total") + 2 * F.col("n_na"), 2 * n_all).alias("na_as_2"),
        _ratio(attainable, 2 * F.col("n_scored")).alias("ceiling"),
    )


def by_subject(cells: DataFrame) -> DataFrame:
    """One row per subject, one column per axis (null = N/A or no cell)."""
    wide = cells.groupBy("subject").pivot("axis", registry.AXIS_IDS).agg(F.max("score"))
    return wide.select("subject", *[F.col(str(a)).alias(f"axis_{a}") for a in registry.AXIS_IDS])


def constant_axes(cells: DataFrame) -> DataFrame:
    """Axes that never vary over the cells where they apply."""
    return (
        cells.filter(F.col("score").isNotNull())
        .groupBy("axis")
        .agg(F.min("score").alias("value"), F.max("score").alias("_max"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("value") == F.col("_max"))
        .drop("_max")
    )


def dominates(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each ``(lo, hi)`` pair: axes where lo is below, strictly above, and comparable.

    At most one row per axis reaches a pair, so the collected axis lists are bounded by 22.
    """
    sides = pairs.select("lo", "hi", F.explode(F.array("lo", "hi")).alias("subject"))
    per_axis = (
        sides.join(cells.select("subject", "axis", "score"), "subject")
        .groupBy("lo", "hi", "axis")
        .agg(
            F.max(F.when(F.col("subject") == F.col("lo"), F.col("score"))).alias("a"),
            F.max(F.when(F.col("subject") == F.col("hi"), F.col("score"))).alias("b"),
        )
    )
    a, b = F.col("a"), F.col("b")

    def axes_where(cond: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("axis")))).cast("array<string>"), ",")

    return per_axis.groupBy("lo", "hi").agg(
        axes_where(a < b).alias("below"),
        axes_where(a > b).alias("strictly_above"),
        F.count_if(a.isNotNull() & b.isNotNull()).alias("n_comparable"),
    )


def ledger_fingerprint(cells: DataFrame, policy: DataFrame) -> DataFrame:
    """Fingerprint of every (subject, axis, score) and every policy row; one row out."""
    scored = cells.select(row_digest(F.lit("cell"), F.col("subject"), F.col("axis"), F.col("score")).alias("d"))
    declared = policy.select(
        row_digest(F.lit("policy"), F.col("subject"), F.col("axis"), F.col("key"), F.col("value")).alias("d")
    )
    return (
        scored.unionByName(declared)
        .agg(F.count(F.lit(1)).alias("n_rows"), *digest_sums(F.col("d")))
        .select("n_rows", close_digest(F.col("n_rows")).alias("fingerprint"))
    )


DIGEST_PARTS = {
    "cells": ["subject", "axis", "score"], "subjects": ["subject", "kind", "repo"], "sources": ["subject", "source"],
    "policy": ["subject", "axis", "key", "value"], "warrants": ["subject", "source", "document"],
    "superseded": ["subject", "address", "grp", "superseded_by", "still_valid_for"],
}


def digest_tree(led) -> DataFrame:
    """``level, subject, part, n_rows, digest`` of a ledger: root, each table, each subject, each subject's rows of a table.

    Row digests are summed per (subject, table) and the sums are folded upwards, so every level is a digest of all rows
    below it, whatever their order, and no level gathers rows.
    """
    parts = [
        getattr(led, part).select(F.col("subject").cast("string").alias("subject"), F.lit(part).alias("part"), row_digest(F.lit(part), *[F.col(c) for c in columns]).alias("d"))
        for part, columns in DIGEST_PARTS.items()
    ]
    leaves = reduce(DataFrame.unionByName, parts).groupBy("subject", "part").agg(F.count(F.lit(1)).alias("n"), *digest_sums(F.col("d")))
    folded = leaves.cube("subject", "part").agg(F.grouping_id().alias("g"), F.sum("n").alias("n_rows"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(8)])
    level = F.when(F.col("g") == 0, "rows").when(F.col("g") == 1, "subject").when(F.col("g") == 2, "table").otherwise("root")
    return folded.select(level.alias("level"), "subject", "part", "n_rows", close_digest(F.col("n_rows")).alias("digest"))


def ledger_diff(here: DataFrame, there: DataFrame) -> DataFrame:
    """``level, subject, part, change`` of the nodes in which two digest trees differ; equal ledgers give no row."""
    theirs = there.select("level", F.col("subject").alias("_s"), F.col("part").alias("_p"), F.col("digest").alias("_d"))
    mine = here.select(F.col("level").alias("_l"), "subject", "part", "digest")
    same = (F.col("_l") == F.col("level")) & F.col("subject").eqNullSafe(F.col("_s")) & F.col("part").eqNullSafe(F.col("_p"))
    change = F.when(F.col("_d").isNull(), "only here").when(F.col("digest").isNull(), "only there").when(F.col("digest") != F.col("_d"), "differing")
    both = mine.join(theirs, same, "full_outer").select(
        F.coalesce("_l", "level").alias("level"), F.coalesce("subject", "_s").alias("subject"), F.coalesce("part", "_p").alias("part"), change.alias("change"))
    return both.where("change is not null")


def cover_fingerprint(cited: DataFrame) -> DataFrame:
    """Fingerprint of the *set* of (url, digest) pairs: repeats and order do not matter."""
    pairs = cited.select("url", "sha256").distinct()
    return multiset_digest(pairs, F.col("url"), F.col("sha256"))


def score_band_spread(scores: DataFrame) -> DataFrame:
    return scores.select(
        "subject", "as_coded", "na_as_0", "na_as_2",
        (F.col("na_as_2") - F.col("na_as_0")).alias("spread"),
    )


def zero_coverage(cells: DataFrame) -> DataFrame:
    """How many zeros carry a replayable bound, and how many carry only a note."""
    zero = F.col("score") == 0
    noted = F.coalesce(F.trim(F.col("note")), F.lit("")) != ""
    return cells.agg(
        F.count_if(zero).alias("zeros"),
        F.count_if(zero & F.col("has_bound")).alias("bounded_zeros"),
        F.count_if(zero & ~F.col("has_bound") & noted).alias("unbounded_notes"),
    ).withColumn("pct_bounded", 100.0 * F.col("bounded_zeros") / F.greatest(F.lit(1), F.col("zeros")))


def caps_and_bridges(cells: DataFrame, subjects: DataFrame) -> DataFrame:
    """Per axis and stratum: cap, attainable points, permitted methods, requirement, determination."""
    axis, kind = F.col("axis"), F.col("kind")
    determined = F.lit(False)
    for a, k in registry.DETERMINED:
        determined = determined | ((axis == a) & (kind == k))
    permitted = F.lit(0)
    for method in registry.METHODS:
        permitted = permitted + registry.is_permitted(F.lit(method), axis).cast("int")
    return (
        cells.join(subjects.select("subject", "kind"), "subject")
        .groupBy("axis", "kind")
        .agg(F.count("score").alias("n_live"))
        .select(
            "axis", "kind", "n_live",
            registry.max_for(axis, kind).alias("max_score"),
            (F.col("n_live") * registry.max_for(axis, kind)).alias("attainable"),
            permitted.alias("n_methods"),
            registry.required_method(axis).alias("required_method"),
            F.size(registry.required_fields(registry.required_method(axis))).alias("n_required_fields"),
            F.coalesce(determined, F.lit(False)).alias("determined"),
        )
    )
