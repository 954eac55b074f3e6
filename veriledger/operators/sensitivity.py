"""How fragile an ordering is: order changes, weight sweeps, leave-k-out, correlation.

Fractions are compared exactly: with at most 22 scored axes ``total / n`` becomes the
integer ``total * (L / n)`` where L is the least common multiple of 1..22, so no
tolerance is needed.  Pair counts never enumerate pairs: subjects are first grouped by
their distinct score values (a bounded number), then counted with prefix sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriledger.sources import registry

UNIT = registry.SCORE_UNIT
KEY_BITS = 29  # 2 * UNIT < 2**29


def exact_key(total: Column, n: Column) -> Column:
    """Integer that orders exactly like total / n (0 when nothing is scored)."""
    return F.when(n > 0, total * (F.lit(UNIT) / n).cast("long")).otherwise(F.lit(0)).cast("long")


def score_keys(scores: DataFrame) -> DataFrame:
    """Exact keys of the readings that the order tests compare."""
    n_all = F.col("n_scored") + F.col("n_na")
    return scores.select(
        "subject", "kind",
        exact_key(F.col("total"), F.col("n_scored")).alias("as_coded"),
        exact_key(F.col("total"), n_all).alias("na_as_0"),
        exact_key(F.col("total") + 2 * F.col("n_na"), n_all).alias("na_as_2"),
        exact_key(2 * (F.col("n_2") + F.col("n_1")), F.col("n_scored")).alias("collapsed"),
    )


def claimed_collapse(scores: DataFrame) -> DataFrame:
    """Every score of 1 read as 2: per-subject movement and who does not move."""
    base = F.when(F.col("n_scored") > 0, F.col("total") / (2 * F.col("n_scored"))).otherwise(0.0)
    moved = F.when(F.col("n_scored") > 0, F.col("n_1") / (2 * F.col("n_scored"))).otherwise(0.0)
    return scores.select(
        "subject", base.alias("base"), (base + moved).alias("collapsed"), moved.alias("movement"),
        (F.col("n_1") == 0).alias("unmoved"),
    )


def _pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def _grouped(keys: DataFrame, base: str, test: str) -> DataFrame:
    return keys.groupBy(F.col(base).alias("x"), F.col(test).alias("y")).agg(F.count(F.lit(1)).alias("w"))


def discordant_pairs(groups: DataFrame) -> DataFrame:
    """Number of pairs with x < x' and y > y' among weighted ``(x, y, w)`` rows.

    Two different y values first differ at exactly one bit; below a shared prefix the
    larger has a 1 there and the smaller a 0.  So each pair is counted once, by a
    running sum over x inside its (bit, prefix) node; a node holds at most one row per
    distinct x.
    """
    bits = groups.select("x", "y", "w", F.explode(F.sequence(F.lit(0), F.lit(KEY_BITS - 1))).alias("bit"))
    is_one = F.expr("shiftright(y, bit) & 1") == 1
    nodes = bits.groupBy("bit", F.expr("shiftright(y, bit + 1)").alias("prefix"), "x").agg(
        F.coalesce(F.sum(F.when(is_one, F.col("w"))), F.lit(0)).alias("ones"),
        F.coalesce(F.sum(F.when(~is_one, F.col("w"))), F.lit(0)).alias("zeros"),
    )
    before = Window.partitionBy("bit", "prefix").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.select(
        (F.col("zeros") * F.coalesce(F.sum("ones").over(before), F.lit(0))).alias("n")
    ).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reversed"))


def strict_inversions(keys: DataFrame, base: str, test: str) -> DataFrame:
    """Pairs strictly ordered one way by ``base`` and the other way by ``test``."""
    return discordant_pairs(_grouped(keys, base, test)).select(F.col("reversed").alias("inversions"))


def order_transitions(keys: DataFrame, base: str, test: str) -> DataFrame:
    """Unordered pairs that collapse to a tie, separate from a tie, or reverse."""
    groups = _grouped(keys, base, test)
    tied_both = groups.agg(F.sum(_pairs(F.col("w"))).alias("v"))

    def tied(col: str) -> DataFrame:
        return groups.groupBy(col).agg(F.sum("w").alias("w")).agg(F.sum(_pairs(F.col("w"))).alias("v"))

    parts = reduce(
        DataFrame.unionByName,
        [
            tied_both.select(F.lit("both").alias("part"), "v"),
            tied("x").select(F.lit("base").alias("part"), "v"),
            tied("y").select(F.lit("test").alias("part"), "v"),
            discordant_pairs(groups).select(F.lit("reversed").alias("part"), F.col("reversed").alias("v")),
        ],
    )

    def part(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("part") == name, F.col("v"))), F.lit(0))

    return parts.agg(
        (part("test") - part("both")).alias("collapsed"),
        (part("base") - part("both")).alias("separated"),
        part("reversed").alias("reversed"),
    )


def weight_sweep(scores: DataFrame, upper: str, lower: str, named_subject=None) -> DataFrame:
    """At how many of the 21 weights of a claimed cell does stratum ``upper`` stay above ``lower``?"""
    weighted = scores.filter(F.col("n_scored") > 0).select(
        "subject", "kind", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("w10"), "n_1", "n_2", "n_scored"
    ).select(
        "w10", "subject", "kind",
        exact_key(20 * F.col("n_2") + F.col("w10") * F.col("n_1"), F.col("n_scored")).alias("key"),
    )
    per_weight = weighted.groupBy("w10").agg(
        F.min(F.when(F.col("kind") == upper, F.col("key"))).alias("min_upper"),
        F.max(F.when(F.col("kind") == lower, F.col("key"))).alias("max_lower"),
        F.min(F.when(F.col("subject").eqNullSafe(F.lit(named_subject)), F.col("key"))).alias("named"),
    )

    def holds(side: str) -> Column:
        """Weights at which this side is above; null when a side is empty, which tells nothing."""
        return F.when((F.count(side) > 0) & (F.count("max_lower") > 0), F.count_if(F.col(side) > F.col("max_lower")))

    return per_weight.agg(
        F.count(F.lit(1)).alias("n_weights"),
        holds("min_upper").alias("stratum_holds"),
        holds("named").alias("subject_holds"),
    )


def score_vectors(cells: DataFrame, subjects: DataFrame) -> DataFrame:
    """Distinct 22-entry score vectors per stratum with their number of subjects."""
    vector = F.array(*[F.max(F.when(F.col("axis") == a, F.col("score"))) for a in registry.AXIS_IDS])
    return (
        cells.groupBy("subject").agg(vector.alias("v"))
        .join(subjects.select("subject", "kind"), "subject", "left")
        .groupBy("kind", "v").agg(F.count(F.lit(1)).alias("w"))
    )


def _drop_axes(vectors: DataFrame, k: int) -> DataFrame:
    """Every k-subset of axes dropped from every vector: k chained generators, no join.

    The running total and count are carried along; ``drop`` reads as base-100 digits, so
    its order is the lexicographic order of the dropped axes.
    """
    n_axes = len(registry.AXIS_IDS)
    total = F.aggregate("v", F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    live = F.size(F.filter("v", lambda x: x.isNotNull()))
    out = vectors.select(
        "kind", "v", total.alias("total"), live.alias("n"), exact_key(total, live).alias("base"),
        F.lit(0).alias("last"), F.lit(0).cast("decimal(38,0)").alias("drop"),
    )
    for depth in range(1, k + 1):
        top = n_axes - k + depth
        out = out.select(
            "kind", "v", "total", "n", "base", "drop",
            F.explode(F.sequence(F.col("last") + 1, F.lit(top))).alias("axis"),
        )
        value = F.get(F.col("v"), F.col("axis") - 1)
        out = out.select(
            "kind", "v", (F.col("total") - F.coalesce(value, F.lit(0))).alias("total"),
            (F.col("n") - value.isNotNull().cast("int")).alias("n"), "base",
            F.col("axis").alias("last"),
            (F.col("drop") * 100 + F.col("axis")).cast("decimal(38,0)").alias("drop"),
        )
    return out.select("kind", "base", exact_key(F.col("total"), F.col("n")).alias("key"), "drop")


def leave_k_axes_out(vectors: DataFrame, k: int = 3) -> DataFrame:
    """How many k-axis drops make some pair reverse strictly, and the first such drop.

    Per drop only the extreme keys of each distinct base value matter: a pair reverses
    exactly when a lower base value has a larger key than a higher base value's smallest.
    """
    extremes = _drop_axes(vectors, k).groupBy("drop", "base").agg(
        F.min("key").alias("low"), F.max("key").alias("high")
    )
    below = Window.partitionBy("drop").orderBy("base").rowsBetween(Window.unboundedPreceding, -1)
    flagged = extremes.select("drop", (F.max("high").over(below) > F.col("low")).alias("inverted"))
    return (
        flagged.groupBy("drop").agg(F.coalesce(F.bool_or("inverted"), F.lit(False)).alias("inverted"))
        .agg(
            F.count(F.lit(1)).alias("n_drops"),
            F.count_if("inverted").alias("n_inverted"),
            F.min(F.when(F.col("inverted"), F.col("drop"))).cast("string").alias("first_drop"),
        )
    )


CHUNKS = ((0, 8), (8, 15), (15, len(registry.AXIS_IDS)))


def _coded(vector: Column) -> Column:
    """A score vector as one long, two bits an axis; 3 is not scored."""
    parts = [F.shiftleft(F.coalesce(F.get(vector, F.lit(i)), F.lit(3)).cast("long"), 2 * i) for i in range(len(registry.AXIS_IDS))]
    return reduce(Column.bitwiseOR, parts)


def _chunk_drops(first: int, last: int, k: int) -> Column:
    """Every set of at most k dropped axes within a chunk: its bits, its size, and the kept axes as two-bit places."""
    width = last - first
    sets = [(m, m.bit_count(), sum(1 << 2 * j for j in range(width) if not m >> j & 1)) for m in range(1 << width) if m.bit_count() <= k]
    return F.array(*[F.struct(F.lit(m << first).alias("axes"), F.lit(size).alias("size"), F.lit(keep).cast("long").alias("keep"))
                     for m, size, keep in sets])


def drop_extremes(vectors: DataFrame, k: int) -> DataFrame:
    """``(kind, drop, n, low, high)``: least and greatest total of a kind's vectors after each k-axis drop, by axes left.

    A dynamic programme over chunks of axes.  A state is what was dropped so far, how many scored axes were
    kept, and the scores still to come; of all vectors in one state only the least and the greatest total go on,
    because equal suffixes and counts keep their order under every later drop.  The number of states after a
    chunk is bounded by the drops, counts and suffixes there are, whatever the number of subjects, and vectors
    that differ only in axes already passed are one.
    """
    state = vectors.select("kind", _coded(F.col("v")).alias("code"), F.lit(0).alias("drop"), F.lit(0).alias("dropped"), F.lit(0).alias("n"),
                           F.lit(0).alias("low"), F.lit(0).alias("high")).distinct()
    for first, last in CHUNKS:
        width, left = last - first, len(registry.AXIS_IDS) - last
        state = state.select("*", F.explode(_chunk_drops(first, last, k)).alias("c"))
        state = state.where((F.col("dropped") + F.col("c.size")).between(k - left, k))
        ones = F.col("code").bitwiseAND(F.col("c.keep"))
        twos = F.shiftright("code", 1).bitwiseAND(F.col("c.keep"))
        none = F.bit_count(ones.bitwiseAND(twos))
        gain = F.bit_count(ones) + 2 * F.bit_count(twos) - 3 * none
        state = state.select(
            "kind", F.shiftright("code", 2 * width).alias("code"), F.col("drop").bitwiseOR(F.col("c.axes")).alias("drop"),
            (F.col("dropped") + F.col("c.size")).alias("dropped"), (F.col("n") + width - F.col("c.size") - none).alias("n"),
            (F.col("low") + gain).alias("low"), (F.col("high") + gain).alias("high"),
        ).groupBy("kind", "drop", "dropped", "n", "code").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return state.select("kind", "drop", "n", "low", "high")


def separation_at(vectors: DataFrame, upper: str, lower: str, k: int) -> DataFrame:
    """At depth k: drops where stratum ``upper`` ties with or falls below stratum ``lower``."""
    found = drop_extremes(vectors.filter(F.col("kind").isin(upper, lower)), k)
    per_drop = found.groupBy("drop").agg(
        F.min(F.when(F.col("kind") == upper, exact_key(F.col("low"), F.col("n")))).alias("low"),
        F.max(F.when(F.col("kind") == lower, exact_key(F.col("high"), F.col("n")))).alias("high"),
    )
    return per_drop.agg(
        F.count_if(F.col("low") == F.col("high")).alias("ties"),
        F.count_if(F.col("low") < F.col("high")).alias("inversions"),
    ).select(F.lit(k).alias("k"), "ties", "inversions")


def separation_depth(vectors: DataFrame, upper: str, lower: str, max_k: int = 11) -> DataFrame:
    """``(k, searched_to, ties, inversions)``: the smallest k whose drops break the separation.

    ``k`` is null when no drop of up to ``searched_to`` axes does, which says nothing about deeper ones; with
    ``max_k`` = 22 there always is one, if both strata have a subject.  Only one summary row per depth reaches
    the driver, and the loop stops at the first hit.
    """
    spark = vectors.sparkSession
    schema = "k int, searched_to int, ties long, inversions long"
    vectors = vectors.persist()
    try:
        for k in range(1, max_k + 1):
            row = separation_at(vectors, upper, lower, k).first()
            if row["ties"] + row["inversions"]:
                return spark.createDataFrame([(k, k, row["ties"], row["inversions"])], schema)
    finally:
        vectors.unpersist()
    return spark.createDataFrame([(None, max_k, 0, 0)], schema)


def stratum_extremes(keys: DataFrame, upper: str, lower: str) -> DataFrame:
    """``(lo, hi)``: lowest subject of one stratum, highest of the other (ties by id)."""
    return keys.agg(
        F.min_by("subject", F.when(F.col("kind") == upper, F.struct(F.col("as_coded"), F.col("subject")))).alias("lo"),
        F.min_by("subject", F.when(F.col("kind") == lower, F.struct(-F.col("as_coded"), F.col("subject")))).alias("hi"),
    )


def axis_correlation(vectors: DataFrame, min_subjects: int = 8, threshold: float = 0.9) -> DataFrame:
    """Pearson r of every pair of axes over the subjects that score both.

    Integer moments are summed per axis pair (231 groups, combined map-side).  Pairs that
    never vary, or have fewer than ``min_subjects`` subjects, give no row.
    """
    axis = F.explode(F.sequence(F.lit(1), F.lit(len(registry.AXIS_IDS))))
    firsts = vectors.select("v", "w", axis.alias("axis_a"))
    last = F.lit(len(registry.AXIS_IDS))
    pairs = firsts.filter(F.col("axis_a") < last).select(
        "w", "axis_a", F.get("v", F.col("axis_a") - 1).alias("x"), "v",
        F.explode(F.sequence(F.col("axis_a") + 1, last)).alias("axis_b"),
    ).select("w", "axis_a", "axis_b", F.col("x").cast("long"), F.get("v", F.col("axis_b") - 1).cast("long").alias("y"))
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    sums = pairs.filter(x.isNotNull() & y.isNotNull()).groupBy("axis_a", "axis_b").agg(
        F.sum("w").alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
        F.sum(w * x * y).alias("sxy"), F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"),
    )
    n = F.col("n").cast("double")
    cov = n * F.col("sxy") - F.col("sx").cast("double") * F.col("sy")
    var_x = n * F.col("sxx") - F.col("sx").cast("double") * F.col("sx")
    var_y = n * F.col("syy") - F.col("sy").cast("double") * F.col("sy")
    return (
        sums.filter((F.col("n") >= min_subjects) & (var_x > 0) & (var_y > 0))
        .select("axis_a", "axis_b", "n", (cov / (F.sqrt(var_x) * F.sqrt(var_y))).alias("r"))
        .withColumn("redundant", F.abs("r") >= threshold)
    )
