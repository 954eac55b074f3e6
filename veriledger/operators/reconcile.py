"""Controls over a recorded search: recounts, truncation, recall, equivalence, filter cost."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriledger.functions import content, urls
from veriledger.functions.digests import close_digest, digest_sums
from veriledger.operators import funnel
from veriledger.sources import registry

# fixed values: categories counted as adjacent by the profile and by the bound
PROFILE_ADJACENT = ["cs.CV", "cs.AI", "cs.SE", "cs.IR", "cs.RO", "cs.HC", "cs.NE", "cs.MA", "cs.CR", "cs.DC", "stat.ML"]
BOUND_ADJACENT = [
    "cs.CV", "cs.AI", "cs.SE", "cs.IR", "cs.RO", "cs.HC", "cs.NE", "cs.MA", "cs.CR", "cs.DC",
    "cs.DB", "cs.PF", "stat.ML",
]
TOP_CATEGORIES = 14


def screen_recount(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Subjects (and the grand total) whose stored screen count does not follow from the data.

    ``stored(subject, n)``; the row with subject ``*`` is the stored total.
    """
    counts = recomputed.rollup("subject").agg(F.count(F.lit(1)).alias("recomputed"), F.grouping("subject").alias("g"))
    counts = counts.select(F.when(F.col("g") == 1, "*").otherwise(F.col("subject")).alias("subject"), "recomputed")
    joined = stored.select("subject", F.col("n").alias("stored")).join(counts, "subject", "full_outer")
    return joined.select("subject", "stored", F.coalesce("recomputed", F.lit(0)).alias("recomputed")).filter(
        ~F.col("stored").eqNullSafe(F.col("recomputed"))
    )


def truncated_queries(queries: DataFrame) -> DataFrame:
    """Recorded queries that did not retrieve everything they reported."""
    short = (F.col("total") > 0) & (~F.coalesce("complete", F.lit(False)) | (F.col("retrieved") < F.col("total")))
    return queries.filter(short).select("subject", "term", "total", "retrieved")


def unadjudicated(subjects: DataFrame, searched: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Subjects never searched, searched without a verdict, or positive without url and quote."""
    never = subjects.select("subject").join(searched.select("subject"), "subject", "left_anti").withColumn("why", F.lit("never searched"))
    open_ = searched.select("subject").distinct().join(adjudications.select("subject"), "subject", "left_anti").withColumn("why", F.lit("no verdict"))
    unbound = adjudications.filter(
        F.col("hit") & (content.is_blank(F.col("url")) | content.is_blank(F.col("quote")))
    ).select("subject", F.lit("no evidence for hit").alias("why"))
    return never.unionByName(open_).unionByName(unbound)


def recall_control(known: DataFrame, found: DataFrame) -> DataFrame:
    """Known cases against the candidate pool.

    ``known(case, record, subject, expect)`` with expect in_pool or off_corpus;
    ``found(subject, record_url)``.  The record id is read out of the candidate address, so
    the test is an equi-join.
    """
    pool = found.select("subject", F.regexp_extract("record_url", urls.RECORD_ID, 1).alias("record")).distinct().withColumn("found", F.lit(True))
    joined = known.join(pool, ["subject", "record"], "left")
    status = (
        F.when(F.col("expect") != "in_pool", "out of frame").when(F.col("found"), "in pool").otherwise("missing")
    )
    return joined.select("case", "subject", status.alias("status"))


def recall(statuses: DataFrame) -> DataFrame:
    reachable = F.col("status").isin("in pool", "missing")
    return statuses.agg(
        F.count_if(reachable).alias("expected"), F.count_if(F.col("status") == "in pool").alias("found"),
        F.count_if(~reachable).alias("out_of_frame"),
    )


def page_total_reconcile(pages: DataFrame) -> DataFrame:
    """(subject, term) whose archived entries do not add up to the header total.

    ``pages(subject, term, entries, total)``, one row per archived page.
    """
    return (
        pages.groupBy("subject", "term")
        .agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.max("total").alias("total"))
        .filter((F.col("total") > 0) & (F.col("entries") != F.col("total")))
    )


# --------------------------------------------------------------------- term equivalence

def term_sets(pages: DataFrame) -> DataFrame:
    """One fingerprint of the id set per (subject, term).

    ``pages(subject, term, ids)``; null ids = a page that could not be read.  A term with an
    unreadable page is not comparable, which is not the same as an empty set.
    """
    ids = pages.select("subject", "term", F.explode_outer("ids").alias("id"), F.col("ids").isNull().alias("unread"))
    distinct = ids.groupBy("subject", "term", "id").agg(F.max("unread").alias("unread"))
    hashed = distinct.withColumn("d", F.when(F.col("id").isNotNull(), F.sha2("id", 256)))
    sums = hashed.groupBy("subject", "term").agg(F.max("unread").alias("unread"), F.count("id").alias("n_ids"), *digest_sums(F.col("d")))
    return sums.select("subject", "term", "n_ids", "unread", close_digest(F.col("n_ids")).alias("ids_digest"))


def term_pairs(sets: DataFrame, terms: list[str]) -> DataFrame:
    """For every pair of terms: subjects compared, identical, and identical and non-empty.

    Terms become columns of one row per subject; all pairs are then aggregates of a single
    pass, so no pair of rows is ever emitted.
    """
    readable = F.when(~F.col("unread"), F.struct("ids_digest", "n_ids"))
    wide = sets.groupBy("subject").agg(*[F.max(F.when(F.col("term") == t, readable)).alias(f"t{i}") for i, t in enumerate(terms)])
    pairs = list(combinations(range(len(terms)), 2))

    def stats(i: int, j: int) -> list[Column]:
        a, b = F.col(f"t{i}"), F.col(f"t{j}")
        same = a["ids_digest"] == b["ids_digest"]
        return [
            F.count_if(a.isNotNull() & b.isNotNull()).alias(f"c_{i}_{j}"), F.count_if(same).alias(f"s_{i}_{j}"),
            F.count_if(same & (a["n_ids"] > 0)).alias(f"w_{i}_{j}"),
        ]

    totals = wide.agg(*[c for i, j in pairs for c in stats(i, j)])
    rows = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(terms[i]).alias("a"), F.lit(terms[j]).alias("b"), F.col(f"c_{i}_{j}").alias("compared"),
                 F.col(f"s_{i}_{j}").alias("identical"), F.col(f"w_{i}_{j}").alias("both_non_empty"))
        for i, j in pairs
    ])
    return totals.select(F.explode(rows).alias("r")).select("r.*").withColumn(
        "equivalent", (F.col("compared") > 0) & (F.col("identical") == F.col("compared")) & (F.col("both_non_empty") > 0)
    )


def term_groups(pairs: DataFrame, terms: list[str]) -> DataFrame:
    """Greedy groups: a term joins the first earlier group leader it is equivalent to.

    Equivalence need not be transitive (terms may be comparable on different subjects), so
    leaders are settled in term order; the fold runs over the protocol's few terms.
    """
    linked = pairs.agg(F.collect_set(F.when(F.col("equivalent"), F.col("i") * 1000 + F.col("j"))).alias("links"))

    def step(leaders: Column, j: Column) -> Column:
        earlier = F.filter(
            F.sequence(F.lit(0), F.lit(len(terms))),
            lambda i: (i < j) & (F.get(leaders, i) == i) & F.array_contains(F.col("links"), i * 1000 + j),
        )
        return F.concat(leaders, F.array(F.coalesce(F.get(earlier, F.lit(0)), j)))

    order = F.array(*[F.lit(i) for i in range(len(terms))])
    leaders = F.aggregate(order, F.array().cast("array<int>"), step)
    names = F.array(*[F.lit(t) for t in terms])
    return linked.select(F.posexplode(leaders).alias("pos", "leader")).select(
        F.get(names, F.col("pos")).alias("term"), F.get(names, F.col("leader")).alias("grp")
    )


def query_counts(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Issued and distinct terms and queries."""
    joined = sets.join(groups, "term")
    per_subject = joined.groupBy("subject").agg(
        F.countDistinct("term").alias("issued"), F.countDistinct(F.when(~F.col("unread"), F.col("grp"))).alias("live")
    )
    n_groups = groups.agg(F.countDistinct("grp")).scalar()
    return per_subject.agg(
        F.sum("issued").alias("queries_issued"),
        F.sum(F.when(F.col("live") > 0, F.col("live")).otherwise(n_groups)).alias("queries_distinct"),
    ).select(groups.agg(F.count(F.lit(1))).scalar().alias("terms_issued"), n_groups.alias("terms_distinct"), "queries_issued", "queries_distinct")


def control_pair(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """The designated pair must differ on every comparable subject."""
    chosen = pairs.filter(((F.col("a") == first) & (F.col("b") == second)) | ((F.col("a") == second) & (F.col("b") == first)))
    differ = F.col("compared") - F.col("identical")
    return chosen.select(F.lit(first).alias("a"), F.lit(second).alias("b"), "compared", differ.alias("differ"),
                         ((F.col("compared") > 0) & (differ == F.col("compared"))).alias("passes"))


# -------------------------------------------------------------------------- filter cost

def filter_cost(unfiltered: DataFrame, filtered: DataFrame, verbs: str = funnel.FILTER_VERBS) -> DataFrame:
    """Documents found only without the category filter that name the subject with a verb.

    ``unfiltered(subject, name, id, text, …)``, ``filtered(subject, id)``.  The cheap text
    tests run before the anti-join.
    """
    relevant = unfiltered.filter(
        F.contains(F.lower("text"), F.lower("name")) & F.col("text").rlike(f"(?i){verbs}")
    )
    return relevant.join(filtered.select("subject", "id").distinct(), ["subject", "id"], "left_anti").dropDuplicates(["subject", "id"])


def category_counts(excluded: DataFrame, adjacent: list[str] = PROFILE_ADJACENT) -> DataFrame:
    """``(category, n, adjacent)``: every category among the distinct excluded documents; no category is null too."""
    counts = excluded.dropDuplicates(["id"]).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("adjacent", F.coalesce(F.col("category").isin(adjacent), F.lit(False)))


def category_top(counts: DataFrame, k: int = TOP_CATEGORIES) -> DataFrame:
    """Report view: the k most common of ``category_counts``."""
    return counts.orderBy(F.desc("n"), "category").limit(k)


def subject_categories(excluded: DataFrame, adjacent: list[str] = PROFILE_ADJACENT) -> DataFrame:
    """``(subject, category, n, rank, adjacent)``: every category of a subject's excluded documents, most common first."""
    counts = excluded.filter("category is not null").groupBy("subject", "category").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("n"), "category"))
    return counts.select("subject", "category", "n", rank.alias("rank"), F.col("category").isin(adjacent).alias("adjacent"))


def category_profile(categories: DataFrame, k: int = 3) -> DataFrame:
    """Report view of ``subject_categories``: excluded, adjacent, and the k most common categories as text."""
    shown = F.when(F.col("rank") <= k, F.struct("rank", F.concat_ws(":", "category", F.col("n").cast("string")).alias("t")))
    return categories.groupBy("subject").agg(
        F.sum("n").alias("excluded"), F.coalesce(F.sum(F.when(F.col("adjacent"), F.col("n"))), F.lit(0)).alias("adjacent"),
        F.array_sort(F.collect_list(shown)).alias("top"),
    ).select("subject", "excluded", "adjacent", F.array_join(F.transform("top", lambda s: s["t"]), ",").alias("top"))


def filter_bound(excluded: DataFrame, adjacent: list[str] = BOUND_ADJACENT, verbs: str = funnel.TITLE_VERBS) -> DataFrame:
    """Per subject and (subject ``*``) over distinct categorised documents."""
    near = F.col("category").isin(adjacent)
    per_subject = excluded.groupBy("subject").agg(
        F.count(F.lit(1)).alias("excluded"), F.count_if(near).alias("adjacent"),
        F.count_if(near & F.col("title").rlike(f"(?i){verbs}")).alias("adjacent_titled"),
    )
    distinct = excluded.filter("category is not null").dropDuplicates(["id"]).agg(
        F.lit("*").alias("subject"), F.count(F.lit(1)).alias("excluded"), F.count_if(near).alias("adjacent"),
        F.count_if(near & F.col("title").rlike(f"(?i){verbs}")).alias("adjacent_titled"),
    )
    return per_subject.unionByName(distinct)


# -------------------------------------------------------------------------- adjudication

def label_from_queries(queries: DataFrame, terms: list[str]) -> DataFrame:
    """The one quoted name a subject's queries use; refused when it is not exactly one."""
    labels = queries.select("subject", F.explode_outer(urls.query_labels(F.col("url"), terms)).alias("label"))
    return labels.groupBy("subject").agg(F.min("label").alias("low"), F.max("label").alias("high")).select(
        "subject", F.when(F.col("low") == F.col("high"), F.col("low")).alias("label"),
        F.coalesce(F.col("low") != F.col("high"), F.lit(True)).alias("refused"),
    )


def route_hits(cells: DataFrame, records: DataFrame) -> DataFrame:
    """Rewrite the notes of searched cells; a positive goes only to the axes its record names.

    ``cells(subject, axis, score, note)``, ``records(subject, name, hit, affects, totals,
    n_candidates, n_screened, rationale, title, url, quote)``.  Scores are passed through unchanged;
    ``blocked`` says why a cell stops the write.
    """
    axes = content.affected_axes(F.col("affects"))
    routed = records.withColumns({"axes": axes, "unroutable": F.col("hit") & (F.size(axes) == 0)})
    joined = cells.filter(F.col("axis").isin(list(registry.HIT_AXES))).join(routed.withColumn("searched", F.lit(True)), "subject", "left")
    positive = F.coalesce(F.col("hit") & F.array_contains("axes", F.col("axis")), F.lit(False))
    note = content.render_note(
        F.col("axis"), F.col("name"), positive, F.col("totals"), F.col("n_candidates"), F.col("n_screened"), F.col("rationale"),
        F.col("title"), F.col("url"), F.col("quote"),
    )
    blocked = F.when(F.col("searched").isNull(), "never searched").when(F.col("unroutable"), "unroutable hit")
    return joined.select(
        "subject", "axis", "score", positive.alias("positive"), blocked.alias("blocked"), F.when(blocked.isNull(), note).alias("new_note"),
        F.when(blocked.isNull(), ~note.eqNullSafe(F.col("note"))).alias("changed"),
    )


def adjudication_consistency(adjudications: DataFrame, cells: DataFrame) -> DataFrame:
    """Subjects whose recorded verdict and axis-17 score disagree."""
    scored = cells.filter("axis = 17").select("subject", F.coalesce(F.col("score") != 0, F.lit(False)).alias("scored"))
    joined = adjudications.select("subject", F.coalesce("hit", F.lit(False)).alias("hit")).join(scored, "subject")
    return joined.filter(F.col("hit") != F.col("scored"))
