"""Search and screening over a text corpus.

Subjects, terms, signals and verbs are the protocol's own short lists, so they are
literals of one expression: a corpus is read once, every (subject, term) probe is
answered in that pass, and only matching rows leave it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledger.functions import content

# fixed values: the published protocol
TERMS = ["reproduce", "reproduction", "replicate", "replication", "reimplementation", "from scratch", "independently trained"]
SIGNALS = [
    "reproduce the training", "reproduction of the training", "retrain", "re-train",
    "from scratch", "replicate the training", "reproduced the pretraining",
    "training run", "reproducibility study", "bit-identical", "bitwise identical",
]
SENTENCE_VERBS = "reproduc|replicat|retrain|re-train|from scratch|training run|reimplement"
FILTER_VERBS = r"\b(reproduc\w+|replicat\w+|reimplement\w+|from scratch|independently trained)\b"
TITLE_VERBS = "reproduc|replicat|reimplement|from scratch"
GOVERN_CHARS = 25


def _pairs(names: dict[str, str]) -> Column:
    return F.array(*[F.struct(F.lit(s).alias("subject"), F.lit(n).alias("name")) for s, n in names.items()])


def _check_names(names: dict[str, str]) -> None:
    blank = [s for s, n in names.items() if not n]
    if blank or not names:
        raise ValueError(f"no search name for {blank}; a zero would stand without a search")


def mentions(corpus: DataFrame, names: dict[str, str], terms: list[str], categories: list[str] | None = None) -> DataFrame:
    """``corpus`` columns plus ``subject, name, terms`` for every document naming a subject.

    ``corpus(id, text, category, …)``; one row per (document, named subject), no shuffle.
    """
    _check_names(names)
    low = F.lower("text")
    rows = corpus if categories is None else corpus.filter(F.col("category").isin(categories))
    named = F.filter(_pairs(names), lambda p: F.contains(low, F.lower(p["name"])))
    found = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, F.lower(t)))
    return rows.withColumn("terms", found).select("*", F.explode(named).alias("p")).select("*", "p.*").drop("p")


def probe_hits(corpus: DataFrame, names: dict[str, str], terms: list[str], categories: list[str] | None = None) -> DataFrame:
    """``(subject, term, term_no, id)`` for every document containing the name and the term."""
    ordered = F.array(*[F.lit(t) for t in terms])
    found = mentions(corpus, names, terms, categories).select("subject", "id", F.explode("terms").alias("term"))
    return found.select("subject", "term", F.array_position(ordered, F.col("term")).cast("int").alias("term_no"), "id")


def probe_matrix(corpus: DataFrame, names: dict[str, str], terms: list[str], categories: list[str] | None = None) -> DataFrame:
    """Number of documents per (subject, term); probes that find nothing stay as zeros."""
    spark = corpus.sparkSession
    hits = probe_hits(corpus, names, terms, categories).groupBy("subject", "term").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(s, t) for s in names for t in terms], "subject string, term string")
    return grid.join(hits, ["subject", "term"], "left").select("subject", "term", F.coalesce("n", F.lit(0)).alias("n"))


def candidates(hits: DataFrame) -> DataFrame:
    """Distinct documents per subject over all terms, with the term that first found them."""
    return hits.groupBy("subject", "id").agg(
        F.min_by("term", "term_no").alias("first_term"), F.countDistinct("term").alias("n_terms")
    )


def candidate_texts(corpus: DataFrame, names: dict[str, str], terms: list[str], categories: list[str] | None = None) -> DataFrame:
    """The same candidates with their texts, straight from the corpus pass (no shuffle of texts)."""
    return mentions(corpus, names, terms, categories).filter(F.size("terms") > 0)


def stage1_signals(texts: DataFrame, signals: list[str] = SIGNALS) -> DataFrame:
    """Candidates that carry at least one signal phrase, with the phrases."""
    found = texts.withColumn("signals", content.signals_in(F.col("text"), signals))
    return found.filter(F.size("signals") > 0)


def stage2_sentence(texts: DataFrame, verbs: str = SENTENCE_VERBS) -> DataFrame:
    """The first sentence of each candidate that has the name and a verb."""
    pattern = f"(?i)(?:{verbs})"
    hit = F.filter(
        content.sentences(F.col("text")),
        lambda s: F.contains(F.lower(s), F.lower(F.col("name"))) & s.rlike(pattern),
    )
    return texts.withColumn("sentence", F.get(hit, F.lit(0))).filter("sentence is not null")


def near_pattern(names: list[str], terms: list[str], distance: int = GOVERN_CHARS) -> str:
    """Matches when some name starts at most ``distance`` characters from where some term starts.

    Look-ahead anchors both starts, so overlapping phrases count as they should.
    """
    any_name = "|".join(re.escape(n.lower()) for n in names)
    any_term = "|".join(re.escape(t.lower()) for t in terms)
    name, term = f"(?=(?:{any_name}))", f"(?=(?:{any_term}))"
    gap = f"(?s:.{{0,{distance}}})"
    return f"{name}{gap}{term}|{term}{gap}{name}"


def stage3_proximity(screened: DataFrame, names: dict[str, str | list[str]], terms: list[str]) -> DataFrame:
    """Stage-2 sentences where a term governs the subject's name."""
    low = F.lower("sentence")
    near = F.lit(False)
    for subject, name in names.items():
        spelled = [name] if isinstance(name, str) else name
        near = F.when(F.col("subject") == subject, low.rlike(near_pattern(spelled, terms))).otherwise(near)
    return screened.filter(near)
