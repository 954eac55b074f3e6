"""Document fingerprints by consistent weighted sampling.

A document is a bag of words weighted by their counts.  For each of ``samples`` samples and each
word, hashes of (sample, word) give r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ Uniform(0, 1); with
weight w, t = floor(ln w / r + b), and the sample keeps the word with the smallest
ln c - r (t - b + 1).  Two documents agree in a sample with a probability equal to their
generalised Jaccard similarity, the sum of smaller counts over the sum of larger ones.  The kept
value is a function of (sample, word, t) alone, so a sample is stored as 32 bits of its hash.

Built-in functions only.  Documents are placed by ranges of ``doc_id`` and every grouping of words
includes the place, so texts are shuffled once and their words not at all.

Edge cases: null text is empty; texts without words have the all-zero fingerprint, equal to each other and
unlike any text with words.  Documents follow each other by ``doc_id`` (null first), then text; repeated
rows each have their own next row.  A single document is its own next one.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriledger.llm.common import materialise, sha256_of

SAMPLES = 32
PLACE_ROWS = 2048
FAN = 4096
WORD_BREAKS = r"[\x00-\x20]+"


def sampling_key(word: Column, weight: Column, sample: int) -> Column:
    """ln c - r (t - b + 1) of a hashed word with this weight; null for weight 0."""
    first, second = F.xxhash64(word, F.lit(sample)), F.xxhash64(word, F.lit(-1 - sample))

    def uniform(h, shift):
        return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 21) - 1)) + 0.5) / float(1 << 21)

    rate = -F.log(uniform(first, 0) * uniform(first, 21))
    log_c = F.log(-F.log(uniform(second, 0) * uniform(second, 21)))
    shift = uniform(first, 42)
    return log_c - rate * (F.floor(F.log(weight) / rate + shift) - shift + 1.0)


def placed(documents: DataFrame, rows: int = PLACE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Documents with a ``place``, and ``(place, next_place)`` of the places in use, the last followed by the first.

    A place is a range of ids of one width.  The width is halved until no place holds more than
    four times ``rows`` rows or it is 1; empty places cost nothing, so gaps and clusters of ids do no harm.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    low, high = low or 0, high or 0
    width = max(1, (high - low + 1) * rows // max(n, 1))
    while width > 1:
        most = docs.groupBy(_place(low, width)).count().agg(F.max("count")).first()[0]
        if (most or 0) <= 4 * rows:
            break
        width = max(1, width // 8)
    docs = docs.select(_place(low, width).alias("place"), "doc_id", "text")
    used = docs.select("place").distinct()
    last = (high - low) // width + 1
    return docs, _ring(used, last)


def _place(low: int, width: int) -> Column:
    """Null ids come before all others."""
    return F.coalesce(F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)) + 1, F.lit(0)).cast("long")


def _following(keys: DataFrame, highest: int) -> DataFrame:
    """``(place, next_place)``: the next larger key in use, null after the last; groups of ``FAN`` numbers, then groups of groups."""
    group = F.floor(F.col("place") / FAN)
    keys = keys.withColumn("g", group)
    inner = keys.withColumn("n", F.lead("place").over(Window.partitionBy("g").orderBy("place")))
    if highest < FAN:
        return inner.select("place", F.col("n").alias("next_place"))
    heads = keys.groupBy("g").agg(F.min("place").alias("head"))
    groups = _following(heads.select(F.col("g").alias("place")), highest // FAN)
    groups = groups.join(heads, F.col("next_place") == F.col("g")).select(F.col("place").alias("g"), "head")
    return inner.join(groups, "g", "left").select("place", F.coalesce("n", "head").alias("next_place"))


def _ring(keys: DataFrame, highest: int) -> DataFrame:
    first = keys.agg(F.min("place")).first()[0]
    return _following(keys, highest).select("place", F.coalesce("next_place", F.lit(first)).alias("next_place"))


def _with_next(rows: DataFrame, ring: DataFrame, order: list, value: str) -> DataFrame:
    """Adds ``pos`` (number within the place) and ``next``: the ``value`` of the following row."""
    w = Window.partitionBy("place").orderBy(*order)
    rows = rows.withColumn("pos", F.row_number().over(w)).withColumn("next", F.lead(value).over(w)).withColumn(
        "last", F.lead(F.lit(False), 1, True).over(w))
    heads = rows.where("pos = 1").select(F.col("place").alias("next_place"), F.col(value).alias("head"))
    heads = heads.join(ring, "next_place").select(F.col("place").alias("before"), "head")
    rows = rows.join(heads, (F.col("place") == F.col("before")) & F.col("last"), "left")
    return rows.withColumn("next", F.coalesce("next", "head")).drop("head", "before", "last")


def edited_texts(docs: DataFrame, ring: DataFrame) -> DataFrame:
    """``place, doc_id, pos, text, n_chars, edited``: the last quarter replaced by the beginning of the next document."""
    rows = _with_next(docs, ring, ["doc_id", "text"], "text").withColumn("n_chars", F.length("text"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - quarter), F.substring("next", F.lit(1), quarter))
    return rows.select("place", "doc_id", "pos", "text", "n_chars", edited.alias("edited"))


def signatures(rows: DataFrame, keys: list[str], left: str, right: str, samples: int = SAMPLES) -> DataFrame:
    """``*keys, left, right``: for two text columns of each row, their arrays of ``samples`` 32-bit numbers (null: no words)."""
    def words(column, side):
        return F.transform(F.split(column, WORD_BREAKS), lambda w: F.struct(w.alias("w"), F.lit(side).alias("side")))

    counted = rows.select(*keys, F.explode(F.concat(words(left, 0), words(right, 1))).alias("x")).select(
        *keys, F.when(F.col("x.w") != "", F.xxhash64("x.w")).alias("h"), F.col("x.side").alias("side"))
    counted = counted.groupBy(*keys, "h").agg(F.sum(1 - F.col("side")).alias("l"), F.sum("side").alias("r"))
    # a value kept for equal weights on both sides is the same number, so equal counts give equal samples
    weights = {"l": F.when(F.col("h").isNotNull(), F.col("l")), "r": F.when(F.col("h").isNotNull(), F.col("r"))}
    least = [F.min(sampling_key(F.col("h"), weights[side], s)).alias(f"{side}{s}") for s in range(samples) for side in "lr"]
    found = counted.groupBy(*keys).agg(*least)

    def numbers(side):
        return F.when(F.col(f"{side}0").isNotNull(), F.array(
            *[F.shiftright(F.xxhash64(F.col(f"{side}{s}")), 32).cast("int") for s in range(samples)]))

    return found.select(*keys, numbers("l").alias(left), numbers("r").alias(right))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two texts without words are alike."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).otherwise(F.coalesce(same / F.size(a), F.lit(0.0)))


def as_text(signature: Column, samples: int = SAMPLES) -> Column:
    return F.coalesce(F.array_join(F.transform(signature, lambda v: F.lower(F.lpad(F.hex(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), ""),
                      F.lit("0" * 8 * samples))


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprint of every document and of its edited text, with their likeness to each other and to the next document."""
    docs, ring = placed(documents)
    rows = edited_texts(docs, ring)
    keys = ["place", "doc_id", "pos"]
    prints = signatures(rows, keys, "text", "edited")
    facts = rows.select(*keys, F.col("n_chars").cast("long").alias("n_chars"), sha256_of(F.col("edited")).alias("edited_sha256"))
    same = (F.col("f.place") == F.col("p.place")) & F.col("f.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("f.pos") == F.col("p.pos"))
    found = facts.alias("f").join(prints.alias("p"), same).select(
        *[F.col(f"f.{k}") for k in keys[:2]], F.col("f.pos").alias("nr"), "n_chars", "edited_sha256",
        F.struct(F.col("p.text").alias("p")).alias("own"), F.col("p.edited").alias("other"))
    # written once, in the job that shuffles the texts: neighbours and the heads of places read it
    out = _with_next(materialise(found), ring, ["doc_id", "nr"], "own")
    own, other = F.col("own.p"), F.col("other")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(own).alias("fingerprint"),
        as_text(other).alias("edited_fingerprint"), likeness(own, other).alias("near_edited"),
        likeness(own, F.col("next.p")).alias("near_next"))
