"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Texts are folded (A-Z lower-cased) and cut into words of digits, letters a-z and non-ASCII
characters.  A window is ``n`` consecutive words of an item; a shorter item is one window.  Every
document's windows are hashed and looked up in the set of item-window hashes that is shipped
with the tasks; a hit is then verified by joining its words with the item's words.  All of it is
built-in functions: tokens, hashes and the look-up stay in the row, only verified or claimed
hits leave it.

The hash set is shipped only while the items have at most ``max_set`` distinct windows of at most ``max_bytes``.  Above that
a bit filter of the windows, of bounded size, is shipped instead: document windows that pass it are joined with the
items by a shuffle, the others never leave their task.

Edge cases: null or wordless texts have no words, no hits and are kept; items without words have
no window.  Repeated document rows are judged each on their own.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledger.llm.common import BITS_LEAST, BITS_MOST, drop_ids, lower_ascii, materialise, sha256_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N = 10
MAX_SET = 200_000
MAX_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _starts(words: Column, length: int) -> Column:
    """1-based positions at which a window of ``length`` words begins."""
    return F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - (length - 1))).otherwise(
        F.array().cast("array<int>"))


def _claims(length: int, hashes: list[int] | None) -> Column:
    """Windows of ``words`` whose hash is in the set (all windows without a set), with their text."""
    starts = _starts(F.col("words"), length)
    if hashes is not None:
        starts = F.filter(starts, lambda i: F.xxhash64(F.slice("words", i, length)).isin(hashes))
    return F.transform(starts, lambda i: F.struct(
        i.alias("start"), F.lit(length).alias("length"), F.array_join(F.slice("words", i, length), " ").alias("window"),
        F.xxhash64(F.slice("words", i, length)).alias("hash")))


def item_windows(items: DataFrame, n: int = N) -> DataFrame:
    """``length, hash, window, items``: one row per distinct window of the benchmark."""
    words = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    words = words.withColumn("length", F.least(F.lit(n), F.size("words")))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    cut = F.transform(starts, lambda i: F.slice("words", i, F.col("length")))
    return (
        words.select("item_id", "length", F.explode(cut).alias("w"))
        .groupBy("length", F.xxhash64("w").alias("hash"), F.array_join("w", " ").alias("window"))
        .agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    )


def _mask(hash_: Column) -> Column:
    """Three of the 64 bits of a filter word, from the low bits of a hash."""
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.pmod(F.shiftrightunsigned(hash_, 6 * k), F.lit(64)).cast("int")) for k in range(3)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def _word(hash_: Column, words: int) -> Column:
    return F.pmod(F.shiftrightunsigned(hash_, 18), F.lit(words))


def _sifted(rows: DataFrame, windows: DataFrame, n_windows: int) -> DataFrame:
    """``rows`` without those whose ``hash`` is surely in no window; rows of length below 1 stay.

    A blocked Bloom filter with about 16 bits for a window in at most ``BITS_MOST`` bits, the proven bound of what
    is broadcast; the join on the words decides about what it lets through.
    """
    words = BITS_LEAST // 64
    while words * 64 < min(16 * n_windows, BITS_MOST):
        words *= 2
    bits = windows.select(_word(F.col("hash"), words).alias("filter_word"), _mask(F.col("hash")).alias("bits"))
    bits = bits.groupBy("filter_word").agg(F.bit_or("bits").alias("bits"))
    marked = rows.join(F.broadcast(bits), _word(F.col("hash"), words) == F.col("filter_word"), "left")
    inside = F.coalesce(F.col("bits"), F.lit(0)).bitwiseAND(_mask(F.col("hash"))) == _mask(F.col("hash"))
    return marked.where((F.col("length") < 1) | inside).drop("filter_word", "bits")


def hits(documents: DataFrame, items: DataFrame, n: int = N, max_set: int = MAX_SET, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``row_id, doc_id, n_words, hits`` per document row; hits = array of (start, length, items), verified.

    At most ``max_set`` windows of at most ``max_bytes`` with their items are looked up in the plan and broadcast.  Beyond
    that a bit filter sifts the windows of the documents, and what is left is joined by a shuffle.
    """
    windows = item_windows(items, n)
    weight = F.octet_length("window") + F.aggregate("items", F.lit(0), lambda s, x: s + F.octet_length(x) + 16)
    sizes = windows.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("bytes")).collect()  # at most n rows
    lengths, n_windows = sorted(r.length for r in sizes), sum(r.n for r in sizes)
    in_set = n_windows <= max_set and sum(r.bytes for r in sizes) <= max_bytes
    known = windows.select("length", "hash").collect() if in_set else []  # at most max_set
    docs = documents.select("doc_id", words_of(F.col("text")).alias("words")).select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", "words", F.size("words").alias("n_words"))
    claims = F.array().cast("array<struct<start:int,length:int,window:string,hash:bigint>>")
    for length in lengths:
        claims = F.concat(claims, _claims(length, [r[1] for r in known if r[0] == length] if in_set else None))
    if not in_set:
        # every document keeps one row; its length is none of a window and spreads these rows over the join's tasks
        spread = (-1 - F.pmod(F.xxhash64("row_id"), F.lit(1 << 20))).cast("int")
        claims = F.concat(claims, F.array(F.struct(
            F.lit(0).alias("start"), spread.alias("length"), F.lit("").alias("window"), F.lit(0).cast("long").alias("hash"))))
    rows = docs.select("row_id", "doc_id", "n_words", F.explode_outer(claims).alias("c")).select(
        "row_id", "doc_id", "n_words", "c.*")
    texts = windows.select("length", "window", "items")
    if not in_set:
        rows = _sifted(rows, windows, n_windows)
    found = rows.drop("hash").join(F.broadcast(texts) if in_set else texts, ["length", "window"], "left")
    return found.groupBy("row_id", "doc_id", "n_words").agg(
        F.collect_list(F.when(F.col("items").isNotNull(), F.struct("start", "length", "items"))).alias("hits"))


def report(documents: DataFrame, items: DataFrame, n: int = N, max_set: int = MAX_SET, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated`` per document."""
    covered = F.array_distinct(F.flatten(F.transform(
        "hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    out = hits(documents, items, n, max_set, max_bytes).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size(covered).cast("long").alias("n_hit"), names.alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
                      (F.col("n_hit") > 0).alias("contaminated"))


def digest(documents: DataFrame, items: DataFrame) -> DataFrame:
    return report(documents, items).select(
        "doc_id", "n_words", "n_hit", "n_items", sha256_of(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def drop_contaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without a benchmark window, all columns kept; a document id goes if any of its rows is hit."""
    return drop_ids(documents, materialise(report(documents, items).where("contaminated").select("doc_id").distinct()))
