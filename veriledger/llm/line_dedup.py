"""Reversible line dedup: sharded cuckoo filters in front of exact reference tables.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys of at least
``MIN_CHARS`` code points found in at least ``MIN_DOCS`` documents lose all their lines except those of
the largest ``doc_id`` that holds them.

The state of an index is three tables: ``refs(key, doc_id)``, one row per key and document;
``counts(shard, key, n_docs, max_doc)``; and ``filters(shard, n, slots)``, one cuckoo filter per shard of
keys.  ``insert`` counts the new documents' keys (combined before the shuffle, so a line that a third of
all documents share is one row per task) and asks the shard's filter: a key that is not in it is new and is
appended without reading the old counts, a key that may be in it is joined with them; where the filter was wrong, the
key gets a slot after all, so that every key of the counts has one of its own.  ``delete`` takes
documents out again, recounts only the keys they held, and removes keys without references from the
filters.  Deleting what was inserted gives back the state before.  An index has a shard for at most ``SHARD_KEYS`` keys
on average; one that outgrows them is dealt anew.

Edge cases: null or empty text is one empty line.  Rows that share a ``doc_id`` count as one document
and are cut alike.  Rows with a null id count for nothing and keep their lines.  Keys are compared by a 128-bit hash.
Inserting an id that the index holds already adds only keys that it did not hold for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledger.llm.common import arrow_rows, materialise

MIN_CHARS = 40
MIN_DOCS = 5
SHARDS = 64
SHARD_KEYS = 250_000
SPACE = " \t\n\x0b\x0c\r"
SLOTS = 4
PRINTS = 65535


def line_key(line: str) -> bytes | None:
    """128-bit key of a line, None for a short one."""
    line = line.strip(SPACE)
    if len(line) < MIN_CHARS:
        return None
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass").lower())


def _refs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, docs = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if doc is None or not text:
                continue
            found = {k for k in map(line_key, text.split("\n")) if k is not None}
            keys += found
            docs += [doc] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(docs, pa.int64())], names=["key", "doc_id"])


class CuckooFilter:
    """Approximate set of 128-bit keys with deletion: ``SLOTS`` 16-bit fingerprints in each of a power of two of buckets.

    A key's fingerprint stands in one of two buckets, each the other's XOR with a hash of the
    fingerprint.  All methods take arrays of distinct keys, as rows of two 64-bit words.
    """

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots
        self.mask = np.uint64(len(self.slots) - 1)

    @classmethod
    def for_size(cls, n: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * 0.85 < n:
            buckets *= 2
        return cls(buckets)

    def _prints(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (keys[:, 1] % np.uint64(PRINTS)).astype(np.uint16) + np.uint16(1)
        return prints, (keys[:, 0] & self.mask).astype(np.int64)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        h = prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (bucket.astype(np.uint64) ^ ((h >> np.uint64(24)) & self.mask)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one = self._prints(keys)
        two = self._other(one, prints)
        return (self.slots[one] == prints[:, None]).any(1) | (self.slots[two] == prints[:, None]).any(1)

    def add(self, keys: np.ndarray) -> bool:
        """Add keys; False if the filter is too full (it is then to be rebuilt larger)."""
        prints, bucket = self._prints(keys)
        random = np.random.default_rng(len(keys))
        tried = np.zeros(len(keys), bool)
        for _ in range(500):
            if not len(prints):
                return True
            order = np.argsort(bucket, kind="stable")
            prints, bucket, tried = prints[order], bucket[order], tried[order]
            new = np.append(True, bucket[1:] != bucket[:-1])
            heads = np.flatnonzero(new)
            rank = np.arange(len(bucket)) - heads[np.cumsum(new) - 1]
            rows = self.slots[bucket]
            empty_first = np.argsort(rows != 0, axis=1, kind="stable")
            fits = rank < (rows == 0).sum(1)
            self.slots[bucket[fits], empty_first[fits, rank[fits]]] = prints[fits]
            prints, bucket, tried, rank = prints[~fits], bucket[~fits], tried[~fits], rank[~fits]
            # whoever found both buckets full takes the slot of a resident, one per bucket and round
            new = np.append(True, bucket[1:] != bucket[:-1]) if len(bucket) else np.zeros(0, bool)
            evict = tried & new
            slot = random.integers(0, SLOTS, int(evict.sum()))
            at = bucket[evict]
            out = self.slots[at, slot].copy()
            self.slots[at, slot] = prints[evict]
            prints[evict] = out
            bucket = self._other(bucket, prints)
            tried = np.ones(len(bucket), bool)
        return not len(prints)

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that were added."""
        prints, one = self._prints(keys)
        for turn in (0, 1):  # first from the key's own bucket, what is not there from the other one
            while len(prints):
                bucket = self._other(one, prints) if turn else one
                hit = self.slots[bucket] == prints[:, None]
                slot = hit.argmax(1)
                # two keys may point at one slot: the first takes it, the other looks again
                _, first = np.unique(np.where(hit.any(1), bucket * SLOTS + slot, -1 - np.arange(len(prints))), return_index=True)
                mine = np.zeros(len(prints), bool)
                mine[first] = True
                mine &= hit.any(1)
                if not mine.any():
                    break
                self.slots[bucket[mine], slot[mine]] = 0
                prints, one = prints[~mine], one[~mine]


@dataclass
class Index:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int = SHARDS


REFS = "key binary, doc_id long"
COUNTS = "shard int, key binary, n_docs long, max_doc long"
FILTERS = "shard int, n long, slots binary"


def empty_index(spark: SparkSession) -> Index:
    return Index(*(spark.createDataFrame([], schema) for schema in (REFS, COUNTS, FILTERS)))


def line_refs(documents: DataFrame) -> DataFrame:
    docs = arrow_rows(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_refs_of, REFS).distinct()


def _count(refs: DataFrame, shards: int) -> DataFrame:
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    return refs.groupBy("key").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc")).select(
        shard.alias("shard"), "key", "n_docs", "max_doc")


def _words_of(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("key").to_pylist()), np.uint64).reshape(-1, 2)


def _filter_of(table: pa.Table) -> tuple[CuckooFilter | None, int]:
    if not table.num_rows:
        return None, 0
    n, data = table.column("n")[0].as_py(), table.column("slots")[0].as_py()
    if data is None:
        return None, n
    slots = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
    return CuckooFilter(len(slots), slots), n


def _asked(counts: pa.Table, filters: pa.Table) -> pa.Table:
    """The keys of a shard with the filter's answer, and the filter with the new keys in it (a row without key)."""
    old, n = _filter_of(filters)
    keys = _words_of(counts)
    known = old.contains(keys) if old is not None else np.zeros(len(keys), bool)
    fresh = keys[~known]
    size = n + len(fresh)
    full = old is None or len(old.slots) * SLOTS * 0.9 < size
    if not full:
        full = not old.add(fresh)
    data = None if full else old.slots.tobytes()
    rows = counts.num_rows
    shard = (counts if rows else filters).column("shard")[0].as_py()
    return pa.table({
        "shard": pa.array([shard] * (rows + 1), pa.int32()), "key": pa.array(counts.column("key").to_pylist() + [None], pa.binary()),
        "n_docs": pa.array(counts.column("n_docs").to_pylist() + [size], pa.int64()),
        "max_doc": pa.array(counts.column("max_doc").to_pylist() + [None], pa.int64()),
        "known": pa.array(known.tolist() + [None], pa.bool_()), "slots": pa.array([None] * rows + [data], pa.binary())})


def _built(table: pa.Table) -> pa.Table:
    """A filter for all keys of a shard."""
    keys, n = _words_of(table), table.num_rows
    size = n
    while not (made := CuckooFilter.for_size(size)).add(keys):
        size *= 2
    return pa.table({"shard": table.column("shard").slice(0, 1).cast(pa.int32()), "n": pa.array([n], pa.int64()),
                     "slots": pa.array([made.slots.tobytes()], pa.binary())})


def _added(filters: pa.Table, late: pa.Table) -> pa.Table:
    """A shard's filter with more keys in it; without slots if it is too full to take them."""
    made, n = _filter_of(filters)
    shard = (filters if filters.num_rows else late).column("shard")[0].as_py()
    fits = made is not None and len(made.slots) * SLOTS * 0.9 >= n + late.num_rows and (not late.num_rows or made.add(_words_of(late)))
    return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([n + late.num_rows], pa.int64()),
                     "slots": pa.array([made.slots.tobytes() if fits else None], pa.binary())})


def _resharded(index: Index) -> Index:
    """The index with shards for about half as many keys as one may hold, where its keys have outgrown them."""
    n = index.counts.count()
    if n <= index.shards * SHARD_KEYS:
        return index
    shards = 2 * -(-n // SHARD_KEYS)
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    counts = materialise(index.counts.withColumn("shard", shard))
    return Index(index.refs, counts, materialise(counts.groupBy("shard").applyInArrow(_built, FILTERS)), shards)


def insert(index: Index, documents: DataFrame, shards: int | None = None) -> Index:
    """The index with the lines of ``documents(doc_id, text)``; ``shards``: how many a new index gets (default: by its keys)."""
    first = index.refs.isEmpty()
    refs = line_refs(documents)
    if not first:
        refs = refs.join(index.refs, ["key", "doc_id"], "left_anti")
    refs = materialise(refs)
    if not first:
        shards = index.shards
    elif shards is None:
        shards = max(SHARDS, -(-refs.count() // SHARD_KEYS))  # no more distinct keys than references
    asked = materialise(_count(refs, shards).groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInArrow(
        _asked, "shard int, key binary, n_docs long, max_doc long, known boolean, slots binary"))
    mine = asked.where("key is not null")
    counts = mine.where("not known").select("shard", "key", "n_docs", "max_doc")
    kept = asked.where("key is null").select("shard", F.col("n_docs").alias("n"), "slots")
    if not first:
        # the filter's "maybe": the exact counts decide; keys that it does not know are never looked up
        more = mine.where("known").select("shard", "key", F.col("n_docs").alias("n"), F.col("max_doc").alias("m"))
        both = index.counts.join(more, ["shard", "key"], "full_outer").select(
            "shard", "key", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"),
            F.greatest("max_doc", "m").alias("max_doc"))
        counts = counts.union(both)
        # "maybe" was wrong: the key is new all the same and gets a slot of its own, which its deletion will take out again
        late = materialise(more.join(index.counts, ["shard", "key"], "left_anti").select("shard", "key"))
        kept = kept.groupBy("shard").cogroup(late.groupBy("shard")).applyInArrow(_added, FILTERS)
    counts, kept = materialise(counts), materialise(kept)
    # filters that were too small are built again from the exact keys
    grown = kept.where("slots is null").select("shard")
    rebuilt = counts.join(grown, "shard", "left_semi").groupBy("shard").applyInArrow(_built, FILTERS)
    filters = materialise(kept.where("slots is not null").union(rebuilt))
    made = Index(refs if first else materialise(index.refs.union(refs)), counts, filters, shards)
    return made if first else _resharded(made)


def _without(filters: pa.Table, gone: pa.Table) -> pa.Table:
    made, n = _filter_of(filters)
    if made is None:
        return pa.table({"shard": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "slots": pa.array([], pa.binary())})
    made.remove(_words_of(gone))
    return pa.table({"shard": filters.column("shard").slice(0, 1).cast(pa.int32()), "n": pa.array([n - gone.num_rows], pa.int64()),
                     "slots": pa.array([made.slots.tobytes()], pa.binary())})


def delete(index: Index, doc_ids: DataFrame) -> Index:
    """The index without the documents of ``doc_ids(doc_id)``."""
    shards = index.shards
    ids = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    touched = materialise(index.refs.join(ids, "doc_id", "left_semi").select("key").distinct())
    refs = materialise(index.refs.join(ids, "doc_id", "left_anti").select("key", "doc_id"))
    left = _count(refs.join(touched, "key", "left_semi"), shards)
    counts = materialise(index.counts.join(touched, "key", "left_anti").select("shard", "key", "n_docs", "max_doc").union(left))
    gone = touched.join(counts, "key", "left_anti").select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key")
    filters = index.filters.groupBy("shard").cogroup(gone.groupBy("shard")).applyInArrow(_without, FILTERS)
    return Index(refs, counts, materialise(filters), shards)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, drops = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        lines, dropped, kept = [], [], []
        for text, gone in zip(texts, drops, strict=True):
            parts = (text or "").split("\n")
            left = parts
            if gone:
                gone = set(gone)
                left = [x for x in parts if line_key(x) not in gone]
            lines.append(len(parts))
            dropped.append(len(parts) - len(left))
            kept.append("\n".join(left))
        digests = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in kept]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string()),
             pa.array(digests, pa.string()), *batch.columns[3:]],
            names=["doc_id", "n_lines", "n_dropped", "kept", "kept_sha256", *batch.schema.names[3:]])


def apply(index: Index, documents: DataFrame, min_docs: int = MIN_DOCS, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept, kept_sha256`` per row of documents in the index; the columns named in ``carry`` follow as ``carry_0``, ..."""
    frequent = index.counts.where(F.col("n_docs") >= min_docs).select("key", "max_doc")
    drops = index.refs.join(frequent, "key").where("doc_id != max_doc").groupBy("doc_id").agg(F.collect_list("key").alias("drops"))
    kinds = dict(documents.dtypes)
    rest = {f"carry_{i}": c for i, c in enumerate(carry or [])}
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(n) for n, c in rest.items()])
    rows = docs.join(drops, "doc_id", "left").select("doc_id", "text", "drops", *rest)
    schema = "doc_id long, n_lines long, n_dropped long, kept string, kept_sha256 string" + "".join(f", {n} {kinds[c]}" for n, c in rest.items())
    return rows.mapInArrow(_cut, schema)


def dedup(documents: DataFrame) -> DataFrame:
    index = insert(empty_index(documents.sparkSession), documents)
    return apply(index, documents).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def drop_lines(documents: DataFrame) -> DataFrame:
    """The documents without their repeated lines; ``n_chars`` follows the new text, other columns stay."""
    index = insert(empty_index(documents.sparkSession), documents)
    rest = [c for c in documents.columns if c not in ("doc_id", "text")]
    out = apply(index, documents, carry=rest)
    values = {c: F.col(f"carry_{i}") for i, c in enumerate(rest)} | {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in rest:
        values["n_chars"] = F.length("kept").cast(dict(documents.dtypes)["n_chars"])
    return out.select(*[values[c].alias(c) for c in documents.columns])
