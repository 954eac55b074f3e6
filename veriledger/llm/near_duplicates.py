"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

A document is the set of its distinct 5-word shingles; two are linked if 100 times the
intersection is at least 85 times the union, and components of links are groups.

1. ``_sketches``: per document the size and a 128-bit digest of its set, ``TREES`` signatures of
   ``DEPTH`` 16-bit MinHash values, and 128 one-bit MinHash values.  Documents with equal sets are one
   node from here on, so exact copies of any number cost one node.
2. LSH forest: every node stands in ``TREES`` orders sorted by signature (range-partitioned, so a
   region is cut rather than gathered).  Nodes that share at least ``MIN_DEPTH`` leading values with a
   longest-common-prefix neighbour are candidates.  In a region of up to ``NEIGHBOURS`` + 1 nodes these are
   all pairs, and a candidate whose one-bit values agree in ``MIN_AGREE`` places is a likely link.  All nodes of a
   crowded region, and of one that a partition's border cuts, go into one rough component untested, so that
   step 3 compares them exactly.  A pair at the limit of 0.85 shares
   5 values in one tree with probability 0.44, so it is missed in all 24 with 8e-7, and falls below
   104 of 128 agreeing bits with 1e-6; closer pairs far more rarely.
3. Connected components of likely links, then ``_confirm`` computes the true links on full sets inside
   each.  A component of up to ``BLOCK`` nodes is compared at once.  In a larger one, sorted blocks of
   ``ORDERS`` signature orders find most links in bounded memory, and ``_exact_links`` finds the others by a
   prefix-filter join: with the shingles of every set in one order, rare ones first, two linked sets share one
   of the first n - ceil(0.85 n) + 1 shingles of each.  Pairs that the blocks have joined already are left out.
4. Connected components of the confirmed links.

Edge cases: a text of fewer than five words is one shingle; without words, or null, the set is empty,
linked with nothing and kept.  Rows that share a ``doc_id`` count as one document.  Null ids are never
linked, have a null component and are kept.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriledger.llm.common import arrow_rows, connected_components, drop_ids, join_ids, materialise

WORDS = 5
PERCENT = 85
TREES, DEPTH, MIN_DEPTH = 24, 10, 5
NEIGHBOURS = 64
MIN_AGREE = 104
BLOCK, OVERLAP, ORDERS, CELL_DEPTH = 2000, 256, 6, 3
PART_WORDS = 100_000
COUNTERS = 1 << 20

_RANDOM = np.random.default_rng(11).integers(0, 1 << 32, (2, TREES * DEPTH), dtype=np.uint32)
_RANDOM[0] |= np.uint32(1)


class _WordHashes(dict):
    def __missing__(self, word):
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    hashes = _WordHashes()
    out = []
    for text in texts:
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
        h = np.fromiter((hashes[w] for w in found), np.uint64, len(found))
        if not len(h):
            out.append(h)
            continue
        n = max(1, len(h) - words + 1)
        s = np.full(n, min(words, len(h)), np.uint64)
        for j in range(min(words, len(h))):
            s = (s ^ h[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(32)
        out.append(np.unique(s))
        if len(hashes) > 1_000_000:
            hashes = _WordHashes()
    return out


def min_hashes(sets: list[np.ndarray], columns: slice = slice(None)) -> np.ndarray:
    """Low 16 bits of the smallest permuted shingle, per set (none empty) and permutation."""
    h = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    random = _RANDOM[:, columns]
    out = np.empty((len(sets), random.shape[1]), np.uint16)
    for k in range(random.shape[1]):
        out[:, k] = np.minimum.reduceat((h ^ random[1, k]) * random[0, k], starts).astype(np.uint16)
    return out


def _parts(sets: list[np.ndarray]) -> Iterator[list[int]]:
    part, size = [], 0
    for i, s in enumerate(sets):
        if len(s):
            part.append(i)
            size += len(s)
        if size >= PART_WORDS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _binary(rows: np.ndarray) -> list[bytes]:
    raw, width = rows.tobytes(), rows.shape[1] * rows.itemsize
    return [raw[i * width:(i + 1) * width] for i in range(len(rows))]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(batch.column(1).to_pylist())
        forest, bits = [None] * len(sets), [None] * len(sets)
        for part in _parts(sets):
            low = min_hashes([sets[i] for i in part])
            for i, f, b in zip(part, _binary(low.byteswap()), _binary(np.packbits(low[:, :128] >> 15, axis=1)), strict=True):
                forest[i], bits[i] = f, b
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            pa.array(forest, pa.binary()), pa.array(bits, pa.binary()),
        ], names=["doc_id", "n_shingles", "digest", "forest", "bits"])


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    data = column.cast(pa.binary(width)) if len(column) else column
    return np.frombuffer(data.buffers()[1], np.uint8)[data.offset * width:(data.offset + len(data)) * width].reshape(-1, width) if len(
        column) else np.zeros((0, width), np.uint8)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` nodes reaches over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _likely_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tree, signature): likely links ``(a, b)`` of nodes in a region.

    Rows with a ``border`` are the nodes of the partition's first and last region, which a neighbouring partition
    may hold too, with the first node of the region here; of a crowded region the first node does for all.
    """
    keep: tuple | None = None  # the last rows of the batch before
    head: tuple | None = None  # key and first node of the region that is open, and its rows so far
    start: bytes | None = None  # the region that the partition begins with

    def batch_of(a, b, border):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(border, pa.binary())], names=["a", "b", "border"])

    for batch in batches:
        key = np.concatenate([batch.column(0).to_numpy().astype(np.uint8)[:, None], _fixed(batch.column(1), 2 * DEPTH)[:, :2 * MIN_DEPTH]], axis=1)
        node, bits = batch.column(2).to_numpy(), _fixed(batch.column(3), 16).view(np.uint64)
        if not len(node):
            continue
        old = 0
        if keep is not None:
            old = len(keep[1])
            key, node, bits = (np.concatenate(x) for x in zip(keep, (key, node, bits), strict=True))
        new = np.append(True, (key[1:] != key[:-1]).any(1))
        region = np.cumsum(new) - 1
        first, size = node[np.flatnonzero(new)], np.bincount(region)
        if head is not None and (key[0] == head[0]).all():  # the region began before the rows kept, or with them
            first[0] = head[1]
            size[0] = head[2] + int((region[old:] == 0).sum())
        crowded = (size > NEIGHBOURS + 1)[region]
        a, b = [np.zeros(0, int)], [np.zeros(0, int)]
        for step in range(1, min(NEIGHBOURS + 1, len(node))):
            left = np.flatnonzero((region[step:] == region[:-step]) & ~crowded[step:])
            if not len(left):
                break
            a.append(left)
            b.append(left + step)
        a, b = np.concatenate(a), np.concatenate(b)
        agree = 128 - np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
        ok = (agree >= MIN_AGREE) & (node[a] != node[b])
        label = _labels(len(node), a[ok], b[ok])
        at = np.flatnonzero(label != np.arange(len(node)))
        out_a, out_b = [node[at], node[crowded]], [node[label[at]], first[region[crowded]]]
        border: list[bytes | None] = [None] * sum(map(len, out_a))
        if start is None:
            start = key[0].tobytes()
        if head is None or head[0].tobytes() == start:
            some = node[region == 0] if size[0] <= NEIGHBOURS + 1 else first[:1]
            out_a.append(some)
            out_b.append(np.full(len(some), first[0]))
            border += [start] * len(some)
        head = (key[-1].copy(), first[-1], int(size[-1]))
        keep = (key[-NEIGHBOURS - 1:].copy(), node[-NEIGHBOURS - 1:].copy(), bits[-NEIGHBOURS - 1:].copy())
        yield batch_of(np.concatenate(out_a), np.concatenate(out_b), border)
    if head is not None:
        some = keep[1][(keep[0] == head[0]).all(1)] if head[2] <= NEIGHBOURS + 1 else np.array([head[1]])
        yield batch_of(some, np.full(len(some), head[1]), [head[0].tobytes()] * len(some))


def _rough_links(likely: DataFrame) -> DataFrame:
    """The links of ``_likely_links``, and those of regions that lie in several partitions."""
    edge = likely.where("border is not null")
    several = edge.groupBy("border").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low != high")
    across = edge.join(several, "border").select("a", "b", "low")
    return likely.where("border is null").select("a", "b").union(across.select("a", F.col("low").alias("b"))).union(
        across.select("b", F.col("low").alias("b_"))).distinct()


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(component, tree, cell, sig, doc_id, data)``; nodes of large components once for each of ``ORDERS`` orders."""
    for batch in batches:
        component, big, ids, texts = (batch.column(i).to_pylist() for i in range(4))
        sets = shingle_sets(texts)
        rows = []
        for i, s in enumerate(sets):
            if not len(s):
                continue
            if not big[i]:
                rows.append((component[i], 0, b"", b"", ids[i], s.tobytes()))
                continue
            low = min_hashes([s], slice(0, ORDERS * DEPTH)).byteswap().tobytes()
            for t in range(ORDERS):
                sig = low[2 * DEPTH * t:2 * DEPTH * (t + 1)]
                rows.append((component[i], t, sig[:2 * CELL_DEPTH], sig, ids[i], s.tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         names=["component", "tree", "cell", "sig", "doc_id", "data"])


def true_links(ids: list[int], sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """(document, smallest document of its group) by exact links between all the sets given.

    One set is compared with all others; only sets outside the largest group found so are compared
    with all others in turn, because links inside that group cannot change the groups.
    """
    size = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(code, kind="stable")
    holders = owner[order]
    count = np.bincount(code)
    begin = np.cumsum(count) - count
    ends = np.cumsum(size)

    def linked(i: int) -> np.ndarray:
        mine = code[ends[i] - size[i]:ends[i]]
        n = count[mine]
        at = np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(holders[at], minlength=len(sets))
        return np.flatnonzero(100 * both >= percent * (size[i] + size - both))

    around = linked(0)
    a, b = [np.zeros(len(around), int)], [around]
    for i in np.setdiff1d(np.arange(len(sets)), around, assume_unique=True).tolist():
        found = linked(i)
        a.append(np.full(len(found), i))
        b.append(found)
    names = np.array(ids)
    by_name = np.argsort(names, kind="stable")
    place = np.empty(len(names), int)
    place[by_name] = np.arange(len(names))
    label = _labels(len(names), place[np.concatenate(a)], place[np.concatenate(b)])
    names = names[by_name]
    return [(int(names[i]), int(names[k])) for i, k in enumerate(label) if i != k]


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links of rows sorted by (component, tree, cell, sig)."""
    group, ids, sets = None, [], []

    def done(out):
        if len(ids) > 1:
            out += true_links(ids, sets)

    for batch in batches:
        out: list[tuple[int, int]] = []
        keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        for key, doc, data in zip(keys, batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
            if key != group:
                done(out)
                group, ids, sets = key, [], []
            elif len(ids) >= BLOCK and key[2]:
                done(out)
                ids, sets = ids[-OVERLAP:], sets[-OVERLAP:]
            ids.append(doc)
            sets.append(np.frombuffer(data, np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
    out = []
    done(out)
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of column 0's texts fall on each of ``COUNTERS`` counters."""
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for s in shingle_sets(batch.column(0).to_pylist()):
            np.add.at(total, (s % np.uint64(COUNTERS)).astype(np.int64), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["counter", "n"])


def _prefixes(counts: np.ndarray, percent: int = PERCENT):
    """Rows ``(component, token, doc_id, n, rest)``: the rarest shingles of every set, those that a linked set must share.

    ``rest`` counts the shingles from this one on; the order is the same for all sets: by counter, then by hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            component, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
            for i, s in enumerate(shingle_sets(texts)):
                n = len(s)
                first = s[np.lexsort((s, counts[(s % np.uint64(COUNTERS)).astype(np.int64)]))][:n - -(-percent * n // 100) + 1]
                k = len(first)
                for column, x in zip(columns, (np.full(k, component[i]), first.view(np.int64), np.full(k, ids[i]), np.full(k, n), n - np.arange(k)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns],
                                             names=["component", "token", "doc_id", "n", "rest"])

    return run


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "data"])


def _linked_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs ``(a, b)`` of rows ``(a, b, set of a, set of b)`` that are linked."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _exact_links(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Links ``(a, b)`` inside the components of ``texts(component, doc_id, text)`` between sets that ``known(a, b)`` does not join."""
    total = texts.select("text").mapInArrow(_shingle_counts, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[total.column("counter").to_numpy()] = total.column("n").to_numpy()
    joined = connected_components(known).select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    prefixes = texts.mapInArrow(_prefixes(counts), "component long, token long, doc_id long, n long, rest long").join(joined, "doc_id", "left").select(
        "component", "token", "doc_id", "n", "rest", F.coalesce("label", "doc_id").alias("label"))
    prefixes = materialise(prefixes)
    other = prefixes.select(*[F.col(c).alias(f"{c}_b") for c in prefixes.columns])
    # the first shingle that two sets share bounds what they share; this holds the size filter too
    room = (100 + PERCENT) * F.least("rest", "rest_b") >= PERCENT * (F.col("n") + F.col("n_b"))
    same = (F.col("component") == F.col("component_b")) & (F.col("token") == F.col("token_b"))
    pairs = materialise(prefixes.join(other, same & (F.col("doc_id") < F.col("doc_id_b")) & (F.col("label") != F.col("label_b")) & room)
                        .select(F.col("doc_id").alias("a"), F.col("doc_id_b").alias("b")).distinct())
    sets = materialise(texts.select("doc_id", "text").mapInArrow(_sets_of, "doc_id long, data binary"))
    a, b = (sets.select(F.col("doc_id").alias(c), F.col("data").alias(f"data_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "data_a", "data_b").mapInArrow(_linked_pairs, "a long, b long")


def groups(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``documents(doc_id, text)``."""
    docs = arrow_rows(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = materialise(docs.mapInArrow(_sketches, "doc_id long, n_shingles long, digest binary, forest binary, bits binary"))
    nodes = table.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"))
    entries = table.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select(
        F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "doc_id", "forest", "bits")
    width = 2 * DEPTH
    entries = entries.select("tree", F.substring("forest", F.col("tree") * width + 1, F.lit(width)).alias("sig"), "doc_id", "bits")
    likely = entries.repartitionByRange("tree", "sig", "doc_id").sortWithinPartitions("tree", "sig", "doc_id").mapInArrow(
        _likely_links, "a long, b long, border binary")
    rough = connected_components(_rough_links(materialise(likely.distinct())))
    sizes = rough.groupBy("component").agg((F.count(F.lit(1)) > BLOCK).alias("big"))
    members = materialise(rough.join(sizes, "component").select("component", "big", F.col("node").alias("doc_id")))
    texts = join_ids(docs, members).select("component", "big", "doc_id", "text")
    sets = texts.mapInArrow(_full_sets, "component long, tree int, cell binary, sig binary, doc_id long, data binary")
    links = sets.repartition("component", "tree", "cell").sortWithinPartitions("component", "tree", "cell", "sig").mapInArrow(
        _confirm, "a long, b long")
    large = members.where("big").drop("big")
    if not large.isEmpty():
        # rows that share an id count once
        large = materialise(join_ids(docs, large).dropDuplicates(["doc_id"]).select("component", "doc_id", "text"))
        links = materialise(links)
        links = links.union(_exact_links(large, links))
    found = connected_components(links)
    node = nodes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = table.select("doc_id", "n_shingles", "digest").join(node, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents that stand for their group, all columns kept."""
    return drop_ids(documents, materialise(groups(documents).where("not kept").select("doc_id").distinct()))
