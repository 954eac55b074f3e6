"""Removal of byte strings that repeat across documents, by suffix intervals of a Burrows-Wheeler transform.

A byte is removed if it lies in a string of ``length`` bytes that also starts in a document with
a smaller ``doc_id``.  The corpus is never sorted as one text.  Every window of ``length`` bytes
has a minimiser, the smallest hash among its ``SEED``-byte substrings; equal windows have equal
minimisers, so runs of windows with one minimiser (``length`` - 1 bytes more than windows) can be
sorted shard by shard:

1. ``_runs_of_batch`` finds the runs; values met in several documents of a batch are marked at once and
   sent on as one entry, so a passage that a third of all documents share costs one entry per batch.
2. ``_repeated`` keeps, per shard of values, the runs whose value is met in two documents.
3. ``_texts_of_runs`` cuts the bytes of marked runs; equal bytes of a batch go on once, with the
   smallest document, and the others are removed at once.  Runs of a value with more than ``HOT``
   entries in the whole corpus are sent window by window, keyed by the window, so that they spread;
   ``_repeated`` decides that once per value and tells every document shard.
4. ``_removed`` concatenates the distinct runs of a shard, builds their Burrows-Wheeler transform, and
   derives common prefixes by increasing value with breadth-first backward extension
   (``short_prefixes``), stopping at ``length``: what is left between two shorter prefixes are equal windows.
   A run whose value no other distinct run has is left out: equal windows lie in runs of one value.
5. ``_cut_texts`` unites the removed ranges of every document.

Edge cases: null text is empty; texts shorter than ``length`` bytes lose nothing.  A repeat within one
document, or between rows that share a ``doc_id``, is no repeat.  Rows that repeat id and text are
judged alike.  A null ``doc_id`` counts as smaller than all others.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriledger.llm.common import arrow_rows

LENGTH = 50
SEED = 20
SHARD_BYTES = 12 << 20
PIECE_BYTES = 2 << 20
HOT = 20_000
CHUNK = 1 << 16  # arrays of so many numbers stay in a core's cache
DENSE = 5  # all intervals are extended at once while those of interest hold more than a fifth of the suffixes
NO_DOC = np.iinfo(np.int64).min

_MIX = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def _seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the ``seed`` bytes that start at every position (positions near the end are left out)."""
    power = {1: _MIX[data]}
    m = 1
    while m * 2 <= seed:
        h = power[m]
        power[2 * m] = h[:-m] * np.uint64(pow(_BASE, m, 1 << 64)) + h[m:]
        m *= 2
    out, have = power[m], m
    while have < seed:
        m //= 2
        if seed - have >= m:
            n = len(data) - have - m + 1
            out = out[:n] * np.uint64(pow(_BASE, m, 1 << 64)) + power[m][have:have + n]
            have += m
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    m, have = h, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[:len(h) - width + 1], m[width - have:][:len(h) - width + 1])
    return m


def _runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(value, document index, start in the document, windows) of every run; data: bytes of several documents."""
    found = []
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        lo, hi = offsets[first], offsets[last]
        if hi - lo >= length:
            low = _window_min(_seed_hashes(data[lo:hi], SEED), length - SEED + 1)
            starts, ends = offsets[first:last] - lo, offsets[first + 1:last + 1] - lo
            inside = np.zeros(len(low) + 1, np.int32)
            ok = ends - starts >= length
            np.add.at(inside, starts[ok], 1)
            np.add.at(inside, ends[ok] - length + 1, -1)
            inside = np.cumsum(inside[:-1]) > 0
            edge = np.empty(len(low), bool)
            edge[0] = True
            edge[1:] = (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])
            edge[starts[ok]] = True
            at = np.flatnonzero(edge)
            size = np.diff(np.append(at, len(low)))
            keep = inside[at]
            at, size = at[keep], size[keep]
            doc = np.searchsorted(starts, at, "right") - 1
            # a run of empty documents shares its start: searchsorted takes the last of them, the one with bytes
            found.append((low[at], doc + first, at - starts[doc], size))
        first = last
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _doc_ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(NO_DOC)).to_numpy(zero_copy_only=False)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _planes(column: np.ndarray) -> bytes:
    """Bytes of equal significance side by side, so that constant ones compress to nothing."""
    return np.ascontiguousarray(column.view(np.uint8).reshape(len(column), -1).T).tobytes()


def _from_planes(data: bytes, at: int, kind, n: int) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel(), at + n * size


def _pack(value, row, start, size) -> bytes:
    """Run entries: 48 bits of the value, then document, start and windows.

    A shorter value can only mark a run too many; what is removed is decided on the bytes.
    """
    return b"".join((_planes(value)[2 * len(value):], _planes(row), _planes(start.astype(np.int32)),
                     _planes(size.astype(np.int32))))


def _unpack(ns, blobs) -> list[np.ndarray]:
    kinds = (np.int64, np.int32, np.int32)
    columns = [[np.zeros(0, k)] for k in (np.uint64, *kinds)]
    for n, data in zip(ns, blobs, strict=True):
        value, _ = _from_planes(bytes(2 * n) + data[:6 * n], 0, np.uint64, n)
        columns[0].append(value)
        at = 6 * n
        for kind, column in zip(kinds, columns[1:], strict=True):
            found, at = _from_planes(data, at, kind, n)
            column.append(found)
    return [np.concatenate(c) for c in columns]


def _dealt(at: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, indices) of every shard that is met."""
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, order[cuts[s]:cuts[s + 1]]


def _home(ids: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a document; ``_home_column`` is the same for a column."""
    return (ids ^ (ids >> 7) ^ (ids >> 17)) % shards


def _home_column(shards: int):
    i = F.col("doc_id")
    return F.pmod(i.bitwiseXOR(F.shiftright(i, 7)).bitwiseXOR(F.shiftright(i, 17)), F.lit(shards)).cast("int")


def _named(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids of one document shard and hashes that tell rows of one id apart; where an id has one row the hash is 0, which packs to nothing."""
    ids, th = _doc_ids(docs.column("doc_id").combine_chunks()), docs.column("th").to_numpy()
    _, place, count = np.unique(ids, return_inverse=True, return_counts=True)
    return ids, np.where(count[place] > 1, th, 0)


def _runs_of_batch(shards: int, length: int):
    """Rows ``(shard, sure, n, data)``: packed run entries; ``sure`` ones are known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _doc_ids(batch.column(0))
            value, doc, start, size = _runs(*_bytes_of(batch.column(1)), length)
            if not len(value):
                continue
            row = ids[doc]
            value &= ~np.uint64(0xFFFF)
            order = np.argsort(value)
            value, row, start, size = (x[order] for x in (value, row, start, size))
            heads = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            counts = np.diff(np.append(heads, len(value)))
            several = np.repeat(np.minimum.reduceat(row, heads) != np.maximum.reduceat(row, heads), counts)
            # entries known to repeat go on as they are; one of each tells the value's shard (start -1, their number as size)
            entry = ~several
            entry[heads] = True
            told, number = np.where(several, -1, start), np.where(several, np.repeat(counts, counts), size)
            rows = []
            for sure, pick, at, begin, many in ((0, entry, (value >> np.uint64(20)) % np.uint64(shards), told, number),
                                                (1, several, _home(row, shards), start, size)):
                take = np.flatnonzero(pick)
                for s, k in _dealt(at[take].astype(np.int64), shards):
                    k = take[k]
                    rows.append((s, sure, len(k), _pack(value[k], row[k], begin[k], many[k])))
            yield _batch_of(rows)

    return run


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "kind", "n", "data"])


def _repeated(shards: int):
    """Runs of one shard whose value is met in two documents, packed for the documents' shards.

    Rows of kind 2 tell all of these the hot values, those with more than ``HOT`` entries in all batches.
    """

    def run(table: pa.Table) -> pa.Table:
        kind, n, data = (table.column(c).to_pylist() for c in ("kind", "n", "data"))
        told = [i for i, k in enumerate(kind) if k == 0]
        value, row, start, size = _unpack([n[i] for i in told], [data[i] for i in told])
        order = np.argsort(value, kind="stable")
        value, row, start, size = (x[order] for x in (value, row, start, size))
        keep, hot = np.zeros(0, bool), np.zeros(0, np.uint64)
        if len(value):
            heads = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            counts = np.diff(np.append(heads, len(value)))
            several = np.minimum.reduceat(row, heads) != np.maximum.reduceat(row, heads)
            several |= np.minimum.reduceat(start, heads) < 0
            keep = np.repeat(several, counts) & (start >= 0)
            hot = value[heads[several & (np.add.reduceat(np.where(start < 0, size, 1).astype(np.int64), heads) > HOT)]]
        rows = [(s, 0, len(k), _pack(value[keep][k], row[keep][k], start[keep][k], size[keep][k]))
                for s, k in _dealt(_home(row[keep], shards), shards)]
        rows += [(table.column("shard")[i].as_py(), 1, n[i], data[i]) for i, k in enumerate(kind) if k == 1]
        if len(hot):
            rows += [(s, 2, len(hot), hot.tobytes()) for s in range(shards)]
        return pa.Table.from_batches([_batch_of(rows)])

    return run


def _texts_of_runs(shards: int, cells: int, length: int):
    """Rows ``(shard, kind, n, data)``: packed distinct runs for one of ``cells`` (0), or removed ranges of a document shard (1)."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows or not found.num_rows:
            return pa.Table.from_batches([_batch_of([])])
        ids, th = _named(docs)
        data, offsets = _bytes_of(docs.column("text").combine_chunks())
        raw = data.tobytes()
        packed = list(zip(*(found.column(c).to_pylist() for c in ("kind", "n", "data")), strict=True))
        value, row, start, size = _unpack([n for k, n, _ in packed if k != 2], [x for k, _, x in packed if k != 2])
        hot = np.isin(value, np.frombuffer(b"".join(x for k, _, x in packed if k == 2), np.uint64))
        by_id = np.argsort(ids, kind="stable")
        low, high = np.searchsorted(ids[by_id], row, "left"), np.searchsorted(ids[by_id], row, "right")
        count = high - low  # several rows may share an id
        mark = np.repeat(np.arange(len(row)), count)
        doc = by_id[np.repeat(low - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(int(count.sum()))]
        order = np.argsort(ids[doc], kind="stable")
        fits = start[mark] + size[mark] + length - 1 <= np.diff(offsets)[doc]
        order = order[fits[order]]
        first: dict[bytes, int] = {}
        gone: list[tuple[int, int, int]] = []
        kept: list[tuple[int, int, int, bytes]] = []
        picked = zip(doc[order].tolist(), ids[doc[order]].tolist(), offsets[doc[order]].tolist(), *(
            x[mark[order]].tolist() for x in (value, start, size, hot)), strict=True)
        for d, name, base, v, s, z, many in picked:
            if many:
                pieces = [(None, s + j, raw[base + s + j:base + s + j + length]) for j in range(z)]
            else:
                pieces = [(v, s, raw[base + s:base + s + z + length - 1])]
            for v, s, text in pieces:
                if first.setdefault(text, name) < name:
                    gone.append((d, s, s + len(text)))
                else:
                    if v is None:
                        v = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little") & ~0xFFFF
                    kept.append((v, d, s, text))
        kept.sort(key=lambda p: p[0])
        v, d, s = (np.array([p[j] for p in kept], k) for j, k in ((0, np.uint64), (1, np.int64), (2, np.int32)))
        z = np.array([len(p[3]) for p in kept], np.int32)
        press = zstandard.ZstdCompressor(level=3)
        mark = (v >> np.uint64(32)).astype(np.uint32)
        rows = [(at, 0, len(k), b"".join((_planes(mark[k]), _planes(ids[d[k]]), _planes(th[d[k]]), _planes(s[k]), _planes(z[k]),
                                          press.compress(b"".join([kept[i][3] for i in k.tolist()])))))
                for at, k in _dealt(((v >> np.uint64(20)) % np.uint64(cells)).astype(np.int64), cells)]
        ranges = np.array(gone, np.int64).reshape(-1, 3)
        rows += _ranges_by_home(ids[ranges[:, 0]], th[ranges[:, 0]], ranges[:, 1], ranges[:, 2], shards)
        return pa.Table.from_batches([_batch_of(rows)])

    return run


def _ranges_by_home(ids, th, start, end, shards: int) -> list[tuple]:
    """Rows (document shard, 1, n, data) of ranges, those that touch united."""
    order = np.lexsort((start, th, ids))
    ids, th, start, end = (x[order] for x in (ids, th, start, end))
    if len(ids):
        # within a document the largest end so far: shifting documents apart makes one running maximum do
        doc = np.cumsum(np.append(0, (ids[1:] != ids[:-1]) | (th[1:] != th[:-1])))
        reach = np.maximum.accumulate(end + doc * (1 << 32))
        new = np.append(True, (start + doc * (1 << 32))[1:] > reach[:-1])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(ids)) - 1
        ids, th, start, end = ids[heads], th[heads], start[heads], reach[tails] - doc[tails] * (1 << 32)
    return [(s, 1, len(k), b"".join((_planes(ids[k]), _planes(th[k]), _planes(start[k].astype(np.int32)), _planes(end[k].astype(np.int32)))))
            for s, k in _dealt(_home(ids, shards), shards)]


def _quads(ns, blobs) -> list[np.ndarray]:
    """(document, hash, start, end or size) of packed rows."""
    kinds = (np.int64, np.int64, np.int32, np.int32)
    columns = [[np.zeros(0, k)] for k in kinds]
    for n, data in zip(ns, blobs, strict=True):
        at = 0
        for kind, column in zip(kinds, columns, strict=True):
            found, at = _from_planes(data, at, kind, n)
            column.append(found)
    return [np.concatenate(c) for c in columns]


def _order_of(key: np.ndarray, bits: int) -> np.ndarray:
    """Indices that sort keys of ``bits`` bits; key and index are sorted as one word where both fit, which is faster."""
    low = len(key).bit_length()
    if bits + low > 64:
        return np.argsort(key)
    both = key << np.uint64(low)
    both |= np.arange(len(key), dtype=np.uint64)
    both.sort()
    both &= np.uint64((1 << low) - 1)
    return both.astype(np.int64)


def sorted_suffixes(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of ``data`` by the first ``depth`` (or more) symbols, by prefix doubling; the start follows the end.

    Only suffixes that still tie with another one are sorted again.
    """
    n = len(data)
    met = np.bincount(data, minlength=256) > 0
    bits = max(1, int(met.sum() - 1).bit_length())
    have = min(8, max(1, (64 - n.bit_length()) // bits))
    ring = (np.cumsum(met) - 1).astype(np.uint64)[np.append(data, np.resize(data, have))]
    key = ring[:n].copy()
    for j in range(1, have):
        key <<= np.uint64(bits)
        key |= ring[j:j + n]
    order = _order_of(key, have * bits)
    key = key[order]
    head = np.append(True, key[1:] != key[:-1])
    # the rank of a suffix is the place where those that tie with it begin
    rank = np.empty(n, np.uint64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    wide = n.bit_length()
    while have < depth:
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            break
        at = order[tied]
        after = at + have
        after[after >= n] %= n
        key = rank[at] << np.uint64(wide)
        key |= rank[after]
        by_key = _order_of(key, 2 * wide)
        at, key = at[by_key], key[by_key]
        fresh = np.append(True, key[1:] != key[:-1])
        order[tied], head[tied] = at, fresh
        rank[at] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        have *= 2
    return order


def short_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """True at every rank whose suffix shares fewer than ``depth`` symbols with the suffix before it.

    Breadth-first backward extension: an interval of suffixes that begin with a string w is
    extended by every symbol c that precedes one of them.  The end of the interval of cw is a
    border of common prefix |w|, unless a shorter one was found there before; only intervals
    that set a border are extended again.  Values appear in increasing order and the search stops at ``depth``.
    While the intervals that set a border hold many suffixes, all intervals are extended at once.
    """
    n = len(data)
    bwt = data[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    turn = np.append(True, np.diff(bwt[by_symbol]) != 0)
    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    left, right = np.array([0], np.int32), np.array([n], np.int32)
    level = 0
    while level < depth and DENSE * int((right - left).sum()) > n:
        # neighbours that follow one symbol part where the suffixes after it lie in different intervals
        of = np.cumsum(border[:n], dtype=np.int32)[by_symbol]
        fresh = turn.copy()
        fresh[1:] |= of[1:] != of[:-1]
        fresh &= ~border[:n]
        border[:n] |= fresh
        at = np.flatnonzero(border).astype(np.int32)
        pick = np.append(fresh, False)[at[1:]]
        left, right = at[:-1][pick], at[1:][pick]
        level += 1
    if level == depth or not len(left):
        return border[:n]
    forward = np.empty(n, np.int32)
    forward[by_symbol] = np.arange(n, dtype=np.int32)
    nxt, prv = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    same = ~turn[1:]
    nxt[by_symbol[:-1][same]] = by_symbol[1:][same]
    prv[by_symbol[1:][same]] = by_symbol[:-1][same]
    for _ in range(level, depth):
        if not len(left):
            break
        total = np.cumsum(right - left, dtype=np.int64)
        lefts, rights = [], []
        at = 0
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, "right")))
            lo, hi = left[at:to], right[at:to]
            size = hi - lo
            place = np.arange(int(size.sum()), dtype=np.int32) + np.repeat(lo - (np.cumsum(size) - size).astype(np.int32), size)
            ends = forward[place[nxt[place] >= np.repeat(hi, size)]] + 1
            begins = forward[place[prv[place] < np.repeat(lo, size)]]
            ends.sort()
            begins.sort()
            lefts.append(begins)
            rights.append(ends)
            at = to
        left, right = np.concatenate(lefts), np.concatenate(rights)
        fresh = ~border[right]
        left, right = left[fresh], right[fresh]
        border[right] = True
    return border[:n]


def repeats(texts: list[bytes], docs: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) of the ranges of each text covered by windows that also lie in a text of a smaller document."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    order = sorted_suffixes(data, length)
    group = np.cumsum(short_prefixes(data, order, length)) - 1
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    place = np.arange(len(data)) - starts[owner]
    whole = place + length <= sizes[owner]
    doc = np.where(whole, docs[owner], np.iinfo(np.int64).max)
    ranked = doc[order]
    low = np.minimum.reduceat(ranked, np.flatnonzero(np.append(True, group[1:] != group[:-1])))
    gone = np.empty(len(data), bool)
    gone[order] = low[group] < ranked
    hit = np.flatnonzero(gone & whole)
    if not len(hit):
        return
    split = np.append(True, (np.diff(hit) > length) | (owner[hit[1:]] != owner[hit[:-1]]))
    heads = np.flatnonzero(split)
    tails = np.append(heads[1:], len(hit)) - 1
    for a, b in zip(hit[heads].tolist(), hit[tails].tolist(), strict=True):
        t = int(owner[a])
        yield t, a - int(starts[t]), b - int(starts[t]) + length


def _removed(shards: int, length: int):
    """Removed ranges of one shard of runs, packed for the documents' shards."""

    def run(table: pa.Table) -> pa.Table:
        kind, n, data = (table.column(c).to_pylist() for c in ("kind", "n", "data"))
        # equal runs of several batches: the smallest document stands for them, the others go whole
        first: dict[bytes, tuple[int, ...]] = {}  # document, then hash and start of each place
        marks: list[int] = []  # of the texts in ``first``: 32 bits of the value
        out: list[tuple[int, int, int, int]] = []
        press = zstandard.ZstdDecompressor()
        for k, m, packed in zip(kind, n, data, strict=True):
            if k == 1:
                continue
            at, whole = 0, press.decompress(packed[28 * m:])
            mark, _ = _from_planes(packed, 0, np.uint32, m)
            for v, d, t, s, z in zip(*(x.tolist() for x in (mark, *_quads([m], [packed[4 * m:]]))), strict=True):
                text = whole[at:at + z]
                at += z
                old = first.get(text)
                if old is None:
                    first[text] = (d, t, s)
                    marks.append(v)
                elif old[0] > d:
                    first[text] = (d, t, s)
                    out.extend((old[0], *old[j:j + 2], old[j + 1] + z) for j in range(1, len(old), 2))
                elif old[0] < d:
                    out.append((d, t, s, s + z))
                else:  # the same document holds it twice: both stand
                    first[text] = (*old, t, s)
        # equal windows lie in runs of one value: a run that is alone with its value shares nothing with the others
        _, place, count = np.unique(np.array(marks, np.uint32), return_inverse=True, return_counts=True)
        texts = [text for text, several in zip(first, (count[place] > 1).tolist(), strict=True) if several]
        if texts:
            for k, a, b in repeats(texts, np.array([first[t][0] for t in texts], np.int64), length):
                places = first[texts[k]]
                out.extend((places[0], places[j], places[j + 1] + a, places[j + 1] + b) for j in range(1, len(places), 2))
        found = np.array(out, np.int64).reshape(-1, 4)
        rows = _ranges_by_home(found[:, 0], found[:, 1], found[:, 2], found[:, 3], shards)
        rows += [(table.column("shard")[i].as_py(), 1, n[i], data[i]) for i, k in enumerate(kind) if k == 1]
        return pa.Table.from_batches([_batch_of(rows)])

    return run


def _united(start: np.ndarray, end: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal ranges covered by the given ones."""
    order = np.argsort(start, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(start[order].tolist(), np.minimum(end[order], size).tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut_texts(docs: pa.Table, found: pa.Table) -> pa.Table:
    """The result rows of one shard of documents."""
    ids, th = _named(docs)
    data, offsets = _bytes_of(docs.column("text").combine_chunks())
    raw = data.tobytes()
    where: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, t, a, b in zip(*(x.tolist() for x in _quads(found.column("n").to_pylist(), found.column("data").to_pylist())), strict=True):
        where.setdefault((d, t), []).append((a, b))
    removed, spans, digests = [], [], []
    for i, key in enumerate(zip(ids.tolist(), th.tolist(), strict=True)):
        text = raw[offsets[i]:offsets[i + 1]]
        gone = np.array(where.get(key, []), np.int64).reshape(-1, 2)
        gone = _united(gone[:, 0], gone[:, 1], len(text)) if len(gone) else []
        at, digest = 0, hashlib.sha256()
        for a, b in gone:
            digest.update(text[at:a])
            at = b
        digest.update(text[at:])
        removed.append(sum(b - a for a, b in gone))
        spans.append([{"start": a, "end": b} for a, b in gone])
        digests.append(digest.hexdigest())
    return pa.table({
        "doc_id": pa.array(ids, mask=ids == NO_DOC), "n_bytes": pa.array(np.diff(offsets), pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        "kept_sha256": pa.array(digests, pa.string())})


def removed_spans(documents: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept_sha256`` per row of ``documents(doc_id, text)``; spans are byte ranges."""
    if length < SEED + 2:
        raise ValueError(f"length must be at least {SEED + 2}")
    # equal runs are combined batch by batch, so batches are larger here
    docs = arrow_rows(documents, 10_000).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_DOC))).alias("doc_id"),
                            F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    cells = max(1, -(-total // PIECE_BYTES))
    packed = "shard int, kind int, n int, data binary"
    homes = docs.select(_home_column(shards).alias("shard"), "doc_id", "text", F.xxhash64("text").alias("th"))
    runs = docs.mapInArrow(_runs_of_batch(shards, length), packed)
    marks = runs.groupBy("shard").applyInArrow(_repeated(shards), packed)
    pieces = homes.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(_texts_of_runs(shards, cells, length), packed)
    ranges = pieces.groupBy("shard").applyInArrow(_removed(shards, length), packed)
    return homes.groupBy("shard").cogroup(ranges.groupBy("shard")).applyInArrow(
        _cut_texts, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept_sha256 string")


def digest(documents: DataFrame) -> DataFrame:
    return removed_spans(documents).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
