"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has one slot per hash value and one bit per language in each slot; the
AND of an n-gram's slots is the set of languages that contain it.  A text's n-grams are looked up,
the bits are counted per language, the counts are corrected for the filter's false positives, and
the language with the most corrected hits wins.

Fitting takes, per language, about ``SAMPLE_DOCS`` labelled texts (those with the smallest hash of their
id, all if fewer) and keeps an n-gram for a language if it stands in at least ``MIN_SHARE`` of its
sampled texts, and in a share at least ``SPREAD`` times that of the other languages on average: n-grams common
to all tell nothing.  The filter has ``SLOTS_PER_GRAM`` slots or more for each n-gram of the language that keeps
most, so a false positive stays below (1 - exp(-HASHES / SLOTS_PER_GRAM)) ** HASHES, 1.4 %, however long the texts
are; its size follows the sample, not the corpus, and it ships with the tasks.

Edge cases: null text, and text without a letter, is ``und`` with score 0.  A text with letters but no known
n-gram gets the most frequent language with score 0.  Ties go to the first language by name.  Without any
labelled text every prediction is ``und``.  Rows that repeat are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledger.llm.common import arrow_rows

SAMPLE_DOCS = 2000
SIZES = (1, 2, 3, 4)
MIN_SHARE = 0.01
SPREAD = 3.0
SLOTS_LEAST = 1 << 16
SLOTS_PER_GRAM = 16
HASHES = 2
BATCH_CHARS = 1 << 17
HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    """Rows that fitting never sees: crc32 of the id as text, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, with every run of non-letters as one space; and the text each belongs to."""
    lowered = [t.lower() for t in texts]  # one by one: a final sigma depends on what follows it
    raw = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    return raw, owner


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters; only those that occur are looked up."""
    table = np.bincount(codes, minlength=1) > 0
    for c in np.flatnonzero(table).tolist():
        table[c] = chr(c).isalpha()
    return table[codes]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index) of all n-grams of the texts' words, with one space at each end; and per text whether it has a letter."""
    codes, owner = _codes(texts)
    letter = _letters(codes)
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    # a non-letter stays only where a word begins or ends, as a space
    edge = np.zeros(len(codes), bool)
    if len(codes):
        edge[1:] |= letter[:-1] & (owner[1:] == owner[:-1])
        edge[:-1] |= letter[1:] & (owner[1:] == owner[:-1])
    keep = letter | edge
    codes, owner, space = np.where(letter, codes, 32)[keep].astype(np.uint64), owner[keep], ~letter[keep]
    hashes, owners = [], []
    for n in SIZES:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j:j + m]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        ok = owner[:m] == owner[n - 1:]
        for j in range(1, n - 1):  # spaces at the ends only: n-grams do not cross words
            ok &= ~space[j:j + m]
        if n == 2:
            ok &= ~(space[:m] & space[1:])
        if n == 1:
            ok &= ~space
        hashes.append(h[ok])
        owners.append(owner[:m][ok])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    return np.concatenate(hashes), np.concatenate(owners), has


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of a column in parts of about ``BATCH_CHARS`` characters; null is empty."""
    texts = column.fill_null("").to_pylist()
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BATCH_CHARS or i == len(texts) - 1:
            yield first, texts[first:i + 1]
            first, size = i + 1, 0


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, gram, n)``: texts of a batch that hold the n-gram, by language."""
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist())
        for first, texts in _parts(batch.column(0)):
            gram, owner, _ = _grams(texts)
            if not len(gram):
                continue
            order = np.argsort(gram, kind="stable")
            gram, owner = gram[order], owner[order]
            new = np.append(True, gram[1:] != gram[:-1])
            one = np.append(True, owner[1:] != owner[:-1]) | new  # owners ascend within an n-gram
            names, code = np.unique(langs[first:first + len(texts)], return_inverse=True)
            group = (np.cumsum(new) - 1)[one] * len(names) + code[owner[one]]
            n = np.bincount(group, minlength=int(new.sum()) * len(names))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[at % len(names)]), pa.array(gram[new][at // len(names)].view(np.int64)), pa.array(n[at], pa.int64())],
                names=["lang", "gram", "n"])


def _slots(gram: np.ndarray, k: int, bits: int) -> np.ndarray:
    h = gram * np.uint64((0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)[k % 3])
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Filter:
    """Bit-sliced Bloom filter: ``words[slot]`` has one bit per language.

    ``slots``: a power of two; by default as many as the n-grams of the fullest language need.
    """

    def __init__(self, langs: list[str], grams: list[np.ndarray], default: str, slots: int | None = None):
        self.langs, self.default = langs, default
        need = max(SLOTS_LEAST, SLOTS_PER_GRAM * max(map(len, grams), default=0))
        self.bits = ((slots or need) - 1).bit_length()
        self.words = np.zeros((-(-len(langs) // 64) or 1, 1 << self.bits), np.uint64)
        rates = []
        for i, found in enumerate(grams):
            for k in range(HASHES):
                self.words[i // 64][_slots(found, k, self.bits)] |= np.uint64(1 << (i % 64))
            rates.append((((self.words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** HASHES)
        self.false_rate = np.array(rates)

    def hits(self, gram: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits per (text, language), and n-grams per text."""
        total = np.bincount(owner, minlength=n).astype(float)
        out = np.zeros((n, len(self.langs)))
        places = [_slots(gram, k, self.bits) for k in range(HASHES)]
        for w, row in enumerate(self.words):
            mask = row[places[0]]
            for place in places[1:]:
                mask &= row[place]
            some = np.flatnonzero(mask)
            mask, who = mask[some], owner[some]
            for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                hit = (mask >> np.uint64(i % 64)) & np.uint64(1)
                out[:, i] = np.bincount(who, weights=hit, minlength=n)
        out = (out - total[:, None] * self.false_rate) / (1 - self.false_rate)
        return np.maximum(out, 0), total


def fit(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Filter:
    """The filter of all languages with a labelled text that is not held out."""
    rows = arrow_rows(documents).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    # per language, a hash border that leaves about sample_docs rows: no ranking of all rows
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return Filter([], [], "und")
    border = F.lit(False)
    for lang, n in counts.items():
        part = int(min(1.0, sample_docs / n) * ((1 << 32) - 1))
        border |= (F.col("lang") == lang) & (F.pmod(order, F.lit(1 << 32)) <= part)
    sample = rows.where(border).select("text", "lang")
    sizes = {r[0]: r[1] for r in sample.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    grams = sample.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("lang"))
    shares = grams.select("gram", "lang", share.alias("share"))
    table = shares.groupBy("gram").agg(F.sum("share").alias("total")).join(shares.where(F.col("share") >= MIN_SHARE), "gram")
    others = (F.col("total") - F.col("share")) / max(1, len(langs) - 1)
    # at most 1/MIN_SHARE times the n-grams of a text for each language: bounded
    kept = table.where(F.col("share") >= SPREAD * others).select("lang", "gram").toPandas()
    found = [np.array(kept["gram"][kept["lang"] == lang], np.int64).view(np.uint64) for lang in langs]
    return Filter(langs, found, max(langs, key=lambda x: (counts[x], x)))


def _predict(model: Filter, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    names, scores, shares = [], [], []
    for _, texts in _parts(column):
        gram, owner, has = _grams(texts)
        if not model.langs:
            names += ["und"] * len(texts)
            scores.append(np.zeros(len(texts)))
            shares.append(np.zeros(len(texts)))
            continue
        hits, total = model.hits(gram, owner, len(texts))
        best, sums = hits.argmax(1), hits.sum(1)
        top = hits[np.arange(len(texts)), best]
        names += [("und" if not h else model.langs[b] if t > 0 else model.default) for h, b, t in zip(has, best, top, strict=True)]
        scores.append(np.where(has & (sums > 0), top / np.maximum(sums, 1e-12), 0.0))
        shares.append(np.where(has, top / np.maximum(total, 1.0), 0.0))
    empty = np.zeros(0)
    return names, np.concatenate([empty, *scores]), np.concatenate([empty, *shares])


def predict(documents: DataFrame, model: Filter) -> DataFrame:
    """``doc_id, lang_pred, score, coverage`` per row: score is the winner's part of all corrected hits, coverage its part of all n-grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, shares = _predict(model, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())],
                names=["doc_id", "lang_pred", "score", "coverage"])

    return arrow_rows(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, coverage double")


def identify(documents: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, predict all."""
    out = predict(documents, fit(documents))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "coverage")


def keep_identified(documents: DataFrame) -> DataFrame:
    """The rows whose text has a language; null and letterless texts go.  All columns stay."""
    model = fit(documents)
    columns = documents.columns
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _, _ = _predict(model, batch.column(columns.index("text")))
            yield batch.filter(pa.array([n != "und" for n in names], pa.bool_()))

    return documents.mapInArrow(run, schema)
