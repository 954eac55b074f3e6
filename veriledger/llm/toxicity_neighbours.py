"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting takes about ``EXAMPLES`` labelled documents of each class (those with the smallest hash of
their id, none held out) as examples, and the at most ``TERMS`` words whose presence depends on the
label (chi-square at least ``CHI_SQUARE``).  The inverse document frequencies of these words are counted over
all documents.  A document's vector is (1 + ln tf) idf over these words, of length 1.

The index keeps, for each word, its postings by blocks of ``BLOCK`` examples and the largest weight in
each block.  The sum of these bounds every cosine of a block, so blocks are worked off by falling bound and
the search for the ``K`` nearest ends when no bound exceeds the K-th cosine: exact, like a full scan.
Neighbours vote with weight 1 / (distance + 0.1), corrected for the classes' sampling rates.  A
logistic curve fitted on the examples' own leave-one-out votes turns the vote into a probability; since a
cosine does not see how much evidence there is, the curve also takes the number of words found and their share
of the text.

The index is bounded by the number of examples and words, so it travels with the tasks.

Edge cases: documents without any of the words, null and empty texts get the rate of such examples.  Ties of
cosine are broken by example order.  Without a labelled document of each class every score is the share of
label 1 (0 without labels).  A document labelled more than once is toxic if any label says so.  Rows that repeat
are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriledger.llm.common import arrow_rows
from veriledger.llm.language_id import held_out

EXAMPLES = 2000
TERMS = 2048
CHI_SQUARE = 24.0
BLOCK = 64
K = 25
THRESHOLD = 0.3

_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters, ASCII lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_LETTERS).split()


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.update((word, toxic) for word in set(words_of(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.binary()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "toxic", "n"])


def _frequency(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                counts.update(known & set(words_of(text)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([vocabulary[w] for w in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return run


class Index:
    """Labelled unit vectors with block maxima; ``examples`` are (id, label, {term: tf}, words)."""

    def __init__(self, vocabulary: dict[bytes, int], idf: np.ndarray, examples: list[tuple[int, int, dict[int, int], int]], rates: tuple[float, float]):
        self.vocabulary, self.idf = vocabulary, idf
        vectors = [self.vector(x[2]) for x in examples]
        # like examples share blocks: by their heaviest word, then the next
        order = sorted(range(len(examples)), key=lambda i: ([*vectors[i][0][np.argsort(-vectors[i][1], kind="stable")][:3]], examples[i][0]))
        self.ids = np.array([examples[i][0] for i in order], np.int64)
        self.label = np.array([examples[i][1] for i in order], np.int64)
        self.importance = np.array(rates)[self.label] if len(order) else np.zeros(0)
        self.vectors = [vectors[i] for i in order]
        amounts = [_amount(examples[i][2], examples[i][3]) for i in order]
        blocks = max(1, -(-len(order) // BLOCK))
        self.top = np.zeros((len(vocabulary), blocks))
        self.postings: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        lists: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for i, (terms, weights) in enumerate(self.vectors):
            for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                lists.setdefault((t, i // BLOCK), []).append((i % BLOCK, w))
        for (t, b), found in lists.items():
            self.postings[t, b] = np.array([x[0] for x in found]), np.array([x[1] for x in found])
            self.top[t, b] = max(x[1] for x in found)
        empty = np.array([len(v[0]) == 0 for v in self.vectors], bool)
        mass, hit = self.importance.sum(), (self.importance * self.label).sum()
        self.base = hit / mass if mass else 0.0
        self.empty_rate = ((self.importance * self.label)[empty].sum() + self.base) / (self.importance[empty].sum() + 1.0) if mass else 0.0
        self.curve = self._calibrated(amounts)

    def vector(self, tf: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(tf), np.int64)
        weights = np.array([1 + np.log(tf[t]) for t in terms.tolist()]) * self.idf[terms] if len(terms) else np.zeros(0)
        return terms, weights / np.sqrt((weights ** 2).sum()) if len(terms) else weights

    def counts(self, text: str | None) -> tuple[dict[int, int], int]:
        """({term: tf}, words of the text)."""
        known, words = self.vocabulary, words_of(text)
        return Counter(known[w] for w in words if w in known), len(words)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = K, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of the ``k`` nearest with a positive cosine, nearest first; ``without`` is left out."""
        bound = weights @ self.top[terms]
        best, who = np.zeros(0), np.zeros(0, np.int64)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(best) >= k and bound[b] < best[-1] - 1e-12):
                break
            score = np.zeros(BLOCK)
            for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                found = self.postings.get((t, b))
                if found is not None:
                    score[found[0]] += w * found[1]
            at = np.flatnonzero(score > 0)
            at, score = at + b * BLOCK, score[at]
            if without >= 0:
                at, score = at[at != without], score[at != without]
            best, who = np.concatenate([best, score]), np.concatenate([who, at])
            order = np.lexsort((who, -np.round(best, 12)))[:k]
            best, who = best[order], who[order]
        return who, best

    def vote(self, who: np.ndarray, cosine: np.ndarray) -> float:
        weight = self.importance[who] / (1.1 - np.minimum(cosine, 1.0))
        return float(((weight * self.label[who]).sum() + self.base) / (weight.sum() + 1.0))

    def _calibrated(self, amounts: list[tuple[float, float]]) -> np.ndarray:
        """Logistic coefficients of the log-odds of leave-one-out votes, of the two amounts, and of 1."""
        start = np.array([1.0, 0.0, 0.0, 0.0])
        rows = [i for i, v in enumerate(self.vectors) if len(v[0])]
        if not rows or not 0 < self.base < 1:
            return start
        x = np.array([(_log_odds(self.vote(*self.nearest(*self.vectors[i], without=i))), *amounts[i], 1.0) for i in rows])
        y, w = self.label[rows], self.importance[rows] / self.importance[rows].mean()
        beta = start
        for _ in range(100):  # Newton steps, drawn a little to the uncalibrated vote
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.eye(4), x.T @ (w * (y - p)) - (beta - start))
            beta = beta + np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-9:
                break
        return beta

    def score(self, text: str | None) -> tuple[float, np.ndarray, np.ndarray]:
        """(probability, nearest examples, their cosines)."""
        tf, n = self.counts(text)
        if not tf:
            return self.empty_rate, np.zeros(0, np.int64), np.zeros(0)
        who, cosine = self.nearest(*self.vector(tf))
        if not len(who):
            return self.empty_rate, who, cosine
        z = float(self.curve @ np.array([_log_odds(self.vote(who, cosine)), *_amount(tf, n), 1.0]))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), who, cosine


def _amount(tf: dict[int, int], words: int) -> tuple[float, float]:
    """Logarithms of the number of known words in a text and of their share."""
    n = sum(tf.values())
    return (float(np.log(n)), float(np.log(n / words))) if n else (0.0, 0.0)


def _log_odds(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def fit(documents: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS) -> Index:
    """The index of labelled rows that are not held out."""
    documents = arrow_rows(documents)
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}  # two rows
    order = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 32))
    border = F.lit(False)
    for label, n in total.items():
        border |= (F.col("toxic") == label) & (order <= int(min(1.0, examples / n) * ((1 << 32) - 1)))
    # about EXAMPLES ids of each class: bounded, so they go to the texts
    chosen = known.where(border)
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), "doc_id")
    presence = sample.mapInArrow(_presence, "word binary, toxic int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") != 1, F.col("n")).otherwise(0)).alias("b"))
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), float(n1 + n0)
    chi = F.when(a + b < n, n * F.pow(a * (n0 - b) - b * (n1 - a), 2) / ((a + b) * (n - a - b) * n1 * n0))
    words = [bytes(r[0]) for r in presence.where(chi >= CHI_SQUARE).orderBy(chi.desc(), "word").limit(terms).select("word").collect()] if n1 and n0 else []
    vocabulary = {w: i for i, w in enumerate(words)}
    seen = np.zeros(len(words))
    if words:
        found = documents.select("text").mapInArrow(_frequency(vocabulary), "term int, n long").groupBy("term").agg(F.sum("n")).collect()
        for t, m in found:  # one row per word of the vocabulary
            seen[t] = m
    idf = np.log((1 + documents.count()) / (1 + seen)) + 1
    rows: list[tuple[int, int, dict[int, int], int]] = []
    if words:
        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = [words_of(t) for t in batch.column(0).to_pylist()]
                tfs = [Counter(vocabulary[w] for w in ws if w in vocabulary) for ws in words]
                yield pa.RecordBatch.from_arrays([
                    batch.column(2), batch.column(1), pa.array([list(t) for t in tfs], pa.list_(pa.int32())),
                    pa.array([list(t.values()) for t in tfs], pa.list_(pa.int32())), pa.array([len(ws) for ws in words], pa.int32())],
                    names=["doc_id", "toxic", "term", "tf", "words"])

        rows = [(r[0], int(r[1] == 1), dict(zip(r[2], r[3], strict=True)), r[4])
                for r in sample.mapInArrow(vectors, "doc_id long, toxic int, term array<int>, tf array<int>, words int").collect()]
        rows.sort(key=lambda r: (r[0], sorted(r[2].items())))
    all1, all0 = total.get(1, 0), sum(v for k, v in total.items() if k != 1)
    index = Index(vocabulary, idf, rows, (all0 / n0 if n0 else 0.0, all1 / n1 if n1 else 0.0))
    if not rows and all1 + all0:
        index.base = index.empty_rate = all1 / (all1 + all0)
    return index


def score(documents: DataFrame, index: Index, evidence: int = 3) -> DataFrame:
    """``doc_id, score, predicted, neighbours`` per row; neighbours: the nearest examples with their cosines."""
    kind = pa.list_(pa.struct([("example", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, near = [], []
            for text in batch.column(1).to_pylist():
                p, who, cosine = index.score(text)
                scores.append(p)
                near.append([{"example": int(index.ids[i]), "toxic": int(index.label[i]), "cosine": float(c)}
                             for i, c in zip(who[:evidence], cosine[:evidence], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(near, kind)],
                names=["doc_id", "score", "predicted", "neighbours"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double, predicted int, neighbours array<struct<example:long,toxic:int,cosine:double>>")


def assess(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on rows that are not held out, score all."""
    out = score(documents, fit(documents, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "neighbours")
