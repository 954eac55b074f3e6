import hashlib
import random

import numpy as np
import pytest

from veriledger.llm import suffix_dedup as S


def brute(pairs, length=50):
    first, out = {}, {}
    for doc, text in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0)):
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            w = data[i:i + length]
            first[w] = min(first.get(w, doc), doc)
    for doc, text in pairs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i:i + length]] < doc:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest())
    return out


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    parts = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(12)]
    texts = [" ".join(rng.choice([word(), word(), rng.choice(parts)]) for _ in range(rng.randrange(0, 25))) for _ in range(n)]
    return [*texts, None, "", "x" * 49, "x" * 50, "x" * 500, texts[3], texts[3], "ab" * 4000, "z" + "ab" * 3000, parts[0], parts[0][:50]]


def digests(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digest(df).collect()}


@pytest.mark.parametrize("hot", [S.HOT, 3])
def test_same_as_brute_force(spark, docs_of, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "SHARD_BYTES", 2000)
    pairs = list(enumerate(corpus()))
    assert digests(docs_of(pairs, "shard th n data").repartition(5)) == brute(pairs)


def test_a_value_is_hot_for_all_batches_or_none(spark, docs_of, monkeypatch):
    """One batch holds more entries of the values than ``HOT``, another one fewer, and there are many cells."""
    monkeypatch.setattr(S, "HOT", 6)
    monkeypatch.setattr(S, "PIECE_BYTES", 100)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefghij") for _ in range(60))
    around = lambda: "".join(rng.choice("klmnopqrst") for _ in range(70))
    large = [(10 + i, "".join(around() + passage for _ in range(4)) + around()) for i in range(3)]
    small = [(i, around() + passage + around()) for i in range(2)]
    single = [(5, around() + passage + around())]
    # partitions that differ in number are not zipped by the union: every one is a batch of its own
    df = docs_of(large).coalesce(1).union(docs_of(small + single).coalesce(2))
    assert digests(df) == brute([*large, *small, *single])


def test_repeated_rows_null_id_and_empty_table(spark, docs_of):
    text = "the quick brown fox jumps over the lazy dog " * 3
    got = S.digest(docs_of([(7, text), (7, text), (None, text), (9, text + "~tail of nine")])).collect()
    removed = sorted((r.doc_id or -1, r.n_removed) for r in got)
    assert removed == [(-1, 0), (7, len(text)), (7, len(text)), (9, len(text))]
    assert S.digest(docs_of([(7, text)]).where("false")).count() == 0


def test_intervals_give_all_short_prefixes():
    rng = np.random.default_rng(3)
    data = np.append(rng.integers(97, 100, 3000).astype(np.uint8), 0).astype(np.uint8)
    data[1000:1200] = data[100:300]
    order = S.sorted_suffixes(data, 50)
    got = S.short_prefixes(data, order, 50)
    raw = data.tobytes()
    want = [True] + [raw[a:a + 50] != raw[b:b + 50] for a, b in zip(order[:-1], order[1:])]
    assert got.tolist() == want


def test_runs_alone_with_their_value_meet_no_sort(spark, docs_of, monkeypatch):
    """Copies are settled where equal runs meet: the transform gets only values with several distinct runs."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    copies = [(i, t) for i, t in enumerate([text(400) for _ in range(6)] * 2)]
    passage = text(45)  # shared seeds, but no equal windows
    near = [(20 + i, text(60) + passage + text(60)) for i in range(3)]
    docs = docs_of([*copies, *near])
    packed = "shard int, kind int, n int, data binary"
    flat = docs.select("doc_id", "text")
    marks = flat.coalesce(1).mapInArrow(S._runs_of_batch(1, 50), packed).groupBy("shard").applyInArrow(S._repeated(1), packed)
    homes = docs.selectExpr("0 shard", "cast(doc_id as long) doc_id", "text", "xxhash64(text) th")
    pieces = homes.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(S._texts_of_runs(1, 1, 50), packed).toArrow()
    met = []
    real = S.sorted_suffixes
    monkeypatch.setattr(S, "sorted_suffixes", lambda data, depth: met.append(data.tobytes()) or real(data, depth))
    S._removed(1, 50)(pieces.combine_chunks())
    assert len(met) == 1
    assert not any(t[i:i + 50].encode() in met[0] for _, t in copies for i in range(351))
    assert max(met[0].count(passage[j:j + S.SEED].encode()) for j in range(26)) > 1
    assert digests(docs) == brute([*copies, *near])


@pytest.mark.parametrize("dense", [0, S.DENSE, 10 ** 9])
@pytest.mark.parametrize("alphabet", [b"\0a", b"ab", b"\0abc", b"a"])
def test_repeats_hold_for_any_bytes(monkeypatch, dense, alphabet):
    """NUL bytes of the texts are no ends of texts, whichever way the intervals are extended."""
    monkeypatch.setattr(S, "DENSE", dense)
    for seed in range(40):
        rng = random.Random(seed)
        base = bytes(rng.choice(alphabet) for _ in range(300))
        texts = []
        for _ in range(rng.randrange(1, 10)):
            a = rng.randrange(200)
            texts.append(base[a:a + rng.randrange(12, 70)] if rng.random() < 0.6 else bytes(rng.choice(alphabet) for _ in range(rng.randrange(12, 70))))
        texts = list(dict.fromkeys(texts))
        docs = [rng.randrange(5) for _ in texts]
        first = {}
        windows = [(k, i, t[i:i + 12]) for k, t in enumerate(texts) for i in range(len(t) - 11)]
        for k, _, w in windows:
            first[w] = min(first.get(w, 5), docs[k])
        want = {(k, i + j) for k, i, w in windows if first[w] < docs[k] for j in range(12)}
        assert {(k, p) for k, a, b in S.repeats(texts, np.array(docs), 12) for p in range(a, b)} == want
