import collections
import hashlib
import itertools
import random
import re

import sentencepiece

from veriledger.llm import decontaminate as C
from veriledger.llm import sentencepiece_codec as S
from veriledger.llm import weighted_fingerprints as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute_hits(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    named |= windows[tuple(w[i:i + n])]
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_hits_same_as_brute_force_in_both_ways(spark, docs_of):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("a b é c-d E.f 7 日本".split()) for _ in range(n))
    items = [(i, text(rng.randrange(8, 40))) for i in range(30)] + [(77, None), (78, "--"), (79, "Only three words"), (3, text(12))]
    docs = [(i, text(rng.randrange(0, 60)) + rng.choice(["", " " + (rng.choice(items)[1] or "")])) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "only THREE, words!"), (103, text(30000)), (104, items[0][1]), (104, items[0][1])]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, hits string")
    for limits in ((C.MAX_SET, C.MAX_BYTES), (5, C.MAX_BYTES), (C.MAX_SET, 100)):
        hits = C.hits(docs_of(docs, "hits words item_id"), table, C.N, *limits)
        assert hits.count() == len(docs)
        out = C.report(docs_of(docs, "hits words item_id"), table, C.N, *limits)
        got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in out.collect()]
        assert sorted(got, key=repr) == brute_hits(docs, items)
    kept = C.drop_contaminated(docs_of(docs), table)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d[0] for d in brute_hits(docs, items) if not d[5])


def test_sifting_keeps_every_window_and_little_else(spark):
    windows = spark.range(20000).selectExpr("xxhash64(id) hash")
    rows = spark.range(60000).selectExpr("id", "xxhash64(id) hash", "10 length").unionByName(
        spark.createDataFrame([(-1, 0, -5)], "id long, hash long, length int"))
    kept = {r.id for r in C._sifted(rows, windows, 20000).collect()}
    assert kept >= {-1, *range(20000)} and len(kept) < 20001 + 0.03 * 40000


def test_empty_tables(spark, docs_of):
    table = spark.createDataFrame([], "item_id long, text string")
    assert C.digest(docs_of(["a b"]), table).first().contaminated is False
    assert C.digest(docs_of(["a b"]).where("false"), table).count() == 0


def jaccard(a, b):
    a, b = collections.Counter(a.split()), collections.Counter(b.split())
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_fingerprints_follow_generalised_jaccard(spark, docs_of, monkeypatch):
    monkeypatch.setattr(W, "PLACE_ROWS", 16)
    monkeypatch.setattr(W, "FAN", 4)
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(rng.randrange(1, 150))) for _ in range(150)]
    ids = sorted(rng.sample(range(5000), 140)) + list(range(10**6, 10**6 + 10))
    pairs = list(zip(ids, texts))
    pairs[20], pairs[21], pairs[22], pairs[23] = (ids[20], None), (ids[21], ""), (ids[22], texts[5]), (ids[23], texts[5])
    docs, ring = W.placed(docs_of(pairs), rows=16)
    assert docs.select("place").distinct().count() == ring.count() > 3
    got = {r.doc_id: r for r in W.fingerprints(docs_of(pairs, "pos place next")).collect()}
    errors = []
    for k, (doc, text) in enumerate(pairs):
        text, following = text or "", pairs[(k + 1) % len(pairs)][1] or ""
        q = len(text) // 4
        edited = text[:len(text) - q] + following[:q]
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if text.split() and following.split():
            errors += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, following)]
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.45
    assert got[ids[22]].fingerprint == got[ids[23]].fingerprint == got[ids[5]].fingerprint and got[ids[22]].near_next == 1.0
    assert got[ids[20]].near_next == 1.0 and got[ids[21]].near_next == 0.0


def test_fingerprints_of_few_rows(spark, docs_of):
    assert W.fingerprints(docs_of(["a"]).where("false")).count() == 0
    one = W.fingerprints(docs_of(["a b c d"])).first()
    assert one.near_next == 1.0
    rows = W.fingerprints(docs_of([(1, "a b"), (1, "a b"), (None, "c " * 30000)])).collect()
    assert len(rows) == 3 and len({r.fingerprint for r in rows}) == 2


def test_codec_is_sentencepiece(spark, docs_of):
    odd = ["Hello  world", " a", "a\nb\t c ", "x 😀 ﬁ é ①", " ", "", "▁a", "\x00x", "a" * 50000, "日本語", "\r\n\r\n", *[" " * k + "x" + " " * k for k in range(1, 40)]]
    data = S.read_bytes(S.MODEL_PATH)
    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = S.Codec(data)
    ids = codec.encode(odd)
    assert ids == reference.encode(odd) and codec.decode(ids) == reference.decode(ids)
    got = S.encode(docs_of([*odd, None, "Hello"], "ids decoded")).collect()
    assert len(got) == len(odd) + 2 and all(r.parity for r in got) and got[len(odd)].decoded == ""
    assert all(r.round_trip == (o.find("▁") < 0) for r, o in zip(S.digest(docs_of(odd)).orderBy("doc_id").collect(), odd))
    assert S.digest(docs_of(odd).where("false")).count() == 0


def test_codec_over_all_places_of_spaces_and_markers():
    data = S.read_bytes(S.MODEL_PATH)
    reference, codec = sentencepiece.SentencePieceProcessor(model_proto=data), S.Codec(data)
    parts = ["a", " ", "▁", "\n", "é", "日", " the"]
    texts = ["".join(x) for n in range(5) for x in itertools.product(parts, repeat=n)]
    ids = codec.encode(texts)
    assert ids == reference.encode(texts)
    assert codec.decode(ids) == reference.decode(ids)
    assert codec.decode([[22557, 28705], [3 + 0xC3], [3 + 0xC3, 3 + 0xA9]]) == ["Hello ", "\ufffd", "é"]


def test_words_are_learned_in_blocks(monkeypatch):
    monkeypatch.setattr(S, "WORDS_AT_ONCE", 3)
    monkeypatch.setattr(S, "KNOWN_WORDS", 10)
    data = S.read_bytes(S.MODEL_PATH)
    reference, codec = sentencepiece.SentencePieceProcessor(model_proto=data), S.Codec(data)
    texts = [" ".join(f"w{i % 7}é{i}" for i in range(k)) for k in range(300)]
    for at in range(0, 300, 50):
        assert codec.encode(texts[at:at + 50]) == reference.encode(texts[at:at + 50])
