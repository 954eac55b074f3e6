import random
import zlib

import numpy as np
import pytest

from veriledger.llm import language_id as L
from veriledger.llm import toxicity_neighbours as T

WORDS = {"aa": "the of and thing reading other", "bb": "der und nicht ein über straße", "cc": "el los ñandú que corazón para"}


def sample(n=240):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(3, 30))), lang, "s", 0))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")


def test_language_on_held_out_rows_and_odd_texts(spark):
    rows = sample() + [(1000, None, "aa", "s", 0), (1001, "", None, "s", 0), (1002, "123 .. !", "bb", "s", 0), (1003, "über " * 40000, None, "s", 0),
                       (1004, "語", "cc", "s", 0), (None, "the thing", "aa", None, None), (5, sample()[5][1], "cc", "s", 0)]
    got = L.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(240))
    assert sum(by[r[0]].lang_pred == r[2] for r in sample() if by[r[0]].held_out) >= 0.98 * sum(by[r[0]].held_out for r in sample())
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got) and by[1004].lang_pred in ("aa", "bb", "cc") and not by[None].held_out
    kept = L.keep_identified(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "score"] and kept.count() == len(rows) - 3


def test_language_without_labels_or_rows(spark):
    assert {r.lang_pred for r in L.identify(frame(spark, [(1, "the", None, "s", 0), (2, None, None, "s", 0)])).collect()} == {"und"}
    assert L.identify(frame(spark, sample(1)).where("false")).count() == 0


def test_false_positives_are_corrected():
    rng = np.random.default_rng(1)
    grams = [rng.integers(0, 1 << 63, 300_000, dtype=np.uint64) for _ in range(2)]
    made = L.Filter(["a", "b"], grams, "a", slots=1 << 20)
    sized = L.Filter(["a", "b"], grams, "a")
    assert sized.bits == 23 and sized.false_rate.max() < 0.014
    other = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)
    hits, total = made.hits(np.concatenate([grams[0][:1000], other]), np.repeat([0, 1], [1000, 50_000]), 2)
    assert made.false_rate[0] > 0.1 and hits[0, 0] == pytest.approx(1000, rel=1e-6)
    assert hits[1, 0] < 0.02 * total[1] and hits[0, 1] < 60


def plain_grams(text):
    """The n-grams of one text as strings, letter by letter."""
    low = text.lower()
    kept = [c if c.isalpha() else " " for i, c in enumerate(low)
            if c.isalpha() or (i > 0 and low[i - 1].isalpha()) or (i + 1 < len(low) and low[i + 1].isalpha())]
    out = []
    for n in L.SIZES:
        for i in range(len(kept) - n + 1):
            gram = "".join(kept[i:i + n])
            if gram.strip() and " " not in gram[1:-1] and (n > 1 or gram != " "):
                out.append(gram)
    return out


def test_language_counts_equal_exact_sets(spark):
    rows = [r for r in sample(300) if zlib.crc32(str(r[0]).encode()) % 4 != 2] + [(2000 + i, t, None, "s", 0) for i, t in enumerate(
        ["ΛΟΓΟΣ", "der  thing, los", "über straße 12 über", "a", "the\ncorazón -- de que"])]
    stands, texts = {}, {}
    for _, text, lang, _, _ in rows:
        if lang:
            texts[lang] = texts.get(lang, 0) + 1
            for gram in set(plain_grams(text)):
                stands[gram, lang] = stands.get((gram, lang), 0) + 1
    langs = sorted(texts)
    share = {k: n / texts[k[1]] for k, n in stands.items()}
    kept = {(g, x) for (g, x), s in share.items() if s >= L.MIN_SHARE
            and s >= L.SPREAD * sum(share.get((g, y), 0) for y in langs if y != x) / (len(langs) - 1)}
    model = L.fit(frame(spark, rows))
    assert model.langs == langs
    found = L.predict(frame(spark, rows), model).collect()
    for (i, text, *_), row in zip(sorted(rows), sorted(found)):
        grams = plain_grams(text)
        exact = [sum((g, x) in kept for g in grams) for x in langs]
        gram, owner, _ = L._grams([text])
        hits, total = model.hits(gram, owner, 1)
        assert total[0] == len(grams) and np.allclose(hits[0], exact, atol=1 + 0.03 * len(grams)), (text, hits, exact)
        if sorted(exact)[-1] > sorted(exact)[-2] + 2 + 0.06 * len(grams):
            assert row.doc_id == i and row.lang_pred == langs[exact.index(max(exact))]


def test_a_text_is_lowered_on_its_own():
    alone = L._grams(["ΛΟΓΟΣ"])[0]
    gram, owner, _ = L._grams(["ΛΟΓΟΣ", "abc"])
    assert sorted(alone) == sorted(gram[owner == 0])


def labelled(spark, n=600):
    rng = random.Random(4)
    plain, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)], ["grub", "zonk", "plop"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        toxic = i % 7 == 0
        if toxic:
            words += [rng.choice(bad) for _ in range(3)]
        rng.shuffle(words)
        docs.append((i, " ".join(words), "aa", "s", 0))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    docs += [(9000, None, None, None, None), (9001, "", "aa", "s", 1), (9002, "zonk " * 30000, "aa", "s", 1), docs[7]]
    labels += [(1, None, None), (50_000, 1, 1), labels[0], (None, 1, 1)]
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: int(i % 7 == 0) for i in range(n)}


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    got = T.assess(docs, labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == docs.count()
    held = [i for i in truth if by[i].held_out]
    assert sum(by[i].predicted == truth[i] for i in held) >= 0.98 * len(held)
    assert by[9002].predicted == 1 and by[9002].neighbours and by[9000].score == by[9001].score < 0.3
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_block_max_search_is_exact(spark):
    docs, labels, _ = labelled(spark)
    index = T.fit(docs, labels, examples=150)
    dense = np.zeros((len(index.ids), len(index.vocabulary)))
    for i, (terms, weights) in enumerate(index.vectors):
        dense[i, terms] = weights
    for i, (terms, weights) in enumerate(index.vectors):
        if len(terms):
            cosine = dense[:, terms] @ weights
            who, found = index.nearest(terms, weights, k=7, without=i)
            cosine[i] = 0
            order = np.lexsort((np.arange(len(cosine)), -np.round(cosine, 12)))[:7]
            assert who.tolist() == [int(k) for k in order if cosine[k] > 0]
            assert np.allclose(found, cosine[who])


def test_toxicity_without_one_class_or_rows(spark):
    docs, labels, _ = labelled(spark, 60)
    assert {r.predicted for r in T.assess(docs, labels.where("toxic = 0")).collect()} == {0}
    assert {r.score for r in T.assess(docs, labels.where("false")).collect()} == {0.0}
    assert T.assess(docs.where("false"), labels).count() == 0
