import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from veriledger.llm import near_duplicates as N
from veriledger.llm.common import connected_components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(pairs):
    sets = {i: shingles(t) for i, t in pairs}
    ids, low = sorted(sets), {i: i for i in sets}
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return {i: (len(sets[i]), low[i], low[i] == i) for i in ids}


def corpus(seed=8, copies=12):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(rng.randrange(3, 250))] for _ in range(25)]
    rows = []
    for words in base:
        rows.append(" ".join(words))
        for _ in range(rng.randrange(copies)):
            near = list(words)
            for _ in range(rng.randrange(1 + len(words) // 40)):
                near[rng.randrange(len(near))] = "edit" + str(rng.randrange(99))
            rows.append(rng.choice([" ", "\n"]).join(near).replace("a", rng.choice("aA")))
    rng.shuffle(rows)
    return list(enumerate([*rows, None, "", " \t", "One two", "one TWO", "x " * 30000]))


def grouped(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.groups(df).collect()}


@pytest.mark.parametrize(("block", "neighbours"), [(N.BLOCK, N.NEIGHBOURS), (6, 4)])
def test_groups_same_as_brute_force(spark, docs_of, monkeypatch, block, neighbours):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "OVERLAP", block // 2)
    monkeypatch.setattr(N, "NEIGHBOURS", neighbours)
    pairs = corpus()
    assert grouped(docs_of(pairs, "digest node component").repartition(3)) == brute_groups(pairs)


def test_large_component_of_shared_boilerplate_is_exact(spark, docs_of, monkeypatch):
    """One rough component far above the block size, whose true pairs do not stand side by side in any order."""
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "OVERLAP", 1)
    monkeypatch.setattr(N, "ORDERS", 1)
    rng = random.Random(3)
    shared = [f"b{i}" for i in range(160)]
    rows = []
    for k in range(60):
        own = [f"o{k}x{i}" for i in range(rng.randrange(20, 45))]
        rows.append(" ".join(shared + own))
        rows += [" ".join(shared + own[:-rng.randrange(1, 4)] + [f"e{k}"] * rng.randrange(1, 3)) for _ in range(rng.randrange(2))]
        if k % 3 == 0:
            at = rng.randrange(20, 140)
            rows.append(" ".join(shared[:at] + [f"cut{k}"] + shared[at:] + own))
    rng.shuffle(rows)
    pairs = list(enumerate(rows))
    want = brute_groups(pairs)
    assert len({w[1] for w in want.values()}) > 20
    assert grouped(docs_of(pairs).repartition(3)) == want


def test_crowded_and_cut_regions_keep_all_their_nodes(spark):
    """Two like nodes 80 places apart among unlike ones, and regions that lie in several batches or partitions."""
    rng = np.random.default_rng(1)
    bits = rng.bytes(16 * 300)
    bits = [bits[16 * i:16 * i + 16] for i in range(300)]
    bits[90] = bits[10]
    sig = [b"\0" * 10 + i.to_bytes(10, "big") for i in range(300)]
    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.binary())
    part = lambda *ids: pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(([3] * len(ids), [sig[i] for i in ids], list(ids), [bits[i] for i in ids]), kinds)], names=["tree", "sig", "doc_id", "bits"])

    def joined(*parts):
        rows = [(r["a"], r["b"], r["border"]) for batches in parts for out in N._likely_links(iter(batches)) for r in out.to_pylist()]
        frame = spark.createDataFrame(rows, "a long, b long, border binary")
        return {frozenset(k) for k in _by_component(connected_components(N._rough_links(frame)).collect())}

    everything = {frozenset(range(100))}
    assert joined([part(*range(100))]) == everything
    assert joined([part(*range(0, 40)), part(*range(40, 66)), part(*range(66, 100))]) == everything
    assert joined([part(*range(0, 30))], [part(*range(30, 100))]) == everything
    assert joined([part(*range(0, 5))], [part(*range(5, 8))]) == {frozenset(range(8))}
    assert joined([part(*range(0, 60))]) == set()


def _by_component(rows):
    out = {}
    for r in rows:
        out.setdefault(r.component, set()).add(r.node)
    return out.values()


def test_repeated_rows_null_ids_and_empty(spark, docs_of):
    got = N.groups(docs_of([(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (9, "A B C D E F")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (4, 4, True), (4, 4, True), (9, 4, False)]
    assert N.groups(docs_of(["a"]).where("false")).count() == 0
    kept = N.keep_one(docs_of([(4, "a b c d e f"), (9, "A B C D E F"), (None, "z")]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in kept.collect()} == {4, None}


def test_links_of_a_group_are_exact():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        core = rng.integers(0, 1 << 40, 80, dtype=np.uint64)
        sets += [np.unique(np.concatenate([core[rng.random(80) > rng.choice([0.02, 0.1])], rng.integers(0, 1 << 40, 4, dtype=np.uint64)])) for _ in range(4)]
    ids = list(range(len(sets)))
    low = dict(enumerate(ids))
    for _ in range(6):
        for a in ids:
            for b in ids[:a]:
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    low[a] = low[b] = min(low[a], low[b])
    assert dict(N.true_links(ids, sets)) == {a: b for a, b in low.items() if a != b}


def test_components_of_chains_hubs_and_nothing(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(7, i) for i in range(200, 400)]
    frame = spark.createDataFrame([*chain, *hub, (5, 5), (None, 3), (8, None), (7, 201)], "a long, b long")
    got = {r.node: r.component for r in connected_components(frame).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(200, 400)}, 7: 7}
    assert connected_components(frame.where("false")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8)))
    own = {i: " ".join(word() for _ in range(60)) for i in range(30)}
    item = " ".join(word() for _ in range(14))
    line = "this line is found in many documents and goes away, " + word()
    rows = [(i, t + ("\n" + line if i < 8 else ""), "en", "s", 0) for i, t in own.items()]
    rows += [(50, own[3] + " end", "en", "s", 0), (51, own[4] + "\n" + item, "en", "s", 0), (52, None, "en", "s", 0), (53, "12 34", "en", "s", 0), (54, own[9], None, None, None)]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == [c.split()[0] for c in columns.split(", ")]
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        left.append({r.doc_id for r in docs.collect()})
    everything = {r[0] for r in rows}
    assert left[0] == everything - {52, 53} == left[1]
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/1").where(f"text like '%{line}%'").collect()} == {7}
    assert left[2] == left[1] - {50, 54} and left[3] == left[2] - {51} == left[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left[4]
