import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriledger.llm import conversation_repair as C
from veriledger.llm import warc_archive as A
from veriledger.llm import whitening as W
from veriledger.llm.common import shared_dir

TURNS = "conv_id long, turn long, role string, text string"


# ---------------------------------------------------------------- conversation repair

class NoBound:
    def __init__(self, codes):
        pass

    def at(self, i, state):
        return 0


def every_edit(codes, inserts=3):
    """(cost, audit) by trying all edit lists with at most so many inserts."""
    found = []

    def go(i, state, cost, audit, left):
        if i == len(codes) and state in (0, 3):
            found.append((cost, audit))
        called = 3 if state == 2 else 2
        if left:
            go(i, called, cost + 5, audit + "I", left - 1)
        if i == len(codes):
            return
        initial, fault = codes[i] >> 2, codes[i] & 3
        go(i + 1, state, cost + 2, audit + "D", left)
        if fault in (1, 2):
            return
        extra = 5 if fault == 3 else 0
        go(i + 1, called, cost + 1 + extra, audit + "R", left)
        for at, after in ((0, 1),) if initial == 0 else ((0, 2), (1, 2), (3, 2)) if initial == 1 else ((2, 3),) if initial == 2 else ():
            if state == at:
                go(i + 1, after, cost + extra, audit + "K", left)

    go(0, 0, 0, "", inserts)
    return min(found)


def test_search_is_the_least_of_all_edits():
    r = random.Random(5)
    for _ in range(600):
        codes = bytes(r.randrange(16) for _ in range(r.randrange(6)))
        want = every_edit(codes)
        assert C.search(codes) == want
        assert C.search(codes, NoBound(codes)) == want  # the proof does not need tight bounds


def test_search_crosses_blocks(monkeypatch):
    r = random.Random(6)
    codes = [bytes(r.randrange(16) for _ in range(n)) for n in (1, 7, 8, 9, 40, 200)]
    want = [C.search(c) for c in codes]
    monkeypatch.setattr(C, "BLOCK", 8)
    assert [C.search(c) for c in codes] == want


def test_long_conversation_is_linear():
    r = random.Random(7)
    codes = bytes(r.choice((0, 4, 8, 7, 9, 10)) for _ in range(60_000))
    cost, audit = C.search(codes)
    assert sum(audit.count(x) for x in "KRD") == len(codes) and cost > 0


def plainly(rows):
    """All columns for one conversation's (turn, role, text), by hand."""
    damaged = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else "".join(c for c in text if c not in ".!?") if harm == 2 else text
        damaged += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    key = lambda r: hashlib.sha256(f"{'null ' if rows[0][0] is None else rows[0][0]}:{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, key(r)))
    faults, seen = [], set()
    for _, role, text in damaged:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    codes = bytes(4 * ("sua".index(role[0]) if role[:1] in ("s", "u", "a") else 3) + f for (_, role, _), f in zip(damaged, faults))
    cost, audit = every_edit(codes, 2)
    out, state, at = [], 0, 0
    for x in audit:
        if x == "D":
            at += 1
            continue
        called = "assistant" if state == 2 else "user"
        if x == "K":
            role, text = damaged[at][1:]
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
        else:
            role, text, state = called, damaged[at][2] if x == "R" else "", 3 if state == 2 else 2
        out.append(f"{role}:{text}")
        at += x != "I"
    turns = [t for t, _, _ in damaged if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(damaged, damaged[1:])]
    return (rows[0][0], max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in (1, 2, 3)),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_repair_against_hand_computation(spark):
    r = random.Random(8)
    texts = ["Hello there.", "Why?", "no end", " ", "", None, "é!", "Hello there."]
    rows = []
    for conv in [None, *range(60)]:
        rows += [(conv, r.choice([None, *range(6)]), r.choice(["user", "assistant", "system", "tool", "", None]), r.choice(texts)) for _ in range(r.randrange(1, 6))]
    got = C.repair(C.damage(spark.createDataFrame(rows, TURNS).withColumns({"key": F.lit("x"), "kind": F.lit(1), "copies": F.lit(9), "audit": F.lit("")})))
    want = {plainly([x for x in rows if x[0] == conv]) for conv in {x[0] for x in rows}}
    assert {tuple(x) for x in got.collect()} == want


def test_repair_edge_cases(spark):
    assert C.repair(C.damage(spark.createDataFrame([], TURNS))).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    [row] = C.repair(C.damage(spark.createDataFrame([(gone, 0, "user", "Hi.")], TURNS))).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    same = [(1, t, "user", "word " * 20_000 + ".") for t in range(300)]
    [row] = C.repair(spark.createDataFrame(same, TURNS)).collect()
    assert row["duplicate"] == 299 and row["illegal"] == 299 and row["audit"] == "D" * 300 and row["cost"] == 600


def test_repaired_turns_fit_the_pattern(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {c} {t}.") for c in range(20) for t in range(c % 5 + 2)]
    turns = C.repaired_turns(C.damage(spark.createDataFrame(rows, TURNS))).orderBy("conv_id", "turn").collect()
    for c in {t["conv_id"] for t in turns}:
        assert set("".join(t["role"][0] for t in turns if t["conv_id"] == c).split("ua")) == {""}


# ---------------------------------------------------------------- archives

PAGES = "page_id long, url string, html string"


def by_hand(pages):
    """Rows of the contract as a dictionary by (page, digest), for pages without repeated ids."""
    first, out = {}, []
    for page_id, _, html in sorted(pages, key=lambda p: p[0]):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        lead = first.setdefault(digest, page_id)
        again = len(data) >= A.SMALLEST and lead != page_id
        out.append((page_id, len(data), digest, "revisit" if again else "response", lead if again else None))
    return out


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(A, "VOLUME", 3000)  # many volumes and files
    odd = ["", None, "x" * 99, "y" * 100, "é" * 50, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 5, "\r\n\r\n" * 40, "filedesc://a 0 1 text/plain 5\n" * 9, "\x00 \n" * 60, "long " * 50_000]
    urls = ["http://a.example/x", None, "http://b.example/a b\nc", "http://é.example/", "no scheme"]
    pages = [(i, urls[i % 5], odd[i % len(odd)]) for i in range(60)]
    df = spark.createDataFrame(pages, PAGES).withColumns({"file": F.lit("f"), "offset": F.lit(1), "digest": F.lit("d"), "value": F.lit("v")})
    got = sorted((tuple(r) for r in A.round_trip(df.repartition(3)).collect()), key=lambda r: r[0])
    assert got == by_hand(pages)


def test_round_trip_ties_nulls_and_nothing(spark):
    assert A.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    same = "z" * 500
    got = A.round_trip(spark.createDataFrame([(7, "u", same), (7, "u", same), (None, "u", same), (3, None, "short"), (2, None, "short")], PAGES)).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in got) == [
        (0, "revisit", 7), (2, "response", 0), (3, "response", 0), (7, "response", 0), (7, "revisit", 7)]


def test_files_are_whole(spark):
    folder = f"{shared_dir(spark)}/archive-test-{random.randrange(1 << 60)}"
    pages = [(i, f"http://h.example/{i}", f"<p>page {i % 3}</p>" * 10) for i in range(9)]
    A.write_arc(spark.createDataFrame(pages, PAGES).coalesce(1), f"{folder}/arc")
    A.convert(spark, f"{folder}/arc", f"{folder}/warc")
    read = A.read_warc(spark, f"{folder}/warc", payloads=True).collect()
    assert {r["page_id"]: r["payload"].decode() for r in read if r["record_type"] == "response"} == {i: pages[i][2] for i in range(3)}
    assert {r["page_id"] for r in read if r["record_type"] == "revisit"} == set(range(3, 9)) and len({r["record_id"] for r in read}) == 9
    assert {r["date"] for r in read} == {"2024-01-01T00:00:00Z"}


def test_both_versions_and_broken_archives():
    def volume(version, docs):
        out = A._version_block(version, "v", "1999")
        for k, d in enumerate(docs):
            out += A._arc_record(version, "v", len(out), k, f"http://x/{k}", d, "199912312359")
        return out

    found = list(A.arc_records(gzip.compress(volume("1", [b"a\nb", b""])) ))
    assert [A.split_http(d)[2] for _, _, d in found] == [b"a\nb", b""] and set(found[0][1]) == set(A.ARC_FIELDS["1"])
    found = list(A.arc_records(gzip.compress(volume("1", [b"x"]) + volume("2", [b"y" * 200_000]))))
    assert [len(h) for _, h, _ in found] == [5, 10] and len(A.split_http(found[1][2])[2]) == 200_000
    assert [A.warc_date(d) for d in ("1999", "199912312359", "20000102030405")] == ["1999-01-01T00:00:00Z", "1999-12-31T23:59:00Z", "2000-01-02T03:04:05Z"]
    whole = volume("2", [b"z" * 50])
    with pytest.raises(ValueError, match="more than its file holds"):
        list(A.arc_records(gzip.compress(whole[:-20])))
    with pytest.raises(ValueError, match="version 7"):
        list(A.arc_records(gzip.compress(whole.replace(b"\n2 0 archive", b"\n7 0 archive"))))
    with pytest.raises(ValueError, match="digest"):
        A._checked(b"a", "sha256:" + hashlib.sha256(b"b").hexdigest(), "block")


# ---------------------------------------------------------------- whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def matrix(e, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(e), len(e))))
    a = (q * np.asarray(e, float)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("e", [np.linspace(1, 40, 40), [5.0] * 3 + [5 + 1e-9] * 2 + [1.0] * 12 + [0.0] * 4, [1e6, 1e6 + 1e-5, 1e6 + 2e-5, 3, 2, 1], [0.0] * 4, [2.0],
                               10.0 ** -np.arange(12)])
def test_refined_eigenvectors(e):
    a = matrix(e)
    values, x = W.eigen(a)
    size = max(np.abs(a).max(), 1e-300)
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-12
    assert np.abs((a.astype(np.longdouble) @ x - x * values)).max() / size < 1e-15
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() / size < 1e-14 and (np.diff(values) <= 0).all()


def test_float32_alone_is_not_enough():
    a = matrix(np.linspace(1, 40, 40))
    _, x = np.linalg.eigh(a.astype(np.float32))
    rough = np.abs(a @ x - x * np.diag(x.T @ a @ x)).max()
    values, x = W.eigen(a)
    assert np.abs(a @ x - x * values).max() < rough / 1e6


def test_whiten_against_numpy(spark):
    g = np.random.default_rng(3)
    c = (g.normal(size=(300, 12)) * np.linspace(0.05, 1, 12)).astype(np.float32)
    rows = [(i, [float(v) for v in c[i]], 0) for i in range(300)]
    bad = [(900, None, 0), (901, [None] + [0.0] * 11, 0), (902, [float("nan")] * 12, 0), (903, [float("inf")] + [0.0] * 11, 0), (904, [], 0), (905, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + bad, VECTORS).withColumns({"vector": F.lit(1), "at": F.lit(2), "n": F.lit(3)}).repartition(5)
    got = W.whiten(df).toPandas()
    assert sorted(got.vec_id.unique()) == list(range(300)) and len(got) == 2400 and set(got.n) == {300}
    x = np.floor(1024 * c.astype(float)).astype(int) + 100_000
    n, s = 300, x.sum(0)
    assert dict(zip(got.vec_id, got.deviation)) == dict(enumerate(((n * x - s) ** 2).sum(1)))
    v = np.cov(x.T, bias=True)
    e, q = np.linalg.eigh(v)
    for k in range(8):
        part = got[got.component == k + 1].sort_values("vec_id")
        want = (x - s / n) @ q[:, -1 - k] / np.sqrt(e[-1 - k])
        assert min(np.abs(part.whitened - want).max(), np.abs(part.whitened + want).max()) < 1e-8
        assert np.abs(part.explained - e[-1 - k] / e.sum()).max() < 1e-12
    assert set(got.identity_error) == {got.identity_error[0]} and got.identity_error[0] < 1e-9


def test_whiten_edge_cases(spark):
    assert W.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], VECTORS)).count() == 0
    one = W.whiten(spark.createDataFrame([(None, [1.0, 2.0], 0)] * 2, VECTORS)).collect()
    assert len(one) == 4 and {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(0, 0.0, 0.0, 0.0)}
    flat = W.whiten(spark.createDataFrame([(i, [float(i), 0.0], 0) for i in range(5)], VECTORS)).toPandas()  # one direction only
    assert np.allclose(flat[flat.component == 1].explained, 1) and (flat[flat.component == 2].whitened == 0).all() and flat.identity_error.max() < 1e-9
    huge = W.whiten(spark.createDataFrame([(1, [1e30, 0.0], 0), (2, [-1e30, 1.0], 0), (3, [0.0, 2.0], 0)], VECTORS)).collect()
    assert {r["vec_id"] for r in huge if r["deviation"] is None} == {1, 2}


def test_deviations_beyond_a_long_are_exact_or_null():
    x = np.array([[3_000_000_000], [0], [5]])
    sums = [int(x.sum())]
    want = [(3 * int(v) - sums[0]) ** 2 for v in x[:, 0]]
    assert list(W.deviations(x, 3, sums)) == [v if v < 1 << 63 else None for v in want]
