import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest

from veriledger.llm import line_dedup as D
from veriledger.llm import personal_data as P

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in found.split(".")),
            "card": 16 <= len(digits) <= 19 and P.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def test_plain_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    texts = ["".join(rng.choice("a1 .@+-()97é") for _ in range(rng.randrange(50))) for _ in range(4000)]
    texts += ["card 4111 1111 1111 1111, a.b@c.d@e.fg +1 (415) 555-2671 and 300.1.1.1 then 1.2.3.4.5.6.7.8"]
    for text in texts:
        want = {k: [m.span() for m in re.finditer(p, text) if valid(k, m[0])] for k, p in BASE.items()}
        base, every = P.find_in(text)
        assert base == want
        assert all(set(base[k]) <= set(every[k]) for k in base)


@pytest.mark.parametrize(("text", "kind", "part"), [
    ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("ask john dot doe at example dot com please", "email", "john dot doe at example dot com"),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ!", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("to jоhn@example.com", "email", "jоhn@example.com"),
    ("é call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
    ("ip one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one")])
def test_disguises_map_back_to_the_source(text, kind, part):
    _, every = P.find_in(text)
    assert part in [text[a:b] for a, b in every[kind]]


@pytest.mark.parametrize(("text", "kind", "part"), [
    ("write to john.doe at example.com", "email", "john.doe at example.com"),
    ("ip 10 point 0 point 0 point one", "ip", "10 point 0 point 0 point one"),
    ("one point two point three point four", "ip", "one point two point three point four"),
    ("a.b.c.d.e.f.g.h.i.j.k at x dot com", "email", "a.b.c.d.e.f.g.h.i.j.k at x dot com")])
def test_disguises_need_no_other_hint_in_the_text(text, kind, part):
    assert part in [text[a:b] for a, b in P.find_in(text)[1][kind]]


def test_unrelated_text_decides_nothing():
    rng = random.Random(4)
    parts = [" at ", " dot ", " point ", ".", "@", " ", "-", "one", "Two", "zero", "7", "joe", "x", "com", "+", "plus ", "(at)", "[.]", ","]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 24)))
        assert P.find_in(text)[1] == P.find_in(text + "\n\u2013 then \u2013")[1], text
    long = "a dot " * 40000 + "b.c" * 40000 + " at"
    assert P.find_in(long)[1]["email"] == []


def test_ordinary_text_has_no_disguise():
    for text in ("I have one two three four reasons to be at home", "we met at the bar dot dot dot", "(at) . the end", "", "naïve café"):
        assert P.find_in(text)[1] == {k: [] for k in P.KINDS}


def test_digest_of_odd_rows(spark, docs_of):
    long = "1." * 60000 + "a" * 60000 + "@" * 500 + "+1 " * 2000
    got = P.digest(docs_of([None, "", long, "x@y.zz", "x@y.zz", (None, "x@y.zz")], "spans n_email")).collect()
    assert len(got) == 6 and got[0].base_sha256 == hashlib.sha256(b"").hexdigest() and got[0].spans == ""
    assert [r.spans for r in got[3:]] == ["email:0:6"] * 3 and got[3].n_email == 1
    assert P.find(docs_of(["x@y.zz"])).first().spans[0].asDict() == {"kind": "email", "start": 0, "end": 6, "disguised": False}
    assert P.digest(docs_of([""]).where("false")).count() == 0


def brute_lines(pairs):
    key = lambda line: line.strip(D.SPACE).encode().lower()
    found = collections.defaultdict(set)
    for doc, text in pairs:
        for line in (text or "").split("\n"):
            if len(line.strip(D.SPACE)) >= 40:
                found[key(line)].add(doc)
    out = {}
    for doc, text in pairs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(found.get(key(x), ())) >= 5 and max(found[key(x)]) != doc)]
        out[doc] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def line_corpus():
    rng = random.Random(6)
    common = [f"Common line number {i} with É and enough letters to count" for i in range(6)]
    rows = []
    for i in range(40):
        lines = [rng.choice([rng.choice(common), "  " + rng.choice(common).upper().replace("É", "É") + "\t", f"own line {i} {rng.random()} of some length, to be sure", "short"])
                 for _ in range(rng.randrange(0, 9))]
        rows.append((i, "\n".join(lines)))
    return [*rows, (100, None), (101, ""), (102, "\n\n"), (103, "y" * 200_000), (104, "\n".join([common[0]] * 300))]


def cut(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()}


def test_lines_same_as_brute_force(spark, docs_of):
    pairs = line_corpus()
    assert cut(D.dedup(docs_of(pairs, "key drops kept"))) == brute_lines(pairs)
    assert D.dedup(docs_of(pairs).where("false")).count() == 0
    twice = docs_of([*pairs, pairs[3], (None, pairs[3][1])])
    got = D.dedup(twice).collect()
    assert len(got) == len(pairs) + 2 and [r.n_dropped for r in got if r.doc_id is None] == [0]
    out = D.drop_lines(docs_of(pairs))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() == len(pairs)
    assert out.where("n_chars != length(text)").count() == 0


def test_insert_and_delete_are_inverse(spark, docs_of):
    pairs = line_corpus()
    one, two = docs_of(pairs[:25]), docs_of(pairs[25:])
    first = D.insert(D.empty_index(spark), one, shards=4)
    both = D.insert(first, two, shards=4)
    assert cut(D.apply(both, docs_of(pairs))) == brute_lines(pairs)
    back = D.delete(both, two.select("doc_id"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(back.refs) == rows(first.refs) and rows(back.counts) == rows(first.counts)
    assert [tuple(r)[:2] for r in sorted(back.filters.collect())] == [tuple(r)[:2] for r in sorted(first.filters.collect())]
    assert cut(D.apply(back, one)) == brute_lines(pairs[:25])


def test_keys_that_collide_in_the_filter_stay_reversible(spark, docs_of, monkeypatch):
    monkeypatch.setattr(D, "PRINTS", 2)  # nearly every new key looks known
    monkeypatch.setattr(D, "SHARD_KEYS", 20)
    line = lambda k: f"line number {k} of the shared part, long enough to count"
    pairs = [(i, "\n".join(line(k) for k in range(i % 7, 60, 3))) for i in range(30)]
    parts = [docs_of(pairs[:10]), docs_of(pairs[10:20]), docs_of(pairs[20:])]
    index = D.insert(D.empty_index(spark), parts[0], shards=2)
    for part in parts[1:]:
        index = D.insert(index, part)
    assert index.shards > 2  # it has outgrown two shards
    for part in (parts[1], parts[0]):  # out and in again
        index = D.insert(D.delete(index, part.select("doc_id")), part)
    counts = index.counts.collect()
    assert len({bytes(r.key) for r in counts}) == len(counts) == 60
    assert sum(r.n for r in index.filters.collect()) == 60
    assert cut(D.apply(index, docs_of(pairs))) == brute_lines(pairs)
    left = D.delete(index, parts[2].select("doc_id"))
    assert cut(D.apply(left, docs_of(pairs[:20]))) == brute_lines(pairs[:20])


def test_disguised_among_many_plain_addresses_in_linear_time():
    text = " ".join(f"user{i}@example{i}.com or user{i} at other{i} dot com" for i in range(16_000))
    start = time.process_time()
    base, every = P.find_in(text)
    assert len(base["email"]) == 16_000 and len(every["email"]) == 32_000
    taken = time.process_time() - start
    start = time.process_time()
    P.find_in(text[: len(text) // 2])
    assert taken < 4 * (time.process_time() - start) + 0.5  # half the text takes about half the time


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, (5000, 2), dtype=np.uint64)
    made = D.CuckooFilter.for_size(4000)
    assert made.add(keys[:2000]) and made.add(keys[2000:4000]) and made.contains(keys[:4000]).all()
    assert made.contains(keys[4000:]).mean() < 0.01
    made.remove(keys[:1500])
    assert made.contains(keys[1500:4000]).all() and made.contains(keys[:1500]).mean() < 0.02
    assert (made.slots != 0).sum() == 2500
    assert not D.CuckooFilter(8).add(keys[:100])
