"""Content checks, facts, search screens, drift and mutation against small known cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veriledger.operators import content_checks as checks
from veriledger.operators import drift, facts, funnel, history, mutation, probes, reconcile
from veriledger.sources import documents


def one(df):
    return {r[0]: r.asDict() for r in df.collect()}


def test_grep_verdicts(spark):
    blobs = spark.createDataFrame([("h1", "Alpha BETA text"), ("h2", "gamma only")], "sha256 string, body string")
    cites = spark.createDataFrame([(1, "h1"), (1, "h2"), (2, "h1"), (2, "h2"), (3, "gone"), (4, "h1"), (5, "h1")], "cell int, sha256 string")
    rows = [(1, ["alpha", "beta"], 2), (2, ["alpha", "gamma"], 2), (3, ["alpha"], 1), (4, ["abc"], 1), (5, ["alpha"], 2)]
    got = one(checks.grep_all_in_one(spark.createDataFrame(rows, "cell int, literals array<string>, expect_artifacts int"), cites, blobs))
    assert got[1]["verdict"] is True
    assert (got[2]["verdict"], got[2]["reason"], got[2]["n_lost"]) == (False, "not in one document", 0)
    assert got[3]["reason"] == "not archived"
    assert got[4]["reason"] == "literal too short"
    assert got[5]["reason"] == "artifact count differs"


def test_count_is_null_when_nothing_is_archived(spark):
    blobs = spark.createDataFrame([("h", "aa AA b")], "sha256 string, body string")
    cites = spark.createDataFrame([(1, "h"), (2, "gone")], "cell int, sha256 string")
    rows = spark.createDataFrame([(1, ["aa", "b"], 2), (2, ["aa"], 0)], "cell int, literals array<string>, expect_count long")
    got = one(checks.count_in_retrieved(rows, cites, blobs))
    assert got[1]["verdict"] is True and got[2]["verdict"] is None


def test_token_width_must_do_work(spark):
    words = b"\x01\x00\x02\x00"  # [1, 2] as 16 bit, 131073 as 32 bit
    blobs = spark.createDataFrame([("h", bytearray(words))], "sha256 string, body binary")
    rows = [(1, "h", 2, 2, 50000, 2), (2, "h", 2, 2, 200000, 2), (3, "h", 2, 3, 50000, 2), (4, "h", 2, 2, 2, 2), (5, "x", 2, 2, 9, 2), (6, "h", 2, 2, 50000, 1)]
    schema = "cell int, sha256 string, width int, count long, vocab_bound long, max_id long"
    got = one(checks.token_range_check(spark.createDataFrame(rows, schema), blobs))
    assert [got[i]["reason"] for i in range(1, 7)] == [None, "width does no work", "word count differs", "not below bound", None, "maximum differs"]
    assert got[1]["verdict"] is True and got[5]["verdict"] is None


def test_pattern_probe(spark):
    claims = spark.createDataFrame([("c", 1)], "cell string, expect_matches int")
    files = spark.createDataFrame([("c", "a.sig", "file"), ("c", "b", "file")], "cell string, path string, type string")

    def run(patterns, exemplars):
        return checks.release_artifact_patterns(claims, files, patterns, exemplars).first()

    assert run([r"\.SIG$"], ["x.sig"]).verdict is True
    assert run([r"\.sig$", r"\.ots$"], ["x.sig"]).reason == "dead pattern"
    assert run([r"\.sig$"], ["x.sig", "x.asc"]).reason == "unmatched exemplar"
    assert run([r"\.sig$"], ["a.sig"]).reason == "exemplar is published"


def test_facts_refuse_rather_than_count(spark):
    df = spark.createDataFrame([("x 1\nx 2\ny", '[{"k": "1"}, {"k": 1}, 5]', '{"k": "1"}')], "t string, a string, o string")
    row = df.select(
        facts.count_lines_matching(F.col("t"), F.lit("x"), F.lit("x")).alias("ok"), facts.count_lines_matching(F.col("t"), F.lit("x"), F.lit("1")).alias("bad"),
        facts.count_json_entries(F.col("o"), F.lit("k"), F.lit("1")).alias("obj"),
    ).first()
    assert row.ok.value == 2 and row.bad.value is None and row.bad.error and row.obj.error == "not a JSON array"


def test_missing_name_is_refused(spark):
    corpus = spark.createDataFrame([(1, "t", "c")], "id int, text string, category string")
    with pytest.raises(ValueError):
        funnel.probe_matrix(corpus, {"s": ""}, ["x"])


def test_proximity_matches_brute_force(spark):
    rng = random.Random(2)
    names, terms, words = ["bert"], ["replicate", "from scratch"], ["bert", "replicate", "from scratch", "we", "a model", "xx"]
    rows = [(i, "s", " ".join(rng.choice(words) for _ in range(rng.randint(2, 9)))) for i in range(200)]

    def near(s):
        starts = [m.start() for n in names for m in re.finditer(re.escape(n), s)]
        return any(abs(m.start() - a) <= 25 for a in starts for t in terms for m in re.finditer(re.escape(t), s))

    df = spark.createDataFrame(rows, "id int, subject string, sentence string")
    got = {r.id for r in funnel.stage3_proximity(df, {"s": names}, terms).collect()}
    assert got == {i for i, _, s in rows if near(s)}


def test_unreadable_page_is_not_an_empty_set(spark):
    pages = [("s1", "a", ["1"]), ("s1", "b", ["1"]), ("s1", "c", None), ("s2", "a", []), ("s2", "b", []), ("s2", "c", ["9"])]
    pairs = reconcile.term_pairs(reconcile.term_sets(spark.createDataFrame(pages, "subject string, term string, ids array<string>")), ["a", "b", "c"])
    got = {(r.a, r.b): (r.compared, r.identical, r.both_non_empty, r.equivalent) for r in pairs.collect()}
    assert got == {("a", "b"): (2, 2, 1, True), ("a", "c"): (1, 0, 0, False), ("b", "c"): (1, 0, 0, False)}
    groups = {r.term: r.grp for r in reconcile.term_groups(pairs, ["a", "b", "c"]).collect()}
    assert groups == {"a": "a", "b": "a", "c": "c"}


def test_drift_kinds(spark):
    cases = [
        ('{"a": 1, "downloads": 1}', '{"downloads": 2, "a": 1}', "METADATA", "downloads"), ('{"a": 1}', '{ "a" : 1 }', "NONE", ""),
        ('{"a": 1}', '{"a": 2, "likes": 1}', "MATERIAL", "a,likes"), ("[1]", "[2]", "MATERIAL", "*"), ("[1, 2]", "[1,2]", "NONE", ""),
        ("x", '{"a": 1}', "MATERIAL", "*"), ('{"a": {"x": 1, "y": 2}}', '{"a": {"y": 2, "x": 1}}', "NONE", ""), ('{"a": null}', "{}", "NONE", ""),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(cases)], "i int, a string, b string")
    rows = df.orderBy("i").select(drift.drift_keys(F.col("a"), F.col("b")).alias("d")).collect()
    assert [(r.d.kind, ",".join(r.d["keys"])) for r in rows] == [(k, m) for _, _, k, m in cases]


def test_multiset_keeps_multiplicity(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert {(r.only_in, r.x, r.n) for r in history.multiset_diff(a, b).collect()} == {("stored", 1, 1), ("recomputed", 3, 1)}


def test_mutations_of_expectations(spark):
    blobs = spark.createDataFrame([("h1", "alpha beta"), ("h2", "gamma")], "sha256 string, body string")
    cites = spark.createDataFrame([(1, "h1"), (1, "h2"), (2, "h2")], "cell int, sha256 string")
    rows = spark.createDataFrame([(1, ["alpha"], 2), (2, ["absent"], 1)], "cell int, literals array<string>, expect_artifacts int")
    got = one(mutation.field_mutation_coverage(rows, cites, blobs, F.lit("h2")))
    assert len(got) == 7 and all(r["n"] == 1 for r in got.values())  # the failing baseline takes no part
    assert {m for m, r in got.items() if r["survived"]} == set()
    more = rows.union(spark.createDataFrame([(3, ["Gamma"], 1), (None, ["gamma"], 0)], rows.schema))
    got = one(mutation.field_mutation_coverage(more, cites.union(spark.createDataFrame([(3, "h2")], cites.schema)), blobs, F.lit("h2")))
    assert {m: (r["n"], r["survived"]) for m, r in got.items() if r["survived"]} == {"transplant evidence": (2, 1)}
    assert mutation.field_mutation_coverage(rows.where("false"), cites, blobs, F.lit("h2")).isEmpty()


def test_every_category_is_a_row(spark):
    rows = [("s1" if i % 3 else "s2", i, None if i == 50 else f"c{i % 20:02}") for i in range(60)] + [("s2", 1, "c01")]
    excluded = spark.createDataFrame(rows, "subject string, id int, category string")
    counts = {r.category: (r.n, r.adjacent) for r in reconcile.category_counts(excluded, ["c03"]).collect()}
    assert len(counts) == 21 and counts["c03"] == (3, True) and counts[None] == (1, False) and counts["c10"] == (2, False)
    assert reconcile.category_top(reconcile.category_counts(excluded, ["c03"]), 2).count() == 2
    per = reconcile.subject_categories(excluded, ["c03"])
    assert sum(r.n for r in per.collect()) == 60 and per.filter("subject = 's2'").count() == 20
    top = {r.subject: r for r in reconcile.category_profile(per, 2).collect()}
    assert top["s1"].excluded == 40 - sum(1 for s, i, c in rows if s == "s1" and c is None) and top["s2"].top.count(",") == 1
    assert reconcile.subject_categories(excluded.where("false")).isEmpty() and reconcile.category_counts(excluded.where("false")).isEmpty()


def test_a_digest_stored_often_is_read_once(spark):
    store = spark.createDataFrame([("a", b"12")] * 40 + [("b", b"345"), ("c", None), ("uncited", b"1")], "sha256 string, body binary")
    asked = spark.createDataFrame([(d, "contains", str(i)) for d in "abc" for i in range(30)], "sha256 string, kind string, arg string")
    assert sorted(r.sha256 for r in probes.bodies_of(asked.select("sha256").distinct(), store).collect()) == ["a", "b"]
    found = probes.measure(asked, store, ["contains"]).collect()
    assert len(found) == 60 and {(r.sha256, r.arg) for r in found if r.flag} == {("a", "1"), ("a", "2"), ("a", "12"), ("b", "3"), ("b", "4"), ("b", "5")}


def test_a_revision_response_is_parsed_once(spark):
    body = '{"sha": "r", "id": "o/m", "siblings": [{"rfilename": "b.bin"}, {"rfilename": "a.safetensors"}, {"rfilename": "sub/x.bin"}]}'
    rows = spark.createDataFrame([(1, body, "r"), (2, body, "q"), (3, "<html>", "r"), (4, None, "r"), (5, "{}", "r")], "id int, body string, revision string")
    df = rows.select("id", documents.enumerate_revision(F.col("body"), F.lit("o/m"), F.col("revision")).alias("r"))
    assert df._jdf.queryExecution().analyzed().toString().count("from_json") == 1
    assert {r.id: (r.r.shards, r.r.reason) for r in df.collect()} == {
        1: (["a.safetensors", "b.bin"], None), 2: (None, "other revision"), 3: (None, "not json"), 4: (None, "not json"), 5: (None, "not json")}
