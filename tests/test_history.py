import random

from pyspark.sql import functions as F

from veriledger.functions.digests import prefix_digest, segment_hashes
from veriledger.functions.ranking import carried, global_rank, ordinals
from veriledger.operators import drift, history

RUNS = "run long, round int, controls_total long, watched long, never_executes int, source_fingerprint string, inputs_fingerprint string"


def runs(spark, n, change=None):
    rows = [[i, i // 7, 100 + i, i, 0, f"s{i // 6}", "i"] for i in range(1, n + 1)]
    for run, column, value in change or []:
        rows[run - 1][column] = value
    return spark.createDataFrame([tuple(r) for r in rows], RUNS)


def test_ordinals_where_a_third_of_all_rows_are_alike(spark):
    rows = [(None if i % 3 == 0 else i % 2, None if i % 3 == 0 else i) for i in range(3000)]
    df = spark.createDataFrame(rows, "v long, id long").repartition(7)
    got = global_rank(df, "v", "id").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 3001))
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or 0))
    assert [(r.v, r.id) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert "Exchange SinglePartition" not in df._jdf.queryExecution().toString()
    assert ordinals(df.where("false"), F.asc("v")).count() == 0


def test_carried_over_partitions(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None] * 9 + [i])) for i in range(2000)]
    rows[:300] = [(i, None) for i in range(300)]
    got = {r.at: r.known for r in carried(spark.createDataFrame(rows, "at long, v long").repartition(5), F.asc("at"), value="v", out="known").collect()}
    last, want = None, {}
    for at, v in rows:
        want[at] = last
        last = v if v is not None else last
    assert got == want


def test_segment_hashes_see_order_and_combine(spark):
    rows = [(i, f"x{i % 5}") for i in range(1, 200)]
    df = spark.createDataFrame(rows, "run long, v string")
    base = segment_hashes(df, "run", ["v"], span=16)
    again = segment_hashes(df.orderBy(F.rand(1)).repartition(6), "run", ["v"], span=16)
    assert sorted(map(tuple, base.collect())) == sorted(map(tuple, again.collect()))
    swapped = spark.createDataFrame([(i, {20: "x1", 21: "x0"}.get(i, v)) for i, v in rows], "run long, v string")
    differing = {r.segment for r in base.exceptAll(segment_hashes(swapped, "run", ["v"], span=16)).collect()}
    assert differing == {1}
    # a prefix has one digest, whatever the ranges it is put together from
    whole = {prefix_digest(segment_hashes(df.where(f"run <= {k}"), "run", ["v"], span=s), s).first().digest for s in (4, 16, 1000) for k in (150,)}
    assert len(whole) == 1
    assert prefix_digest(base, 16).first().digest not in whole
    assert prefix_digest(segment_hashes(df.where("false"), "run", ["v"])).first().n == 0


def test_an_altered_middle_row_is_found_by_its_range(spark):
    new, nobody = runs(spark, 500), spark.createDataFrame([], RUNS)
    stored = runs(spark, 400, [(203, 2, 7)])
    segments = history.segment_agreement(stored, new, span=32).collect()
    assert {r.segment for r in segments if not r.agrees} == {203 // 32}
    assert all(r.prefix_agrees == (r.segment < 203 // 32) for r in segments)
    assert sorted(map(tuple, history.append_only_check(stored, new, nobody, span=32).collect())) == [("row changed", 203)]
    assert history.append_only_check(runs(spark, 400), new, nobody, span=32).count() == 0
    cut = history.append_only_check(runs(spark, 400).where("run != 100"), new, nobody, span=32)
    assert cut.count() == 0  # a missing stored row is no changed row, but its range does not agree
    assert [r.segment for r in history.segment_agreement(runs(spark, 400).where("run != 100"), new, span=32).where("not agrees").collect()] == [3]
    assert sorted(map(tuple, history.append_only_check(runs(spark, 402), runs(spark, 400), nobody, span=32).collect())) == [("row lost", 401), ("row lost", 402)]


def test_nulls_move_segment_hashes(spark):
    a = spark.createDataFrame([(1, None, "x")], "run long, p string, q string")
    b = spark.createDataFrame([(1, "x", None)], "run long, p string, q string")
    assert segment_hashes(a, "run", ["p", "q"]).first().h0 != segment_hashes(b, "run", ["p", "q"]).first().h0


def test_equal_numbers_are_no_drift(spark):
    pairs = [('{"a": 100}', '{"a": 1e2}', "NONE"), ('{"a": {"b": [1.50, 2]}}', '{"a": {"b": [1.5, 2.0]}}', "NONE"), ('{"a": 1}', '{"a": 1.5}', "MATERIAL"),
             ('{"a": "1e2"}', '{"a": "100"}', "MATERIAL"), ('{"a": "x: 1.0, y"}', '{"a": "x: 1, y"}', "MATERIAL"), ('{"a": -0}', '{"a": 0.0}', "NONE"),
             ('{"a": 9007199254740993}', '{"a": 9007199254740992}', "MATERIAL"), ('{"q": "\\\\", "b": 1.0}', '{"q": "\\\\", "b": 1}', "NONE"),
             ('{"downloads": 10, "a": 3}', '{"downloads": 11, "a": 3.0}', "METADATA")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.kind for r in df.select("i", drift.drift_keys(F.col("a"), F.col("b"))["kind"].alias("kind")).collect()}
    assert got == {i: k for i, (_, _, k) in enumerate(pairs)}
