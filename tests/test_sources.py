"""Reading, storing and verifying."""

import gzip
import hashlib
import json
import os

import pytest

from veriledger.plans import fixtures, q_sources
from veriledger.sources import blobs, documents, ledger, sinks

LEDGER = {
    "as_of": "2026-01-01", "zero_bounds_floor": {"bounded_zeros": 1},
    "subjects": [{"id": "s", "repo": "o/r", "kind": "api-only", "sources": ["hf:o/r"], "axis_sources": {"1": ["hf:o/r"]},
                  "axis_literals": {"1": []}, "axis_method": {"1": None}}],
    "cells": [{"subject": "s", "axis": 1, "score": 0, "bound": {"method": "grep_retrieved"},
               "evidence": [{"url": "https://huggingface.co/o/r", "sha256": "a" * 64}]},
              {"subject": "s", "axis": 2, "score": None, "na_reason": "x"}],
}


def test_read_ledger(spark, tmp_path):
    path = tmp_path / "ledger.json"
    path.write_text(json.dumps(LEDGER, indent=1))
    docs = ledger.read_ledger(spark, str(path), lines=False)
    cells = {r.axis: r for r in ledger.cells_of(docs).collect()}
    assert cells[1].score == 0 and cells[1].has_bound and not cells[1].has_check
    assert cells[2].score is None  # N/A is not zero
    policy = {(r.key, r.axis, r.value) for r in ledger.policy_of(docs).collect()}
    assert ("axis_sources", 1, "hf:o/r") in policy
    assert ("axis_literals", 1, None) in policy and ("axis_method", 1, None) in policy  # declared, empty
    assert ledger.evidence_of(docs).count() == 1


def test_ledger_without_floor_is_refused(spark, tmp_path):
    path = tmp_path / "ledger.json"
    path.write_text(json.dumps({**LEDGER, "zero_bounds_floor": None}))
    with pytest.raises(Exception, match="no zero_bounds_floor"):
        ledger.cells_of(ledger.read_ledger(spark, str(path))).collect()
    assert ledger.read_ledger(spark, str(tmp_path / "missing.json")).isEmpty()


def test_gzip_store(spark, tmp_path):
    body = b"hello bytes"
    digest = hashlib.sha256(body).hexdigest()
    (tmp_path / f"{digest}.gz").write_bytes(gzip.compress(body))
    (tmp_path / f"{'b' * 64}.gz").write_bytes(b"not gzip")
    large = os.urandom(9 << 20)
    (tmp_path / f"{'c' * 64}.gz").write_bytes(gzip.compress(large))
    got = {r.sha256: (r.body, r.status) for r in blobs.read_gzip_store(spark, str(tmp_path)).collect()}
    assert bytes(got[digest][0]) == body and got["b" * 64] == (None, "corrupt")
    assert bytes(got["c" * 64][0]) == large and got["c" * 64][1] == "mismatch" and got[digest][1] == "ok"  # named by other bytes


def test_store_is_idempotent(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([(b"a",), (b"b",), (b"a",)], "body binary")
    for _ in range(2):
        blobs.store_blobs(rows, store)
    got = blobs.read_store(spark, store).collect()
    assert sorted(bytes(r.body) for r in got) == [b"a", b"b"]
    assert all(hashlib.sha256(bytes(r.body)).hexdigest() == r.sha256 for r in got)


def test_feed_without_id(spark):
    page = "<feed>opensearch:totalResults>7<<entry><title> A\n b</title></entry><entry><id> i </id><summary>x</summary></entry></feed>"
    df = spark.createDataFrame([(page,)], "body string")
    rows = documents.parse_feed(df, "body").orderBy("pos").collect()
    assert [(r.total, r.id, r.title, r.abstract) for r in rows] == [(7, "", "A b", ""), (7, "i", "", "x")]
    assert documents.parse_feed(df, "body", require_id=True).count() == 1


def test_verify_record_compares_both_sides(spark):
    schema = "k int, field string, value string"
    stored = spark.createDataFrame([(1, "a", "1"), (1, "gone", "x"), (1, "as_of", "old")], schema)
    fresh = spark.createDataFrame([(1, "a", "2"), (1, "new", None), (1, "as_of", "now")], schema)
    got = {r.field for r in sinks.verify_record(stored, fresh, ["k"], ["as_of"]).collect()}
    assert got == {"a", "gone"}


def test_gzip_store_written_and_read_back(spark, tmp_path):
    path = str(tmp_path / "store")
    assert blobs.read_gzip_store(spark, path).isEmpty()
    bodies = spark.createDataFrame([(b"a",), (b"a",), (b"",), (None,), (os.urandom(1 << 20),)], "body binary")
    for _ in range(2):
        blobs.write_gzip_store(bodies, path)
    got = blobs.read_gzip_store(spark, path).collect()
    assert len(got) == 3 and {r.status for r in got} == {"ok"}
    assert all(hashlib.sha256(bytes(r.body)).hexdigest() == r.sha256 for r in got)
    member = next((tmp_path / "store").glob(f"*/{hashlib.sha256(b'a').hexdigest()}.gz"))
    member.write_bytes(gzip.compress(b"b"))
    assert {r.status for r in blobs.read_gzip_store(spark, path).collect() if bytes(r.body) == b"b"} == {"mismatch"}
    with pytest.raises(Exception, match="appended to"):
        bodies.write.format("gzip_store").mode("overwrite").save(path)


LINES = "sort_key double, subject string, line string"


def test_emit_table_is_sorted_and_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(-i / 50, f"s{i}", f"line é {i}") for i in range(50)]
    sinks.emit_table(spark.createDataFrame([(0.0, "z", "before")], LINES), "2025-01-01", "g", path)
    sinks.emit_table(spark.createDataFrame(rows, LINES).repartition(5), "2026-01-01", "f", path)
    got = [r.line for r in sinks.read_table(spark, path).orderBy("rank").collect()]
    assert got == [f"line é {i}" for i in reversed(range(50))]
    parts = sinks.table_parts(spark, path).collect()
    assert {(p.stamp, p.fingerprint, p.status) for p in parts} == {("2026-01-01", "f", "ok")} and sum(p.n for p in parts) == 50
    assert len(list((tmp_path / "t" / "data").iterdir())) == len(parts)  # the parts of the first table are gone


def test_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.emit_table(spark.createDataFrame([(0.0, "a", "kept"), (1.0, "b", None)], LINES), "d", "f", path)
    with pytest.raises(Exception, match="line feed"):
        sinks.emit_table(spark.createDataFrame([(0.0, "a", "new"), (1.0, "b", "two\nlines")], LINES), "d", "f", path)
    assert [r.line for r in sinks.read_table(spark, path).orderBy("rank").collect()] == ["kept", ""]


def test_altered_and_missing_parts_are_named(spark, tmp_path):
    path = str(tmp_path / "t")
    lines = spark.range(30).selectExpr("cast(id as double) sort_key", "cast(id as string) subject", "concat('l', id) line")
    with_parts = lines.repartitionByRange(3, "sort_key").sortWithinPartitions("sort_key")
    sinks.stores.register(spark)
    with_parts.select("line").write.format("stamped_table").options(stamp="d", fingerprint="f").mode("overwrite").save(path)
    first, second, *_ = sorted((tmp_path / "t" / "data").iterdir())
    first.write_text("changed\n")
    second.unlink()
    status = {p.part: p.status for p in sinks.table_parts(spark, path).collect()}
    assert status[0] == "altered" and status[1] == "missing" and set(status.values()) == {"altered", "missing", "ok"}
    with pytest.raises(Exception, match="is altered|is missing"):
        sinks.read_table(spark, path).collect()


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.emit_table(spark.createDataFrame([], LINES), "d", "f", path)
    assert sinks.read_table(spark, path).isEmpty() and sinks.table_parts(spark, path).isEmpty()


def test_records_verified_against_the_store(spark, tmp_path):
    path = str(tmp_path / "r")
    schema = "k int, a long, b string, day string"
    sinks.emit_records(spark.createDataFrame([(1, 5, "x\ny", "old"), (2, None, "z", "old")], schema), "d", "f", path)
    fresh = spark.createDataFrame([(1, 5, "x\ny", "new"), (2, 7, None, "new"), (3, 1, None, "new")], schema)
    got = {(r.k, r.field, r.stored, r.recomputed) for r in sinks.verify_records(fresh, path, ["k"], ["day"]).collect()}
    assert got == {("2", "a", None, "7"), ("2", "b", "z", None), ("3", "a", None, "1")}


def test_observed_sizes_beyond_32_bits(spark, tmp_path):
    pages = [(10, "https://a.example/x", "x" * 30_000), (12, "https://a.example/y", None), (13, "https://a.example/z", "xyz")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    seen = fixtures.frame(spark, str(tmp_path), "fs_observed")
    assert {r.url[-1]: r.n_bytes for r in seen.collect()} == {"x": 3_000_000_000, "y": None, "z": 3}
    plan = q_sources.s6(spark, str(tmp_path))
    assert {r.url[-1]: (r.decision, r.n_bytes) for r in plan.collect() if r.url[-1] != "y"} == {"x": ("too large", 3_000_000_000), "z": ("store", 3)}
