"""Column functions: one violating and one clean case each; absent is not zero is not empty."""

import hashlib

from pyspark.sql import functions as F

from veriledger.functions import content, urls


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v")).alias("r")).collect()]


def test_source_key(spark):
    cases = {
        "https://huggingface.co/api/models/o/r/revision/x": "hf:o/r",
        "https://huggingface.co/api/datasets/o/d/tree/x": "hfds:o/d",
        "https://huggingface.co/datasets/o/d/blob/main/x": "hfds:o/d",
        "https://huggingface.co/o/r/resolve/x/f": "hf:o/r",
        "https://raw.githubusercontent.com/o/r/main/README.md": "gh:o/r",
        "https://api.github.com/repos/o/r/git/trees/x": "gh:o/r",
        "https://arxiv.org/abs/2401.00001": "arxiv:2401.00001",
        "https://example.org/a/b": "host:example.org",
        "example.org/a//b": "host:b",
    }
    assert column(spark, list(cases), urls.source_key) == list(cases.values())


def test_query_terms(spark):
    url = "https://export.arxiv.org/api/query?search_query=abs%3A%22Llama%203.1%22%20AND%20abs%3A%22from%20scratch%22&start=0"
    assert column(spark, [url, "https://x/y"], urls.query_term) == ["from scratch", "https://x/y"]
    assert column(spark, [url], lambda c: urls.query_labels(c, ["from scratch"])) == [["Llama 3.1"]]
    assert column(spark, [url], lambda c: urls.query_names(c, F.lit("Llama 3.1"))) == [True]


def test_dates(spark):
    as_of = F.lit("2026-01-01").cast("date")
    values = ["2025-12-31", "2026-99-99", "2026-02-30", "2027-01-01", "", None, "2025-1-1"]
    assert column(spark, values, lambda c: content.is_real_past_date(c, as_of)) == [True] + [False] * 6


def test_absent_is_not_zero(spark):
    assert column(spark, [0, None, 5], content.is_absent, "int") == [False, True, False]
    assert column(spark, ["", None, "0"], lambda c: content.is_absent(c, "text")) == [True, True, False]
    assert column(spark, [[], None, [0]], lambda c: content.is_absent(c, "container"), "array<int>") == [True, True, False]


def test_sha256_lookalikes(spark):
    values = ["a" * 64, "a" * 63, "A" * 64, "word", None]
    assert column(spark, values, content.is_sha256) == [True, False, False, False, False]


def test_walls(spark):
    manual = "Sign in to continue. " + "documentation " * 1000
    gate = "Please log in " + "x" * 100
    challenge = "x" * 30000 + " checking your browser"
    pointer = "version https://git-lfs.github.com/spec/v1\noid sha256:" + "a" * 64 + "\nsize 12\n"
    got = column(spark, [manual, gate, challenge, pointer, "short"], lambda c: content.classify_wall(c, F.lit("200")))
    assert got == [None, "gate:please log in", "challenge:checking your browser", None, "too-small"]
    assert column(spark, [manual], lambda c: content.classify_wall(c, F.lit("404"))) == ["http:404"]


def test_commit_object(spark):
    body = "tree x\ncommitter A B <a@example.org> 1 +0000\ngpgsig y\n\n  First line  \nmore"
    raw = body.encode()
    want = hashlib.sha1(b"commit " + str(len(raw)).encode() + b"\0" + raw).hexdigest()
    assert column(spark, [body], lambda c: content.git_object_id(c.cast("binary"))) == [want]
    fields = column(spark, [body], content.commit_fields)[0]
    assert (fields.committer, fields.subject_line, fields.signed) == ("a@example.org", "First line", True)


def test_affected_axes_refuses_unroutable(spark):
    assert column(spark, ["axis 17 only", "axis16 and axis  17", "axis 3", None], content.affected_axes) == [[17], [16, 17], [], []]


def test_occurrences_do_not_overlap(spark):
    assert column(spark, ["aAaa", "abc"], lambda c: content.occurrences(c, F.lit("aa"))) == [2, 0]
