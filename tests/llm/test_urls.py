from pyspark.sql import functions as F

from veriledger.llm import url_aliases as U

PAGES = "page_id long, url string, html string, rule string, component long"
CANON = '<link rel="canonical" href="{}">'


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, (u, h) in enumerate(rows)], PAGES)


def verdicts(spark, rows, **more):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict, r.decided_by) for r in U.judge(pages(spark, rows), **more).collect()}


def test_rules_longest_prefix_and_odd_urls(spark):
    got = verdicts(spark, [
        ("http://WWW.Example.COM/en/1?x#y", None), ("https://m.example.com/en/1", ""), ("http://a.net/es", ""), ("http://net/fr/", ""),
        ("http://a.com?x", ""), ("no scheme", ""), (None, None), ("http://b.org/é", "<p>")])
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow", "rule")
    assert got[1][2:4] == ("example.com/en/", "block")
    assert got[2][2:4] == (None, "allow") and got[3][2:4] == ("net/fr/", "block")
    assert got[4][:3] == ("a.com", "", None)
    assert got[5] == ("", "", None, "allow", "default") and got[6] == ("", "", None, "allow", "default")
    assert got[7][0:2] == ("b.org", "/é")


def test_blocks_reach_aliases_through_chains_and_allow_wins(spark):
    got = verdicts(spark, [
        ("http://a.org/1", CANON.format("http://b.org/1")),
        ("http://b.org/1", "<META http-equiv='refresh' content='0; url=http://x.net/es/9'>"),
        ("https://b.org/1#frag", ""),
        ("http://c.org/1", CANON.format("/self") + CANON.format("http://y.net/fr/2") + CANON.format("http://z.com/ok")),
        ("http://d.org/1", CANON.format("http://d.org/1")),
        ("http://y.net/fr/2", ""), ("http://lone.org/", CANON.format("mailto:a@b"))])
    assert [got[i][3:] for i in range(3)] == [("block", "alias")] * 3
    assert got[3][3:] == ("allow", "alias") and got[5][3:] == ("block", "rule")
    assert got[4][3:] == ("allow", "default") and got[6][3:] == ("allow", "default")


def test_redirect_table_hub_and_empty(spark):
    hub = [(f"http://h{i}.org/", "") for i in range(40)]
    redirects = spark.createDataFrame([(u, "http://hub.org/") for u, _ in hub] + [("http://hub.org/", "http://q.net/es/")], "source string, target string")
    got = verdicts(spark, hub + hub[:2], redirects=redirects)
    assert len(got) == 42 and {v[3:] for v in got.values()} == {("block", "alias")}
    assert U.judge(pages(spark, [("http://a.org", None)]).where("false")).count() == 0


def test_members_are_judged_by_their_own_path(spark):
    # a.com has an empty path, which com/ does not fit; no member is allowed, so the block reaches all
    got = verdicts(spark, [("http://a.com", CANON.format("http://x.net/es/1")), ("http://b.org/1", CANON.format("http://a.com")), ("http://a.com/", None)])
    assert [got[i][3:] for i in (0, 1)] == [("block", "alias")] * 2 and got[2][3:] == ("allow", "rule")


def test_line_feeds_long_urls_and_clashing_columns(spark):
    far = "http://b.org/" + "y" * 100_000
    rows = [("\nhttp://w.org/9", None), ("\nhttp://v.org/9", CANON.format("http://x.net/es/9")), (far, CANON.format("http://x.net/fr/1")), (far + "z", "")]
    got = verdicts(spark, rows)
    assert got[0] == ("w.org", "/9", None, "allow", "default") and got[1] == ("v.org", "/9", None, "block", "alias")
    assert got[2][3:] == ("block", "alias") and got[2][1] == far[12:] and got[3][3:] == ("allow", "default")
    more = pages(spark, rows)
    for name in ("host", "path", "key", "verdict", "a", "b", "node", "u", "v", "m", "target", "decided_by"):
        more = more.withColumn(name, F.lit("x"))
    assert {r.page_id: r.verdict for r in U.judge(more).collect()} == {i: r[3] for i, r in got.items()}
