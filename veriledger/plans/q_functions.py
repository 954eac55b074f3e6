"""Scalar function queries (addresses, bodies, dates, digests, lookups)."""

from pyspark.sql import functions as F

from veriledger.functions import content, urls
from veriledger.plans.catalog import query
from veriledger.plans.fixtures import frame
from veriledger.sources import registry

_HUB = "^https://huggingface\\.co/"
_REST = "split_part(url, '//', 2)"


def _joined(array):
    return F.array_join(array.cast("array<string>"), ",")


@query("p1_source_key", f"""
WITH sp AS (SELECT page_id, url, split_part({_REST}, '/', 1) AS h, list_filter(string_split({_REST}, '/')[2:], lambda x: x <> '') AS p FROM fu_urls)
SELECT page_id, CASE
  WHEN h = 'huggingface.co' AND p[1] = 'api' THEN (CASE WHEN p[2] = 'models' THEN 'hf:' ELSE 'hfds:' END) || p[3] || '/' || p[4]
  WHEN h = 'huggingface.co' AND p[1] = 'datasets' THEN 'hfds:' || p[2] || '/' || p[3]
  WHEN h = 'huggingface.co' THEN 'hf:' || p[1] || '/' || p[2]
  WHEN h IN ('raw.githubusercontent.com', 'github.com') THEN 'gh:' || p[1] || '/' || p[2]
  WHEN h = 'api.github.com' THEN 'gh:' || p[2] || '/' || p[3]
  WHEN h = 'arxiv.org' THEN 'arxiv:' || p[len(p)] ELSE 'host:' || h END AS source FROM sp""")
def p1(spark, d):
    return frame(spark, d, "fu_urls").select("page_id", urls.source_key(F.col("url")).alias("source"))


@query("p2_is_mutable_ref", "SELECT page_id, url LIKE '%/main/%' OR url LIKE '%/master/%' OR url LIKE '%/HEAD/%' OR url LIKE '%/latest/%' AS mutable FROM fu_urls")
def p2(spark, d):
    return frame(spark, d, "fu_urls").select("page_id", urls.is_mutable_ref(F.col("url")).alias("mutable"))


@query("p3_parse_pinned_url", """
WITH q AS (SELECT page_id, url, page_id % 10 AS k, string_split(url, '/') AS p FROM fu_urls)
SELECT page_id, CASE k WHEN 0 THEN 'model_revision' WHEN 1 THEN 'dataset_tree' WHEN 2 THEN 'file' WHEN 4 THEN 'source_tree' END AS shape,
  CASE k WHEN 0 THEN p[6] || '/' || p[7] WHEN 1 THEN p[6] || '/' || p[7] WHEN 2 THEN p[4] || '/' || p[5] WHEN 4 THEN p[5] || '/' || p[6] END AS repo,
  CASE k WHEN 0 THEN p[9] WHEN 1 THEN p[9] WHEN 2 THEN p[7] WHEN 4 THEN split_part(p[9], '?', 1) END AS revision,
  CASE k WHEN 1 THEN nullif(array_to_string(p[10:], '/'), '') WHEN 2 THEN array_to_string(p[8:], '/') END AS path FROM q""")
def p3(spark, d):
    pinned = urls.parse_pinned_url(F.col("url"))
    return frame(spark, d, "fu_urls").select("page_id", pinned.alias("p")).select("page_id", "p.*")


@query("p4_query_term", """
SELECT page_id, CASE WHEN page_id % 10 <> 7 THEN url WHEN page_id % 3 = 0 THEN 'from scratch' ELSE 'reproduce' END AS term,
       page_id % 10 = 7 AND page_id % 5 = 2 AS searches_model_2,
       CASE WHEN page_id % 10 = 7 THEN 'Model ' || page_id % 5 ELSE '' END AS labels FROM fu_urls""")
def p4(spark, d):
    url = F.col("url")
    return frame(spark, d, "fu_urls").select(
        "page_id", urls.query_term(url).alias("term"), urls.query_names(url, F.lit("Model 2")).alias("searches_model_2"),
        F.array_join(urls.query_labels(url, ["reproduce", "from scratch"]), ",").alias("labels"),
    )


@query("p5_record_id", """
SELECT page_id, CASE WHEN page_id % 10 = 5 THEN '2401.' || lpad(CAST(page_id AS VARCHAR), 5, '0') ELSE '' END
  || CASE WHEN page_id % 10 = 5 THEN ',' ELSE '' END || '9999.00001' AS ids FROM fu_urls""")
def p5(spark, d):
    text = F.concat(F.col("url"), F.lit(" see http://arxiv.org/abs/9999.00001"))
    return frame(spark, d, "fu_urls").select("page_id", F.array_join(urls.record_ids(text), ",").alias("ids"))


@query("p6_affected_axes", """
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([doc_id % 20, CASE WHEN quality = 1 THEN 17 END], lambda x: x IN (16, 17)))), ',') AS axes,
       NOT (doc_id % 20 IN (16, 17) OR quality = 1) AS refused FROM labels""")
def p6(spark, d):
    affects = F.concat(F.lit("bears on axis  "), (F.col("doc_id") % 20).cast("string"), F.when(F.col("quality") == 1, " and axis17 too").otherwise(""))
    axes = content.affected_axes(affects)
    return frame(spark, d, "labels").select("doc_id", _joined(axes).alias("axes"), (F.size(axes) == 0).alias("refused"))


@query("p7_dates", """
SELECT o_orderkey, o_orderkey % 7 = 0 OR (o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0) AS iso,
       coalesce(TRY_CAST(text AS DATE) <= DATE '1998-01-01', FALSE) AND length(text) = 10 AS real_past FROM fu_dates""")
def p7(spark, d):
    text = F.col("text")
    return frame(spark, d, "fu_dates").select(
        "o_orderkey", content.is_iso_date(text).alias("iso"), content.is_real_past_date(text, F.lit("1998-01-01").cast("date")).alias("real_past")
    )


@query("p8_is_sha256", "SELECT page_id, page_id % 3 = 0 AS ok FROM fu_urls")
def p8(spark, d):
    text = F.when(F.col("page_id") % 3 == 0, F.col("sha")).when(F.col("page_id") % 3 == 1, F.upper("sha")).otherwise(F.substring("sha", 1, 63))
    return frame(spark, d, "fu_urls").select("page_id", content.is_sha256(text).alias("ok"))


@query("p9_is_absent", """
SELECT event_id, event_type IN ('error', 'click') AS text_absent, event_id % 3 = 1 AS number_absent, event_type = 'view' AS list_absent FROM events""")
def p9(spark, d):
    kind = F.col("event_type")
    text = F.when(kind == "error", "").when(kind == "click", F.lit(None)).otherwise(F.col("props"))
    number = F.when(F.col("event_id") % 3 == 0, 0.0).when(F.col("event_id") % 3 == 2, F.col("value"))
    items = F.filter(F.array("event_type"), lambda x: x != "view")
    return frame(spark, d, "events").select(
        "event_id", content.is_absent(text, "text").alias("text_absent"), content.is_absent(number).alias("number_absent"),
        content.is_absent(items, "container").alias("list_absent"),
    )


@query("p10_range_length", "SELECT p_partkey, CAST(p_size + 1 AS BIGINT) AS n_bytes FROM part")
def p10(spark, d):
    spec = F.format_string("bytes=%d-%d", F.col("p_partkey"), F.col("p_partkey") + F.col("p_size"))
    return frame(spark, d, "part").select("p_partkey", content.range_length(spec).alias("n_bytes"))


@query("p11_classify_wall", """
WITH b AS (SELECT page_id, status, body, lower(body) AS h, strlen(body) AS n FROM fu_bodies)
SELECT page_id, CASE WHEN status <> '200' THEN 'http:' || status WHEN page_id % 11 = 0 THEN NULL WHEN n < 64 THEN 'too-small'
  WHEN contains(h, 'checking your browser') THEN 'challenge:checking your browser'
  WHEN n <= 4096 AND contains(h, 'log in to continue') THEN 'gate:log in to continue'
  WHEN n <= 4096 AND contains(h, 'rate limit') THEN 'gate:rate limit' END AS wall FROM b""")
def p11(spark, d):
    return frame(spark, d, "fu_bodies").select("page_id", content.classify_wall(F.col("body"), F.col("status")).alias("wall"))


@query("p12_is_throttled", """
SELECT page_id, status IN ('429', '503') OR (status = '403' AND contains(lower(body), 'rate limit')) AS throttled FROM fu_bodies""")
def p12(spark, d):
    return frame(spark, d, "fu_bodies").select("page_id", content.is_throttled(F.col("status"), F.col("body")).alias("throttled"))


@query("p13_parse_pointer", """
SELECT page_id, page_id % 11 = 0 AS is_pointer, CASE WHEN page_id % 11 = 0 THEN sha END AS oid,
       CASE WHEN page_id % 11 = 0 THEN length(html) END AS size FROM fx_pages""")
def p13(spark, d):
    return frame(spark, d, "fu_bodies").select("page_id", content.parse_pointer(F.col("body")).alias("p")).select("page_id", "p.*")


@query("p14_sniff_header", """
SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'no safetensors header' WHEN 2 THEN CASE WHEN doc_id % 4 = 0 OR strlen(text) < 8 THEN 'too short' ELSE 'no safetensors header' END
   WHEN 4 THEN 'pointer' WHEN 5 THEN CASE WHEN left(text, 1) = '{' OR left(text, 2) = 'PK' THEN NULL ELSE 'no weight magic' END END AS reason FROM documents""")
def p14(spark, d):
    return frame(spark, d, "fu_heads").select("doc_id", content.sniff_header(F.col("body"), F.col("name")).alias("reason"))


@query("p15_primary_object", """
WITH n AS (SELECT l_orderkey, 'part-' || l_linenumber || CASE WHEN l_returnflag = 'R' THEN '.safetensors' ELSE '.bin' END AS name FROM lineitem)
SELECT l_orderkey, coalesce(min(name) FILTER (WHERE name LIKE '%.safetensors'), min(name)) AS name FROM n GROUP BY l_orderkey""")
def p15(spark, d):
    name = F.concat(F.lit("part-"), F.col("l_linenumber").cast("string"), F.when(F.col("l_returnflag") == "R", ".safetensors").otherwise(".bin"))
    return frame(spark, d, "lineitem").groupBy("l_orderkey").agg(content.primary_object_of(name).alias("name"))


@query("p16_git_object_id", """
SELECT doc_id, sha1(encode('commit ' || strlen(body)) || unhex('00') || encode(body)) AS object_id FROM fu_commits""")
def p16(spark, d):
    return frame(spark, d, "fu_commits").select("doc_id", content.git_object_id(F.col("body").cast("binary")).alias("object_id"))


@query("p17_commit_fields", """
SELECT doc_id, 'user' || doc_id % 9 || '@example.org' AS committer, 'Update ' || doc_id % 5 AS subject_line,
       doc_id % 3 = 0 OR contains(body, 'gpgsig') AS signed FROM fu_commits""")
def p17(spark, d):
    return frame(spark, d, "fu_commits").select("doc_id", content.commit_fields(F.col("body")).alias("c")).select("doc_id", "c.*")


@query("p18_dimension_lookups", """
SELECT axis, score, CASE score WHEN 2 THEN 'VERIFIED' WHEN 1 THEN 'ASSERTED' WHEN 0 THEN 'ABSENT' WHEN 3 THEN 'UNKNOWN' ELSE 'N/A' END AS level,
  CASE WHEN axis <= 5 THEN 'Corpus — what the model was made from' WHEN axis <= 11 THEN 'Procedure — how the artifact was produced'
       WHEN axis <= 15 THEN 'Artifact — the thing shipped' WHEN axis <= 19 THEN 'Verification — has anyone actually checked'
       WHEN axis <= 22 THEN 'Post-training — where behaviour is shaped, and visibility is lowest' ELSE 'ungrouped' END AS group_name,
  c.cost, c.cost IS NULL AS cost_missing, count(*) AS n
FROM fl_cells LEFT JOIN (SELECT p_size AS id, min(p_type) AS cost FROM part GROUP BY p_size) c ON id = axis GROUP BY ALL""")
def p18(spark, d):
    cells = frame(spark, d, "fl_cells").groupBy("axis", "score").agg(F.count(F.lit(1)).alias("n"))
    costs = frame(spark, d, "part").groupBy(F.col("p_size").alias("axis")).agg(F.min("p_type").alias("cost"))
    named = cells.select(
        "axis", "score", "n", registry.level_name(F.col("score")).alias("level"),
        registry.group_name(registry.axis_group(F.col("axis"))).alias("group_name"),
    )
    return registry.cost_of(named, costs)
