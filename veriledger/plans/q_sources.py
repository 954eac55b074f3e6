"""Source, scan and sink queries.

Stores, ledgers and tables are written into the shared folder first and then read by the operator under test; a
folder belongs to one query, input and session, so a repeated run replaces it or adds nothing to it.
"""

import hashlib

from pyspark.sql import functions as F

from veriledger.operators import scoring
from veriledger.plans.catalog import DIGEST_WORDS, query
from veriledger.plans.fixtures import AS_OF, frame
from veriledger.session import shared_dir
from veriledger.sources import blobs, documents, ledger, registry, sinks


def _folder(spark, d, name):
    return f"{shared_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{hashlib.md5(d.encode()).hexdigest()[:10]}"


def _ledger_docs(spark, d):
    """The clean ledger as JSON documents, one per subject (at most 22 cells each)."""
    cells = frame(spark, d, "fx_cells").groupBy("subject").agg(F.collect_list(F.struct(
        F.col("subject").cast("string").alias("subject"), "axis", "score",
        F.when(F.col("has_bound"), F.struct(F.lit("grep_retrieved").alias("method"))).alias("bound"),
    )).alias("cells"))
    return cells.select(F.to_json(F.struct(
        F.lit("2024-06-01").alias("as_of"), F.struct(F.lit(1).alias("bounded_zeros")).alias("zero_bounds_floor"), "cells"
    )).alias("doc"))


@query("s1_read_ledger", """
SELECT CAST(subject AS VARCHAR) AS subject, axis, score, FALSE AS has_check, has_bound, '2024-06-01' AS as_of FROM fx_cells""")
def s1(spark, d):
    path = _folder(spark, d, "ledger")
    _ledger_docs(spark, d).write.mode("overwrite").text(path)
    cells = ledger.cells_of(ledger.read_ledger(spark, path), "as_of")
    return cells.select("subject", "axis", "score", "has_check", "has_bound", "as_of")


@query("s2_all_cited", """
SELECT CAST(subject AS VARCHAR) || '/axis' || axis AS label, url, sha256 FROM fl_evidence UNION ALL SELECT label, url, sha256 FROM fl_facts""")
def s2(spark, d):
    return ledger.all_cited(frame(spark, d, "fl_evidence"), frame(spark, d, "fl_facts"))


@query("s3_read_facts", """
SELECT 'fact-' || page_id AS name, length(html) AS value, 'chars' AS unit, 'byte_length' AS method, url, sha AS sha256 FROM fx_pages""")
def s3(spark, d):
    path = _folder(spark, d, "facts")
    frame(spark, d, "fs_facts").select("body").write.mode("overwrite").text(path)
    return ledger.read_facts(spark, path).withColumn("method", F.col("method.name"))


@query("s4_blob_scan", """
WITH bl AS (SELECT DISTINCT sha256(text) AS h, text FROM documents WHERE text IS NOT NULL)
SELECT cell, sha256, strlen(text) AS n_bytes, sha256(text) AS body_sha256, text IS NOT NULL AS archived FROM fs_cites LEFT JOIN bl ON h = sha256""")
def s4(spark, d):
    path = _folder(spark, d, "members")
    blobs.write_gzip_store(frame(spark, d, "documents").select(F.col("text").cast("binary").alias("body")).distinct(), path)
    members = blobs.read_gzip_store(spark, path)
    # what is asked of the bytes is computed beside them, the answers meet the citations
    read = members.select("sha256", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("body_sha256"))
    return frame(spark, d, "fs_cites").join(read, "sha256", "left").withColumn("archived", F.col("n_bytes").isNotNull())


@query("s4_member_status", """
SELECT sha256(text) AS sha256, 'ok' AS status, count(*) AS n_documents FROM documents WHERE text IS NOT NULL GROUP BY text""")
def s4_status(spark, d):
    path = _folder(spark, d, "status")
    bodies = frame(spark, d, "documents").select(F.col("text").cast("binary").alias("body"))
    blobs.write_gzip_store(bodies, path)  # copies meet the member that is there
    counts = bodies.groupBy(F.sha2("body", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n_documents"))
    return blobs.read_gzip_store(spark, path).select("sha256", "status").join(counts, "sha256")


@query("s5_blob_store", """
SELECT sha256, any_value(n) AS n_bytes FROM (SELECT sha256(html) AS sha256, strlen(html) AS n FROM pages
  UNION ALL SELECT sha256(text), strlen(text) FROM documents) WHERE sha256 NOT IN (SELECT sha256 FROM fs_stored) GROUP BY sha256""")
def s5(spark, d):
    bodies = frame(spark, d, "documents").select(F.col("text").cast("binary").alias("body")).unionByName(
        frame(spark, d, "pages").select(F.col("html").cast("binary").alias("body"))
    )
    fresh = blobs.blobs_to_store(bodies, frame(spark, d, "fs_stored"))
    return fresh.select("sha256", F.octet_length("body").cast("long").alias("n_bytes"))


@query("s6_archive_plan", """
WITH j AS (SELECT w.url, w.sha256, w.volatile, w.range, o.observed_sha256 AS o, o.n_bytes, o.has_body, w.sha256 IN (SELECT sha256 FROM fs_stored) AS st
           FROM fs_wanted w LEFT JOIN fs_observed o ON o.url = w.url),
z AS (SELECT url, sha256, n_bytes, CASE WHEN st THEN 'already stored' WHEN range IS NOT NULL THEN CASE WHEN o IS NULL OR o <> sha256 THEN 'range moved' ELSE 'store range' END
  WHEN n_bytes > 8 * 1024 * 1024 THEN 'too large' WHEN o IS NULL THEN 'unretrievable' WHEN o <> sha256 THEN CASE WHEN volatile THEN 'volatile' ELSE 'drifted' END
  WHEN NOT has_body THEN 'no body' ELSE 'store' END AS decision FROM j)
SELECT *, decision IN ('already stored', 'store', 'store range') AS stored FROM z""")
def s6(spark, d):
    plan = blobs.archive_plan(frame(spark, d, "fs_wanted"), frame(spark, d, "fs_stored"), frame(spark, d, "fs_observed"), max_bytes=8 * 1024 * 1024)
    return plan.withColumn("n_bytes", F.col("n_bytes").cast("long"))


@query("s7_parse_feed", r"""
WITH b AS (SELECT doc_id, body, regexp_extract_all(body, '(?s)<entry>(.*?)</entry>', 1) AS es FROM fs_feeds),
e AS (SELECT doc_id, CAST(regexp_extract(body, 'totalResults[^>]*>(\d+)<', 1) AS BIGINT) AS total, es[i] AS e, CAST(i - 1 AS INTEGER) AS pos FROM b, range(1, 50) t(i) WHERE i <= len(es))
SELECT doc_id, total, pos, trim(regexp_extract(e, '<id>([^<]*)</id>', 1)) AS id,
  trim(regexp_replace(regexp_extract(e, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title,
  trim(regexp_replace(regexp_extract(e, '(?s)<summary>(.*?)</summary>', 1), '\s+', ' ', 'g')) AS abstract FROM e""")
def s7(spark, d):
    return documents.parse_feed(frame(spark, d, "fs_feeds"), "body", "doc_id")


@query("s8_parse_primary_category", """
SELECT '25' || doc_id || '.2' AS id, 'stat.' || source AS category FROM documents
UNION ALL SELECT '24' || doc_id || '.1v1', 'cs.' || upper(lang) FROM documents WHERE doc_id % 4 <> 0""")
def s8(spark, d):
    return documents.parse_primary_category(frame(spark, d, "fs_feeds"), "body")


@query("s9_enumerate_paths", """
SELECT page_id, 0 AS pos, url AS path FROM fx_pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 1, 'second/' || page_id FROM fx_pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 0, 'https://host/base/a/' || page_id FROM fx_pages WHERE page_id % 6 = 1
UNION ALL SELECT page_id, 1, 'https://host/base/b' FROM fx_pages WHERE page_id % 6 = 1
UNION ALL SELECT page_id, NULL, NULL FROM fx_pages WHERE page_id % 3 = 2 OR page_id % 6 = 4""")
def s9(spark, d):
    return documents.enumerate_paths(frame(spark, d, "fs_lists"), "kind", "body", "base", "page_id")


@query("s10_enumerate_revision", """
SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'not json' WHEN p_partkey % 5 = 0 THEN 'other revision' WHEN p_partkey % 7 = 0 THEN 'other repository' END AS reason,
       CASE WHEN p_partkey % 17 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN 'a.bin,model-' || p_size || '.safetensors' END AS shards FROM part""")
def s10(spark, d):
    found = documents.enumerate_revision(F.col("body"), F.col("repo"), F.col("revision"))
    return frame(spark, d, "fs_revisions").select("p_partkey", found.alias("r")).select(
        "p_partkey", "r.reason", F.array_join("r.shards", ",").alias("shards")
    )


@query("s11_emit_tables", """
WITH t AS (SELECT c.subject, count(*) FILTER (WHERE score = 2) AS a, count(*) FILTER (WHERE score = 1) AS b, count(*) FILTER (WHERE score = 0) AS z,
  count(*) - count(score) AS na, sum(score) / (2.0 * count(score)) AS x, sum(score) / (2.0 * count(*)) AS lo, (sum(score) + 2 * (count(*) - count(score))) / (2.0 * count(*)) AS hi,
  sum(CASE WHEN score IS NULL THEN 0 WHEN s.kind = 'api-only' AND axis = 12 THEN 0 WHEN axis IN (5, 7, 16, 17, 19) OR (s.kind = 'api-only' AND axis IN (13, 14, 15)) THEN 1 ELSE 2 END) / (2.0 * count(score)) AS cap
  FROM fx_cells c JOIN fx_subjects s ON s.subject = c.subject GROUP BY c.subject)
SELECT row_number() OVER (ORDER BY x DESC NULLS FIRST, subject) AS rank, format('| {} | {} | {} | {} | {} | {:.3f} | {:.3f} | {:.3f} | {:.3f} |', subject, a, b, z, na, x, lo, hi, cap) AS line FROM t""")
def s11(spark, d):
    path = _folder(spark, d, "score-table")
    _emit_scores(spark, d, path)
    return sinks.read_table(spark, path)


def _emit_scores(spark, d, path):
    cells = frame(spark, d, "fx_cells")
    fingerprint = scoring.ledger_fingerprint(cells, frame(spark, d, "fp_policy")).first().fingerprint  # one row
    sinks.emit_table(sinks.score_table(scoring.score(cells, frame(spark, d, "fx_subjects"))), AS_OF, fingerprint, path)


@query("s11_table_stamp", f"""
WITH dg AS (SELECT sha256(concat_ws('|', 'cell', subject, axis, coalesce(CAST(score AS VARCHAR), 'None'))) AS d FROM fx_cells
  UNION ALL SELECT sha256(concat_ws('|', 'policy', subject, axis, key, coalesce(value, 'None'))) FROM fp_policy)
SELECT '{AS_OF}' AS stamp, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {DIGEST_WORDS})) AS fingerprint,
  (SELECT count(DISTINCT subject) FROM fx_cells) AS n_lines, 'ok' AS status FROM dg""")
def s11_stamp(spark, d):
    path = _folder(spark, d, "stamped-table")
    _emit_scores(spark, d, path)
    return sinks.table_parts(spark, path).groupBy("stamp", "fingerprint", "status").agg(F.sum("n").alias("n_lines"))


@query("s12_emit_records", """
SELECT subject, format('{{"subject":{},"n_2":{},"n_1":{},"n_0":{},"n_na":{}}}', subject, count(*) FILTER (WHERE score = 2), count(*) FILTER (WHERE score = 1),
  count(*) FILTER (WHERE score = 0), count(*) - count(score)) AS record FROM fx_cells GROUP BY subject""")
def s12(spark, d):
    path = _folder(spark, d, "records")
    sinks.emit_records(_counts(spark, d), AS_OF, "", path)
    return sinks.read_records(spark, path).withColumn("subject", F.get_json_object("record", "$.subject").cast("long"))


def _counts(spark, d):
    return scoring.score(frame(spark, d, "fx_cells"), frame(spark, d, "fx_subjects")).select("subject", "n_2", "n_1", "n_0", "n_na")


@query("s12_verify_records", """
WITH t AS (SELECT subject, count(*) FILTER (WHERE score = 2) AS n2, count(*) - count(score) AS na FROM fx_cells GROUP BY subject)
SELECT CAST(subject AS VARCHAR) AS subject, 'n_2' AS field, CAST(n2 + 1 AS VARCHAR) AS stored, CAST(n2 AS VARCHAR) AS recomputed FROM t WHERE subject % 3 = 1
UNION ALL SELECT CAST(subject AS VARCHAR), 'n_na', NULL, CAST(na AS VARCHAR) FROM t WHERE subject % 4 = 2""")
def s12_verify(spark, d):
    path = _folder(spark, d, "verified-records")
    counts = _counts(spark, d)
    moved = counts.withColumns({
        "n_2": F.col("n_2") + (F.col("subject") % 3 == 1).cast("int"), "n_na": F.when(F.col("subject") % 4 != 2, F.col("n_na")), "day": F.lit("old"),
    })
    sinks.emit_records(moved, AS_OF, "", path)
    return sinks.verify_records(counts.withColumn("day", F.lit("new")), path, ["subject"], ["day"])


@query("s13_verify_record", """
WITH st AS (SELECT axis, 'n' AS field, CAST(count(*) + (axis % 5 = 0)::INT AS VARCHAR) AS value FROM fx_cells GROUP BY axis
            UNION ALL SELECT axis, 'total', CAST(sum(score) AS VARCHAR) FROM fx_cells GROUP BY axis
            UNION ALL SELECT axis, 'gone', '1' FROM fx_cells WHERE axis % 7 = 0 GROUP BY axis),
re AS (SELECT axis, 'n' AS field, CAST(count(*) AS VARCHAR) AS value FROM fx_cells GROUP BY axis
       UNION ALL SELECT axis, 'total', CAST(sum(score) AS VARCHAR) FROM fx_cells GROUP BY axis
       UNION ALL SELECT axis, 'fresh', '2' FROM fx_cells WHERE axis % 6 = 0 GROUP BY axis)
SELECT coalesce(st.axis, re.axis) AS axis, coalesce(st.field, re.field) AS field, st.value AS stored, re.value AS recomputed
FROM st FULL JOIN re ON st.axis = re.axis AND st.field = re.field WHERE st.value IS DISTINCT FROM re.value""")
def s13(spark, d):
    by_axis = frame(spark, d, "fx_cells").groupBy("axis").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))

    def fields(n, extra, cond):
        def item(field, value):
            return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"))

        items = F.array(
            item("n", n), item("total", F.col("total")), item("as_of", F.lit(extra)),
            F.when(cond, item(extra, F.lit("1" if extra == "gone" else "2"))),
        )
        return by_axis.select("axis", F.explode(F.filter(items, lambda i: i.isNotNull())).alias("i")).select("axis", "i.*")

    stored = fields(F.col("n") + (F.col("axis") % 5 == 0).cast("int"), "gone", F.col("axis") % 7 == 0)
    recomputed = fields(F.col("n"), "fresh", F.col("axis") % 6 == 0)
    return sinks.verify_record(stored, recomputed, ["axis"], ["as_of"])


@query("s11_emit_axis_table", """
SELECT axis, format('| {} | {} | {} | {} |', axis, CASE WHEN axis <= 5 THEN 1 WHEN axis <= 11 THEN 2 WHEN axis <= 15 THEN 3 WHEN axis <= 19 THEN 4 ELSE 5 END,
  name, CASE WHEN axis IN (12, 13, 14, 15, 20, 21, 22) THEN 'yes' ELSE 'no' END) AS line
FROM (SELECT DISTINCT axis FROM fx_cells) JOIN (VALUES (1, 'corpus enumerated'), (2, 'corpus content-addressed'), (3, 'corpus committed BEFORE'), (4, 'corpus obtainable'),
 (5, 'membership decidable'), (6, 'training code released'), (7, 'hyperparameters fully specified'), (8, 'seeds published'),
 (9, 'determinism settings specified'), (10, 'environment pinned'), (11, 'data order reproducible'), (12, 'weights released'),
 (13, 'weights content-addressed'), (14, 'weights signed'), (15, 'weights timestamped'), (16, 'bit-identical reproduction reported'),
 (17, 'approximate reproduction reported'), (18, 'eval harness released and versioned'), (19, 'eval/train disjointness checkable'),
 (20, 'fine-tuning data disclosed'), (21, 'preference or reward data disclosed'), (22, 'safety-training procedure disclosed')) nm(id, name) ON id = axis""")
def s11_axes(spark, d):
    axis = F.col("axis")
    return frame(spark, d, "fx_cells").select("axis").distinct().select(
        "axis", sinks.axis_line(axis, registry.axis_group(axis), registry.axis_name(axis), axis.isin(registry.NA_AXES)).alias("line")
    )
