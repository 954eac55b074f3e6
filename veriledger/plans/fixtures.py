"""Stand-in ledger tables derived from the given parquet tables.

Each view is one SELECT in the SQL subset that both Spark and DuckDB read, so the
same input rows reach the operators under test and their independent oracles.  The
views only prepare input; no operator lives here.  ``@name`` is a given table.
Defects are injected by arithmetic on the row's own counts, at every scale.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

TABLE = r"@(region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|pages|benchmark|labels|conversations)\b"
AS_OF = "2024-06-01"

VIEWS: dict[str, str] = {}

# ------------------------------------------------------------------ clean ledger
VIEWS["fx_subjects"] = """
SELECT s_suppkey AS subject,
       CASE s_suppkey % 4 WHEN 0 THEN 'fully-open' WHEN 1 THEN 'open-weights'
                          WHEN 2 THEN 'api-only' ELSE 'historical-control' END AS kind,
       CONCAT('org', CAST(s_suppkey % 7 AS STRING), '/model', CAST(s_suppkey AS STRING)) AS repo
FROM @supplier"""
VIEWS["fx_grid"] = """
SELECT l_suppkey AS s, CAST(l_partkey % 22 AS INT) + 1 AS a, COUNT(*) AS n,
       SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r
FROM @lineitem GROUP BY l_suppkey, CAST(l_partkey % 22 AS INT) + 1"""
VIEWS["fx_capped"] = """
SELECT s, a, n, CASE WHEN r % 7 <= 1 THEN 2 WHEN r % 7 <= 4 THEN 1 ELSE 0 END AS raw,
       LEAST(CASE WHEN a IN (5, 7, 16, 17, 19) THEN 1 ELSE 2 END,
             CASE WHEN s % 4 = 2 AND a = 12 THEN 0
                  WHEN s % 4 = 2 AND a IN (13, 14, 15) THEN 1 ELSE 2 END) AS cap
FROM fx_grid"""
VIEWS["fx_cells"] = """
SELECT s AS subject, a AS axis, n,
       CASE WHEN a IN (12, 13, 14, 15, 20, 21, 22) AND n % 6 = 0 THEN NULL
            ELSE LEAST(raw, cap) END AS score,
       CASE WHEN n % 5 = 0 THEN '' ELSE 'searched, nothing found' END AS note,
       n % 4 = 0 AND NOT (a IN (12, 13, 14, 15, 20, 21, 22) AND n % 6 = 0) AND LEAST(raw, cap) = 0 AS has_bound
FROM fx_capped"""
VIEWS["fx_pages"] = """
SELECT page_id, url, html, SHA256(html) AS sha,
       CONCAT('host:', regexp_extract(url, '//([^/]+)', 1)) AS source
FROM @pages"""
VIEWS["fx_evidence"] = """
SELECT c.subject, c.axis, c.score, c.n, p.page_id, p.url, p.sha AS sha256, p.source,
       CONCAT('2024-01-', LPAD(CAST(c.axis AS STRING), 2, '0')) AS retrieved
FROM (SELECT subject, axis, score, n, (subject * 22 + axis) % (SELECT COUNT(*) FROM @pages) AS page_id
      FROM fx_cells WHERE score > 0) c
JOIN fx_pages p ON c.page_id = p.page_id"""

# --------------------------------------------------------------- ledger with defects
VIEWS["fl_raw"] = """
SELECT s, a, n, raw, cap, 0 AS dup FROM fx_capped WHERE n % 19 <> 0
UNION ALL
SELECT s, a, n, raw, cap, 1 AS dup FROM fx_capped WHERE n % 19 <> 0 AND n % 12 = 0"""
VIEWS["fl_scored"] = """
SELECT s * 100 + a + 50 * dup AS cell_no, s, a, n,
       CASE WHEN n % 29 = 0 THEN s + 1000000 ELSE s END AS subject,
       CASE WHEN n % 23 = 0 THEN 99 ELSE a END AS axis,
       CASE WHEN n % 13 = 0 THEN 3
            WHEN n % 17 = 0 THEN NULL
            WHEN a IN (12, 13, 14, 15, 20, 21, 22) AND n % 6 = 0 THEN NULL
            WHEN n % 11 = 0 THEN raw
            ELSE LEAST(raw, cap) END AS score,
       CASE WHEN n % 9 = 0 THEN 'read_document'
            WHEN n % 7 = 0 THEN 'http_status'
            WHEN a = 6 THEN 'repo_tree_probe'
            WHEN a = 12 THEN 'hf_probe.weight_object'
            WHEN a = 13 THEN 'hf_probe.all_shard_digests'
            WHEN a = 4 THEN 'http_range'
            WHEN a IN (16, 17) THEN 'reproduction_search'
            ELSE 'grep_retrieved' END AS method
FROM fl_raw"""
VIEWS["fl_paged"] = """
SELECT c.*, p.url, p.sha, p.source,
       c.page_id % 2 = 0 AS even_page
FROM (SELECT *, (s * 22 + a) % (SELECT COUNT(*) FROM @pages) AS page_id FROM fl_scored) c
JOIN fx_pages p ON c.page_id = p.page_id"""
VIEWS["fl_cells"] = """
SELECT cell_no, subject, axis, n, score,
       CASE WHEN score IS NULL AND n % 4 <> 0 THEN 'does not exist for this release'
            WHEN score IS NULL THEN ' ' END AS na_reason,
       CASE WHEN n % 5 = 0 THEN '' ELSE 'searched, nothing found' END AS note,
       COALESCE(score > 0, FALSE) AND n % 10 <> 0 AS has_check,
       CASE WHEN score > 0 AND n % 10 <> 0 THEN method END AS check_method,
       CASE WHEN score > 0 AND n % 10 <> 0 THEN CASE WHEN n % 8 = 0 THEN '' ELSE 'the document says so' END END AS check_asserts,
       CASE WHEN score > 0 AND n % 10 <> 0 THEN CASE WHEN n % 16 = 1 THEN ' ' ELSE 'it was there' END END AS check_observed,
       CASE WHEN score > 0 AND n % 10 <> 0 AND n % 5 <> 0
            THEN LIST(CONCAT('literal-', CAST(a AS STRING)), CONCAT('kind-', CAST(s % 4 AS STRING))) END AS check_expect,
       CASE WHEN score > 0 AND n % 10 <> 0 THEN
            MAPOF(LIST('expect', 'expect_file', 'expect_evidence_sha256', 'expect_range_bytes', 'expect_shards',
                       'expect_repo', 'expect_commit', 'expect_paths', 'expect_subject_name', 'expect_queries', 'as_of'),
                  LIST(CASE WHEN n % 5 = 0 THEN '[]' ELSE 'given' END, CONCAT('model-', CAST(s % 3 AS STRING), '.safetensors'),
                       sha, CASE WHEN n % 3 = 0 THEN NULL ELSE '2048' END, '0',
                       CONCAT('org/', CAST(s % 7 AS STRING)), CASE WHEN n % 4 = 0 THEN '' ELSE 'abc' END, '[]', 'name', '7', CASE WHEN n % 21 = 1 THEN 'soon' ELSE '2024-02-01' END)) END AS check_fields,
       score = 0 AND n % 4 < 3 OR (score = 1 AND n % 14 = 0) AS has_bound,
       CASE WHEN score = 0 AND n % 4 < 3 OR (score = 1 AND n % 14 = 0) THEN method END AS bound_method,
       CASE WHEN score = 0 AND n % 4 < 3 OR (score = 1 AND n % 14 = 0) THEN CASE WHEN n % 8 = 0 THEN '' ELSE 'nothing is published' END END AS bound_asserts,
       CASE WHEN score = 0 AND n % 4 < 3 OR (score = 1 AND n % 14 = 0) THEN 'no match' END AS bound_observed,
       CASE WHEN score = 0 AND n % 4 < 3 OR (score = 1 AND n % 14 = 0) THEN CASE WHEN n % 8 = 4 THEN '' WHEN n % 15 = 0 THEN 'last week' ELSE '2024-02-01' END END AS bound_as_of,
       CASE WHEN (score = 0 AND n % 4 < 3 OR (score = 1 AND n % 14 = 0)) AND n % 5 <> 0
            THEN LIST(url, CASE WHEN n % 6 = 0 THEN 'https://elsewhere.example/x' ELSE url END) END AS bound_archived,
       CASE WHEN score = 0 AND n % 4 < 3 OR (score = 1 AND n % 14 = 0)
            THEN LIST(CASE WHEN n % 7 = 0 THEN url ELSE 'https://live.example/q' END) END AS bound_live,
       CASE WHEN score = 0 AND n % 4 < 3 OR (score = 1 AND n % 14 = 0) THEN n % 16 = 0 END AS bound_legacy,
       CASE WHEN score = 0 AND n % 4 < 3 OR (score = 1 AND n % 14 = 0) THEN
            MAPOF(LIST('expect', 'expect_repo', 'expect_matches', 'expect_evidence_sha256'),
                  LIST(CASE WHEN n % 5 = 0 THEN NULL ELSE 'given' END, 'org/x', '0', sha)) END AS bound_fields
FROM fl_paged"""
VIEWS["fl_evidence"] = """
SELECT cell_no, subject, axis, 0 AS pos, score, n, s, a,
       CASE WHEN n % 24 = 0 THEN REPLACE(REPLACE(url, 'https:', 'ftp:'), 'http:', 'ftp:')
            WHEN n % 9 = 4 THEN CONCAT(url, '/main/README.md')
            WHEN axis = 9 AND n % 4 = 1 THEN CONCAT(url, '?copy=', CAST(n AS STRING)) ELSE url END AS url,
       CASE WHEN n % 18 = 0 THEN '2024-02-31' WHEN n % 20 = 0 THEN '2999-01-01' WHEN n % 30 = 1 THEN 'yesterday'
            ELSE CONCAT('2024-01-', LPAD(CAST(a AS STRING), 2, '0')) END AS retrieved,
       CASE WHEN n % 25 = 0 THEN UPPER(sha) WHEN axis = 7 AND n % 3 = 1 THEN SHA256(CONCAT(url, sha)) ELSE sha END AS sha256,
       CASE WHEN n % 5 = 1 THEN TRUE WHEN n % 5 = 2 THEN FALSE END AS volatile,
       CASE WHEN n % 5 = 1 AND n % 2 = 0 THEN 'rendered per request' END AS volatile_reason,
       source
FROM fl_paged
WHERE (score > 0 OR (score = 0 AND n % 4 < 3)) AND n % 21 <> 0"""
VIEWS["fl_facts"] = """
SELECT CONCAT('fact:', CAST(page_id AS STRING)) AS label, url, CASE WHEN page_id % 6 = 5 THEN SHA256(url) ELSE sha END AS sha256
FROM fx_pages WHERE page_id % 5 < 2"""
VIEWS["fl_cited"] = """
SELECT CONCAT(CAST(subject AS STRING), '/axis', CAST(axis AS STRING)) AS label, url, sha256 FROM fl_evidence
UNION ALL SELECT label, url, sha256 FROM fl_facts"""

VIEWS["fr_cells"] = """
SELECT cell_no, subject, axis, n, score, na_reason, note, has_check, check_method, check_asserts, check_observed, check_expect,
       has_bound, bound_method, bound_asserts, bound_observed, bound_as_of, bound_archived, bound_live, bound_legacy,
       CASE WHEN has_check THEN map_concat(check_fields, MAPOF(LIST('expect_artifacts'), LIST(CASE WHEN n % 6 = 5 THEN '2' ELSE '1' END))) END AS check_fields,
       CASE WHEN has_bound THEN MAPOF(LIST('expect', 'expect_artifacts', 'expect_repo', 'expect_evidence_sha256'),
            LIST(CASE n % 4 WHEN 0 THEN '["kind-1"]' WHEN 1 THEN CONCAT('["kind-', CAST(subject % 4 AS STRING), '", "LITERAL-"]') WHEN 2 THEN '["no"]' ELSE '["no such literal"]' END,
                 CASE WHEN n % 11 = 3 THEN '2' ELSE '1' END, 'org/x', 'none')) END AS bound_fields
FROM fl_cells"""
VIEWS["fr_store"] = """
SELECT sha AS sha256, MIN(CONCAT(html, ' literal-', CAST(page_id % 23 AS STRING), ' kind-', CAST(page_id % 4 AS STRING))) AS body
FROM fx_pages WHERE page_id % 13 <> 5 GROUP BY sha"""

VIEWS["fl_subjects"] = """
SELECT subject, kind, repo FROM fx_subjects
UNION ALL SELECT subject, kind, repo FROM fx_subjects WHERE subject % 17 = 3"""
VIEWS["fl_records"] = """
SELECT subject, CONCAT('{"id": ', CAST(subject AS STRING), ', "kind": "', kind, '"',
       CASE WHEN subject % 5 = 0 THEN ', "colour": "red"' ELSE '' END,
       CASE WHEN subject % 15 = 0 THEN ', "weight": 3' ELSE ', "note": ""' END, '}') AS record
FROM fx_subjects"""

# --------------------------------------------------------------------- declared policy
VIEWS["fp_cited"] = """
SELECT DISTINCT s, a, n, url, sha, source, method FROM fl_paged WHERE score > 0 OR (score = 0 AND n % 4 < 3)"""
VIEWS["fp_sources"] = """
SELECT DISTINCT s AS subject, source FROM fp_cited WHERE s % 10 <> 9 AND (LENGTH(source) + s) % 6 <> 0"""
VIEWS["fp_keyed"] = """
SELECT s, a, n, url, sha, source, method,
       EXPLODE(LIST('axis_sources', 'axis_documents', 'axis_documents+', 'axis_method', 'axis_literals', 'axis_literals+',
                    'axis_file', 'axis_evidence_sha256')) AS entry
FROM fp_cited"""
VIEWS["fp_policy"] = """
SELECT s AS subject, a AS axis, REPLACE(entry, '+', '') AS key,
       CASE entry
         WHEN 'axis_sources' THEN CASE WHEN n % 15 = 0 THEN 'host:moved.example' ELSE source END
         WHEN 'axis_documents' THEN CASE WHEN n % 16 = 0 THEN CONCAT(url, '#v2') ELSE url END
         WHEN 'axis_documents+' THEN 'https://second.example/doc'
         WHEN 'axis_method' THEN CASE WHEN n % 20 = 0 THEN 'http_range' WHEN n % 20 = 5 THEN NULL ELSE method END
         WHEN 'axis_literals' THEN CASE WHEN n % 22 = 0 THEN 'other' ELSE CONCAT('literal-', CAST(a AS STRING)) END
         WHEN 'axis_literals+' THEN CONCAT('kind-', CAST(s % 4 AS STRING))
         WHEN 'axis_file' THEN CONCAT('model-', CAST(n % 3 AS STRING), '.safetensors')
         ELSE CASE WHEN n % 8 = 0 THEN SHA256(url) ELSE sha END END AS value
FROM fp_keyed
WHERE CASE entry
         WHEN 'axis_sources' THEN n % 14 <> 0
         WHEN 'axis_documents' THEN n % 20 <> 1
         WHEN 'axis_documents+' THEN n % 16 = 3
         WHEN 'axis_method' THEN n % 18 <> 0
         WHEN 'axis_literals' THEN n % 18 <> 2
         WHEN 'axis_literals+' THEN n % 18 <> 2
         WHEN 'axis_file' THEN a IN (12, 13)
         ELSE a IN (3, 6, 12, 13) END"""
VIEWS["fp_warrants"] = """
SELECT DISTINCT s AS subject, source, url AS document FROM fp_cited WHERE (LENGTH(source) + s) % 12 = 0"""
VIEWS["fp_superseded"] = """
SELECT subject, CASE WHEN subject % 3 = 0 THEN MIN(source) ELSE 'host:nowhere.example' END AS address,
       CAST(1 + subject % 5 AS INT) AS grp, 'host:replacement.example' AS superseded_by,
       LIST(CAST(1 AS INT), CAST(19 AS INT), CAST(8 AS INT)) AS still_valid_for
FROM fp_sources WHERE subject % 3 < 2 GROUP BY subject"""

# ------------------------------------------------------------------------- blob store
VIEWS["fb_blobs"] = """
SELECT sha256, MIN(doc_id) AS doc_id, MIN(body) AS body FROM (SELECT SHA256(text) AS sha256, doc_id, text AS body FROM @documents) d GROUP BY sha256"""

# ------------------------------------------------------------ addresses, bodies, objects
VIEWS["fu_urls"] = """
SELECT page_id, url AS page_url, sha,
  CASE page_id % 10
    WHEN 0 THEN CONCAT('https://huggingface.co/api/models/org', CAST(page_id % 3 AS STRING), '/m', CAST(page_id % 7 AS STRING), '/revision/', SUBSTRING(sha, 1, 40))
    WHEN 1 THEN CONCAT('https://huggingface.co/api/datasets/org/ds', CAST(page_id % 4 AS STRING), '/tree/', SUBSTRING(sha, 1, 40), CASE WHEN page_id % 4 = 1 THEN '/data/part' ELSE '' END)
    WHEN 2 THEN CONCAT('https://huggingface.co/org/m/resolve/', SUBSTRING(sha, 1, 40), '/model-', CAST(page_id AS STRING), '.safetensors')
    WHEN 3 THEN CONCAT('https://raw.githubusercontent.com/org/repo', CAST(page_id % 3 AS STRING), '/main/README.md')
    WHEN 4 THEN CONCAT('https://api.github.com/repos/org/repo', CAST(page_id % 3 AS STRING), '/git/trees/', SUBSTRING(sha, 1, 40), '?recursive=1')
    WHEN 5 THEN CONCAT('https://arxiv.org/abs/2401.', LPAD(CAST(page_id AS STRING), 5, '0'))
    WHEN 6 THEN CONCAT('https://huggingface.co/datasets/org/ds', CAST(page_id % 4 AS STRING), '/blob/latest/x')
    WHEN 7 THEN CONCAT('https://export.arxiv.org/api/query?search_query=abs%3A%22Model%20', CAST(page_id % 5 AS STRING), '%22%20AND%20abs%3A%22',
                       CASE WHEN page_id % 3 = 0 THEN 'from%20scratch' ELSE 'reproduce' END, '%22%20AND%20%28cat%3Acs.CL%29&start=0&max_results=100')
    WHEN 8 THEN CONCAT(url, '/HEAD/file') ELSE url END AS url
FROM fx_pages"""
VIEWS["fu_bodies"] = """
SELECT page_id, sha,
  CASE WHEN page_id % 11 = 0 THEN CONCAT('  version https://git-lfs.github.com/spec/v1', chr(10), 'oid sha256:', sha, chr(10), 'size ', CAST(LENGTH(html) AS STRING), chr(10))
       WHEN page_id % 13 = 0 THEN CONCAT('tiny ', CAST(page_id AS STRING))
       WHEN page_id % 7 = 0 THEN CONCAT('Checking your BROWSER ', html)
       WHEN page_id % 5 = 0 THEN CONCAT(html, ' Please LOG IN to continue')
       WHEN page_id % 9 = 0 THEN CONCAT(html, ' API rate limit exceeded')
       WHEN page_id % 3 = 0 THEN CONCAT('rate limit reached ', html) ELSE html END AS body,
  CASE WHEN page_id % 17 = 0 THEN '404' WHEN page_id % 6 = 0 THEN '403' WHEN page_id % 19 = 0 THEN '429' WHEN page_id % 23 = 0 THEN '503' ELSE '200' END AS status
FROM fx_pages"""
VIEWS["fu_dates"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '1997-02-30' WHEN o_orderkey % 11 = 0 THEN '97-1-1' WHEN o_orderkey % 13 = 0 THEN ''
       ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS text FROM @orders"""
VIEWS["fu_heads"] = """
SELECT doc_id, CASE WHEN doc_id % 6 < 3 THEN 'model.safetensors' ELSE 'model.bin' END AS name,
  CASE doc_id % 6 WHEN 0 THEN unhex('2000000000000000') || TOBIN('{"') || TOBIN(text)
                  WHEN 1 THEN unhex('FFFFFFFFFFFFFFFF') || TOBIN('{"') || TOBIN(text)
                  WHEN 2 THEN CASE WHEN doc_id % 4 = 0 THEN unhex('2000') ELSE TOBIN(text) END
                  WHEN 3 THEN unhex('504B0304') || TOBIN(text)
                  WHEN 4 THEN TOBIN(CONCAT('version https://git-lfs.github.com/spec/v1', chr(10), text))
                  ELSE TOBIN(text) END AS body
FROM @documents"""
VIEWS["fu_commits"] = """
SELECT doc_id, CONCAT('tree ', SUBSTRING(SHA256(text), 1, 40), chr(10), 'author A <a@example.org> 1700000000 +0000', chr(10),
       'committer Committer <user', CAST(doc_id % 9 AS STRING), '@example.org> 1700000000 +0000', chr(10),
       CASE WHEN doc_id % 3 = 0 THEN CONCAT('gpgsig -----BEGIN PGP SIGNATURE-----', chr(10), ' abc', chr(10)) ELSE '' END, chr(10),
       'Update ', CAST(doc_id % 5 AS STRING), chr(10), chr(10), text) AS body
FROM @documents"""
VIEWS["fs_feeds"] = """
SELECT doc_id, CONCAT('<feed><opensearch:totalResults xmlns="u">', CAST(n_chars AS STRING), '</opensearch:totalResults><entry>',
       CASE WHEN doc_id % 4 = 0 THEN '' ELSE CONCAT('<id> http://arxiv.org/abs/24', CAST(doc_id AS STRING), '.1v1 </id>') END,
       '<title>Paper ', chr(10), '  ', CAST(doc_id AS STRING), '</title><summary>', text, '</summary><arxiv:primary_category x="y" term="cs.', UPPER(lang), '"/></entry><entry><id>http://arxiv.org/abs/25',
       CAST(doc_id AS STRING), '.2</id><title>Second</title><arxiv:primary_category term="stat.', source, '"/></entry></feed>') AS body
FROM @documents"""
VIEWS["fs_lists"] = """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'yaml_dash_list' WHEN 1 THEN 'hf_tree_json' ELSE 'unknown' END AS kind,
       CASE WHEN page_id % 6 = 4 THEN '' ELSE 'https://host/base/' END AS base,
       CASE page_id % 3 WHEN 0 THEN CONCAT('paths:', chr(10), '    - ', url, chr(10), '  - no', chr(10), '    - second/', CAST(page_id AS STRING), chr(10))
         ELSE CONCAT('[{"type": "file", "path": "a/', CAST(page_id AS STRING), '"}, {"type": "directory", "path": "d"}, {"type": "file", "path": "b"}]') END AS body
FROM fx_pages"""
VIEWS["fs_revisions"] = """
SELECT p_partkey, CONCAT('org/m', CAST(p_partkey AS STRING)) AS repo, SUBSTRING(SHA256(p_name), 1, 40) AS revision,
       CASE WHEN p_partkey % 17 = 0 THEN '<html>busy</html>' ELSE
       CONCAT('{"sha": "', CASE WHEN p_partkey % 5 = 0 THEN 'f00' ELSE SUBSTRING(SHA256(p_name), 1, 40) END, '", "id": "org/m',
              CAST(CASE WHEN p_partkey % 7 = 0 THEN p_partkey + 1 ELSE p_partkey END AS STRING),
              '", "siblings": [{"rfilename": "model-', CAST(p_size AS STRING), '.safetensors"}, {"rfilename": "model.safetensors.index.json"}, {"rfilename": "index-a.bin"}, {"rfilename": "sub/x.bin"}, {"rfilename": "a.bin"}]}') END AS body
FROM @part"""
VIEWS["fs_facts"] = """
SELECT page_id, CONCAT('{"facts": {"fact-', CAST(page_id AS STRING), '": {"value": ', CAST(LENGTH(html) AS STRING),
       ', "unit": "chars", "method": {"name": "byte_length"}, "evidence": {"url": "', url, '", "sha256": "', sha, '"}}}}') AS body FROM fx_pages"""
VIEWS["fs_cites"] = """
SELECT o.o_orderkey AS cell, CASE WHEN o.o_orderkey % 9 = 0 THEN SHA256(CONCAT(d.text, 'x')) ELSE SHA256(d.text) END AS sha256
FROM (SELECT o_orderkey, o_custkey % (SELECT COUNT(*) FROM @documents) AS doc_id FROM @orders) o JOIN @documents d ON d.doc_id = o.doc_id"""
VIEWS["fs_observed"] = """
SELECT url, CASE WHEN page_id % 7 = 0 THEN SHA256(url) ELSE sha END AS observed_sha256,
       LENGTH(html) * (CASE WHEN page_id % 10 = 0 THEN 100000 ELSE 1 END) AS n_bytes, page_id % 4 <> 0 AS has_body
FROM fx_pages WHERE page_id % 11 <> 0"""
VIEWS["fs_wanted"] = """
SELECT url, sha AS sha256, page_id % 2 = 0 AS volatile, CASE WHEN page_id % 12 = 5 THEN 'bytes=0-9' END AS range FROM fx_pages"""
VIEWS["fs_stored"] = """
SELECT sha AS sha256 FROM fx_pages WHERE page_id % 3 = 0"""

# ---------------------------------------------------------------- checks over archived bytes
VIEWS["fc_docs"] = """
SELECT a.doc_id, a.text, SHA256(a.text) AS sha, b.text AS ntext, SHA256(b.text) AS nsha
FROM @documents a LEFT JOIN @documents b ON b.doc_id = a.doc_id + 1"""
VIEWS["fc_items"] = """
SELECT d.doc_id, b.text AS item FROM (SELECT doc_id, doc_id % (SELECT COUNT(*) FROM @benchmark) AS item_id FROM @documents) d
JOIN @benchmark b ON b.item_id = d.item_id"""
VIEWS["fc_checks"] = """
SELECT d.doc_id AS cell,
  CASE d.doc_id % 6 WHEN 0 THEN LIST(SUBSTRING(d.text, 3, 10), SUBSTRING(d.text, 20, 8)) WHEN 1 THEN LIST('license', 'the')
    WHEN 2 THEN LIST(i.item) WHEN 3 THEN LIST(SUBSTRING(d.text, 3, 10), SUBSTRING(COALESCE(d.ntext, 'nothing follows'), 3, 10))
    WHEN 4 THEN LIST('tion', 'here') END AS literals,
  CASE WHEN d.doc_id % 14 = 0 THEN 5 WHEN d.doc_id % 15 = 1 THEN NULL WHEN d.doc_id % 3 = 0 AND d.nsha IS NOT NULL THEN 2 ELSE 1 END AS expect_artifacts,
  CASE WHEN d.doc_id % 4 < 3 THEN CAST(d.doc_id % 4 AS BIGINT) END AS expect_count
FROM fc_docs d JOIN fc_items i ON i.doc_id = d.doc_id"""
VIEWS["fc_cites"] = """
SELECT doc_id AS cell, CASE WHEN doc_id % 10 = 0 THEN SHA256(CONCAT(text, 'x')) ELSE sha END AS sha256 FROM fc_docs
UNION ALL SELECT doc_id, nsha FROM fc_docs WHERE doc_id % 3 = 0 AND nsha IS NOT NULL"""
VIEWS["fc_ranged"] = """
SELECT d.doc_id AS cell, CASE WHEN d.doc_id % 7 = 0 THEN 'https://other/'
    WHEN p.page_id % 3 = 0 THEN CASE WHEN p.page_id % 2 = 0 THEN p.url ELSE CONCAT('second/', CAST(p.page_id AS STRING)) END
    ELSE CASE WHEN p.page_id % 2 = 0 THEN CONCAT('https://host/base/a/', CAST(p.page_id AS STRING)) ELSE 'https://host/base/b' END END AS url,
  CONCAT('bytes=0-', CAST(OCTETS(d.text) - (CASE WHEN d.doc_id % 9 = 0 THEN 2 ELSE 1 END) AS STRING)) AS range,
  CASE WHEN d.doc_id % 13 = 0 THEN SHA256(CONCAT(d.text, 'x')) ELSE SHA256(d.text) END AS sha256,
  CASE WHEN d.doc_id % 10 = 9 THEN NULL WHEN d.doc_id % 11 = 0 THEN CAST(1 - p.page_id % 2 AS INT) ELSE CAST(p.page_id % 2 AS INT) END AS index
FROM (SELECT doc_id, text, doc_id % (SELECT COUNT(*) FROM @pages) AS page_id FROM @documents) d JOIN fx_pages p ON p.page_id = d.page_id"""
VIEWS["fc_ranges"] = """
SELECT * FROM fc_ranged UNION ALL SELECT * FROM fc_ranged WHERE cell % 17 = 1"""
VIEWS["fc_listings"] = """
SELECT d.doc_id AS cell, l.page_id, l.kind, l.body, l.base
FROM (SELECT doc_id, doc_id % (SELECT COUNT(*) FROM @pages) AS page_id FROM @documents) d JOIN fs_lists l ON l.page_id = d.page_id WHERE l.page_id % 6 <> 2"""
VIEWS["fc_entries"] = """
SELECT cell, path, CASE WHEN line = 1 AND cell % 8 <> 5 THEN NULL WHEN line = 2 AND cell % 5 = 0 AND qty > 48 THEN 'ABC'
       WHEN cell % 6 = 1 AND qty = 1 AND line > 1 THEN NULL ELSE SHA256(path) END AS oid
FROM (SELECT l_suppkey AS cell, l_linenumber AS line, l_quantity AS qty,
             CONCAT('d/', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), CASE WHEN l_linenumber = 1 THEN '.md' ELSE '.bin' END) AS path FROM @lineitem) x"""
VIEWS["fc_claims"] = """
SELECT cell, COUNT(*) + (CASE WHEN cell % 7 = 0 THEN 1 ELSE 0 END) AS expect_files,
       CASE WHEN cell % 9 = 4 THEN NULL WHEN cell % 9 = 5 THEN 'bin|md' WHEN cell % 9 = 6 THEN '-[2-6][.]bin$' ELSE '[.]bin$' END AS content_pattern,
       CASE WHEN cell % 4 = 0 THEN SUM(CASE WHEN LENGTH(oid) = 64 THEN 1 ELSE 0 END) + (CASE WHEN cell % 12 = 0 THEN 1 ELSE 0 END) END AS bound_items
FROM fc_entries GROUP BY cell"""
VIEWS["fc_declared"] = """
SELECT DISTINCT cell, path FROM fc_entries WHERE path LIKE '%.md' AND cell % 3 <> 2
UNION ALL SELECT s_suppkey, 'ghost.txt' FROM @supplier WHERE s_suppkey % 10 = 6"""
VIEWS["fc_weights"] = """
SELECT *, CASE WHEN cell % 23 = 0 THEN SHA256(url) ELSE SHA256(content) END AS sha256, SHA256(content) AS expect_evidence_sha256,
  CASE WHEN cell % 29 = 0 THEN NULL ELSE content END AS body
FROM (SELECT p_partkey AS cell, repo AS subject_repo, CAST(CASE WHEN p_partkey % 31 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_ranged,
  CONCAT('https://huggingface.co/', CASE WHEN p_partkey % 19 = 0 THEN 'org/else' ELSE repo END, '/resolve/', revision, '/', CASE WHEN p_partkey % 3 = 0 THEN 'a.bin' ELSE CONCAT('model-', CAST(p_size AS STRING), '.safetensors') END) AS url,
  CASE WHEN p_partkey % 37 = 0 THEN 'bytes=1-9' ELSE CONCAT('bytes=0-', CAST(LENGTH(p_name) + 9 AS STRING)) END AS range,
  CASE WHEN p_partkey % 41 = 0 THEN 'f00' WHEN p_partkey % 2 = 0 THEN revision END AS pinned_commit,
  CASE WHEN p_partkey % 3 = 0 THEN unhex('504B030400000000') ELSE CASE WHEN p_partkey % 11 = 0 THEN unhex('0000000000000000') ELSE unhex('2000000000000000') END END || TOBIN('{"') || TOBIN(p_name) AS content,
  CONCAT('https://huggingface.co/api/models/', repo, '/revision/', revision) AS listing_url, body AS listing_body,
  CASE WHEN p_partkey % 43 = 0 THEN 'other.bin' WHEN p_partkey % 3 = 0 THEN 'a.bin' ELSE CONCAT('model-', CAST(p_size AS STRING), '.safetensors') END AS expect_file,
  CAST(LENGTH(p_name) + 10 AS BIGINT) AS expect_range_bytes
FROM (SELECT p.p_partkey, p.p_name, p.p_size, r.repo, r.revision, r.body FROM @part p JOIN fs_revisions r ON r.p_partkey = p.p_partkey) y) x"""
VIEWS["fc_shards"] = """
SELECT DISTINCT l_orderkey AS cell, CONCAT('s', CAST(l_linenumber AS STRING), '.bin') AS file FROM @lineitem"""
VIEWS["fc_pointers"] = """
SELECT cell, file, lfs_oid, CASE WHEN k % 89 = 0 THEN SHA256(file) ELSE SHA256(content) END AS sha256, CASE WHEN k % 83 = 0 THEN NULL ELSE content END AS body
FROM (SELECT l_orderkey AS cell, l_partkey AS k, CASE WHEN l_partkey % 79 = 0 THEN 'x.bin' ELSE CONCAT('s', CAST(l_linenumber AS STRING), '.bin') END AS file,
             SHA256(CONCAT(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))) AS lfs_oid,
             CASE WHEN l_partkey % 61 = 0 THEN 'version 1' ELSE CONCAT('version https://git-lfs.github.com/spec/v1', chr(10), 'oid sha256:',
               SHA256(CONCAT(CAST(l_orderkey AS STRING), CASE WHEN l_partkey % 97 = 0 THEN '+' ELSE '-' END, CAST(l_linenumber AS STRING))), chr(10)) END AS content
      FROM @lineitem WHERE NOT (l_linenumber = 7 AND l_orderkey % 5 = 0)) x"""
VIEWS["fc_shard_claims"] = """
SELECT cell, COUNT(*) + (CASE WHEN cell % 13 = 0 THEN 1 ELSE 0 END) AS expect_shards FROM fc_shards GROUP BY cell"""
VIEWS["fc_signed"] = """
SELECT doc_id AS subject, CASE WHEN doc_id % 41 = 1 THEN NULL ELSE body END AS body,
  CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 21 = 0 THEN CONCAT('U', CAST(doc_id AS STRING)) ELSE CONCAT('F', CAST(doc_id % 4 AS STRING)) END END AS fingerprint,
  doc_id % 27 <> 0 AS intact,
  CASE WHEN doc_id % 11 = 0 THEN 'f00' WHEN doc_id % 37 = 0 THEN NULL ELSE sha1(TOBIN(CONCAT('commit ', CAST(OCTETS(body) AS STRING))) || unhex('00') || TOBIN(body)) END AS expect_revision,
  CASE WHEN doc_id % 7 = 1 THEN 'someone@example.org' ELSE CONCAT('user', CAST(doc_id % 9 AS STRING), '@example.org') END AS expect_committer,
  CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN doc_id % 3 <> 0 ELSE doc_id % 3 = 0 END AS expect_signed,
  CASE WHEN doc_id % 3 <> 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'OTHER' WHEN doc_id % 21 = 0 THEN CONCAT('U', CAST(doc_id AS STRING)) ELSE CONCAT('F', CAST(doc_id % 4 AS STRING)) END AS expect_fingerprint,
  CASE WHEN doc_id % 31 = 0 THEN 'Other' ELSE CONCAT('Update ', CAST(doc_id % 5 AS STRING)) END AS expect_subject_line,
  CASE WHEN doc_id % 19 = 0 THEN NULL ELSE doc_id % 5 <> 0 END AS expect_shared
FROM fu_commits"""
VIEWS["fc_tree"] = """
SELECT l_suppkey AS cell, CONCAT('f', CAST(l_linenumber AS STRING), '/', CAST(l_partkey % 9 AS STRING), '.py') AS path,
       CASE WHEN l_returnflag = 'R' THEN 'tree' ELSE 'blob' END AS type,
       CAST(CASE WHEN l_linenumber = 7 THEN l_quantity ELSE l_quantity * 40 END AS BIGINT) AS size FROM @lineitem"""
VIEWS["fc_tree_claims"] = """
SELECT s_suppkey AS cell, s_suppkey % 9 = 0 AS truncated,
       CASE WHEN s_suppkey % 8 = 3 THEN NULL WHEN s_suppkey % 8 = 4 THEN 'nope.txt' ELSE 'f3/0.py' END AS manifest FROM @supplier"""
VIEWS["fc_required"] = """
SELECT s_suppkey AS cell, EXPLODE(LIST('f1/1.py', 'f2/2.py', CASE WHEN s_suppkey % 6 = 1 THEN 'f9/1.py' WHEN s_suppkey % 5 = 2 THEN 'f7/3.py' ELSE 'f4/4.py' END)) AS path FROM @supplier"""
VIEWS["fc_published"] = """
SELECT p_brand AS cell, CONCAT(REPLACE(p_name, ' ', '_'), '.', LOWER(p_type)) AS path, CASE WHEN p_partkey % 211 = 5 THEN 'directory' ELSE 'file' END AS type FROM @part"""
VIEWS["fc_published_claims"] = """
SELECT cell, COUNT(DISTINCT CASE WHEN type = 'file' AND (path LIKE '%.promo' OR path LIKE 'red_%') THEN path END)
       + (CASE WHEN cell IN ('Brand#3', 'Brand#7') THEN 1 ELSE 0 END) AS expect_matches FROM fc_published GROUP BY cell"""
VIEWS["fn_counted"] = """
SELECT d.doc_id, d.source AS subject, d.lang AS term, 2 * c.n AS total
FROM @documents d JOIN (SELECT source, lang, COUNT(*) AS n FROM @documents GROUP BY source, lang) c ON c.source = d.source AND c.lang = d.lang"""
VIEWS["fn_pages"] = """
SELECT doc_id, subject, term, total,
  CONCAT('https://export.arxiv.org/api/query?search_query=abs%3A%22', subject, '%22%20AND%20abs%3A%22', term, '%22&start=', CAST(doc_id AS STRING)) AS url,
  CASE WHEN subject = 'src11' AND term = 'fr' THEN NULL ELSE
  CONCAT('<feed>', CASE WHEN subject = 'src13' THEN '' ELSE CONCAT('<opensearch:totalResults>', CAST(total + (CASE WHEN subject IN ('src3', 'src8') AND term <> 'en' THEN 1 ELSE 0 END) AS STRING), '</opensearch:totalResults>') END,
         '<entry><id>http://arxiv.org/abs/24', CAST(doc_id AS STRING), '.1</id></entry><entry ><id>http://arxiv.org/abs/25', CAST(doc_id AS STRING), '.2</id></entry></feed>') END AS body
FROM fn_counted"""
VIEWS["fn_responses"] = """
SELECT doc_id, subject, term, total, url, SHA256(url) AS sha256, body FROM fn_pages"""
VIEWS["fn_claims"] = """
SELECT subject, CASE WHEN subject = 'src5' THEN 'somebody' ELSE subject END AS name, COUNT(DISTINCT term) + (CASE WHEN subject = 'src7' THEN 1 ELSE 0 END) AS expect_queries,
       CASE WHEN subject = 'src9' THEN 1 WHEN subject = 'src10' THEN NULL ELSE 0 END AS positives, CASE WHEN subject = 'src6' THEN 1 ELSE 0 END AS score
FROM fn_responses GROUP BY subject"""
VIEWS["fn_totals"] = """
SELECT DISTINCT subject, term, total + (CASE WHEN subject IN ('src2', 'src3') AND term <> 'en' THEN 1 ELSE 0 END) AS total FROM fn_responses"""
VIEWS["fn_digests"] = """
SELECT subject, sha256 FROM fn_responses WHERE NOT (subject = 'src1' AND doc_id % 3 = 0)"""
VIEWS["fn_verdicts"] = """
SELECT subject, subject = 'src4' AS hit, subject <> 'src12' AS has_axis17, CASE WHEN subject = 'src14' THEN 1 ELSE 0 END AS axis17 FROM fn_claims WHERE subject <> 'src15'"""
VIEWS["fc_manifest"] = """
SELECT url, CASE WHEN page_id % 6 = 1 THEN SHA256(url) ELSE sha END AS manifest_sha256, page_id % 4 <> 3 AS stored FROM fx_pages WHERE page_id % 9 <> 0"""
VIEWS["fc_archive"] = """
SELECT sha AS sha256, CASE WHEN page_id % 8 = 0 THEN CONCAT(html, ' ') ELSE html END AS body FROM fx_pages WHERE page_id % 10 <> 2"""
VIEWS["fc_facts"] = """
SELECT CONCAT('doc-', CAST(doc_id AS STRING)) AS name,
  CASE doc_id % 6 WHEN 0 THEN 'byte_length' WHEN 1 THEN 'count_lines_matching' WHEN 2 THEN 'token_ids_below' WHEN 3 THEN 'count_json_entries' WHEN 4 THEN 'byte_length' ELSE 'http_206' END AS method,
  CASE WHEN doc_id % 6 = 2 THEN CAST(FLOOR(OCTETS(text) / (CASE WHEN doc_id % 4 = 2 THEN 2.0 ELSE 4.0 END)) AS BIGINT) WHEN doc_id % 6 = 1 THEN 1 ELSE CAST(OCTETS(text) AS BIGINT) + (CASE WHEN doc_id % 6 = 4 THEN doc_id % 2 ELSE 0 END) - doc_id % 2 END AS value,
  CASE WHEN doc_id % 7 = 0 THEN SHA256(CONCAT(text, 'x')) ELSE SHA256(text) END AS sha256,
  '[A-Z][a-z]+' AS pattern, CASE WHEN doc_id % 4 = 1 THEN 'e' END AS also_all_contain, 'k' AS field, '1' AS match,
  CASE WHEN doc_id % 4 = 2 THEN 'uint16' ELSE 'uint32' END AS width, CAST(CASE WHEN doc_id % 4 = 2 THEN 32768 ELSE 2100000000 END AS BIGINT) AS below
FROM @documents"""

# ----------------------------------------------------------------------- search and screens
VIEWS["fn_corpus"] = """
SELECT doc_id AS id, text, lang AS category, SPLIT_PART(text, chr(10), 1) AS title FROM @documents"""
VIEWS["fn_queries"] = """
SELECT subject, term, total, total - (CASE WHEN subject IN ('src2', 'src9') THEN 2 ELSE 0 END) AS retrieved,
       CASE WHEN subject = 'src4' THEN FALSE WHEN subject = 'src8' THEN NULL ELSE TRUE END AS complete
FROM fn_counted GROUP BY subject, term, total"""
VIEWS["fn_adjudged"] = """
SELECT s_suppkey AS subject, s_suppkey % 5 = 0 AS hit, CASE WHEN s_suppkey % 10 = 0 THEN ' ' ELSE 'https://arxiv.org/abs/1' END AS url,
       CASE WHEN s_suppkey % 15 = 0 THEN NULL ELSE 'we reproduce it' END AS quote,
       CASE s_suppkey % 4 WHEN 0 THEN 'axis 17 only' WHEN 1 THEN 'axis 16 and axis 17' WHEN 2 THEN 'axis 3' ELSE 'the model' END AS affects,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'read in full' END AS rationale
FROM @supplier WHERE s_suppkey % 7 <> 0"""
VIEWS["fn_known"] = """
SELECT item_id AS case, CONCAT('24.', CAST(item_id * 7 AS STRING)) AS record, CASE item_id % 4 WHEN 0 THEN 'mit' WHEN 1 THEN 'apache' WHEN 2 THEN 'ccbync' ELSE 'gnu' END AS subject,
       CASE WHEN item_id % 5 = 4 THEN 'off_corpus' ELSE 'in_pool' END AS expect FROM @benchmark"""

# -------------------------------------------------------------------- snapshots and history
VIEWS["fr_last"] = """
SELECT user_id, ts >= TIMESTAMP '2024-01-16 00:00:00' AS late, max_by(event_type, ts) AS et, max_by(event_id, ts) AS eid,
       max_by(regexp_extract(props, '([0-9]+)', 1), ts) AS k FROM @events GROUP BY user_id, ts >= TIMESTAMP '2024-01-16 00:00:00'"""
VIEWS["fr_pair"] = """
SELECT a.user_id, b.et AS new_type,
  CONCAT('{"event_type": "', a.et, '", "k": ', a.k, ', "downloads": ', CAST(a.eid AS STRING), '}') AS old_body,
  CONCAT('{"downloads": ', CAST(a.eid AS STRING), ',"k":', a.k, ',"event_type":"', a.et, '"}') AS same_body,
  CONCAT('{"event_type": "', a.et, '", "k": ', a.k, ', "downloads": ', CAST(b.eid AS STRING), ', "likes": 3}') AS meta_body,
  CONCAT('{"event_type": "', b.et, '", "k": ', b.k, ', "downloads": ', CAST(b.eid AS STRING), '}') AS new_body
FROM fr_last a JOIN fr_last b ON a.user_id = b.user_id WHERE NOT a.late AND b.late"""
VIEWS["fr_snap"] = """
SELECT user_id, new_type, CASE user_id % 10 WHEN 3 THEN '[1, 2]' ELSE old_body END AS old_body,
  CASE user_id % 10 WHEN 0 THEN same_body WHEN 1 THEN old_body WHEN 2 THEN 'not json' WHEN 3 THEN CASE WHEN user_id % 20 = 3 THEN '[1,2]' ELSE '[1, 3]' END WHEN 4 THEN meta_body ELSE new_body END AS new_body
FROM fr_pair"""
VIEWS["fr_cited"] = """
SELECT CONCAT('s', CAST(user_id AS STRING), '/axis1') AS label, CONCAT('https://h/', CAST(user_id AS STRING)) AS url, SHA256(old_body) AS sha256, user_id % 6 = 5 AS volatile FROM fr_snap
UNION ALL SELECT CONCAT('s', CAST(user_id AS STRING), '/axis2'), CONCAT('https://h/', CAST(user_id AS STRING)), SHA256(old_body), FALSE FROM fr_snap WHERE user_id % 3 = 0"""
VIEWS["fr_blobs"] = """
SELECT SHA256(old_body) AS sha256, MIN(old_body) AS body FROM fr_snap WHERE user_id % 11 <> 0 GROUP BY SHA256(old_body)"""
VIEWS["fr_seen"] = """
SELECT CONCAT('https://h/', CAST(user_id AS STRING)) AS url, CASE WHEN new_type = 'error' THEN 'limited' WHEN user_id % 13 = 0 THEN 'gone' ELSE 'ok' END AS status,
       SHA256(new_body) AS sha256, new_body AS body FROM fr_snap WHERE user_id % 17 <> 0"""
VIEWS["fr_cites"] = """
SELECT CONCAT('c', CAST(page_id AS STRING)) AS label, CONCAT(page_url, CASE WHEN page_id % 3 = 0 THEN '/main/x' ELSE '' END) AS url, sha AS sha256 FROM fu_urls"""
VIEWS["fr_pins"] = """
SELECT url, REPLACE(url, '/main/', CONCAT('/', SUBSTRING(MIN(sha256), 1, 40), '/')) AS pinned, MIN(sha256) AS pinned_sha256 FROM fr_cites WHERE url LIKE '%/main/%' GROUP BY url"""
VIEWS["fr_shared_cites"] = """
SELECT CONCAT('c', CAST(page_id AS STRING)) AS label, url, sha AS sha256 FROM fu_urls"""
VIEWS["fr_shared_pins"] = """
SELECT url, CONCAT('pinned:', url) AS pinned, MIN(sha256) AS pinned_sha256 FROM fr_shared_cites WHERE url NOT LIKE '%/latest/%' GROUP BY url"""
VIEWS["fr_claims"] = """
SELECT p_partkey AS id, CASE WHEN p_size = 7 THEN 1 ELSE (SELECT COUNT(*) FROM @part) - p_partkey END AS claimed FROM @part
UNION ALL SELECT p_partkey + 100000000, CASE WHEN p_size = 3 THEN p_partkey END FROM @part WHERE p_size < 5"""
VIEWS["fr_days"] = """
SELECT CAST(EXTRACT(DAY FROM ts) AS INT) AS run, COUNT(*) AS n FROM @events GROUP BY CAST(EXTRACT(DAY FROM ts) AS INT)"""
VIEWS["fr_runs"] = """
SELECT run, CAST(FLOOR((run - 1) / 7.0) AS INT) AS round, CASE WHEN run % 10 = 5 THEN 3 ELSE 1000 + CAST(FLOOR(run / 3.0) AS BIGINT) * 10 - CASE WHEN run IN (20, 21) THEN 50 ELSE 0 END END AS controls_total,
       CAST(FLOOR(run / 3.0) AS BIGINT) AS watched, CASE WHEN n > 0 THEN 0 ELSE 1 END AS never_executes, CONCAT('s', CAST(CAST(FLOOR(run / 6.0) AS BIGINT) AS STRING)) AS source_fingerprint, 'i0' AS inputs_fingerprint
FROM fr_days"""
VIEWS["fr_stored_runs"] = """
SELECT run, round, controls_total + (CASE WHEN run = 4 THEN 1 ELSE 0 END) AS controls_total, watched, never_executes, source_fingerprint, inputs_fingerprint FROM fr_runs
UNION ALL SELECT MAX(run) + 1, 9, 1, 1, 1, 's', 'i' FROM fr_runs"""
VIEWS["fr_named"] = """
SELECT run, round, controls_total, watched, never_executes + 1 AS never_executes FROM fr_runs WHERE run = 12
UNION ALL SELECT run, round, controls_total, watched, never_executes FROM fr_runs WHERE run = 13"""
VIEWS["fr_rows"] = """
SELECT CAST(EXTRACT(DAY FROM ts) AS INT) AS line, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS source, event_type AS class FROM @events"""
VIEWS["fr_rows_again"] = """
SELECT CAST(EXTRACT(DAY FROM ts) AS INT) AS line, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS source, CASE WHEN event_id % 97 = 0 THEN 'other' ELSE event_type END AS class FROM @events"""

def _needs(name: str, views: dict[str, str] = VIEWS) -> list[str]:
    """A view and everything it reads, in definition order."""
    found: set[str] = set()
    todo = [name]
    while todo:
        current = todo.pop()
        if current in found:
            continue
        found.add(current)
        todo += [v for v in re.findall(r"\bf[a-z]_\w+", views[current]) if v in views]
    return [v for v in views if v in found]


def _with(names: list[str], tail: str, views: dict[str, str] = VIEWS) -> str:
    wanted = {v for n in names for v in _needs(n, views)}
    ctes = [f"{v} AS ({views[v]})" for v in views if v in wanted]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + tail


def given(spark: SparkSession, sf_dir: str, table: str) -> str:
    """Name of the session view over a given table, so its footer is read once per session."""
    name = f"given_{hashlib.md5(sf_dir.encode()).hexdigest()[:10]}_{table}"
    if not spark.catalog.tableExists(name):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(name)
    return name


def _spark_digests(sql: str) -> str:
    """``SHA256(x)`` as Spark's ``sha2(x, 256)``, innermost last."""
    while (start := sql.find("SHA256(")) >= 0:
        depth, end = 1, start + 7
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:start]}sha2({sql[start + 7:end - 1]}, 256){sql[end:]}"
    return sql


def frame(spark: SparkSession, sf_dir: str, name: str, staged: dict[str, str] | None = None) -> DataFrame:
    """A view, or a given table; views that are ``staged`` are read from the session view named."""
    views = VIEWS | {v: f"SELECT * FROM {at}" for v, at in (staged or {}).items()}
    sql = _with(_needs(name, views)[:-1], views[name], views) if name in views else f"SELECT * FROM @{name}"
    sql = _spark_digests(sql).replace("LIST(", "array(").replace("MAPOF(", "map_from_arrays(")
    sql = re.sub(r"\bLENGTH\((\w+)\) \*", r"bigint(LENGTH(\1)) *", sql)  # 64 bits in DuckDB, 32 in Spark: products overflow
    sql = sql.replace("EXPLODE(", "explode(").replace("TOBIN(", "binary(").replace("OCTETS(", "octet_length(")
    return spark.sql(re.sub(TABLE, lambda m: given(spark, sf_dir, m.group(1)), sql))


def oracle(sql: str) -> str:
    """DuckDB text of an oracle query: the views it mentions plus its own SELECT."""
    names = [v for v in dict.fromkeys(re.findall(r"\bf[a-z]_\w+", sql)) if v in VIEWS]
    head = sql.lstrip()
    if names:
        ctes = _with(names, "").rstrip()
        head = f"{ctes}, {head[4:].lstrip()}" if head[:5].upper() == "WITH " else f"{ctes} {head}"
    head = re.sub(r"\bSHA256\(", "sha256(", head).replace("LIST(", "list_value(").replace("MAPOF(", "map(").replace("EXPLODE(", "unnest(").replace("TOBIN(", "encode(").replace("OCTETS(", "strlen(")
    return re.sub(TABLE, r"\1", head)
