"""Content check and named fact queries over the stand-in blob store."""

from pyspark.sql import functions as F

from veriledger.operators import content_checks as checks
from veriledger.operators import facts
from veriledger.plans.catalog import query
from veriledger.plans.fixtures import frame

# words of a text read as little-endian integers: long (id, word) rows
WORDS = """
hx AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents),
w2 AS (SELECT doc_id, CAST('0x' || substr(c, 3, 2) || substr(c, 1, 2) AS BIGINT) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(h, '.{4}')) AS c FROM hx)),
w4 AS (SELECT doc_id, CAST('0x' || substr(c, 7, 2) || substr(c, 5, 2) || substr(c, 3, 2) || substr(c, 1, 2) AS BIGINT) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(h, '.{8}')) AS c FROM hx))"""


def _own(rows, body="body", digest=None):
    """Bodies under the digest they have, or the one given."""
    return rows.select((F.sha2(body, 256) if digest is None else F.col(digest)).alias("sha256"), F.col(body).cast("binary").alias("body")).where(F.col(body).isNotNull())


def _store(*parts):
    out = parts[0].select("sha256", F.col("body").cast("binary").alias("body"))
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("c1_grep_all_in_one", """
WITH ct AS (SELECT c.cell, c.sha256, b.body FROM fc_cites c LEFT JOIN fb_blobs b ON b.sha256 = c.sha256),
n AS (SELECT cell, count(*) AS n, count(body) AS m FROM ct GROUP BY cell),
lt AS (SELECT cell, unnest(literals) AS lit FROM fc_checks),
h AS (SELECT ct.cell, ct.sha256, lit, coalesce(contains(lower(body), lower(lit)), FALSE) AS f FROM ct JOIN lt ON lt.cell = ct.cell),
o AS (SELECT cell, bool_or(a) AS o FROM (SELECT cell, sha256, bool_and(f) AS a FROM h GROUP BY cell, sha256) GROUP BY cell),
l AS (SELECT cell, count(*) AS n_lost, min(lit) AS lost FROM (SELECT cell, lower(lit) AS lit, bool_or(f) AS f FROM h GROUP BY cell, lower(lit)) WHERE NOT f GROUP BY cell),
z AS (SELECT k.cell, coalesce(n_lost, 0) AS n_lost, lost, CASE WHEN coalesce(len(literals), 0) = 0 THEN 'nothing expected'
  WHEN len(list_filter(literals, lambda x: length(trim(x)) < 4)) > 0 THEN 'literal too short' WHEN expect_artifacts IS NULL THEN 'artifact count not declared'
  WHEN n.n <> expect_artifacts THEN 'artifact count differs' WHEN n.m < n.n THEN 'not archived' WHEN NOT o.o THEN 'not in one document' END AS reason
  FROM fc_checks k LEFT JOIN n ON n.cell = k.cell LEFT JOIN o ON o.cell = k.cell LEFT JOIN l ON l.cell = k.cell)
SELECT cell, reason IS NULL AS verdict, reason, n_lost, lost FROM z""")
def c1(spark, d):
    return checks.grep_all_in_one(frame(spark, d, "fc_checks"), frame(spark, d, "fc_cites"), frame(spark, d, "fb_blobs"))


@query("c2_count_in_retrieved", """
WITH h AS (SELECT c.cell, lit, CASE WHEN lit = '' THEN strlen(lower(body)) + 1 ELSE (length(lower(body)) - length(replace(lower(body), lower(lit), ''))) // length(lit) END AS n
           FROM (SELECT cell, unnest(literals) AS lit FROM fc_checks) c JOIN fc_cites t ON t.cell = c.cell JOIN fb_blobs b ON b.sha256 = t.sha256),
m AS (SELECT cell, max(n) AS n FROM (SELECT cell, lower(lit) AS lit, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY ALL) GROUP BY cell)
SELECT k.cell, m.n AS counted, CASE WHEN m.n IS NOT NULL AND expect_count IS NOT NULL THEN m.n = expect_count END AS verdict
FROM fc_checks k LEFT JOIN m ON m.cell = k.cell""")
def c2(spark, d):
    return checks.count_in_retrieved(frame(spark, d, "fc_checks"), frame(spark, d, "fc_cites"), frame(spark, d, "fb_blobs"))


@query("c3_range_check", r"""
WITH one AS (SELECT cell, count(*) AS n, min(url) AS url, min(range) AS range, min(sha256) AS sha256, min(index) AS idx FROM fc_ranges GROUP BY cell),
pl AS (SELECT cell, kind, CASE WHEN kind = 'yaml_dash_list' THEN [regexp_extract(body, '    - (.*)\n  - no', 1), 'second/' || page_id]
                              WHEN kind = 'hf_tree_json' AND base <> '' THEN ['https://host/base/a/' || page_id, 'https://host/base/b'] END AS p FROM fc_listings),
z AS (SELECT o.cell, CASE WHEN o.n <> 1 THEN 'not one range' WHEN pl.cell IS NULL THEN 'cited alone' END AS r1, b.sha256 IS NULL AS nob,
  CASE WHEN strlen(b.body) <> CAST(regexp_extract(range, '-(\d+)', 1) AS BIGINT) + 1 THEN 'length differs' WHEN pl.p IS NULL THEN 'listing unreadable'
       WHEN list_contains(pl.p, o.url) AND idx IS NOT NULL AND pl.p[idx + 1] <> o.url THEN 'other position'
       WHEN NOT list_contains(pl.p, o.url) THEN 'not listed' WHEN idx IS NULL THEN 'no position recorded' END AS r2
  FROM one o LEFT JOIN pl ON pl.cell = o.cell LEFT JOIN fb_blobs b ON b.sha256 = o.sha256)
SELECT cell, CASE WHEN r1 IS NULL AND nob THEN NULL ELSE coalesce(r1, r2) END AS reason,
       CASE WHEN r1 IS NULL AND nob THEN NULL ELSE coalesce(r1, r2) IS NULL END AS verdict FROM z""")
def c3(spark, d):
    listings = frame(spark, d, "fc_listings").select("cell", "kind", "base", F.sha2("body", 256).alias("sha256"))
    store = _store(frame(spark, d, "fb_blobs"), _own(frame(spark, d, "fs_lists")))
    return checks.range_check(frame(spark, d, "fc_ranges"), listings, store)


@query("c4_token_range_check", f"""
WITH {WORDS},
s2 AS (SELECT doc_id, count(*) AS n, max(w) AS m FROM w2 GROUP BY doc_id), s4 AS (SELECT doc_id, count(*) AS n, max(w) AS m FROM w4 GROUP BY doc_id),
b AS (SELECT x.doc_id AS cell, CASE WHEN x.doc_id % 2 = 0 THEN 2 ELSE 4 END AS width, CASE x.doc_id % 6 WHEN 0 THEN 32768 WHEN 1 THEN 2130706432 WHEN 2 THEN 65536 WHEN 3 THEN 4294967295 WHEN 4 THEN 4294967295 ELSE 30000 END AS bnd,
      coalesce(s2.n, 0) AS n2, s2.m AS m2, coalesce(s4.n, 0) AS n4, s4.m AS m4 FROM documents x LEFT JOIN s2 ON s2.doc_id = x.doc_id LEFT JOIN s4 ON s4.doc_id = x.doc_id),
o AS (SELECT cell, width, bnd, CASE WHEN width = 2 THEN n2 ELSE n4 END AS n_words, CASE WHEN width = 2 THEN m2 ELSE m4 END AS max_word,
      CASE WHEN width = 2 THEN (SELECT count(*) FROM w2 WHERE w2.doc_id = b.cell AND w >= bnd) ELSE (SELECT count(*) FROM w4 WHERE w4.doc_id = b.cell AND w >= bnd) END AS n_over,
      CASE WHEN width = 2 THEN bnd < 4294967296 AND n4 > 0 AND m4 < bnd ELSE bnd < 65536 AND n2 > 0 AND m2 < bnd END AS idle FROM b),
z AS (SELECT cell, n_words, max_word, n_over, CASE WHEN cell % 7 = 3 THEN 'word count differs' WHEN n_over > 0 THEN 'not below bound' WHEN idle THEN 'width does no work'
      WHEN cell % 5 = 0 THEN 'maximum differs' END AS reason FROM o)
SELECT *, reason IS NULL AS verdict FROM z""")
def c4(spark, d):
    docs = frame(spark, d, "documents").select(F.col("doc_id").alias("cell"), F.col("text").cast("binary").alias("body"))
    cell = F.col("cell")
    width = F.when(cell % 2 == 0, 2).otherwise(4)
    bound = F.element_at(F.array(*[F.lit(b) for b in (32768, 2130706432, 65536, 4294967295, 4294967295, 30000)]), (cell % 6 + 1).cast("int"))
    # what the ledger recorded: a first reading of the bytes, spoilt for some cells
    first = checks.word_table(docs.select("cell", "body", bound.alias("vocab_bound")), "vocab_bound")
    recorded = first.select(
        "cell", F.sha2("body", 256).alias("sha256"), width.alias("width"), "vocab_bound",
        (F.when(width == 2, F.col("w16.n_words")).otherwise(F.col("w32.n_words")) + (cell % 7 == 3).cast("int")).alias("count"),
        (F.when(width == 2, F.col("w16.max_word")).otherwise(F.col("w32.max_word")) + (cell % 5 == 0).cast("int")).alias("max_id"),
    )
    return checks.token_range_check(recorded, _store(frame(spark, d, "fb_blobs")))


@query("c5_item_digest_coverage", """
WITH e AS (SELECT e.cell, e.path, e.oid, content_pattern AS p, EXISTS (SELECT 1 FROM fc_declared x WHERE x.cell = e.cell AND x.path = e.path) AS dcl FROM fc_entries e JOIN fc_claims c ON c.cell = e.cell),
k AS (SELECT cell, count(*) AS n, count(*) FILTER (WHERE dcl AND coalesce(oid, '') <> '') AS mis, count(*) FILTER (WHERE dcl AND coalesce(regexp_matches(path, p), FALSE)) AS grd,
  count(*) FILTER (WHERE NOT dcl AND NOT coalesce(regexp_matches(path, p), FALSE)) AS unc, count(*) FILTER (WHERE NOT dcl AND coalesce(length(oid), 0) <> 64) AS msg,
  count(*) FILTER (WHERE length(oid) <> 64) AS mal FROM e GROUP BY cell),
ab AS (SELECT cell, count(*) AS n FROM fc_declared x WHERE NOT EXISTS (SELECT 1 FROM fc_entries e WHERE e.cell = x.cell AND e.path = x.path) GROUP BY cell),
z AS (SELECT c.cell, k.n - k.msg AS n_with_digest, CASE WHEN k.n <> c.expect_files THEN 'file count differs' WHEN ab.n > 0 THEN 'declared name absent' WHEN mis > 0 THEN 'declared name has digest'
  WHEN s.n > 0 AND content_pattern IS NULL THEN 'no content pattern' WHEN s.n > 0 AND grd > 0 THEN 'declared name looks like content' WHEN s.n > 0 AND unc > 0 THEN 'name not covered'
  WHEN mal > 0 THEN 'malformed digest' WHEN bound_items IS NOT NULL AND k.n - msg <> bound_items THEN 'claimed count differs' WHEN bound_items IS NULL AND msg > 0 THEN 'digest missing' END AS reason
  FROM fc_claims c JOIN k ON k.cell = c.cell LEFT JOIN ab ON ab.cell = c.cell LEFT JOIN (SELECT cell, count(*) AS n FROM fc_declared GROUP BY cell) s ON s.cell = c.cell)
SELECT *, reason IS NULL AS verdict FROM z""")
def c5(spark, d):
    return checks.item_digest_coverage(frame(spark, d, "fc_claims"), frame(spark, d, "fc_entries"), frame(spark, d, "fc_declared"))


@query("c6_weight_object", """
WITH z AS (SELECT cell, NOT EXISTS (SELECT 1 FROM fc_weights a WHERE a.body IS NOT NULL AND a.expect_evidence_sha256 = w.sha256) AS nob, CASE
  WHEN cell % 19 = 0 THEN 'identities differ' WHEN cell % 17 = 0 THEN 'listing: not json' WHEN cell % 5 = 0 THEN 'listing: other revision' WHEN cell % 7 = 0 THEN 'listing: other repository'
  WHEN n_ranged <> 1 THEN 'not one range' WHEN cell % 23 = 0 THEN 'other evidence' WHEN cell % 43 = 0 THEN 'other file' WHEN cell % 41 = 0 THEN 'other commit' WHEN cell % 37 = 0 THEN 'range differs' END AS r1,
  CASE WHEN cell % 3 <> 0 AND cell % 11 = 0 THEN 'no safetensors header' END AS r2 FROM fc_weights w)
SELECT cell, CASE WHEN r1 IS NULL AND nob THEN NULL ELSE coalesce(r1, r2) END AS reason, CASE WHEN r1 IS NULL AND nob THEN NULL ELSE coalesce(r1, r2) IS NULL END AS verdict FROM z""")
def c6(spark, d):
    rows = frame(spark, d, "fc_weights")
    claims = rows.withColumn("listing_sha256", F.sha2("listing_body", 256)).drop("body", "listing_body", "content")
    archived = rows.select(F.col("expect_evidence_sha256").alias("sha256"), "body").where("body is not null")
    return checks.weight_object(claims, _store(archived, _own(frame(spark, d, "fs_revisions"))))


@query("c7_all_shard_digests", """
WITH p AS (SELECT cell, file, count(*) AS c, count(*) FILTER (WHERE body IS NULL) AS u, count(*) FILTER (WHERE body = 'version 1') AS no,
   count(*) FILTER (WHERE contains(body, 'oid') AND NOT contains(body, lfs_oid)) AS bo, count(*) FILTER (WHERE sha256(body) <> sha256) AS bd FROM fc_pointers GROUP BY cell, file),
j AS (SELECT coalesce(s.cell, p.cell) AS cell, s.file AS sf, p.file AS pf, p.c, p.u, p.no, p.bo, p.bd FROM fc_shards s FULL JOIN p ON p.cell = s.cell AND p.file = s.file),
k AS (SELECT cell, count(sf) AS n, bool_or(sf IS NULL OR pf IS NULL) AS uneq, bool_or(coalesce(c, 0) > 1) AS dup, sum(u) AS u, sum(no) AS no, sum(bo) AS bo, sum(bd) AS bd FROM j GROUP BY cell),
z AS (SELECT c.cell, CASE WHEN n <> expect_shards THEN 'shard count differs' ELSE nullif(array_to_string(list_filter([CASE WHEN u > 0 THEN 'not archived' END, CASE WHEN no > 0 THEN 'no digest in pointer' END,
  CASE WHEN bo > 0 THEN 'digest differs from ledger' END, CASE WHEN bd > 0 THEN 'bytes differ' END, CASE WHEN dup THEN 'duplicate pointer' END, CASE WHEN uneq THEN 'not set-equal' END], lambda x: x IS NOT NULL), '; '), '') END AS reason
  FROM fc_shard_claims c JOIN k ON k.cell = c.cell)
SELECT *, reason IS NULL AS verdict FROM z""")
def c7(spark, d):
    return checks.all_shard_digests(frame(spark, d, "fc_shard_claims"), frame(spark, d, "fc_shards"), frame(spark, d, "fc_pointers"))


@query("c8_signed_commit", """
WITH z AS (SELECT s.subject, body IS NULL AND expect_revision IS NOT NULL AS nob, CASE WHEN expect_revision IS NULL THEN 'no revision declared' WHEN expect_revision = 'f00' THEN 'other revision'
  WHEN expect_signed IS NULL THEN 'signed flag not declared' WHEN subject % 7 = 1 THEN 'other committer' WHEN expect_signed <> (subject % 3 = 0) THEN 'signed flag differs'
  WHEN subject % 3 <> 0 THEN NULL WHEN NOT intact THEN 'signature damaged' WHEN fingerprint <> expect_fingerprint THEN 'other signer' WHEN subject % 31 = 0 THEN 'other subject line'
  WHEN expect_shared IS NULL THEN 'shared flag not declared'
  WHEN expect_shared AND (SELECT count(DISTINCT o.subject) FROM fc_signed o WHERE o.expect_fingerprint = s.fingerprint AND o.subject <> s.subject) < 2 THEN 'signer not shared' END AS r FROM fc_signed s)
SELECT subject, CASE WHEN NOT nob THEN r END AS reason, CASE WHEN NOT nob THEN r IS NULL END AS verdict FROM z""")
def c8(spark, d):
    rows = frame(spark, d, "fc_signed")
    return checks.signed_commit(rows.withColumn("sha256", F.sha2("body", 256)).drop("body"), _own(rows))


@query("c9_repo_tree_check", """
WITH f AS (SELECT cell, path, max(size) AS size FROM fc_tree WHERE type = 'blob' GROUP BY cell, path),
q AS (SELECT r.cell, count(*) FILTER (WHERE f.size IS NULL) AS n_missing, count(*) FILTER (WHERE f.size < 512) AS n_stubs FROM fc_required r LEFT JOIN f ON f.cell = r.cell AND f.path = r.path GROUP BY r.cell),
z AS (SELECT c.cell, n_missing, n_stubs, CASE WHEN truncated THEN 'truncated' WHEN n_missing > 0 THEN 'path missing' WHEN n_stubs > 0 THEN 'stub' WHEN manifest IS NULL THEN 'manifest not declared'
  WHEN NOT EXISTS (SELECT 1 FROM f WHERE f.cell = c.cell AND f.path = c.manifest) THEN 'manifest missing' END AS reason FROM fc_tree_claims c JOIN q ON q.cell = c.cell)
SELECT *, reason IS NULL AS verdict FROM z""")
def c9(spark, d):
    return checks.repo_tree_check(frame(spark, d, "fc_tree_claims"), frame(spark, d, "fc_tree"), frame(spark, d, "fc_required"))


@query("c10_release_artifact_patterns", """
WITH k AS (SELECT cell, count(*) FILTER (WHERE type = 'file') AS n_files, count(*) FILTER (WHERE type = 'directory') AS dirs,
   count(DISTINCT path) FILTER (WHERE type = 'file' AND (regexp_matches(path, '[.]promo$', 'i') OR regexp_matches(path, '^red_', 'i'))) AS n_matches,
   count(*) FILTER (WHERE type = 'file' AND path IN ('x.promo', 'red_cog.standard')) AS lk FROM fc_published GROUP BY cell),
z AS (SELECT c.cell, n_files, n_matches, CASE WHEN dirs > 0 THEN 'unexpanded directory' WHEN lk > 0 THEN 'exemplar is published' WHEN n_matches <> expect_matches THEN 'count differs' END AS reason FROM fc_published_claims c JOIN k ON k.cell = c.cell)
SELECT *, reason IS NULL AS verdict FROM z""")
def c10(spark, d):
    return checks.release_artifact_patterns(
        frame(spark, d, "fc_published_claims"), frame(spark, d, "fc_published"), ["[.]promo$", "^red_"], ["x.promo", "red_cog.standard"]
    )


@query("c11_search_replay", r"""
WITH rs AS (SELECT r.subject, term, sha256, body, CAST(regexp_extract(body, 'totalResults>(\d+)<', 1) AS VARCHAR) AS hd, len(regexp_extract_all(body, '<entry[ >]')) AS ne,
   contains(url, 'abs%3A%22' || name || '%22') AS nm FROM fn_responses r JOIN fn_claims c ON c.subject = r.subject),
pt AS (SELECT subject, term, max(TRY_CAST(hd AS BIGINT)) AS header, sum(ne) AS counted, bool_or(NOT nm) AS un, bool_or(body IS NULL) AS ur, bool_or(body IS NOT NULL AND hd = '') AS hl FROM rs GROUP BY subject, term),
tt AS (SELECT pt.subject, count(*) AS n, bool_or(ur) AS ur, bool_or(un) AS un, bool_or(hl) AS hl, coalesce(bool_or(t.total <> header), FALSE) AS mv, coalesce(bool_or(counted <> header), FALSE) AS sh
  FROM pt LEFT JOIN fn_totals t ON t.subject = pt.subject AND t.term = pt.term GROUP BY pt.subject),
dd AS (SELECT subject, bool_or(NOT EXISTS (SELECT 1 FROM fn_digests g WHERE g.subject = r.subject AND g.sha256 = r.sha256)) AS df FROM fn_responses r GROUP BY subject),
z AS (SELECT c.subject, CASE WHEN positives IS NULL THEN 'incomplete record' WHEN score = 0 AND positives <> 0 THEN 'zero with a positive'
   WHEN v.hit IS NOT NULL AND v.has_axis17 AND v.hit <> (v.axis17 > 0) THEN 'adjudication disagrees' WHEN tt.n <> expect_queries THEN 'query count differs' WHEN df THEN 'responses differ' END AS r1, ur,
   CASE WHEN un THEN 'query without the name' WHEN hl THEN 'no total in response' WHEN mv THEN 'total moved' WHEN sh THEN 'entries differ from total' END AS r2
   FROM fn_claims c JOIN tt ON tt.subject = c.subject JOIN dd ON dd.subject = c.subject LEFT JOIN fn_verdicts v ON v.subject = c.subject)
SELECT subject, CASE WHEN r1 IS NULL AND ur THEN NULL ELSE coalesce(r1, r2) END AS reason, CASE WHEN r1 IS NULL AND ur THEN NULL ELSE coalesce(r1, r2) IS NULL END AS verdict FROM z""")
def c11(spark, d):
    return checks.search_replay(
        frame(spark, d, "fn_claims"), frame(spark, d, "fn_totals"), frame(spark, d, "fn_digests"),
        frame(spark, d, "fn_responses").drop("body"), frame(spark, d, "fn_verdicts"), _own(frame(spark, d, "fn_responses"), digest="sha256"),
    )


@query("c12_replay_summary", """
WITH h AS (SELECT c.cell, lower(lit) AS lit, sum(CASE WHEN lit = '' THEN strlen(lower(body)) + 1 ELSE (length(lower(body)) - length(replace(lower(body), lower(lit), ''))) // length(lit) END) AS n
           FROM (SELECT cell, unnest(literals) AS lit FROM fc_checks) c JOIN fc_cites t ON t.cell = c.cell JOIN fb_blobs b ON b.sha256 = t.sha256 GROUP BY ALL),
v AS (SELECT k.cell, CASE WHEN m.n IS NOT NULL AND expect_count IS NOT NULL THEN m.n = expect_count END AS v
      FROM fc_checks k LEFT JOIN (SELECT cell, max(n) AS n FROM h GROUP BY cell) m ON m.cell = k.cell)
SELECT CASE cell % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'asserted' ELSE 'bounded negative' END AS class, count(*) FILTER (WHERE v) AS passed, count(*) FILTER (WHERE NOT v) AS failed,
  count(*) FILTER (WHERE v IS NULL) AS unreplayable, count(*) AS n FROM v GROUP BY 1""")
def c12(spark, d):
    verdicts = c2(spark, d)
    name = F.element_at(F.array(F.lit("positive"), F.lit("asserted"), F.lit("bounded negative")), (F.col("cell") % 3 + 1).cast("int"))
    return checks.replay_summary(verdicts.select(name.alias("class"), "verdict"))


@query("c13_archive_verify", """
WITH z AS (SELECT w.url, w.sha256, CASE WHEN m.url IS NULL THEN 'not in manifest' WHEN m.manifest_sha256 <> w.sha256 THEN 'manifest disagrees' WHEN stored AND b.sha256 IS NULL THEN 'bytes missing'
   WHEN stored AND sha256(b.body) <> w.sha256 THEN 'bytes differ' END AS reason FROM fs_wanted w LEFT JOIN fc_manifest m ON m.url = w.url LEFT JOIN fc_archive b ON b.sha256 = w.sha256)
SELECT * FROM z WHERE reason IS NOT NULL""")
def c13(spark, d):
    return checks.archive_verify(frame(spark, d, "fs_wanted").select("url", "sha256"), frame(spark, d, "fc_manifest"), frame(spark, d, "fc_archive"))


@query("c14_unreferenced_blobs", "SELECT sha256 FROM fc_archive WHERE sha256 NOT IN (SELECT manifest_sha256 FROM fc_manifest)")
def c14(spark, d):
    return checks.unreferenced_blobs(frame(spark, d, "fc_archive"), frame(spark, d, "fc_manifest"))


def _result(df, key, column):
    return df.select(key, column.alias("r")).select(key, "r.value", "r.error")


@query("f1_count_lines_matching", r"""
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^(?:[A-Z][a-z]+)')) AS l FROM documents),
n AS (SELECT doc_id, len(l) AS n, len(list_filter(l, lambda x: NOT contains(x, 'th'))) AS k FROM l)
SELECT doc_id, CASE WHEN k = 0 THEN n END AS value, CASE WHEN k > 0 THEN k || ' lines lack the qualifier' END AS error FROM n""")
def f1(spark, d):
    return _result(frame(spark, d, "documents"), "doc_id", facts.count_lines_matching(F.col("text"), F.lit("[A-Z][a-z]+"), F.lit("th")))


@query("f2_byte_length", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS value, CAST(NULL AS VARCHAR) AS error FROM documents")
def f2(spark, d):
    return _result(frame(spark, d, "documents"), "doc_id", facts.byte_length(F.col("text")))


@query("f3_count_json_entries", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN (CASE WHEN json_extract_string(props, '$.k') = '7' THEN 1 ELSE 0 END) + (CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) END::BIGINT AS value,
       CASE WHEN event_type = 'error' THEN 'not a JSON array' END AS error FROM events""")
def f3(spark, d):
    extra = F.when(F.col("event_id") % 3 == 0, ', {"k": 7}').otherwise(', {"j": 7}')
    body = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.concat(F.lit("["), F.col("props"), extra, F.lit("]")))
    return _result(frame(spark, d, "events"), "event_id", facts.count_json_entries(body, F.lit("k"), F.lit("7")))


@query("f4_token_ids_below", f"""
WITH {WORDS}, k AS (SELECT doc_id, count(*) FILTER (WHERE w >= 30000) AS o FROM w2 GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(o, 0) = 0 THEN strlen(text) // 2 END AS value, CASE WHEN o > 0 THEN o || ' words not below bound' END AS error
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id""")
def f4(spark, d):
    return _result(frame(spark, d, "documents"), "doc_id", facts.token_ids_below(F.col("text"), F.lit(30000), 2))


@query("f5_check_facts", f"""
WITH {WORDS},
f AS (SELECT f.*, b.body, CAST(regexp_extract(name, '\\d+', 0) AS BIGINT) AS i FROM fc_facts f LEFT JOIN fb_blobs b ON b.sha256 = f.sha256),
t AS (SELECT f.name, count(*) FILTER (WHERE w >= below) AS o FROM f JOIN w2 ON w2.doc_id = f.i WHERE method = 'token_ids_below' AND width = 'uint16' GROUP BY f.name
      UNION ALL SELECT f.name, count(*) FILTER (WHERE w >= below) FROM f JOIN w4 ON w4.doc_id = f.i WHERE method = 'token_ids_below' AND width = 'uint32' GROUP BY f.name),
l AS (SELECT name, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '^(?:[A-Z][a-z]+)')) AS l FROM f WHERE method = 'count_lines_matching'),
c AS (SELECT f.name, method, value AS recorded, body, CASE method WHEN 'byte_length' THEN strlen(body) WHEN 'token_ids_below' THEN CASE width WHEN 'uint16' THEN strlen(body) // 2 ELSE strlen(body) // 4 END
        WHEN 'count_lines_matching' THEN len(l) END AS v,
      CASE WHEN method = 'token_ids_below' AND o > 0 THEN o || ' words not below bound' WHEN method = 'count_json_entries' THEN 'not a JSON array'
           WHEN method = 'count_lines_matching' AND len(list_filter(l, lambda x: NOT contains(x, also_all_contain))) > 0 THEN len(list_filter(l, lambda x: NOT contains(x, also_all_contain))) || ' lines lack the qualifier' END AS e
      FROM f LEFT JOIN t ON t.name = f.name LEFT JOIN l ON l.name = f.name)
SELECT name, method, recorded, CASE WHEN method <> 'http_206' AND body IS NOT NULL AND e IS NULL THEN v END AS recomputed,
  CASE WHEN method = 'http_206' THEN 'method not registered' WHEN body IS NULL THEN 'not archived' WHEN e IS NOT NULL THEN e WHEN v = recorded THEN 'ok' ELSE 'value differs' END AS status FROM c""")
def f5(spark, d):
    return facts.check_facts(frame(spark, d, "fc_facts"), frame(spark, d, "fb_blobs"))
