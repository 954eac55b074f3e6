"""Drift, selection, run history and mutation queries."""

from pyspark.sql import functions as F

from veriledger.functions.ranking import carried
from veriledger.operators import drift, history, mutation
from veriledger.plans.catalog import query
from veriledger.plans.fixtures import frame
from veriledger.plans.q_validation import OKAY

KIND = """CASE user_id % 10 WHEN 0 THEN 'NONE' WHEN 1 THEN 'NONE' WHEN 2 THEN 'MATERIAL' WHEN 3 THEN CASE WHEN user_id % 20 = 3 THEN 'NONE' ELSE 'MATERIAL' END
  WHEN 4 THEN 'METADATA' ELSE CASE WHEN mk = '' THEN 'NONE' WHEN mk = 'downloads' THEN 'METADATA' ELSE 'MATERIAL' END END"""
MOVED = """CASE user_id % 10 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '*' WHEN 3 THEN CASE WHEN user_id % 20 = 3 THEN '' ELSE '*' END ELSE mk END"""
DRIFT = f"""WITH jv AS (SELECT *, user_id % 10 > 3 AS o, CASE WHEN user_id % 10 > 3 THEN old_body ELSE '{{}}' END AS ob, CASE WHEN user_id % 10 > 3 THEN new_body ELSE '{{}}' END AS nb FROM fr_snap),
dk AS (SELECT *, array_to_string(list_filter(['downloads', 'event_type', 'k', 'likes'], lambda f: json_extract_string(ob, '$.' || f) IS DISTINCT FROM json_extract_string(nb, '$.' || f)), ',') AS mk FROM jv),
dr AS (SELECT user_id, old_body, new_body, new_type, {KIND} AS kind, {MOVED} AS moved FROM dk)"""


@query("r1_drift_keys", DRIFT + " SELECT user_id, kind, moved FROM dr")
def r1(spark, d):
    found = drift.drift_keys(F.col("old_body"), F.col("new_body"))
    return frame(spark, d, "fr_snap").select("user_id", found.alias("d")).select("user_id", "d.kind", F.array_join("d.keys", ",").alias("moved"))


REPORT = DRIFT + """, ci AS (SELECT url, min(sha256) AS sha256, bool_or(volatile) AS v, count(*) AS n_cells, min(label) AS first_cell FROM fr_cited GROUP BY url),
rp AS (SELECT ci.url, n_cells, first_cell, ci.sha256, CASE WHEN s.status = 'limited' THEN 'limited' WHEN s.status IS NULL OR s.status = 'gone' THEN 'gone' WHEN s.sha256 = ci.sha256 THEN 'ok' WHEN v THEN 'volatile'
   WHEN dr.user_id % 11 = 0 AND NOT EXISTS (SELECT 1 FROM fr_blobs b WHERE b.sha256 = ci.sha256) THEN 'material'
   ELSE CASE kind WHEN 'NONE' THEN 'serialisation' WHEN 'METADATA' THEN 'metadata' ELSE 'material' END END AS class, moved, dr.user_id
   FROM ci JOIN dr ON 'https://h/' || dr.user_id = ci.url LEFT JOIN fr_seen s ON s.url = ci.url)"""
REPORTED = """SELECT url, class, CASE WHEN class NOT IN ('serialisation', 'metadata', 'material') THEN '' WHEN user_id % 11 = 0 AND NOT EXISTS (SELECT 1 FROM fr_blobs b WHERE b.sha256 = rp.sha256) THEN 'bytes unavailable' ELSE moved END AS moved, n_cells, first_cell FROM rp"""


def _report(spark, d):
    return drift.drift_report(frame(spark, d, "fr_cited"), frame(spark, d, "fr_blobs"), frame(spark, d, "fr_seen"))


@query("r2_drift_report", f"{REPORT} {REPORTED}")
def r2(spark, d):
    return _report(spark, d)


@query("r2_affected_cells", f"{REPORT} SELECT DISTINCT rp.url, class, label FROM rp JOIN fr_cited c ON c.url = rp.url WHERE class <> 'ok'")
def r2_cells(spark, d):
    return drift.affected_cells(_report(spark, d), frame(spark, d, "fr_cited"))


@query("r3_findings", f"{REPORT}, fd AS ({REPORTED}) SELECT '2024-02-01T00:00:00Z' AS at, url, class, moved, n_cells FROM fd WHERE class <> 'ok'")
def r3_findings(spark, d):
    return drift.drift_findings(_report(spark, d), "2024-02-01T00:00:00Z")


_COUNTS = ", ".join(f"count(*) FILTER (WHERE class = '{c}') AS n_{c}" for c in drift.CLASSES)
_WORDS = ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {8 * i + 1}, 8)) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query("r3_drift_run_record", f"""{REPORT}, cv AS (SELECT sha256(url || '|' || sha256) AS h FROM ci)
SELECT '2024-02-01T00:00:00Z' AS at, count(*) AS artifacts, {_COUNTS}, count(*) FILTER (WHERE class = 'limited') = 0 AS complete,
 (SELECT sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {_WORDS})) FROM cv) AS covered FROM rp""")
def r3(spark, d):
    return drift.drift_run_record(_report(spark, d), frame(spark, d, "fr_cited"), "2024-02-01T00:00:00Z")


@query("r3_runs_kept", """SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS at, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 50""")
def r3_kept(spark, d):
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss")
    return drift.keep_last_runs(frame(spark, d, "events").groupBy(hour.alias("at")).agg(F.count(F.lit(1)).alias("n")), n=50)


@query("r4_volatile_by_double_observation", """
SELECT user_id || '/' || event_type AS url, count(*) AS n, count(DISTINCT props) > 1 AS volatile FROM events GROUP BY user_id, event_type""")
def r4(spark, d):
    url = F.concat_ws("/", F.col("user_id").cast("string"), F.col("event_type"))
    seen = frame(spark, d, "events").select(url.alias("url"), F.sha2("props", 256).alias("sha256"))
    return drift.volatile_by_double_observation(seen)


@query("r5_pin_gate", """
WITH t AS (SELECT * FROM fr_shared_cites WHERE contains(url, '/main/') OR contains(url, '/HEAD/') OR contains(url, '/latest/'))
SELECT count(DISTINCT t.url) AS n_targets, count(DISTINCT t.url) FILTER (WHERE p.url IS NULL) AS n_unmapped, count(*) FILTER (WHERE p.pinned_sha256 <> t.sha256) AS n_moved,
       FALSE AS allowed FROM t LEFT JOIN fr_shared_pins p ON p.url = t.url""")
def r5_gate(spark, d):
    return drift.pin_gate(frame(spark, d, "fr_shared_cites"), frame(spark, d, "fr_shared_pins"))


@query("r5_pin_mapping", """
SELECT label, replace(url, '/main/', '/' || substr(sha256, 1, 40) || '/') AS url, sha256, contains(url, '/main/') AS rewritten FROM fr_cites""")
def r5(spark, d):
    return drift.pin_mapping(frame(spark, d, "fr_cites"), frame(spark, d, "fr_pins"))


@query("r6_superseded_apply", """
WITH gp AS (SELECT *, CASE WHEN axis <= 5 THEN 1 WHEN axis <= 11 THEN 2 WHEN axis <= 15 THEN 3 WHEN axis <= 19 THEN 4 ELSE 5 END AS g FROM fp_policy WHERE key = 'axis_sources'),
ch AS (SELECT gp.*, EXISTS (SELECT 1 FROM fp_superseded z WHERE z.subject = gp.subject AND z.address = gp.value AND z.grp = g AND NOT list_contains(z.still_valid_for, gp.axis)) AS changed FROM gp)
SELECT subject, axis, CASE WHEN changed THEN 'host:replacement.example' ELSE value END AS value, changed FROM ch""")
def r6(spark, d):
    return drift.superseded_apply(frame(spark, d, "fp_policy"), frame(spark, d, "fp_superseded"))


@query("r7_rank_check", """
WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
SELECT id, claimed, rank, claimed IS NOT DISTINCT FROM rank AS agrees FROM fr_claims LEFT JOIN r ON p_partkey = id""")
def r7(spark, d):
    return history.rank_check(frame(spark, d, "part"), frame(spark, d, "fr_claims"), "p_retailprice", "p_partkey")


_TOP = "SELECT org, id FROM (SELECT p_brand AS org, p_partkey AS id, p_retailprice AS p, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1 ORDER BY p DESC, id LIMIT 4"


def _top(spark, d):
    return history.first_per_org_topk(frame(spark, d, "part"), "p_brand", "p_retailprice", "p_partkey")


@query("r8_first_per_org_topk", _TOP)
def r8(spark, d):
    return _top(spark, d)


@query("r8_selected_overlap", f"SELECT * FROM ({_TOP}) WHERE id IN (SELECT p_partkey FROM part WHERE p_size > 20)")
def r8_overlap(spark, d):
    claimed = frame(spark, d, "part").filter("p_size > 20").select(F.col("p_partkey").alias("id"))
    return history.selected_overlap(_top(spark, d), claimed)


@query("r9_shared_signer", "SELECT count(DISTINCT fingerprint) AS n_keys, count(DISTINCT subject) AS n_subjects, count(DISTINCT fingerprint) < count(DISTINCT subject) AS shared FROM fc_signed WHERE fingerprint IS NOT NULL")
def r9(spark, d):
    return history.shared_signer(frame(spark, d, "fc_signed").select("subject", "fingerprint"))


@query("r10_run_history", """
WITH p AS (SELECT *, lag((round, controls_total, watched, never_executes, source_fingerprint, inputs_fingerprint)) OVER (ORDER BY run) AS was FROM fr_runs),
k AS (SELECT * FROM p WHERE was IS DISTINCT FROM (round, controls_total, watched, never_executes, source_fingerprint, inputs_fingerprint))
SELECT run, round, controls_total, watched, never_executes, source_fingerprint, inputs_fingerprint, row_number() OVER (ORDER BY run) AS ordinal FROM k""")
def r10(spark, d):
    return history.run_history(frame(spark, d, "fr_runs"))


@query("r11_previous_round", """
SELECT r.round, (SELECT max(x.round) FROM fr_runs x WHERE x.round < r.round) AS previous_round, (SELECT max(x.run) FROM fr_runs x WHERE x.round < r.round) AS previous_run FROM (SELECT DISTINCT round FROM fr_runs) r""")
def r11(spark, d):
    return history.previous_round(frame(spark, d, "fr_runs"))


@query("r12_history_anomalies", """
WITH t AS (SELECT run, controls_total, lag(controls_total) OVER (ORDER BY run) AS was, (SELECT arg_max(controls_total, run) FROM fr_runs) AS now FROM fr_runs)
SELECT run, controls_total, controls_total < now // 2 AS narrow, coalesce(controls_total < was, FALSE) AS fell FROM t WHERE controls_total < now // 2 OR controls_total < was""")
def r12(spark, d):
    return history.history_anomalies(frame(spark, d, "fr_runs"))


@query("r13_inputs_manifest_diff", """
SELECT 'f' || p_partkey AS name, CASE WHEN p_size = 1 THEN 'only here' WHEN p_size = 2 THEN 'only there' WHEN p_size = 3 THEN 'differing' ELSE 'same' END AS status FROM part""")
def r13(spark, d):
    part = frame(spark, d, "part").select("p_size", F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), F.sha2("p_name", 256).alias("digest"))
    there = part.filter("p_size <> 1").select("name", F.when(F.col("p_size") == 3, "moved").otherwise(F.col("digest")).alias("digest"))
    return history.inputs_manifest_diff(part.filter("p_size <> 2").select("name", "digest"), there)


@query("r14_multiset_diff", """
WITH s AS (SELECT line, source, class, count(*) AS n FROM fr_rows GROUP BY ALL), r AS (SELECT line, source, class, count(*) AS n FROM fr_rows_again GROUP BY ALL)
SELECT CASE WHEN coalesce(s.n, 0) > coalesce(r.n, 0) THEN 'stored' ELSE 'recomputed' END AS only_in, coalesce(s.line, r.line) AS line, coalesce(s.source, r.source) AS source, coalesce(s.class, r.class) AS class,
       abs(coalesce(s.n, 0) - coalesce(r.n, 0)) AS n FROM s FULL JOIN r ON s.line = r.line AND s.source = r.source AND s.class = r.class WHERE coalesce(s.n, 0) <> coalesce(r.n, 0)""")
def r14(spark, d):
    return history.multiset_diff(frame(spark, d, "fr_rows"), frame(spark, d, "fr_rows_again"))


@query("r15_append_only_check", """
SELECT 'row changed' AS why, 4 AS run UNION ALL SELECT 'row lost', max(run) + 1 FROM fr_runs UNION ALL SELECT 'predecessor not in history', 12""")
def r15(spark, d):
    return history.append_only_check(frame(spark, d, "fr_stored_runs"), frame(spark, d, "fr_runs"), frame(spark, d, "fr_named"))


@query("r15_segment_agreement", """
WITH b AS (SELECT coalesce(s.run, r.run) // 8 AS segment, s.run AS sr, r.run AS rr,
    (s.run, s.round, s.controls_total, s.watched, s.never_executes, s.source_fingerprint, s.inputs_fingerprint)
      = (r.run, r.round, r.controls_total, r.watched, r.never_executes, r.source_fingerprint, r.inputs_fingerprint) AS eq
  FROM fr_stored_runs s FULL JOIN (SELECT * FROM fr_runs WHERE run <= (SELECT max(run) FROM fr_stored_runs)) r ON r.run = s.run),
g AS (SELECT segment, count(sr) AS n_stored, count(rr) AS n_recomputed, bool_and(coalesce(eq, FALSE)) AS agrees FROM b GROUP BY segment)
SELECT *, bool_and(agrees) OVER (ORDER BY segment) AS prefix_agrees FROM g""")
def r15_segments(spark, d):
    return history.segment_agreement(frame(spark, d, "fr_stored_runs"), frame(spark, d, "fr_runs"), span=8)


@query("r11_last_known_round", """
WITH t AS (SELECT run, CASE WHEN run % 4 = 0 THEN round END AS round FROM fr_runs)
SELECT run, round, (SELECT arg_max(x.round, x.run) FROM t x WHERE x.run < t.run AND x.round IS NOT NULL) AS known FROM t""")
def r11_known(spark, d):
    runs = frame(spark, d, "fr_runs").select("run", F.when(F.col("run") % 4 == 0, F.col("round")).alias("round"))
    return carried(runs, F.asc("run"), value="round", out="known")


@query("r16_partition_check", """
SELECT day(ts) AS grp, count(*) + CAST(day(ts) % 7 = 0 AS INT) AS total, count(*) AS summed, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS parts,
       day(ts) % 7 <> 0 AS is_partition, count(*) FILTER (WHERE event_type IN ('click', 'view')) = count(*) + CAST(day(ts) % 7 = 0 AS INT) AS parts_cover FROM events GROUP BY day(ts)""")
def r16(spark, d):
    events = frame(spark, d, "events").select(F.dayofmonth("ts").cast("long").alias("grp"), F.col("event_type").alias("category"))
    counts = events.groupBy("grp", "category").agg(F.count(F.lit(1)).alias("n"))
    totals = events.groupBy("grp").agg(F.count(F.lit(1)).alias("total")).withColumn("total", F.col("total") + (F.col("grp") % 7 == 0).cast("int"))
    return history.partition_check(counts, totals, ["click", "view"])


@query("m2_field_mutation_coverage", """
WITH ct AS (SELECT c.cell, c.sha256, b.body FROM fc_cites c LEFT JOIN fb_blobs b ON b.sha256 = c.sha256),
bs AS (SELECT k.cell, literals, expect_artifacts FROM fc_checks k JOIN (SELECT cell, count(*) AS n, count(body) AS m FROM ct GROUP BY cell) q ON q.cell = k.cell
  WHERE len(literals) > 0 AND len(list_filter(literals, lambda x: length(trim(x)) < 4)) = 0 AND expect_artifacts = q.n AND q.n = q.m
  AND EXISTS (SELECT 1 FROM ct WHERE ct.cell = k.cell AND list_bool_and(list_transform(literals, lambda x: contains(lower(body), lower(x)))))),
ot AS (SELECT body FROM fb_blobs WHERE sha256 = (SELECT min(sha256) FROM fb_blobs)),
fs AS (SELECT ct.cell, min(sha256) AS h FROM ct GROUP BY ct.cell),
rm AS (SELECT b.cell, count(*) AS left_n FROM bs b JOIN ct ON ct.cell = b.cell JOIN fs ON fs.cell = b.cell AND fs.h <> ct.sha256 GROUP BY b.cell),
pb AS (SELECT b.cell, list_bool_and(list_transform(literals, lambda x: contains(lower(ot.body), lower(x)))) AS hit FROM bs b, ot),
pt AS (SELECT b.cell, bool_or(list_bool_and(list_transform(literals, lambda x: contains(lower(body), lower(x) || chr(1))))) AS hit FROM bs b JOIN ct ON ct.cell = b.cell GROUP BY b.cell),
al AS (SELECT cell, 'delete expect' AS mutation, FALSE AS s FROM bs UNION ALL SELECT cell, 'perturb expect', hit FROM pt UNION ALL SELECT cell, 'delete expect_artifacts', FALSE FROM bs
  UNION ALL SELECT cell, 'perturb expect_artifacts', FALSE FROM bs UNION ALL SELECT cell, 'repoint digest', FALSE FROM bs UNION ALL SELECT cell, 'transplant evidence', hit FROM pb
  UNION ALL SELECT b.cell, 'drop co-cited', coalesce(left_n, 0) = expect_artifacts FROM bs b LEFT JOIN rm ON rm.cell = b.cell)
SELECT mutation, count(*) AS n, count(*) FILTER (WHERE NOT s) AS rejected, count(*) FILTER (WHERE s) AS survived FROM al GROUP BY mutation""")
def m2(spark, d):
    blobs = frame(spark, d, "fb_blobs")
    other = blobs.agg(F.min("sha256")).scalar()
    return mutation.field_mutation_coverage(frame(spark, d, "fc_checks"), frame(spark, d, "fc_cites"), blobs, other)
