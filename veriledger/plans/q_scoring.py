"""Scoring and sensitivity queries over the clean stand-in ledger."""

from pyspark.sql import functions as F

from veriledger.operators import scoring, sensitivity
from veriledger.plans.catalog import DIGEST_WORDS, query
from veriledger.plans.fixtures import frame
from veriledger.plans.q_validation import ledger


def _scores(spark, d):
    return scoring.score(frame(spark, d, "fx_cells"), frame(spark, d, "fx_subjects"))


def _keys(spark, d):
    return sensitivity.score_keys(_scores(spark, d))


def _vectors(spark, d):
    return sensitivity.score_vectors(frame(spark, d, "fx_cells"), frame(spark, d, "fx_subjects"))


def _rounded(df, *cols):
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


SCORED = """WITH sc AS (
  SELECT c.subject, s.kind, sum(score) AS total, count(score) AS n, count(*) AS m,
         count(*) FILTER (WHERE score = 1) AS ones, count(*) FILTER (WHERE score = 2) AS twos
  FROM fx_cells c LEFT JOIN fx_subjects s USING (subject) GROUP BY ALL)
"""


@query("a1_score", """
SELECT c.subject, s.kind, CAST(sum(score) AS BIGINT) AS total, count(score) AS n_scored,
       count(*) - count(score) AS n_na,
       count(*) FILTER (WHERE score = 2) AS n_2, count(*) FILTER (WHERE score = 1) AS n_1,
       count(*) FILTER (WHERE score = 0) AS n_0,
       CAST(sum(CASE WHEN score IS NULL THEN 0 WHEN s.kind = 'api-only' AND axis = 12 THEN 0
                     WHEN axis IN (5, 7, 16, 17, 19) OR (s.kind = 'api-only' AND axis IN (13, 14, 15)) THEN 1
                     ELSE 2 END) AS BIGINT) AS attainable,
       round(sum(score) / (2.0 * count(score)), 6) AS as_coded,
       round(sum(score) / (2.0 * count(*)), 6) AS na_as_0,
       round((sum(score) + 2 * (count(*) - count(score))) / (2.0 * count(*)), 6) AS na_as_2,
       round(sum(CASE WHEN score IS NULL THEN 0 WHEN s.kind = 'api-only' AND axis = 12 THEN 0
                      WHEN axis IN (5, 7, 16, 17, 19) OR (s.kind = 'api-only' AND axis IN (13, 14, 15)) THEN 1
                      ELSE 2 END) / (2.0 * count(score)), 6) AS ceiling
FROM fx_cells c LEFT JOIN fx_subjects s ON c.subject = s.subject GROUP BY c.subject, s.kind""")
def a1(spark, d):
    return _rounded(_scores(spark, d), "as_coded", "na_as_0", "na_as_2", "ceiling")


_PIVOT = ", ".join(f"max(CASE WHEN axis = {a} THEN score END) AS axis_{a}" for a in range(1, 23))


@query("a2_by_subject", f"SELECT subject, {_PIVOT} FROM fx_cells GROUP BY subject")
def a2(spark, d):
    return scoring.by_subject(frame(spark, d, "fx_cells"))


@query("a3_constant_axes", """
SELECT axis, kind, any_value(score) AS value, count(score) AS n
FROM fx_cells JOIN fx_subjects USING (subject)
GROUP BY axis, kind HAVING count(DISTINCT score) = 1""")
def a3(spark, d):
    cells = frame(spark, d, "fx_cells").join(frame(spark, d, "fx_subjects").select("subject", "kind"), "subject")
    kinds = ["fully-open", "open-weights", "api-only", "historical-control"]
    out = [scoring.constant_axes(cells.filter(F.col("kind") == k)).withColumn("kind", F.lit(k)) for k in kinds]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("a4_dominates", """
WITH pr AS (SELECT subject AS lo, subject + 1 AS hi FROM fx_subjects),
j AS (SELECT lo, hi, a.axis, a.score AS x, b.score AS y FROM pr
      JOIN fx_cells a ON a.subject = lo JOIN fx_cells b ON b.subject = hi AND b.axis = a.axis)
SELECT lo, hi, coalesce(string_agg(CAST(axis AS VARCHAR), ',' ORDER BY axis) FILTER (WHERE x < y), '') AS below,
       coalesce(string_agg(CAST(axis AS VARCHAR), ',' ORDER BY axis) FILTER (WHERE x > y), '') AS strictly_above,
       count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n_comparable
FROM j GROUP BY lo, hi""")
def a4(spark, d):
    subjects = frame(spark, d, "fx_subjects").select("subject")
    pairs = subjects.select(F.col("subject").alias("lo"), (F.col("subject") + 1).alias("hi"))
    known = pairs.join(subjects, pairs.hi == subjects.subject, "left_semi")
    return scoring.dominates(frame(spark, d, "fx_cells"), known)


@query("a5_ledger_fingerprint", f"""
WITH dg AS (
  SELECT sha256(concat_ws('|', 'cell', subject, axis, coalesce(CAST(score AS VARCHAR), 'None'))) AS d FROM fx_cells
  UNION ALL
  SELECT sha256(concat_ws('|', 'policy', subject, axis, key, coalesce(value, 'None'))) FROM fp_policy)
SELECT count(*) AS n_rows, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {DIGEST_WORDS})) AS fingerprint FROM dg""")
def a5(spark, d):
    return scoring.ledger_fingerprint(frame(spark, d, "fx_cells"), frame(spark, d, "fp_policy"))


_PARTS = {"cells": ("fl_cells", "subject, axis, coalesce(CAST(score AS VARCHAR), 'None')"), "subjects": ("fl_subjects", "subject, kind, repo"), "sources": ("fp_sources", "subject, source"),
          "policy": ("fp_policy", "subject, axis, key, coalesce(value, 'None')"), "warrants": ("fp_warrants", "subject, source, document"),
          "superseded": ("fp_superseded", "subject, address, grp, superseded_by, '[' || array_to_string(still_valid_for, ', ') || ']'")}


def _tree(name, keep=None):
    rows = " UNION ALL ".join(
        f"SELECT CAST(subject AS VARCHAR) AS subject, '{part}' AS part, sha256(concat_ws('|', '{part}', {columns})) AS d FROM {view} WHERE {(keep or {}).get(part, 'TRUE')}"
        for part, (view, columns) in _PARTS.items())
    return f"""{name} AS (SELECT CASE grouping(subject, part) WHEN 0 THEN 'rows' WHEN 1 THEN 'subject' WHEN 2 THEN 'table' ELSE 'root' END AS level, subject, part, count(*) AS n_rows,
   sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {DIGEST_WORDS})) AS digest FROM ({rows}) GROUP BY CUBE (subject, part))"""


@query("a5_digest_tree", f"WITH {_tree('tr')} SELECT * FROM tr")
def a5_tree(spark, d):
    return scoring.digest_tree(ledger(spark, d))


_OTHER = {"sources": "subject % 9 <> 4", "superseded": "subject % 7 <> 2", "warrants": "source NOT LIKE '%7%'"}


@query("a5_ledger_diff", f"""WITH {_tree('tr')}, {_tree('ot', _OTHER)}
SELECT level, subject, part, CASE WHEN h.digest IS NULL THEN 'only there' WHEN t.digest IS NULL THEN 'only here' ELSE 'differing' END AS change
FROM (SELECT *, coalesce(subject, '-') || '/' || coalesce(part, '-') AS node FROM tr) h FULL JOIN (SELECT level AS tl, digest, coalesce(subject, '-') || '/' || coalesce(part, '-') AS node FROM ot) t
  ON t.tl = h.level AND t.node = h.node WHERE h.digest IS DISTINCT FROM t.digest""")
def a5_diff(spark, d):
    here, other = ledger(spark, d), ledger(spark, d)
    for part, keep in _OTHER.items():
        setattr(other, part, getattr(other, part).where(keep))
    return scoring.ledger_diff(scoring.digest_tree(here), scoring.digest_tree(other))


@query("a6_cover_fingerprint", f"""
WITH dg AS (SELECT sha256(url || '|' || sha256) AS d FROM (SELECT DISTINCT url, sha256 FROM fx_evidence))
SELECT count(*) AS n_rows, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {DIGEST_WORDS})) AS fingerprint FROM dg""")
def a6(spark, d):
    return scoring.cover_fingerprint(frame(spark, d, "fx_evidence"))


@query("a7_score_band_spread", """
SELECT subject, round(sum(score) / (2.0 * count(score)), 6) AS as_coded,
       round(sum(score) / (2.0 * count(*)), 6) AS na_as_0,
       round((sum(score) + 2 * (count(*) - count(score))) / (2.0 * count(*)), 6) AS na_as_2,
       round((count(*) - count(score)) / (1.0 * count(*)), 6) AS spread
FROM fx_cells GROUP BY subject""")
def a7(spark, d):
    return _rounded(scoring.score_band_spread(_scores(spark, d)), "as_coded", "na_as_0", "na_as_2", "spread")


@query("a8_claimed_collapse", """
SELECT subject, round(avg(score) / 2, 6) AS base,
       round(avg(CASE WHEN score = 1 THEN 2 ELSE score END) / 2, 6) AS collapsed,
       round((avg(CASE WHEN score = 1 THEN 2 ELSE score END) - avg(score)) / 2, 6) AS movement,
       NOT bool_or(coalesce(score = 1, FALSE)) AS unmoved
FROM fx_cells GROUP BY subject""")
def a8(spark, d):
    return _rounded(sensitivity.claimed_collapse(_scores(spark, d)), "base", "collapsed", "movement")


@query("a9_order_transitions", SCORED + """,
k AS (SELECT subject, total, n, total + ones AS t2 FROM sc)
SELECT count(*) FILTER (WHERE x.total * y.n <> y.total * x.n AND x.t2 * y.n = y.t2 * x.n) AS collapsed,
       count(*) FILTER (WHERE x.total * y.n = y.total * x.n AND x.t2 * y.n <> y.t2 * x.n) AS separated,
       count(*) FILTER (WHERE sign(x.total * y.n - y.total * x.n) * sign(x.t2 * y.n - y.t2 * x.n) < 0) AS reversed
FROM k x JOIN k y ON x.subject < y.subject""")
def a9(spark, d):
    return sensitivity.order_transitions(_keys(spark, d), "as_coded", "collapsed")


@query("a10_strict_inversions", SCORED + """
SELECT count(*) AS inversions FROM sc x JOIN sc y ON x.total * y.n < y.total * x.n
 AND (x.total + 2 * (x.m - x.n)) * y.m > (y.total + 2 * (y.m - y.n)) * x.m""")
def a10(spark, d):
    return sensitivity.strict_inversions(_keys(spark, d), "as_coded", "na_as_2")


@query("a11_weight_sweep", SCORED + """,
w AS (SELECT w10, kind, subject, (20 * twos + w10 * ones) / (20.0 * n) AS f FROM sc, range(21) t(w10)),
p AS (SELECT w10, min(f) FILTER (WHERE kind = 'fully-open') AS lo, max(f) FILTER (WHERE kind = 'open-weights') AS hi,
             min(f) FILTER (WHERE subject = 3) AS nm FROM w GROUP BY w10)
SELECT count(*) AS n_weights, count(*) FILTER (WHERE lo > hi) AS stratum_holds,
       count(*) FILTER (WHERE nm > hi) AS subject_holds FROM p""")
def a11(spark, d):
    return sensitivity.weight_sweep(_scores(spark, d), "fully-open", "open-weights", named_subject=3)


@query("a12_leave_k_axes_out", """
WITH dr AS (SELECT a.i AS i, b.i AS j, c.i AS k FROM range(1, 23) a(i), range(1, 23) b(i), range(1, 23) c(i)
            WHERE a.i < b.i AND b.i < c.i),
v AS (SELECT subject, sum(score) AS t, count(score) AS n, max(CASE WHEN score IS NULL THEN NULL ELSE 1 END) AS o FROM fx_cells GROUP BY subject),
u AS (SELECT i, j, k, v.subject, v.t, v.n, v.t - coalesce(sum(c.score), 0) AS t2, v.n - count(c.score) AS n2
      FROM dr, v LEFT JOIN fx_cells c ON c.subject = v.subject AND c.axis IN (i, j, k) GROUP BY i, j, k, v.subject, v.t, v.n),
g AS (SELECT i, j, k, CAST(t AS DOUBLE) / n AS b, CAST(t * 232792560 / n AS BIGINT) AS bk,
             CAST(t2 * CAST(232792560 / n2 AS BIGINT) AS BIGINT) AS s FROM u),
h AS (SELECT i, j, k, bk, min(s) AS lo, max(s) AS hi FROM g GROUP BY ALL),
f AS (SELECT i, j, k, lo, max(hi) OVER (PARTITION BY i, j, k ORDER BY bk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM h),
z AS (SELECT i, j, k, coalesce(bool_or(m > lo), FALSE) AS inv FROM f GROUP BY ALL)
SELECT count(*) AS n_drops, count(*) FILTER (WHERE inv) AS n_inverted,
       CAST(min(i * 10000 + j * 100 + k) FILTER (WHERE inv) AS VARCHAR) AS first_drop FROM z""")
def a12(spark, d):
    return sensitivity.leave_k_axes_out(_vectors(spark, d), k=3)


@query("a13_separation_depth", """
WITH v AS (SELECT c.subject, s.kind, sum(score) AS t, count(score) AS n FROM fx_cells c JOIN fx_subjects s USING (subject) GROUP BY ALL),
u AS (SELECT a.i, v.kind, v.t - coalesce(c.score, 0) AS t2, v.n - (CASE WHEN c.score IS NULL THEN 0 ELSE 1 END) AS n2
      FROM range(1, 23) a(i), v LEFT JOIN fx_cells c ON c.subject = v.subject AND c.axis = a.i),
p AS (SELECT i, min(CAST(t2 * CAST(232792560 / n2 AS BIGINT) AS BIGINT)) FILTER (WHERE kind = 'fully-open') AS lo,
             max(CAST(t2 * CAST(232792560 / n2 AS BIGINT) AS BIGINT)) FILTER (WHERE kind = 'open-weights') AS hi FROM u GROUP BY i)
SELECT 1 AS k, 1 AS searched_to, count(*) FILTER (WHERE lo = hi) AS ties, count(*) FILTER (WHERE lo < hi) AS inversions FROM p""")
def a13(spark, d):
    return sensitivity.separation_depth(_vectors(spark, d), "fully-open", "open-weights")


@query("a14_stratum_dominance", SCORED + """,
p AS (SELECT (SELECT subject FROM sc WHERE kind = 'fully-open' ORDER BY CAST(total AS DOUBLE) / n, subject LIMIT 1) AS lo,
             (SELECT subject FROM sc WHERE kind = 'open-weights' ORDER BY CAST(total AS DOUBLE) / n DESC, subject LIMIT 1) AS hi),
j AS (SELECT lo, hi, a.axis, a.score AS x, b.score AS y FROM p
      JOIN fx_cells a ON a.subject = lo JOIN fx_cells b ON b.subject = hi AND b.axis = a.axis)
SELECT lo, hi, coalesce(string_agg(CAST(axis AS VARCHAR), ',' ORDER BY axis) FILTER (WHERE x < y), '') AS below,
       coalesce(string_agg(CAST(axis AS VARCHAR), ',' ORDER BY axis) FILTER (WHERE x > y), '') AS strictly_above,
       count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n_comparable
FROM j GROUP BY lo, hi""")
def a14(spark, d):
    extremes = sensitivity.stratum_extremes(_keys(spark, d), "fully-open", "open-weights")
    return scoring.dominates(frame(spark, d, "fx_cells"), extremes)


@query("a15_axis_correlation", """
WITH j AS (SELECT a.axis AS axis_a, b.axis AS axis_b, a.score AS x, b.score AS y FROM fx_cells a
           JOIN fx_cells b ON a.subject = b.subject AND a.axis < b.axis
           WHERE a.score IS NOT NULL AND b.score IS NOT NULL)
SELECT axis_a, axis_b, count(*) AS n, round(corr(x, y), 6) AS r, abs(corr(x, y)) >= 0.9 AS redundant
FROM j GROUP BY axis_a, axis_b HAVING count(*) >= 8 AND min(x) < max(x) AND min(y) < max(y)""")
def a15(spark, d):
    return _rounded(sensitivity.axis_correlation(_vectors(spark, d)), "r")


@query("a16_zero_coverage", """
SELECT count(*) AS zeros, count(*) FILTER (WHERE has_bound) AS bounded_zeros,
       count(*) FILTER (WHERE NOT has_bound AND note <> '') AS unbounded_notes,
       round(100.0 * count(*) FILTER (WHERE has_bound) / greatest(1, count(*)), 6) AS pct_bounded
FROM fx_cells WHERE score = 0""")
def a16(spark, d):
    return _rounded(scoring.zero_coverage(frame(spark, d, "fx_cells")), "pct_bounded")


@query("a18_cap_and_bridge_tables", """
SELECT axis, kind, count(score) AS n_live,
       least(CASE WHEN axis IN (5, 7, 16, 17, 19) THEN 1 ELSE 2 END,
             CASE WHEN kind = 'api-only' AND axis = 12 THEN 0 WHEN kind = 'api-only' AND axis IN (13, 14, 15) THEN 1 ELSE 2 END) AS max_score,
       count(score) * least(CASE WHEN axis IN (5, 7, 16, 17, 19) THEN 1 ELSE 2 END,
             CASE WHEN kind = 'api-only' AND axis = 12 THEN 0 WHEN kind = 'api-only' AND axis IN (13, 14, 15) THEN 1 ELSE 2 END) AS attainable,
       (CASE WHEN axis IN (4, 12) THEN 0 ELSE 2 END) + (CASE WHEN axis = 4 THEN 2 WHEN axis = 12 THEN 5 WHEN axis = 13 THEN 3
         WHEN axis = 18 THEN 2 WHEN axis = 2 THEN 2 WHEN axis = 14 THEN 3 WHEN axis = 15 THEN 2 WHEN axis IN (3, 6, 16, 17) THEN 1 ELSE 0 END) AS n_methods,
       CASE axis WHEN 6 THEN 'repo_tree_probe' WHEN 12 THEN 'hf_probe.weight_object' WHEN 13 THEN 'hf_probe.all_shard_digests' END AS required_method,
       CASE axis WHEN 6 THEN 4 WHEN 12 THEN 3 WHEN 13 THEN 2 ELSE 0 END AS n_required_fields,
       axis = 12 AND kind = 'api-only' AS determined
FROM fx_cells JOIN fx_subjects USING (subject) GROUP BY axis, kind""")
def a18(spark, d):
    return scoring.caps_and_bridges(frame(spark, d, "fx_cells"), frame(spark, d, "fx_subjects"))
