"""Ownership policy queries over the stand-in ledger with injected defects."""

from pyspark.sql import functions as F

from veriledger.operators import ownership, replay, validation
from veriledger.plans import q_validation
from veriledger.plans.catalog import query
from veriledger.plans.fixtures import frame
from veriledger.plans.q_validation import OKAY, ledger

# cells that must pass the gate, and the ones that get past O1 and O2
GATED = "(coalesce(c.score <> 0, FALSE) OR c.has_bound)"
O1_OK = "c.subject IN (SELECT subject FROM fl_subjects) AND c.subject IN (SELECT subject FROM fp_sources)"
HAS = "EXISTS (SELECT 1 FROM fp_policy p WHERE p.subject = c.subject AND p.axis = c.axis AND p.key = '{}')"
O2_OK = f"({O1_OK}) AND (coalesce(c.score = 0, TRUE) OR {HAS.format('axis_sources')})"


def _o(rule, detail, rest):
    return f"SELECT '{rule}' AS rule, CAST(subject AS VARCHAR) AS subject, axis, CAST({detail} AS VARCHAR) AS detail FROM ({rest})"


def _declared(rule, key, got):
    return _o(rule, "coalesce(got, 'None') || ' not ' || coalesce(want, 'None')", f"""
        SELECT DISTINCT c.cell_no, c.subject, c.axis, {got} AS got, p.value AS want FROM fl_cells c
        JOIN fp_policy p ON p.subject = c.subject AND p.axis = c.axis AND p.key = '{key}'
        WHERE c.score <> 0 AND {O2_OK} AND {got} IS DISTINCT FROM p.value""")


def _diff(rule, body, item):
    return _o(rule, "'extra ' || ne || ' ' || coalesce(e, '-') || ' missing ' || nm || ' ' || coalesce(m, '-')", f"""
        SELECT cell_no, subject, axis, count(*) FILTER (WHERE l > r) AS ne, min({item}) FILTER (WHERE l > r) AS e,
               count(*) FILTER (WHERE r > l) AS nm, min({item}) FILTER (WHERE r > l) AS m
        FROM (SELECT cell_no, subject, axis, {item}, sum(l) AS l, sum(r) AS r FROM ({body}) GROUP BY ALL) WHERE l <> r GROUP BY ALL""")


SQL = {
    "o1_undeclared_subject": _o("O1", "d", f"""SELECT c.subject, c.axis, CASE WHEN c.subject NOT IN (SELECT subject FROM fl_subjects) THEN 'undeclared' ELSE 'no sources' END AS d
        FROM fl_cells c WHERE {GATED} AND NOT ({O1_OK})"""),
    "o2_no_axis_sources": _o("O2", "score", f"SELECT c.subject, c.axis, c.score FROM fl_cells c WHERE c.score <> 0 AND {O1_OK} AND NOT {HAS.format('axis_sources')}"),
    "o3_source_not_for_axis": _o("O3", "d", f"""
        SELECT subject, axis, CASE WHEN NOT EXISTS (SELECT 1 FROM fp_sources x WHERE x.subject = u.subject AND x.source = u.k) THEN k || ' undeclared'
          ELSE k || ' for axes ' || coalesce((SELECT string_agg(DISTINCT CAST(p.axis AS VARCHAR), ',' ORDER BY lpad(CAST(p.axis AS VARCHAR), 2, '0')) FROM fp_policy p
             WHERE p.key = 'axis_sources' AND p.subject = u.subject AND p.value = k), 'none') END AS d
        FROM (SELECT DISTINCT e.subject, e.axis, 'host:' || regexp_extract(e.url, '//([^/]*)', 1) AS k FROM fl_evidence e JOIN fl_cells c ON c.cell_no = e.cell_no
              WHERE {GATED} AND {O2_OK} AND coalesce(c.check_method, c.bound_method, '') <> 'reproduction_search') u
        WHERE NOT EXISTS (SELECT 1 FROM fp_sources x WHERE x.subject = u.subject AND x.source = u.k)
           OR (EXISTS (SELECT 1 FROM fp_policy p WHERE p.key = 'axis_sources' AND p.subject = u.subject AND p.axis = u.axis)
               AND NOT EXISTS (SELECT 1 FROM fp_policy p WHERE p.key = 'axis_sources' AND p.subject = u.subject AND p.axis = u.axis AND p.value = k))"""),
    "o4_document_sets": _o("O4", "'no axis_documents'", f"""SELECT c.subject, c.axis FROM fl_cells c WHERE {O2_OK} AND NOT {HAS.format('axis_documents')}
        AND (coalesce(c.score <> 0, FALSE) OR (c.has_bound AND c.cell_no IN (SELECT cell_no FROM fl_evidence)))""")
        + " UNION ALL " + _diff("O4", f"""
        SELECT DISTINCT c.cell_no, c.subject, c.axis, e.url, 1 AS l, 0 AS r FROM fl_cells c JOIN fl_evidence e ON e.cell_no = c.cell_no WHERE {O2_OK} AND {HAS.format('axis_documents')}
        UNION ALL SELECT DISTINCT c.cell_no, c.subject, c.axis, p.value, 0, 1 FROM fl_cells c JOIN fp_policy p ON p.subject = c.subject AND p.axis = c.axis AND p.key = 'axis_documents' WHERE {O2_OK}""", "url"),
    "o5_missing_policy_key": _o("O5", "k", f"SELECT c.subject, c.axis, k FROM fl_cells c, (VALUES ('axis_method'), ('axis_literals')) t(k) WHERE c.score <> 0 AND {O2_OK} AND NOT EXISTS (SELECT 1 FROM fp_policy p WHERE p.subject = c.subject AND p.axis = c.axis AND p.key = k)"),
    "o6_method_differs": _declared("O6", "axis_method", "c.check_method"),
    "o7_digest_differs": _declared("O7", "axis_evidence_sha256", "c.check_fields['expect_evidence_sha256']"),
    "o8_file_differs": _declared("O8", "axis_file", "c.check_fields['expect_file']"),
    "o9_literals_differ": _diff("O9", f"""
        SELECT c.cell_no, c.subject, c.axis, unnest(check_expect) AS lit, 1 AS l, 0 AS r FROM fl_cells c WHERE c.score <> 0 AND {O2_OK} AND {HAS.format('axis_literals')}
        UNION ALL SELECT c.cell_no, c.subject, c.axis, p.value, 0, 1 FROM fl_cells c JOIN fp_policy p ON p.subject = c.subject AND p.axis = c.axis AND p.key = 'axis_literals' WHERE c.score <> 0 AND {O2_OK}""", "lit"),
}

for _name, _sql in SQL.items():
    _rule = _name.split("_")[0].upper()
    query(_name, _sql)(lambda spark, d, r=_rule: ownership.ownership_rule(ledger(spark, d), r))

_ALL = " UNION ALL ".join(f"SELECT subject, axis FROM ({sql})" for sql in SQL.values())
_FIELDS = {"grep_retrieved": ["expect"], "hf_probe.weight_object": ["expect_range_bytes", "expect_file", "expect_evidence_sha256"],
           "hf_probe.all_shard_digests": ["expect_shards", "expect_evidence_sha256"],
           "repo_tree_probe": ["expect_repo", "expect_commit", "expect_paths", "expect_evidence_sha256"],
           "reproduction_search": ["expect_subject_name", "expect_queries", "expect_total_results", "expect_adjudicated_positive", "expect_response_digests"]}
_MISSING = " ".join(
    f"WHEN m = '{m}' AND NOT coalesce(list_contains(map_keys(f), '{x}'), FALSE) THEN 'missing {x}'" for m, fields in _FIELDS.items() for x in fields
)


GATE = f"""
WITH own AS (SELECT DISTINCT subject, axis FROM ({_ALL})),
dbl AS (SELECT DISTINCT cell_no FROM fl_evidence WHERE sha256 IN (SELECT sha256 FROM fl_evidence GROUP BY sha256 HAVING count(DISTINCT url) > 1)),
g AS (SELECT c.cell_no, c.subject, c.axis, c.score, coalesce(c.check_method, c.bound_method, '') AS m,
             CASE WHEN has_bound THEN bound_fields ELSE check_fields END AS f FROM fl_cells c WHERE {GATED}),
z AS (SELECT cell_no, subject, axis, score, CASE
        WHEN EXISTS (SELECT 1 FROM own WHERE own.subject = CAST(g.subject AS VARCHAR) AND own.axis = g.axis) THEN 'ownership'
        WHEN cell_no IN (SELECT cell_no FROM dbl) THEN 'digest under two urls'
        WHEN score = 1 THEN NULL
        WHEN (axis = 6 AND m <> 'repo_tree_probe') OR (axis = 12 AND m <> 'hf_probe.weight_object') OR (axis = 13 AND m <> 'hf_probe.all_shard_digests') THEN 'required method'
        {_MISSING}
        WHEN NOT {OKAY} THEN 'method not permitted'
        WHEN m = 'http_status' THEN 'no executor' END AS reason FROM g)
SELECT *, CASE WHEN reason IS NOT NULL THEN 'fail' WHEN score = 1 THEN 'pass' ELSE 'execute' END AS verdict FROM z"""


@query("o10_gate", GATE)
def o10(spark, d):
    return ownership.gate(ledger(spark, d, keep=True))


# the replayed ledger: bounds that name literals, and the number of artifacts each check requires
REPLAY = f"""
WITH gt AS ({GATE.replace("fl_cells", "fr_cells")}),
st AS (SELECT c.cell_no, CASE WHEN has_bound THEN bound_method ELSE check_method END AS m,
   CASE WHEN has_bound THEN from_json(bound_fields['expect'], '["VARCHAR"]') ELSE check_expect END AS lits,
   CAST((CASE WHEN has_bound THEN bound_fields ELSE check_fields END)['expect_artifacts'] AS BIGINT) AS want FROM fr_cells c WHERE has_check OR has_bound),
ev AS (SELECT e.cell_no, lower(b.body) AS low FROM fl_evidence e LEFT JOIN fr_store b ON b.sha256 = e.sha256),
cn AS (SELECT cell_no, count(*) AS n, count(low) AS nb FROM ev GROUP BY cell_no),
hit AS (SELECT ev.cell_no, bool_or(coalesce(list_bool_and(list_transform(lits, lambda x: contains(low, lower(x)))), FALSE)) AS hit FROM ev JOIN st ON st.cell_no = ev.cell_no GROUP BY ev.cell_no),
ex AS (SELECT st.cell_no, CASE m WHEN 'grep_retrieved' THEN CASE WHEN coalesce(len(lits), 0) = 0 THEN 'nothing expected' WHEN len(list_filter(lits, lambda x: length(trim(x)) < 4)) > 0 THEN 'literal too short'
     WHEN want IS NULL THEN 'artifact count not declared' WHEN coalesce(cn.n, 0) <> want THEN 'artifact count differs' WHEN cn.nb < cn.n THEN 'not archived' WHEN NOT hit THEN 'not in one document' END
   WHEN 'http_range' THEN 'no ranged artifact' WHEN 'repo_tree_probe' THEN 'not one tree' WHEN 'hf_probe.weight_object' THEN 'not a range beside its enumeration' ELSE 'no check frame' END AS why,
   m IN ('grep_retrieved', 'http_range', 'repo_tree_probe', 'hf_probe.weight_object') AS known
   FROM st LEFT JOIN cn ON cn.cell_no = st.cell_no LEFT JOIN hit ON hit.cell_no = st.cell_no),
ge AS (SELECT gt.*, ex.why, ex.known, c.has_bound FROM gt JOIN fr_cells c ON c.cell_no = gt.cell_no LEFT JOIN ex ON ex.cell_no = gt.cell_no),
rp AS (SELECT cell_no, subject, axis, class, CASE WHEN verdict = 'fail' THEN FALSE WHEN class = 'asserted' THEN TRUE WHEN known THEN why IS NULL END AS verdict,
   CASE WHEN verdict = 'fail' THEN reason WHEN class <> 'asserted' THEN why END AS reason
   FROM (SELECT *, unnest(list_filter([CASE WHEN score = 1 THEN 'asserted' END, CASE WHEN score NOT IN (0, 1) THEN 'positive' END, CASE WHEN has_bound THEN 'bounded negative' END], lambda x: x IS NOT NULL)) AS class FROM ge))"""


class ReplayedLedger(q_validation.StandInLedger):
    VIEWS = q_validation.StandInLedger.VIEWS | {"cells": "fr_cells"}


def _replayed(spark, d):
    led = ReplayedLedger(spark, d, keep=True)
    return led, replay.replay(led, frame(spark, d, "fr_store"))


@query("o10_replay", REPLAY + " SELECT * FROM rp")
def o10_replay(spark, d):
    return _replayed(spark, d)[1]


@query("c12_replayed_classes", REPLAY + """
SELECT class, count(*) FILTER (WHERE verdict) AS passed, count(*) FILTER (WHERE NOT verdict) AS failed, count(*) FILTER (WHERE verdict IS NULL) AS unreplayable, count(*) AS n,
  CASE WHEN class = 'bounded negative' THEN (SELECT round(count(*) FILTER (WHERE has_bound) * 100.0 / count(*), 1) FROM fr_cells WHERE score = 0)::DOUBLE END AS coverage_pct FROM rp GROUP BY class""")
def c12_classes(spark, d):
    led, verdicts = _replayed(spark, d)
    return replay.summary(verdicts, led.cells)


@query("o11_settled_blocks", """
SELECT cell_no, subject, axis, coalesce(check_method, bound_method) AS declared_method,
       CASE WHEN has_bound THEN bound_method ELSE check_method END AS asserted_method FROM fl_cells WHERE has_check OR has_bound""")
def o11(spark, d):
    return ownership.settled_blocks(frame(spark, d, "fl_cells"))


@query("o12_cited_by", "SELECT url, subject FROM fl_evidence GROUP BY url, subject")
def o12(spark, d):
    return ownership.cited_by(frame(spark, d, "fl_evidence"))

_EVERY = " UNION ALL ".join(f"SELECT rule, subject, axis, detail FROM ({sql})" for sql in [*(q_validation.SQL | {"v32_foreign_source": q_validation.FOREIGN_USE}).values(), *SQL.values()])


@query("v41_validate", f"SELECT rule, count(*) AS n, min(subject) AS first_subject FROM ({_EVERY}) GROUP BY rule")
def v41(spark, d):
    found = validation.validate(ledger(spark, d, keep=True))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("first_subject"))


@query("v41_defects", f"SELECT * FROM ({_EVERY})")
def v41_defects(spark, d):
    return validation.validate(ledger(spark, d, keep=True))


@query("v41_defects_shown", f"SELECT * FROM ({_EVERY}) ORDER BY rule NULLS FIRST, subject NULLS FIRST, axis NULLS FIRST, detail NULLS FIRST LIMIT 40")
def v41_shown(spark, d):
    return validation.report(validation.validate(ledger(spark, d, keep=True)), 40)
