"""Validation rule queries over the stand-in ledger with injected defects."""

from pyspark.sql import functions as F

from veriledger.operators import validation
from veriledger.plans.catalog import query
from veriledger.plans.fixtures import AS_OF, frame
from veriledger.session import stage


class StandInLedger:
    """The defective ledger; a table is planned only when an operator asks for it."""

    VIEWS = {"subjects": "fl_subjects", "cells": "fl_cells", "evidence": "fl_evidence", "sources": "fp_sources",
             "cited": "fl_cited", "policy": "fp_policy", "warrants": "fp_warrants",
             "superseded": "fp_superseded", "records": "fl_records"}
    BASE = "fl_paged"  # what all cells, evidence and policy are derived from: one pass over the given rows
    as_of = AS_OF

    def __init__(self, spark, d, keep=False):
        self._source = (spark, d)
        self._keep = keep  # whole-ledger runs read each table in many branches: stage it once
        self._staged = {}

    @property
    def bounded_zero_floor(self):
        """One more than the ledger holds, so the coverage rule must fire at every scale."""
        return self._table("fl_cells").filter("score = 0").agg(F.count_if("has_bound") + 1).scalar()

    def _table(self, view):
        if self._keep and not self._staged:
            base = stage(frame(*self._source, self.BASE))
            name = f"staged_{id(self)}_{self.BASE}"
            base.createOrReplaceTempView(name)
            self._staged[self.BASE] = name
        return frame(*self._source, view, self._staged)

    def __getattr__(self, name):
        if name not in self.VIEWS:
            raise AttributeError(name)
        table = self._table(self.VIEWS[name])
        if self._keep:
            table = stage(table)
        setattr(self, name, table)
        return table


def ledger(spark, d, keep=False) -> validation.Ledger:
    return StandInLedger(spark, d, keep)


NA = "(12, 13, 14, 15, 20, 21, 22)"
REG = ("('hf_probe.weight_object', 'hf_probe.corpus_item_digests', 'hf_probe.all_shard_digests', 'http_range', 'http_status', "
       "'api_field', 'grep_retrieved', 'count_in_retrieved', 'hash_compare', 'reproduction_search', "
       "'hf_probe.release_artifacts', 'repo_tree_probe', 'hf_probe.signed_commit')")
NAMES = """(VALUES (1, 'corpus enumerated'), (2, 'corpus content-addressed'), (3, 'corpus committed BEFORE'), (4, 'corpus obtainable'),
 (5, 'membership decidable'), (6, 'training code released'), (7, 'hyperparameters fully specified'), (8, 'seeds published'),
 (9, 'determinism settings specified'), (10, 'environment pinned'), (11, 'data order reproducible'), (12, 'weights released'),
 (13, 'weights content-addressed'), (14, 'weights signed'), (15, 'weights timestamped'), (16, 'bit-identical reproduction reported'),
 (17, 'approximate reproduction reported'), (18, 'eval harness released and versioned'), (19, 'eval/train disjointness checkable'),
 (20, 'fine-tuning data disclosed'), (21, 'preference or reward data disclosed'), (22, 'safety-training procedure disclosed')) nm(id, name)"""
# permitted (method, axis) pairs among the methods that occur in the stand-in ledger
OKAY = """((m = 'grep_retrieved' AND axis NOT IN (4, 12)) OR (m = 'http_range' AND axis IN (4, 12))
 OR (m IN ('hf_probe.weight_object', 'hf_probe.all_shard_digests') AND axis IN (12, 13)) OR (m = 'http_status' AND axis IN (4, 12, 18))
 OR (m = 'repo_tree_probe' AND axis = 6) OR (m = 'reproduction_search' AND axis IN (16, 17)))"""
REQ = """(VALUES ('grep_retrieved', 'expect'), ('hf_probe.weight_object', 'expect_range_bytes'), ('hf_probe.weight_object', 'expect_file'),
 ('hf_probe.weight_object', 'expect_evidence_sha256'), ('hf_probe.all_shard_digests', 'expect_shards'), ('hf_probe.all_shard_digests', 'expect_evidence_sha256'),
 ('repo_tree_probe', 'expect_repo'), ('repo_tree_probe', 'expect_commit'), ('repo_tree_probe', 'expect_paths'), ('repo_tree_probe', 'expect_evidence_sha256'),
 ('reproduction_search', 'expect_subject_name'), ('reproduction_search', 'expect_queries'), ('reproduction_search', 'expect_total_results'),
 ('reproduction_search', 'expect_adjudicated_positive'), ('reproduction_search', 'expect_response_digests')) rq(method, field)"""


def _v(rule, subject, axis, detail, rest):
    return f"SELECT '{rule}' AS rule, CAST({subject} AS VARCHAR) AS subject, CAST({axis} AS INTEGER) AS axis, CAST({detail} AS VARCHAR) AS detail {rest}"


_EV = "FROM fl_evidence e JOIN fl_cells c ON c.cell_no = e.cell_no WHERE c.axis BETWEEN 1 AND 22 AND c.score IN (1, 2)"
_GOOD = "c.axis BETWEEN 1 AND 22 AND c.score IN (0, 1, 2)"
_GRP = "CASE WHEN id <= 5 THEN 1 WHEN id <= 11 THEN 2 WHEN id <= 15 THEN 3 WHEN id <= 19 THEN 4 ELSE 5 END"
_KNOWN = ("EXISTS (SELECT 1 FROM fp_sources x WHERE x.subject = z.subject AND x.source = z.address) OR EXISTS "
          "(SELECT 1 FROM fp_policy p WHERE p.key = 'axis_sources' AND p.subject = z.subject AND p.value = z.address)")

SQL = {
    "v1_undeclared_axis_source": _v("V1", "p.subject", "p.axis", "p.value", """FROM fp_policy p WHERE p.key = 'axis_sources'
        AND p.value NOT IN (SELECT source FROM fp_sources x WHERE x.subject = p.subject)
        AND p.value NOT IN (SELECT source FROM fp_warrants x WHERE x.subject = p.subject)"""),
    "v2_superseded_names_nothing": _v("V2", "z.subject", "NULL", "z.address", f"FROM fp_superseded z WHERE NOT ({_KNOWN})"),
    "v3_draws_on_superseded": _v("V3", "z.subject", "id", "z.address", f"""FROM fp_superseded z, {NAMES}
        WHERE ({_KNOWN}) AND {_GRP} = z.grp AND NOT list_contains(z.still_valid_for, id) AND CASE
          WHEN EXISTS (SELECT 1 FROM fp_policy p WHERE p.key = 'axis_sources' AND p.value IS NOT NULL AND p.subject = z.subject AND p.axis = id)
          THEN EXISTS (SELECT 1 FROM fp_policy p WHERE p.key = 'axis_sources' AND p.subject = z.subject AND p.axis = id AND p.value = z.address)
          ELSE EXISTS (SELECT 1 FROM fp_sources x WHERE x.subject = z.subject AND x.source = z.address) END"""),
    "v4_bad_as_of": _v("V4", "subject", "axis", "x", r"FROM (SELECT subject, axis, CASE WHEN has_bound THEN bound_as_of ELSE check_fields['as_of'] END AS x FROM fl_cells) WHERE x <> '' AND NOT regexp_full_match(x, '\d{4}-\d{2}-\d{2}')"),
    "v5_duplicate_subject": _v("V5", "subject", "NULL", "count(*)", "FROM fl_subjects GROUP BY subject HAVING count(*) > 1"),
    "v6_unknown_axis": _v("V6", "subject", "axis", "''", "FROM fl_cells WHERE axis NOT BETWEEN 1 AND 22"),
    "v7_undeclared_subject": _v("V7", "subject", "axis", "cell_no", "FROM fl_cells WHERE axis BETWEEN 1 AND 22 AND subject NOT IN (SELECT subject FROM fl_subjects)"),
    "v8_duplicate_cell": _v("V8", "subject", "axis", "cell_no || ' after ' || f", "FROM (SELECT subject, axis, cell_no, lag(cell_no) OVER (PARTITION BY subject, axis ORDER BY cell_no) AS f FROM fl_cells WHERE axis BETWEEN 1 AND 22) WHERE f IS NOT NULL"),
    "v9_bad_score": _v("V9", "subject", "axis", "score", "FROM fl_cells WHERE axis BETWEEN 1 AND 22 AND score NOT IN (0, 1, 2)"),
    "v10_na_forbidden": _v("V10", "subject", "axis", "name", f"FROM fl_cells JOIN {NAMES} ON id = axis WHERE score IS NULL AND axis NOT IN {NA}"),
    "v11_na_unexplained": _v("V11", "subject", "axis", "''", "FROM fl_cells WHERE axis BETWEEN 1 AND 22 AND score IS NULL AND trim(coalesce(na_reason, '')) = ''"),
    "v12_positive_without_evidence": _v("V12", "subject", "axis", "score", "FROM fl_cells c WHERE axis BETWEEN 1 AND 22 AND score IN (1, 2) AND NOT EXISTS (SELECT 1 FROM fl_evidence e WHERE e.cell_no = c.cell_no)"),
    "v13_not_http": _v("V13", "e.subject", "e.axis", "e.url", f"{_EV} AND NOT (e.url LIKE 'http://%' OR e.url LIKE 'https://%')"),
    "v14_bad_date": _v("V14", "e.subject", "e.axis", "e.retrieved", f"{_EV} AND coalesce(TRY_CAST(e.retrieved AS DATE) > DATE '{AS_OF}', TRUE)"),
    "v15_volatile_under_two": _v("V15", "e.subject", "e.axis", "e.url", f"""{_EV} AND e.volatile AND c.score = 2 AND coalesce(c.check_method, '') NOT IN
        ('grep_retrieved', 'count_in_retrieved', 'http_range', 'hf_probe.weight_object', 'hf_probe.all_shard_digests')"""),
    "v16_volatile_unexplained": _v("V16", "e.subject", "e.axis", "e.url", f"{_EV} AND e.volatile AND coalesce(e.volatile_reason, '') = ''"),
    "v17_bad_digest": _v("V17", "e.subject", "e.axis", "e.sha256", f"{_EV} AND NOT regexp_full_match(e.sha256, '[0-9a-f]{{64}}')"),
    "v18_above_cap": _v("V18", "subject", "axis", "score || '>' || cap", f"""FROM (SELECT DISTINCT c.cell_no, c.subject, axis, score,
        CASE WHEN axis IN (5, 7, 16, 17, 19) THEN 1 WHEN kind = 'api-only' AND axis = 12 THEN 0 WHEN kind = 'api-only' AND axis IN (13, 14, 15) THEN 1 ELSE 2 END AS cap
        FROM fl_cells c LEFT JOIN fl_subjects s ON s.subject = c.subject WHERE axis BETWEEN 1 AND 22 AND score IN (1, 2)) WHERE score > cap"""),
    "v19_mutable_ref": _v("V19", "e.subject", "e.axis", "e.url", f"{_EV} AND c.score = 2 AND (contains(e.url, '/main/') OR contains(e.url, '/master/') OR contains(e.url, '/HEAD/') OR contains(e.url, '/latest/'))"),
    "v20_two_without_check": _v("V20", "subject", "axis", "''", "FROM fl_cells WHERE axis BETWEEN 1 AND 22 AND score = 2 AND NOT has_check"),
    "v21_unregistered_method": _v("V21", "c.subject", "c.axis", "CASE WHEN check_method = 'http_status' THEN 'http_status has no executor' ELSE check_method END",
        f"FROM fl_cells c WHERE {_GOOD} AND has_check AND (check_method NOT IN {REG} OR check_method IN ('http_status', 'api_field', 'hash_compare'))"),
    "v22_method_not_permitted": _v("V22", "c.subject", "c.axis", "m", f"FROM (SELECT *, check_method AS m FROM fl_cells) c WHERE {_GOOD} AND has_check AND m IN {REG} AND NOT {OKAY}"),
    "v23_required_method": _v("V23", "c.subject", "c.axis", "req", f"""FROM (SELECT *, CASE axis WHEN 6 THEN 'repo_tree_probe' WHEN 12 THEN 'hf_probe.weight_object'
        WHEN 13 THEN 'hf_probe.all_shard_digests' END AS req FROM fl_cells) c WHERE score = 2 AND has_check AND req <> check_method"""),
    "v24_required_field": _v("V24", "subject", "axis", "d", f"""FROM (
        SELECT c.subject, c.axis, 'check.' || field AS d FROM fl_cells c JOIN {REQ} ON rq.method = c.check_method WHERE {_GOOD} AND has_check AND coalesce(check_fields[field], '') IN ('', '[]', '{{}}')
        UNION ALL SELECT c.subject, c.axis, 'bound.' || field FROM fl_cells c JOIN {REQ} ON rq.method = c.bound_method WHERE {_GOOD} AND has_bound AND coalesce(bound_fields[field], '') IN ('', '[]', '{{}}'))"""),
    "v25_empty_expect": _v("V25", "c.subject", "c.axis", "check_method", f"FROM fl_cells c WHERE {_GOOD} AND has_check AND check_method IN ('grep_retrieved', 'count_in_retrieved') AND coalesce(len(check_expect), 0) = 0"),
    "v26_blank_assertion": _v("V26", "subject", "axis", "d", f"""FROM (SELECT c.subject, c.axis, 'asserts' AS d FROM fl_cells c WHERE {_GOOD} AND has_check AND trim(check_asserts) = ''
        UNION ALL SELECT c.subject, c.axis, 'observed' FROM fl_cells c WHERE {_GOOD} AND has_check AND trim(check_observed) = '')"""),
    "v27_bad_bound": _v("V27", "c.subject", "c.axis", "d", f"""FROM (SELECT *, unnest(list_filter([CASE WHEN score <> 0 THEN 'score' END, CASE WHEN m NOT IN {REG} THEN 'unregistered' WHEN NOT {OKAY} THEN 'not permitted' END,
        CASE WHEN trim(bound_asserts) = '' THEN 'asserts' END, CASE WHEN trim(bound_observed) = '' THEN 'observed' END, CASE WHEN trim(bound_as_of) = '' THEN 'as_of' END], lambda t: t IS NOT NULL)) AS d
        FROM (SELECT *, bound_method AS m FROM fl_cells WHERE has_bound)) c WHERE {_GOOD}"""),
    "v28_bound_locations": _v("V28", "subject", "axis", "d", f"""FROM (
        SELECT c.subject, c.axis, 'nothing archived' AS d FROM fl_cells c WHERE {_GOOD} AND has_bound AND coalesce(len(bound_archived), 0) = 0
        UNION ALL SELECT c.subject, c.axis, 'legacy searched' FROM fl_cells c WHERE {_GOOD} AND has_bound AND bound_legacy
        UNION ALL SELECT c.subject, c.axis, 'no evidence' FROM fl_cells c WHERE {_GOOD} AND has_bound AND cell_no NOT IN (SELECT cell_no FROM fl_evidence)
        UNION ALL SELECT subject, axis, 'not archived: ' || u FROM (SELECT DISTINCT c.cell_no, c.subject, c.axis, unnest(bound_archived) AS u FROM fl_cells c WHERE {_GOOD} AND has_bound) b
          WHERE NOT EXISTS (SELECT 1 FROM fl_evidence e WHERE e.cell_no = b.cell_no AND e.url = b.u)
        UNION ALL SELECT subject, axis, 'live and archived: ' || u FROM (SELECT DISTINCT c.cell_no, c.subject, c.axis, unnest(bound_live) AS u FROM fl_cells c WHERE {_GOOD} AND has_bound) b
          WHERE EXISTS (SELECT 1 FROM fl_evidence e WHERE e.cell_no = b.cell_no AND e.url = b.u))"""),
    "v29_url_two_digests": _v("V29", "NULL", "NULL", "url || ' ' || sha256", "FROM (SELECT DISTINCT url, sha256 FROM fl_cited WHERE sha256 IS NOT NULL) WHERE url IN (SELECT url FROM fl_cited GROUP BY url HAVING count(DISTINCT sha256) > 1)"),
    "v30_digest_two_urls": _v("V30", "NULL", "NULL", "sha256 || ' ' || url", "FROM (SELECT DISTINCT url, sha256 FROM fl_cited WHERE url IS NOT NULL) WHERE sha256 IN (SELECT sha256 FROM fl_cited GROUP BY sha256 HAVING count(DISTINCT url) > 1)"),
    "v31_no_sources": _v("V31", "subject", "axis", "score", "FROM fl_cells WHERE score <> 0 AND subject NOT IN (SELECT subject FROM fp_sources)"),
    "v32_foreign_source": _v("V32", "subject", "axis", "k || coalesce(' of ' || owner, '')", """FROM (SELECT u.*, o.subject AS owner FROM (
        SELECT DISTINCT e.subject, e.axis, 'host:' || split_part(split_part(e.url, '//', 2), '/', 1) AS k FROM fl_evidence e JOIN fl_cells c ON c.cell_no = e.cell_no WHERE c.score <> 0) u
        LEFT JOIN (SELECT DISTINCT subject, source FROM fp_sources) o ON o.source = k
        WHERE u.subject IN (SELECT subject FROM fp_sources) AND NOT EXISTS (SELECT 1 FROM fp_sources x WHERE x.subject = u.subject AND x.source = k))"""),
    "v33_missing_pair": _v("V33", "subject", "id", "name", f"FROM (SELECT DISTINCT subject FROM fl_subjects) s, {NAMES} WHERE NOT EXISTS (SELECT 1 FROM fl_cells c WHERE c.subject = s.subject AND c.axis = id)"),
    "v34_bounded_zeros_fell": _v("V34", "NULL", "NULL", "count(*) FILTER (WHERE has_bound) || ' of ' || count(*) || ' floor ' || (count(*) FILTER (WHERE has_bound) + 1)", "FROM fl_cells WHERE score = 0"),
    "v37_determined_yet_positive": _v("V37", "subject", "axis", "score", "FROM fl_cells WHERE axis = 12 AND score > 0 AND subject IN (SELECT subject FROM fl_subjects WHERE kind = 'api-only')"),
    "v39_unknown_subject_field": _v("V39", "subject", "NULL", "k", "FROM (SELECT subject, unnest(json_keys(record)) AS k FROM fl_records) WHERE k NOT IN ('id', 'repo', 'kind', 'sources', 'note')"),
    "v40_two_volatility_flags": _v("V40", "NULL", "NULL", "url || ' ' || f", "FROM (SELECT DISTINCT url, f, count(*) OVER (PARTITION BY url) AS c FROM (SELECT DISTINCT url, coalesce(CAST(volatile AS VARCHAR), 'None') AS f FROM fl_evidence)) WHERE c > 1"),
}

# the rule of whole-ledger runs has one row per use, with the first owner and how many more there are
FOREIGN_USE = _v("V32", "subject", "axis", "k || coalesce(' of ' || owner || CASE WHEN n > 1 THEN ' and ' || (n - 1) || ' more' ELSE '' END, '')", """FROM (SELECT u.*, o.owner, o.n FROM (
        SELECT DISTINCT e.subject, e.axis, 'host:' || split_part(split_part(e.url, '//', 2), '/', 1) AS k FROM fl_evidence e JOIN fl_cells c ON c.cell_no = e.cell_no WHERE c.score <> 0) u
        LEFT JOIN (SELECT source, min(subject) AS owner, count(DISTINCT subject) AS n FROM fp_sources GROUP BY source) o ON o.source = k
        WHERE u.subject IN (SELECT subject FROM fp_sources) AND NOT EXISTS (SELECT 1 FROM fp_sources x WHERE x.subject = u.subject AND x.source = k))""")
RUNS = {"v32_foreign_source": validation.foreign_uses}  # queries that return more than their rule does, over staged tables

for _name, _sql in SQL.items():
    _rule = _name.split("_")[0].upper()
    query(_name, _sql)(lambda spark, d, run=RUNS.get(_name, validation.RULES.get(_rule)), keep=_name in RUNS: run(ledger(spark, d, keep)))


@query("v32_foreign_owners", """
WITH u AS (SELECT DISTINCT e.subject, 'host:' || split_part(split_part(e.url, '//', 2), '/', 1) AS k FROM fl_evidence e JOIN fl_cells c ON c.cell_no = e.cell_no WHERE c.score <> 0)
SELECT DISTINCT source, subject AS owner FROM fp_sources WHERE source IN (SELECT k FROM u WHERE u.subject IN (SELECT subject FROM fp_sources)
  AND NOT EXISTS (SELECT 1 FROM fp_sources x WHERE x.subject = u.subject AND x.source = k))""")
def v32_owners(spark, d):
    return validation.foreign_owners(ledger(spark, d))
