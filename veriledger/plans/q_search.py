"""Search funnel and reconciliation queries over the document corpus."""

from pyspark.sql import functions as F

from veriledger.functions import content
from veriledger.operators import funnel, reconcile
from veriledger.plans.catalog import query
from veriledger.plans.fixtures import frame

NAMES = {"mit": "mit license", "apache": "apache license", "ccbync": "cc by-nc", "gnu": "gnu general public"}
TERMS = ["licensed under", "released under", "license", "version", "licensed"]
VERBS = "licens|released|distribut"
SIGNALS = ["licensed under the", "all rights reserved", "version 2", "version 3", "copyright"]
FILTER = ["en", "es"]
ADJACENT = ["fr"]

NM = "(VALUES ('mit', 'mit license'), ('apache', 'apache license'), ('ccbync', 'cc by-nc'), ('gnu', 'gnu general public')) nm(subject, name)"
TM = "(VALUES (1, 'licensed under'), (2, 'released under'), (3, 'license'), (4, 'version'), (5, 'licensed')) tm(k, term)"
HITS = f"ht AS (SELECT subject, name, k, term, id, text, category, title FROM fn_corpus, {NM}, {TM} WHERE contains(lower(text), name) AND contains(lower(text), term))"
CAND = f"{HITS}, cd AS (SELECT DISTINCT subject, name, id, text, category, title FROM ht)"
SENT = CAND + r""", st AS (SELECT *, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM cd),
s2 AS (SELECT subject, name, id, list_filter(ss, lambda s: contains(lower(s), name) AND regexp_matches(s, 'licens|released|distribut', 'i'))[1] AS sentence FROM st),
s2k AS (SELECT * FROM s2 WHERE sentence IS NOT NULL)"""
NEAR = """, ps AS (SELECT subject, id, lower(sentence) AS s, name FROM s2k),
ap AS (SELECT subject, id, i, substr(s, i, length(name)) = name AS is_name, EXISTS (SELECT 1 FROM (VALUES ('licensed under'), ('released under'), ('license'), ('version'), ('licensed')) t(x) WHERE substr(s, i, length(x)) = x) AS is_term
       FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM ps)),
s3 AS (SELECT DISTINCT a.subject, a.id FROM ap a JOIN ap b ON a.subject = b.subject AND a.id = b.id AND a.is_name AND b.is_term AND abs(a.i - b.i) <= 25)"""


def _corpus(spark, d):
    return frame(spark, d, "fn_corpus")


def _texts(spark, d):
    return funnel.candidate_texts(_corpus(spark, d), NAMES, TERMS)


def _stage2(spark, d):
    return funnel.stage2_sentence(_texts(spark, d), VERBS)


@query("n1_probe_matrix", f"""
WITH {HITS} SELECT nm.subject, tm.term, count(id) AS n FROM {NM} CROSS JOIN {TM} LEFT JOIN ht ON ht.subject = nm.subject AND ht.term = tm.term GROUP BY nm.subject, tm.term""")
def n1(spark, d):
    return funnel.probe_matrix(_corpus(spark, d), NAMES, TERMS)


@query("n1_probe_matrix_filtered", f"""
WITH {HITS} SELECT nm.subject, tm.term, count(id) AS n FROM {NM} CROSS JOIN {TM} LEFT JOIN ht ON ht.subject = nm.subject AND ht.term = tm.term AND category IN ('en', 'es') GROUP BY nm.subject, tm.term""")
def n1_filtered(spark, d):
    return funnel.probe_matrix(_corpus(spark, d), NAMES, TERMS, FILTER)


@query("n3_candidates", f"WITH {HITS} SELECT subject, id, arg_min(term, k) AS first_term, count(*) AS n_terms FROM ht GROUP BY subject, id")
def n3(spark, d):
    return funnel.candidates(funnel.probe_hits(_corpus(spark, d), NAMES, TERMS))


@query("n4_stage1_signals", f"""
WITH {CAND}, sg AS (SELECT subject, id, array_to_string(list_filter(['licensed under the', 'all rights reserved', 'version 2', 'version 3', 'copyright'], lambda x: contains(lower(text), x)), ',') AS signals FROM cd)
SELECT * FROM sg WHERE signals <> ''""")
def n4(spark, d):
    return funnel.stage1_signals(_texts(spark, d), SIGNALS).select("subject", "id", F.array_join("signals", ",").alias("signals"))


@query("n5_stage2_sentence", f"WITH {SENT} SELECT subject, id, sentence FROM s2k")
def n5(spark, d):
    return _stage2(spark, d).select("subject", "id", "sentence")


@query("n6_stage3_proximity", f"WITH {SENT}{NEAR} SELECT * FROM s3")
def n6(spark, d):
    return funnel.stage3_proximity(_stage2(spark, d), NAMES, TERMS).select("subject", "id")


@query("n7_screen_recount", f"""
WITH {SENT}{NEAR},
ct AS (SELECT subject, count(*) AS n FROM s3 GROUP BY subject UNION ALL SELECT '*', count(*) FROM s3),
sd AS (SELECT subject, count(*) + (CASE WHEN subject = 'mit' THEN 1 ELSE 0 END) AS n FROM s2k GROUP BY subject UNION ALL SELECT '*', count(*) FROM s2k)
SELECT coalesce(sd.subject, ct.subject) AS subject, sd.n AS stored, coalesce(ct.n, 0) AS recomputed FROM sd FULL JOIN ct ON ct.subject = sd.subject WHERE sd.n IS DISTINCT FROM coalesce(ct.n, 0)""")
def n7(spark, d):
    # the stored figures are those of the earlier screen, one of them miscounted
    screened = _stage2(spark, d)
    stored = screened.rollup("subject").agg(F.count(F.lit(1)).alias("n")).withColumn("subject", F.coalesce("subject", F.lit("*")))
    stored = stored.withColumn("n", F.col("n") + (F.col("subject") == "mit").cast("int"))
    return reconcile.screen_recount(stored, funnel.stage3_proximity(screened, NAMES, TERMS))


@query("n8_truncated_queries", "SELECT subject, term, total, retrieved FROM fn_queries WHERE retrieved < total OR complete IS NOT TRUE")
def n8(spark, d):
    return reconcile.truncated_queries(frame(spark, d, "fn_queries"))


@query("n9_unadjudicated", """
SELECT subject, 'never searched' AS why FROM fx_subjects WHERE subject NOT IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey % 11 <> 0)
UNION ALL SELECT DISTINCT l_suppkey, 'no verdict' FROM lineitem WHERE l_suppkey % 11 <> 0 AND l_suppkey NOT IN (SELECT subject FROM fn_adjudged)
UNION ALL SELECT subject, 'no evidence for hit' FROM fn_adjudged WHERE hit AND (trim(url) = '' OR quote IS NULL)""")
def n9(spark, d):
    searched = frame(spark, d, "lineitem").select(F.col("l_suppkey").alias("subject")).filter("subject % 11 <> 0")
    return reconcile.unadjudicated(frame(spark, d, "fx_subjects"), searched, frame(spark, d, "fn_adjudged"))


_POOL = f"{HITS}, po AS (SELECT DISTINCT subject, '24.' || id AS record FROM ht)"
_STATUS = "SELECT k.case, k.subject, CASE WHEN expect <> 'in_pool' THEN 'out of frame' WHEN po.record IS NULL THEN 'missing' ELSE 'in pool' END AS status FROM fn_known k LEFT JOIN po ON po.subject = k.subject AND po.record = k.record"


def _statuses(spark, d):
    hits = funnel.probe_hits(_corpus(spark, d), NAMES, TERMS)
    found = hits.select("subject", F.concat(F.lit("http://arxiv.org/abs/24."), F.col("id").cast("string"), F.lit("v1")).alias("record_url"))
    return reconcile.recall_control(frame(spark, d, "fn_known"), found)


@query("n10_recall_control", f"WITH {_POOL} {_STATUS}")
def n10(spark, d):
    return _statuses(spark, d)


@query("n10_recall", f"""WITH {_POOL}, s AS ({_STATUS}) SELECT count(*) FILTER (WHERE status <> 'out of frame') AS expected,
 count(*) FILTER (WHERE status = 'in pool') AS found, count(*) FILTER (WHERE status = 'out of frame') AS out_of_frame FROM s""")
def n10_recall(spark, d):
    return reconcile.recall(_statuses(spark, d))


@query("n11_page_total_reconcile", """
WITH g AS (SELECT subject, term, CAST(sum(CASE WHEN doc_id % 20 = 3 AND term <> 'en' THEN 1 ELSE 2 END) AS BIGINT) AS entries, max(total) AS total FROM fn_counted GROUP BY subject, term)
SELECT * FROM g WHERE entries <> total""")
def n11(spark, d):
    pages = frame(spark, d, "fn_counted")
    entries = F.when((F.col("doc_id") % 20 == 3) & (F.col("term") != "en"), 1).otherwise(2)
    return reconcile.page_total_reconcile(pages.select("subject", "term", entries.alias("entries"), "total"))


def _pages(spark, d):
    """One page per (document, subject, term): the ids it lists; some pages cannot be read."""
    hits = funnel.probe_hits(_corpus(spark, d), NAMES, TERMS)
    readable = ~((F.col("subject") == "apache") & (F.col("term") == "version"))
    ids = F.when(readable, F.array(F.col("id").cast("string")))
    pages = hits.select("subject", "term", ids.alias("ids"))
    grid = funnel.probe_matrix(_corpus(spark, d), NAMES, TERMS).filter("n = 0").select("subject", "term", F.array().cast("array<string>").alias("ids"))
    return pages.unionByName(grid)


_SETS = f"""WITH {HITS}, sets AS (SELECT nm.subject, tm.k, tm.term, nm.subject = 'apache' AND tm.term = 'version' AND count(id) > 0 AS unread,
   coalesce(string_agg(DISTINCT CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)), '') AS ids
   FROM {NM} CROSS JOIN {TM} LEFT JOIN ht ON ht.subject = nm.subject AND ht.term = tm.term GROUP BY nm.subject, tm.k, tm.term),
pr AS (SELECT a.k AS i, b.k AS j, a.term AS a, b.term AS b, count(*) FILTER (WHERE NOT a.unread AND NOT b.unread) AS compared,
   count(*) FILTER (WHERE NOT a.unread AND NOT b.unread AND a.ids = b.ids) AS identical, count(*) FILTER (WHERE NOT a.unread AND NOT b.unread AND a.ids = b.ids AND a.ids <> '') AS both_non_empty
   FROM sets a JOIN sets b ON b.subject = a.subject AND b.k > a.k GROUP BY a.k, b.k, a.term, b.term),
pe AS (SELECT *, compared > 0 AND identical = compared AND both_non_empty > 0 AS equivalent FROM pr),
gr AS (SELECT tm.term, coalesce((SELECT arg_min(p.a, p.i) FROM pe p WHERE p.j = tm.k AND p.equivalent), tm.term) AS grp FROM {TM})"""


@query("n12_term_equivalence", _SETS + " SELECT a, b, compared, identical, both_non_empty, equivalent FROM pe")
def n12(spark, d):
    return reconcile.term_pairs(reconcile.term_sets(_pages(spark, d)), TERMS).drop("i", "j")


@query("n12_term_groups", _SETS + " SELECT * FROM gr")
def n12_groups(spark, d):
    return reconcile.term_groups(reconcile.term_pairs(reconcile.term_sets(_pages(spark, d)), TERMS), TERMS)


@query("n12_query_counts", _SETS + """ SELECT (SELECT count(*) FROM gr) AS terms_issued, (SELECT count(DISTINCT grp) FROM gr) AS terms_distinct, (SELECT count(*) FROM sets) AS queries_issued,
 (SELECT count(*) FROM (SELECT DISTINCT subject, grp FROM sets JOIN gr ON gr.term = sets.term WHERE NOT unread)) AS queries_distinct""")
def n12_counts(spark, d):
    sets = reconcile.term_sets(_pages(spark, d))
    return reconcile.query_counts(sets, reconcile.term_groups(reconcile.term_pairs(sets, TERMS), TERMS))


@query("n13_control_pair", _SETS + " SELECT 'licensed' AS a, 'released under' AS b, compared, compared - identical AS differ, compared > 0 AND identical = 0 AS passes FROM pe WHERE i = 2 AND j = 5")
def n13(spark, d):
    return reconcile.control_pair(reconcile.term_pairs(reconcile.term_sets(_pages(spark, d)), TERMS), "licensed", "released under")


_EXCLUDED = f"{CAND}, ex AS (SELECT subject, id, category, title FROM cd WHERE category NOT IN ('en', 'es') AND regexp_matches(text, 'licens|released|distribut', 'i'))"


def _excluded(spark, d):
    filtered = funnel.probe_hits(_corpus(spark, d), NAMES, TERMS, FILTER)
    return reconcile.filter_cost(_texts(spark, d), filtered, VERBS)


@query("n14_filter_cost", f"WITH {_EXCLUDED} SELECT subject, id FROM ex")
def n14(spark, d):
    return _excluded(spark, d).select("subject", "id")


_RANKED = f"""WITH {_EXCLUDED}, g AS (SELECT subject, category, count(*) AS n FROM ex WHERE category IS NOT NULL GROUP BY subject, category),
r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, category) AS r FROM g)"""


@query("n15_category_profile", f"""{_RANKED}
SELECT subject, CAST(sum(n) AS BIGINT) AS excluded, CAST(coalesce(sum(n) FILTER (WHERE category = 'fr'), 0) AS BIGINT) AS adjacent,
       string_agg(category || ':' || n, ',' ORDER BY r) FILTER (WHERE r <= 3) AS top FROM r GROUP BY subject""")
def n15(spark, d):
    return reconcile.category_profile(reconcile.subject_categories(_excluded(spark, d), ADJACENT))


@query("n15_subject_categories", f"""{_RANKED} SELECT subject, category, n, r AS rank, category = 'fr' AS adjacent FROM r""")
def n15_subjects(spark, d):
    return reconcile.subject_categories(_excluded(spark, d), ADJACENT)


_COUNTED = f"WITH {_EXCLUDED} SELECT category, count(DISTINCT id) AS n, coalesce(category = 'fr', FALSE) AS adjacent FROM ex GROUP BY category"


@query("n15_category_counts", _COUNTED)
def n15_counts(spark, d):
    return reconcile.category_counts(_excluded(spark, d), ADJACENT)


@query("n15_category_top", _COUNTED + " ORDER BY n DESC, category LIMIT 14")
def n15_top(spark, d):
    return reconcile.category_top(reconcile.category_counts(_excluded(spark, d), ADJACENT))


@query("n16_filter_bound", f"""
WITH {_EXCLUDED} SELECT subject, count(*) AS excluded, count(*) FILTER (WHERE category = 'fr') AS adjacent, count(*) FILTER (WHERE category = 'fr' AND regexp_matches(title, 'licens|released|distribut', 'i')) AS adjacent_titled FROM ex GROUP BY subject
UNION ALL SELECT '*', count(DISTINCT id), count(DISTINCT id) FILTER (WHERE category = 'fr'), count(DISTINCT id) FILTER (WHERE category = 'fr' AND regexp_matches(title, 'licens|released|distribut', 'i')) FROM ex WHERE category IS NOT NULL""")
def n16(spark, d):
    return reconcile.filter_bound(_excluded(spark, d), ADJACENT, VERBS)


@query("n17_label_from_queries", """
SELECT subject, CASE WHEN subject <> 'src2' THEN subject END AS label, subject = 'src2' AS refused FROM fn_responses GROUP BY subject""")
def n17(spark, d):
    url = F.when((F.col("subject") == "src2") & (F.col("doc_id") % 40 == 2), F.regexp_replace("url", "src2", "other")).otherwise(F.col("url"))
    queries = frame(spark, d, "fn_responses").select("subject", url.alias("url"))
    return reconcile.label_from_queries(queries, ["en", "fr", "de", "es"])


_RUN = """'Searched for ''model ' || r.subject || ''' (hits license=' || r.subject % 9 || '): ' || (r.subject % 50) || ' distinct candidates, ' || (r.subject % 6) || ' kept by the sentence screen. '"""
_FOUND = """'The report is ' || CASE WHEN r.subject % 4 = 1 THEN '(title not recorded)' ELSE 'Report ' || r.subject END || ' at '
   || CASE WHEN trim(r.url) = '' THEN '(address not recorded)' ELSE r.url END || ': ' || coalesce(r.quote, '(quote not recorded)') || '. '"""
_WHY = "coalesce(r.rationale, 'No adjudication recorded.')"
_WORD = "CASE c.axis WHEN 16 THEN 'bit-identical' ELSE 'approximate' END"


def _title(subject):
    return F.when(subject % 4 != 1, F.concat(F.lit("Report "), subject.cast("string")))


@query("n18_route_hits", f"""
WITH z AS (SELECT c.subject, c.axis, c.score, c.note, r.subject IS NULL AS never, r.hit AND r.subject % 4 >= 2 AS unr,
   coalesce(r.hit AND ((r.subject % 4 = 0 AND c.axis = 17) OR r.subject % 4 = 1), FALSE) AS positive,
   CASE WHEN r.hit AND ((r.subject % 4 = 0 AND c.axis = 17) OR r.subject % 4 = 1) THEN 'Found: a third party reports a ' || {_WORD} || ' reproduction. ' || {_RUN} || {_FOUND} ELSE 'Nothing found: no third party reports a ' || {_WORD} || ' reproduction. ' || {_RUN} END || {_WHY} AS nn
   FROM fx_cells c LEFT JOIN fn_adjudged r ON r.subject = c.subject WHERE c.axis IN (16, 17))
SELECT subject, axis, score, positive, CASE WHEN never THEN 'never searched' WHEN unr THEN 'unroutable hit' END AS blocked,
       CASE WHEN NOT never AND NOT unr THEN nn END AS new_note, CASE WHEN NOT never AND NOT unr THEN nn IS DISTINCT FROM note END AS changed FROM z""")
def n18(spark, d):
    subject = F.col("subject")
    records = frame(spark, d, "fn_adjudged").select(
        "subject", "hit", "affects", "rationale", F.concat(F.lit("model "), subject.cast("string")).alias("name"),
        F.concat(F.lit("license="), (subject % 9).cast("string")).alias("totals"),
        (subject % 50).alias("n_candidates"), (subject % 6).alias("n_screened"), _title(subject).alias("title"), "url", "quote",
    )
    return reconcile.route_hits(frame(spark, d, "fx_cells"), records)


@query("p19_render_note", f"""
SELECT r.subject, c.axis, CASE WHEN r.hit THEN 'Found: a third party reports a ' || {_WORD} || ' reproduction. ' || {_RUN} || {_FOUND}
  ELSE 'Nothing found: no third party reports a ' || {_WORD} || ' reproduction. ' || {_RUN} END || {_WHY} AS note
FROM fn_adjudged r JOIN fx_cells c ON c.subject = r.subject AND c.axis IN (16, 17)""")
def p19(spark, d):
    subject = F.col("subject")
    cells = frame(spark, d, "fx_cells").filter("axis in (16, 17)").select("subject", "axis")
    joined = frame(spark, d, "fn_adjudged").join(cells, "subject")
    note = content.render_note(
        F.col("axis"), F.concat(F.lit("model "), subject.cast("string")), F.col("hit"), F.concat(F.lit("license="), (subject % 9).cast("string")),
        subject % 50, subject % 6, F.col("rationale"), _title(subject), F.col("url"), F.col("quote"),
    )
    return joined.select("subject", "axis", note.alias("note"))


@query("n19_adjudication_consistency", """
SELECT a.subject, a.hit, coalesce(c.score <> 0, FALSE) AS scored FROM fn_adjudged a JOIN fx_cells c ON c.subject = a.subject AND c.axis = 17 WHERE a.hit <> coalesce(c.score <> 0, FALSE)""")
def n19(spark, d):
    return reconcile.adjudication_consistency(frame(spark, d, "fn_adjudged"), frame(spark, d, "fx_cells"))
