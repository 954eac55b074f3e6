"""DuckDB SQL with the same result as the registered queries that SQL can express."""

from __future__ import annotations

from veriledger.llm.common import LOWER, UPPER
from veriledger.llm.url_aliases import RULES

SHA_OF_NOTHING = "sha256('')"


def _low(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


_RULES = ", ".join(f"('{action}', '{rule}')" for action, rule in RULES)

# Aliases: canonical links and meta refreshes with absolute targets (the tables declare no others).
OP1 = f"""
WITH RECURSIVE rules AS (
  SELECT action, rule, regexp_extract(rule, '^[^/]*') AS rule_host, regexp_extract(rule, '/.*$') AS rule_path
  FROM (VALUES {_RULES}) AS r(action, rule)),
rest AS (
  SELECT page_id, html, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, html, url, {_low("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
links AS (
  SELECT url AS source, unnest(list_concat(
      regexp_extract_all(html, '<link[^>]*rel="?canonical"?[^>]*href="?([^"\\s>]+)', 1),
      regexp_extract_all(html, '<meta[^>]*http-equiv="?refresh"?[^>]*url=([^"''>;\\s]+)', 1))) AS target FROM pages),
keyed AS (
  SELECT regexp_replace(source, '^[^:]*://|#.*$', '', 'g') AS a, regexp_replace(target, '^[^:]*://|#.*$', '', 'g') AS b
  FROM links WHERE contains(target, '://') AND contains(source, '://')),
reach(a, b) AS (
  SELECT a, b FROM keyed UNION SELECT b, a FROM keyed UNION
  SELECT r.a, k.b FROM reach r JOIN (SELECT a, b FROM keyed UNION SELECT b, a FROM keyed) k ON r.b = k.a),
ranked AS (
  SELECT page_id, host, path, rule, action, url,
         row_number() OVER (PARTITION BY page_id, url ORDER BY length(rule) DESC NULLS LAST, rule) AS n
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
aliases AS (
  SELECT r.a AS key, bool_or(action = 'allow') AS some_allow, bool_or(action = 'block') AS some_block
  FROM reach r JOIN rules ON (regexp_extract(r.b, '^[^/?]*') = rule_host OR ends_with(regexp_extract(r.b, '^[^/?]*'), '.' || rule_host))
   AND starts_with(regexp_extract(r.b, '^[^/?]*([^?]*)', 1), rule_path) GROUP BY r.a)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(action, CASE WHEN some_allow THEN 'allow' WHEN some_block THEN 'block' END, 'allow') AS verdict,
       CASE WHEN action IS NOT NULL THEN 'rule' WHEN some_allow OR some_block THEN 'alias' ELSE 'default' END AS decided_by
FROM ranked LEFT JOIN aliases ON key = regexp_replace(url, '^[^:]*://|#.*$', '', 'g') WHERE n = 1"""

OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS first_doc FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT w.doc_id, i FROM w JOIN m USING (s) WHERE first_doc < w.doc_id),
runs AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS is_new FROM gone),
numbered AS (SELECT doc_id, i, sum(is_new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM runs),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, k),
pieces AS (
  SELECT s.doc_id, a, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) + 1,
                             2 * (a - coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0))) AS piece, b
  FROM spans s JOIN d ON d.doc_id = s.doc_id),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY a) AS head, max(b) AS last_end FROM pieces GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN head IS NULL THEN h ELSE head || substr(h, 2 * last_end + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id"""

_WORDS5 = f"list_filter(string_split_regex({_low('coalesce(text, {q})')}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')".replace("{q}", "''")
OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS5} AS w FROM documents),
b AS (SELECT item_id, {_WORDS5} AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS n, w FROM b WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM bw)),
lengths AS (SELECT DISTINCT n FROM items),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, dw.n, i FROM dw JOIN items USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""

_KEY6 = _low("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")
OP6 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT doc_id, i, line, {_KEY6} AS key FROM l),
f AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, last_doc IS NULL OR last_doc = doc_id AS keep FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (NOT keep))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_low("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
sides AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM sides UNION SELECT r.x, s.y FROM reach r JOIN sides s ON r.y = s.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low.y, d.doc_id)) AS component_id,
       coalesce(low.y, d.doc_id) >= d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.x = d.doc_id"""

def _state(cost: str, audit: str, text: str) -> str:
    return f"{{'c': {cost}, 'a': {audit}, 't': {text}}}"


def _edit(letter: str, cost: str, role: str = "", text: str = "''"):
    """SQL of a state after an edit: cost, audit and repaired lines."""
    line = f" || chr(10) || {role} || ':' || {text}" if role else ""
    return lambda s: _state(f"{s}.c + {cost}", f"{s}.a || '{letter}'", f"{s}.t{line}")


_DEL, _KEEP = _edit("D", "2"), _edit("K", "x", "role", "text")
_RE_USER, _RE_ASSISTANT = _edit("R", "1 + x", "'user'", "text"), _edit("R", "1 + x", "'assistant'", "text")
_ADD_USER, _ADD_ASSISTANT = _edit("I", "5", "'user'"), _edit("I", "5", "'assistant'")
_NEVER = _state("1099511627776", "''", "''")


def _if(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


# Cheapest way to each state of the role pattern (0 start, 1 after s, 2 after u, 3 after a), row by row.
_CLOSED = f"""(SELECT *, least(c3, {_ADD_ASSISTANT("d2")}) AS d3
   FROM (SELECT *, least(c2, {_ADD_USER("c0")}, {_ADD_USER("c1")}, {_ADD_USER("c3")}) AS d2 FROM walk) AS z)"""
OP11 = rf"""
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([CAST(b AS UBIGINT)], list_transform(range(8), lambda z: CAST(0 AS UBIGINT))),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END)) AS t),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
harmed AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split(name, ''), lambda h: CAST(unicode(h) AS UBIGINT))),
    lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % 20 AS harm FROM named, steps),
damaged AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM harmed),
placed AS (SELECT conv_id, turn, role, text, substr(role, 1, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(coalesce(CAST(conv_id AS VARCHAR), 'null ') || ':' || length(role) || ':' || role || text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {_state("CAST(0 AS BIGINT)", "''", "''")} AS c0, {_NEVER} AS c1, {_NEVER} AS c2, {_NEVER} AS c3 FROM conversations
  UNION ALL
  SELECT conv_id, i, {_DEL("c0")}, least({_DEL("c1")}, {_if("ok AND initial = 's'", _KEEP("c0"))}),
    least({_DEL("d2")}, {", ".join(_if("ok AND initial = 'u'", _KEEP(s)) for s in ("c0", "c1", "d3"))}, {", ".join(_if("ok", _RE_USER(s)) for s in ("c0", "c1", "d3"))}),
    least({_DEL("d3")}, {_if("ok AND initial = 'a'", _KEEP("d2"))}, {_if("ok", _RE_ASSISTANT("d2"))})
  FROM (SELECT w.conv_id, f.i, c0, c1, d2, d3, role, text, initial, fault NOT IN (1, 2) AS ok, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS x
        FROM {_CLOSED} AS w JOIN faulty AS f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1) AS y),
ends AS (SELECT conv_id, i, least(c0, d3) AS won FROM {_CLOSED} AS w),
counts AS (SELECT conv_id, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, won.c AS cost, won.a AS audit, sha256(substr(won.t, 2)) AS repaired_sha256
FROM ends AS e LEFT JOIN counts AS k ON k.conv_id IS NOT DISTINCT FROM e.conv_id WHERE e.i = coalesce(n, 0)"""

OP12 = """
WITH records AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
ranked AS (SELECT *, payload_bytes >= 100 AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) > 1 AS again,
  first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS lead FROM records)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN lead END AS refers_to FROM ranked"""

ORACLES = {
    "op1_redirect_equivalence": OP1,
    "op2_prefix_interval_dedup": OP2,
    "op5_benchmark_decontamination": OP5,
    "op6_cuckoo_line_dedup": OP6,
    "op10_lsh_forest": OP10,
    "op11_conversation_repair": OP11,
    "op12_legacy_archives": OP12,
}
