"""URL filter with redirect equivalence.

Longest-prefix rules judge a url by its host suffix and path prefix.  A url that no rule fits
takes over the decision of its aliases: pages connected by redirect and canonical-link edges
form one component (distributed connected components), and an explicit allow anywhere in it
takes precedence over any block in it.  A url's own rule always wins over what aliases say.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule, has no
aliases and is allowed.  A line feed anywhere in a url, before ``://`` too, is an ordinary character.
Urls of any length are read whole.  Null html declares nothing.  Repeated urls share one node and every row
is judged.  Self-links add nothing.  Other columns of ``pages`` are ignored.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledger.llm.common import connected_components, lower_ascii, materialise

# The production rule list, (action, host and path prefix).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = _after_scheme(url)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def url_key(url: Column) -> Column:
    """Node of a url in the alias graph: its host and path, as they are judged, and its query; scheme and fragment are dropped.

    An empty path and ``/`` are two nodes, because rules tell them apart.
    """
    host, path = host_and_path(url)
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, query))


def best_rule(host: Column, path: Column, rules=None) -> Column:
    """Longest rule string that fits, or null.  The rule list is part of the plan, so keep it short."""
    fits = []
    for _, rule in sorted(rules or RULES, key=lambda r: (-len(r[1]), r[1])):
        name, prefix = rule[: rule.index("/")], rule[rule.index("/"):]
        on_host = (host == name) | F.endswith(host, F.lit("." + name))
        fits.append(F.when(on_host & F.startswith(path, F.lit(prefix)), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def action_of(rule: Column, rules=None) -> Column:
    out = F.lit(None).cast("string")
    for action, text in rules or RULES:
        out = F.when(rule == text, F.lit(action)).otherwise(out)
    return out


def _resolve(target: Column, url: Column) -> Column:
    """Absolute form of a link found in the page at ``url``."""
    target = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    site = F.regexp_extract(url, r"^([^?#]*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^([^?#]*?://[^?#]*/)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .when((target == "") | target.rlike("^[#?]|^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(folder != "", F.concat(folder, target))
        .otherwise(F.concat(site, F.lit("/"), target))
    )


def declared_aliases(pages: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` of url keys from canonical links and meta-refresh redirects in the html."""
    links = F.filter(F.regexp_extract_all("html", F.lit(r"(?i)(<link\b[^>]*>)"), 1),
                     lambda tag: tag.rlike(r"""(?i)\brel\s*=\s*["']?canonical\b"""))
    links = F.transform(links, lambda tag: F.regexp_extract(tag, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    metas = F.filter(F.regexp_extract_all("html", F.lit(r"(?i)(<meta\b[^>]*>)"), 1),
                     lambda tag: tag.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""))
    metas = F.transform(metas, lambda tag: F.regexp_extract(tag, r"""(?i)\burl\s*=\s*([^"'>;\s]+)""", 1))
    found = pages.select("url", F.explode(F.concat(links, metas)).alias("target"))
    found = found.select("url", _resolve(F.col("target"), F.col("url")).alias("target"))
    return found.select(url_key(F.col("url")).alias("a"), url_key(F.col("target")).alias("b"))


def judge(pages: DataFrame, rules=None, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, decided_by`` for every row of ``pages(page_id, url, html)``.

    ``redirects(source, target)`` adds edges known from fetch logs to those the html declares.
    ``decided_by`` is ``rule``, ``alias`` or ``default``.
    """
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), url_key(F.col("url")).alias("key"))
    judged = judged.withColumn("rule", best_rule(F.col("host"), F.col("path"), rules))
    edges = declared_aliases(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.union(redirects.select(url_key(F.col("source")), url_key(F.col("target"))))
    edges = materialise(edges.where("a is not null and b is not null and a != b").distinct())
    nodes = connected_components(edges)
    ruled = nodes.select("component", F.regexp_extract("node", "^([^/?]*)", 1).alias("host"),
                         F.regexp_extract("node", r"^[^/?]*([^?]*)", 1).alias("path"))
    ruled = ruled.select("component", best_rule(F.col("host"), F.col("path"), rules).alias("rule"))
    decided = ruled.select("component", action_of(F.col("rule"), rules).alias("action")).groupBy("component").agg(
        F.max(F.col("action") == "allow").alias("some_allow"), F.max(F.col("action") == "block").alias("some_block"))
    alias = nodes.join(decided, "component").select(
        F.col("node").alias("key"), F.when(F.col("some_allow"), "allow").when(F.col("some_block"), "block").alias("of_aliases"))
    own = action_of(F.col("rule"), rules)
    return judged.join(alias, "key", "left").select(
        "page_id", "host", "path", "rule", F.coalesce(own, "of_aliases", F.lit("allow")).alias("verdict"),
        F.when(own.isNotNull(), "rule").when(F.col("of_aliases").isNotNull(), "alias").otherwise("default").alias("decided_by"))
