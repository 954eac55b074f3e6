"""Column functions over cited addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the pinned address shapes the checks understand
PIN_MODEL_REVISION = r"^https://huggingface\.co/api/models/([^/]+/[^/]+)/revision/([0-9a-f]{40})$"
PIN_DATASET_TREE = r"^https://huggingface\.co/api/datasets/([^/]+/[^/]+)/tree/([0-9a-f]{40})(?:/(.+))?$"
PIN_FILE = r"^https://huggingface\.co/([^/]+/[^/]+)/(?:raw|resolve)/([0-9a-f]{40})/(.+)$"
PIN_SOURCE_TREE = r"^https://api\.github\.com/repos/([^/]+/[^/]+)/git/trees/([0-9a-f]{40})\?recursive=1$"
MUTABLE_REF = r"/(main|master|HEAD|latest)/"
QUERY_TERM = r'abs:"([^"]+)"'
RECORD_ID = r"arxiv\.org/abs/([0-9]+\.[0-9]+)"


def _after_scheme(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)^.*?//", "")


def url_host(url: Column) -> Column:
    return F.split_part(_after_scheme(url), F.lit("/"), F.lit(1))


def source_key(url: Column) -> Column:
    """The publishing source an address belongs to (``hf:``, ``hfds:``, ``gh:``, ``arxiv:``, ``host:``)."""
    host = url_host(url)
    path = F.filter(F.split(_after_scheme(url), "/"), lambda part, i: (i > 0) & (part != ""))

    def pair(start: int) -> Column:
        return F.array_join(F.slice(path, start, 2), "/")

    first, second = F.get(path, F.lit(0)), F.get(path, F.lit(1))
    hub = (
        F.when(first == "api", F.concat(F.when(second == "models", F.lit("hf:")).otherwise(F.lit("hfds:")), pair(3)))
        .when(first == "datasets", F.concat(F.lit("hfds:"), pair(2)))
        .otherwise(F.concat(F.lit("hf:"), pair(1)))
    )
    return (
        F.when(host == "huggingface.co", hub)
        .when(host.isin("raw.githubusercontent.com", "github.com"), F.concat(F.lit("gh:"), pair(1)))
        .when(host == "api.github.com", F.concat(F.lit("gh:"), pair(2)))
        .when(host == "arxiv.org", F.concat(F.lit("arxiv:"), F.coalesce(F.get(path, F.size(path) - 1), F.lit(""))))
        .otherwise(F.concat(F.lit("host:"), host))
    )


def is_web_url(url: Column) -> Column:
    return F.coalesce(url.rlike("^https?://"), F.lit(False))


def is_mutable_ref(url: Column) -> Column:
    return url.rlike(MUTABLE_REF)


def parse_pinned_url(url: Column) -> Column:
    """``struct(shape, repo, revision, path)``; all null when the address pins nothing."""
    shapes = [
        ("model_revision", PIN_MODEL_REVISION, 2),
        ("dataset_tree", PIN_DATASET_TREE, 3),
        ("file", PIN_FILE, 3),
        ("source_tree", PIN_SOURCE_TREE, 2),
    ]

    def field(group: int | None) -> Column:
        out = F.lit(None).cast("string")
        for shape, pattern, groups in reversed(shapes):
            if group is None:
                value = F.lit(shape)
            elif group > groups:
                value = F.lit(None).cast("string")
            else:
                value = F.nullif(F.regexp_extract(url, pattern, group), F.lit(""))
            out = F.when(url.rlike(pattern), value).otherwise(out)
        return out

    return F.struct(
        field(None).alias("shape"), field(1).alias("repo"), field(2).alias("revision"), field(3).alias("path")
    )


def search_expression(url: Column) -> Column:
    """The decoded search expression of a query address ('' when there is none)."""
    raw = F.try_parse_url(url, F.lit("QUERY"), F.lit("search_query"))
    return F.coalesce(F.try_url_decode(raw), F.lit(""))


def query_phrases(url: Column) -> Column:
    return F.regexp_extract_all(search_expression(url), F.lit(QUERY_TERM), F.lit(1))


def query_term(url: Column) -> Column:
    """The last quoted phrase of a query address; the address itself when it has none."""
    phrases = query_phrases(url)
    return F.coalesce(F.get(phrases, F.size(phrases) - 1), url)


def query_names(url: Column, name: Column) -> Column:
    """Does this query search for ``name``?"""
    return F.contains(search_expression(url), F.concat(F.lit('abs:"'), name, F.lit('"')))


def query_labels(url: Column, terms: list[str]) -> Column:
    """Quoted phrases of a query that are not search terms (exactly one is a usable label)."""
    return F.array_except(query_phrases(url), F.array(*[F.lit(t) for t in terms]))


def record_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RECORD_ID), F.lit(1))
