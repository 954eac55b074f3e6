"""Documents that list other objects: feeds, enumerations, revision responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: markup the parsers read
ENTRY = r"(?s)<entry>(.*?)</entry>"
TOTAL = r"opensearch:totalResults[^>]*>(\d+)<"
PRIMARY_CATEGORY = r'<arxiv:primary_category[^>]*term="([^"]+)"'
REVISION_RESPONSE = "sha string, id string, siblings array<struct<rfilename:string>>"
DATASET_TREE = "array<struct<type:string, path:string, lfs:struct<oid:string>>>"
SOURCE_TREE = "truncated boolean, tree array<struct<path:string, type:string, size:bigint>>"


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def feed_total(body: Column) -> Column:
    return F.nullif(F.regexp_extract(body, TOTAL, 1), F.lit("")).cast("long")


def feed_entries(body: Column) -> Column:
    """Array of ``struct(id, title, abstract)``; text is whitespace-collapsed."""

    def tag(block: Column, name: str) -> Column:
        return F.regexp_extract(block, f"(?s)<{name}>(.*?)</{name}>", 1)

    return F.transform(
        F.regexp_extract_all(body, F.lit(ENTRY), F.lit(1)),
        lambda e: F.struct(
            F.trim(tag(e, "id")).alias("id"), collapse_space(tag(e, "title")).alias("title"),
            collapse_space(tag(e, "summary")).alias("abstract"),
        ),
    )


def parse_feed(pages: DataFrame, body: str, *keep: str, require_id: bool = False) -> DataFrame:
    """One row per entry of every feed page; pages without entries give none."""
    rows = pages.select(*keep, feed_total(F.col(body)).alias("total"), F.posexplode(feed_entries(F.col(body))).alias("pos", "e"))
    rows = rows.select(*keep, "total", "pos", "e.*")
    return rows.filter("id <> ''") if require_id else rows


def primary_category(entry: Column) -> Column:
    """``struct(id, category)`` of one feed entry."""
    return F.struct(
        F.nullif(F.trim(F.regexp_extract(entry, r"<id>[^<]*abs/([^<]+)</id>", 1)), F.lit("")).alias("id"),
        F.nullif(F.regexp_extract(entry, PRIMARY_CATEGORY, 1), F.lit("")).alias("category"),
    )


def parse_primary_category(pages: DataFrame, body: str) -> DataFrame:
    entries = pages.select(F.explode(F.regexp_extract_all(F.col(body), F.lit(ENTRY), F.lit(1))).alias("entry"))
    return entries.select(primary_category(F.col("entry")).alias("p")).select("p.*").filter(
        "id is not null and category is not null"
    )


def enumerated_paths(kind: Column, body: Column, base: Column) -> Column:
    """Ordered paths a document lists; null when the document cannot be read as ``kind``."""
    dashed = F.transform(
        F.filter(F.split(body, "\n"), lambda line: F.startswith(line, F.lit("    - "))),
        lambda line: F.substring(F.trim(line), F.lit(3), F.length(line)),
    )
    files = F.filter(F.from_json(body, DATASET_TREE), lambda e: (e["type"] == "file") & e["path"].isNotNull())
    tree = F.transform(files, lambda e: F.concat(base, e["path"]))
    return F.when(kind == "yaml_dash_list", dashed).when((kind == "hf_tree_json") & (base != ""), tree)


def enumerate_paths(documents: DataFrame, kind: str, body: str, base: str, *keep: str) -> DataFrame:
    """``(keep…, pos, path)`` per listed object; an unreadable document gives one row with null pos."""
    paths = enumerated_paths(F.col(kind), F.col(body), F.col(base))
    return documents.select(*keep, F.posexplode_outer(paths).alias("pos", "path"))


def shard_names(response: Column) -> Column:
    """Top-level weight files of a parsed revision response."""
    names = F.transform(response["siblings"], lambda s: s["rfilename"])
    return F.array_sort(F.array_distinct(F.filter(
        names, lambda n: n.rlike(r"^[^/]+\.(safetensors|bin)$") & ~F.contains(n, F.lit("index"))
    )))


def enumerate_revision(body: Column, url_repo: Column, url_revision: Column) -> Column:
    """``struct(shards, reason)``; reason says why the response does not answer for its address."""

    def read(response: Column) -> Column:
        unread = response.isNull() | (response["sha"].isNull() & response["siblings"].isNull())
        reason = (
            F.when(unread, "not json")
            .when(~response["sha"].eqNullSafe(url_revision), "other revision")
            .when(response["id"].isNotNull() & (response["id"] != "") & (response["id"] != url_repo), "other repository")
        )
        return F.struct(F.when(reason.isNull(), shard_names(response)).alias("shards"), reason.alias("reason"))

    # a lambda's argument is evaluated once: the body is parsed once, not for every use of the response
    return F.get(F.transform(F.array(F.from_json(body, REVISION_RESPONSE)), read), F.lit(0))
