"""Snapshot drift: what moved between the recorded bytes and a later observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledger.functions import urls
from veriledger.functions.digests import close_digest, digest_sums, row_digest
from veriledger.sources import registry

CLASSES = ["ok", "limited", "gone", "volatile", "serialisation", "metadata", "material"]


_JSON_TOKENS = r'("(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+|-)'


def _number(token: Column) -> Column:
    """One spelling for equal numbers: whole ones without point and exponent, others as the nearest double."""
    value = token.try_cast("double")
    whole = (value == F.floor(value)) & (F.abs(value) < 2.0**53)
    return F.when(token.rlike("^-?[0-9]+$"), F.when(token == "-0", "0").otherwise(token)).when(
        whole, value.cast("decimal(20,0)").cast("string")).otherwise(value.cast("string"))


def _numbers_alike(text: Column) -> Column:
    """JSON text whose numbers, those outside strings, are spelled alike where they are equal."""
    tokens = F.regexp_extract_all(text, F.lit(_JSON_TOKENS), 1)
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9]"), _number(t)).otherwise(t)), "")


def _canonical(text: Column) -> Column:
    """Canonical text of a JSON document: object keys sorted, spacing gone, equal numbers alike at any depth."""
    return _numbers_alike(F.to_json(F.try_parse_json(text)))


def _fields(text: Column) -> Column:
    """Top-level fields of a JSON object as canonical text; null and missing are alike."""
    values = F.transform_values(F.from_json(text, "map<string,variant>"), lambda _, v: F.nullif(_numbers_alike(F.to_json(v)), F.lit("null")))
    return F.map_filter(values, lambda _, v: v.isNotNull())


def drift_keys(old: Column, new: Column, volatile_keys: list[str] = registry.VOLATILE_KEYS) -> Column:
    """``struct(kind, keys)``: NONE, METADATA (only volatile keys moved) or MATERIAL."""
    a, b = F.try_parse_json(old), F.try_parse_json(new)
    same = _canonical(old) == _canonical(new)
    objects = F.startswith(_canonical(old), F.lit("{")) & F.startswith(_canonical(new), F.lit("{"))
    fields_a, fields_b = _fields(F.when(objects, old)), _fields(F.when(objects, new))
    every = F.array_union(F.map_keys(fields_a), F.map_keys(fields_b))
    moved = F.array_sort(F.filter(every, lambda k: ~F.try_element_at(fields_a, k).eqNullSafe(F.try_element_at(fields_b, k))))
    metadata = F.size(F.array_except(moved, F.array(*[F.lit(k) for k in volatile_keys]))) == 0
    whole = F.array(F.lit("*"))
    none = F.array().cast("array<string>")
    unparsed = a.isNull() | b.isNull()
    kind = (
        F.when(unparsed, "MATERIAL").when(same, "NONE").when(~objects, "MATERIAL")
        .when(F.size(moved) == 0, "NONE").when(metadata, "METADATA").otherwise("MATERIAL")
    )
    keys = F.when(unparsed, whole).when(same, none).when(~objects, whole).otherwise(moved)
    return F.struct(kind.alias("kind"), keys.alias("keys"))


def drift_report(cited: DataFrame, blobs: DataFrame, observations: DataFrame) -> DataFrame:
    """One row per cited address with its class, moved keys and how many cells it affects.

    ``cited(label, url, sha256, volatile)``, ``blobs(sha256, body)``, ``observations(url,
    status, sha256, body)`` where status 'limited' or 'gone' means that no bytes came back.
    Only addresses whose digest moved are joined to the recorded bytes.
    """
    by_url = cited.groupBy("url").agg(
        F.min("sha256").alias("sha256"), F.bool_or(F.coalesce("volatile", F.lit(False))).alias("volatile"),
        F.count(F.lit(1)).alias("n_cells"), F.min("label").alias("first_cell"),
    )
    seen = observations.select("url", "status", F.col("sha256").alias("now"), F.col("body").alias("live"))
    joined = by_url.join(seen, "url", "left")
    moved = (F.col("now") != F.col("sha256")) & F.coalesce(F.col("status") == "ok", F.lit(False))
    settled = (
        F.when(F.col("status") == "limited", "limited")
        .when(F.col("status").isNull() | (F.col("status") == "gone") | F.col("now").isNull(), "gone")
        .when(F.col("now") == F.col("sha256"), "ok")
        .when(F.col("volatile"), "volatile")
    )
    quiet = joined.withColumn("class", settled).filter("class is not null").select(
        "url", "class", F.lit("").alias("moved"), "n_cells", "first_cell"
    )
    loud = joined.filter(moved & ~F.col("volatile")).join(blobs.select("sha256", F.col("body").alias("recorded")), "sha256", "left")
    found = F.when(
        F.col("recorded").isNotNull() & F.col("live").isNotNull(), drift_keys(F.col("recorded"), F.col("live"))
    )
    name = F.when(F.col("d.kind") == "NONE", "serialisation").when(F.col("d.kind") == "METADATA", "metadata").otherwise("material")
    return quiet.unionByName(loud.withColumn("d", found).select(
        "url", name.alias("class"), F.coalesce(F.array_join("d.keys", ","), F.lit("bytes unavailable")).alias("moved"), "n_cells", "first_cell"
    ))


def affected_cells(report: DataFrame, cited: DataFrame) -> DataFrame:
    """``url, class, label``: every cell that cites an address which is not as it was recorded."""
    moved = report.where(F.col("class") != "ok").select("url", "class")
    return cited.select("label", "url").distinct().join(moved, "url").select("url", "class", "label")


def drift_findings(report: DataFrame, at: str) -> DataFrame:
    """``at, url, class, moved, n_cells``: what a run found, one row for each address that is not as recorded."""
    return report.where(F.col("class") != "ok").select(F.lit(at).alias("at"), "url", "class", "moved", "n_cells")


def drift_run_record(report: DataFrame, cited: DataFrame, at: str) -> DataFrame:
    """One run record: counts by class, completeness, and a fingerprint of what was covered."""
    cover = cited.groupBy("url").agg(F.min("sha256").alias("sha256")).select(row_digest(F.col("url"), F.col("sha256")).alias("d"))
    covered = cover.agg(F.count(F.lit(1)).alias("n"), *digest_sums(F.col("d"))).select(close_digest(F.col("n"))).scalar()
    counts = report.agg(
        F.count(F.lit(1)).alias("artifacts"), *[F.count_if(F.col("class") == c).alias(f"n_{c}") for c in CLASSES]
    )
    return counts.select(F.lit(at).alias("at"), "*", (F.col("n_limited") == 0).alias("complete"), covered.alias("covered"))


def keep_last_runs(runs: DataFrame, order: str = "at", n: int = 1) -> DataFrame:
    """A view of the most recent ``n`` runs; the log itself keeps every run."""
    return runs.orderBy(F.desc(order)).limit(n)


def volatile_by_double_observation(observations: DataFrame) -> DataFrame:
    """Addresses whose repeated observations differ."""
    return observations.groupBy("url").agg(
        F.count(F.lit(1)).alias("n"), (F.min("sha256") != F.max("sha256")).alias("volatile")
    )


# ------------------------------------------------------------------------ rewriting

def pin_gate(cited: DataFrame, mapping: DataFrame) -> DataFrame:
    """May the mutable addresses be rewritten? One row: targets, unmapped, moved, allowed."""
    targets = cited.filter(urls.is_mutable_ref(F.col("url")))
    joined = targets.groupBy("url", "sha256").agg(F.count(F.lit(1)).alias("n")).join(mapping, "url", "left")
    return joined.agg(
        F.countDistinct("url").alias("n_targets"),
        F.countDistinct(F.when(F.col("pinned").isNull(), F.col("url"))).alias("n_unmapped"),
        F.coalesce(F.sum(F.when(F.col("pinned_sha256") != F.col("sha256"), F.col("n"))), F.lit(0)).alias("n_moved"),
    ).withColumn("allowed", (F.col("n_unmapped") == 0) & (F.col("n_moved") == 0))


def pin_mapping(cited: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cited rows with mutable addresses replaced, all of them or none.

    ``mapping(url, pinned, pinned_sha256)``.  The gate is one scalar of the same plan.
    """
    allowed = pin_gate(cited, mapping).select("allowed").scalar()
    joined = cited.join(mapping.select("url", "pinned"), "url", "left")
    target = F.when(urls.is_mutable_ref(F.col("url")) & allowed, F.col("pinned"))
    return joined.select("label", F.coalesce(target, F.col("url")).alias("url"), "sha256", target.isNotNull().alias("rewritten"))


def superseded_apply(policy: DataFrame, superseded: DataFrame) -> DataFrame:
    """Re-point the affected axes of a superseded address to its replacement."""
    sources = policy.filter("key = 'axis_sources'")
    rules = superseded.select("subject", F.col("address").alias("value"), "grp", "superseded_by", "still_valid_for")
    joined = sources.join(rules, ["subject", "value"], "left")
    affected = F.coalesce(
        (registry.axis_group(F.col("axis")) == F.col("grp")) & ~F.array_contains("still_valid_for", F.col("axis")), F.lit(False)
    )
    return joined.select("subject", "axis", F.when(affected, F.col("superseded_by")).otherwise(F.col("value")).alias("value"), affected.alias("changed"))
