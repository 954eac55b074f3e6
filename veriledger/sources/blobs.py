"""Content-addressed bytes: scanning, storing, planning what to archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledger.sources import stores


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``blobs(sha256, body)`` from a Parquet store; pruned to matching files by its sort order."""
    return spark.read.parquet(path)


def read_gzip_store(spark: SparkSession, path: str) -> DataFrame:
    """``blobs(sha256, body, status)`` from ``<sha256>.gz`` files of any size, one row each.

    ``status`` is ``ok``, ``corrupt`` or ``mismatch``; a corrupt member has a null body, so that unreadable and
    not archived stay two facts.  A folder that is not there is an empty store.
    """
    tasks = 4 * spark.sparkContext.defaultParallelism
    return stores.register(spark).read.format("gzip_store").option("tasks", tasks).load(path)


def write_gzip_store(bodies: DataFrame, path: str) -> None:
    """Add ``bodies(body)`` to a store of gzip members; digests are computed by the writer, members that are there stay."""
    stores.register(bodies.sparkSession)
    bodies.select("body").write.format("gzip_store").mode("append").save(path)


def blob_scan(cited: DataFrame, blobs: DataFrame) -> DataFrame:
    """Cited rows with the bytes behind their digest (null = not archived).

    A digest cited by very many rows stays one join key; adaptive skew-join splits it,
    and callers that only need a property of the bytes should join that property instead.
    """
    return cited.join(blobs.select("sha256", "body"), "sha256", "left")


def archived_flags(cited: DataFrame, blobs: DataFrame) -> DataFrame:
    """Cited rows with ``archived`` and ``n_bytes``; the bodies never enter the shuffle."""
    sizes = blobs.select("sha256", F.octet_length("body").cast("long").alias("n_bytes"))
    return cited.join(sizes, "sha256", "left").withColumn("archived", F.col("n_bytes").isNotNull())


def blobs_to_store(bodies: DataFrame, existing: DataFrame) -> DataFrame:
    """New bytes under their own digest; digests are computed here, never supplied.

    The anti-join against the store runs on digests before the bodies are deduplicated.
    """
    keyed = bodies.select(F.sha2(F.col("body"), 256).alias("sha256"), "body")
    fresh = keyed.join(existing.select("sha256"), "sha256", "left_anti")
    return fresh.dropDuplicates(["sha256"])


def store_blobs(bodies: DataFrame, store_path: str) -> None:
    """Append the new bytes, clustered by digest so later digest lookups prune row groups."""
    spark = bodies.sparkSession
    try:
        existing = read_store(spark, store_path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        existing = spark.createDataFrame([], "sha256 string, body binary")
    fresh = blobs_to_store(bodies, existing)
    fresh.repartitionByRange("sha256").sortWithinPartitions("sha256").write.mode("append").parquet(store_path)


def archive_plan(cited: DataFrame, blobs: DataFrame, observations: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Per cited address: keep, store, or why not; ``max_bytes`` is the caller's archive policy (none: any size).

    ``cited(url, sha256, volatile, range)``; ``observations(url, observed_sha256, n_bytes,
    has_body)`` from the retrieval run (no row = could not be retrieved).
    """
    stored = blobs.select("sha256", F.lit(True).alias("stored"))
    wanted = cited.groupBy("url", "sha256").agg(
        F.bool_or(F.coalesce(F.col("volatile"), F.lit(False))).alias("volatile"), F.max("range").alias("range")
    )
    joined = wanted.join(stored, "sha256", "left").join(observations, "url", "left")
    moved = ~F.col("observed_sha256").eqNullSafe(F.col("sha256"))
    large = F.lit(False) if max_bytes is None else F.col("n_bytes") > max_bytes
    decision = (
        F.when(F.col("stored"), "already stored")
        .when(F.col("range").isNotNull() & (F.col("observed_sha256").isNull() | moved), "range moved")
        .when(F.col("range").isNotNull(), "store range")
        .when(large, "too large")
        .when(F.col("observed_sha256").isNull(), "unretrievable")
        .when(moved & F.col("volatile"), "volatile")
        .when(moved, "drifted")
        .when(~F.coalesce(F.col("has_body"), F.lit(False)), "no body")
        .otherwise("store")
    )
    return joined.select("url", "sha256", decision.alias("decision"), F.col("n_bytes")).withColumn(
        "stored", F.col("decision").isin("already stored", "store", "store range")
    )
