"""Tables and records written out, and the verification of stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriledger.sources import stores


def score_line(c=F.col) -> Column:
    """One Markdown row of the score table."""
    return F.format_string(
        "| %s | %d | %d | %d | %d | %.3f | %.3f | %.3f | %.3f |",
        c("subject").cast("string"), c("n_2"), c("n_1"), c("n_0"), c("n_na"),
        c("as_coded"), c("na_as_0"), c("na_as_2"), c("ceiling"),
    )


def axis_line(axis: Column, group: Column, name: Column, may_be_na: Column) -> Column:
    return F.format_string("| %d | %d | %s | %s |", axis, group, name, F.when(may_be_na, "yes").otherwise("no"))


def score_table(scores: DataFrame) -> DataFrame:
    """Score rows as text; ``sort_key`` orders them (highest as-coded first, then subject)."""
    return scores.select((-F.col("as_coded")).alias("sort_key"), "subject", score_line().alias("line"))


def emit_table(lines: DataFrame, stamp: str, fingerprint: str, path: str) -> None:
    """Replace the table at ``path`` by ``lines(sort_key, subject, line)`` in their order, stamped with date and ledger fingerprint.

    Parts are ranges of the order, so no task holds the table; stamp and parts become visible by one commit.
    """
    _stamped(lines.orderBy("sort_key", "subject").select("line"), stamp, fingerprint, path)


def _stamped(lines: DataFrame, stamp: str, fingerprint: str, path: str) -> None:
    stores.register(lines.sparkSession)
    lines.write.format("stamped_table").option("stamp", stamp).option("fingerprint", fingerprint).mode("overwrite").save(path)


def table_parts(spark: SparkSession, path: str) -> DataFrame:
    """Stored parts with their stamp; ``status`` is ``ok``, ``missing`` or ``altered``, from the bytes."""
    return stores.register(spark).read.format("stamped_table").option("view", "parts").load(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """``(rank, line)`` of a stored table, ranks from 1 in stored order; a missing or altered part fails the reader."""
    lines = stores.register(spark).read.format("stamped_table").load(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = table_parts(spark, path).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return lines.join(starts, "part").select((F.col("_start") + F.col("pos") + 1).alias("rank"), "line")


def record_json(df: DataFrame, *keys: str) -> DataFrame:
    """Result rows as JSON records, keyed."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("record"))


def emit_records(df: DataFrame, stamp: str, fingerprint: str, path: str) -> None:
    """Replace the records at ``path`` by the rows of ``df``, one JSON object a line."""
    _stamped(df.select(F.to_json(F.struct(*df.columns)).alias("line")), stamp, fingerprint, path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Stored records as ``record``, JSON text."""
    return stores.register(spark).read.format("stamped_table").load(path).select(F.col("line").alias("record"))


def record_fields(records: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys…, field, value)`` of JSON ``record``s; keys and values are text, a null field is an absent one."""
    fields = records.select(F.from_json("record", "map<string,string>").alias("_fields"))
    named = F.explode(F.map_filter("_fields", lambda k, v: ~k.isin(keys) & v.isNotNull())).alias("field", "value")
    return fields.select(*[F.col("_fields")[k].alias(k) for k in keys], named)


def verify_records(recomputed: DataFrame, path: str, keys: list[str], not_recomputable: list[str] = ()) -> DataFrame:
    """Fields on which the records stored at ``path`` and the recomputed rows disagree; nothing is written."""
    fresh = recomputed.select(F.to_json(F.struct(*recomputed.columns)).alias("record"))
    stored = read_records(recomputed.sparkSession, path)
    return verify_record(record_fields(stored, keys), record_fields(fresh, keys), keys, not_recomputable)


def verify_record(stored: DataFrame, recomputed: DataFrame, keys: list[str], not_recomputable: list[str] = ()) -> DataFrame:
    """Fields on which stored and recomputed records disagree.

    Both sides are ``(keys…, field, value)``; a field present on one side only counts, and
    the fields named as not recomputable are left out.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.filter(~F.col("field").isin(list(not_recomputable))).select(*keys, "field", F.col("value").alias(name), F.lit(True).alias(f"has_{name}"))

    joined = side(stored, "stored").join(side(recomputed, "recomputed"), [*keys, "field"], "full_outer")
    return joined.filter(~F.col("stored").eqNullSafe(F.col("recomputed"))).select(*keys, "field", "stored", "recomputed")


def append_rows(df: DataFrame, path: str) -> None:
    """Append-only tables (run records, observations)."""
    df.write.mode("append").parquet(path)
