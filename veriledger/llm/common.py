"""Helpers shared by the training-data operators: shared storage, connected components, text folding."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see, as ``spark.checkpoint.dir`` names it.

    A local session without that setting gets a folder of its own; a cluster without it is an
    error, because other executors would not see machine-local files.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="llm-shared-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def arrow_rows(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with the session's Arrow batches set to ``rows`` rows: what a Python worker holds at once.

    Texts may be long, so the default of 10,000 rows would be hundreds of megabytes.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder below ``shared_dir`` that nothing reads any more."""
    if not path.startswith(shared_dir(spark)):
        raise ValueError(f"{path} is not in the shared folder")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character left alone."""
    return F.translate(text, UPPER, LOWER)


def sha256_of(items: Column) -> Column:
    return F.sha2(F.encode(items, "UTF-8"), 256)


BITS_LEAST, BITS_MOST = 1 << 16, 1 << 27


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with ``_in_id_filter``: false only if its ``doc_id`` is surely not in ``ids(doc_id)``.

    A bit filter of about 16 bits for an id, at most ``BITS_MOST`` (2 million 64-bit words, the proven
    bound of what is broadcast), so that rows that match nothing need no shuffle.
    """
    n, bits = ids.count(), BITS_LEAST
    while bits < min(16 * n, BITS_MOST):
        bits *= 2
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))
    one = F.shiftrightunsigned(h, 6)
    words = ids.select(one.alias("_id_filter_word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(cast(doc_id as bigint)), 64) as int))").alias("bit"))
    words = words.groupBy("_id_filter_word").agg(F.bit_or("bit").alias("_id_filter_bits"))
    rows = rows.join(F.broadcast(words), one == F.col("_id_filter_word"), "left")
    set_bits = F.expr("shiftrightunsigned(_id_filter_bits, cast(pmod(xxhash64(cast(doc_id as bigint)), 64) as int)) & 1")
    return rows.withColumn("_in_id_filter", F.coalesce(set_bits == 1, F.lit(False))).drop("_id_filter_word", "_id_filter_bits")


def join_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` joined with ``ids(doc_id, ...)`` on ``doc_id``; only rows that may match are shuffled."""
    return _marked(rows, ids.select("doc_id")).where("_in_id_filter").drop("_in_id_filter").join(ids, "doc_id")


def drop_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose ``doc_id`` is not in ``ids(doc_id)``; only rows that may match are shuffled.  Null ids stay."""
    columns = rows.columns
    marked = _marked(rows, ids)
    left = marked.where("_in_id_filter").join(ids, "doc_id", "left_anti")
    return marked.where("not _in_id_filter").select(*columns).unionByName(left.select(*columns))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge; component = smallest node it reaches.

    Alternating large-star and small-star contraction.  A star keeps one row per edge; its
    minimum per node combines before the shuffle and the join back to a hub's edges is a plain
    sort-merge join that adaptive execution may split, so a hub of any degree is never gathered.
    Each round is checkpointed reliably.  Self-loops and null ends add nothing.  Nodes may be of
    any orderable type.  The number of rounds grows with the logarithm of the longest path.
    """
    u, v = F.col("u"), F.col("v")
    edges = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (u != v)).distinct()
    )
    before = _state(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = edges.union(edges.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v)
        edges = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle within max_rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(u.alias("node"), "component").union(
        edges.select(v.alias("node"), v.alias("component")).distinct()
    )
