"""Session settings and lineage helpers shared by jobs and tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime-settable options that every job of this library relies on.  Skewed
# joins and the number of post-shuffle partitions are left to adaptive
# execution; the broadcast decision is left to the size-checked threshold.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder that ``spark.checkpoint.dir`` names, computed here and once.

    A lazy one would compute the rows again for every branch that reads them in the first job, and once more to write them.
    Without that setting the rows are persisted: blocks of a lost executor are computed again
    from the tables.  The caller unpersists, or clears the cache, when the job is done.
    """
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint(eager=True)
    return df.persist()


def stage(df: DataFrame) -> DataFrame:
    """The rows written once, as Parquet in a folder of their own: each of many branches reads only its columns of them."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: the one ``spark.checkpoint.dir`` names, or the context's own.

    A local session without either gets a temporary folder; a cluster without it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _OWN.get(spark.sparkContext.applicationId)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="ledger-shared-")
    return folder


_OWN: dict[str, str] = {}
