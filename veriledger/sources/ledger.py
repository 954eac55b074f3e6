"""Reading ledgers and named facts, and listing everything they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVIDENCE = ("url string, retrieved string, sha256 string, range string, volatile boolean, volatile_reason string, "
            "pinned_commit string, lfs_oid string, retrieval string, note string")
BLOCK = ("method string, asserts string, observed string, expect array<string>, expect_file string, "
         "expect_evidence_sha256 string, expect_range_bytes string, expect_shards string, expect_count string, "
         "expect_artifacts string, expect_repo string, expect_revision string, expect_commit string, expect_files string, "
         "expect_matches string, expect_subject_name string, expect_queries string, as_of string, "
         "searched_archived array<string>, searched_live array<string>, searched array<string>")


def _struct(ddl: str) -> str:
    """``name type, …`` as the inside of ``struct<name:type, …>``."""
    return ", ".join(part.strip().replace(" ", ":", 1) for part in ddl.split(","))


LEDGER = ("as_of string, zero_bounds_floor struct<bounded_zeros:int>, "
          "subjects array<struct<id:string, repo:string, kind:string, sources:array<string>, "
          "axis_sources:map<string,array<string>>, axis_documents:map<string,array<string>>, axis_method:map<string,string>, "
          "axis_literals:map<string,array<string>>, axis_file:map<string,string>, axis_evidence_sha256:map<string,string>, "
          "source_warrant:map<string,string>>>, "
          f"cells array<struct<subject:string, axis:int, score:int, na_reason:string, note:string, check:struct<{_struct(BLOCK)}>, "
          f"bound:struct<{_struct(BLOCK)}>, evidence:array<struct<{_struct(EVIDENCE)}>>>>")
FACTS = ("facts map<string,struct<value:bigint, unit:string, "
         "method:struct<name:string, pattern:string, also_all_contain:string, field:string, value:string, width:string, below:bigint>, "
         "evidence:struct<url:string, sha256:string>>>")


def read_ledger(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Ledger documents, one row per document; a document without a coverage floor fails whatever reads it.

    ``lines`` reads one document per line, which splits over tasks; a single pretty-printed
    document needs ``lines=False``.  A missing path gives an empty ledger.  The refusal is part of the
    plan: it costs no scan of its own and no reader can get round it.
    """
    reader = spark.read.schema(LEDGER).option("multiLine", not lines).option("mode", "FAILFAST")
    try:
        docs = reader.json(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], LEDGER)
    return with_floor(docs)


def with_floor(docs: DataFrame) -> DataFrame:
    """``docs``, failing on the first document that states no ``zero_bounds_floor``."""
    refusal = F.raise_error(F.lit("the ledger has no zero_bounds_floor; the coverage ratchet would not run"))
    return docs.filter(F.when(F.col("zero_bounds_floor").isNull(), refusal.cast("boolean")).otherwise(True))


def parse_ledger(text: Column) -> Column:
    return F.from_json(text, LEDGER)


def subjects_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("subjects").alias("s")).select("s.*").withColumnRenamed("id", "subject")


def cells_of(docs: DataFrame, *carried: str) -> DataFrame:
    """Cells of all documents; ``carried`` fields of the document go with each of its cells."""
    return docs.select(*carried, F.explode("cells").alias("c")).select(*carried, "c.*").withColumns(
        {"has_check": F.col("check").isNotNull(), "has_bound": F.col("bound").isNotNull()}
    )


def evidence_of(docs: DataFrame) -> DataFrame:
    cells = docs.select(F.explode("cells").alias("c"))
    return cells.select(
        F.col("c.subject"), F.col("c.axis"), F.col("c.score"), F.posexplode("c.evidence").alias("pos", "e")
    ).select("subject", "axis", "score", "pos", "e.*")


def policy_of(docs: DataFrame) -> DataFrame:
    """Declared policy as ``(subject, axis, key, value)``; an empty declaration keeps a null value."""
    subjects = subjects_of(docs)
    lists = ("axis_sources", "axis_documents", "axis_literals")
    entries = []
    for key in (*lists, "axis_method", "axis_file", "axis_evidence_sha256"):
        value = F.col(key) if key in lists else F.transform_values(key, lambda _, v: F.array(v))
        entries.append(_keyed(key, value))
    found = F.flatten(F.array(*[F.coalesce(e, F.array().cast("array<struct<key:string,axis:string,values:array<string>>>")) for e in entries]))
    return subjects.select("subject", F.explode(found).alias("p")).select(
        "subject", F.col("p.axis").cast("int").alias("axis"), F.col("p.key").alias("key"), F.explode_outer("p.values").alias("value")
    )


def _keyed(key: str, value: Column) -> Column:
    return F.transform(
        F.map_entries(value),
        lambda e: F.struct(F.lit(key).alias("key"), e["key"].alias("axis"), e["value"].alias("values")),
    )


def all_cited(evidence: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Everything the ledger cites, cells and facts alike: ``(label, url, sha256)``."""
    label = F.concat(F.col("subject").cast("string"), F.lit("/axis"), F.col("axis").cast("string"))
    cited = evidence.select(label.alias("label"), "url", "sha256")
    return cited if facts is None else cited.unionByName(facts.select("label", "url", "sha256"))


def read_facts(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    return facts_of(spark.read.schema(FACTS).option("multiLine", not lines).json(path))


def parse_facts(text: Column) -> Column:
    return F.from_json(text, FACTS)


def facts_of(docs: DataFrame) -> DataFrame:
    """One row per named fact."""
    return docs.select(F.explode("facts").alias("name", "f")).select(
        "name", "f.value", "f.unit", F.col("f.method"), F.col("f.evidence.url").alias("url"), F.col("f.evidence.sha256").alias("sha256")
    )
