"""How many corrupted checks the content rules would catch: every mutant is run through the real rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriledger.operators import content_checks

BASE = "none"

def field_mutation_coverage(checks: DataFrame, cites: DataFrame, blobs: DataFrame, other_digest: Column) -> DataFrame:
    """Delete and perturb every declared expectation of literal checks; count what survives.

    A mutant is a changed row tagged with its base.  Bases and mutants go through the check operator together, which
    measures each distinct (digest, literal) once: a mutant that changes a count or drops a citation asks nothing of
    the bodies that its base has not asked.  Only mutants of checks that pass unmutated are counted.
    """
    no_text = F.lit(None).cast("array<string>")
    no_count = F.lit(None).cast(checks.schema["expect_artifacts"].dataType)
    artifacts = F.col("expect_artifacts")

    def variant(name: str, literals: Column, count: Column) -> Column:
        return F.struct(F.lit(name).alias("mutation"), literals.alias("literals"), count.alias("expect_artifacts"))

    broken = F.transform("literals", lambda x: F.concat(x, F.lit("\u0001")))
    variants = checks.select("cell", F.explode(F.array(
        variant(BASE, F.col("literals"), artifacts),
        variant("delete expect", no_text, artifacts), variant("perturb expect", broken, artifacts),
        variant("delete expect_artifacts", F.col("literals"), no_count),
        variant("perturb expect_artifacts", F.col("literals"), artifacts + 1),
        variant("repoint digest", F.col("literals"), artifacts), variant("transplant evidence", F.col("literals"), artifacts),
        variant("drop co-cited", F.col("literals"), artifacts),
    )).alias("m")).select("cell", "m.*")
    tag = F.to_json(F.struct("cell", "mutation"))  # any cell id stays apart from its mutation
    # which citation a mutation touches: the smallest digest of the cell
    first = cites.groupBy("cell").agg(F.min("sha256").alias("first"))
    moved = cites.select("cell", "sha256").join(first, "cell").join(variants.select("cell", "mutation"), "cell")
    hit = F.col("sha256") == F.col("first")
    touched = (
        F.when((F.col("mutation") == "repoint digest") & hit, F.sha2(F.col("sha256"), 256))
        .when(F.col("mutation") == "transplant evidence", other_digest).otherwise(F.col("sha256"))
    )
    moved = moved.filter(~((F.col("mutation") == "drop co-cited") & hit)).select(tag.alias("cell"), touched.alias("sha256"))
    results = content_checks.grep_all_in_one(variants.select(tag.alias("cell"), "literals", "expect_artifacts"), moved, blobs)
    results = results.select(F.get_json_object("cell", "$.cell").alias("base"), F.get_json_object("cell", "$.mutation").alias("mutation"),
                             F.coalesce("verdict", F.lit(False)).alias("survived"))
    stands = F.bool_or((F.col("mutation") == BASE) & F.col("survived")).over(Window.partitionBy("base"))  # a check's few variants
    mutants = results.withColumn("stands", stands).filter(F.col("stands") & (F.col("mutation") != BASE))
    return mutants.groupBy("mutation").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("survived")).alias("rejected"), F.count_if("survived").alias("survived")
    )
