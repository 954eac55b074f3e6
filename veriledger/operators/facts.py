"""Named facts recomputed from archived bytes.

Every method gives ``struct(value, error)``: an error is a refusal, not a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledger.functions.digests import word_stats
from veriledger.operators import probes
from veriledger.sources import registry

WIDTHS = {"uint16": 2, "uint32": 4}


def _result(value: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), value).cast("long").alias("value"), error.alias("error"))


def count_lines_matching(body: Column, pattern: Column, also_all_contain: Column) -> Column:
    """Lines matching a pattern at their start; every one of them must contain the qualifier."""
    anchored = F.concat(F.lit("^(?:"), pattern, F.lit(")"))
    lines = F.filter(F.split(body, "\n"), lambda line: F.regexp_like(line, anchored))
    lacking = F.size(F.filter(lines, lambda line: ~F.contains(line, also_all_contain)))
    wrong = also_all_contain.isNotNull() & (also_all_contain != "") & (lacking > 0)
    return _result(F.size(lines), F.when(wrong, F.concat(lacking.cast("string"), F.lit(" lines lack the qualifier"))))


def byte_length(body: Column) -> Column:
    return _result(F.octet_length(body), F.lit(None).cast("string"))


def count_json_entries(body: Column, field: Column, value: Column) -> Column:
    """Objects of a JSON array whose field equals the value."""
    rows = F.from_json(body, "array<map<string,string>>")
    hits = F.size(F.filter(rows, lambda r: F.try_element_at(r, field) == value))
    is_array = body.rlike(r"^\s*\[") & rows.isNotNull()
    return _result(hits, F.when(~F.coalesce(is_array, F.lit(False)), "not a JSON array"))


def token_ids_below(body: Column, below: Column, width: int) -> Column:
    """Number of little-endian words, all of which must be below the bound."""
    stats = word_stats(width)(body.cast("binary"), below.cast("long"))
    over = stats["n_over"]
    return _result(stats["n_words"], F.when(over > 0, F.concat(over.cast("string"), F.lit(" words not below bound"))))


METHODS = ["count_lines_matching", "byte_length", "count_json_entries", "token_ids_below"]


def check_facts(facts: DataFrame, blobs: DataFrame) -> DataFrame:
    """Status of every named fact: ok, or why it does not follow from the bytes it cites.

    ``facts(name, value, sha256, method, pattern, also_all_contain, field, match, width,
    below)``, ``blobs(sha256, body)``.  Each body is read once for all facts that cite it.
    """
    method = F.col("method")
    asked = (
        F.when(method == "count_lines_matching", F.struct(F.lit("lines").alias("kind"), probes.arg_of(pattern=F.col("pattern"), also=F.col("also_all_contain")).alias("arg")))
        .when(method == "count_json_entries", F.struct(F.lit("json_entries").alias("kind"), probes.arg_of(field=F.col("field"), match=F.col("match")).alias("arg")))
        .when((method == "token_ids_below") & F.col("width").isin(list(WIDTHS)),
              F.struct(F.lit(probes.WORDS).alias("kind"), probes.arg_of(width=registry.lookup(WIDTHS, F.col("width")), bound=F.col("below")).alias("arg")))
    )
    claims = facts.withColumn("_ask", asked)
    known = claims.where(F.coalesce(method.isin(METHODS), F.lit(False)))
    answers = probes.measure(probes.probe(known, "bytes", "sha256").unionByName(
        probes.probe(known.where(F.col("_ask").isNotNull()), F.col("_ask.kind"), "sha256", F.col("_ask.arg"))), blobs,
        ["bytes", "lines", "json_entries", probes.WORDS])
    joined = probes.answered(probes.answered(claims, answers, "bytes", "sha256", F.lit(""), "body"), answers, F.col("_ask.kind"), "sha256", F.col("_ask.arg"), "own")
    over = F.col("own_text").cast("long")
    error = F.when(method == "token_ids_below", F.when(over > 0, F.concat(over.cast("string"), F.lit(" words not below bound")))).when(method != "byte_length", F.col("own_text"))
    value = F.when(method == "byte_length", F.col("body_n")).otherwise(F.col("own_n"))
    refused = (
        F.when(~F.coalesce(method.isin(METHODS), F.lit(False)), "method not registered")
        .when(~F.col("body_read"), "not archived")
        .when(~F.col("body_flag"), "digest differs")
        .when((method != "byte_length") & ~F.col("own_read"), "width not known")
    )
    status = F.coalesce(refused, error, F.when(value.eqNullSafe(F.col("value")), "ok").otherwise("value differs"))
    return joined.select("name", "method", F.col("value").alias("recorded"), F.when(refused.isNull() & error.isNull(), value).alias("recomputed"), status.alias("status"))
