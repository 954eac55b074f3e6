"""One pass over archived bytes for all that any check wants to know of them.

A check states what it needs as probes ``(sha256, kind, arg)``.  Equal probes of different claims are one; a digest's probes
are put into lists of at most about ``CHUNK``, so a digest that very many claims cite spreads over tasks; each list meets
its body once, is answered where the body lies, and only the answers, ``(n, m, flag, text)``, go back to the claims.
A body is thus read and moved once for a list of probes, never once for a claim, and bodies that no claim cites not at all.

A probe without a row among the answers was asked of a digest that is not archived.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriledger.functions import content
from veriledger.functions.digests import count_words
from veriledger.session import cut_lineage
from veriledger.sources import documents, registry

CHUNK = 1000
ANSWER = "struct<n:bigint,m:bigint,flag:boolean,text:string>"


def _answer(n: Column | None = None, m: Column | None = None, flag: Column | None = None, text: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct((none if n is None else n).cast("long").alias("n"), (none if m is None else m).cast("long").alias("m"),
                    (none if flag is None else flag).cast("boolean").alias("flag"), (none if text is None else text).cast("string").alias("text"))


def _field(arg: Column, name: str) -> Column:
    return F.get_json_object(arg, f"$.{name}")


def arg_of(**fields: Column) -> Column:
    """The argument of a probe that needs several values."""
    return F.to_json(F.struct(*[c.cast("string").alias(n) for n, c in fields.items()]))


def _bytes(body: Column, arg: Column, digest: Column) -> Column:
    """n: length; flag: the bytes have the digest they are stored under."""
    return _answer(n=F.octet_length(body), flag=F.sha2(body, 256) == digest)


def _listed(body: Column, arg: Column, digest: Column) -> Column:
    """flag: the enumeration can be read; n: place of ``url`` in it from 1, 0 for none; text: what stands at ``index``."""
    paths = documents.enumerated_paths(_field(arg, "kind"), body.cast("string"), F.coalesce(_field(arg, "base"), F.lit("")))
    return _answer(n=F.array_position(paths, _field(arg, "url")), flag=paths.isNotNull(), text=F.get(paths, _field(arg, "index").cast("int")))


def _revision(body: Column, arg: Column, digest: Column) -> Column:
    """text: why the listing is none of ``repo`` at ``revision``; flag: it enumerates ``file``."""
    found = documents.enumerate_revision(body.cast("string"), _field(arg, "repo"), _field(arg, "revision"))
    return _answer(text=found["reason"], flag=F.array_contains(found["shards"], _field(arg, "file")))


def _head(body: Column, arg: Column, digest: Column) -> Column:
    """text: why the bytes are no weights."""
    return _answer(text=content.sniff_header(body, arg))


COMMIT = "struct<committer:string,signed:boolean,subject_line:string>"


def _commit(body: Column, arg: Column, digest: Column) -> Column:
    """flag: the commit's object id is the argument; text: its fields, ``COMMIT``."""
    fields = content.commit_fields(body.cast("string"))
    kept = F.struct(*[fields[x].alias(x) for x in ("committer", "signed", "subject_line")])
    return _answer(flag=content.git_object_id(body) == arg, text=F.to_json(kept))


def _feed(body: Column, arg: Column, digest: Column) -> Column:
    """n: the total of the header; m: entries that are there."""
    text = body.cast("string")
    return _answer(n=documents.feed_total(text), m=F.regexp_count(text, F.lit("<entry[ >]")))


def _contains(body: Column, arg: Column, digest: Column) -> Column:
    return _answer(flag=F.contains(F.lower(body.cast("string")), F.lower(arg)))


def _occurrences(body: Column, arg: Column, digest: Column) -> Column:
    return _answer(n=content.occurrences(F.lower(body.cast("string")), F.lower(arg)))


def _lines(body: Column, arg: Column, digest: Column) -> Column:
    """n: lines that begin with ``pattern``; text: why they do not count."""
    anchored, also = F.concat(F.lit("^(?:"), _field(arg, "pattern"), F.lit(")")), _field(arg, "also")
    lines = F.filter(F.split(body.cast("string"), "\n"), lambda line: F.regexp_like(line, anchored))
    lacking = F.size(F.filter(lines, lambda line: ~F.contains(line, also)))
    wrong = also.isNotNull() & (also != "") & (lacking > 0)
    return _answer(n=F.size(lines), text=F.when(wrong, F.concat(lacking.cast("string"), F.lit(" lines lack the qualifier"))))


def _json_entries(body: Column, arg: Column, digest: Column) -> Column:
    text = body.cast("string")
    rows = F.from_json(text, "array<map<string,string>>")
    hits = F.size(F.filter(rows, lambda r: F.try_element_at(r, _field(arg, "field")) == _field(arg, "match")))
    is_array = F.coalesce(text.rlike(r"^\s*\[") & rows.isNotNull(), F.lit(False))
    return _answer(n=hits, text=F.when(~is_array, "not a JSON array"))


TREE = "struct<truncated:boolean,tree:array<struct<path:string,type:string,size:bigint>>>"


def _tree(body: Column, arg: Column, digest: Column) -> Column:
    """text: why the tree does not hold all of ``paths`` as files of real size, and ``manifest``."""
    tree = F.from_json(body.cast("string"), TREE)
    files = F.filter(tree["tree"], lambda e: e["type"] == "blob")
    names = F.transform(files, lambda e: e["path"])
    real = F.transform(F.filter(files, lambda e: F.coalesce(e["size"], F.lit(0)) >= registry.STUB_BYTES), lambda e: e["path"])
    wanted, manifest = F.from_json(_field(arg, "paths"), "array<string>"), _field(arg, "manifest")
    reason = (
        F.when(tree.isNull() | tree["tree"].isNull(), "not json").when(F.coalesce(tree["truncated"], F.lit(False)), "truncated")
        .when(wanted.isNull() | (F.size(wanted) == 0), "nothing required").when(F.size(F.array_except(wanted, names)) > 0, "path missing")
        .when(F.size(F.array_except(wanted, real)) > 0, "stub").when(manifest.isNull(), "manifest not declared")
        .when(~F.array_contains(names, manifest), "manifest missing")
    )
    return _answer(flag=reason.isNull(), text=reason)


KINDS = {"tree": _tree, "bytes": _bytes, "listed": _listed, "revision": _revision, "head": _head, "commit": _commit, "feed": _feed,
         "contains": _contains, "occurrences": _occurrences, "lines": _lines, "json_entries": _json_entries}
WORDS = "words"


def _words():
    """Arrow UDF: a body and its ``words`` probes -> for each n: words, m: the largest one, text: how many are not below the bound."""
    kind = T.ArrayType(T.StructType([T.StructField("arg", T.StringType()), T.StructField("n", T.LongType()), T.StructField("m", T.LongType()),
                                     T.StructField("flag", T.BooleanType()), T.StructField("text", T.StringType())]))

    @F.pandas_udf(kind)
    def words(body: pd.Series, args: pd.Series) -> pd.Series:
        def answers(raw, wanted):
            out = []
            for arg in wanted:
                want = json.loads(arg)
                bound = want.get("bound")
                n, most, over = count_words(raw, int(want["width"]), None if bound is None else int(bound))
                out.append({"arg": arg, "n": n, "m": most, "flag": None, "text": str(over)})
            return out

        return pd.Series([answers(b, a) for b, a in zip(body, args)])

    return words


def bodies_of(cited: DataFrame, store: DataFrame) -> DataFrame:
    """``sha256, body`` of the cited digests, one row each: a digest's lists meet its bytes once, however often it is stored."""
    bodies = store.select("sha256", F.col("body").cast("binary").alias("body")).where("body is not null")
    return bodies.join(cited.select("sha256"), "sha256", "left_semi").dropDuplicates(["sha256"])


def measure(probes: DataFrame, store: DataFrame, kinds: list[str], chunk: int = CHUNK) -> DataFrame:
    """``sha256, kind, arg, n, m, flag, text`` of every distinct probe of an archived digest.

    ``probes(sha256, kind, arg)``, of the ``kinds`` named; a null argument is the empty text.  ``store(sha256, body)``, where a digest
    may stand more than once.  The answers' lineage is cut, since every check joins them once for each kind it asks.
    """
    wanted = probes.select("sha256", "kind", F.coalesce("arg", F.lit("")).alias("arg")).where("sha256 is not null").distinct()
    sizes = wanted.groupBy("sha256").agg(F.count(F.lit(1)).alias("_n"))
    placed = wanted.join(sizes, "sha256").select(
        "sha256", "kind", "arg", (F.col("kind") == WORDS).alias("_lane"), F.pmod(F.xxhash64("kind", "arg"), F.ceil(F.col("_n") / chunk)).alias("_chunk"))
    lists = placed.groupBy("sha256", "_lane", "_chunk").agg(F.collect_list(F.struct("kind", "arg")).alias("_probes"))
    met = lists.join(bodies_of(sizes, store), "sha256")
    body, digest = F.col("body"), F.col("sha256")

    def one(p: Column) -> Column:
        answer = F.lit(None).cast(ANSWER)
        for kind in kinds:
            if kind != WORDS:
                answer = F.when(p["kind"] == kind, KINDS[kind](body, p["arg"], digest)).otherwise(answer)
        return F.struct(p["kind"].alias("kind"), p["arg"].alias("arg"), answer.alias("a"))

    parts = []
    if set(kinds) != {WORDS}:
        plain = met.where("not _lane").select("sha256", F.explode(F.transform("_probes", one)).alias("p"))
        parts.append(plain.select("sha256", "p.kind", "p.arg", "p.a.n", "p.a.m", "p.a.flag", "p.a.text"))
    if WORDS in kinds:
        counted = met.where("_lane").select("sha256", F.explode(_words()(body, F.col("_probes.arg"))).alias("p"))
        parts.append(counted.select("sha256", F.lit(WORDS).alias("kind"), "p.arg", "p.n", "p.m", "p.flag", "p.text"))
    return cut_lineage(reduce(DataFrame.unionByName, parts).dropDuplicates(["sha256", "kind", "arg"]))


def answered(claims: DataFrame, answers: DataFrame, kind: str | Column, digest: str, arg: Column, prefix: str) -> DataFrame:
    """``claims`` with the answers to one probe of each row as ``<prefix>_n``, ``_m``, ``_flag``, ``_text`` and ``<prefix>_read``."""
    if isinstance(kind, str):
        answers, kind = answers.where(F.col("kind") == kind), F.lit(kind)
    mine = answers.select(F.col("sha256").alias("_digest"), F.col("kind").alias("_of"), F.col("arg").alias("_arg"), F.lit(True).alias(f"{prefix}_read"),
                          *[F.col(c).alias(f"{prefix}_{c}") for c in ("n", "m", "flag", "text")])
    joined = claims.withColumns({"_kind": kind, "_asked": F.coalesce(arg, F.lit(""))})
    same = (F.col(digest) == F.col("_digest")) & (F.col("_kind") == F.col("_of")) & (F.col("_asked") == F.col("_arg"))
    joined = joined.join(mine, same, "left").drop("_digest", "_of", "_arg", "_kind", "_asked")
    return joined.withColumn(f"{prefix}_read", F.coalesce(f"{prefix}_read", F.lit(False)))


def probe(claims: DataFrame, kind: str | Column, digest: str, arg: Column | None = None) -> DataFrame:
    """The probes of one kind that a claims frame asks."""
    return claims.select(F.col(digest).alias("sha256"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit("") if arg is None else arg).alias("arg"))
