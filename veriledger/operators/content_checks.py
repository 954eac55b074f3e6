"""Checks re-run over archived bytes.

``verdict`` is three-valued: true, false, or null when the bytes are not archived.

Bodies are heavy and a popular document may be cited by very many cells, so bodies are
never carried per citation: what a check needs from the bytes is computed once per
(digest, literal) or per digest, and only that small result is joined back to cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledger.functions import content, urls
from veriledger.functions.digests import word_stats
from veriledger.operators import probes
from veriledger.sources import registry


def _first(*entries: tuple[Column, str | Column]) -> Column:
    """The first reason whose condition holds, else null."""
    out = F.lit(None).cast("string")
    for cond, reason in reversed(entries):
        out = F.when(F.coalesce(cond, F.lit(False)), reason).otherwise(out)
    return out


def _verdict(reason: str = "reason", unread: Column | None = None) -> Column:
    passed = F.col(reason).isNull()
    return passed if unread is None else F.when(~unread, passed)


# ------------------------------------------------------------------- literals in documents

def _literal_results(cites: DataFrame, checks: DataFrame, blobs: DataFrame, measure) -> DataFrame:
    """``(cell, sha256, literal, value)`` for every cited document and literal of a cell.

    ``measure(low_body, low_literal)`` is evaluated once per distinct (digest, literal).
    """
    wanted = cites.join(checks.select("cell", F.explode("literals").alias("literal")), "cell").select(
        "cell", "sha256", F.lower("literal").alias("literal")
    )
    bodies = blobs.select("sha256", F.lower("body").alias("low"))
    measured = wanted.select("sha256", "literal").distinct().join(bodies, "sha256").select(
        "sha256", "literal", measure(F.col("low"), F.col("literal")).alias("value")
    )
    return wanted.join(measured, ["sha256", "literal"], "left")


def _archived(cites: DataFrame, blobs: DataFrame) -> DataFrame:
    """Per cell: how many citations, how many of them archived."""
    known = blobs.select("sha256", F.lit(1).alias("known"))
    return cites.join(known, "sha256", "left").groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_cited"), F.count("known").alias("n_archived")
    )


def grep_all_in_one(checks: DataFrame, cites: DataFrame, blobs: DataFrame) -> DataFrame:
    """Every literal, case-insensitively, in one cited document.

    ``checks(cell, literals, expect_artifacts)``, ``cites(cell, sha256)``, ``blobs(sha256, body)``.
    """
    found = _literal_results(cites, checks, blobs, lambda low, lit: F.contains(low, lit))
    per_doc = found.groupBy("cell", "sha256").agg(F.bool_and(F.coalesce("value", F.lit(False))).alias("all_here"))
    some_doc = per_doc.groupBy("cell").agg(F.bool_or("all_here").alias("in_one"))
    lost = (
        found.groupBy("cell", "literal").agg(F.bool_or(F.coalesce("value", F.lit(False))).alias("anywhere"))
        .filter(~F.col("anywhere")).groupBy("cell").agg(F.count(F.lit(1)).alias("n_lost"), F.min("literal").alias("lost"))
    )
    joined = checks.join(_archived(cites, blobs), "cell", "left").join(some_doc, "cell", "left").join(lost, "cell", "left")
    n_cited = F.coalesce("n_cited", F.lit(0))
    short = F.exists("literals", lambda x: F.length(F.regexp_replace(x, r"^\s+|\s+$", "")) < registry.MIN_LITERAL_CHARS)
    reason = _first(
        (content.is_absent(F.col("literals"), "container"), "nothing expected"),
        (short, "literal too short"),
        (F.col("expect_artifacts").isNull(), "artifact count not declared"),
        (n_cited != F.col("expect_artifacts"), "artifact count differs"),
        (F.col("n_archived") < n_cited, "not archived"),
        (~F.col("in_one"), "not in one document"),
    )
    out = joined.select("cell", reason.alias("reason"), F.coalesce("n_lost", F.lit(0)).alias("n_lost"), "lost", n_cited.alias("n_cited"))
    return out.select("cell", _verdict("reason", F.col("reason").isNull() & (F.col("n_cited") == 0)).alias("verdict"), "reason", "n_lost", "lost")


def count_in_retrieved(checks: DataFrame, cites: DataFrame, blobs: DataFrame) -> DataFrame:
    """Largest total over the literals of their occurrences in all cited documents = the claim.

    ``checks(cell, literals, expect_count)``.
    """
    counts = _literal_results(cites, checks, blobs, content.occurrences)
    most = counts.groupBy("cell", "literal").agg(F.sum("value").alias("n")).groupBy("cell").agg(F.max("n").alias("counted"))
    joined = checks.join(_archived(cites, blobs), "cell", "left").join(most, "cell", "left")
    unread = (
        content.is_absent(F.col("literals"), "container") | F.col("expect_count").isNull() | (F.coalesce("n_archived", F.lit(0)) == 0)
    )
    return joined.select(
        "cell", "counted", F.when(~unread, F.col("counted") == F.col("expect_count")).alias("verdict")
    )


# ------------------------------------------------------------------------ ranges and words

def range_check(ranged: DataFrame, listings: DataFrame, store: DataFrame) -> DataFrame:
    """One ranged artifact: length, digest, and its address at the recorded listing position.

    ``ranged(cell, url, range, sha256, index)``, ``listings(cell, kind, base, sha256)`` (the co-cited enumerations),
    ``store(sha256, body)`` holds the bytes of both.
    """
    one = ranged.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_ranged"), F.min("url").alias("url"), F.min("range").alias("range"),
        F.min("sha256").alias("sha256"), F.min("index").alias("index"),
    )
    listed = listings.select("cell", "kind", "base", F.col("sha256").alias("listing_sha256")).join(one.select("cell", "url", "index"), "cell")
    where = probes.arg_of(kind=F.col("kind"), base=F.col("base"), url=F.col("url"), index=F.col("index"))
    answers = probes.measure(probes.probe(one, "bytes", "sha256").unionByName(probes.probe(listed, "listed", "listing_sha256", where)), store, ["bytes", "listed"])
    listed = probes.answered(listed, answers, "listed", "listing_sha256", where, "list")
    member = F.col("list_n") > 0
    anchors = listed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_listings"),
        F.count_if(~F.coalesce("list_flag", F.lit(False))).alias("n_unreadable"),
        F.count_if(member).alias("n_members"),
        F.count_if(member & F.col("index").isNotNull() & ~F.col("list_text").eqNullSafe(F.col("url"))).alias("n_misplaced"),
    )
    joined = probes.answered(one.join(anchors, "cell", "left"), answers, "bytes", "sha256", F.lit(""), "body")
    before = _first(
        (F.col("n_ranged") != 1, "not one range"),
        (F.coalesce("n_listings", F.lit(0)) == 0, "cited alone"),
    )
    after = _first(
        (F.col("body_n") != content.range_length(F.col("range")), "length differs"),
        (~F.col("body_flag"), "digest differs"),
        (F.col("n_unreadable") > 0, "listing unreadable"),
        (F.col("n_misplaced") > 0, "other position"),
        (F.col("n_members") == 0, "not listed"),
        (F.col("index").isNull(), "no position recorded"),
    )
    unread = before.isNull() & ~F.col("body_read")
    return joined.select("cell", F.when(~unread, F.coalesce(before, after)).alias("reason"), unread.alias("unread")).select(
        "cell", _verdict("reason", F.col("unread")).alias("verdict"), "reason"
    )


def word_table(bodies: DataFrame, bound: str) -> DataFrame:
    """Word statistics of binary ``body`` at both widths, next to the input columns."""
    limit = F.col(bound).cast("long")
    return bodies.withColumns({"w16": word_stats(2)(F.col("body"), limit), "w32": word_stats(4)(F.col("body"), limit)})


def token_range_check(claims: DataFrame, store: DataFrame) -> DataFrame:
    """Bytes read at the declared width: count, bound, maximum; the other width must fail.

    ``claims(cell, sha256, width, count, vocab_bound, max_id)`` with width 2 or 4; ``store(sha256, body)``.  The other width is
    read only where its bound could fail.
    """
    bound, width = F.col("vocab_bound"), F.col("width")
    other_width = F.when(width == 4, 2).otherwise(4)
    other_could_fail = F.coalesce(F.when(other_width == 2, bound < 256**2).otherwise(bound < 256**4), F.lit(False))
    own, other = (probes.arg_of(width=w, bound=bound) for w in (F.when(width == 4, 4).otherwise(2), other_width))
    answers = probes.measure(
        probes.probe(claims, probes.WORDS, "sha256", own).unionByName(probes.probe(claims.where(other_could_fail), probes.WORDS, "sha256", other)), store, [probes.WORDS])
    joined = probes.answered(probes.answered(claims, answers, probes.WORDS, "sha256", own, "own"), answers, probes.WORDS, "sha256", other, "other")
    reason = _first(
        (~width.isin(2, 4), "unknown width"),
        (F.col("own_n") != F.col("count"), "word count differs"),
        (F.col("own_text").cast("long") > 0, "not below bound"),
        (other_could_fail & (F.col("other_n") > 0) & (F.col("other_text").cast("long") == 0), "width does no work"),
        (F.col("own_m") != F.col("max_id"), "maximum differs"),
    )
    return joined.select("cell", F.col("own_n").alias("n_words"), F.col("own_m").alias("max_word"), F.col("own_text").cast("long").alias("n_over"),
                         (~F.col("own_read")).alias("unread"), reason.alias("reason")).select(
        "cell", "n_words", "max_word", "n_over", _verdict("reason", F.col("unread")).alias("verdict"), "reason"
    )


# ---------------------------------------------------------------------------- enumerations

def item_digest_coverage(claims: DataFrame, entries: DataFrame, declared: DataFrame) -> DataFrame:
    """Do the enumerated files carry publisher digests, apart from declared non-content?

    ``claims(cell, expect_files, content_pattern, bound_items)``, ``entries(cell, path, oid)``
    (files only), ``declared(cell, path)`` (the non-content names).
    """
    names = declared.distinct().withColumn("declared", F.lit(True))
    joined = entries.join(claims.select("cell", "content_pattern"), "cell").join(names, ["cell", "path"], "left")
    excluded = F.coalesce("declared", F.lit(False))
    has_oid = F.coalesce(F.col("oid") != "", F.lit(False))
    good_oid = content.is_sha256(F.col("oid"))
    matches = F.coalesce(F.regexp_like("path", F.col("content_pattern")), F.lit(False))
    counts = joined.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(excluded & has_oid).alias("n_mislabelled"),
        F.count_if(excluded & matches).alias("n_greedy"),
        F.count_if(~excluded & ~matches).alias("n_uncovered"),
        F.count_if(~excluded & ~good_oid).alias("n_missing"),
        F.count_if(has_oid & ~good_oid).alias("n_malformed"),
    )
    listed = names.groupBy("cell").agg(F.count(F.lit(1)).alias("n_declared"))
    absent = names.join(entries.select("cell", "path"), ["cell", "path"], "left_anti").groupBy("cell").agg(F.count(F.lit(1)).alias("n_absent"))
    every = claims.join(counts, "cell", "left").join(listed, "cell", "left").join(absent, "cell", "left")
    some = F.coalesce("n_declared", F.lit(0)) > 0
    n_files = F.coalesce("n_files", F.lit(0))
    with_digest = n_files - F.coalesce("n_missing", F.lit(0))
    reason = _first(
        (F.col("expect_files").isNull() | (F.col("expect_files") == 0), "nothing expected"),
        (n_files != F.col("expect_files"), "file count differs"),
        (F.col("n_absent") > 0, "declared name absent"),
        (F.col("n_mislabelled") > 0, "declared name has digest"),
        (some & F.col("content_pattern").isNull(), "no content pattern"),
        (some & (F.col("n_greedy") > 0), "declared name looks like content"),
        (some & (F.col("n_uncovered") > 0), "name not covered"),
        (F.col("n_malformed") > 0, "malformed digest"),
        (F.col("bound_items").isNotNull() & (with_digest != F.col("bound_items")), "claimed count differs"),
        (F.col("bound_items").isNull() & (F.col("n_missing") > 0), "digest missing"),
    )
    return every.select("cell", with_digest.alias("n_with_digest"), reason.alias("reason")).withColumn("verdict", _verdict())


def weight_object(checks: DataFrame, store: DataFrame) -> DataFrame:
    """A real weight range from a file that the subject's own revision enumerates.

    One row per cell: ``cell, subject_repo, n_ranged, url, range, sha256, pinned_commit, listing_url,
    listing_sha256, expect_file, expect_range_bytes, expect_evidence_sha256``; ``store(sha256, body)`` holds the
    bytes of the ranged artifact and of the enumeration response.
    """
    file = urls.parse_pinned_url(F.col("url"))
    listing = urls.parse_pinned_url(F.col("listing_url"))
    parsed = checks.withColumns({"file": file, "listing": listing})
    where = probes.arg_of(repo=F.col("listing.repo"), revision=F.col("listing.revision"), file=F.col("file.path"))
    answers = probes.measure(
        probes.probe(parsed, "bytes", "sha256").unionByName(probes.probe(parsed, "head", "sha256", F.col("file.path")))
        .unionByName(probes.probe(parsed, "revision", "listing_sha256", where)), store, ["bytes", "head", "revision"])
    parsed = probes.answered(parsed, answers, "bytes", "sha256", F.lit(""), "body")
    parsed = probes.answered(parsed, answers, "head", "sha256", F.col("file.path"), "head")
    parsed = probes.answered(parsed, answers, "revision", "listing_sha256", where, "enum")
    before = _first(
        (F.coalesce("expect_range_bytes", F.lit(0)) == 0, "nothing expected"),
        (~F.col("file.shape").eqNullSafe("file") | ~F.col("listing.shape").eqNullSafe("model_revision"), "not pinned"),
        ((F.col("file.repo") != F.col("listing.repo")) | (F.col("file.revision") != F.col("listing.revision")), "identities differ"),
        (F.col("enum_text").isNotNull(), F.concat(F.lit("listing: "), F.col("enum_text"))),
        (F.col("subject_repo").isNotNull() & (F.col("listing.repo") != F.col("subject_repo")), "other subject"),
        (F.col("n_ranged") != 1, "not one range"),
        (~F.col("sha256").eqNullSafe(F.col("expect_evidence_sha256")), "other evidence"),
        (~F.col("file.path").eqNullSafe(F.col("expect_file")), "other file"),
        (~F.col("enum_flag"), "not enumerated"),
        (F.col("pinned_commit").isNotNull() & (F.col("pinned_commit") != F.col("listing.revision")), "other commit"),
        (~F.col("range").eqNullSafe(F.concat(F.lit("bytes=0-"), (F.col("expect_range_bytes") - 1).cast("string"))), "range differs"),
    )
    after = _first(
        (F.col("body_n") != F.col("expect_range_bytes"), "length differs"),
        (F.col("head_text").isNotNull(), F.col("head_text")),
        (~F.col("body_flag"), "digest differs"),
    )
    unread = before.isNull() & ~(F.col("body_read") & F.col("enum_read"))
    return parsed.select("cell", F.when(~unread, F.coalesce(before, after)).alias("reason"), unread.alias("unread")).select(
        "cell", _verdict("reason", F.col("unread")).alias("verdict"), "reason"
    )


def all_shard_digests(claims: DataFrame, shards: DataFrame, pointers: DataFrame) -> DataFrame:
    """Cited pointers must be exactly the enumerated shards, each once, each digest agreeing.

    ``claims(cell, expect_shards)``, ``shards(cell, file)``, ``pointers(cell, file, lfs_oid,
    sha256, body)``.  Both sides are counted per (cell, file); the bodies are reduced to
    flags before the shuffle.
    """
    oid = content.parse_pointer(F.col("body"))["oid"]
    sides = shards.distinct().select("cell", "file", F.lit(1).alias("e"), *[F.lit(0).alias(c) for c in ("p", "unread", "no_oid", "bad_oid", "bad_digest")]).unionByName(
        pointers.select(
            "cell", "file", F.lit(0).alias("e"), F.lit(1).alias("p"), F.col("body").isNull().cast("int").alias("unread"),
            (F.col("body").isNotNull() & oid.isNull()).cast("int").alias("no_oid"),
            F.coalesce(oid != F.col("lfs_oid"), F.lit(False)).cast("int").alias("bad_oid"),
            F.coalesce(F.sha2("body", 256) != F.col("sha256"), F.lit(False)).cast("int").alias("bad_digest"),
        )
    )
    per_file = sides.groupBy("cell", "file").agg(*[F.sum(c).alias(c) for c in ("e", "p", "unread", "no_oid", "bad_oid", "bad_digest")])
    counts = per_file.groupBy("cell").agg(
        F.sum("e").alias("n_shards"),
        F.count_if((F.col("p") > 0) & (F.col("e") == 0)).alias("n_extra"),
        F.count_if((F.col("e") > 0) & (F.col("p") == 0)).alias("n_missing"),
        F.count_if(F.col("p") > 1).alias("n_duplicate"),
        *[F.sum(c).alias(f"n_{c}") for c in ("unread", "no_oid", "bad_oid", "bad_digest")],
    )
    joined = claims.join(counts, "cell", "left")
    problems = F.filter(
        F.array(
            _first((F.col("n_unread") > 0, "not archived")), _first((F.col("n_no_oid") > 0, "no digest in pointer")),
            _first((F.col("n_bad_oid") > 0, "digest differs from ledger")), _first((F.col("n_bad_digest") > 0, "bytes differ")),
            _first((F.col("n_duplicate") > 0, "duplicate pointer")),
            _first(((F.col("n_extra") > 0) | (F.col("n_missing") > 0), "not set-equal")),
        ),
        lambda p: p.isNotNull(),
    )
    reason = F.when(F.coalesce("expect_shards", F.lit(0)) == 0, "nothing expected").when(
        F.coalesce("n_shards", F.lit(0)) != F.col("expect_shards"), "shard count differs"
    ).otherwise(F.nullif(F.array_join(problems, "; "), F.lit("")))
    return joined.select("cell", reason.alias("reason")).withColumn("verdict", _verdict())


def signed_commit(checks: DataFrame, store: DataFrame) -> DataFrame:
    """Self-authenticating commit, committer, signature flag, signer, subject line, shared signer.

    ``checks(subject, sha256, fingerprint, intact, expect_revision, expect_committer,
    expect_signed, expect_fingerprint, expect_subject_line, expect_shared)``, ``store(sha256, body)``; the signer
    fingerprint of the bytes is an input column.
    """
    signers = (
        checks.filter("expect_fingerprint is not null").groupBy(F.col("expect_fingerprint").alias("_fpr"))
        .agg(F.countDistinct("subject").alias("n_signed"))
    )
    answers = probes.measure(probes.probe(checks, "commit", "sha256", F.col("expect_revision")), store, ["commit"])
    parsed = probes.answered(checks, answers, "commit", "sha256", F.col("expect_revision"), "commit")
    parsed = parsed.withColumn("c", F.from_json("commit_text", probes.COMMIT))
    # rows without a fingerprint have nobody to share with and stay out of the join
    named = parsed.where("fingerprint is not null").join(signers, F.col("fingerprint") == F.col("_fpr"), "left").drop("_fpr")
    joined = named.unionByName(parsed.where("fingerprint is null").withColumn("n_signed", F.lit(None).cast("long")))
    own = F.col("expect_fingerprint").eqNullSafe(F.col("fingerprint")).cast("int")
    others = F.coalesce("n_signed", F.lit(0)) - own
    signed = F.col("c.signed")
    reason = _first(
        (F.col("expect_revision").isNull(), "no revision declared"),
        (~F.col("commit_flag"), "other revision"),
        (F.col("expect_signed").isNull(), "signed flag not declared"),
        (F.col("expect_committer").isNull(), "committer not declared"),
        (~F.col("c.committer").eqNullSafe(F.col("expect_committer")), "other committer"),
        (signed != F.col("expect_signed"), "signed flag differs"),
        (signed & ~F.coalesce("intact", F.lit(True)), "signature damaged"),
        (signed & ~F.col("fingerprint").eqNullSafe(F.col("expect_fingerprint")), "other signer"),
        (signed & F.col("expect_subject_line").isNull(), "subject line not declared"),
        (signed & ~F.col("c.subject_line").eqNullSafe(F.col("expect_subject_line")), "other subject line"),
        (signed & F.col("expect_shared").isNull(), "shared flag not declared"),
        (signed & F.col("expect_shared") & (others < 2), "signer not shared"),
    )
    unread = F.col("expect_revision").isNotNull() & ~F.col("commit_read")
    return joined.select("subject", F.when(~unread, reason).alias("reason"), unread.alias("unread")).select(
        "subject", _verdict("reason", F.col("unread")).alias("verdict"), "reason"
    )


def repo_tree_check(claims: DataFrame, entries: DataFrame, required: DataFrame) -> DataFrame:
    """Required paths exist in an untruncated tree as files of real size, with the manifest.

    ``claims(cell, truncated, manifest)``, ``entries(cell, path, type, size)``,
    ``required(cell, path)``.
    """
    files = entries.filter("type = 'blob'").groupBy("cell", "path").agg(F.max("size").alias("size"))
    wanted = required.select("cell", "path", F.lit(True).alias("is_entry")).unionByName(
        claims.filter("manifest is not null").select("cell", F.col("manifest").alias("path"), F.lit(False).alias("is_entry"))
    )
    found = wanted.join(files, ["cell", "path"], "left").groupBy("cell").agg(
        F.count_if(F.col("is_entry")).alias("n_required"),
        F.count_if(F.col("is_entry") & F.col("size").isNull()).alias("n_missing"),
        F.count_if(F.col("is_entry") & (F.col("size") < registry.STUB_BYTES)).alias("n_stubs"),
        F.count_if(~F.col("is_entry") & F.col("size").isNull()).alias("no_manifest"),
    )
    reason = _first(
        (F.coalesce("n_required", F.lit(0)) == 0, "nothing required"),
        (F.coalesce("truncated", F.lit(False)), "truncated"),
        (F.col("n_missing") > 0, "path missing"),
        (F.col("n_stubs") > 0, "stub"),
        (F.col("manifest").isNull(), "manifest not declared"),
        (F.col("no_manifest") > 0, "manifest missing"),
    )
    return claims.join(found, "cell", "left").select("cell", "n_missing", "n_stubs", reason.alias("reason")).withColumn("verdict", _verdict())


def release_artifact_patterns(claims: DataFrame, entries: DataFrame, patterns: list[str], exemplars: list[str]) -> DataFrame:
    """Distinct files matching any declared pattern = the claim, with a probe of the patterns.

    ``claims(cell, expect_matches)``, ``entries(cell, path, type)``.  Patterns and exemplars
    are the check's own short lists, so matching is one expression per row, not a join.
    """
    path = F.col("path")
    insensitive = [f"(?i){p}" for p in patterns]

    def matches(text: Column) -> Column:
        out = F.lit(False)
        for p in insensitive:
            out = out | text.rlike(p)
        return out

    dead = F.lit(False)
    for p in insensitive:
        dead = dead | _no_exemplar(p, exemplars)
    unmatched = F.lit(False)
    for x in exemplars:
        unmatched = unmatched | ~matches(F.lit(x))
    counts = entries.groupBy("cell").agg(
        F.count_if(F.col("type") == "file").alias("n_files"),
        F.count_if(F.col("type") == "directory").alias("n_directories"),
        F.countDistinct(F.when((F.col("type") == "file") & matches(path), path)).alias("n_matches"),
        F.count_if((F.col("type") == "file") & path.isin(exemplars)).alias("n_leaked"),
    )
    reason = _first(
        (F.lit(not patterns) | F.col("expect_matches").isNull(), "nothing declared"),
        (F.col("n_directories") > 0, "unexpanded directory"),
        (F.coalesce("n_files", F.lit(0)) == 0, "empty enumeration"),
        (F.lit(not exemplars), "no probe"),
        (dead, "dead pattern"),
        (unmatched, "unmatched exemplar"),
        (F.col("n_leaked") > 0, "exemplar is published"),
        (F.col("n_matches") != F.col("expect_matches"), "count differs"),
    )
    return claims.join(counts, "cell", "left").select("cell", "n_files", "n_matches", reason.alias("reason")).withColumn("verdict", _verdict())


def _no_exemplar(pattern: str, exemplars: list[str]) -> Column:
    """True when a pattern matches none of the exemplars (a constant the optimizer folds)."""
    hit = F.lit(False)
    for x in exemplars:
        hit = hit | F.lit(x).rlike(pattern)
    return ~hit


def search_replay(claims: DataFrame, expected_totals: DataFrame, expected_digests: DataFrame, responses: DataFrame, adjudications: DataFrame, store: DataFrame) -> DataFrame:
    """The recorded search, recomputed from its archived responses.

    ``claims(subject, name, expect_queries, positives, score)``, ``expected_totals(subject,
    term, total)``, ``expected_digests(subject, sha256)``, ``responses(subject, term, url,
    sha256)``, ``adjudications(subject, hit, has_axis17, axis17)``, ``store(sha256, body)``.
    """
    answers = probes.measure(probes.probe(responses, "feed", "sha256"), store, ["feed"])
    read = probes.answered(responses, answers, "feed", "sha256", F.lit(""), "feed")
    named = read.join(claims.select("subject", "name"), "subject").select(
        "subject", "term", "sha256", F.col("feed_n").alias("header"), F.col("feed_m").alias("n_entries"),
        urls.query_names(F.col("url"), F.col("name")).alias("named"), (~F.col("feed_read")).alias("unread"),
    )
    per_term = named.groupBy("subject", "term").agg(
        F.max("header").alias("header"), F.sum("n_entries").alias("counted"),
        F.count_if(~F.col("named")).alias("unnamed"), F.count_if("unread").alias("unread"),
        F.count_if(~F.col("unread") & F.col("header").isNull()).alias("headless"),
    )
    terms = per_term.join(expected_totals, ["subject", "term"], "full_outer").groupBy("subject").agg(
        F.count_if(F.col("unread").isNotNull()).alias("n_terms"),
        F.sum("unread").alias("n_unread"), F.sum("unnamed").alias("n_unnamed"), F.sum("headless").alias("n_headless"),
        F.count_if(F.col("total").isNotNull() & F.col("unread").isNull()).alias("n_absent"),
        F.count_if(F.col("total") != F.col("header")).alias("n_moved"),
        F.count_if(F.col("counted") != F.col("header")).alias("n_short"),
    )
    digests = responses.select("subject", "sha256").distinct().withColumn("g", F.lit(1)).join(
        expected_digests.distinct().withColumn("w", F.lit(1)), ["subject", "sha256"], "full_outer"
    ).groupBy("subject").agg(F.count_if(F.col("g").isNull() | F.col("w").isNull()).alias("n_digest_diff"))
    joined = claims.join(terms, "subject", "left").join(digests, "subject", "left").join(adjudications, "subject", "left")
    before = _first(
        (F.col("name").isNull() | F.col("expect_queries").isNull() | F.col("positives").isNull(), "incomplete record"),
        ((F.col("score") == 0) & (F.col("positives") != 0), "zero with a positive"),
        (F.col("hit").isNotNull() & F.col("has_axis17") & (F.col("hit") != F.coalesce(F.col("axis17") > 0, F.lit(False))), "adjudication disagrees"),
        (F.coalesce("n_terms", F.lit(0)) != F.col("expect_queries"), "query count differs"),
        (F.col("n_digest_diff") > 0, "responses differ"),
    )
    after = _first(
        (F.col("n_unnamed") > 0, "query without the name"),
        (F.col("n_headless") > 0, "no total in response"),
        (F.col("n_absent") > 0, "term not archived"),
        (F.col("n_moved") > 0, "total moved"),
        (F.col("n_short") > 0, "entries differ from total"),
    )
    unread = before.isNull() & (F.col("n_unread") > 0)
    return joined.select("subject", F.when(~unread, F.coalesce(before, after)).alias("reason"), unread.alias("unread")).select(
        "subject", _verdict("reason", F.col("unread")).alias("verdict"), "reason"
    )


# -------------------------------------------------------------------- summaries and archive

def replay_summary(verdicts: DataFrame) -> DataFrame:
    """``verdicts(class, verdict)`` → passed / failed / unreplayable per class."""
    v = F.col("verdict")
    return verdicts.groupBy("class").agg(
        F.count_if(v).alias("passed"), F.count_if(~v).alias("failed"), F.count_if(v.isNull()).alias("unreplayable"),
        F.count(F.lit(1)).alias("n"),
    )


def archive_verify(cited: DataFrame, manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """Cited addresses whose archive entry is missing, disagrees, or does not hash to its digest.

    ``cited(url, sha256)``, ``manifest(url, manifest_sha256, stored)``; only bodies that a stored entry cites are
    hashed, each once.
    """
    entries = cited.distinct().join(manifest, "url", "left")
    answers = probes.measure(probes.probe(entries.where("stored and manifest_sha256 = sha256"), "bytes", "sha256"), blobs, ["bytes"])
    joined = probes.answered(entries, answers, "bytes", "sha256", F.lit(""), "body")
    reason = _first(
        (F.col("manifest_sha256").isNull(), "not in manifest"),
        (F.col("manifest_sha256") != F.col("sha256"), "manifest disagrees"),
        (F.col("stored") & ~F.col("body_read"), "bytes missing"),
        (F.col("stored") & ~F.col("body_flag"), "bytes differ"),
    )
    return joined.select("url", "sha256", reason.alias("reason")).filter("reason is not null")


def unreferenced_blobs(blobs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stored digests that no manifest row names."""
    return blobs.select("sha256").join(manifest.select(F.col("manifest_sha256").alias("sha256")), "sha256", "left_anti")
