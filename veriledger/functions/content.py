"""Column functions over archived bytes, dates, digests and notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriledger.sources import registry

# fixed values: access-gate and pointer markers
HARD_MARKERS = [
    "checking your browser", "cf-browser-verification", "verify you are human",
    "just a moment...", "anubis", "enable javascript and cookies to continue",
]
SOFT_MARKERS = [
    "sign in to continue", "log in to continue", "please log in", "access denied",
    "you need to agree", "accept the license", "gated repo", "authorization required",
    "request access", "403 forbidden", "rate limit", "captcha",
]
THROTTLE_PHRASES = ["rate limit", "abuse detection"]
POINTER_PREFIX = "version https://git-lfs.github.com/spec/v1"
WEIGHT_MAGIC = ["7B", "504B", "80"]
SHA256 = "^[0-9a-f]{64}$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def is_iso_date(value: Column) -> Column:
    return value.rlike(ISO_DATE)


def is_real_past_date(value: Column, as_of: Column) -> Column:
    """A calendar date that is not later than ``as_of`` (passed in, never 'now')."""
    parsed = F.when(is_iso_date(value), F.try_to_date(value, "yyyy-MM-dd"))
    return F.coalesce(parsed <= as_of, F.lit(False))


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike(SHA256), F.lit(False))


def is_absent(value: Column, shape: str = "scalar") -> Column:
    """Missing, or an empty container. Zero and false are present."""
    if shape == "text":
        return value.isNull() | (value == "")
    if shape == "container":
        return value.isNull() | (F.size(value) == 0)
    if shape == "json":
        return value.isNull() | value.isin("", "[]", "{}")
    return value.isNull()


def is_blank(value: Column) -> Column:
    """Null, empty or white space of any kind."""
    return F.coalesce(F.regexp_replace(value, r"^\s+", ""), F.lit("")) == ""


def range_length(spec: Column) -> Column:
    first = F.regexp_extract(spec, r"^(?:.*=)?(\d+)-(\d+)$", 1)
    last = F.regexp_extract(spec, r"^(?:.*=)?(\d+)-(\d+)$", 2)
    return F.nullif(last, F.lit("")).cast("long") - F.nullif(first, F.lit("")).cast("long") + 1


def _first_marker(text: Column, markers: list[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(m)), F.lit(m)) for m in markers])


def is_pointer(body: Column) -> Column:
    return F.startswith(F.regexp_replace(body, r"^\s+", ""), F.lit(POINTER_PREFIX))


def classify_wall(body: Column, status: Column, page_bytes: int = 4096, least_bytes: int = 64) -> Column:
    """Why a retrieved body is not the document, or null when it is.

    The whole body is searched.  Two sizes are part of the classification: a body below
    ``least_bytes`` is no document, and the softer markers count only in a page of at most
    ``page_bytes``, because a manual may well mention signing in.
    """
    size = F.octet_length(body)
    low = F.lower(body)
    hard = _first_marker(low, HARD_MARKERS)
    soft = _first_marker(low, SOFT_MARKERS)
    return (
        F.when(~status.eqNullSafe("200"), F.concat(F.lit("http:"), F.coalesce(status, F.lit("none"))))
        .when(is_pointer(body), F.lit(None))
        .when(size < least_bytes, F.lit("too-small"))
        .when(hard.isNotNull(), F.concat(F.lit("challenge:"), hard))
        .when((size <= page_bytes) & soft.isNotNull(), F.concat(F.lit("gate:"), soft))
    )


def is_throttled(status: Column, body: Column) -> Column:
    low = F.lower(F.coalesce(body, F.lit("")))
    refused = F.lit(False)
    for phrase in THROTTLE_PHRASES:
        refused = refused | F.contains(low, F.lit(phrase))
    return F.coalesce(status.isin("429", "503") | ((status == "403") & refused), F.lit(False))


def parse_pointer(body: Column) -> Column:
    """``struct(is_pointer, oid, size)`` of a large-file pointer."""
    return F.struct(
        is_pointer(body).alias("is_pointer"),
        F.nullif(F.regexp_extract(body, "oid sha256:([0-9a-f]{64})", 1), F.lit("")).alias("oid"),
        F.nullif(F.regexp_extract(body, r"(?m)^size (\d+)$", 1), F.lit("")).cast("long").alias("size"),
    )


def _byte_hex(body: Column, start: int, length: int) -> Column:
    return F.hex(F.substring(body, start, length))


def little_endian_u64(body: Column) -> Column:
    reversed_hex = F.concat(*[_byte_hex(body, i, 1) for i in range(8, 0, -1)])
    return F.conv(reversed_hex, 16, 10).cast("decimal(20,0)")


def sniff_header(body: Column, name: Column) -> Column:
    """Why binary ``body`` does not look like the weight file ``name``, or null when it does."""
    size = F.octet_length(body)
    header = little_endian_u64(body)
    magic = F.lit(False)
    for prefix in WEIGHT_MAGIC:
        magic = magic | F.startswith(_byte_hex(body, 1, 4), F.lit(prefix))
    plausible = (header > 0) & (header < size * 4096) & _byte_hex(body, 9, 2).isin("7B22", "7B7D")
    pointer_hex = POINTER_PREFIX.encode().hex().upper()
    return (
        F.when(_byte_hex(body, 1, len(POINTER_PREFIX)) == pointer_hex, "pointer")
        .when(F.endswith(name, F.lit(".safetensors")) & (size < 8), "too short")
        .when(F.endswith(name, F.lit(".safetensors")) & ~plausible, "no safetensors header")
        .when(~F.endswith(name, F.lit(".safetensors")) & ~magic, "no weight magic")
    )


def primary_object(names: Column) -> Column:
    """Of an array of names: the first ``.safetensors`` by name, else the first by name."""
    tensors = F.filter(names, lambda n: F.endswith(n, F.lit(".safetensors")))
    return F.coalesce(F.array_min(tensors), F.array_min(names))


def primary_object_of(name: Column) -> Column:
    """The same choice as an aggregate over rows, combinable map-side."""
    return F.min_by(name, F.struct((~F.endswith(name, F.lit(".safetensors"))).alias("other"), name.alias("name")))


def git_object_id(body: Column) -> Column:
    """Object id of binary commit bytes: sha1 over the typed, length-prefixed object."""
    head = F.concat(F.lit("commit "), F.octet_length(body).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), body))


def commit_fields(text: Column) -> Column:
    """``struct(committer, subject_line, signed)`` of a commit object read as text."""
    first_line = F.rtrim(F.regexp_extract(text, r"\n\n\s*(\S[^\n]*)", 1))
    return F.struct(
        F.nullif(F.regexp_extract(text, r"(?m)^committer .+? <(.+?)>", 1), F.lit("")).alias("committer"),
        F.nullif(first_line, F.lit("")).alias("subject_line"),
        F.contains(text, F.lit("gpgsig")).alias("signed"),
    )


def occurrences(text: Column, literal: Column) -> Column:
    """Non-overlapping, case-insensitive occurrences of a literal in a text."""
    low, lit_low = F.lower(text), F.lower(literal)
    removed = F.length(low) - F.length(F.replace(low, lit_low, F.lit("")))
    empty = F.length(lit_low) == 0  # an empty literal occurs at every byte boundary
    return F.when(empty, F.octet_length(low) + 1).otherwise(F.try_divide(removed, F.length(lit_low))).cast("long")


def affected_axes(text: Column) -> Column:
    """Axes a positive adjudication names, restricted to those a search can settle."""
    named = F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"axis\s*(\d+)"), F.lit(1)),
        lambda n: n.try_cast("int"),
    )
    return F.array_sort(F.array_intersect(named, F.array(*[F.lit(a) for a in registry.HIT_AXES])))


def signals_in(text: Column, phrases: list[str]) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def _stated(text: Column, otherwise: str) -> Column:
    return F.when(is_blank(text), F.lit(otherwise)).otherwise(text)


def render_note(axis: Column, name: Column, hit: Column, totals: Column, n_candidates: Column,
                n_screened: Column, rationale: Column, title: Column, url: Column, quote: Column) -> Column:
    """The narrative of a searched cell: what was run, what was found, what bounds it.

    A positive names its report by ``title``, ``url`` and ``quote`` and says of each that is blank that it is not recorded.
    """
    word = registry.lookup(registry.HIT_AXES, axis)
    head = F.when(hit, F.concat(F.lit("Found: a third party reports a "), word, F.lit(" reproduction."))).otherwise(
        F.concat(F.lit("Nothing found: no third party reports a "), word, F.lit(" reproduction."))
    )
    body = F.format_string(
        " Searched for '%s' (hits %s): %d distinct candidates, %d kept by the sentence screen.",
        name, totals, n_candidates, n_screened,
    )
    report = F.when(hit, F.format_string(
        " The report is %s at %s: %s.",
        _stated(title, "(title not recorded)"), _stated(url, "(address not recorded)"), _stated(quote, "(quote not recorded)"),
    )).otherwise("")
    return F.concat(head, body, report, F.lit(" "), F.coalesce(rationale, F.lit("No adjudication recorded.")))
