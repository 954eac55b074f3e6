"""Personal data in texts, plain or disguised, with offsets into the source.

Plain identifiers are found on the text itself.  Then a transducer rewrites disguises and keeps,
for every character it writes, the source range it comes from: look-alike letters and digits of
other scripts and widths, invisible characters, ``[at]`` / ``(dot)`` and spelled ``at`` / ``dot`` in an
address, digits spelled as words.  The same detectors run on what it wrote, and the spans found there
are mapped back.  Plain spans always stay; a mapped span is added if it holds a rewritten
character and does not lie within a plain span of its kind.

Offsets are code points, end exclusive.  Edge cases: null and empty texts have no spans.  Texts are scanned
whole, in time linear in their length.  Repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriledger.llm.common import arrow_rows

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# Characters of an address, and the patterns of the four kinds.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other alphabets that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ⅼ": "l", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
INVISIBLE = frozenset("­​‌‍‎‏⁠﻿")
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_WORD = "(?:" + "|".join(DIGIT_WORDS) + ")"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
SPELLED_DIGITS = re.compile(rf"(?i)(?<![A-Za-z0-9])(?:plus +|\+ ?)?(?:{_WORD}|[0-9]+)(?:(?: dot | point |[ .-]){{1}}(?:{_WORD}|[0-9]+)(?![A-Za-z]))+")
DIGIT_PARTS = re.compile(rf"(?i){_WORD}(?![A-Za-z])|[0-9]+|plus +|\+ ?| (?:dot|point) |[ .-]")
BRACKETED = re.compile(rf"(?i) *{_OPEN} *(at|@|dot|\.) *{_CLOSE} *")
# A local part without an address after it matches too, with group 1 unset: it is passed over once, whatever its length.
SPELLED_ADDRESS = re.compile(
    r"(?i)(?<![A-Za-z0-9._%+-])[a-z0-9_%+-]++(?:(?:\.| dot )[a-z0-9_%+-]++)*+((?: at |@)[a-z0-9-]++(?:(?:\.| dot )[a-z0-9-]++)+(?![A-Za-z0-9-]))?")
ADDRESS_PARTS = re.compile(r"(?i) (at|dot) ")


def _plain_char(c: str) -> str | None:
    """ASCII character that ``c`` stands for, empty for an invisible one, None if it stands for itself."""
    if c < "\x80":
        return None
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded < "\x80" else None


class _Folds(dict):
    def __missing__(self, c):
        self[c] = found = _plain_char(c)
        return found


_FOLDS = _Folds()


class Tape:
    """A rewritten text; ``source[i]`` is the source range of its character i and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))
        self.changed = [False] * len(text)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply (start, end, new) edits, ascending and apart; each new character covers the whole range it replaces."""
        if not edits:
            return
        text, start, end, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            changed += self.changed[at:a]
            text.append(new)
            start += [self.start[a]] * len(new)
            end += [self.end[b - 1]] * len(new)
            changed += [True] * len(new)
            at = b
        text.append(self.text[at:])
        self.text = "".join(text)
        self.start, self.end, self.changed = start + self.start[at:], end + self.end[at:], changed + self.changed[at:]

    def source(self, span: Span) -> Span | None:
        """Source range of a span that holds a rewritten character or an inner gap, else None."""
        a, b = span
        lo, hi = self.start[a], self.end[b - 1]
        return (lo, hi) if hi - lo != b - a or any(self.changed[a:b]) else None


def _fold_edits(text: str) -> list[tuple[int, int, str]]:
    return [(i, i + 1, new) for i, c in enumerate(text) if c >= "\x80" and (new := _FOLDS[c]) is not None]


def _digit_edits(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits of runs with at least four digits and at least one word."""
    edits = []
    for run in SPELLED_DIGITS.finditer(text):
        parts = list(DIGIT_PARTS.finditer(run[0]))
        words = [p[0].lower() in DIGIT_WORDS for p in parts]
        if not any(words) or sum(w or p[0].isdigit() for w, p in zip(words, parts, strict=True)) < 4:
            continue
        for i, p in enumerate(parts):
            a, b, low = run.start() + p.start(), run.start() + p.end(), p[0].lower()
            if words[i]:
                edits.append((a, b, DIGIT_WORDS[low]))
            elif low.strip() in ("dot", "point"):
                edits.append((a, b, "."))
            elif low.strip() in ("plus", "+") and (low[0] == "p" or len(low) > 1):
                edits.append((a, b, "+"))
            elif low == " " and 0 < i < len(parts) - 1 and (words[i - 1] or words[i + 1]):
                edits.append((a, b, ""))
    return edits


def _address_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    if not ADDRESS_PARTS.search(text):
        return edits
    for found in SPELLED_ADDRESS.finditer(text):
        if found[1] is None:
            continue
        edits += [(found.start() + p.start(), found.start() + p.end(), "@" if p[1].lower() == "at" else ".")
                  for p in ADDRESS_PARTS.finditer(found[0])]
    return edits


def _bracket_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "@" if m[1].lower() in ("at", "@") else ".") for m in BRACKETED.finditer(text)]


def deobfuscated(text: str) -> Tape | None:
    """The rewritten text, or None if nothing was rewritten."""
    tape = None
    for edits_of in (_fold_edits, _bracket_edits, _digit_edits, _address_edits):
        now = text if tape is None else tape.text
        if edits_of is _fold_edits and now.isascii():
            continue
        if edits := edits_of(now):
            tape = tape or Tape(text)
            tape.replace(edits)
    return tape


def emails(text: str) -> list[Span]:
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            free = domain.end()
            found.append((start, free))
        at = text.find("@", at + 1)
    return found


def ips(text: str) -> list[Span]:
    return [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def find_in(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(plain spans, all spans) by kind, each in ascending order."""
    base = {kind: find(text) for kind, find in DETECTORS.items()}
    tape = deobfuscated(text)
    if tape is None:
        return base, base
    every = {}
    for kind, find in DETECTORS.items():
        # plain spans of a kind ascend and do not overlap: only the last one that starts no later can hold another
        plain, taken = sorted(base[kind]), list(base[kind])
        starts = [a for a, _ in plain]
        for span in find(tape.text):
            source = tape.source(span)
            if source:
                at = bisect_right(starts, source[0]) - 1
                if at < 0 or source[1] > plain[at][1]:
                    taken.append(source)
        every[kind] = sorted(taken)
    return base, every


def _listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


SPAN_TYPE = "array<struct<kind:string,start:long,end:long,disguised:boolean>>"


def find(documents: DataFrame) -> DataFrame:
    """``doc_id, spans``: every span of every text with its kind, offsets and whether it was disguised."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())]))
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = find_in(text or "")
                plain = {k: set(base[k]) for k in KINDS}
                rows.append([{"kind": k, "start": a, "end": b, "disguised": (a, b) not in plain[k]} for k in KINDS for a, b in every[k]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return arrow_rows(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, spans {SPAN_TYPE}")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, spans = [], [], []
        for text in batch.column(1).to_pylist():
            base, every = find_in(text or "")
            counts.append([len(base[kind]) for kind in KINDS])
            digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
            spans.append(_listed(every))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"])


def digest(documents: DataFrame) -> DataFrame:
    """Counts and digest of the plain spans, and the list of all spans, per document."""
    return arrow_rows(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _digests, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
