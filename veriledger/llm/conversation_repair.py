"""Conversation structure repair by depth-first branch and bound.

A conversation's role initials have to spell ``(s?(ua)+)?``.  Every row is kept (cost 0), given the role user or
assistant (1) or deleted (2, a must for blank and repeated rows); an empty user or assistant turn may be put in anywhere
(5); a truncated row that stays costs 5 more.  The cheapest list of edits is wanted, the ASCII-least of equal ones.

A first dive along the least bounds gives the incumbent (cost, audit).  The search then walks edits depth first in ASCII order
with a stack of its own.  A node is (rows consumed, state of the role pattern).  It is cut when its cost and a lower bound of
the suffix exceed the incumbent's cost, or equal it with an audit that is no smaller, or when an earlier path came to the same
node as cheaply: at equal cost no audit is a prefix of another, so the earlier one is the smaller.  The search ends
when the stack is empty, which proves the incumbent.  Suffix bounds are computed backwards from the rows alone;
they are tight, so a conversation costs time in proportion to its rows, and they are kept for every ``BLOCK``-th row and
computed again inside a block, so that a conversation of any length takes some thirty bytes a row.

In Spark, only one row of a few bytes per distinct (conversation, turn, role, text) goes to the search: counts combine before
the shuffle and the first of equal rows is found by an aggregate and a join on their digest, so neither a repeated
turn nor a conversation with a third of all rows is gathered with its texts.  The audits then meet the texts in one sorted
pass that streams: a row at a time is put into the digest.  One conversation is one task there, because its digest is sequential.

Edge cases: a null role or text is one space; null turns come first; rows of one turn are ordered by the digest of role
and text (SHA-256, which also tells repeated rows); null ids are one conversation.  A conversation whose rows are all
dropped has zeros, an empty audit and the digest of nothing.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
INITIALS = "sua"
START, SYSTEM, USER, ASSISTANT = range(4)
FINE, BLANK, DUPLICATE, CUT = range(4)
FAR = 1 << 60
SAME, SMALLER, LARGER = range(3)
BLOCK = 4096
SHORT, REMEMBERED = 64, 50_000
SPACES = r"[^\x20\x09-\x0D]"

# kept[state][initial]: the state after a kept row, None where the pattern forbids it
KEPT = [[SYSTEM, USER, None, None], [None, USER, None, None], [None, None, ASSISTANT, None], [None, USER, None, None]]
CALLED = [USER, USER, ASSISTANT, USER]


def _edge(code: int, state: int, letter: str) -> tuple[int, int] | None:
    """(cost, next state) of an edit of a row of this code, None where it is not allowed."""
    if letter == "D":
        return DELETE, state
    if letter == "I":
        return INSERT, CALLED[state]
    fault = code & 3
    if fault in (BLANK, DUPLICATE):
        return None
    extra = TRUNCATED if fault == CUT else 0
    if letter == "R":
        return REROLE + extra, CALLED[state]
    after = KEPT[state][code >> 2]
    return None if after is None else (KEEP + extra, after)


LETTERS = "DIKR"
EDGES = [[[_edge(code, state, x) for x in LETTERS] for state in range(4)] for code in range(16)]


def _with_inserts(c: list[int]) -> tuple[int, int, int, int]:
    user, assistant = min(c[2], INSERT + c[3]), min(c[3], INSERT + c[2])
    return min(c[0], INSERT + user), min(c[1], INSERT + user), user, assistant


class SuffixBounds:
    """``at(i, state)``: at least what the rows from the i-th on cost from that state."""

    def __init__(self, codes: bytes):
        self.codes, self.ends, self.block, self.values = codes, {}, -1, []
        value = _with_inserts([0, FAR, FAR, 0])
        for i in range(len(codes), -1, -1):
            if i < len(codes):
                value = self._before(value, codes[i])
            if i % BLOCK == 0 or i == len(codes):
                self.ends[i] = value

    @staticmethod
    def _before(after: tuple, code: int) -> tuple:
        here = []
        for state in range(4):
            d, _, k, r = EDGES[code][state]
            c = d[0] + after[d[1]]
            for e in (k, r):
                if e is not None and e[0] + after[e[1]] < c:
                    c = e[0] + after[e[1]]
            here.append(c)
        return _with_inserts(here)

    def at(self, i: int, state: int) -> int:
        block = i // BLOCK
        if block != self.block:
            stop = min((block + 1) * BLOCK, len(self.codes))
            value, values = self.ends[stop], [self.ends[stop]]
            for k in range(stop - 1, block * BLOCK - 1, -1):
                value = self._before(value, self.codes[k])
                values.append(value)
            self.block, self.values = block, values[::-1]
        return self.values[i - block * BLOCK][state]


def _dive(codes: bytes, bounds) -> tuple[int, bytearray]:
    """A first incumbent: always the edit whose cost and bound are least, the ASCII-least of equal ones."""
    i = cost = 0
    state, path = START, bytearray()
    while i < len(codes) or state not in (START, ASSISTANT):
        least = None
        for t in range(4) if i < len(codes) else (1,):
            edge = EDGES[codes[i] if i < len(codes) else 0][state][t]
            if edge is not None and (least is None or edge[0] + bounds.at(i + (t != 1), edge[1]) < least[0]):
                least = edge[0] + bounds.at(i + (t != 1), edge[1]), t, edge
        _, t, edge = least
        path.append(t)
        i, cost, state = i + (t != 1), cost + edge[0], edge[1]
    return cost, path


def search(codes: bytes, bounds=None) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, the ASCII-least of equal ones.

    ``codes``: a byte per row, 4 * initial (0 s, 1 u, 2 a, 3 other) + fault.  ``bounds``: anything with an admissible ``at``.
    """
    n, bounds = len(codes), bounds or SuffixBounds(codes)
    best, audit = _dive(codes, bounds)
    reached = array("q", [-1]) * (4 * (n + 1))  # dominance: cheapest arrival at a node
    path, states, tried = bytearray(), bytearray([START]), bytearray([0])
    order = bytearray([SAME])  # of the path up to a frame against the incumbent
    i = cost = 0
    while states:
        state, t = states[-1], tried[-1]
        if t == 4:
            states.pop(), tried.pop(), order.pop()
            if path:
                letter = path.pop()
                i -= letter != 1
                cost -= (EDGES[codes[i]] if letter != 1 else EDGES[0])[states[-1]][letter][0]
            continue
        tried[-1] = t + 1
        if i == n and t != 1:
            continue
        edge = EDGES[codes[i] if i < n else 0][state][t]
        if edge is None:
            continue
        at, spent, after = i + (t != 1), cost + edge[0], edge[1]
        least = spent + bounds.at(at, after)
        if least > best:
            continue
        rank = order[-1]
        if rank == SAME and (len(path) >= len(audit) or t != audit[len(path)]):
            rank = SMALLER if len(path) < len(audit) and t < audit[len(path)] else LARGER
        if least == best and rank == LARGER:
            continue
        node = 4 * at + after
        if 0 <= reached[node] <= spent:
            continue
        reached[node] = spent
        if at == n and after in (START, ASSISTANT):
            if spent < best or rank == SMALLER:
                best, audit = spent, path + bytes([t])
                order = bytearray([SAME]) * len(order)
            continue
        path.append(t), states.append(after), tried.append(0), order.append(rank)
        i, cost = at, spent
    return best, audit.translate(bytes.maketrans(bytes(range(4)), LETTERS.encode())).decode()


class Repairer:
    """Searches conversations; short ones of equal codes are searched once."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, str]] = {}

    def __call__(self, codes: bytes) -> tuple[int, str]:
        if len(codes) > SHORT:
            return search(codes)
        if codes not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[codes] = search(codes)
        return self.known[codes]


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows harmed by crc32(``conv_id:turn``) modulo 20; ``copies`` is 0 to 2."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"),
                                F.coalesce("text", space).alias("text"), (F.crc32(F.encode(name, "UTF-8")) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1).alias("copies"))


def _keyed(rows: DataFrame) -> DataFrame:
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null ")), F.lit(":"), F.length("role"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumn("key", F.unhex(F.sha2(F.encode(name, "UTF-8"), 256)))


def _light(rows: DataFrame) -> DataFrame:
    """A row per conversation, turn and distinct role and text, with its count and whether it is the first of its kind."""
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    initial = F.when((F.substring("role", 1, 1) == "") | (initial == 0), 3).otherwise(initial - 1)
    fault = F.when(~F.col("text").rlike(SPACES), BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(FINE)
    light = rows.select("conv_id", "turn", "key", "copies", (initial * 4 + fault).alias("code"))
    light = light.groupBy("conv_id", "turn", "key").agg(F.sum("copies").alias("n"), F.first("code").alias("code"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = light.where("n > 0").groupBy("key").agg(F.min(when).alias("first"))
    return light.join(first, "key", "left").select("conv_id", "turn", "key", "n", "code", when.eqNullSafe(F.col("first")).alias("leads"))


STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
LEGAL = {(0, 1), (1, 2), (2, 1)}


class _Conversation:
    """Counts of one conversation and the codes of its rows, fed in order."""

    def __init__(self, conv_id):
        self.conv_id, self.codes = conv_id, bytearray()
        self.low = self.high = self.last = None
        self.turns = self.illegal = 0

    def add(self, turn: int | None, n: int, code: int, leads: bool) -> None:
        if not n:
            return
        if turn is not None:
            self.turns += turn != self.last
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn
        initial, again = code >> 2, code & ~3 | DUPLICATE
        if self.codes:
            self.illegal += (self.codes[-1] >> 2, initial) not in LEGAL
        self.illegal += n - 1
        repeats = code if code & 3 == BLANK else again
        self.codes.append(code if leads else repeats)
        self.codes += bytes([repeats]) * (n - 1)

    def done(self, repairer: Repairer) -> tuple:
        codes = bytes(self.codes)
        cost, audit = repairer(codes)
        faults = codes.translate(bytes(c & 3 for c in range(256)))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, CUT)), self.illegal, cost, audit)


def _audits(light: DataFrame, id_type: str) -> DataFrame:
    """``conv_id``, the six counts and the audit of every conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer, held, out = Repairer(), None, []
        for batch in batches:
            kind = batch.column(0).type
            for conv_id, turn, n, code, leads in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or conv_id != held.conv_id:
                    if held is not None:
                        out.append(held.done(repairer))
                    held = _Conversation(conv_id)
                held.add(turn, n, code, leads)
            if out:
                yield _batch(out, kind)
                out = []
        if held is not None:
            yield _batch([held.done(repairer)], kind)

    def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.string())],
                                          names=["conv_id", *STATS, "audit"])

    ordered = light.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "key")
    schema = f"conv_id {id_type}, " + ", ".join(f"{s} long" for s in STATS) + ", audit string"
    return ordered.select("conv_id", "turn", "n", "code", "leads").mapInArrow(run, schema)


def edited(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation."""
    state, edits = START, iter(audit)
    for role, text in rows:
        for letter in edits:
            if letter == "D":
                break
            if letter == "K":
                state = KEPT[state][INITIALS.find(role[:1])]
                yield role, text
                break
            state = CALLED[state]
            yield ("user" if state == USER else "assistant"), text if letter == "R" else ""
            if letter == "R":
                break
    for _ in edits:
        state = CALLED[state]
        yield ("user" if state == USER else "assistant"), ""


def _met(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit row, followed by its rows in order, within one partition."""
    texts = rows.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "key", "role", "text", "copies", *[F.lit(None).cast("long").alias(s) for s in STATS])
    heads = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("key"),
                          F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(1).alias("copies"), *STATS)
    both = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "key")
    return both.select("conv_id", "kind", "role", "text", "copies", *STATS)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Iterator[tuple[str, str]]]]:
    """(id, counts and audit; rows) of each conversation of a partition made by ``_met``; the rows stream."""
    stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    row = next(stream, None)

    def rows():
        nonlocal row
        row = next(stream, None)
        while row is not None and row[1] == 1:
            for _ in range(row[4]):
                yield row[2], row[3]
            row = next(stream, None)

    while row is not None:
        conv_id, _, _, audit, _, *stats = row
        rest = rows()
        yield [conv_id, *stats, audit], rest
        for _ in rest:  # what the caller left
            pass


def _prepare(rows: DataFrame) -> tuple[DataFrame, str]:
    plain = _keyed(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                               F.coalesce("text", F.lit(" ")).alias("text"), (F.col("copies") if "copies" in rows.columns else F.lit(1)).alias("copies")))
    id_type = rows.select("conv_id").schema[0].dataType.simpleString()
    return _met(plain, _audits(_light(plain), id_type)), id_type


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation.

    ``rows(conv_id, turn, role, text)``, with ``copies`` if rows stand for several equal ones or for none.
    """
    met, id_type = _prepare(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for head, texts in _conversations(batches):
            digest, between = hashlib.sha256(), b""
            for role, text in edited(texts, head[-1]):
                digest.update(between + role.encode() + b":")
                digest.update(text.encode())
                between = b"\n"
            out.append((*head, digest.hexdigest()))
            if len(out) == 1000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        ids = pa.array(columns[0], pa.string() if id_type == "string" else pa.int64() if id_type == "bigint" else None)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.string()), pa.array(columns[8], pa.string())],
                                          names=["conv_id", *STATS, "audit", "repaired_sha256"])

    schema = f"conv_id {id_type}, " + ", ".join(f"{s} long" for s in STATS) + ", audit string, repaired_sha256 string"
    return met.mapInArrow(run, schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of the repaired conversations, turns numbered from 0."""
    met, id_type = _prepare(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for head, texts in _conversations(batches):
            for turn, (role, text) in enumerate(edited(texts, head[-1])):
                out.append((head[0], turn, role, text))
                if len(out) == 1000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    def _batch(found: list[tuple]) -> pa.RecordBatch:
        a, b, c, d = zip(*found, strict=True)
        ids = pa.array(a, pa.string() if id_type == "string" else pa.int64() if id_type == "bigint" else None)
        return pa.RecordBatch.from_arrays([ids, pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.string())], names=["conv_id", "turn", "role", "text"])

    return met.mapInArrow(run, f"conv_id {id_type}, turn long, role string, text string")
