"""Order-insensitive digests that combine map-side, and byte decoders.

A digest over sorted rows needs all rows in one place.  Here every row is hashed on
its own and the eight 32-bit words of the row hashes are summed, so partial sums
combine on the map side and no task ever holds more than one row; the final sha256
is taken over the eight sums and the row count.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "|"


def row_digest(*cols: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("None")) for c in cols]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def digest_sums(digest: Column, prefix: str = "w") -> list[Column]:
    """Mergeable aggregates: eight word sums of a hex digest column."""
    return [
        F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"{prefix}{i}")
        for i in range(8)
    ]


def close_digest(n: Column, prefix: str = "w") -> Column:
    words = [F.coalesce(F.col(f"{prefix}{i}").cast("string"), F.lit("0")) for i in range(8)]
    return F.sha2(F.concat_ws(":", n.cast("string"), *words), 256)


def multiset_digest(df: DataFrame, *cols: Column, by: list[str] | None = None) -> DataFrame:
    """``(by…, n_rows, fingerprint)`` of the rows of ``df``; row order never matters."""
    hashed = df.select(*(by or []), row_digest(*cols).alias("_digest"))
    grouped = hashed.groupBy(*by) if by else hashed.groupBy()
    summed = grouped.agg(F.count(F.lit(1)).alias("n_rows"), *digest_sums(F.col("_digest")))
    return summed.select(*(by or []), "n_rows", close_digest(F.col("n_rows")).alias("fingerprint"))


# Two primes below 2**31 and a base for each: products of residues fit a long.
SEGMENT_FIELDS = ((2_147_483_647, 1_000_003), (2_147_483_629, 16_777_619))
SEGMENT_ROWS = 65_536


def _power(base: int, exponent: Column, modulus: int, bits: int) -> Column:
    """base ** exponent modulo a prime below 2**31, by the bits of the exponent."""
    out = F.lit(1).cast("long")
    for k in range(bits):
        bit = F.shiftright(exponent, k).bitwiseAND(F.lit(1))
        out = (out * F.when(bit == 1, F.lit(pow(base, 1 << k, modulus)).cast("long")).otherwise(F.lit(1).cast("long"))) % modulus
    return out


def segment_hashes(rows: DataFrame, ordinal: str, fields: list[str], span: int = SEGMENT_ROWS) -> DataFrame:
    """``(segment, n, h0, h1)`` of rows numbered by ``ordinal``: an order-sensitive hash of every ``span`` ordinals.

    A segment's hash is the polynomial of its row digests in the ordinal's powers, so it is a sum: partial sums combine on the
    map side in any order, and still two rows that change places change it.  ``span`` is at most ``SEGMENT_ROWS``.
    """
    at = F.col(ordinal).cast("long")
    digest = F.sha2(F.to_json(F.struct(*fields)), 256)
    rows = rows.select(F.floor(at / span).alias("segment"), F.pmod(at, F.lit(span)).alias("_at"), digest.alias("_digest"))
    terms = []
    for k, (prime, base) in enumerate(SEGMENT_FIELDS):
        own = F.conv(F.substring("_digest", 1 + 15 * k, 15), 16, 10).cast("long") % prime
        terms.append((F.sum(own * _power(base, F.col("_at"), prime, 17) % prime) % prime).alias(f"h{k}"))
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), *terms)


def prefix_digest(segments: DataFrame, span: int = SEGMENT_ROWS) -> DataFrame:
    """One row ``(n, digest)`` of the prefix that the segments make up: again a sum, each segment shifted by its start."""
    terms = []
    for k, (prime, base) in enumerate(SEGMENT_FIELDS):
        start = F.pmod(F.col("segment") * span, F.lit(prime - 1))
        terms.append((F.coalesce(F.sum(F.col(f"h{k}") * _power(base, start, prime, 31) % prime), F.lit(0)) % prime).alias(f"p{k}"))
    folded = segments.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *terms)
    return folded.select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("p0").cast("string"), F.col("p1").cast("string")), 256).alias("digest"))


def count_words(raw: bytes, width: int, bound: int | None) -> tuple[int, int | None, int]:
    """(words, largest word, words not below the bound) of bytes read as little-endian words of 2 or 4 bytes."""
    words = np.frombuffer(raw, dtype={2: "<u2", 4: "<u4"}[width], count=len(raw) // width)
    return len(words), int(words.max()) if len(words) else None, 0 if bound is None else int((words >= bound).sum())


def word_stats(width: int):
    """Arrow UDF: bytes, bound -> ``struct(n_words, max_word, n_over)`` for LE words."""
    fields = [T.StructField(n, T.LongType()) for n in ("n_words", "max_word", "n_over")]

    @F.pandas_udf(T.StructType(fields))
    def stats(body: pd.Series, bound: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if raw is None else count_words(raw, width, limit) for raw, limit in zip(body, bound)]
        return pd.DataFrame(rows, columns=["n_words", "max_word", "n_over"]).astype("Int64")

    return stats
