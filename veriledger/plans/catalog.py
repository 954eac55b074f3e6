"""Registration of the runnable queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veriledger.plans import fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


# the eight word sums of a fingerprint over digests ``d``, as DuckDB text
DIGEST_WORDS = ", ".join(f"CAST(sum(CAST(('0x' || substr(d, {8 * i + 1}, 8)) AS BIGINT)) AS VARCHAR)" for i in range(8))


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = fixtures.oracle(oracle)
        return fn

    return register
