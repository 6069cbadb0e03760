"""Join helpers: size-checked broadcast and salted fallback for hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dictionaries up to this many rows and bytes are broadcast; beyond it the
# planner (AQE included) chooses, and hot keys on the big side are salted.
DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_BROADCAST_BYTES = 128 << 20


def measured(small: DataFrame) -> tuple[int, int]:
    """(rows, about how many bytes) of a small table: one aggregate over it."""
    width = F.lit(16)
    for f in small.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        size = F.octet_length(c) if kind in ("string", "binary") else F.lit(8) if kind.isalpha() else F.octet_length(c.cast("string"))
        width = width + F.coalesce(size, F.lit(0)) + 8
    row = small.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def dictionary_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner",
                    max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS, salt_buckets: int = 16,
                    salt_from: Column | None = None, known_rows: int | None = None,
                    max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Join a row table to a dictionary (word -> value) on ``on``.

    The dictionary's rows and bytes are measured first (a small job over a
    small table); under both bounds it is broadcast, so the big side is not shuffled at all. Above
    it, each dictionary row is replicated ``salt_buckets`` times and the big
    side picks a bucket from ``salt_from`` (a stable per-row key), so one
    frequent word is spread over many tasks instead of one.

    ``known_rows``: an upper bound on the rows of a small side of plain
    numbers that the caller has proven (e.g. hash buckets); nothing is
    measured then.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left", "left_outer", "left_anti", "left_semi"):
        raise ValueError(f"unsupported join type {how!r}")
    rows, size = (known_rows, known_rows * 16 * len(small.columns)) if known_rows is not None else measured(small)
    if rows <= max_broadcast_rows and size <= max_broadcast_bytes:
        return big.join(F.broadcast(small), keys, how)
    if salt_from is None:
        salt_from = F.xxhash64(*[F.col(k) for k in big.columns])
    salted_big = big.withColumn("_salt", F.pmod(salt_from, F.lit(salt_buckets)).cast("int"))
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    return salted_big.join(salted_small, keys + ["_salt"], how).drop("_salt")
