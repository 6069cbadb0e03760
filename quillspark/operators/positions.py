"""Dense 0-based positions (W1), exact seeded samples (P8) and batches by length (T21) without a single-partition window.

A global ``row_number()`` over one split puts the whole split in one task. Instead rows are range partitioned and sorted once and written
with their place in their partition; a small table of counts per partition turns places into positions. Samples come from a distributed
k-th order statistic of a hash. All of it is exact, deterministic and independent of the number of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.joins import dictionary_join
from quillspark.session import written

#: ``monotonically_increasing_id`` holds the partition above these bits and the place in it below.
_PLACE_BITS = 33


def row_index(df: DataFrame, partition_by: Sequence[str] = ("split",), order_col: str | Sequence[str] = "index", out: str = "idx",
              partitions: int | None = None) -> DataFrame:
    """0-based index per split in ``order_col`` order (``reset_index``); several columns order one after the other.

    The rows are written as they come, so what is above runs once; range bounds are sampled from that copy. One range shuffle by
    (split, order) follows, so a split that holds a third of the rows is many partitions. The sorted rows are written with their
    place; the offset of each (split, partition) is a window over the counts, at most one row for each partition and one more for each
    split, and it is joined by a size-checked broadcast. The rows are not shuffled again and nothing is counted at plan time but the size of
    the offset table. Rows that tie in ``order_col`` are numbered in any order; nulls come first.
    """
    keys, order = list(partition_by), [order_col] if isinstance(order_col, str) else list(order_col)
    staged = written(df, "rows")
    by = [F.col(c) for c in [*keys, *order]]
    ranged = staged.repartitionByRange(partitions, *by) if partitions else staged.repartitionByRange(*by)
    placed = written(ranged.sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id()), "placed-rows")
    placed = placed.withColumn("_part", F.shiftright("_place", _PLACE_BITS))
    counts = placed.groupBy(*keys, "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one window over the table of counts, never over rows
    offsets = counts.select(*[F.struct(F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)], "_part",
                            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    rows = placed.withColumns({f"_k{i}": F.struct(F.col(k)) for i, k in enumerate(keys)})  # a null key is a key too
    rows = dictionary_join(rows, offsets, [*[f"_k{i}" for i in range(len(keys))], "_part"], "inner")
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_place") + F.col("_off")).cast("bigint").alias(out))


def seeded_hash(seed: int | Column, key: Column | str) -> Column:
    s = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", s, k.cast("string")))


#: A histogram of the order statistic has 16^DIGITS buckets; a bucket of at most LAST_ROWS keys is looked at key by key.
DIGITS = 3
LAST_ROWS = 4096


def kth_smallest_hash(df: DataFrame, n: int, seed: int, key: str, last_rows: int = LAST_ROWS) -> tuple[int, tuple | None]:
    """(rows, (hash, key) of the ``n``-th row in the order of the seeded hash, then key); None if there are fewer rows.

    Counts rows by the next digits of the hash, goes on in the bucket that holds the n-th, and collects a bucket's keys once it has at
    most ``last_rows``. The driver gets at most 4,096 counts a round; three or four rounds do for any table. Only ``key`` is read.
    """
    d = df.select(seeded_hash(seed, key).alias("h"), F.col(key).alias("k"))
    prefix, total, left = "", None, n
    while True:
        own = d.where(F.col("h").startswith(prefix)) if prefix else d
        digits = F.substring("h", len(prefix) + 1, DIGITS)
        counts = sorted((r.digits, r.n) for r in own.groupBy(digits.alias("digits")).agg(F.count(F.lit(1)).alias("n")).collect())
        if total is None:
            total = sum(c for _, c in counts)
            if n > total:
                return total, None
        for digits, count in counts:
            if left <= count:
                break
            left -= count
        prefix += digits
        if count <= last_rows or len(prefix) >= 32:
            rows = d.where(F.col("h").startswith(prefix)).orderBy("h", "k").limit(left).collect()  # at most last_rows keys
            return total, (rows[-1].h, rows[-1].k)


def sample_exact_n(df: DataFrame, n: int, seed: int, key: str = "index", check: bool = True, last_rows: int = LAST_ROWS) -> DataFrame:
    """Exactly ``n`` rows without replacement, those first in the order of the seeded hash of ``key`` (ties by key).

    ``n <= 0`` keeps every row; ``n`` above the row count is an error, or with ``check`` False keeps every row; a table without rows gives none. ``key`` must be unique
    and not null. The n-th smallest hash is found first (``kth_smallest_hash``), so the sample itself is a filter: no shuffle, no
    join, and no task holds more than its own rows, whatever ``n``.
    """
    if n <= 0:
        return df
    total, last = kth_smallest_hash(df, n, seed, key, last_rows)
    if last is None:
        if check and total:
            raise ValueError(f"cannot select {n} rows without replacement from {total}")
        return df
    h = seeded_hash(seed, key)
    return df.where((h < last[0]) | (h == last[0]) & (F.col(key) <= F.lit(last[1])))


def consecutive_batches(df: DataFrame, batch_rows: int, length: str = "len", keys: Sequence[str] = ("split",), order_col: str = "index") -> DataFrame:
    """``df`` with ``batch``, the number of its batch of ``batch_rows`` consecutive rows."""
    return row_index(df, keys, order_col, out="_pos").withColumn("batch", F.floor(F.col("_pos") / batch_rows)).drop("_pos")


def packed_batches(df: DataFrame, batch_rows: int, length: str = "len", keys: Sequence[str] = ("split",), order_col: str = "index") -> DataFrame:
    """``df`` with ``batch`` over the whole split in order of length, so that a batch's rows are about equally long."""
    return consecutive_batches(df, batch_rows, length, keys, [length, order_col])


def batch_padding(df: DataFrame, length: str = "len", keys: Sequence[str] = ("split",)) -> DataFrame:
    """(keys, batch, n_rows, max_len, pad_tokens) of assigned batches, each padded to its longest row."""
    n, longest = F.count(F.lit(1)), F.max(length)
    return df.groupBy(*keys, "batch").agg(n.alias("n_rows"), longest.alias("max_len"), (longest * n - F.sum(length)).cast("bigint").alias("pad_tokens"))


def packed_padding(df: DataFrame, batch_rows: int, length: str = "len", keys: Sequence[str] = ("split",)) -> DataFrame:
    """What ``batch_padding(packed_batches(...))`` gives, from the histogram of lengths alone: no row is moved or numbered.

    The window runs over one row for each (split, length). A length that spans several batches gives one row for each of them.
    """
    lengths = df.groupBy(*keys, length).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(length).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lengths = lengths.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_n"))
    first, last = F.floor(F.col("_from") / batch_rows), F.floor((F.col("_to") - 1) / batch_rows)
    parts = lengths.withColumn("batch", F.explode(F.sequence(first, last)))
    here = F.least("_to", (F.col("batch") + 1) * batch_rows) - F.greatest("_from", F.col("batch") * batch_rows)
    parts = parts.withColumn("_here", here)
    n, longest = F.sum("_here"), F.max(length)
    return parts.groupBy(*keys, "batch").agg(n.alias("n_rows"), longest.alias("max_len"),
                                             (longest * n - F.sum(F.col(length) * F.col("_here"))).cast("bigint").alias("pad_tokens"))
