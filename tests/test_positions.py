"""Row positions (W1), exact seeded samples (P8), batches by length."""

import hashlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators.positions import (
    batch_padding, consecutive_batches, kth_smallest_hash, packed_batches, packed_padding, row_index, sample_exact_n,
)


def test_row_index_equals_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 100003).alias("index"),
                                     F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 100 != 7, "b").alias("split"))
    want = df.withColumn("idx", F.row_number().over(Window.partitionBy("split").orderBy("index")) - 1)
    want = sorted(map(tuple, want.select("index", "split", "idx").collect()), key=str)
    for parts, ranges in ((7, None), (5, 13), (1, 1)):
        got = row_index(df.repartition(parts), ("split",), "index", out="idx", partitions=ranges)
        assert sorted(map(tuple, got.select("index", "split", "idx").collect()), key=str) == want
    assert row_index(df.limit(0)).collect() == []


def test_row_index_neither_counts_nor_repeats_its_input(spark):
    """What is above runs once; after the range shuffle the rows are not exchanged again."""
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = spark.range(0, 3000).select(F.col("id").alias("index"), F.lit("a").alias("split")).mapInArrow(watch, "index long, split string")
    out = row_index(df)
    assert out.count() == 3000 and seen.value == 3000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "BroadcastHashJoin" in plan


def test_kth_smallest_hash_refines_one_bucket(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "index").repartition(5)
    order = sorted(range(3000), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
    for n in (1, 2, 1499, 3000):
        for last in (1, 5, 4096):
            total, (h, k) = kth_smallest_hash(df, n, 7, "index", last)
            assert (total, k) == (3000, order[n - 1]) and h == hashlib.md5(f"7:{k}".encode()).hexdigest()
    assert kth_smallest_hash(df, 3001, 7, "index") == (3000, None)


@pytest.mark.parametrize("parts", [1, 6])
def test_sample_exact_n(spark, parts):
    df = spark.range(0, 3000).withColumnRenamed("id", "index").repartition(parts)
    got = sorted(r["index"] for r in sample_exact_n(df, 250, 42).collect())
    want = sorted(range(3000), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))[:250]
    assert got == sorted(want)
    assert sample_exact_n(df, 0, 1).count() == 3000 and sample_exact_n(df, 3000, 1).count() == 3000
    with pytest.raises(Exception, match="cannot select 3001 rows"):
        sample_exact_n(df, 3001, 1).collect()
    with pytest.raises(ValueError):
        sample_exact_n(df, 3001, 1, last_rows=100)
    assert sample_exact_n(df, 3001, 1, check=False).count() == 3000
    assert sample_exact_n(df.limit(0), 5, 1).collect() == []
    fine = sorted(r["index"] for r in sample_exact_n(df, 250, 42, last_rows=1).collect())
    assert fine == got


def test_sample_is_a_filter_at_any_size(spark):
    """Below and above 100,000 rows there is no limit, sort, window, join or exchange of the corpus, and the sample is exact."""
    df = spark.range(0, 250_000).withColumnRenamed("id", "index")
    small = {r["index"] for r in sample_exact_n(df, 99_999, 3).collect()}
    out = sample_exact_n(df, 100_001, 3)
    big = {r["index"] for r in out.collect()}
    assert len(small) == 99_999 and len(big) == 100_001 and small < big
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Limit", "TakeOrdered", "Sort", "Window", "Join", "Exchange"))


def test_packed_batches_pad_less(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b"]), int(rng.lognormvariate(2.5, 0.7))) for i in range(1000)]
    df = spark.createDataFrame(rows, "index long, split string, len int").repartition(6)
    plain, packed = batch_padding(consecutive_batches(df, 32)), batch_padding(packed_batches(df, 32))
    total = lambda d: sorted((r.split, r.batch, r.n_rows, r.max_len, r.pad_tokens) for r in d.collect())
    assert total(packed) == total(packed_padding(df, 32))
    want = []
    for split in "ab":
        own = sorted(n for _, s, n in rows if s == split)
        want += [(split, k // 32, len(b), b[-1], b[-1] * len(b) - sum(b)) for k in range(0, len(own), 32) for b in [own[k:k + 32]]]
    assert total(packed) == sorted(want)
    assert sum(r[4] for r in total(packed)) < 0.2 * sum(r[4] for r in total(plain))
    assert packed_padding(df.limit(0), 32).collect() == []
