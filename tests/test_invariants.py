"""Invariants: results do not depend on the partition count; operators keep row counts."""

import pytest

import __spark_entry__ as E
from tests.conftest import SMOKE

KEYS = ["weighted_prf", "preprocess_full", "sample_exact_n", "row_index", "detect_entities", "lemmatize"]


@pytest.mark.parametrize("key", KEYS)
def test_partition_count_does_not_change_results(spark, key):
    q = E.queries()[key]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = sorted(map(tuple, q(spark, SMOKE).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = sorted(map(tuple, q(spark, SMOKE).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b and len(a) > 0


@pytest.mark.parametrize("key", ["anonymize", "process_text", "mask_brands", "strip_emails", "prompt_chat",
                                 "tokenize", "score_batches"])
def test_row_count_preserved(spark, key):
    q = E.queries()
    base = q["filter_split"](spark, SMOKE).count() if key in ("prompt_chat", "score_batches") else \
        q["majority_vote"](spark, SMOKE).count()
    assert q[key](spark, SMOKE).count() == base
