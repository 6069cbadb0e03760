"""The fine-tuning set: sampled, checked, written and read back."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.plans.finetune import finetune_rows, read_finetune_lines, write_finetune_set
from quillspark.session import scratch_path
from quillspark.sources.fixtures import labelled_sentences
from tests.conftest import SMOKE


@pytest.mark.parametrize("form", ["chat", "completion"])
def test_round_trip(spark, form):
    path = scratch_path(spark, "ft")
    rows = finetune_rows(labelled_sentences(spark, SMOKE), form, n_train=40, seed=7)
    write_finetune_set(rows, path)
    lines = read_finetune_lines(spark, path, form)
    counts = {r["split"]: r["count"] for r in lines.groupBy("split").count().collect()}
    assert counts["train"] == 40 and set(counts) == {"train", "validation"}
    text = spark.read.text(f"{path}/jsonl").first().value
    assert set(json.loads(text)) == ({"messages"} if form == "chat" else {"prompt", "completion"})
    cols = [c for c in lines.columns]
    assert lines.exceptAll(spark.read.parquet(f"{path}/parquet").select(*cols)).count() == 0


def test_mismatch_stops_the_job(spark):
    path = scratch_path(spark, "ft-bad")
    rows = finetune_rows(labelled_sentences(spark, SMOKE), "completion", n_train=5)
    bad = rows.withColumn("completion", F.concat("completion", F.lit("!")))
    with pytest.raises(AssertionError):
        write_finetune_set(bad, path)


def test_sample_larger_than_the_table_is_an_error(spark):
    with pytest.raises(Exception, match="without replacement"):
        finetune_rows(labelled_sentences(spark, SMOKE), "chat", n_train=90_000).count()
