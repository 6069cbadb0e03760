"""Readers and strict checks: stop-word file, missing CSV path, label assertions, key alignment."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark.operators.align import align_predictions
from quillspark.operators.select import assert_label_text, check_training_examples, raise_on_mismatch
from quillspark.operators.tokens import read_stopword_file
from quillspark.session import scratch_path
from quillspark.sources.io import read_sentences_csv


def test_stopword_file(spark):
    path = scratch_path(spark, "stopwords-file")
    os.makedirs(path)
    with open(os.path.join(path, "stopwords.txt"), "w") as f:
        f.write("şi\nacesta  \nşi\n\ncare\n")
    words = sorted(r.word for r in read_stopword_file(spark, path).collect())
    assert words == ["", "acesta", "care", "și"]


def test_missing_csv_names_the_path(spark):
    with pytest.raises(FileNotFoundError, match="nowhere/selection.csv"):
        read_sentences_csv(spark, "/tmp/nowhere/selection.csv")


def test_strict_label_assertion(spark):
    ok = spark.createDataFrame([("factual",), ("satiră",)], "labels string")
    assert assert_label_text(ok).count() == 2
    bad = spark.createDataFrame([("factual",), ("ironie",)], "labels string")
    with pytest.raises(Exception, match="ironie"):
        assert_label_text(bad).collect()


def test_training_example_mismatch_raises(spark):
    df = spark.createDataFrame([("RĂSPUNS: factual", "RĂSPUNS: factual"), ("RĂSPUNS: satiră", "RĂSPUNS: x")],
                               "expected string, got string")
    check = check_training_examples(df, F.col("expected"), F.col("got"))
    assert check.first()["n_mismatch"] == 1
    with pytest.raises(AssertionError):
        raise_on_mismatch(check)


def test_strict_alignment(spark):
    gold = spark.createDataFrame([(1, 0), (2, 1)], "index long, label int")
    preds = spark.createDataFrame([(1, 0), (3, 1)], "index long, prediction int")
    with pytest.raises(ValueError, match="2 keys"):
        align_predictions(gold, preds, strict=True)
    assert align_predictions(gold, preds).count() == 1


def test_csv_round_trip_keeps_empty_null_and_na(spark):
    from quillspark.sources.io import SENTENCE_SCHEMA, write_sentences_csv

    rows = [(1, 1, s, "it-stiinta", 0, 0, 0, 0, "test") for s in
            ('a, b', 'he said "hi"', "line1\nline2", "back\\slash", "NA", "", None, "  padded  ")]
    rows = [(i,) + r[1:2] + r[2:] for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, SENTENCE_SCHEMA)
    path = scratch_path(spark, "csv-edges")
    write_sentences_csv(df, path)
    back = {r["index"]: r.sentence for r in read_sentences_csv(spark, path).collect()}
    assert back == {r[0]: r[2] for r in rows}
