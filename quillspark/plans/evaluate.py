"""Bulk evaluation: raw answers -> parsed classes -> aligned with gold -> metrics.

Spark plan: test rows are pruned to (index, domain, label) at the scan;
answers are parsed with staged column expressions (no Python); the
alignment is an equi-join on the stable key; metrics come from one
partial+final aggregate into the confusion table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.parse import chat_answer, class_from_answer, parse_completion
from quillspark.functions.prompts import shuffled_classes
from quillspark.operators.align import align_predictions
from quillspark.operators.metrics import evaluate
from quillspark.operators.select import filter_split
from quillspark.sources.fixtures import labelled_sentences, outputs


def parse_answers(raw: DataFrame, mode: str = "chat", seed_col: str = "run", key: str = "index") -> DataFrame:
    """Add class order (B9), the parsed answer text and ``prediction``."""
    c0, c1 = shuffled_classes(F.col(seed_col), F.col(key))
    staged = raw.withColumn("class0", c0).withColumn("class1", c1)
    if mode == "chat":
        staged = staged.withColumn("answer", chat_answer("output"))
        return staged.withColumn("prediction", class_from_answer("answer", F.col("class0"), F.col("class1")))
    if mode == "completion":
        return staged.withColumn("prediction", parse_completion("output", F.col("class0"), F.col("class1")))
    raise ValueError(f"unknown mode {mode!r}")


def gold_rows(spark: SparkSession, sf_dir: str, split: str = "test") -> DataFrame:
    return filter_split(labelled_sentences(spark, sf_dir), split)


def scored_predictions(spark: SparkSession, sf_dir: str, runs: int | Sequence[int] = 1, mode: str = "chat",
                       align: bool = False) -> DataFrame:
    """(run, index, domain, label, prediction): fixture answers parsed.

    The stand-in model's answer is a function of (run, index), so it is
    computed on the gold rows themselves. With ``align`` the answers are
    built as a separate table and lined up with gold by key (J1), the shape
    of a real run where answers come back from a scorer's output table.
    """
    gold = gold_rows(spark, sf_dir).select("index", "domain", "label")
    run_list = runs if isinstance(runs, int) else list(runs)
    if not align:
        raw = outputs(gold, run_list, carry=("domain", "label"))
        return parse_answers(raw, mode).select(F.col("run").cast("int").alias("run"), "index", "domain", "label",
                                               "prediction")
    raw = outputs(gold.select("index"), run_list)
    preds = parse_answers(raw, mode).select(F.col("run").cast("int").alias("run"), "index", "prediction")
    return align_predictions(gold, preds, ["index"])


def metrics_by_run_domain(spark: SparkSession, sf_dir: str, runs: int = 1) -> DataFrame:
    """Flagship: weighted metrics of parsed answers per (run, domain) on the test split."""
    return evaluate(scored_predictions(spark, sf_dir, runs), keys=("run", "domain"))
