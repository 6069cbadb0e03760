"""Result writers (S5, S7, S8, S9): partitioned, idempotent, no single-file coalesce."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.joins import dictionary_join
from quillspark.session import written


def layout_columns(model_name: Column, run: Column) -> list[Column]:
    """Model folder, base model and the results path of a run."""
    model = F.substring_index(model_name, ":", 1)
    base = F.substring_index(F.substring_index(model_name, "/", -1), ":", 1)
    path = F.concat(F.lit("results/inference/"), model, F.lit("/"), run.cast("string"))
    return [model.alias("model"), base.alias("base_model"), path.alias("path")]


def write_predictions(rows: DataFrame, path: str, key: tuple[str, ...] = ()) -> None:
    """Rows with ``model_name`` and ``run``, written under (key=)/model=/run= folders.

    Dynamic partition overwrite replaces only the folders being written, so a
    re-run of one run never touches the others. ``key`` names columns that tell
    apart runs whose short model name is the same.
    """
    out = rows.withColumn("model", F.substring_index("model_name", ":", 1))
    out = out if key else out.drop("model_name")
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*key, "model", "run").parquet(path))


def write_label_files(rows: DataFrame, path: str) -> None:
    """``preds`` and ``gt`` text, one label per line in ``idx`` order, per run, under ``path/kind=.../run=...``.

    One pass writes both kinds. A global sort range-partitions by (kind, run, idx); part files are in order.
    """
    both = rows.select("run", "idx", F.explode(F.create_map(
        F.lit("preds"), F.col("prediction").cast("string"), F.lit("gt"), F.col("ground_truth").cast("string"))).alias("kind", "value"))
    ordered = both.repartitionByRange("kind", "run", "idx").sortWithinPartitions("kind", "run", "idx")
    ordered.select("kind", "run", "value").write.mode("overwrite").partitionBy("kind", "run").option("lineSep", "\n").text(path)


def numbered_lines(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """(keys, value, line): the lines of text files under ``path``, numbered from 0 through the files of a folder in their order.

    A file split is read by one task in order, so a line's place is counted from the first of its split; the offset of a split is a window
    over one row for each split. The lines are written once, as they are read, and never sorted or shuffled.
    """
    keys = list(keys)
    lines = (spark.read.option("lineSep", "\n").text(path).withColumn("_f", F.col("_metadata.file_path"))
             .withColumn("_b", F.col("_metadata.file_block_start")).withColumn("_n", F.monotonically_increasing_id()))
    lines = written(lines, "lines")
    splits = lines.groupBy(*keys, "_f", "_b").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_f", "_b", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    return dictionary_join(lines, splits, ["_f", "_b"]).select(*keys, "value", (F.col("_n") + F.col("_off")).alias("line"))


def write_metrics(metrics: DataFrame, path: str, key: tuple[str, ...] = ("config_id", "run")) -> None:
    """Metric records (one per configuration and run); writing one again replaces it."""
    key = tuple(k for k in key if k in metrics.columns)
    if not key:
        metrics.write.mode("overwrite").parquet(path)
        return
    (metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key).parquet(path))
