"""Evaluation aggregates.

Everything starts from the confusion table (A2): one partial + final hash
aggregate over the predictions, leaving at most |keys| x 3 x 3 rows. All
metric arithmetic then runs on that tiny table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 when den is 0 (zero_division=0)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion_counts(df: DataFrame, keys: Sequence[str] = (), gt: str = "label", pred: str = "prediction") -> DataFrame:
    """A2: rows per (keys, gt, pred). A missing prediction counts as -1."""
    return (df.select(*keys, F.col(gt).cast("int").alias("gt"), F.coalesce(F.col(pred).cast("int"), F.lit(-1)).alias("pred"))
            .groupBy(*keys, "gt", "pred").agg(F.count(F.lit(1)).alias("n")))


def per_class_counts(conf: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """W4 + per-class tp / predicted / support over the labels seen in gt or pred."""
    side = F.explode(F.array(
        F.struct(F.col("gt").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("tp")),
    )).alias("c")
    return (conf.select(*keys, side).select(*keys, "c.*")
            .groupBy(*keys, "cls").agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"),
                                       F.sum("support").alias("support")))


def weighted_prf(conf: DataFrame, keys: Sequence[str] = (), digits: int | None = 6,
                 with_invalid: bool = False) -> DataFrame:
    """A1 + A3 from a confusion table: accuracy and support-weighted precision,
    recall and F1 over the labels seen in gt or pred (0 where undefined).
    ``with_invalid`` adds the number of -1 predictions (C6)."""
    pc = per_class_counts(conf, keys)
    pc = pc.select(
        *keys, "tp", "support",
        F.when(F.col("cls") == -1, F.col("predicted")).otherwise(F.lit(0)).alias("inv"),
        _ratio(F.col("tp"), F.col("predicted")).alias("p"),
        _ratio(F.col("tp"), F.col("support")).alias("r"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f"),
    )
    n = F.sum("support")
    out = pc.groupBy(*keys).agg(
        n.cast("bigint").alias("n"),
        F.try_divide(F.sum("tp").cast("double"), n.cast("double")).alias("accuracy"),
        F.try_divide(F.sum(F.col("support") * F.col("p")), n.cast("double")).alias("precision"),
        F.try_divide(F.sum(F.col("support") * F.col("r")), n.cast("double")).alias("recall"),
        F.try_divide(F.sum(F.col("support") * F.col("f")), n.cast("double")).alias("f1"),
        F.sum("inv").cast("bigint").alias("n_invalid"),
    )
    if not with_invalid:
        out = out.drop("n_invalid")
    return _round(out, ("accuracy", "precision", "recall", "f1"), digits)


def evaluate(df: DataFrame, keys: Sequence[str] = (), gt: str = "label", pred: str = "prediction",
             digits: int | None = 6) -> DataFrame:
    """A3 (+A1) directly from predictions; adds the invalid count."""
    return weighted_prf(confusion_counts(df, keys, gt, pred), keys, digits, with_invalid=True)


def accuracy(df: DataFrame, keys: Sequence[str] = (), gt: str = "label", pred: str = "prediction") -> DataFrame:
    """A1: mean(pred == gt); -1 and missing count as wrong; empty -> null."""
    return df.groupBy(*keys).agg(
        F.round(F.avg(F.coalesce((F.col(pred) == F.col(gt)).cast("double"), F.lit(0.0))), 6).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def binary_prf(df: DataFrame, keys: Sequence[str] = (), gt: str = "label", pred: str = "prediction",
               positive: int = 1, digits: int | None = 6) -> DataFrame:
    """A4: accuracy and precision / recall / F1 of the positive class."""
    g, p = F.col(gt), F.col(pred)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(g == p).alias("_ok"),
        F.count_if((g == positive) & (p == positive)).alias("_tp"),
        F.count_if(p == positive).alias("_pp"),
        F.count_if(g == positive).alias("_sup"),
    )
    out = out.select(
        *keys, "n",
        F.try_divide(F.col("_ok").cast("double"), F.col("n").cast("double")).alias("accuracy"),
        _ratio(F.col("_tp"), F.col("_pp")).alias("precision"),
        _ratio(F.col("_tp"), F.col("_sup")).alias("recall"),
        _ratio(2 * F.col("_tp"), F.col("_pp") + F.col("_sup")).alias("f1"),
    )
    return _round(out, ("accuracy", "precision", "recall", "f1"), digits)


def binary_from_confusion(conf: DataFrame, keys: Sequence[str] = (), positive: int = 1,
                          digits: int | None = 6) -> DataFrame:
    """A4 from a confusion table (so A3 and A4 share one pass over the predictions)."""
    n = F.col("n")
    out = conf.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.sum(F.when(F.col("gt") == F.col("pred"), n).otherwise(0)).alias("_ok"),
        F.sum(F.when((F.col("gt") == positive) & (F.col("pred") == positive), n).otherwise(0)).alias("_tp"),
        F.sum(F.when(F.col("pred") == positive, n).otherwise(0)).alias("_pp"),
        F.sum(F.when(F.col("gt") == positive, n).otherwise(0)).alias("_sup"),
    )
    out = out.select(
        *keys, F.col("n").cast("bigint").alias("n"),
        F.try_divide(F.col("_ok").cast("double"), F.col("n").cast("double")).alias("accuracy"),
        _ratio(F.col("_tp"), F.col("_pp")).alias("precision"),
        _ratio(F.col("_tp"), F.col("_sup")).alias("recall"),
        _ratio(2 * F.col("_tp"), F.col("_pp") + F.col("_sup")).alias("f1"),
    )
    return _round(out, ("accuracy", "precision", "recall", "f1"), digits)


def invalid_rate(df: DataFrame, keys: Sequence[str] = (), pred: str = "prediction") -> DataFrame:
    """Count and share of -1 (or missing) predictions per group."""
    bad = F.coalesce(F.col(pred), F.lit(-1)) == -1
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(bad).alias("n_invalid"),
        F.round(F.avg(bad.cast("double")), 6).alias("invalid_share"),
    )


def run_summary(metrics: DataFrame, keys: Sequence[str] = ("model",),
                cols: Sequence[str] = ("accuracy", "precision", "recall", "f1"), digits: int | None = 6) -> DataFrame:
    """Mean and sample standard deviation of each metric over runs."""
    aggs = [F.count(F.lit(1)).alias("n_runs")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    out = metrics.groupBy(*keys).agg(*aggs)
    return _round(out, [f"{c}_{s}" for c in cols for s in ("mean", "std")], digits)


def _round(df: DataFrame, cols: Sequence[str], digits: int | None) -> DataFrame:
    if digits is None:
        return df
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})
