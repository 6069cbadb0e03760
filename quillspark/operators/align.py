"""Aligning predictions with gold rows by key, never by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align_predictions(gold: DataFrame, preds: DataFrame, on: Sequence[str] = ("index",), strict: bool = False) -> DataFrame:
    """Inner equi-join of predictions and gold rows on the stable key.

    With ``strict`` the key sets are compared first (one full-outer aggregate)
    and a difference raises.
    """
    keys = list(on)
    if strict:
        g = gold.select(*keys).withColumn("_g", F.lit(1))
        p = preds.select(*keys).withColumn("_p", F.lit(1))
        diff = g.join(p, keys, "full_outer").agg(F.count_if(F.col("_g").isNull() | F.col("_p").isNull()).alias("d")).first()
        if diff["d"]:
            raise ValueError(f"{diff['d']} keys are present on one side only")
    return gold.join(preds, keys, "inner")


def scatter_results(gold: DataFrame, results: DataFrame, on: Sequence[str] = ("index",)) -> DataFrame:
    """Results back to every gold row; a missing result stays null."""
    return gold.join(results, list(on), "left")
