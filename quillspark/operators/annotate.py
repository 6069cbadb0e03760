"""Annotation aggregates: majority vote (A5) and corpus statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority_label(annotator_cols: Sequence[str]) -> Column:
    """A5: the label that more than half of the given votes have; null votes do not count, no majority gives null."""
    votes = F.array_compact(F.array(*[F.col(c) for c in annotator_cols]))
    ones = F.size(F.filter(votes, lambda v: v == 1))
    zeros = F.size(F.filter(votes, lambda v: v == 0))
    return F.when(ones * 2 > F.size(votes), 1).when(zeros * 2 > F.size(votes), 0).cast("int")


def majority_vote(df: DataFrame, annotator_cols: tuple[str, ...] = ("label_0", "label_1", "label_2"),
                  out: str = "label") -> DataFrame:
    """A5 (wide form): the strict majority of the annotators' votes, null when there is none."""
    return df.withColumn(out, majority_label(annotator_cols))


def majority_vote_long(votes: DataFrame, id_col: str = "index", label_col: str = "vote") -> DataFrame:
    """A5 (long form, k annotators): the same rule, one row per id; ``n_votes`` is the number of votes for the label.

    Two aggregates with partial counts; no window, so an id with very many votes is not sorted in one task.
    """
    counts = votes.groupBy(id_col, label_col).agg(F.count(label_col).alias("n"))
    top = counts.groupBy(id_col).agg(F.max(F.struct("n", F.col(label_col).alias("v"))).alias("top"), F.sum("n").alias("total"))
    won = F.col("top.n") * 2 > F.col("total")
    return top.select(id_col, F.when(won, F.col("top.v")).alias("label"), F.when(won, F.col("top.n")).alias("n_votes"))


def corpus_stats(df: DataFrame, keys: tuple[str, ...] = ("split", "domain", "label")) -> DataFrame:
    """Sentences, distinct news and mean sentence length per group."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sentences"),
        F.countDistinct("news_id").alias("n_news"),
        F.round(F.avg(F.length("sentence")), 6).alias("avg_chars"),
    )
