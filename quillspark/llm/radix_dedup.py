"""Exact dedup by distributed most-significant-digit radix partitioning.

Texts are equal when their UTF-8 bytes are, after lower-casing A-Z; a null text counts as an empty one. A group starts as the whole
corpus and is split by the next digit, a run of successive bytes, until it has one member or its texts have ended. A digit
shorter than its width tells that the text ended in it, so a text that is a prefix of another splits off there. Groups meet by
the bytes of their digits only: no digest takes part in equality. Digits are ``FIRST`` bytes wide at first and ``GROWTH`` times wider each
round, at most ``WIDEST``, so a corpus is done after a number of rounds that grows with the logarithm of its longest copied text.

Scale: a round is one aggregate by (group, digit) that runs before the shuffle, so a text that a third of the corpus shares costs each
map task one row, and one equi-join of the members with the groups that have several, which adaptive execution splits where a group is
hot. The groups are written first, so that this join has no aggregate in its stage. A document leaves with its result
in the round that finds it alone or ended; the others carry only the bytes that are not yet split on, so what moves shrinks
from round to round. Bytes travel to the join only where a bitmap says that the digit may occur twice; the join itself is exact.

Edge cases: a null doc_id ranks below all others; of rows that are equal in doc_id and text exactly one is kept (they
cannot be told apart, so the result is the same whichever it is); very long texts take more rounds; an empty table gives an empty result; other columns
are not read, so extra ones cannot clash.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import columns_of, filter_bits, membership_filter, passes_filter, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIRST = 256
GROWTH = 16
WIDEST = 1 << 20


def normalised(text: Column) -> Column:
    """UTF-8 bytes of a text, A-Z lower-cased; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary")


def _split(d: DataFrame, width: int) -> DataFrame:
    return d.withColumns({"digit": F.substring("rest", 1, width), "rest": F.substring("rest", width + 1, (1 << 31) - 1)})


def _several(d: DataFrame, *aggregates: Column) -> DataFrame:
    """(of, by, n, ...) of the groups of (group, digit) with several members, each with a number of its own in ``next``."""
    found = d.groupBy(F.col("group").alias("of"), F.col("digit").alias("by")).agg(F.count(F.lit(1)).alias("n"), *aggregates)
    return written(d.sparkSession, found.where("n > 1").withColumn("next", F.monotonically_increasing_id()), "radix-groups")


def _members(d: DataFrame, groups: DataFrame) -> DataFrame:
    """``d`` with the columns of its rows' groups, null for rows that are alone; these may lose digit and rest."""
    members = groups.select(F.xxhash64("of", "by").alias("h"))
    bitmap = d.sparkSession.sparkContext.broadcast(membership_filter(members, "h", filter_bits(groups.count())))

    @F.pandas_udf("boolean")
    def may_repeat(h: pd.Series) -> pd.Series:
        return pd.Series(passes_filter(bitmap.value, h.to_numpy()))

    d = d.withColumn("may", may_repeat(F.xxhash64("group", "digit")))
    d = d.withColumns({"digit": F.when(F.col("may"), F.col("digit")), "rest": F.when(F.col("may"), F.col("rest"))}).drop("may")
    return d.join(groups, (F.col("group") == F.col("of")) & (F.col("digit") == F.col("by")), "left")


def radix_groups(docs: DataFrame, first: int = FIRST, growth: int = GROWTH, row: Column | None = None) -> DataFrame:
    """(doc_id, row, keep_id, group_size, kept, sha) of every row of ``docs`` (doc_id, text); ``sha`` is the 32 bytes of SHA-256.

    ``row`` is a column of distinct numbers; by default rows are numbered as they are first written.
    """
    spark = docs.sparkSession
    own = docs if row is not None else columns_of(docs, "doc_id", "text")
    number = [row.alias("row")] if row is not None else []
    d = own.select("doc_id", *number, "text", F.lit(0).cast("long").alias("group"))
    # the first bytes come from as many characters, so that counting does not normalise whole texts
    groups = _several(d.select("group", F.substring(normalised(F.substring("text", 1, first)), 1, first).alias("digit")))
    d = d.select("doc_id", *(["row"] if number else []), "group", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha"), normalised(F.col("text")).alias("rest"))
    d = _members(_split(d, first), groups)
    numbered = F.col("row") if number else F.monotonically_increasing_id()
    d = d.select("doc_id", numbered.alias("row"), "sha", F.col("next").alias("group"), F.when(F.col("n").isNotNull(), F.col("rest")).alias("rest"))
    d = written(spark, d, "radix-members")
    alone = [F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")]
    done = [d.where("group IS NULL").select("doc_id", "row", "sha", *alone)]
    live, width = d.where("group IS NOT NULL"), first
    while True:
        width = min(WIDEST, width * growth)
        d = _split(live.select("doc_id", "row", "sha", "group", "rest"), width)
        groups = _several(d, F.max(F.struct("doc_id", "row")).alias("best"))
        if groups.isEmpty():
            done.append(live.select("doc_id", "row", "sha", *alone))
            break
        d = _members(d, groups)
        ended = F.col("n").isNotNull() & (F.length("digit") < width)
        d = d.select("doc_id", "row", "sha", "n", "best", F.col("next").alias("group"), ended.alias("ended"),
                     F.when(F.col("n").isNotNull() & ~ended, F.col("rest")).alias("rest"))
        d = written(spark, d, "radix-members")
        done.append(d.where("n IS NULL").select("doc_id", "row", "sha", *alone))
        done.append(d.where("ended").select("doc_id", "row", "sha", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                                            (F.col("row") == F.col("best.row")).alias("kept")))
        live = d.where("n IS NOT NULL AND NOT ended")
    return functools.reduce(DataFrame.unionByName, done)


def drop_copies(docs: DataFrame, **rule) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one row of each group of equal texts, the one with the largest doc_id; all columns pass through."""
    name = next(n for n in ("row_no" + "_" * i for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    rows = written(docs.sparkSession, docs.withColumn(name, F.monotonically_increasing_id()), "radix-rows")
    kept = radix_groups(rows, row=F.col(name), **rule).where("kept").select(F.col("row").alias(name))
    return rows.join(kept, name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_query(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return radix_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


#: The same rows in DuckDB.
EXACT_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t)::BIGINT AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""
