"""Row selection, projection and table checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.constants import CLASS_0, CLASS_1, DOMAINS, SPLITS
from quillspark.operators.annotate import majority_label
from quillspark.operators.positions import row_index

PREVIEW_SEP = "\n\n====\n\n"


def filter_split(df: DataFrame, split: str = "test") -> DataFrame:
    """Keep one split (pushed to the scan / pruned when partitioned by split)."""
    return df.where(F.col("split") == split)


def split_three_way(df: DataFrame, splits: Sequence[str] = SPLITS) -> DataFrame:
    """The three splits with a per-split 0-based ``idx`` (index reset).
    One DataFrame keyed by ``split``; write it with ``partitionBy("split")``."""
    return row_index(df.where(F.col("split").isin(*splits)), ("split",), "index", out="idx")


def project_columns(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Keep only the listed columns, in that order."""
    return df.select(*keep)


def preview_head(df: DataFrame, col: str = "sentence", n: int = 10, order: str = "index", sep: str = PREVIEW_SEP) -> DataFrame:
    """The first ``n`` values joined by the preview separator (one row)."""
    head = df.orderBy(order).limit(n)
    return head.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(col)))),
                                 lambda x: x[col]), sep).alias("preview"),
        F.count(F.lit(1)).alias("n"),
    )


def split_size(df: DataFrame, split: str = "test") -> DataFrame:
    """P5: number of rows in one split."""
    return filter_split(df, split).agg(F.count(F.lit(1)).alias("n"))


def choose_label_column(df: DataFrame, label_field: str = "label", out: str = "target") -> DataFrame:
    """The configured target column as int."""
    return df.withColumn(out, F.col(label_field).cast("int"))


def label_to_class_text(df: DataFrame, label_field: str = "label", classes: Sequence[str] = (CLASS_0, CLASS_1),
                        out: str = "labels") -> DataFrame:
    """Class text of the label. An existing ``labels`` column wins.
    -1 and out-of-range labels give null (the original wraps -1 to the last class)."""
    if out in df.columns:
        return df
    return df.withColumn(out, F.get(F.array(*[F.lit(c) for c in classes]), F.col(label_field).cast("int")))


def label_text_ok(label_text: Column, classes: Sequence[str] = (CLASS_0, CLASS_1)) -> Column:
    return F.coalesce(label_text.isin(*classes), F.lit(False))


def assert_label_text(df: DataFrame, col: str = "labels", classes: Sequence[str] = (CLASS_0, CLASS_1)) -> DataFrame:
    """P9 (strict): fail the job on the first row whose label text is not a class."""
    ok = label_text_ok(F.col(col), classes)
    msg = F.concat(F.lit("Label must be one of the classes, got "), F.coalesce(F.col(col), F.lit("null")))
    # In a filter, not a dropped column: column pruning would remove the check.
    return df.where(F.assert_true(ok, msg).isNull())


def quarantine_label_text(df: DataFrame, col: str = "labels", classes: Sequence[str] = (CLASS_0, CLASS_1)) -> tuple[DataFrame, DataFrame]:
    """P9 (lenient): (valid rows, quarantined rows)."""
    ok = label_text_ok(F.col(col), classes)
    return df.where(ok), df.where(~ok)


def check_training_examples(df: DataFrame, expected: Column, got: Column, keys: Sequence[str] = ()) -> DataFrame:
    """P10: rows checked and rows whose rendered answer differs, in one aggregate (per ``keys``, else one row)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_checked"),
                  F.count_if(~expected.eqNullSafe(got)).alias("n_mismatch"))


def raise_on_mismatch(check: DataFrame) -> None:
    """Fail when ``check_training_examples`` found a mismatch (reads one row)."""
    row = check.first()
    if row is not None and row["n_mismatch"]:
        raise AssertionError(f"{row['n_mismatch']} of {row['n_checked']} training examples do not end in their answer")


EXPECTED_COLUMNS = ("index", "news_id", "sentence", "domain", "label_0", "label_1", "label_2", "label", "split")


def validate_schema(df: DataFrame) -> DataFrame:
    """Column contract and closed value sets, one pass, one row of counts."""
    missing = [c for c in EXPECTED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    binary = lambda c: F.col(c).isin(0, 1)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("index").isNull()).alias("null_index"),
        F.count_if(F.col("sentence").isNull()).alias("null_sentence"),
        F.count_if(~F.coalesce(F.col("domain").isin(*DOMAINS), F.lit(False))).alias("bad_domain"),
        F.count_if(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))).alias("bad_split"),
        F.count_if(~F.coalesce(binary("label_0") & binary("label_1") & binary("label_2") & binary("label"),
                               F.lit(False))).alias("bad_label"),
        (F.count(F.lit(1)) - F.countDistinct("index")).alias("dup_index"),
        # label is documented as the majority of the three annotators
        F.count_if(~F.col("label").eqNullSafe(majority_label(("label_0", "label_1", "label_2")))).alias("label_not_majority"),
    )
