"""Readers and writers for the sentence table.

CSV follows pandas' dialect for the documented table: header, quoted fields
that may hold newlines, doubled quotes inside quotes. The literal text ``NA``
stays text (pandas would null it; pass ``null_value`` to get that).
Writers produce folders of part files, never a single coalesced file.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources.tables import spread_input

SENTENCE_SCHEMA = T.StructType([
    T.StructField("index", T.LongType()),
    T.StructField("news_id", T.LongType()),
    T.StructField("sentence", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("label_0", T.IntegerType()),
    T.StructField("label_1", T.IntegerType()),
    T.StructField("label_2", T.IntegerType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("split", T.StringType()),
])


# Read-side null marker that never occurs in text: an unquoted empty field is
# null, a quoted empty field ("") stays an empty string.
NO_NULL_TEXT = "\u0000"


def _csv_options(null_value: str | None = None) -> dict[str, str]:
    return {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "FAILFAST",
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
            "nullValue": NO_NULL_TEXT if null_value is None else null_value}


def read_sentences_csv(spark: SparkSession, path: str, schema: T.StructType = SENTENCE_SCHEMA,
                       null_value: str | None = None) -> DataFrame:
    """Typed read (no schema inference); a missing path is an error naming it.

    Multi-line CSV cannot be split, so each file is read by one task; the rows
    are hash-spread by ``index`` right after the read. ``write_sentences_csv``
    bounds its files; of files from elsewhere the largest decides. For large inputs write the table once as
    parquet (``write_sentences_parquet``) and read that instead.
    """
    if "://" not in path and not os.path.exists(path):
        parent = os.path.dirname(path) or "."
        listing = sorted(os.listdir(parent)) if os.path.isdir(parent) else []
        raise FileNotFoundError(f"dataset not found at {path}; available in {parent}: {listing[:20]}")
    # enforceSchema=false: the header names must match the schema (no silent positional mix-up).
    df = spark.read.schema(schema).options(**_csv_options(null_value)).option("enforceSchema", "false").csv(path)
    return spread_input(df, "index") if "index" in df.columns else df


#: Rows of a CSV file: one task reads a whole file, as it cannot be split.
CSV_FILE_ROWS = 100_000


def write_sentences_csv(df: DataFrame, path: str) -> None:
    """S3: header, quoted as needed, no index column added; files of at most ``CSV_FILE_ROWS`` rows."""
    # Empty strings are written as "" so they read back as empty, not null.
    (df.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"')
       .option("emptyValue", '""').option("maxRecordsPerFile", CSV_FILE_ROWS).option("ignoreLeadingWhiteSpace", "false")
       .option("ignoreTrailingWhiteSpace", "false").csv(path))


def read_sentences_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S2."""
    return spark.read.parquet(path)


def write_sentences_parquet(df: DataFrame, path: str, partition_by: str | None = "split") -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def dump_sentences(df: DataFrame, path: str, col: str = "sentence") -> DataFrame:
    """One sentence per line, newlines replaced by spaces. Returns what is written."""
    lines = df.select(F.replace(F.col(col), F.lit("\n"), F.lit(" ")).alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\n").text(path)
    return lines


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines split on \n only (a \r inside a sentence stays in its line)."""
    return spark.read.option("lineSep", "\n").text(path)
