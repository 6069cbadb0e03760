"""A corpus pipeline: raw documents to a training mix.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``; the last adds ``copy_no``.

Edge cases: null and empty texts, null and repeated ids, rows that are equal in all columns, very long texts, further columns whatever their
names, and empty tables have the results that the modules' docstrings define; no stage fails on them. Rows equal in doc_id and text are one document for the
line, near-duplicate and decontamination stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import line_chunks, pareto_mix, probminhash, quality_cnn, template_decontam
from quillspark.llm.common import written
from quillspark.session import ship_package
from quillspark.sources.tables import read_table

#: Share of its characters that line dedup may take from a document: all of them, so that no document is left out.
COPY_SHARE = 1.0


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship_package(spark)
    model = quality_cnn.train_quality(docs, read_table(spark, sf_dir, "labels"))
    return quality_cnn.keep_quality(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Multi-line chunks that an earlier document holds are cut out of every document, copies too; every document stays."""
    ship_package(spark)
    return line_chunks.dedup_lines(docs, spans_as=None, most=COPY_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    ship_package(spark)
    return probminhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or re-parameterised, go."""
    ship_package(spark)
    return template_decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, one row for each copy."""
    ship_package(spark)
    return pareto_mix.mixed_documents(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The classifier's score has no SQL form; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(spark, docs, f"pipeline-{name}")
    return docs
