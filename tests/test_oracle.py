"""Every registered query against its DuckDB twin (the correctness gate), at sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from quillspark.sources.tables import TABLES
from tests.conftest import SMOKE

SQL = E.oracle_sql()
QUERIES = E.queries()
ROWS_ONLY_FAST = ["logits_text", "train_text_classifier", "train_frozen_probe", "predict_with_saved_model"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SMOKE, t + '.parquet')}')")
    return c


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return sorted((tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")), key=repr)


def test_every_query_is_registered_with_aliases():
    assert len(QUERIES) >= 80
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, con, key):
    got = QUERIES[key](spark, SMOKE).toPandas()
    want = con.execute(SQL[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("key", ROWS_ONLY_FAST)
def test_rows_only_queries_run(spark, key):
    assert QUERIES[key](spark, SMOKE).count() > 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["run", "domain", "n", "accuracy", "precision", "recall", "f1", "n_invalid"]
    assert df.count() > 0
