"""Metrics (A1-A8) against a direct computation, and their invariants."""

import random

import pytest
from quillspark.operators import metrics as M
from quillspark.operators.annotate import majority_vote, majority_vote_long


def py_weighted(gt, pred):
    labels = sorted(set(gt) | set(pred))
    n = len(gt)
    p = r = f = 0.0
    for c in labels:
        tp = sum(1 for g, q in zip(gt, pred) if g == c and q == c)
        pp = sum(1 for q in pred if q == c)
        sup = sum(1 for g in gt if g == c)
        pc = tp / pp if pp else 0.0
        rc = tp / sup if sup else 0.0
        fc = 2 * pc * rc / (pc + rc) if pc + rc else 0.0
        p, r, f = p + sup * pc, r + sup * rc, f + sup * fc
    acc = sum(g == q for g, q in zip(gt, pred)) / n
    return acc, p / n, r / n, f / n


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_weighted_matches_direct(spark, seed):
    rnd = random.Random(seed)
    gt = [rnd.choice([0, 1]) for _ in range(300)]
    pred = [rnd.choice([0, 1, -1]) for _ in range(300)]
    df = spark.createDataFrame(list(zip(gt, pred)), "label int, prediction int").repartition(5)
    row = M.evaluate(df).first()
    want = py_weighted(gt, pred)
    for got, w in zip((row.accuracy, row.precision, row.recall, row.f1), want):
        assert got == pytest.approx(w, abs=1e-6)
    assert row.n_invalid == pred.count(-1)
    assert row.recall == row.accuracy  # weighted recall equals accuracy


def test_binary_and_empty(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, -1)], "label int, prediction int")
    b = M.binary_prf(df).first()
    assert (b.precision, b.recall) == (0.5, pytest.approx(1 / 3, abs=1e-6))
    empty = spark.createDataFrame([], "label int, prediction int")
    assert M.accuracy(empty).first().accuracy is None


def test_missing_prediction_counts_as_invalid(spark):
    df = spark.createDataFrame([(1, None), (0, 0)], "label int, prediction int")
    assert M.evaluate(df).first().n_invalid == 1


def test_majority_vote_wide_and_long(spark):
    df = spark.createDataFrame([(1, 1, 0, 1), (2, 0, 0, 1), (3, 1, 1, 1)], "index long, label_0 int, label_1 int, label_2 int")
    assert [r.label for r in majority_vote(df).orderBy("index").collect()] == [1, 0, 1]
    votes = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 0), (2, 1)], "index long, vote int")
    assert {r["index"]: r.label for r in majority_vote_long(votes).collect()} == {1: 1, 2: None}


def test_run_summary(spark):
    m = spark.createDataFrame([("m", 1, 0.5, 0.5, 0.5, 0.5), ("m", 2, 0.7, 0.7, 0.7, 0.7)],
                              "model string, run int, accuracy double, precision double, recall double, f1 double")
    r = M.run_summary(m).first()
    assert r.n_runs == 2 and r.accuracy_mean == pytest.approx(0.6) and r.f1_std == pytest.approx(0.141421, abs=1e-6)


def test_binary_from_confusion_equals_direct(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([0, 1]), rnd.choice([0, 1, -1])) for _ in range(200)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    a = M.binary_prf(df).first()
    b = M.binary_from_confusion(M.confusion_counts(df)).first()
    assert (a.n, a.accuracy, a.precision, a.recall, a.f1) == (b.n, b.accuracy, b.precision, b.recall, b.f1)
