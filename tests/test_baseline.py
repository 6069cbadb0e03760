"""The fitted baselines against a plain optimiser, and batched model calls."""

import random

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
from quillspark.operators import baseline as ML
from quillspark.operators.score import predict_logits
from tests.conftest import SMOKE


def plain_logistic(x, y, reg):
    """Intercept and weights that minimise mean log loss + reg / 2 * |w * std|^2, by Newton steps."""
    std = x.std(axis=0, ddof=1)
    used = std > 0
    a = np.hstack([np.ones((len(x), 1)), x[:, used] / std[used]])
    penalty = np.r_[0.0, np.full(used.sum(), reg)]
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ w))
        grad = a.T @ (p - y) / len(x) + penalty * w
        hess = (a * (p * (1 - p))[:, None]).T @ a / len(x) + np.diag(penalty)
        w -= np.linalg.solve(hess, grad)
    return a @ w


def test_text_classifier_equals_a_plain_fit(spark):
    """Features are tf times log((n + 1) / (df + 1)); margins and classes are those of the plain optimiser."""
    rng = random.Random(3)
    vocabulary = [f"cuvânt{c}" for c in "abcdefghijkl"]
    rows = []
    for i in range(120):
        label = i % 2
        words = [rng.choice(vocabulary[:11] if label else vocabulary[2:]) for _ in range(rng.randint(3, 9))]
        rows.append((i, " ".join(words), label))
    train = spark.createDataFrame(rows, "index long, sentence string, label int").repartition(3)
    cfg = ML.TextClassifierConfig(max_iter=300, reg_param=0.05)
    got = {r["index"]: r for r in ML.predict(ML.fit_text_classifier(train, cfg), train).collect()}
    tf = np.array([[s.split().count(w) for w in vocabulary] for _, s, _ in rows], dtype=float)
    x = tf * np.log((len(rows) + 1) / ((tf > 0).sum(axis=0) + 1))
    margin = plain_logistic(x, np.array([r[2] for r in rows]), cfg.reg_param)
    assert np.abs(np.array([got[i].logits[1] for i in range(len(rows))]) - margin).max() < 1e-3
    for i, m in enumerate(margin):
        if abs(m) > 1e-2:
            assert got[i].prediction == int(m > 0) and abs(got[i].confidence - abs(m)) < 1e-3
    metrics = {r.kind: r for r in ML.metrics_table(ML.predict(ML.fit_text_classifier(train, cfg), train)).collect()}
    right = np.mean([(m > 0) == r[2] for m, r in zip(margin, rows)])
    assert abs(metrics["weighted"].accuracy - right) < 1e-6 and 0.7 < right < 1


def test_queries_return_what_was_trained(spark):
    """Predictions, confidences and logits agree with each other, both classes are predicted, and metrics follow from the predictions."""
    q = E.queries()
    rows = q["predict_with_saved_model"](spark, SMOKE).collect()
    for r in rows:
        logits = [float(x) for x in r.logits.strip("[]").split(",")]
        assert abs(max(logits) - r.confidence) < 1e-9 and logits[r.prediction] == max(logits)
    assert {r.prediction for r in rows} == {0, 1}
    m = {r.kind: r for r in q["train_text_classifier"](spark, SMOKE).collect()}["weighted"]
    assert m.n == len(rows) and abs(m.accuracy - sum(r.prediction == r.ground_truth for r in rows) / len(rows)) < 1e-5
    sink = q["sink_predictions_logits"](spark, SMOKE).collect()
    assert sorted(r.idx for r in sink) == list(range(len(rows))) and {r.model for r in sink} == {"tfidf-lr"}
    probe = q["train_frozen_probe"](spark, SMOKE).collect()[0]
    assert probe.n > 0 and probe.recall == probe.accuracy  # the labels there do not depend on the vectors


def test_probe_learns_labels_that_depend_on_the_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 8)) * 3
    rows = [(i, [float(v) for v in centres[i % 4] + rng.normal(size=8)], i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    model = ML.embedding_probe(df.where("vec_id < 300"))
    pred = ML.probe_predict(model, df.where("vec_id >= 300")).collect()
    near = {i: int(np.argmin(((centres - np.array(v)) ** 2).sum(axis=1))) for i, v, _ in rows}
    assert sum(r.prediction == r.label for r in pred) >= 97
    assert sum(r.prediction == near[r.vec_id] for r in pred) >= 97  # the best rule for these rows


def test_model_is_called_once_a_batch(spark):
    calls = spark.sparkContext.accumulator(0)

    def make():
        def model(a, b):
            calls.add(1)
            assert len(a) <= 64
            return np.stack([a + b, a - b, np.zeros(len(a))], axis=1)
        return model
    df = spark.range(0, 1000, 1, 2).select("id", (F.col("id") * 2).alias("a"), F.lit(0.5).alias("b"), F.lit("kept").alias("c"))
    out = predict_logits(df, make, ["a", "b"], batch_rows=64)
    rows = out.collect()
    assert len(rows) == 1000 and all(r.logits == [r.a + 0.5, r.a - 0.5, 0.0] and r.c == "kept" for r in rows)
    assert 16 <= calls.value <= 20
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
