"""Registered queries: Spark ML baselines (M1-M5) and the logits sink.

The queries return what was trained for: metrics, predictions, confidences and logits. Trained numbers have no SQL twin; tests hold
the fits against a plain optimiser on a small table. For each there is a ``*_checks`` query with what is determined whatever the
model: row counts, ranges and identities; these have SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import baseline as ML
from quillspark.operators import metrics as M
from quillspark.operators.positions import row_index
from quillspark.operators.select import filter_split
from quillspark.plans import oracle as O
from quillspark.plans.registry import register
from quillspark.session import scratch_path
from quillspark.sinks import write_predictions
from quillspark.sources.fixtures import labelled_sentences
from quillspark.sources.tables import read_table

S = O.with_sentences
SEEDS = (1, 2, 3, 4, 5)
ITER_GRID = (5, 10, 20)
_TEST_N = "(SELECT count(*) FROM sentl WHERE split = 'test')"


def _splits(spark, sf_dir):
    t = labelled_sentences(spark, sf_dir).select("index", "sentence", "label", "split")
    return filter_split(t, "train"), filter_split(t, "validation"), filter_split(t, "test")


def _in_range(*cols):
    ok = [F.col(c).between(0, 1) for c in cols]
    return reduce(lambda a, b: a & b, ok)


def determined(metrics: DataFrame, *keys: str) -> DataFrame:
    """What holds of weighted metrics whatever the model: n, all within [0, 1], weighted recall equal to accuracy."""
    return metrics.select(*keys, "n", _in_range("accuracy", "precision", "recall", "f1").alias("in_range"),
                          (F.col("recall") == F.col("accuracy")).alias("recall_is_accuracy"))


def _m1(spark, sf_dir):
    train, _, test = _splits(spark, sf_dir)
    return ML.metrics_table(ML.predict(ML.fit_text_classifier(train), test))


@register("train_text_classifier")
def q_train_text(spark, sf_dir):
    """M1: fit on train; weighted and binary accuracy, precision, recall and F1 on test."""
    return _m1(spark, sf_dir)


@register("train_text_classifier_checks", S() + f"""
SELECT kind, {_TEST_N} AS n, TRUE AS in_range, TRUE AS recall_is_accuracy FROM (SELECT unnest(['weighted', 'binary']) AS kind)""")
def q_train_text_checks(spark, sf_dir):
    """M1: what holds of the metrics whatever the model."""
    t = _m1(spark, sf_dir)
    same = (F.col("kind") == "binary") | (F.col("recall") == F.col("accuracy"))
    return t.select("kind", "n", _in_range("accuracy", "precision", "recall", "f1").alias("in_range"), same.alias("recall_is_accuracy"))


def _m2(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    is_test = F.substring(F.md5(F.concat(F.lit("probe:"), F.col("vec_id").cast("string"))), 1, 1) >= "c"
    pred = ML.probe_predict(ML.embedding_probe(emb.where(~is_test)), emb.where(is_test))
    return M.evaluate(pred, (), "label", "prediction")


@register("train_frozen_probe")
def q_frozen_probe(spark, sf_dir):
    """M2: linear probe on frozen embedding vectors (train / test by md5 of the id); weighted metrics on test."""
    return _m2(spark, sf_dir)


@register("train_frozen_probe_checks", """
SELECT count(*) AS n, TRUE AS in_range, TRUE AS recall_is_accuracy FROM embeddings
WHERE substr(md5('probe:' || CAST(vec_id AS VARCHAR)), 1, 1) >= 'c'""")
def q_frozen_probe_checks(spark, sf_dir):
    """M2: what holds of the metrics whatever the model."""
    return determined(_m2(spark, sf_dir))


def _m3(spark, sf_dir):
    train, valid, test = _splits(spark, sf_dir)
    best, scores = ML.select_best(train, valid, [ML.TextClassifierConfig(max_iter=it) for it in ITER_GRID])
    best_iter = max(scores, key=lambda s: s[1])[0].max_iter
    rows = [(int(c.max_iter), float(f1), c.max_iter == best_iter) for c, f1 in scores]
    cand = spark.createDataFrame(rows, "iterations int, validation_f1 double, chosen boolean")
    return cand, M.evaluate(ML.predict(best, test), ())


@register("select_best_checkpoint")
def q_select_best(spark, sf_dir):
    """M3: one candidate per training length (optimiser iterations, the counterpart of epochs), chosen on
    validation; the chosen one scores test once. Its test metrics stand in its row."""
    cand, test_m = _m3(spark, sf_dir)
    test_m = test_m.select(F.lit(True).alias("chosen"), F.col("n").alias("n_test"), *[F.col(c).alias(f"test_{c}") for c in ("accuracy", "precision", "recall", "f1")])
    return cand.join(test_m, "chosen", "left").select("iterations", "validation_f1", "chosen", "n_test", "test_accuracy", "test_precision", "test_recall", "test_f1")


@register("select_best_checkpoint_checks", S() + f"""
SELECT CAST(i AS INTEGER) AS iterations, TRUE AS validation_in_range, TRUE AS best_is_chosen, CAST(1 AS BIGINT) AS n_chosen, {_TEST_N} AS n_test
FROM (SELECT unnest([5, 10, 20]) AS i)""")
def q_select_best_checks(spark, sf_dir):
    """M3: one candidate is chosen, and it has the highest validation F1."""
    cand, test_m = _m3(spark, sf_dir)
    top = cand.agg(F.max("validation_f1").alias("top"), F.count_if("chosen").alias("n_chosen"))
    # one-row tables beside three candidate rows
    out = (cand.withColumn("k", F.lit(1)).join(top.withColumn("k", F.lit(1)), "k")
           .join(test_m.select(F.col("n").alias("n_test")).withColumn("k", F.lit(1)), "k"))
    return out.select("iterations", F.col("validation_f1").between(0, 1).alias("validation_in_range"),
                      (~F.col("chosen") | (F.col("validation_f1") == F.col("top"))).alias("best_is_chosen"), "n_chosen", "n_test")


def _saved(spark, train):
    """(the fitted pipeline, the same one saved and loaded back)."""
    path = scratch_path(spark, "text-model")
    fitted = ML.fit_text_classifier(train)
    fitted.write().overwrite().save(path)
    return fitted, PipelineModel.load(path)


@register("predict_with_saved_model")
def q_predict_saved(spark, sf_dir):
    """M4: per test row, class, confidence and logits of a fitted pipeline that was saved and loaded back."""
    train, _, test = _splits(spark, sf_dir)
    _, loaded = _saved(spark, train)
    return ML.predict(loaded, test).select("index", F.col("label").alias("ground_truth"), "prediction", "confidence", F.col("logits_text").alias("logits"))


@register("predict_with_saved_model_checks", S() + """
SELECT "index", label AS ground_truth, TRUE AS same_prediction, TRUE AS same_logits FROM sentl WHERE split = 'test'""")
def q_predict_saved_checks(spark, sf_dir):
    """M4: per test row, whether the loaded model says what the fitted one says."""
    train, _, test = _splits(spark, sf_dir)
    fitted, loaded = _saved(spark, train)
    a = ML.predict(fitted, test).select("index", F.col("label").alias("ground_truth"), F.col("prediction").alias("p"), F.col("logits_text").alias("l"))
    b = ML.predict(loaded, test).select("index", "prediction", "logits_text")
    return a.join(b, "index").select("index", "ground_truth", (F.col("p") == F.col("prediction")).alias("same_prediction"),
                                     (F.col("l") == F.col("logits_text")).alias("same_logits"))


def _s6(spark, sf_dir):
    train, _, test = _splits(spark, sf_dir)
    pred = ML.predict(ML.fit_text_classifier(train), test)
    pred = row_index(pred.select("index", "sentence", "label", "prediction", "confidence", "logits_text", F.lit("test").alias("split")),
                     ("split",), "index", out="idx")
    rows = pred.select(F.lit("tfidf-lr:1").alias("model_name"), F.lit(1).alias("run"), "idx", "sentence",
                       F.col("label").alias("ground_truth"), "prediction", "confidence", F.col("logits_text").alias("logits"))
    path = scratch_path(spark, "predictions-logits")
    write_predictions(rows, path)
    return spark.read.parquet(path).withColumn("run", F.col("run").cast("int"))


@register("sink_predictions_logits")
def q_sink_logits(spark, sf_dir):
    """Per-row idx, sentence, ground truth, prediction, confidence, logits; written partitioned by model/run and read back."""
    return _s6(spark, sf_dir).select("model", "run", "idx", "sentence", "ground_truth", "prediction", "confidence", "logits")


@register("sink_predictions_logits_checks", S() + """
SELECT 'tfidf-lr' AS model, 1 AS run, row_number() OVER (ORDER BY "index") - 1 AS idx, sentence, label AS ground_truth,
  TRUE AS confidence_is_max, TRUE AS prediction_is_argmax FROM sentl WHERE split = 'test'""")
def q_sink_logits_checks(spark, sf_dir):
    """The written confidences and predictions held against the written logits."""
    lg = F.from_json("logits", "array<double>")
    return _s6(spark, sf_dir).select(
        "model", "run", "idx", "sentence", "ground_truth",
        (F.col("confidence") == F.array_max(lg)).alias("confidence_is_max"),
        (F.col("prediction") == F.array_position(lg, F.array_max(lg)) - 1).alias("prediction_is_argmax"))


def _m5(spark, sf_dir):
    train, _, test = _splits(spark, sf_dir)
    shared = ML.SharedFeatures(train, carry=("index",))
    test = shared.featured(test)
    parts = [M.evaluate(ML.predict_featured(shared.fit(weight=ML.bootstrap_weight(seed)), test), ()).withColumn("run", F.lit(seed)) for seed in SEEDS]
    return reduce(DataFrame.unionByName, parts)


@register("repeat_over_seeds")
def q_repeat_seeds(spark, sf_dir):
    """M5: one fit per seed over all training rows (seeded bootstrap weights) on features computed once; weighted metrics per run."""
    return _m5(spark, sf_dir)


@register("repeat_over_seeds_checks", S() + f"""
SELECT CAST(r AS INTEGER) AS run, {_TEST_N} AS n, TRUE AS in_range, TRUE AS recall_is_accuracy FROM (SELECT unnest([1, 2, 3, 4, 5]) AS r)""")
def q_repeat_seeds_checks(spark, sf_dir):
    """M5: what holds of each run's metrics whatever the model."""
    return determined(_m5(spark, sf_dir), "run")
