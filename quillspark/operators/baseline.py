"""Distributed baselines with Spark ML (M1-M5).

The original fine-tunes transformer encoders on a GPU; here the same
experiment shape (fit on train, choose on validation, score test once,
repeat over seeds, log per-row logits and metrics) runs as Spark ML
pipelines: HashingTF + IDF + LogisticRegression on the sentence tokens, and
a logistic-regression probe on frozen embedding vectors. Fitting is
distributed (gradient tree-aggregates); nothing is collected to the driver
except model coefficients.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.parse import argmax_class, logits_text, max_logit_confidence
from quillspark.functions.text import lowercase, tokenize
from quillspark.operators import metrics as M
from quillspark.session import written


@dataclass(frozen=True)
class TextClassifierConfig:
    num_features: int = 1 << 16
    reg_param: float = 0.01
    max_iter: int = 20
    label_field: str = "label"
    # Each optimiser step tree-aggregates one dense gradient of num_features
    # doubles per partition: keep the width moderate and deepen the tree for
    # thousands of partitions.
    aggregation_depth: int = 2


def text_features(df: DataFrame, text_col: str = "sentence") -> DataFrame:
    return df.withColumn("words", tokenize(lowercase(text_col)))


def classifier(cfg: TextClassifierConfig, weight_col: str | None = None) -> LogisticRegression:
    lr = LogisticRegression(featuresCol="features", labelCol="target", regParam=cfg.reg_param, maxIter=cfg.max_iter,
                            aggregationDepth=cfg.aggregation_depth)
    return lr.setWeightCol(weight_col) if weight_col else lr


class SharedFeatures:
    """HashingTF + IDF of the train rows, fitted once and shared by every candidate and seed that is fitted on them.

    The term counts are written once into the shared folder; a fit reads them and keeps its own blocks of vectors, and nothing else is held.
    They are read in two partitions a task slot at most: each optimiser step moves one gradient a partition.
    """

    def __init__(self, train: DataFrame, cfg: TextClassifierConfig = TextClassifierConfig(), carry: Sequence[str] = ()):
        terms = HashingTF(inputCol="words", outputCol="tf", numFeatures=cfg.num_features)
        rows = terms.transform(_with_target(text_features(train), cfg.label_field)).select("tf", "target", *carry)
        rows = written(rows, "train-terms").coalesce(2 * train.sparkSession.sparkContext.defaultParallelism)
        idf = IDF(inputCol="tf", outputCol="features").fit(rows)
        self.features = PipelineModel(stages=[terms, idf])
        self.rows = idf.transform(rows).select("features", "target", *carry)

    def fit(self, cfg: TextClassifierConfig = TextClassifierConfig(), weight: Column | None = None) -> PipelineModel:
        """A whole pipeline model: the shared features and a classifier fitted for ``cfg`` (row weights optional)."""
        rows = self.rows if weight is None else self.rows.withColumn("_w", weight)
        model = classifier(cfg, None if weight is None else "_w").fit(rows)
        return PipelineModel(stages=[*self.features.stages, model])

    def featured(self, df: DataFrame, label_field: str = "label") -> DataFrame:
        """(features, target, label) of further rows, written once, for ``predict_featured``."""
        rows = self.features.transform(_with_target(text_features(df), label_field))
        return written(rows.select("features", "target", label_field), "features")


def bootstrap_weight(seed: int, key: str = "index") -> Column:
    """Seeded Bayesian-bootstrap weight of a row: Exponential(1) from md5(seed:key).

    Every row takes part (weights are never 0); the seed changes the fit the
    way a new random seed changes a stochastic trainer, reproducibly.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 12), 16, 10)
    u = (h.cast("double") + 1.0) / float(16 ** 12 + 1)
    return -F.log(u)


def _with_target(df: DataFrame, label_field: str) -> DataFrame:
    return df.withColumn("target", F.col(label_field).cast("double"))


def fit_text_classifier(train: DataFrame, cfg: TextClassifierConfig = TextClassifierConfig(),
                        weight: Column | None = None, carry: Sequence[str] = ()) -> PipelineModel:
    """M1 fit on the train rows; ``weight`` may use the columns named in ``carry``."""
    return SharedFeatures(train, cfg, carry).fit(cfg, weight)


def predict(model: PipelineModel, df: DataFrame, label_field: str = "label") -> DataFrame:
    """Scores with class, confidence (max logit) and logits text."""
    return _with_logits(model.transform(_with_target(text_features(df), label_field)))


def predict_featured(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``predict`` over rows that have the model's features already (``SharedFeatures.featured``)."""
    return _with_logits(model.stages[-1].transform(rows))


def _with_logits(out: DataFrame) -> DataFrame:
    out = out.withColumn("logits", vector_to_array("rawPrediction"))
    return out.withColumns({
        "prediction": argmax_class("logits"),
        "confidence": max_logit_confidence("logits"),
        "logits_text": logits_text("logits"),
    })


def metrics_table(pred: DataFrame, keys: Sequence[str] = (), label_field: str = "label") -> DataFrame:
    """Weighted (A3) and binary (A4) metrics side by side, one row per kind.
    Both come from one confusion table, so the predictions are computed once
    (the two branches share, and reuse, the confusion aggregate's exchange)."""
    conf = M.confusion_counts(pred, keys, label_field, "prediction")
    w = M.weighted_prf(conf, keys).withColumn("kind", F.lit("weighted"))
    b = M.binary_from_confusion(conf, keys).withColumn("kind", F.lit("binary"))
    cols = [*keys, "kind", "n", "accuracy", "precision", "recall", "f1"]
    return w.select(*cols).unionByName(b.select(*cols))


def select_best(train: DataFrame, valid: DataFrame, candidates: Sequence[TextClassifierConfig],
                label_field: str = "label") -> tuple[PipelineModel, list[tuple[TextClassifierConfig, float]]]:
    """M3: fit each candidate on train (e.g. one per training-length
    "checkpoint"), score on validation (weighted F1), keep the best. Test
    rows are never looked at here. Candidates share the label field and the
    number of features, which are computed once."""
    scores, best = [], None
    shared = SharedFeatures(train, candidates[0])
    valid = shared.featured(valid, label_field)
    for cfg in candidates:
        model = shared.fit(cfg)
        f1 = M.evaluate(predict_featured(model, valid), (), label_field).first()["f1"]
        scores.append((cfg, f1))
        if best is None or f1 > best[1]:
            best = (model, f1)
    return best[0], scores


def embedding_probe(train: DataFrame, reg_param: float = 0.0, max_iter: int = 50) -> PipelineModel:
    """M2: the encoder is frozen (vectors given), only the linear classifier is trained."""
    feats = train.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    lr = LogisticRegression(featuresCol="features", labelCol="target", regParam=reg_param, maxIter=max_iter,
                            family="multinomial")
    return Pipeline(stages=[lr]).fit(feats.withColumn("target", F.col("label").cast("double")))


def probe_predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    feats = df.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    out = model.transform(feats.withColumn("target", F.col("label").cast("double")))
    return out.withColumn("prediction", argmax_class(vector_to_array("rawPrediction")))
