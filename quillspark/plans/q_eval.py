"""Registered queries: parsing, alignment and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import metrics as M
from quillspark.operators.align import scatter_results
from quillspark.operators.annotate import corpus_stats, majority_vote, majority_vote_long
from quillspark.plans import oracle as O
from quillspark.plans.evaluate import parse_answers, scored_predictions, gold_rows
from quillspark.plans.registry import register
from quillspark.sources.fixtures import labelled_sentences, outputs, sentences

RUNS = 5

_PRED_SQL_1 = O.with_sentences(O.outputs_cte(1), O.parsed_cte(),
    ', preds AS (SELECT p.run, p."index", s.domain, s.label, p.prediction FROM pr p JOIN sentl s USING ("index"))')
_PRED_SQL_5 = O.with_sentences(O.outputs_cte(RUNS), O.parsed_cte(),
    ', preds AS (SELECT p.run, p."index", s.domain, s.label, p.prediction FROM pr p JOIN sentl s USING ("index"))')


@register("parse_chat", O.with_sentences(O.outputs_cte(1), O.parsed_cte()) +
          'SELECT run, "index", output, ans AS answer, prediction FROM pr')
def q_parse_chat(spark, sf_dir):
    raw = outputs(gold_rows(spark, sf_dir).select("index"), 1)
    return (parse_answers(raw, "chat")
            .select(F.col("run").cast("int").alias("run"), "index", "output", "answer", "prediction"))


_COMPLETION_SQL = O.with_sentences(O.outputs_cte(1), r"""
, ord AS (
  SELECT *, substr(md5(concat('order:', CAST(run AS VARCHAR), ':', CAST("index" AS VARCHAR))),1,1) >= '8' AS swapped FROM outp)
, ans AS (
  SELECT *, CASE WHEN swapped THEN 'satiră' ELSE 'factual' END AS c0,
            CASE WHEN swapped THEN 'factual' ELSE 'satiră' END AS c1 FROM ord)
, pick AS (
  SELECT *, regexp_replace(
      CASE WHEN contains(output, c0) THEN c0 WHEN contains(output, c1) THEN c1
           WHEN output = '' THEN '-1'
           ELSE regexp_extract(output, '^""" + O.W + "*(" + O.N + r"""*)', 1) END, '[^\p{L}]', '', 'g') AS letters
  FROM ans)
SELECT run, "index", output, CAST(CASE WHEN contains(letters, 'factual') THEN 0
                                       WHEN contains(letters, 'satiră') THEN 1 ELSE -1 END AS INTEGER) AS prediction
FROM pick
""")


@register("parse_completion", _COMPLETION_SQL)
def q_parse_completion(spark, sf_dir):
    raw = outputs(gold_rows(spark, sf_dir).select("index"), 1)
    return (parse_answers(raw, "completion")
            .select(F.col("run").cast("int").alias("run"), "index", "output", "prediction"))


@register("align_predictions", _PRED_SQL_1 + 'SELECT run, "index", domain, label, prediction FROM preds')
def q_align(spark, sf_dir):
    return scored_predictions(spark, sf_dir, 1, align=True).select("run", "index", "domain", "label", "prediction")


@register("scatter_results", O.with_sentences(O.outputs_cte(1), O.parsed_cte()) + r"""
SELECT s."index", s.label, CAST(p.prediction AS VARCHAR) AS prediction
FROM sentl s LEFT JOIN (SELECT * FROM pr WHERE substr(md5(CAST("index" AS VARCHAR)), 1, 1) <> 'f') p USING ("index")
WHERE s.split = 'test'
""")
def q_scatter(spark, sf_dir):
    gold = gold_rows(spark, sf_dir).select("index", "label")
    preds = parse_answers(outputs(gold.select("index"), 1), "chat").select("index", "prediction")
    # Results arrive unordered and some are missing (here: md5 digit f).
    preds = preds.where(F.substring(F.md5(F.col("index").cast("string")), 1, 1) != "f")
    # The prediction is shown as text so a missing slot is a plain null.
    return scatter_results(gold, preds, ["index"]).withColumn("prediction", F.col("prediction").cast("string"))


@register("confusion_counts", _PRED_SQL_5 + """
SELECT run, label AS gt, prediction AS pred, count(*) AS n FROM preds GROUP BY run, label, prediction""")
def q_confusion(spark, sf_dir):
    return M.confusion_counts(scored_predictions(spark, sf_dir, RUNS), ["run"])


@register("accuracy", _PRED_SQL_1 + """
SELECT run, round(avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n
FROM preds GROUP BY run""")
def q_accuracy(spark, sf_dir):
    return M.accuracy(scored_predictions(spark, sf_dir, 1), ["run"])


@register("weighted_prf", _PRED_SQL_1 + O.weighted_sql("preds", ["run", "domain"]))
def q_weighted(spark, sf_dir):
    return M.evaluate(scored_predictions(spark, sf_dir, 1), ["run", "domain"])


@register("metrics_by_run", _PRED_SQL_5 + O.weighted_sql("preds", ["run"]))
def q_metrics_by_run(spark, sf_dir):
    return M.evaluate(scored_predictions(spark, sf_dir, RUNS), ["run"])


@register("run_summary", _PRED_SQL_5 + O.weighted_sql("preds", ["run"]).replace(
    "SELECT run, CAST(sum(sup)", ", m AS (SELECT run, CAST(sum(sup)", 1) + """)
SELECT 'fixture' AS model, count(*) AS n_runs,
  round(avg(accuracy), 6) AS accuracy_mean, round(stddev_samp(accuracy), 6) AS accuracy_std,
  round(avg(precision), 6) AS precision_mean, round(stddev_samp(precision), 6) AS precision_std,
  round(avg(recall), 6) AS recall_mean, round(stddev_samp(recall), 6) AS recall_std,
  round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std
FROM m""")
def q_run_summary(spark, sf_dir):
    m = M.evaluate(scored_predictions(spark, sf_dir, RUNS), ["run"])
    return M.run_summary(m.withColumn("model", F.lit("fixture")), ["model"])


@register("binary_prf", _PRED_SQL_5 + """
, b AS (SELECT run, count(*) AS n,
    sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS ok,
    sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN prediction = 1 THEN 1 ELSE 0 END) AS pp,
    sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS sup
  FROM preds GROUP BY run)
SELECT run, n, round(ok / n, 6) AS accuracy,
  round(CASE WHEN pp = 0 THEN 0 ELSE tp / pp END, 6) AS precision,
  round(CASE WHEN sup = 0 THEN 0 ELSE tp / sup END, 6) AS recall,
  round(CASE WHEN pp + sup = 0 THEN 0 ELSE 2 * tp / (pp + sup) END, 6) AS f1
FROM b""")
def q_binary(spark, sf_dir):
    return M.binary_prf(scored_predictions(spark, sf_dir, RUNS), ["run"])


@register("invalid_rate", _PRED_SQL_5 + """
SELECT run, domain, count(*) AS n, count(*) FILTER (WHERE prediction = -1) AS n_invalid,
  round(avg(CASE WHEN prediction = -1 THEN 1.0 ELSE 0.0 END), 6) AS invalid_share
FROM preds GROUP BY run, domain""")
def q_invalid(spark, sf_dir):
    return M.invalid_rate(scored_predictions(spark, sf_dir, RUNS), ["run", "domain"])


@register("label_union", _PRED_SQL_5 + """
SELECT DISTINCT run, c AS cls FROM (SELECT run, label AS c FROM preds UNION ALL SELECT run, prediction FROM preds)""")
def q_label_union(spark, sf_dir):
    conf = M.confusion_counts(scored_predictions(spark, sf_dir, RUNS), ["run"])
    return M.per_class_counts(conf, ["run"]).select("run", "cls")


@register("majority_vote", O.with_sentences() + """
SELECT "index", label_0, label_1, label_2, label FROM sentl""")
def q_majority(spark, sf_dir):
    return majority_vote(sentences(spark, sf_dir)).select("index", "label_0", "label_1", "label_2", "label")


_VOTES_SQL = """
, v AS (SELECT "index", CASE WHEN "index" % 35 = 0 THEN NULL ELSE label_0 END AS a,
               CASE WHEN "index" % 5 = 0 THEN NULL ELSE label_1 END AS b, CASE WHEN "index" % 35 = 0 THEN NULL ELSE label_2 END AS c FROM sentl)
, u AS (SELECT "index", unnest([a, b, c]) AS vote FROM v)
, n AS (SELECT "index", count(vote) AS k, count_if(vote = 1) AS ones, count_if(vote = 0) AS zeros FROM u GROUP BY "index")
"""


def _majority_sql(k: str, ones: str, zeros: str) -> str:
    return f"CASE WHEN {ones} * 2 > {k} THEN 1 WHEN {zeros} * 2 > {k} THEN 0 END"


@register("majority_vote_partial", O.with_sentences(_VOTES_SQL) + f"""
SELECT v."index", coalesce({_majority_sql('n.k', 'n.ones', 'n.zeros')}, -9) AS of_three, coalesce({_majority_sql('n.k', 'n.ones', 'n.zeros')}, -9) AS long_form,
  coalesce({_majority_sql('(count_a + count_b)', '(one_a + one_b)', '(zero_a + zero_b)')}, -9) AS of_two
FROM n JOIN (SELECT "index", CASE WHEN a IS NULL THEN 0 ELSE 1 END AS count_a, CASE WHEN b IS NULL THEN 0 ELSE 1 END AS count_b,
  CASE WHEN a = 1 THEN 1 ELSE 0 END AS one_a, CASE WHEN b = 1 THEN 1 ELSE 0 END AS one_b,
  CASE WHEN a = 0 THEN 1 ELSE 0 END AS zero_a, CASE WHEN b = 0 THEN 1 ELSE 0 END AS zero_b FROM v) v USING ("index")""")
def q_majority_partial(spark, sf_dir):
    """A5 with missing votes, two and three annotators, and the long form; -9 stands for no majority."""
    i = F.col("index")
    v = sentences(spark, sf_dir).select(
        "index", F.when(i % 35 != 0, F.col("label_0")).alias("a"), F.when(i % 5 != 0, F.col("label_1")).alias("b"),
        F.when(i % 35 != 0, F.col("label_2")).alias("c"))
    wide = majority_vote(majority_vote(v, ("a", "b", "c"), "of_three"), ("a", "b"), "of_two")
    long = majority_vote_long(v.select("index", F.explode(F.array("a", "b", "c")).alias("vote")))
    out = wide.join(long.select("index", F.col("label").alias("long_form")), "index")
    return out.select("index", *[F.coalesce(c, F.lit(-9)).cast("int").alias(c) for c in ("of_three", "long_form", "of_two")])


@register("corpus_stats", O.with_sentences() + """
SELECT split, domain, label, count(*) AS n_sentences, count(DISTINCT news_id) AS n_news,
  round(avg(length(sentence)), 6) AS avg_chars
FROM sentl GROUP BY split, domain, label""")
def q_corpus_stats(spark, sf_dir):
    return corpus_stats(labelled_sentences(spark, sf_dir))


BULK_RUNS = (1, 2)


_BULK_MODELS = ("fixture:8b", "fixture:70b")


@register("bulk_evaluation", O.with_sentences(O.outputs_cte(len(BULK_RUNS)), O.parsed_cte(),
    """, preds AS (SELECT m.model_name, p.run, p."index", s.label, p.prediction FROM pr p JOIN sentl s USING ("index")
       CROSS JOIN (SELECT unnest(['fixture:8b', 'fixture:70b']) AS model_name) m)""")
    + O.weighted_sql("preds", ["model_name", "run"]).replace(
        "SELECT model_name, run, CAST(sum(sup)", "SELECT 'fixture' AS model, 'sentences' AS data_file, model_name, run, CAST(sum(sup)", 1))
def q_bulk(spark, sf_dir):
    """The whole job for two models that share a short name, then one of them again:
    score (stand-in model) -> raw outputs -> parse -> predictions -> metrics per run."""
    from quillspark.operators.score import RetryPolicy
    from quillspark.plans.bulk_eval import RunConfig, run_bulk_evaluation
    from quillspark.session import scratch_path
    from quillspark.sources.fixtures import fixture_scorer

    out = scratch_path(spark, "bulk-eval")
    gold = gold_rows(spark, sf_dir)
    for model, runs in ((_BULK_MODELS[0], BULK_RUNS[:1]), (_BULK_MODELS[1], BULK_RUNS), (_BULK_MODELS[0], BULK_RUNS)):
        run_bulk_evaluation(spark, gold, fixture_scorer, out, runs=runs, cfg=RunConfig(model=model, temperature=0.8),
                            policy=RetryPolicy(base_delay=0.0))
    return spark.read.parquet(f"{out}/metrics").select(
        "model", "data_file", "model_name", F.col("run").cast("int").alias("run"), "n", "accuracy", "precision", "recall", "f1", "n_invalid")
