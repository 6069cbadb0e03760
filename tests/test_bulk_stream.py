"""Bulk evaluation (resume without re-scoring) and the streaming runners."""

from pyspark.sql import functions as F

from quillspark.operators.score import RetryPolicy
from quillspark.operators.tokens import load_stopwords, prepare_lemmas
from quillspark.plans.bulk_eval import RunConfig, prompts_for_runs, run_bulk_evaluation, score_pending
from quillspark.plans.evaluate import gold_rows
from quillspark.plans.preprocess import preprocess_full
from quillspark.session import scratch_path
from quillspark.sources.fixtures import fixture_scorer, gazetteer_df, labelled_sentences, lemmas_df, stopwords_df
from quillspark.streaming.incremental import incremental_preprocess, incremental_scoring
from tests.conftest import SMOKE

NO_WAIT = RetryPolicy(base_delay=0.0)


def test_bulk_resume_scores_only_missing_keys(spark):
    gold = gold_rows(spark, SMOKE)
    out = scratch_path(spark, "bulk-test")
    cfg = RunConfig(model="fixture:latest")
    half = gold.where(F.col("index") % 2 == 0)
    score_pending(spark, prompts_for_runs(half, [1], cfg), fixture_scorer, f"{out}/raw", policy=NO_WAIT)
    n_half = spark.read.parquet(f"{out}/raw").count()
    m = run_bulk_evaluation(spark, gold, fixture_scorer, out, runs=[1], cfg=cfg, policy=NO_WAIT).first()
    raw = spark.read.parquet(f"{out}/raw")
    assert raw.count() == gold.count() and 0 < n_half < raw.count()
    assert raw.groupBy("config_id", "run", "index").count().where("count > 1").count() == 0
    assert m["n"] == gold.count()


def test_models_with_one_short_name_and_reruns_stay_apart(spark):
    gold = gold_rows(spark, SMOKE).limit(20).cache()
    out = scratch_path(spark, "bulk-ids")
    kw = dict(runs=[1], policy=NO_WAIT)
    wrong_scorer, _ = local_scorers()
    run_bulk_evaluation(spark, gold, fixture_scorer, out, cfg=RunConfig(model="m:8b"), **kw)
    run_bulk_evaluation(spark, gold, wrong_scorer, out, cfg=RunConfig(model="m:70b"), **kw)
    run_bulk_evaluation(spark, gold, wrong_scorer, out, cfg=RunConfig(model="m:8b", temperature=1.0), **kw)
    again = run_bulk_evaluation(spark, gold, wrong_scorer, out, cfg=RunConfig(model="m:8b"), **kw).collect()
    assert len(again) == 1  # answered before: not scored again, metrics not repeated
    rows = spark.read.parquet(f"{out}/metrics").collect()
    assert sorted((r.model_name, r.temperature is None) for r in rows) == [("m:70b", True), ("m:8b", False), ("m:8b", True)]
    invalid = {(r.model_name, r.temperature): r.n_invalid for r in rows}
    assert invalid[("m:70b", None)] == 20 == invalid[("m:8b", 1.0)] > invalid[("m:8b", None)]
    assert spark.read.parquet(f"{out}/predictions").count() == 60


def local_scorers():
    """Factories that travel by value: test modules are not shipped to the workers."""
    def wrong():
        return lambda row: "?"

    def failing():
        def fn(row):
            raise ValueError("down")
        return fn

    return wrong, failing


def test_failed_rows_are_scored_again(spark):
    gold = gold_rows(spark, SMOKE).limit(6).cache()
    out = scratch_path(spark, "bulk-retry")
    cfg = RunConfig(model="m")
    _, failing_scorer = local_scorers()
    first = run_bulk_evaluation(spark, gold, failing_scorer, out, runs=[1], cfg=cfg, policy=NO_WAIT).first()
    assert first.n_invalid == 6
    assert {r.prompt for r in spark.read.parquet(f"{out}/predictions").collect()} == {'""'}
    m = run_bulk_evaluation(spark, gold, fixture_scorer, out, runs=[1], cfg=cfg, policy=NO_WAIT).first()
    assert m.n == 6 and spark.read.parquet(f"{out}/raw").count() == 12
    preds = spark.read.parquet(f"{out}/predictions")
    assert preds.count() == 6 and preds.where("llm_output = ''").count() < 6


def test_unreadable_raw_outputs_raise(spark):
    import os

    import pytest

    gold = gold_rows(spark, SMOKE).limit(3)
    out = scratch_path(spark, "bulk-corrupt")
    os.makedirs(f"{out}/raw/config_id=x/run=1")
    with open(f"{out}/raw/config_id=x/run=1/part-0.parquet", "wb") as f:
        f.write(b"not a parquet file at all")
    with pytest.raises(Exception, match="(?i)footer|parquet|read"):
        run_bulk_evaluation(spark, gold, fixture_scorer, out, runs=[1], cfg=RunConfig(model="m"), policy=NO_WAIT)


def test_settings_reach_the_scorer(spark):
    gold = gold_rows(spark, SMOKE).limit(2)
    out = scratch_path(spark, "bulk-settings")

    def echo():
        return lambda row: f"{row['model_name']}|{row['temperature']}|{row['top_k']}|{row['seed']}|{row['prompt'][:1]}|{row['instructions'] is not None}"

    score_pending(spark, prompts_for_runs(gold, [1], RunConfig(model="o3-mini:x", temperature=0.5, top_k=7, seed=3)), echo, f"{out}/raw", policy=NO_WAIT)
    got = {r.output for r in spark.read.parquet(f"{out}/raw").collect()}
    assert all(x.startswith("o3-mini:x|0.5|7|3|") and x.endswith("|True") and "|[|" not in x for x in got)


def _write_in_chunks(spark, df, src):
    a = df.where(F.col("index") % 2 == 0)
    b = df.where(F.col("index") % 2 == 1)
    a.write.mode("append").parquet(src)
    b.write.mode("append").parquet(src)


def test_incremental_preprocess_equals_batch(spark):
    sent = labelled_sentences(spark, SMOKE)
    src, out, ckpt = (scratch_path(spark, n) for n in ("stream-src", "stream-out", "stream-ckpt"))
    _write_in_chunks(spark, sent, src)
    kw = dict(gazetteer=gazetteer_df(spark), stopwords=load_stopwords(stopwords_df(spark), "ro"),
              lemmas=prepare_lemmas(lemmas_df(spark), "ro"))
    q = incremental_preprocess(spark, src, spark.read.parquet(src).schema, out, ckpt, max_files=1, **kw)
    q.awaitTermination(300)
    got = spark.read.parquet(out).drop("batch_id")
    want = preprocess_full(sent, **kw)
    cols = sorted(want.columns)
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_incremental_scoring(spark):
    sent = labelled_sentences(spark, SMOKE)
    src, raw, ckpt = (scratch_path(spark, n) for n in ("score-src", "score-raw", "score-ckpt"))
    _write_in_chunks(spark, sent, src)
    q = incremental_scoring(spark, src, spark.read.parquet(src).schema, fixture_scorer, raw, ckpt,
                            cfg=RunConfig(model="fixture:latest"), policy=NO_WAIT)
    q.awaitTermination(300)
    assert spark.read.parquet(raw).count() == sent.where("split = 'test'").count()


def test_label_files_are_in_idx_order(spark):
    import glob

    from quillspark.sinks import write_label_files

    rows = spark.range(0, 2000).select(
        F.lit(1).alias("run"), F.col("id").alias("idx"),
        (F.col("id") % 3 - 1).cast("int").alias("prediction"), (F.col("id") % 2).cast("int").alias("ground_truth"))
    path = scratch_path(spark, "labels-order")
    write_label_files(rows.repartition(7), path)
    lines = []
    for f in sorted(glob.glob(f"{path}/kind=preds/run=1/part-*")):
        with open(f) as fh:
            lines += fh.read().splitlines()
    assert lines == [str(i % 3 - 1) for i in range(2000)]


def test_bulk_predictions_idx_is_position(spark):
    gold = gold_rows(spark, SMOKE)
    out = scratch_path(spark, "bulk-idx")
    run_bulk_evaluation(spark, gold, fixture_scorer, out, runs=[1], cfg=RunConfig(model="fixture:latest"), policy=NO_WAIT)
    idx = sorted(r.idx for r in spark.read.parquet(f"{out}/predictions").select("idx").collect())
    assert idx == list(range(gold.count()))


def test_incremental_scoring_resumes_from_checkpoint(spark):
    sent = labelled_sentences(spark, SMOKE)
    src, raw, ckpt = (scratch_path(spark, n) for n in ("resume-src", "resume-raw", "resume-ckpt"))
    sent.where(F.col("index") % 2 == 0).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    cfg = RunConfig(model="fixture:latest")
    incremental_scoring(spark, src, schema, fixture_scorer, raw, ckpt, cfg=cfg, policy=NO_WAIT).awaitTermination(300)
    first = spark.read.parquet(raw).count()
    # new files arrive; a second run with the same checkpoint scores only them
    sent.where(F.col("index") % 2 == 1).write.mode("append").parquet(src)
    incremental_scoring(spark, src, schema, fixture_scorer, raw, ckpt, cfg=cfg, policy=NO_WAIT).awaitTermination(300)
    out = spark.read.parquet(raw)
    assert 0 < first < out.count() == sent.where("split = 'test'").count()
    assert out.groupBy("model", "run", "index").count().where("count > 1").count() == 0
