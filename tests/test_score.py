"""Scoring with retry and fallback."""

from pyspark.sql import functions as F

from quillspark.operators.score import RateLimited, RetryPolicy, call_with_retry, pending_rows, score_rows
from quillspark.sources.fixtures import fixture_answer_py, flaky_failures, flaky_scorer


def test_retry_policy_waits_exponentially():
    waits = []
    calls = {"n": 0}

    def fn(row):
        calls["n"] += 1
        raise RateLimited("429")
    res = call_with_retry(fn, {"prompt": "p"}, RetryPolicy(), sleep=waits.append)
    assert calls["n"] == 5 and waits == [1.0, 2.0, 4.0, 8.0]
    assert res.output == "" and res.prompt == "" and "RateLimited" in res.error


def test_other_errors_are_not_retried():
    calls = {"n": 0}

    def fn(row):
        calls["n"] += 1
        raise ValueError("boom")
    res = call_with_retry(fn, {}, RetryPolicy(), sleep=lambda s: None)
    assert calls["n"] == 1 and res.attempts == 1 and res.error.startswith("ValueError")


def test_score_rows_flaky(spark):
    df = spark.range(0, 200).select(F.lit(1).alias("run"), F.col("id").alias("index"), F.lit("p").alias("prompt"))
    out = score_rows(df.repartition(3), flaky_scorer, keep=["run", "index"], policy=RetryPolicy(base_delay=0.0))
    for r in out.collect():
        f = flaky_failures(r["index"])
        assert r.attempts == min(f + 1, 5)
        assert (r.error is not None) == (f >= 5)
        assert r.output == ("" if f >= 5 else fixture_answer_py(1, r["index"]))


def test_pending_rows(spark):
    todo = spark.createDataFrame([("m", 1, 1), ("m", 1, 2)], "model string, run int, index long")
    done = spark.createDataFrame([("m", 1, 1)], "model string, run int, index long")
    assert [r["index"] for r in pending_rows(todo, done, ("model", "run", "index")).collect()] == [2]


def test_scorer_with_reasoning_and_prompt_kept(spark):
    # Defined inside the test so it is pickled by value (the test module is not on the workers).
    def _reasoning_scorer():
        def fn(row):
            return f"RĂSPUNS: factual #{row['index']}", f"thought about {row['index']}"
        return fn

    df = spark.range(0, 50).select(F.lit(1).alias("run"), F.col("id").alias("index"),
                                   F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    out = {r["index"]: r for r in score_rows(df, _reasoning_scorer, keep=["run", "index"],
                                             policy=RetryPolicy(base_delay=0.0)).collect()}
    assert len(out) == 50
    r = out[7]
    assert (r.output, r.reasoning, r.sent_prompt, r.attempts, r.error) == ("RĂSPUNS: factual #7", "thought about 7", "p7", 1, None)
