"""Registered queries: logits and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.constants import SYSTEM_PROMPT_CHAT, USER_PROMPT_CHAT
from quillspark.functions import parse as C
from quillspark.functions import prompts as B
from quillspark.operators.score import RetryPolicy, predict_logits, score_rows
from quillspark.operators.select import filter_split
from quillspark.plans import oracle as O
from quillspark.plans.evaluate import parse_answers
from quillspark.plans.registry import register
from quillspark.sources.fixtures import failing_scorer, fixture_scorer, flaky_scorer, labelled_sentences
from quillspark.sources.tables import read_table

S = O.with_sentences
NO_WAIT = RetryPolicy(base_delay=0.0)


def _logits(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("logits"))


@register("argmax_class", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS cls FROM embeddings")
def q_argmax(spark, sf_dir):
    """C1 over the embedding vectors read as logits."""
    return _logits(spark, sf_dir).select("vec_id", C.argmax_class("logits").alias("cls"))


@register("max_logit_confidence",
          "SELECT vec_id, round(CAST(coalesce(list_max(embedding), 0.0) AS DOUBLE), 6) AS confidence FROM embeddings")
def q_confidence(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", F.round(C.max_logit_confidence("logits"), 6).alias("confidence"))


@register("logits_text", "SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings")
def q_logits_text(spark, sf_dir):
    """Logits as text, parsed back: every number must survive exactly."""
    text = _logits(spark, sf_dir).select("vec_id", C.logits_text("logits").alias("logits"))
    return text.select("vec_id", F.posexplode(F.from_json("logits", "array<double>")).alias("pos", "v"))


def _to_score(spark, sf_dir, runs=(1,)):
    t = filter_split(labelled_sentences(spark, sf_dir), "test").select("index", "sentence", "label")
    t = t.select(F.explode(F.array(*[F.lit(r) for r in runs])).alias("run"), "index", "sentence", "label")
    c0, c1 = B.shuffled_classes(F.col("run"), "index")
    msgs = B.prompt_chat(B.render_system_prompt(SYSTEM_PROMPT_CHAT, c0, c1), B.render_user_prompt("sentence", USER_PROMPT_CHAT))
    return t.withColumn("prompt", B.prompt_to_json(msgs))


_SCORED_SQL = S(O.outputs_cte(1))


@register("score_batches", _SCORED_SQL + "SELECT run, \"index\", output, CAST(1 AS INTEGER) AS attempts FROM outp")
def q_score_batches(spark, sf_dir):
    """Every test row scored once by the stand-in model, in Arrow batches."""
    scored = score_rows(_to_score(spark, sf_dir), fixture_scorer, keep=["run", "index"], policy=NO_WAIT)
    return scored.select("run", "index", "output", "attempts")


_FLAKY = "(strpos('0123456789abcdef', substr(md5('flaky:' || CAST(\"index\" AS VARCHAR)), 1, 1)) - 1) % 7"


@register("score_with_retry", _SCORED_SQL + f"""
SELECT "index", CASE WHEN {_FLAKY} >= 5 THEN '' ELSE output END AS output,
  CAST(least({_FLAKY} + 1, 5) AS INTEGER) AS attempts, {_FLAKY} >= 5 AS failed FROM outp""")
def q_score_retry(spark, sf_dir):
    """Rate limits retried up to 5 tries; rows still limited fall back."""
    scored = score_rows(_to_score(spark, sf_dir), flaky_scorer, keep=["run", "index"], policy=NO_WAIT)
    return scored.select("index", "output", "attempts", F.col("error").isNotNull().alias("failed"))


_FAIL = "(strpos('0123456789abcdef', substr(md5('fail:' || CAST(s.\"index\" AS VARCHAR)), 1, 1)) - 1) < 2"


@register("score_fallback_row", S(O.outputs_cte(1), O.parsed_cte()) + f"""
SELECT s."index", s.label, CASE WHEN {_FAIL} THEN -1 ELSE p.prediction END AS prediction,
  CASE WHEN {_FAIL} THEN '' ELSE p.output END AS output, CAST(1 AS INTEGER) AS attempts, {_FAIL} AS failed
FROM sentl s JOIN pr p USING ("index") WHERE s.split = 'test'""")
def q_score_fallback(spark, sf_dir):
    """Hard failures are not retried; the row keeps its label, prediction -1."""
    src = _to_score(spark, sf_dir)
    scored = score_rows(src, failing_scorer, keep=["run", "index", "label"], policy=NO_WAIT)
    parsed = parse_answers(scored, "chat")
    pred = F.when(F.col("error").isNotNull(), F.lit(-1)).otherwise(F.col("prediction"))
    return parsed.select("index", "label", pred.cast("int").alias("prediction"), "output", "attempts",
                         F.col("error").isNotNull().alias("failed"))


DISPATCH = [("completion", True, "gpt2-large"), ("chat", False, "llama3.1:latest"), ("reasoning", False, "o4-mini")]


@register("dispatch_scorer", S(O.outputs_cte(1), O.parsed_cte()) + """
, comp AS (SELECT *, regexp_replace(
      CASE WHEN contains(output, c0) THEN c0 WHEN contains(output, c1) THEN c1
           WHEN output = '' THEN '-1'
           ELSE regexp_extract(output, '^""" + O.W + "*(" + O.N + r"""*)', 1) END, '[^\p{L}]', '', 'g') AS l2 FROM pr)
SELECT 'completion' AS config, "index", CAST(CASE WHEN contains(l2, 'factual') THEN 0 WHEN contains(l2, 'satiră') THEN 1 ELSE -1 END AS INTEGER) AS prediction FROM comp
UNION ALL SELECT 'chat', "index", prediction FROM pr
UNION ALL SELECT 'reasoning', "index", prediction FROM pr""")
def q_dispatch(spark, sf_dir):
    """Each run configuration gets its prompt (B7) and its parser (C4 or C5)."""
    t = filter_split(labelled_sentences(spark, sf_dir), "test").select(F.lit(1).alias("run"), "index", "sentence")
    c0, c1 = B.shuffled_classes(F.col("run"), "index")
    prompt = None
    for name, completion, model in DISPATCH:
        p = B.prompt_for_run("sentence", c0, c1, use_completion=completion, model=model)
        text = p["prompt_text"] if completion else B.prompt_to_json(p["messages"])
        prompt = F.when(F.col("config") == name, text) if prompt is None else prompt.when(F.col("config") == name, text)
    # one scan and one scoring pass over row x configuration
    t = t.withColumn("config", F.explode(F.array(*[F.lit(d[0]) for d in DISPATCH])))
    scored = score_rows(t.withColumn("prompt", prompt), fixture_scorer, keep=["config", "run", "index"], policy=NO_WAIT)
    chat = parse_answers(scored, "chat")
    completion = C.parse_completion("output", F.col("class0"), F.col("class1"))
    return chat.select("config", "index", F.when(F.col("config").isin(*[d[0] for d in DISPATCH if d[1]]), completion)
                       .otherwise(F.col("prediction")).cast("int").alias("prediction"))


#: A linear model over (tokens, characters): weights that doubles hold exactly, so SQL gives the same logits.
BATCH_WEIGHTS = ((0.25, -0.03125), (-0.125, 0.0625))
BATCH_BIAS = (1.5, -0.75)


def make_linear_model():
    """Built once per worker; called with the columns of one batch."""
    import numpy as np
    weights, bias = np.array(BATCH_WEIGHTS), np.array(BATCH_BIAS)
    return lambda tokens, chars: np.stack([tokens, chars], axis=1) @ weights.T + bias


def _logit_sql(k: int) -> str:
    return f"({BATCH_WEIGHTS[k][0]} * tokens + {BATCH_WEIGHTS[k][1]} * chars + {BATCH_BIAS[k]})::DOUBLE"


@register("predict_batches", S() + f"""
, x AS (SELECT "index", label, len({O.toks_sql('sentence')}) AS tokens, length(sentence) AS chars FROM sentl WHERE split = 'test')
, l AS (SELECT *, {_logit_sql(0)} AS logit_0, {_logit_sql(1)} AS logit_1 FROM x)
SELECT "index", label AS ground_truth, logit_0, logit_1, CAST(CASE WHEN logit_1 > logit_0 THEN 1 ELSE 0 END AS INTEGER) AS prediction,
  greatest(logit_0, logit_1) AS confidence FROM l""")
def q_predict_batches(spark, sf_dir):
    """Class, confidence and logits per row from a model that is called once a batch (C1, C2 on top)."""
    from quillspark.functions.text import tokenize
    t = filter_split(labelled_sentences(spark, sf_dir), "test")
    t = t.select("index", F.col("label").alias("ground_truth"), F.size(tokenize("sentence")).alias("tokens"), F.length("sentence").alias("chars"))
    t = predict_logits(t, make_linear_model, ["tokens", "chars"])
    return t.select("index", "ground_truth", F.col("logits")[0].alias("logit_0"), F.col("logits")[1].alias("logit_1"),
                    C.argmax_class("logits").cast("int").alias("prediction"), C.max_logit_confidence("logits").alias("confidence"))
