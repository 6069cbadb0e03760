"""Registered queries: readers and writers round trips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.constants import SYSTEM_PROMPT_CHAT, USER_PROMPT_CHAT
from quillspark.functions import prompts as B
from quillspark.operators import metrics as M
from quillspark.operators.positions import row_index
from quillspark.operators.tokens import load_stopwords, prepare_lemmas
from quillspark.plans import oracle as O
from quillspark.plans.evaluate import parse_answers
from quillspark.plans.preprocess import preprocess_full
from quillspark.plans.q_prompts import sys_sql, user_sql
from quillspark.plans.q_text import _ANON_SQL, _DICTS
from quillspark.plans.registry import register
from quillspark.session import scratch_path
from quillspark.sources.tables import read_table
from quillspark.sinks import layout_columns, numbered_lines, write_label_files, write_metrics, write_predictions
from quillspark.sources import io as IO
from quillspark.sources.fixtures import gazetteer_df, labelled_sentences, lemmas_df, outputs, stopwords_df

S = O.with_sentences
COLS = ["index", "news_id", "sentence", "domain", "label_0", "label_1", "label_2", "label", "split"]
ALL = 'SELECT "index", news_id, sentence, domain, label_0, label_1, label_2, label, split FROM '


def csv_edge_cases(sentence: Column, index: Column) -> Column:
    """Text that CSV must carry: comma, quotes, newline, backslash, the text NA, empty."""
    d = F.substring(F.md5(F.concat(F.lit("csv:"), index.cast("string"))), 1, 1)
    return (F.when(d == "0", F.concat(sentence, F.lit(", cu virgulă")))
            .when(d == "1", F.concat(F.lit('"'), sentence, F.lit('" a spus')))
            .when(d == "2", F.concat(sentence, F.lit("\nrând nou")))
            .when(d == "3", F.concat(sentence, F.lit(" \\ bară")))
            .when(d == "4", F.lit("NA"))
            .when(d == "5", F.lit(""))
            .otherwise(sentence))


_EDGE_CTE = r"""
, edge AS (SELECT "index", news_id,
    CASE substr(md5('csv:' || CAST("index" AS VARCHAR)), 1, 1)
      WHEN '0' THEN sentence || ', cu virgulă'
      WHEN '1' THEN '"' || sentence || '" a spus'
      WHEN '2' THEN sentence || chr(10) || 'rând nou'
      WHEN '3' THEN sentence || ' \ bară'
      WHEN '4' THEN 'NA'
      WHEN '5' THEN ''
      ELSE sentence END AS sentence,
    domain, label_0, label_1, label_2, label, split FROM sentl)
"""


def _edge(spark, sf_dir):
    t = labelled_sentences(spark, sf_dir)
    return t.withColumn("sentence", csv_edge_cases(F.col("sentence"), F.col("index")))


@register("scan_sentences_csv", S(_EDGE_CTE) + ALL + "edge")
def q_scan_csv(spark, sf_dir):
    """The table written as CSV (folder of parts) and read back with the typed reader."""
    path = scratch_path(spark, "sentences-csv")
    IO.write_sentences_csv(_edge(spark, sf_dir).select(*COLS), path)
    return IO.read_sentences_csv(spark, path).select(*COLS)


@register("dump_sentences", S(_EDGE_CTE) + "SELECT replace(sentence, chr(10), ' ') AS value FROM edge")
def q_dump(spark, sf_dir):
    """One sentence per line, newlines replaced by spaces."""
    path = scratch_path(spark, "sentences-txt")
    IO.dump_sentences(_edge(spark, sf_dir), path)
    return IO.read_lines(spark, path)


@register("sink_processed_csv", _ANON_SQL + _DICTS + O.process_ctes("an", "sentence", "pf") + """
SELECT s."index", s.news_id, pf.t AS sentence, s.domain, s.label_0, s.label_1, s.label_2, s.label, s.split
FROM sentl s JOIN pf USING ("index")""")
def q_sink_processed(spark, sf_dir):
    """S3: the preprocessed table written as CSV and read back."""
    out = preprocess_full(labelled_sentences(spark, sf_dir), gazetteer=gazetteer_df(spark),
                          stopwords=load_stopwords(stopwords_df(spark), "ro"), lemmas=prepare_lemmas(lemmas_df(spark), "ro"))
    path = scratch_path(spark, "processed-csv")
    IO.write_sentences_csv(out.select(*COLS), path)
    return IO.read_sentences_csv(spark, path).select(*COLS)


RUNS = (1, 2)
#: Predictions, with their prompts, for one writing task.
PREDICTION_ROWS = 50_000
MODEL = "fixture:latest"


def _prediction_rows(spark, sf_dir):
    gold = labelled_sentences(spark, sf_dir).where(F.col("split") == "test").select("index", "sentence", "label")
    gold = row_index(gold.withColumn("split", F.lit("test")), ("split",), "index", out="idx").drop("split")
    raw = outputs(gold.select("index"), list(RUNS))
    parsed = parse_answers(raw, "chat")
    c0, c1 = B.shuffled_classes(F.col("run"), "index")
    prompt = B.prompt_to_json(B.prompt_chat(B.render_system_prompt(SYSTEM_PROMPT_CHAT, c0, c1),
                                            B.render_user_prompt("sentence", USER_PROMPT_CHAT)))
    # both sides dealt by the number of rows, so that a writing task sorts so many prompts however many there are
    parts = max(spark.sparkContext.defaultParallelism, -(-gold.count() * len(RUNS) // PREDICTION_ROWS))
    rows = parsed.repartition(parts, "index").join(gold.repartition(parts, "index"), "index").select(
        F.lit(MODEL).alias("model_name"), F.col("run").cast("int").alias("run"), "idx", "sentence",
        prompt.alias("prompt"), F.col("label").alias("ground_truth"), "prediction",
        F.col("output").alias("llm_output"), F.lit(None).cast("string").alias("llm_reasoning"))
    return rows


_PRED_ROWS_SQL = S(O.outputs_cte(len(RUNS)), O.parsed_cte(), f"""
, g AS (SELECT "index", sentence, label, row_number() OVER (ORDER BY "index") - 1 AS idx FROM sentl WHERE split = 'test')
, rows_ AS (SELECT '{MODEL}' AS model_name, p.run, g.idx, g.sentence,
    to_json([{{'role': 'system', 'content': {sys_sql(SYSTEM_PROMPT_CHAT)}}},
             {{'role': 'user', 'content': {user_sql(USER_PROMPT_CHAT, 'g.sentence')}}}]) AS prompt,
    g.label AS ground_truth, p.prediction, p.output AS llm_output, CAST(NULL AS VARCHAR) AS llm_reasoning
  FROM pr p JOIN g USING ("index"))
""")


@register("sink_predictions", _PRED_ROWS_SQL + """
SELECT split_part(model_name, ':', 1) AS model, run, idx, sentence, prompt, ground_truth, prediction, llm_output, llm_reasoning
FROM rows_""")
def q_sink_predictions(spark, sf_dir):
    """Per-row predictions written partitioned by (model, run) and read back."""
    path = scratch_path(spark, "predictions")
    write_predictions(_prediction_rows(spark, sf_dir), path)
    return spark.read.parquet(path).select("model", F.col("run").cast("int").alias("run"), "idx", "sentence", "prompt",
                                           "ground_truth", "prediction", "llm_output", "llm_reasoning")


@register("sink_label_files", _PRED_ROWS_SQL + """
SELECT 'preds' AS kind, run, CAST(idx AS BIGINT) AS line, CAST(prediction AS INTEGER) AS v FROM rows_
UNION ALL SELECT 'gt', run, CAST(idx AS BIGINT), CAST(ground_truth AS INTEGER) FROM rows_""")
def q_sink_label_files(spark, sf_dir):
    """Preds / gt text per run, one label per line in idx order; read back with line numbers."""
    path = scratch_path(spark, "label-files")
    write_label_files(_prediction_rows(spark, sf_dir), path)
    # lines are numbered through a run's part files, file by file; the files themselves are the result
    return numbered_lines(spark, path, ["kind", "run"]).select("kind", F.col("run").cast("int").alias("run"), "line", F.col("value").cast("int").alias("v"))


@register("sink_metrics", _PRED_ROWS_SQL.replace("WITH ", "WITH ", 1) + """
, m_src AS (SELECT run, ground_truth AS label, prediction FROM rows_)
""" + O.weighted_sql("m_src", ["run"], with_invalid=False).replace(
    "SELECT run, CAST(sum(sup)", f"SELECT 'fixture' AS model, 'sentences' AS data_file, run, CAST(sum(sup)", 1))
def q_sink_metrics(spark, sf_dir):
    """One metrics record per run appended to a metrics table, read back."""
    rows = _prediction_rows(spark, sf_dir)
    m = M.weighted_prf(M.confusion_counts(rows, ["run"], "ground_truth", "prediction"), ["run"])
    path = scratch_path(spark, "metrics")
    write_metrics(m.withColumn("model", F.lit("fixture")).withColumn("data_file", F.lit("sentences")), path)
    return spark.read.parquet(path).select("model", "data_file", F.col("run").cast("int").alias("run"), "n",
                                           "accuracy", "precision", "recall", "f1")


_LAYOUT_SQL = """CASE doc_id % 3 WHEN 0 THEN 'hf.co/' || source || '/' || lang || ':Q4_K_M' WHEN 1 THEN source || ':' || lang ELSE source END"""


@register("run_layout", f"""
, m AS (SELECT {_LAYOUT_SQL} AS model_name, CAST(doc_id % 4 + 1 AS INTEGER) AS run FROM documents)
SELECT model_name, run, split_part(model_name, ':', 1) AS model, split_part(string_split(model_name, '/')[-1], ':', 1) AS base_model,
  'results/inference/' || split_part(model_name, ':', 1) || '/' || CAST(run AS VARCHAR) AS path, count(*) AS n_rows
FROM m GROUP BY ALL""".replace(", m AS", "WITH m AS", 1))
def q_run_layout(spark, sf_dir):
    """Output folder per (model, run) of a table with a model name per row: model = text before the first ':',
    base model = last path segment before ':'."""
    source, lang, k = F.col("source"), F.col("lang"), F.col("doc_id") % 3
    name = (F.when(k == 0, F.concat(F.lit("hf.co/"), source, F.lit("/"), lang, F.lit(":Q4_K_M")))
            .when(k == 1, F.concat(source, F.lit(":"), lang)).otherwise(source))
    t = read_table(spark, sf_dir, "documents").select(name.alias("model_name"), (F.col("doc_id") % 4 + 1).cast("int").alias("run"))
    t = t.select("model_name", "run", *layout_columns(F.col("model_name"), F.col("run")))
    return t.groupBy("model_name", "run", "model", "base_model", "path").agg(F.count(F.lit(1)).alias("n_rows"))
