"""Bulk evaluation of a scorer over repeated runs (the original's main job).

test rows x runs -> prompt per run configuration (B7, B9) -> scorer
(mapInPandas, C7-C9) -> raw outputs written first, keyed by (config, run,
index) -> parse (C4/C5) -> strict alignment with gold (J1) -> predictions
table (S5) and metrics per configuration and run (A3, A7, S8).

``config_id`` is a digest of the whole run configuration: model name with
its tag, data file, seed, decoding settings and prompt flags. Models that
share a short name, or one model under changed settings, never share rows.
The settings go to the scorer with every row and are columns of all three
tables.

Raw outputs are durable: re-parsing never re-scores, and a restart scores
the keys that have no answer yet, rows that failed included (left-anti
join); the latest answer of a key counts. Predictions and metrics of a
configuration and run replace their earlier version.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import prompts as B
from quillspark.operators import metrics as M
from quillspark.operators.align import align_predictions
from quillspark.operators.positions import row_index
from quillspark.operators.score import RetryPolicy, pending_rows, score_rows
from quillspark.plans.evaluate import parse_answers
from quillspark.session import written
from quillspark.sinks import write_metrics, write_predictions

KEYS = ("config_id", "run", "index")
#: Rows of runs, with their prompts, for one scoring or writing task.
TASK_ROWS = 50_000


@dataclass(frozen=True)
class RunConfig:
    """Everything that decides a run's answers; a None decoding setting leaves the choice to the scorer."""

    model: str = "llama3.1:latest"
    use_completion: bool = False
    from_ft_model: bool = False
    merge_system_into_user: bool = False
    data_file: str = "sentences"
    seed: int | None = None
    temperature: float | None = None
    top_k: int | None = None
    top_p: float | None = None
    min_p: float | None = None

    @property
    def config_id(self) -> str:
        return hashlib.md5(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    def columns(self) -> list:
        """The configuration as literal columns (``model_name`` keeps the tag; ``model`` is the short display name)."""
        kinds = {"seed": "long", "temperature": "double", "top_k": "int", "top_p": "double", "min_p": "double"}
        values = asdict(self)
        name = values.pop("model")
        return [F.lit(self.config_id).alias("config_id"), F.lit(name).alias("model_name"), F.lit(name.split(":")[0]).alias("model"),
                *[F.lit(v).cast(kinds[k]).alias(k) if k in kinds else F.lit(v).alias(k) for k, v in values.items()]]


CONFIG_COLUMNS = ("config_id", "model_name", "model", "use_completion", "from_ft_model", "merge_system_into_user", "data_file",
                  "seed", "temperature", "top_k", "top_p", "min_p")


def prompts_for_runs(gold: DataFrame, runs: Sequence[int], cfg: RunConfig) -> DataFrame:
    """(configuration, run, index, label, sentence, prompt, prompt_json, instructions).

    ``prompt`` is what the scorer gets: the text in completion mode, the user message's content in reasoning mode
    (with the system text as ``instructions``), else the message array as JSON.
    """
    return with_prompts(rows_of_runs(gold, runs, cfg), cfg)


def rows_of_runs(gold: DataFrame, runs: Sequence[int], cfg: RunConfig) -> DataFrame:
    """(config_id, run, index, sentence, label): every row for every run."""
    return gold.select("index", "sentence", "label").select(
        F.lit(cfg.config_id).alias("config_id"), F.explode(F.array(*[F.lit(int(r)) for r in runs])).alias("run"), "index", "sentence", "label")


def with_prompts(t: DataFrame, cfg: RunConfig) -> DataFrame:
    """The rows of runs with the configuration and their prompts (see ``prompts_for_runs``), other columns kept; nothing moves."""
    c0, c1 = B.shuffled_classes(F.col("run"), "index")
    p = B.prompt_for_run("sentence", c0, c1, use_completion=cfg.use_completion, from_ft_model=cfg.from_ft_model,
                         merge_system_into_user=cfg.merge_system_into_user, model=cfg.model)
    prompt_json = B.json_string(p["prompt_text"]) if cfg.use_completion else B.prompt_to_json(p["messages"])
    if cfg.use_completion:
        prompt = p["prompt_text"]
    else:
        prompt = F.when(p["instructions"].isNotNull(), F.get(p["messages"], F.lit(0))["content"]).otherwise(prompt_json)
    own = ("config_id", "run", "index", "label", "sentence")
    return t.select(*cfg.columns(), "run", "index", "label", "sentence", *[c for c in t.columns if c not in own],
                    prompt.alias("prompt"), prompt_json.alias("prompt_json"), p["instructions"].alias("instructions"))


def read_raw(spark: SparkSession, raw_path: str) -> DataFrame | None:
    """The raw outputs, or None when nothing has been written yet; any other failure to read is raised."""
    try:
        return spark.read.parquet(raw_path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def latest_answers(raw: DataFrame) -> DataFrame:
    """One row per key: an answer rather than an error, then the latest."""
    rest = [c for c in raw.columns if c not in KEYS]
    best = raw.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), F.struct(F.col("error").isNull(), F.col("scored_at"))).alias("r"))
    return best.select(*KEYS, *[F.col(f"r.{c}").alias(c) for c in rest])


def score_pending(spark: SparkSession, todo: DataFrame, make_scorer: Callable, raw_path: str,
                  concurrency: int = 8, policy: RetryPolicy = RetryPolicy(), partitions: int | None = None,
                  prompts: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Score the rows of ``todo`` that have no answer in ``raw_path`` yet and append them there.

    The rows are spread over ``partitions`` tasks (by default as many as the cluster has slots), each with ``concurrency`` calls.
    ``prompts`` adds the prompts to rows that have none, once they are spread, so that no prompt is shuffled.
    """
    raw = read_raw(spark, raw_path)
    if raw is not None:
        todo = pending_rows(todo, raw.where(F.col("error").isNull()), KEYS)
    todo = todo.repartition(partitions or spark.sparkContext.defaultParallelism, *KEYS)
    if prompts is not None:
        todo = prompts(todo)
    scored = score_rows(todo, make_scorer, keep=[*CONFIG_COLUMNS, "run", "index", "instructions"], prompt_col="prompt",
                        concurrency=concurrency, policy=policy)
    (scored.withColumn("scored_at", F.current_timestamp())
     .write.mode("append").partitionBy("config_id", "run").parquet(raw_path))


def run_bulk_evaluation(spark: SparkSession, gold: DataFrame, make_scorer: Callable, out_dir: str, *,
                        runs: Sequence[int] = (1, 2, 3, 4, 5), cfg: RunConfig = RunConfig(),
                        concurrency: int = 8, policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """Score, persist, parse, align and evaluate; returns the metrics per (model, run)."""
    gold = written(gold.select("index", "sentence", "label"), "gold")  # read several times below
    parts = max(spark.sparkContext.defaultParallelism, -(-gold.count() * len(runs) // TASK_ROWS))
    raw_path = f"{out_dir}/raw"
    score_pending(spark, rows_of_runs(gold, runs, cfg), make_scorer, raw_path, concurrency, policy, parts, lambda t: with_prompts(t, cfg))
    run_list = [int(r) for r in runs]
    this = (F.col("config_id") == cfg.config_id) & F.col("run").isin(*run_list)
    # of the prompt that was sent, only whether there was one
    raw = read_raw(spark, raw_path).where(this).select(*KEYS, "output", "reasoning", "error", "scored_at", (F.col("sent_prompt") == "").alias("unsent"))
    parsed = parse_answers(latest_answers(raw), "completion" if cfg.use_completion else "chat")
    pred = F.when(F.col("error").isNotNull(), F.lit(-1)).otherwise(F.col("prediction")).cast("int")
    parsed = written(parsed.select("config_id", F.col("run").cast("int").alias("run"), "index", pred.alias("prediction"),
                                   "output", "reasoning", "unsent"), "parsed")
    # every evaluated row must have an answer and every answer a row; a difference raises
    answers = align_predictions(rows_of_runs(gold, runs, cfg).select(*KEYS).distinct(), parsed, list(KEYS), strict=True)
    # idx = 0-based position in the evaluated rows, ordered by key.
    positions = row_index(gold.select("index").withColumn("_all", F.lit(1)), ("_all",), "index", out="idx").drop("_all")
    # each row's answers, one a run; a sentence moves once for all runs, and its prompts are made again where it is
    aligned = gold.repartition(parts, "index").join(positions.repartition(parts, "index"), "index", "inner")
    aligned = with_prompts(aligned.join(answers.repartition(parts, "index"), "index", "inner"), cfg)
    rows = aligned.select(
        *[c for c in CONFIG_COLUMNS if c != "model"], "run", "idx", "sentence",
        # a failed row has sent nothing: the JSON text of an empty prompt
        F.when(F.col("unsent"), F.lit('""')).otherwise(F.col("prompt_json")).alias("prompt"),
        F.col("label").alias("ground_truth"), "prediction", F.col("output").alias("llm_output"),
        F.col("reasoning").alias("llm_reasoning"))
    write_predictions(rows, f"{out_dir}/predictions", ("config_id",))
    preds = spark.read.parquet(f"{out_dir}/predictions").where(this)
    keys = [*CONFIG_COLUMNS, "run"]
    metrics = M.evaluate(preds.select(*keys, "ground_truth", "prediction"), keys, "ground_truth", "prediction")
    write_metrics(metrics, f"{out_dir}/metrics")
    return spark.read.parquet(f"{out_dir}/metrics").where(this).select(*metrics.columns)
