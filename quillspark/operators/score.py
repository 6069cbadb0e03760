"""Scoring rows with a user-supplied model.

``mapInPandas`` hands each task
Arrow batches; the scorer is built once per task; rows of a batch are sent
through a small thread pool (I/O-bound calls), so concurrency is
partitions x pool size. Each row is retried on rate limits only, with
exponential waits; any other failure, or running out of tries, gives the
fallback row (prediction -1, empty output and prompt) plus the error text.

Results are keyed by (run, index): a re-executed task recomputes the same
rows, and a restart can skip finished keys with a left-anti join against
the rows already written (``pending_rows``).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.constants import MAX_TRIES


class RateLimited(Exception):
    """Raised by scorers when the service answers 429."""

    status_code = 429


def is_rate_limit_error(e: BaseException) -> bool:
    """429 status or an exception class named like a rate-limit error."""
    return getattr(e, "status_code", None) == 429 or type(e).__name__ == "RateLimitError"


@dataclass(frozen=True)
class RetryPolicy:
    max_tries: int = MAX_TRIES
    base_delay: float = 1.0
    factor: float = 2.0

    def delay(self, attempt: int) -> float:
        """Wait after failed attempt ``attempt`` (1-based): 1, 2, 4, 8 s by default, no jitter."""
        return self.base_delay * self.factor ** (attempt - 1)


@dataclass
class Scored:
    output: str
    prompt: str
    reasoning: str | None
    attempts: int
    error: str | None


def call_with_retry(fn: Callable[[dict], object], row: dict, policy: RetryPolicy,
                    sleep: Callable[[float], None] = time.sleep) -> Scored:
    """C8 + C9 for one row."""
    attempt = 0
    while True:
        attempt += 1
        try:
            res = fn(row)
            if isinstance(res, tuple):
                output, reasoning = res
            else:
                output, reasoning = res, None
            if output is None:
                raise ValueError("No output")
            return Scored(str(output), str(row.get("prompt") or ""), reasoning, attempt, None)
        except Exception as e:  # noqa: BLE001 - the fallback row keeps the error text
            if is_rate_limit_error(e) and attempt < policy.max_tries:
                sleep(policy.delay(attempt))
                continue
            return Scored("", "", None, attempt, f"{type(e).__name__}: {e}")


SCORE_FIELDS = [
    T.StructField("output", T.StringType()),
    T.StructField("sent_prompt", T.StringType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("error", T.StringType()),
]


def score_rows(df: DataFrame, make_scorer: Callable[[], Callable[[dict], object]], *,
               keep: Sequence[str], prompt_col: str = "prompt", concurrency: int = 8,
               policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """One scored row per input row, input order kept within each batch.

    ``make_scorer()`` runs once per task and returns ``fn(row: dict) -> str``
    (or ``(output, reasoning)``); ``row`` holds the ``keep`` columns and
    ``prompt``.
    """
    from quillspark.session import ship_package

    ship_package(df.sparkSession)
    keep = list(keep)
    cols = keep + ([prompt_col] if prompt_col not in keep else [])
    src = df.select(*cols)
    schema = T.StructType([src.schema[c] for c in keep] + SCORE_FIELDS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make_scorer()
        with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
            for pdf in batches:
                records = pdf.rename(columns={prompt_col: "prompt"}).to_dict("records")
                results = list(pool.map(lambda r: call_with_retry(fn, r, policy), records))
                out = pdf[keep].copy()
                out["output"] = [r.output for r in results]
                out["sent_prompt"] = [r.prompt for r in results]
                out["reasoning"] = [r.reasoning for r in results]
                out["attempts"] = pd.array([r.attempts for r in results], dtype="int32")
                out["error"] = [r.error for r in results]
                yield out

    return src.mapInPandas(run, schema)


def predict_logits(df: DataFrame, make_model: Callable[[], Callable], inputs: Sequence[str], batch_rows: int = 1024, out: str = "logits") -> DataFrame:
    """``df`` with ``out``, the array of logits that a batch model gives for each row.

    ``make_model()`` runs once per Python worker and returns a function of one numpy array of doubles for each column in ``inputs``,
    with up to ``batch_rows`` rows, to an array of (rows, classes). The model is called once a
    batch, never once a row. Map-only; other columns pass through. A null in an input column is a NaN for the model.
    """
    from pyspark.ml.functions import predict_batch_udf
    from quillspark.session import ship_package

    ship_package(df.sparkSession)
    udf = predict_batch_udf(make_model, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_rows)
    return df.withColumn(out, udf(*[F.col(c).cast("double") for c in inputs]))


def pending_rows(todo: DataFrame, done: DataFrame, keys: Sequence[str] = ("config_id", "run", "index")) -> DataFrame:
    """Rows not scored yet (restart without re-scoring)."""
    return todo.join(done.select(*keys), list(keys), "left_anti")
