"""Writing the fine-tuning set (lifecycle D).

Labelled sentences -> split filter (P1) -> seeded sample of the training rows (P8) -> class text (P7, P9) -> chat messages or
prompt / completion (B10, B11) -> answer check (P10) -> JSON lines and Parquet, partitioned by split. One pass per split; the
check is an aggregate over the written rows' source, and a mismatch stops the job before anything is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import prompts as B
from quillspark.operators import select as P
from quillspark.operators.positions import sample_exact_n

FORMS = ("chat", "completion")
SPLITS = ("train", "validation")
CHAT_SCHEMA = T.StructType([T.StructField("messages", T.ArrayType(T.StructType([
    T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])))])
COMPLETION_SCHEMA = T.StructType([T.StructField("prompt", T.StringType()), T.StructField("completion", T.StringType())])


def finetune_rows(sentences: DataFrame, form: str = "chat", n_train: int = 0, seed: int = 42, label_col: str = "label",
                  merge_system_into_user: bool = False) -> DataFrame:
    """(split, index, labels, messages | prompt, completion) of the train and validation rows.

    ``n_train`` rows of the training split are sampled by a seeded hash (0: all); a row whose label is no class fails the job.
    """
    if form not in FORMS:
        raise ValueError(f"unknown form {form!r}")
    t = sentences.select("split", "index", "sentence", F.col(label_col).alias("label"))
    train = sample_exact_n(P.filter_split(t, SPLITS[0]), n_train, seed)
    rows = train.unionByName(P.filter_split(t, SPLITS[1]))
    rows = P.assert_label_text(P.label_to_class_text(rows, "label"))
    if form == "chat":
        return rows.select("split", "index", "labels", B.training_example_chat(
            "sentence", F.col("labels"), merge_system_into_user).alias("messages"))
    prompt, completion = B.training_example_completion("sentence", F.col("labels"))
    return rows.select("split", "index", "labels", prompt.alias("prompt"), completion.alias("completion"))


def answer_of(rows: DataFrame) -> Column:
    """The rendered answer of a row, in either form."""
    return F.element_at("messages", -1)["content"] if "messages" in rows.columns else F.col("completion")


def write_finetune_set(rows: DataFrame, path: str) -> None:
    """Checks every rendered answer (P10), then writes ``path/jsonl`` and ``path/parquet``, partitioned by split.

    JSON lines hold what a trainer reads (``messages`` or ``prompt`` and ``completion``); Parquet also keeps the row key.
    """
    P.raise_on_mismatch(P.check_training_examples(rows, B.answer_text(F.col("labels")), answer_of(rows)))
    rows.drop("labels").write.mode("overwrite").partitionBy("split").parquet(f"{path}/parquet")
    # the lines come from the Parquet copy: the texts are rendered once
    back = rows.sparkSession.read.parquet(f"{path}/parquet")
    back.drop("index").write.mode("overwrite").partitionBy("split").json(f"{path}/jsonl")


def read_finetune_lines(spark, path: str, form: str) -> DataFrame:
    schema = CHAT_SCHEMA if form == "chat" else COMPLETION_SCHEMA
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("split", T.StringType())])).json(f"{path}/jsonl")
