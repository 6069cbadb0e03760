"""Registered queries: prompts and training examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.constants import (
    CLASS_0, CLASS_1, SYSTEM_PROMPT_CHAT, SYSTEM_PROMPT_SIMPLE, USER_PROMPT_CHAT, USER_PROMPT_COMPLETION,
)
from quillspark.functions import prompts as B
from quillspark.operators.select import filter_split, label_to_class_text
from quillspark.plans import oracle as O
from quillspark.plans.registry import register
from quillspark.sources.tables import read_table
from quillspark.sources.fixtures import labelled_sentences

S = O.with_sentences
RUN = 1

# Run configurations exercised by the prompt-variant query.
RUN_CONFIGS = [
    ("completion", True, False, False, "gpt2-large"),
    ("fine_tuned", False, True, False, "llama3.1-ft:latest"),
    ("chat", False, False, False, "llama3.1:latest"),
    ("merged", False, False, True, "gemma3:4b"),
    ("reasoning", False, False, False, "o4-mini"),
]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sys_sql(template: str, c0: str = "c0", c1: str = "c1") -> str:
    return f"replace(replace({q(template)}, '{{class0}}', {c0}), '{{class1}}', {c1})"


def user_sql(template: str, sentence: str = "sentence") -> str:
    pre, post = template.split("{sentence}")
    return f"{q(pre)} || {sentence} || {q(post)}"


ORDER_CTE = f"""
, ord AS (SELECT s.*, substr(md5(concat('order:', '{RUN}', ':', CAST("index" AS VARCHAR))),1,1) >= '8' AS swapped
          FROM sentl s WHERE split = 'test')
, cls AS (SELECT *, CASE WHEN swapped THEN '{CLASS_1}' ELSE '{CLASS_0}' END AS c0,
                    CASE WHEN swapped THEN '{CLASS_0}' ELSE '{CLASS_1}' END AS c1 FROM ord)
"""


def _test(spark, sf_dir):
    t = filter_split(labelled_sentences(spark, sf_dir), "test").select("index", "sentence")
    c0, c1 = B.shuffled_classes(RUN, "index")
    return t.withColumn("c0", c0).withColumn("c1", c1)


@register("randomize_class_order", S() + """
, r AS (SELECT CAST(run AS INTEGER) AS run FROM range(1, 6) t(run))
, o AS (SELECT r.run, s."index", substr(md5(concat('order:', CAST(r.run AS VARCHAR), ':', CAST(s."index" AS VARCHAR))),1,1) >= '8' AS sw
        FROM sentl s, r WHERE s.split = 'test')
SELECT run, "index", CASE WHEN sw THEN 'satiră' ELSE 'factual' END AS class0,
                     CASE WHEN sw THEN 'factual' ELSE 'satiră' END AS class1 FROM o""")
def q_randomize(spark, sf_dir):
    t = filter_split(labelled_sentences(spark, sf_dir), "test").select("index")
    t = t.select(F.explode(F.array(*[F.lit(r) for r in range(1, 6)])).alias("run"), "index")
    c0, c1 = B.shuffled_classes(F.col("run"), "index")
    return t.select("run", "index", c0.alias("class0"), c1.alias("class1"))


@register("render_system_prompt", S(ORDER_CTE) + f'SELECT "index", {sys_sql(SYSTEM_PROMPT_CHAT)} AS system FROM cls')
def q_system(spark, sf_dir):
    t = _test(spark, sf_dir)
    return t.select("index", B.render_system_prompt(SYSTEM_PROMPT_CHAT, F.col("c0"), F.col("c1")).alias("system"))


@register("render_user_prompt", S() + f"""SELECT "index", {user_sql(USER_PROMPT_CHAT)} AS user_prompt,
  {user_sql(USER_PROMPT_COMPLETION)} AS completion_prompt FROM sentl WHERE split = 'test'""")
def q_user(spark, sf_dir):
    t = _test(spark, sf_dir)
    return t.select("index", B.render_user_prompt("sentence", USER_PROMPT_CHAT).alias("user_prompt"),
                    B.render_user_prompt("sentence", USER_PROMPT_COMPLETION).alias("completion_prompt"))


@register("prompt_completion", S(ORDER_CTE) + f"""
SELECT "index", {sys_sql(SYSTEM_PROMPT_SIMPLE)} || chr(10) || {user_sql(USER_PROMPT_COMPLETION)} || chr(10) AS prompt FROM cls""")
def q_prompt_completion(spark, sf_dir):
    t = _test(spark, sf_dir)
    p = B.prompt_completion(B.render_system_prompt(SYSTEM_PROMPT_SIMPLE, F.col("c0"), F.col("c1")),
                            B.render_user_prompt("sentence", USER_PROMPT_COMPLETION))
    return t.select("index", p.alias("prompt"))


@register("prompt_chat", S(ORDER_CTE) + f"""
SELECT "index", to_json([{{'role': 'system', 'content': {sys_sql(SYSTEM_PROMPT_CHAT)}}},
                         {{'role': 'user', 'content': {user_sql(USER_PROMPT_CHAT)}}}]) AS messages FROM cls""")
def q_prompt_chat(spark, sf_dir):
    t = _test(spark, sf_dir)
    m = B.prompt_chat(B.render_system_prompt(SYSTEM_PROMPT_CHAT, F.col("c0"), F.col("c1")),
                      B.render_user_prompt("sentence", USER_PROMPT_CHAT))
    return t.select("index", B.prompt_to_json(m).alias("messages"))


@register("prompt_merged", S(ORDER_CTE) + f"""
SELECT "index", to_json([{{'role': 'user', 'content': {sys_sql(SYSTEM_PROMPT_CHAT)} || chr(10) || {user_sql(USER_PROMPT_CHAT)}}}]) AS messages
FROM cls""")
def q_prompt_merged(spark, sf_dir):
    t = _test(spark, sf_dir)
    m = B.prompt_merged(B.render_system_prompt(SYSTEM_PROMPT_CHAT, F.col("c0"), F.col("c1")),
                        B.render_user_prompt("sentence", USER_PROMPT_CHAT))
    return t.select("index", B.prompt_to_json(m).alias("messages"))


@register("prompt_reasoning", S(ORDER_CTE) + f"""
SELECT "index", {sys_sql(SYSTEM_PROMPT_CHAT)} AS instructions,
  to_json([{{'role': 'user', 'content': chr(10) || {user_sql(USER_PROMPT_CHAT)}}}]) AS messages FROM cls""")
def q_prompt_reasoning(spark, sf_dir):
    t = _test(spark, sf_dir)
    return t.select("index", B.render_system_prompt(SYSTEM_PROMPT_CHAT, F.col("c0"), F.col("c1")).alias("instructions"),
                    B.prompt_to_json(B.prompt_reasoning(B.render_user_prompt("sentence", USER_PROMPT_CHAT))).alias("messages"))


def _variant_sql() -> str:
    rows = []
    for name, comp, ft, merge, model in RUN_CONFIGS:
        system = sys_sql(SYSTEM_PROMPT_SIMPLE if ft else SYSTEM_PROMPT_CHAT)
        user = user_sql(USER_PROMPT_CHAT)
        if comp:
            kind = "completion"
            prompt = f"to_json({sys_sql(SYSTEM_PROMPT_SIMPLE)} || chr(10) || {user_sql(USER_PROMPT_COMPLETION)} || chr(10))"
            instr = "CAST(NULL AS VARCHAR)"
        elif any(r in model.lower() for r in ("o3", "o1", "o4-mini")):
            kind = "reasoning"
            prompt = f"to_json([{{'role': 'user', 'content': chr(10) || {user}}}])"
            instr = system
        elif merge:
            kind = "chat"
            prompt = f"to_json([{{'role': 'user', 'content': {system} || chr(10) || {user}}}])"
            instr = "CAST(NULL AS VARCHAR)"
        else:
            kind = "chat"
            prompt = f"to_json([{{'role': 'system', 'content': {system}}}, {{'role': 'user', 'content': {user}}}])"
            instr = "CAST(NULL AS VARCHAR)"
        rows.append(f"SELECT '{name}' AS config, \"index\", '{kind}' AS kind, {prompt} AS prompt, {instr} AS instructions FROM cls")
    return S(ORDER_CTE) + "\nUNION ALL\n".join(rows)


@register("prompt_variant", _variant_sql())
def q_prompt_variant(spark, sf_dir):
    """The prompt each run configuration sends, for every test row."""
    t = _test(spark, sf_dir).withColumn("config", F.explode(F.array(*[F.lit(c[0]) for c in RUN_CONFIGS])))
    chosen = {"kind": None, "prompt": None, "instructions": None}
    for name, comp, ft, merge, model in RUN_CONFIGS:
        p = B.prompt_for_run("sentence", F.col("c0"), F.col("c1"), use_completion=comp, from_ft_model=ft,
                             merge_system_into_user=merge, model=model)
        p["prompt"] = B.json_string(p["prompt_text"]) if comp else B.prompt_to_json(p["messages"])
        for k, had in chosen.items():
            chosen[k] = F.when(F.col("config") == name, p[k]) if had is None else had.when(F.col("config") == name, p[k])
    return t.select("config", "index", *[v.alias(k) for k, v in chosen.items()])


# Model names taken from the documents: their source under one of five families.
_MODEL_SQL = """CASE doc_id % 5 WHEN 0 THEN 'o3-' WHEN 1 THEN 'gpt-4o-' WHEN 2 THEN 'Lab/O4-mini-' WHEN 3 THEN 'llama3.' ELSE 'x-o1:' END || source"""


def _model_names(spark, sf_dir):
    family = F.element_at(F.array(*[F.lit(x) for x in ("o3-", "gpt-4o-", "Lab/O4-mini-", "llama3.", "x-o1:")]),
                          (F.col("doc_id") % 5 + 1).cast("int"))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.concat(family, F.col("source")).alias("model"))


@register("is_reasoning_model", f"""
SELECT doc_id, {_MODEL_SQL} AS model, regexp_matches(lower({_MODEL_SQL}), 'o3|o1|o4-mini') AS reasoning FROM documents""")
def q_is_reasoning(spark, sf_dir):
    """B8 for a model name per row."""
    return _model_names(spark, sf_dir).withColumn("reasoning", B.is_reasoning_model("model"))


_TRAIN = S() + f"""
, tr AS (SELECT *, CASE label WHEN 0 THEN '{CLASS_0}' WHEN 1 THEN '{CLASS_1}' END AS labels
         FROM sentl WHERE split = 'train')
"""


def _train(spark, sf_dir):
    return label_to_class_text(filter_split(labelled_sentences(spark, sf_dir), "train"), "label")


@register("training_example_chat", _TRAIN + f"""
SELECT "index", to_json([{{'role': 'system', 'content': {q(SYSTEM_PROMPT_SIMPLE.format(class0=CLASS_0, class1=CLASS_1))}}},
                         {{'role': 'user', 'content': {user_sql(USER_PROMPT_CHAT)}}},
                         {{'role': 'assistant', 'content': 'RĂSPUNS: ' || labels}}]) AS messages FROM tr""")
def q_train_chat(spark, sf_dir):
    t = _train(spark, sf_dir)
    return t.select("index", B.prompt_to_json(B.training_example_chat("sentence", F.col("labels"))).alias("messages"))


@register("training_example_completion", _TRAIN + f"""
SELECT "index", {q(SYSTEM_PROMPT_SIMPLE.format(class0=CLASS_0, class1=CLASS_1))} || chr(10) || {user_sql(USER_PROMPT_CHAT)} || chr(10) AS prompt,
       'RĂSPUNS: ' || labels AS completion FROM tr""")
def q_train_completion(spark, sf_dir):
    t = _train(spark, sf_dir)
    p, c = B.training_example_completion("sentence", F.col("labels"))
    return t.select("index", p.alias("prompt"), c.alias("completion"))


@register("prompt_to_json", S(ORDER_CTE) + f"""
SELECT "index", to_json([{{'role': 'system', 'content': {sys_sql(SYSTEM_PROMPT_CHAT)}}},
                         {{'role': 'user', 'content': {user_sql(USER_PROMPT_CHAT)}}}]) AS prompt,
  to_json({sys_sql(SYSTEM_PROMPT_SIMPLE)} || chr(10) || {user_sql(USER_PROMPT_COMPLETION)} || chr(10)) AS prompt_text FROM cls""")
def q_prompt_json(spark, sf_dir):
    t = _test(spark, sf_dir)
    chat = B.prompt_chat(B.render_system_prompt(SYSTEM_PROMPT_CHAT, F.col("c0"), F.col("c1")),
                         B.render_user_prompt("sentence", USER_PROMPT_CHAT))
    text = B.prompt_completion(B.render_system_prompt(SYSTEM_PROMPT_SIMPLE, F.col("c0"), F.col("c1")),
                               B.render_user_prompt("sentence", USER_PROMPT_COMPLETION))
    return t.select("index", B.prompt_to_json(chat).alias("prompt"), B.json_string(text).alias("prompt_text"))


FINETUNE_N, FINETUNE_SEED = 500, 42
_FT_SQL = S() + f"""
, pick AS (SELECT "index" FROM sentl WHERE split = 'train' ORDER BY md5(concat('{FINETUNE_SEED}:', CAST("index" AS VARCHAR))), "index" LIMIT {FINETUNE_N})
, tr AS (SELECT *, CASE label WHEN 0 THEN '{CLASS_0}' WHEN 1 THEN '{CLASS_1}' END AS labels FROM sentl
         WHERE split = 'validation' OR (split = 'train' AND "index" IN (SELECT "index" FROM pick)))
"""


def _finetune_round_trip(spark, sf_dir, form):
    """The set written as JSON lines and Parquet, the lines read back."""
    from quillspark.plans.finetune import finetune_rows, read_finetune_lines, write_finetune_set
    from quillspark.session import scratch_path

    path = scratch_path(spark, f"finetune-{form}")
    rows = finetune_rows(labelled_sentences(spark, sf_dir), form, FINETUNE_N, FINETUNE_SEED)
    write_finetune_set(rows, path)
    return read_finetune_lines(spark, path, form)


@register("finetune_set_chat", _FT_SQL + f"""
SELECT split, to_json([{{'role': 'system', 'content': {q(SYSTEM_PROMPT_SIMPLE.format(class0=CLASS_0, class1=CLASS_1))}}},
                       {{'role': 'user', 'content': {user_sql(USER_PROMPT_CHAT)}}},
                       {{'role': 'assistant', 'content': 'RĂSPUNS: ' || labels}}]) AS messages FROM tr""")
def q_finetune_chat(spark, sf_dir):
    """Lifecycle D in chat form: filter, sample, label text, render, check, write, read back."""
    return _finetune_round_trip(spark, sf_dir, "chat").select("split", B.prompt_to_json(F.col("messages")).alias("messages"))


@register("finetune_set_completion", _FT_SQL + f"""
SELECT split, {q(SYSTEM_PROMPT_SIMPLE.format(class0=CLASS_0, class1=CLASS_1))} || chr(10) || {user_sql(USER_PROMPT_CHAT)} || chr(10) AS prompt,
       'RĂSPUNS: ' || labels AS completion FROM tr""")
def q_finetune_completion(spark, sf_dir):
    """Lifecycle D in completion form."""
    return _finetune_round_trip(spark, sf_dir, "completion").select("split", "prompt", "completion")
