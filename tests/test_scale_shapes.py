"""What must not grow with the input: files, tasks, and what is moved."""

import contextlib
import io
import os

from pyspark.sql import functions as F

from quillspark.operators import baseline as ML
from quillspark.operators import entities as EN
from quillspark.plans import bulk_eval as B
from quillspark.sinks import numbered_lines
from quillspark.sources import io as IO
from quillspark.sources import tables


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_lines_are_numbered_without_sorting_them(spark, tmp_path):
    """F2."""
    rows = [("a", i) for i in range(500)] + [("b", i) for i in range(300)]
    df = spark.createDataFrame(rows, "kind string, v int").repartitionByRange(7, "kind", "v").sortWithinPartitions("kind", "v")
    df.select("kind", F.col("v").cast("string")).write.partitionBy("kind").text(str(tmp_path / "t"))
    out = numbered_lines(spark, str(tmp_path / "t"), ["kind"])
    assert sorted((r.kind, int(r.value)) for r in out.collect()) == rows
    assert all(int(r.value) == r.line for r in out.collect())
    assert "monotonically" not in plan(out) and "value" not in "".join(x for x in plan(out).splitlines() if "Window [" in x)


def test_csv_files_and_tasks_are_bounded(spark, tmp_path, monkeypatch):
    """F10, F12, F7."""
    monkeypatch.setattr(IO, "CSV_FILE_ROWS", 50)
    df = spark.range(200).select(F.col("id").alias("index"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in IO.SENTENCE_SCHEMA.fields[1:]])
    IO.write_sentences_csv(df.coalesce(1), str(tmp_path / "c"))
    assert sum(f.endswith(".csv") for f in os.listdir(tmp_path / "c")) == 4
    assert IO.read_sentences_csv(spark, str(tmp_path / "c")).count() == 200
    slots = spark.sparkContext.defaultParallelism
    df.write.parquet(str(tmp_path / "p"))
    read = spark.read.parquet(str(tmp_path / "p"))
    size = int(str(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    monkeypatch.setattr(tables, "SPREAD_BYTES", size // (5 * slots))
    assert tables.spread_input(read, "index").rdd.getNumPartitions() >= 5 * slots


def test_prompts_are_made_where_the_rows_are_scored(spark, tmp_path):
    """F4."""
    cfg = B.RunConfig(model="m:1")
    gold = spark.createDataFrame([(i, f"text {i}", i % 2) for i in range(40)], "index long, sentence string, label int")
    seen = []

    def prompts(t):
        seen.append(t.columns)
        return B.with_prompts(t, cfg)

    B.score_pending(spark, B.rows_of_runs(gold, [1, 2], cfg), lambda: lambda row: row["prompt"], str(tmp_path / "raw"), partitions=3, prompts=prompts)
    assert "prompt" not in seen[0]
    want = {(r.run, r["index"]): r.prompt for r in B.prompts_for_runs(gold, [1, 2], cfg).collect()}
    assert {(r.run, r["index"]): r.output for r in B.read_raw(spark, str(tmp_path / "raw")).collect()} == want


def test_ngrams_do_not_move(spark):
    """Of the n-grams only those that are surfaces are shuffled."""
    df = spark.createDataFrame([(b"a", "Ana Pop, Ana are mere"), (b"a", "Ana Pop, Ana are mere"), (b"b", "nimic")], "id binary, t string")
    gaz = spark.createDataFrame([("Ana", "PERSON"), ("Ana Pop", "ORG")], "surface string, label string")
    assert "Exchange" not in plan(EN.gazetteer_ngrams(df, "id", "t", 2))
    hits = EN.gazetteer_hits(df, gaz, "id", "t").collect()
    assert [(bytes(r.id), sorted((h.i, h.surface, h.label) for h in r._hits)) for r in hits] == [(b"a", [(0, "Ana Pop", "ORG"), (2, "Ana", "PERSON")])]


def test_spans_are_placed_in_parts(spark, monkeypatch):
    """F9."""
    texts = [(i, None if i % 7 == 0 else "" if i % 7 == 1 else "nimic aici" if i % 7 == 2 else f"ăâ {i} Ana Pop și Ana") for i in range(60)]
    df = spark.createDataFrame(texts, "index long, sentence string").coalesce(1)
    gaz = spark.createDataFrame([("Ana", "PERSON"), ("Ana Pop", "ORG")], "surface string, label string")
    monkeypatch.setattr(EN, "PLACE_ROWS", 5)
    got = {r["index"]: [(e.start, e.end, e.label) for e in r.entities] for r in EN.with_entities(df, gaz).collect()}
    for i, t in texts:
        at = t.index("Ana") if t and "Ana" in t else None
        assert got[i] == ([] if at is None else [(at, at + 7, "ORG"), (at + 11, at + 14, "PERSON")])


def test_shared_features_hold_nothing(spark):
    """rows are featured once and nothing is kept in memory between fits."""
    df = spark.createDataFrame([(i, f"cuvânt {'da' if i % 2 else 'nu'} {i}", i % 2) for i in range(40)], "index long, sentence string, label int")
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    shared = ML.SharedFeatures(df, carry=("index",))
    model = shared.fit(weight=ML.bootstrap_weight(1))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
    rows = shared.featured(df)
    assert "sentence" not in rows.columns
    a = sorted(r.logits_text for r in ML.predict(model, df).collect())
    assert a == sorted(r.logits_text for r in ML.predict_featured(model, rows).collect())
