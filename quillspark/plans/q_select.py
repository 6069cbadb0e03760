"""Registered queries: selection, projection, checks and row positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.constants import CLASS_0, CLASS_1
from quillspark.functions.prompts import answer_text, training_example_chat, training_example_completion
from quillspark.operators import select as P
from quillspark.operators.positions import row_index, sample_exact_n
from quillspark.plans import oracle as O
from quillspark.plans.registry import register
from quillspark.sources.fixtures import labelled_sentences

S = O.with_sentences
ALL = 'SELECT "index", news_id, sentence, domain, label_0, label_1, label_2, label, split FROM sentl'
SAMPLE_N = 1000
SAMPLE_SEED = 42


def _sent(spark, sf_dir):
    return labelled_sentences(spark, sf_dir)


@register("scan_sentences_parquet", S() + ALL)
def q_scan_parquet(spark, sf_dir):
    """The sentence table written as parquet (partitioned by split) and read back."""
    from quillspark.sources.io import read_sentences_parquet, write_sentences_parquet
    from quillspark.session import scratch_path
    path = scratch_path(spark, "sentences-parquet")
    write_sentences_parquet(_sent(spark, sf_dir), path)
    return read_sentences_parquet(spark, path).select(
        "index", "news_id", "sentence", "domain", "label_0", "label_1", "label_2", "label", "split")


@register("filter_split", S() + ALL + " WHERE split = 'test'")
def q_filter_split(spark, sf_dir):
    return P.filter_split(_sent(spark, sf_dir), "test")


@register("split_three_way", S() + """
SELECT split, row_number() OVER (PARTITION BY split ORDER BY "index") - 1 AS idx, "index", sentence, label FROM sentl""")
def q_split_three_way(spark, sf_dir):
    return P.split_three_way(_sent(spark, sf_dir).select("split", "index", "sentence", "label")).select(
        "split", "idx", "index", "sentence", "label")


@register("row_index", S() + """
SELECT split, "index", row_number() OVER (PARTITION BY split ORDER BY "index") - 1 AS idx FROM sentl""")
def q_row_index(spark, sf_dir):
    return row_index(_sent(spark, sf_dir).select("split", "index"), ("split",), "index", out="idx")


@register("project_columns", S() + """SELECT "index", sentence, label FROM sentl WHERE split = 'test'""")
def q_project(spark, sf_dir):
    return P.project_columns(P.filter_split(_sent(spark, sf_dir)), ["index", "sentence", "label"])


def _preview_sql() -> str:
    from quillspark.plans.q_text import _ANON_SQL, _DICTS

    sep = "chr(10) || chr(10) || '====' || chr(10) || chr(10)"
    return (_ANON_SQL + _DICTS + O.process_ctes("an", "sentence", "pf") + f"""
, head AS (SELECT "index", sentence FROM sentl ORDER BY "index" LIMIT 10)
SELECT (SELECT string_agg(sentence, {sep} ORDER BY "index") FROM head) AS preview,
       (SELECT string_agg(pf.t, {sep} ORDER BY pf."index") FROM pf JOIN head USING ("index")) AS preview_after,
       (SELECT count(*) FROM head) AS n""")


@register("preview_head", _preview_sql())
def q_preview(spark, sf_dir):
    """The first 10 sentences, before and after preprocessing."""
    from quillspark.operators.tokens import load_stopwords, prepare_lemmas
    from quillspark.plans.preprocess import preprocess_full
    from quillspark.sources.fixtures import gazetteer_df, lemmas_df, stopwords_df

    sent = _sent(spark, sf_dir)
    # Processing is per row, so the first 10 rows are taken first, then processed.
    head = sent.orderBy("index").limit(10)
    after = preprocess_full(head, gazetteer=gazetteer_df(spark), stopwords=load_stopwords(stopwords_df(spark), "ro"),
                            lemmas=prepare_lemmas(lemmas_df(spark), "ro"))
    rows = head.select("index", "sentence").join(after.select("index", F.col("sentence").alias("after")), "index")
    return rows.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "sentence"))), lambda x: x["sentence"]),
                     P.PREVIEW_SEP).alias("preview"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "after"))), lambda x: x["after"]),
                     P.PREVIEW_SEP).alias("preview_after"),
        F.count(F.lit(1)).alias("n"),
    )


@register("split_size", S() + "SELECT count(*) AS n FROM sentl WHERE split = 'test'")
def q_split_size(spark, sf_dir):
    return P.split_size(_sent(spark, sf_dir), "test")


@register("choose_label_column", S() + 'SELECT "index", CAST(label_0 AS INTEGER) AS target FROM sentl')
def q_choose_label(spark, sf_dir):
    return P.choose_label_column(_sent(spark, sf_dir), "label_0").select("index", "target")


@register("label_to_class_text", S() + f"""
SELECT "index", label, CASE label WHEN 0 THEN '{CLASS_0}' WHEN 1 THEN '{CLASS_1}' END AS labels
FROM sentl WHERE split IN ('train', 'validation')""")
def q_label_text(spark, sf_dir):
    t = _sent(spark, sf_dir).where(F.col("split").isin("train", "validation"))
    return P.label_to_class_text(t, "label").select("index", "label", "labels")


@register("sample_exact_n", S() + f"""
SELECT "index", sentence, label FROM sentl WHERE split = 'train'
ORDER BY md5(concat('{SAMPLE_SEED}:', CAST("index" AS VARCHAR))), "index" LIMIT {SAMPLE_N}""")
def q_sample(spark, sf_dir):
    train = P.filter_split(_sent(spark, sf_dir), "train").select("index", "sentence", "label")
    return sample_exact_n(train, SAMPLE_N, SAMPLE_SEED)


@register("assert_label_text", S() + f"""
SELECT split, count(*) FILTER (WHERE label_0 + label_1 < 2) AS n_valid,
       count(*) FILTER (WHERE label_0 + label_1 >= 2) AS n_quarantined
FROM sentl GROUP BY split""")
def q_assert_label(spark, sf_dir):
    """Label text from label_0 + label_1 (2 is outside the classes): valid vs quarantined rows."""
    t = _sent(spark, sf_dir).withColumn("pair", F.col("label_0") + F.col("label_1"))
    t = P.label_to_class_text(t, "pair")
    ok, bad = P.quarantine_label_text(t)
    ok_n = ok.groupBy("split").agg(F.count(F.lit(1)).alias("n_valid"))
    bad_n = bad.groupBy("split").agg(F.count(F.lit(1)).alias("n_quarantined"))
    return (ok_n.join(bad_n, "split", "full_outer")
            .select("split", F.coalesce("n_valid", F.lit(0)).alias("n_valid"),
                    F.coalesce("n_quarantined", F.lit(0)).alias("n_quarantined")))


@register("check_training_examples", S() + """
SELECT form, split, count(*) AS n_checked, count(*) FILTER (WHERE "index" % 7 = 0 AND label_0 <> label) AS n_mismatch
FROM sentl, (SELECT unnest(['chat', 'completion']) AS form) WHERE split IN ('train', 'validation') GROUP BY form, split""")
def q_check_examples(spark, sf_dir):
    """P10 in both forms, on train and validation; every seventh row is rendered from another annotator's label."""
    t = _sent(spark, sf_dir).where(F.col("split").isin("train", "validation"))
    t = P.assert_label_text(P.label_to_class_text(t, "label"))
    wrong = P.label_to_class_text(t.withColumn("used", F.when(F.col("index") % 7 == 0, F.col("label_0")).otherwise(F.col("label"))),
                                  "used", out="used_labels")
    chat = F.element_at(training_example_chat("sentence", F.col("used_labels")), -1)["content"]
    _, completion = training_example_completion("sentence", F.col("used_labels"))
    forms = wrong.select("split", "labels", F.explode(F.create_map(F.lit("chat"), chat, F.lit("completion"), completion)).alias("form", "got"))
    return P.check_training_examples(forms, answer_text(F.col("labels")), F.col("got"), ("form", "split"))


@register("validate_schema", S() + """
SELECT count(*) AS n_rows,
  count(*) FILTER (WHERE "index" IS NULL) AS null_index,
  count(*) FILTER (WHERE sentence IS NULL) AS null_sentence,
  count(*) FILTER (WHERE domain IS NULL OR domain NOT IN ('life-death', 'it-stiinta', 'cronica-de-film')) AS bad_domain,
  count(*) FILTER (WHERE split IS NULL OR split NOT IN ('train', 'validation', 'test')) AS bad_split,
  count(*) FILTER (WHERE NOT coalesce(label_0 IN (0, 1) AND label_1 IN (0, 1) AND label_2 IN (0, 1) AND label IN (0, 1), false)) AS bad_label,
  count(*) - count(DISTINCT "index") AS dup_index,
  count(*) FILTER (WHERE label IS DISTINCT FROM (CASE WHEN label_0 + label_1 + label_2 >= 2 THEN 1 ELSE 0 END)) AS label_not_majority
FROM sentl""")
def q_validate(spark, sf_dir):
    return P.validate_schema(_sent(spark, sf_dir))
