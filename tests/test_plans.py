"""Plan shape: pruning, pushdown, no Python per row, no cartesian products, one keyed exchange."""

import contextlib
import io
import re

import __spark_entry__ as E
from quillspark.operators.select import filter_split
from quillspark.session import scratch_path
from quillspark.sources.fixtures import labelled_sentences
from quillspark.sources.io import read_sentences_parquet, write_sentences_parquet
from tests.conftest import SMOKE

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def plan(df):
    """The formatted physical plan, as ``explain`` prints it."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_no_bad_operators(spark):
    q = E.queries()
    for key in ["preprocess_full", "anonymize", "weighted_prf", "metrics_by_run", "training_example_chat",
                "sample_exact_n", "split_three_way", "lemmatize", "detect_entities"]:
        p = plan(q[key](spark, SMOKE))
        for bad in BAD:
            assert bad not in p, (key, bad)


def test_preprocess_full_is_map_only(spark):
    p = plan(E.queries()["preprocess_full"](spark, SMOKE))
    # Inlined gazetteer + broadcast dictionary lookup: the sentence rows are
    # never exchanged by key; the only Python is Arrow-batched.
    assert not re.search(r"hashpartitioning\(index#", p)
    assert "ArrowEvalPython" in p and "BatchEvalPython" not in p


def test_join_strategy_regroups_after_partial_aggregate(spark):
    from quillspark.functions import text as T
    from quillspark.operators.tokens import lemmatize_and_filter, load_stopwords, prepare_lemmas
    from quillspark.sources.fixtures import lemmas_df, stopwords_df

    t = labelled_sentences(spark, SMOKE).withColumn("t", T.tokenize("sentence"))
    out = lemmatize_and_filter(t, "index", "t", lemmas=prepare_lemmas(lemmas_df(spark), "ro"),
                               stopwords=load_stopwords(stopwords_df(spark), "ro"), strategy="join")
    p = plan(out)
    # distinct arrays, regrouped by their digest; the sentence key is never exchanged
    assert "partial_collect_list" in p and not re.search(r"hashpartitioning\(index#", p)


def test_split_filter_prunes_partitions_and_columns(spark):
    path = scratch_path(spark, "plan-parquet")
    write_sentences_parquet(labelled_sentences(spark, SMOKE), path)
    df = filter_split(read_sentences_parquet(spark, path), "test").select("index", "label")
    p = plan(df)
    assert re.search(r"PartitionFilters: \[isnotnull\(split#\d+\), \(split#\d+ = test\)\]", p)
    assert re.search(r"ReadSchema: struct<index:bigint,label:int>", p)


def test_documents_scan_reads_only_needed_columns(spark):
    p = plan(E.queries()["weighted_prf"](spark, SMOKE))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
    assert "n_chars" not in p and "lang" not in p.replace("language", "")
