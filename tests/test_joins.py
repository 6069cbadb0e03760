"""Dictionary joins: the salted path (above the broadcast bound) equals the broadcast path."""

from pyspark.sql import functions as F

from quillspark.operators.joins import dictionary_join
from quillspark.operators.tokens import lemmatize_and_filter


def test_salted_equals_broadcast(spark):
    # one hot word holding a third of the rows
    big = spark.range(0, 3000).select(
        F.col("id").alias("index"),
        F.when(F.col("id") % 3 == 0, F.lit("the")).otherwise(F.concat(F.lit("w"), (F.col("id") % 50).cast("string"))).alias("tok"))
    small = spark.createDataFrame([("the", "THE"), ("w1", "one"), ("w7", "seven")], "tok string, lemma string")
    for how in ("inner", "left", "left_anti", "left_semi"):
        a = dictionary_join(big, small, "tok", how)
        b = dictionary_join(big, small, "tok", how, max_broadcast_rows=0, salt_buckets=8,
                            salt_from=F.xxhash64("index"))
        assert sorted(a.collect()) == sorted(b.select(*a.columns).collect()), how


def test_regroup_with_salted_dictionary(spark):
    df = spark.createDataFrame([(1, ["aaaa", "bbbb", "cccc"]), (2, ["cccc"]), (3, [])], "index long, toks array<string>")
    lem = spark.createDataFrame([("aaaa", "Alfa")], "surface string, lemma string")
    stop = spark.createDataFrame([("bbbb",)], "word string")
    want = {r["index"]: r.tokens for r in lemmatize_and_filter(df, "index", "toks", lemmas=lem, stopwords=stop).collect()}
    got = {r["index"]: r.tokens for r in lemmatize_and_filter(df, "index", "toks", lemmas=lem, stopwords=stop,
                                                              max_broadcast_rows=0).collect()}
    assert got == want == {1: ["alfa", "cccc"], 2: ["cccc"], 3: []}


def test_lookup_and_join_strategies_agree(spark):
    from quillspark.operators.tokens import load_stopwords, prepare_lemmas
    from quillspark.plans.preprocess import normalize
    from quillspark.functions import text as T
    from quillspark.sources.fixtures import labelled_sentences, lemmas_df, stopwords_df
    from tests.conftest import SMOKE

    t = normalize(labelled_sentences(spark, SMOKE)).withColumn("t", T.drop_short_tokens(T.tokenize("sentence")))
    kw = dict(lemmas=prepare_lemmas(lemmas_df(spark), "ro"), stopwords=load_stopwords(stopwords_df(spark), "ro"),
              carry=["split"])
    a = lemmatize_and_filter(t, "index", "t", strategy="lookup", **kw).collect()
    b = lemmatize_and_filter(t, "index", "t", strategy="join", **kw).select("index", "split", "tokens").collect()
    assert len(a) > 100 and sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_auto_strategies_switch_on_size(spark):
    from quillspark.operators.entities import detect_entities
    from quillspark.sources.fixtures import gazetteer_df, labelled_sentences
    from tests.conftest import SMOKE

    import contextlib
    import io

    def plan(df):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        return buf.getvalue()

    df = spark.createDataFrame([(1, ["aaaa", "bbbb"]), (2, ["cccc"])], "index long, toks array<string>")
    lem = spark.createDataFrame([("aaaa", "Alfa"), ("cccc", "Ce")], "surface string, lemma string")
    small = lemmatize_and_filter(df, "index", "toks", lemmas=lem)
    big = lemmatize_and_filter(df, "index", "toks", lemmas=lem, max_lookup_entries=1)
    assert "ArrowEvalPython" in plan(small) and "ArrowEvalPython" not in plan(big)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, big.collect()))

    text = labelled_sentences(spark, SMOKE).select("index", "sentence")
    inline = detect_entities(text, gazetteer_df(spark))
    joined = detect_entities(text, gazetteer_df(spark), inline_max=1, trie_max=0)
    assert "Window" not in plan(inline) and "Window" in plan(joined)
    assert sorted(map(tuple, inline.collect())) == sorted(map(tuple, joined.collect()))
