"""Masking, normalisation and tokens (T1-T17) on edge cases."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.constants import BRANDS
from quillspark.functions import text as T
from quillspark.operators.entities import detect_entities
from quillspark.operators.tokens import lemmatize_and_filter, load_stopwords, prepare_lemmas
from quillspark.plans.preprocess import anonymize, process_text
from quillspark.sources.fixtures import gazetteer_df, lemmas_df, stopwords_df
from tests.conftest import one_col


def col(spark, values, fn):
    return [r[0] for r in one_col(spark, values).select(fn(F.col("s"))).collect()]


def test_brands_single_pass_equals_sequential(spark):
    texts = ["TNRDS", "RDTNR", "GoogleApple", "BitdefenderBitDefender", "YoutubeYouTube x", "Samsung<ORG>", "nimic"]

    def seq(t):
        for b in BRANDS:
            t = t.replace(b, "<ORG>")
        return t
    assert col(spark, texts, T.mask_brands) == [seq(t) for t in texts]


def test_site_patterns_dots_are_wildcards(spark):
    got = col(spark, ["Timesnewroman.ro", "TimesnewromanXro", "wwwXcautatoriidepovesti.ro"], T.mask_site_urls)
    assert got == ["@URL", "@URL", "@URL"]


def test_emails_also_remove_url_placeholder(spark):
    got = col(spark, ["a b@c.d e", "vezi @URL acum", "x@y"], T.strip_emails)
    assert got == ["a e", "vezi acum", ""]


WS = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", " ", " ", " ", "　"]


@settings(max_examples=40, deadline=None, derandomize=True)
@given(st.lists(st.lists(st.sampled_from(WS + list("ab@.") + ["​"]), max_size=15).map("".join),
                min_size=25, max_size=25))
def test_email_and_whitespace_match_python(spark, texts):
    def py(t):
        return re.sub(r"\s+", " ", re.sub(r"\S*@\S*\s?", "", t))
    got = col(spark, texts, lambda c: T.collapse_whitespace(T.strip_emails(c)))
    assert got == [py(t) for t in texts]


def test_diacritics_upper_cedilla_kept_by_default(spark):
    assert col(spark, ["ţara Ţara şi Şi"], lambda c: T.lowercase(T.fix_diacritics(c))) == ["țara ţara și şi"]
    assert col(spark, ["Ţara"], lambda c: T.lowercase(T.fix_diacritics(c, upper=True))) == ["țara"]


def test_tokens_short_dropped_brackets_kept(spark):
    got = col(spark, ["<person> la casa mare, dar-ul l'apa 123"],
              lambda c: T.join_tokens(T.drop_short_tokens(T.tokenize(c))))
    assert got == ["< person > casa mare dar-ul l'apa"]


def test_restore_gpe_vanishes_person_restored(spark):
    text = "<PERSON> merge la <GPE> cu <NORP>"
    got = col(spark, [text], lambda c: T.restore_placeholders(T.join_tokens(T.drop_short_tokens(T.tokenize(T.lowercase(c))))))
    assert got == ["<PERSON> merge  <NORP>"]
    tags = ["PERSON", "NORP", "GPE", "ORG", "LOC", "FAC"]
    kept = col(spark, [text + " gpe la"], lambda c: T.restore_placeholders(
        T.join_tokens(T.drop_short_tokens(T.tokenize(T.lowercase(c)), keep_tags=tags))))
    assert kept == ["<PERSON> merge <GPE> <NORP>"]  # a bare "gpe" word is still short and dropped


def test_process_text_keep_all_tags(spark):
    df = spark.createDataFrame([(1, "Ana merge la <GPE> cu <ORG> astazi")], "index long, sentence string")
    default = process_text(df).first().sentence
    kept = process_text(df, keep_all_tags=True).first().sentence
    assert default == "merge   astazi" and kept == "merge <GPE> <ORG> astazi"


def test_mask_spans_right_to_left_equivalent(spark):
    df = spark.createDataFrame(
        [("Ion și Ana la Cluj", [(0, 3, "PERSON"), (7, 10, "PERSON"), (14, 18, "GPE")]),
         ("nimic", []), ("x Eriner y", [(2, 8, "MISC")])],
        "s string, sp array<struct<start:int,end:int,label:string>>")
    got = [r[0] for r in df.select(T.mask_spans("s", "sp")).collect()]
    assert got == ["<PERSON> și <PERSON> la <GPE>", "nimic", "x Eriner y"]


def test_gazetteer_longest_leftmost(spark):
    df = spark.createDataFrame([(1, "Orre Orre Orre și Stteen Erachtz, Eriner"), (2, "fără nume"), (3, "Stteen  Erachtz")],
                               "index long, sentence string")
    ents = {r["index"]: [(e.start, e.end, e.label) for e in r.entities]
            for r in detect_entities(df, gazetteer_df(spark)).collect()}
    assert ents[1] == [(0, 9, "ORG"), (10, 14, "PERSON"), (18, 32, "PERSON"), (34, 40, "MISC")]
    assert 2 not in ents
    assert ents[3] == [(0, 6, "LOC")]  # two spaces: not the two-word surface
    out = anonymize(df, gazetteer_df(spark)).orderBy("index").collect()
    assert out[0].sentence == "<ORG> <PERSON> și <PERSON>, Eriner"


def test_stopwords_loaded_normalised(spark):
    words = sorted(r.word for r in load_stopwords(stopwords_df(spark), "ro").collect())
    assert words == ["dans", "from", "that", "this", "with", "țările"]


def test_lemma_stopword_and_upper_lemma(spark):
    df = spark.createDataFrame([(1, ["thatin", "ononst", "țările", "kept"]), (2, [])], "index long, toks array<string>")
    out = lemmatize_and_filter(df, "index", "toks", lemmas=prepare_lemmas(lemmas_df(spark), "ro"),
                               stopwords=load_stopwords(stopwords_df(spark), "ro"))
    got = {r["index"]: r.tokens for r in out.collect()}
    assert got == {1: ["onon", "kept"], 2: []}


def test_process_text_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "Ana are mere multe cont.nou@exemplu.ro  acum", "x"), (2, "a b", "y"), (3, None, "z")],
                               "index long, sentence string, other string")
    out = process_text(df, stopwords=load_stopwords(stopwords_df(spark), "ro"),
                       lemmas=prepare_lemmas(lemmas_df(spark), "ro")).orderBy("index").collect()
    assert [(r["index"], r.sentence, r.other) for r in out] == [(1, "mere multe acumul", "x"), (2, "", "y"), (3, None, "z")]


def test_inline_and_joined_gazetteer_agree(spark):
    from quillspark.sources.fixtures import labelled_sentences
    from tests.conftest import SMOKE

    text = labelled_sentences(spark, SMOKE).select("index", "sentence")
    a = detect_entities(text, gazetteer_df(spark)).collect()
    b = detect_entities(text, gazetteer_df(spark), inline_max=0, trie_max=0).collect()
    assert len(a) > 10
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_size_switches_do_not_change_results(spark):
    """Null and repeated keys, repeated texts, null surfaces: one row out per row in, on both sides of the switches."""
    from quillspark.plans.preprocess import preprocess_full

    rows = [(None, "Orre came home today"), (1, "Orre went with Orre"), (1, "hello there Orre friend"), (None, "Orre came home today"),
            (2, None), (None, None), (3, ""), (1, "mere mere multe")]
    df = spark.createDataFrame(rows, "index long, sentence string")
    gaz = spark.createDataFrame([("Orre", "PERSON"), (None, "ORG"), ("home", None)], "surface string, label string")
    small = sorted(str(tuple(r)) for r in anonymize(df, gaz).collect())
    large = sorted(str(tuple(r)) for r in anonymize(df, gaz, inline_max=0, trie_max=0).collect())
    assert small == large and len(large) == len(rows)
    assert "(1, '<PERSON> went with <PERSON>')" in small and "(None, '<PERSON> came home today')" in small
    kw = dict(gazetteer=gaz, stopwords=load_stopwords(stopwords_df(spark), "ro"), lemmas=prepare_lemmas(lemmas_df(spark), "ro"))
    a = sorted(str(tuple(r)) for r in preprocess_full(df, **kw).collect())
    b = sorted(str(tuple(r)) for r in preprocess_full(df, inline_max=0, trie_max=0, strategy="join", **kw).collect())
    assert a == b and len(b) == len(rows)


def test_masking_is_linear_in_hits(spark):
    import time

    gaz = gazetteer_df(spark)

    def seconds(n):
        df = spark.createDataFrame([(1, "Orre merge acasă " * n)], "index long, sentence string")
        t = time.perf_counter()
        out = anonymize(df, gaz).first().sentence
        assert out.count("<PERSON>") == n
        return time.perf_counter() - t

    seconds(1000)
    half, whole = min(seconds(8000) for _ in range(2)), min(seconds(16000) for _ in range(2))
    assert whole < 2.5 * half + 1 and whole < 15


def test_model_recognizer_path(spark):
    from quillspark.operators.entities import detect_entities_with_model
    from quillspark.sources.fixtures import gazetteer_recognizer, labelled_sentences
    from tests.conftest import SMOKE

    df = spark.createDataFrame([(1, "Google și Orre Orre"), (2, None), (3, "nimic")], "index long, sentence string")
    got = {r["index"]: [tuple(e) for e in r.entities or []]
           for r in detect_entities_with_model(df, gazetteer_recognizer).collect()}
    # the model says ORGANIZATION; the label map turns it into ORG, which is masked
    assert got == {1: [(0, 6, "ORG"), (10, 19, "ORG")], 2: [], 3: []}
    text = labelled_sentences(spark, SMOKE).select("index", "sentence")
    a = anonymize(text, recognizer=gazetteer_recognizer).collect()
    b = anonymize(text, gazetteer_df(spark)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
