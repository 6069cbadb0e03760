"""Registered queries: anonymisation, normalisation and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.entities import detect_entities, sort_spans_desc, with_entities
from quillspark.operators.joins import dictionary_join
from quillspark.operators.positions import batch_padding, consecutive_batches, packed_batches, packed_padding
from quillspark.operators.tokens import explode_tokens, lemmatize_and_filter, load_stopwords, prepare_lemmas
from quillspark.plans import oracle as O
from quillspark.plans.preprocess import anonymize, preprocess_full, process_text
from quillspark.plans.registry import register
from quillspark.sources.fixtures import (
    GAZETTEER, LEMMAS, STOPWORDS, gazetteer_df, gazetteer_recognizer, labelled_sentences, lemmas_df, stopwords_df,
)

S = O.with_sentences
MAX_N = 2  # longest fixture gazetteer surface, in tokens
TRUNCATE_N = 32
BATCH_ROWS = 32


def _sent(spark, sf_dir):
    return labelled_sentences(spark, sf_dir)


def _text(spark, sf_dir):
    return _sent(spark, sf_dir).select("index", "sentence")


def _col_query(key: str, fn, sql_expr: str):
    @register(key, S() + f'SELECT "index", {sql_expr} AS sentence FROM sentl')
    def q(spark, sf_dir):
        return _text(spark, sf_dir).withColumn("sentence", fn(F.col("sentence")))
    return q


_col_query("mask_brands", T.mask_brands, O.brands_sql("sentence"))
_col_query("mask_site_urls", T.mask_site_urls, O.sites_sql("sentence"))
_col_query("mask_all_urls", lambda c: T.mask_all_urls(T.mask_site_urls(c)),
           f"regexp_replace({O.sites_sql('sentence')}, 'https?://{O.N}+|www\\.{O.N}+', '@URL', 'g')")
_col_query("strip_emails", T.strip_emails, f"regexp_replace(sentence, '{O.EMAIL}', '', 'g')")
_col_query("collapse_whitespace", lambda c: T.collapse_whitespace(T.strip_emails(c)),
           f"regexp_replace(regexp_replace(sentence, '{O.EMAIL}', '', 'g'), '{O.W}+', ' ', 'g')")
_col_query("fix_diacritics", T.fix_diacritics, "translate(sentence, 'ţş', 'țș')")
_col_query("lowercase", lambda c: T.lowercase(T.fix_diacritics(c)), "lower(translate(sentence, 'ţş', 'țș'))")


def _normed(spark, sf_dir):
    from quillspark.plans.preprocess import normalize
    return normalize(_text(spark, sf_dir))


@register("tokenize", S() + f"""
, tk AS (SELECT "index", {O.toks_sql(O.norm_sql('sentence'))} AS toks FROM sentl)
SELECT "index", array_to_string(toks, ' ') AS tokens, CAST(len(toks) AS INTEGER) AS n_tokens FROM tk""")
def q_tokenize(spark, sf_dir):
    t = _normed(spark, sf_dir).withColumn("toks", T.tokenize("sentence"))
    return t.select("index", T.join_tokens("toks").alias("tokens"), F.size("toks").alias("n_tokens"))


@register("drop_short_tokens", S() + f"""
SELECT "index", array_to_string({O.short_sql(O.toks_sql(O.norm_sql('sentence')))}, ' ') AS tokens FROM sentl""")
def q_drop_short(spark, sf_dir):
    t = _normed(spark, sf_dir)
    return t.select("index", T.join_tokens(T.drop_short_tokens(T.tokenize("sentence"))).alias("tokens"))


@register("join_tokens", S() + f"""
SELECT "index", array_to_string({O.toks_sql('lower(sentence)')}, ' ') AS sentence FROM sentl""")
def q_join_tokens(spark, sf_dir):
    return _text(spark, sf_dir).withColumn("sentence", T.join_tokens(T.tokenize(F.lower("sentence"))))


@register("restore_placeholders", S() + f"""
SELECT "index", {O.restore_sql("array_to_string(" + O.short_sql(O.toks_sql(O.norm_sql('sentence'))) + ", ' ')")}
  AS sentence FROM sentl""")
def q_restore(spark, sf_dir):
    t = _normed(spark, sf_dir)
    joined = T.join_tokens(T.drop_short_tokens(T.tokenize("sentence")))
    return t.select("index", T.restore_placeholders(joined).alias("sentence"))


@register("truncate_tokens", S() + f"""
, tk AS (SELECT "index", {O.toks_sql(O.norm_sql('sentence'))} AS toks FROM sentl)
SELECT "index", CAST(len(toks) AS INTEGER) AS n_tokens, CAST(least(len(toks), {TRUNCATE_N}) AS INTEGER) AS n_kept,
  len(toks) > {TRUNCATE_N} AS was_cut, array_to_string(toks[1:{TRUNCATE_N}], ' ') AS tokens FROM tk""")
def q_truncate(spark, sf_dir):
    t = _normed(spark, sf_dir).withColumn("toks", T.tokenize("sentence"))
    kept = T.truncate_tokens("toks", TRUNCATE_N)
    return t.select("index", F.size("toks").alias("n_tokens"), F.size(kept).alias("n_kept"),
                    (F.size("toks") > TRUNCATE_N).alias("was_cut"), T.join_tokens(kept).alias("tokens"))


@register("length_bucket_batches", S() + f"""
, r AS (SELECT split, CAST(len({O.toks_sql(O.norm_sql('sentence'))}) AS INTEGER) AS len,
          row_number() OVER (PARTITION BY split ORDER BY "index") - 1 AS idx FROM sentl)
, b AS (SELECT split, CAST(idx // {BATCH_ROWS} AS BIGINT) AS batch, len FROM r)
SELECT split, batch, count(*) AS n_rows, max(len) AS max_len,
  CAST(sum(m - len) AS BIGINT) AS pad_tokens
FROM (SELECT *, max(len) OVER (PARTITION BY split, batch) AS m FROM b) GROUP BY split, batch""")
def q_length_batches(spark, sf_dir):
    """Padding waste when each batch of consecutive rows is padded to its longest row."""
    from quillspark.plans.preprocess import normalize
    t = normalize(_sent(spark, sf_dir).select("index", "split", "sentence"))
    t = t.select("index", "split", F.size(T.tokenize("sentence")).alias("len"))
    return batch_padding(consecutive_batches(t, BATCH_ROWS))


_LENGTHS_SQL = f"""
, b AS (SELECT split, len, CAST((row_number() OVER (PARTITION BY split ORDER BY len, "index") - 1) // {BATCH_ROWS} AS BIGINT) AS batch
        FROM (SELECT split, "index", CAST(len({O.toks_sql(O.norm_sql('sentence'))}) AS INTEGER) AS len FROM sentl))
SELECT split, batch, count(*) AS n_rows, max(len) AS max_len, CAST(max(len) * count(*) - sum(len) AS BIGINT) AS pad_tokens
FROM b GROUP BY split, batch"""


def _lengths(spark, sf_dir):
    from quillspark.plans.preprocess import normalize
    t = normalize(_sent(spark, sf_dir).select("index", "split", "sentence"))
    return t.select("index", "split", F.size(T.tokenize("sentence")).alias("len"))


@register("length_packed_batches", S() + _LENGTHS_SQL)
def q_packed_batches(spark, sf_dir):
    """Padding when batches are packed over the whole split in order of length; every row gets its batch."""
    return batch_padding(packed_batches(_lengths(spark, sf_dir), BATCH_ROWS))


@register("length_packed_padding", S() + _LENGTHS_SQL)
def q_packed_padding(spark, sf_dir):
    """The same figures from the histogram of lengths alone."""
    return packed_padding(_lengths(spark, sf_dir), BATCH_ROWS)


_DICTS = O.stop_ctes(STOPWORDS, LEMMAS)


@register("load_stopwords", S(_DICTS, f"""
, tk AS (SELECT unnest({O.toks_sql(O.norm_sql('sentence'))}) AS tok FROM sentl)
, hits AS (SELECT tok, count(*) AS n FROM tk GROUP BY tok)
""") + "SELECT s.word, coalesce(h.n, 0) AS n_hits FROM stop s LEFT JOIN hits h ON h.tok = s.word")
def q_load_stopwords(spark, sf_dir):
    """The normalised list, with how often each word occurs in the corpus."""
    stop = load_stopwords(stopwords_df(spark), "ro")
    toks = _normed(spark, sf_dir).select(F.explode(T.tokenize("sentence")).alias("word"))
    # Keep only stop-word tokens (size-checked broadcast semi join) before counting.
    hits = dictionary_join(toks, stop, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n_hits"))
    return stop.join(hits, "word", "left").select("word", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


@register("drop_stopwords", S(_DICTS, f"""
, tk AS (SELECT "index", {O.short_sql(O.toks_sql(O.norm_sql('sentence')))} AS toks FROM sentl)
, tu AS (SELECT "index", unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM tk)
, kept AS (SELECT * FROM tu WHERE tok NOT IN (SELECT word FROM stop))
""") + """SELECT k."index", coalesce(string_agg(tok, ' ' ORDER BY pos), '') AS tokens
FROM tk k LEFT JOIN kept USING ("index") GROUP BY k."index\"""")
def q_drop_stopwords(spark, sf_dir):
    t = _normed(spark, sf_dir).withColumn("toks", T.drop_short_tokens(T.tokenize("sentence")))
    stop = load_stopwords(stopwords_df(spark), "ro")
    out = lemmatize_and_filter(t, "index", "toks", stopwords=stop, out="kept", lower_lemmas=False)
    return out.select("index", T.join_tokens("kept").alias("tokens"))


@register("lemmatize", S(_DICTS, f"""
, tk AS (SELECT "index", {O.short_sql(O.toks_sql(O.norm_sql('sentence')))} AS toks FROM sentl)
, tu AS (SELECT "index", unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM tk)
, tl AS (SELECT tu."index", tu.pos, lower(coalesce(lem.lemma, tu.tok)) AS v FROM tu LEFT JOIN lem ON lem.surface = tu.tok)
""") + """SELECT k."index", coalesce(string_agg(v, ' ' ORDER BY pos), '') AS tokens
FROM tk k LEFT JOIN tl USING ("index") GROUP BY k."index\"""")
def q_lemmatize(spark, sf_dir):
    t = _normed(spark, sf_dir).withColumn("toks", T.drop_short_tokens(T.tokenize("sentence")))
    lem = prepare_lemmas(lemmas_df(spark), "ro")
    out = lemmatize_and_filter(t, "index", "toks", lemmas=lem, out="lemmas")
    return out.select("index", T.join_tokens("lemmas").alias("tokens"))


@register("dictionary_join", S(_DICTS, f"""
, tk AS (SELECT "index", {O.short_sql(O.toks_sql(O.norm_sql('sentence')))} AS toks FROM sentl)
, tu AS (SELECT "index", unnest(toks) AS tok, CAST(unnest(range(len(toks))) AS INTEGER) AS pos FROM tk)
""") + 'SELECT tu."index", tu.pos, tu.tok, lem.lemma FROM tu JOIN lem ON lem.surface = tu.tok')
def q_dictionary_join(spark, sf_dir):
    """Token rows matched to the lemma dictionary (broadcast after a size check)."""
    t = _normed(spark, sf_dir).withColumn("toks", T.drop_short_tokens(T.tokenize("sentence")))
    ex = explode_tokens(t, "index", "toks").where(F.col("tok").isNotNull())
    lem = prepare_lemmas(lemmas_df(spark), "ro").withColumnRenamed("surface", "tok")
    return dictionary_join(ex, lem, "tok", "inner").select("index", "pos", "tok", "lemma")


@register("process_text", S(_DICTS, O.process_ctes("sentl", "sentence", "pt")) +
          'SELECT "index", t AS sentence FROM pt')
def q_process_text(spark, sf_dir):
    t = _text(spark, sf_dir)
    return process_text(t, stopwords=load_stopwords(stopwords_df(spark), "ro"),
                        lemmas=prepare_lemmas(lemmas_df(spark), "ro"))


_GAZ = O.gazetteer_ctes("sentl", "sentence", GAZETTEER, MAX_N)


@register("detect_entities", S(_GAZ) + """
SELECT "index", CAST(z.s AS INTEGER) AS "start", CAST(z.e AS INTEGER) AS "end", z.l AS label
FROM (SELECT "index", unnest(spans) AS z FROM ents)""")
def q_detect_entities(spark, sf_dir):
    ents = detect_entities(_text(spark, sf_dir), gazetteer_df(spark))
    return ents.select("index", F.explode("entities").alias("z")).select(
        "index", F.col("z.start").alias("start"), F.col("z.end").alias("end"), F.col("z.label").alias("label"))


@register("sort_spans_desc", S(_GAZ) + """
SELECT "index", array_to_string(list_reverse(list_sort(list_transform(spans, lambda z: z.s))), ',') AS starts_desc
FROM ents""")
def q_sort_spans(spark, sf_dir):
    ents = detect_entities(_text(spark, sf_dir), gazetteer_df(spark))
    desc = sort_spans_desc(F.col("entities"))
    return ents.select("index", F.array_join(F.transform(desc, lambda z: z["start"].cast("string")), ",").alias("starts_desc"))


@register("mask_entity_spans", S(_GAZ) + f"""
SELECT s."index", {O.mask_sql('s.sentence', 'e.spans')} AS sentence
FROM sentl s LEFT JOIN ents e USING ("index")""")
def q_mask_spans(spark, sf_dir):
    t = with_entities(_text(spark, sf_dir), gazetteer_df(spark))
    return t.select("index", T.mask_spans("sentence", "entities").alias("sentence"))


_ANON_SQL = S(_GAZ, f"""
, an AS (SELECT s."index", {O.sites_sql(O.brands_sql(O.mask_sql('s.sentence', 'e.spans')))} AS sentence
         FROM sentl s LEFT JOIN ents e USING ("index"))
""")


@register("anonymize", _ANON_SQL + 'SELECT "index", sentence FROM an')
def q_anonymize(spark, sf_dir):
    return anonymize(_text(spark, sf_dir), gazetteer_df(spark))


@register("anonymize_recognizer", _ANON_SQL + 'SELECT "index", sentence FROM an')
def q_anonymize_recognizer(spark, sf_dir):
    """T6 with a recogniser model in place of the gazetteer (T2 (b)); the stand-in model finds the gazetteer's surfaces."""
    return anonymize(_text(spark, sf_dir), recognizer=gazetteer_recognizer)


# Keys of every kind for the same texts: null for a third of the rows, shared by neighbours for another third.
_KEYS_SQL = """
, kd AS (SELECT CASE WHEN "index" % 3 = 0 THEN NULL WHEN "index" % 3 = 1 THEN concat('n', news_id) ELSE concat('i', "index") END AS "key", "index" AS idx FROM sentl)
"""


def _mixed_keys(df):
    i = F.col("index")
    return df.withColumn("key", F.when(i % 3 == 1, F.concat(F.lit("n"), F.col("news_id"))).when(i % 3 == 2, F.concat(F.lit("i"), i)))


@register("anonymize_large_gazetteer", _ANON_SQL + _KEYS_SQL +
          'SELECT kd.key, an.sentence FROM an JOIN kd ON kd.idx = an."index"')
def q_anonymize_large(spark, sf_dir):
    """T6 through the trie that a gazetteer too big for literal sets becomes (map-only), with null and repeated row keys."""
    t = _mixed_keys(_sent(spark, sf_dir).select("index", "news_id", "sentence")).select("key", "sentence")
    return anonymize(t, gazetteer_df(spark), inline_max=0)


@register("anonymize_joined_gazetteer", _ANON_SQL + _KEYS_SQL +
          'SELECT kd.key, an.sentence FROM an JOIN kd ON kd.idx = an."index"')
def q_anonymize_joined(spark, sf_dir):
    """T6 through the joined path that a gazetteer too big for a trie takes, with null and repeated row keys."""
    t = _mixed_keys(_sent(spark, sf_dir).select("index", "news_id", "sentence")).select("key", "sentence")
    return anonymize(t, gazetteer_df(spark), inline_max=0, trie_max=0)


@register("preprocess_large_dictionary", _ANON_SQL + _KEYS_SQL + _DICTS + O.process_ctes("an", "sentence", "pf") +
          'SELECT kd.key, pf.t AS sentence FROM pf JOIN kd ON kd.idx = pf."index"')
def q_preprocess_large(spark, sf_dir):
    """T19 through both joined paths (big gazetteer, big dictionary), with null and repeated row keys."""
    t = _mixed_keys(_sent(spark, sf_dir).select("index", "news_id", "sentence")).select("key", "sentence")
    return preprocess_full(t, gazetteer=gazetteer_df(spark), stopwords=load_stopwords(stopwords_df(spark), "ro"),
                           lemmas=prepare_lemmas(lemmas_df(spark), "ro"), id_col="key", inline_max=0, trie_max=0, strategy="join")


@register("preprocess_full", _ANON_SQL + _DICTS + O.process_ctes("an", "sentence", "pf") + """
SELECT s."index", s.news_id, pf.t AS sentence, s.domain, s.label_0, s.label_1, s.label_2, s.label, s.split
FROM sentl s JOIN pf USING ("index")""")
def q_preprocess_full(spark, sf_dir):
    out = preprocess_full(_sent(spark, sf_dir), gazetteer=gazetteer_df(spark),
                          stopwords=load_stopwords(stopwords_df(spark), "ro"),
                          lemmas=prepare_lemmas(lemmas_df(spark), "ro"))
    return out.select("index", "news_id", "sentence", "domain", "label_0", "label_1", "label_2", "label", "split")


@register("distinct_stopwords", S(_DICTS, f"""
, tk AS (SELECT unnest({O.toks_sql(O.norm_sql('sentence'))}) AS tok FROM sentl)
""") + "SELECT DISTINCT tok AS word FROM tk WHERE tok IN (SELECT word FROM stop)")
def q_distinct_stopwords(spark, sf_dir):
    """The normalised stop-word set, as it occurs in the corpus (distinct)."""
    stop = load_stopwords(stopwords_df(spark), "ro")
    toks = _normed(spark, sf_dir).select(F.explode(T.tokenize("sentence")).alias("word"))
    return dictionary_join(toks, stop, "word", "left_semi").distinct()
