"""Dictionary-driven token operators.

A dictionary of checked size is broadcast and applied to each row's tokens in
Arrow batches. With a bigger one the token arrays are exploded to
(digest, pos, tok) and joined to it (salted when it cannot be broadcast);
the tokens that it changes or drops are regrouped by the digest and joined
back: what a row's tokens become depends on the tokens alone, so the user's row key plays no part and rows with null
or repeated keys stay apart. Both ways give one output row per input row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import fix_diacritics, py_strip
from quillspark.operators.joins import DEFAULT_BROADCAST_ROWS, dictionary_join
from quillspark.session import written


def load_stopwords(words: DataFrame, lang: str | None = None, col: str = "word") -> DataFrame:
    """Cedilla fixed, stripped, distinct; read once, not per row."""
    if lang is not None and "lang" in words.columns:
        words = words.where(F.col("lang") == lang)
    return words.select(py_strip(fix_diacritics(F.col(col))).alias("word")).distinct()


def read_stopword_file(spark: SparkSession, path: str) -> DataFrame:
    """One word per line (a text file or folder of them)."""
    return load_stopwords(spark.read.text(path).withColumnRenamed("value", "word"))


def prepare_lemmas(lemmas: DataFrame, lang: str | None = None) -> DataFrame:
    """(surface, lemma), one lemma per surface (the smallest, deterministic)."""
    if lang is not None and "lang" in lemmas.columns:
        lemmas = lemmas.where(F.col("lang") == lang)
    return lemmas.groupBy("surface").agg(F.min("lemma").alias("lemma"))


def explode_tokens(df: DataFrame, id_col: str, tokens_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """(id, carry..., pos, tok); rows without tokens keep one row with null pos."""
    return df.select(id_col, *carry, F.posexplode_outer(tokens_col).alias("pos", "tok"))


def token_dictionary(lemmas: DataFrame | None, stopwords: DataFrame | None,
                     token_stopwords: DataFrame | None) -> DataFrame:
    """One row per known word: (tok, _lemma, _drop).

    Folds the three lookups of the original (built-in stop word, lemma, lemma
    in the custom stop list) into a single dictionary-sized table, so the
    token rows go through one join instead of three. A word absent from it
    keeps itself as lemma and is not dropped (every stop word is a key).
    """
    keys = []
    if lemmas is not None:
        keys.append(lemmas.select(F.col("surface").alias("tok")))
    for sw in (stopwords, token_stopwords):
        if sw is not None:
            keys.append(sw.select(F.col("word").alias("tok")))
    d = keys[0]
    for k in keys[1:]:
        d = d.unionByName(k)
    d = d.distinct()
    if lemmas is not None:
        d = d.join(lemmas.select(F.col("surface").alias("tok"), F.col("lemma").alias("_lemma")), "tok", "left")
        d = d.withColumn("_lemma", F.coalesce("_lemma", "tok"))
    else:
        d = d.withColumn("_lemma", F.col("tok"))
    drop = F.lit(False)
    if token_stopwords is not None:
        ts = token_stopwords.select(F.col("word").alias("tok"), F.lit(True).alias("_st")).distinct()
        d = d.join(ts, "tok", "left")
        drop = drop | F.coalesce("_st", F.lit(False))
    if stopwords is not None:
        ls = stopwords.select(F.col("word").alias("_lemma"), F.lit(True).alias("_sl")).distinct()
        d = d.join(ls, "_lemma", "left")
        drop = drop | F.coalesce("_sl", F.lit(False))
    return d.select("tok", "_lemma", drop.alias("_drop"))


# Combined dictionaries up to this many entries are applied by a broadcast
# lookup inside each task (no shuffle); bigger ones by explode / join / regroup.
LOOKUP_MAX_ENTRIES = 500_000


def lemmatize_and_filter(df: DataFrame, id_col: str, tokens_col: str, *, lemmas: DataFrame | None = None,
                         stopwords: DataFrame | None = None, token_stopwords: DataFrame | None = None,
                         out: str = "tokens", carry: Sequence[str] = (), lower_lemmas: bool = True,
                         strategy: str = "auto", max_lookup_entries: int = LOOKUP_MAX_ENTRIES,
                         max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS, lookup_rows: list | None = None) -> DataFrame:
    """T14 + T15: drop stop words, replace tokens by their lemma.

    A token is dropped when it is in ``token_stopwords`` (the built-in list of
    the original; defaults to ``stopwords``) or when its lemma is in
    ``stopwords``. Kept tokens become their lemma, lower-cased. The lemma of a
    token missing from the dictionary is the token itself.

    ``strategy``:

    * ``"lookup"``: the combined dictionary (size checked first) is broadcast
      and applied to each row's token array in Arrow batches. Map-only: no
      shuffle, rows keep their partitioning.
    * ``"join"``: the token arrays are exploded and joined to the dictionary
      (broadcast, or salted above the bound); what it changes is regrouped by
      a digest of the array and joined back. Only those tokens move.
    * ``"auto"``: ``lookup`` up to ``max_lookup_entries`` entries, else ``join``.

    ``lookup_rows``: the result of ``prepare_lookup`` when already read (e.g.
    once for all micro-batches of a stream).
    """
    if lookup_rows is not None:
        return _lookup_strategy(df, lookup_rows, id_col, tokens_col, out, carry, lower_lemmas)
    if token_stopwords is None:
        token_stopwords = stopwords
    if lemmas is None and stopwords is None and token_stopwords is None:
        kept = F.transform(tokens_col, lambda t: F.lower(t)) if lower_lemmas else F.col(tokens_col)
        return df.select(id_col, *carry, F.coalesce(kept, F.array().cast("array<string>")).alias(out))
    d = token_dictionary(lemmas, stopwords, token_stopwords)
    if strategy in ("auto", "lookup"):
        # One bounded read decides and, when small, is the lookup table itself.
        rows = d.limit(max_lookup_entries + 1).collect()
        if len(rows) <= max_lookup_entries:
            return _lookup_strategy(df, rows, id_col, tokens_col, out, carry, lower_lemmas)
        if strategy == "lookup":
            raise ValueError(f"dictionary has more than {max_lookup_entries} entries; use strategy='join'")
        strategy = "join"
    if strategy != "join":
        raise ValueError(f"unknown strategy {strategy!r}")
    # written once: the tokens are read twice, to look them up and to change them
    keyed = df.select(id_col, *carry, F.col(tokens_col).alias("_t"), F.unhex(F.md5(F.to_json(F.struct(F.col(tokens_col).alias("t"))))).alias("_tok_key"))
    keyed = written(keyed, "tokens")
    t = keyed.where(F.size("_t") > 0).select("_tok_key", F.posexplode("_t").alias("pos", "tok"))
    known = d.where(F.col("_drop") | ~F.col("_lemma").eqNullSafe(F.col("tok")))  # a token of no other entry stays as it is
    t = dictionary_join(t, known, "tok", "inner", max_broadcast_rows=max_broadcast_rows,
                        salt_from=F.xxhash64(F.col("_tok_key"), F.col("pos")))
    # rows equal in digest have equal changes: one of each
    t = t.select("_tok_key", "pos", F.when(~F.col("_drop"), F.col("_lemma")).alias("v")).distinct()
    changes = t.groupBy("_tok_key").agg(F.collect_list(F.struct("pos", "v")).alias("_changes"))
    changed = keyed.join(changes, "_tok_key", "left")
    # tokens and changes in order of their place, a change before its token; sorted once, in a generator that is not substituted
    both = F.concat(F.transform("_t", lambda x, i: F.struct(i.alias("pos"), F.lit(1).alias("k"), x.alias("v"))),
                    F.transform("_changes", lambda x: F.struct(x["pos"], F.lit(0).alias("k"), x["v"])))
    changed = changed.select("*", F.inline(F.array(F.struct(F.array_sort(both).alias("_m")))))
    first = F.filter("_m", lambda x, i: x["v"].isNotNull() & ((i == 0) | (F.get("_m", i - 1)["pos"] != x["pos"])))
    kept = F.when(F.col("_changes").isNull(), F.array_compact("_t")).otherwise(F.transform(first, lambda x: x["v"]))
    if lower_lemmas:
        kept = F.transform(kept, lambda x: F.lower(x))
    return changed.select(id_col, *carry, F.coalesce(kept, F.array().cast("array<string>")).alias(out))


def prepare_lookup(lemmas: DataFrame | None, stopwords: DataFrame | None, token_stopwords: DataFrame | None = None,
                   max_entries: int = LOOKUP_MAX_ENTRIES) -> list | None:
    """The combined dictionary rows for the lookup strategy, or None when it is
    bigger than ``max_entries`` (one bounded read)."""
    if lemmas is None and stopwords is None and token_stopwords is None:
        return None
    d = token_dictionary(lemmas, stopwords, token_stopwords if token_stopwords is not None else stopwords)
    rows = d.limit(max_entries + 1).collect()
    return rows if len(rows) <= max_entries else None


def _lookup_strategy(df: DataFrame, rows: list, id_col: str, tokens_col: str, out: str, carry: Sequence[str],
                     lower_lemmas: bool) -> DataFrame:
    """Broadcast dictionary applied per Arrow batch (see ``lemmatize_and_filter``)."""
    from quillspark.session import ship_package

    ship_package(df.sparkSession)
    # {token: (lemma, drop)} with raw lemmas; lower-casing stays a JVM
    # expression (below) so both strategies give identical text.
    table = {r["tok"]: (r["_lemma"], bool(r["_drop"])) for r in rows}
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<string>")
    def apply_dictionary(tokens: pd.Series) -> pd.Series:
        # all tokens of the batch at once: each distinct token is looked up once
        sizes = np.array([0 if t is None else len(t) for t in tokens], dtype=np.int64)
        if not sizes.sum():
            return pd.Series([[]] * len(sizes))
        code, words = pd.factorize(np.concatenate([t for t in tokens if t is not None and len(t)]), use_na_sentinel=False)
        found = [shared.value.get(w, (w, False)) for w in words]
        lemma = np.array([x[0] for x in found], dtype=object)
        keep = ~np.array([x[1] for x in found])[code]
        ends = np.cumsum(np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes)))
        return pd.Series(np.split(lemma[code[keep]], ends[:-1]))

    kept = apply_dictionary(F.col(tokens_col))
    if lower_lemmas:
        kept = F.transform(kept, lambda t: F.lower(t))
    return df.select(id_col, *carry, kept.alias(out))
