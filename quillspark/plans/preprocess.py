"""Anonymise (T6), process (T18) and the full preprocessing job.

With dictionaries of checked size the whole job is map-only. Bigger ones are
joined to the texts or token arrays, keyed by a digest of the
content; the row key is carried along and never used for matching, so every
input row gives one output row, whatever its key. Every text step is staged
with ``withColumn`` so each regex runs once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.constants import DEFAULT_ENTITY_LABELS
from quillspark.functions import text as T
from quillspark.operators.entities import INLINE_MAX_SURFACES, detect_entities_with_model, with_entities
from quillspark.operators.gazetteer_trie import TRIE_MAX_BYTES, Trie
from quillspark.operators.tokens import lemmatize_and_filter


def anonymize(df: DataFrame, gazetteer: DataFrame | None = None, labels: Iterable[str] = DEFAULT_ENTITY_LABELS,
              all_urls: bool = False, text_col: str = "sentence",
              sets: tuple[dict[str, list[str]], int] | Trie | None = None, recognizer=None,
              inline_max: int = INLINE_MAX_SURFACES, trie_max: int = TRIE_MAX_BYTES) -> DataFrame:
    """Entity spans -> tags (T2, T1), brands (T3), site names (T4), optionally all URLs (T5).

    A gazetteer of at most ``inline_max`` surfaces, or of at most ``trie_max`` bytes
    as a trie, is matched inside each row (no shuffle at all); a bigger one is
    joined to the texts' n-grams.
    """
    labels = list(labels)
    if gazetteer is not None or recognizer is not None:
        df = (with_entities(df, gazetteer, text_col, "_ents", inline_max, sets, trie_max) if gazetteer is not None
              else detect_entities_with_model(df, recognizer, text_col, "_ents"))
        df = df.withColumn(text_col, T.mask_spans(text_col, "_ents", labels)).drop("_ents")
    df = df.withColumn(text_col, T.mask_brands(text_col))
    df = df.withColumn(text_col, T.mask_site_urls(text_col))
    if all_urls:
        df = df.withColumn(text_col, T.mask_all_urls(text_col))
    return df


def normalize(df: DataFrame, text_col: str = "sentence", upper_diacritics: bool = False) -> DataFrame:
    """T7 -> T8 -> T9 -> T10, staged."""
    df = df.withColumn(text_col, T.strip_emails(text_col))
    df = df.withColumn(text_col, T.collapse_whitespace(text_col))
    df = df.withColumn(text_col, T.fix_diacritics(text_col, upper=upper_diacritics))
    return df.withColumn(text_col, T.lowercase(text_col))


def process_text(df: DataFrame, *, stopwords: DataFrame | None = None, lemmas: DataFrame | None = None,
                 token_stopwords: DataFrame | None = None, labels: Iterable[str] = DEFAULT_ENTITY_LABELS,
                 min_len: int = 3, keep_all_tags: bool = False, upper_diacritics: bool = False,
                 id_col: str = "index", text_col: str = "sentence", lookup_rows: list | None = None,
                 strategy: str = "auto") -> DataFrame:
    """Normalise, tokenise, drop short tokens, drop stop words, lemmatise,
    join and restore the entity tags; ``text_col`` is replaced, other columns kept."""
    df = df.withColumn("_null_text", F.col(text_col).isNull())
    carry: Sequence[str] = [c for c in df.columns if c not in (id_col, text_col)]
    df = normalize(df, text_col, upper_diacritics)
    labels = list(labels)
    tags = labels if keep_all_tags else ()
    df = df.withColumn("_tok", T.drop_short_tokens(T.tokenize(text_col), min_len, keep_tags=tags))
    if stopwords is None and lemmas is None and token_stopwords is None:
        out = df.withColumn("_tok2", F.col("_tok"))
    else:
        out = lemmatize_and_filter(df, id_col, "_tok", lemmas=lemmas, stopwords=stopwords,
                                   token_stopwords=token_stopwords, out="_tok2", carry=carry, lookup_rows=lookup_rows,
                                   strategy=strategy)
    restored = T.restore_placeholders(T.join_tokens("_tok2"), labels)
    # A null sentence stays null (the original would fail on it).
    out = out.withColumn(text_col, F.when(~F.col("_null_text"), restored))
    return out.select(id_col, text_col, *[c for c in carry if c != "_null_text"])


def preprocess_full(df: DataFrame, *, gazetteer: DataFrame | None = None, stopwords: DataFrame | None = None,
                    lemmas: DataFrame | None = None, labels: Iterable[str] = DEFAULT_ENTITY_LABELS,
                    all_urls: bool = False, id_col: str = "index", text_col: str = "sentence",
                    sets: tuple[dict[str, list[str]], int] | Trie | None = None, inline_max: int = INLINE_MAX_SURFACES,
                    trie_max: int = TRIE_MAX_BYTES, **kw) -> DataFrame:
    """T6 then T18 over the whole table; ``kw`` goes to ``process_text``."""
    df = anonymize(df, gazetteer, labels, all_urls, text_col, sets=sets, inline_max=inline_max, trie_max=trie_max)
    return process_text(df, stopwords=stopwords, lemmas=lemmas, labels=labels, id_col=id_col, text_col=text_col, **kw)
