"""Text normalisation, masking and token columns.

All builders but ``mask_spans`` (Arrow batches) return JVM expressions
(regexp_replace, translate, higher-order array functions). Patterns are Java regex
and are linear on long unbroken runs (possessive quantifiers, no nested
unbounded repetition).
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.constants import BRANDS, DEFAULT_ENTITY_LABELS, KEEP_SHORT_TOKENS, SITE_PATTERNS

# Whitespace as Python's ``str.isspace`` sees it: Java's Unicode White_Space
# plus the four information separators \x1c-\x1f.
_WS = r"\s\x1c-\x1f"

# A sentence: a run without terminators, plus trailing terminators.
SENTENCE_RE = r"[^.!?\n]+[.!?]*"
# Non-space run holding an '@', plus one following whitespace character.
EMAIL_RE = rf"(?U)(?<![^{_WS}])[^{_WS}@]*+@[^{_WS}]*+[{_WS}]?"
WS_RUN_RE = rf"(?U)[{_WS}]+"
STRIP_RE = rf"(?U)^[{_WS}]+|[{_WS}]+$"
FIRST_WORD_RE = rf"(?U)^[{_WS}]*+([^{_WS}]*+)"
# Word tokens (letters, marks, digits, inner hyphen/apostrophe) and angle brackets.
TOKEN_RE = r"[<>]|[\p{L}\p{M}\p{N}]+(?:[-'’][\p{L}\p{M}\p{N}]+)*"
URL_RE = rf"(?U)https?://[^{_WS}]+|www\.[^{_WS}]+"
BRAND_RE = "|".join(BRANDS)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()``: Unicode whitespace on both ends (Spark trim strips spaces only)."""
    return F.regexp_replace(_c(c), STRIP_RE, "")


# --- anonymisation (T3, T4, T5) ----------------------------------------------

def mask_brands(c: Column | str, brands: Iterable[str] = BRANDS, tag: str = "<ORG>") -> Column:
    """Case-sensitive substring replace of brand names with ``<ORG>``."""
    pattern = BRAND_RE if tuple(brands) == BRANDS else "|".join(brands)
    return F.regexp_replace(_c(c), pattern, tag)


def mask_site_urls(c: Column | str, patterns: Iterable[str] = SITE_PATTERNS, tag: str = "@URL") -> Column:
    """T4: the two site names (dots are regex wildcards) -> ``@URL``, in order."""
    out = _c(c)
    for p in patterns:
        out = F.regexp_replace(out, p, tag)
    return out


def mask_all_urls(c: Column | str, tag: str = "@URL") -> Column:
    """T5: every http(s):// or www. run -> ``@URL`` (documented behaviour, opt-in)."""
    return F.regexp_replace(_c(c), URL_RE, tag)


# --- normalisation (T7-T10) -----------------------------------------------------

def strip_emails(c: Column | str) -> Column:
    """Drop every non-space run containing '@' and one following whitespace.

    This also removes ``@URL`` placeholders, as the original does.
    """
    return F.regexp_replace(_c(c), EMAIL_RE, "")


def collapse_whitespace(c: Column | str) -> Column:
    """Runs of whitespace -> one space (no trim)."""
    return F.regexp_replace(_c(c), WS_RUN_RE, " ")


def fix_diacritics(c: Column | str, upper: bool = False) -> Column:
    """Cedilla -> comma below, lower case only unless ``upper``."""
    if upper:
        return F.translate(_c(c), "ţşŢŞ", "țșȚȘ")
    return F.translate(_c(c), "ţş", "țș")


def lowercase(c: Column | str) -> Column:
    """T10."""
    return F.lower(_c(c))


# --- tokens (T11, T12, T16, T17, T20) -------------------------------------------

def tokenize(c: Column | str) -> Column:
    """Word tokens and angle brackets, punctuation and spaces dropped."""
    return F.regexp_extract_all(_c(c), F.lit(TOKEN_RE), 0)


def drop_short_tokens(tokens: Column | str, min_len: int = 3, keep: Iterable[str] = KEEP_SHORT_TOKENS,
                      keep_tags: Iterable[str] = ()) -> Column:
    """Drop tokens with length <= ``min_len`` except the kept ones.

    ``keep_tags``: short words also kept when they sit between ``<`` and
    ``>`` (entity tags such as ``< gpe >``). Neighbours come from shifted
    copies zipped with the array, so the lambda reads only its own element.
    """
    keep = list(keep)
    tags = [t.lower() for t in keep_tags]
    toks = _c(tokens)
    if not tags:
        return F.filter(toks, lambda t: (F.length(t) > min_len) | t.isin(*keep))
    prev = F.concat(F.array(F.lit(None).cast("string")), toks)
    nxt = F.concat(F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
    zipped = F.arrays_zip(toks.alias("t"), prev.alias("p"), nxt.alias("n"))
    kept = F.filter(zipped, lambda z: (F.length(z["t"]) > min_len) | z["t"].isin(*keep) |
                    (z["t"].isin(*tags) & (z["p"] == "<") & (z["n"] == ">")))
    return F.transform(kept, lambda z: z["t"])


def drop_listed_tokens(tokens: Column | str, words: Iterable[str]) -> Column:
    """Drop tokens found in a small literal word list (hashed set inside the lambda)."""
    words = sorted(set(words))
    if not words:
        return _c(tokens)
    return F.filter(_c(tokens), lambda t: ~t.isin(*words))


def join_tokens(tokens: Column | str, sep: str = " ") -> Column:
    """T16."""
    return F.array_join(_c(tokens), sep)


def restore_placeholders(c: Column | str, labels: Iterable[str] = DEFAULT_ENTITY_LABELS) -> Column:
    """Drop ``< >``, then ``< person >`` -> ``<PERSON>`` for each label.

    The three-letter tags (GPE, ORG, LOC, FAC) only reach this step when the
    short-token filter kept them (``drop_short_tokens(keep_tags=...)``).
    """
    # Literal patterns: plain string replace, no regex engine.
    out = F.replace(_c(c), F.lit("< >"), F.lit(""))
    for tag in labels:
        out = F.replace(out, F.lit(f"< {tag.lower()} >"), F.lit(f"<{tag}>"))
    return out


def truncate_tokens(tokens: Column | str, n: int) -> Column:
    """Keep the first ``n`` tokens."""
    return F.slice(_c(tokens), 1, n)


# --- masking entity spans (T1) -----------------------------------------------------

def mask_spans(text: Column | str, spans: Column | str, labels: Iterable[str] | None = DEFAULT_ENTITY_LABELS) -> Column:
    """Replace each span (start, end, label), 0-based half-open code points,
    whose label is in ``labels`` by ``<LABEL>``. Spans must not overlap.

    Rebuilt from gap and tag pieces in one pass over Arrow batches: linear in
    the text and its spans.
    """
    t = _c(text)
    sp = _c(spans)
    allowed = None if labels is None else frozenset(labels)

    @F.pandas_udf("string")
    def mask(texts: pd.Series, starts: pd.Series, ends: pd.Series, tags: pd.Series) -> pd.Series:
        out = []
        for x, s, e, names in zip(texts, starts, ends, tags):
            if x is not None and s is not None and len(s):
                at, pieces = 0, []
                for a, b, name in sorted(zip(s, e, names)):
                    if allowed is None or name in allowed:
                        pieces += [x[at:a], "<", name, ">"]
                        at = b
                x = "".join([*pieces, x[at:]])
            out.append(x)
        return pd.Series(out, dtype=object)

    return mask(t, sp["start"], sp["end"], sp["label"])
