"""Quality rules, line first (DataFrame functions only).

Every line is judged by itself: a line without a word is blank and ignored; a line
fails if it is

* navigation: it has at least ``nav_pipes`` separators ``|``, and at least ``nav_share`` times as many as words;
* symbols: more than ``symbol_share`` of its characters are one of ``#*$%&|<>``;
* boilerplate: it has at most ``max_boiler_words`` words and contains one of BOILERPLATE, whatever the case;
* punctuation: it has ``min_line_words`` words or more and no sentence mark
  ``. ! ? : ; …`` anywhere.

Failed lines are removed. A document whose removed lines hold more than ``max_lost_percent``
of its words is rejected, as is one that fails the base rules: fewer than ``min_words`` words,
or more than ``max_repeat_percent`` of its words in three-word windows that occur twice or more.

Scale: everything happens inside a row; there is no shuffle and no Python. Words, lines
and windows are staged behind a one-row generator so that no expression is computed
once for each element. Repeated windows are found by sorting longs within the text: a window's 64-bit hash with its
lowest bits (as many as the text's number of words needs) replaced by its position.

Edge cases: a null text has no words and fails the base rules, as does an empty one; repeated rows are
judged alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import WORD_RE, columns_of

SPACE_RE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
SYMBOL_RE = r"[#*$%&|<>]"
SENTENCE_MARKS = (".", "!", "?", ":", ";", "…")
#: Lower-case phrases that mark a line of web boilerplate.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "back to top", "click here to", "enable javascript",
    "lorem ipsum", "privacy policy", "read more", "sign up for our newsletter", "skip to main content",
    "terms of use", "use of cookies",
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_LINE_WORDS = 8
MAX_BOILER_WORDS = 40
MAX_LOST_PERCENT = 30


def _stage(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns behind a generator: later lambdas see them as computed values."""
    row = F.struct(*[v.alias(k) for k, v in cols.items()])
    return df.select("*", F.inline(F.array(row)))


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def covered(positions: Column, width: int = 3) -> Column:
    """Number of positions covered by windows of ``width`` that start at the sorted ``positions``."""
    n = F.size(positions)
    nxt = F.slice(positions, 2, F.greatest(n - 1, F.lit(0)))
    steps = F.zip_with(positions, nxt, lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


def line_fails(text: Column, n: Column, symbols: Column, nav_pipes: int = 3, nav_share: float = 0.2,
               symbol_share: float = 0.1, min_line_words: int = MIN_LINE_WORDS,
               max_boiler_words: int = MAX_BOILER_WORDS) -> Column:
    """True for a line (its text and number of words) that some rule rejects; ``symbols`` are those of its document."""
    marks = F.regexp_count(text, F.lit(SYMBOL_RE))
    pipes = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("|"), F.lit("")))
    marked = F.when(symbols == 0, F.lit(False)).otherwise(  # most documents have none
        (marks > F.length(text) * symbol_share) | ((pipes >= nav_pipes) & (pipes >= n * nav_share)))
    low = F.lower(text)
    boiler = F.contains(low, F.lit(BOILERPLATE[0]))
    for phrase in BOILERPLATE[1:]:
        boiler = boiler | F.contains(low, F.lit(phrase))
    unpunctuated = n >= min_line_words
    for mark in SENTENCE_MARKS:
        unpunctuated = unpunctuated & ~F.contains(text, F.lit(mark))
    return (n > 0) & (marked | unpunctuated | ((n <= max_boiler_words) & boiler))


def judged(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
           max_lost_percent: int = MAX_LOST_PERCENT, min_line_words: int = MIN_LINE_WORDS,
           with_text: bool = False) -> DataFrame:
    """(doc_id, counts, base_failed, kept, lost_words) for each row of ``docs`` (doc_id, text).

    ``with_text`` adds ``cleaned``, the text without its failed lines.
    """
    d = columns_of(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    d = _stage(d, rows=F.split("text", "\n"),
               n_symbols=F.when(F.rlike("text", F.lit(SYMBOL_RE)), F.regexp_count("text", F.lit(SYMBOL_RE)))
               .otherwise(0).cast("long"))
    d = _stage(d, line_words=F.transform("rows", _words))
    d = _stage(d, words=F.flatten("line_words"), n_line=F.transform("line_words", F.size))
    windows = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))),
                          lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    failed = F.transform(F.arrays_zip(F.col("rows").alias("t"), F.col("n_line").alias("n")),
                         lambda x: line_fails(x["t"], x["n"], F.col("n_symbols"), min_line_words=min_line_words))
    d = _stage(d.drop("line_words"), n_words=F.size("words").cast("long"), windows=windows, failed=failed,
               word_chars=F.length(F.array_join("words", "")).cast("long"),
               full=F.filter("rows", lambda t, i: F.get("n_line", i) > 0),
               # a power of two above the number of words: a hash's low bits make room for the position
               room=F.pow(F.lit(2.0), F.ceil(F.log2(F.size("words") + F.lit(2.0)))).cast("long"))
    # most texts have no window twice and are done here
    keys = F.when(F.size(F.array_distinct("windows")) < F.size("windows"),
                  F.sort_array(F.transform("windows", lambda h, i: _window(h) + i)))
    d = _stage(d.drop("words"), keys=F.coalesce(keys, F.array().cast("array<bigint>")))
    twice = F.filter("keys", lambda k, i: (_window(k) == _window(F.get("keys", i + 1))) | (_window(k) == _window(F.get("keys", i - 1))))
    d = _stage(d.drop("windows"), repeats=F.sort_array(F.transform(twice, lambda k: F.pmod(k, F.col("room")))),
               n_dup_lines=(F.size("full") - F.size(F.array_distinct("full"))).cast("long"),
               lost_words=F.aggregate(F.zip_with("n_line", "failed", lambda n, f: F.when(f, n).otherwise(0)),
                                      F.lit(0).cast("long"), lambda s, x: s + x))
    d = _stage(d, n_repeat_words=covered(F.col("repeats")))
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    cleaned = F.array_join(F.filter("rows", lambda t, i: ~F.get("failed", i)), "\n")
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
           (~base & (F.col("lost_words") * 100 <= F.col("n_words") * max_lost_percent)).alias("kept"), "lost_words"]
    return d.select(*out, *([cleaned.alias("cleaned")] if with_text else []))


def _window(key: Column) -> Column:
    return key - F.pmod(key, F.col("room"))


def rules_query(docs: DataFrame) -> DataFrame:
    return judged(docs)


_BOILER_SQL = " OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)

RULES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{WORD_RE}') AS words FROM d),
pos AS (SELECT rid, generate_subscripts(words, 1) AS i, unnest(words) AS a FROM w),
seq AS (SELECT rid, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM pos WINDOW o AS (PARTITION BY rid ORDER BY i)),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM seq WHERE c IS NOT NULL),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM win, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d),
lw AS (SELECT rid, l, regexp_extract_all(l, '{WORD_RE}') AS ws FROM ln),
lf AS (SELECT rid, l, len(ws) AS n,
              len(ws) > 0 AND ((length(l) - length(replace(l, '|', '')) >= 3
                AND length(l) - length(replace(l, '|', '')) >= len(ws) * 0.2)
               OR length(l) - length(translate(l, '#*$%&|<>', '')) > length(l) * 0.1
               OR (len(ws) <= {MAX_BOILER_WORDS} AND ({_BOILER_SQL}))
               OR (len(ws) >= {MIN_LINE_WORDS} AND length(l) = length(translate(l, '.!?:;…', '')))) AS failed
       FROM lw),
la AS (SELECT rid, sum(CASE WHEN failed THEN n ELSE 0 END)::BIGINT AS lost_words,
              count(*) FILTER (n > 0) - count(DISTINCT l) FILTER (n > 0) AS n_dup_lines FROM lf GROUP BY rid),
a AS (SELECT w.rid, w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             la.n_dup_lines::BIGINT AS n_dup_lines, coalesce(rep.n_repeat_words, 0)::BIGINT AS n_repeat_words, la.lost_words
      FROM w LEFT JOIN rep USING (rid) LEFT JOIN la USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM a)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost_words * 100 <= n_words * {MAX_LOST_PERCENT} AS kept, lost_words
FROM b
"""
