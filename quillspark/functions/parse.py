"""Turning free-text answers and logits into classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.constants import ANSWER_MARKER, CLASS_0, CLASS_1, INVALID
from quillspark.functions.text import FIRST_WORD_RE, py_strip


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- logits (C1-C3) -------------------------------------------------------------

def argmax_class(logits: Column | str) -> Column:
    """0-based index of the largest logit, first of ties; null when empty."""
    lg = _c(logits)
    return F.when(F.size(lg) > 0, (F.array_position(lg, F.array_max(lg)) - 1).cast("int"))


def max_logit_confidence(logits: Column | str) -> Column:
    """The largest logit (not a probability), 0.0 when empty."""
    return F.coalesce(F.array_max(_c(logits)), F.lit(0.0)).cast("double")


def logits_text(logits: Column | str) -> Column:
    """Logits as JSON text."""
    return F.to_json(_c(logits))


# --- answers (C4, C5) -----------------------------------------------------------

def class_from_answer(answer: Column | str, class0: Column | str = CLASS_0, class1: Column | str = CLASS_1) -> Column:
    """C4 on an answer string.

    Pick the first of (class0, class1) contained in the answer, else its first
    whitespace-delimited word ("-1" when empty); keep letters only; then
    'factual' -> 0, 'satiră' -> 1, anything else -> -1. Case-sensitive.
    """
    a = _c(answer)
    c0, c1 = _lit(class0), _lit(class1)
    picked = (
        F.when(F.contains(a, c0), c0)
        .when(F.contains(a, c1), c1)
        .when(a == "", F.lit("-1"))
        .otherwise(F.regexp_extract(a, FIRST_WORD_RE, 1))
    )
    letters = F.regexp_replace(picked, r"[^\p{L}]", "")
    return (
        F.when(a.isNull(), F.lit(INVALID))
        .when(F.contains(letters, F.lit(CLASS_0)), F.lit(0))
        .when(F.contains(letters, F.lit(CLASS_1)), F.lit(1))
        .otherwise(F.lit(INVALID))
        .cast("int")
    )


def chat_answer(output: Column | str) -> Column:
    """The answer text of a chat output (first step of C5), lower-cased.

    With ``RĂSPUNS:`` found in the upper-cased output, the output is cut from
    that position, and the answer is what stands between its first and second
    ':', up to the newline, stripped. Upper-casing may lengthen the text, so
    the cut can fall behind the marker; with no ':' left the whole output
    stripped is the answer. With no marker it is the whole output stripped
    too, except that an output ending in ':' gives ''.
    """
    o = _c(output)
    pos = F.locate(ANSWER_MARKER, F.upper(o))
    cut = F.substr(o, F.greatest(pos, F.lit(1)))
    colon = F.locate(":", cut)
    found = F.substring_index(F.substring_index(F.substr(cut, colon + 1), ":", 1), "\n", 1)
    answer = (
        F.when((pos > 0) & (colon > 0), py_strip(found))
        .when((pos == 0) & F.endswith(o, F.lit(":")), F.lit(""))
        .otherwise(py_strip(o))
    )
    return F.lower(answer)


def parse_completion(output: Column | str, class0: Column | str = CLASS_0, class1: Column | str = CLASS_1) -> Column:
    """C4: class of a completion-style output."""
    return class_from_answer(output, class0, class1)


def parse_chat(output: Column | str, class0: Column | str = CLASS_0, class1: Column | str = CLASS_1) -> Column:
    """Class of a chat-style output. Stage ``chat_answer`` with withColumn
    when the answer is also needed, so the regexes run once."""
    return class_from_answer(chat_answer(output), class0, class1)
