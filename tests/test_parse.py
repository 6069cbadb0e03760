"""Answer parsing (C4, C5) and logits (C1, C2) against a plain statement of the rules."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from quillspark.functions.parse import (
    argmax_class, chat_answer, max_logit_confidence, parse_chat, parse_completion,
)
from quillspark.sources.fixtures import LOGITS
from tests.conftest import one_col


MARKER = "RĂSPUNS:"


def rule_completion(output, c0, c1):
    """C4 as specified: a contained class in the row's order wins, otherwise the
    first whitespace-separated word ("-1" for empty text); only letters count."""
    if c0 in output:
        word = c0
    elif c1 in output:
        word = c1
    elif output == "":
        word = "-1"
    elif not output.strip():
        return -1  # blank but not empty: the original errors here and falls back to -1
    else:
        word = re.match(r"\s*(\S+)", output).group(1)
    letters = "".join(ch for ch in word if ch.isalpha())
    if "factual" in letters:
        return 0
    return 1 if "satiră" in letters else -1


def rule_chat(output, c0, c1):
    """C5 as specified: slice at the marker's place in the upper-cased text, then the part after the first ':' up to
    the next ':' or newline, trimmed; the whole trimmed output if that fails. A missing marker slices the last character."""
    at = output.upper().find(MARKER)
    parts = (output[at:] if at >= 0 else output[-1:]).split(":")
    answer = parts[1].split("\n")[0].strip() if len(parts) > 1 else output.strip()
    return rule_completion(answer.lower(), c0, c1)


FIXTURE_CASES = [
    ("", -1), ("RĂSPUNS: satiră", 1), ("răspuns: Factual\nExplicație: nu", 0), ("RASPUNS: factual", 0),
    ("Cred că este Satiră.", 1), ("nu știu:", -1), ("RĂSPUNS: sati-ră", 1),
    ("RĂSPUNS: factual sau satiră", 0), ("RĂSPUNS: satiră sau factual", 0), ("   ", -1),
    ("RĂSPUNS:\tfactual\n", 0), ("x RĂSPUNS:  satiră ", 1),
]


def test_fixture_answers(spark):
    df = spark.createDataFrame(FIXTURE_CASES, "o string, want int")
    got = df.select("o", "want", parse_chat("o").alias("p")).collect()
    for r in got:
        assert r.p == r.want, r
        assert r.p == rule_chat(r.o, "factual", "satiră")


def test_class_order_decides_when_both_present(spark):
    df = one_col(spark, ["RĂSPUNS: factual sau satiră"], "o")
    fwd = df.select(parse_chat("o", "factual", "satiră")).first()[0]
    rev = df.select(parse_chat("o", "satiră", "factual")).first()[0]
    assert (fwd, rev) == (0, 1)


def test_null_output_is_invalid(spark):
    df = spark.createDataFrame([(None,)], "o string")
    assert df.select(parse_chat("o")).first()[0] == -1


_ALPHABET = st.sampled_from(list("abcfturăsiţșRĂSPUN: \n\t.-,?!") + ["factual", "satiră", "RĂSPUNS:", " ", " "])


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.lists(st.lists(_ALPHABET, max_size=12).map("".join), min_size=20, max_size=20), st.booleans())
def test_chat_rule_property(spark, outputs, swapped):
    c0, c1 = ("satiră", "factual") if swapped else ("factual", "satiră")
    df = spark.createDataFrame([(o,) for o in outputs], "o string")
    got = [r[0] for r in df.select(parse_chat("o", c0, c1)).collect()]
    want = [rule_chat(o, c0, c1) for o in outputs]
    assert got == want


@settings(max_examples=40, deadline=None, derandomize=True)
@given(st.lists(st.lists(_ALPHABET, max_size=10).map("".join), min_size=20, max_size=20))
def test_completion_rule_property(spark, outputs):
    df = spark.createDataFrame([(o,) for o in outputs], "o string")
    got = [r[0] for r in df.select(parse_completion("o")).collect()]
    assert got == [rule_completion(o, "factual", "satiră") for o in outputs]


def test_answer_text_staged(spark):
    df = one_col(spark, ["Raspuns? RĂSPUNS:  Satiră  :extra", "fără marcaj:"], "o")
    assert [r[0] for r in df.select(chat_answer("o")).collect()] == ["satiră", ""]


def test_logits(spark):
    df = spark.createDataFrame(LOGITS, "id int, logits array<double>")
    rows = {r.id: (r.c, r.m) for r in df.select("id", argmax_class("logits").alias("c"),
                                                 max_logit_confidence("logits").alias("m")).collect()}
    assert rows[1] == (1, 0.9)
    assert rows[2] == (0, 0.7)          # tie: first
    assert rows[3] == (None, 0.0)       # empty
    assert rows[4] == (1, -0.5)         # all negative
    assert rows[5][0] == 0
