"""The trie path of T2 against the other paths and against a brute-force matcher."""

import random
import time

import pytest
import regex

from quillspark.functions.text import TOKEN_RE
from quillspark.operators.entities import SPAN_TYPE, with_entities
from quillspark.operators.gazetteer_trie import add_entity_spans_trie, gazetteer_trie
from quillspark.plans.preprocess import anonymize


def brute(text, surfaces):
    """Leftmost, then longest, over token n-grams; the corpus has no surface of more than 8 tokens."""
    toks = [m.span() for m in regex.finditer(TOKEN_RE, text or "")]
    cands = [(a, -(e - a), e, surfaces[text[a:e]]) for i, (a, _) in enumerate(toks) for _, e in toks[i:i + 8] if text[a:e] in surfaces]
    out, last = [], 0
    for a, _, e, lab in sorted(cands):
        if a >= last:
            out.append((a, e, lab))
            last = e
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    words = ["Ana", "ana", "Marin-Pop", "București", "d'Artagnan", "12", "<", ">", "𝔘nic", "é", "of"]
    seps = [" ", "  ", ", ", "\t", ". ", "-", "\n", " 🙂 "]

    def run(n):
        return "".join(w for _ in range(n) for w in (rng.choice(words), rng.choice(seps)))

    surfaces = {}
    for _ in range(150):
        t = run(rng.randint(1, 5))
        surfaces.setdefault(t if rng.random() < 0.2 else t.rstrip(" ,\t.-\n🙂"), rng.choice(["PERSON", "ORG", "GPE"]))
    surfaces.pop("", None)
    texts = [run(rng.randint(0, 30)) for _ in range(300)] + [None, "", "...", " Ana", "Ana ", run(1000)]
    return surfaces, texts


def with_trie(df, gaz):
    return add_entity_spans_trie(df.withColumn("i", df._toks), "sentence", gazetteer_trie(gaz), "entities", SPAN_TYPE).fillna({"i": 0})


def spans(df):
    return sorted(((r.i, [tuple(s) for s in r.entities]) for r in df.collect()), key=lambda x: x[0])


def test_trie_equals_brute_force_and_other_paths(spark, corpus):
    surfaces, texts = corpus
    gaz = spark.createDataFrame([*surfaces.items(), (None, "ORG"), ("of", None)], "surface string, label string")
    df = spark.createDataFrame(list(enumerate(texts)), "i long, sentence string").repartition(5)
    want = [(i, brute(t, surfaces)) for i, t in enumerate(texts)]
    assert sum(len(s) for _, s in want) > 500
    assert spans(with_entities(df, gaz, inline_max=0)) == want
    assert spans(with_entities(df, gaz)) == want
    assert spans(with_entities(df, gaz, inline_max=0, trie_max=0)) == want


def test_trie_is_map_only_up_to_its_bytes(spark, corpus):
    surfaces, texts = corpus
    gaz = spark.createDataFrame(list(surfaces.items()), "surface string, label string")
    df = spark.createDataFrame([(t,) for t in texts], "sentence string")

    def plan(**kw):
        return anonymize(df, gaz, inline_max=0, **kw)._jdf.queryExecution().executedPlan().toString()

    assert "Exchange" not in plan()
    assert "Exchange" in plan(trie_max=100)
    entries = gaz.groupBy("surface").agg({"label": "min"}).toDF("surface", "label")
    trie = gazetteer_trie(entries)
    least = sum(len(s.encode()) for s in trie.surfaces)
    assert gazetteer_trie(entries, least) is None and gazetteer_trie(entries, 100 * least) is not None


def test_empty_gazetteer_labels_of_a_repeated_surface_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "Ana Pop", "x"), (None, None, "y")], "_toks long, sentence string, _pieces string")
    none = spark.createDataFrame([], "surface string, label string")
    assert gazetteer_trie(none).depth == 0 and [s for _, s in spans(with_trie(df, none))] == [[], []]
    gaz = spark.createDataFrame([("Ana Pop", "PERSON"), ("Ana Pop", "GPE"), ("Ana", "ORG")], "surface string, label string")
    got = with_entities(df, gaz, inline_max=0)
    assert got.columns == ["_toks", "sentence", "_pieces", "entities"]
    assert {(r._toks, r._pieces, *map(tuple, r.entities)) for r in got.collect()} == {(1, "x", (0, 7, "GPE")), (None, "y")}


def test_trie_is_linear_in_hits(spark):
    gaz = spark.createDataFrame([("Orre", "PERSON")], "surface string, label string")

    def seconds(n):
        df = spark.createDataFrame([("Orre merge acasă " * n,)], "sentence string")
        t = time.perf_counter()
        assert anonymize(df, gaz, inline_max=0).first().sentence.count("<PERSON>") == n
        return time.perf_counter() - t

    seconds(1000)
    half, whole = min(seconds(20000) for _ in range(2)), min(seconds(40000) for _ in range(2))
    assert whole < 2.5 * half + 1
