import itertools
import zlib

import numpy as np
import pytest

from quillspark.llm import lang_crf as L
from quillspark.sources.tables import read_table

SMALL = "/root/testdata/sf0.01"


def random_crf(k, seed):
    crf = L.Crf([f"l{i}" for i in range(k)], {"b": 1})
    rng = np.random.default_rng(seed)
    for q in crf.p:
        crf.p[q] = rng.normal(0, 1, crf.p[q].shape)
    return crf


def test_forward_backward_equals_all_labelings():
    crf = random_crf(3, 1)
    rng = np.random.default_rng(2)
    lengths = np.array([3, 1, 5, 2])
    em = rng.normal(0, 1, (6, 3))
    code = rng.integers(0, 6, lengths.sum())
    post, expected = crf.forward_backward(em, code, lengths, pairs=True)
    want, trans, at = [], np.zeros((3, 3)), 0
    for n in lengths:
        total, marginal = 0.0, np.zeros((n, 3))
        pair = np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=int(n)):
            s = crf.p["start"][y[0]] + sum(em[code[at + t]][y[t]] for t in range(n)) + sum(crf.p["trans"][a, b] for a, b in zip(y, y[1:]))
            w = np.exp(s)
            total += w
            for t in range(n):
                marginal[t, y[t]] += w
            for a, b in zip(y, y[1:]):
                pair[a, b] += w
        want.append(marginal / total)
        trans += pair / total
        at += n
    assert post == pytest.approx(np.concatenate(want))
    assert expected == pytest.approx(trans)


def test_emissions_do_not_depend_on_the_batch():
    crf = random_crf(2, 3)
    words = ["a", "b", "straße", "ñandú", "x" * 50]
    together = crf.emissions(crf.features(words))
    alone = np.concatenate([crf.emissions(crf.features([w])) for w in words])
    assert together == pytest.approx(alone)
    assert crf.remembered(words[::-1]) == pytest.approx(together[::-1], abs=1e-4)
    assert crf.remembered(words) == pytest.approx(together, abs=1e-4)


def test_words_in_code_switched_text():
    sample = [("en", "the cat and the dog with the house that thing\n" * 6), ("de", "der hund und die katze mit dem haus nicht das\n" * 6)] * 3
    crf = L.Crf.fit(sample, steps=40)
    chains, _, post = crf.label(["the cat with the dog und die katze mit dem hund"])
    words = [w for c in chains[0] for w in c]
    assert [crf.langs[int(p.argmax())] for p in post] == ["en"] * 5 + ["de"] * 6 and len(words) == 11


def test_held_out_accuracy_and_columns(spark):
    docs = read_table(spark, SMALL, "documents")
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = L.language_query(docs).collect()
    assert len(got) == len(langs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.97


def test_edges(spark, table):
    docs = table([(1, None, "en"), (2, "", None), (3, "123 !?", "en"), (None, "the cat", "en"), (4, "der hund " * 60_000, "de"),
                  (4, "the 𝓍 cat", "en"), (5, "the cat", "en"), (5, "the cat", "en")], "doc_id long, text string, lang string")
    got = {(r.doc_id, i): r for i, r in enumerate(L.language_query(docs).collect())}
    assert len(got) == 8
    assert all(r.lang_pred == "und" and r.score == 0 for (d, _), r in got.items() if d in (1, 2, 3))
    assert {r.lang_pred for (d, _), r in got.items() if d not in (1, 2, 3)} <= {"en", "de"}
    assert L.language_query(table([], "doc_id long, text string, lang string")).collect() == []
    unknown = table([(1, "the cat", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.language_query(unknown).collect()] == [("und", 0.0)]


def test_long_lines_are_chained_whole():
    text = "wort " * (3 * L.CHAIN + 7)
    assert [len(c) for c in L.words_of(text)] == [L.CHAIN] * 3 + [7]
