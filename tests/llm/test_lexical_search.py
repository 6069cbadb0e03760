import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=20):
    corpus = [(i, Counter(w)) for i, t in docs if (w := words(t))]
    n_docs, total = len(corpus), sum(sum(c.values()) for _, c in corpus)
    df = Counter(t for _, c in corpus for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in corpus:
            n = sum(c.values())
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in words(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "é1", "naïve", "x9", "ÄB", "漢字"] + [f"w{i}" for i in range(60)]
    docs = [(i, rng.choice([" ", "_", ", ", "\n"]).join(rng.choice([str.upper, str])(rng.choice(vocabulary)) for _ in range(rng.choice([0, 1, 5, 30, 200]))))
            for i in range(n)]
    docs += [(1000 + i, docs[i % 9][1]) for i in range(60)]  # ties
    items = [(i, " ".join(rng.choice(vocabulary + ["unseen"]) for _ in range(rng.choice([1, 3, 20])))) for i in range(12)]
    return docs, items


def result(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rule", [{}, {"items_a_block": 3, "tile_docs": 7, "tile_terms": 5}, {"terms_a_block": 20, "tile_docs": 1, "tile_terms": 1}])
def test_equals_brute_force(spark, table, rule):
    docs, items = corpus(5)
    got = S.ranked_search(table(docs).repartition(6), table(items, "item_id long, text string"), **rule)
    assert result(got) == brute(docs, items)


def test_edges(spark, table):
    docs = [(None, "alpha beta"), (None, "Alpha Beta"), (1, None), (2, ""), (3, "-- !?"), (4, "alpha beta"), (4, "alpha beta"), (5, "gamma"),
            (6, "alpha " * 200_000), (7, "z" * 3_000_000 + " alpha")]
    items = [(1, "ALPHA"), (None, "beta beta"), (2, None), (3, ""), (4, "..."), (5, "absent"), (6, "alpha gamma" * 3)]
    items_df = table(items, "item_id long, text string").withColumns({"term": F.lit(1), "c": F.lit(1), "item": F.lit(2), "n": F.lit(1)})
    got = S.search_query(table(docs).withColumns({"tids": F.lit(1), "n": F.lit(2), "item": F.lit(0)}), items_df)
    assert result(got) == brute(docs, items)
    for d, i in (([], items), (docs, []), ([], []), ([(1, "--")], items)):
        assert S.search_query(table(d), table(i, "item_id long, text string")).collect() == []
    twice = S.search_query(table(docs), table([(1, "gamma"), (1, "gamma")], "item_id long, text string")).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in twice) == [(1, 1, 5), (1, 1, 5)]


def test_ties_at_the_cut_go_by_id(spark, table):
    docs = [(i, "same words here") for i in range(300)] + [(1000, "other")]
    random.Random(1).shuffle(docs)
    got = S.search_query(table(docs).repartition(7), table([(1, "words")], "item_id long, text string")).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == list(range(20))


def test_tiles_keep_sums_exact():
    """Every tile's sums stay below 2^53, whatever the weights, and the tiles add up to the weights."""
    rng = random.Random(8)
    weights = {(i, t): rng.choice([0, 1, 900, 10 ** 6, 10 ** 9, 3 * 10 ** 10, 10 ** 11]) for i in range(4) for t in range(30) if rng.random() < 0.7}
    tiles = S.weight_tiles([(i, t, w) for (i, t), w in weights.items()], 4, 30, tile_terms=8)
    total = Counter()
    for numbers, q in tiles:
        assert len(set(numbers.tolist())) == len(numbers) <= 8
        assert (q.sum(axis=1) * S.MOST_IMPACT < S.EXACT).all()
        for j, t in enumerate(numbers.tolist()):
            for i in range(4):
                total[i, t] += int(q[i, j])
    assert {k: v for k, v in total.items() if v} == {k: v for k, v in weights.items() if v}
    assert S.impacts(np.array([1]), np.array([10 ** 12]), 1, 1)[0] < S.MOST_IMPACT


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 5)
    text = "Ab cd-ef é9 " * 20 + "q" * 40 + " end"
    assert [t.decode() for piece in S.terms(text.encode()) for t in piece] == words(text)
