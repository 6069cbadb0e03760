import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import trie_codes as T

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """Result rows by plain loops over Python integers."""
    kept = [(i, [math.floor(float(np.float32(x)) * 4096) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0]))
    w = len(kept[0][1]) // 8
    part = {i: [v[p * w:(p + 1) * w] for p in range(8)] for i, v, _ in kept}
    books = [[list(part[i][p]) for i, _, _ in kept[:16]] for p in range(8)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(6):
        new = []
        for p, book in enumerate(books):
            members = {}
            for i, _, _ in kept:
                members.setdefault(near(part[i][p], book)[1], []).append(part[i][p])
            new.append([[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else book[e] for e in range(len(book))])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = {i: [near(part[i][p], books[p]) for p in range(8)] for i, _, _ in kept}
    error = {i: sum(f for f, _ in s) for i, s in found.items()}
    total = {}
    for i, _, label in kept:
        total[label] = total.get(label, 0) + error[i]
    return sorted((i, "".join(f"{e:02x}" for _, e in found[i]), error[i], total[label], digest) for i, _, label in kept)


def vectors(n, dim=16, seed=1):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(9)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [round(x + rng.gauss(0, 0.1), rng.choice([1, 6])) for x in c]
        rows.append((i * 3 + 1, v, rng.choice([None, 0, 1, 5])))
    return rows


def result(df):
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_equals_brute_force(spark):
    rows = vectors(300)
    rows += [(1000 + i, rows[i % 7][1], 5) for i in range(60)]  # copies are one weighted part
    random.Random(2).shuffle(rows)
    assert result(T.code_query(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_dropped_rows_and_few_vectors(spark):
    good = vectors(9)
    bad = [(0, None, 1), (-5, [float("nan")] * 16, 1), (-4, [None] + [0.5] * 15, 1), (-3, [float("inf")] + [0.0] * 15, 0),
           (-2, [0.5] * 24, 0), (-1, [0.5] * 3, 0), (-7, [], 0)]
    df = spark.createDataFrame(good + bad, SCHEMA).withColumns({"p": F.lit("x"), "part": F.lit(1), "v": F.lit(2), "code": F.lit(0), "of": F.lit(1)})
    assert result(T.code_query(df)) == brute(good)  # fewer entries than 16


def test_edges(spark):
    assert T.code_query(spark.createDataFrame([], SCHEMA)).collect() == []
    assert T.code_query(spark.createDataFrame([(1, None, 2)], SCHEMA)).collect() == []
    same = [(None if i < 3 else 4, [0.25] * 8, None) for i in range(8)]  # null and repeated ids
    out = T.code_query(spark.createDataFrame(same, SCHEMA)).collect()
    assert len(out) == 8 and {(r.code, r.error, r.label_error) for r in out} == {("00" * 8, 0, 0)}
    huge = [(i, [3e38 if i % 2 else -3e38] * 8, 1) for i in range(6)]  # counts as the limit
    assert {r.error for r in T.code_query(spark.createDataFrame(huge, SCHEMA)).collect()} == {0}
    no_label = T.code_query(spark.createDataFrame(vectors(20), SCHEMA).drop("label")).collect()
    assert len({r.label_error for r in no_label}) == 1


def test_trie_is_exact_over_blocks(monkeypatch):
    """Shared prefixes, copies, ties and blocks of any size give what all distances give."""
    rng = np.random.default_rng(3)
    parts = rng.integers(-3, 4, size=(500, 5)).astype(np.int64)
    entries = rng.integers(-3, 4, size=(16, 5)).astype(np.int64)
    entries[7] = entries[2]
    far = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    for block in (1, 7, 64, 4096):
        monkeypatch.setattr(T, "BLOCK", block)
        index, got = T.nearest(parts, entries)
        assert (index == far.argmin(axis=1)).all() and (got == far.min(axis=1)).all()


def test_prefixes_are_computed_once():
    parts = np.array([[1, 2, 3], [1, 2, 3], [1, 2, 4], [1, 5, 0], [2, 0, 0]], dtype=np.int64)
    trie = T.Trie(np.zeros((2, 3), dtype=np.int64))
    trie.leaves(parts[:2])
    assert trie.path[:, 0].tolist() == [1, 5, 14]  # the open path is carried on
    index, far = trie.leaves(parts[2:])
    assert far.tolist() == [21, 26, 4] and index.tolist() == [0, 0, 0]
