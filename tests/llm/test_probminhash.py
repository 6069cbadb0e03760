import random
import re

import numpy as np
import pytest

from quillspark.llm import probminhash as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(docs, threshold=0.8):
    """Smallest id of each document's class, by all pairs."""
    n = len(docs)
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [shingle_set(t) if t is not None else None for _, t in docs]
    for i in range(n):
        for j in range(i):
            if sets[i] is None or sets[j] is None:
                continue
            same = docs[i][1] == docs[j][1]
            if not same and sets[i] and sets[j]:
                inter = len(sets[i] & sets[j])
                same = inter / (len(sets[i]) + len(sets[j]) - inter) >= threshold
            if same:
                up[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        ids.setdefault(root(i), []).append(d)
    return {d: min(ids[root(i)]) for i, (d, _) in enumerate(docs)}


def mutated(rng, words, rate, vocabulary):
    return [rng.choice(vocabulary) if rng.random() < rate else w for w in words]


def corpus(seed, groups=6, size=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 160))]
        banner = [rng.choice(vocabulary) for _ in range(25)]
        texts = [base]
        for _ in range(size):
            src = rng.choice(texts)
            t = mutated(rng, src, rng.choice([0, 0.005, 0.01, 0.02, 0.04]), vocabulary)
            if rng.random() < 0.3:
                t = banner + t
            if rng.random() < 0.2:
                t = t[:int(len(t) * rng.uniform(0.7, 1))]
            texts.append(t)
        docs += [" ".join(t) for t in texts]
    docs += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(20)]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, table, seed):
    docs = corpus(seed)
    got = {r.doc_id: r.class_id for r in P.near_duplicates(table(docs)).collect()}
    assert got == brute_classes(docs)


def test_large_group_without_all_pairs(spark, table):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    docs = list(enumerate(" ".join(mutated(rng, base, rng.choice([0.005, 0.02, 0.03]), vocabulary)) for _ in range(150)))
    got = {r.doc_id: r.class_id for r in P.near_duplicates(table(docs)).collect()}
    assert got == brute_classes(docs)


def test_rounds_and_tasks_give_the_same_classes(spark, table, monkeypatch):
    """With no room in a task every bucket is refined round by round."""
    docs = corpus(4, groups=3, size=10)
    monkeypatch.setattr(P, "TASK_NODES", 2)
    assert {r.doc_id: r.class_id for r in P.near_duplicates(table(docs)).collect()} == brute_classes(docs)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    names = [bytes([i // 256, i % 256]) for i in range(400)]
    edges = [(names[i], names[i + 1]) for i in range(0, 60)] + [(names[i], names[100]) for i in range(101, 180)]
    edges += [(names[rng.randint(200, 399)], names[rng.randint(200, 399)]) for _ in range(110)]
    edges = [e for e in edges if e[0] != e[1]]
    rng.shuffle(edges)
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {bytes(r.node): bytes(r.label) for r in P.components(spark.createDataFrame(edges, "node binary, center binary")).collect()}
    nodes = {x for e in edges for x in e}
    assert {x: got.get(x, x) for x in nodes} == {x: root(x) for x in nodes}


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    h = P.mix64(np.arange(1, 301, dtype=np.uint64))
    a, b = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 300).astype(float)
    a[200:250], b[250:] = 0, 0
    exact = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(300) if a[i] > 0 and b[i] > 0)
    rows = np.repeat([0, 1], [int((a > 0).sum()), int((b > 0).sum())])
    sig = P.prob_minhash(np.concatenate([h[a > 0], h[b > 0]]), rows, np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03


def test_early_termination_is_exact():
    """Letting every process run on changes no register."""
    h = P.mix64(np.arange(1, 40, dtype=np.uint64))
    w = np.arange(1, 40, dtype=float)
    sig = P.prob_minhash(h, np.zeros(39, dtype=np.int64), w, 1, 64)
    best, win, time = np.full(64, np.inf), np.zeros(64, dtype=np.uint64), np.zeros(39)
    for n in range(1, 400):
        bits = P.mix64(h ^ P.mix64(np.full(1, 2 * n, dtype=np.uint64)))
        time = time - np.log(((bits >> np.uint64(11)).astype(float) + 1) * 2.0 ** -53) / w
        k = (P.mix64(bits ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(64)).astype(int)
        for i in range(39):
            if time[i] < best[k[i]]:
                best[k[i]], win[k[i]] = time[i], h[i]
    assert (sig[0] == win).all()


def test_edge_cases(spark, table):
    docs = [(1, None), (2, None), (3, ""), (4, ""), (5, "  "), (None, "one two"), (6, "one two"), (7, "one  two"),
            (8, "a b c d e f"), (8, "a b c d e f"), (9, "x" * 200_000), (10, "word " * 30_000)]
    rows = P.near_duplicates(table(docs)).collect()
    assert len(rows) == len(docs)
    cls = {}
    for r in rows:
        cls.setdefault(r.class_id, []).append(r.doc_id)
    assert cls[1] == [1] and cls[2] == [2] and sorted(cls[3]) == [3, 4] and cls[5] == [5]
    assert sorted(map(str, cls[6])) == ["6", "7", "None"] and cls[8] == [8, 8]
    kept = P.keep_one(table(docs))
    assert kept.columns == table(docs).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 5, 6, 8, 9, 10]))
    empty = table([])
    assert P.near_duplicates(empty).collect() == [] and P.keep_one(empty).collect() == []


def test_repeated_lines_do_not_hide_equal_shingle_sets(spark, table):
    """Equal sets of shingles, of which one text of each pair holds some many times: plain Jaccard at least 0.8, probability Jaccard far below."""
    docs = []
    for i in range(12):
        body = " ".join(f"d{i}w{k}" for k in range(100))
        footer = " ".join(f"d{i}f{k}" for k in range(15))
        docs += [(2 * i, f"{body} {footer} {footer}"), (2 * i + 1, f"{body} " + " ".join([footer] * 1000))]
    got = {r.doc_id: (r.class_id, r.class_size) for r in P.near_duplicates(table(docs)).collect()}
    assert got == {d: (d - d % 2, 2) for d, _ in docs}


def edited_copies(rng, words, n, most, choices):
    """Copies in which some words are replaced, each by one of few others, so that copies share edits."""
    for _ in range(n):
        t = list(words)
        for p in rng.sample(range(len(t)), rng.randint(1, most)):
            t[p] = f"{t[p]}e{rng.randrange(choices)}"
        yield " ".join(t)


def test_large_bucket_takes_one_step(spark, table, monkeypatch):
    """A bucket of many times what a task may hold, of copies that share their edits, takes no rounds, and its classes are exact."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(130)]
    docs = list(enumerate({" ".join(words), *edited_copies(rng, words, 120, 7, 2)}))
    steps, written = [], P.written
    monkeypatch.setattr(P, "written", lambda spark, df, name: steps.append(name) or written(spark, df, name))
    monkeypatch.setattr(P, "TASK_NODES", 16)
    found = P.links(table(docs)).count()
    assert found and len(steps) <= 10, steps
    got = {r.doc_id: r.class_id for r in P.near_duplicates(table(docs)).collect()}
    assert got == brute_classes(docs) and len(set(got.values())) > 5


def test_blocks_bring_all_members_together(spark, monkeypatch):
    """Any two members of a large bucket share a task, unless both are linked to the center; no task holds much more than it may."""
    monkeypatch.setattr(P, "TASK_NODES", 20)
    monkeypatch.setattr(P, "TASK_SHINGLES", 600)
    rows = [(k, bytes([k, i]), bytes([k, 0]), 100, 2, 90, [100 * k + i + j for j in range(3 + i % 30)], i % 3 == 0)
            for k, size in enumerate((8, 60, 150)) for i in range(size)]
    d = spark.createDataFrame(rows, "key long, node binary, center binary, n long, lack long, reference long, diff array<bigint>, linked boolean")
    tasks = {}
    for r in P._blocks(d).collect():
        tasks.setdefault(r.key, {})[bytes(r.node)] = len(r.diff)
    together = {frozenset((a, b)) for t in tasks.values() for a in t for b in t if a < b}
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[1] < y[1]:
                assert frozenset((x[1], y[1])) in together or (x[7] and y[7])
    assert all(len({n[0] for n in t}) == 1 for t in tasks.values())
    assert max(len(t) for t in tasks.values()) <= 40 and max(sum(t.values()) for t in tasks.values()) <= 1200


@pytest.mark.parametrize("seed", range(4))
def test_links_by_differences_equal_all_pairs(seed):
    """Whatever the reference, and with the members linked to one of them in a class from the start."""
    rng = np.random.default_rng(seed)

    def similar(a, b):
        inter = len(np.intersect1d(a, b))
        return inter / (len(a) + len(b) - inter) >= 0.8

    def classes(pairs, n):
        label = np.arange(n)
        for a, b in pairs:
            label[label == label[a]] = label[b]
        return {frozenset(np.flatnonzero(label == x).tolist()) for x in label}

    for _ in range(40):
        bases = [rng.integers(0, 1 << 60, rng.integers(3, 60)).astype(np.uint64) for _ in range(rng.integers(1, 4))]
        sets = []
        for _ in range(rng.integers(2, 40)):
            x = bases[rng.integers(len(bases))].copy()
            out = rng.random(len(x)) < rng.choice([0, 0.03, 0.08, 0.15, 0.4])
            x[out] = rng.integers(0, 40, out.sum())
            sets.append(np.unique(x))
        n, size = len(sets), np.array([len(x) for x in sets])
        exact = classes([(i, j) for i in range(n) for j in range(i) if similar(sets[i], sets[j])], n)
        assert classes(P.links_within(sets, 0.8), n) == exact
        reference, center = np.unique(rng.choice(np.concatenate(sets), 20)), rng.integers(n)
        linked = np.array([similar(x, sets[center]) for x in sets])
        found = P.links_by_difference([np.setxor1d(x, reference) for x in sets], size, np.array([len(np.setdiff1d(reference, x)) for x in sets]),
                                      len(reference), linked, 0.8)
        assert classes([*found, *((i, center) for i in np.flatnonzero(linked))], n) == exact
