import zlib

import numpy as np
import pytest

from quillspark.llm import quality_cnn as Q
from quillspark.sources.tables import read_table

SMALL = "/root/testdata/sf0.01"


def as_bytes(text):
    return np.frombuffer(text.encode(), dtype=np.uint8)


def plain_score(net, text):
    """The network by loops over positions and chunks."""
    data = np.concatenate([as_bytes(text), np.zeros(2 * Q.WIDTH, dtype=np.uint8)])
    t = net.tables()
    n = max(1, len(text.encode()))
    z = np.array([sum(t[k][data[p + k]] for k in range(Q.WIDTH)) for p in range(n)])
    pooled, at = [], 0
    while True:
        pooled.append(z[at:at + Q.CHUNK].max(axis=0))
        if at + Q.CHUNK >= n:
            break
        at += Q.HOP * Q.BLOCK
    act = np.maximum(np.array(pooled) + net.p["bias"], 0)
    v = np.concatenate([act.mean(axis=0), act.max(axis=0)]) @ net.p["out"] + net.p["out_bias"][0]
    return 1 / (1 + np.exp(-v))


def test_scores_equal_plain_convolution():
    net = Q.ByteCnn(np.random.default_rng(4))
    rng = np.random.default_rng(1)
    texts = ["", "a", "é" * 70, "x" * Q.BLOCK, "y" * (Q.CHUNK + 1)] + ["".join(map(chr, rng.integers(32, 400, n))) for n in (5, 127, 129, 1024, 2500, 5000)]
    got = net.score([as_bytes(t) for t in texts])
    assert got == pytest.approx([plain_score(net, t) for t in texts], abs=1e-5)
    alone = [net.score([as_bytes(t)])[0] for t in texts]
    assert got == pytest.approx(alone, abs=1e-6)  # neighbours in a batch do not matter


def test_gradients_equal_differences():
    net = Q.ByteCnn(np.random.default_rng(2))
    texts = [as_bytes(t) for t in ("some text", "other words here", "z" * 1500, "")]
    y, w = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])
    _, g = net.gradients(texts, y, w)
    rng = np.random.default_rng(0)
    for name in net.p:
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in net.p[name].shape)
            old = net.p[name][at]
            net.p[name][at] = old + 1e-5
            up = net.gradients(texts, y, w)[0]
            net.p[name][at] = old - 1e-5
            down = net.gradients(texts, y, w)[0]
            net.p[name][at] = old
            assert g[name][at] == pytest.approx((up - down) / 2e-5, abs=2e-3)


def test_held_out_accuracy_and_columns(spark):
    docs, labels = read_table(spark, SMALL, "documents"), read_table(spark, SMALL, "labels")
    got = {r.doc_id: r for r in Q.quality_query(docs, labels).collect()}
    assert len(got) == docs.count()
    right, n = 0, 0
    for r in labels.collect():
        x = got[r.doc_id]
        assert x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3)
        if x.held_out:
            n += 1
            right += x.predicted == r.quality
    assert right / n > 0.9


def test_edges(spark, table):
    docs = table([(1, None), (2, ""), (None, "text"), (3, "text"), (3, "text"), (4, "long " * 100_000)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    net = Q.train_quality(docs, labels)
    got = Q.score_documents(docs, net).collect()
    assert [r.score for r in got] == [0.5] * 6
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 0), (4, 1, 1), (None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.score_documents(docs, Q.train_quality(docs, one)).collect()} == {1.0}
    net = Q.ByteCnn(np.random.default_rng(1))
    rows = {str(r.doc_id) + str(i): r.score for i, r in enumerate(Q.score_documents(docs, net).collect())}
    assert rows["10"] == rows["21"]  # null is scored like an empty text
    kept = Q.keep_quality(docs, net, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == 6
    assert Q.score_documents(table([]), net).collect() == [] and Q.keep_quality(table([]), net).collect() == []
