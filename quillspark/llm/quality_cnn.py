"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and convolved with ``FILTERS`` learned filters of ``WIDTH`` bytes at every position.
The responses are max-pooled over chunks of ``CHUNK`` bytes that overlap by ``BLOCK`` bytes and cover the whole
text, rectified, and combined over the chunks as mean and maximum into one logistic unit. The score is the
probability of label 1.

Training uses a bounded sample: of the labelled documents of the training folds, at most ``TRAIN_DOCS`` of each label,
by a hash of the id, and at most ``TRAIN_CHUNKS`` evenly spaced chunks of each. Scoring reads every byte. Embedding,
filters and combination are trained together by Adam; a chunk passes its gradient to the position that won each filter.

Scale: scoring is one pass, no shuffle; the model (some 20 kB, expanded per worker to tables over byte pairs) travels with the function. The
sample's ids are chosen from the labels alone and broadcast (at most 2 * TRAIN_DOCS ids), so no text is shuffled.

Edge cases: a null or empty text is scored like an empty string; if the sample holds only one label the score is that label;
with no labelled rows it is 0.5; repeated rows get equal scores; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import columns_of, fold, least_hashed, pieces, text_buffers

WIDTH = 8
DIMS = 8
FILTERS = 16
BLOCK = 128
BLOCKS_PER_CHUNK = 8
CHUNK = BLOCK * BLOCKS_PER_CHUNK
HOP = BLOCKS_PER_CHUNK - 1
TRAIN_DOCS = 1000
TRAIN_CHUNKS = 12
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
#: Positions whose responses are held at a time.
STEP = 1 << 15


def layout(texts: list[np.ndarray]):
    """One buffer in which every text starts at a block and is followed by at least WIDTH zero bytes; (bytes, first block, lengths)."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    blocks = (lengths + WIDTH + BLOCK - 1) // BLOCK
    first = np.concatenate([[0], np.cumsum(blocks)])
    data = np.zeros(int(first[-1]) * BLOCK + WIDTH, dtype=np.uint8)
    for t, b in zip(texts, first):
        data[b * BLOCK:b * BLOCK + len(t)] = t
    return data, first, lengths


def chunk_blocks(first: np.ndarray, lengths: np.ndarray):
    """(document, first block, end block) of every chunk; a text has one chunk at least."""
    used = np.maximum(1, -(-lengths // BLOCK))
    chunks = np.maximum(1, -(-(used - 1) // HOP))
    doc = np.repeat(np.arange(len(lengths)), chunks)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = first[:-1][doc] + nth * HOP
    return doc, start, np.minimum(start + BLOCKS_PER_CHUNK, (first[:-1] + used)[doc])


class ByteCnn:
    """Embedding, filters and the logistic unit over mean and maximum of the chunks' pooled responses."""

    def __init__(self, rng: np.random.Generator | None = None, constant: float | None = None):
        rng = rng or np.random.default_rng(0)
        self.constant = constant
        self.p = {
            "emb": rng.normal(0, 0.5, (256, DIMS)), "conv": rng.normal(0, 1 / np.sqrt(WIDTH * DIMS), (WIDTH, DIMS, FILTERS)),
            "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, 2 * FILTERS), "out_bias": np.zeros(1)}
        self._pairs = None

    def __getstate__(self):
        return {"constant": self.constant, "p": self.p, "_pairs": None}

    def tables(self) -> np.ndarray:
        """Response of every filter to every byte at every offset: (WIDTH, 256, FILTERS)."""
        return np.einsum("bd,kdf->kbf", self.p["emb"], self.p["conv"])

    # --- scoring ---

    def _block_maxima(self, data: np.ndarray, n_blocks: int, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if self._pairs is None:  # two neighbouring bytes at once: half the look-ups
            t = self.tables().astype(np.float32)
            self._pairs = [(t[k][None, :, :] + t[k + 1][:, None, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]
        pair = data[:-1].astype(np.int64) | (data[1:].astype(np.int64) << 8)
        out = np.empty((n_blocks, FILTERS), dtype=np.float32)
        live = np.zeros(n_blocks * BLOCK, dtype=bool)
        for a, n in zip(first[:-1], lengths):
            live[a * BLOCK:a * BLOCK + max(1, n)] = True
        for lo in range(0, n_blocks * BLOCK, STEP):
            hi = min(lo + STEP, n_blocks * BLOCK)
            z = np.take(self._pairs[0], pair[lo:hi], axis=0)
            for j in range(1, WIDTH // 2):
                z += np.take(self._pairs[j], pair[lo + 2 * j:hi + 2 * j], axis=0)
            if not live[lo:hi].all():
                z[~live[lo:hi]] = -np.inf
            out[lo // BLOCK:hi // BLOCK] = z.reshape(-1, BLOCK, FILTERS).max(axis=1)
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 for texts given as byte arrays."""
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant if self.constant is not None else 0.5)
        data, first, lengths = layout(texts)
        data = np.concatenate([data, np.zeros(WIDTH, dtype=np.uint8)])
        maxima = self._block_maxima(data, int(first[-1]), first, lengths)
        doc, start, end = chunk_blocks(first, lengths)
        padded = np.vstack([maxima, np.full((1, FILTERS), -np.inf, dtype=np.float32)])
        pooled = np.maximum.reduceat(padded, np.column_stack([start, end]).ravel(), axis=0)[::2]
        act = np.maximum(pooled + self.p["bias"], 0)
        at = np.searchsorted(doc, np.arange(len(texts)))
        counts = np.bincount(doc, minlength=len(texts))
        vec = np.hstack([np.add.reduceat(act, at, axis=0) / counts[:, None], np.maximum.reduceat(act, at, axis=0)])
        return 1 / (1 + np.exp(-np.clip(vec @ self.p["out"] + self.p["out_bias"], -30, 30)))

    # --- training ---

    def gradients(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray):
        """Loss and gradients of a mini-batch."""
        data, first, lengths = layout(texts)
        data = np.concatenate([data, np.zeros(WIDTH, dtype=np.uint8)])
        t = self.tables()
        n = int(first[-1]) * BLOCK
        t32 = t.astype(np.float32)
        z = t32[0][data[:n]]
        for k in range(1, WIDTH):
            z += t32[k][data[k:n + k]]
        live = np.zeros(n, dtype=bool)
        for a, m in zip(first[:-1], lengths):
            live[a * BLOCK:a * BLOCK + max(1, m)] = True
        z[~live] = -np.inf
        doc, start, end = chunk_blocks(first, lengths)
        best = np.empty((len(doc), FILTERS), dtype=np.int64)
        for c, (s, e) in enumerate(zip(start * BLOCK, end * BLOCK)):
            best[c] = s + z[s:e].argmax(axis=0)
        pooled = z[best, np.arange(FILTERS)].astype(np.float64) + self.p["bias"]
        act = np.maximum(pooled, 0)
        counts = np.bincount(doc, minlength=len(texts))
        at = np.searchsorted(doc, np.arange(len(texts)))
        mean = np.add.reduceat(act, at, axis=0) / counts[:, None]
        top = np.maximum.reduceat(act, at, axis=0)
        vec = np.hstack([mean, top])
        s = 1 / (1 + np.exp(-np.clip(vec @ self.p["out"] + self.p["out_bias"], -30, 30)))
        loss = -np.mean(weight * (y * np.log(s + 1e-9) + (1 - y) * np.log(1 - s + 1e-9)))
        err = weight * (s - y) / len(y)
        g = {"out": vec.T @ err, "out_bias": np.array([err.sum()])}
        back = err[:, None] * self.p["out"]
        d_act = (back[:, :FILTERS] / counts[:, None])[doc]
        d_act += np.where(act == top[doc], back[:, FILTERS:][doc], 0)
        d_act *= pooled > 0
        g["bias"] = d_act.sum(axis=0)
        d_t = np.zeros_like(t)
        for k in range(WIDTH):
            flat = data[best + k].astype(np.int64) * FILTERS + np.arange(FILTERS)
            d_t[k] = np.bincount(flat.ravel(), weights=d_act.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
        g["emb"] = np.einsum("kbf,kdf->bd", d_t, self.p["conv"])
        g["conv"] = np.einsum("kbf,bd->kdf", d_t, self.p["emb"])
        return loss, g

    @classmethod
    def fit(cls, texts: list[np.ndarray], labels, epochs: int = 12, batch: int = 50, rate: float = 0.01, l2: float = 1e-4, seed: int = 0):
        y = np.asarray(labels, dtype=np.float64)
        if len(y) == 0 or y.min() == y.max():
            return cls(constant=0.5 if len(y) == 0 else float(y[0]))
        rng = np.random.default_rng(seed)
        net = cls(rng)
        weight = np.ones(len(y))
        m = {k: np.zeros_like(v) for k, v in net.p.items()}
        v = {k: np.zeros_like(x) for k, x in net.p.items()}
        step, total = 0, epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                at = order[lo:lo + batch]
                _, g = net.gradients([texts[i] for i in at], y[at], weight[at])
                step += 1
                lr = rate * (1 - step / (total + 1))
                for k in net.p:
                    d = g[k] + l2 * net.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.99 * v[k] + 0.01 * d * d
                    net.p[k] = net.p[k] - lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
        return net


def spaced(text: bytes, chunks: int = TRAIN_CHUNKS) -> bytes:
    """At most ``chunks`` evenly spaced chunks of a text, for training."""
    if len(text) <= chunks * CHUNK:
        return text
    at = np.linspace(0, len(text) - CHUNK, chunks).astype(int)
    return b"".join(text[a:a + CHUNK] for a in at)


def training_sample(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> list[tuple[bytes, int]]:
    """At most ``train_docs`` (text, label) of each label, from training folds, by a hash of the id."""
    import pyarrow as pa

    known = (columns_of(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
             .where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")))
    ids = [least_hashed(known.where(F.col("quality") == y), "doc_id", train_docs).select(F.col("doc_id").alias("l_doc_id"), F.lit(y).alias("quality"))
           for y in (0, 1)]
    ids = ids[0].unionByName(ids[1])
    found = columns_of(docs, "doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("l_doc_id"))  # 2 * train_docs ids
    kind = found.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator) -> Iterator:
        for b in batches:
            text = [spaced((x or "").encode("utf-8", "replace")) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.binary()), b.column("quality")],
                                             names=["doc_id", "text", "quality"])

    rows = (found.select("doc_id", "text", "quality").mapInArrow(cut, f"doc_id {kind}, text binary, quality int")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")).collect())
    return sorted((bytes(r.text), int(r.quality)) for r in rows)


def train_quality(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, **fit_args) -> ByteCnn:
    sample = training_sample(docs, labels, train_docs)
    return ByteCnn.fit([np.frombuffer(t, dtype=np.uint8) for t, _ in sample], [y for _, y in sample], **fit_args)


def _score_column(model: ByteCnn, column) -> np.ndarray:
    raw, offsets, _ = text_buffers(column)
    out = [model.score([raw[offsets[i]:offsets[i + 1]] for i in range(a, b)]) for a, b in pieces(offsets)]
    return np.concatenate(out) if out else np.zeros(0)


def score_documents(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text)."""
    import pyarrow as pa

    d = columns_of(docs, "doc_id", "text").select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    kind = d.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator) -> Iterator:
        for b in batches:
            s = _score_column(model, b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return d.mapInArrow(scan, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, model: ByteCnn, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more; all columns pass through."""
    import pyarrow as pa

    @F.arrow_udf("double")
    def score(text):
        return pa.array(_score_column(model, text), pa.float64())

    return docs.where(score(F.col("text")) >= threshold)


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, train_quality(docs, labels))
