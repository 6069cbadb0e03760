"""Ranked lexical search by dense blocked matrix multiplication.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A document's impact of a term grows with
its count and falls with the document's length; an item's weight of a term is its rarity times its repeats. Scores are the
product of two matrices: item weights by vocabulary, and vocabulary by document impacts. Both are cut into dense float64 tiles of
at most ``TERMS`` terms and ``DOCS`` documents and multiplied by BLAS. All entries are integers, and a vocabulary tile ends where an item's sum of weights
times the largest impact would reach 2^53, so each product is exact whatever the order of its additions; tiles add up in
64-bit integers. The best rows of a tile are chosen by score, then doc_id, so ties at the cut are decided by the ids alone.

Scale: the items are the stated query set. They come in blocks of about ``ITEMS`` items and ``BLOCK_TERMS`` terms, by a hash of the
item and counts; a block's terms are collected and broadcast (bounded by the block), and all documents are read once a block. That pass writes each document's
length and its counts of the block's terms, not its text. Corpus statistics (N, L, document frequencies) are aggregates over it;
the driver gets one number for each term of the block. The second pass multiplies; a task returns at most ``top`` rows an item, and these
are cut again by item and group of tasks (``GROUPS`` of them) before they meet by item, so an item's rows of all tasks never meet at once.

Edge cases: null and empty texts and texts without a term are no documents of the corpus and no items; a repeated document is ranked once for each of its
rows; a null doc_id ranks last among equal scores; items that repeat an item_id are ranked each for itself, equal rows too; empty tables give an empty result; very long texts
are cut into terms in pieces that end between terms; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import columns_of, written

TOP = 20
#: Terms and documents of a tile.
TERMS = 4096
DOCS = 512
#: Items and terms of a block, about.
ITEMS = 512
BLOCK_TERMS = 1 << 16
#: No impact reaches this: (10^9 * tf) div (1000 * tf + ...) < 10^6.
MOST_IMPACT = 10 ** 6
EXACT = 1 << 53
#: Groups of tasks whose best rows meet before all meet.
GROUPS = 64
#: Bytes cut into terms at a time.
PIECE = 1 << 20

_TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Lists of the terms of a text, in order; a long text gives several lists."""
    text = text.translate(_TERM_BYTES)
    at, n = 0, len(text)
    while at < n:
        cut = n if n - at <= PIECE else text.find(b" ", at + PIECE)
        cut = n if cut < 0 else cut
        yield text[at:cut].split()
        at = cut


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, c): the repeats of each term of each item; ``item`` is a number of its own for each row with a term."""
    import pyarrow as pa

    d = columns_of(items, "item_id", "text").where("text IS NOT NULL")
    d = written(items.sparkSession, d.withColumn("item", F.monotonically_increasing_id()), "items")
    kind = d.schema["item_id"].dataType.simpleString()

    def count(batches: Iterator) -> Iterator:
        for b in batches:
            rows, term, c = [], [], []
            for i, text in enumerate(b.column("text")):
                found: Counter = Counter()
                for piece in terms(text.as_py().encode("utf-8", "surrogatepass")):
                    found.update(piece)
                rows += [i] * len(found)
                term += found.keys()
                c += found.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("item").take(at), b.column("item_id").take(at), pa.array(term, pa.binary()),
                                              pa.array(c, pa.int64())], names=["item", "item_id", "term", "c"])

    return d.select("item", "item_id", "text").mapInArrow(count, f"item long, item_id {kind}, term binary, c long")


def term_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, tids, tfs) of every document with a term: its number of terms, and the counts of those of ``vocabulary``."""
    import pyarrow as pa

    d = columns_of(docs, "doc_id", "text").where("text IS NOT NULL")
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    kind = d.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator) -> Iterator:
        number = known.value
        for b in batches:
            rows, lengths, sizes, tids, tfs = [], [], [0], [], []
            for i, text in enumerate(b.column("text")):
                n, found = 0, Counter()
                for piece in terms(text.as_py().encode("utf-8", "surrogatepass")):
                    n += len(piece)
                    found.update(filter(number.__contains__, piece))
                if n:
                    rows.append(i)
                    lengths.append(n)
                    tids += map(number.__getitem__, found)
                    tfs += found.values()
                    sizes.append(len(tids))
            ends = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(tids, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))],
                names=["doc_id", "n", "tids", "tfs"])

    return d.mapInArrow(count, f"doc_id {kind}, n long, tids array<int>, tfs array<long>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def weight_tiles(entries: list[tuple[int, int, int]], n_items: int, n_terms: int, tile_terms: int = TERMS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(term numbers, dense item weights) of the vocabulary tiles; ``entries`` are (item, term, weight) with whole weights.

    In each tile every item's sum of weights stays below 2^53 / MOST_IMPACT. A weight beyond a quarter of that is spread over columns of
    a tile of their own for the same term, so a term stands once in a tile.
    """
    most = EXACT // MOST_IMPACT - 1
    columns: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for item, term, weight in entries:
        layer = 0
        while weight > 0:
            part = min(weight, most // 4)
            columns.setdefault((layer, term), []).append((item, part))
            weight, layer = weight - part, layer + 1
    tiles, now, load = [], [], np.zeros(n_items, dtype=np.int64)

    def close() -> None:
        q = np.zeros((n_items, len(now)))
        for j, (_, cells) in enumerate(now):
            for item, part in cells:
                q[item, j] = part
        tiles.append((np.array([t for t, _ in now], dtype=np.int64), q))

    at = 0
    for (layer, term), cells in sorted(columns.items()):
        if now and (layer > at or len(now) == tile_terms or any(load[i] + part > most for i, part in cells)):
            close()
            now, load = [], np.zeros(n_items, dtype=np.int64)
        at = layer
        now.append((term, cells))
        for i, part in cells:
            load[i] += part
    if now:
        close()
    return tiles


def impacts(n: np.ndarray, tf: np.ndarray, n_docs: int, n_terms_all: int) -> np.ndarray:
    m = 100 - 25 + (25 * n * n_docs) // n_terms_all
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def best_rows(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, top: int) -> np.ndarray:
    """Positions of the ``top`` highest positive scores, highest first, equal ones by id, rows without an id last."""
    at = np.flatnonzero(scores > 0)
    if len(at) > top:
        least = np.partition(scores[at], len(at) - top)[len(at) - top]
        at = at[scores[at] >= least]  # all ties at the cut
    return at[np.lexsort((ids[at], ~known[at], -scores[at]))][:top]


def block_scores(counts: DataFrame, tiles: list, n_items: int, n_docs: int, n_terms_all: int, top: int, tile_docs: int = DOCS) -> DataFrame:
    """(item, doc_id, score): for each item the best ``top`` documents of each task; ``item`` is the row of the weight tiles."""
    import pyarrow as pa
    from pyspark import TaskContext

    sent = counts.sparkSession.sparkContext.broadcast(tiles)
    kind = counts.schema["doc_id"].dataType.simpleString()

    def tile_scores(n: np.ndarray, doc: np.ndarray, tid: np.ndarray, tf: np.ndarray) -> np.ndarray:
        impact = impacts(n[doc], tf, n_docs, n_terms_all).astype(np.float64)
        scores = np.zeros((n_items, len(n)), dtype=np.int64)
        n_terms = int(tid.max()) + 1 if len(tid) else 0
        for numbers, weights in sent.value:
            place = np.full(max(n_terms, int(numbers.max()) + 1), -1)
            place[numbers] = np.arange(len(numbers))
            own = place[tid]
            here = own >= 0
            used, column = np.unique(own[here], return_inverse=True)  # the terms that the tile's documents hold
            dense = np.zeros((len(used), len(n)))
            dense[column, doc[here]] = impact[here]
            scores += (weights[:, used] @ dense).astype(np.int64)
        return scores

    def multiply(batches: Iterator) -> Iterator:
        part = TaskContext.get().partitionId()
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)) for _ in range(n_items)]
        for b in batches:
            doc_id = b.column("doc_id")
            known = np.asarray(doc_id.is_valid())
            ids = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
            n = b.column("n").to_numpy()
            size = b.column("tids").value_lengths().to_numpy()
            tid, tf = b.column("tids").flatten().to_numpy(), b.column("tfs").flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(size)])
            for lo in range(0, b.num_rows, tile_docs):
                hi = min(b.num_rows, lo + tile_docs)
                own = slice(ends[lo], ends[hi])
                doc = np.repeat(np.arange(hi - lo), size[lo:hi])
                scores = tile_scores(n[lo:hi], doc, tid[own], tf[own])
                for i, highest in enumerate(scores.max(axis=1).tolist()):
                    s, d, k = best[i]
                    if highest == 0 or len(s) == top and highest < s[-1]:
                        continue
                    new = best_rows(scores[i], ids[lo:hi], known[lo:hi], top)
                    s, d, k = np.append(s, scores[i][new]), np.append(d, ids[lo:hi][new]), np.append(k, known[lo:hi][new])
                    keep = best_rows(s, d, k, top)
                    best[i] = s[keep], d[keep], k[keep]
        rows = np.repeat(np.arange(n_items), [len(s) for s, _, _ in best])
        if len(rows):
            s, d, k = (np.concatenate(x) for x in zip(*best))
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(d, mask=~k).cast(counts_type), pa.array(s),
                                              pa.array(np.full(len(rows), part, dtype=np.int32))], names=["item", "doc_id", "score", "task"])

    counts_type = {"bigint": pa.int64(), "int": pa.int32()}[kind]
    return counts.mapInArrow(multiply, f"item int, doc_id {kind}, score long, task int")


def _top(d: DataFrame, top: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, items_a_block: int = ITEMS, terms_a_block: int = BLOCK_TERMS,
                  tile_terms: int = TERMS, tile_docs: int = DOCS) -> DataFrame:
    """(item, item_id, rank, doc_id, score) of the ``top`` documents with a score above 0 of each item; doc_id is an integer."""
    spark = docs.sparkSession
    queries = written(spark, item_terms(items), "item-terms")
    size = queries.agg(F.countDistinct("item").alias("items"), F.count(F.lit(1)).alias("terms")).first()
    blocks = max(1, -(-size.items // items_a_block), -(-size.terms // terms_a_block))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    out = None
    for k in range(blocks if size.items else 0):
        rows = queries.where(block == k).collect()  # about ITEMS items and BLOCK_TERMS terms
        if not rows:
            continue
        vocabulary = sorted({bytes(r.term) for r in rows})
        number = {t: i for i, t in enumerate(vocabulary)}
        item_ids = {r["item"]: r.item_id for r in rows}
        place = {item: i for i, item in enumerate(sorted(item_ids))}
        counts = written(spark, term_counts(docs, vocabulary), "term-counts")
        corpus = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("terms")).first()
        if not corpus.n:
            continue
        df = {r.t: r.n for r in counts.select(F.explode("tids").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
        entries = [(place[r["item"]], t, r.c * term_weight(corpus.n, df[t])) for r in rows if (t := number[bytes(r.term)]) in df]
        tiles = weight_tiles(entries, len(place), len(vocabulary), tile_terms)
        if not tiles:
            continue
        found = block_scores(counts, tiles, len(place), corpus.n, corpus.terms, top, tile_docs)
        found = _top(found.withColumn("group", F.pmod("task", F.lit(GROUPS))), top, "item", "group").drop("rank")
        found = _top(found, top, "item")
        names = spark.createDataFrame([(i, item, item_ids[item]) for item, i in place.items()],
                                      f"at int, number long, item_id {queries.schema['item_id'].dataType.simpleString()}")
        found = found.join(F.broadcast(names), F.col("item") == F.col("at")).select(  # at most a block's items
            F.col("number").alias("item"), "item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        kinds = [d.schema[c].dataType.simpleString() if c in d.columns else "bigint" for d, c in ((items, "item_id"), (docs, "doc_id"))]
        return spark.createDataFrame([], f"item long, item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    return out


def search_query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return ranked_search(docs, items).select("item_id", "rank", "doc_id", "score")


#: The same rows in DuckDB (item_id and doc_id are unique there).
SEARCH_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents WHERE text IS NOT NULL),
q AS (SELECT item_id, t, count(*) AS c FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
lens AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
corpus AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM lens),
tf AS (SELECT doc_id, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * (SELECT nd FROM corpus) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY t),
s AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))))::BIGINT AS score
      FROM q JOIN w USING (t) JOIN tf USING (t) JOIN lens USING (doc_id), corpus GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {TOP}
"""
