"""Vector code compression: product codes whose codebooks are fitted and assigned over a trie of distinct parts.

A vector becomes integers floor(4096 * x) and is cut into ``PARTS`` equal consecutive parts. Each part position has a codebook of at most
``ENTRIES`` entries, at first that part of the smallest kept vec_ids. A round gives every part the nearest entry (squared
Euclidean distance, ties to the lower index) and makes each used entry the componentwise floor of the mean of its parts.

Distances come from a lexicographic trie over the distinct parts. It is walked depth first, in blocks of leaves in order: a node's vector
of distances to all entries is that of its parent plus the squares of one more dimension, computed once for all leaves below; the
vectors on the open path are carried from block to block. Leaves take the lowest entry and add weight times part to the entry's sums.

Scale: equal parts are one weighted row after an aggregate that runs before the shuffle, so copies cost nothing, and a range
partitioning in lexicographic order gives each task a run of the trie. It is written once and read in every round; a
task returns one row for each entry and dimension that it met, and the driver gets the sums of the codebooks only (PARTS * ENTRIES * width numbers). The last
assignment walks tries of the parts of each record batch of the vectors, so codes need no join. Sums of errors by label are a small
written table, joined to the codes by an equi-join that adaptive execution splits where a label is hot.

Edge cases: null vectors and vectors with null or non-finite components are dropped, and so are those whose length is not the most
common one among lengths that PARTS divides (of equally common ones the larger); a null vec_id ranks last; a repeated vec_id gives one entry, of its
smallest vector, and all its rows get codes; with fewer than ENTRIES ids the codebooks are smaller; components beyond ``LIMIT`` (values beyond 32768)
count as ``LIMIT``, so that distances stay exact in 64 bits; an empty table gives an empty result; columns other than vec_id, the vector and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LIMIT = 1 << 27
#: Leaves of the trie handled at a time.
BLOCK = 4096


def integer_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of the rows whose vector is whole and finite; ``v`` is an array of integers."""
    x = F.col(f"`{column}`")
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def integer(c: Column) -> Column:
        return F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("long")

    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    return vectors.where(whole).select("vec_id", label, F.transform(x, integer).alias("v"))


def vector_length(vectors: DataFrame, parts: int = PARTS) -> int:
    """The most common length that ``parts`` divides; 0 if there is none."""
    n = F.size("v")
    found = vectors.groupBy(n.alias("n")).agg(F.count(F.lit(1)).alias("rows")).where((F.col("n") > 0) & (F.col("n") % parts == 0))
    top = found.agg(F.max(F.struct("rows", "n")).alias("top")).first().top
    return top.n if top else 0


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """For each part position, the parts of the smallest vec_ids. Only ids are sorted; the vectors of the chosen ones are read then."""
    ids = [r.vec_id for r in vectors.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    known = [i for i in ids if i is not None]
    chosen = F.col("vec_id").isin(known) if known else F.lit(False)
    if None in ids:
        chosen = chosen | F.col("vec_id").isNull()
    rows = vectors.where(chosen).groupBy("vec_id").agg(F.min("v").alias("v")).collect()  # at most ``entries`` rows
    rows.sort(key=lambda r: (r.vec_id is None, r.vec_id))
    whole = np.array([r.v for r in rows], dtype=np.int64)
    return [np.ascontiguousarray(x) for x in np.split(whole, parts, axis=1)]


class Trie:
    """A depth-first walk over parts in lexicographic order, in blocks; the open path is carried from one block to the next."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.last: np.ndarray | None = None
        self.path = np.zeros((entries.shape[1], len(entries)), dtype=np.int64)

    def leaves(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, its squared distance) of each part; equal parts and prefixes next to each other are computed once."""
        n, width = parts.shape
        differs = np.ones((n, width), dtype=bool)
        differs[1:] = parts[1:] != parts[:-1]
        if self.last is not None:
            differs[0] = parts[0] != self.last
        opens = np.logical_or.accumulate(differs, axis=1)  # a node of this depth begins at this leaf
        above = np.zeros((1, len(self.entries)), dtype=np.int64)
        node = np.zeros(n, dtype=np.int64)
        for depth in range(width):
            at = np.flatnonzero(opens[:, depth])
            step = parts[at, depth][:, None] - self.entries[:, depth]
            above = np.concatenate([self.path[depth][None], above[node[at]] + step * step])
            node = np.cumsum(opens[:, depth])
            self.path[depth] = above[-1]
        self.last = parts[-1].copy()
        best = above.argmin(axis=1)
        return best[node], above[np.arange(len(above)), best][node]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each of many parts in any order, by a trie over the sorted ones."""
    order = np.lexsort(parts.T[::-1])
    trie = Trie(entries)
    index, far = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
    for i in range(0, len(order), BLOCK):
        at = order[i:i + BLOCK]
        index[at], far[at] = trie.leaves(parts[at])
    return index, far


def distinct_parts(vectors: DataFrame, length: int, parts: int = PARTS) -> DataFrame:
    """(p, part, weight): the distinct parts of each position with their number, in lexicographic order within and across tasks."""
    width = length // parts
    cut = F.array(*[F.slice("v", 1 + p * width, width) for p in range(parts)])
    found = vectors.select(F.posexplode(cut).alias("p", "part")).groupBy("p", "part").agg(F.count(F.lit(1)).alias("weight"))
    return found.repartitionByRange("p", "part").sortWithinPartitions("p", "part")


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(n, -1)


def entry_sums(table: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(p, entry, d, total, n): for each entry, the weight of its parts and their weighted sum in each dimension."""
    import pyarrow as pa

    def walk(batches: Iterator) -> Iterator:
        tries = [Trie(b) for b in books]
        total = [np.zeros(b.shape, dtype=np.int64) for b in books]
        count = [np.zeros(len(b), dtype=np.int64) for b in books]
        for b in batches:
            if not b.num_rows:
                continue
            place, weight, parts = b.column("p").to_numpy(), b.column("weight").to_numpy(), _matrix(b.column("part"))
            for p in np.unique(place).tolist():
                rows = np.flatnonzero(place == p)
                for i in range(0, len(rows), BLOCK):
                    at = rows[i:i + BLOCK]
                    best, _ = tries[p].leaves(parts[at])
                    np.add.at(count[p], best, weight[at])
                    np.add.at(total[p], best, weight[at][:, None] * parts[at])
        for p, (t, n) in enumerate(zip(total, count)):
            entry, d = np.nonzero(np.repeat(n[:, None] > 0, t.shape[1], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p, dtype=np.int32)), pa.array(entry.astype(np.int32)),
                                              pa.array(d.astype(np.int32)), pa.array(t[entry, d]), pa.array(n[entry])],
                                             names=["p", "entry", "d", "total", "n"])

    return (table.mapInArrow(walk, "p int, entry int, d int, total long, n long")
            .groupBy("p", "entry", "d").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))


def fit_codebooks(vectors: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after ``rounds`` rounds; ``vectors`` as of ``integer_vectors``, all of one length."""
    books = first_codebooks(vectors, parts, entries)
    table = written(vectors.sparkSession, distinct_parts(vectors, length, parts), "distinct-parts")
    for _ in range(rounds):
        books = [b.copy() for b in books]
        for r in entry_sums(table, books).collect():  # one row for each number of the codebooks
            books[r.p][r.entry, r.d] = r.total // r.n
    return books


def codes(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error): the entry of each part as two hex digits, and the squared distances summed."""
    import pyarrow as pa

    kind, label = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def assign(batches: Iterator) -> Iterator:
        for b in batches:
            if not b.num_rows:
                continue
            pieces = np.split(_matrix(b.column("v")), len(books), axis=1)
            found = [nearest(x, book) for x, book in zip(pieces, books)]
            index = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            code = [row.tobytes().hex() for row in index]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()),
                                              pa.array(sum(far for _, far in found))], names=["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(assign, f"vec_id {kind}, label {label}, code string, error long")


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def code_query(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    spark = embeddings.sparkSession
    vectors = integer_vectors(embeddings, column)
    length = vector_length(vectors)
    if not length:
        out = "code string, error long, label_error long, codebooks_sha256 string"
        return spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, {out}")
    vectors = vectors.where(F.size("v") == length)
    books = fit_codebooks(vectors, length)
    coded = written(spark, codes(vectors, books), "codes")
    totals = written(spark, coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _code_sql() -> str:
    """The same rows in DuckDB: every round by all distances of all parts (64 dimensions or any other multiple of 8)."""
    sql = f"""
WITH bad AS (SELECT vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x IS NULL OR NOT isfinite(x)),
kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND vec_id NOT IN (FROM bad)),
d AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // {PARTS} AS w FROM kept),
x AS MATERIALIZED (SELECT vec_id, i // w AS p, i % w AS j, floor({SCALE} * x::DOUBLE)::BIGINT AS x FROM d),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p, j ORDER BY vec_id) - 1 AS e, j, x AS c FROM x
                    WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
"""
    for r in range(ROUNDS + 1):
        sql += f"""
f{r} AS (SELECT vec_id, x.p, e, sum((x - c) * (x - c))::BIGINT AS far FROM x JOIN b{r} b ON x.p = b.p AND x.j = b.j GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT vec_id, p, min(struct_pack(far := far, e := e)) AS s FROM f{r} GROUP BY ALL),"""
        if r < ROUNDS:
            sql += f"""
m{r} AS (SELECT x.p, a.s.e AS e, j, floor(sum(x)::DECIMAL(38, 0) / count(*))::BIGINT AS c FROM x JOIN a{r} a ON x.vec_id = a.vec_id AND x.p = a.p GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON b.p = m.p AND b.e = m.e AND b.j = m.j),"""
    return sql + f"""
v AS (SELECT vec_id, string_agg(printf('%02x', s.e), '' ORDER BY p) AS code, sum(s.far)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT v.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) FROM b{ROUNDS}) AS codebooks_sha256
FROM v JOIN kept k ON v.vec_id = k.vec_id
"""


CODE_SQL = _code_sql()
