"""Near-duplicate detection: ProbMinHash signatures, banding, exact verification, connected classes.

A text is a weighted set of shingles of ``SHINGLE`` words, weighted by how often they occur. For every shingle a Poisson process with
its weight as rate sends arrivals to random registers; a register keeps the shingle whose arrival is earliest. Two texts agree in a
register with the probability Jaccard similarity of their weights. A process stops as soon as its next arrival is later than
every register's earliest one. Links are decided without weights, so a text in which a shingle repeats has a second signature
with all weights 1, whose agreement is the plain Jaccard similarity. Signatures are cut into ``BANDS`` bands of ``ROWS`` registers; texts that agree in
a band share a bucket and are candidates. A candidate pair is a link if the exact Jaccard similarity of the shingle sets
is at least ``THRESHOLD``. Classes are the connected components of links; equal texts are one node from the start.

No pairs are spread out within a bucket. Each bucket has a center (its node with the most bucket neighbours); buckets with one center
are one. A set is held as its differences to a reference, the shingles that more than half of the bucket's members have: those of the
reference that it lacks and those that it has besides. For two members ``o`` and ``m``, with ``lack`` the number of the former,

    ``|o & m| = |reference| - lack_o - lack_m + (differences that both have)``

is exact whatever the reference, and near copies have few differences; all members together never have more of them than shingles. An
index from differences to members gives a member's intersections with all others at once.

A bucket of at most ``TASK_NODES`` texts with ``TASK_SHINGLES`` shingles is resolved exactly in one task. In a larger one every
member is compared with the center; those linked to it are one class. The others are dealt into blocks by a hash, the linked ones into blocks of
their own, and every two blocks, at least one of them of others, meet in one task that finds the links between and within them. So
every pair of members meets, unless both are linked to the center; no candidate pair is given up, and there is one such step however
large a bucket is. Blocks are bounded by half of what a task may hold, counted in texts and in differences (a text is never cut). The number of
pairs of blocks grows with the square of a bucket, a text of it being sent once for each other block. The banding
itself misses a pair of similarity ``s`` with probability ``(1 - s ** ROWS) ** BANDS`` (3e-6 at 0.8).

Scale: signatures take one scan and are small. Shingle sets are made only for nodes in a bucket (a bitmap of fixed size thins them
in a second scan), and move in equi-joins that adaptive execution splits where a center is hot. Buckets, classes and centers are
aggregates with partial sums. Nothing is collected but counts and the bitmap.

Edge cases: a text with fewer words than a shingle is one shingle; texts without words are only equal to the same text; a null text is
a class of its own; null and repeated ids are rows like others; rows equal in id and text are in one class; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import (
    columns_of, membership_filter, mix64, passes_filter, pieces, span_hashes, text_buffers, text_digest, window_hashes,
    word_spans, written,
)

SHINGLE = 5
BANDS = 24
ROWS = 4
THRESHOLD = 0.8
#: Texts whose registers are held at a time.
MAX_TEXTS = 4096
#: What one task may hold of a bucket, in texts and in shingles or differences (8 bytes each).
TASK_NODES = 2000
TASK_SHINGLES = 1 << 20
_U = float(2.0 ** -53)


def shingles(data: np.ndarray, bounds: np.ndarray, size: int = SHINGLE):
    """(hash, row) of the shingles of concatenated texts."""
    starts, ends, row = word_spans(data, bounds)
    h, r, _ = window_hashes(span_hashes(data, starts, ends), row, len(bounds) - 1, size)
    return h, r


def weighted(h: np.ndarray, row: np.ndarray):
    """Distinct (hash, row) with their counts."""
    if not len(h):
        return h, row, np.zeros(0)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    return h[at], row[at], np.diff(np.append(at, len(h))).astype(np.float64)


def prob_minhash(h: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """Signatures (n_rows, registers) of weighted sets; rows without elements stay 0."""
    earliest = np.full(n_rows * registers, np.inf)
    winner = np.zeros(n_rows * registers, dtype=np.uint64)
    time = np.zeros(len(h))
    n = 0
    while len(h):
        n += 1
        bits = mix64(h ^ mix64(np.full(1, 2 * n, dtype=np.uint64)))
        time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 1.0) * _U) / weight
        at = row * registers + (mix64(bits ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, at, time)
        won = earliest[at] == time
        winner[at[won]] = h[won]
        # a process ends when it is later than the latest of its text's registers
        rows = np.flatnonzero(np.bincount(row, minlength=n_rows))
        latest = np.full(n_rows, np.inf)
        latest[rows] = earliest.reshape(n_rows, registers)[rows].max(axis=1)
        on = time < latest[row]
        h, row, weight, time = h[on], row[on], weight[on], time[on]
    return winner.reshape(n_rows, registers)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket key for each band of each signature."""
    s = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), s.shape[:2]).copy()
    for j in range(rows):
        key = mix64(key * np.uint64(1_000_003) + s[:, :, j])
    return key


def jaccard_of(inter, n, m):
    return inter / (n + m - inter)


def _long_lists(values: np.ndarray, lengths: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values.view(np.int64)))


def _arrays(column) -> list[np.ndarray]:
    """The rows of an Arrow list column as numpy arrays."""
    values, off = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[off[i]:off[i + 1]] for i in range(len(column))]


def signatures(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, n, buckets) of every distinct text: its md5, its number of distinct shingles, its band keys (none without words)."""
    import pyarrow as pa

    d = docs.where("text is not null").select(text_digest(F.col("text")).alias("node"), "text")

    def scan(batches: Iterator) -> Iterator:
        for b in batches:
            raw, offsets, _ = text_buffers(b.column("text"))
            for lo, hi in pieces(offsets, MAX_TEXTS):
                h, row, weight = weighted(*shingles(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], size))
                n = np.bincount(row, minlength=hi - lo)
                keys = band_keys(prob_minhash(h, row, weight, hi - lo, bands * rows), bands, rows)
                own = np.repeat((n > 0)[:, None], 2 * bands, axis=1)
                own[:, bands:] = False
                plain = np.zeros_like(keys)
                again = np.flatnonzero(np.bincount(row[weight > 1], minlength=hi - lo))  # texts in which a shingle repeats
                if len(again):
                    at = np.isin(row, again)
                    ones = prob_minhash(h[at], np.searchsorted(again, row[at]), np.ones(at.sum()), len(again), bands * rows)
                    plain[again] = band_keys(ones, bands, rows)
                    own[again, bands:] = plain[again] != keys[again]
                yield pa.RecordBatch.from_arrays(
                    [b.column("node").slice(lo, hi - lo), pa.array(n, pa.int64()),
                     _long_lists(np.concatenate([keys, plain], axis=1)[own], own.sum(axis=1))], names=["node", "n", "buckets"])

    found = d.mapInArrow(scan, "node binary, n long, buckets array<bigint>")
    return found.groupBy("node").agg(F.first("n").alias("n"), F.first("buckets").alias("buckets"))


def shingle_sets(docs: DataFrame, bitmap: np.ndarray, size: int = SHINGLE) -> DataFrame:
    """(node, set) of the distinct texts that may be in a bucket; set is the sorted array of distinct shingle hashes."""
    import pyarrow as pa

    d = docs.where("text is not null").select(text_digest(F.col("text")).alias("node"), "text")
    known = docs.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator) -> Iterator:
        for b in batches:
            wanted = passes_filter(known.value, node_longs(b.column("node")))
            raw, offsets, _ = text_buffers(b.column("text"))
            for i in np.flatnonzero(wanted):  # one at a time: a batch's sets may be large
                h, _ = shingles(raw[offsets[i]:offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), size)
                h = np.unique(h)
                yield pa.RecordBatch.from_arrays(
                    [b.column("node").slice(i, 1), _long_lists(h, np.array([len(h)]))], names=["node", "set"])

    return d.mapInArrow(scan, "node binary, set array<bigint>").dropDuplicates(["node"])


def node_longs(column) -> np.ndarray:
    """The first eight bytes of 16-byte binaries as signed integers (null-free column)."""
    return np.frombuffer(b"".join(x[:8] for x in column.to_pylist()), dtype=">i8").astype(np.int64)


def _node_long(node):
    """The same number as a column."""
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long")


def differences(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(key, node, center, n, lack, reference, diff, linked) of the members (key, node, center, nodes) of buckets, centers among them.

    ``nodes`` is the number of the bucket's members, ``reference`` that of its reference shingles, ``lack`` how many of them the node lacks, ``diff`` its differences;
    ``linked`` whether it is the center or similar to it.
    """
    spark = members.sparkSession
    held = written(spark, members.join(sets.select(F.col("node").alias("s_node"), "set"), F.col("node") == F.col("s_node"))
                   .select("key", "node", "center", "nodes", "set"), "held")
    most = (held.select("key", "nodes", F.explode("set").alias("y")).groupBy("key", "nodes", "y").agg(F.count(F.lit(1)).alias("times"))
            .where(2 * F.col("times") > F.col("nodes")).groupBy(F.col("key").alias("m_key")).agg(F.collect_list("y").alias("most")))
    about = held.where(F.col("node") == F.col("center")).select(F.col("key").alias("c_key"), F.col("set").alias("c_set"))
    about = about.join(most, F.col("c_key") == F.col("m_key"), "left").select(
        "c_key", "c_set", F.coalesce("most", F.array().cast("array<bigint>")).alias("most"))
    inter, n, m = F.size(F.array_intersect("set", "c_set")), F.size("set"), F.size("c_set")
    lack = F.array_except("most", "set")
    d = held.join(about, F.col("key") == F.col("c_key")).select(
        "key", "node", "center", n.cast("long").alias("n"), F.size(lack).cast("long").alias("lack"), F.size("most").cast("long").alias("reference"),
        F.concat(F.array_except("set", "most"), lack).alias("diff"), (jaccard_of(inter, n, m) >= threshold).alias("linked"))
    return written(spark, d, "differences")


def _blocks(d: DataFrame) -> DataFrame:
    """Rows of ``differences`` as (key, node, n, lack, reference, diff, linked), once for each task that they go to, which is ``key``.

    Any two members of a bucket meet in a task, unless both are linked to the center.
    """
    parts = lambda nodes, diffs: F.ceil(F.greatest(2 * nodes / F.lit(TASK_NODES), 2 * diffs / F.lit(TASK_SHINGLES))).cast("int")
    of = lambda value: F.sum(F.when(F.col("linked"), F.lit(0)).otherwise(value))
    many = F.size("diff").cast("long")
    total = d.groupBy(F.col("key").alias("t_key")).agg(
        F.count(F.lit(1)).alias("nodes"), of(F.lit(1)).alias("o_nodes"), F.sum(many).alias("diffs"), of(many).alias("o_diffs"))
    whole = (F.col("nodes") <= TASK_NODES) & (F.col("diffs") <= TASK_SHINGLES)
    total = total.where("o_nodes > 0").select(
        "t_key", whole.alias("whole"), parts(F.col("o_nodes"), F.col("o_diffs")).alias("o_parts"),
        parts(F.col("nodes") - F.col("o_nodes"), F.col("diffs") - F.col("o_diffs")).alias("l_parts"))
    h = F.xxhash64("node")
    at = F.when(F.col("linked"), F.col("o_parts") + F.pmod(h, F.col("l_parts"))).otherwise(F.pmod(h, F.col("o_parts"))).cast("int")
    with_ = F.col("o_parts") + F.when(F.col("linked"), F.lit(0)).otherwise(F.col("l_parts"))
    d = d.join(total, F.col("key") == F.col("t_key")).withColumn("at", F.when(F.col("whole"), F.lit(0)).otherwise(at))
    d = d.withColumn("other", F.explode(F.when(F.col("whole"), F.array(F.lit(0))).otherwise(
        F.array_except(F.sequence(F.lit(0), with_ - 1), F.array("at")))))
    return d.select(F.xxhash64("key", F.least("at", "other"), F.greatest("at", "other")).alias("key"), "node", "n", "lack", "reference", "diff", "linked")


def _in_tasks(held: DataFrame, resolve) -> DataFrame:
    """(node, center): what ``resolve`` finds in each group of rows (key, node, ...), the pairs of positions of a group's rows.

    ``resolve`` gets the group's further columns: lists as arrays, numbers as they are.
    """
    import pyarrow as pa

    names = [c for c in held.columns if c not in ("key", "node")]

    def rows(batches: Iterator):
        for b in batches:
            columns = [_arrays(c) if pa.types.is_list(c.type) else c.to_pylist() for c in map(b.column, names)]
            yield from zip(b.column("key").to_pylist(), b.column("node").to_pylist(), *columns)

    def scan(batches: Iterator) -> Iterator:
        for _, group in groupby(rows(batches), key=itemgetter(0)):
            _, nodes, *columns = zip(*group)
            found = resolve(*columns)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[j] for j, _ in found], pa.binary()),
                                                  pa.array([nodes[i] for _, i in found], pa.binary())], names=["node", "center"])

    return held.repartition("key").sortWithinPartitions("key").mapInArrow(scan, "node binary, center binary")


def _resolved(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(node, center): links within buckets (key, node) of bounded size, each resolved exactly in one task."""
    held = members.join(sets.select(F.col("node").alias("s_node"), "set"), F.col("node") == F.col("s_node")).select("key", "node", "set")
    return _in_tasks(held, lambda arrays: links_within(list(arrays), threshold))


def _resolved_by_blocks(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(node, center): links within buckets (key, node, center, nodes) of any size."""
    d = differences(members, sets, threshold)

    def resolve(n, lack, reference, diff, linked):
        return links_by_difference(list(diff), np.array(n), np.array(lack), reference[0], np.array(linked), threshold)

    return (d.where(F.col("linked") & (F.col("node") != F.col("center"))).select("node", "center")
            .unionByName(_in_tasks(_blocks(d), resolve)))


def links_within(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Pairs of positions that connect every class of the given shingle sets."""
    if len(sets) < 2:
        return []
    n = np.array([len(x) for x in sets])
    if len(sets) == 2:
        inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(1, 0)] if jaccard_of(inter, n[0], n[1]) >= threshold else []
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    common = 2 * np.bincount(flat) > len(sets)
    reference = np.flatnonzero(common)
    has = np.zeros(len(common), dtype=bool)
    diff, lack = [], np.zeros(len(sets), dtype=np.int64)
    for i, mine in enumerate(np.split(flat, np.cumsum(n)[:-1])):
        has[mine] = True
        lacks = reference[~has[reference]]
        has[mine] = False
        lack[i] = len(lacks)
        diff.append(np.concatenate([mine[~common[mine]], lacks]))
    return links_by_difference(diff, n, lack, len(reference), np.zeros(len(sets), dtype=bool), threshold)


def links_by_difference(diff: list[np.ndarray], n: np.ndarray, lack: np.ndarray, reference: int, linked: np.ndarray,
                        threshold: float) -> list[tuple[int, int]]:
    """Pairs of positions that connect every class of sets given by their differences (see the module's docstring).

    The sets that are ``linked`` are in one class from the start. A set is compared with all others at once; it is skipped if it is in
    the class of the linked ones (without any, of the first set that is similar to another): whatever it is
    similar to is in that class too or finds it.
    """
    count = len(diff)
    sizes = np.array([len(x) for x in diff])
    owner = np.repeat(np.arange(count), sizes)
    flat = np.unique(np.concatenate(diff), return_inverse=True)[1]
    shared = np.bincount(flat, minlength=1)[flat] > 1  # what one set only has counts for no pair
    flat, owner = flat[shared], owner[shared]
    starts = np.searchsorted(owner, np.arange(count + 1))
    holders = owner[np.argsort(flat, kind="stable")]
    held = np.bincount(flat, minlength=1)
    first = np.cumsum(held) - held
    label = np.arange(count)
    hub = int(linked.argmax()) if linked.any() else -1
    label[linked] = hub
    found = []
    for i in np.argsort(sizes, kind="stable"):
        if hub >= 0 and label[i] == label[hub]:
            continue
        mine = flat[starts[i]:starts[i + 1]]
        times = held[mine]
        at = np.arange(times.sum()) + np.repeat(first[mine] - (np.cumsum(times) - times), times)
        inter = reference - lack[i] - lack + np.bincount(holders[at], minlength=count)
        near = np.flatnonzero((jaccard_of(inter, n[i], n) >= threshold) & (label != label[i]))
        if len(near):
            classes, one = np.unique(label[near], return_index=True)
            found += [(int(j), int(i)) for j in near[one]]
            label[np.isin(label, classes)] = label[i]
            hub = int(i) if hub < 0 else hub
    return found


def links(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, center): verified links between different texts that connect every class."""
    spark = docs.sparkSession
    d = columns_of(docs, "text")
    sig = written(spark, signatures(d, size, bands, rows), "signatures")
    entries = sig.select("node", "n", F.explode("buckets").alias("key"))
    shared = entries.groupBy(F.col("key").alias("s_key")).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(spark, entries.join(shared, F.col("key") == F.col("s_key")).select("key", "node", "n", "size"), "buckets")
    nodes = written(spark, members.groupBy(F.col("node").alias("d_node")).agg(F.sum(F.col("size") - 1).alias("degree")), "nodes")
    bitmap = membership_filter(nodes.select(_node_long(F.col("d_node")).alias("v")), "v")
    sets = written(spark, shingle_sets(d, bitmap, size), "sets")
    members = members.join(nodes, F.col("node") == F.col("d_node")).select("key", "node", "n", "degree")
    best = members.groupBy(F.col("key").alias("c_key")).agg(
        F.max(F.struct("degree", "node", "n")).alias("best")).select("c_key", F.col("best.node").alias("center"), F.col("best.n").alias("c_n"))
    # buckets with one center are one bucket from here on
    pairs = members.join(best, F.col("key") == F.col("c_key")).where(F.col("node") != F.col("center"))
    pairs = written(spark, pairs.select(F.xxhash64("center").alias("key"), "node", "center", "n", "c_n", "degree").distinct(), "pairs")
    size = pairs.groupBy(F.col("key").alias("l_key")).agg(
        (F.count(F.lit(1)) + 1).alias("nodes"), (F.sum("n") + F.max("c_n")).alias("shingles"), F.max("center").alias("l_center"))
    size = _sized(spark, size)
    small = size.where("small")
    ready = pairs.join(small, F.col("key") == F.col("l_key"), "left_semi").select("key", "node").unionByName(
        small.select(F.col("l_key").alias("key"), F.col("l_center").alias("node")))
    found = written(spark, _resolved(ready, sets, threshold), "resolved")
    large = size.where("not small")
    if not large.isEmpty():
        members = pairs.join(large, F.col("key") == F.col("l_key")).select("key", "node", "center", "nodes").unionByName(
            large.select(F.col("l_key").alias("key"), F.col("l_center").alias("node"), F.col("l_center").alias("center"), "nodes"))
        found = found.unionByName(written(spark, _resolved_by_blocks(members, sets, threshold), "resolved"))
    return found.distinct()


def _sized(spark: SparkSession, size: DataFrame) -> DataFrame:
    """(l_key, small, ...): whether one task can hold a bucket of so many nodes and shingles."""
    small = (F.col("nodes") <= TASK_NODES) & (F.col("shingles") <= TASK_SHINGLES)
    return written(spark, size.withColumn("small", small), "sizes")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (node, center); label is the smallest node of its component."""
    spark = edges.sparkSession
    edges = written(spark, edges, "edges")
    label = edges.select("node").unionByName(edges.select(F.col("center").alias("node"))).distinct()
    label = written(spark, label.withColumn("label", F.col("node")), "labels")
    while True:
        a = label.select(F.col("node").alias("a_node"), F.col("label").alias("a"))
        b = label.select(F.col("node").alias("b_node"), F.col("label").alias("b"))
        between = (edges.join(a, F.col("node") == F.col("a_node")).join(b, F.col("center") == F.col("b_node"))
                   .where(F.col("a") != F.col("b")).select("a", "b").distinct())
        between = written(spark, between, "between")
        if between.isEmpty():
            return label
        both = between.unionByName(between.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up"))
        parent = written(spark, parent, "parents")
        # two steps up at once
        grand = parent.select(F.col("a").alias("g_a"), F.col("up").alias("g_up"))
        parent = (parent.join(grand, F.col("up") == F.col("g_a"), "left")
                  .select("a", F.least(F.col("up"), F.coalesce("g_up", "up")).alias("up")))
        label = written(spark, label.join(parent, F.col("label") == F.col("a"), "left")
                        .select("node", F.coalesce("up", "label").alias("label")), "labels")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, **rule) -> DataFrame:
    """(doc_id, class_id, class_size, class_key) of every row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest doc_id of the class, ``class_size`` its number of rows; ``class_key`` names the class where ids are null
    (null for a null text, which is a class by itself).
    """
    spark = docs.sparkSession
    label = components(links(docs, threshold, **rule)).select(F.col("node").alias("l_node"), "label")
    d = columns_of(docs, "doc_id", "text").select("doc_id", text_digest(F.col("text")).alias("node"))
    d = d.join(label, F.col("node") == F.col("l_node"), "left").select("doc_id", F.coalesce("label", "node").alias("class_key"))
    d = written(spark, d, "classes")
    classes = (d.where("class_key is not null").groupBy(F.col("class_key").alias("c_key"))
               .agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")))
    d = d.join(classes, F.col("class_key") == F.col("c_key"), "left")
    alone = F.col("class_key").isNull()
    return d.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"), "class_key")


def near_duplicate_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).drop("class_key")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, **rule) -> DataFrame:
    """One row of every class: the smallest doc_id (null last), then the smallest row key; all columns pass through.

    Rows equal in id and text are one document, of which one row stays. A row with a null text stays.
    """
    from quillspark.llm.common import row_key

    spark = docs.sparkSession
    cols = docs.columns
    label = components(links(docs, threshold, **rule)).select(F.col("node").alias("l_node"), "label")
    d = columns_of(docs, "doc_id", "text").where("text is not null").select(
        "doc_id", text_digest(F.col("text")).alias("node"), row_key(F.col("doc_id"), F.col("text")).alias("key"))
    d = d.join(label, F.col("node") == F.col("l_node"), "left")
    keep = (d.groupBy(F.coalesce("label", "node").alias("class_key"))
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("key"))).alias("k"))
            .select(F.col("k.key").alias("__keep")))
    keep = written(spark, keep, "kept")
    row = docs.withColumn("__row_key", row_key(F.col("doc_id"), F.col("text")))
    rows = row.where("text is not null").join(keep, F.col("__row_key") == F.col("__keep"), "left_semi")
    many = (columns_of(docs, "doc_id", "text").where("text is not null")
            .groupBy(row_key(F.col("doc_id"), F.col("text")).alias("__many")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    many = written(spark, many.select("__many"), "repeated-rows")
    if not many.isEmpty():
        twice = rows.join(many, F.col("__row_key") == F.col("__many"), "left_semi").dropDuplicates(["__row_key"])
        rows = rows.join(many, F.col("__row_key") == F.col("__many"), "left_anti").unionByName(twice)
    return rows.unionByName(row.where("text is null")).select(*[F.col(f"`{c}`") for c in cols])
