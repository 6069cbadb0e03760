"""Line dedup by content-defined chunks of lines.

A text's units are its lines, and the clauses of a line that holds several. A rolling hash over the hashes of ``WINDOW`` units chooses the
boundaries: a chunk ends at a unit where it is 0 modulo ``DIVISOR``, and at the end of the text. Chunks do not overlap, and text inserted
or removed elsewhere in a document does not shift their boundaries. Chunks of at least ``SEED_WORDS`` words whose bytes stand at an earlier place
of the corpus, by doc_id (null last), row key and position, are repeats: the join is on a rolling hash of the bytes and on the bytes themselves. A repeat
is extended into the chunks beside it, unit by unit, while their bytes equal those beside the first place, because the ends of a passage fall
inside chunks that differ. Runs of repeated units with at least ``min_lines`` units and ``min_words`` words are removed. Of every unit the first
place stays, as a removed one always has an equal one at an earlier place.

Scale: the first pass emits 8-byte hashes of the chunks, made with numpy on the Arrow buffers. Those seen twice set bits of a bitmap sized
from their number (bounded); the second pass emits only the chunks whose bit is set and those beside them, so less than the text moves, and once. A chunk's first
place is an aggregate that runs before the shuffle and is written, so that the join of the repeats with it has no aggregate in its stage and adaptive
execution can split a hot chunk; so are the joins that fetch the chunks to extend into, which read only chunks that a bitmap of the wanted ones lets pass. Of documents, the repeated units meet, and
the texts that may lose something (by a bitmap again), to have the spans cut out; the others stay where they are.

Edge cases: null and empty texts have no chunks and pass unchanged; rows equal in doc_id and text are one document and
get the same result; a chunk that repeats within one text keeps its first place; very long texts are chunked like any other; a text may become empty; an empty table gives an empty
result; all other columns pass through, and ``n_chars``, if there, is set anew where the text changed. White space after a unit goes with it, so a
passage that starts inside a line takes its last line end along. Three or more chunks of fewer than ``SEED_WORDS`` words in a row are not bridged.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import (
    columns_of, cut_spans, filter_bits, free_name, may_be_member, membership_filter, mix64, passes_filter, pieces, row_key, slices, span_hasher, text_buffers,
    word_spans, written,
)

MIN_LINES = 2
MIN_WORDS = 8
#: A shorter chunk is no repeat of its own; it goes with a longer one beside it.
SEED_WORDS = 4
#: Units under the rolling hash, and one of how many is a boundary.
WINDOW = 2
DIVISOR = 2

#: Text bytes handled at a time: the arrays of 8 bytes a text byte stay small.
PIECE = 1 << 16

_ROLL = np.uint64(0x9E3779B97F4A7C15)
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_CLOSER = np.zeros(256, dtype=bool)
_CLOSER[[ord(c) for c in "\"')]}"]] = True


def units(data: np.ndarray, bounds: np.ndarray):
    """(starts, ends, row, index of each unit's first word) of the words of concatenated texts; a unit ends at a line end or punctuation mark."""
    starts, ends, row = word_spans(data, bounds)
    if not len(starts):
        return starts, ends, row, starts
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    closed = _CLOSER[data[ends - 1]] & (ends - starts > 1)
    mark = _MARK[data[ends - 1 - closed]]
    head = np.ones(len(starts), dtype=bool)
    head[1:] = mark[:-1] | (row[1:] != row[:-1]) | (lines[starts[1:]] > lines[ends[:-1]])
    return starts, ends, row, np.flatnonzero(head)


class Chunks:
    """Units and chunks of concatenated texts, as arrays; offsets are bytes.

    ``start``, ``stop``, ``behind`` (start of the next unit of the text, or the text's end), ``words``, ``row`` are of units;
    ``first`` and ``last`` are the units of a chunk, ``seed`` tells whether it is long enough, ``hash`` is of its bytes.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        starts, ends, row, head = units(data, bounds)
        n = len(head)
        self.start, self.row = starts[head], row[head]
        self.words = np.diff(np.append(head, len(starts)))
        self.stop = ends[np.append(head[1:], len(starts)) - 1] if n else self.start
        new = np.ones(n, dtype=bool)
        new[1:] = self.row[1:] != self.row[:-1]
        ends_text = np.append(new[1:], True)[:n]
        self.behind = np.where(ends_text, bounds[self.row + 1], np.append(self.start[1:], 0)[:n])
        hashes = span_hasher(data)
        h = hashes(self.start, self.stop)
        roll = h.copy()
        for back in range(1, WINDOW):
            roll[back:] += h[:-back] * _ROLL ** np.uint64(back)
        self.number = np.arange(n) - np.flatnonzero(new)[np.cumsum(new) - 1] if n else np.zeros(0, dtype=np.int64)  # of the unit in its text
        cut = (mix64(roll) % np.uint64(DIVISOR) == 0) & (self.number >= WINDOW - 1) | ends_text
        self.last = np.flatnonzero(cut)
        self.first = np.append(0, self.last[:-1] + 1)[:len(self.last)]
        total = np.concatenate([[0], np.cumsum(self.words)])
        self.seed = total[self.last + 1] - total[self.first] >= SEED_WORDS
        self.hash = hashes(self.start[self.first], self.stop[self.last]).view(np.int64)
        opens = new[self.first]
        self.place = np.arange(len(self.last)) - np.flatnonzero(opens)[np.cumsum(opens) - 1] if n else self.number  # of the chunk in its text


def _code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte offset."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def chunks_of(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, number of units) of the chunks of a text in code points; white space goes with the unit before, at the start of the text with none."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    c = Chunks(data, np.array([0, len(data)]))
    cp = _code_points(data)
    for a, b in zip(c.first.tolist(), c.last.tolist()):
        yield int(cp[c.start[a]]), int(cp[c.behind[b]]), b - a + 1


#: A chunk of a text: its place among the text's chunks, the number of its first unit, its bytes, and the marks of its units.
_CHUNK = "c long, seed boolean, h long, u0 long, body binary, marks binary"


class Marks:
    """Of a chunk's n units, as 4n + 1 32-bit integers: the code points where they start, the one where the last one ends, their bytes'
    starts and stops within the chunk in turn, and their words."""

    @staticmethod
    def packed(at: np.ndarray, cut: np.ndarray, words: np.ndarray, size: np.ndarray):
        """An Arrow binary array; ``at`` has size + 1 numbers for each chunk, ``cut`` 2 * size and ``words`` size."""
        import pyarrow as pa

        offsets = np.concatenate([[0], np.cumsum(4 * size + 1)])
        out = np.empty(offsets[-1], dtype="<i4")
        for values, count, skip in ((at, size + 1, 0 * size), (cut, 2 * size, size + 1), (words, size, 3 * size + 1)):
            ends = np.cumsum(count)
            out[np.repeat(offsets[:-1] + skip - (ends - count), count) + np.arange(ends[-1])] = values
        return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(out)])

    def __init__(self, marks: bytes):
        m = struct.unpack(f"<{len(marks) // 4}i", marks)
        n = len(m) // 4
        self.at, self.cut, self.words = m[:n + 1], m[n + 1:3 * n + 1], m[3 * n + 1:]

    def part(self, first: int, last: int) -> bytes:
        """The marks of the units [first, last), without bytes."""
        kept = self.at[first:last + 1] + (0,) * (2 * (last - first)) + self.words[first:last]
        return struct.pack(f"<{len(kept)}i", *kept)


def _pass(docs: DataFrame, bitmap=None) -> DataFrame:
    import pyarrow as pa

    d = columns_of(docs, "doc_id", "text").where("text is not null")
    known = docs.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None
    kind = d.schema["doc_id"].dataType.simpleString()

    def found(b) -> Iterator:
        raw, offsets, _ = text_buffers(b.column("text"))
        for lo, hi in pieces(offsets, size=PIECE):
            data = raw[offsets[lo]:offsets[hi]]
            yield lo, data, offsets[lo:hi + 1] - offsets[lo], Chunks(data, offsets[lo:hi + 1] - offsets[lo])

    def hashes(batches: Iterator) -> Iterator:
        for b in batches:
            for _, _, _, c in found(b):
                yield pa.RecordBatch.from_arrays([pa.array(c.hash[c.seed])], names=["h"])

    def repeated(batches: Iterator) -> Iterator:
        for b in batches:
            for lo, data, bounds, c in found(b):
                seed = c.seed & passes_filter(known.value, c.hash) if len(c.last) else c.seed
                row = c.row[c.first]
                keep = seed.copy()
                same = row[1:] == row[:-1]
                keep[1:] |= seed[:-1] & same
                keep[:-1] |= seed[1:] & same
                keep = np.flatnonzero(keep)
                if not len(keep):
                    continue
                first, last = c.first[keep], c.last[keep]
                size = last - first + 1
                ends = np.concatenate([[0], np.cumsum(size)])
                unit = np.repeat(first - ends[:-1], size) + np.arange(ends[-1])  # of all kept chunks, in order
                cp = _code_points(data)
                base = cp[bounds[c.row]]
                at = np.insert(cp[c.start[unit]] - base[unit], ends[1:], cp[c.behind[last]] - base[last])
                cut = np.stack([c.start[unit], c.stop[unit]], axis=1) - np.repeat(c.start[first], size)[:, None]
                bodies = [data[s:e].tobytes() for s, e in zip(c.start[first].tolist(), c.stop[last].tolist())]

                of = pa.array(row[keep] + lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(of), b.column("key").take(of), pa.array(c.place[keep]), pa.array(seed[keep]), pa.array(c.hash[keep]),
                     pa.array(c.number[first]), pa.array(bodies, pa.binary()), Marks.packed(at, cut.ravel(), c.words[unit], size)],
                    names=["doc_id", "key", "c", "seed", "h", "u0", "body", "marks"])

    if known is None:
        return d.select("text").mapInArrow(hashes, "h long")
    d = d.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    return d.mapInArrow(repeated, f"doc_id {kind}, key binary, {_CHUNK}")


def equal_units(body: bytes, cut, other: bytes, other_cut, side: int) -> int:
    """How many units of two chunks are equal in bytes, from their starts (side 1) or their ends (side -1)."""
    most = min(len(cut), len(other_cut)) // 2
    for n in range(most):
        i, j = (2 * n, 2 * n) if side > 0 else (len(cut) - 2 * n - 2, len(other_cut) - 2 * n - 2)
        if body[cut[i]:cut[i + 1]] != other[other_cut[j]:other_cut[j + 1]]:
            return n
    return most


def _extensions(repeats: DataFrame, found: DataFrame) -> DataFrame:
    """Units (key, u0, marks, first_doc_id) beside the repeats that equal those beside the first places."""
    order = Window.partitionBy("key").orderBy("c")
    r = repeats.select("key", "c", "first", F.lag("c").over(order).alias("before"), F.lead("c").over(order).alias("after"))
    sides = F.array(F.when(F.col("before").isNull() | (F.col("before") < F.col("c") - 1), F.lit(-1)),
                    F.when(F.col("after").isNull() | (F.col("after") > F.col("c") + 1), F.lit(1)))
    edges = r.select("key", "c", "first", F.explode(sides).alias("side")).where("side IS NOT NULL").select(
        F.col("key").alias("k"), (F.col("c") + F.col("side")).alias("n"), F.col("first.key").alias("f_key"),
        (F.col("first.c") + F.col("side")).alias("f_c"), "side", F.col("first.doc_id").alias("first_doc_id"))
    edges = written(repeats.sparkSession, edges, "chunk-edges")
    needed = may_be_member(edges.select(F.explode(F.array(F.xxhash64("k", "n"), F.xxhash64("f_key", "f_c"))).alias("h")), "h")
    beside = written(repeats.sparkSession, found.where(needed(F.xxhash64("key", "c"))).dropDuplicates(["key", "c"]), "chunks-beside")
    own = beside.select("key", "c", "u0", "body", "marks")
    its = beside.select(F.col("key").alias("o_key"), F.col("c").alias("o_c"), F.col("body").alias("o_body"), F.col("marks").alias("o_marks"))
    beside = edges.join(own, (F.col("k") == F.col("key")) & (F.col("n") == F.col("c")))
    beside = beside.join(its, (F.col("f_key") == F.col("o_key")) & (F.col("f_c") == F.col("o_c")))

    kind = repeats.schema["first"].dataType["doc_id"].dataType.simpleString()

    def extended(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for rows in slices(b.num_rows):
                part = b.slice(rows.start, rows.stop - rows.start)
                at, skip, marks = [], [], []
                columns = (part.column(x).to_pylist() for x in ("body", "marks", "o_body", "o_marks", "side"))
                for i, (body, m, other, om, side) in enumerate(zip(*columns)):
                    own = Marks(m)
                    n, units = equal_units(body, own.cut, other, Marks(om).cut, side), len(own.words)
                    if n:
                        first, last = (0, n) if side > 0 else (units - n, units)
                        at.append(i)
                        skip.append(first)
                        marks.append(own.part(first, last))
                of = part.select(["key", "u0", "first_doc_id"]).take(pa.array(at, pa.int64()))
                u0 = pa.array(of.column("u0").to_numpy() + np.array(skip, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([of.column("key"), u0, pa.array(marks, pa.binary()), of.column("first_doc_id")],
                                                 names=["key", "u0", "marks", "first_doc_id"])

    beside = beside.select("key", "u0", "body", "marks", "o_body", "o_marks", "side", "first_doc_id")
    return beside.mapInArrow(extended, f"key binary, u0 long, marks binary, first_doc_id {kind}")


def _united(parts, min_lines: int, min_words: int):
    """The long enough runs of each document's parts, as an Arrow list array; of a unit in several parts the first counts."""
    import pyarrow as pa

    offsets = parts.offsets.to_numpy()
    u0, marks, firsts = parts.flatten().flatten()
    raw, at, _ = text_buffers(marks)
    values = np.frombuffer(raw[at[0]:at[-1]].tobytes(), dtype="<i4").astype(np.int64)
    at = (at[:-1] - at[0]) // 4
    size = (np.append(at[1:], len(values)) - at) // 4
    ends = np.cumsum(size)
    part = np.repeat(np.arange(len(size)), size)
    j = np.arange(len(part)) - np.repeat(ends - size, size)  # of the unit in its part
    unit = u0.to_numpy()[part] + j
    doc = np.repeat(np.arange(len(parts)), np.diff(offsets))[part]
    order = np.lexsort((unit, doc))  # stable: parts keep their order
    unit, doc = unit[order], doc[order]
    new = np.ones(len(unit), dtype=bool)
    new[1:] = (unit[1:] != unit[:-1]) | (doc[1:] != doc[:-1])
    order, unit, doc = order[new], unit[new], doc[new]
    part, place = part[order], (at[part] + j)[order]
    head = np.ones(len(unit), dtype=bool)
    head[1:] = (unit[1:] != unit[:-1] + 1) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(head)
    tail = np.append(head[1:], len(unit))[:len(head)] - 1
    words = np.concatenate([[0], np.cumsum(values[place + 3 * size[part] + 1])])
    long = (tail - head + 1 >= min_lines) & (words[tail + 1] - words[head] >= min_words)
    head, tail = head[long], tail[long]
    runs = pa.StructArray.from_arrays([pa.array(values[place[head]]), pa.array(values[place[tail] + 1]), firsts.take(pa.array(part[head]))],
                                      names=["start", "end", "first_doc_id"])
    count = np.bincount(doc[head], minlength=len(parts))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), runs)


def _runs(parts: DataFrame, min_lines: int, min_words: int, kind: str) -> DataFrame:
    """(key, spans) of documents (key, parts): (start, end, first_doc_id) of the runs of adjacent units that are long enough, at least one."""
    def unite(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            for rows in slices(b.num_rows):
                some = b.slice(rows.start, rows.stop - rows.start)
                spans = _united(some.column("parts"), min_lines, min_words)
                out = pa.RecordBatch.from_arrays([some.column("key"), spans], names=["key", "spans"])
                yield out.filter(pc.greater(pc.list_value_length(spans), 0))

    return parts.mapInArrow(unite, f"key binary, spans array<struct<start:bigint,end:bigint,first_doc_id:{kind}>>")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, spans): for each document with runs to remove their (start, end, first_doc_id), code points of the original text."""
    spark = docs.sparkSession
    twice = written(spark, _pass(docs).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "repeated-hashes")
    found = written(spark, _pass(docs, membership_filter(twice, "h", filter_bits(twice.count()))), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("key"), F.col("c"))
    seeds = found.where("seed")
    first = (seeds.groupBy(F.col("h").alias("f_h"), F.col("body").alias("f_body"))
             .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    first = written(spark, first, "first-chunks")  # an aggregate in the join's own stage would keep it from being split
    repeats = seeds.join(first, (F.col("h") == F.col("f_h")) & (F.col("body") == F.col("f_body")))
    repeats = repeats.where((F.col("key") != F.col("first.key")) | (F.col("c") != F.col("first.c"))).select("key", "c", "u0", "marks", "first")
    repeats = written(spark, repeats.dropDuplicates(["key", "c"]), "repeated-chunks")  # rows equal in id and text are one document
    parts = repeats.select("key", "u0", "marks", F.col("first.doc_id").alias("first_doc_id")).unionByName(_extensions(repeats, found))
    parts = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("u0", "marks", "first_doc_id"))).alias("parts"))
    kind = repeats.schema["first"].dataType["doc_id"].dataType.simpleString()
    return _runs(parts.select("key", "parts"), min_lines, min_words, kind)


def dedup_lines(docs: DataFrame, spans_as: str | None = "removed", most: float = 1.0, **rule) -> DataFrame:
    """``docs`` (doc_id, text, ...) without repeated chunks.

    ``spans_as`` names an added column with the array of (start, end, first_doc_id) that were cut out of the original text
    (a column of that name in ``docs`` is replaced); None adds nothing. A document that would lose more than ``most`` of
    its characters stays whole: such a document is a copy, which is a matter of near-duplicate detection.
    """
    cols = [c for c in docs.columns if c != spans_as]
    own, its, spans, may = (free_name(docs, n) for n in ("row_key", "chunk_key", "chunk_spans", "may_have_spans"))
    cut = repeated_runs(docs, **rule).select(F.col("key").alias(its), F.col("spans").alias(spans))
    cut = written(docs.sparkSession, cut, "chunk-spans")
    has_spans = may_be_member(cut.select(F.xxhash64(its).alias("h")), "h")
    d = docs.withColumn(own, row_key(F.col("doc_id"), F.col("text")))
    d = d.withColumn(may, has_spans(F.xxhash64(own)))
    rest = d.where(~F.col(may))
    # a shuffle between the two Python steps, the test and the cut: a task holds one Python worker, not two, whatever the size of the spans
    d = d.where(may).join(cut.hint("merge"), F.col(own) == F.col(its), "left")
    if most < 1:
        lost = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
        d = d.withColumn(spans, F.when(lost <= most * F.length("text"), F.col(spans)))
    hit = F.size(spans) > 0
    text = F.when(hit, cut_spans(F.col("text"), F.col(spans)["start"], F.col(spans)["end"])).otherwise(F.col("text"))
    d = d.withColumn("text", text)
    if "n_chars" in cols:
        d = d.withColumn("n_chars", F.when(hit, F.length("text").cast(d.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    out = d.select(*[F.col(f"`{c}`") for c in cols], *([F.col(spans).alias(spans_as)] if spans_as else []))
    none = F.lit(None).cast(d.schema[spans].dataType).alias(spans_as) if spans_as else None
    return out.union(rest.select(*[F.col(f"`{c}`") for c in cols], *([none] if spans_as else [])))


def chunk_query(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the text that is left, and the removed spans as ``start:end:first_doc_id``."""
    d = dedup_lines(columns_of(docs, "doc_id", "text"))
    span = F.transform("removed", lambda r: F.concat_ws(":", r["start"], r["end"], F.coalesce(r["first_doc_id"].cast("string"), F.lit("-"))))
    return d.select("doc_id", "text", F.greatest(F.coalesce(F.size("removed"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce(F.array_join(span, ","), F.lit("")).alias("removed"))
