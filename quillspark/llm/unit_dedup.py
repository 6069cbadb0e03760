"""Substring dedup by hashing lines, paragraphs or passages.

A text's units are its lines (``unit="line"``), its paragraphs, that is runs of non-blank lines (``unit="paragraph"``), or its clauses:
lines cut where a punctuation mark is followed by white space. A unit is normalised (NFC, lower case, runs of white space as one
space) and hashed to 16 bytes. Digests are grouped over the whole corpus; the occurrence that ranks first, by doc_id (null last), then row key,
then position, is kept and every other one is a repeat. ``repeated_units`` reports the repeats of lines or paragraphs of at least ``min_words``
words. ``repeated_passages`` takes clauses of any length and reports the runs of adjacent repeats that have ``min_words`` words together, so a repeated
paragraph, a repeated line and a passage inside a line are all found, and a short clause that occurs everywhere is removed only within a longer
repeat. Each has its offsets in the original text.

Scale: no text is moved. Passages take two passes over the texts: the first counts 8-byte hashes of the units; those seen twice set bits of a
bitmap sized from their number (bounded), and the second emits small rows (digest, document, offsets) where the bit is set; all of them take part in
finding first occurrences, but only those in a long enough run of set bits can be removed and are joined. The digests' first
occurrences are a partial aggregate, so a unit that a third of all documents share costs each map task one row. They are written before the
repeats are joined to them, by a plain equi-join that adaptive execution splits where a digest is hot. Runs are a window over one document's repeats.

Edge cases: null and empty texts have no units; a null doc_id is ranked last; rows equal in doc_id and text are one document
(their units are listed for each of them, or for none; their runs once); a unit twice in one text keeps its first place;
an empty table gives an empty result; other columns are not read. Offsets are code points, end exclusive; a run holds the white space between
its units, not that around it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import columns_of, cut_spans, filter_bits, membership_filter, passes_filter, row_key, written

MIN_WORDS = 16
_LINE = re.compile(r"[^\n]+")
#: A clause with the white space behind it; these matches cover a text.
CLAUSE_RE = r"""[^\n]*?[.,;:!?]["')\]}]*[ \t\r\f\v]+|[^\n]*\n|[^\n]+"""
_CLAUSE = re.compile(CLAUSE_RE)
_SPACE = " \t\r\n\f\v"
_PARAGRAPH = re.compile(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*")


def normalised(unit: str) -> list[str]:
    """Words of the normalised unit."""
    if not unit.isascii():
        unit = unicodedata.normalize("NFC", unit)
    return unit.lower().split()


def units_of(text: str, unit: str = "line", min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, number of words, digest) of the units of a text that are long enough."""
    for m in (_LINE if unit == "line" else _PARAGRAPH).finditer(text):
        if m.end() - m.start() < 2 * min_words - 1:
            continue
        words = normalised(m.group())
        if len(words) >= min_words:
            yield m.start(), m.end(), len(words), hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"),
                                                                  digest_size=16).digest()


def unit_table(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, start, end, n_words, digest) of every unit of ``docs`` (doc_id, text)."""
    import pyarrow as pa

    d = columns_of(docs, "doc_id", "text")
    d = d.where("text is not null").select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    kind = d.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator) -> Iterator:
        for b in batches:
            rows, found = [], []
            for i, text in enumerate(b.column("text")):
                for u in units_of(text.as_py(), unit, min_words):
                    rows.append(i)
                    found.append(u)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(at), b.column("key").take(at),
                 pa.array([u[0] for u in found], pa.int64()), pa.array([u[1] for u in found], pa.int64()),
                 pa.array([u[2] for u in found], pa.int64()), pa.array([u[3] for u in found], pa.binary())],
                names=["doc_id", "key", "start", "end", "n_words", "digest"])

    return d.mapInArrow(scan, f"doc_id {kind}, key binary, start long, end long, n_words long, digest binary")


def repeated_units(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """Units to remove: (doc_id, start, end, n_words, first_doc_id, first_start, key).

    ``first_*`` is the kept occurrence; ``key`` is the row key of the document.
    """
    units = written(docs.sparkSession, unit_table(docs, unit, min_words), "units")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("key"), F.col("start"))
    first = (units.groupBy(F.col("digest").alias("f_digest"))
             .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    out = units.join(first, F.col("digest") == F.col("f_digest"))
    out = out.where((F.col("key") != F.col("first.key")) | (F.col("start") != F.col("first.start")))
    return out.select("doc_id", "start", "end", "n_words", F.col("first.doc_id").alias("first_doc_id"),
                      F.col("first.start").alias("first_start"), "key")


def remove_units(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the repeated units; adds ``removed``, the array of (start, end) in the original text (it replaces a column of that name)."""
    cols = [c for c in docs.columns if c != "removed"]
    spans = (repeated.groupBy(F.col("key").alias("__unit_key"))
             .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__removed")))
    d = docs.withColumn("__key", row_key(F.col("doc_id"), F.col("text"))).join(spans, F.col("__key") == F.col("__unit_key"), "left")
    d = d.withColumn("text", cut_spans(F.col("text"), F.col("__removed.start"), F.col("__removed.end")))
    return d.select(*[F.col(f"`{c}`") for c in cols], F.coalesce("__removed", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("removed"))


def clauses_of(text: str) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(number, start, end, number of words, digest) of the clauses of a text that have a word; numbers count these."""
    i = 0
    for m in _CLAUSE.finditer(text):
        words = normalised(m.group())
        if words:
            start = m.end() - len(m.group().lstrip(_SPACE))
            yield i, start, m.start() + len(m.group().rstrip(_SPACE)), len(words), hashlib.blake2b(
                " ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
            i += 1


def _clause_rows(docs: DataFrame, bitmap=None, min_words: int = MIN_WORDS) -> DataFrame:
    """Without a bitmap (h) of every clause, else (doc_id, key, i, start, end, n_words, digest, long) of those whose bit is set.

    ``long`` tells that the run of adjacent clauses whose bits are set has ``min_words`` words; no run of repeats outside such a run can have them.
    """
    import pyarrow as pa

    d = columns_of(docs, "doc_id", "text").where("text is not null")
    known = docs.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None
    kind = d.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator) -> Iterator:
        for b in batches:
            rows, found = [], []
            for n, text in enumerate(b.column("text")):
                at = len(found)
                found.extend(clauses_of(text.as_py()))
                rows += [n] * (len(found) - at)
            if not found:
                continue
            i, start, end, words, digest = zip(*found)
            h = np.frombuffer(b"".join(digest), dtype=np.int64)[::2]
            if known is None:
                yield pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])
                continue
            may = passes_filter(known.value, np.ascontiguousarray(h))
            run = np.cumsum(~may | (np.array(i) == 0))
            long = np.bincount(run, weights=np.array(words) * may)[run] >= min_words
            keep = pa.array(np.flatnonzero(may))
            of = pa.array(rows, pa.int64()).take(keep)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(of), b.column("key").take(of), *(pa.array(x, pa.int64()).take(keep) for x in (i, start, end, words)),
                 pa.array(digest, pa.binary()).take(keep), pa.array(long[may])],
                names=["doc_id", "key", "i", "start", "end", "n_words", "digest", "long"])

    if known is None:
        return d.select("text").mapInArrow(scan, "h long")
    d = d.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    return d.mapInArrow(scan, f"doc_id {kind}, key binary, i long, start long, end long, n_words long, digest binary, long boolean")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs to remove: (doc_id, start, end, n_units, n_words, first_doc_id, first_start, key).

    ``first_*`` is the kept occurrence of the run's first clause; ``key`` is the row key of the document.
    """
    spark = docs.sparkSession
    twice = written(spark, _clause_rows(docs).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "repeated-hashes")
    units = written(spark, _clause_rows(docs, membership_filter(twice, "h", filter_bits(twice.count())), min_words), "clauses")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("key"), F.col("start"))
    first = (units.groupBy(F.col("digest").alias("f_digest"))
             .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    first = written(spark, first, "first-clauses")  # an aggregate in the join's own stage would keep it from being split
    out = units.where("long").join(first, F.col("digest") == F.col("f_digest"))
    out = out.where((F.col("key") != F.col("first.key")) | (F.col("start") != F.col("first.start")))
    out = out.select("key", "i", "doc_id", "start", "end", "n_words", "first").dropDuplicates(["key", "i"])
    out = out.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy("key").orderBy("i")))
    first = F.min_by("first", "i")
    out = out.groupBy("key", "run").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_units"),
                                        F.sum("n_words").alias("n_words"), first.getField("doc_id").alias("first_doc_id"), first.getField("start").alias("first_start"))
    return out.where(F.col("n_words") >= min_words).select("doc_id", "start", "end", "n_units", "n_words", "first_doc_id", "first_start", "key")


def unit_query(docs: DataFrame) -> DataFrame:
    return repeated_passages(docs).drop("key")


#: The same rows in DuckDB (ids are unique there, so the row key never decides).
UNIT_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(x) AS l, generate_subscripts(x, 1) AS k
           FROM (SELECT doc_id, regexp_extract_all(text, '{CLAUSE_RE.replace("'", "''")}') AS x FROM documents WHERE text IS NOT NULL)),
p AS (SELECT doc_id, k, l, (sum(length(l)) OVER (PARTITION BY doc_id ORDER BY k) - length(l))::BIGINT AS s,
             trim(regexp_replace(lower(nfc_normalize(l)), '\s+', ' ', 'g')) AS norm FROM l),
u AS (SELECT doc_id, s + length(l) - length(ltrim(l, E' 	
')) AS s, s + length(rtrim(l, E' 	
')) AS e,
             len(string_split(norm, ' '))::BIGINT AS n_words, norm, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM p WHERE norm <> ''),
r AS (SELECT *, row_number() OVER o AS nth, first_value(doc_id) OVER o AS first_doc_id, first_value(s) OVER o AS first_start
      FROM u WINDOW o AS (PARTITION BY norm ORDER BY doc_id NULLS LAST, s)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r WHERE nth > 1)
SELECT doc_id, min(s) AS start, max(e) AS "end", count(*)::BIGINT AS n_units, sum(n_words)::BIGINT AS n_words,
       min_by(first_doc_id, i) AS first_doc_id, min_by(first_start, i) AS first_start
FROM g GROUP BY doc_id, run HAVING sum(n_words) >= {MIN_WORDS}
"""
