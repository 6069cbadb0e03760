"""Helpers shared by the corpus operators: row keys, folds, scratch tables, byte kernels.

The byte kernels read a string column's Arrow buffers as numpy arrays, so words
are found and hashed without making a Python object for each of them. Words are
``[^\\x20\\x09-\\x0D]+`` everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import scratch_path

#: The word pattern in Java, Python and RE2 syntax.
WORD_RE = r"[^\x20\x09-\x0D]+"


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; missing ones are null, so extra columns never clash with working names."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so (names compare without case, as Spark's do)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id is text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that identify a document: md5 over id and text. Rows equal in both are one document."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("\n"),
                                  F.coalesce(text, F.lit("\x00")))))


def text_digest(text: Column) -> Column:
    """16 bytes of md5 over the whole text."""
    return F.unhex(F.md5(text))


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared checkpoint folder as Parquet and read it back."""
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(n: int, size: int = 256) -> Iterator[slice]:
    """Few rows of an Arrow batch at a time, so that only they exist as Python objects."""
    return (slice(lo, min(lo + size, n)) for lo in range(0, n, size))


def least_hashed(values: DataFrame, column: str, most: int) -> DataFrame:
    """The ``most`` distinct values of a column with the least hashes (all, if fewer), as a DataFrame of that column.

    A threshold on the hash from the approximate number of distinct values lets some twice as many pass, so the top-n that follows
    gathers a bounded number of rows whatever the number of partitions, and repeated values count once.
    """
    h = F.xxhash64(column)
    n = values.agg(F.approx_count_distinct(column, 0.02).alias("n")).first().n or 0
    if n > 2 * most:
        values = values.where(h < F.lit((2 * most << 64) // n - (1 << 63)))
    return values.select(column).distinct().orderBy(h, F.col(column)).limit(most)


def cut_spans(text: Column, starts: Column, ends: Column) -> Column:
    """The text without the given code point spans (disjoint, ascending); texts without spans pass unchanged."""
    @F.arrow_udf("string")
    def cut(t, a, b):
        import pyarrow as pa

        parts = [pa.array([], pa.string())]
        for rows in slices(len(t)):
            out = []
            for x, s, e in zip(t[rows].to_pylist(), a[rows].to_pylist(), b[rows].to_pylist()):
                if x is not None and s:
                    at, kept = 0, []
                    for i, j in zip(s, e):
                        kept.append(x[at:i])
                        at = j
                    x = "".join([*kept, x[at:]])
                out.append(x)
            parts.append(pa.array(out, pa.string()))
        return pa.concat_arrays(parts)

    return cut(text, starts, ends)


#: Bits of a membership filter: 2 MiB, whatever the number of members.
FILTER_BITS = 1 << 24


def membership_filter(members: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of ``bits`` bits in which the bit ``value mod bits`` of every value of a long column is set.

    Its size is fixed, so it can be broadcast whatever the data. It only thins out rows before an exact
    join: with very many members it passes more rows, never fewer.
    """
    at = F.pmod(F.col(column), F.lit(bits)) + 1
    rows = (members.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p"))
            .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect())  # at most bits / 32768 rows of 4 KiB
    out = np.zeros(max(1, bits // 8), dtype=np.uint8)
    for r in rows:
        m = np.frombuffer(bytes(r.m), dtype=np.uint8)
        lo = (r.b - 1) * 4096
        out[lo:lo + 4096] = m[:len(out) - lo]
    return out


#: A filter sized from its members has 16 bits a member, 128 KiB at least and 32 MiB at most.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def filter_bits(members: int) -> int:
    """Bits (a power of two) of a filter of so many members. Beyond 16 million members it passes more than a few percent of the others."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * members).bit_length()))


def may_be_member(members: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test of a long column: false only where the value is not in ``column`` of ``members`` (a bitmap sized from their number, bounded)."""
    sc = members.sparkSession.sparkContext
    bitmap = sc.broadcast(membership_filter(members, column, filter_bits(members.count())))

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        return pd.Series(passes_filter(bitmap.value, h.to_numpy()))

    return may


def passes_filter(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each signed 64-bit value may be a member."""
    at = values.view(np.uint64) & np.uint64(len(bitmap) * 8 - 1)  # equals pmod: the number of bits is a power of two
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


# --- byte kernels -----------------------------------------------------------

#: Most text bytes handled by the numpy kernels at a time (a single longer text is one piece).
PIECE_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[0x20, 9, 10, 11, 12, 13]] = False
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


def text_buffers(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of an Arrow string column, without copying the bytes."""
    import pyarrow as pa

    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = (np.frombuffer(off, dtype=kind)[column.offset:column.offset + n + 1].astype(np.int64)
               if off is not None and n else np.zeros(n + 1, dtype=np.int64))
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    nulls = np.asarray(column.is_null())
    return raw, offsets, nulls


def pieces(offsets: np.ndarray, max_rows: int = 1 << 30, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose texts hold about ``size`` bytes together."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        b = min(b, a + max_rows, n)
        yield a, b
        a = b


def word_spans(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray | None = None):
    """(starts, ends, row) of the words of concatenated texts; ``bounds`` are the texts' offsets in ``data``."""
    w = _WORD_BYTE[data] if is_word is None else is_word
    n = len(w)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    at = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[at] = w[at]
    at = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    last[at] = w[at]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def span_hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives 64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[:len(data)], out=total[1:])
    return lambda starts, ends: mix64((total[ends] - total[starts]) * down[starts])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, as of ``span_hasher``."""
    return span_hasher(data)(starts, ends)


def window_hashes(words: np.ndarray, row: np.ndarray, n_rows: int, size: int):
    """Hashes of windows of ``size`` words within each row: (hash, row, index of the first word).

    A row with fewer words than ``size``, but at least one, has one window of all its words.
    """
    counts = np.bincount(row, minlength=n_rows)
    n = len(words)
    mult = [np.uint64(pow(_BASE, 2 * j + 3, 1 << 64)) for j in range(size)]
    out_h, out_r, out_i = [], [], []
    if n >= size:
        h = words[:n - size + 1] * mult[0]
        for j in range(1, size):
            h = h + words[j:n - size + 1 + j] * mult[j]
        keep = row[:n - size + 1] == row[size - 1:]
        out_h.append(h[keep])
        out_r.append(row[:n - size + 1][keep])
        out_i.append(np.flatnonzero(keep))
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.searchsorted(row, short)
        h = counts[short].astype(np.uint64)
        for j in range(size - 1):
            has = counts[short] > j
            h = h + np.where(has, words[np.minimum(first + j, n - 1)], np.uint64(0)) * mult[j]
        out_h.append(h)
        out_r.append(short)
        out_i.append(first)
    if not out_h:
        z = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), z, z
    h, r, i = np.concatenate(out_h), np.concatenate(out_r), np.concatenate(out_i)
    order = np.argsort(r, kind="stable")
    return mix64(h[order]), r[order], i[order]
