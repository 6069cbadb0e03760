"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of canonical tokens: numbers, names and units are replaced by typed placeholders
(``<num>`` for tokens that start with a digit, ``<unit>`` for a unit word after a number, ``<name>`` for a
capitalised token that is no function word), neighbouring numbers and neighbouring names become one, other tokens
are lower-cased. Windows of ``WINDOW`` canonical tokens of documents are hash-joined with those of benchmark items. A
question that was copied with other numbers or names so still matches. Matches of one document and
item on one diagonal (document position minus item position) are one aligned occurrence; there every slot value of the
item must map to one value of the document and back. Occurrences of which fewer than ``min_consistency``
of the slot pairs agree are dropped. A document is contaminated by an item if consistent occurrences cover at
least ``min_coverage`` of the item's windows.

Placeholders depend on case, and names and numbers alone are no evidence. So every text also has a literal form: all its tokens,
lower-cased, none replaced. Windows of it meet the items' literal windows in the same join, and an item is found as well
if these cover it; copies in other case, and items of names or numbers only, are found so. What the template form finds is
not reported again by the literal form.

Items with fewer tokens than a window have one window of all their tokens; forms with fewer than
``MIN_TOKENS`` are not judged. Template windows of which less than half are literal words are no evidence and not counted.
Lower case is that of letters of one or two UTF-8 bytes (Latin, Greek, Cyrillic, Armenian).

Scale: tokens and windows are computed with numpy on the Arrow buffers. The benchmark's window hashes set bits of a
bitmap of fixed size, which thins the documents' windows before they are shuffled; the join itself is exact, on
(hash). Items equal in template and in the pattern of equal slots are one item there, so a popular template does not
multiply matches. Per document, item and diagonal there are at most as many rows as the item has windows.

Edge cases: null and empty texts or items have no windows; a null doc_id is reported as null; items are told apart by their form, so
null and repeated item ids lose nothing (a form whose ids are all null is reported as null); rows equal in doc_id and
text are one document and reported once; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import (
    columns_of, membership_filter, mix64, passes_filter, pieces, row_key, span_hashes, text_buffers, window_hashes,
    word_spans, written,
)

WINDOW = 8
MIN_TOKENS = 4
MIN_COVERAGE = 0.5
MIN_CONSISTENCY = 0.8
#: Unit words that count as a unit after a number.
UNITS = (
    "mm cm m km in ft yd mi mile miles inch inches foot feet yard yards meter meters metre metres kilometer kilometers "
    "kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonnes "
    "ml cl l liter liters litre litres gallon gallons s sec min h hr second seconds minute minutes hour hours day days "
    "week weeks month months year years percent degrees degree c f k mph kmh w kw mw v a hz khz mhz ghz kb mb gb tb "
    "dollar dollars cent cents euro euros usd eur gbp"
).split()
#: Capitalised function words that are not names.
FUNCTION_WORDS = (
    "a an and are as at be but by can did do does each every find for from given had has have he her his how i if in is it "
    "its let many much no not of on one or she so some suppose that the their then there these they this to under was we "
    "were what when where which who why will with you your"
).split()

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[ord("0"):ord("9") + 1] = _TOKEN[ord("A"):ord("Z") + 1] = _TOKEN[ord("a"):ord("z") + 1] = True
_TOKEN[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
#: Lower case of letters of two bytes, by both bytes.
_FOLD_PAIR = np.arange(65536, dtype=np.uint16)
for _cp in range(0x80, 0x800):
    _low = chr(_cp).lower().encode()
    if len(_low) == 2:
        _FOLD_PAIR[int.from_bytes(chr(_cp).encode(), "big")] = int.from_bytes(_low, "big")
_STOP = np.zeros(256, dtype=np.int32)
_STOP[[ord(c) for c in ".!?;:\n"]] = 1
_NUM, _NAME, _UNIT = (np.uint64(x) for x in (11, 22, 33))
#: Sets literal windows apart from template windows.
_LITERAL = np.uint64(0xA0761D6478BD642F)


def _hashes_of(words) -> np.ndarray:
    data = np.frombuffer("\n".join(words).encode(), dtype=np.uint8)
    s, e, _ = word_spans(data, np.array([0, len(data)]))
    return np.sort(span_hashes(data, s, e))


_UNIT_HASH, _FUNCTION_HASH = _hashes_of(UNITS), _hashes_of(FUNCTION_WORDS)


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def tokens(data: np.ndarray, bounds: np.ndarray):
    """(starts, ends, row, hash of the lower-cased token) of the tokens of concatenated texts."""
    starts, ends, row = word_spans(data, bounds, _TOKEN[data])
    folded = _FOLD[data]
    lead = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] <= 0xDF))
    if len(lead):
        pair = _FOLD_PAIR[(data[lead].astype(np.int64) << 8) | data[lead + 1]]
        folded[lead], folded[lead + 1] = pair >> 8, pair & 255
    h = span_hashes(folded, starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
    return starts, ends, row, h


def canonical(data: np.ndarray, bounds: np.ndarray, found=None):
    """(code, slot, row) of the canonical tokens of concatenated texts; slot is 0 for a literal word, else a hash of its value.

    ``found`` are the texts' ``tokens``, if the caller has them.
    """
    starts, ends, row, h = tokens(data, bounds) if found is None else found
    n = len(starts)
    if n == 0:
        z = np.zeros(0, dtype=np.uint64)
        return z, z, row
    # two-byte Latin capitals (C3 80..9E without C3 97)
    latin = np.zeros(len(data), dtype=bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    first = data[starts]
    second = np.minimum(starts + 1, len(data) - 1)
    number = (first >= ord("0")) & (first <= ord("9"))
    capital = ((first >= ord("A")) & (first <= ord("Z"))) | ((first == 0xC3) & latin[second])
    name = capital & ~_in(h, _FUNCTION_HASH)
    same_row = np.zeros(n, dtype=bool)
    same_row[1:] = row[1:] == row[:-1]
    unit = np.zeros(n, dtype=bool)
    unit[1:] = number[:-1] & same_row[1:]
    unit &= _in(h, _UNIT_HASH) & ~number
    name &= ~unit
    kind = np.where(number, 1, np.where(unit, 3, np.where(name, 2, 0)))
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    apart = np.zeros(n, dtype=bool)  # a sentence mark followed by space parts names; "3.5" and "1,000" stay one number
    apart[1:] = (stops[starts[1:]] - stops[ends[:-1]] > 0) & ((starts[1:] - ends[:-1] > 1) | (kind[1:] != 1))
    joins = np.zeros(n, dtype=bool)
    joins[1:] = same_row[1:] & (kind[1:] == kind[:-1]) & ((kind[1:] == 1) | (kind[1:] == 2)) & ~apart[1:]
    heads = np.flatnonzero(~joins)
    value = mix64(np.add.reduceat(h, heads) + np.uint64(1))
    k = kind[heads]
    code = np.where(k == 0, h[heads], np.where(k == 1, _NUM, np.where(k == 2, _NAME, _UNIT)))
    return code, np.where(k == 0, np.uint64(0), value | np.uint64(1)), row[heads]


def canonical_windows(code, slot, row, n_rows: int, size: int, whole_only: bool = False):
    """(hash, row, position in the row, slots array) of informative windows of ``size`` tokens.

    With ``whole_only`` only rows of exactly ``size`` tokens give a window.
    """
    counts = np.bincount(row, minlength=n_rows)
    h, r, i = window_hashes(code, row, n_rows, size)
    first = np.concatenate([[0], np.cumsum(counts)])
    full = counts[r] >= size
    if whole_only:
        full &= counts[r] == size
    h, r, i = h[full], r[full], i[full]
    if len(h):
        literal = np.concatenate([[0], np.cumsum(slot == 0)])
        good = 2 * (literal[i + size] - literal[i]) >= size
        h, r, i = h[good], r[good], i[good]
    return h, r, i - first[r], i


def literal_windows(found, n_rows: int, size: int):
    """(hash, row, position in the row) of the windows of ``size`` lower-cased tokens of texts with tokens ``found``."""
    _, _, row, h = found
    w, r, _, i = canonical_windows(h, np.zeros(len(h), dtype=np.uint64), row, n_rows, size)
    return mix64(w ^ _LITERAL), r, i - np.searchsorted(row, r)


def _slot_lists(slot: np.ndarray, at: np.ndarray, size: int):
    import pyarrow as pa

    values = slot[at[:, None] + np.arange(size)].view(np.int64).ravel() if len(at) else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * size, pa.int32()), pa.array(values))


def item_table(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, literal, form, template_form, size, n_windows, windows array<struct<h, ipos, islots>>) of the judged forms of the items.

    ``form`` is a digest of what the windows are made from; rows with the same one have the same windows. Slots are numbered by their
    values' first places. ``template_form`` is, on a literal form, the digest of the item's template form if that is judged.
    """
    import pyarrow as pa

    d = columns_of(benchmark, "item_id", "text").where("text is not null")
    kind = d.schema["item_id"].dataType.simpleString()

    def scan(batches: Iterator) -> Iterator:
        for b in batches:
            out = []
            raw, offsets, _ = text_buffers(b.column("text"))
            ids = b.column("item_id").to_pylist()
            for i in range(len(ids)):
                data = raw[offsets[i]:offsets[i + 1]]
                found = tokens(data, np.array([0, len(data)]))
                template = None
                code, slot, row = canonical(data, np.array([0, len(data)]), found)
                size = min(window, len(code))
                h, _, pos, at = canonical_windows(code, slot, row, 1, size) if size >= MIN_TOKENS else ((),) * 4
                if len(h):
                    seen: dict[int, int] = {}
                    pattern = np.array([seen.setdefault(int(v), len(seen) + 1) if v else 0 for v in slot], dtype=np.int64)
                    template = _form(b"template", code, pattern)
                    out.append({"item_id": ids[i], "literal": False, "form": template, "template_form": None, "size": size, "n_windows": len(h),
                                "windows": [{"h": int(x), "ipos": int(p), "islots": pattern[a:a + size].tolist()}
                                            for x, p, a in zip(h.view(np.int64), pos, at)]})
                size = min(window, len(found[3]))
                if size >= MIN_TOKENS:
                    h, _, pos = literal_windows(found, 1, size)
                    out.append({"item_id": ids[i], "literal": True, "form": _form(b"literal", found[3]), "template_form": template, "size": size,
                                "n_windows": len(h), "windows": [{"h": int(x), "ipos": int(p), "islots": []} for x, p in zip(h.view(np.int64), pos)]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("item_id", b.schema.field("item_id").type), ("literal", pa.bool_()), ("form", pa.binary()), ("template_form", pa.binary()),
                ("size", pa.int32()), ("n_windows", pa.int64()),
                ("windows", pa.list_(pa.struct([("h", pa.int64()), ("ipos", pa.int64()), ("islots", pa.list_(pa.int64()))])))]))

    return d.mapInArrow(scan, f"item_id {kind}, literal boolean, form binary, template_form binary, size int, n_windows long, "
                              "windows array<struct<h:bigint,ipos:bigint,islots:array<bigint>>>")


def _form(kind: bytes, *parts: np.ndarray) -> bytes:
    return hashlib.blake2b(b"".join([kind, *(x.tobytes() for x in parts)]), digest_size=16).digest()


def document_windows(docs: DataFrame, bitmap: np.ndarray, sizes: list[tuple[bool, int]]) -> DataFrame:
    """(key, doc_id, h, pos, slots) of the documents' windows, of the given (literal, size), that may be windows of the benchmark."""
    import pyarrow as pa

    d = columns_of(docs, "doc_id", "text").where("text is not null")
    d = d.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator) -> Iterator:
        for b in batches:
            raw, offsets, _ = text_buffers(b.column("text"))
            for lo, hi in pieces(offsets):
                data, bounds = raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                tok = tokens(data, bounds)
                code, slot, row = canonical(data, bounds, tok)
                for literal, size in sizes:
                    if literal:
                        h, r, pos = literal_windows(tok, hi - lo, size)
                    else:
                        h, r, pos, at = canonical_windows(code, slot, row, hi - lo, size)
                    h = h.view(np.int64)
                    keep = np.flatnonzero(passes_filter(known.value, h))
                    if not len(keep):
                        continue
                    rows = pa.array(r[keep] + lo)
                    lists = _slot_lists(slot, at[keep], size) if not literal else _slot_lists(slot, keep, 0)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("key").take(rows), b.column("doc_id").take(rows), pa.array(h[keep]), pa.array(pos[keep]),
                         lists], names=["key", "doc_id", "h", "pos", "slots"])

    return d.mapInArrow(scan, f"key binary, doc_id {kind}, h long, pos long, slots array<bigint>")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE,
                 min_consistency: float = MIN_CONSISTENCY) -> DataFrame:
    """(key, doc_id, item_id, n_items, n_matched, n_windows, coverage) of every contaminated document and item.

    ``item_id``, the least one, stands for all ``n_items`` rows of the benchmark with its form: its template and slot pattern or, where only
    the literal form is found, its lower-cased tokens. It is null if all of them have none.
    """
    spark = docs.sparkSession
    items = written(spark, item_table(benchmark, window), "items")
    forms = items.groupBy("form").agg(
        F.first("literal").alias("literal"), F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"),
        F.first("n_windows").alias("n_windows"), F.first("size").alias("size"), F.first("windows").alias("windows"))
    ones = forms.select("form", "literal", "n_windows", "size", F.explode("windows").alias("w")).select(
        "form", "literal", "n_windows", "size", F.col("w.h").alias("w_h"), F.col("w.ipos").alias("ipos"), F.col("w.islots").alias("islots"))
    ones = written(spark, ones, "item-windows")
    # at most ``window`` numbers of each kind
    sizes = sorted((r["literal"], r["size"]) for r in ones.select("literal", "size").distinct().collect())
    found = written(spark, document_windows(docs, membership_filter(ones, "w_h"), sizes), "windows")
    pair = F.arrays_zip(F.col("islots").alias("i"), F.col("slots").alias("d"))
    m = found.join(ones, F.col("h") == F.col("w_h")).select(
        "key", "doc_id", "form", "n_windows", "ipos", (F.col("pos") - F.col("ipos")).alias("diagonal"),
        F.filter(pair, lambda p: p["i"] != 0).alias("pairs"))
    run = m.groupBy("key", "form", "diagonal").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_windows").alias("n_windows"),
        F.collect_set("ipos").alias("at"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    n_pairs = F.size("pairs")
    agree = F.least(F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))),
                    F.size(F.array_distinct(F.transform("pairs", lambda p: p["d"]))))
    run = run.where((n_pairs == 0) | (agree >= n_pairs * min_consistency))
    out = run.groupBy("key", "form").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_windows").alias("n_windows"),
        F.size(F.array_distinct(F.flatten(F.collect_set("at")))).cast("long").alias("n_matched"))
    out = out.withColumn("coverage", F.col("n_matched") / F.col("n_windows")).where(F.col("coverage") >= min_coverage)
    out = written(spark, out, "contaminated")
    # literal forms of which an item's template form is found in the same document
    both = items.where("literal and template_form is not null").select(F.col("form").alias("l_form"), "template_form").distinct()
    known = (out.select("key", "form").join(both, F.col("form") == F.col("template_form"))
             .select(F.col("key").alias("l_key"), "l_form").distinct())
    out = out.join(known, (F.col("key") == F.col("l_key")) & (F.col("form") == F.col("l_form")), "left_anti")
    out = out.join(forms.select(F.col("form").alias("f_form"), "item_id", "n_items"), F.col("form") == F.col("f_form"))
    return out.select("key", "doc_id", "item_id", "n_items", "n_matched", "n_windows", "coverage")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **args) -> DataFrame:
    """The rows of ``docs`` that no item contaminates; all columns pass through."""
    bad = contaminated(docs, benchmark, **args).select(F.col("key").alias("__bad_key")).distinct()
    d = docs.withColumn("__row_key", row_key(F.col("doc_id"), F.col("text")))
    return d.join(bad, F.col("__row_key") == F.col("__bad_key"), "left_anti").drop("__row_key")


def decontam_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark).drop("key")
