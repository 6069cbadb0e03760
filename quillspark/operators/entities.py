"""Entity recognition (T2) and span resolution.

Four ways to get entity spans, all giving half-open code-point offsets of
the original text, resolved leftmost first, then longest, never overlapping:

* gazetteer ``(surface, label)`` of checked, bounded size: matched inside
  each row (``add_entity_spans_inline``): hashed literal sets, n-grams only
  at tokens that start a surface; offsets and overlaps in one linear pass
  over Arrow batches. No shuffle.
* bigger gazetteer of checked bytes (``gazetteer_trie``): a token trie in
  flat arrays walked by whole Arrow batches. No shuffle.
* bigger still (``detect_entities_joined``): the texts are exploded into
  n-grams, which are joined to the gazetteer (broadcast when its size allows,
  salted otherwise); those that are surfaces are regrouped by text and joined
  to the rows, where they are placed as on the first path.
* a recogniser model (``detect_entities_with_model``): a user factory run
  once per task, applied to Arrow batches of texts; its label names are
  mapped onto the default set.

Spans depend on the text alone, so the joined path is keyed by a digest of the
text, never by the user's row key: rows with null or repeated keys are matched
like any other, and every input row gives one output row on all paths.

Gazetteer matches are exact and case-sensitive on token n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import TOKEN_RE
from quillspark.operators.gazetteer_trie import TRIE_MAX_BYTES, Trie, add_entity_spans_trie, gazetteer_trie
from quillspark.operators.joins import dictionary_join

SPAN_TYPE = "array<struct<start:int,end:int,label:string>>"


def tokens_and_seps(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``_toks``, the tokens of a text, and ``_seps``, what stands before each and behind the last.

    A one-row generator is the materialisation point: the optimizer does not
    substitute generator outputs into later expressions.
    """
    text = F.col(text_col)
    return df.select("*", F.inline(F.array(F.struct(
        F.regexp_extract_all(text, F.lit(TOKEN_RE), 0).alias("_toks"),
        F.split(text, TOKEN_RE, -1).alias("_seps")))))


def _positions(toks: Column) -> Column:
    return F.when(F.size(toks) > 0, F.sequence(F.lit(0), F.size(toks) - 1)).otherwise(F.array().cast("array<int>"))


def _grams_at(toks: Column, seps: Column, i: Column, max_n: int) -> Column:
    """(i, surface) of 1..max_n tokens from i: tok_i, then (separator, token) pairs; null past the end."""
    grams, surface = [], toks[i]
    for n in range(1, max_n + 1):
        if n > 1:
            surface = F.concat(surface, F.get(seps, i + n - 1), F.get(toks, i + n - 1))
        grams.append(F.struct(i.alias("i"), surface.alias("surface")))
    return F.array(*grams)


def gazetteer_ngrams(df: DataFrame, id_col: str, text_col: str, max_n: int) -> DataFrame:
    """(id, i, surface) for every n-gram of 1..max_n tokens of a text, from token i; map-only."""
    toks, seps = F.col("_toks"), F.col("_seps")
    st = tokens_and_seps(df.select(id_col, text_col), text_col).select(id_col, "_toks", "_seps", F.explode(_positions(toks)).alias("i"))
    g = st.select(id_col, F.inline(_grams_at(toks, seps, F.col("i"), max_n)))
    return g.where(F.col("surface").isNotNull())


def prepare_gazetteer(gazetteer: DataFrame) -> tuple[DataFrame, int]:
    """One label per surface (smallest) and the longest surface in tokens; entries with a null part are no entries."""
    g = _entries(gazetteer)
    g = g.withColumn("n_tok", F.size(F.regexp_extract_all("surface", F.lit(TOKEN_RE), 0)))
    max_n = g.agg(F.max("n_tok")).first()[0] or 1
    return g.select("surface", "label"), int(max_n)


def _entries(gazetteer: DataFrame) -> DataFrame:
    g = gazetteer.where(F.col("surface").isNotNull() & F.col("label").isNotNull())
    return g.groupBy("surface").agg(F.min("label").alias("label"))


def leftmost_longest(spans: list[tuple[int, int, str]]) -> list[dict]:
    """Sorted by start, longest first; those that overlap an earlier pick are dropped."""
    last, chosen = 0, []
    for start, neg, end, label in sorted((s, s - e, e, lab) for s, e, lab in spans):
        if start >= last:
            chosen.append({"start": start, "end": end, "label": label})
            last = end
    return chosen


def resolve_spans(cands: Column) -> Column:
    """Leftmost, then longest; drop candidates overlapping an earlier pick (linear after the sort; null gives none)."""
    @F.pandas_udf(SPAN_TYPE)
    def resolve(starts: pd.Series, ends: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([
            [] if s is None else leftmost_longest([(int(a), int(b), lab) for a, b, lab in zip(s, e, x)])
            for s, e, x in zip(starts, ends, labels)])

    return resolve(cands["start"], cands["end"], cands["label"])


#: Rows whose spans are placed at a time.
PLACE_ROWS = 512


def _ends(lists) -> np.ndarray:
    """Bounds of each list in the flattened values of an Arrow list array; null lists are empty."""
    import pyarrow.compute as pc

    return np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64))])


def _spans_of_hits(seps: Column, toks: Column, hits: Column) -> Column:
    """Spans of hits (i: token, surface, label): one running sum over the row's token lengths, then resolved."""
    @F.arrow_udf(SPAN_TYPE)
    def place(sep, tok, at, size, label):
        import pyarrow as pa

        of = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))
        # rows with hits only, and of these so many at a time: what is held beside the batch does not grow with it
        rows = np.flatnonzero(np.diff(_ends(at)))
        spans = []
        for part in np.split(rows, range(PLACE_ROWS, len(rows), PLACE_ROWS)):
            some = pa.array(part)
            s, t, i, n, lab = (c.take(some) for c in (sep, tok, at, size, label))
            s0, t0, i0 = _ends(s), _ends(t), _ends(i)
            s, t, i, n = (np.asarray(c.flatten()) for c in (s, t, i, n))
            lab = lab.flatten().to_pylist()
            for k in range(len(part)):
                own = t[t0[k]:t0[k + 1]]
                start = np.cumsum(s[s0[k]:s0[k] + len(own)] + own) - own
                here = slice(i0[k], i0[k + 1])
                first = start[i[here]]
                spans.append([(x["start"], x["end"], x["label"])
                              for x in leftmost_longest(list(zip(first.tolist(), (first + n[here]).tolist(), lab[here])))])
        sizes = np.zeros(len(at) + 1, dtype=np.int32)
        sizes[rows + 1] = [len(x) for x in spans]
        flat = [x for row in spans for x in row]
        values = pa.StructArray.from_arrays(
            [pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.string())],
            fields=list(of.value_type))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), values, type=of)

    some = F.size(hits) > 0  # lengths are needed only where something was found
    # all of it under the same condition: a null for every array of the other rows
    return place(F.when(some, F.transform(seps, F.length)), F.when(some, F.transform(toks, F.length)),
                 F.when(some, hits["i"]), F.when(some, F.transform(hits["surface"], F.length)), F.when(some, hits["label"]))


# Gazetteers up to this many surfaces are matched inside each row (hashed
# literal sets, no shuffle); bigger ones are a trie, or joined when that is too big.
# At 15,000 surfaces the trie takes less than half the time of the sets, at a dozen about as long.
INLINE_MAX_SURFACES = 2_000


def inline_sets(gazetteer: DataFrame, max_surfaces: int = INLINE_MAX_SURFACES) -> tuple[dict[str, list[str]], int] | None:
    """Surfaces per label and the longest surface in tokens, when the
    (deduplicated) gazetteer is small enough; else None.

    One bounded read: at most ``max_surfaces + 1`` short rows reach the
    driver, which is how the size is checked.
    """
    import regex

    rows = _entries(gazetteer).limit(max_surfaces + 1).collect()
    if len(rows) > max_surfaces:
        return None
    sets: dict[str, list[str]] = {}
    max_n = 1
    for r in rows:
        sets.setdefault(r["label"], []).append(r["surface"])
        max_n = max(max_n, len(regex.findall(TOKEN_RE, r["surface"])))
    return sets, max_n


def add_entity_spans_inline(df: DataFrame, text_col: str, sets: dict[str, list[str]], max_n: int,
                            out: str = "entities") -> DataFrame:
    """T2 within the row into ``out`` array<struct<start,end,label>>.

    Only positions whose token begins some surface are expanded (one hashed
    membership test per token); at those, n-grams of 1..max_n tokens are
    looked up in the per-label hashed sets; offsets are computed in rows with
    hits only, from one running sum; overlaps are resolved leftmost, then longest.

    Higher-order functions run interpreted, element by element, so the work
    per token is kept to that single test. Tokens and separators are
    materialised per row first: an expression referenced inside a lambda
    runs once per element, so the regex must never be inlined there.
    """
    labels = sorted(sets)
    firsts = sorted({_first_token(sf) for lab in labels for sf in sets[lab]})
    st = tokens_and_seps(df, text_col)
    toks, seps = F.col("_toks"), F.col("_seps")

    def label_of(surface: Column) -> Column:
        expr = None
        for lab in labels:
            cond = surface.isin(*sets[lab])
            expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
        return expr if expr is not None else F.lit(None).cast("string")

    st = st.withColumn("_starts", F.filter(_positions(toks), lambda i: toks[i].isin(*firsts)))
    cands = F.filter(F.flatten(F.transform(F.col("_starts"), lambda i: _grams_at(toks, seps, i, max_n))), lambda g: g["surface"].isNotNull())
    st = st.withColumn("_hits", F.filter(
        F.transform(cands, lambda g: F.struct(g["i"].alias("i"), g["surface"].alias("surface"),
                                              label_of(g["surface"]).alias("label"))),
        lambda g: g["label"].isNotNull()))

    st = st.withColumn(out, _spans_of_hits(seps, toks, F.col("_hits")))
    return st.drop("_toks", "_seps", "_starts", "_hits")


def _first_token(surface: str) -> str:
    """First token of a surface, by the same pattern as the column tokenizer."""
    import regex

    m = regex.search(TOKEN_RE, surface)
    return m.group(0) if m else surface


def detect_entities(df: DataFrame, gazetteer: DataFrame, id_col: str = "index", text_col: str = "sentence",
                    out: str = "entities", inline_max: int = INLINE_MAX_SURFACES, trie_max: int = TRIE_MAX_BYTES) -> DataFrame:
    """(id, entities) for rows with at least one match."""
    ents = with_entities(df.select(id_col, text_col), gazetteer, text_col, out, inline_max, trie_max=trie_max)
    return ents.select(id_col, out).where(F.size(out) > 0)


def gazetteer_hits(df: DataFrame, gazetteer: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, _hits): the (i, surface, label) of a text's n-grams that are surfaces, for texts with some.

    N-grams are made and joined where the texts are (broadcast when the size allows, salted otherwise), and only those that are
    surfaces move. Rows equal in id are one text. Of the surfaces from one token only the longest can be chosen: the others go here.
    """
    gaz, max_n = prepare_gazetteer(gazetteer)
    grams = gazetteer_ngrams(df, id_col, text_col, max_n)
    hits = dictionary_join(grams, gaz, "surface", "inner", salt_from=F.xxhash64(id_col, "i"))
    hits = hits.select(id_col, "i", "surface", "label").distinct()
    w = Window.partitionBy(id_col).orderBy("i", F.length("surface").desc())
    hits = hits.withColumn("_before", F.lag("i").over(w)).where(~F.col("_before").eqNullSafe(F.col("i")))
    return hits.groupBy(id_col).agg(F.collect_list(F.struct("i", "surface", "label")).alias("_hits"))


def _placed(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with the spans of its ``_hits`` in place of them; the text is cut into tokens again where there are hits only."""
    st = tokens_and_seps(df.withColumn("_hit_text", F.when(F.col("_hits").isNotNull(), F.col(text_col))), "_hit_text")
    st = st.withColumn(out, _spans_of_hits(F.col("_seps"), F.col("_toks"), F.col("_hits")))
    return st.drop("_toks", "_seps", "_hits", "_hit_text")


def detect_entities_joined(df: DataFrame, gazetteer: DataFrame, id_col: str = "index", text_col: str = "sentence",
                           out: str = "entities") -> DataFrame:
    """T2 for big gazetteers over rows with a unique, non-null ``id_col``: (id, spans) of rows with some."""
    rows = df.select(id_col, text_col)
    return _placed(rows.join(gazetteer_hits(rows, gazetteer, id_col, text_col), id_col), text_col, out).select(id_col, out)


def gazetteer_matcher(gazetteer: DataFrame, inline_max: int = INLINE_MAX_SURFACES,
                      trie_max: int = TRIE_MAX_BYTES) -> tuple[dict[str, list[str]], int] | Trie | None:
    """What the rows can be matched with: literal sets, a trie, or None when the gazetteer is too big for both."""
    small = inline_sets(gazetteer, inline_max)
    if small is not None or trie_max <= 0:
        return small
    return gazetteer_trie(_entries(gazetteer), trie_max)


def with_entities(df: DataFrame, gazetteer: DataFrame, text_col: str = "sentence", out: str = "entities",
                  inline_max: int = INLINE_MAX_SURFACES, sets: tuple[dict[str, list[str]], int] | Trie | None = None,
                  trie_max: int = TRIE_MAX_BYTES) -> DataFrame:
    """``df`` plus its entity spans (empty array when none), one output row per input row. ``sets``: result of
    ``gazetteer_matcher`` when already computed. Above ``inline_max`` surfaces a trie is matched, and above ``trie_max`` bytes
    of it (0: always) the texts' n-grams are joined."""
    known = sets if sets is not None else gazetteer_matcher(gazetteer, inline_max, trie_max)
    if isinstance(known, Trie):
        return add_entity_spans_trie(df, text_col, known, out, SPAN_TYPE)
    if known is not None:
        return add_entity_spans_inline(df, text_col, *known, out=out)
    keyed = df.withColumn("_text_key", F.unhex(F.md5(F.col(text_col))))
    hits = gazetteer_hits(keyed.where(F.col(text_col).isNotNull()), gazetteer, "_text_key", text_col)
    return _placed(keyed.join(hits, "_text_key", "left"), text_col, out).select(*df.columns, out)


def sort_spans_desc(spans: Column) -> Column:
    """Spans by start, descending (the replacement order of the original)."""
    return F.reverse(F.array_sort(spans))


# Label names some recognisers use for the default categories (mapped before
# the label filter, so those entities are masked too).
MODEL_LABEL_MAP = {"ORGANIZATION": "ORG", "NAT_REL_POL": "NORP", "FACILITY": "FAC"}


def detect_entities_with_model(df: DataFrame, make_recognizer, text_col: str = "sentence", out: str = "entities",
                               label_map: dict[str, str] | None = None) -> DataFrame:
    """T2 (b): spans from a user-supplied recogniser, ``df`` plus ``out``; map-only, one output row per input row.

    ``make_recognizer()`` runs once per task (load the model there) and
    returns ``fn(texts: list[str]) -> list[list[(start, end, label)]]``, code
    point offsets, half-open. Labels are renamed with ``label_map`` and
    overlapping spans resolved like the gazetteer's.
    """
    from quillspark.session import ship_package

    ship_package(df.sparkSession)
    mapping = dict(MODEL_LABEL_MAP if label_map is None else label_map)

    @F.pandas_udf(SPAN_TYPE)
    def recognise(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = make_recognizer()
        for texts in batches:
            found = fn([t if t is not None else "" for t in texts])
            yield pd.Series([
                leftmost_longest([(int(s), int(e), mapping.get(lab, lab)) for s, e, lab in spans]) if t is not None else []
                for t, spans in zip(texts, found)])

    return df.withColumn(out, recognise(F.col(text_col)))
