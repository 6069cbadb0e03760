"""Gazetteers too big for literal sets, matched inside each row (T2): a token trie in flat arrays.

A surface is a path of tokens and the separators between them. The trie's nodes are the 64-bit keys of all path prefixes, sorted in
one array; a second array tells which surface ends at a node. The tokens of a whole Arrow batch walk down together, one depth a step,
and only those that are still on a path go on: the pass is linear in the text but for the binary search of a node, and no row
meets another one, so nothing is shuffled. Keys only find candidates: every span is compared with its surface.

The trie travels to the workers once each, so its size is measured first; a bigger gazetteer is joined (``operators.entities``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import TOKEN_RE

#: Bytes of surfaces and labels, and of a node for each of their tokens, that a trie may have.
TRIE_MAX_BYTES = 32 << 20
_NODE_BYTES = 12

_STEP = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Trie:
    """``nodes``: sorted path keys; ``entry``: the surface that ends at each, or -1; ``label``: each surface's place in ``labels``."""

    nodes: np.ndarray
    entry: np.ndarray
    surfaces: list[str]
    label: np.ndarray
    labels: list[str]
    depth: int

    def walk(self, row: np.ndarray, first: np.ndarray, after: np.ndarray):
        """(token at the start, token at the end, surface) of all paths through the tokens of a batch that end at a surface."""
        at, key, found = np.arange(len(first)), _step(np.uint64(0), first), []
        for n in range(self.depth):
            node = np.searchsorted(self.nodes, key)
            node[node == len(self.nodes)] = 0
            on = self.nodes[node] == key
            at, key, node = at[on], key[on], node[on]
            entry = self.entry[node]
            found.append(np.stack([at, at + n, entry])[:, entry >= 0])
            to = at + n + 1
            more = to < len(row)
            more[more] = row[to[more]] == row[at[more]]
            at, key = at[more], key[more]
            key = _step(key, after[at + n + 1])
        return np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)


def _step(key, piece: np.ndarray) -> np.ndarray:
    """The key of a path one piece longer."""
    x = (key + piece.view(np.uint64)) * _STEP
    return (x ^ (x >> np.uint64(32))) * _STEP


def with_pieces(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` plus the tokens of a text as array<struct<gap, size, first, after>>: the lengths of the separator before a token and of
    the token, and the hashes of the token alone and of both."""
    text = F.col(text_col)
    toks, seps = _free(df, "_toks"), _free(df, "_seps")
    # A one-row generator, so that the patterns run once a row (see ``add_entity_spans_inline``).
    st = df.select("*", F.inline(F.array(F.struct(
        F.regexp_extract_all(text, F.lit(TOKEN_RE), 0).alias(toks), F.split(text, TOKEN_RE, -1).alias(seps)))))
    pieces = F.zip_with(F.slice(seps, 1, F.size(toks)), toks, lambda s, t: F.struct(
        F.length(s).alias("gap"), F.length(t).alias("size"), F.xxhash64(t).alias("first"), F.xxhash64(s, t).alias("after")))
    return st.withColumn(out, F.when(F.size(toks) > 0, pieces)).select(*[F.col(f"`{c}`") for c in df.columns], out)


def _free(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def gazetteer_trie(entries: DataFrame, max_bytes: int = TRIE_MAX_BYTES) -> Trie | None:
    """The trie of (surface, label) with one row a surface; None when its measured size is over ``max_bytes``.

    Surfaces that do not start and end with a token match nowhere and are left out.
    """
    g = with_pieces(entries.select("surface", "label"), "surface", "pieces")
    ends = F.split("surface", TOKEN_RE, -1)
    g = g.where(F.col("pieces").isNotNull() & (F.element_at(ends, 1) == "") & (F.element_at(ends, -1) == ""))
    size = F.octet_length("surface") + F.octet_length("label") + _NODE_BYTES * F.size("pieces")
    if (g.agg(F.sum(size)).first()[0] or 0) > max_bytes:
        return None
    t = g.select("surface", "label", F.transform("pieces", lambda p: p["first"]).alias("first"),
                 F.transform("pieces", lambda p: p["after"]).alias("after")).toArrow().combine_chunks()
    n = t.num_rows
    if not n:
        return Trie(np.zeros(0, np.uint64), np.zeros(0, np.int32), [], np.zeros(0, np.int32), [], 0)
    chunk = {c: t.column(c).chunk(0) for c in t.column_names}
    lengths = np.diff(np.asarray(chunk["after"].offsets))
    begin = np.cumsum(lengths) - lengths
    first, after = (np.asarray(chunk[c].flatten()) for c in ("first", "after"))
    keys, key, last = [], _step(np.uint64(0), first[begin]), np.zeros(n, dtype=np.uint64)
    live = np.arange(n)
    for depth in range(1, int(lengths.max()) + 1):
        keys.append(key)
        done = lengths[live] == depth
        last[live[done]] = key[done]
        live, key = live[~done], key[~done]
        key = _step(key, after[begin[live] + depth])
    if len(np.unique(last)) < n:  # two surfaces with one key: the joined path tells them apart
        return None
    nodes = np.unique(np.concatenate(keys))
    entry = np.full(len(nodes), -1, dtype=np.int32)
    entry[np.searchsorted(nodes, last)] = np.arange(n)
    labels, label = np.unique(chunk["label"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    return Trie(nodes, entry, chunk["surface"].to_pylist(), label.astype(np.int32), labels.tolist(), int(lengths.max()))


def _spans(trie: Trie, texts, pieces) -> list[list[dict]]:
    """Resolved spans of a batch's texts."""
    import pyarrow.compute as pc

    from quillspark.operators.entities import leftmost_longest

    sizes = np.asarray(pc.fill_null(pc.list_value_length(pieces), 0))
    row = np.repeat(np.arange(len(sizes)), sizes)
    flat = pieces.flatten()
    gap, size, first, after = (np.asarray(flat.field(i)) for i in range(4))
    start, end, entry = trie.walk(row, first, after)
    out: list[list[dict]] = [[] for _ in sizes]
    if not len(entry):
        return out
    stop = np.cumsum(gap.astype(np.int64) + size)  # of each token, were all texts one without what follows their last token
    base = np.concatenate([[0], stop])[(np.cumsum(sizes) - sizes)[row[start]]]
    a, b, of = stop[start] - size[start] - base, stop[end] - base, row[start]
    cands: dict[int, list] = {}
    for i, s, e, k in zip(of.tolist(), a.tolist(), b.tolist(), entry.tolist()):
        cands.setdefault(i, []).append((s, e, k))
    for i, found in cands.items():
        text = texts[i].as_py()
        out[i] = leftmost_longest([(s, e, trie.labels[trie.label[k]]) for s, e, k in found if text[s:e] == trie.surfaces[k]])
    return out


def add_entity_spans_trie(df: DataFrame, text_col: str, trie: Trie, out: str, kind: str) -> DataFrame:
    """``df`` plus its resolved entity spans; map-only, one output row per input row, none for null texts."""
    from quillspark.session import ship_package

    ship_package(df.sparkSession)
    known = df.sparkSession.sparkContext.broadcast(trie)

    @F.arrow_udf(kind)
    def place(texts, pieces):
        import pyarrow as pa

        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])
        return pa.array(_spans(known.value, texts, pieces), pa.list_(span))

    names: list[Column] = [F.col(f"`{c}`") for c in df.columns if c != out]
    pieces = _free(df, "_pieces")
    return with_pieces(df, text_col, pieces).select(*names, place(F.col(text_col), F.col(pieces)).alias(out))
