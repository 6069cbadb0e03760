"""Language identification by a linear-chain conditional random field over words.

Every word (a run of letters, lower-cased) of a text is labelled with a language; the labels of neighbouring words are tied
by learned transitions, so code-switched text is labelled piece by piece. A word's features are its prefixes and
suffixes of one to three letters, its n-grams of two and three letters with boundaries, and its presence in a lexicon of
each language (words seen at least ``LEXICON_MIN`` times in that language's training text, and more often than elsewhere).
Forward-backward gives each word's label probabilities; a document's language is the one with the largest sum, the score is
its share. A line of text is a chain; lines of more than ``CHAIN`` words are cut into chains of that length.

Training uses a bounded sample of the training folds: at most ``TRAIN_DOCS`` documents a language, chosen by a hash, and a
piece of at most ``TRAIN_CHARS`` characters of each; the ``MAX_LANGS`` most frequent languages are learned. Pieces of
different languages are spliced into chains so that transitions are learned from switches. The gradient of the
log-likelihood comes from forward-backward; Adam climbs it.

Scale: prediction is one pass, no shuffle; forward-backward runs over all chains of about a megabyte of text at once. The
model is a few megabytes and is broadcast (fixed size: ``SLOTS`` by languages, and a lexicon bounded by the sample).

Edge cases: a text that is null or has no letter is ``und`` with score 0, as is everything if no language was learned; repeated rows
are judged alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import columns_of, fold, mix64

SLOTS = 1 << 16
CHAIN = 256
TRAIN_DOCS = 150
TRAIN_CHARS = 3000
MAX_LANGS = 256
LEXICON_MIN = 3
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Words labelled at a time.
STEP_WORDS = 1 << 18
#: Words whose emissions a worker remembers.
CACHE_WORDS = 300_000
_EDGE = np.uint64(7)


def _letters() -> re.Pattern:
    """Runs of letters of the basic plane, spelled out as ranges: the matcher then tests a letter by table."""
    ranges, start = [], None
    for cp in range(0x10001):
        letter = cp < 0x10000 and chr(cp).isalpha()
        if letter and start is None:
            start = cp
        elif not letter and start is not None:
            ranges.append(f"{chr(start)}-{chr(cp - 1)}")
            start = None
    return re.compile(f"[{''.join(ranges)}]+")


_WORD, _ANY_WORD, _BEYOND = _letters(), re.compile(r"[^\W\d_]+"), re.compile("[\U00010000-\U0010ffff]")


def words_of(text: str) -> list[list[str]]:
    """Lower-cased words of each chain of a text."""
    chains = []
    pattern = _ANY_WORD if _BEYOND.search(text) else _WORD
    for line in text.lower().split("\n"):
        w = pattern.findall(line)
        chains += [w] if len(w) <= CHAIN else [w[i:i + CHAIN] for i in range(0, len(w), CHAIN)]
    return [c for c in chains if c]


def feature_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, slot) of the affix and n-gram features of each word."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    n = int(lengths.sum())
    # every word between two edge marks
    code = np.full(n + 2 * len(words), _EDGE, dtype=np.uint64)
    word = np.repeat(np.arange(len(words)), lengths + 2)
    inner = np.ones(len(code), dtype=bool)
    ends = np.cumsum(lengths + 2)
    inner[ends - 1] = False
    inner[ends - lengths - 2] = False
    code[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rows, slots = [], []

    def add(kind: int, at: np.ndarray, size: int) -> None:
        h = np.full(len(at), kind, dtype=np.uint64)
        for j in range(size):
            h = mix64(h * np.uint64(1_000_003) + code[at + j])
        rows.append(word[at])
        slots.append((h % np.uint64(SLOTS)).astype(np.int64))

    for size in (2, 3):
        at = np.arange(len(code) - size + 1)
        add(size, at[word[at] == word[at + size - 1]], size)
    first, last = ends - lengths - 1, ends - 2
    for size in (1, 2, 3):
        long_enough = lengths >= size
        add(10 + size, first[long_enough], size)
        add(20 + size, last[long_enough] - size + 1, size)
    return np.concatenate(rows), np.concatenate(slots)


class Crf:
    """Emission weights over hashed features and lexicons, and a transition matrix."""

    def __init__(self, langs: list[str], lexicon: dict[str, int]):
        self.langs, self.lexicon = langs, lexicon
        k = len(langs)
        self.p = {"slot": np.zeros((SLOTS, k)), "lex": np.zeros((k + 1, k)), "trans": np.eye(k) * 2.0, "start": np.zeros(k)}
        self._known: dict[str, int] = {}
        self._rows = np.zeros((0, k), dtype=np.float32)

    def __getstate__(self):
        return {"langs": self.langs, "lexicon": self.lexicon, "p": self.p, "_known": {}, "_rows": self._rows[:0]}

    def features(self, words: list[str]):
        row, slot = feature_slots(words)
        size = 1.0 / np.sqrt(np.bincount(row, minlength=len(words)))
        lex = np.array([self.lexicon.get(w, len(self.langs)) for w in words], dtype=np.int64)
        return row, slot, size, lex

    def emissions(self, feats) -> np.ndarray:
        row, slot, size, lex = feats
        out = self.p["lex"][lex].copy()
        for j in range(len(self.langs)):
            out[:, j] += np.bincount(row, weights=self.p["slot"][slot, j], minlength=len(size)) * size
        return out

    def remembered(self, words: list[str]) -> np.ndarray:
        """Emissions of distinct words; a worker computes each of its frequent words once."""
        if len(self._known) > CACHE_WORDS:
            self._known, self._rows = {}, self._rows[:0]
        new = [w for w in words if w not in self._known]
        if new:
            n = len(self._known)
            self._rows = np.concatenate([self._rows, self.emissions(self.features(new)).astype(np.float32)])
            self._known.update(zip(new, range(n, n + len(new))))
        return self._rows[np.fromiter((self._known[w] for w in words), dtype=np.int64, count=len(words))]

    def forward_backward(self, em: np.ndarray, code: np.ndarray, lengths: np.ndarray, pairs: bool = False):
        """Label probabilities of every word; word i has emissions ``em[code[i]]``, chains of ``lengths`` follow each other.

        With ``pairs`` also the expected transition counts.
        """
        k = em.shape[1]
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        steps = int(lengths.max())
        # words in the order (place in the chain, chain by falling length): every step is one slice
        live = np.searchsorted(-lengths[order], -np.arange(steps), side="left")  # chains longer than t
        off = np.concatenate([[0], np.cumsum(live)])
        place = np.repeat(np.arange(steps), live)
        word = starts[order][np.arange(off[-1]) - off[place]] + place
        e = np.exp(em - em.max(axis=1, keepdims=True))[code[word]]
        trans, start = np.exp(self.p["trans"]).astype(e.dtype), np.exp(self.p["start"]).astype(e.dtype)
        one = np.ones(k, dtype=e.dtype)
        alpha, scale = np.empty_like(e), np.empty(len(e), dtype=e.dtype)
        for t in range(steps):
            a, b, m = off[t], off[t + 1], live[t]
            x = e[a:b] * start if t == 0 else (alpha[off[t - 1]:off[t - 1] + m] @ trans) * e[a:b]
            scale[a:b] = x @ one
            np.divide(x, scale[a:b, None], out=alpha[a:b])
        beta = np.ones_like(e)
        expected = np.zeros((k, k))
        back = np.ascontiguousarray(trans.T)
        for t in range(steps - 2, -1, -1):
            a, b, m = off[t + 1], off[t + 2], live[t + 1]
            y = beta[a:b] * e[a:b] / scale[a:b, None]
            np.matmul(y, back, out=beta[off[t]:off[t] + m])
            if pairs:
                expected += alpha[off[t]:off[t] + m].T @ y * trans
        alpha *= beta
        alpha /= (alpha @ one)[:, None]
        post = np.empty_like(alpha)
        post[word] = alpha
        return (post, expected) if pairs else post

    @classmethod
    def fit(cls, sample: list[tuple[str, str]], steps: int = 60, rate: float = 0.1, l2: float = 1e-4, seed: int = 0):
        """Trains on (language, text) pairs."""
        langs = sorted({x for x, _ in sample})
        if not langs:
            return cls([], {})
        counts = {x: Counter() for x in langs}
        runs: list[tuple[int, list[str]]] = []
        for lang, text in sample:
            for c in words_of(text):
                counts[lang].update(c)
                runs.append((langs.index(lang), c))
        lexicon = {}
        for j, lang in enumerate(langs):
            for w, n in counts[lang].items():
                if n >= LEXICON_MIN and all(n > counts[o][w] for o in langs if o != lang):
                    lexicon[w] = j
        crf = cls(langs, lexicon)
        # half of the chains are as they are; the others are cut into pieces and spliced, so that languages switch within a chain
        rng = np.random.default_rng(seed)
        chains: list[list[tuple[int, str]]] = []
        loose: list[list[tuple[int, str]]] = []
        for i in rng.permutation(len(runs)):
            y, words = runs[i]
            tagged = [(y, w) for w in words]
            if rng.random() < 0.5:
                chains.append(tagged)
            else:
                cut = 0
                while cut < len(tagged):
                    size = 1 + int(rng.geometric(1 / 15))
                    loose.append(tagged[cut:cut + size])
                    cut += size
        loose = [loose[i] for i in rng.permutation(len(loose))]
        chains += [sum(loose[i:i + 6], []) for i in range(0, len(loose), 6)]
        if not chains:
            return crf
        flat = [x for c in chains for x in c]
        y = np.array([x[0] for x in flat])
        code, vocab = pd.factorize(np.array([x[1] for x in flat], dtype=object))
        lengths = np.array([len(c) for c in chains])
        starts = np.cumsum(lengths) - lengths
        feats = crf.features(list(vocab))
        row, slot, size, lex = feats
        k, n = len(langs), len(y)
        inside = np.ones(n, dtype=bool)
        inside[starts] = False
        seen = np.zeros((k, k))
        at = np.flatnonzero(inside)
        np.add.at(seen, (y[at - 1], y[at]), 1)
        m = {q: np.zeros_like(x) for q, x in crf.p.items()}
        v = {q: np.zeros_like(x) for q, x in crf.p.items()}
        for step in range(1, steps + 1):
            post, expected = crf.forward_backward(crf.emissions(feats), code, lengths, pairs=True)
            d = post.copy()
            d[np.arange(n), y] -= 1
            d /= n
            by_word = np.stack([np.bincount(code, weights=d[:, j], minlength=len(vocab)) for j in range(k)], axis=1)
            g = {"slot": np.stack([np.bincount(slot, weights=(by_word[:, j] * size)[row], minlength=SLOTS) for j in range(k)], axis=1),
                 "lex": np.stack([np.bincount(lex, weights=by_word[:, j], minlength=k + 1) for j in range(k)], axis=1),
                 "trans": (expected - seen) / n, "start": d[starts].sum(axis=0)}
            for q in crf.p:
                grad = g[q] + l2 * crf.p[q] / n
                m[q] = 0.9 * m[q] + 0.1 * grad
                v[q] = 0.99 * v[q] + 0.01 * grad * grad
                crf.p[q] = crf.p[q] - rate * (m[q] / (1 - 0.9 ** step)) / (np.sqrt(v[q] / (1 - 0.99 ** step)) + 1e-10)
        crf.p["slot"] = crf.p["slot"].astype(np.float32)
        return crf

    def label(self, texts: list[str | None]):
        """(chains' words, row offset of each text, label probabilities of every word)."""
        chains = [words_of(t) if t else [] for t in texts]
        lengths = np.array([len(c) for cs in chains for c in cs], dtype=np.int64)
        flat = [w for cs in chains for c in cs for w in c]
        offsets = np.cumsum([0, *[sum(map(len, cs)) for cs in chains]])
        if not flat or not self.langs:
            return chains, offsets, np.zeros((len(flat), len(self.langs)))
        code, vocab = pd.factorize(np.array(flat, dtype=object))
        return chains, offsets, self.forward_backward(self.remembered(list(vocab)), code, lengths)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of every text."""
        langs, scores = [], []
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b] or "") <= STEP_WORDS * 5):
                size += len(texts[b] or "")
                b += 1
            _, offsets, post = self.label(texts[a:b])
            total = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post, axis=0, dtype=np.float64)])
            total = total[offsets[1:]] - total[offsets[:-1]]
            n = offsets[1:] - offsets[:-1]
            for i in range(b - a):
                if n[i] == 0 or not self.langs:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    j = int(total[i].argmax())
                    langs.append(self.langs[j])
                    scores.append(float(min(1.0, max(0.0, total[i, j] / n[i]))))
            a = b
        return langs, np.array(scores)


def training_sample(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> list[tuple[str, str]]:
    """At most ``train_docs`` (language, piece of text) a language, from the training folds."""
    d = (columns_of(docs, "doc_id", "text", "lang").where("lang is not null and text is not null")
         .where(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    per_lang = (d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect())
    if not per_lang:
        return []
    # about twice as many as are wanted of each language fall under its threshold, whatever its size
    share = F.lit(0.0)
    for r in per_lang:
        share = F.when(F.col("lang") == r.lang, F.lit(min(1.0, 2.0 * train_docs / r.n))).otherwise(share)
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("lang"))
    d = d.withColumn("h", h).where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    room = F.greatest(F.length("text") - train_chars, F.lit(0)) + 1
    piece = F.substr("text", (F.pmod("h", room) + 1).cast("int"), F.lit(train_chars))
    rows = (d.select("h", "lang", piece.alias("piece")).orderBy("h", "lang", "piece")
            .limit(3 * train_docs * len(per_lang)).collect())
    sample, taken = [], Counter()
    for r in rows:
        if taken[r.lang] < train_docs:
            taken[r.lang] += 1
            sample.append((r.lang, r.piece))
    return sample


def train_languages(docs: DataFrame, train_docs: int = TRAIN_DOCS, **fit_args) -> Crf:
    return Crf.fit(training_sample(docs, train_docs), **fit_args)


def identify(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text)."""
    import pyarrow as pa

    d = columns_of(docs, "doc_id", "text").select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator) -> Iterator:
        for b in batches:
            lang, score = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()),
                                              pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return d.mapInArrow(scan, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_query(docs: DataFrame) -> DataFrame:
    return identify(docs, train_languages(docs))
