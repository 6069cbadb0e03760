"""URL filter: allow / block rules, and a logistic regression on hashed character n-grams for the rest.

The model is trained on a small labelled URL table (url, verdict). In the query that table is a
bounded sample of the pages that a rule decides, so the model carries the rules' judgement over to
hosts and paths that no rule names. Character n-grams of ``^host$`` and of the path are hashed into
``dims`` slots, host and path apart; a URL's value is the sum of its slots' weights over the square
root of its number of n-grams.

Scale: one pass over (key, url), no shuffle. Training rows are the distinct URLs with the least hashes, at most ``train_rows`` a verdict;
a threshold from the approximate number of distinct URLs bounds what is gathered to find them. Rules are a short list given by the caller; they become
column expressions.

Edge cases: a null URL or one without ``://`` has an empty host and path; no rule fits it and the model scores the empty string.
If the labelled table holds one verdict only, the model says that one; if it is empty, "allow".
Repeated rows are judged alike, and a repeated URL is one training row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import columns_of, least_hashed, mix64

#: (verdict, rule); a rule is a host followed by the path's first characters.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
DIMS = 1 << 14
SIZES = (3, 4, 5)
TRAIN_ROWS = 2000


def host_path(url: Column) -> tuple[Column, Column]:
    """(host, path) as columns; both '' for a null URL or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"\A[^?#]*", 0)
    return host, path


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, or null."""
    found = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"),
                                           F.lit(verdict).alias("verdict"))))
    return F.greatest(*found) if len(found) > 1 else found[0]


def ngram_slots(hosts: list[str], paths: list[str], dims: int = DIMS, sizes=SIZES):
    """(row, slot) of every character n-gram; bytes of a path are told apart from those of a host."""
    parts = []
    for h, p in zip(hosts, paths):
        host = np.frombuffer(("^" + h + "$").encode(), dtype=np.uint8).astype(np.uint64)
        path = np.frombuffer(p.encode(), dtype=np.uint8).astype(np.uint64) + np.uint64(256)
        parts.append(np.concatenate([host, path]))
    lengths = np.array([len(x) for x in parts], dtype=np.int64)
    code = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    row = np.repeat(np.arange(len(parts)), lengths)
    rows, slots = [], []
    for n in sizes:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            h = mix64(h * np.uint64(1_000_003) + code[j:len(code) - n + 1 + j])
        same = row[:len(code) - n + 1] == row[n - 1:]
        rows.append(row[:len(code) - n + 1][same])
        slots.append((h[same] % np.uint64(dims)).astype(np.int64))
    if not rows:
        z = np.zeros(0, dtype=np.int64)
        return z, z
    return np.concatenate(rows), np.concatenate(slots)


class UrlModel:
    """Logistic regression over hashed n-grams."""

    def __init__(self, weights: np.ndarray, bias: float, sizes=SIZES):
        self.weights, self.bias, self.sizes = weights, bias, sizes

    @classmethod
    def fit(cls, hosts, paths, blocked, dims: int = DIMS, sizes=SIZES, steps: int = 200, l2: float = 1e-3):
        """Full-batch Adam; ``blocked`` holds 0 and 1."""
        y = np.asarray(blocked, dtype=np.float64)
        if len(y) == 0 or y.min() == y.max():
            return cls(np.zeros(dims), 30.0 if len(y) and y[0] == 1 else -30.0, sizes)
        row, slot = ngram_slots(list(hosts), list(paths), dims, sizes)
        norm = 1.0 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
        balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
        w, b = np.zeros(dims), 0.0
        m, v, mb, vb = np.zeros(dims), np.zeros(dims), 0.0, 0.0
        for t in range(1, steps + 1):
            z = np.bincount(row, weights=w[slot], minlength=len(y)) * norm + b
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
            g = np.bincount(slot, weights=(err * norm)[row], minlength=dims) + l2 * w / len(y)
            gb = err.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            w = w - 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
            b = b - 0.05 * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.999 ** t)) + 1e-8)
        return cls(w, b, sizes)

    def score(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability of "block" for each (host, path)."""
        row, slot = ngram_slots(hosts, paths, len(self.weights), self.sizes)
        norm = 1.0 / np.sqrt(np.maximum(np.bincount(row, minlength=len(hosts)), 1))
        z = np.bincount(row, weights=self.weights[slot], minlength=len(hosts)) * norm + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled_by_rules(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """A small labelled URL table: at most ``train_rows`` distinct rule-decided URLs a verdict, by a hash of the URL."""
    host, path = host_path(F.col("url"))
    d = (columns_of(pages, "url").where("url is not null")
         .select("url", matched_rule(host, path, rules)["verdict"].alias("verdict")))
    verdicts = ("block", "allow")
    samples = [least_hashed(d.where(F.col("verdict") == v), "url", train_rows).withColumn("verdict", F.lit(v)) for v in verdicts]
    return samples[0].unionByName(samples[1])


def train_url_model(labelled: DataFrame, **fit_args) -> UrlModel:
    """Fits on a small table (url, verdict); its rows are read on the driver."""
    host, path = host_path(F.col("url"))
    rows = labelled.select(host.alias("host"), path.alias("path"), "verdict").collect()
    rows.sort(key=lambda r: (r.host, r.path, r.verdict))
    return UrlModel.fit([r.host for r in rows], [r.path for r in rows], [r.verdict == "block" for r in rows], **fit_args)


def filter_urls(pages: DataFrame, model: UrlModel, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score); the score is the model's probability of "block"."""
    import pyarrow as pa

    host, path = host_path(F.col("url"))
    rule = matched_rule(host, path, rules)
    d = columns_of(pages, "page_id", "url").select(
        "page_id", host.alias("host"), path.alias("path"), rule["rule"].alias("rule"), rule["verdict"].alias("verdict"))
    kind = d.schema["page_id"].dataType.simpleString()

    def score(batches: Iterator) -> Iterator:
        for b in batches:
            s = model.score(b.column("host").to_pylist(), b.column("path").to_pylist())
            verdict = [v if v is not None else ("block" if x >= threshold else "allow")
                       for v, x in zip(b.column("verdict").to_pylist(), s)]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("host"), b.column("path"), b.column("rule"),
                 pa.array(verdict, pa.string()), pa.array(s, pa.float64())],
                names=["page_id", "host", "path", "rule", "verdict", "score"])

    return d.mapInArrow(score, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def url_query(pages: DataFrame) -> DataFrame:
    return filter_urls(pages, train_url_model(labelled_by_rules(pages)))
