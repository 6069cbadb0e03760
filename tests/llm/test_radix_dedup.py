import hashlib
import random

from pyspark.sql import functions as F

from quillspark.llm import radix_dedup as R

LOWER = str.maketrans(R.UPPER, R.LOWER)


def brute(docs):
    """Sorted result rows, by a dictionary of whole texts."""
    groups = {}
    for i, t in docs:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        for n, i in enumerate(ids):
            out.append((i, ids[-1], len(ids), n == len(ids) - 1, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


def test_equals_brute_force(spark, table):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abé") for _ in range(rng.choice([0, 1, 3, 4, 7, 8, 40, 300]))) for _ in range(60)]
    docs = []
    for i in range(400):
        t = rng.choice(stems)
        cut = rng.randint(0, len(t))
        docs.append((i, rng.choice([t, t.upper(), t[:cut], t + rng.choice("ab"), t[:cut] + "É" + t[cut:], None])))
    for first, growth in ((1, 2), (4, 4), (R.FIRST, R.GROWTH)):
        got = R.radix_groups(table(docs), first, growth).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
        assert result(got) == brute(docs)
    assert result(R.exact_query(table(docs))) == brute(docs)


def test_digit_widths_meet_text_ends(spark, table):
    """Texts that end exactly with a digit, or differ in the last byte only, in a later round, or in case only."""
    base = "x" * (R.FIRST * (1 + R.GROWTH))
    docs = [(i, t) for i, t in enumerate([base, base + "y", base[:-1], base.upper(), "x" * R.FIRST, "X" * R.FIRST, "x" * (R.FIRST - 1), "", None,
                                         base + "É", base + "é", base + "É"])]
    assert result(R.exact_query(table(docs))) == brute(docs)


def test_edges(spark, table):
    long = "long text " * 60_000
    docs = [(None, "a"), (None, "A"), (None, "b"), (3, "b"), (3, "B"), (3, "b"), (1, None), (2, ""), (7, long), (8, long.upper()), (9, long + "!")]
    got = R.exact_query(table(docs))
    assert result(got) == brute(docs)
    assert sum(r.kept for r in got.collect()) == 5  # of equal rows exactly one is kept
    assert R.exact_query(table([])).collect() == []
    assert [f.name for f in R.exact_query(table([])).schema] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_hot_group(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text " * 30)).otherwise(
        F.concat(F.lit("the same text " * 10), F.col("id").cast("string"))).alias("text"))
    sizes = {r.group_size: r.n for r in R.exact_query(docs).groupBy("group_size").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {6667: 6667, 1: 13333}


def test_drop_copies_keeps_all_columns(spark, table):
    docs = [(1, "One text"), (2, "one text"), (3, "other"), (3, "other"), (None, "One Text"), (4, None)]
    df = table(docs).withColumn("row_no", F.lit("user's"))
    out = R.drop_copies(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text, r.row_no, r.key) for r in out.collect()) == [
        (2, "one text", "user's", 7), (3, "other", "user's", 7), (4, None, "user's", 7)]
