"""Fixture views shaped like the labelled sentence table.

``sentences`` splits ``documents`` into sentences and derives domain, split
and three annotator labels from md5 digits of stable keys, so the view is the
same in every engine and for every partition count. ``outputs`` stands in for
a model's raw answers. The small dictionaries exercise the edge cases listed
in FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import SENTENCE_RE
from quillspark.sources.tables import read_table, spread_input

# Sentence key: doc_id * SENTENCE_KEY_STRIDE + position in the document.
SENTENCE_KEY_STRIDE = 100000


def md5_digit(*parts: Column | str) -> Column:
    """First hex digit of md5 over the concatenated parts (text)."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.substring(F.md5(F.concat(*cols)), 1, 1)


def _key(c: Column) -> Column:
    return c.cast("string")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index, news_id, sentence, domain, label_0..2, split (no majority label)."""
    docs = spread_input(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    # Attach the document-level label before exploding: one row per document
    # goes through the join instead of one row per sentence.
    docs = docs.join(labels, "doc_id", "left")
    raw = docs.select(
        "doc_id",
        F.coalesce("quality", F.lit(0)).alias("q"),
        F.posexplode(F.regexp_extract_all("text", F.lit(SENTENCE_RE), 0)).alias("pos", "s"),
    )
    keyed = (
        raw.select(
            # a document with more sentences would take its neighbour's keys: fail instead
            F.when(F.col("pos") < SENTENCE_KEY_STRIDE, F.col("doc_id") * SENTENCE_KEY_STRIDE + F.col("pos"))
            .otherwise(F.raise_error(F.lit("document with too many sentences for the key stride"))).alias("index"),
            F.col("doc_id").alias("news_id"),
            F.trim("s").alias("s"),
            "q",
        )
        .where(F.col("s") != "")
        .withColumn("d", md5_digit(_key(F.col("index")), ":d"))
        .withColumn("m", md5_digit(_key(F.col("news_id")), ":m"))
        .withColumn("sp", md5_digit(_key(F.col("news_id")), ":s"))
    )
    d = F.col("d")
    s = F.col("s")
    sentence = (
        F.when(d == "0", F.concat(s, F.lit(" TNR")))
        .when(d == "1", F.concat(F.lit("Ţara şi ţările "), s))
        .when(d == "2", F.concat(s, F.lit(" www.cautatoriidepovesti.ro")))
        .when(d == "3", F.concat(s, F.lit(" cont.nou@exemplu.ro  acum")))
        .when(d == "4", F.concat(F.lit("Google <PERSON> "), s))
        .when(d == "5", F.concat(s, F.lit(" la <GPE> şi <NORP>")))
        .when(d == "6", F.concat(s, F.lit(" https://exemplu.ro/a?b=1")))
        .otherwise(s)
    )
    m = F.col("m")
    domain = F.when(m < "6", "life-death").when(m < "b", "it-stiinta").otherwise("cronica-de-film")
    sp = F.col("sp")
    split = F.when(sp < "a", "train").when(sp < "c", "validation").otherwise("test")

    def annotator(k: int) -> Column:
        flip = md5_digit(_key(F.col("index")), f":{k}") < "3"
        return F.when(flip, 1 - F.col("q")).otherwise(F.col("q")).alias(f"label_{k}")

    return keyed.select(
        "index", "news_id", sentence.alias("sentence"), domain.alias("domain"),
        annotator(0), annotator(1), annotator(2), split.alias("split"),
    )


def labelled_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sentences`` plus the majority label (the documented table shape)."""
    from quillspark.operators.annotate import majority_vote

    return majority_vote(sentences(spark, sf_dir))


# --- raw answers standing in for a model -------------------------------------

# The eight answer shapes, keyed by the first md5 hex digit (fixed fixture values).
_OUTPUT_CASES = (
    ("0", ""),
    ("1", "RĂSPUNS: satiră"),
    ("2", "răspuns: Factual\nExplicație: nu"),
    ("3", "RASPUNS: factual"),
    ("4", "Cred că este Satiră."),
    ("5", "nu știu:"),
    ("6", "RĂSPUNS: sati-ră"),
    ("7", "RĂSPUNS: factual sau satiră"),
)
_OUTPUT_DEFAULT = "RĂSPUNS: factual"


def fixture_answer(run: Column, index: Column) -> Column:
    """Raw answer for (run, index): a pure function of md5('{run}:{index}')."""
    digit = md5_digit(run.cast("string"), ":", index.cast("string"))
    expr = None
    for key, text in _OUTPUT_CASES:
        expr = F.when(digit == key, F.lit(text)) if expr is None else expr.when(digit == key, F.lit(text))
    return expr.otherwise(F.lit(_OUTPUT_DEFAULT))


def fixture_answer_py(run: int, index: int) -> str:
    """The same rule in plain Python, for a local scorer inside tasks."""
    import hashlib

    digit = hashlib.md5(f"{run}:{index}".encode()).hexdigest()[0]
    return dict(_OUTPUT_CASES).get(digit, _OUTPUT_DEFAULT)


def outputs(sent: DataFrame, runs: int | list[int] = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """outputs(run, index, output[, carry...]) for the given runs of the test stand-in model."""
    run_list = list(range(1, runs + 1)) if isinstance(runs, int) else list(runs)
    return sent.select(
        F.explode(F.array(*[F.lit(r) for r in run_list])).alias("run"), "index", *carry
    ).withColumn("output", fixture_answer(F.col("run"), F.col("index")))


# --- small dictionaries -------------------------------------------------------
# Invented test dictionaries (not from the original tool): words chosen from the
# driver's generated prose so that every rule is hit.

STOPWORDS = [
    ("ro", "that"),
    ("ro", "with"),
    ("ro", "this"),
    ("ro", "dans"),
    ("ro", "ţările"),      # cedilla: normalised to comma-below on load
    ("ro", "from   "),     # trailing spaces: stripped on load
    ("ro", "that"),        # duplicate: removed on load
    ("en", "orre"),        # other language: filtered by lang
]

LEMMAS = [
    ("ro", "thatin", "that"),       # lemma is a stop word -> token dropped
    ("ro", "ononst", "Onon"),       # upper-case lemma -> lower-cased
    ("ro", "inoran", "inora"),
    ("ro", "hehely", "hehe"),
    ("ro", "acum", "ACUMUL"),
    ("en", "orantion", "xx"),       # other language: filtered by lang
]

GAZETTEER = [
    ("Orre", "PERSON"),
    ("Orre Orre", "ORG"),           # nested: contains another surface
    ("Stteen Erachtz", "PERSON"),   # two-word surface
    ("Stteen", "LOC"),
    ("Eriner", "MISC"),             # label outside the default set
    ("Nicht", "GPE"),
    ("Google", "ORG"),
    ("Ietzte", "NORP"),
]

LOGITS = [
    (1, [0.1, 0.9]),
    (2, [0.7, 0.7]),        # tie -> first index
    (3, []),                # empty -> null class, confidence 0.0
    (4, [-2.0, -0.5, -1.0]),  # all negative
    (5, [3.5, -1.25]),
]


def stopwords_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STOPWORDS, "lang string, word string")


def lemmas_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEMMAS, "lang string, surface string, lemma string")


def gazetteer_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GAZETTEER, "surface string, label string")


def logits_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOGITS, "id int, logits array<double>")


# --- local stand-in scorers (top-level so tasks can unpickle them) ---------------

def _hex(text: str) -> int:
    import hashlib

    return int(hashlib.md5(text.encode()).hexdigest()[0], 16)


def fixture_scorer():
    """A model that answers with the fixture answer of (run, index)."""
    def fn(row: dict) -> str:
        return fixture_answer_py(int(row["run"]), int(row["index"]))
    return fn


def flaky_failures(index: int) -> int:
    """How many times the flaky service rate-limits a row before answering (0..6)."""
    return _hex(f"flaky:{index}") % 7


def flaky_scorer():
    """Rate-limits each row ``flaky_failures(index)`` times, then answers."""
    from quillspark.operators.score import RateLimited

    seen: dict[tuple[int, int], int] = {}

    def fn(row: dict) -> str:
        key = (int(row["run"]), int(row["index"]))
        seen[key] = seen.get(key, 0) + 1
        if seen[key] <= flaky_failures(key[1]):
            raise RateLimited("429 Too Many Requests")
        return fixture_answer_py(*key)
    return fn


def failing_scorer():
    """Fails hard (no retry) on rows whose md5('fail:{index}') starts with 0 or 1."""
    def fn(row: dict) -> str:
        if _hex(f"fail:{int(row['index'])}") < 2:
            raise ValueError("connection reset")
        return fixture_answer_py(int(row["run"]), int(row["index"]))
    return fn


def gazetteer_recognizer():
    """A stand-in recogniser model: finds the fixture gazetteer surfaces with a
    Python regex and reports some labels under a model's own names."""
    import regex

    model_names = {"ORG": "ORGANIZATION", "NORP": "NAT_REL_POL"}
    surfaces = sorted({s for s, _ in GAZETTEER}, key=len, reverse=True)
    label = {}
    for s, lab in GAZETTEER:
        label[s] = min(label.get(s, lab), lab)
    tok = r"[<>]|[\p{L}\p{M}\p{N}]+(?:[-'’][\p{L}\p{M}\p{N}]+)*"
    pattern = regex.compile(r"(?<![\p{L}\p{M}\p{N}])(?:" + "|".join(regex.escape(s) for s in surfaces) +
                            r")(?![\p{L}\p{M}\p{N}])")

    def fn(texts):
        out = []
        for t in texts:
            spans = []
            for m in pattern.finditer(t, overlapped=True):
                if regex.fullmatch(r"(?:" + tok + r")(?:[^\p{L}\p{M}\p{N}<>]+(?:" + tok + r"))*", m.group(0)):
                    lab = label[m.group(0)]
                    spans.append((m.start(), m.end(), model_names.get(lab, lab)))
            out.append(spans)
        return out
    return fn
