import random
import re

from pyspark.sql import functions as F

from quillspark.llm import line_rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = text.split("\n")
    full = [x for x in lines if WORD.search(x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lost, left = 0, []
    for x in lines:
        n = len(WORD.findall(x))
        symbols = len(re.findall(r"[#*$%&|<>]", x))
        bad = n > 0 and ((x.count("|") >= 3 and x.count("|") >= n * 0.2) or symbols > len(x) * 0.1
                         or (n <= 40 and any(p in x.lower() for p in R.BOILERPLATE))
                         or (n >= 8 and not re.search("[.!?:;…]", x)))
        lost += n * bad
        if not bad:
            left.append(x)
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered), base,
            not base and lost * 100 <= len(w) * 30, lost, "\n".join(left))


def check(spark, table, texts):
    docs = table(list(enumerate(texts)))
    got = {r.doc_id: r for r in R.judged(docs, with_text=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.lost_words,
                r.cleaned) == brute(t), repr(t)[:200]


def test_counts_equal_brute_force(spark, table):
    rng = random.Random(4)
    words = ["a", "bb", "ccc", "déjà", "x%y", "|", "end.", "Read", "more", "e\u00a0f", "#", "&&&"]
    texts = []
    for _ in range(150):
        n = rng.randint(0, 120)
        texts.append("".join(rng.choice(words[:rng.randint(2, 12)]) + rng.choice([" ", " ", " ", "\n", "  ", "\t", "\r\n", "\x0b"]) for _ in range(n)))
    check(spark, table, texts)


def test_edges(spark, table):
    body = " ".join(f"w{i}" for i in range(60)) + "."
    check(spark, table, [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "x " * 49, body, body + "\n" + body, "\n" + body + "\n",
                         "a | b | c | d", body + "\nHome | News | Shop | Help", "\u00a0", "\x85", "z" * 100_000, "one two three " * 20_000])
    docs = table([(None, body), (1, body), (1, body)])
    assert [r.kept for r in R.judged(docs).collect()] == [True] * 3
    assert R.judged(table([])).collect() == []


def test_lines_are_cleaned_and_lossy_documents_go(spark, table):
    prose = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) + "." for i in range(12))
    menu = "Home | News | Sport | Weather | Contact | Imprint"
    got = {r.doc_id: r for r in R.judged(table([(1, prose + "\n" + menu), (2, "\n".join([prose] + [" | ".join(f"item{i}n{j}" for j in range(6)) for i in range(20)])), (3, prose)]), with_text=True).collect()}
    assert got[1].kept and got[1].cleaned == prose
    assert not got[2].kept and not got[2].base_failed
    assert got[3].kept and got[3].cleaned == prose


def test_plan_has_no_python_and_no_shuffle(spark, table):
    plan = R.judged(table([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    assert F is not None
