import random

from pyspark.sql import functions as F

from quillspark.llm import unit_dedup as D


def brute(docs, min_words):
    """(doc_id, start, end) of every unit that an earlier place holds; ids are unique."""
    seen, out = set(), []
    for doc_id, text in sorted((d for d in docs if d[1] is not None), key=lambda d: (d[0] is None, d[0])):
        at = 0
        for line in text.split("\n"):
            norm = " ".join(line.lower().split())
            if len(norm.split()) >= min_words:
                if norm in seen:
                    out.append((doc_id, at, at + len(line)))
                seen.add(norm)
            at += len(line) + 1
    return sorted(out, key=str)


def test_equals_brute_force(spark, table):
    rng = random.Random(2)
    lines = [" ".join(rng.choice("abcdefghé") * rng.randint(1, 3) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    vary = [lambda x: x, str.upper, lambda x: "  " + x.replace(" ", "\t "), lambda x: x + "!"]
    docs = [(i, "\n".join(rng.choice(vary)(rng.choice(lines)) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    df = table(docs)
    got = D.repeated_units(df, min_words=4)
    assert sorted(((r.doc_id, r.start, r.end) for r in got.collect()), key=str) == brute(docs, 4)
    left = {r.doc_id: r for r in D.remove_units(df, got).collect()}
    text = dict(docs)
    for i, r in left.items():
        want, at = [], 0
        for d, s, e in sorted(x for x in brute(docs, 4) if x[0] == i):
            want.append(text[i][at:s])
            at = e
        assert r.text == "".join([*want, text[i][at:]])
        assert [tuple(x) for x in r.removed] == sorted((s, e) for d, s, e in brute(docs, 4) if d == i)


def test_passage_over_fifty_words_is_caught(spark, table):
    passage = " ".join(f"word{i}" for i in range(55))
    docs = table([(1, "intro one\n" + passage + "\nend"), (2, "other\n" + passage), (3, "clean text of its own"), (4, passage.replace("word3 ", "word33 "))])
    got = D.repeated_units(docs).collect()
    assert [(r.doc_id, r.start, r.first_doc_id) for r in got] == [(2, 6, 1)]


def test_edges(spark, table):
    line = " ".join(f"w{i}" for i in range(20))
    docs = [(None, line), (5, line), (5, line), (2, None), (3, ""), (4, line + "\n" + line), (9, "x" * 500_000), (10, "\n" * 1000)]
    got = D.repeated_units(table(docs)).collect()
    # 4 keeps its first line and loses its second; both rows of 5 lose theirs, as does the one without an id
    assert sorted((str(r.doc_id), r.start) for r in got) == [("4", len(line) + 1), ("5", 0), ("5", 0), ("None", 0)]
    assert D.repeated_units(table([])).collect() == []
    assert D.remove_units(table([]), D.repeated_units(table([]))).collect() == []
    same = D.repeated_units(table([(1, line), (1, line)])).collect()
    assert same == []  # rows equal in id and text are one document


def test_paragraphs(spark, table):
    para = "first line of it\nsecond line of it"
    docs = table([(1, para + "\n\nother words here now"), (2, "x y z\n\n" + para)])
    got = D.repeated_units(docs, unit="paragraph", min_words=4).collect()
    assert [(r.doc_id, r.start, r.end) for r in got] == [(2, 7, 7 + len(para))]
    assert F is not None


def brute_passages(docs, min_words):
    """(doc_id, start, end, first_doc_id) of the runs of repeated clauses, by a plain scan over characters; ids are unique."""
    seen, out = {}, []
    for doc_id, text in sorted((d for d in docs if d[1] is not None), key=lambda d: (d[0] is None, d[0])):
        cuts, at = [], 0
        for i, c in enumerate(text):
            back = text[at:i].rstrip(" \t").rstrip("\"')]}")
            if c == "\n" or c in " \t" and back and back[-1] in ".,;:!?" and (i + 1 == len(text) or text[i + 1] not in " \t"):
                cuts.append((at, i + 1))
                at = i + 1
        run = []
        units = [(s, e) for s, e in [*cuts, (at, len(text))] if text[s:e].split()]
        for s, e in [*units, (None, None)]:
            norm = " ".join(text[s:e].lower().split()) if s is not None else None
            if norm is not None and norm in seen:
                run.append((s + len(text[s:e]) - len(text[s:e].lstrip()), s + len(text[s:e].rstrip()), len(norm.split()), seen[norm]))
                continue
            if run and sum(r[2] for r in run) >= min_words:
                out.append((doc_id, run[0][0], run[-1][1], run[0][3]))
            run = []
            if norm is not None:
                seen[norm] = doc_id
    return sorted(out, key=str)


def test_passages_equal_brute_force(spark, table):
    rng = random.Random(6)
    pool = [" ".join(rng.choice("abcdéf") * rng.randint(1, 3) for _ in range(rng.randint(1, 9))) + rng.choice([".", "!", '."', "?)", "...", ",", ";"]) for _ in range(150)]
    vary = [lambda x: x, str.upper, lambda x: x + ""]
    docs = []
    for i in range(150):
        k = rng.randint(0, len(pool) - 8)
        own = [f"Own {i} {n} {rng.random():.6f} words of it." for n in range(rng.randint(0, 3))]
        mid = pool[k:k + rng.randint(0, 8)] if rng.random() < 0.6 else []
        docs.append((i, "".join(rng.choice(vary)(x) + rng.choice([" ", "\n", "\n\n", "  "]) for x in own + mid + own[:1])))
    for min_words in (1, 6, 16):
        got = D.repeated_passages(table(docs), min_words).collect()
        assert sorted(((r.doc_id, r.start, r.end, r.first_doc_id) for r in got), key=str) == brute_passages(docs, min_words)
        assert all(r.n_words >= min_words for r in got)


def test_passage_inside_a_line_is_caught(spark, table):
    """Whole clauses of a passage in the middle of a line go; a short sentence that occurs everywhere does not."""
    passage = "The first sentence has these words. " + " ".join(f"Sentence {n} of the passage holds some more words." for n in range(6))
    docs = [(1, "Intro of one " + passage + " then on. Yes."), (2, "other words " + passage + " and its end. Yes. Own."), (3, "Clean text. Yes. No other words here.")]
    got = D.repeated_passages(table(docs)).collect()
    assert [(r.doc_id, r.n_units, r.first_doc_id) for r in got] == [(2, 6, 1)]
    left = {r.doc_id: r.text for r in D.remove_units(table(docs), got and D.repeated_passages(table(docs))).collect()}
    assert left[1] == docs[0][1] and left[3] == docs[2][1]
    assert left[2] == "other words The first sentence has these words.  and its end. Yes. Own."


def test_passage_edges(spark, table):
    line = " ".join(f"w{i}" for i in range(20)) + "."
    docs = [(None, line), (5, line), (5, line), (2, None), (3, ""), (4, line + "\n" + line), (9, "x" * 500_000), (10, "\n" * 1000), (11, ". ! ? " * 2000)]
    got = D.repeated_passages(table(docs)).collect()
    assert sorted((str(r.doc_id), r.start) for r in got) == [("11", 2 * 3), ("4", len(line) + 1), ("5", 0), ("None", 0)]
    assert D.repeated_passages(table([])).collect() == []
    assert D.repeated_passages(table([(1, line), (1, line)])).collect() == []
