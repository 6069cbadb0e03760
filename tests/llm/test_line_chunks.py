import random
import re

import numpy as np

from quillspark.llm import line_chunks as C


def plain_units(text):
    """(start, stop, end, words) of the units, from the text's words alone."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    units = []
    for k, (a, b) in enumerate(words):
        w = text[a:b]
        before = text[words[k - 1][0]:words[k - 1][1]] if k else ""
        if before[-1:] in tuple("\"')]}") and len(before) > 1:
            before = before[:-1]
        if not k or before[-1:] in tuple(".,;:!?") or "\n" in text[words[k - 1][1]:a]:
            units.append([a, b, 0])
        units[-1][1] = b
        units[-1][2] += 1
        assert w
    return [(a, b, units[i + 1][0] if i + 1 < len(units) else len(text), n) for i, (a, b, n) in enumerate(units)]


def brute(docs, min_lines=2, min_words=8):
    """Texts after removal, by a plain scan: chunk boundaries from the module, everything else from strings; ids are unique."""
    docs = sorted((d for d in docs if d[1] is not None), key=lambda d: (d[0] is None, d[0]))
    cut = {}
    for i, t in docs:
        u = plain_units(t)
        at, chunks = 0, []
        for _, _, n in C.chunks_of(t):
            chunks.append(u[at:at + n])
            at += n
        assert at == len(u)
        cut[i] = chunks
    text, first, out = dict(docs), {}, {}

    def said(i, c):
        return [text[i][a:b] for a, b, _, _ in cut[i][c]]

    for i, t in docs:
        numbered, u = [], 0
        for chunk in cut[i]:
            numbered.append(range(u, u + len(chunk)))
            u += len(chunk)
        gone, repeats = set(), {}
        for c, chunk in enumerate(cut[i]):
            if sum(x[3] for x in chunk) >= C.SEED_WORDS:
                whole = t[chunk[0][0]:chunk[-1][1]]
                if whole in first:
                    repeats[c] = first[whole]
                    gone.update(numbered[c])
                else:
                    first[whole] = (i, c)
        for c, (f, fc) in repeats.items():
            for side in (-1, 1):
                if c + side in repeats or not 0 <= c + side < len(cut[i]) or not 0 <= fc + side < len(cut[f]):
                    continue
                mine, its = said(i, c + side)[::side], said(f, fc + side)[::side]
                k = 0
                while k < min(len(mine), len(its)) and mine[k] == its[k]:
                    gone.add(list(numbered[c + side])[::side][k])
                    k += 1
        units = [x for chunk in cut[i] for x in chunk]
        runs = []
        for u in sorted(gone):
            if runs and runs[-1][-1] == u - 1:
                runs[-1].append(u)
            else:
                runs.append([u])
        left, at = [], 0
        for run in runs:
            if len(run) >= min_lines and sum(units[u][3] for u in run) >= min_words:
                left.append(t[at:units[run[0]][0]])
                at = units[run[-1]][2]
        out[i] = "".join([*left, t[at:]])
    return out


def corpus(seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice(["alpha", "beta,", "gamma", "é", "d."]) + str(rng.randint(0, 50)) * rng.randint(0, 1) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    shared = [rng.sample(lines, 14) for _ in range(4)]
    docs = []
    for i in range(80):
        own = rng.sample(lines, rng.randint(0, 10))
        k = rng.randint(0, len(own))
        mid = rng.choice(shared) if rng.random() < 0.6 else []
        docs.append((i, rng.choice(["\n", ". ", "; \n"]).join(own[:k] + mid + own[k:]) + rng.choice(["", "\n", "\n\n", " "])))
    return docs


def test_equals_brute_force(spark, table):
    for seed in (3, 4):
        docs = corpus(seed)
        got = {r.doc_id: r.text for r in C.dedup_lines(table(docs)).collect()}
        want = brute(docs)
        assert got == want
        assert sum(len(t) for _, t in docs) > 1.2 * sum(map(len, want.values()))


def test_boundaries_are_a_rolling_hash_and_resist_shifts():
    rng = random.Random(1)
    run = [f"line number {rng.random()} of a passage" for _ in range(200)]

    def chunks(text):
        return {text[s:e].strip() for s, e, _ in C.chunks_of(text)}
    whole = chunks("\n".join(run))
    assert 60 < len(whole) < 140  # two units on average
    for head in (["x"], ["x", "y"], ["x", "y", "z z"]):
        assert len(whole & chunks("\n".join(head + run))) >= len(whole) - 1
    changed = chunks("\n".join(run[:100] + ["inserted line"] + run[101:]))
    assert len(whole & changed) >= len(whole) - 3


def test_chunks_cover_the_text_and_do_not_overlap():
    rng = random.Random(9)
    for _ in range(80):
        text = "".join(rng.choice(["a b", "\n", "\n\n", "c", " ", ". ", "é, ", ")"]) for _ in range(rng.randint(0, 80)))
        parts = list(C.chunks_of(text))
        assert "".join(text[s:e] for s, e, _ in parts) == text.lstrip(" \n")
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert sum(n for _, _, n in parts) == len(plain_units(text))


def test_units_equal_plain_units():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "é", " ", "\n", ".", ",", "!)", "\"", "?", "\t"]) for _ in range(rng.randint(0, 40)))
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        c = C.Chunks(data, np.array([0, len(data)]))
        cp = C._code_points(data)
        assert [tuple(map(int, x)) for x in zip(cp[c.start], cp[c.stop], cp[c.behind], c.words)] == plain_units(text)


def test_edges(spark, table):
    block = "\n".join(f"one shared line number {i} with words" for i in range(30))
    docs = [(None, block), (1, block), (1, block), (2, None), (3, ""), (4, block + "\n" + block), (5, "z" * 300_000), (6, "clean\ntext of its own\nwith lines"),
            (7, ", ".join(f"unit {i}" for i in range(30_000)))]
    out = C.dedup_lines(table(docs), spans_as="removed")
    assert sorted(out.columns) == sorted(table(docs).columns)
    rows = out.collect()
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[1] == [block, block]  # rows equal in id and text are one document, the first here
    assert by[2] == [None] and by[3] == [""] and by[5] == ["z" * 300_000] and by[6] == ["clean\ntext of its own\nwith lines"] and by[7] == [docs[-1][1]]
    assert by[None] == [""]
    assert by[4][0] in block and by[4][0].count("\n") <= 2  # the chunk over the border of the two blocks has no equal
    assert C.dedup_lines(table([])).collect() == []
    q = C.chunk_query(table(docs)).collect()
    assert len(q) == len(docs) and all(r.n_removed >= 0 for r in q)


def test_clashing_names_and_whole_copies(spark, table):
    from pyspark.sql import functions as F

    block = "\n".join(f"one shared line number {i} with words" for i in range(30))
    docs = table([(1, block), (2, block + "\nand an end of its own."), (3, "Some text of its own stands here, in front of it.\n" * 1 + block[:400])])
    docs = docs.withColumns({"row_key": F.lit("r"), "chunk_key": F.lit("c"), "chunk_spans": F.lit("s"), "c": F.lit(3), "n_chars": F.lit(9)})
    out = {r.doc_id: r for r in C.dedup_lines(docs, None).collect()}
    assert (out[2].row_key, out[2].chunk_key, out[2].chunk_spans, out[2].c) == ("r", "c", "s", 3)
    assert out[2].text == "and an end of its own." and out[2].n_chars == len(out[2].text) and out[1].n_chars == 9
    kept = {r.doc_id: r.text for r in C.dedup_lines(docs, None, most=0.9).collect()}
    assert kept[2].startswith(block) and len(kept[3]) < 200  # a copy stays whole


def test_of_every_unit_one_place_stays(spark, table):
    docs = corpus(5) + [(100 + i, "same short line of words\n" * i) for i in range(6)]
    left = [x for r in C.dedup_lines(table(docs)).collect() for x in plain_units(r.text) for x in [r.text[x[0]:x[1]]]]
    assert {t[a:b] for _, t in docs for a, b, _, _ in plain_units(t)} == set(left)


def test_python_steps_run_once_and_one_to_a_stage(spark, table, monkeypatch):
    """A filter on what a Python function returns is moved below it and evaluates it again, in a second worker of the task."""
    plans = {}
    kept = C.written

    def noted(session, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept(session, df, name)

    monkeypatch.setattr(C, "written", noted)
    out = C.dedup_lines(table(corpus(6)))
    assert plans["chunk-spans"].count("MapInArrow") == 2 and "ArrowEvalPython" not in plans["chunk-spans"]
    last = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in last and "BroadcastHashJoin" not in last  # a shuffle between the test and the cut


def test_runs_of_parts_equal_a_plain_union():
    import pyarrow as pa

    rng = random.Random(7)
    kind = pa.list_(pa.struct([("u0", pa.int64()), ("marks", pa.binary()), ("first_doc_id", pa.string())]))
    docs, want = [], []
    for _ in range(120):
        at = np.cumsum([rng.randint(1, 30) for _ in range(40)]).tolist()
        words = [rng.randint(1, 6) for _ in range(40)]
        parts, known = [], {}
        for _ in range(rng.randint(0, 6)):
            a = rng.randint(0, 34)
            b = a + rng.randint(1, 5)
            marks = np.array(at[a:b + 1] + [0] * (2 * (b - a)) + words[a:b], dtype="<i4").tobytes()
            parts.append({"u0": a, "marks": marks, "first_doc_id": rng.choice([None, "x", "y"])})
            for u in range(a, b):
                known.setdefault(u, parts[-1]["first_doc_id"])
        runs = []
        for u in sorted(known):
            if runs and runs[-1][-1] == u - 1:
                runs[-1].append(u)
            else:
                runs.append([u])
        docs.append(parts)
        want.append([{"start": at[r[0]], "end": at[r[-1] + 1], "first_doc_id": known[r[0]]}
                     for r in runs if len(r) >= 2 and sum(words[u] for u in r) >= 8])
    docs = pa.array(docs, kind)
    assert C._united(docs, 2, 8).to_pylist() == want
    assert C._united(docs.slice(50, 9), 2, 8).to_pylist() == want[50:59] and C._united(docs.slice(0, 0), 2, 8).to_pylist() == []
