import corpus_pipeline as C
import pytest

from quillspark.llm import line_chunks, pareto_mix, probminhash, quality_cnn, template_decontam
from quillspark.sources.tables import read_table

SMALL = "/root/testdata/sf0.01"


def multiset(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_stages_equal_their_operators_on_whole_input(spark, tmp_path):
    """Every stage against a plain version over all rows that the one before kept."""
    from tests.llm.test_line_chunks import brute as brute_chunks
    from tests.llm.test_probminhash import shingle_set

    docs = read_table(spark, SMALL, "documents")
    bench, labels = read_table(spark, SMALL, "benchmark"), read_table(spark, SMALL, "labels")
    for i, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows, kept = docs.collect(), out.collect()
        assert out.columns[:5] == docs.columns[:5]
        if i < 4:
            assert out.columns == docs.columns
        if name == "quality_classifier":
            net = quality_cnn.train_quality(docs, labels)
            want = [r.doc_id for r in quality_cnn.score_documents(docs, net).where("score >= 0.3").collect()]
            assert sorted(r.doc_id for r in kept) == sorted(want)
            good = {r.doc_id for r in labels.where("quality = 1").collect()}
            assert len({r.doc_id for r in kept} & good) > 0.97 * len(good & {r.doc_id for r in rows})
        elif name == "line_dedup":
            want = brute_chunks([(r.doc_id, r.text) for r in rows])
            # the stage's rule: a document that would lose more than COPY_SHARE of its characters stays whole
            want |= {r.doc_id: r.text for r in rows if len(r.text) - len(want[r.doc_id]) > C.COPY_SHARE * len(r.text)}
            assert sum(len(t) for t in want.values()) < sum(len(r.text) for r in rows)
            assert {r.doc_id: r.text for r in kept} == want and all(r.n_chars == len(r.text) for r in kept)
        elif name == "near_dedup":
            ids = {r.doc_id for r in kept}
            classes = {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs).collect()}
            assert ids == set(classes.values()) and len(kept) == len(ids)
            # no two kept documents are near duplicates: by an inverted index of all shingles
            sets = {r.doc_id: shingle_set(r.text) for r in kept}
            at = {}
            for d, s in sets.items():
                for x in s:
                    at.setdefault(x, []).append(d)
            common = {}
            for ds in at.values():
                for k, a in enumerate(ds):
                    for b in ds[:k]:
                        common[(a, b)] = common.get((a, b), 0) + 1
            assert all(n / (len(sets[a]) + len(sets[b]) - n) < 0.8 for (a, b), n in common.items())
        elif name == "decontamination":
            words = {r.item_id: r.text.split() for r in bench.collect()}
            left = {r.doc_id for r in kept}
            for r in rows:
                holds = any(" ".join(w) in " ".join(r.text.split()) for w in words.values())
                assert not (holds and r.doc_id in left)
            hit = {r.doc_id for r in template_decontam.contaminated(docs, bench).collect()}
            assert left == {r.doc_id for r in rows} - hit
        else:
            plan = {r.doc_id: r.copies for r in pareto_mix.pareto_mix(docs).collect()}
            got = {}
            for r in kept:
                got[r.doc_id] = got.get(r.doc_id, 0) + 1
            assert got == {d: n for d, n in plan.items() if n}
        docs = out


def test_run_is_the_stages(spark):
    assert [n for n, _ in C.STAGES] and C.ORACLE_SQL is None
    out = C.run(spark, "/root/testdata/sf0.001")
    assert out.columns[-1] == "copy_no" and out.count() > 0


@pytest.mark.parametrize("schema_only", [True])
def test_empty_documents(spark, tmp_path, schema_only):
    for t in ("documents", "benchmark", "labels"):
        read_table(spark, SMALL, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert C.run(spark, str(tmp_path)).collect() == []
    assert line_chunks is not None


def test_line_stage_cuts_copies_too(spark):
    """A document that is mostly a copy loses the copied lines like any other."""
    block = "\n".join(f"one shared line number {i} with words" for i in range(30))
    docs = spark.createDataFrame([(1, block), (2, block + "\nand an end of its own.")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in C.drop_repeated_lines(spark, docs, SMALL).collect()}
    assert out == {1: block, 2: "and an end of its own."}
