import random

import numpy as np

from quillspark.llm import template_decontam as T

ITEMS = [
    (1, "Mary has 12 apples and gives 5 apples to John. How many apples does Mary have after John eats 2 kg of them?"),
    (2, "A train leaves the station at 9 and travels 300 km in 4 hours; what is its average speed in km per hour?"),
    (3, "too short"),
    (4, "which planet is largest of all"),
    (5, None),
    (6, ""),
]


def found(spark, table, texts, items=ITEMS, **args):
    docs = table(list(enumerate(texts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in T.contaminated(docs, bench, **args).collect()}


def test_copies_and_new_parameters_are_caught(spark, table):
    texts = [
        "intro words here. " + ITEMS[0][1] + " some more words",
        "Anna has 48 apples and gives 17 apples to Peter. How many apples does Anna have after Peter eats 9 lb of them?",
        "Anna has 48 apples and gives 17 apples to Peter. How many apples does Olga have after Tom eats 9 lb of them?",  # slots disagree
        "A TRAIN leaves the station at 7 and travels 1,250.5 miles in 3 days; what is its average speed in m per second?".replace("TRAIN", "train"),
        "we ask: Which planet is largest of all",
        "nothing of that kind is written in this text about apples and a train at the station",
    ]
    assert found(spark, table, texts) == {(0, 1), (1, 1), (3, 2), (4, 4)}


def test_equals_brute_force_on_word_templates(spark, table):
    rng = random.Random(6)
    vocabulary = [f"tok{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 30)))) for i in range(30)]
    texts, want = [], set()
    for d in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            i, t = rng.choice(items)
            w = t.split()
            share = rng.choice([1, 0.8, 0.3])
            part = w[:max(1, int(len(w) * share))]
            at = rng.randint(0, len(body))
            body = body[:at] + part + body[at:]
        texts.append(" ".join(body))
        for i, t in items:
            w = t.split()
            size = min(T.WINDOW, len(w))
            mine = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)}
            its = {tuple(body[k:k + size]) for k in range(len(body) - size + 1)}
            if len(mine & its) >= 0.5 * (len(w) - size + 1):
                want.add((d, i))
    assert found(spark, table, texts, items) == want


def test_canonical_tokens():
    def codes(text):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        code, slot, _ = T.canonical(data, np.array([0, len(data)]))
        return [{int(T._NUM): "<num>", int(T._NAME): "<name>", int(T._UNIT): "<unit>"}.get(int(c), "w") for c in code], slot

    assert codes("The 3.5 kg of New York are 1,000 km")[0] == ["w", "<num>", "<unit>", "w", "<name>", "w", "<num>", "<unit>"]
    assert codes("Étienne sees Été")[0] == ["<name>", "w", "<name>"]
    a, b = codes("étienne HELLO world"), codes("Étienne hello World")
    assert a[0] == ["w", "<name>", "w"] and b[0] == ["<name>", "w", "<name>"]
    slot = codes("Bob and Ann and Bob")[1]
    assert slot[0] == slot[4] != slot[2] and slot[1] == 0


def test_same_templates_are_one_item(spark, table):
    items = [(i, f"Name{chr(65 + i)} buys {i + 10} red books for the small school library this week") for i in range(20)]
    texts = ["Peter buys 77 red books for the small school library this week", "no such text"]
    docs = table(list(enumerate(texts)))
    rows = T.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.n_items) for r in rows] == [(0, 0, 20)]


def test_edges(spark, table):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = [(None, ITEMS[0][1]), (1, ITEMS[0][1]), (1, ITEMS[0][1]), (2, None), (3, ""), (4, "a b " * 100_000 + ITEMS[1][1]), (5, "clean words only")]
    df = table(docs)
    rows = sorted((str(r.doc_id), r.item_id) for r in T.contaminated(df, bench).collect())
    assert rows == [("1", 1), ("4", 2), ("None", 1)]
    left = T.decontaminate(df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 5]
    assert T.contaminated(table([]), bench).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert T.contaminated(df, none).collect() == [] and T.decontaminate(df, none).count() == len(docs)


def test_copies_in_other_case_and_items_without_words_are_caught(spark, table):
    items = [
        (1, "Mary has 12 apples and gives 5 apples to John. How many apples does Mary have left?"),
        (2, "Great Expectations By Charles Dickens Was Published In London"),  # names only: no informative template window
        (3, "12 15 18 21 24 27 30 33 36 39"),
        (4, "Сколько планет в Солнечной системе без Плутона"),
    ]
    texts = ["so: " + items[0][1].upper(), items[0][1].lower() + " so", items[1][1], "in " + items[1][1].upper(), "count " + items[2][1], items[3][1].upper(),
             "MARY HAS TWO CATS AND GIVES NONE TO JOHN", "Hard Times By Charles Dickens", "12 15 18 20 24 27 31 33 36 40"]
    assert found(spark, table, texts, items) == {(0, 1), (1, 1), (2, 2), (3, 2), (4, 3), (5, 4)}
    rows = T.contaminated(table(list(enumerate(items[0][1:]))), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.item_id, r.n_items, r.coverage) for r in rows] == [(1, 1, 1.0)]  # once, although both forms match


def test_null_and_repeated_item_ids_are_items_of_their_own(spark, table):
    one = "which of these seven rivers is the longest of them all in the world"
    other = "please name the largest planet that moves around our sun in one year or more"
    docs = table([(0, "a " + one + " b"), (1, "c " + other + " d"), (2, "neither of them")])
    for ids in [(None, None), (7, 7), (7, None)]:
        bench = spark.createDataFrame([(ids[0], one), (ids[1], other), (ids[0], one)], "item_id long, text string")
        rows = {(r.doc_id, r.item_id, r.n_items, r.coverage) for r in T.contaminated(docs, bench).collect()}
        assert rows == {(0, ids[0], 2, 1.0), (1, ids[1], 1, 1.0)}
        assert [r.doc_id for r in T.decontaminate(docs, bench).collect()] == [2]
