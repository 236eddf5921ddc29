import random

from tagloom.llm import contamination as C


def brute(ws, items, least):
    grams = {}
    for i, t in items.items():
        for k in range(len(t) - least + 1):
            grams.setdefault(tuple(t[k : k + least]), set()).add(i)
    return {i for k in range(len(ws) - least + 1) for i in grams.get(tuple(ws[k : k + least]), ())}


def test_automaton_equals_shared_runs():
    rnd = random.Random(7)
    for _ in range(60):
        least = rnd.choice([1, 2, 3, 5])
        voc = [str(i) for i in range(rnd.choice([2, 3, 6]))]
        items = {i: [rnd.choice(voc) for _ in range(rnd.randint(0, 15))] for i in range(rnd.randint(1, 6))}
        a = C.Automaton(items, least)
        for _ in range(10):
            ws = [rnd.choice([*voc, "unknown"]) for _ in range(rnd.randint(0, 30))]
            hit = set()
            for k, m, its in a.matches(ws):
                hit.update(its)
                assert any(t[j : j + m] == ws[k - m + 1 : k + 1] for t in items.values() for j in range(len(t)))
            assert hit == brute(ws, items, least)


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen"


def run(spark, texts, items=((1, ITEM), (2, None), (3, "short item")), **how):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    return {r.doc_id: r for r in C.leaks(docs, spark.createDataFrame([(i, t, "s") for i, t in items], "eval_item_id int, text string, doc_id string"), **how).collect()}


def test_twelve_words_in_any_dress(spark):
    twelve = " ".join(ITEM.split()[:12])
    texts = [ITEM, twelve, " ".join(ITEM.split()[:11]), twelve.upper().replace(" ", " -- \n"), twelve.replace("six", "6"), f"before, {twelve}. After", None, "", "word " * 100_000 + twelve, twelve.replace("four", "fo_ur")]
    got = run(spark, texts)
    assert sorted(got) == [0, 1, 3, 7 + 1 - 3, 8]
    assert got[0]["leaked_words"] == 13 and got[5]["spans"][0]["first"] == 1 and list(got[0]["items"]) == [1]


def test_blocks_of_items_find_the_same(spark):
    items = tuple((i, f"{i} " + ITEM) for i in range(1, 40))
    texts = [ITEM, "7 " + ITEM]
    whole = run(spark, texts, items)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df = C.leaks(docs, spark.createDataFrame(items, "eval_item_id int, text string"), block_chars=500)
    parts = {}
    for r in df.collect():
        parts.setdefault(r.doc_id, set()).update(r["items"])
    assert parts == {k: set(r["items"]) for k, r in whole.items()} == {0: set(range(1, 40)), 1: set(range(1, 40))}


def test_cleaning(spark):
    docs = spark.createDataFrame([(1, "Keep this much of the text here please. " * 3 + ITEM + ". And this."), (2, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "eval_item_id int, text string")
    got = {r.doc_id: r for r in C.decontaminate(docs, items).collect()}
    assert got[1].action == "cut" and got[1].clean_text.endswith("please. . And this.") and got[2].action == "drop" and got[2].clean_text is None


def test_empty_tables(spark):
    assert run(spark, [], ((1, ITEM),)) == {}
    d = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert C.leaks(d, spark.createDataFrame([], "eval_item_id int, text string")).count() == 0


def test_block_size_changes_no_column(spark):
    rnd = random.Random(3)
    voc = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(voc) for _ in range(30))) for i in range(24)]
    texts = [None, "", "nothing of it"]
    for _ in range(30):
        text = []
        for _ in range(rnd.randint(1, 5)):
            ws = rnd.choice(items)[1].split()
            at = rnd.randint(0, 14)
            text += [rnd.choice(voc) for _ in range(rnd.randint(0, 25))] + ws[at : at + rnd.randint(11, 16)]
        texts.append(", ".join(text))
    docs = spark.createDataFrame([(i % 31, t) for i, t in enumerate(texts)], "doc_id long, text string")
    known = spark.createDataFrame(items, "eval_item_id int, text string")
    for f in (lambda **k: C.leaks(docs, known, clean=True, **k), lambda **k: C.decontaminate(docs, known, **k)):
        whole, parts = (sorted(map(str, f(block_chars=n).collect())) for n in (4_000_000, 700))
        assert whole == parts and len(whole) > 20
    assert {r.action for r in C.decontaminate(docs, known, block_chars=700).collect()} == {"cut", "drop"}


def test_letters_that_fold_to_two_keep_the_places(spark):
    text = "Straße İstanbul ŉ " + ITEM.upper() + " Maße"
    got = run(spark, [text], ((1, ITEM),), clean=True)[0]
    assert got["spans"][0]["first"] == 3 and got["clean_text"] == "Straße İstanbul ŉ  Maße"
