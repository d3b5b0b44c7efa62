import random
import re

from kinfold.llm import decontamination as D

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(text, items, window=10):
    words = lambda t: re.findall(PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, names = words(text), set(), set()
    for name, item in items:
        own = words(item)
        size = min(window, len(own))
        if not size:
            continue
        wins = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
        for p in range(len(w) - size + 1):
            if tuple(w[p : p + size]) in wins:
                hit |= set(range(p, p + size))
                names.add("" if name is None else str(name))
    return len(w), len(hit), sorted(names)


def items_of(seed):
    rng = random.Random(seed)
    seq = lambda n: " ".join(f"w{rng.randrange(6)}" for _ in range(n))
    return [(i, seq(rng.randrange(1, 25))) for i in range(3, 30)] + [(30, ""), (31, None), (None, seq(12)), (32, "w1 W2. w1"), (2, seq(10)), (11, seq(10))]


def test_against_brute_force_in_one_and_many_blocks(spark, awkward, empty):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(6)}" for _ in range(rng.randrange(80))) for _ in range(60)] + [None, "", "é漢 W1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for seed in (1, 2):
        items = items_of(seed)
        if seed == 2:
            items = [x for x in items if x[1] and len(x[1].split()) > 9]
        frame = spark.createDataFrame(items, "item_id long, text string")
        for limit in (1 << 20, 300):
            for r in D.contamination(docs, frame, block_bytes=limit).collect():
                assert (r.n_words, r.n_hit, list(r["items"])) == brute(r.text, items), (limit, r)
            for r in D.contamination(awkward, frame, block_bytes=limit).collect():
                assert (r.n_words, r.n_hit, list(r["items"])) == brute(r.text, items)
        assert D.contamination(empty, frame).collect() == []
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in D.contamination(docs, nothing).collect())


def test_spans_go_and_clean_texts_stay(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, "Before, this. " + item.upper() + "! After, that and some more words so that coverage is low enough here."), (2, "one two three, clean"), (3, item), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in D.remove_contamination(docs, items).collect()}
    assert got == {1: "Before, this. ! After, that and some more words so that coverage is low enough here.", 2: "one two three, clean", 4: None}
