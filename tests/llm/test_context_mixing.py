import math
import re
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import context_mixing as M
from tests_llm_brute import lower


def base_scores(rows, training):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None]
    c = Counter(w for t in training for w in split(t))
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in rows:
        w = split(t)
        out[i] = (len(w), sum(c[x] > 0 for x in w), n, sum(log10((c[x] + 1) / (n + v + 1)) for x in w))
    return out


@pytest.mark.parametrize("top", [200_000, 7])
def test_base_and_model(spark, awkward, empty, top, monkeypatch):
    monkeypatch.setattr(M, "TOP", top)
    docs = awkward.withColumn("id", F.monotonically_increasing_id())
    training = docs.where("id % 3 <> 0")
    want = base_scores([(r.id, r.text) for r in docs.collect()], [r.text for r in training.collect()])
    rows = M.scores(docs, training, id_col="id").collect()
    assert len(rows) == len(want)
    for r in rows:
        n, known, total, base = want[r.id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score < 0 and np.isfinite(r.score)
    assert M.scores(empty, training.drop("id")).collect() == []
    assert all(r.n_known == 0 for r in M.scores(docs, docs.limit(0), id_col="id").collect())


def test_probabilities_add_up_to_one_and_learning_helps(spark):
    rng = np.random.default_rng(0)
    words = ["the", "of", "house", "housing", "tree", "and", "gave"]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = M.fit(df.where("doc_id < 150"))
    context, _ = M.windows([b"the housin"])
    every = (context[-1] & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
    assert abs((10 ** model.costs(every)).sum() - 1) < 1e-3
    rows = M.scores(df, df.where("doc_id < 150")).where("doc_id >= 150").collect()
    assert np.mean([r.bits_per_byte for r in rows]) < 1.2


def test_windows_know_where_texts_begin():
    x, sizes = M.windows([b"ab", b"", b"ab"])
    assert sizes.tolist() == [3, 1, 3]
    assert x[:3].tolist() == x[4:].tolist()
    assert (x & np.uint64(255)).tolist() == [97, 98, 0, 0, 97, 98, 0]


def test_weights_of_every_task_count(spark):
    tasks = 300
    rng = np.random.default_rng(1)
    n = rng.integers(1, 5_000, tasks) * 1000
    # The tasks beyond 256 learnt something else.
    weights = rng.normal(0.3, 0.1, (tasks, M._GATES, len(M.ORDERS) + 1)).astype(np.float32)
    weights[256:] += 5

    def learnt(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                yield M.weighted(k, int(n[k]), weights[k])

    found = M.averaged(spark.range(0, tasks, numPartitions=4).mapInArrow(learnt, M._PIECES), tasks)
    assert np.allclose(found, np.average(weights, axis=0, weights=n), rtol=1e-5)


def plain_costs(model, training, text):
    """Log10 of a text's probability, decision by decision, from counts in dictionaries of whole contexts."""
    orders = len(M.ORDERS)

    def contexts(whole, at):
        out = [whole[at - o : at] if at >= o else b"\0" * (o - at) + whole[:at] for o in range(orders - 1)]
        start = at
        while start > 0 and at - start < 8 and whole[start - 1] > 32:
            start -= 1
        # The word so far is the run of letters before, its last eight bytes, with the byte before.
        return [*out, (whole[start:at], whole[at - 1 : at])]

    counts = {}
    for t in training:
        whole = t + b"\0"
        for at in range(len(whole)):
            for o, c in enumerate(contexts(whole, at)):
                node = 1
                for bit in range(8):
                    y = whole[at] >> (7 - bit) & 1
                    counts.setdefault((o, c, node), [0, 0])[y] += 1
                    node = 2 * node + y
    total, whole = 0.0, text + b"\0"
    level = lambda n: int(n > 0) + int(n > 3) + int(n > 20)
    for at in range(len(whole)):
        node = 1
        for bit in range(8):
            y = whole[at] >> (7 - bit) & 1
            z, known = [], []
            for o, c in enumerate(contexts(whole, at)):
                n0, n1 = counts.get((o, c, node), (0, 0))
                z.append(math.log((n1 + 0.2) / (n0 + 0.2)))
                known.append(n0 + n1)
            gate = bit * 16 + 4 * level(known[-2]) + level(known[-1])
            logit = sum(w * v for w, v in zip(model.weights[gate], [*z, 0.3], strict=True))
            clipped = min(12, max(-12, logit))
            p = 1 / (1 + math.exp(-clipped))
            cell = (whole[at - 1] if at else 0) * M._STEPS + round((clipped + 12) * (M._STEPS - 1) / 24)
            m0, m1 = model.map0[cell], model.map1[cell]
            p = min(1 - 1e-6, max(1e-6, (p + (m1 + 4 * p) / (m0 + m1 + 4)) / 2))
            total += math.log10(p if y else 1 - p)
            node = 2 * node + y
    return total


def test_scores_against_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(M, "slots_for", lambda windows: (1 << 22,) * 6)  # contexts hardly ever share a slot
    rng = np.random.default_rng(2)
    words = ["one", "two", "three", "thirteen", "of", "extraordinarily", "\n"]
    texts = [" ".join(rng.choice(words, 25)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = M.fit(df.where("doc_id < 24"))
    training = [t.encode() for t in texts[:24]]
    for t in [*texts[20:], "", "never seen", "one"]:
        x, sizes = M.windows([t.encode()])
        assert abs(model.totals(x, sizes)[0] - plain_costs(model, training, t.encode())) < 1e-3 * max(1, len(t))


def test_scores_do_not_depend_on_partitions(spark, awkward, monkeypatch):
    monkeypatch.setattr(M, "FIT_WINDOWS", 3000)  # several fitting tasks
    docs, found = awkward.withColumn("id", F.monotonically_increasing_id()), []
    for n in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append({r.id: r.score for r in M.scores(docs, docs.where("id % 3 <> 0"), id_col="id").collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1]


def test_frequent_windows_keep_their_weight():
    x, n = np.arange(5000, dtype=np.uint64), np.ones(5000, np.int64)
    n[7] = 10_000_000
    mixer = M.Mixer([np.ones(1 << 16, np.uint16)] * 6, [np.ones(1 << 16, np.uint16)] * 6)
    mixer.learn(x, n)
    assert np.isfinite(mixer.weights).all()


def test_tables_grow_with_the_corpus():
    assert M.slots_for(1) == tuple(min(s, 1 << 16) for s in M.SLOTS)
    assert M.slots_for(1 << 40) == M.SLOTS
    assert sum(M.slots_for(100_000)) > sum(M.slots_for(10_000))


def test_long_words_are_counted_by_the_shuffle(spark):
    long = "x" * 5000
    rows = [(0, f"{long} a {long}"), (1, "a b"), (2, f"{long} {'y' * 300}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = base_scores(rows, [t for _, t in rows])
    for r in M.scores(df, df).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and abs(r.base_score - want[r.doc_id][3]) < 1e-6
