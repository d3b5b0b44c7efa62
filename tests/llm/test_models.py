import os
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import language_id, quality

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_data
def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.op5_language_id(spark, SF).join(docs, "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95


@needs_data
def test_quality_of_held_out_rows(spark):
    """Both classes are told apart; a constant answer would have one of them all wrong."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.op1_quality_classifier(spark, sf).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert len(good) > 500 and len(bad) > 100
    assert np.mean([r.predicted for r in good]) > 0.98 and np.mean([1 - r.predicted for r in bad]) > 0.85
    assert np.mean([[a.score > b.score for b in bad] for a in good]) > 0.99


def test_labels_both_ways_ties_and_repeats(spark):
    texts = ["fine words and more of them " * 3, "fine words and more of them " * 3, "BAD!!! ||| ###", None, "", "x"] * 4
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (0, 1), (1, 0), (3, None), (None, 1), (6, 1)], "doc_id long, quality int")
    one, two = (quality.fit(docs.repartition(n), labels) for n in (1, 3))
    assert np.allclose(one.weights, two.weights)
    by_text = {}
    for r in quality.score(docs, one).collect():
        by_text.setdefault(r.text or "", set()).add(r.quality_score)
    assert all(len(v) == 1 for v in by_text.values()) and len(by_text) == 4


def plain_features(text):
    """The surface numbers of a text, character by character."""
    raw, words, lines = text, text.split(), [x for x in text.split(b"\n") if x]
    kinds = [b"\n", b" \t\r\x0b\x0c", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".", b",", b"!", b"|", b"#$%&*", b"?;:'\"()-"]
    n = [sum(c in k for c in raw) for k in kinds] + [0, sum(c >= 128 for c in raw)]
    n[11] = len(raw) - sum(n)
    size, w = max(len(raw), 1), max(len(words), 1)
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ends = [n[2] / max(n[2] + n[3] + n[12], 1), (size - n[0] - n[1]) / w, n[5] / w, n[6] / w, np.log1p(size), np.log1p(len(words)), len(set(words)) / w, twice / w, len(set(lines)) / max(1, len(lines)), len(words) / max(len(lines), 1)]
    return [x / size for x in n] + ends


def test_plain_version_of_features_and_score():
    """Surface numbers, hashed words and the score, against loops over characters and dictionaries; texts of any length."""
    texts = [b"", b"a", "Fine wörds, and  more. More more!\n\nLine | two #1".encode(), b"AB " * 3, b"x" * 70_000, b"long words of a very long text " * 40_000, "é漢 ' \x1c 😀".encode()]
    x, words = quality.features(texts), quality.hashed(texts)
    assert np.allclose(x, [plain_features(t) for t in texts])
    model = quality.Model(quality._edges(x), 0.7)
    model.weights = np.random.default_rng(1).normal(size=len(model.weights))
    model.bias = 0.25
    for i, t in enumerate(texts):
        own = t.lower().split()
        h = [quality.xxh3_64_intdigest(w) for w in own]
        pairs = [(a * 0x9E3779B97F4A7C15 + b) % 2**64 for a, b in zip(h, h[1:], strict=False)]
        dims = {int(quality.mix(np.array([v], np.uint64))[0] % quality.HASHED) for v in h + pairs}
        assert dims == set(words[i].tolist())
        z = 0.25 + sum(model.weights[j * (quality.BINS + 1) + sum(e <= x[i, j] for e in edges)] for j, edges in enumerate(model.edges))
        z += sum(model.weights[model.first + d] for d in dims) / np.sqrt(max(len(dims), 1)) - np.log(0.7 / 0.3)
        assert abs(model.score(x[i : i + 1], words[i : i + 1])[0] - 1 / (1 + np.exp(-z))) < 1e-9


def plain_risk(prior, p, x):
    """The non-negative risk: positives, and what the unlabelled rows cost as negatives without the positives among them."""
    loss = lambda z: np.log1p(np.exp(z))
    return prior * loss(-p).mean(), loss(x).mean() - prior * loss(p).mean()


def test_plain_version_of_the_risk():
    rng = np.random.default_rng(2)
    for up, shift in ((0.0, 2.0), (4.0, -4.0)):
        p, x, step = rng.normal(size=6) + up, rng.normal(size=9) + shift, 1e-6
        dp, dx = quality.risk_gradient(0.8, p, x)
        below = plain_risk(0.8, p, x)[1] < 0
        assert below == (shift < 0)
        value = lambda p, x: -plain_risk(0.8, p, x)[1] if below else sum(plain_risk(0.8, p, x))
        for own, found, at in ((p, dp, 0), (x, dx, 1)):
            for i in range(len(own)):
                more = own.copy()
                more[i] += step
                moved = value(more, x) if at == 0 else value(p, more)
                assert abs((moved - value(p, x)) / step - found[i]) < 1e-4


def test_training_lowers_the_plain_risk():
    rng = np.random.default_rng(3)
    good = [b"clear sentences about things that matter number %d." % i for i in range(200)]
    bad = [b"WIN!!! $$$ click %d ||| #### !!!" % i for i in range(200)]
    rows = lambda t: (quality.features(t), quality.hashed(t))
    unlabelled = [t for _, t in sorted((rng.random(), t) for t in good[100:] + bad[:50])]
    model = quality.train(rows(good[:100]), rows(unlabelled), 0.6)
    p, x = (model.logits(model.rows(*rows(t))) for t in (good[:100], unlabelled))
    a, b = plain_risk(0.6, p, x)
    zero = plain_risk(0.6, 0 * p, 0 * x)
    assert a + max(b, 0) < 0.4 * (zero[0] + max(zero[1], 0))
    assert np.mean(model.score(*rows(bad[50:])) < 0.3) > 0.95
    assert np.mean(model.score(*rows(good[150:])) >= 0.3) > 0.95


def test_awkward(awkward, empty):
    model = language_id.fit(awkward)
    assert model.languages == ["en", "fr"]
    rows = language_id.predict(awkward, model).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert 0 <= r.lang_score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict(awkward, nothing).collect()} == {"und"}
    assert language_id.predict(empty, model).collect() == []
    good = awkward.select("doc_id", F.lit(1).alias("quality")).where("doc_id % 2 = 0")
    fitted = quality.fit(awkward, good)
    scores = [r.quality_score for r in quality.score(awkward, fitted).collect()]
    assert len(scores) == awkward.count() and all(0 <= s <= 1 for s in scores)
    assert {r.quality_score for r in quality.score(awkward, quality.fit(awkward, good.limit(0))).collect()} == {0.5}
    assert quality.fit(empty, good) is None and quality.score(empty, fitted).collect() == []


def test_filter_against_plain_sets(spark):
    rng = np.random.default_rng(3)
    alphabets = {"en": "etaoin shrdlu", "fr": "esaitnrul od", "de": "enisratdhul "}
    texts = [("".join(rng.choice(list(a), 80)), k) for k, a in alphabets.items() for _ in range(30)]
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(texts)], "doc_id long, text string, lang string")

    def grams(text):
        t = "\n" + text.lower() + "\n"
        return [tuple(c if c.isalpha() else " " for c in t[i - 1 : i + 2]) for i in range(1, len(t) - 1) if t[i].isalpha()]

    counts = {k: {} for k in alphabets}
    for t, k in texts:
        for g in grams(t):
            counts[k][g] = counts[k].get(g, 0) + 1
    rates = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    best = {}
    for r in rates.values():
        for g, x in r.items():
            best[g] = max(best.get(g, 0), x)
    held = {k: {g for g, x in r.items() if x >= language_id.SHARE * best[g]} for k, r in rates.items()}
    model = language_id.fit(df)
    tests = [t for t, _ in texts[::7]] + ["tree house", "une idee", "12", "zzz"]
    for text, name, score in zip(tests, *model.predict(tests), strict=True):
        own = grams(text)
        want = {k: sum(g in h for g in own) / max(1, len(own)) for k, h in held.items()}
        assert (name == "und") == (not own)
        if own:
            assert abs(score - want[name]) < 0.03 and want[name] >= max(want.values()) - 0.03


def test_filter_size_follows_the_corpus(monkeypatch):
    assert language_id.size_of([(0, 0, 10)]) == (1, language_id.FEWEST)
    assert language_id.size_of([(0, 0, 100_000), (1, 0, 90_000), (0, 3, 50_000)]) == (1, 1 << 21)
    assert language_id.size_of([(0, 0, 10_000_000), (0, 1, 1_000_000)]) == (2, 1 << 23)
    assert language_id.size_of([]) == (1, language_id.FEWEST)


def test_more_languages_than_one_plane(spark):
    rows = [(i, chr(0x4E00 + 40 * i) * 3 + " " + "".join(chr(0x4E00 + 40 * i + j) for j in range(30)), f"l{i:03d}") for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert len(model.planes) == 2
    assert all(r.lang == r.lang_pred for r in language_id.predict(df, model).collect())


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    rows = lambda x: (x, [np.array([i % 7], np.uint16) for i in range(len(x))])
    for prior in (0.3, 0.8):
        positive = rng.normal(1.5, 1, (4000, 3))
        n = int(8000 * prior)
        unlabelled = np.concatenate([rng.normal(1.5, 1, (n, 3)), rng.normal(-1.5, 1, (8000 - n, 3))])
        model = quality.train(rows(positive), rows(unlabelled))
        assert abs(model.prior - prior) < 0.06
        truth = np.arange(8000) < n
        assert ((model.score(*rows(unlabelled)) > 0.5) == truth).mean() > 0.95


def test_rows_take_two_bytes_a_word():
    """What the driver holds of a sample: hashed words as they came, numbers and values for the rows that are taken alone."""
    rng = np.random.default_rng(0)
    words = [np.unique(rng.integers(0, quality.HASHED, 2000)).astype(np.uint16) for _ in range(200)] + [np.empty(0, np.uint16)]
    bins, n = rng.integers(0, 9, (len(words), 3)), sum(map(len, words))
    tracemalloc.start()
    rows = quality.Rows(bins, words, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * n
    which = np.array([3, len(words) - 1, 3, 7])
    plain = [(int(b), 1.0, k) if j < 3 else (50 + int(b), 1 / np.sqrt(len(words[i])), k) for k, i in enumerate(which) for j, b in enumerate([*bins[i], *words[i]])]
    index, value, at = rows.take(which)
    assert list(zip(index.tolist(), value.tolist(), at.tolist(), strict=True)) == plain
