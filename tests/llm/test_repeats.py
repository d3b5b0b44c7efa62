import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from kinfold.llm import repeats, substring, suffix_array
from kinfold.llm.common import rowed


def brute_words(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = defaultdict(list)
    for d, w in enumerate(words):
        for p in range(len(w) - window + 1):
            seen[tuple(w[p : p + window])].append((d, p))
    gone = defaultdict(set)
    for where in seen.values():
        if len(where) > 1:
            for d, p in where:
                gone[d] |= set(range(p, p + window))
    return [(len(w), len(gone[d]), " ".join(x for i, x in enumerate(w) if i not in gone[d])) for d, w in enumerate(words)]


def brute_bytes(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    order = [2**63 - 1 if i is None else i for i, _ in rows]
    least = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            least[s] = min(least.get(s, 2**63), order[k])
    out = []
    for k, t in enumerate(texts):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if least[t[p : p + length]] < order[k]:
                gone[p : p + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone, strict=False) if not g)))
    return out


@pytest.fixture(params=[0, 1, 2])
def texts(request):
    rng = random.Random(request.param)
    pool = [f"w{i}" for i in range([2, 30, 3000][request.param])]
    passages = [[rng.choice(pool) for _ in range(n)] for n in (34, 35, 36, 55, 120)]
    out = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(5)):
            words += [rng.choice(pool) for _ in range(rng.randrange(40))]
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randrange(6)
                words += p[a : len(p) - rng.randrange(4)]
        out.append(rng.choice([" ", "  ", "\n"]).join(words))
    return out + [None, "", "é" * 40, "é" * 60, "aab" * 100, "x" * 300, "x" * 49, "x" * 50]


@pytest.mark.parametrize("broadcast", [True, False])
def test_words(spark, tmp_path, texts, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(repeats, "BROADCAST_BYTES", -1)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == dict(enumerate(brute_words(texts, 35)))


@pytest.mark.parametrize("broadcast", [True, False])
def test_bytes(spark, tmp_path, texts, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(repeats, "BROADCAST_BYTES", -1)
    ids = list(range(len(texts)))
    random.Random(3).shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_array.remove_repeats(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == dict(zip(ids, brute_bytes(rows, 50), strict=True))


def test_small_buffers_change_nothing(spark, tmp_path, texts, monkeypatch):
    """Pickled by value, the settings reach the workers through a module of the same name only in one process."""
    rows = list(enumerate(texts))
    for module in (repeats, substring):
        monkeypatch.setattr(module, "BUFFER", 50)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    assert {r.doc_id: r.kept for r in substring.remove_repeats(df).collect()} == {d: w[2] for d, w in enumerate(brute_words(texts, 35))}


def test_blocks_are_cut_by_bytes(spark, tmp_path, texts, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 300)
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    found = repeats.blocks(rowed(docs), "doc_id").collect()
    assert len(found) > 20 and {r.offset for r in found} != {0}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs).collect()}
    assert got == dict(enumerate(brute_words(texts, 35)))


def test_awkward(awkward, empty):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    want = sorted(((i, *w[:2], hashlib.sha256(w[2].encode()).hexdigest()) for (i, _), w in zip(rows, brute_words([t for _, t in rows], 35), strict=True)), key=repr)
    assert sorted(map(tuple, substring.remove_repeats(awkward).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == want
    want = sorted(((i, *w[:3], hashlib.sha256(w[3]).hexdigest()) for (i, _), w in zip(rows, brute_bytes(rows, 50), strict=True)), key=repr)
    assert sorted(map(tuple, suffix_array.remove_repeats(awkward).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr) == want
    assert substring.remove_repeats(empty).collect() == [] and suffix_array.remove_repeats(empty).collect() == []


def test_cover():
    assert {(a - b) % 21 for a in substring.COVER for b in substring.COVER} == set(range(21))


def test_deep_shallow_classes():
    rng = np.random.default_rng(1)
    for alphabet in (2, 3, 200):
        windows = rng.integers(0, alphabet, (400, 50), np.uint8)
        windows[200:] = windows[rng.integers(0, 200, 200)]
        windows[300:, 45:] = windows[300:, 44:49]
        group = rng.integers(0, 3, 400).astype(np.uint64)
        found = suffix_array.ordered_windows(windows, group)
        classes = found.rank
        # The ranks are the order of the windows of each group, the groups one after another.
        order = sorted(range(400), key=lambda i: (int(group[i]), windows[i].tobytes()))
        assert all(classes[i] <= classes[j] for i, j in zip(order, order[1:], strict=False))
        for first, many, branch in found.tries.tolist():
            below = [windows[i].tobytes() for i in order[first : first + many]]
            assert many > 1 and len({w[:branch] for w in below}) == 1 and len({w[branch] for w in below}) > 1 and branch >= 16
        names = {}
        for c, g, w in zip(classes.tolist(), group.tolist(), windows, strict=True):
            assert names.setdefault(c, (g, w.tobytes())) == (g, w.tobytes())
        assert len(names) == len({(g, w.tobytes()) for g, w in zip(group.tolist(), windows, strict=True)})


def test_bytes_with_few_windows_at_once(monkeypatch):
    """Large groups are dealt by a hash of the window; periodic segments are looked at once a period."""
    import zstandard

    rng = random.Random(8)
    head, texts = [], []
    for row in range(60):
        text = rng.choice([b"ab" * 200, b"abc" * 90, b"x" * rng.randrange(50, 400), bytes(rng.choice(b"ab") for _ in range(rng.randrange(50, 130)))])
        head.append((7 + row % 2, row, rng.randrange(40), 3, len(text)))
        texts.append(text)
    packed = zstandard.ZstdCompressor().compress(np.array(head, suffix_array.SEGMENT).tobytes() + b"".join(texts))
    want = None
    for at_once in (1 << 17, 64, 1000):
        monkeypatch.setattr(suffix_array, "AT_ONCE", at_once)
        got = suffix_array.ordered([(60, packed)], 50).to_pydict()
        want = want or got
        assert got == want
    rows = np.frombuffer(b"".join(want["ranges"]), repeats.RANGE)
    for top in (7, 8):
        mine = [(h, t) for h, t in zip(head, texts, strict=True) if h[0] == top]
        for (_, row, _, start, size), (n, removed, _, _) in zip([h for h, _ in mine], brute_bytes([(h[2], t.decode()) for h, t in mine], 50), strict=True):
            own = rows[rows["row"] == row]
            assert int((own["end"] - own["start"]).sum()) == removed and n == size
