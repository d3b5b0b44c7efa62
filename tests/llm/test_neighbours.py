"""Nearest neighbours against distances to all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score int, q int"


def brute(vectors, asks, k):
    """Rows by query id: (vec_id, distance), nearest first; vectors that take no part are left out before."""
    ids = np.array(sorted(vectors))
    out = {}
    for i in ids:
        if not asks(i):
            continue
        same = [j for j in ids if j != i and len(vectors[j]) == len(vectors[i])]
        x, y = np.array(vectors[i], np.float32).astype(float), np.array([vectors[j] for j in same], np.float32).astype(float).reshape(len(same), -1)
        d = np.sqrt(((y - x) ** 2).sum(axis=1)) if same else np.empty(0)
        out[int(i)] = [(int(same[a]), float(d[a])) for a in np.lexsort((same, d))[:k]]
    return out


def found(spark, rows, every, k=10):
    df = N.nearest(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("vec_id") % every == 0, k)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    hit = sum(len({a for a, _ in got.get(q, [])} & {a for a, _ in w}) for q, w in want.items())
    return hit / sum(len(w) for w in want.values())


def row(i, v):
    return (i, v, 0, "r", 1, 2)


def test_small_tables_are_exact(spark):
    """Copies in hot groups, ties, repeated rows and ids, vectors that take no part, two lengths, clashing columns."""
    rng = np.random.default_rng(5)
    vectors = {i: rng.standard_normal(6).tolist() for i in range(90)}
    vectors |= {i: [1.0] + [0.0] * 5 for i in range(100, 140)} | {i: [0.0] * (i % 6) + [2.0] + [0.0] * (5 - i % 6) for i in range(140, 170)}
    vectors |= {i: rng.standard_normal(3).tolist() for i in range(200, 208)}
    none = [row(300, None), row(310, []), row(320, [0.0] * 6), row(330, [1.0, None] + [0.0] * 4), row(340, [float("nan")] * 6), row(350, [float("inf")] + [1.0] * 5), row(None, [1.0] * 6)]
    rows = [row(i, v) for i, v in vectors.items()]
    # A repeated row, and an id with a second and larger vector.
    rows += [rows[3], rows[95], row(20, [9.0] * 6)] + none
    vectors[20] = min(vectors[20], [9.0] * 6)
    got, want = found(spark, rows, 10), brute(vectors, lambda i: i % 10 == 0, 10)
    assert got == want
    assert len(got[200]) == 7
    assert got[100][:2] == [(101, 0.0), (102, 0.0)]


def test_no_rows(spark):
    assert found(spark, [], 10) == {}
    assert found(spark, [row(10, [1.0])], 10) == {}
    assert found(spark, [row(10, [1.0]), row(3, [2.0])], 10) == {10: [(3, 1.0)]}


def clustered(rng, n, dim=24):
    centres = 4 * rng.standard_normal((n // 40, dim))
    return centres[rng.integers(0, len(centres), n)] + 0.4 * rng.standard_normal((n, dim))


@pytest.mark.parametrize("kind", ["clusters", "even", "one far cluster"])
def test_recall(spark, kind):
    rng = np.random.default_rng(len(kind))
    x = {"clusters": lambda: clustered(rng, 6000), "even": lambda: rng.standard_normal((5000, 16)), "one far cluster": lambda: np.vstack([0.001 * rng.standard_normal((3000, 8)), 50 + rng.standard_normal((300, 8))])}[kind]()
    x = np.vstack([x, np.repeat(x[:1], 50, axis=0)]).astype(np.float32)
    vectors = {i: v.tolist() for i, v in enumerate(x)}
    got, want = found(spark, [row(i, v) for i, v in vectors.items()], 50), brute(vectors, lambda i: i % 50 == 0, 10)
    assert set(got) == set(want)
    assert all(len(g) == 10 for g in got.values())
    assert recall(got, want) >= 0.9
    assert got[0] == want[0]  # copies first, by id


def test_clusters_cost_little_and_probes_follow_their_order():
    """Queries among clusters visit a small part; buckets come by falling probability, the own one first."""
    rng = np.random.default_rng(2)
    x = clustered(rng, 20000)
    index = N.Index(24, len(x), float(np.sqrt(((x - x.mean(0)) ** 2).sum(1).mean())))
    places = index.places(x)
    cells = index.cells(np.floor(places).astype(np.int64), np.arange(index.tables)[None, :])
    seen = []
    for q in range(0, 20000, 500):
        d = np.sort(np.sqrt(((x - x[q]) ** 2).sum(1)))[10]
        probes = index.probes(places[q], d)
        assert probes[0] in cells[q]
        seen.append(np.isin(cells, probes).any(axis=1).mean())
    assert np.mean(seen) < 0.2


def test_too_many_probes_fall_back_on_all_vectors(spark):
    """A query far from everything has no small set of buckets; its neighbours are still right."""
    rng = np.random.default_rng(3)
    x = np.vstack([1e-3 * rng.standard_normal((3000, 8)), np.full((1, 8), 1e4)]).astype(np.float32)
    index = N.Index(8, len(x), 1.0)
    assert index.probes(index.places(x[:1].astype(float))[0], 1e3) is None
    vectors = {i: v.tolist() for i, v in enumerate(x)}
    assert found(spark, [row(i, v) for i, v in vectors.items()], 3000)[3000] == brute(vectors, lambda i: i == 3000, 10)[3000]


def test_normal_distribution():
    assert np.abs(N.normal(np.array([-1.96, 0.0, 1.0])) - [0.0249979, 0.5, 0.8413447]).max() < 1e-6
