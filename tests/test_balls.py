"""Search over balls gives what a scan gives, and reads a small part where vectors form clusters."""

import numpy as np
import pytest

from kinfold.operators import balls as B
from kinfold.operators import vectors as V


def frame(spark, x, name, start=0):
    return spark.createDataFrame([(start + i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], f"{name} long, vec array<double>")


def rows(df):
    return sorted((r["query"], r["rank"], r["id"], round(r["score"], 7)) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_same_rows_as_the_scan(spark, metric):
    """Clusters, copies, zero and null vectors, ties, thresholds, and more neighbours asked for than there are."""
    rng = np.random.default_rng(4)
    centres = 5 * rng.standard_normal((12, 6))
    x = [*(centres[rng.integers(0, 12, 500)] + 0.3 * rng.standard_normal((500, 6))), *[np.ones(6)] * 30, *[np.zeros(6)] * 4, None]
    q = [*(centres[:6] + 0.2), np.ones(6), np.zeros(6), 100 * np.ones(6), None]
    corpus, queries = frame(spark, x, "id"), frame(spark, q, "query", 1000)
    index = B.build(corpus, metric=metric)
    for k, threshold in ((10, None), (3, 0.5), (40, None), (700, None)):
        want = rows(V.nearest(queries, corpus, k, metric, threshold))
        assert rows(B.search(index, queries, k, threshold)) == want and want
    again = B.Balls(spark, index.path, metric)
    assert rows(B.search(again, queries, 5)) == rows(V.nearest(queries, corpus, 5, metric))


def test_clusters_are_read_in_part(spark):
    rng = np.random.default_rng(5)
    centres = 10 * rng.standard_normal((30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.2 * rng.standard_normal((3000, 16))
    corpus, queries = frame(spark, x, "id"), frame(spark, x[:40] + 0.01, "query")
    index = B.build(corpus)
    assert rows(B.search(index, queries, 10)) == rows(V.nearest(queries, corpus, 10))
    assert B.share_read(index, queries, 10) < 0.15


def test_empty(spark):
    corpus, queries = frame(spark, [], "id"), frame(spark, [[1.0, 2.0]], "query")
    assert not B.search(B.build(corpus), queries).collect()
    full = B.build(frame(spark, [[1.0, 2.0], [3.0, 4.0]], "id"))
    assert not B.search(full, queries.where("false")).collect()
    assert rows(B.search(full, queries)) == [(0, 1, 0, 0.0), (0, 2, 1, 8.0)]
