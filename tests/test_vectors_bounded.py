"""Vector search holds products of bounded size, whatever a block's queries are."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from kinfold.operators import vectors as V


@pytest.mark.parametrize("cosine", [False, True])
def test_products_are_bounded(cosine):
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(6000, 8)), rng.normal(size=(3000, 8))
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + 1500)), pa.array(list(x[a : a + 1500]))], names=["id", "vec"]) for a in (0, 1500)]
    tracemalloc.start()
    found = [b.to_pydict() for b in V.best_of(iter(batches), np.arange(6000) * 3, q, 4, cosine)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # all scores at once are 144 MB
    names, ids, scores = (np.array([v for f in found for v in f[c]]) for c in ("query", "id", "score"))
    assert names.tolist() == np.repeat(np.arange(6000) * 3, 4).tolist()
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    want = -(unit(q) @ unit(x).T) if cosine else ((q[:, None] - x[None]) ** 2).sum(2)
    order = np.argsort(want, axis=1)[:, :4]
    assert ids.reshape(-1, 4).tolist() == order.tolist()
    assert np.allclose(scores.reshape(-1, 4), np.take_along_axis(want, order, 1))
