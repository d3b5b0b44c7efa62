import random
from collections import defaultdict

from kinfold.llm import simhash
from kinfold.llm.graph import components
from tests_llm_brute import closure, simhash_of


def test_covering_masks_cover_every_pair_of_positions():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_awkward_rows(awkward):
    rows = awkward.select("doc_id", "text").collect()
    fps = [simhash_of(r.text) for r in rows]
    label = closure(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for r, f in zip(rows, fps, strict=True):
        if r.doc_id is not None:
            least[label[f]].append(r.doc_id)
    want = sorted(((r.doc_id, f"{f:016x}", min(least[label[f]], default=None)) for r, f in zip(rows, fps, strict=True)), key=repr)
    got = sorted(map(tuple, simhash.near_duplicates(awkward).select("doc_id", "fingerprint", "component_id").collect()), key=repr)
    assert got == want


def test_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []


def test_large_buckets_link_as_small_ones_do(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:40]:
        for _ in range(6):
            f ^= 1 << rng.randrange(64)
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    label = closure(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for pairwise in (64, 2, 1):
        found = {r.node: r.component for r in components(simhash.links(df, 2, pairwise)).collect()}
        for f in signed:
            assert found.get(f, f) == label[f]


def test_chain_and_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)}


def test_fingerprints_make_candidates_of_their_own(spark):
    """Texts whose bands all differ share a key where covering tables link their fingerprints, over a chain as well."""
    rng = random.Random(4)
    base, other = rng.getrandbits(62), rng.getrandbits(62)
    fps = [base, base ^ 0b11, base ^ 0b1111, base, other, other ^ 0b111]
    signed = spark.createDataFrame([(n, [100 * n + b for b in range(20)], f) for n, f in enumerate(fps)], "node long, keys array<long>, fp long")
    groups = defaultdict(set)
    for r in simhash.candidates(signed).collect():
        groups[r.key].add(r.node)
    assert [sorted(g) for g in groups.values() if len(g) > 1] == [[0, 1, 2, 3]]
    assert len(groups) == 20 * len(fps) + 3


def test_sets_are_copied_a_few_at_a_time():
    """Sets of a batch come as one; what a worker holds beside it follows a part, not the batch."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from kinfold.llm.simhash import _compared

    n, size = 300, 20_000
    packed = [(np.arange(size, dtype=np.uint64) + np.uint64(size * (k // 2))).tobytes() for k in range(n)]
    whole, number = sum(map(len, packed)), pa.array([k // 2 for k in range(n)], pa.int64())
    zero, node = pa.array([0] * n, pa.int32()), pa.array(range(n), pa.int64())
    batch = pa.RecordBatch.from_arrays([number, zero, zero, node, node, zero, pa.array(packed, pa.binary())], names=["key", "i", "j", "node", "component", "side", "packed"])
    packed.clear()
    tracemalloc.start()
    found = [tuple(x) for b in _compared(iter([batch])) for x in zip(*b.to_pydict().values(), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(k, k + 1) for k in range(0, n, 2)]
    assert peak < whole / 2
