"""Links counted from functions' repositories, against plain sets."""

import random
from itertools import permutations

import pytest

from kinfold.operators import linkage as L


@pytest.mark.parametrize("pairs", [4_000_000, 5])
def test_shared_counts_and_evidence(spark, monkeypatch, pairs):
    monkeypatch.setattr(L, "PAIRS", pairs)
    rng = random.Random(1)
    rows = [(rng.randrange(12), rng.randrange(40)) for _ in range(150)] + [(r, 99) for r in range(12)] + [(0, None), (3, None), (None, 5), (50, 77)]
    rows += rows[:20]
    holds = spark.createDataFrame(rows, "repo long, fid long").repartition(4)
    own = {r: {f for x, f in rows if x == r} for r in {r for r, _ in rows if r is not None}}
    shared = {(a, b): (own[a] & own[b]) - {None} for a, b in permutations(own, 2)}
    counts, sizes = L.shared_counts(holds)
    found = {(r.src, r.dst): (r.shared, r.n_src, r.n_dst) for r in L.sized(counts, sizes).collect()}
    assert found == {(a, b): (len(s), len(own[a]), len(own[b])) for (a, b), s in shared.items() if a < b and s}
    links = [(a, b, len(own[a]), len(own[b])) for a, b in shared if (a + b) % 3 == 0]
    got = L.evidence_of(spark.createDataFrame(links, "src long, dst long, n_src long, n_dst long"), holds.distinct()).collect()
    assert sorted(map(tuple, got)) == sorted((a, b, f) for a, b, _, _ in links for f in shared[a, b])


def test_pairs_are_not_joined_before_they_are_counted(spark):
    holds = spark.createDataFrame([(r, f) for r in range(20) for f in range(30)], "repo long, fid long")
    plan = L.shared_counts(holds)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_no_rows(spark):
    counts, sizes = L.shared_counts(spark.createDataFrame([], "repo long, fid long"))
    assert L.sized(counts, sizes).collect() == [] and sizes.collect() == []
