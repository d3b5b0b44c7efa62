"""Loops that end where nothing changes, however many rounds that takes, and tables that are whole."""

import random

import numpy as np
import pytest

from kinfold.functions.network import Network
from kinfold.operators import graph, linkage
from kinfold.sources import readers as R

EDGE, EVIDENCE = "src long, dst long", "src string, dst string, kind string, key long"


def rows(df):
    return sorted(map(tuple, df.collect()))


def reached(edges, seeds):
    out = set()
    for seed, node in seeds:
        todo = [node]
        while todo:
            x = todo.pop()
            if (seed, x) not in out:
                out.add((seed, x))
                todo += [b for a, b in edges if a == x]
    return sorted(out)


def test_closure_of_cyclic_graphs(spark):
    for seed, n, m, k in ((1, 30, 45, 90), (2, 60, 60, 70), (3, 12, 40, 3)):
        rng = random.Random(seed)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        seeds = [(rng.randrange(k), rng.randrange(n + 3)) for _ in range(k)]
        e, s = spark.createDataFrame(edges, EDGE), spark.createDataFrame(seeds, "seed long, node long")
        assert rows(graph.closure(e, s)) == reached(edges, seeds)
        blocked = [(x,) for x in range(0, n, 5)]
        free = [(a, b) for a, b in edges if b % 5 or b >= n], [(a, b) for a, b in seeds if b % 5 or b >= n]
        assert rows(graph.reach(e, s, spark.createDataFrame(blocked, "node long"))) == reached(*free)


def test_strong_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (6, 6), (7, 1), (8, 9), (9, 8), (4, 8)]
    assert rows(graph.strong_components(spark.createDataFrame(edges, EDGE))) == [(1, 3), (2, 3), (3, 3), (4, 5), (5, 5), (8, 9), (9, 9)]
    assert rows(graph.strong_components(spark.createDataFrame([(1, 2), (2, 3), (3, 3)], EDGE))) == []


def test_no_edges_and_no_seeds(spark):
    e, s = spark.createDataFrame([], EDGE), spark.createDataFrame([(1, 5), (1, 5)], "seed long, node long")
    assert rows(graph.closure(e, s)) == [(1, 5)]
    assert rows(graph.closure(e, s.where("false"))) == []


def test_a_chain_of_repositories_is_followed_to_its_end(spark):
    n = 25
    repos = [f"r{i:02}" for i in range(n)]
    holds = [(r, k, i + k) for i, r in enumerate(repos) for k in (0, 1)]  # the last function of one is the first of the next
    edges = [(r, 0, 1) for r in repos]
    links = [(a, b, i + 1) for i, (a, b) in enumerate(zip(repos, repos[1:], strict=False))]
    found = graph.cross_repo_reach(
        spark.createDataFrame(edges, "repo string, src long, dst long"), spark.createDataFrame(links, "src string, dst string, fid long"),
        spark.createDataFrame(holds, "repo string, node long, fid long"), spark.createDataFrame([("r00", 0)], "repo string, node long"))
    assert rows(found) == [(r, i) for i, r in enumerate(repos)]


def subsumed(evidence):
    e = set(evidence)
    while True:
        links = {(a, b) for a, b, _, _ in e}
        one = {(a, b) for a, b in links if (b, a) not in links}
        gone = {(n, o1, t, k) for n, o1, t, k in e if any((n, o2, t, k) in e for a, o2 in one if a == o1)}
        if not gone:
            return sorted(e)
        e -= gone


def test_subsumption_takes_all_its_rounds(spark):
    """Each round makes one more link one-way: more rounds than any cap that was there."""
    n = 53
    b = [f"b{i:02}" for i in range(n)]
    evidence = [("a", x, "f", 1000 + i) for i, x in enumerate(b)] + [(x, "a", "f", i) for i, x in enumerate(b) if i] + [(x, b[i - 1], "f", i) for i, x in enumerate(b) if i]
    found = rows(linkage.subsume(spark.createDataFrame(evidence, EVIDENCE)))
    assert found == subsumed(evidence)
    assert not [e for e in found if e[1] == "a"]


def test_subsumption_of_random_links(spark):
    for seed in range(4):
        rng = random.Random(seed)
        names = "abcdefg"
        evidence = list({(x, y, rng.choice("ft"), rng.randrange(4)) for _ in range(45) for x, y in [rng.sample(names, 2)]})
        df = spark.createDataFrame(evidence + evidence[:5], EVIDENCE)
        assert rows(linkage.subsume(df)) == subsumed(evidence)
    assert rows(linkage.subsume(df.where("false"))) == []


def test_ids_beyond_the_vocabulary_fail():
    network = Network(32, 4, 8, 2)
    network.embed(np.array([[0, 31, 5, 5]]))
    for ids in ([40, 1, 1, 1], [-1, 1, 1, 1]):
        with pytest.raises(ValueError, match="vocabulary of 32"):
            network.embed(np.array([ids]))


def test_half_written_tables_are_built_again(spark, tmp_path):
    path = tmp_path / "t"
    (path / "_temporary" / "0").mkdir(parents=True)
    (path / "part-00000.parquet").write_bytes(b"torn")
    df = spark.range(7)
    assert R.load_or_build(spark, str(path), lambda: df).count() == 7
    assert R.load_or_build(spark, str(path), lambda: df.limit(1)).count() == 7
