"""Executables, selection of functions and searches from functions on, against plain versions."""

import numpy as np
import pytest

from kinfold.functions import code as C
from kinfold.functions.network import Network
from kinfold.operators.embedded import Embedder, binary_scores, source_scores
from kinfold.operators.executables import Executables
from kinfold.operators.selection import all_functions, functions_of_nodes, representative_functions

NODES = "exe long, node long, ea long, label string"
FUNCTIONS = "exe long, ea long, fname string, fid long, strings array<string>"


def made(spark, nodes, edges, functions):
    return Executables(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, "exe long, src long, dst long"), spark.createDataFrame(functions, FUNCTIONS))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def two(spark):
    nodes = [(1, 1, 10, "a"), (1, 2, 20, "b"), (1, 3, 30, None), (1, 4, None, None), (2, 1, 10, "b"), (2, 2, 99, "a"), (None, 5, 10, "a"), (1, 1, 10, "a"), (1, 6, 60, "_Znwm"), (1, 7, 70, "malloc"), (1, 8, 80, "_ZN2ns1fEi"), (1, 9, 90, "std::x")]
    functions = [(1, 10, "a", 100, ["long one", "long one", "abc", None, "ü--"]), (1, 77, "b", 101, ["beta"]), (1, 30, None, 102, ["gamma"]), (2, 10, "c", 103, None), (2, 11, "a", 104, []), (1, 70, "malloc", 105, ["only libc"]), (None, 10, "a", 106, ["nowhere"])]
    return made(spark, nodes, [(1, 1, 2), (1, 1, 2), (1, None, 2), (2, 1, 2)], functions)


def test_functions_meet_inside_their_executable_only(two):
    assert rows(two.node_functions()) == sorted([(1, 1, 100, 0), (1, 2, 101, 1), (1, 3, 102, 2), (1, 4, None, None), (2, 1, 103, 2), (2, 2, 104, 1), (1, 6, None, None), (1, 7, 105, 0), (1, 8, None, None), (1, 9, None, None)], key=repr)


def test_names_and_features(two):
    assert rows(two.names()) == [(1, 1, "a"), (1, 2, "b"), (1, 8, "ns::f"), (2, 1, "b"), (2, 2, "a")]
    # The C library's own strings and those of three bytes say nothing; a node without a label has strings but no symbol.
    assert rows(two.features()) == sorted([(1, "symbol", x) for x in ("a", "b", "_Znwm", "_ZN2ns1fEi", "std::x")] + [(1, "string", x) for x in ("long one", "ü--", "beta")] + [(2, "symbol", "a"), (2, "symbol", "b")], key=repr)
    assert ("gamma", 3) in {(s, n) for _, s, n in rows(two.strings())}


def test_a_graph_of_another_build_fails(two):
    assert rows(two.incompatible()) == [(1, 2, 20, "b"), (2, 2, 99, "a")]
    with pytest.raises(ValueError, match="other addresses"):
        two.checked()


def test_sizes_and_nothing(spark, two):
    assert [tuple(r) for r in two.sizes().orderBy("exe").collect()] == [(1, 8, 1, 4, 5, 3, 1), (2, 2, 1, 2, 2, 0, 1)]
    empty = made(spark, [], [], []).checked()
    assert not empty.sizes().collect() and not empty.names().collect() and not empty.features().collect()


@pytest.fixture(scope="module")
def files(spark):
    ok, bad = ["return", ";"], ["<ERROR>", ";"]
    data = [("p", 1, "h1", ok, 3.0), ("p", 2, "", ok, 1.0), ("p", 3, "h3", bad, 0.0), ("p", 4, "h4", [*bad, "x", "y"], 2.0), ("q", 1, "h5", ok, 2.0), ("q", 2, "h6", None, 2.0), ("s", 1, "h7", ok, 1.0), ("t", 1, "", ok, 1.0)]
    return spark.createDataFrame(data, "path string, line long, fhash string, tokens array<string>, mi double")


def test_selection(spark, files):
    skip = spark.createDataFrame([("s",), ("s",), ("unseen",), (None,)], "path string")
    kept, errors, skipped = all_functions(files, skip)
    assert rows(kept.select("path", "line")) == [("p", 1), ("p", 4), ("q", 1), ("q", 2)]
    assert rows(errors.select("path", "line")) == [("p", 3)] and rows(skipped) == [("s",)]
    assert all_functions(files)[0].count() == 5
    few, _, _ = representative_functions(files, 0.5, skip)
    assert rows(few.select("path", "line")) == [("p", 4), ("q", 1)]


def test_nodes_stand_for_whole_files(spark, files):
    nodes = spark.createDataFrame([(k,) for k in (1, 1, 2, 3, 4, 5, 6, 7)], "node long")
    names = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 7, 9)], "node long")
    debug = spark.createDataFrame([(1, "p"), (2, "p"), (3, "lost"), (5, "s"), (6, "q"), (7, "t"), (4, None)], "node long, path string")
    kept, left, skipped = functions_of_nodes(nodes, names, debug, files, spark.createDataFrame([("s",), ("q",)], "path string"))
    # 6 has no name; 4 has no line; "t" is known, but its only function is empty.
    assert rows(kept.select("path", "line")) == [("p", 1), ("p", 3), ("p", 4)]
    assert rows(left) == [(3,), (4,)] and rows(skipped) == [("s",)]
    kept, left, skipped = functions_of_nodes(nodes, names, debug, files)
    assert kept.count() == 4 and rows(left) == [(3,), (4,)] and not skipped.collect()


def plain_scores(network, ids, asked, weights, repos, k, near):
    """Scores by all distances; ``near``: which score of the k best counts."""
    names = sorted(ids)
    vec = network.embed(np.array([ids[n] for n in names])).astype(float)
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    out = {}
    for q in asked:
        d = near(vec[names.index(q)], vec)
        order = sorted(range(len(names)), key=lambda i: (round(d[i], 9), names[i]))[:k]
        found = {repo for i in order if d[i] < 0 for repo in repos.get(names[i], ())}
        for repo in found:
            out[repo] = out.get(repo, 0) + weights[q] / 5 ** (len(found) - 1)
    return out


WORDS = ["if", "a", ";", "x", "for", "return"]


def bodies_of(n, seed):
    rng = np.random.default_rng(seed)
    own = [[WORDS[j] for j in rng.integers(0, len(WORDS), rng.integers(1, 9))] for _ in range(n)]
    return [*own[: n // 2], *own[: n - n // 2]]  # every body twice


def setting(spark, n, column):
    bodies = bodies_of(n, 5)
    functions = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], f"id long, {column} array<string>")
    vocabulary = spark.createDataFrame([("<PAD>", 0), ("<UNK>", 1), *((w, i + 2) for i, w in enumerate(WORDS[:-1]))], "token string, id long")
    network = Network(len(WORDS) + 1, 8, 8, 3)
    number = {w: i + 2 for i, w in enumerate(WORDS[:-1])}
    ids = {i: ([number.get(w, 1) for w in b] + [0] * 16)[:16] for i, b in enumerate(bodies)}
    repos = {i: {i % 4, 9 if i % 3 else 8} for i in range(n)}
    holds = spark.createDataFrame([(i, r) for i, rs in repos.items() for r in rs], "id long, repo long")
    return bodies, functions, Embedder(vocabulary, network, 16), network, ids, repos, holds


def test_sources_to_scores(spark):
    bodies, functions, embedder, network, ids, repos, holds = setting(spark, 40, "tokens")
    asked = functions.withColumnRenamed("id", "query").where("query < 9")
    got = {r.repo: r.score for r in source_scores(embedder, embedder.index(functions, "tokens"), asked, holds, 3, 0.2).collect()}
    weights = {i: 1 + sum(w in C.BRANCHES for w in b) for i, b in enumerate(bodies)}
    want = plain_scores(network, ids, range(9), weights, repos, 3, lambda q, v: ((v - q) ** 2).sum(axis=1) - 0.2)
    assert got == pytest.approx(want)


def test_instructions_to_scores(spark):
    bodies, functions, embedder, network, ids, repos, holds = setting(spark, 40, "instructions")
    lines = spark.createDataFrame([(i,) for i in range(30)], "query long")
    asked = functions.withColumnRenamed("id", "query")
    got = {r.repo: r.score for r in binary_scores(embedder, embedder.index(functions, "instructions", "cosine"), asked, lines, holds, 4, 0.6).collect()}
    want = plain_scores(network, ids, range(30, 40), {i: len(b) for i, b in enumerate(bodies)}, repos, 4, lambda q, v: 0.6 - v @ q)
    assert got == pytest.approx(want)


def test_equal_beginnings_share_a_vector_and_nulls_have_none(spark):
    _, _, embedder, *_ = setting(spark, 4, "tokens")
    long = [";"] * 16
    data = [(1, long), (2, [*long, "x"]), (3, None), (4, [])]
    got = {r.id: r.vec for r in embedder.embed(spark.createDataFrame(data, "id long, tokens array<string>"), "id", "tokens").collect()}
    assert sorted(got) == [1, 2, 4] and got[1] == got[2]
