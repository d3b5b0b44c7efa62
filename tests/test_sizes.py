"""Steps that must not grow faster than their input: what is broadcast, and counts against the rows that they stand for."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.functions import code as C
from kinfold.functions import digest, network
from kinfold.operators import balls
from kinfold.operators import intervals as I
from kinfold.operators import linkage as L
from kinfold.operators import matching as M
from kinfold.operators import references as S
from kinfold.sources import readers as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_are_not_broadcast(spark):
    """A few bytes by the estimate, many rows once they are blocks."""
    ranges = spark.createDataFrame([("p", 1, 1, 9), ("p", 2, 10, 12)], "path string, nid long, line_start int, line_end int")
    lines = spark.createDataFrame([("p", 3), ("p", 11)], "path string, line int")
    for found in (I.innermost(lines, ranges), I.holding(lines, ranges)):
        assert "Broadcast" not in plan(found)
        assert sorted(r.nid for r in found.collect()) == [1, 2]


def test_functions_are_not_broadcast(spark):
    files = spark.createDataFrame([("p", "int f() {\n return g(1);\n}\nint g(int a) {\n return a;\n}\n")], "path string, text string")
    functions = spark.createDataFrame([("p", 1, "f", 1, 3), ("p", 2, "g", 4, 6)], "path string, nid long, name string, line_start int, line_end int")
    found = S.reference_edges(files, functions)
    assert "Broadcast" not in plan(found)
    assert [tuple(r) for r in found.collect()] == [(1, 2)]


def test_three_are_counted_in_their_task(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(9), rng.randrange(30)) for _ in range(200)] + [(1, None), (2, None), (None, 3), (3, 3), (3, 3)]
    holds = spark.createDataFrame(rows, "repo long, fid long")
    found = L.shared_by_three(holds)
    # One row a repository and function is dealt out, and nothing after it.
    assert plan(found).count("Exchange") == 1
    own = {r for r in rows if None not in r}
    expected = {}
    for src, fid in own:
        others = sorted(r for r, f in own if f == fid and r != src)
        for i, x in enumerate(others):
            for y in others[i + 1 :]:
                expected[src, x, y] = expected.get((src, x, y), 0) + 1
    assert {(r.src, r.o1, r.o2): r.n for r in found.collect()} == expected


def test_token_links_are_counted_without_their_rows(spark):
    """Equal to the count of the links' rows: nulls, common names, a repeated row, and bodies that are near or far."""
    rng = random.Random(3)
    digest = ["0" * 70, "0" * 69 + "1", "0" * 7 + "f" * 63]
    nodes = [(n, f"n{rng.randrange(3)}" if n % 8 else None, rng.choice([None, "std", "s::t"])) for n in range(40)]
    rows = [(rng.randrange(7), *x) for x in nodes for _ in range(3)]
    tokens = spark.createDataFrame([*rows, rows[1], (None, 1, "n1", "s::t")], "repo long, nid long, name string, scope string")
    hashes = spark.createDataFrame([(n, rng.choice(digest)) for n, *_ in nodes if n % 5], "nid long, fhash string")
    common = spark.createDataFrame([("n2",)], "identifier string")
    for own in (None, hashes):
        expected = L.token_links(tokens, common, own).groupBy("ra", "rb").agg(F.count("*").alias("n"))
        found = L.token_link_counts(tokens, common, own)
        assert plan(found).count("Exchange") == 1
        assert found.count() and sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_a_large_vocabulary_needs_no_table():
    """Rows follow from their ids: the same wherever they are looked up, normal, and zero for padding."""
    n = network.TABLE + 5
    own = network.Network(n, 8, 8, 3)
    ids = np.array([[0, n - 1, 7], [7, 1, 0]])
    rows = own.looked_up(ids)
    assert own.embedding is None and rows.shape == (2, 3, 8)
    assert not rows[0, 0].any() and (rows[0, 2] == rows[1, 0]).all() and (rows[0, 1] == own.looked_up(np.array([n - 1]))).all()
    many = own.looked_up(np.arange(1, 20_000))
    assert abs(many.mean()) < 0.01 and abs(many.std() - 1) < 0.01 and len(np.unique(many)) > 150_000
    assert own.embed(np.tile(ids, 8)).shape == (2, 8)
    with pytest.raises(ValueError):
        own.embed(np.array([[n]]))


def test_digests_are_bounded_before_they_are_compared(monkeypatch):
    """Few pairs near and all pairs near, against the sum of costs; where few are near, no product of weights is made."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 16, (70, 70))
    close = base[:40].copy()
    for row in close:
        row[rng.integers(0, 70, 6)] = rng.integers(0, 16, 6)
    text = lambda v: ["".join(f"{c:x}" for c in row) for row in v]
    for ys, threshold in ((close, 50), (close, 1000)):
        with monkeypatch.context() as m:
            if threshold == 50:
                m.delattr(digest._Side, "weights")
            batch = pa.RecordBatch.from_pydict({"x": ["x"], "y": ["y"], "xs": [text(base)], "ys": [text(ys)]})
            found = {(r["a"], r["b"]): r["distance"] for b in digest.pairs_below(iter([batch]), threshold) for r in b.to_pylist()}
        expected = {}
        for a, u in zip(text(base), base, strict=True):
            for b, v in zip(text(ys), ys, strict=True):
                codes = sum(int(digest._CODES[p >> 2][q >> 2] + digest._CODES[p & 3][q & 3]) for p, q in zip(u[6:].tolist(), v[6:].tolist(), strict=True))
                d = codes + digest.nibble_cost(int(u[4] - v[4])) + digest.nibble_cost(int(u[5] - v[5])) + int(a[:2] != b[:2])
                if d < threshold:
                    expected[a, b] = d
        assert expected and found == expected


def test_equal_vectors_are_asked_for_once(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(12)], "id long, vec array<double>")
    queries = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(10)] + [(10, None)], "query long, vec array<double>")
    index, asked, plain = balls.build(corpus), [], balls._rounds
    monkeypatch.setattr(balls, "_rounds", lambda i, q, *more: asked.append(q.count()) or plain(i, q, *more))
    found = sorted(map(tuple, balls.search(index, queries, 3, 0.5).select("query", "rank", "id", "score").collect()))
    assert asked == [2]
    assert found == [(q, r + 1, q % 2 + 3 * r, 0.0) for q in range(10) for r in range(3)]


def test_borrowed_before_needs_no_links(spark):
    """As along the links, which are never made: no row goes out for two repositories."""
    rng = random.Random(8)
    rows = [(rng.randrange(12), n, rng.choice([*"abcd", None]), rng.choice([None, "s", "t", "u"])) for n in range(60)]
    tokens = spark.createDataFrame([*rows, rows[0], (None, 1, "a", "s")], "repo long, nid long, name string, scope string")
    a, b = tokens.select(F.col("repo").alias("dst"), "name").distinct(), tokens.select(F.col("repo").alias("src"), "name").distinct()
    expected = L.borrowed(a.join(b, "name").where("dst < src").select("src", "dst"), tokens)
    found = L.borrowed_before(tokens)
    assert 0 < found.count() < 60 and sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    assert "src" not in plan(found)


def test_equal_vectors_are_stored_once(spark):
    """One of each is compared; all their ids are found, the smallest first."""
    corpus = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)] + [(40, None)], "id long, vec array<double>")
    queries = spark.createDataFrame([(0, [0.1, 1.0])], "query long, vec array<double>")
    for metric in ("l2", "cosine"):
        index = balls.build(corpus, metric=metric)
        assert int(index.n.sum()) == 3 and index.vectors.count() <= 3
        assert [r.id for r in balls.search(index, queries, 12).orderBy("rank").collect()] == [*range(0, 30, 3), 1, 4]


def test_padding_is_not_computed(monkeypatch):
    """Vectors as those of all positions; the positions that convolutions see follow the tokens, not the padding."""
    seen, plain = [], network.Network.convolve
    own = network.Network(40, 4, 8, 6)
    rng = np.random.default_rng(2)
    for length in (1, 5, 33, 64):
        for used in {0, 1, min(7, length), length}:
            ids = rng.integers(1, 40, (3, length))
            ids[:, used:] = 0
            x = own.convolve(own.looked_up(ids).transpose(0, 2, 1), own.first)
            for block in own.blocks[:-1]:
                x = own.down(x, block)
            expected = own.residual(x, own.blocks[-1]).mean(axis=2)
            with monkeypatch.context() as m:
                m.setattr(network.Network, "convolve", staticmethod(lambda x, w: seen.append(x.shape[2]) or plain(x, w)))
                found = own.embed(ids)
            assert np.allclose(found, expected, atol=1e-5)
            if length == 64 and used == 7:
                assert max(seen) <= 12
            seen.clear()


def test_instructions_are_read_by_text(spark):
    """As read one by one, in the order of addresses and texts; the reading is behind a checkpoint of distinct texts."""
    texts = ["mov rax , [ rbx + 0x10 ]", "add rcx , 0x99999", "bad 0xzz", "ret"]
    rows = spark.createDataFrame([(i % 3, i % 2, i // 4, texts[i * i % 4]) for i in range(40)], "ea long, block_id long, addr long, text string")
    one = F.struct("addr", "text")
    plain = C.instruction_sequences(rows.groupBy("ea", "block_id").agg(F.collect_list(one).alias("instructions")))
    expected = plain.select("ea", F.transform("instructions", lambda t: C.instruction(t)).alias("i"))
    tokens = C.with_tokens(rows)
    assert "regexp" not in plan(tokens).lower()
    found = C.instruction_sequences(tokens.groupBy("ea", "block_id").agg(F.collect_list(F.struct("addr", "text", "token")).alias("instructions")), "token")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_a_folder_gets_few_files(spark, tmp_path):
    """One file a folder, however many tasks have rows of it."""
    rows = spark.range(0, 400, numPartitions=8).select((F.col("id") % 20).alias("repo"), F.col("id").alias("k"))
    R.write_json(rows, str(tmp_path / "j"), by=("repo",))
    files = list((tmp_path / "j").glob("repo=*/*.json"))
    assert len(files) == 20 and R.read_json(spark, str(tmp_path / "j"), "k long, repo long").count() == 400


def test_versions_are_not_broadcast(spark):
    """What is joined grows with both versions; only the block counts, 256 at most, are broadcast."""
    digest = lambda c: F.concat(F.lit("aabb00"), F.md5(c.cast("string")), F.md5(c.cast("string")))
    a, b = (spark.range(60).select(F.col("id"), F.concat(F.lit(n), F.col("id").cast("string")).alias("name"), F.lit(None).cast("string").alias("ns"), F.lit(n).alias("path"), digest(F.col("id") + k).alias("fhash")) for n, k in (("x", 0), ("y", 20)))
    found = M.implementation_relations(a, b, M.version_relations(a, b))
    assert sorted((r.a, r.b) for r in found.collect() if r.exact) == [(i, i - 20) for i in range(20, 60)]
    final = plan(found).split("== Initial Plan ==")[0]
    assert final.count("BroadcastHashJoin") <= 2 and "SortMergeJoin" in final
