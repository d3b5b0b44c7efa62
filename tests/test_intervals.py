"""Lines in functions: against comparing every line with every function, and one file with very many functions."""

import random

from pyspark.sql import functions as F

from kinfold.operators import intervals as I
from kinfold.operators import matching as M

FUNCTION, POSITION = "path string, nid long, line_start int, line_end int", "path string, line int"


def brute(positions, functions):
    out = []
    for path, line in positions:
        hits = [(e - s, -s, n) for p, n, s, e in functions if None not in (p, s, e, line) and p == path and s <= line <= e]
        if hits:
            out.append((path, line, min(hits)[2]))
    return sorted(out)


def test_blocks_make_up_the_range(spark):
    ranges = [(i, s, s + n) for i, (s, n) in enumerate([(0, 0), (5, 0), (-7, 20), (3, 1000), (1, 2**40), (8, 7), (9, -1)])]
    df = spark.createDataFrame(ranges, "i long, s long, e long")
    for i, s, e in ranges:
        own = sorted((b << k, (b + 1) << k) for k, b in df.where(f"i = {i}").transform(lambda d: I.range_blocks(d, "s", "e")).select("level", "block").collect())
        if e < s:
            assert not own
            continue
        assert own[0][0] == s and own[-1][1] == e + 1 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
        assert len(own) <= 2 * (e - s + 2).bit_length()


def test_innermost_of_overlapping_functions(spark):
    rng = random.Random(1)
    functions = [(rng.choice(["a", "b", None]), i, s, s + rng.randrange(-2, 40)) for i in range(400) for s in [rng.randrange(300)]] + [("a", 900, None, 5), ("a", 901, 5, None)]
    functions += functions[:20]
    positions = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(320)])) for _ in range(500)]
    positions += positions[:30]
    f, p = spark.createDataFrame(functions, FUNCTION), spark.createDataFrame(positions, POSITION)
    assert sorted(map(tuple, M.enclosing(p, f).collect())) == brute(positions, functions)
    hits = sorted((path, line, n) for path, line in positions for q, n, s, e in functions if None not in (q, s, e, line) and q == path and s <= line <= e)
    assert sorted(map(tuple, I.holding(p, f).collect())) == hits
    assert not M.enclosing(p, f.where("false")).collect()
    assert not M.enclosing(p.where("false"), f).collect()


def test_one_file_with_very_many_functions(spark):
    """100,000 functions in one file inside one large scope: each position meets a row a level, never all functions."""
    n = 100_000
    f = spark.range(n).select(F.lit("big.c").alias("path"), F.col("id").alias("nid"), (F.col("id") * 10).alias("line_start"), (F.col("id") * 10 + 7).alias("line_end"))
    f = f.unionByName(spark.range(1).select(F.lit("big.c").alias("path"), F.lit(n).cast("long").alias("nid"), F.lit(0).cast("long").alias("line_start"), F.lit(10 * n).cast("long").alias("line_end")))
    p = spark.range(50_000).select(F.lit("big.c").alias("path"), (F.col("id") * 17).alias("line"), F.lit("x").alias("more"))
    found = M.enclosing(p, f)
    assert found.columns == ["path", "line", "more", "nid"]
    wrong = found.where(F.col("nid") != F.when(F.col("line") % 10 <= 7, F.floor(F.col("line") / 10)).otherwise(n))
    assert found.count() == 50_000 and wrong.isEmpty()
