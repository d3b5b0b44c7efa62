"""The point-in-time join against a search through all versions for each question."""

import random

import duckdb
from pyspark.sql import functions as F

from kinfold.llm import features

VERSION = "id long, source string, event long, arrival long, expiry long, note string, winner string"
QUESTION = "q long, source string, t long, key string, winner int, best int, stretch string"


def brute(versions, questions, lifetime):
    out = []
    for q in questions:
        usable = []
        for v in versions:
            if None in (v[1], v[2], v[3], v[4], q[1], q[2]) or v[1] != q[1]:
                continue
            if v[2] <= q[2] and v[3] <= q[2] < min(v[4], v[2] + lifetime):
                usable.append((v[2], v[3], (v[0] is not None, v[0] or 0), (v[5] is not None, v[5] or "")))
        best = max(usable, default=None)
        out.append((q[0], best and (best[0], best[1], best[2][1] if best[2][0] else None, best[3][1] if best[3][0] else None)))
    return sorted(out, key=repr)


def found(spark, versions, questions, lifetime):
    v, q = spark.createDataFrame(versions, VERSION), spark.createDataFrame(questions, QUESTION)
    df = features.point_in_time(v, q, "source", F.col("event"), F.col("arrival"), F.col("expiry"), F.col("t"), lifetime, ["id"], ["note"])
    assert df.columns == ["q", "source", "t", "key", "best", "stretch", "winner"]
    return sorted(((r.q, r.winner and (r.winner.event, r.winner.arrival, r.winner.id, r.winner.note)) for r in df.collect()), key=repr)


def test_equals_a_search_through_all_versions(spark):
    """Nulls in every column, one hot source, ties, repeated rows, times below zero, lives longer than the maximum."""
    rng = random.Random(3)
    maybe = lambda x, p=0.06: None if rng.random() < p else x
    versions = []
    for i in range(700):
        e = rng.randrange(-120, 400)
        versions.append((maybe(i // 2), maybe(rng.choice(["hot", "hot", "a", "b", "c"])), maybe(e), maybe(e - 10 + rng.randrange(60)), maybe(e + rng.randrange(70)), maybe(f"n{i % 5}"), "mine"))
    versions += versions[:40]
    questions = [(k, maybe(rng.choice(["hot", "hot", "a", "b", "none"])), maybe(rng.randrange(-150, 500)), "k", 1, 2, "s") for k in range(500)]
    questions += questions[:20]
    for lifetime in (50, 7, 1000):
        got = found(spark, versions, questions, lifetime)
        assert got == brute(versions, questions, lifetime)
    assert any(w for _, w in got) and any(w is None for _, w in got)


def test_many_equal_times(spark):
    """A thousand versions of one source at one second: the best few stand for all."""
    versions = [(i, "s", 100, 90 + i % 30, 101 + i % 50, f"n{i}", None) for i in range(1000)]
    questions = [(t, "s", t, "", 0, 0, "") for t in range(95, 160)]
    assert found(spark, versions, questions, 60) == brute(versions, questions, 60)
    v = spark.createDataFrame(versions, VERSION)
    rows = v.select(F.col("source").alias("key"), "event", "arrival", "expiry", F.struct("event", "arrival", "id").alias("best"))
    kept = features.contenders(rows, 60).groupBy("start").count().collect()
    assert max(r["count"] for r in kept) <= 50


def test_empty_tables(spark):
    q = [(1, "s", 5, "", 0, 0, "")]
    assert found(spark, [], q, 10) == [(1, None)]
    assert found(spark, [(1, "s", 5, 5, 9, "n", None)], [], 10) == []


def test_query_on_awkward_tables(spark, tmp_path):
    """Null and repeated ids and labels, documents without a source, columns with names of results."""
    rng = random.Random(4)
    docs = [(rng.choice([None, i, i // 3]), f"t{i}", rng.choice(["en", None]), rng.choice(["s1", "s1", None, "s2"]), rng.choice([None, i]), "x") for i in range(300)]
    labels = [(rng.choice([None, i, i]), 1, 0, 7) for i in range(0, 330, 2)]
    labels += labels[:30]
    # Few seconds, so that versions meet questions: many documents share the same ids' folds.
    spark.createDataFrame(docs + docs[:25], "doc_id long, text string, lang string, source string, n_chars long, status string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, t long").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(features.OP12_SQL)
    got = features.op12_point_in_time(spark, str(tmp_path))
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
