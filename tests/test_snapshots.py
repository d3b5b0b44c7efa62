"""Versioned tables: what a killed writer leaves is never seen, ids stay without gaps, a repeated build does only what is left."""

import pytest
from pyspark.sql import functions as F

from kinfold.sources import snapshots as S


def bodies(spark, *names):
    return spark.createDataFrame([(f"h{n}", f"body {n}") for n in names], "fhash string, body string")


def embed(new):
    return new.select("fid", F.array(F.length("body").cast("float")).alias("vec"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_functions_are_added_as_one_version(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "s"))
    assert store.read("functions") is None and store.versions() == []
    assert S.add_functions(store, bodies(spark, "b", "a", "b"), embed) == 1
    assert S.add_functions(store, bodies(spark, "b", "d", "aa"), embed) == 2
    assert rows(store.read("functions").select("fid", "fhash")) == [(1, "ha"), (2, "hb"), (3, "haa"), (4, "hd")]
    assert rows(store.read("vectors").select("fid")) == [(1,), (2,), (3,), (4,)]
    assert rows(store.read("functions", 1).select("fid", "fhash")) == [(1, "ha"), (2, "hb")]
    assert S.add_functions(store, bodies(spark, "a"), embed) == 2
    assert store.manifest()["tables"]["functions"]["rows"] == 4
    with pytest.raises(ValueError, match="no version 9"):
        store.read("functions", 9)


def test_a_writer_killed_half_way_changes_nothing(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "s"))
    S.add_functions(store, bodies(spark, "a", "b"), embed)

    def dies(new):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        S.add_functions(store, bodies(spark, "c"), dies)
    # Killed after one table was written, and after the manifest was written but not renamed.
    spark.range(3).write.parquet(str(tmp_path / "s/data/functions/torn"))
    (tmp_path / "s/versions/.half").write_text('{"version": 2, "tab')
    assert store.versions() == [1]
    assert rows(store.read("functions").select("fhash")) == [("ha",), ("hb",)]
    assert "functions/torn" in store.leftovers()
    assert S.add_functions(store, bodies(spark, "c"), embed) == 2
    assert "functions/torn" in store.vacuum() and store.leftovers() == []
    assert rows(store.read("functions").select("fid", "fhash")) == [(1, "ha"), (2, "hb"), (3, "hc")]


def test_bad_rows_are_kept_out(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="same ids"):
        S.add_functions(store, bodies(spark, "a", "b"), lambda new: embed(new).where("fid > 1"))
    with pytest.raises(ValueError, match="same ids"):
        S.add_functions(store, bodies(spark, "a", "b"), lambda new: embed(new).union(embed(new)))
    assert store.versions() == [] and store.read("functions") is None
    S.add_functions(store, bodies(spark, "a"), embed)
    with pytest.raises(ValueError, match="has the columns"):
        store.commit({"vectors": spark.range(2)})


def test_two_writers(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "s"))
    store.commit({"t": spark.range(1)})
    store.commit({"t": spark.range(2)}, based_on=1)
    with pytest.raises(S.Conflict):
        store.commit({"t": spark.range(4)}, based_on=1)
    assert store.versions() == [1, 2] and store.read("t").count() == 3


def test_a_build_goes_on_where_it_stopped(spark, tmp_path):
    store, asked = S.Store(spark, str(tmp_path / "s")), []
    repos = spark.createDataFrame([(f"r{i}",) for i in range(12)] + [("r3",)], "repo string")

    def builder(stop=None, note="first"):
        def run(some):
            names = sorted(r.repo for r in some.collect())
            if stop is not None and len(asked) == stop:
                raise RuntimeError("killed")
            asked.append(names)
            return some.where("repo <> 'r5'").select("repo", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), F.lit(note).alias("note"))

        return run

    with pytest.raises(RuntimeError, match="killed"):
        S.build(store, repos, builder(stop=2), batches=4)
    first = {r for names in asked for r in names}
    assert 0 < len(first) < 12
    assert S.build(store, repos, builder(), batches=4) == 12 - len(first)
    assert sorted(r for names in asked for r in names) == sorted(f"r{i}" for i in range(12))
    assert S.build(store, repos, builder(stop=len(asked))) == 0
    assert rows(S.built(store).groupBy("repo").count()) == sorted((f"r{i}", 2) for i in range(12) if i != 5)
    before = store.manifest()["version"]
    assert S.build(store, repos, builder(note="again"), again=spark.createDataFrame([("r7",), ("r5",)], "repo string")) == 2
    assert rows(S.built(store).groupBy("repo", "note").count()) == sorted((f"r{i}", "again" if i == 7 else "first", 2) for i in range(12) if i != 5)
    assert rows(S.built(store, before).select("note").distinct()) == [("first",)]
