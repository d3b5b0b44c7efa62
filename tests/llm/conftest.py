import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, pool=40):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def awkward_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows and shared passages."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 60, 500))
    long = " ".join(words(rng, 6000, 900))
    texts = [None, "", " \n\t", "a", "A b", passage, passage + " tail", "head\n" + passage.upper() + "  x", long, long + " " + passage, "x" * 5000, "ab" * 3000, "é漢 \x1c\x00 😀 ' s", passage]
    texts += [" ".join(words(rng, rng.randrange(1, 120))) for _ in range(40)]
    texts += [texts[-1], texts[-2] + " end"]
    rows = [(i, t, ["en", "fr", None][i % 3], None if i % 7 == 0 else f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [(None, passage, None, None, None), (None, None, "en", "s1", 3), rows[5], rows[5], rows[20]]


@pytest.fixture(scope="session")
def awkward(spark, tmp_path_factory):
    """The awkward rows as a table with other columns that have the names of results."""
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("awkward") / "documents.parquet")
    df = spark.createDataFrame(awkward_rows(), SCHEMA).withColumn("n_words", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("score", F.lit("y")).withColumn("ids", F.lit(2)).withColumn("component", F.lit(None).cast("string"))
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
