"""Exact vector search over a stored ball partition: a query is compared with the balls that its k-th neighbour can lie in.

A ball is what is nearest to its centre; its radius is the largest distance from there. By the triangle inequality all its
vectors are at least the distance of the centre less the radius away, and at most the sum. The first round searches the
nearest balls that hold k vectors, whose k-th distance is a bound; the second one all other balls that begin below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.operators.graph import cut
from kinfold.operators.vectors import nearest_of
from kinfold.sources.readers import scratch

#: Balls at most, a sample that steers the work and not the result; vectors or queries of a block.
BALLS, BLOCK = 2048, 1024
#: What a distance by a matrix product may be wrong by, and scores are compared to nine digits.
_SLACK = 1e-6


class Balls:
    """A stored partition: ``vectors`` (ball, block, ids, vecs: packed; equal ones once, by the smallest id), ``members`` (kind, id:
    whose vector is that of kind) and ``centres`` with ``radius`` and ``n``, in memory."""

    def __init__(self, spark: SparkSession, path: str, metric: str):
        self.spark, self.path, self.metric = spark, path, metric
        self.vectors, self.members = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/members")
        rows = spark.read.parquet(f"{path}/balls").orderBy("ball").collect()
        self.number = np.array([r.ball for r in rows], np.int64)
        self.centres = np.array([r.centre for r in rows], float) if rows else np.empty((0, 0))
        self.radius, self.n = np.array([r.radius for r in rows]), np.array([r.n for r in rows], np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def build(corpus: DataFrame, path: str | None = None, metric: str = "l2", balls: int | None = None) -> Balls:
    """Writes the partition of ``corpus`` (id, vec) to ``path``, the shared folder unless one is given.

    There are as many balls as the square root of the number of vectors, BALLS at most; centres are drawn by a hash. For
    ``cosine`` vectors have length 1, on which the distance orders as the cosine does; zero vectors, which have the cosine 0
    with everything, are stored at the origin as a ball of their own (-1). Null vectors are left out, equal ones are one.
    """
    spark, cosine = corpus.sparkSession, metric == "cosine"
    path = path or scratch(spark, "balls")
    every = corpus.where("vec IS NOT NULL").select(F.col("id").cast("long").alias("id"), "vec")
    rows = cut(every.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"))
    every.join(rows.withColumnRenamed("id", "kind"), "vec").select("kind", "id").write.mode("overwrite").parquet(f"{path}/members")
    zero = F.forall("vec", lambda x: x == 0) if cosine else F.lit(False)
    n = rows.where(~zero).count()
    drawn = rows.where(~zero).orderBy(F.xxhash64("id"), "id").limit(balls or max(1, min(BALLS, round(n**0.5)))).select("vec").toArrow()
    centres = _matrix(drawn.column("vec").combine_chunks()) if drawn.num_rows else np.empty((0, 0))
    shared = spark.sparkContext.broadcast(_unit(centres) if cosine and len(centres) else centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = _matrix(part.column("vec"))
                none = ~x.any(axis=1) if cosine else np.zeros(len(x), bool)
                x = _unit(x) if cosine else x
                d = _distances(x, shared.value) if len(shared.value) else np.zeros((len(x), 1))
                ball = np.where(none, -1, d.argmin(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(ball), pa.array(np.where(none, 0, d.min(axis=1))), part.column("id"), pa.array(list(x), pa.list_(pa.float64()))], names=["ball", "away", "id", "vec"])

    placed = cut(rows.mapInArrow(place, "ball long, away double, id long, vec array<double>"))
    sizes = placed.groupBy("ball").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    blocks = placed.join(sizes.select("ball", F.ceil(F.col("n") / BLOCK).alias("k")), "ball").withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")))
    packed = blocks.groupBy("ball", "block").agg(F.collect_list(F.struct("id", "vec")).alias("x"))
    packed.select("ball", "block", F.col("x.id").alias("ids"), F.col("x.vec").alias("vecs")).write.mode("overwrite").parquet(f"{path}/vectors")
    one = rows.select(F.size("vec")).first()
    at = [(i, c.tolist()) for i, c in enumerate(shared.value)] + [(-1, [0.0] * (one[0] if one else 0))]
    named = spark.createDataFrame(at, "ball long, centre array<double>")
    sizes.join(named, "ball").write.mode("overwrite").parquet(f"{path}/balls")
    return Balls(spark, path, metric)


def _asked(index: Balls, queries: DataFrame, k: int, bound: DataFrame | None) -> DataFrame:
    """``ball``, ``query``, ``vec``: the balls of a round. Without a ``bound`` (query, bound) the nearest ones that hold k
    vectors; with one all others that begin below it."""
    centres, radius, size, number = index.centres, index.radius, index.n, index.number
    shared = queries.sparkSession.sparkContext.broadcast((centres, radius, size, number))
    cosine, later = index.metric == "cosine", bound is not None
    kind = queries.schema["query"].dataType.simpleString()

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, size, number = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = _matrix(part.column("vec"))
                x = _unit(x) if cosine else x
                d = _distances(x, centres)
                order = np.argsort(d, axis=1, kind="stable")
                # Whether the balls before one in this order hold k vectors already.
                before = np.cumsum(size[order], axis=1) - size[order]
                first = np.zeros(d.shape, bool)
                np.put_along_axis(first, order, before < k, 1)
                if cosine:
                    first[:, number == -1] = True
                if later:
                    most = part.column("bound").to_numpy(zero_copy_only=False)
                    first = ~first & (d - radius[None, :] <= most[:, None] + _SLACK)
                i, j = np.nonzero(first)
                yield pa.RecordBatch.from_arrays([pa.array(number[j]), part.column("query").take(pa.array(i)), pa.array(list(x[i]), pa.list_(pa.float64()))], names=["ball", "query", "vec"])

    rows = queries if bound is None else queries.join(bound, "query")
    return rows.mapInArrow(reach, f"ball long, query {kind}, vec array<double>")


def _compared(index: Balls, asked: DataFrame, k: int) -> DataFrame:
    """``query``, ``id``, ``score``: the k nearest of each block to each of its queries."""
    cosine, kind = index.metric == "cosine", asked.schema["query"].dataType.simpleString()
    counts = asked.groupBy("ball").agg(F.ceil(F.count("*") / BLOCK).alias("k"))
    blocks = asked.join(counts, "ball").withColumn("part", F.pmod(F.xxhash64("query"), F.col("k")))
    blocks = blocks.groupBy("ball", "part").agg(F.collect_list(F.struct("query", "vec")).alias("q"))
    both = index.vectors.join(blocks, "ball").select("ids", "vecs", F.col("q.query").alias("queries"), F.col("q.vec").alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, queries = np.array(batch.column("ids")[i].as_py(), np.int64), batch.column("queries")[i].as_py()
                x, q = (np.array(batch.column(c)[i].as_py(), float) for c in ("vecs", "asked"))
                score = -(q @ x.T) if cosine else np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0)
                best = nearest_of(score, np.broadcast_to(ids, score.shape), k)
                each = best[0].shape[1]
                named = batch.schema.field("queries").type.value_type
                yield pa.RecordBatch.from_arrays([pa.array([x for x in queries for _ in range(each)], named), pa.array(best[1].ravel()), pa.array(best[0].ravel())], names=["query", "id", "score"])

    return both.mapInArrow(run, f"query {kind}, id long, score double")


def _rounds(index: Balls, queries: DataFrame, k: int, threshold: float | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the first round asks for, its k nearest so far, and what the second one asks for."""
    cosine = index.metric == "cosine"
    first = cut(_asked(index, queries, k, None))
    near = cut(_ranked(_compared(index, first, k), k))
    # The k-th distance so far; a query that has fewer than k neighbours yet has no bound.
    away = F.sqrt(F.greatest(2 + 2 * F.col("score"), F.lit(0.0))) if cosine else F.sqrt("score")
    last = near.groupBy("query").agg(F.max(away).alias("far"), F.count("*").alias("m"))
    bound = F.when(F.col("m") >= k, F.col("far")).otherwise(F.lit(float("inf")))
    if threshold is not None:
        bound = F.least(bound, F.lit(float(np.sqrt(max(0.0, 2 - 2 * threshold if cosine else threshold)))))
    if cosine:  # a zero query has the same cosine with all vectors
        bound = F.when(F.forall("vec", lambda x: x == 0), float("inf")).otherwise(bound)
    bounds = queries.join(last, "query", "left").select("query", bound.alias("bound"))
    return first, near, cut(_asked(index, queries, k, bounds))


def _ranked(df: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.round("score", 9), "id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _named(queries: DataFrame) -> DataFrame:
    return queries.where("vec IS NOT NULL").select("query", F.col("vec").cast("array<double>").alias("vec"))


def search(index: Balls, queries: DataFrame, k: int = 10, threshold: float | None = None) -> DataFrame:
    """``query``, ``id``, ``score``, ``rank`` as ``vectors.nearest`` gives them: the k nearest to each of ``queries`` (query,
    vec; each name once), squared distances below or cosines not below the threshold, ties by the smaller id."""
    if not len(index.number):
        return index.spark.createDataFrame([], f"query {queries.schema['query'].dataType.simpleString()}, id long, score double, rank int")
    # Equal vectors are asked for once.
    named = _named(queries)
    kinds = cut(named.groupBy("vec").agg(F.min("query").alias("query")))
    _, near, rest = _rounds(index, kinds, k, threshold)
    found = _ranked(near.drop("rank").unionByName(_compared(index, rest, k)), k).withColumnRenamed("id", "kind")
    # Of equal vectors the k smallest ids; no id of the k nearest has a vector that isn't among the k nearest ones.
    least = Window.partitionBy("kind").orderBy("id")
    ids = index.members.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k).select("kind", "id")
    found = _ranked(found.join(ids, "kind").select("query", "id", "score"), k)
    members = named.join(kinds.withColumnRenamed("query", "_kind"), "vec").select("query", "_kind")
    found = members.join(found.withColumnRenamed("query", "_kind"), "_kind").select("query", "id", "score", "rank")
    if index.metric == "cosine":
        found = found.withColumn("score", -F.col("score"))
        return found if threshold is None else found.where(F.col("score") >= threshold)
    return found if threshold is None else found.where(F.col("score") < threshold)


def share_read(index: Balls, queries: DataFrame, k: int = 10, threshold: float | None = None) -> float:
    """Which share of all pairs of queries and vectors a search compares."""
    first, _, rest = _rounds(index, _named(queries), k, threshold)
    sizes = index.spark.createDataFrame(list(zip(index.number.tolist(), index.n.tolist(), strict=True)), "ball long, n long")
    read = first.unionByName(rest).join(sizes, "ball").agg(F.sum("n")).first()[0] or 0
    return read / max(_named(queries).count() * int(index.n.sum()), 1)
