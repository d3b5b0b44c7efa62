"""Exact vector search and the scores built on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors in one block: what one broadcast holds. More queries are searched block after block.
BLOCK_BYTES = 8 << 20
#: Bytes of one product of queries and vectors, and vectors in it: some of a block's queries with some vectors. A task holds a few
#: arrays of that size and its k best, however many queries and vectors there are.
PRODUCT_BYTES, PRODUCT_ROWS = 8 << 20, 1024


def normalised(v: Column) -> Column:
    """A vector over its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def nearest_of(score: np.ndarray, label: np.ndarray, k: int) -> list[np.ndarray]:
    """The k smallest scores (to nine digits) of each row with their labels, smaller labels first among equals.

    A partition finds the k-th score; only what is not above it is sorted.
    """
    if score.shape[1] > k:
        rounded = np.round(score, 9)
        bound = np.partition(rounded, k - 1, axis=1)[:, k - 1]
        most = int((rounded <= bound[:, None]).sum(axis=1).max())
        near = np.argpartition(rounded, most - 1, axis=1)[:, :most] if most < score.shape[1] else np.broadcast_to(np.arange(score.shape[1]), score.shape)
        score, label = np.take_along_axis(score, near, 1), np.take_along_axis(label, near, 1)
    order = np.lexsort((label, np.round(score, 9)), axis=1)[:, :k]
    return [np.take_along_axis(score, order, 1), np.take_along_axis(label, order, 1)]


def best_of(batches: Iterator[pa.RecordBatch], names: np.ndarray, q: np.ndarray, k: int, cosine: bool) -> Iterator[pa.RecordBatch]:
    """``query``, ``id``, ``score`` (ascending) of the k best of a task's vectors for each of a block's queries."""
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) if cosine else q
    parts = np.array_split(np.arange(len(q)), min(len(q), max(1, -(-len(q) * 8 * (PRODUCT_ROWS + k) // PRODUCT_BYTES))))
    best = [[np.full((len(p), 0), 0.0), np.full((len(p), 0), 0)] for p in parts]
    for batch in batches:
        for at in range(0, batch.num_rows, PRODUCT_ROWS):
            piece = batch.slice(at, PRODUCT_ROWS)
            ids = np.array(piece.column("id").to_pylist(), np.int64)
            x = np.array(piece.column("vec").to_pylist(), float).reshape(len(ids), -1)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if cosine else x
            for j, p in enumerate(parts):
                own = q[p[0] : p[-1] + 1]
                score = -(own @ x.T) if cosine else np.maximum((own * own).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * own @ x.T, 0)
                best[j] = nearest_of(np.hstack([best[j][0], score]), np.hstack([best[j][1], np.broadcast_to(ids, score.shape)]), k)
    for p, (score, label) in zip(parts, best, strict=True):
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[p], score.shape[1])), pa.array(label.ravel().astype(np.int64)), pa.array(score.ravel())], names=["query", "id", "score"])


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "l2", threshold: float | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query``, ``id``, ``score``, ``rank``: the k nearest of ``corpus`` (id, vec) to each of ``queries`` (query, vec).

    ``l2`` is the squared distance, ascending, below the threshold; ``cosine`` descends and includes the threshold. Ties
    go to the smaller id. Each task multiplies its vectors with a broadcast block of queries and keeps its own k best, so
    k rows for each query and task are shuffled, never all pairs.
    """
    cosine = metric == "cosine"
    size = queries.agg(F.sum(F.size("vec") * 8 + 16)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    found = None
    for b in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64("query"), F.lit(n)) == b)
        rows = part.where("vec IS NOT NULL").select("query", "vec").collect()
        if not rows:
            continue
        shared = queries.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            return best_of(batches, *shared.value, k, cosine)

        kind = queries.schema["query"].dataType.simpleString()
        own = corpus.where("vec IS NOT NULL").select(F.col("id").cast("long"), "vec").mapInArrow(run, f"query {kind}, id long, score double")
        found = own if found is None else found.unionByName(own)
    if found is None:
        return corpus.select(F.lit(None).cast("long").alias("query"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")).where("false")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 9), "id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    if cosine:
        found = found.withColumn("score", -F.col("score"))
        return found if threshold is None else found.where(F.col("score") >= threshold)
    return found if threshold is None else found.where(F.col("score") < threshold)


def repo_scores(hits: DataFrame, holds: DataFrame, weights: DataFrame, base: float = 5.0) -> DataFrame:
    """``repo``, ``score``, ``n``: each query function gives its weight over 5^(repositories it hits - 1) to each of them.

    ``hits``: query, id; ``holds``: id, repo; ``weights``: query, weight.
    """
    pairs = hits.join(holds, "id").select("query", "repo").distinct()
    shares = pairs.groupBy("query").agg(F.count("*").alias("repos")).join(weights, "query").select("query", (F.col("weight") / F.pow(F.lit(base), F.col("repos") - 1)).alias("share"))
    return pairs.join(shares, "query").groupBy("repo").agg(F.sum("share").alias("score"), F.count("*").alias("n"))


def informativeness(repos: Column, instructions: Column) -> Column:
    """Higher for functions of few repositories and few instructions: 1 / (ln(repos + 2) ln(instructions + 2))."""
    return 1 / (F.log(repos + 2) * F.log(instructions + 2))


def top_fraction(df: DataFrame, score: str, key: str, ratio: float, by: list[str] | None = None, at_least_one_more: bool = True) -> DataFrame:
    """The first least(n, floor(n ratio) + 1) rows by score, or ceil(n ratio) of them, in each group."""
    from kinfold.operators.numbering import numbered

    if by:
        ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score), key))).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    else:
        ranked = numbered(df.withColumn("_s", -F.col(score)), "_s", key, name="_r").drop("_s").withColumn("_n", df.agg(F.count("*")).scalar())
    limit = F.least(F.col("_n"), F.floor(F.col("_n") * ratio) + 1) if at_least_one_more else F.ceil(F.col("_n") * ratio)
    return ranked.where(F.col("_r") <= limit).drop("_r", "_n")
