"""Nearest neighbours by multiprobe p-stable hashing.

A hash is a Gaussian projection cut into slots of one width; a table joins several hashes, and its buckets are the slots'
combinations. A vector at distance r from a query falls into a slot with a normal probability, so buckets have estimated
success probabilities. A query visits the most probable buckets of all tables in turn, its own and perturbed ones, until the success
over all tables is as wanted. Candidates of all tables are ranked by their exact distance.

What a query needs is set by its own distances, taken from a bounded sample: among well separated vectors a few buckets do,
among evenly spread ones most of them. A query whose buckets would be too many is compared with all vectors instead. Equal
vectors are searched once and stand for all their rows. Buckets of any size are cut into blocks, and two blocks meet in one
matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import mix, release, staged, table

#: Tables; success wanted over all of them for a neighbour as far as the last one asked for.
TABLES, SUCCESS = 8, 0.95
#: Vectors of a bucket that the number of hashes aims at; width of a slot, in deviations of a projection.
BUCKET, WIDTH = 128, 2.0
#: Distinct vectors that distances and the width are estimated on; buckets that a query visits at most, beyond
#: which it is compared with all vectors; vectors and queries of a block.
SAMPLE, PROBES, BLOCK = 4096, 2048, 1024
#: Slack of distances by matrix products, which only choose what is measured exactly.
_SLACK = 1e-7
#: Probability of a slot below which no neighbour is looked for in it.
_RARE = 1e-3
_U = np.uint64


def usable(vec: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


class Index:
    """The hashes of all tables for vectors of one length: a rule gives them, so every worker has the same."""

    def __init__(self, dim: int, n: int, deviation: float):
        # A slot of this width tells about 1.2 bits.
        self.hashes = max(0, int(np.log2(max(n, 1) / BUCKET) / 1.2 + 0.5)) if n > BUCKET else 0
        self.tables = TABLES if self.hashes else 1
        rng = np.random.Generator(np.random.PCG64([dim, 7]))
        self.planes = rng.standard_normal((dim, self.tables * self.hashes))
        self.shifts = rng.random(self.tables * self.hashes)
        self.width = WIDTH * deviation if deviation > 0 else 1.0
        self.dim = dim

    def places(self, x: np.ndarray) -> np.ndarray:
        """Where each vector stands on each hash, in slots: vectors, tables, hashes."""
        return (x @ self.planes / self.width + self.shifts).reshape(len(x), self.tables, self.hashes)

    def cells(self, codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """A number for each bucket: the last axis of ``codes`` holds a bucket's slots. Buckets that share one are searched together."""
        h = mix((tables.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15) + _U(self.dim))
        h = np.broadcast_to(h, codes.shape[:-1]).copy()
        for i in range(codes.shape[-1]):
            h = mix(h * _U(31) + codes[..., i].astype(np.int64).view(_U))
        return h.view(np.int64)

    def probes(self, place: np.ndarray, r: float) -> np.ndarray | None:
        """The buckets that a query at ``place`` visits for neighbours at distance r; None where they are too many."""
        if not self.hashes:
            return self.cells(np.zeros((1, 0), np.int64), np.zeros(1, np.int64))
        scale = max(r / self.width, 1e-9)
        if scale > 5:
            return None
        reach = int(np.ceil(3 * scale)) + 1
        slots = np.floor(place).astype(np.int64)[..., None] + np.arange(-reach, reach + 1)
        edges = np.concatenate([slots, slots[..., -1:] + 1], axis=-1) - place[..., None]
        share = np.diff(normal(edges / scale), axis=-1)
        cells, chances, gains = [], [], []
        for t in range(self.tables):
            codes, chance = np.zeros((1, 0), np.int64), np.ones(1)
            for slot, p in zip(slots[t], share[t], strict=True):
                # The most probable combinations begin with most probable ones; slots out of reach are left out.
                slot, p = slot[p > _RARE], p[p > _RARE]
                both = (chance[:, None] * p).ravel()
                best = np.argsort(-both, kind="stable")[:PROBES]
                codes = np.hstack([codes[best // len(p)], slot[best % len(p)][:, None]])
                chance = both[best]
            cells.append(self.cells(codes, np.full(len(codes), t)))
            chances.append(chance)
            gains.append(-np.diff(np.log1p(-np.minimum(np.cumsum(chance), 1 - 1e-12)), prepend=0.0))
        # Success over all tables: 1 less the product of what each table misses.
        order = np.argsort(-np.concatenate(chances), kind="stable")
        n = int(np.searchsorted(np.cumsum(np.concatenate(gains)[order]), -np.log(1 - SUCCESS))) + 1
        return np.concatenate(cells)[order[:n]] if n <= min(len(order), PROBES) else None


def normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, by a polynomial that errs by 7.5e-8 at most."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, 1 - tail, tail)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of each vector length."""
    lengths = np.array([len(v) for v in batch.column("vec")], np.int64)
    for dim in np.unique(lengths):
        yield int(dim), batch.take(pa.array(np.flatnonzero(lengths == dim)))


def _own_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)


class _Best:
    """The nearest vectors of each query so far."""

    def __init__(self, k: int):
        self.k = k
        self.found: dict[int, dict[int, tuple[float, list[int]]]] = {}

    def add(self, queries: list[int], x: np.ndarray, reps: list[int], ids: list[list[int]], y: np.ndarray) -> None:
        near = _own_distances(x, y)
        bound = np.partition(near, self.k - 1, axis=1)[:, self.k - 1] if near.shape[1] > self.k else near.max(axis=1)
        i, j = np.nonzero(near <= (bound + _SLACK * (1 + bound))[:, None])
        exact = np.sqrt(((x[i] - y[j]) ** 2).sum(axis=1))
        for a, b, d in zip(i.tolist(), j.tolist(), exact.tolist(), strict=True):
            self.found.setdefault(queries[a], {})[reps[b]] = (d, ids[b])
        for q in {queries[a] for a in i.tolist()}:
            own = self.found[q]
            if len(own) > 4 * self.k:
                self.found[q] = self._first(own)

    def _first(self, own: dict) -> dict:
        return dict(sorted(own.items(), key=lambda e: (e[1][0], e[0]))[: self.k])

    def batch(self) -> pa.RecordBatch:
        rows = [(q, rep, d, ids) for q, own in self.found.items() for rep, (d, ids) in self._first(own).items()]
        self.found = {}
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())), strict=True)], names=["q", "rep", "score", "ids"])


def _met(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest distinct vectors of each query among the blocks of a task. Rows come by block, queries first."""
    best, block, asked = _Best(k), None, ([], np.empty((0, 0)))
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "i", "j", "is_row")])
        cuts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
            part, here = batch.slice(a, b - a), tuple(key[:3, a].tolist())
            if here != block:
                block, asked = here, ([], np.empty((0, 0)))
            for dim, rows in _by_length(part) if len({len(v) for v in part.column("vec")}) > 1 else [(len(part.column("vec")[0]), part)]:
                names, x = rows.column("rep").to_pylist(), _matrix(rows.column("vec"), dim)
                if key[3, a] == 0:
                    asked = (asked[0] + names, np.vstack([asked[1], x]) if asked[0] else x)
                elif asked[0] and asked[1].shape[1] == dim:
                    best.add(asked[0], asked[1], names, rows.column("ids").to_pylist(), x)
        if len(best.found) > 1 << 14:
            yield best.batch()
    yield best.batch()
    release()


def nearest(vectors: DataFrame, asks: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest rows to each row that ``asks``, by Euclidean distance.

    Nearest first, equal distances by the smaller id; a row is no neighbour of its own. Vectors that are null, empty, zero
    or hold null or non-finite components take no part, neither do rows with a null id; of rows with equal ids the one
    with the least vector counts, so repeated rows count once. Only vectors of equal length are compared. Other columns are
    ignored, and an empty table gives no rows. A query with fewer neighbours than k has them all.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec"))).groupBy("id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks"))
    rows = staged(rows, "vectors")
    # A vector's first k + 1 rows are all that can be among the k nearest of any other row; the limit works in map tasks too.
    order = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    firsts = rows.select("id", "vec").withColumn("n", order).where(F.col("n") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    firsts = staged(firsts.select(F.col("ids")[0].alias("rep"), "ids", "vec"), "distinct-vectors")
    asking = staged(rows.where("asks").select("id", "vec").join(firsts.select("rep", "vec"), "vec").select("id", "rep"), "queries")
    asked = firsts.join(asking.select("rep").distinct(), "rep", "left_semi").select("rep", "vec")
    found = _searched(firsts, asked, k + 1)
    near = found.dropDuplicates(["q", "rep"]).select("q", F.explode("ids").alias("vec_id"), "score")
    first = lambda df, by, n, name: df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy("score", "vec_id"))).where(F.col(name) <= n)
    near = first(near, "q", k + 1, "n").drop("n")
    pairs = asking.withColumnRenamed("id", "query_id").join(near, F.col("rep") == F.col("q")).where("vec_id <> query_id")
    return first(pairs, "query_id", k, "rank").select("query_id", "rank", "vec_id", "score")


def _searched(firsts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``q``, ``rep``, ``score``, ``ids``: the k nearest distinct vectors of each query that a task has found."""
    spark = firsts.sparkSession
    counts = {r["dim"]: r["n"] for r in firsts.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}
    drawn: dict[int, list[list[float]]] = {}
    for r in firsts.orderBy(F.xxhash64("vec"), "rep").limit(SAMPLE).select("vec").toArrow().column("vec").to_pylist():
        drawn.setdefault(len(r), []).append(r)
    samples = {dim: np.array(v) for dim, v in drawn.items()}
    deviations = {dim: float(np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1).mean())) for dim, x in samples.items()}
    shared = spark.sparkContext.broadcast((counts, deviations, samples))
    names = ["cell", "rep", "ids", "vec", "is_row"]

    def rows_of(cells, batch, at, is_row) -> pa.RecordBatch:
        part = batch.take(pa.array(at))
        ids = part.column("ids") if is_row else pa.nulls(len(at), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), part.column("rep"), ids, part.column("vec"), pa.array(np.full(len(at), is_row, np.int32))], names=names)

    def chunk(reps: np.ndarray, n: int) -> np.ndarray:
        return (mix(reps.astype(np.int64).view(_U).copy()) % _U(n)).astype(np.int64)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector in its bucket of each table."""
        counts, deviations, _ = shared.value
        for batch in batches:
            for dim, part in _by_length(batch):
                index = Index(dim, counts[dim], deviations.get(dim, 1.0))
                codes = np.floor(index.places(_matrix(part.column("vec"), dim))).astype(np.int64)
                cells = index.cells(codes, np.arange(index.tables)[None, :])
                for t in range(index.tables):
                    yield rows_of(cells[:, t], part, np.arange(part.num_rows), 1)
        release()

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query in the buckets that it visits; in cell -1 if they would be too many."""
        counts, deviations, samples = shared.value
        for batch in batches:
            for dim, part in _by_length(batch):
                index, sample = Index(dim, counts[dim], deviations.get(dim, 1.0)), samples.get(dim, np.empty((0, dim)))
                x = _matrix(part.column("vec"), dim)
                # The sample's neighbour that stands for the last one asked for; the query itself may be in the sample.
                rank = max(1, -(-k * len(sample) // counts[dim]))
                places = index.places(x)
                for a in range(0, len(x), BLOCK):
                    far = np.sort(_own_distances(x[a : a + BLOCK], sample), axis=1)
                    cells, at = [], []
                    for i in range(len(far)):
                        apart = far[i][far[i] > _SLACK * (1 + (x[a + i] ** 2).sum())]
                        r = float(np.sqrt(apart[min(rank, len(apart)) - 1])) if len(apart) else float("inf")
                        own = index.probes(places[a + i], r)
                        own = np.array([-1], np.int64) if own is None else np.unique(own)
                        cells.append(own)
                        at.append(np.full(len(own), a + i))
                    yield rows_of(np.concatenate(cells), part, np.concatenate(at), 0)
        release()

    schema = "cell long, rep long, ids array<long>, vec array<double>, is_row int"
    probes = staged(asked.mapInArrow(probed, schema), "probes")
    index = firsts.mapInArrow(indexed, schema)
    if not probes.where("cell = -1").isEmpty():
        # For queries that are compared with all vectors these are in cell -1 too, whose blocks are dealt like any other's.
        index = index.unionByName(firsts.select(F.lit(-1).cast("long").alias("cell"), "rep", "ids", "vec", F.lit(1).alias("is_row")))
    index = staged(index, "buckets")
    sizes = [df.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name)) for df, name in ((index, "ni"), (probes, "nj"))]
    grid = sizes[0].join(sizes[1], "cell")
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    both = index.join(grid, "cell").select("cell", deal("ni").alias("i"), every("nj").alias("j"), "is_row", "rep", "ids", "vec")
    both = both.unionByName(probes.join(grid, "cell").select("cell", every("ni").alias("i"), deal("nj").alias("j"), "is_row", "rep", "ids", "vec"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(n, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "is_row")
    return dealt.mapInArrow(lambda batches: _met(batches, k), "q long, rep long, score double, ids array<long>")


#: Every so many ids are queries.
EVERY = 100


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of ``embeddings`` to each vector whose id is divisible by 100."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
