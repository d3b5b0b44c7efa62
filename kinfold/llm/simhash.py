"""SimHash near-duplicate groups by covering locality-sensitive hashing.

Covering codes: every bit position i gets a vector m(i) of r + 1 bits; the table of a vector v other than zero keeps the
bits with <m(i), v> = 1 (mod 2). Any r positions span at most r dimensions, so some v is orthogonal to all of them: two
fingerprints that differ in at most r bits agree on all kept bits of that table. With r = 2 there are 7 tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest, xxh128_digest

from kinfold.llm.common import ROW, blobs, cut, mix, slices, staged, table
from kinfold.llm.graph import components
from kinfold.llm.repeats import BROADCAST_BYTES, partitions

#: Distinct fingerprints of one bucket that are still compared pair by pair; larger buckets link through neighbours.
PAIRWISE = 64
_PART = 1 << 16


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The kept bits of each of the 2^(radius+1) - 1 tables."""
    full = (1 << (radius + 1)) - 1
    vectors = [1 + (i % full) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, full + 1)]


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The SimHash of one text: a bit is set if it is set in over half of the hashes of its word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return xxh64_intdigest(whole, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = [0, *ends[: n - 1].tolist()]
    last = (ends[width - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _PART):
        parts = [whole[a:b] for a, b in zip(first[at : at + _PART], last[at : at + _PART], strict=True)]
        h = np.fromiter(map(xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            found = np.array([fingerprint(t, width) for t in blobs(batch.column(text_col))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(found)], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _forest(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of each small bucket, thinned to those that join its groups."""
    for batch in batches:
        out: list[tuple[int, int]] = []
        for members in batch.column("fps").to_pylist():
            x = np.array(members, np.int64)
            near = np.bitwise_count(x[:, None].view(np.uint64) ^ x[None, :].view(np.uint64)) <= radius
            left, right = np.nonzero(np.triu(near, 1))
            root = list(range(len(members)))
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                while root[i] != i:
                    i = root[i]
                while root[j] != j:
                    j = root[j]
                if i != j:
                    root[max(i, j)] = min(i, j)
                    out.append((members[i], members[j]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])


def links(fps: DataFrame, radius: int = 2, pairwise: int = PAIRWISE) -> DataFrame:
    """Links ``a``, ``b`` between the distinct values of ``fp`` whose transitive closure is that of all links.

    Buckets of at most ``pairwise`` values are compared pair by pair. In larger ones the values link through what they
    become when up to radius / 2 bits flip (two values differ in at most ``radius`` bits exactly if they share such a
    neighbour), which costs each value 65 rows however large the bucket is. Only radius 2 has that second way.
    """
    if radius != 2:
        raise ValueError("large buckets are exact for radius 2 only")
    masks = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius)]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    placed = cut(keyed.join(sizes, ["t", "key"]))
    small = placed.where(F.col("n") <= pairwise).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    near = small.mapInArrow(lambda b: _forest(b, radius), "a long, b long")
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - ((1 << 64) if i == 63 else 0)).cast("long")) for i in range(64)])
    around = placed.where(F.col("n") > pairwise).select("fp").distinct().select("fp", F.explode(flips).alias("by"))
    hubs = around.groupBy("by").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("by", "hub")
    return near.unionByName(around.join(hubs, "by").where("fp != hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` of each row of ``docs``.

    Fingerprints of 3-word shingles link at 2 or fewer differing bits; ``component_id`` is the smallest id reachable.
    A null or empty text has fingerprint zero and links like any other. Rows with equal ids are rows of their own and
    share a group if their texts do. A null id is never the smallest; a group with null ids only has a null component.
    An empty table gives no rows; other columns of ``docs`` are not touched.
    """
    found = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = cut(found.groupBy("fp").agg(F.min(id_col).alias("least")))
    linked = cut(components(links(distinct.select("fp"))))
    of = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of.join(least, "component").select("fp", "component_id")
    return found.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- Groups of similar texts -------------------------------------------------------------------------------------------
# Groups of SimHash fingerprints within 2 bits are candidates first. Texts at a shingle similarity of 0.8 differ in about ten
# of 64 bits, and a covering family for all of them would need 2^17 tables: those beyond 2 bits come from bands of smallest
# hashes. The exact check follows for both; see the README for the figures.

BANDS, ROWS = 20, 4
#: Words of a shingle, and the least similarity (Jaccard, as a fraction) of near duplicates.
WIDTH, LEAST = 5, (4, 5)
#: Smallest hashes, of BANDS * ROWS, in which two texts of a bucket have to agree to be compared: texts at 0.8 agree in 64 on
#: average, with a standard deviation of 3.6.
SCREEN = 48
#: Members, and bytes of shingle sets, of a bucket that one task compares at once.
MEMBERS, MEMBER_BYTES = 1024, 32 << 20
_U = np.uint64
_A = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, np.uint64) << _U(1) | _U(1)
_B = np.random.default_rng(8).integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Hashes of the distinct word shingles, sorted; a text of fewer words is one shingle."""
    parts = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    return np.unique(np.fromiter(map(xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts)))


def bands(h: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key for each band, different from band to band, and a byte of each smallest hash."""
    least = np.full(len(_A), ~_U(0))
    for a in range(0, len(h), 1 << 12):
        np.minimum(least, (_A[:, None] * h[a : a + (1 << 12)] + _B[:, None]).min(axis=1), out=least)
    sketch = (least >> _U(20)).astype(np.uint8).tobytes()
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = mix(key ^ column)
    return key, sketch


def similar(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Which of ``sets`` and ``others`` (or ``sets`` again) are at LEAST or more: products of their incidence matrices."""
    both = sets if others is None else [*sets, *others]
    sizes = np.array([len(s) for s in both])
    _, column, counts = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), sizes)
    some = counts[column] > 1  # what only one set has is in no intersection
    number = np.cumsum(counts > 1) - 1
    row, column = row[some], number[column[some]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n = len(sets)
    shared = np.zeros((n, n if others is None else len(others)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        x, y = np.searchsorted(column, [a, a + 4096])
        part = np.zeros((len(both), 4096), np.float32)
        part[row[x:y], column[x:y] - a] = 1
        shared += part[:n] @ (part[:n] if others is None else part[n:]).T
    left, right = sizes[:n, None], sizes[None, :] if others is None else sizes[None, n:]
    return LEAST[1] * shared >= LEAST[0] * (left + right - shared)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        same, keys, sketches, fps = [], [], [], []
        for text in blobs(batch.column("text")):
            words = text.lower().split()
            same.append(xxh128_digest(b" ".join(words)))
            key, sketch = bands(shingles(words))
            keys.append(key.view(np.int64))
            sketches.append(sketch)
            fps.append(fingerprint(text))
        arrays = [batch.column(ROW), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, names=[ROW, "same", "keys", "sketch", "fp"])


def candidates(signed: DataFrame) -> DataFrame:
    """``node``, ``key``: texts (node, keys, fp) that may be near duplicates share a key.

    A group of SimHash fingerprints that covering tables link at 2 or fewer bits has a key, and so has each band (``keys``) for
    texts that differ in more bits.
    """
    linked = cut(components(links(signed.select("fp").distinct()))).select(F.col("node").alias("fp"), "component")
    alike = signed.join(linked, "fp", "left").select("node", F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("key"))
    return signed.select("node", F.explode("keys").alias("key")).unionByName(alike)


def _screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each bucket whose sketch agrees with another's in SCREEN bytes or more."""
    now, nodes, sketches = None, [], []

    def kept() -> pa.RecordBatch:
        x = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(nodes), -1)
        most = np.zeros(len(x), np.int64)
        for a in range(0, len(x), 64):
            agree = (x[a : a + 64, None, :] == x[None, :, :]).sum(axis=2)
            agree[np.arange(len(agree)), a + np.arange(len(agree))] = 0
            most[a : a + 64] = agree.max(axis=1)
        some = np.array(nodes, np.int64)[most >= SCREEN]
        nodes.clear()
        sketches.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), now, np.int64)), pa.array(some)], names=["key", "node"])

    for batch in batches:
        for key, node, sketch in zip(*(batch.column(k).to_pylist() for k in ("key", "node", "sketch")), strict=True):
            if key != now and nodes:
                yield kept()
            now = key
            nodes.append(node)
            sketches.append(sketch)
    if nodes:
        yield kept()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        packed = [shingles(t.lower().split()).tobytes() for t in blobs(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], names=["node", "packed"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group (a bucket, or two parts of a large one): enough to join what is similar, none that is joined."""
    now, held = None, []

    def links_of() -> pa.RecordBatch:
        out: list[tuple[int, int]] = []
        sides = sorted({side for _, _, side, _ in held})
        parts = [[m for m in held if m[2] == side] for side in sides]
        if len(parts) < 3 and len(held) > 1:
            xs, ys = parts[0], parts[-1]
            near = similar([m[3] for m in xs], None if len(parts) == 1 else [m[3] for m in ys])
            near &= np.array([m[1] for m in xs])[:, None] != np.array([m[1] for m in ys])[None, :]
            root: dict[int, int] = {}

            def top(x: int) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for i, j in zip(*(v.tolist() for v in np.nonzero(near)), strict=True):
                a, b = top(xs[i][1]), top(ys[j][1])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((xs[i][0], ys[j][0]))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    for batch in slices(batches, "packed"):  # a whole batch of sets, copied, would be several times a part
        columns = [batch.column(k).to_pylist() for k in ("key", "i", "j", "node", "component", "side", "packed")]
        for key, i, j, node, component, side, packed in zip(*columns, strict=True):
            if (key, i, j) != now and held:
                yield links_of()
            now = key, i, j
            held.append((node, component, side, np.frombuffer(packed, np.uint64)))
    if held:
        yield links_of()


def near_groups(docs: DataFrame) -> DataFrame:
    """ROW and ``component`` (the smallest ROW reachable) of each row of ``docs`` (``rowed()``, with ``text``).

    Texts link at LEAST or more of their WIDTH-word shingles, in any case and with any white space. Null and empty texts
    are copies of each other, and so are repeated rows; ids play no part. An empty table gives no rows. Candidates are in one
    group of SimHash fingerprints at 2 or fewer differing bits (``links``), or else share
    a band: with similarity s two texts do with chance 1 - (1 - s^ROWS)^BANDS, over 0.9999 at 0.8. Texts of a bucket whose
    smallest hashes agree often enough are compared on their shingle sets in the bucket's task, which sends on no more
    links than it has texts. Larger buckets are first linked through their smallest member; then only parts that hold
    different groups meet.
    """
    spark = docs.sparkSession
    found = staged(docs.select(ROW, "text").mapInArrow(_signed, f"{ROW} long, same binary, keys array<long>, sketch binary, fp long"), "signatures")
    distinct = cut(found.groupBy("same").agg(F.min(ROW).alias("node")))
    keyed = candidates(found.join(distinct.select(F.col("node").alias(ROW)), ROW, "left_semi").select(F.col(ROW).alias("node"), "keys", "fp"))
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    placed = staged(keyed.join(several, "key"), "buckets")
    nodes = staged(placed.select("node").distinct(), "nodes")
    # Whole texts needn't be shuffled for a look at which of them are in a bucket, as long as those are few enough to broadcast.
    nodes = F.broadcast(nodes) if 64 * nodes.count() <= BROADCAST_BYTES else nodes
    texts = docs.select(F.col(ROW).alias("node"), "text").join(nodes, "node", "left_semi")
    sets = staged(texts.mapInArrow(_sets, "node long, packed binary"), "sets")
    whole = placed.join(sets.select("node", F.length("packed").alias("bytes")), "node")
    sizes = whole.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("node").alias("hub"), F.bit_xor(F.xxhash64("node")).alias("mark"))
    # Copies share many bands: of buckets with the same texts (by a 64-bit mark) one stands for all.
    sizes = sizes.groupBy("n", "bytes", "hub", "mark").agg(F.min("key").alias("key"))
    parts = F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("bytes") / MEMBER_BYTES)).cast("int")
    sizes = staged(sizes.select("key", "hub", parts.alias("parts")), "sizes")
    n = partitions(spark)

    def compare(members: DataFrame) -> DataFrame:
        rows = members.join(sets, "node").repartition(4 * n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
        return rows.select("key", "i", "j", "node", "component", "side", "packed").mapInArrow(_compared, "a long, b long")

    node, zero = F.col("node"), F.lit(0)
    dealt = placed.select("key", "node").join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    sketches = found.select(F.col(ROW).alias("node"), "sketch").join(nodes, "node", "left_semi")
    screened = dealt.where("parts = 1").select("key", "node").join(sketches, "node").repartition(4 * n, "key").sortWithinPartitions("key")
    screened = screened.select("key", "node", "sketch").mapInArrow(_screened, "key long, node long")
    small = screened.select("key", "node", zero.alias("i"), zero.alias("j"), node.alias("component"), zero.alias("side"))
    large = dealt.where("parts > 1")
    # The hub comes to each part of its bucket as the other side.
    to_hub = large.where("node <> hub").select("key", "node", F.col("part").alias("i"), zero.alias("j"), node.alias("component"), zero.alias("side"))
    hubs = sizes.where("parts > 1").select("key", F.col("hub").alias("node"), F.explode(F.sequence(zero, F.col("parts") - 1)).alias("i"))
    hubs = hubs.select("key", "node", "i", zero.alias("j"), node.alias("component"), F.lit(1).alias("side"))
    links_ = staged(compare(small.unionByName(to_hub).unionByName(hubs)), "links")
    joined_ = cut(components(links_))
    if not large.isEmpty():
        own = large.join(joined_, "node", "left").select("key", "node", "hub", "parts", F.coalesce("component", "node").alias("component"))
        of_hub = own.where("node = hub").select("key", F.col("component").alias("main"))
        # Texts that are with the hub form their own parts: they needn't meet each other.
        own = own.join(of_hub, "key").withColumn("apart", (F.col("component") != F.col("main")).cast("int"))
        counts = own.groupBy("key").agg(F.sum("apart").alias("others"), F.count("*").alias("n"), F.max("parts").alias("parts")).where("others > 0")
        share = lambda k: F.ceil(F.col("parts") * k / F.col("n")).cast("int")
        counts = counts.select("key", share(F.col("others")).alias("p"), share(F.col("n") - F.col("others")).alias("q"))
        own = staged(own.drop("parts", "hub", "main").join(counts, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("apart") == 1, F.col("p")).otherwise(F.col("q"))).cast("int")), "parts")
        rest, main = own.where("apart = 1"), own.where("apart = 0")
        keep = ["key", "node", "i", "j", "component", "side"]
        # Parts of the rest meet each other (i <= j, the same part as one side) and each part of the hub's group (j < 0).
        first = rest.withColumn("i", F.col("part")).withColumn("j", F.explode(F.sequence(F.col("part"), F.col("p") - 1))).withColumn("side", zero).select(*keep)
        second = rest.where("part > 0").withColumn("j", F.col("part")).withColumn("i", F.explode(F.sequence(zero, F.col("part") - 1))).withColumn("side", F.lit(1)).select(*keep)
        with_main = rest.withColumn("i", F.col("part")).withColumn("j", F.explode(F.transform(F.sequence(F.lit(1), F.col("q")), lambda x: -x))).withColumn("side", zero).select(*keep)
        mains = main.withColumn("j", -1 - F.col("part")).withColumn("i", F.explode(F.sequence(zero, F.col("p") - 1))).withColumn("side", F.lit(1)).select(*keep)
        more = compare(first.unionByName(second).unionByName(with_main).unionByName(mains))
        joined_ = cut(components(links_.unionByName(staged(more, "links"))))
    of = distinct.join(joined_, "node", "left").select("same", F.coalesce("component", "node").alias("component"))
    return found.select(ROW, "same").join(of, "same").select(ROW, "component")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
