"""What exact-repeat operators share: find anchors that occur twice, go back to their texts, and cut ranges out.

Arrays travel packed, one row of a shuffle for each bucket and buffer, so the JVM handles few rows. Texts are named by
ROW, 256 rows in a row make a block. Anchor hashes are filters only: what is removed is decided by the operator itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import ROW, blobs, release, slices, spans, staged

BLOCK_BITS = 8
#: Anchors that a task gathers before it sends them on; sorting them takes about a hundred bytes each.
BUFFER = 1 << 18
#: Removed ranges are broadcast up to so many bytes; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
_LOCAL = (1 << BLOCK_BITS) - 1
_U = np.uint64


#: Bytes of texts in a block's record, beyond which it is cut; bytes of input for each partition of a shuffle, at most.
BLOCK_BYTES, PARTITION_BYTES = 8 << 20, 32 << 20


def partitions(spark: SparkSession, docs: DataFrame | None = None) -> int:
    """Shuffle partitions: as the session says, or more where the table's files are large."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = 0 if docs is None else int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Spark takes a table of unknown size for the largest there is.
    return max(n, size // PARTITION_BYTES) if size < 1 << 60 else n


def _by_block(rows: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Values of each block of rows."""
    blk = rows >> BLOCK_BITS
    order = np.argsort(blk, kind="stable")
    blk, values = blk[order], values[order]
    cuts = np.flatnonzero(np.concatenate([[True], blk[1:] != blk[:-1]])) if len(blk) else np.empty(0, np.int64)
    for a, b in spans(cuts, len(blk)):
        yield int(blk[a]), values[a:b]


class _Rows:
    """Gathers (key, base, packed array) rows."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.bases: list[int] = []
        self.packed: list[bytes] = []

    def add(self, key: int, base: int, values: np.ndarray) -> None:
        self.keys.append(key)
        self.bases.append(base)
        self.packed.append(values.tobytes())

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(self.keys, pa.int64()), pa.array(self.bases, pa.int64()), pa.array(self.packed, pa.binary())], names=["bucket", "base", "packed"])
        self.__init__()
        return out


def repeated_anchors(docs: DataFrame, anchors: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], within: bool, text_col: str = "text") -> DataFrame:
    """``blk`` and ``flags``: packed (47 bits of hash, row in block) of anchors that occur again elsewhere.

    ``anchors`` gives hashes (uint64) and text numbers for a list of texts. ``within``: a second occurrence in the same
    text counts. A hash that a task's buffer meets twice is known to be repeated there; one row of it is sent on, so a
    frequent anchor costs a row for each buffer and not one for each occurrence.
    """
    n = partitions(docs.sparkSession, docs)
    buckets = 4 * n

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count, base, rows = 0, None, _Rows()

        def flush() -> pa.RecordBatch:
            h = np.concatenate([x for x, _ in held])
            row = np.concatenate([x for _, x in held])
            key = (h >> _U(17)) << _U(17) | (row - base).astype(np.uint64)
            key.sort()
            same = np.concatenate([[False], key[1:] == key[:-1]])
            twice = np.unique(key[same]) >> _U(17) if within else np.empty(0, np.uint64)
            key = key[~same]
            tops = key >> _U(17)
            first = np.concatenate([[True], tops[1:] != tops[:-1]])
            starts = np.flatnonzero(first)
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            known_group = sizes > 1
            if len(twice):
                known_group |= np.isin(tops[starts], twice)
            known = np.repeat(known_group, sizes)
            out = key[starts] | (known_group.astype(np.uint64) << _U(16))
            bucket = ((out >> _U(17)) * _U(buckets) >> _U(47)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            for a, b in spans(cuts, len(bucket)):
                rows.add(int(bucket[a]), base, out[a:b])
            if known.any():
                found = key[known]
                at = base + (found & _U(0xFFFF)).astype(np.int64)
                for blk, values in _by_block(at, (found >> _U(17)) << _U(BLOCK_BITS) | (at & _LOCAL).astype(np.uint64)):
                    rows.add(-1 - blk, blk, values)
            held.clear()
            return rows.batch()

        for batch in slices(batches, text_col):
            ids = batch.column(ROW).to_numpy(zero_copy_only=False).astype(np.int64)
            if held and (count > BUFFER or ids[-1] - base > 0xFFFF or ids[0] < base):
                yield flush()
                count = 0
            if not held:
                base = int(ids[0])
            h, at = anchors(blobs(batch.column(text_col)))
            if len(h):
                held.append((h, ids[at]))
                count += len(h)
        if held:
            yield flush()
        release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def answers() -> pa.RecordBatch:
            keys, packed = [], []
            if found:
                for blk, values in _by_block(np.concatenate([r for r, _ in found]), np.concatenate([v for _, v in found])):
                    keys.append(blk)
                    packed.append(values.tobytes())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], names=["blk", "flags"])

        for bucket, bases, packed in buckets_of(batches):
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([pa.array(bases, pa.int64()), pa.array(packed, pa.binary())], names=["blk", "flags"])
                continue
            key = np.frombuffer(b"".join(packed), np.uint64)
            base = np.repeat(np.array(bases, np.int64), [len(p) // 8 for p in packed])
            order = np.argsort(key, kind="stable")
            key, base = key[order], base[order]
            top = key >> _U(17)
            same = top[1:] == top[:-1]
            again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            asks = again & ((key >> _U(16)) & _U(1) == 0)
            if asks.any():
                row = base[asks] + (key[asks] & _U(0xFFFF)).astype(np.int64)
                found.append((row, top[asks] << _U(BLOCK_BITS) | (row & _LOCAL).astype(np.uint64)))
                count += len(row)
                if count > 4 * BUFFER:
                    yield answers()
                    count = 0
        yield answers()
        release()

    dealt = docs.select(ROW, text_col).mapInArrow(deal, "bucket long, base long, packed binary")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "blk long, flags binary")


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """The rows of each bucket of a partition that is sorted by bucket."""
    now, bases, packed = None, [], []
    for batch in batches:
        for bucket, base, x in zip(batch.column("bucket").to_pylist(), batch.column("base").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if bucket != now and packed:
                yield now, bases, packed
                bases, packed = [], []
            now = bucket
            bases.append(base)
            packed.append(x)
    if packed:
        yield now, bases, packed
    release()


def blocks(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``blk``, ``offset``, ``ids`` (longs; a null id is the largest long), ``sizes`` and ``z`` (the texts, compressed) of
    each block; a block with long texts is several records, which begin at different offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        first, ids, texts, held = 0, [], [], 0

        def block() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            columns = [pa.array([first >> BLOCK_BITS], pa.int64()), pa.array([first & _LOCAL], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary()), pa.array([squeeze(b"".join(texts))], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["blk", "offset", "ids", "sizes", "z"])

        for batch in slices(batches, text_col):
            for row, key, text in zip(batch.column(ROW).to_pylist(), batch.column(id_col).to_pylist(), blobs(batch.column(text_col)), strict=True):
                if texts and (row >> BLOCK_BITS != first >> BLOCK_BITS or row != first + len(texts) or held + len(text) > BLOCK_BYTES):
                    yield block()
                    ids, texts, held = [], [], 0
                first = first if texts else row
                ids.append((1 << 63) - 1 if key is None else key)
                texts.append(text)
                held += len(text)
        if texts:
            yield block()

    return docs.select(ROW, F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, "blk long, offset int, ids binary, sizes binary, z binary")


class Block:
    """One record of ``blocks`` with the ``flags`` of its block. ``first`` is the row of its first text."""

    def __init__(self, blk: int, offset: int, ids: bytes, sizes: bytes, z: bytes, flags: list[bytes]):
        self.first = (blk << BLOCK_BITS) + offset
        self.ids = np.frombuffer(ids, np.int64)
        sizes = np.frombuffer(sizes, np.int64)
        whole = zstandard.ZstdDecompressor().decompress(z)
        ends = np.cumsum(sizes)
        packed = np.frombuffer(b"".join(flags), np.uint64)
        local = (packed & _U(_LOCAL)).astype(np.int64) - offset
        own = (local >= 0) & (local < len(sizes))
        local, packed = local[own], packed[own]
        order = np.argsort(local, kind="stable")
        local, tops = local[order], packed[order] >> _U(BLOCK_BITS)
        cuts = np.flatnonzero(np.concatenate([[True], local[1:] != local[:-1]])) if len(local) else []
        #: (number in the record, text, sorted 47-bit hashes of its repeated anchors)
        self.flagged = []
        for a, b in spans(cuts, len(local)):
            i = int(local[a])
            self.flagged.append((i, whole[ends[i] - sizes[i] : ends[i]], np.unique(tops[a:b])))


def flagged_blocks(docs: DataFrame, flags: DataFrame, id_col: str, text_col: str, run: Callable[[Iterator[Block]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies ``run`` to the blocks that have repeated anchors."""
    together = blocks(docs, id_col, text_col).join(flags.groupBy("blk").agg(F.collect_list("flags").alias("flags")), "blk")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[Block]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield Block(*(batch.column(k)[i].as_py() for k in ("blk", "offset", "ids", "sizes", "z", "flags")))

        return run(found())

    return together.mapInArrow(each, schema)


#: A range of a row of a block. Ranges travel by block, so there are no more rows of them than blocks in each bucket's task.
RANGE = np.dtype([("row", "u1"), ("start", "<u4"), ("end", "<u4")])
RANGES_SCHEMA = "blk long, ranges binary"


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of each row as one."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    # Ends rise within a row after this; a row's offset keeps rows apart.
    span = int(end.max()) + 2
    _, dense = np.unique(row, return_inverse=True)
    offset = dense * span
    reach = np.maximum.accumulate(end + offset)
    fresh = np.concatenate([[True], (start + offset)[1:] > reach[:-1]])
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(row)]]) - 1
    return row[first], start[first], (reach[last] - offset[last])


def range_rows(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Ranges, merged, as one record for each block."""
    row, start, end = merged(row, start, end)
    packed = np.empty(len(row), RANGE)
    packed["row"], packed["start"], packed["end"] = row & _LOCAL, start, end
    found = [(blk, values.tobytes()) for blk, values in _by_block(row, packed)]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["blk", "ranges"])


def with_ranges(docs: DataFrame, ranges: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_ranges``: packed (start, end) pairs of each row, merged, null where nothing is removed.

    Only the merged ranges travel: to every task where all of them together are small, else by a shuffle on the row.
    """

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blk, parts in zip(batch.column("blk").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                x = np.frombuffer(b"".join(parts), RANGE)
                row, start, end = merged((blk << BLOCK_BITS) + x["row"].astype(np.int64), x["start"].astype(np.int64), x["end"].astype(np.int64))
                pairs = np.stack([start, end], axis=1).astype("<u4")
                cuts = spans(np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])), len(row)) if len(row) else []
                yield pa.RecordBatch.from_arrays([pa.array([int(row[a]) for a, _ in cuts], pa.int64()), pa.array([pairs[a:b].tobytes() for a, b in cuts], pa.binary())], names=["row", "ranges"])

    whole = staged(ranges.groupBy("blk").agg(F.collect_list("ranges").alias("ranges")).mapInArrow(unite, "row long, ranges binary"), "ranges")
    size = whole.agg(F.sum(F.octet_length("ranges") + 64)).first()[0] or 0
    whole = whole.select(F.col("row").alias(ROW), F.col("ranges").alias("_ranges"))
    if size <= BROADCAST_BYTES:
        return docs.join(F.broadcast(whole), ROW, "left")
    return unsqueezed(squeezed(docs, text_col).join(whole, ROW, "left"), text_col)


def squeezed(docs: DataFrame, text_col: str) -> DataFrame:
    """The texts compressed, for a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, text_col):
            found = [None if x is None else squeeze(x) for x in batch.column(text_col).cast(pa.binary()).to_pylist()]
            yield batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(found, pa.binary()))

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {'binary' if f.name == text_col else f.dataType.simpleString()}" for f in docs.schema))


def unsqueezed(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, text_col, 1 << 20):
            found = [None if x is None else expand(x).decode() for x in batch.column(text_col).to_pylist()]
            yield batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(found, pa.string()))

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in docs.schema))
