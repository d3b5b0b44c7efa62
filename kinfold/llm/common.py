"""What the operators of this subpackage share: folds, shared-folder stages, Arrow batches and packed arrays."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "_kin_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; without one that the session names, only a local master gets its own."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="kinfold-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` now and cuts its lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kinfold-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rowed(docs: DataFrame) -> DataFrame:
    """Adds ROW, which names each row (also rows with equal or null ids).

    The number follows the splits of the scan, so it is the same each time only where rows come from files without
    a shuffle; any other input is written to the shared folder first. Splits also follow the number of cores that Spark
    counts just now, unless spark.sql.files.minPartitionNum is set: it is set here, so a lost executor changes nothing.
    """
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "Scan ExistingRDD" in plan or "Arrow" in plan or "Python" in plan or "FileScan" not in plan:
        docs = staged(docs, "rows")
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row of a string column; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """Each row of a string column; a null is empty."""
    return [x or "" for x in column.to_pylist()]


def release() -> None:
    """Gives memory that a worker no longer uses back to the system: idle workers stay alive beside those at work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text at most; a longer text comes alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, total = 0, 0
        for i in range(n):
            if i > start and total + sizes[i] > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(sizes[i])
        yield batch.slice(start, n - start)
    release()


def joined(texts: list[bytes], gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array with ``gap`` zero bytes after each, and where each text starts; one start more at the end."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + gap
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    sep = b"\0" * gap
    return np.frombuffer(sep.join(texts) + sep if texts else b"", np.uint8), starts


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, in place on uint64."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def spans(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(start, end) of each run, from where runs start in ``n`` values; none where there are no values."""
    starts = np.asarray(starts).tolist()
    return list(zip(starts, [*starts[1:], n], strict=True)) if starts and n else []
