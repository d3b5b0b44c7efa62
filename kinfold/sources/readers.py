"""Readers of what the tools around a repository print, as DataFrames over text lines; tables and sinks.

Text sources give one row for each line with ``path`` and ``line_no``; the parsers below take such rows, so any reader
of lines (files, tables, streams) works.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.operators.graph import cut, shared_dir
from kinfold.operators.numbering import numbered

CTAGS_SCHEMA = T.StructType([T.StructField(k, T.StringType()) for k in ("name", "kind", "scope", "pattern", "path")] + [T.StructField(k, T.IntegerType()) for k in ("line", "end")])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@contextmanager
def cached_table(spark: SparkSession, path: str) -> Iterator[DataFrame]:
    """A table that is read once for all that is asked of it inside the block, and released after it."""
    df = read_table(spark, path).persist()
    try:
        yield df
    finally:
        df.unpersist()


def write_table(df: DataFrame, path: str, mode: str = "overwrite", by: tuple[str, ...] = ()) -> None:
    """Writes Parquet; ``append`` adds a batch, ``ignore`` keeps what is there (a run that is repeated does nothing)."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table at ``path`` was written to its end: Spark leaves its mark last."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``, built first where it isn't there or a writer left it half-written."""
    if not finished(spark, path):
        write_table(build(), path)
    return spark.read.parquet(path)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/kinfold-{what}-{uuid.uuid4().hex}"


def concatenated(spark: SparkSession, sources: list[tuple[str, dict[str, Column]]]) -> DataFrame:
    """The rows of several tables as one: a path and the columns to take from it, for each."""
    return reduce(DataFrame.unionByName, (spark.read.parquet(path).select(*(c.alias(k) for k, c in columns.items())) for path, columns in sources))


def write_matrix(vectors: DataFrame, path: str) -> None:
    """Vectors (fid, vec of floats) as matrix records, one for each Arrow batch: ids, shape and the rows in one block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vec")
            sizes = np.diff(lists.offsets.to_numpy())
            rows, ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<f4"), batch.column("fid").to_numpy(zero_copy_only=False).astype("<i8")
            for dim in np.unique(sizes):
                own = np.repeat(sizes == dim, sizes)
                yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([ids[sizes == dim].tobytes()], pa.binary()), pa.array([rows[own].tobytes()], pa.binary())], names=["dim", "fids", "block"])

    vectors.where("vec IS NOT NULL").select("fid", "vec").mapInArrow(pack, "dim int, fids binary, block binary").write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``fid`` and ``vec`` of what ``write_matrix`` wrote."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, fids, block in zip(*(batch.column(k).to_pylist() for k in ("dim", "fids", "block")), strict=True):
                ids, rows = np.frombuffer(fids, "<i8"), np.frombuffer(block, "<f4")
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * dim, pa.int32()), pa.array(rows))], names=["fid", "vec"])

    return spark.read.schema("dim int, fids binary, block binary").parquet(path).mapInArrow(unpack, "fid long, vec array<float>")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_json(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Writes JSON, with ``by`` a folder for each of its values. Rows are dealt by it first: a folder gets a file or, if it is
    large, a few, not one from each task."""
    if by:
        df = df.hint("rebalance", *by)
    df.write.mode("overwrite").partitionBy(*by).json(path)


def unique_key(df: DataFrame, key: str) -> DataFrame:
    """The same rows; a key that occurs twice fails the query."""
    n = F.count("*").over(Window.partitionBy(key))
    checked = df.withColumn("_n", n)
    return checked.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("key occurs twice: "), F.col(key).cast("string"))).cast("int")).otherwise(F.lit(1))).where("_ok = 1").drop("_n", "_ok")


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """All rows with one of the keys, however many keys there are."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def chunked(df: DataFrame, order: str, size: int = 100) -> DataFrame:
    """``chunk``: the number of the group of ``size`` rows in a row, in the order of a column."""
    return numbered(df, order, name="_n").withColumn("chunk", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``line_no``, ``block``, ``value`` of each line of the files, from 1; large files are read in many tasks.

    A task reads ranges of bytes and numbers the lines that begin in each (``block``); what stands before a range follows
    from the number of lines in the ranges before it, one row each. Lines are written to the shared folder once, so that
    ranges stay the same for both. An end of line at a file's end begins no line.
    """
    each = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    each = cut(each)
    ranges = each.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return each.join(ranges, ["path", "block"]).select("path", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line_no"), "block", "value")


#: Lines of a block where a source of lines names none.
BLOCK_LINES = 1 << 16


def last_before(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """``lines`` (path, line_no, ...) with ``name``: the last value that isn't null at or before the line, in its file.

    A window runs inside a block of lines; what goes on from block to block is one row for each of them, so no task sees
    a whole file.
    """
    block = F.col("block") if "block" in lines.columns else F.floor(F.col("line_no") / BLOCK_LINES)
    rows = lines.withColumns({"_block": block, "_value": value})
    inside = Window.partitionBy("path", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy("path", "_block").agg(F.max(F.when(F.col("_value").isNotNull(), F.struct("line_no", "_value"))).alias("_end"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("path", "_block", F.last("_end._value", ignorenulls=True).over(before).alias("_carried"))
    own = F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_carried"))
    return rows.join(carried, ["path", "_block"]).withColumn(name, own).select(*lines.columns, name)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below ``path``, the largest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length").orderBy(F.desc("length"), "path")


def until_first_bad(lines: DataFrame, good: Column) -> DataFrame:
    """The lines of each file before its first bad one."""
    bad = lines.where(~F.coalesce(good, F.lit(False))).groupBy("path").agg(F.min("line_no").alias("_bad"))
    return lines.join(bad, "path", "left").where(F.col("_bad").isNull() | (F.col("line_no") < F.col("_bad"))).select(*lines.columns)


def ctags_records(lines: DataFrame) -> DataFrame:
    """Symbol records of JSON lines; a file ends at its first line that is no JSON object."""
    parsed = lines.withColumn("tag", F.from_json("value", CTAGS_SCHEMA))
    good = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")
    return until_first_bad(parsed, good).select(F.col("path").alias("file"), "line_no", "tag.*")


def first_language(c: DataFrame, cpp: DataFrame) -> DataFrame:
    """Records of the C parser's lines, and of the C++ parser's for files in which C found none; ``language`` says which."""
    first = ctags_records(c).select(F.lit("C").alias("language"), "*")
    second = ctags_records(cpp).select(F.lit("C++").alias("language"), "*")
    return first.unionByName(second.join(first.select("file").distinct(), "file", "left_anti"))


def commits(lines: DataFrame) -> DataFrame:
    """``hash date subject`` lines of a log."""
    cut = F.regexp_extract("value", r"^([0-9a-f]{7,40}) (\d{4}-\d\d-\d\d \d\d:\d\d:\d\d [+-]\d{4}) ?(.*)$", 1)
    return lines.select("path", "line_no", cut.alias("commit"), F.regexp_extract("value", r"^[0-9a-f]{7,40} (\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) ", 1).alias("date"), F.regexp_extract("value", r"^\S+ \S+ \S+ \S+ ?(.*)$", 1).alias("subject")).where("commit <> ''")


def changes(lines: DataFrame) -> DataFrame:
    """Status letter and path of each line of a name-status diff; a rename deletes one path and adds another."""
    parts = F.split("value", "\t")
    status = F.substring(parts[0], 1, 1)
    one = lines.where(F.size(parts) >= 2).select("path", "line_no", F.explode(F.when(status == "R", F.array(F.struct(F.lit("D").alias("status"), parts[1].alias("file")), F.struct(F.lit("A").alias("status"), F.get(parts, F.lit(2)).alias("file")))).otherwise(F.array(F.struct(status.alias("status"), parts[1].alias("file"))))).alias("c"))
    return one.select("path", "line_no", "c.status", F.regexp_replace("c.file", r"^\./", "").alias("file"))


def tag_dates(lines: DataFrame, skip_same_date: bool = False) -> DataFrame:
    """Tags and their dates of ``date  (tag: X, tag: Y)`` lines; optionally the first tag of each date only."""
    date = F.rtrim(F.substring("value", 1, 20))
    tags = F.expr(r"regexp_extract_all(value, 'tag: ([^,)]+)', 1)")
    rows = lines.select("path", "line_no", date.alias("date"), F.posexplode(tags).alias("at", "tag"))
    if skip_same_date:
        first = F.row_number().over(Window.partitionBy("path", "date").orderBy("line_no", "at"))
        rows = rows.withColumn("_n", first).where("_n = 1").drop("_n")
    return rows.drop("at")


def submodules(lines: DataFrame) -> DataFrame:
    """Name, path and address of each section of a submodule file."""
    name = F.expr(r"nullif(regexp_extract(value, '^\\s*\\[submodule \"(.*)\"\\]', 1), '')")
    rows = last_before(lines, name, "module")
    rows = rows.withColumn("field", F.regexp_extract("value", r"^\s*(path|url)\s*=\s*(.*?)\s*$", 1)).withColumn("content", F.regexp_extract("value", r"^\s*(path|url)\s*=\s*(.*?)\s*$", 2)).where("field <> '' AND module IS NOT NULL")
    return rows.groupBy(F.col("path").alias("file"), "module").agg(F.max(F.when(F.col("field") == "path", F.col("content"))).alias("path"), F.max(F.when(F.col("field") == "url", F.col("content"))).alias("url"))


def cross_references(lines: DataFrame) -> DataFrame:
    """``file symbol line text`` of each line that has at least three parts: references, definitions, callers, includes."""
    parts = F.split("value", " ", 4)
    return lines.where((F.size(parts) >= 3) & parts[2].rlike("^[0-9]+$")).select(parts[0].alias("file"), parts[1].alias("symbol"), parts[2].cast("int").alias("line"), F.coalesce(F.get(parts, F.lit(3)), F.lit("")).alias("text"))


def debug_lines(lines: DataFrame) -> DataFrame:
    """File and line of each address; a line that goes on is joined to the one before it."""
    grouped = last_before(lines, F.when(F.col("value").rlike(r"^(Line|No line|Address)"), F.col("line_no")), "g")
    whole = grouped.groupBy("path", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), " ").alias("text"))
    return whole.select(F.regexp_extract("text", r"0x([0-9a-fA-F]+)", 1).alias("hex"), F.regexp_extract("text", 'Line ([0-9]+) of "([^"]*)"', 2).alias("file"), F.regexp_extract("text", 'Line ([0-9]+) of "', 1).cast("int").alias("line")).where("file <> ''").select(F.conv("hex", 16, 10).cast("long").alias("ea"), "file", "line")


def debug_sources(lines: DataFrame) -> DataFrame:
    """Source files named in comma-separated lists."""
    return lines.select(F.explode(F.split("value", r",\s*")).alias("file")).select(F.trim("file").alias("file")).where(F.col("file").startswith("/")).distinct()


def dumped_symbols(lines: DataFrame) -> DataFrame:
    """Address and name of each ``address <name>:`` line; names of the linkage table lose their mark and are external."""
    hexa, name = F.regexp_extract("value", r"^([0-9a-fA-F]+) <(.+)>:", 1), F.regexp_extract("value", r"^([0-9a-fA-F]+) <(.+)>:", 2)
    return lines.where(hexa != "").select(F.conv(hexa, 16, 10).cast("long").alias("ea"), F.regexp_replace(name, "@plt$", "").alias("name"), name.endswith("@plt").alias("external"))


def address_of_path(path: Column) -> Column:
    """The number that a file's base name (hexadecimal, before the dot) stands for."""
    return F.conv(F.regexp_extract(path, r"([^/.]+)[^/]*$", 1), 16, 10).cast("long")


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both listings with equal keys; a key that only one has fails the query."""
    both = a.join(b, key, "full_outer")
    missing = F.col(a.columns[-1]).isNull() | F.col(b.columns[-1]).isNull()
    return both.where(F.when(missing, F.raise_error(F.concat(F.lit("no pair for "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True)))
