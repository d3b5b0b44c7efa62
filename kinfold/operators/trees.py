"""Hashes of all functions of a source tree: from files and the lines of their functions to places by digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.digest import canonical, digest
from kinfold.functions.text import body_of, is_source_path, normalise_body, strip_comments


def function_texts(files: DataFrame, functions: DataFrame) -> DataFrame:
    """``functions`` (tag, path, line_start, line_end, ...) with their ``text``, cut out of ``files`` (tag, path, text).

    Lines count from 1; lines beyond the file's end are not there. Functions of unknown files are left out.
    """
    lines = files.where("text IS NOT NULL").select("tag", "path", F.split("text", "\n").alias("_lines"))
    count = F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0))
    own = F.when(F.col("line_start") >= 1, F.array_join(F.slice("_lines", F.greatest("line_start", F.lit(1)), count), "\n"))
    return functions.join(lines, ["tag", "path"]).select(*functions.columns, own.alias("text"))


def tree_hashes(files: DataFrame, functions: DataFrame, hasher: Callable[[Column], Column] = digest) -> DataFrame:
    """``functions`` of source files with ``fhash``: the canonical digest of the body between the outer braces, without
    comments, braces and white space, in lower case. Functions without a digest are left out, as are files that aren't source.
    """
    texts = function_texts(files.where(is_source_path(F.col("path"))), functions)
    body = normalise_body(strip_comments(body_of(F.col("text"))))
    return texts.select(*functions.columns, canonical(hasher(body)).alias("fhash")).where("fhash <> ''")


def places(hashed: DataFrame) -> DataFrame:
    """``fhash``, ``n_places``, ``n_tags``, ``first_tag`` and ``first_path`` of each digest over all trees."""
    first = F.min(F.struct("tag", "path", "line_start")).alias("first")
    found = hashed.groupBy("fhash").agg(F.count("*").alias("n_places"), F.countDistinct("tag").alias("n_tags"), first)
    return found.select("fhash", "n_places", "n_tags", F.col("first.tag").alias("first_tag"), F.col("first.path").alias("first_path"))


def tree_counters(files: DataFrame, hashed: DataFrame) -> DataFrame:
    """``tag``, ``files``, ``functions`` and ``lines`` of each tree: source files, hashed functions, lines of the files."""
    own = files.where(is_source_path(F.col("path"))).groupBy("tag").agg(F.count("*").alias("files"), F.sum(F.size(F.split("text", "\n"))).alias("lines"))
    return own.join(hashed.groupBy("tag").agg(F.count("*").alias("functions")), "tag", "left").select("tag", "files", F.coalesce("functions", F.lit(0)).alias("functions"), "lines")


def parsed(rows: DataFrame, text: str, tokens: str) -> DataFrame:
    """Rows whose ``text`` isn't empty and whose ``tokens`` aren't three or fewer with an error among them."""
    broken = (F.size(tokens) <= 3) & F.array_contains(tokens, "<ERROR>")
    return rows.where((F.col(text) != "") & ~F.coalesce(broken, F.lit(False)))
