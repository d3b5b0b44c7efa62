"""Which functions of an executable's sources are embedded: all, those of files that nodes name, or representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.vectors import top_fraction


def broken(tokens: Column) -> Column:
    """Three tokens or fewer, one of them an error."""
    return F.coalesce((F.size(tokens) <= 3) & F.array_contains(tokens, "<ERROR>"), F.lit(False))


def _usable(functions: DataFrame, skip: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Functions with a body in files that aren't skipped, and ``path`` of the files that are."""
    paths = functions.select("path").distinct()
    if skip is None:
        return functions.where("fhash <> ''"), paths.where("false")
    gone = skip.select("path").distinct()
    return functions.join(gone, "path", "left_anti").where("fhash <> ''"), paths.join(gone, "path", "left_semi")


def all_functions(functions: DataFrame, skip: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Functions (path, line, fhash, tokens, ...) to embed, those that don't parse, and the skipped files (path).

    Functions without a body are in neither; what is in a skipped file (``skip``: path) isn't looked at.
    """
    rows, skipped = _usable(functions, skip)
    return rows.where(~broken(F.col("tokens"))), rows.where(broken(F.col("tokens"))), skipped


def representative_functions(functions: DataFrame, ratio: float, skip: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``all_functions``, but of each file only the ceil(n ratio) that are the easiest to maintain (mi, then line)."""
    rows, errors, skipped = all_functions(functions, skip)
    return top_fraction(rows, "mi", "line", ratio, ["path"], at_least_one_more=False), errors, skipped


def functions_of_nodes(nodes: DataFrame, names: DataFrame, debug: DataFrame, functions: DataFrame, skip: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Functions to embed for ``nodes`` (node), the nodes that have none (node), and the skipped files (path).

    A node with a name (``names``: node) stands for the whole file that its debug line (``debug``: node, path) is in.
    Nodes without a line, or in a file of which no function (path, line, fhash, ...) is known, are left over; nodes
    without a name and nodes in skipped files are in no result.
    """
    known = nodes.select("node").distinct().join(names.select("node").distinct(), "node", "left_semi")
    at = known.join(debug.where("path IS NOT NULL").groupBy("node").agg(F.min("path").alias("path")), "node", "left")
    gone = nodes.select(F.lit(None).cast("string").alias("path")).where("false") if skip is None else skip.select("path").distinct()
    skipped = at.join(gone, "path", "left_semi").select("path").distinct()
    at = at.join(gone, "path", "left_anti")
    left = at.join(functions.select("path").distinct(), "path", "left_anti").select("node")
    chosen = functions.join(at.select("path").distinct(), "path", "left_semi").where("fhash <> ''")
    return chosen, left, skipped
