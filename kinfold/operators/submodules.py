"""Which repositories a set of repositories needs: the closure over the submodule sections of those that are at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.graph import cut, reach_any
from kinfold.sources.readers import submodules


def address(url: Column) -> Column:
    """An address in one form: no white space around it, no slashes and no ``.git`` at its end."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), r"(\.git)?/*$", "")


def resolved(url: Column, base: Column) -> Column:
    """The address that ``url`` means in the repository at ``base``: ``./`` stays there and each ``../`` goes up by one part.

    What goes up beyond the host has no address (null).
    """
    up = F.length(F.regexp_extract(url, r"^((?:\.\./|\./)*)", 1)) - F.length(F.replace(F.regexp_extract(url, r"^((?:\.\./|\./)*)", 1), F.lit(".."), F.lit(".")))
    rest = F.regexp_replace(url, r"^(?:\.\./|\./)*", "")
    parts = F.split(address(base), "/")
    left = F.size(parts) - up
    above = F.array_join(F.slice(parts, 1, F.greatest(left, F.lit(0))), "/")
    return F.when(~url.rlike(r"^\.\.?/"), address(url)).when(left >= 3, address(F.concat(above, F.lit("/"), rest)))


def submodule_links(lines: DataFrame) -> DataFrame:
    """``repo``, ``module``, ``path``, ``target`` of submodule files, given as lines whose ``path`` is the repository's address."""
    found = submodules(lines)
    return found.select(address(F.col("file")).alias("repo"), "module", "path", resolved(F.col("url"), F.col("file")).alias("target"))


def needed(links: DataFrame, known: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``repo`` and whether it is ``known`` of all repositories that ``start`` (repo) needs, itself included; and the links of
    these (repo, module, path, target) that stay open: without an address, or to a repository that isn't ``known`` (repo).

    Sections of a known repository lead on, in rounds until nothing new is reached; cycles end.
    """
    links = cut(links)
    nodes = start.select(address(F.col("repo")).alias("node")).distinct()
    edges = links.where("target IS NOT NULL").select(F.col("repo").alias("src"), F.col("target").alias("dst")).distinct()
    reached = cut(reach_any(edges, nodes).select(F.col("node").alias("repo")))
    there = known.select(address(F.col("repo")).alias("repo")).distinct().withColumn("known", F.lit(True))
    own = reached.join(there, "repo", "left").select("repo", F.coalesce("known", F.lit(False)).alias("known"))
    open_links = links.join(reached, "repo", "left_semi").join(there.select(F.col("repo").alias("target")), "target", "left_anti")
    return own, open_links.select("repo", "module", "path", "target")
