"""Executables as tables: nodes of call graphs, what is known about their functions, their names and strings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text as X
from kinfold.functions.demangle import demangled
from kinfold.operators.matching import node_info

#: Strings of so many bytes or fewer say nothing.
SHORT = 3


def _of(exe: str, *fields: Column) -> Column:
    """A key within an executable; null where a part of it is, so that it meets nothing."""
    known = F.col(exe).isNotNull()
    for f in fields:
        known = known & f.isNotNull()
    return F.when(known, F.struct(F.col(exe).alias("exe"), *(f.alias(f"k{i}") for i, f in enumerate(fields))))


@dataclass
class Executables:
    """Any number of executables side by side.

    ``nodes``: exe, node, ea, label; ``edges``: exe, src, dst; ``functions``: exe, ea, fname, fid, strings (an array).
    Rows with a null ``exe`` or ``node`` are left out, repeated ones count once. Empty tables give empty results.
    """

    nodes: DataFrame
    edges: DataFrame
    functions: DataFrame

    def __post_init__(self):
        self.nodes = self.nodes.select("exe", "node", "ea", "label").dropna(subset=["exe", "node"]).distinct()
        self.edges = self.edges.select("exe", "src", "dst").dropna().distinct()

    def incompatible(self) -> DataFrame:
        """Nodes whose address no function has, but whose label one has: graph and functions are of different builds."""
        known = self.functions.select("exe", "ea").distinct()
        named = self.functions.select("exe", F.col("fname").alias("label")).distinct()
        return self.nodes.join(known, ["exe", "ea"], "left_anti").join(named, ["exe", "label"], "left_semi").select("exe", "node", "ea", "label")

    def checked(self) -> Executables:
        """The same; fails where a graph and its functions don't belong together."""
        found = self.incompatible().take(3)
        if found:
            raise ValueError(f"the call graph has functions at other addresses than the function table: {found}")
        return self

    def node_functions(self) -> DataFrame:
        """``exe``, ``node``, ``fid``, ``step``: the function of each node by address and label, by label, or by address."""
        label = F.col("label")
        nodes = self.nodes.select(F.struct("exe", "node").alias("node"), _of("exe", F.col("ea")).alias("ea"), _of("exe", label).alias("label"))
        infos = self.functions.select(_of("exe", F.col("ea")).alias("ea"), _of("exe", F.col("fname")).alias("label"), F.col("fid").alias("info"))
        return node_info(nodes, infos).select("node.exe", "node.node", F.col("info").alias("fid"), "step")

    def labelled(self) -> DataFrame:
        """``exe``, ``label``, ``node`` without generated symbols and those of compiler and C library."""
        return self.nodes.where(F.col("label").isNotNull() & ~X.is_skipped_symbol(F.col("label"))).select("exe", "label", "node")

    def strings(self) -> DataFrame:
        """``exe``, ``s``, ``node``: the strings of each node's function, but for those of SHORT bytes or fewer."""
        own = self.functions.select("exe", "fid", F.explode(F.array_distinct("strings")).alias("s")).where(F.octet_length("s") > SHORT).distinct()
        return self.node_functions().join(own, ["exe", "fid"]).select("exe", "s", "node")

    def features(self) -> DataFrame:
        """``exe``, ``kind`` (symbol or string), ``feature``: what two executables can share, each once."""
        labelled = self.labelled()
        own = self.strings().join(labelled.select("exe", "node"), ["exe", "node"], "left_semi")
        row = lambda df, kind, column: df.select("exe", F.lit(kind).alias("kind"), F.col(column).alias("feature"))
        return row(labelled, "symbol", "label").unionByName(row(own, "string", "s")).distinct()

    def names(self) -> DataFrame:
        """``exe``, ``node``, ``name``: names without parameters of the functions that can say where code is from.

        Symbols of the compiler, of the C, C++ and thread libraries and generated ones go before names are demangled,
        operators of the language after.
        """
        label = F.col("label")
        kept = self.nodes.where(label.isNotNull() & ~(X.is_skipped_symbol(label) | X.is_std(label) | X.is_thread_or_posix(label)))
        return demangled(kept, "label").where(~X.is_native_support(F.col("name"))).select("exe", "node", "name").distinct()

    def sizes(self) -> DataFrame:
        """``exe`` with ``n_nodes``, ``n_edges``, ``n_functions``, ``n_symbols``, ``n_strings`` and ``n_incompatible``."""
        features = self.features()
        parts = {
            "n_edges": self.edges,
            "n_functions": self.node_functions().where("fid IS NOT NULL"),
            "n_symbols": features.where("kind = 'symbol'"),
            "n_strings": features.where("kind = 'string'"),
            "n_incompatible": self.incompatible(),
        }
        out = self.nodes.groupBy("exe").agg(F.count("*").alias("n_nodes"))
        for name, rows in parts.items():
            out = out.join(rows.groupBy("exe").agg(F.count("*").alias(name)), "exe", "left")
        return out.fillna(0, list(parts))
