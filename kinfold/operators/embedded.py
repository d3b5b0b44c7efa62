"""Searches that begin with functions, not with vectors: encode, embed, look up in an index, score repositories.

Vectors are computed once and checkpointed: building an index and searching it read them several times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.code import LENGTH, cyclomatic, encoded
from kinfold.functions.network import Network, vectors
from kinfold.operators import balls
from kinfold.operators.graph import cut
from kinfold.operators.vectors import normalised, repo_scores


@dataclass
class Embedder:
    """A vocabulary (token, id) with the network that was trained on it; rows are cut or filled up to ``length`` tokens."""

    vocabulary: DataFrame
    network: Network
    length: int = LENGTH

    def embed(self, rows: DataFrame, key: str, tokens: str) -> DataFrame:
        """``key``, ``vec``: a vector of length 1 for each row. Equal beginnings are embedded once, however many rows have
        them; a row with null tokens has no vector, one without tokens that of nothing."""
        own = rows.where(F.col(tokens).isNotNull()).select(key, F.slice(tokens, 1, self.length).alias("_tokens"))
        kinds = cut(own.groupBy("_tokens").agg(F.min(key).alias("_kind")))
        # A number of partitions that isn't merged by size: a row is small, but costs much to embed.
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ids = encoded(kinds, "_kind", "_tokens", self.vocabulary, self.length).repartition(n, "_kind")
        found = vectors(ids, "_kind", "ids", self.network).select("_kind", normalised(F.col("vec")).alias("vec"))
        return own.join(kinds, "_tokens").join(found, "_kind").select(key, "vec")

    def index(self, functions: DataFrame, tokens: str, metric: str = "l2", path: str | None = None) -> balls.Balls:
        """A stored ball partition of the vectors of ``functions`` (id, tokens)."""
        return balls.build(cut(self.embed(functions, "id", tokens)), path, metric)


def source_scores(embedder: Embedder, index: balls.Balls, functions: DataFrame, holds: DataFrame, k: int = 10, threshold: float | None = 1.3) -> DataFrame:
    """``repo``, ``score``, ``n`` of repositories (``holds``: id, repo) by ``functions`` (query, tokens) of sources.

    A function gives its cyclomatic complexity, shared out over the repositories of the vectors that are near.
    """
    found = balls.search(index, cut(embedder.embed(functions, "query", "tokens")), k, threshold)
    return repo_scores(found, holds, functions.select("query", cyclomatic(F.col("tokens")).cast("double").alias("weight")))


def binary_scores(embedder: Embedder, index: balls.Balls, functions: DataFrame, lines: DataFrame, holds: DataFrame, k: int = 100, threshold: float | None = 0.3) -> DataFrame:
    """The same for functions of an executable (query, instructions) that no debug line (``lines``: query) names.

    A function gives the number of its instructions.
    """
    bare = functions.join(lines.select("query").distinct(), "query", "left_anti")
    found = balls.search(index, cut(embedder.embed(bare, "query", "instructions")), k, threshold)
    return repo_scores(found, holds, bare.select("query", F.size("instructions").cast("double").alias("weight")))
