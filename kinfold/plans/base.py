"""Registration of queries, and the roles that the test tables play in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import linkage as L
from kinfold.operators.graph import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def incidence(spark: SparkSession, sf_dir: str, repos: DataFrame | None = None) -> DataFrame:
    """Which repository holds which function, and when it first did; of the repositories in ``repos`` (repo) if given."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("repo"), F.col("l_partkey").alias("fid"), day(F.col("l_shipdate")).alias("ver"))
    if repos is not None:
        rows = rows.join(L.broadcast_if_small(repos), "repo", "left_semi")
    return rows.groupBy("repo", "fid").agg(F.min("ver").alias("ver"))


INC = "inc AS (SELECT l_suppkey AS repo, l_partkey AS fid, min(strftime(l_shipdate, '%Y-%m-%d')) AS ver FROM lineitem GROUP BY l_suppkey, l_partkey)"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of each repository by name and scope; some have no scope."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("nid"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("scope"), F.col("p_size").cast("long").alias("size"))
    return incidence(spark, sf_dir).select("repo", F.col("fid").alias("nid")).join(parts, "nid")


TOK = INC + ", tok AS (SELECT repo, p_partkey AS nid, p_name AS name, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS scope, CAST(p_size AS BIGINT) AS size FROM inc JOIN part ON fid = p_partkey)"


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call graph over supplier numbers."""
    n = read(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    rows = read(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_quantity <= 2")
    return rows.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % n).alias("dst")).distinct()


EDGE = "edge AS (SELECT DISTINCT l_suppkey AS src, l_partkey % (SELECT count(*) FROM supplier) AS dst FROM lineitem WHERE l_linenumber = 1 AND l_quantity <= 2)"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that two repositories share, in long form, one row for each ordered pair and key."""
    one = incidence(spark, sf_dir)
    a, b = one.select(F.col("repo").alias("src"), "fid"), one.select(F.col("repo").alias("dst"), "fid")
    return a.join(b, "fid").where("src <> dst").select("src", "dst", "fid")


EVI = INC + ", evi AS (SELECT a.repo AS src, b.repo AS dst, a.fid FROM inc a JOIN inc b ON a.fid = b.fid AND a.repo <> b.repo)"


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function bodies with a comment and braces around each text."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("repo"), F.concat(F.lit("{ int v; // "), F.coalesce("lang", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(" }")).alias("body"))


BODY = "body AS (SELECT doc_id, source AS repo, concat('{ int v; // ', coalesce(lang, ''), chr(10), coalesce(text, ''), ' }') AS body FROM documents)"


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which repository holds which function, once or more often."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("repo"), F.col("l_partkey").alias("fid"))


def links(spark: SparkSession, sf_dir: str, share: float = 0.25) -> DataFrame:
    """One-way links between repositories that share at least ``share`` of the smaller one, from the smaller key to the larger.

    Written once: queries read them several times.
    """
    found = L.sized(*L.shared_counts(holdings(spark, sf_dir)))
    return cut(found.where(F.col("shared") >= share * F.least("n_src", "n_dst")).select("src", "dst", "shared", "n_src", "n_dst"))


def linked_repos(links: DataFrame) -> DataFrame:
    """``repo``: those that have a link."""
    return cut(links.select(F.explode(F.array("src", "dst")).alias("repo")).distinct())


LINK = EVI + """, sizes AS (SELECT repo, count(*) AS n FROM inc GROUP BY repo),
link AS (SELECT e.src, e.dst, e.shared, a.n AS n_src, b.n AS n_dst FROM (SELECT src, dst, count(*) AS shared FROM evi WHERE src < dst GROUP BY src, dst) e JOIN sizes a ON a.repo = src JOIN sizes b ON b.repo = dst WHERE e.shared >= 0.25 * least(a.n, b.n))"""
