"""Graph operators over edge tables (``src``, ``dst``). Loops run over frontiers, each round is checkpointed."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one that the session names, only a local master gets its own."""
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
    """Cuts lineage with a reliable checkpoint in the shared folder that the session names."""
    shared_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    # New attributes: the optimizer confuses inputs of a union that descend from one checkpoint.
    return kept.select(*(F.col(c).alias(c) for c in kept.columns))


#: Frontiers that are kept apart; a longer search writes them as one now and then.
_MERGED = 64


def _united(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def strong_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its largest node) of each node on a cycle with others; all other nodes are their own.

    Nodes without an edge in or out are trimmed. What is left takes colours: each node the largest that reaches it. A node
    of its own colour begins a component, which is what reaches it inside the colour. These go, and the rest takes colours
    again. Rounds follow the length of cycles and of paths between them, each is checkpointed.
    """
    left, found = cut(edges.where("src <> dst").select("src", "dst").distinct()), None
    while True:
        size = None
        while size != (n := left.count()):
            size = n
            goes, comes = left.select(F.col("src").alias("dst")).distinct(), left.select(F.col("dst").alias("src")).distinct()
            left = cut(left.join(goes, "dst", "left_semi").join(comes, "src", "left_semi").select("src", "dst"))
        if not size:
            break
        colour = cut(left.select(F.col("src").alias("node")).distinct().withColumn("c", F.col("node")))
        fresh = colour
        while not fresh.isEmpty():
            given = fresh.join(left, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("g"))
            fresh = cut(colour.join(given, "node").where("g > c").select("node", F.col("g").alias("c")))
            colour = cut(colour.join(fresh.withColumnRenamed("c", "g"), "node", "left").select("node", F.coalesce("g", "c").alias("c")))
        x, y = (colour.select(F.col("node").alias(k), F.col("c").alias(f"c_{k}")) for k in ("src", "dst"))
        inside = cut(left.join(x, "src").join(y, "dst").where("c_src = c_dst").select("src", "dst"))
        own = reach_back(inside, colour.where("node = c").select("node"))
        own = own.join(colour, "node").select("node", F.col("c").alias("component"))
        found = cut(own if found is None else found.unionByName(own))
        gone = own.select("node")
        for k in ("src", "dst"):
            left = left.join(gone.withColumnRenamed("node", k), k, "left_anti").select("src", "dst")
        left = cut(left)
    return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).where("false") if found is None else found


def reach_back(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``node``: all nodes from which any of ``start`` can be reached."""
    return reach_any(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start)


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``seed``, ``node``: all nodes reachable from each seed (``seed``, ``node``), itself included.

    Cycles are contracted first. Over the components, 64 seeds travel as the bits of one number, and a round sends on only
    bits that are new at a component; rounds follow the depth of the contracted graph. Seeds and nodes become rows at the end.
    """
    from kinfold.operators.numbering import numbered

    seeds, edges = cut(seeds.select("seed", "node").distinct()), cut(edges.select("src", "dst").distinct())
    known = strong_components(edges)
    at = lambda df, k, name: df.join(known.select(F.col("node").alias(k), F.col("component").alias("_c")), k, "left").withColumn(name, F.coalesce("_c", k)).drop("_c")
    onward = cut(at(at(edges, "src", "a"), "dst", "b").where("a <> b").select("a", "b").distinct())
    numbers = cut(numbered(seeds.select("seed").distinct(), "seed", name="n").select("seed", (F.col("n") - 1).alias("n")))
    placed = at(seeds, "node", "component").join(numbers, "seed")
    word, bit = F.floor(F.col("n") / 64).cast("long"), (F.col("n") % 64).cast("int")
    deltas = [cut(placed.groupBy("component", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(n % 64 AS INT))")).alias("bits")))]
    while not deltas[-1].isEmpty():
        sent = deltas[-1].join(onward, F.col("component") == F.col("a")).groupBy(F.col("b").alias("component"), "word").agg(F.bit_or("bits").alias("sent"))
        have = _united(deltas).groupBy("component", "word").agg(F.bit_or("bits").alias("have"))
        new = F.col("sent").bitwiseAND(F.bitwise_not(F.coalesce("have", F.lit(0).cast("long"))))
        deltas.append(cut(sent.join(have, ["component", "word"], "left").select("component", "word", new.alias("bits")).where("bits <> 0")))
        if len(deltas) % _MERGED == 0:
            deltas = [cut(_united(deltas[:-1])), deltas[-1]]
    bits = F.explode(F.expr("filter(sequence(0, 63), i -> shiftright(bits, i) & 1 = 1)"))
    reached = _united(deltas).select("component", "word", bits.alias("bit")).select("component", (F.col("word") * 64 + F.col("bit")).alias("n")).join(numbers, "n")
    every = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).unionByName(seeds.select("node")).distinct()
    return reached.join(at(every, "node", "component"), "component").select("seed", "node")


def reach(edges: DataFrame, seeds: DataFrame, blocked: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """``seed``, ``node``: all nodes reachable from each seed (``seed``, ``node``), itself included, in ``depth`` steps if given.

    ``blocked`` nodes (column ``node``) are neither visited nor passed.
    """
    if blocked is not None:
        edges = edges.join(blocked.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        seeds = seeds.join(blocked.select("node"), "node", "left_anti")
    return closure(edges, seeds) if depth is None else _frontiers(edges, seeds, depth)


def _frontiers(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """Rows of seed and node, a step a round; cycles end by the anti-join with what is known."""
    frontiers = [cut(seeds.select("seed", "node").distinct())]
    while not frontiers[-1].isEmpty() and (depth is None or len(frontiers) <= depth):
        last = frontiers[-1]
        step = last.join(edges, last["node"] == edges["src"]).select("seed", F.col("dst").alias("node")).distinct()
        # Only what is new is written: what is known is the union of all frontiers.
        frontiers.append(cut(step.join(_united(frontiers), ["seed", "node"], "left_anti")))
        if len(frontiers) % _MERGED == 0:
            frontiers = [cut(_united(frontiers[:-1])), frontiers[-1]] if depth is None else frontiers
    return _united(frontiers)


def reach_any(edges: DataFrame, start: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """``node``: all nodes reachable from any of ``start``."""
    if blocked is not None:
        edges = edges.join(blocked.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        start = start.join(blocked.select("node"), "node", "left_anti")
    return _frontiers(edges, start.select(F.lit(0).alias("seed"), "node")).select("node")


def bypass(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges after nodes are removed: u to v where a path leads through removed nodes only. New edges from a node to itself are kept only where no edge from a node to itself was there before them on the path."""
    gone = removed.select("node")
    outward = edges.join(gone, edges["dst"] == gone["node"], "left_semi").join(gone, edges["src"] == gone["node"], "left_anti")
    inner = edges.join(gone, edges["src"] == gone["node"], "left_semi").select("src", "dst")
    kept = edges.join(gone, edges["dst"] == gone["node"], "left_anti").join(gone, edges["src"] == gone["node"], "left_anti")
    through = reach(inner, outward.select(F.col("src").alias("seed"), F.col("dst").alias("node")).distinct())
    found = through.join(gone, "node", "left_anti").select(F.col("seed").alias("src"), F.col("node").alias("dst"))
    return kept.select("src", "dst").unionByName(found).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node``, ``n_in`` and ``n_out``, zero where there are none."""
    i = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    o = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    return nodes.select("node").join(i, "node", "left").join(o, "node", "left").fillna(0, ["n_in", "n_out"])


def callers(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("callers"))


def callees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("callees"))


def directed(relations: DataFrame, compatible: bool = True) -> DataFrame:
    """Distinct edges of caller and callee rows, without self loops; optionally only between compatible scopes.

    ``src_scope`` and ``dst_scope`` are compatible where one is null or one begins with the other.
    """
    rows = relations.where("src <> dst")
    if compatible:
        a, b = F.col("src_scope"), F.col("dst_scope")
        rows = rows.where(a.isNull() | b.isNull() | a.startswith(b) | b.startswith(a))
    return rows.select("src", "dst").distinct()


def merge_versions(edges: DataFrame) -> DataFrame:
    """One row for each edge with all its versions."""
    return edges.groupBy("src", "dst").agg(F.array_sort(F.collect_set("ver")).alias("vers"))


def cross_repo_reach(edges: DataFrame, links: DataFrame, holds: DataFrame, start: DataFrame) -> DataFrame:
    """``repo``, ``round``: repositories reached from ``start`` (repo, node) along one-way links whose evidence is used.

    Nodes reachable inside a repository give the functions it uses (``holds``: repo, node, fid); a link (src, dst, fid)
    whose fid is among them is followed, and the nodes of dst that hold that fid go on. A repository enters once, so rounds
    end with the longest chain of repositories.
    """
    place = lambda k: F.struct("repo", F.col(k).alias("node"))
    calls = cut(edges.select(place("src").alias("src"), place("dst").alias("dst")).distinct())
    visited = [cut(start.select("repo").distinct().withColumn("round", F.lit(0)))]
    state, k = cut(start.select("repo", "node").distinct()), 0
    while True:
        k += 1
        inside = reach_any(calls, state.select(place("node").alias("node"))).select("node.*")
        used = inside.join(holds, ["repo", "node"]).select(F.col("repo").alias("src"), "fid").distinct()
        onward = links.join(used, ["src", "fid"]).select(F.col("dst").alias("repo"), "fid").distinct()
        onward = cut(onward.join(_united(visited).select("repo"), "repo", "left_anti"))
        if onward.isEmpty():
            return _united(visited)
        visited.append(cut(onward.select("repo").distinct().withColumn("round", F.lit(k))))
        if len(visited) % _MERGED == 0:
            visited = [cut(_united(visited))]
        state = cut(onward.join(holds, ["repo", "fid"]).select("repo", "node").distinct())
