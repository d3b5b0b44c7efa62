"""Links between repositories: evidence in long form (src, dst, kind, key), orientation, pruning, segmentation.

Evidence stays in long form until the last projection, so sets are joins and nothing grows into one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions.digest import distance
from kinfold.functions.text import prefixes
from kinfold.operators.graph import cut
from kinfold.operators.products import counted_twos, shared_keys

COMMON_THRESHOLD, DIGEST_THRESHOLD = 100, 50
COMMON_SCOPES = ("std", "main")


def identifier_counts(tokens: DataFrame) -> DataFrame:
    """In how many (repository, scope) an identifier occurs."""
    return tokens.select("repo", "name", "scope").distinct().groupBy(F.col("name").alias("identifier")).agg(F.count("*").alias("n"))


def common_identifiers(tokens: DataFrame, threshold: int = COMMON_THRESHOLD) -> DataFrame:
    return identifier_counts(tokens).where(F.col("n") > threshold).select("identifier")


def token_projections(tokens: DataFrame, borrowed: DataFrame) -> DataFrame:
    """Distinct identifiers, scopes and tokens of each repository (repo, nid, name, scope), and without borrowed nodes."""
    rows = tokens.join(borrowed.select("repo", "nid").distinct().withColumn("_b", F.lit(True)), ["repo", "nid"], "left")
    token, own = F.concat("name", F.lit("::"), F.coalesce("scope", F.lit(""))), F.col("_b").isNull()
    return rows.groupBy("repo").agg(F.countDistinct("name").alias("identifiers"), F.countDistinct("scope").alias("scopes"), F.countDistinct(token).alias("tokens"), F.countDistinct(F.when(own, F.col("name"))).alias("trimmed_identifiers"), F.countDistinct(F.when(own, token)).alias("trimmed_tokens"))


def repo_statistics(nodes: DataFrame, edges: DataFrame, borrowed: DataFrame) -> DataFrame:
    """Bodies, nodes and edges of each repository, and its nodes and edges without borrowed ones.

    ``nodes``: repo, nid, fid; ``edges``: repo, src, dst; ``borrowed``: repo, nid.
    """
    own = nodes.join(borrowed.select("repo", "nid"), ["repo", "nid"], "left_anti").select("repo", "nid")
    inner = edges
    for k in ("src", "dst"):
        inner = inner.join(own.withColumnRenamed("nid", k), ["repo", k], "left_semi")
    n = lambda df, name: df.groupBy("repo").agg(F.count("*").alias(name))
    out = nodes.groupBy("repo").agg(F.countDistinct("fid").alias("num_fhash"), F.count("*").alias("num_nodes"))
    for df, name in ((edges, "num_edges"), (own, "num_trimmed_nodes"), (inner, "num_trimmed_edges")):
        out = out.join(n(df, name), "repo", "left")
    return out.fillna(0)


def similar_nodes(pairs: DataFrame, hashes: DataFrame, threshold: int = DIGEST_THRESHOLD, require_body: bool = False) -> DataFrame:
    """Those of ``pairs`` (a, b) whose digest sets (``hashes``: nid, fhash) are equal or hold two digests below the threshold.

    Two nodes without any digest have equal sets, unless ``require_body``.
    """
    sets = hashes.groupBy("nid").agg(F.array_sort(F.collect_set("fhash")).alias("set"))
    x = pairs.join(sets.select(F.col("nid").alias("a"), F.col("set").alias("sa")), "a", "left").join(sets.select(F.col("nid").alias("b"), F.col("set").alias("sb")), "b", "left")
    blank = F.array().cast("array<string>")
    sa, sb = F.coalesce("sa", blank), F.coalesce("sb", blank)
    near = F.exists(sa, lambda p: F.exists(sb, lambda q: F.coalesce(distance(p, q) < threshold, F.lit(False))))
    equal = (sa == sb) & ((F.size(sa) > 0) | F.lit(not require_body))
    return x.where(equal | near).select("a", "b")


def token_links(tokens: DataFrame, common: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Same name and scope in two repositories (ra < rb), unless both are common, with similar bodies if ``hashes`` are given.

    Common names go before the repositories meet, so they never cost the square of their repositories.
    """
    plain = F.col("scope").isNull() | F.col("scope").isin(*COMMON_SCOPES)
    marked = tokens.join(common.select(F.col("identifier").alias("name"), F.lit(True).alias("_c")), "name", "left")
    rare = marked.where(~(F.coalesce("_c", F.lit(False)) & plain))
    a = rare.select(F.col("repo").alias("ra"), F.col("nid").alias("a"), "name", "scope")
    b = rare.select(F.col("repo").alias("rb"), F.col("nid").alias("b"), F.col("name").alias("nb"), F.col("scope").alias("sb"))
    rows = a.join(b, (F.col("name") == F.col("nb")) & F.col("scope").eqNullSafe(F.col("sb"))).where("ra < rb").select("ra", "rb", "a", "b", "name", "scope")
    return _with_similar_bodies(rows, hashes)


def token_link_counts(tokens: DataFrame, common: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """``ra``, ``rb``, ``n``: how many rows ``token_links`` has for each two repositories, without making these rows.

    Nodes are compared once, by name and scope, not once for each two repositories that have them. Each repository of a
    node goes on with the repositories of all nodes like it as one array, dealt by the first one (as in ``shared_counts``).
    """
    plain = F.col("scope").isNull() | F.col("scope").isin(*COMMON_SCOPES)
    marked = tokens.join(common.select(F.col("identifier").alias("name"), F.lit(True).alias("_c")), "name", "left")
    kind = F.concat("name", F.lit("\0"), F.coalesce(F.concat(F.lit("+"), "scope"), F.lit("-")))
    rare = marked.where(F.col("name").isNotNull() & ~(F.coalesce("_c", F.lit(False)) & plain)).select("repo", "nid", kind.alias("kind"))
    nodes = cut(rare.where("repo IS NOT NULL").groupBy("nid", "kind").agg(F.collect_list("repo").alias("repos")))
    a, b = nodes.select(F.col("nid").alias("a"), "kind"), nodes.select(F.col("nid").alias("b"), "kind")
    pairs = cut(_with_similar_bodies(a.join(b, "kind").where("a < b").select("a", "b", "kind"), hashes))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind"))
    like = both.join(nodes.select(F.col("nid").alias("b"), "kind", "repos"), ["b", "kind"]).groupBy(F.col("a").alias("nid"), "kind").agg(F.flatten(F.collect_list("repos")).alias("more"))
    # A node is like itself.
    met = cut(nodes.join(like, ["nid", "kind"], "left").select("repos", F.concat("repos", F.coalesce("more", F.array().cast(nodes.schema["repos"].dataType))).alias("others")))
    dealt = met.select(F.explode("repos").alias("ra"), "others").select("ra", F.filter("others", lambda x: x > F.col("ra")).alias("after")).where("size(after) > 0")
    n = met.agg(F.sum(F.size("repos").cast("long") * F.size("others"))).first()[0] or 0
    return dealt.repartition(_tasks(tokens.sparkSession, n // 2), "ra").select("ra", F.explode("after").alias("rb")).groupBy("ra", "rb").agg(F.count("*").alias("n"))


def _with_similar_bodies(rows: DataFrame, hashes: DataFrame | None) -> DataFrame:
    """Those of ``rows`` (a, b) whose nodes are similar; each pair of nodes is compared once, in however many repositories."""
    return rows if hashes is None else rows.join(similar_nodes(rows.select("a", "b").distinct(), hashes), ["a", "b"])


def identifier_links(tokens: DataFrame, common: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Same identifier, not a common one, and similar bodies if ``hashes`` are given; of each function of the first
    repository, the first of the second."""
    rare = tokens.join(common.select(F.col("identifier").alias("name")), "name", "left_anti")
    a = rare.select(F.col("repo").alias("ra"), F.col("nid").alias("a"), "name")
    b = rare.select(F.col("repo").alias("rb"), F.col("nid").alias("b"), "name")
    rows = _with_similar_bodies(a.join(b, "name").where("ra < rb").select("ra", "rb", "a", "b"), hashes)
    return rows.groupBy("ra", "rb", "a").agg(F.min("b").alias("b"))


def key_evidence(one: DataFrame, key: str, kind: str, without: tuple = (), most: int | None = None) -> DataFrame:
    """Both directions of what two repositories share by a key, without null keys and those in ``without``.

    ``most``: keys of more repositories say nothing and are left out before the repositories meet. Without it a key of n
    repositories gives n (n - 1) rows, as many as there are links.
    """
    rows = one.select("repo", F.col(key).alias("key")).where(F.col("key").isNotNull() & ~F.col("key").isin(*without) if without else F.col("key").isNotNull()).distinct()
    if most is not None:
        rows = rows.join(rows.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") <= most).select("key"), "key", "left_semi")
    a, b = rows.select(F.col("repo").alias("src"), "key"), rows.select(F.col("repo").alias("dst"), "key")
    return a.join(b, "key").where("src <> dst").select("src", "dst", F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"))


def shared_key_counts(one: DataFrame, key: str, without: tuple = ()) -> DataFrame:
    """``src``, ``dst``, ``n``: how many rows ``key_evidence`` has for each two repositories, without making these rows."""
    rows = one.select(F.col("repo").cast("long").alias("row"), F.col(key).alias("key"))
    found = shared_keys(rows.where(~F.col("key").isin(*without)) if without else rows)
    return found.select(F.col("a").alias("src"), F.col("b").alias("dst"), "n")


#: Pairs that a task of ``shared_counts`` counts, and rows that one of the other counts does; rows of up to four numbers that are broadcast (at most 32 MB).
PAIRS, BROADCAST_ROWS = 4_000_000, 1_000_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df``, which was written, to be broadcast if it has few rows of a few numbers."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shared_counts(holds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``src`` < ``dst``, ``shared``: how many functions two repositories share, and ``repo``, ``n``: how many each has.

    ``holds``: repo, fid; repeated rows count once, a null function counts as one that is not shared. The sorted repositories of a function are one row. Each
    of them goes on with those after it, as one array dealt by the first repository, and pairs become rows only where they
    are counted: a shuffle carries a number for a pair and a function, not a row. Tasks follow the number of pairs.
    """
    held = cut(holds.groupBy("fid").agg(F.array_sort(F.collect_set("repo")).alias("repos")))
    sizes = held.select(F.explode("repos").alias("repo")).groupBy("repo").agg(F.count("*").alias("n"))
    n, known = F.size("repos").cast("long"), held.where("fid IS NOT NULL").select("repos")
    pairs, spark = int(known.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0), holds.sparkSession
    tasks = _tasks(spark, pairs)
    each = known.select("repos", F.posexplode("repos").alias("i", "src")).where("i + 1 < size(repos)")
    dealt = each.select("src", F.slice("repos", F.col("i") + 2, F.size("repos")).alias("after")).repartition(tasks, "src")
    return dealt.select("src", F.explode("after").alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("shared")), sizes


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // PAIRS))


def shared_by_three(holds: DataFrame) -> DataFrame:
    """``src``, ``o1`` < ``o2``, ``n``: how many functions a repository shares with each two others at once.

    ``holds`` as for ``shared_counts``. A repository goes on with the others of a function as one array, dealt and sorted by
    the repository; twos are made and counted in its task, which gets PAIRS of them on average, some at a time.
    """
    held = cut(holds.where("fid IS NOT NULL").groupBy("fid").agg(F.array_sort(F.collect_set(F.col("repo").cast("long"))).alias("repos")).where("size(repos) > 2").select("repos"))
    n = F.size("repos").cast("long")
    rows = int(held.agg(F.sum(n * (n - 1) * (n - 2) / 2)).first()[0] or 0)
    each = held.select(F.explode("repos").alias("src"), "repos").select("src", F.array_remove("repos", F.col("src")).alias("others"))
    dealt = each.repartition(_tasks(holds.sparkSession, rows), "src").sortWithinPartitions("src")
    return dealt.mapInArrow(counted_twos, "src long, o1 long, o2 long, n long")


def sized(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """``counts`` (src, dst) with the sizes (repo, n) of both repositories, ``n_src`` and ``n_dst``."""
    sizes = cut(sizes)
    for k in ("src", "dst"):
        counts = counts.join(broadcast_if_small(sizes.select(F.col("repo").alias(k), F.col("n").alias(f"n_{k}"))), k)
    return counts


def evidence_of(links: DataFrame, holds: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``fid``: what the two ends of each link (src, dst, n_src, n_dst) share of ``holds`` (distinct repo, fid).

    The smaller end's functions are looked up in the larger one, so links at a share of the smaller one never cost much
    more than the evidence they have.
    """
    less = F.col("n_src") <= F.col("n_dst")
    ends = links.select("src", "dst", F.when(less, F.col("src")).otherwise(F.col("dst")).alias("_less"), F.when(less, F.col("dst")).otherwise(F.col("src")).alias("_more"))
    a, b = (holds.select(F.col("repo").alias(k), "fid") for k in ("_less", "_more"))
    return ends.join(a, "_less").join(b, ["_more", "fid"]).select("src", "dst", "fid")


def small_links(links: DataFrame, share: float = 0.01, few: int = 3) -> DataFrame:
    """Links kept: a share of one side is large enough, and more than a few tokens or functions are shared.

    ``links``: src, dst, n_token, n_fhash and the sizes size_src and size_dst; a size of zero counts as no share.
    """
    ratio = lambda n: F.coalesce(F.col("n_fhash") / F.nullif(F.col(n), F.lit(0)), F.lit(0.0))
    return links.where(((ratio("size_src") >= share) | (ratio("size_dst") >= share)) & ~((F.col("n_token") <= few) & (F.col("n_fhash") <= few)))


def without_simple_repos(links: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links whose two repositories (``sizes``: repo, size) have something of their own; unknown ones have."""
    simple = sizes.where("size = 0").select("repo")
    for k in ("src", "dst"):
        links = links.join(simple.select(F.col("repo").alias(k)), k, "left_anti")
    return links


def with_evidence(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Links (src, dst) with evidence of any kind but namespaces; others are empty or hold by a namespace only."""
    return links.join(evidence.where("kind <> 'ns'").select("src", "dst"), ["src", "dst"], "left_semi")


def borrowed_functions(holds: DataFrame, nodes: DataFrame, fids: DataFrame) -> DataFrame:
    """``repo``, ``nid``, ``fid`` of ``holds`` with ``by_node``, ``by_function`` and ``weak``: whether the node, or the
    function's body, was borrowed (``nodes``: repo, nid; ``fids``: repo, fid), or any node of that body in its repository."""
    yes = F.lit(True)
    rows = holds.join(nodes.select("repo", "nid").distinct().withColumn("_n", yes), ["repo", "nid"], "left")
    rows = rows.join(fids.select("repo", "fid").distinct().withColumn("_f", yes), ["repo", "fid"], "left")
    shared = holds.join(nodes.select("repo", "nid"), ["repo", "nid"], "left_semi").select("repo", "fid").distinct()
    rows = rows.join(shared.withColumn("_w", yes), ["repo", "fid"], "left")
    no = F.lit(False)
    return rows.select("repo", "nid", "fid", F.coalesce("_n", no).alias("by_node"), F.coalesce("_f", no).alias("by_function"), F.coalesce("_f", "_w", no).alias("weak"))


def one_way(links: DataFrame) -> DataFrame:
    """Links whose reverse isn't there."""
    return links.join(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")


def two_way(links: DataFrame) -> DataFrame:
    """Pairs (a < b) linked both ways."""
    return links.join(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def orient(links: DataFrame, votes: DataFrame) -> DataFrame:
    """Drops the losing direction of pairs with a vote (a, b, vote): 1 keeps a to b, -1 keeps b to a, 0 keeps both."""
    lost = votes.where("vote <> 0").select(F.when(F.col("vote") > 0, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(F.col("vote") > 0, F.col("a")).otherwise(F.col("b")).alias("dst"))
    return links.join(lost, ["src", "dst"], "left_anti")


def vote_unanimous(firsts: DataFrame) -> DataFrame:
    """Vote on pairs by times (a, b, time_a, time_b of each shared thing): who is earlier in all of them is the source of
    the copy, so the other one reuses it: 1 where a is always later or equal and once later."""
    later = F.sum((F.col("time_a") > F.col("time_b")).cast("long"))
    earlier = F.sum((F.col("time_a") < F.col("time_b")).cast("long"))
    return firsts.groupBy("a", "b").agg(later.alias("later"), earlier.alias("earlier")).select("a", "b", F.when((F.col("later") > 0) & (F.col("earlier") == 0), 1).when((F.col("earlier") > 0) & (F.col("later") == 0), -1).otherwise(0).alias("vote"))


def vote_namespace(shared: DataFrame, tokens: DataFrame) -> DataFrame:
    """Vote by how much of each repository's namespaces the shared functions make up.

    ``shared``: a, b, fid; ``tokens``: repo, fid, scope. Every prefix of a token's scope counts for its repository, and
    the total is the depth of all scopes. The weight of a side is the sum of its counts over the prefixes of the scopes of
    its shared functions. Where a's share is the smaller and its total the larger, a reuses b (1); the other way -1; else 0.
    """
    scoped = tokens.where("scope IS NOT NULL").select("repo", "fid", prefixes(F.col("scope"), whole=True).alias("p"))
    counts = scoped.select("repo", F.explode("p").alias("ns")).groupBy("repo", "ns").agg(F.count("*").alias("n"))
    totals = scoped.groupBy("repo").agg(F.sum(F.size("p")).alias("total"))
    out = shared.select("a", "b").distinct()
    for k in ("a", "b"):
        own = shared.join(scoped.withColumnRenamed("repo", k), [k, "fid"]).select("a", "b", F.explode("p").alias("ns")).distinct()
        weight = own.join(counts.withColumnRenamed("repo", k), [k, "ns"]).groupBy("a", "b").agg(F.sum("n").alias(f"w{k}"))
        out = out.join(weight, ["a", "b"], "left").join(totals.select(F.col("repo").alias(k), F.col("total").alias(f"s{k}")), k, "left")
    # Shares compared crosswise, in whole numbers; a repository without scopes gives no vote.
    left, right = F.coalesce("wa", F.lit(0)) * F.col("sb"), F.coalesce("wb", F.lit(0)) * F.col("sa")
    vote = F.when((left < right) & (F.col("sa") > F.col("sb")), 1).when((left > right) & (F.col("sa") < F.col("sb")), -1).otherwise(0)
    return out.select("a", "b", vote.alias("vote"))


def vote_identifiers(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vote by functions with the same identifier: calls first, then times.

    ``pairs``: a, b, na, nb; ``nodes``: repo, nid, n_out, time (null where unknown). If only a has functions that call
    nothing while their counterparts do, a reuses b (1), if only b, -1. Else a side that is later in some pair and never
    earlier reuses the other.
    """
    rows = pairs
    for k in ("a", "b"):
        rows = rows.join(nodes.select(F.col("repo").alias(k), F.col("nid").alias(f"n{k}"), F.col("n_out").alias(f"out_{k}"), F.col("time").alias(f"time_{k}")), [k, f"n{k}"])
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    counts = rows.groupBy("a", "b").agg(
        n((F.col("out_a") == 0) & (F.col("out_b") > 0)).alias("idle_a"), n((F.col("out_b") == 0) & (F.col("out_a") > 0)).alias("idle_b"),
        n(F.col("time_a") > F.col("time_b")).alias("later_a"), n(F.col("time_b") > F.col("time_a")).alias("later_b"),
    )
    one = lambda x, y: (F.col(x) > 0) & (F.col(y) == 0)
    vote = F.when(one("idle_a", "idle_b"), 1).when(one("idle_b", "idle_a"), -1).when(one("later_a", "later_b"), 1).when(one("later_b", "later_a"), -1).otherwise(0)
    return counts.select("a", "b", vote.alias("vote"))


def vote_calls(pairs: DataFrame, degrees: DataFrame) -> DataFrame:
    """Vote by call relations of shared functions: one that nobody calls in a repository was copied into it unused.

    ``pairs``: a, b, na, nb (the function's node in each); ``degrees``: repo, nid, n_in.
    """
    rows = pairs
    for k in ("a", "b"):
        rows = rows.join(degrees.select(F.col("repo").alias(k), F.col("nid").alias(f"n{k}"), F.col("n_in").alias(f"in_{k}")), [k, f"n{k}"])
    idle_a = F.sum(((F.col("in_a") == 0) & (F.col("in_b") > 0)).cast("long"))
    idle_b = F.sum(((F.col("in_b") == 0) & (F.col("in_a") > 0)).cast("long"))
    return rows.groupBy("a", "b").agg(idle_a.alias("ia"), idle_b.alias("ib")).select("a", "b", F.when((F.col("ia") > 0) & (F.col("ib") == 0), 1).when((F.col("ib") > 0) & (F.col("ia") == 0), -1).otherwise(0).alias("vote"))


def combine_votes(pairs: DataFrame, *votes: DataFrame) -> DataFrame:
    """The first vote that isn't zero; without votes every pair keeps both directions."""
    rows, total = pairs.select("a", "b"), F.lit(None).cast("int")
    for k, v in enumerate(votes):
        rows = rows.join(v.select("a", "b", F.col("vote").alias(f"v{k}")), ["a", "b"], "left")
        total = F.coalesce(total, F.nullif(F.col(f"v{k}"), F.lit(0)))
    return rows.select("a", "b", F.coalesce(total, F.lit(0)).alias("vote"))


def primitive_first(links: DataFrame, primitive: DataFrame) -> DataFrame:
    """Links out of primitive repositories are dropped and reversed, unless the target is primitive or the reverse is there."""
    out = links.join(primitive.select(F.col("repo").alias("src")), "src", "left_semi").select("src", "dst")
    rest = links.select("src", "dst").join(out, ["src", "dst"], "left_anti")
    back = out.join(primitive.select(F.col("repo").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return rest.unionByName(back.select("src", "dst")).distinct()


def manual(links: DataFrame, wanted: DataFrame, compat: bool = False) -> DataFrame:
    """Pairs that are linked either way and wanted as src to dst get that direction; ``compat`` keeps a lone reverse."""
    back = wanted.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    known = links.select("src", "dst")
    there = known.join(wanted, ["src", "dst"], "left_semi").unionByName(known.join(back, ["src", "dst"], "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    drop = there.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if compat:
        drop = drop.join(known.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    return known.join(drop, ["src", "dst"], "left_anti").unionByName(there).distinct()


def without_primitive_evidence(evidence: DataFrame, primitive: DataFrame) -> DataFrame:
    """Evidence of a repository's links that it also shares with a primitive repository goes; functions stay by digest."""
    known = evidence.join(primitive.select(F.col("repo").alias("dst")), "dst", "left_semi").where("kind <> 'fhash'").select("src", "kind", "key").distinct()
    return evidence.join(known, ["src", "kind", "key"], "left_anti")


def subsumed_once(evidence: DataFrame, links: DataFrame) -> DataFrame:
    """What one round of subsumption removes: evidence of n to o1 that n shares with o2, where o1 links one-way to o2."""
    chain = one_way(links.select("src", "dst")).select(F.col("src").alias("o1"), F.col("dst").alias("o2"))
    first = evidence.select(F.col("src").alias("n"), F.col("dst").alias("o1"), "kind", "key")
    second = evidence.select(F.col("src").alias("n"), F.col("dst").alias("o2"), "kind", "key")
    return first.join(chain, "o1").join(second, ["n", "o2", "kind", "key"], "left_semi").select(F.col("n").alias("src"), F.col("o1").alias("dst"), "kind", "key").distinct()


def subsume(evidence: DataFrame) -> DataFrame:
    """Subsumption until nothing more goes; links without evidence vanish with it.

    A round removes what ``subsumed_once`` does. After the first one, evidence can only go because a link has just become
    one-way, its reverse having lost its last evidence: a round looks at the evidence of such links alone, and ends when
    there are none. The evidence itself is written once; rounds write what they remove and the links' counts.
    """
    keys = ["src", "dst", "kind", "key"]
    evidence = cut(evidence.select(*keys).distinct())
    counts = cut(evidence.groupBy("src", "dst").agg(F.count("*").alias("n")))
    chain, gone = one_way(counts.select("src", "dst")).select(F.col("src").alias("o1"), F.col("dst").alias("o2")), []
    while True:
        first = evidence.select(F.col("src").alias("n"), F.col("dst").alias("o1"), "kind", "key").join(chain.select("o1").distinct(), "o1", "left_semi")
        second = evidence.select(F.col("src").alias("n"), F.col("dst").alias("o2"), "kind", "key").join(chain.select("o2").distinct(), "o2", "left_semi")
        if gone:
            removed = reduce(DataFrame.unionByName, gone)
            first, second = (df.join(removed.withColumnsRenamed({"src": "n", "dst": k}), ["n", k, "kind", "key"], "left_anti") for df, k in ((first, "o1"), (second, "o2")))
        out = first.join(chain, "o1").join(second, ["n", "o2", "kind", "key"], "left_semi").select(F.col("n").alias("src"), F.col("o1").alias("dst"), "kind", "key").distinct()
        out = cut(out)
        if out.isEmpty():
            break
        gone = [cut(reduce(DataFrame.unionByName, gone)), out] if len(gone) >= 32 else [*gone, out]
        lost = out.groupBy("src", "dst").agg(F.count("*").alias("m"))
        counts = cut(counts.join(lost, ["src", "dst"], "left").select("src", "dst", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")))
        empty = counts.join(lost, ["src", "dst"], "left_semi").where("n = 0").select(F.col("dst").alias("o1"), F.col("src").alias("o2"))
        chain = cut(empty.join(counts.where("n > 0").select(F.col("src").alias("o1"), F.col("dst").alias("o2")), ["o1", "o2"], "left_semi"))
        if chain.isEmpty():
            break
    return evidence.join(reduce(DataFrame.unionByName, gone), keys, "left_anti") if gone else evidence


def reused(evidence: DataFrame) -> DataFrame:
    """Distinct functions that each repository reuses: over all links, and over one-way links only."""
    alone = one_way(evidence.select("src", "dst").distinct()).withColumn("_one", F.lit(True))
    rows = evidence.join(alone, ["src", "dst"], "left")
    return rows.groupBy(F.col("src").alias("repo")).agg(F.countDistinct("key").alias("with_bi"), F.countDistinct(F.when(F.col("_one"), F.col("key"))).alias("one_way"))


def reuse_ratio(links: DataFrame, threshold: float = 1.0) -> DataFrame:
    """``kept``: False where what a link shares is too small a part of what its target has of its own.

    ``links``: src, dst, common, and of dst n (functions) and reused. Targets that reuse nothing, or have nothing of their
    own, are not judged.
    """
    judged = (F.col("reused") >= 1) & (F.col("n") - F.col("reused") >= 1)
    enough = F.col("common") / F.col("n") >= threshold * F.col("n") / F.col("reused")
    return links.withColumn("kept", ~judged | F.coalesce(enough, F.lit(False)))


def borrowed(evidence: DataFrame, tokens: DataFrame) -> DataFrame:
    """Functions (repo, nid) that a repository borrowed along one-way links: by name and scope, else all with that name.

    ``evidence``: src, dst of links; every function of dst counts.
    """
    out = one_way(evidence.select("src", "dst").distinct())
    theirs = tokens.select(F.col("repo").alias("dst"), F.col("name").alias("n"), "scope").distinct()
    mine = tokens.select(F.col("repo").alias("src"), "nid", "name", F.col("scope").alias("s"))
    # By name first: a link brings only the names that both sides have.
    found = mine.join(theirs, F.col("name") == F.col("n")).join(out, ["src", "dst"]).select("src", "name", "scope", "nid", F.col("scope").eqNullSafe(F.col("s")).alias("exact"))
    best = F.max("exact").over(Window.partitionBy("src", "name", "scope"))
    return found.withColumn("best", best).where("exact = best").select(F.col("src").alias("repo"), "nid").distinct()


def borrowed_before(tokens: DataFrame) -> DataFrame:
    """``borrowed`` where every repository links to all those before it that have a name in common with it.

    Then every name and scope that an earlier repository has counts, so its first repository decides, and links aren't
    needed: a function is borrowed by name and scope if these were there before, or by name if of the scopes that the name
    had before there are more than those that its repository has too.
    """
    rows = tokens.select("repo", "nid", "name", "scope").where("repo IS NOT NULL AND name IS NOT NULL")
    known = cut(rows.groupBy("name", "scope").agg(F.min("repo").alias("first")))
    firsts = known.groupBy("name").agg(F.array_sort(F.collect_list("first")).alias("firsts"))
    first = known.select(F.col("name").alias("_n"), F.col("scope").alias("_s"), "first")
    met = rows.join(first, (F.col("name") == F.col("_n")) & F.col("scope").eqNullSafe(F.col("_s"))).join(firsts, "name")
    exact = F.col("first") < F.col("repo")
    both = F.size(F.collect_set(F.when(exact, F.struct("scope"))).over(Window.partitionBy("repo", "name")))
    return met.withColumn("both", both).where(exact | (F.size(F.filter("firsts", lambda r: r < F.col("repo"))) > F.col("both"))).select("repo", "nid").distinct()


def significantly_larger(a: Column, b: Column) -> Column:
    return F.when(b == 0, a > 10).otherwise(a > 10 * b)
