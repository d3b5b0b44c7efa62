"""Graph queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinfold.operators import graph as G
from kinfold.operators.references import reference_edges, references
from kinfold.plans.base import EDGE, call_edges, incidence, links, query, read

SEEDS = "seed AS (SELECT DISTINCT src AS seed, src AS node FROM edge WHERE src % 9 = 0)"


def nodes_of(edges):
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


@query("WITH RECURSIVE " + EDGE + ", " + SEEDS + ", r AS (SELECT seed, node FROM seed UNION SELECT r.seed, edge.dst FROM r JOIN edge ON edge.src = r.node) SELECT seed, node FROM r")
def reachability(spark, d):
    e = call_edges(spark, d)
    return G.reach(e, e.where("src % 9 = 0").select(F.col("src").alias("seed"), F.col("src").alias("node")))


@query("WITH RECURSIVE " + EDGE + ", s AS (SELECT DISTINCT src AS node FROM edge WHERE src % 9 = 0 AND src % 5 <> 0), e AS (SELECT * FROM edge WHERE dst % 5 <> 0), r AS (SELECT node FROM s UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def reachability_previsited(spark, d):
    e = call_edges(spark, d)
    visited = nodes_of(e).where("node % 5 = 0")
    return G.reach_any(e, e.where("src % 9 = 0").select(F.col("src").alias("node")).distinct(), visited)


@query("WITH RECURSIVE " + EDGE + ", n AS (SELECT src AS node FROM edge UNION SELECT dst FROM edge), r AS (SELECT DISTINCT src AS node FROM edge WHERE src % 9 = 0 UNION SELECT edge.dst FROM r JOIN edge ON edge.src = r.node) SELECT node FROM n WHERE node NOT IN (SELECT node FROM r)")
def unvisited_branches(spark, d):
    e = call_edges(spark, d)
    return nodes_of(e).join(G.reach_any(e, e.where("src % 9 = 0").select(F.col("src").alias("node")).distinct()), "node", "left_anti")


@query()
def cross_repo_reachability(spark, d):
    """Repositories reached from the first one along links whose functions are reachable; rounds are deterministic here."""
    holds = incidence(spark, d).select("repo", F.col("fid").alias("node"), "fid")
    one = holds.groupBy("repo").agg(F.min("node").alias("src"))
    inner = holds.join(one, "repo").where("node <> src").select("repo", "src", F.col("node").alias("dst"))
    a, b = holds.select(F.col("repo").alias("src"), "fid"), holds.select(F.col("repo").alias("dst"), "fid")
    evidence = links(spark, d).select("src", "dst").join(a, "src").join(b, ["dst", "fid"])
    start = one.orderBy("repo").limit(1).select("repo", F.col("src").alias("node"))
    return G.cross_repo_reach(inner, evidence, holds, start)


@query("WITH RECURSIVE " + EDGE + ", gone AS (SELECT node FROM (SELECT src AS node FROM edge UNION SELECT dst FROM edge) WHERE node % 4 = 0), r AS (SELECT src, dst AS node FROM edge WHERE src % 4 <> 0 AND dst % 4 = 0 UNION SELECT r.src, edge.dst FROM r JOIN edge ON edge.src = r.node AND r.node % 4 = 0), a AS (SELECT src, dst FROM edge WHERE src % 4 <> 0 AND dst % 4 <> 0 UNION SELECT src, node FROM r WHERE node % 4 <> 0) SELECT src, dst FROM a")
def bypass_removal(spark, d):
    e = call_edges(spark, d)
    return G.bypass(e, nodes_of(e).where("node % 4 = 0"))


@query("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey <> l_partkey AND (l_returnflag = l_linestatus OR l_returnflag = 'N' OR l_linestatus LIKE l_returnflag || '%')")
def relation_graph(spark, d):
    li = read(spark, d, "lineitem")
    return G.directed(li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("src_scope"), F.col("l_linestatus").alias("dst_scope")))


@query("SELECT src, dst, string_agg(DISTINCT ver, ',' ORDER BY ver) AS vers FROM (SELECT l_suppkey AS src, l_partkey % 100 AS dst, l_linenumber AS ver FROM lineitem) GROUP BY src, dst")
def merged_versions(spark, d):
    e = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"), F.col("l_linenumber").alias("ver"))
    return G.merge_versions(e).select("src", "dst", F.array_join("vers", ",").alias("vers"))


@query("WITH " + EDGE + ", n AS (SELECT src AS node FROM edge UNION SELECT dst FROM edge) SELECT node, (SELECT count(*) FROM edge WHERE dst = node) AS n_in, (SELECT count(*) FROM edge WHERE src = node) AS n_out FROM n")
def degrees(spark, d):
    e = call_edges(spark, d)
    return G.degrees(nodes_of(e), e)


@query("WITH " + EDGE + " SELECT DISTINCT dst AS node FROM edge WHERE dst NOT IN (SELECT src FROM edge)")
def primitive_nodes(spark, d):
    e = call_edges(spark, d)
    return G.degrees(nodes_of(e), e).where("n_out = 0").select("node")


@query("WITH " + EDGE + " SELECT dst AS node, string_agg(src, ',' ORDER BY src) AS callers FROM edge GROUP BY dst")
def callers(spark, d):
    return G.callers(call_edges(spark, d)).select("node", F.array_join("callers", ",").alias("callers"))


@query("WITH " + EDGE + " SELECT src AS node, string_agg(dst, ',' ORDER BY dst) AS callees FROM edge GROUP BY src")
def callees(spark, d):
    return G.callees(call_edges(spark, d)).select("node", F.array_join("callees", ",").alias("callees"))


@query("WITH " + EDGE + """, c AS (SELECT s_suppkey AS root, s_nationkey % 5 AS label, list(dst) AS s FROM supplier JOIN edge ON src = s_suppkey GROUP BY s_suppkey, s_nationkey)
SELECT a.root AS a, b.root AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)), 6) AS similarity, CAST(2 * abs(len(a.s) - len(b.s)) AS BIGINT) AS low, CAST(2 * (len(a.s) + len(b.s) - 2 * len(list_intersect(a.s, b.s))) AS BIGINT) AS high FROM c a JOIN c b ON a.label = b.label AND a.root < b.root""")
def subgraph_edit_bounds(spark, d):
    """Bounds of the edit distance of call neighbourhoods of supplier pairs that share a label."""
    from kinfold.operators.subgraphs import edit_bounds

    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("root"), (F.col("s_nationkey") % 5).alias("label"))
    return edit_bounds(call_edges(spark, d), s).withColumn("similarity", F.round("similarity", 6))


#: Two programs: documents are functions with their longer sentences as strings, and each calls one or two of its half.
TWO_PROGRAMS = """fn AS (SELECT doc_id AS nid, doc_id % 2 AS half, n_chars, CASE WHEN doc_id % 4 < 2 THEN 'f' || (doc_id // 4) END AS label FROM documents), str AS (SELECT DISTINCT nid, half, string FROM (SELECT doc_id AS nid, doc_id % 2 AS half, unnest(string_split(text, '. ')) AS string FROM documents) WHERE length(string) >= 20),
e AS (SELECT DISTINCT x.nid AS src, y.nid AS dst FROM (SELECT nid, unnest([nid + 2, nid + 2 + 2 * (n_chars % 5)]) AS dst FROM fn) x JOIN fn y ON y.nid = x.dst),
pair AS (SELECT a, b, bool_or(by_label) AS by_label, sum(score) AS score FROM (SELECT a.nid AS a, b.nid AS b, true AS by_label, 0 AS score FROM fn a JOIN fn b ON a.label = b.label AND a.half = 0 AND b.half = 1 WHERE a.nid % 7 <> 0 UNION ALL SELECT a.nid, b.nid, false, length(a.string) FROM str a JOIN str b ON a.string = b.string AND a.half = 0 AND b.half = 1 WHERE a.nid % 7 <> 0) GROUP BY a, b),
stop AS (SELECT a AS node FROM pair UNION SELECT b FROM pair), r AS (SELECT a AS root, 0 AS side FROM pair WHERE NOT by_label UNION SELECT b, 1 FROM pair WHERE NOT by_label),
l1 AS (SELECT DISTINCT root, dst AS node FROM r JOIN e ON src = root), l2 AS (SELECT DISTINCT root, dst AS node FROM l1 JOIN e ON src = node WHERE node NOT IN (SELECT node FROM stop)),
near AS (SELECT root, root AS node FROM r UNION SELECT * FROM l1 UNION SELECT * FROM l2), own AS (SELECT DISTINCT root, string FROM near JOIN str ON nid = node), total AS (SELECT root, sum(length(string)) AS n FROM own GROUP BY root),
size AS (SELECT root, count(*) AS n, (SELECT count(*) FROM e WHERE EXISTS (SELECT 1 FROM near x WHERE x.root = near.root AND x.node = src) AND EXISTS (SELECT 1 FROM near x WHERE x.root = near.root AND x.node = dst)) AS m FROM near GROUP BY root),
sim AS (SELECT a, b, shared / (x.n + y.n - shared) AS similarity FROM (SELECT a, b, sum(length(p.string)) AS shared FROM pair JOIN own p ON p.root = a JOIN own q ON q.root = b AND q.string = p.string WHERE NOT by_label GROUP BY a, b) JOIN total x ON x.root = a JOIN total y ON y.root = b)"""


def two_programs(spark, d):
    """Nodes and edges of two programs; every seventh function is one of a library."""
    docs, k = read(spark, d, "documents"), F.col("doc_id")
    label = F.when(k % 4 < 2, F.concat(F.lit("f"), F.floor(k / 4).cast("string")))
    strings = F.array_distinct(F.filter(F.split("text", r"\. "), lambda s: F.length(s) >= 20))
    nodes = docs.select(k.alias("nid"), label.alias("label"), F.explode_outer(strings).alias("string"))
    called = docs.select(k.alias("src"), F.explode(F.array(k + 2, k + 2 + 2 * (F.col("n_chars") % 5))).alias("dst"))
    edges = called.join(docs.select(k.alias("dst")), "dst", "left_semi").distinct()
    return [x for r in (0, 1) for x in (nodes.where(f"nid % 2 = {r}"), edges.where(f"src % 2 = {r}"))]


def matched_programs(spark, d):
    from kinfold.operators.subgraphs import call_graph_match

    a_nodes, a_edges, b_nodes, b_edges = two_programs(spark, d)
    return call_graph_match(a_nodes, a_edges, b_nodes, b_edges, F.col("nid") % 7 == 0, 2)


@query("WITH " + TWO_PROGRAMS + """ SELECT a, b, true AS by_label, NULL::DOUBLE AS similarity, NULL::BIGINT AS nodes FROM pair WHERE by_label UNION ALL
SELECT a, b, false, round(similarity, 6), CAST(greatest(x.n, y.n) + greatest(x.m, y.m) AS BIGINT) FROM sim JOIN size x ON x.root = a JOIN size y ON y.root = b WHERE similarity >= 0.05""")
def call_graph_match(spark, d):
    """Functions of two programs that match by name or by strings, and how alike their neighbourhoods are."""
    return matched_programs(spark, d).select("a", "b", "by_label", F.round("similarity", 6).alias("similarity"), "nodes")


@query()
def call_graph_bounds(spark, d):
    """Bounds of the edit distance of the neighbourhoods that match by strings; tests hold them against all node maps."""
    return matched_programs(spark, d).where("NOT by_label").select("a", "b", "low", "high", "nodes")


#: Files of five functions each, made from parts, and where they begin: eight lines, and one more for some.
FILES = """loc AS (SELECT p_partkey AS k, p_partkey // 5 AS file, 8 + p_size % 3 AS n FROM part), fn AS (SELECT k, file, 1 + coalesce(sum(n) OVER (PARTITION BY file ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, n FROM loc)"""


def source_files(spark, d):
    """Source files (path, text) and their functions (path, nid, name, line_start, line_end). Comments, strings, declarations
    and members look like calls."""
    p, k, n = read(spark, d, "part"), F.col("p_partkey").cast("string"), F.col("p_size") % 3
    lines = (
        "// helper_#(1) is old", "static int fn_#(int a, struct s *p) {", "  int r = fn_$(a, inner_#(a));  /* no_#(2)", "  neither_#(3) */ printf(\"str(%d)\\n\", r);",
        "  if (check_#(a) && p->method_#(a)) { ns::qual_#(); return last_# (r); }", "  Foo obj_#(3); int decl_#(int); r = a * mul_#(2);", "@define M_#(x) macro_#(x)", "}",
    )
    text = F.concat_ws("\n", *(F.replace(F.replace(F.replace(F.lit(t), F.lit("#"), k), F.lit("$"), (F.col("p_partkey") + 1).cast("string")), F.lit("@"), F.lit("#")) for t in lines), F.when(n > 0, F.repeat(F.lit("\n"), (n - 1).cast("int"))))
    each = p.select(F.floor(F.col("p_partkey") / 5).alias("file"), F.col("p_partkey").alias("k"), text.alias("text"), (8 + n).alias("n"))
    files = each.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n").alias("text"))
    before = Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0)) + 1
    path = F.concat(F.col("file").cast("string"), F.lit(".c"))
    functions = each.select(path.alias("path"), F.col("k").alias("nid"), F.concat(F.lit("fn_"), F.col("k").cast("string")).alias("name"), start.alias("line_start"), (start + F.col("n") - 1).alias("line_end"))
    return files.select(path.alias("path"), "text"), functions


@query("WITH " + FILES + """ SELECT file || '.c' AS path, k AS nid, CAST(s + o AS BIGINT) AS line, replace(replace(name, '#', '' || k), '$', '' || (k + 1)) AS name FROM fn, (VALUES (2, 'fn_$'), (2, 'inner_#'), (3, 'printf'), (4, 'check_#'), (4, 'last_#'), (5, 'mul_#')) c(o, name)""")
def structural_calls(spark, d):
    """Calls in source files with the function around each."""
    return references(*source_files(spark, d)).select("path", "nid", F.col("line").cast("long").alias("line"), "name")


@query("WITH " + FILES + """ SELECT k AS nid, CAST(s + o AS BIGINT) AS line, count(*) AS n FROM fn, (VALUES (1, 'fn'), (1, 'a'), (1, 'p'), (2, 'r'), (2, 'fn'), (2, 'a'), (2, 'inner'), (2, 'a'), (3, 'printf'), (3, 'r'), (4, 'check'), (4, 'a'), (4, 'p'), (4, 'a'), (4, 'qual'), (4, 'last'), (4, 'r'), (5, 'obj'), (5, 'decl'), (5, 'r'), (5, 'a'), (5, 'mul')) c(o, name) GROUP BY k, s, o""")
def structural_names(spark, d):
    """How many names of any kind each line of each function refers to."""
    return references(*source_files(spark, d), mode="all").groupBy("nid", F.col("line").cast("long").alias("line")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)")
def call_references(spark, d):
    """Which function calls which, by their names."""
    return reference_edges(*source_files(spark, d))
