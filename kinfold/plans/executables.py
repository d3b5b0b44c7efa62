"""Queries over whole executables: what a loader makes of them, which functions are embedded, searches from functions on."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions import code as C
from kinfold.functions.network import Network
from kinfold.operators import embedded as E
from kinfold.operators import linkage as L
from kinfold.operators import selection as S
from kinfold.operators.executables import Executables
from kinfold.operators.graph import cut
from kinfold.plans.base import incidence, query, read

#: Five executables whose nodes are parts, in fours each calls the next. Labels are mangled names, symbols of libraries
#: and plain names. A third of the functions is at another address, a seventh has another name.
EXES = """lab AS (SELECT p_partkey AS k, p_size % 5 AS exe, p_name, p_type, regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS b, regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g') || '_' || p_partkey % 40 AS n FROM part),
nd AS (SELECT exe, k AS node, k AS ea, p_name, p_type, CASE k % 8 WHEN 0 THEN 'sub_' || upper(hex(k)) WHEN 1 THEN 'malloc' WHEN 2 THEN '_Znwm' WHEN 3 THEN 'pthread_' || b WHEN 4 THEN '_ZN' || length(b) || b || length(n) || n || 'Ev'
WHEN 5 THEN '_ZN' || length(b) || b || length(n) || n || 'IiE3runEPKci' ELSE n END AS label, CASE WHEN k % 8 = 4 THEN b || '::' || n WHEN k % 8 = 5 THEN b || '::' || n || '<int>::run' WHEN k % 8 > 5 THEN n END AS short FROM lab),
ed AS (SELECT a.exe, a.node AS src, b.node AS dst FROM nd a JOIN nd b ON b.node = a.node + 1 AND b.exe = a.exe AND a.node % 4 <> 3),
fu AS (SELECT exe, ea + CASE WHEN node % 3 = 0 THEN 10000000 ELSE 0 END AS ea, label || CASE WHEN node % 7 = 0 THEN '_x' ELSE '' END AS fname, node AS fid, string_split(p_name || ' ' || p_type || ' of', ' ') AS strings FROM nd),
n1 AS (SELECT exe, ea, fname AS label, min(fid) AS i0 FROM fu GROUP BY exe, ea, fname), n2 AS (SELECT exe, fname AS label, arg_min(fid, {'a': ea, 'b': fid}) AS i1 FROM fu GROUP BY exe, fname), n3 AS (SELECT exe, ea, arg_min(fid, {'a': fname, 'b': fid}) AS i2 FROM fu GROUP BY exe, ea),
nf AS (SELECT exe, node, coalesce(i0, i1, i2) AS fid, CAST(CASE WHEN i0 IS NOT NULL THEN 0 WHEN i1 IS NOT NULL THEN 1 WHEN i2 IS NOT NULL THEN 2 END AS INT) AS step FROM nd LEFT JOIN n1 USING (exe, ea, label) LEFT JOIN n2 USING (exe, label) LEFT JOIN n3 USING (exe, ea)),
lb AS (SELECT exe, label, node FROM nd WHERE NOT (label = 'malloc' OR label LIKE 'sub\\_%' ESCAPE '\\')),
st AS (SELECT DISTINCT nf.exe, s, node FROM nf JOIN (SELECT exe, fid, unnest(strings) AS s FROM fu) USING (exe, fid) WHERE octet_length(encode(s)) > 3),
ft AS (SELECT DISTINCT exe, 'symbol' AS kind, label AS feature FROM lb UNION SELECT DISTINCT exe, 'string', s FROM st WHERE node IN (SELECT node FROM lb)),
bad AS (SELECT exe, node FROM nd WHERE NOT EXISTS (SELECT 1 FROM fu WHERE fu.exe = nd.exe AND fu.ea = nd.ea) AND EXISTS (SELECT 1 FROM fu WHERE fu.exe = nd.exe AND fu.fname = nd.label))"""


def executables(spark, d) -> Executables:
    k = F.col("k")
    simple = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 5).cast("long").alias("exe"), "p_name", "p_type", simple("p_brand").alias("b"), F.concat(simple("p_name"), F.lit("_"), (F.col("p_partkey") % 40).cast("string")).alias("n"))
    part = lambda c: F.concat(F.length(c).cast("string"), F.col(c))
    nested, m = F.concat(F.lit("_ZN"), part("b"), part("n")), k % 8
    label = F.when(m == 0, F.concat(F.lit("sub_"), F.hex(k))).when(m == 1, "malloc").when(m == 2, "_Znwm").when(m == 3, F.concat(F.lit("pthread_"), "b"))
    label = label.when(m == 4, F.concat(nested, F.lit("Ev"))).when(m == 5, F.concat(nested, F.lit("IiE3runEPKci"))).otherwise(F.col("n"))
    nodes = rows.select("exe", k.alias("node"), k.alias("ea"), label.alias("label"), "p_name", "p_type")
    edges = nodes.select("exe", F.col("node").alias("src")).where("src % 4 <> 3").join(nodes.select("exe", (F.col("node") - 1).alias("src"), F.col("node").alias("dst")), ["exe", "src"])
    moved, renamed = F.when(F.col("node") % 3 == 0, 10_000_000).otherwise(0), F.when(F.col("node") % 7 == 0, "_x").otherwise("")
    strings = F.split(F.concat_ws(" ", "p_name", "p_type", F.lit("of")), " ")
    functions = nodes.select("exe", (F.col("ea") + moved).alias("ea"), F.concat("label", renamed).alias("fname"), F.col("node").alias("fid"), strings.alias("strings"))
    return Executables(nodes, edges, functions)


@query("WITH " + EXES + " SELECT exe, node, fid, step FROM nf")
def executable_functions(spark, d):
    return executables(spark, d).node_functions()


@query("WITH " + EXES + " SELECT exe, s, count(*) AS n, min(node) AS first_node FROM st GROUP BY exe, s")
def executable_strings(spark, d):
    return executables(spark, d).strings().groupBy("exe", "s").agg(F.count("*").alias("n"), F.min("node").alias("first_node"))


@query("WITH " + EXES + " SELECT exe, kind, feature FROM ft")
def executable_features(spark, d):
    return executables(spark, d).features()


@query("WITH " + EXES + " SELECT exe, node, short AS name FROM nd WHERE short IS NOT NULL")
def executable_name_set(spark, d):
    """Names as the matching with repositories gets them: filtered, demangled, and operators of the language left out."""
    return executables(spark, d).names()


@query("WITH " + EXES + """, c AS (SELECT exe, 0 AS w FROM nd UNION ALL SELECT exe, 1 FROM ed UNION ALL SELECT exe, 2 FROM nf WHERE fid IS NOT NULL UNION ALL SELECT exe, 3 FROM ft WHERE kind = 'symbol' UNION ALL SELECT exe, 4 FROM ft WHERE kind = 'string' UNION ALL SELECT exe, 5 FROM bad)
SELECT exe, count(*) FILTER (w = 0) AS n_nodes, count(*) FILTER (w = 1) AS n_edges, count(*) FILTER (w = 2) AS n_functions, count(*) FILTER (w = 3) AS n_symbols, count(*) FILTER (w = 4) AS n_strings, count(*) FILTER (w = 5) AS n_incompatible FROM c GROUP BY exe""")
def executable_sizes(spark, d):
    return executables(spark, d).sizes()


#: Functions of source files: ten parts a file, one in eleven without a body, some that don't parse; a node has a debug line
#: but for one in seven, one in six lines is in a file that isn't known, and a file in nine is skipped.
CHOICE = EXES + """, sf AS (SELECT p_partkey AS line, 'f' || p_partkey // 10 || '.c' AS path, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'h' || p_partkey END AS fhash, p_partkey % 13 IN (1, 2) AS err, p_partkey % 13 = 1 AS short, p_retailprice AS mi FROM part), sk AS (SELECT DISTINCT path FROM sf WHERE (line // 10) % 9 = 0),
db AS (SELECT node, CASE WHEN node % 6 = 0 THEN 'lost.c' ELSE 'f' || node // 10 || '.c' END AS path FROM nd WHERE node % 7 <> 0), av AS (SELECT * FROM sf WHERE fhash <> '' AND path NOT IN (SELECT path FROM sk)), ok AS (SELECT * FROM av WHERE NOT short),
an AS (SELECT node, path FROM nd LEFT JOIN db USING (node) WHERE nd.short IS NOT NULL AND coalesce(path, '') NOT IN (SELECT path FROM sk))"""


def sources(spark, d):
    """Functions, debug lines of the nodes, and skipped files."""
    k = F.col("p_partkey")
    path = lambda c: F.concat(F.lit("f"), F.floor(c / 10).cast("string"), F.lit(".c"))
    tokens = F.when(k % 13 == 1, F.array(F.lit("<ERROR>"), F.lit(";"))).when(k % 13 == 2, F.split(F.lit("<ERROR> a b c"), " ")).otherwise(F.split(F.lit("return <id> a <ID> ;"), " "))
    parts = read(spark, d, "part")
    functions = parts.select(path(k).alias("path"), k.alias("line"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("h"), k.cast("string"))).alias("fhash"), tokens.alias("tokens"), F.col("p_retailprice").alias("mi"))
    debug = parts.where(k % 7 != 0).select(k.alias("node"), F.when(k % 6 == 0, "lost.c").otherwise(path(k)).alias("path"))
    return functions, debug, functions.where(F.floor(F.col("line") / 10) % 9 == 0).select("path").distinct()


@query("WITH " + CHOICE + " SELECT 'kept' AS what, path, line FROM ok UNION ALL SELECT 'error', path, line FROM av WHERE short UNION ALL SELECT 'skipped', path, NULL FROM sk")
def all_function_list(spark, d):
    functions, _, skip = sources(spark, d)
    kept, errors, skipped = S.all_functions(functions, skip)
    row = lambda df, what: df.select(F.lit(what).alias("what"), "path", "line")
    return row(kept, "kept").unionByName(row(errors, "error")).unionByName(row(skipped.withColumn("line", F.lit(None).cast("long")), "skipped"))


@query("WITH " + CHOICE + " SELECT path, line FROM (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY mi, line) AS r, count(*) OVER (PARTITION BY path) AS m FROM ok) WHERE r <= ceil(m * 0.15)")
def representative_list(spark, d):
    functions, _, skip = sources(spark, d)
    return S.representative_functions(functions, 0.15, skip)[0].select("path", "line")


@query("WITH " + CHOICE + """ SELECT 'kept' AS what, path, line AS at_ FROM sf WHERE fhash <> '' AND path IN (SELECT path FROM an) UNION ALL SELECT 'left', NULL, node FROM an WHERE path IS NULL OR path NOT IN (SELECT path FROM sf)
UNION ALL SELECT DISTINCT 'skipped', path, CAST(NULL AS BIGINT) FROM nd JOIN db USING (node) WHERE nd.short IS NOT NULL AND path IN (SELECT path FROM sk)""")
def node_function_list(spark, d):
    """Whole files that named nodes point to, the nodes that no file explains, and the skipped files that were met."""
    functions, debug, skip = sources(spark, d)
    e = executables(spark, d)
    kept, left, skipped = S.functions_of_nodes(e.nodes.select("node"), e.names(), debug, functions, skip)
    row = lambda df, what, path, at: df.select(F.lit(what).alias("what"), path.alias("path"), at.alias("at_"))
    none = F.lit(None)
    out = row(kept, "kept", F.col("path"), F.col("line")).unionByName(row(left, "left", none.cast("string"), F.col("node")))
    return out.unionByName(row(skipped, "skipped", F.col("path"), none.cast("long")))


def program_tokens(spark, d):
    """Functions of about 150 kinds: as many branches and loops as the part's size and key give, and its size as a number."""
    k, s = F.col("p_partkey"), F.col("p_size")
    branches = F.repeat(F.lit("if (a > 1) { a = a ? 2 : 3; }\n"), (s % 7).cast("int"))
    loops = F.repeat(F.lit("for (;;) { p->nextItem; break; }\n"), (k % 3).cast("int"))
    text = F.concat(F.lit("int f(int a) {\n"), branches, loops, F.lit("return a + "), s.cast("string"), F.lit(";\n}"))
    rows = read(spark, d, "part").select(k.alias("id"), text.alias("text"))
    # Each text once: there are far fewer than functions. Written, as what is asked of the tokens later would else be asked of each function's text.
    kinds = cut(rows.groupBy("text").agg(F.min("id").alias("first")))
    kinds = cut(kinds.repartition(spark.sparkContext.defaultParallelism, "text").select("first", "text", C.code_tokens("text").alias("tokens")))
    functions = rows.repartition(spark.sparkContext.defaultParallelism, "id").join(L.broadcast_if_small(kinds), "text")
    return functions.select("id", "tokens"), kinds.select(F.col("first").alias("id"), "tokens")


def origins(spark, d):
    """Which repository had a function first."""
    first = F.min(F.struct("ver", "repo"))
    return incidence(spark, d).groupBy(F.col("fid").alias("id")).agg(first.alias("x")).select("id", F.col("x.repo").alias("repo"))


@query()
def embedded_source_query(spark, d):
    """From functions with sources to scores of repositories: tokens, vectors, index and search in one chain."""
    functions, kinds = program_tokens(spark, d)
    # In the order of first appearance: that of a token is in the first function of a kind.
    vocabulary = C.vocabulary(kinds, "id", "tokens").persist()
    embedder = E.Embedder(vocabulary, Network(C.rows_of(vocabulary), 64, 64, 12))
    index = embedder.index(functions, "tokens")
    asked = functions.where("id % 7 <> 3").select(F.col("id").alias("query"), "tokens")
    holds = origins(spark, d)
    return E.source_scores(embedder, index, asked, holds).withColumn("score", F.round("score", 9))


@query()
def embedded_binary_query(spark, d):
    """From instructions of functions that no debug line names to scores of repositories."""
    li = read(spark, d, "lineitem")
    text = F.concat(F.when(F.col("l_returnflag") == "R", "mov rax , [ rbx + 0x").when(F.col("l_returnflag") == "A", "add rcx , [ rax * 8 + 0x").otherwise("lea rdx , [ rsi - 0x"), F.hex((F.col("l_linenumber") * 8).cast("long")), F.lit(" ]"))
    rows = li.select(F.col("l_partkey").alias("ea"), (F.col("l_orderkey") % 4).alias("block_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("addr"), text.alias("text"))
    blocks = C.with_tokens(rows).groupBy("ea", "block_id").agg(F.collect_list(F.struct("addr", "text", "token")).alias("instructions"))
    functions = cut(C.instruction_sequences(blocks, "token").withColumnRenamed("ea", "id"))
    vocabulary = C.vocabulary(functions, "id", "instructions").persist()
    embedder = E.Embedder(vocabulary, Network(C.rows_of(vocabulary), 16, 16, 12, seed=9))
    index = embedder.index(functions, "instructions", "cosine")
    lines = li.where("l_quantity <= 5").select(F.col("l_partkey").alias("query"))
    holds = origins(spark, d)
    return E.binary_scores(embedder, index, functions.withColumnRenamed("id", "query"), lines, holds, 3, 0.99).withColumn("score", F.round("score", 9))
