"""Version histories and the aggregations over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions import text as X
from kinfold.operators import linkage as K
from kinfold.operators import lineage as L
from kinfold.operators import matching as M
from kinfold.plans.catalog import SYMBOLS, symbols
from kinfold.plans.base import EDGE, EVI, INC, TOK, call_edges, incidence, linked_repos, links, LINK, query, read, tokens

LIFE = """ev AS (SELECT user_id AS repo, event_type AS token, CAST(event_id AS BIGINT) AS ver_idx, CASE WHEN event_id % 11 <> 0 THEN CAST(floor(value) AS BIGINT) % 5 END AS fid FROM events),
top AS (SELECT repo, max(ver_idx) AS last_idx FROM ev GROUP BY repo),
life AS (SELECT * FROM (SELECT ev.repo, token, fid, ver_idx AS from_idx, coalesce(lead(ver_idx) OVER (PARTITION BY ev.repo, token ORDER BY ver_idx) - 1, last_idx) AS to_idx FROM ev JOIN top USING (repo)) WHERE fid IS NOT NULL)"""


def histories(spark, d):
    e = read(spark, d, "events")
    fid = F.when(F.col("event_id") % 11 != 0, F.floor("value").cast("long") % 5)
    return e.select(F.col("user_id").alias("repo"), F.col("event_type").alias("token"), F.col("event_id").cast("long").alias("ver_idx"), fid.alias("fid"))


def lives(spark, d):
    ev = histories(spark, d)
    return L.lifetimes(ev, ["repo", "token"], ev.groupBy("repo").agg(F.max("ver_idx").alias("last_idx")))


@query("WITH " + LIFE + " SELECT repo, token, fid, from_idx, to_idx FROM life")
def token_lifetimes(spark, d):
    return lives(spark, d)


@query("WITH " + LIFE + """, f AS (SELECT *, CASE WHEN from_idx <= max(to_idx) OVER (PARTITION BY repo, token, fid ORDER BY from_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM life),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY repo, token, fid ORDER BY from_idx) AS island FROM f) SELECT repo, token, fid, min(from_idx) AS from_idx, max(to_idx) AS to_idx FROM g GROUP BY repo, token, fid, island""")
def lifetime_islands(spark, d):
    return L.islands(lives(spark, d), ["repo", "token"])


@query("WITH " + LIFE + " SELECT repo, token, fid, min(ver_idx) AS ver_idx FROM ev WHERE fid IS NOT NULL GROUP BY repo, token, fid")
def first_seen(spark, d):
    return L.first_seen(histories(spark, d), ["repo", "token"])


DEL = "st AS (SELECT DISTINCT l_suppkey AS path, l_orderkey % 200 AS ver_idx, l_partkey % 500 AS token FROM lineitem), tc AS (SELECT DISTINCT path, ver_idx FROM st), b AS (SELECT path, ver_idx, lag(ver_idx) OVER (PARTITION BY path ORDER BY ver_idx) AS prior FROM tc)"


@query("WITH " + DEL + " SELECT b.ver_idx, st.token FROM b JOIN st ON st.path = b.path AND st.ver_idx = b.prior EXCEPT SELECT ver_idx, token FROM st")
def deleted_tokens(spark, d):
    st = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("path"), (F.col("l_orderkey") % 200).alias("ver_idx"), (F.col("l_partkey") % 500).alias("token")).distinct()
    return L.deletions(st, ["token"], st.select("path", "ver_idx").distinct())


TAGS = "tags AS (SELECT o_custkey AS repo, 'v' || o_orderkey AS tag, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders)"


def tags(spark, d):
    return read(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("tag"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))


@query("WITH " + TAGS + " SELECT repo, tag, CAST(n AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY date DESC, tag DESC) AS n FROM tags) WHERE n <= 3")
def newest_tags(spark, d):
    return L.ranked_tags(tags(spark, d), 3).select("repo", "tag", "n")


@query("WITH " + TAGS + " SELECT repo, tag, CAST(n AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY date, tag) AS n FROM tags) WHERE n <= 3")
def oldest_tags(spark, d):
    return L.ranked_tags(tags(spark, d), 3, newest=False).select("repo", "tag", "n")


@query("WITH " + TAGS + ", t AS (SELECT repo, min(date) AS t FROM tags WHERE repo % 2 = 0 GROUP BY repo) SELECT c_custkey AS repo, coalesce(t, CASE WHEN c_custkey % 3 = 0 THEN '1990-01-01' END) AS created FROM customer LEFT JOIN t ON repo = c_custkey")
def repo_created(spark, d):
    repos = read(spark, d, "customer").select(F.col("c_custkey").alias("repo"))
    commits = repos.where("repo % 3 = 0").withColumn("date", F.lit("1990-01-01"))
    return L.created(repos, tags(spark, d).where("repo % 2 = 0"), commits)


#: Versions of files: which functions they hold; a file of a version may be removed, and not all files are sources.
STATE = """lst AS (SELECT CASE WHEN l_suppkey % 9 = 0 THEN l_suppkey || '.py' ELSE l_suppkey || '.c' END AS path, l_orderkey % 50 AS ver_idx, l_partkey % 500 AS token, l_linenumber AS fid, (l_suppkey + l_orderkey % 50) % 10 = 0 AS removed FROM lineitem),
tc AS (SELECT DISTINCT path, ver_idx FROM lst WHERE path LIKE '%.c'), st AS (SELECT DISTINCT path, ver_idx, token, fid FROM lst WHERE path LIKE '%.c' AND NOT removed), b AS (SELECT path, ver_idx, lag(ver_idx) OVER (PARTITION BY path ORDER BY ver_idx) AS prior FROM tc),
o AS (SELECT b.ver_idx, st.token, count(DISTINCT fid) AS old FROM b JOIN st ON st.path = b.path AND st.ver_idx = b.prior GROUP BY b.ver_idx, st.token), w AS (SELECT ver_idx, token, count(DISTINCT fid) AS new FROM st GROUP BY ver_idx, token), ts AS (SELECT ver_idx, token, coalesce(old, 0) AS old, coalesce(new, 0) AS new FROM o FULL JOIN w USING (ver_idx, token))"""


def file_states(spark, d):
    li = read(spark, d, "lineitem")
    name = F.concat(F.col("l_suppkey").cast("string"), F.when(F.col("l_suppkey") % 9 == 0, ".py").otherwise(".c"))
    ver = F.col("l_orderkey") % 50
    rows = li.select(name.alias("path"), ver.alias("ver_idx"), (F.col("l_partkey") % 500).alias("token"), F.col("l_linenumber").alias("fid"), ((F.col("l_suppkey") + ver) % 10 == 0).alias("removed"))
    return rows.where("NOT removed").drop("removed").distinct(), rows.select("path", "ver_idx").distinct()


@query("WITH " + STATE + """, e AS (SELECT DISTINCT token, ver_idx, CAST(fid AS BIGINT) AS fid FROM st UNION ALL SELECT token, ver_idx, NULL FROM ts WHERE old > 0 AND new = 0), r AS (SELECT token, ver_idx, lead(ver_idx) OVER (PARTITION BY token ORDER BY ver_idx) AS nxt FROM (SELECT DISTINCT token, ver_idx FROM e))
SELECT token, fid, ver_idx AS from_idx, coalesce(nxt - 1, 49) AS to_idx FROM e JOIN r USING (token, ver_idx) WHERE fid IS NOT NULL""")
def version_replay(spark, d):
    """Lifetimes of all functions from the files that each version changed or removed."""
    state, touched = file_states(spark, d)
    return L.replay(state, ["token"], touched, X.is_source_path(F.col("path")), 49)


@query("SELECT name AS identifier, count(*) AS n FROM (WITH " + TOK + " SELECT DISTINCT repo, name, scope FROM tok) GROUP BY name")
def identifier_counts(spark, d):
    return K.identifier_counts(tokens(spark, d))


@query("SELECT name AS identifier FROM (WITH " + TOK + " SELECT DISTINCT repo, name, scope FROM tok) GROUP BY name HAVING count(*) > 100")
def common_identifiers(spark, d):
    return K.common_identifiers(tokens(spark, d))


@query("WITH t AS (SELECT p_partkey AS nid, 'ns::' || p_brand || '::' || p_size AS scope FROM part), x AS (SELECT nid, unnest(list_transform(range(1, len(string_split(scope, '::')) + 1), lambda i: array_to_string(string_split(scope, '::')[:i], '::'))) AS p FROM t) SELECT p AS prefix, count(*) AS n, CAST(sum(len(string_split(p, '::'))) AS BIGINT) AS depth FROM x GROUP BY p")
def namespace_counts(spark, d):
    scope = F.concat(F.lit("ns::"), "p_brand", F.lit("::"), F.col("p_size").cast("string"))
    x = read(spark, d, "part").select(F.explode(X.prefixes(scope, whole=True)).alias("prefix"))
    return x.groupBy("prefix").agg(F.count("*").alias("n"), F.sum(F.size(F.split("prefix", "::"))).alias("depth"))


@query("WITH " + LINK + ", e AS (SELECT evi.src, evi.dst, fid FROM evi JOIN link USING (src, dst) UNION ALL SELECT dst, src, fid FROM evi JOIN link USING (src, dst) WHERE (src + dst) % 3 = 0), o AS (SELECT DISTINCT src, dst FROM e EXCEPT SELECT DISTINCT dst, src FROM e) SELECT e.src AS repo, count(DISTINCT fid) AS with_bi, count(DISTINCT CASE WHEN o.src IS NOT NULL THEN fid END) AS one_way FROM e LEFT JOIN o USING (src, dst) GROUP BY e.src")
def reused_functions(spark, d):
    found = links(spark, d)
    rows = K.evidence_of(found, incidence(spark, d, linked_repos(found)))
    back = rows.where("(src + dst) % 3 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "fid")
    return K.reused(rows.select("src", "dst", "fid").unionByName(back).withColumnRenamed("fid", "key"))


@query("WITH " + INC + """, own AS (SELECT repo, fid FROM inc WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = repo AND l_partkey = fid AND l_returnflag = 'R')), e AS (SELECT a.repo, a.fid AS src, b.fid AS dst FROM inc a JOIN inc b ON a.repo = b.repo AND b.fid % 97 = a.fid % 97 AND a.fid < b.fid),
oe AS (SELECT e.repo, count(*) AS n FROM e JOIN own x ON x.repo = e.repo AND x.fid = src JOIN own y ON y.repo = e.repo AND y.fid = dst GROUP BY e.repo) SELECT repo, count(DISTINCT fid % 300) AS num_fhash, count(*) AS num_nodes, coalesce((SELECT count(*) FROM e WHERE e.repo = inc.repo), 0) AS num_edges, (SELECT count(*) FROM own WHERE own.repo = inc.repo) AS num_trimmed_nodes, coalesce((SELECT n FROM oe WHERE oe.repo = inc.repo), 0) AS num_trimmed_edges FROM inc GROUP BY repo""")
def repo_statistics(spark, d):
    one = incidence(spark, d)
    nodes = one.select("repo", F.col("fid").alias("nid"), (F.col("fid") % 300).alias("fid"))
    a, b = one.select("repo", F.col("fid").alias("src"), (F.col("fid") % 97).alias("m")), one.select("repo", F.col("fid").alias("dst"), (F.col("fid") % 97).alias("m"))
    edges = a.join(b, ["repo", "m"]).where("src < dst").select("repo", "src", "dst")
    borrowed = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("repo"), F.col("l_partkey").alias("nid"))
    return K.repo_statistics(nodes, edges, borrowed)


@query("WITH " + INC + " SELECT fid, min(ver) AS created, count(*) AS n FROM inc GROUP BY fid")
def function_created(spark, d):
    return incidence(spark, d).groupBy("fid").agg(F.min("ver").alias("created"), F.count("*").alias("n"))


@query("SELECT l_partkey AS nid, string_agg(DISTINCT l_linenumber, ',' ORDER BY l_linenumber) AS versions FROM lineitem GROUP BY l_partkey")
def versions_of_node(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("nid")).agg(F.array_join(F.array_sort(F.collect_set("l_linenumber")), ",").alias("versions"))


@query("SELECT p_name AS fname, count(*) AS n, string_agg(p_partkey, ',' ORDER BY p_partkey) AS tokens FROM part GROUP BY p_name")
def name_groups(spark, d):
    return read(spark, d, "part").groupBy(F.col("p_name").alias("fname")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("p_partkey")), ",").alias("tokens"))


@query("SELECT l_linenumber * 1000 + l_orderkey % 1000 AS fid, string_agg(DISTINCT l_partkey, ',' ORDER BY l_partkey) AS tokens FROM lineitem GROUP BY 1")
def body_tokens(spark, d):
    """Tokens of each body."""
    rows = read(spark, d, "lineitem").select((F.col("l_linenumber") * 1000 + F.col("l_orderkey") % 1000).alias("fid"), "l_partkey")
    return rows.groupBy("fid").agg(F.array_join(F.array_sort(F.collect_set("l_partkey")), ",").alias("tokens"))


@query("WITH " + EDGE + " SELECT p_name AS callee, string_agg(DISTINCT src, ',' ORDER BY src) AS callers FROM edge JOIN part ON p_partkey = dst GROUP BY p_name")
def name_callers(spark, d):
    """Callers of each name."""
    names = read(spark, d, "part").select(F.col("p_partkey").alias("dst"), F.col("p_name").alias("callee"))
    return call_edges(spark, d).join(names, "dst").groupBy("callee").agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("callers"))


@query("WITH " + STATE + " SELECT ver_idx, token, old, new FROM ts")
def token_states(spark, d):
    state, touched = file_states(spark, d)
    source = X.is_source_path(F.col("path"))
    return L.token_states(state.where(source), ["token"], touched.where(source))


@query("WITH " + TOK + ", own AS (SELECT * FROM tok WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = repo AND l_partkey = nid AND l_returnflag = 'R') AND scope IS NOT NULL), x AS (SELECT repo, 'ns::' || scope AS s FROM own) SELECT DISTINCT repo, p FROM (SELECT repo, 'ns' AS p FROM x UNION ALL SELECT repo, s FROM x)")
def own_namespaces(spark, d):
    marks = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("repo"), F.col("l_partkey").alias("nid")).distinct()
    own = tokens(spark, d).join(marks, ["repo", "nid"], "left_anti").where("scope IS NOT NULL")
    return own.select("repo", F.explode(X.prefixes(F.concat(F.lit("ns::"), "scope"), whole=True)).alias("p")).distinct()


@query("""WITH a AS (SELECT doc_id, list_distinct(string_split(text, ' ')) AS s FROM documents WHERE text IS NOT NULL), p AS (SELECT x.doc_id, x.s AS x, y.s AS y FROM a x JOIN a y ON y.doc_id = x.doc_id // 2),
c AS (SELECT doc_id, list_intersect(x, y) AS i, list_distinct(x || y) AS u FROM p) SELECT doc_id, round(len(i) / len(u), 6) AS jaccard, round(coalesce(list_sum(list_transform(i, lambda s: length(s))), 0) / nullif(list_sum(list_transform(u, lambda s: length(s))), 0), 6) AS weighted FROM c""")
def jaccard(spark, d):
    a = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_distinct(F.split("text", " ")).alias("x"))
    p = a.join(a.select(F.col("doc_id").alias("h"), F.col("x").alias("y")), F.floor(F.col("doc_id") / 2) == F.col("h"))
    i, u = F.array_intersect("x", "y"), F.array_union("x", "y")
    size = lambda s: F.aggregate(s, F.lit(0), lambda t, w: t + F.length(w))
    return p.select("doc_id", F.round(F.size(i) / F.size(u), 6).alias("jaccard"), F.round(size(i) / F.nullif(size(u), F.lit(0)), 6).alias("weighted"))


@query("WITH " + SYMBOLS + """, r AS (SELECT p_brand AS pair, name, p_partkey % 3 = 0 AS by_label, p_size / 50 AS similarity, p_partkey % 30 AS low, (p_partkey * 7) % 40 AS high, p_size + 5 AS nodes FROM sym JOIN part ON id = p_partkey), k AS (SELECT * FROM r WHERE NOT (name LIKE 'std::%' OR name IN ('__cxa_throw', 'operator new')) AND (by_label OR similarity >= 0.5))
SELECT pair, CAST(sum(CASE WHEN by_label THEN 0 ELSE least(low, high) END) AS BIGINT) AS low, CAST(sum(CASE WHEN by_label THEN 0 ELSE high END) AS BIGINT) AS high, CAST(sum(CASE WHEN by_label THEN 1 ELSE nodes END) AS BIGINT) AS nodes, count(*) AS roots FROM k GROUP BY pair""")
def match_rollup(spark, d):
    k = F.col("p_partkey")
    rows = symbols(spark, d).join(read(spark, d, "part"), F.col("id") == k).select(F.col("p_brand").alias("pair"), "name", (k % 3 == 0).alias("by_label"), (F.col("p_size") / 50).alias("similarity"), (k % 30).alias("low"), ((k * 7) % 40).alias("high"), (F.col("p_size") + 5).alias("nodes"))
    n = F.col("name")
    return M.roll_up(rows, X.is_std(n) | X.is_compiler_symbol(n) | X.is_native_support(n))


@query("SELECT source, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, CAST(sum(len(string_split(text, '. '))) AS BIGINT) AS functions FROM documents GROUP BY source")
def file_counters(spark, d):
    n = lambda s: F.sum(F.size(F.split("text", s)))
    return read(spark, d, "documents").where("text IS NOT NULL").groupBy("source").agg(F.count("*").alias("files"), n("\n").alias("lines"), n(r"\. ").alias("functions"))
