"""Sources, catalogue lookups, predicates and native text kernels over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions import text as X
from kinfold.operators import lineage as L
from kinfold.operators import linkage as K
from kinfold.operators import matching as M
from kinfold.operators.graph import cut
from kinfold.operators.lineage import assign_fids
from kinfold.plans.base import BODY, EDGE, INC, TOK, bodies, call_edges, day, incidence, query, read, tokens
from kinfold.sources import readers as R
from kinfold.sources import snapshots as S

SYMBOLS = """sym AS (SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN 'sub_' || upper(hex(p_partkey)) WHEN 1 THEN 'malloc' WHEN 2 THEN 'pthread_' || p_brand WHEN 3 THEN 'std::' || p_brand
WHEN 4 THEN p_brand || '::~' || p_brand WHEN 5 THEN '__cxa_throw' WHEN 6 THEN 'posix_' || p_name WHEN 7 THEN 'operator new' WHEN 8 THEN 'ns::' || p_brand || '::' || p_name WHEN 9 THEN p_name || '.part.0' WHEN 10 THEN p_brand || '<int, ' || p_name || '>::run' ELSE p_name END AS name FROM part)"""


def symbols(spark, d):
    """Names of all kinds, made from parts."""
    k, b, n = F.col("p_partkey"), F.col("p_brand"), F.col("p_name")
    m = k % 12
    c = F.concat
    name = (
        F.when(m == 0, c(F.lit("sub_"), F.hex(k))).when(m == 1, "malloc").when(m == 2, c(F.lit("pthread_"), b)).when(m == 3, c(F.lit("std::"), b)).when(m == 4, c(b, F.lit("::~"), b)).when(m == 5, "__cxa_throw")
        .when(m == 6, c(F.lit("posix_"), n)).when(m == 7, "operator new").when(m == 8, c(F.lit("ns::"), b, F.lit("::"), n)).when(m == 9, c(n, F.lit(".part.0"))).when(m == 10, c(b, F.lit("<int, "), n, F.lit(">::run"))).otherwise(n)
    )
    return read(spark, d, "part").select(k.alias("id"), name.alias("name"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def table_scan(spark, d):
    return R.read_table(spark, f"{d}/nation.parquet")


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def cached_scan(spark, d):
    with R.cached_table(spark, f"{d}/nation.parquet") as nation:
        found = nation.join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
        # Computed while the table is held: what is returned doesn't read it again.
        return cut(found)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_scan(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_rows(spark, d):
    """Records written as JSON files and read again by a schema."""
    path = R.scratch(spark, "json")
    R.write_json(read(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k long").alias("props")), path)
    return R.read_json(spark, path, "event_id long, event_type string, props struct<k: long>").select("event_id", "event_type", "props.k")


@query("SELECT p_partkey AS fid, p_name AS body FROM part")
def function_table(spark, d):
    return R.unique_key(read(spark, d, "part").select(F.col("p_partkey").alias("fid"), F.col("p_name").alias("body")), "fid")


@query("SELECT p_partkey AS fid, p_name AS body FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity <= 3)")
def point_lookup(spark, d):
    fids = read(spark, d, "lineitem").where("l_quantity <= 3").select(F.col("l_partkey").alias("fid"))
    return R.lookup(read(spark, d, "part").select(F.col("p_partkey").alias("fid"), F.col("p_name").alias("body")), fids, "fid")


@query("SELECT chunk, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_partkey, CAST(floor((row_number() OVER (ORDER BY p_partkey) - 1) / 100) AS BIGINT) AS chunk FROM part) GROUP BY chunk")
def value_chunks(spark, d):
    return R.chunked(read(spark, d, "part").select("p_partkey"), "p_partkey").groupBy("chunk").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("SELECT vec_id AS fid, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def vector_matrix(spark, d):
    """Vectors written as matrix files, one for each partition, and read again."""
    path = R.scratch(spark, "matrix")
    R.write_matrix(read(spark, d, "embeddings").select(F.col("vec_id").alias("fid"), F.col("embedding").alias("vec")), path)
    v = F.col("vec")
    return R.read_matrix(spark, path).select("fid", F.size(v).cast("long").alias("dim"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("SELECT DISTINCT l_suppkey AS repo FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def allowed_repos(spark, d):
    allowed = read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("repo"))
    return incidence(spark, d).select("repo").distinct().join(allowed, "repo", "left_semi")


@query("""WITH l AS (SELECT CASE WHEN event_id % 3 = 0 THEN event_type END AS c, event_type AS path, event_id AS line_no, CASE WHEN event_id % 97 = 96 THEN NULL ELSE event_id % 500 END AS line FROM events WHERE event_type <> 'click' OR event_id % 3 <> 0),
p AS (SELECT 'C' AS language, path, line_no, line FROM l WHERE path <> 'click' UNION ALL SELECT 'C++', path, line_no, line FROM l WHERE path = 'click'), b AS (SELECT *, min(CASE WHEN line IS NULL THEN line_no END) OVER (PARTITION BY path) AS bad FROM p) SELECT language, path AS file, 'f' || line_no AS name, line FROM b WHERE bad IS NULL OR line_no < bad""")
def ctags_lines(spark, d):
    """The C parser's records, and the C++ parser's for files in which that found none."""
    both = ctags_source(spark, d).where("path <> 'click' OR line_no % 3 <> 0")
    return R.first_language(both.where("path <> 'click'"), both).select("language", "file", "name", "line")


@query("""SELECT o_orderkey AS line_no, o_orderstatus AS tag, strftime(o_orderdate, '%Y-%m-%d') || ' 10:00:00' AS date FROM orders
UNION ALL SELECT o_orderkey, 'v' || o_custkey, strftime(o_orderdate, '%Y-%m-%d') || ' 10:00:00' FROM orders""")
def tag_date_lines(spark, d):
    o = read(spark, d, "orders")
    value = F.concat(day(F.col("o_orderdate")), F.lit(" 10:00:00 +0000  (tag: "), F.col("o_orderstatus"), F.lit(", tag: v"), F.col("o_custkey").cast("string"), F.lit(")"))
    return R.tag_dates(o.select(F.lit("t").alias("path"), F.col("o_orderkey").alias("line_no"), value.alias("value"))).select("line_no", "tag", F.substring("date", 1, 19).alias("date"))


@query("SELECT p_partkey AS ea, 'f' || p_size AS name, p_partkey % 3 = 0 AS external FROM part")
def dumped_symbols(spark, d):
    value = F.concat(F.lower(F.hex("p_partkey")), F.lit(" <f"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "@plt").otherwise(""), F.lit(">:"))
    return R.dumped_symbols(read(spark, d, "part").select(value.alias("value")))


@query("SELECT p_partkey AS id, p_partkey AS ea FROM part")
def disassembly_addresses(spark, d):
    path = F.concat(F.lit("data/bin/"), F.lower(F.hex("p_partkey")), F.lit(".graph"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), R.address_of_path(path).alias("ea"))


@query("SELECT s_suppkey AS exe, s_name AS graph, s_nationkey AS info FROM supplier")
def paired_query_set(spark, d):
    s = read(spark, d, "supplier")
    return R.paired(s.select(F.col("s_suppkey").alias("exe"), F.col("s_name").alias("graph")), s.select(F.col("s_suppkey").alias("exe"), F.col("s_nationkey").alias("info")), "exe")


@query("SELECT 'd' || doc_id AS id, md5(text) AS digest FROM documents UNION ALL SELECT 'b' || item_id, md5(text) FROM benchmark UNION ALL SELECT 'c' || conv_id || '.' || turn, md5(text) FROM conversations")
def training_union(spark, d):
    turn = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"))
    sources = [(f"{d}/documents.parquet", F.concat(F.lit("d"), F.col("doc_id").cast("string"))), (f"{d}/benchmark.parquet", F.concat(F.lit("b"), F.col("item_id").cast("string"))), (f"{d}/conversations.parquet", turn)]
    return R.concatenated(spark, [(path, {"id": key, "text": F.col("text")}) for path, key in sources]).select("id", F.md5("text").alias("digest"))


SIGNATURES = "SELECT l_suppkey AS repo, l_partkey || '' AS hash, string_agg(DISTINCT l_linenumber, ',' ORDER BY l_linenumber) AS vers FROM lineitem GROUP BY l_suppkey, l_partkey"


@query(SIGNATURES)
def component_export(spark, d):
    """Signatures of every repository as JSON files by repository, read back."""
    holds = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("repo"), F.col("l_partkey").alias("fid"), F.col("l_linenumber").alias("ver"))
    path = R.scratch(spark, "signatures")
    R.write_json(L.signatures(holds).select("repo", "sig.*"), path, by=("repo",))
    return R.read_json(spark, path, "hash string, vers array<string>, repo long").select("repo", "hash", F.array_join("vers", ",").alias("vers"))


@query("SELECT o_custkey AS repo, strftime(o_orderdate, '%Y-%m-%d') AS ver, (dense_rank() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d')) - 1) || '' AS idx FROM orders".replace("SELECT o_custkey", "SELECT DISTINCT o_custkey"))
def component_versions(spark, d):
    holds = read(spark, d, "orders").select(F.col("o_custkey").alias("repo"), day(F.col("o_orderdate")).alias("ver"))
    return L.version_index(holds).select("repo", "idx.*")


@query("WITH " + EDGE + ", n AS (SELECT src AS node FROM edge UNION SELECT dst FROM edge) SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM edge) AS n_edges")
def executable_size(spark, d):
    e = call_edges(spark, d)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return nodes.agg(F.count("*").alias("n_nodes")).withColumn("n_edges", e.agg(F.count("*")).scalar())


@query("""WITH f AS (SELECT l_suppkey AS path, l_linenumber AS line, l_partkey AS fid, l_orderkey AS pos FROM lineitem), n AS (SELECT DISTINCT l_suppkey AS path FROM lineitem WHERE l_quantity <= 1)
SELECT path, line, fid FROM (SELECT path, line, fid, row_number() OVER (PARTITION BY path, line ORDER BY pos DESC, fid DESC) AS r FROM f WHERE path IN (SELECT path FROM n)) WHERE r = 1""")
def debug_functions(spark, d):
    li = read(spark, d, "lineitem")
    functions = li.select(F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("fid"), F.col("l_orderkey").alias("pos"))
    return M.functions_of_files(li.where("l_quantity <= 1").select(F.col("l_suppkey").alias("path")), functions)


INFOS = "info AS (SELECT 'h' || l_partkey AS fhash, l_suppkey || '.c' AS path, l_orderkey % 1000 AS line FROM lineitem), at_ AS (SELECT path, line, max(fhash) AS fhash FROM info GROUP BY path, line)"


def hash_infos(spark, d):
    """A hash index: where each digest stands; some paths begin with slashes."""
    path = F.concat(F.when(F.col("l_quantity") > 25, "//").otherwise(""), F.col("l_suppkey").cast("string"), F.lit(".c"))
    rows = read(spark, d, "lineitem").select(F.concat(F.lit("h"), F.col("l_partkey").cast("string")).alias("fhash"), F.struct(path.alias("path"), (F.col("l_orderkey") % 1000).alias("line")).alias("info"))
    return rows.groupBy("fhash").agg(F.collect_list("info").alias("infos"))


@query("WITH " + INFOS + " SELECT * FROM at_")
def hash_index(spark, d):
    return M.hash_positions(hash_infos(spark, d))


@query("WITH " + INFOS + ", p AS (SELECT (o_custkey % 100) || '.c' AS path, o_orderkey % 1200 AS line FROM orders), n AS (SELECT fhash, count(*) AS places FROM info GROUP BY fhash) SELECT path, line, fhash, coalesce(places, 0) AS places FROM p LEFT JOIN at_ USING (path, line) LEFT JOIN n USING (fhash)")
def hash_path_lookup(spark, d):
    positions = read(spark, d, "orders").select(F.concat(F.lit("/"), (F.col("o_custkey") % 100).cast("string"), F.lit(".c")).alias("path"), (F.col("o_orderkey") % 1200).alias("line"))
    return M.implementations_at(positions, hash_infos(spark, d))


@query(r"""SELECT page_id, regexp_matches(path, '(\.c|\.cc|\.cpp|\.cxx|\.h|\.hxx|\.hpp|\.H|\.HPP|\.inl)$') AND len(list_intersect(string_split(path, '/'),
['test','tests','test.c','tests.c','example','examples','example.c','examples.c','demo','docs','doc','documents','document'])) = 0 AS valid
FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '/src/a.c' WHEN 1 THEN '/docs/b.cpp' ELSE '/x.py' END AS path FROM pages)""")
def source_files(spark, d):
    k = F.col("page_id") % 3
    path = F.concat("url", F.when(k == 0, "/src/a.c").when(k == 1, "/docs/b.cpp").otherwise("/x.py"))
    return read(spark, d, "pages").select("page_id", X.is_source_path(path).alias("valid"))


@query("WITH " + SYMBOLS + r""" SELECT id, regexp_full_match(name, 'sub_[0-9A-F]+') AS generated, name IN ('malloc') AS libc, name IN ('__cxa_throw') AS compiler, name = 'operator new' AS native, name LIKE 'pthread\_%' ESCAPE '\' OR name LIKE 'posix\_%' ESCAPE '\' AS posix,
name LIKE 'std::%' AS std, string_split(name, '::')[-1] LIKE '~%' AS destructor FROM sym""")
def symbol_predicates(spark, d):
    n = F.col("name")
    return symbols(spark, d).select("id", X.is_generated_symbol(n).alias("generated"), X.is_libc_symbol(n).alias("libc"), X.is_compiler_symbol(n).alias("compiler"), X.is_native_support(n).alias("native"), X.is_thread_or_posix(n).alias("posix"), X.is_std(n).alias("std"), X.is_destructor(n).alias("destructor"))


FILTERED = r"regexp_full_match(name, 'sub_[0-9A-F]+') OR name IN ('malloc', '__cxa_throw', 'operator new') OR name LIKE '__cxa\_%' ESCAPE '\' OR name LIKE 'pthread\_%' ESCAPE '\' OR name LIKE 'posix\_%' ESCAPE '\' OR name LIKE 'std::%'"


@query("WITH " + SYMBOLS + " SELECT id, name FROM sym WHERE NOT (" + FILTERED + ")")
def filtered_symbols(spark, d):
    return symbols(spark, d).where(~X.is_filtered_function(F.col("name")))


@query("WITH " + SYMBOLS + " SELECT DISTINCT CASE WHEN contains(name, '.') THEN string_split(name, '.')[1] ELSE name END AS name FROM sym WHERE NOT (" + FILTERED + ")")
def executable_names(spark, d):
    n = F.col("name")
    return symbols(spark, d).where(~X.is_filtered_function(n)).select(X.without_suffix(n).alias("name")).distinct()


@query("WITH " + SYMBOLS + " SELECT name AS label, count(*) AS n, string_agg(id, ',' ORDER BY id) AS nodes FROM sym GROUP BY name")
def label_index(spark, d):
    return symbols(spark, d).groupBy(F.col("name").alias("label")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("nodes"))


@query("SELECT doc_id, s, octet_length(encode(s)) AS size FROM (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS s FROM documents) WHERE octet_length(encode(s)) > 3")
def string_features(spark, d):
    s = F.array_distinct(F.filter(F.split("text", " "), lambda x: F.octet_length(x) > 3))
    return read(spark, d, "documents").select("doc_id", F.explode(s).alias("s")).select("doc_id", "s", F.octet_length("s").cast("long").alias("size"))


@query("""WITH i AS (SELECT l_partkey AS ea, 'f' || l_suppkey AS label, l_orderkey AS info FROM lineitem), n AS (SELECT o_orderkey AS node, o_orderkey % 3000 AS ea, 'f' || (o_custkey % 150) AS label FROM orders),
k AS (SELECT ea, label, min(info) AS i0 FROM i GROUP BY ea, label), l AS (SELECT label, first(info ORDER BY ea, info) AS i1 FROM i GROUP BY label), a AS (SELECT ea, first(info ORDER BY label, info) AS i2 FROM i GROUP BY ea)
SELECT node, coalesce(i0, i1, i2) AS info, CASE WHEN i0 IS NOT NULL THEN 0 WHEN i1 IS NOT NULL THEN 1 WHEN i2 IS NOT NULL THEN 2 END AS step FROM n LEFT JOIN k USING (ea, label) LEFT JOIN l USING (label) LEFT JOIN a USING (ea)""")
def node_info_fallback(spark, d):
    infos = read(spark, d, "lineitem").select(F.col("l_partkey").alias("ea"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("label"), F.col("l_orderkey").alias("info"))
    nodes = read(spark, d, "orders").select(F.col("o_orderkey").alias("node"), (F.col("o_orderkey") % 3000).alias("ea"), F.concat(F.lit("f"), (F.col("o_custkey") % 150).cast("string")).alias("label"))
    return M.node_info(nodes, infos)


@query("WITH " + TOK + """, h AS (SELECT repo, nid, nid % 200 AS fid FROM tok), n AS (SELECT DISTINCT l_suppkey AS repo, l_partkey AS nid FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <= 5), f AS (SELECT DISTINCT l_suppkey AS repo, l_partkey % 200 AS fid FROM lineitem WHERE l_quantity <= 1),
w AS (SELECT DISTINCT h.repo, fid FROM h JOIN n ON n.repo = h.repo AND n.nid = h.nid) SELECT h.repo, h.nid, h.fid, n.nid IS NOT NULL AS by_node, f.fid IS NOT NULL AS by_function, f.fid IS NOT NULL OR w.fid IS NOT NULL AS weak
FROM h LEFT JOIN n ON n.repo = h.repo AND n.nid = h.nid LEFT JOIN f ON f.repo = h.repo AND f.fid = h.fid LEFT JOIN w ON w.repo = h.repo AND w.fid = h.fid""")
def borrowed_nodes(spark, d):
    li = read(spark, d, "lineitem")
    holds = tokens(spark, d).select("repo", "nid", (F.col("nid") % 200).alias("fid"))
    nodes = li.where("l_returnflag = 'R' AND l_quantity <= 5").select(F.col("l_suppkey").alias("repo"), F.col("l_partkey").alias("nid"))
    return K.borrowed_functions(holds, nodes, li.where("l_quantity <= 1").select(F.col("l_suppkey").alias("repo"), (F.col("l_partkey") % 200).alias("fid")))


@query("SELECT doc_id FROM documents WHERE len(text) > 0 AND NOT (len(string_split(text, ' ')) <= 3 AND contains(text, '<ERROR>'))")
def parsed_bodies(spark, d):
    t = F.split("text", " ")
    return read(spark, d, "documents").where(F.col("text") != "").where(~((F.size(t) <= 3) & F.array_contains(t, "<ERROR>"))).select("doc_id")


@query("SELECT repo, fid, repo NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) AS kept FROM (SELECT DISTINCT l_suppkey AS repo, l_partkey AS fid FROM lineitem)")
def skipped_paths(spark, d):
    skip = read(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("repo"))
    rows = incidence(spark, d).select("repo", "fid")
    return rows.join(skip, "repo", "left_anti").withColumn("kept", F.lit(True)).unionByName(rows.join(skip, "repo", "left_semi").withColumn("kept", F.lit(False)))


@query("WITH " + SYMBOLS + " SELECT id FROM sym WHERE NOT (" + FILTERED + ") AND id NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipmode_ok) ".replace("l_shipmode_ok", "l_quantity <= 3"))
def functions_without_lines(spark, d):
    lines = read(spark, d, "lineitem").where("l_quantity <= 3").select(F.col("l_partkey").alias("id")).distinct()
    return symbols(spark, d).where(~X.is_filtered_function(F.col("name"))).join(lines, "id", "left_anti").select("id")


@query("SELECT p_partkey AS ea, f.path AS path, f.line AS line, s.name AS function FROM part LEFT JOIN (SELECT l_partkey AS ea, min(l_suppkey) AS path, min(l_linenumber) AS line FROM lineitem GROUP BY l_partkey) f ON ea = p_partkey LEFT JOIN (SELECT s_suppkey AS path, s_name AS name FROM supplier WHERE s_acctbal > 0) s USING (path)")
def debug_lookup(spark, d):
    lines = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("ea")).agg(F.min("l_suppkey").alias("path"), F.min("l_linenumber").alias("line"))
    names = read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("path"), F.col("s_name").alias("function"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("ea")).join(lines, "ea", "left").join(names, "path", "left").select("ea", "path", "line", "function")


@query("WITH " + SYMBOLS + " SELECT id, coalesce(s_name, name) AS name FROM sym LEFT JOIN supplier ON id = s_suppkey")
def renamed_symbols(spark, d):
    new = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("new"))
    return symbols(spark, d).join(new, "id", "left").select("id", F.coalesce("new", "name").alias("name"))


@query("WITH " + TOK + """, t AS (SELECT *, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = repo AND l_partkey = nid AND l_returnflag = 'R') AS own FROM tok), v AS (SELECT l_suppkey AS repo, count(DISTINCT l_linenumber) AS versions FROM lineitem GROUP BY l_suppkey)
SELECT repo, versions, count(DISTINCT name) AS identifiers, count(DISTINCT scope) AS scopes, count(DISTINCT name || '::' || coalesce(scope, '')) AS tokens, count(DISTINCT CASE WHEN NOT own THEN name END) AS trimmed_identifiers, count(DISTINCT CASE WHEN NOT own THEN name || '::' || coalesce(scope, '') END) AS trimmed_tokens FROM t JOIN v USING (repo) GROUP BY repo, versions""")
def token_projections(spark, d):
    li = read(spark, d, "lineitem")
    borrowed = li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("repo"), F.col("l_partkey").alias("nid"))
    versions = li.groupBy(F.col("l_suppkey").alias("repo")).agg(F.countDistinct("l_linenumber").alias("versions"))
    return K.token_projections(tokens(spark, d), borrowed).join(versions, "repo")


@query("SELECT DISTINCT event_type || '/' || user_id || '.c' AS path FROM events WHERE event_id % 97 < 96 AND event_id < coalesce((SELECT min(event_id) FROM events e WHERE e.event_id % 97 = 96 AND e.event_type = events.event_type), 1000000000000)")
def tagged_files(spark, d):
    return R.ctags_records(ctags_source(spark, d)).select("path").distinct()


def ctags_source(spark, d):
    """JSON symbol lines of one file for each kind of event; one line in 97 is a warning."""
    e = read(spark, d, "events")
    record = F.to_json(F.struct(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("name"), F.lit("function").alias("kind"), F.concat("event_type", F.lit("/"), F.col("user_id").cast("string"), F.lit(".c")).alias("path"), (F.col("event_id") % 500).cast("int").alias("line"), (F.col("event_id") % 500 + 9).cast("int").alias("end")))
    return e.select(F.col("event_type").alias("path"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 97 == 96, "warning").otherwise(record).alias("value"))


@query("WITH " + BODY + r", x AS (SELECT doc_id, regexp_extract(body, '(?s)\{(.*)\}', 1) AS b FROM body) SELECT doc_id, md5(lower(translate(b, chr(10) || chr(13) || chr(9) || '{} ', ''))) AS digest FROM x")
def normalised_bodies(spark, d):
    # Lower-casing beyond ASCII differs between engines for a few letters only; the texts here have none of them.
    return bodies(spark, d).select("doc_id", F.md5(X.normalise_body(X.body_of(F.col("body")))).alias("digest"))


@query(r"""WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '"''\', '') AS t FROM documents), b AS (SELECT doc_id, replace(replace(replace(t, '//', '/ /'), '/*', '/ *'), '*/', '* /') AS t FROM t)
SELECT doc_id, md5(' int v; ' || chr(10) || 's = "a // b /* c";  ' || t || ' ') AS digest FROM b""")
def comments_stripped(spark, d):
    """Bodies around each text with both kinds of comment, and a literal that holds the marks of both."""
    text = F.translate(F.coalesce("text", F.lit("")), "\"'\\", "")
    for mark in ("//", "/*", "*/"):
        text = F.replace(text, F.lit(mark), F.lit(" ".join(mark)))
    plain = F.regexp_replace(text, r"[{}]", "")
    body = F.concat(F.lit("{ int v; // "), F.coalesce("lang", F.lit("")), F.lit("\ns = \"a // b /* c\"; /* more\n "), F.coalesce("source", F.lit("")), F.lit(" */ "), text, F.lit(" }"))
    return read(spark, d, "documents").select("doc_id", F.md5(X.strip_comments(body)).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def text_md5(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5("text").alias("digest"))


@query(r"SELECT p_partkey AS id, array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(p_brand || '_' || p_name || 'XMLFile', '([a-z])([A-Z])', '\1|\2', 'g'), '([A-Z])([A-Z][a-z])', '\1|\2', 'g'), '_|[0-9]|\s+', '|', 'g'), '|'), lambda x: x <> ''), lambda x: lower(x)), ' ') AS parts FROM part")
def identifier_parts(spark, d):
    name = F.concat("p_brand", F.lit("_"), "p_name", F.lit("XMLFile"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(X.subtokens(name), " ").alias("parts"))


@query("WITH " + SYMBOLS + r", p AS (SELECT id, regexp_replace(CASE WHEN contains(name, '.') THEN string_split(name, '.')[1] ELSE name END, '<.*>', '') AS name FROM sym) SELECT id, CASE WHEN contains(name, '::') THEN array_to_string(string_split(name, '::')[:-2], '::') END AS scope, string_split(name, '::')[-1] AS last, array_to_string(list_transform(range(1, len(string_split(name, '::'))), lambda i: array_to_string(string_split(name, '::')[:i], '::')), '|') AS prefixes FROM p")
def name_scopes(spark, d):
    plain = X.without_templates(X.without_suffix(F.col("name")))
    return symbols(spark, d).withColumn("name", plain).select("id", X.scope_of(F.col("name")).alias("scope"), X.last_name_of(F.col("name")).alias("last"), F.array_join(X.prefixes(F.col("name")), "|").alias("prefixes"))


@query("WITH " + TOK + " SELECT repo, nid, concat_ws('::', scope, name) AS full_name FROM tok")
def full_names(spark, d):
    return tokens(spark, d).select("repo", "nid", X.full_name(F.col("scope"), F.col("name")).alias("full_name"))


@query(r"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z+]+://', ''), '(\.git)?/*$', '') AS u FROM pages)
SELECT page_id, replace(u, '/', '@@') AS repo, string_split(u, '/')[-1] AS base, replace(regexp_replace(u, '^[^/]*/', ''), '/', '@@') AS own, 'v' || (page_id % 9) || '.0' AS tag FROM u""")
def repo_names(spark, d):
    """A repository's name from its address, from a dump's path, from its address without the host; the tag of an index file."""
    url = F.col("url")
    plain = F.regexp_replace(F.regexp_replace(url, "^[a-z+]+://", ""), r"(\.git)?/*$", "")
    dump = F.concat(F.lit("/dumps/"), X.base_name(plain), F.lit(".pkl"))
    index = F.concat(F.lit("fuzzy_v"), (F.col("page_id") % 9).cast("string"), F.lit(".0.hidx"))
    return read(spark, d, "pages").select("page_id", X.repo_of_url(url).alias("repo"), X.repo_of_dump(dump).alias("base"), X.repo_on_host(url).alias("own"), X.tag_of_index(index).alias("tag"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.scope'), 'none') AS scope, json_extract_string(props, '$.k') AS k FROM events")
def json_fields(spark, d):
    p = F.col("props")
    return read(spark, d, "events").select("event_id", F.coalesce(F.get_json_object(p, "$.scope"), F.lit("none")).alias("scope"), F.get_json_object(p, "$.k").alias("k"))


@query("SELECT md5(text) AS fhash, row_number() OVER (ORDER BY md5(text)) AS fid FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)")
def global_fids(spark, d):
    return assign_fids(read(spark, d, "documents").where("text IS NOT NULL").select(F.md5("text").alias("fhash")))


@query("""WITH old AS (SELECT DISTINCT md5(text) AS fhash FROM documents WHERE doc_id % 2 = 0), ranked AS (SELECT fhash, row_number() OVER (ORDER BY fhash) AS fid FROM old),
fresh AS (SELECT DISTINCT md5(text) AS fhash FROM documents WHERE doc_id % 2 = 1 AND md5(text) NOT IN (SELECT fhash FROM old))
SELECT * FROM ranked UNION ALL SELECT fhash, row_number() OVER (ORDER BY fhash) + (SELECT max(fid) FROM ranked) FROM fresh""")
def incremental_fids(spark, d):
    h = read(spark, d, "documents").select((F.col("doc_id") % 2).alias("half"), F.md5("text").alias("fhash"))
    return assign_fids(h.where("half = 1").select("fhash"), assign_fids(h.where("half = 0").select("fhash")))


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '([A-Za-z_]\\w*)\\s*\\(', 1))) AS callee FROM documents) WHERE callee NOT IN ('if', 'for', 'while', 'switch', 'return', 'sizeof') GROUP BY doc_id".replace("FROM documents)", "FROM (SELECT doc_id, replace(text, ', ', '(1) ') AS text FROM documents))").replace("\\\\", "\\"))
def call_expressions(spark, d):
    from kinfold.functions.code import calls

    text = F.replace(F.col("text"), F.lit(", "), F.lit("(1) "))
    return read(spark, d, "documents").select("doc_id", F.explode(calls(text)).alias("callee")).groupBy("doc_id").agg(F.count("*").alias("n"))


def text_lines(df, path, line_no, *values):
    """Lines of one file for each row, numbered in the order of a key."""
    n = len(values)
    return df.select(path.cast("string").alias("path"), F.posexplode(F.array(*values)).alias("at", "value"), line_no.alias("k")).select("path", (F.col("k") * n + F.col("at")).alias("line_no"), "value")


@query("SELECT lpad(lower(hex(o_orderkey)), 8, '0') AS commit, strftime(o_orderdate, '%Y-%m-%d') || ' 10:00:00' AS date, o_orderpriority AS subject FROM orders")
def git_log(spark, d):
    value = F.concat(F.lpad(F.lower(F.hex("o_orderkey")), 8, "0"), F.lit(" "), day(F.col("o_orderdate")), F.lit(" 10:00:00 +0000 "), "o_orderpriority")
    return R.commits(text_lines(read(spark, d, "orders"), F.col("o_custkey"), F.col("o_orderkey"), value)).select("commit", "date", "subject")


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'D' ELSE 'M' END AS status, 'a' || o_orderkey || '.c' AS file FROM orders UNION ALL SELECT 'A', 'b' || o_orderkey || '.c' FROM orders WHERE o_orderstatus = 'F'")
def git_changes(spark, d):
    k = F.col("o_orderkey").cast("string")
    value = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("R90\t./a"), k, F.lit(".c\tb"), k, F.lit(".c"))).otherwise(F.concat(F.lit("M\ta"), k, F.lit(".c")))
    return R.changes(text_lines(read(spark, d, "orders"), F.lit("log"), F.col("o_orderkey"), value)).select("status", "file")


@query("SELECT s_nationkey || '' AS file, s_name AS module, 'lib/' || s_suppkey AS path, 'https://h/' || s_suppkey || '.git' AS url FROM supplier")
def submodule_sections(spark, d):
    k = F.col("s_suppkey").cast("string")
    values = F.concat(F.lit('[submodule "'), "s_name", F.lit('"]')), F.concat(F.lit("  path = lib/"), k), F.concat(F.lit("\turl = https://h/"), k, F.lit(".git"))
    return R.submodules(text_lines(read(spark, d, "supplier"), F.col("s_nationkey"), F.col("s_suppkey"), *values))


@query("SELECT p_brand || '.c' AS file, 'f' || p_partkey AS symbol, p_size AS line, 'call(' || p_type || ')' AS text FROM part WHERE p_partkey % 4 <> 0")
def cross_reference_lines(spark, d):
    k = F.col("p_partkey")
    good = F.concat("p_brand", F.lit(".c f"), k.cast("string"), F.lit(" "), F.col("p_size").cast("string"), F.lit(" call("), "p_type", F.lit(")"))
    return R.cross_references(text_lines(read(spark, d, "part").withColumn("p_brand", F.replace("p_brand", F.lit(" "), F.lit("_"))), F.lit("x"), k, F.when(k % 4 != 0, good).otherwise("no reference")))


@query("SELECT l_orderkey * 10 + l_linenumber AS ea, 'src/' || min(l_partkey) || '.c' AS file, l_linenumber AS line FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY l_orderkey, l_linenumber")
def debug_line_infos(spark, d):
    ea = F.lower(F.hex(F.col("l_orderkey") * 10 + F.col("l_linenumber")))
    known = F.concat(F.lit("Line "), F.col("l_linenumber").cast("string"), F.lit(' of "src/'), F.col("l_partkey").cast("string"), F.lit('.c" starts at address'))
    first = F.when(F.col("l_orderkey") % 5 != 0, known).otherwise(F.lit("No line number information available for address"))
    rows = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    return R.debug_lines(text_lines(rows, F.col("l_orderkey") % 20, F.col("l_orderkey") * 10 + F.col("l_linenumber"), first, F.concat(F.lit("   0x"), ea, F.lit(" <f>"))))


@query("SELECT DISTINCT '/src/' || p_brand || '.c' AS file FROM part UNION SELECT DISTINCT '/inc/' || p_size || '.h' FROM part")
def debug_source_lists(spark, d):
    value = F.concat(F.lit("/src/"), "p_brand", F.lit(".c, /inc/"), F.col("p_size").cast("string"), F.lit(".h, local.c"))
    return R.debug_sources(text_lines(read(spark, d, "part"), F.lit("x"), F.col("p_partkey"), value))


@query("SELECT fhash, list_sort(list(fid))[1] AS first, count(*) AS n FROM (SELECT l_returnflag || l_linestatus AS fhash, l_partkey AS fid FROM lineitem) GROUP BY fhash")
def tree_hash_index(spark, d):
    rows = read(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("fhash"), F.col("l_partkey").alias("fid"))
    return rows.groupBy("fhash").agg(F.min("fid").alias("first"), F.count("*").alias("n"))


@query()
def table_files(spark, d):
    """The tables' files, the largest first."""
    return R.listing(spark, d, "*.parquet").select(X.base_name(F.col("path")).alias("file"), "length")


@query("""WITH old AS (SELECT DISTINCT text, md5(text) AS fhash FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL), ranked AS (SELECT fhash, length(text) AS n, row_number() OVER (ORDER BY fhash) AS fid FROM old),
fresh AS (SELECT DISTINCT text, md5(text) AS fhash FROM documents WHERE doc_id % 2 = 1 AND text IS NOT NULL AND md5(text) NOT IN (SELECT fhash FROM old))
SELECT fid, fhash, n, 1 AS version FROM ranked UNION ALL SELECT row_number() OVER (ORDER BY fhash) + (SELECT max(fid) FROM ranked), fhash, length(text), 2 FROM fresh""")
def committed_functions(spark, d):
    """Functions with their vectors (here: the body's length), added in two commits, and the version that brought each."""
    store = S.Store(spark, R.scratch(spark, "store"))
    h = read(spark, d, "documents").select((F.col("doc_id") % 2).alias("half"), F.md5("text").alias("fhash"), F.col("text").alias("body"))
    for half in (0, 1):
        S.add_functions(store, h.where(f"half = {half}"), lambda new: new.select("fid", F.length("body").cast("long").alias("n")))
    first = store.read("functions", 1).select("fid", F.lit(1).alias("version"))
    rows = store.read("functions").select("fid", "fhash").join(store.read("vectors"), "fid").join(first, "fid", "left")
    return rows.select("fid", "fhash", "n", F.coalesce("version", F.lit(2)).alias("version"))


@query("SELECT l_suppkey AS repo, l_returnflag AS flag, count(*) AS n, CAST(CASE WHEN l_suppkey % 10 = 0 THEN 2 ELSE 1 END AS INT) AS run FROM lineitem GROUP BY l_suppkey, l_returnflag")
def built_repositories(spark, d):
    """Repositories built in two batches; a second run does nothing, and a third builds one in ten anew."""
    store = S.Store(spark, R.scratch(spark, "built"))
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("repo"), F.col("l_returnflag").alias("flag"))
    counts = lambda run: lambda some: li.join(some, "repo", "left_semi").groupBy("repo", "flag").agg(F.count("*").alias("n"), F.lit(run).alias("run"))
    S.build(store, li, counts(1), batches=2)
    S.build(store, li, counts(3))
    S.build(store, li, counts(2), again=li.where("repo % 10 = 0"))
    return S.built(store)
