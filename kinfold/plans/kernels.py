"""Kernels over text: digests, tokens, metrics, vocabularies, instructions, demangling, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions import code as C
from kinfold.functions import demangle as D
from kinfold.functions import text as X
from kinfold.functions.digest import canonical, digest
from kinfold.functions.network import Network, vectors
from kinfold.operators import trees as T
from kinfold.operators.graph import cut
from kinfold.plans.base import bodies, query, read
from kinfold.plans.graphs import FILES, source_files


@query()
def fuzzy_digests(spark, d):
    """The digest of each normalised body."""
    body = X.normalise_body(X.strip_comments(X.body_of(F.col("body"))))
    return bodies(spark, d).select("doc_id", canonical(digest(body)).alias("fhash"))


@query("""WITH b AS (SELECT *, concat(' int v; ', chr(10), translate(coalesce(text, ''), '"''/{}\', ''), ' ') AS body FROM documents)
SELECT source AS repo, lang || '/' || (doc_id % 50) || '.c' AS path, 'f' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN 'ns::' || lang END AS scope, CASE WHEN doc_id % 3 = 0 THEN concat_ws('::', 'ns::' || lang, 'f' || doc_id) ELSE 'f' || doc_id END AS token, length(body) AS length,
md5(lower(translate(body, chr(10) || chr(13) || chr(9) || ' ', ''))) AS fhash, doc_id % 700 + 1 AS line_start, doc_id % 700 + 1 + len(string_split(body, chr(10))) - 1 AS line_end FROM b""")
def function_records(spark, d):
    """What each body becomes; the hash is a parameter, MD5 here and the fuzzy digest in ``fuzzy_digests``."""
    k = F.col("doc_id")
    text = F.concat(F.lit("{ int v; // "), F.coalesce("lang", F.lit("")), F.lit("\n"), F.translate(F.coalesce("text", F.lit("")), "\"'/{}\\", ""), F.lit(" }"))
    rows = read(spark, d, "documents").select(F.col("source").alias("repo"), F.concat("lang", F.lit("/"), (k % 50).cast("string"), F.lit(".c")).alias("path"), F.concat(F.lit("f"), k.cast("string")).alias("name"), F.when(k % 3 == 0, F.concat(F.lit("ns::"), "lang")).alias("scope"), (k % 700 + 1).alias("line_start"), text.alias("text"))
    return C.function_records(rows, F.md5)


#: Programs made from parts, and the tokens that they have.
PROGRAMS = """prog AS (SELECT p_partkey AS id, 5 + p_size % 7 + p_partkey % 3 AS loc, string_split('int <id> get item f <ID> ( int <id> a <ID> ) { ' || repeat('if ( <id> a <ID> > 1 ) { <id> a <ID> = <id> a <ID> ? 2 : 3 ; } ', p_size % 7) || repeat('for ( ; ; ) { <id> p <ID> -> nextItem ; break ; } ', p_partkey % 3) || 'return <STR> + <id> xml file <ID> ; }', ' ') AS t FROM part)"""


def programs(spark, d):
    """C functions of a few branches and loops; names hold their number, so the lexer's subtokens leave it out."""
    k, s = F.col("p_partkey"), F.col("p_size")
    head = F.concat(F.lit("// made\nint getItemF"), k.cast("string"), F.lit("(int a) { /* a\n comment */\n"))
    branches = F.repeat(F.lit("if (a > 1) { a = a ? 2 : 3; }\n"), (s % 7).cast("int"))
    loops = F.repeat(F.lit("for (;;) { p->nextItem; break; }\n"), (k % 3).cast("int"))
    return read(spark, d, "part").select(k.alias("id"), F.concat(head, branches, loops, F.lit('return "a // b" + XMLFile;\n}')).alias("source"))


@query("WITH " + PROGRAMS + " SELECT id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM prog")
def code_tokens(spark, d):
    return programs(spark, d).select("id", C.code_tokens("source").alias("t")).select("id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("WITH " + PROGRAMS + " SELECT id, 1 + len(list_filter(t, lambda x: x IN ('if', 'for', 'while', 'switch', 'case', '?'))) AS complexity FROM prog")
def cyclomatic_complexity(spark, d):
    return programs(spark, d).select("id", C.cyclomatic(C.code_tokens("source")).cast("long").alias("complexity"))


VOLUMES = PROGRAMS + ", k AS (SELECT *, list_filter(t, lambda x: x <> ')' AND x <> '}') AS k FROM prog), v AS (SELECT *, len(k) * log2(greatest(len(list_distinct(k)), 1)) AS hv FROM k)"


@query("WITH " + VOLUMES + " SELECT id, round(CASE WHEN hv > 0 THEN 171.0 - 5.2 * ln(hv) - 0.23 * (1 + len(list_filter(t, lambda x: x IN ('if', 'for', 'while', 'switch', 'case', '?')))) - 16.2 * ln(loc) ELSE 171.0 END, 5) AS mi FROM v")
def maintainability_index(spark, d):
    lines = F.size(F.split("source", "\n"))
    rows = programs(spark, d).select("id", lines.alias("n"), C.code_tokens("source").alias("t"))
    return rows.select("id", F.round(C.maintainability(F.col("t"), F.col("n")), 5).alias("mi"))


@query("WITH " + PROGRAMS + """, w AS (SELECT id, string_split(replace(replace(array_to_string(t, ' '), '<id> ', ''), ' <ID>', ''), ' ') AS t FROM prog), o AS (SELECT id, list_filter(t, lambda x: x IN ('=', '>', '?', ':', '->', '+')) AS ops, list_filter(t, lambda x: x IN ('get', 'item', 'f', 'a', 'p', 'nextItem', 'xml', 'file')) AS words FROM w)
SELECT id, round((len(ops) + len(words)) * log2(len(list_distinct(ops)) + len(list_distinct(words))), 5) AS volume FROM o""")
def halstead_volumes(spark, d):
    t = F.filter(F.col("t"), lambda x: ~x.isin("<id>", "<ID>", "<STR>"))
    return programs(spark, d).select("id", C.code_tokens("source").alias("t")).select("id", F.round(C.halstead_volume(t), 5).alias("volume"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents), f AS (SELECT token, min(doc_id * 1000000 + pos) AS place FROM s WHERE token NOT IN ('<PAD>', '<UNK>', '<STR>', '<ANY>', '<ERROR>') GROUP BY token)
SELECT token, row_number() OVER (ORDER BY place) + 4 AS id FROM f""")
def token_vocabulary(spark, d):
    rows = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", " ").alias("t"))
    return C.vocabulary(rows, "doc_id", "t").where("id > 4")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey * 37 <= 5000 THEN '0x' || lower(hex(p_partkey * 37)) ELSE 'HIMM' END AS imm FROM part")
def immediates(spark, d):
    value = F.concat(F.lit("0x"), F.lower(F.hex(F.col("p_partkey") * 37)))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), C.immediate(value).alias("imm"))


def blocks(spark, d, tokens=False):
    """Blocks of instructions at addresses made from line items, with their tokens if asked for."""
    li = read(spark, d, "lineitem")
    text = F.concat(F.when(F.col("l_returnflag") == "R", "mov rax , [ rbx + 0x").when(F.col("l_returnflag") == "A", "add rcx , [ rax * 8 + 0x").otherwise("lea rdx , [ rsi - 0x"), F.lower(F.hex(F.col("l_partkey"))), F.lit(" ]"))
    rows = li.select(F.col("l_suppkey").alias("ea"), (F.col("l_orderkey") % 4).alias("block_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("addr"), text.alias("text"))
    one = F.struct("addr", "text", *(["token"] if tokens else []))
    return (C.with_tokens(rows) if tokens else rows).groupBy("ea", "block_id").agg(F.collect_list(one).alias("instructions"))


INSTRUCTIONS = "ins AS (SELECT l_suppkey AS ea, l_orderkey * 10 + l_linenumber AS addr, CASE l_returnflag WHEN 'R' THEN 'X_mov_rax,_,,_[rbx*1+' || l_partkey || ']' WHEN 'A' THEN 'X_add_rcx,_,,_[rax*8+' || l_partkey || ']' ELSE 'X_lea_rdx,_,,_[rsi*1+' || CASE WHEN l_partkey = 0 THEN '0' ELSE '-' || l_partkey END || ']' END AS instruction FROM lineitem)"


@query("WITH " + INSTRUCTIONS + " SELECT ea, addr, instruction FROM ins")
def instruction_text(spark, d):
    each = blocks(spark, d).select("ea", F.explode("instructions").alias("i"))
    return each.select("ea", F.col("i.addr").alias("addr"), C.instruction(F.col("i.text")).alias("instruction"))


@query("SELECT p_partkey AS id, 'X_cmp_eax,_' || CASE WHEN p_partkey * 37 <= 5000 THEN CASE WHEN p_partkey % 2 = 1 AND p_partkey > 0 THEN '-' ELSE '' END || '0x' || lower(hex(p_partkey * 37)) ELSE 'HIMM' END || ',_[MEM],_[r' || p_size || '*1+0]' AS instruction FROM part")
def operand_text(spark, d):
    """Numbers of either sign, a plain address, a register alone, and words for sizes that are left out."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("cmp  eax "), F.when((k % 2 == 1) & (k > 0), "-").otherwise(""), F.lit("0x"), F.lower(F.hex(k * 37)), F.lit(" dword ptr [ 0x"), F.hex(k + 4096), F.lit(" ] cs : [ r"), F.col("p_size").cast("string"), F.lit(" ]"))
    return read(spark, d, "part").select(k.alias("id"), C.instruction(text).alias("instruction"))


@query("SELECT l_suppkey AS ea, count(*) AS n, md5(string_agg(CASE l_returnflag WHEN 'R' THEN 'mov rax , [ rbx + 0x' WHEN 'A' THEN 'add rcx , [ rax * 8 + 0x' ELSE 'lea rdx , [ rsi - 0x' END || lower(hex(l_partkey)) || ' ]', ';' ORDER BY l_orderkey * 10 + l_linenumber, CASE l_returnflag WHEN 'R' THEN 'm' WHEN 'A' THEN 'a' ELSE 'l' END, lower(hex(l_partkey)))) AS digest FROM lineitem GROUP BY l_suppkey")
def instruction_sequences(spark, d):
    return C.instruction_sequences(blocks(spark, d)).select("ea", F.size("instructions").cast("long").alias("n"), F.md5(F.array_join("instructions", ";")).alias("digest"))


@query("""WITH s AS (SELECT l_suppkey AS ea, l_returnflag AS token, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber, l_returnflag) AS pos FROM lineitem) SELECT ea, count(*) FILTER (token = 'R') AS known, count(*) FILTER (token <> 'R') AS unknown, greatest(0, 2048 - count(*)) AS pad FROM s WHERE pos <= 2048 GROUP BY ea""")
def encoded_instructions(spark, d):
    li = read(spark, d, "lineitem")
    rows = li.groupBy(F.col("l_suppkey").alias("ea")).agg(F.array_sort(F.collect_list(F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), F.col("l_returnflag").alias("t")))).alias("x")).select("ea", F.transform("x", lambda i: i["t"]).alias("t"))
    ids = C.encoded(rows, "ea", "t", spark.createDataFrame([("R", 7)], "token string, id long"))
    n = lambda v: F.size(F.filter("ids", lambda x: x == v)).cast("long")
    return ids.select("ea", n(7).alias("known"), n(1).alias("unknown"), n(0).alias("pad"))


@query("""WITH m AS (SELECT p_partkey AS id, p_size % 2 = 0 AS two, regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS b, regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g') AS n FROM part)
SELECT id, b || '::' || n || CASE WHEN two THEN '<int>::run(char const*, int)' ELSE '()' END AS full_name, b || '::' || n || CASE WHEN two THEN '<int>::run' ELSE '' END AS name, b || '::' || n || CASE WHEN two THEN '::run' ELSE '' END AS plain FROM m""")
def demangled_names(spark, d):
    """Mangled names built from parts, demangled in full, without parameters, and without template arguments."""
    n, b = F.regexp_replace("p_name", "[^A-Za-z0-9]", "_"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")
    part = lambda x: F.concat(F.length(x).cast("string"), x)
    mangled = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("_ZN"), part(b), part(n), F.lit("IiE3runEPKci"))).otherwise(F.concat(F.lit("_ZN"), part(b), part(n), F.lit("Ev")))
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), mangled.alias("m"))
    return D.demangled(rows, "m").drop("m")


@query()
def source_embeddings(spark, d):
    """Vectors of programs by the source network: 2048 token ids, 256 channels out, seeded weights. Equal programs are embedded once."""
    tokens = programs(spark, d).select("id", C.code_tokens("source").alias("t"))
    kinds = cut(tokens.groupBy("t").agg(F.min("id").alias("kind")))
    vocabulary = C.vocabulary(kinds, "kind", "t").persist()
    ids = C.encoded(kinds, "kind", "t", vocabulary)
    found = vectors(ids, "kind", "ids", Network(C.rows_of(vocabulary), 128, 256, 12))
    return tokens.join(kinds, "t").select("id", "kind").join(found, "kind").select("id", "vec")


@query()
def binary_embeddings(spark, d):
    """Vectors of all instructions of each function by the binary network with seeded weights; its vocabulary is what occurs."""
    normal = cut(C.instruction_sequences(blocks(spark, d, tokens=True), "token"))
    vocabulary = C.vocabulary(normal, "ea", "instructions").persist()
    # Partitions that aren't merged by size: a row is small, but costs much to embed.
    ids = C.encoded(normal, "ea", "instructions", vocabulary).repartition(4 * spark.sparkContext.defaultParallelism, "ea")
    return vectors(ids, "ea", "ids", Network(C.rows_of(vocabulary, most=1 << 31), 128, 128, 12, seed=9))


#: Files of five functions in two trees: what each function's body is without comments, braces and white space.
TREES = FILES + """, tree AS (SELECT 'v' || t AS tag, CASE WHEN t = 2 THEN 'src/' ELSE '' END || file || '.c' AS path, k, s, n, md5('intr=fn_' || (k + 1) || '(a,inner_' || k || '(a));printf("str(%d)\\n",r);if(check_' || k || '(a)&&p->method_' || k || '(a))ns::qual_' || k || '();returnlast_' || k || '(r);fooobj_' || k || '(3);intdecl_' || k || '(int);r=a*mul_' || k || '(2);#definem_' || k || '(x)macro_' || k || '(x)') AS fhash FROM fn, (VALUES (1), (2)) v(t))"""


def trees(spark, d):
    """Two trees with the same functions; a third of the paths are no source files."""
    files, functions = source_files(spark, d)
    both = lambda df: df.select(F.lit("v1").alias("tag"), "*").unionByName(df.select(F.lit("v2").alias("tag"), "*").withColumn("path", F.concat(F.lit("src/"), "path")))
    notes = files.select(F.lit("v1").alias("tag"), F.concat("path", F.lit(".txt")).alias("path"), "text")
    return both(files).unionByName(notes), both(functions)


@query("WITH " + TREES + " SELECT tag, path, k AS nid, CAST(s AS BIGINT) AS line, fhash FROM tree")
def tree_hashes(spark, d):
    """From files to hashes of their functions in one chain; the digest is a parameter, MD5 here."""
    found = T.tree_hashes(*trees(spark, d), hasher=F.md5)
    return found.select("tag", "path", "nid", F.col("line_start").cast("long").alias("line"), "fhash")


@query("WITH " + TREES + " SELECT fhash, count(*) AS n_places, count(DISTINCT tag) AS n_tags, min(tag) AS first_tag, arg_min(path, tag) AS first_path FROM tree GROUP BY fhash")
def tree_places(spark, d):
    return T.places(T.tree_hashes(*trees(spark, d), hasher=F.md5))


@query("WITH " + TREES + ", l AS (SELECT file, sum(n) AS lines FROM fn GROUP BY file) SELECT tag, count(DISTINCT path) AS files, count(*) AS functions, (SELECT CAST(sum(lines) AS BIGINT) FROM l) AS lines FROM tree GROUP BY tag")
def tree_counters(spark, d):
    files, functions = trees(spark, d)
    return T.tree_counters(files, T.tree_hashes(files, functions, hasher=F.md5))


@query()
def tree_digests(spark, d):
    """The same with the fuzzy digest, on which similar functions meet; tests hold it against a plain version."""
    return T.tree_hashes(*trees(spark, d)).select("tag", "path", "nid", "fhash")


@query()
def function_digests(spark, d):
    """Records of functions whose bodies are whole texts, with the fuzzy digest; tests hold them against a plain version."""
    k = F.col("doc_id")
    rows = bodies(spark, d).select("repo", F.concat(F.lit("d/"), k.cast("string"), F.lit(".c")).alias("path"), F.concat(F.lit("f"), k.cast("string")).alias("name"), F.lit(None).cast("string").alias("scope"), F.lit(1).alias("line_start"), F.col("body").alias("text"))
    return C.function_records(rows, lambda body: canonical(digest(body)))


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN '@ ;' WHEN 2 THEN '@ ; ; ;' ELSE 'x ;' END AS s FROM documents) SELECT doc_id, s FROM t WHERE s <> '' AND s <> '@ ;'""")
def parsed_sources(spark, d):
    """Empty bodies and short ones that don't parse go; a longer one with an error stays."""
    k = F.col("doc_id") % 10
    rows = read(spark, d, "documents").select("doc_id", F.when(k == 0, "").when(k == 1, "@ ;").when(k == 2, "@ ; ; ;").otherwise("x ;").alias("s"))
    return T.parsed(rows.withColumn("t", C.code_tokens("s")), "s", "t").select("doc_id", "s")
