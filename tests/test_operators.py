"""Micro fixtures: graphs, links, lifetimes, names, readers, kernels."""

import random
import shutil
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import code as C
from kinfold.functions import demangle as D
from kinfold.functions import digest as G
from kinfold.functions import text as X
from kinfold.functions.network import Network, Shares
from kinfold.operators import graph, lineage, linkage, matching, vectors
from kinfold.sources import readers as R


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_reach_ends_in_cycles_and_holds_seeds(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src long, dst long")
    s = spark.createDataFrame([(1, 1), (5, 5), (9, 9)], "seed long, node long")
    assert rows(graph.reach(e, s)) == [(1, 1), (1, 2), (1, 3), (1, 4), (5, 5), (9, 9)]
    assert rows(graph.reach(e, s, depth=1)) == [(1, 1), (1, 2), (5, 5), (9, 9)]
    assert rows(graph.reach(e, s, spark.createDataFrame([(3,)], "node long"))) == [(1, 1), (1, 2), (5, 5), (9, 9)]


def test_bypass_joins_what_removed_nodes_joined(spark):
    e = spark.createDataFrame([(1, 10), (10, 11), (11, 2), (10, 3), (2, 3), (11, 1)], "src long, dst long")
    assert rows(graph.bypass(e, spark.createDataFrame([(10,), (11,)], "node long"))) == [(1, 1), (1, 2), (1, 3), (2, 3)]


def test_cross_repo_reach_follows_used_evidence_only(spark):
    e = spark.createDataFrame([("a", 1, 2), ("b", 5, 6)], "repo string, src long, dst long")
    holds = spark.createDataFrame([("a", 2, 20), ("b", 5, 20), ("b", 6, 60), ("c", 7, 60), ("d", 8, 99)], "repo string, node long, fid long")
    links = spark.createDataFrame([("a", "b", 20), ("b", "c", 60), ("a", "d", 99), ("c", "a", 60)], "src string, dst string, fid long")
    start = spark.createDataFrame([("a", 1)], "repo string, node long")
    assert rows(graph.cross_repo_reach(e, links, holds, start)) == [("a", 0), ("b", 1), ("c", 2)]


def test_lifetimes(spark):
    ev = spark.createDataFrame([("r", "t", 0, 7), ("r", "t", 2, None), ("r", "t", 4, 7), ("r", "t", 6, 8), ("r", "t", 6, 9)], "repo string, token string, ver_idx long, fid long")
    found = lineage.lifetimes(ev, ["repo", "token"], 9)
    assert rows(found) == [("r", "t", 7, 0, 1), ("r", "t", 7, 4, 5), ("r", "t", 8, 6, 9), ("r", "t", 9, 6, 9)]
    touching = spark.createDataFrame([("t", 1, 0, 3), ("t", 1, 4, 5), ("t", 1, 8, 9)], "token string, fid long, from_idx long, to_idx long")
    assert rows(lineage.islands(touching, ["token"])) == [("t", 1, 0, 5), ("t", 1, 8, 9)]


def test_symbol_match_prefers_exact_scopes(spark):
    exe = spark.createDataFrame([(1, "f", "a::b"), (2, "g", None), (3, "h", "x::y"), (4, "~d", "d")], "nid long, name string, scope string")
    tok = spark.createDataFrame([("r", 10, "f", "a::b"), ("r", 11, "f", "b"), ("r", 12, "g", None), ("r", 13, "g", "z"), ("q", 14, "f", "b"), ("q", 15, "h", None), ("q", 16, "h", "z")], "repo string, nid long, name string, scope string")
    assert rows(matching.match_symbols(exe, tok)) == [(1, "q", 14, False), (1, "r", 10, True), (2, "r", 12, True), (3, "q", 15, False)]
    common = spark.createDataFrame([("g",)], "identifier string")
    assert {r.nid for r in matching.symbol_query(exe, tok, common).collect()} == {1, 3}


def test_links(spark):
    l = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("p", "c")], "src string, dst string")
    assert rows(linkage.one_way(l)) == [("b", "c"), ("p", "c")]
    assert rows(linkage.two_way(l)) == [("a", "b")]
    assert rows(linkage.orient(l, spark.createDataFrame([("a", "b", 1)], "a string, b string, vote int"))) == [("a", "b"), ("b", "c"), ("p", "c")]
    prim = spark.createDataFrame([("p",), ("b",)], "repo string")
    assert rows(linkage.primitive_first(l, prim)) == [("a", "b"), ("c", "b"), ("c", "p")]
    wanted = spark.createDataFrame([("c", "b"), ("x", "y")], "src string, dst string")
    assert rows(linkage.manual(l, wanted)) == [("a", "b"), ("b", "a"), ("c", "b"), ("p", "c")]
    assert rows(linkage.manual(l, wanted, compat=True)) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("p", "c")]


def test_subsumption_reaches_a_fixpoint(spark):
    e = spark.createDataFrame([("n", "o1", "f", 1), ("n", "o2", "f", 1), ("o1", "o2", "f", 1), ("n", "o1", "f", 2)], "src string, dst string, kind string, key long")
    assert rows(linkage.subsume(e)) == [("n", "o1", "f", 2), ("n", "o2", "f", 1), ("o1", "o2", "f", 1)]


def test_reuse_ratio_is_monotone(spark):
    l = spark.createDataFrame([("a", "b", 5, 10, 4), ("a", "c", 1, 10, 2), ("a", "d", 1, 10, 0), ("a", "e", 1, 3, 3)], "src string, dst string, common long, n long, reused long")
    kept = [{r.dst for r in linkage.reuse_ratio(l, t).where("kept").collect()} for t in (0.0, 0.1, 0.2, 1.0)]
    assert kept[0] == {"b", "c", "d", "e"} and kept[3] == {"d", "e"}
    assert all(b <= a for a, b in zip(kept, kept[1:], strict=False))


def test_similar_digests_lose_none(spark, monkeypatch):
    rng = random.Random(1)
    digits = "0123456789abcdef"
    base = ["".join(rng.choice(digits) for _ in range(70)) for _ in range(12)]
    near = ["".join(rng.choice(digits) if rng.random() < 0.08 else c for c in b) for b in base for _ in range(6)]
    a, b = (spark.createDataFrame([(x,) for x in sorted(set(s))], "digest string") for s in (base, near))
    brute = a.select(F.col("digest").alias("a")).crossJoin(b.select(F.col("digest").alias("b"))).select("a", "b", G.distance(F.col("a"), F.col("b")).alias("distance")).where("distance < 50")
    assert rows(matching.similar_bodies(a, b)) == rows(brute)
    # By both nibbles, and in blocks of a few.
    monkeypatch.setattr(matching, "FINE", 0)
    monkeypatch.setattr(matching, "BLOCK", 3)
    assert rows(matching.similar_bodies(a, b)) == rows(brute)
    upper = b.select(F.upper("digest").alias("digest"))
    assert rows(matching.similar_bodies(a, upper)) == sorted((x, y.upper(), d) for x, y, d in rows(brute))
    assert not matching.similar_bodies(a, b.where("false")).collect()
    same = a.select(G.distance(F.col("digest"), F.col("digest")).alias("d")).collect()
    assert {r.d for r in same} == {0}


def test_similar_nodes(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a long, b long")
    x = "00" * 35
    h = spark.createDataFrame([(1, x), (2, x), (3, x), (4, "f" * 70)], "nid long, fhash string")
    assert rows(linkage.similar_nodes(pairs, h)) == [(1, 2), (5, 6)]
    assert rows(linkage.similar_nodes(pairs, h, require_body=True)) == [(1, 2)]


def test_names_and_bodies(spark):
    names = ["_ZN3foo3barEi", "strlen", "a<b<c>>::d", "operator<", "x.part.0", ".init", "A::~A", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    r = {x.n: x for x in df.select("n", X.without_templates(F.col("n")).alias("t"), X.without_suffix(F.col("n")).alias("s"), X.is_destructor(F.col("n")).alias("d"), D.strip_templates("n").alias("b")).collect()}
    assert r["a<b<c>>::d"].t == r["a<b<c>>::d"].b == "a::d" and r["operator<"].b == "operator<" and r["x.part.0"].s == "x" and r[".init"].s == ".init" and r["A::~A"].d
    source = 'int f() { s = "/* no */ {x}"; // gone {\n c = \'"\'; /* out */ g(); }'
    got = spark.createDataFrame([(source,), ("no body",), ('{"' + "x" * 20_000 + '"}',)], "s string").select(X.strip_comments(X.body_of(F.col("s"))).alias("b")).collect()
    assert got[0].b == ' s = "/* no */ {x}"; \n c = \'"\';  g(); ' and got[1].b == " " and len(got[2].b) == 20_002


@pytest.mark.skipif(not shutil.which("c++filt"), reason="no system demangler")
def test_demangler_against_the_system():
    names = "_Z1fILi1EEv1AIXplT_Li2EEE _Z1fIiEv1AIXsrT_5valueEE _Z1fIiEv1AIXstT_EE _Z1fIiEv1AIXntsr1BIT_EE1vEE _Z1fIiEv1AIXngT_EE _Z1fILi1EEv1AIXquT_Li2ELi3EEE _Z1fIiEDTcl1gfp_EET_ _Z1fIiEv1AIXaasr1BIT_EE1vsr1CIS1_EE1wEE _Z1fILi3EEv1AIXgtT_Li2EEE _Z1fIiEv1AIXcvbT_EE _Z1fIiEDTplfp_fp0_ET_S0_ _Z1fIiEDTdtfp_1xET_ _ZN3foo3barEi _Z1fv _ZNSt6vectorIiSaIiEE9push_backERKi _ZN3FooC1Ev _ZN3FooD0Ev _ZTV3Foo _ZNK3Foo3getEv _Z3addIiET_S0_S0_ _Znwm _ZdlPv _Z4funcPFivE _ZN1A1BIcE1fEPKS0_ _ZN12_GLOBAL__N_13fooEv _Z1fPA10_i _ZN1AcvbEv _ZGVZ3foovE1x _ZN3FooaSERKS_ _ZThn8_N1B1fEv _ZltRK1AS1_ _Z1gILi5EEvv _Z1hILb1EEvv _Z1fPKcz _ZN3FooIiE3barEv _Z1fRA3_Kc _ZN1XclEi strlen main _Zbad".split()
    want = subprocess.run(["c++filt", "-n"], input="\n".join(names), capture_output=True, text=True).stdout.split("\n")
    assert [D.demangle_name(n) for n in names] == want[: len(names)]
    assert D.demangle_name("_ZN3foo3barEi", params=False) == "foo::bar"
    deep = "_Z1f" + "P" * 1900 + "i"
    assert D.demangle_name(deep) == "f(int" + "*" * 1900 + ")" and D.demangle_name("_Z1f" + "P" * 3000 + "i") == "_Z1f" + "P" * 3000 + "i"


def test_code_kernels(spark):
    assert C.tokens_of('int fooBar2(x) { return "a/*b*/" + p->nextItem; } // c') == ["int", "<id>", "foo", "bar", "<ID>", "(", "<id>", "x", "<ID>", ")", "{", "return", "<STR>", "+", "<id>", "p", "<ID>", "->", "nextItem", ";", "}"]
    assert C.tokens_of("#define A b\n@")[-3:] == ["#define", "<ANY>", "<ERROR>"]
    want = {
        "mov rax , [ rbx + 0x10 ]": "X_mov_rax,_,,_[rbx*1+16]", "lea rdx [ rax * 8 + 0x10 ]": "X_lea_rdx,_[rax*8+16]", "lea rdx [ rcx + rax * 4 - 0x8 ]": "X_lea_rdx,_[rax*4+-8]", "mov eax [ rbp - 0x1F ]": "X_mov_eax,_[rbp*1+-31]",
        "push 0x2710": "X_push_HIMM", "push -0x8": "X_push_-0x8", "call [ 0x400 ]": "X_call_[MEM]", "call [ rax ]": "X_call_[rax*1+0]", "mov byte ptr ds : [ rsi ] 0x1": "X_mov_[rsi*1+0],_0x1", "fld st(0)": "X_fld_st(0)",
        "ret": "X_ret", "": "X_UNK", None: "X_UNK", "mov [ rax": "X_UNK", "push 0x1g": "X_UNK",
    }
    texts = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.i for r in texts.select("t", C.instruction(F.col("t")).alias("i")).collect()} == want
    assert texts.select(C.instruction(F.lit("push 0x2710"), ("0x2710",)).alias("i")).first().i == "X_push_0x2710"
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, [])], "k long, t array<string>")
    vocabulary = C.vocabulary(df, "k", "t")
    assert {r.token: r.id for r in vocabulary.collect()}["c"] == 7
    got = {r.k: r.ids for r in C.encoded(df, "k", "t", vocabulary.where("token <> 'b'"), length=4).collect()}
    assert got == {1: [5, 1, 5, 0], 2: [7, 0, 0, 0], 3: [0, 0, 0, 0]}
    t = spark.createDataFrame([(["if", "(", "x", ")", "y", "=", "x"],)], "t array<string>")
    assert t.select(C.cyclomatic(F.col("t")).alias("c"), F.round(C.halstead_volume(F.col("t")), 4).alias("v")).first() == (2, round(4 * np.log2(3), 4))
    blocks = spark.createDataFrame([(1, [(20, "b"), (10, "a")]), (1, [(5, "z")]), (2, [])], "ea long, instructions array<struct<addr:long,text:string>>")
    assert rows(C.instruction_sequences(blocks)) == [(1, ["z", "a", "b"]), (2, ["ret"])]


def test_digests():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh(){};=+ ") for _ in range(800))
    first, short, nothing, again = G.digests_of([text, "short", None, text])
    assert len(first) == 70 and short == "" and nothing == "" and first == again
    state = 0  # the checksum byte by byte
    raw = text.encode()
    for a, b in zip(raw[4:], raw[3:], strict=False):
        state = int(G._T[G._T[G._T[state] ^ a] ^ b])
    assert first.startswith(f"{state:02x}")


def test_nearest_is_prefix_stable(spark):
    rng = np.random.default_rng(1)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(20, 8)))], "query long, vec array<float>")
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 8)))] + [(999, None)], "id long, vec array<float>")
    for metric in ("l2", "cosine"):
        five, ten = (rows(vectors.nearest(q, c, k, metric).select("query", "rank", "id")) for k in (5, 10))
        assert five == [x for x in ten if x[1] <= 5] and len(ten) == 200
        assert ten == rows(vectors.nearest(q, c, 10, metric, block_bytes=300).select("query", "rank", "id"))


def test_networks():
    n = Network(50, 4, 8, 3)
    ids = np.array([[3, 4, 5, 0, 0, 0, 0, 0], [9, 9, 9, 9, 9, 9, 9, 9]])
    both, one = n.embed(ids), n.embed(ids[:1])
    assert both.shape == (2, 8) and np.allclose(both[:1], one, atol=1e-5)
    shares, x, w = Shares(), np.random.default_rng(0).normal(size=(3, 6)), np.random.default_rng(1).normal(size=(6, 4))
    a, b = shares.split(x)
    assert np.allclose(shares.open(a, b), x, atol=1e-4)
    assert np.allclose(shares.open(shares.linear(a, w), shares.linear(b, w), 2), x @ w, atol=1e-3)


def test_readers(spark, tmp_path):
    def lines(*texts):
        return spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(texts)], "path string, line_no int, value string")

    tags = lines('{"name":"f","line":3,"end":9}', "oops", '{"name":"g"}')
    assert [(r.name, r.line, r.end) for r in R.ctags_records(tags).collect()] == [("f", 3, 9)]
    assert rows(R.changes(lines("M\ta.c", "R100\t./b.c\tc.c", "x")).select("status", "file")) == [("A", "c.c"), ("D", "b.c"), ("M", "a.c")]
    dated = R.tag_dates(lines("2020-01-02 03:04:05 +0000  (tag: v1, tag: v2)", "2021-01-02 03:04:05 +0000  (HEAD)"))
    assert [(r.date[:10], r.tag) for r in dated.collect()] == [("2020-01-02", "v1"), ("2020-01-02", "v2")]
    assert R.tag_dates(lines("2020-01-02 03:04:05 +0000  (tag: v1, tag: v2)"), skip_same_date=True).count() == 1
    mods = R.submodules(lines('[submodule "x"]', "  path = lib/x", "  url = https://h/o/x.git", '[submodule "y"]', "  path = y"))
    assert rows(mods.select("module", "path", "url")) == [("x", "lib/x", "https://h/o/x.git"), ("y", "y", None)]
    assert rows(R.cross_references(lines("a.c main 12 int main(void) {", "bad line"))) == [("a.c", "main", 12, "int main(void) {")]
    debug = lines('Line 12 of "a.c" starts at address', "0x10 <f> and ends at 0x14", 'No line number information available for address 0x20', 'Line 7 of "b.c" starts at address 0x30 <g>')
    assert rows(R.debug_lines(debug)) == [(16, "a.c", 12), (48, "b.c", 7)]
    assert rows(R.debug_sources(lines("/a/b.c, /a/c.c, rel.c"))) == [("/a/b.c",), ("/a/c.c",)]
    assert rows(R.dumped_symbols(lines("0000000000000010 <malloc@plt>:", "20 <main>:", "junk"))) == [(16, "malloc", True), (32, "main", False)]
    assert rows(R.commits(lines("abcdef0 2020-01-02 03:04:05 +0100 a subject")).select("commit", "date", "subject")) == [("abcdef0", "2020-01-02 03:04:05", "a subject")]
    df = spark.createDataFrame([(i, "x") for i in range(250)], "k long, v string")
    R.write_table(df, str(tmp_path / "t"))
    R.write_table(df.limit(5), str(tmp_path / "t"), "append")
    assert R.read_table(spark, str(tmp_path / "t")).count() == 255
    assert rows(R.chunked(df, "k").groupBy("chunk").count()) == [(0, 100), (1, 100), (2, 50)]
    assert R.load_or_build(spark, str(tmp_path / "u"), lambda: df).count() == R.load_or_build(spark, str(tmp_path / "u"), lambda: df.limit(1)).count() == 250
    R.write_json(df, str(tmp_path / "j"))
    assert R.read_json(spark, str(tmp_path / "j")).count() == 250
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.c").write_text("one\ntwo")
    assert [r.value for r in R.lines_of(spark, str(tmp_path / "s")).orderBy("line_no").collect()] == ["one", "two"]
    assert R.listing(spark, str(tmp_path / "s")).first().length == 7
    with pytest.raises(Exception, match="key occurs twice"):
        R.unique_key(df.union(df.limit(1)), "k").collect()
    with pytest.raises(Exception, match="no pair"):
        R.paired(df.select("k", F.lit(1).alias("a")), df.where("k > 0").select("k", F.lit(2).alias("b")), "k").collect()


def test_repositories_choose_in_turn(spark):
    from kinfold.operators import joint

    likely = spark.createDataFrame([("x", r, n) for r, own in (("a", (1, 2, 3)), ("b", (2, 3, 4, 5)), ("c", (5, 6)), ("d", (1, 2))) for n in own] + [("y", "a", 2)], "exe string, repo string, nid long")
    edges = spark.createDataFrame([("x", 1, 2), ("x", 5, 6), ("x", 2, 4)], "exe string, src long, dst long")
    found = {(r.exe, r.repo, r.nid): (r.claimed, r.edged) for r in joint.claims(likely, edges, 2).collect()}
    # b has 4 and 5 left without a call between them; c then gets 5 and 6; d has nothing left; the other executable has its own turns.
    assert found == {("x", "a", 1): (True, True), ("x", "a", 2): (True, True), ("x", "a", 3): (True, True), ("x", "b", 4): (False, False), ("x", "b", 5): (False, False), ("x", "c", 5): (True, True), ("x", "c", 6): (True, True), ("y", "a", 2): (False, False)}


def in_turn(likely, edges, least, need_edge):
    """One repository after the other, as the rule says."""
    out = set()
    for exe in {e for e, _, _ in likely}:
        taken = set()
        for repo in sorted({r for e, r, _ in likely if e == exe}):
            free = {n for e, r, n in likely if (e, r) == (exe, repo)} - taken
            edged = any(e == exe and a in free and b in free for e, a, b in edges)
            won = len(free) >= least and (edged or not need_edge)
            taken |= free if won else set()
            out |= {(exe, repo, n, won, edged) for n in free}
    return out


def test_rounds_give_what_turns_give(spark):
    from kinfold.operators import joint

    for seed, least, need in ((1, 3, True), (2, 1, False), (3, 5, True), (4, 2, False)):
        rng = random.Random(seed)
        likely = [(rng.choice("xyz"), f"r{rng.randrange(14):02}", rng.randrange(40)) for _ in range(400)]
        edges = [(rng.choice("xyz"), rng.randrange(40), rng.randrange(40)) for _ in range(60)]
        found = joint.claims(spark.createDataFrame(likely + likely[:9], "exe string, repo string, nid long"), spark.createDataFrame(edges + edges[:5], "exe string, src long, dst long"), least, need)
        assert set(map(tuple, found.collect())) == in_turn(likely, edges, least, need)
        assert found.count() == len(in_turn(likely, edges, least, need))
    none = spark.createDataFrame([], "exe string, repo string, nid long")
    assert not joint.claims(none, spark.createDataFrame([], "exe string, src long, dst long")).collect()


def test_nearest_keeps_ties_by_label(spark):
    score = np.array([[0.5, 0.1, 0.1, 0.1, 0.9], [1.0, 1.0, 1.0, 1.0, 1.0]])
    label = np.array([[9, 7, 3, 5, 1], [5, 4, 3, 2, 1]])
    best = vectors.nearest_of(score, label, 2)
    assert best[1].tolist() == [[3, 5], [1, 2]]


def test_matrix_files_keep_lengths_apart(spark, tmp_path):
    rows_ = [(1, [1.0, 2.0]), (2, [3.0]), (3, None), (4, [4.0, 5.0]), (5, [])]
    df = spark.createDataFrame(rows_, "fid long, vec array<float>")
    R.write_matrix(df, str(tmp_path / "m"))
    assert rows(R.read_matrix(spark, str(tmp_path / "m"))) == [(1, [1.0, 2.0]), (2, [3.0]), (4, [4.0, 5.0]), (5, [])]


def test_namespace_vote(spark):
    tokens = spark.createDataFrame([("a", i, "x::y" if i < 2 else "z") for i in range(8)] + [("b", i, "x::y") for i in range(3)] + [("c", 9, None)], "repo string, fid long, scope string")
    shared = spark.createDataFrame([("a", "b", 0), ("a", "b", 1), ("a", "c", 0)], "a string, b string, fid long")
    assert rows(linkage.vote_namespace(shared, tokens)) == [("a", "b", 1), ("a", "c", 0)]
