"""Hashes of source trees and function records with the fuzzy digest, against plain versions on hostile texts."""

import re

from pyspark.sql import functions as F

from kinfold.functions import code as C
from kinfold.functions import digest as G
from kinfold.operators import trees as T

BODY = "".join(f'  s{i} = "a // {i} \\" /* no */ {{" + \'\\\'\'; // gone "{i}\n  /* out "{i}\' }} */ call{i * 7}(x{i}, y{i % 3});\n' for i in range(12))
SOURCE = "int a;\nint f(int x) {\n" + BODY + "}\n" + "void g() { }\n" + "int h(void);\n"


def plain_body(text):
    """Between the outer braces, literals kept, comments and braces gone, then without white space and in lower case."""
    found = re.search(r"\{(.*)\}", text, re.DOTALL)
    body, out, i = found[1] if found else " ", [], 0
    while i < len(body):
        c = body[i]
        if c in "\"'":
            j = i + 1
            while j < len(body) and body[j] != c:
                j += 2 if body[j] == "\\" else 1
            out.append(body[i : j + 1])
            i = j + 1
        elif body.startswith("//", i):
            i = body.find("\n", i) if "\n" in body[i:] else len(body)
        elif body.startswith("/*", i):
            i = body.find("*/", i) + 2
        else:
            out.append(c if c not in "{}" else "")
            i += 1
    return "".join(out)


def normal(text):
    return re.sub(r"[\n\r\t{} ]", "", plain_body(text)).lower()


FILE, FUNCTION = "tag string, path string, text string", "tag string, path string, name string, line_start int, line_end int"


def test_tree_hashes(spark):
    n = SOURCE.count("\n")
    files = spark.createDataFrame([("v1", "/a/x.c", SOURCE), ("v2", "/a/x.c", SOURCE.replace("x1", "z1")), ("v1", "/a/x.txt", SOURCE), ("v1", "/a/null.c", None)], FILE)
    functions = [(t, "/a/x.c", name, s, e) for t in ("v1", "v2") for name, s, e in (("f", 2, n - 2), ("g", n - 1, n - 1), ("h", n, n), ("past", n + 5, n + 9), ("zero", 0, 3))]
    functions += [("v1", "/a/x.txt", "f", 2, n - 2), ("v1", "/a/none.c", "f", 1, 2), ("v1", "/a/null.c", "f", 1, 2)]
    found = T.tree_hashes(files, spark.createDataFrame(functions, FUNCTION)).collect()
    want = {t: G.digests_of([normal("\n".join(s.split("\n")[1 : n - 2]))])[0] for t, s in (("v1", SOURCE), ("v2", SOURCE.replace("x1", "z1")))}
    assert {(r.tag, r.name): r.fhash for r in found} == {("v1", "f"): want["v1"], ("v2", "f"): want["v2"]}
    assert all(len(x) == 70 for x in want.values())
    near = spark.createDataFrame([(want["v1"], want["v2"])], "a string, b string").select(G.distance(F.col("a"), F.col("b")).alias("d")).first().d
    assert 0 < near < 50
    md5 = T.tree_hashes(files, spark.createDataFrame(functions, FUNCTION), F.md5)
    rows = {(r.n_places, r.n_tags, r.first_tag) for r in T.places(md5).collect()}
    assert (1, 1, "v1") in rows and (1, 1, "v2") in rows
    assert {(r.tag, r.files) for r in T.tree_counters(files, md5).collect()} == {("v1", 2), ("v2", 1)}
    assert not T.tree_hashes(files.where("false"), spark.createDataFrame(functions, FUNCTION)).collect()


def test_function_records_with_the_digest(spark):
    texts = [SOURCE, "{ }", "no body", "{" + "x = y + 1; " * 40 + "}", "{" + '"' + "é漢\\n" * 5000 + '" + 1; // c' + "}"]
    rows = spark.createDataFrame([("r", f"f{i}", None if i % 2 else "ns", f"p{i}", 10, t) for i, t in enumerate(texts)], "repo string, name string, scope string, path string, line_start int, text string")
    found = {r.name: r for r in C.function_records(rows, lambda b: G.canonical(G.digest(b))).collect()}
    for i, t in enumerate(texts):
        r = found[f"f{i}"]
        assert r.fhash == G.digests_of([normal(t)])[0]
        assert r.length == len(plain_body(t)) and r.line_end == 10 + t.count("\n")
        assert r.token == (f"f{i}" if i % 2 else f"ns::f{i}")


def test_parsed(spark):
    rows = spark.createDataFrame([("", []), ("@", ["<ERROR>"]), ("@ a b", ["<ERROR>", "a", "b"]), ("@ a b c", ["<ERROR>", "a", "b", "c"]), ("x", None), (None, ["a"])], "s string, t array<string>")
    assert sorted(r.s for r in T.parsed(rows, "s", "t").collect()) == ["@ a b c", "x"]
