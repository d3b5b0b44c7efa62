"""References by structure: what is a call and what only looks like one."""

import pytest

from kinfold.operators import references as S

SOURCE = r'''// helper(1) was here
#define CALL(x) hidden(x) \
   more(x)
static int work(int a, struct s *p);
namespace ns { class C { int m(int x) const { return one(x); } void d(); }; }
int work(int a, struct s *p) { /* gone(2)
   gone(3) */
  int r = two(a, three(a)); char *t = "str(4) \" str(5)";
  if (four(a) && p->member(a)) { ns::scoped(); return five (r); }
  Foo obj(3); int decl(int); std::vector<int> many(a); Foo *ptr(six(1)); const Foo &ref(a);
  r = a * seven(2); auto n = new Thing(1); char c = '('; x.dot(1);
  FOR_EACH(i, list) { eight(i); }
  do nine(); while (ten());
again:
  goto again;
}
int top = outside(1);
int g() { auto f = [](int y) { return eleven(y); }; return g2() > g3(1); }
'''
FILE = "path string, text string, more int"


def found(spark, text, mode):
    df = S.identifiers(S.source_tokens(spark.createDataFrame([("f.cc", text, 1)], FILE)), mode)
    return sorted((r.line, r.name) for r in df.collect())


def test_calls(spark):
    got = found(spark, SOURCE, "direct")
    want = [(5, "one"), (8, "two"), (8, "three"), (9, "four"), (9, "five"), (10, "six"), (11, "seven"), (12, "FOR_EACH"), (12, "eight"), (13, "nine"), (13, "ten"), (18, "eleven"), (18, "g2"), (18, "g3")]
    assert got == sorted(want)


def test_all_names(spark):
    text = "int f(Foo *p, int n) {\n  Bar b; b.x = n; ns::y(p->z, \"n\"); struct S s;\n  Foo *q = p; out: goto out; // n\n  return n > 1 ? b : k; }\n"
    got = found(spark, text, "all")
    assert got == sorted([(1, "f"), (1, "p"), (1, "n"), (2, "b"), (2, "b"), (2, "n"), (2, "y"), (2, "p"), (2, "s"), (3, "q"), (3, "p"), (4, "n"), (4, "b"), (4, "k")])
    with pytest.raises(ValueError, match="no such mode"):
        found(spark, text, "some")


def test_depth_and_bodies(spark):
    tokens = S.source_tokens(spark.createDataFrame([("a", "struct s { int x; }; int f() { { } g(); } int y;", 0)], FILE)).orderBy("pos").collect()
    assert [t.depth for t in tokens if t.token in "{}"] == [1, 0, 1, 2, 1, 0]
    assert [t.token for t in tokens if t.in_body] == ["{", "{", "}", "g", "(", ")", ";"]


def test_enclosing_functions_and_edges(spark):
    files = spark.createDataFrame([("f.cc", SOURCE, 1), ("f.cc", SOURCE, 2), ("n.cc", None, 1), ("e.cc", "", 1), ("u.cc", "}} f() { \"open", 1)], FILE)
    functions = spark.createDataFrame([("f.cc", 1, "work", 6, 16), ("f.cc", 2, "m", 5, 5), ("f.cc", 3, "g", 18, 18), ("h.cc", 4, "two", 1, 3), ("h.cc", 5, "g2", 4, 9)], "path string, nid long, name string, line_start int, line_end int")
    rows = S.references(files, functions).collect()
    # A repeated file counts once.
    assert sorted((r.nid, r.name) for r in rows if r.nid != 1) == [(2, "one"), (3, "eleven"), (3, "g2"), (3, "g3")]
    assert sum(r.nid == 1 for r in rows) == 10
    assert sorted(map(tuple, S.reference_edges(files, functions).collect())) == [(1, 4), (3, 5)]
    assert not S.references(files.where("false"), functions).collect()


def test_long_literals_and_comments(spark):
    text = 'int f() { s("' + "x\\n" * 4000 + '"); /*' + " * g(1) " * 9000 + '*/ h(' + "(" * 2000 + ")" * 2000 + "); }"
    assert found(spark, text, "direct") == [(1, "h"), (1, "s")]
