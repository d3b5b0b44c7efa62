"""The closure over submodule sections: addresses of all forms, cycles, and what stays open."""

from pyspark.sql import functions as F

from kinfold.operators import submodules as U


def test_addresses(spark):
    base = "https://h/org/main.git"
    want = {
        "https://x/y/z.git/": "https://x/y/z", "git@h:o/r.git": "git@h:o/r", "../other.git": "https://h/org/other", "./sub": "https://h/org/main/sub",
        "../../lib/z": "https://h/lib/z", "../../../z": None, ".././../q": "https://h/q", " https://x/y ": "https://x/y", "..": "..", None: None,
    }
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.a for r in df.select("u", U.resolved(F.col("u"), F.lit(base)).alias("a")).collect()} == want


def test_needed_repositories(spark):
    texts = {
        "https://h/o/a": '[submodule "x"]\n path = x\n url = ../b.git\n[submodule "y"]\n url = ../../../far',
        "https://h/o/b.git": '[submodule "x"]\n url = https://h/o/a.git\n[submodule "z"]\n url = https://h/o/c/',
        "https://h/o/d": '[submodule "w"]\n url = ../a',
    }
    lines = spark.createDataFrame([(p, i + 1, v) for p, t in texts.items() for i, v in enumerate(t.split("\n"))], "path string, line_no long, value string")
    known = spark.createDataFrame([(p,) for p in texts], "repo string")
    own, left = U.needed(U.submodule_links(lines), known, spark.createDataFrame([("https://h/o/a.git",)], "repo string"))
    assert sorted(map(tuple, own.collect())) == [("https://h/o/a", True), ("https://h/o/b", True), ("https://h/o/c", False)]
    assert sorted(map(tuple, left.select("repo", "module", "target").collect())) == [("https://h/o/a", "y", None), ("https://h/o/b", "z", "https://h/o/c")]
    none, _ = U.needed(U.submodule_links(lines.where("false")), known, known.where("false"))
    assert not none.collect()
