"""Line sources: files in many ranges keep their line numbers, and records that go on across ranges are put together."""

import random

from pyspark.sql import functions as F

from kinfold.sources import readers as R


def small_ranges(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


def test_line_numbers_of_files_in_many_ranges(spark, tmp_path):
    rng = random.Random(1)
    texts = {f"f{k}.txt": [("x" * rng.randrange(200) + f" {i}") * (i % 7 != 3) for i in range(n)] for k, n in enumerate((3000, 1, 40))}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name != "f2.txt" else ""))
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "long.txt").write_text("a\n" + "y" * 300_000 + "\nb\r\n\nc")
    texts["long.txt"] = ["a", "y" * 300_000, "b\r", "", "c"]
    small_ranges(spark, 10_000)
    try:
        found = R.lines_of(spark, str(tmp_path))
        assert found.select("path", "block").distinct().count() > 20
        rows = {}
        for r in found.collect():
            rows.setdefault(r.path.split("/")[-1], {})[r.line_no] = r.value
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == {name: dict(enumerate(lines, 1)) for name, lines in texts.items()}


def test_records_across_ranges(spark, tmp_path):
    """Each record is one to four lines; a range ends wherever it may."""
    lines, want = [], []
    for i in range(2500):
        lines += [f'Line {i + 1} of "dir/f{i % 9}.c"', *["   and more of it"] * (i % 4), f"   starts at address 0x{i * 16:x} <f>"]
        want.append((i * 16, f"dir/f{i % 9}.c", i + 1))
    (tmp_path / "log.txt").write_text("\n".join(lines) + "\n")
    small_ranges(spark, 5_000)
    try:
        source = R.lines_of(spark, str(tmp_path))
        assert source.select("block").distinct().count() > 10
        assert sorted(map(tuple, R.debug_lines(source).collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_last_value_goes_from_block_to_block(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_LINES", 4)
    rows = [("p", i, "v" + str(i) if i in (2, 3, 21) else None) for i in range(1, 30)] + [("q", 1, None), ("q", 9, "w"), ("q", 40, None)]
    df = spark.createDataFrame(rows, "path string, line_no long, value string")
    got = {(r.path, r.line_no): r.last for r in R.last_before(df, F.col("value"), "last").collect()}
    want, last = {}, {}
    for path, n, v in rows:
        last[path] = v or last.get(path)
        want[path, n] = last[path]
    assert got == want


def test_lines_before_the_first_bad_one(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 3, "x"), ("b", 1, "x"), ("c", 5, "bad")], "path string, line_no long, value string")
    assert sorted((r.path, r.line_no) for r in R.until_first_bad(df, F.col("value") == "x").collect()) == [("a", 1), ("b", 1)]
