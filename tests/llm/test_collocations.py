"""Collocations against counting all phrases; bitmaps against positions."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from kinfold.llm import collocations as C


def pieces(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", lower)]


def brute(rows, least, longest, share, first):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        frequent = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in frequent.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        covered[p[i:j]] = max(covered[p[i:j]], a)
        rows = []
        for p, a in frequent.items():
            if 100 * covered[p] >= share * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def texts(seed, n=300):
    rng = random.Random(seed)
    words = [rng.choice(["a", "b", "C", "dé", "漢字", "x" * 40, " ", "\x1c", "'q'", "the", "of", "-"]) + str(rng.randrange(3)) for _ in range(30)]
    gap = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", " ! ", "\r\n", ";"]
    rows = [(rng.choice(["en", "en", "fr", None]), "".join(rng.choice(words) + rng.choice(gap) for _ in range(rng.randrange(1, 60)))) for _ in range(n)]
    rows += [("en", None), (None, ""), ("de", ""), ("und", "a b a b a b " * 30), ("en", "of of of of of " * 20), ("en", "." * 50), ("fr", "A\tB.c " * 4000)]
    return rows + rows[:25]


@pytest.mark.parametrize(("least", "longest", "first"), [(10, 3, 2000), (3, 4, 25), (2, 2, 7)])
def test_equals_counting_all_phrases(spark, monkeypatch, least, longest, first):
    """Null, empty and long texts, repeated rows, words in other scripts, ties, columns with the names of results."""
    monkeypatch.setattr(C, "GROUP", 50)
    rows = texts(least)
    docs = spark.createDataFrame([(r[0], r[1], "x", 5, 0) for r in rows], "lang string, text string, phrase string, a int, words int").repartition(5)
    got = C.collocations(docs, least, longest, 50, first)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, longest, 50, first)


def test_small_filter_changes_nothing(spark, monkeypatch):
    """With few slots nearly everything passes the filter, and the result is the same."""
    rows = texts(8, 80)
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = brute(rows, 4, 3, 50, 2000)
    assert sorted(map(tuple, C.collocations(docs, 4).collect())) == want
    assert want
    # Executors have the module as it is, so the filter is emptied instead: every bit is set.
    monkeypatch.setattr(C, "frequent_slots", lambda docs, least, longest: C.Filter(np.full(1 << 21, 255, np.uint8)))
    assert sorted(map(tuple, C.collocations(docs, 4).collect())) == want


def test_filter_holds_what_is_frequent(spark):
    """Every frequent phrase has its bit, and few others have."""
    rows = texts(9, 200)
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("coalesce(lang, 'und') lang", "coalesce(text, '') text")
    found = C.frequent_slots(docs, 5, 3)
    assert len(found.bits) == 1 << (C.UNKNOWN_BITS - 3)
    f = Counter((lang or "und", *w[i : i + k]) for lang, t in rows for w in pieces(t) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    seed = {lang: C.xxhash.xxh3_64_intdigest(lang.encode()) for lang, *_ in f}
    bit = {p: found.has(C._hashed([np.array([C.xxhash.xxh3_64_intdigest(w.encode(), seed[p[0]])], np.uint64) for w in p[1:]]))[0] for p in f}
    assert all(bit[p] for p, n in f.items() if n >= 5)
    assert sum(bit.values()) <= 1.1 * sum(n >= 5 for n in f.values()) + 5


def test_no_rows(spark):
    for rows in ([], [(None, None)], [("en", "")], [("en", "a b")]):
        assert not C.collocations(spark.createDataFrame(rows, "lang string, text string")).collect()


def test_bitmaps_extend_as_positions_do():
    rng = random.Random(1)
    for n in (0, 1, 7, 8, 9, 500):
        text = " ".join(rng.choice("abcd,") for _ in range(n))
        shard = C.Shard([text.encode()])
        want = [Counter(tuple(p[i : i + k]) for p in pieces(text) for i in range(len(p) - k + 1)) for k in (1, 2, 3)]
        names = [w.decode() for w in shard.words.to_pylist()]
        assert {(names[i],): c for i, c in enumerate(shard.counts()) if c} == want[0]
        index, pairs, triples = shard.index(), {}, {}
        for group in shard.groups():
            a, b, count, more = shard.extended(group, index)
            pairs |= {(names[x], names[y]): c for x, y, c in zip(a, b, count, strict=True)}
            p, c, count, _ = shard.extended(more, index)
            triples |= {(names[a[x]], names[b[x]], names[y]): k for x, y, k in zip(p, c, count, strict=True)}
        assert (pairs, triples) == (dict(want[1]), dict(want[2]))


def test_sql_on_a_small_table(spark, tmp_path):
    rows = [(lang, t) for lang, t in texts(6, 120)]
    spark.createDataFrame(rows, "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(C.OP13_SQL)
    got = C.op13_collocations(spark, str(tmp_path))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
