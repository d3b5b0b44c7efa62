import hashlib
import random
import re

import corpus_pipeline as P
from kinfold.llm.bpe import Encoder
import public_tokenizers
from test_decontamination import brute as hits
from test_repeats import brute_words
from kinfold.llm import simhash
from tests_llm_brute import closure, lower
import pytest


def passage(start, n=60):
    return " ".join(f"passage{start}word{i}" for i in range(n))


ITEM = "the quick brown fox jumps over the lazy dog while nobody at all is watching it"


def rows():
    clean = [(i, f"Clean text number {i} speaks about topic{i * 7} and thing{i * 13} in plain words, with item{i} at its end.", "en", "s", None) for i in range(12)]
    return clean + [
        (100, None, "en", "s", 3),
        (101, "", "en", "s", 0),
        (102, "12345 !!! ###", "en", "s", 1),
        (110, "Copied text about rivers and mountains of the north.", "en", "s", 1),
        (111, "Copied text about rivers and mountains of the north.", None, "s", 1),
        (None, "Copied text about rivers and mountains of the north.", "en", None, 1),
        (120, "First head. " + passage(1) + " First tail stays here. " + passage(3, 20), "en", "s", 1),
        (121, "Second and other head. " + passage(1) + " Another tail that stays as well. " + passage(4, 20), "en", "s", 1),
        (130, "Some words before. " + ITEM.upper() + "! Some words after it, more of them so that little is hit, and even more words to be sure of that.", "en", "s", 1),
        (131, ITEM, "en", "s", 1),
    ]


def test_stages_against_plain_versions(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows(), schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert 4 <= len(P.STAGES) <= 5
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        after = docs.collect()
        if name != "byte_bpe":
            assert [f.name for f in docs.schema] == ["doc_id", "text", "lang", "source", "n_chars"]
        texts = sorted(r.text or "" for r in after) if name != "byte_bpe" else []
        if name == "language_id":
            assert texts == sorted(r.text for r in before if re.search(r"[^\W\d_]", r.text or ""))
        if name == "simhash_near_dedup":
            label = closure([five(r.text) for r in before], alike)
            groups = {}
            for r in sorted(before, key=lambda r: (r.doc_id is None, r.doc_id)):
                groups.setdefault(label[five(r.text)], r.text)
            assert texts == sorted(groups.values())
        if name == "substring_dedup":
            plain = [(r, n, gone, kept) for r, (n, gone, kept) in zip(before, brute_words([r.text for r in before], 35), strict=True)]
            assert texts == sorted(kept if gone else r.text for r, n, gone, kept in plain if not gone or gone < n)
            assert not any("passage1word30" in t for t in texts)
        if name == "benchmark_decontamination":
            assert not any(hits(t, [(5, ITEM)])[1] for t in texts)
            assert sorted(r.text for r in before if not hits(r.text, [(5, ITEM)])[1]) == [t for t in texts if "Some words before" not in t]
        if name == "byte_bpe":
            coder = Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
            want = {r.doc_id: len(coder.encode([r.text])[0]) // 4 for r in before}
            assert {r.doc_id: r.n_tokens for r in after} == want
            assert {i for i in want if i is not None and i < 12} == set(range(12))
    assert P.run(spark, str(tmp_path)).count() == docs.count()


def five(text):
    """The five-word shingles of a text, as a value that can be sorted."""
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return tuple(sorted({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}))


def alike(a, b):
    a, b = set(a), set(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []


def test_other_columns_stay_as_they_are(spark, tmp_path):
    """Columns named like results and private names of the operators, odd names, nulls, and one very long text."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000)) + " " + passage(9)
    more = [(500, long, "en", "s", 1), (501, "Words and more words before. " + passage(9), "en", "s", 1)]
    data = [(*r, "mine0" if i % 2 else None, 7, "keep", i, "a", 0.5, b"x", [i], "dotted", "spaced") for i, r in enumerate(rows() + more)]
    names = "lang_pred string, n_words int, kept string, _kin_row int, _ranges string, lang_score double, _hits binary, n_hit array<int>, `a.b` string, `two words` string"
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars int, " + names).repartition(2)
    spark.createDataFrame([(5, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    given = {r["_kin_row"]: r for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema == docs.schema, name
        found = out.collect()
        assert found
        for r in found:
            own = given[r["_kin_row"]]
            assert [r[c] for c in others] == [own[c] for c in others]
            assert r["n_chars"] == (own["n_chars"] if name in ("language_id", "simhash_near_dedup") else None if r["text"] is None else len(r["text"]))
        if name == "substring_dedup":
            assert not any("passage9word5" in (r["text"] or "") for r in found)
            assert sum(r["doc_id"] in (500, 501) for r in found) == 2


@pytest.mark.parametrize("members", [1024, 12])
def test_edited_copies_are_near_duplicates(spark, tmp_path, members, monkeypatch):
    monkeypatch.setattr(simhash, "MEMBERS", members)
    rng = random.Random(3)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 60, 120, 400]))] for _ in range(60)]
    for n in range(40):  # copies with one word in 60 changed, and of a chain
        own = list(texts[n])
        for at in range(20, len(own), 60):
            own[at] = f"edit{n}"
        texts.append(own)
    base = [f"c{k}" for k in range(200)]
    texts += [base[:20] + [f"e{n}"] + base[21:] for n in range(100)]  # a large group
    texts += [base[:150] + [f"far{n}x{k}" for k in range(60)] for n in range(5)]  # alike, under 0.8
    texts += [base[: 140 + n] + [f"mid{k}" for k in range(60 - n)] for n in range(0, 60, 7)]  # a chain that ends at the large group
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    own = [five(" ".join(t)) for t in texts]
    label = closure(range(len(texts)), lambda a, b: alike(own[a], own[b]))
    found = sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect())
    assert found == sorted(set(label.values()))
    assert len(found) < 80


def test_the_pipeline_ends_with_token_ids(spark):
    texts = ["Some words, and more words.", "", None, "é漢 😀 x"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    coder = Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in P.encode(spark, docs, "").collect():
        text = texts[r.doc_id] or ""
        assert bytes(r.ids) == coder.encode([text])[0]
        assert coder.decode(bytes(r.ids)).decode() == text
        assert r.n_tokens == len(r.ids) // 4 and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
