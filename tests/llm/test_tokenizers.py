import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from kinfold.llm import bpe, token_counts

PATH = P.path("byte_bpe_50k.tiktoken")
ALPHABET = " \n\t\r\x0b\x1c\x85\xa0　ab1²Ⅷé漢😀​'sdtlmvr.,!#$AB\x00<|endoftext|>▁"


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["a" * 9000, "ab" * 4000, " " * 999, ""] + ["".join(rng.choice("abcdeth") for _ in range(200)) for _ in range(300)]


def test_replay_is_the_library(reference):
    coder = bpe.Encoder(PATH, P.PATTERN)
    for text, ids in zip(texts(), coder.encode(texts()), strict=True):
        want = reference.encode_ordinary(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want
        assert coder.decode(ids).decode() == text
        for word in coder.split(text)[:5]:
            if word.encode() not in coder.ranks:
                assert coder.alone(word.encode()) == reference.encode_ordinary(word)


def test_small_cache_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 500)
    coder = bpe.Encoder(PATH, P.PATTERN)
    for text in texts()[:300]:
        assert coder.encode([text])[0] == struct.pack(f"<{len(w := reference.encode_ordinary(text))}I", *w)


def test_encode_frames(awkward, empty, reference):
    got = sorted(map(tuple, bpe.digests(awkward).collect()), key=repr)
    want = []
    for r in awkward.select("doc_id", "text").collect():
        ids = reference.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.digests(empty).collect() == []
    again = bpe.decode(bpe.encode(awkward)).select("text", "decoded", "n_words").collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in again)
    assert len(again) == awkward.count()


def test_counts_are_the_librarys(spark, awkward, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts() + ["<s> </s> <unk> <0x41>", "\n", "▁", None])], "doc_id long, text string")
    for top in (0, 50, 65536):
        rows = token_counts.token_counts(df, keep=("doc_id", "text"), top=top).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(model.encode(r.text or "")))
    assert sorted(r.n_tokens for r in token_counts.token_counts(awkward).collect()) == sorted(len(model.encode(r.text or "")) for r in awkward.select("text").collect())
    assert token_counts.token_counts(empty).collect() == []


def test_frequent_words_with_few_counters(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "COUNTERS", 20)
    rng = random.Random(4)
    df = spark.createDataFrame([(" ".join(rng.choice(["the", "of", f"x{rng.randrange(999)}"]) for _ in range(100)),) for _ in range(50)], "text string")
    assert {" the", " of"} <= set(token_counts.frequent_pre_tokens(df, top=5))
