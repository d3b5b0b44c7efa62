"""What a Python worker keeps and takes while it looks for repeated passages."""

import tracemalloc

from kinfold.llm import repeats, substring


def test_hashes_of_words_are_bounded_and_small():
    substring._HASH.clear()
    tracemalloc.start()
    try:
        substring.word_hashes([b"w%d" % i for i in range(300_000)])
        assert tracemalloc.get_traced_memory()[0] < 16_000_000
    finally:
        tracemalloc.stop()
        substring._HASH.clear()


def test_a_worker_gives_memory_back_when_its_buckets_end(monkeypatch):
    import pyarrow as pa

    given = []
    monkeypatch.setattr(repeats, "release", lambda: given.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 2]), pa.array([0, 1, 0]), pa.array([b"a", b"b", b"c"])], names=["bucket", "base", "packed"])
    assert [(k, list(p)) for k, _, p in repeats.buckets_of(iter([batch]))] == [(1, [b"a", b"b"]), (2, [b"c"])]
    assert given
