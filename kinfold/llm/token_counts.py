"""Token counts of a sentencepiece BPE model by a two-tier lookup in the map tasks.

No pre-token is ever shuffled: what is frequent is found from one bounded summary for each task, added up by a tree.
First tier: the token counts of the most frequent pre-tokens of the corpus, in a broadcast table of at most ``top``
entries. Second tier: a cache in each worker, filled by the library. A text is cut where no piece of the vocabulary
reaches across, so the counts of its parts add up to the library's count of the whole.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.bpe import _with
from kinfold.llm.common import blobs, slices, staged, table

#: Entries of the broadcast table; counters that a task keeps while it looks for frequent pre-tokens, and sends on.
TOP, COUNTERS, SENT = 65_536, 200_000, 32_768
#: Longest pre-token in a table; bytes that a worker's cache may take.
LONGEST, CACHE_BYTES = 64, 64 << 20
SPACE = "▁"
parts = re.compile(r" *[^ \n]+| +|\n").findall


def pre_tokens(text: str) -> list[str]:
    """Parts of the text, with the dummy space before it, that no piece of the vocabulary reaches across."""
    return parts(" " + text.replace(SPACE, " ")) if text else []


class Counts:
    """The library's token counts of pre-tokens."""

    def __init__(self, path: str, frequent: dict[str, int]):
        import sentencepiece

        with open(path, "rb") as f:
            self.model = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("pieces of this vocabulary reach across words or lines")
        if self.model.encode("a  b ", out_type=str)[:1] != [SPACE + "a"] or len(self.model.encode("\n")) != 2:
            raise ValueError("this model changes white space")
        self.frequent, self.known, self.held = frequent, {}, 0

    def by_library(self, words: list[str]) -> list[int]:
        """The line break keeps the library from putting its own space before a part; that space and it are 2 tokens."""
        return [len(ids) - 2 for ids in self.model.encode(["\n" + w for w in words], num_threads=1)] if words else []

    def of(self, texts: list[str]) -> list[int]:
        split = [pre_tokens(t) for t in texts]
        frequent, known, long = self.frequent, self.known, {}
        new = list({w for s in split for w in set(s) if w not in frequent and w not in known})
        for word, n in zip(new, self.by_library(new), strict=True):
            if len(word) > LONGEST:
                long[word] = n
            else:
                known[word] = n
                self.held += len(word) + 140
        out = []
        for s in split:
            counts = list(map(frequent.get, s))
            out.append(sum(c if c is not None else known[w] if w in known else long[w] for c, w in zip(counts, s, strict=True)) if None in counts else sum(counts))
        if self.held > CACHE_BYTES:
            known.clear()
            self.held = 0
        return out


def _packed(counts: Counter[str], part: int) -> pa.RecordBatch:
    """The ``SENT`` highest counts as one row."""
    most = counts.most_common(SENT)
    text, numbers = "\n".join(w for w, _ in most).encode(), array("q", [n for _, n in most])
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(text, 1)], pa.binary()), pa.array([numbers.tobytes()], pa.binary())], names=["part", "words", "counts"])


def _unpacked(words: bytes, counts: bytes) -> dict[str, int]:
    numbers = array("q", counts)
    return dict(zip(zlib.decompress(words).decode().split("\n"), numbers, strict=True)) if numbers else {}


def _united(part: pa.Table) -> pa.Table:
    counts: Counter[str] = Counter()
    for words, numbers in zip(part.column("words").to_pylist(), part.column("counts").to_pylist(), strict=True):
        counts.update(_unpacked(words, numbers))
    return pa.Table.from_batches([_packed(counts, part.column("part")[0].as_py())])


def frequent_pre_tokens(docs: DataFrame, text_col: str = "text", top: int = TOP, fan_in: int = 16) -> list[str]:
    """About the ``top`` most frequent pre-tokens of all texts. It steers speed only: a pre-token that is missing is a miss.

    A task counts with bounded memory: whenever it holds ``COUNTERS`` words, it lowers all counts by their median and
    drops what is left without any (Misra and Gries). Its ``SENT`` highest are one row; ``fan_in`` rows become one until
    one is left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in slices(batches, text_col):
            for text in blobs(batch.column(text_col)):
                counts.update(w for w in pre_tokens(text.decode()) if len(w) <= LONGEST and w != "\n")
            while len(counts) > COUNTERS:
                low = sorted(counts.values())[len(counts) // 2]
                counts = Counter({w: n - low for w, n in counts.items() if n > low})
        yield _packed(counts, TaskContext.get().partitionId())

    schema = "part int, words binary, counts binary"
    found = staged(docs.select(text_col).mapInArrow(run, schema), "summaries")
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        found = found.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).groupBy("part").applyInArrow(_united, schema)
        parts = -(-parts // fan_in)
    counts = Counter()
    for r in found.select("words", "counts").collect():
        counts.update(_unpacked(bytes(r.words), bytes(r.counts)))
    return [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top] if n > 1]


_COUNTS: dict[str, Counts] = {}


def token_counts(docs: DataFrame, path: str | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), top: int = TOP) -> DataFrame:
    """``keep``, ``n_bytes`` (UTF-8) and ``n_tokens`` of each row, as the library counts the whole text.

    A null text is an empty one: no bytes, no tokens. Rows, repeated ones too, are counted each by itself; an empty
    table gives no rows. Special strings inside texts are ordinary text. ``path`` is a model file on every executor.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    words = frequent_pre_tokens(docs, text_col, top)
    # A part of LONGEST characters has 4 * LONGEST bytes at most, and so many tokens: two bytes hold a count.
    shared = docs.sparkSession.sparkContext.broadcast(("\n".join(words), array("H", Counts(path, {}).by_library(words)).tobytes()))

    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COUNTS:
            text, counts = shared.value
            _COUNTS.clear()  # a worker serves one table at a time
            _COUNTS[key] = Counts(path, dict(zip(text.split("\n"), array("H", counts), strict=True) if counts else ()) | {"\n": 1})
        counter = _COUNTS[key]
        for batch in slices(batches, text_col, 1 << 20):
            texts = blobs(batch.column(text_col))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array([len(t) for t in texts], pa.int64()), pa.array(counter.of([t.decode() for t in texts]), pa.int64())], names=[*keep, "n_bytes", "n_tokens"])

    docs = docs.select(*dict.fromkeys([*keep, text_col]))
    return docs.mapInArrow(run, _with(docs.select(*keep), "n_bytes long", "n_tokens long"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 4096)
