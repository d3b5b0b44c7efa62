"""Byte-level BPE by corpus-level merge replay, and its inverse.

The words (matches of the split pattern) that a chunk of documents brings and the worker has not met yet are laid out as
one sequence. An inverted index leads from each mergeable pair to the positions where it stands; merges are taken from it
in rank order, each touches its two neighbours only, and their new pairs enter the index.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from kinfold.llm.common import blobs, release, slices, table

#: Bytes of words and ids that a worker keeps at most, and the longest word that it keeps.
CACHE_BYTES, CACHE_WORD = 48 << 20, 128
_EXTRA = 180  # of each cached entry, about


class Encoder:
    """Encodes and decodes by a rank file; keeps the ids of words it has met, within ``CACHE_BYTES``."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.split = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs = {(self.ranks[t[:i]] << 32) | self.ranks[t[i:]]: r for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        self.start = np.full((256, 256), -1, np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.start[token[0], token[1]] = rank
        self.known: dict[str, bytes] = {}
        self.held = 0

    def alone(self, word: bytes) -> list[int]:
        """One word by itself: the lowest rank first, of equal ones the leftmost."""
        ids = [*self.single[np.frombuffer(word, np.uint8)].tolist(), -1]
        after, before, get = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), self.pairs.get
        heap = [(r, i) for i in range(len(ids) - 2) if (r := get((ids[i] << 32) | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            if ids[i] < 0 or get((ids[i] << 32) | ids[j := after[i]]) != r:
                continue
            ids[i], ids[j], after[i] = r, -2, after[j]
            before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (q := get((ids[k] << 32) | ids[after[k]])) is not None:
                    heappush(heap, (q, k))
        return [x for x in ids if x >= 0]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        whole = np.frombuffer(b"\0".join([b"", *words, b""]), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.concatenate([[0], np.cumsum(sizes + 1)])  # a stop before each word and after the last
        at = self.single[whole]
        at[stops] = -1
        first = self.start[whole[:-1], whole[1:]]
        first[stops[:-1]] = -1
        first[stops[1:] - 1] = -1
        where = np.flatnonzero(first >= 0)
        order = where[np.argsort(first[where], kind="stable")]
        ranks, begin = np.unique(first[order], return_index=True)
        index = dict(zip(ranks.tolist(), [x.tolist() for x in np.split(order, begin[1:])] if len(ranks) else [], strict=True))
        ids, get = at.tolist(), self.pairs.get
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap, odd = list(index), []
        heapify(heap)
        while heap:
            r = heappop(heap)
            places = index.pop(r)
            places.sort()
            for i in places:
                a = ids[i]
                if a < 0:
                    continue
                j = after[i]
                if get((a << 32) | ids[j]) != r:
                    continue
                k = after[j]
                ids[i], ids[j], after[i], before[k] = r, -2, k, i
                h = before[i]
                q = get((ids[h] << 32) | r)
                if q is not None:
                    if q < r:
                        odd.append(i)
                    if q in index:
                        index[q].append(h)
                    else:
                        index[q] = [h]
                        heappush(heap, q)
                q = get((r << 32) | ids[k])
                if q is not None:
                    if q < r:
                        odd.append(i)
                    if q in index:
                        index[q].append(i)
                    else:
                        index[q] = [i]
                        heappush(heap, q)
        done = np.array(ids, np.int64)
        left = done >= 0
        ends = np.cumsum(left)[stops]
        packed = done[left].astype("<u4").tobytes()
        out = [packed[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        # A merge that makes a pair of lower rank has to go on with that pair first: such words are done alone.
        for n in set((np.searchsorted(stops, np.array(odd, np.int64), "right") - 1).tolist()):
            out[n] = np.array(self.alone(words[n]), "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as ``replay`` packs them."""
        pieces = [self.split(t) for t in texts]
        known = self.known
        new = list({w for p in pieces for w in set(p) if w not in known})
        long: dict[str, bytes] = {}
        if new:
            raw = [w.encode() for w in new]
            whole = [self.ranks.get(w) for w in raw]
            merged = iter(self.replay([w for w, r in zip(raw, whole, strict=True) if r is None]))
            for word, size, rank in zip(new, map(len, raw), whole, strict=True):
                ids = next(merged) if rank is None else rank.to_bytes(4, "little")
                if size > CACHE_WORD:
                    long[word] = ids
                else:
                    known[word] = ids
                    self.held += size + len(ids) + _EXTRA
        get = known.__getitem__ if not long else (lambda w: known[w] if w in known else long[w])
        out = [b"".join(map(get, p)) for p in pieces]
        if self.held > CACHE_BYTES:
            known.clear()
            self.held = 0
        return out

    def forget(self) -> None:
        """Drops the words it has met at the end of a task: an idle worker would keep them beside those at work."""
        self.known.clear()
        self.held = 0
        release()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each rank file and worker."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``: the ids of ``text_col`` (binary, little-endian unsigned 32-bit integers).

    A null text is an empty one and gives no ids. Rows, repeated ones too, keep all their columns; a column named
    ``out`` is replaced. An empty table gives no rows. ``path`` (a rank file on every executor) is byte_bpe_50k by default.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in slices(batches, text_col, 1 << 20):
            ids = coder.encode([t.decode() for t in blobs(batch.column(text_col))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, out])
        coder.forget()

    return docs.mapInArrow(run, _with(docs, f"`{out}` binary"))


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``: the bytes that the ids stand for."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encoded.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, public_tokenizers.PATTERN)
        for batch in slices(batches, ids_col, 4 << 20):
            texts = [coder.decode(x) for x in blobs(batch.column(ids_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, out])

    return encoded.mapInArrow(run, _with(encoded, f"`{out}` binary"))


def _with(df: DataFrame, *more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + list(more))


def digests(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), ids: str | None = None) -> DataFrame:
    """Encodes and decodes each text in one pass: ``keep``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    ``ids`` names a column for the ids themselves, packed as ``encode`` packs them; without it they are not returned.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in slices(batches, "text", 1 << 20):
            found = coder.encode([t.decode() for t in blobs(batch.column("text"))])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in keep),
                    *([pa.array(found, pa.binary())] if ids else []),
                    pa.array([len(x) // 4 for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in found]),
                    pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in found]),
                ],
                names=[*keep, *([ids] if ids else []), "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        coder.forget()

    docs = docs.select(*dict.fromkeys([*keep, "text"]))
    more = [f"`{ids}` binary"] if ids else []
    return docs.mapInArrow(run, _with(docs.select(*keep), *more, "n_tokens long", "ids_sha256 string", "decoded_sha256 string"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
