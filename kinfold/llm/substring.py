"""Substring dedup of word windows by difference-cover anchors.

The cover {0, 1, 4, 14, 16} meets every difference modulo 21. Two equal windows of 35 words that start at i and j of
their texts share a shift k < 21 with i + k and j + k both at cover positions, so the 15 words there, hashed at cover
positions only, are the same anchor in both. Windows around repeated anchors are then compared as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from xxhash import xxh3_128_digest

from kinfold.llm.bpe import _with
from kinfold.llm.common import ROW, blobs, mix, release, rowed, slices, spans, table
from kinfold.llm.repeats import RANGES_SCHEMA, Block, _Rows, buckets_of, flagged_blocks, partitions, range_rows, repeated_anchors, with_ranges

WINDOW, PERIOD, COVER = 35, 21, (0, 1, 4, 14, 16)
_U = np.uint64
#: Odd multipliers of the two window hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Words whose hashes a worker keeps.
_KEPT = 50_000
#: Windows that a task gathers before it sends them on.
BUFFER = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class _Hash(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _KEPT:
            self.clear()
        value = self[word] = xxh3_128_digest(word)
        return value


_HASH = _Hash()


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        found = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            found.append(np.multiply.accumulate(x))
        _POWERS[base] = tuple(found)
    return _POWERS[base]


def window_hashes(h: np.ndarray, size: int, starts: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the windows of ``size`` words at ``starts``, from the words' hashes."""
    up, down = _powers(_BASES[which], len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[starts + size] - sums[starts]) * down[starts])


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word that have nothing to do with each other."""
    both = np.frombuffer(b"".join(map(_HASH.__getitem__, words)), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _cover_starts(n: int, window: int, cover: tuple[int, ...], period: int) -> np.ndarray:
    size = window - period + 1
    starts = (np.arange(0, n, period)[:, None] + np.array(cover)[None, :]).ravel()
    return starts[starts + size <= n]


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, window: int, cover: tuple[int, ...], period: int) -> DataFrame:
    """Ranges of words, by ROW, that windows cover which start anywhere else too."""
    size = window - period + 1
    if size < 1 or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("the cover has to meet every difference, and the period to be no longer than the window")

    def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found, at = [], []
        for i, text in enumerate(texts):
            words = text.split()
            if len(words) >= window:
                starts = _cover_starts(len(words), window, cover, period)
                found.append(window_hashes(word_hashes(words)[0], size, starts))
                at.append(np.full(len(starts), i))
        _HASH.clear()  # a worker goes on to other tasks
        return (np.concatenate(found), np.concatenate(at)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))

    n = partitions(docs.sparkSession, docs)
    buckets = 4 * n
    item = np.dtype([("h", "<u8"), ("g", "<u4"), ("known", "u1"), ("row", "<u2"), ("pos", "<u4")])

    def windows(found: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        """Windows around repeated anchors: those met once here are sent on, one of each other stands for all."""
        held: list[np.ndarray] = []
        rows, base, count = _Rows(), 0, 0

        def flush() -> pa.RecordBatch:
            x = np.concatenate(held)
            held.clear()
            order = np.lexsort((x["g"], x["h"]))
            x = x[order]
            fresh = np.concatenate([[True], (x["h"][1:] != x["h"][:-1]) | (x["g"][1:] != x["g"][:-1])])
            starts = np.flatnonzero(fresh)
            sizes = np.diff(np.concatenate([starts, [len(x)]]))
            known = np.repeat(sizes > 1, sizes)
            out = x[starts]
            out["known"] = sizes > 1
            bucket = ((out["h"] >> _U(17)) * _U(buckets) >> _U(47)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            for a, b in spans(cuts, len(bucket)):
                rows.add(int(bucket[a]), base, out[a:b])
            if known.any():
                found = range_rows(base + x["row"][known].astype(np.int64), x["pos"][known].astype(np.int64), x["pos"][known].astype(np.int64) + window)
                for blk, ranges in zip(found.column("blk").to_pylist(), found.column("ranges").to_pylist(), strict=True):
                    rows.add(-1 - blk, blk, np.frombuffer(ranges, np.uint8))
            return rows.batch()

        for block in found:
            if held and (count > BUFFER or not 0 <= block.first - base <= 0xFF00):
                yield flush()
                count = 0
            if not held:
                base = block.first
            for i, text, tops in block.flagged:
                words = text.split()
                if len(words) < window:
                    continue
                h, g = word_hashes(words)
                starts = _cover_starts(len(words), window, cover, period)
                hit = starts[np.isin(window_hashes(h, size, starts) >> _U(17), tops)]
                # A window that starts up to period - 1 words before a repeated anchor holds it.
                near = np.zeros(len(words) + 1, np.int64)
                np.add.at(near, np.maximum(hit - period + 1, 0), 1)
                np.add.at(near, hit + 1, -1)
                pos = np.flatnonzero(np.cumsum(near)[: len(words) - window + 1] > 0)
                x = np.zeros(len(pos), item)
                x["h"], x["g"], x["row"], x["pos"] = window_hashes(h, window, pos), window_hashes(g, window, pos, 1) & _U(0xFFFFFFFF), block.first - base + i, pos
                held.append(x)
                count += len(x)
        if held:
            yield flush()
        _HASH.clear()
        release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def ranges() -> pa.RecordBatch:
            row = np.concatenate([np.empty(0, np.int64), *(r for r, _ in out)])
            pos = np.concatenate([np.empty(0, np.int64), *(p for _, p in out)])
            out.clear()
            return range_rows(row, pos, pos + window)

        for bucket, bases, packed in buckets_of(batches):
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([pa.array(bases, pa.int64()), pa.array(packed, pa.binary())], names=["blk", "ranges"])
                continue
            x = np.frombuffer(b"".join(packed), item)
            base = np.repeat(np.array(bases, np.int64), [len(p) // item.itemsize for p in packed])
            order = np.lexsort((x["g"], x["h"]))
            x, base = x[order], base[order]
            same = (x["h"][1:] == x["h"][:-1]) & (x["g"][1:] == x["g"][:-1])
            asks = (np.concatenate([[False], same]) | np.concatenate([same, [False]])) & (x["known"] == 0)
            out.append((base[asks] + x["row"][asks], x["pos"][asks].astype(np.int64)))
            count += int(asks.sum())
            if count > 4 * BUFFER:
                yield ranges()
                count = 0
        yield ranges()
        release()

    flags = repeated_anchors(docs, anchors, True, text_col)
    dealt = flagged_blocks(docs, flags, id_col, text_col, windows, "bucket long, base long, packed binary")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, RANGES_SCHEMA)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cover: tuple[int, ...] = COVER, period: int = PERIOD) -> DataFrame:
    """Removes each word covered by a window of ``window`` words that also starts anywhere else, in any text.

    Returns all columns of ``docs`` plus ``n_words``, ``n_removed``, ``kept`` (the kept words joined by one space) and
    ``kept_sha256``; columns of ``docs`` with these names are replaced. All occurrences go; windows are judged on the
    input. A null or empty text has no words and an empty ``kept``. Rows with equal or null ids are texts of their own, so
    a repeated row of 35 words or more loses all its words. An empty table gives no rows.
    """
    docs = rowed(docs.drop("n_words", "n_removed", "kept", "kept_sha256"))
    together = with_ranges(docs, repeated_windows(docs, id_col, text_col, window, cover, period), text_col).drop(ROW)
    keep = [c for c in together.columns if c != "_ranges"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            n, removed, kept = [], [], []
            for text, ranges in zip(blobs(batch.column(text_col)), batch.column("_ranges").to_pylist(), strict=True):
                words = text.split()
                n.append(len(words))
                for a, b in reversed(np.frombuffer(ranges, "<u4").reshape(-1, 2).tolist()) if ranges else ():
                    del words[a:b]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            arrays = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *arrays], names=[*keep, "n_words", "n_removed", "kept", "kept_sha256"])

    return together.mapInArrow(run, _with(together.drop("_ranges"), "n_words long, n_removed long, kept string, kept_sha256 string"))


def op9_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
v AS (SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, p FROM v WHERE win IN (SELECT win FROM v GROUP BY win HAVING count(*) > 1)),
x AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM r),
k AS (SELECT d.doc_id, d.i, d.word FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d) d LEFT JOIN x USING (doc_id, i) WHERE x.i IS NULL),
t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
