"""Suffix-array dedup: windows of 50 bytes that start in a text with a smaller id are removed.

Suffixes are sorted only where they can matter. The smallest hash of the 16-byte strings in a window (its minimizer) is
the same wherever the window stands, so windows whose minimizer no other text has are out, and equal windows meet in one
bucket. There the suffixes of the remaining segments are ordered deep-shallow: multikey quicksort on 8-byte characters to
a shallow depth, then blind tries, which skip the common prefix of each remaining group and branch on the next byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.bpe import _with
from kinfold.llm.common import ROW, blobs, joined, mix, rowed, slices, spans, table
from kinfold.llm.repeats import RANGES_SCHEMA, Block, buckets_of, flagged_blocks, partitions, range_rows, repeated_anchors, with_ranges

LENGTH, GRAM = 50, 16
#: Characters of 8 bytes that the multikey quicksort takes; what is equal so far goes to the blind tries.
SHALLOW = 2
#: Bytes of segments that a task gathers before it sends them on; windows sorted at once.
BUFFER, AT_ONCE = 16 << 20, 1 << 17
_U = np.uint64
_LAST = (1 << 63) - 1
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15


def minimizers(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The minimizer of the window at each byte of the joined texts, and where each text starts in them."""
    whole, starts = joined(texts)
    n = len(whole)
    if n < length:
        return np.empty(0, np.uint64), starts
    width = 1
    # Hashes of 1, 2, 4, 8, 16 bytes by doubling.
    part = _BYTE[whole]
    power = _BASE
    while width < gram:
        part = part[:-width] * _U(power) + part[width:]
        power = power * power % (1 << 64)
        width *= 2
    h, span = mix(part), length - gram + 1
    size = 1
    least = h
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(h) - span + 1], least[span - size : span - size + len(h) - span + 1])
    # Smallest hashes are small: an odd factor spreads them over all numbers again, and so over the buckets.
    return least * _U(_BASE), starts


def _windows_of(starts: np.ndarray, i: int, length: int) -> tuple[int, int]:
    return int(starts[i]), int(max(starts[i], starts[i + 1] - length + 1))


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    least, starts = minimizers(texts, length)
    found, at = [], []
    for i in range(len(texts)):
        a, b = _windows_of(starts, i, length)
        if b > a:
            own = least[a:b]
            own = np.unique(own[np.concatenate([[True], own[1:] != own[:-1]])])
            found.append(own)
            at.append(np.full(len(own), i))
    return (np.concatenate(found), np.concatenate(at)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))


class Ordered:
    """Windows in suffix order: ``rank`` of each, equal for equal windows of a group and for no others, and the blind tries.

    ``tries``: for each inner node the place of its first window in the order, how many windows are below it, and the byte
    on which they branch.
    """

    def __init__(self, rank: np.ndarray, tries: np.ndarray):
        self.rank, self.tries = rank, tries


def ordered_windows(windows: np.ndarray, group: np.ndarray) -> Ordered:
    """Deep-shallow order of the rows of ``windows`` (bytes), group by group.

    Multikey quicksort takes characters of 8 bytes to the depth ``SHALLOW``: the windows of a group are split three ways
    by a pivot, and only those equal to it go on to the next character. What is still together goes to blind tries.
    """
    n, length = windows.shape
    _, number, sizes = np.unique(group, return_inverse=True, return_counts=True)
    rank = (np.cumsum(sizes) - sizes)[number].astype(np.int64)
    shallow = min(SHALLOW, length // 8)
    chars = np.ascontiguousarray(windows[:, : 8 * shallow]).view(">u8").astype(np.uint64) if shallow else np.empty((n, 0), np.uint64)
    depth = np.zeros(n, np.int64)
    alive = _together(rank, np.arange(n))
    while len(live := alive[depth[alive] < shallow]):
        order = live[np.argsort(rank[live], kind="stable")]
        own, char = rank[order], chars[order, depth[order]]
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        many = np.diff(np.append(heads, len(order)))
        three = np.stack([char[heads], char[heads + many // 2], char[heads + many - 1]])
        pivot = np.repeat(np.sort(three, axis=0)[1], many)
        side = (char > pivot).astype(np.int64) - (char < pivot)
        depth[order[side == 0]] += 1
        _split(rank, order, side)
        alive = _together(rank, alive)
    tries = []
    while len(alive):
        # The first window stands for its node; the first byte where any differs from it is the branch.
        order = alive[np.argsort(rank[alive], kind="stable")]
        own = rank[order]
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        many = np.diff(np.append(heads, len(order)))
        differs = windows[order] != windows[np.repeat(order[heads], many)]
        column = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
        branch = np.minimum.reduceat(column, heads)
        inner = branch < length
        tries.append(np.stack([own[heads][inner], many[inner], branch[inner]], axis=1))
        below = np.repeat(inner, many)
        order, branch = order[below], np.repeat(branch, many)[below]
        _split(rank, order, windows[order, branch].astype(np.int64))
        alive = _together(rank, order)
    return Ordered(rank, np.concatenate([np.empty((0, 3), np.int64), *tries]))


def _together(rank: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Those of ``alive`` that share their rank with another."""
    _, inverse, counts = np.unique(rank[alive], return_inverse=True, return_counts=True)
    return alive[counts[inverse] > 1]


def _split(rank: np.ndarray, order: np.ndarray, by: np.ndarray) -> None:
    """Splits windows of equal rank by ``by``: each part begins where the smaller ones end."""
    again = np.lexsort((by, rank[order]))
    order, by = order[again], by[again]
    own = rank[order]
    heads = np.concatenate([[True], own[1:] != own[:-1]])
    fresh = np.flatnonzero(heads | np.concatenate([[True], by[1:] != by[:-1]]))
    starts = np.flatnonzero(heads)
    offset = fresh - starts[np.searchsorted(starts, fresh, "right") - 1]
    rank[order] = own + np.repeat(offset, np.diff(np.append(fresh, len(order))))


#: A segment: hash of its minimizer, its row and id, where it starts, its bytes; ``known``: a smaller id has it in the same task.
SEGMENT = np.dtype([("top", "<u8"), ("row", "<i8"), ("id", "<i8"), ("start", "<u4"), ("size", "<u4")])


def _portions(flagged: list, limit: int = 1 << 20) -> Iterator[list]:
    """The same texts in lists of about ``limit`` bytes at most."""
    own, size = [], 0
    for x in flagged:
        if own and size + len(x[1]) > limit:
            yield own
            own, size = [], 0
        own.append(x)
        size += len(x[1])
    if own:
        yield own


def repeated_bytes(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """Ranges of bytes, by ROW, that windows cover which start in a text with a smaller id."""
    n = partitions(docs.sparkSession, docs)
    buckets = 4 * n

    def segments(found: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        meta: list[tuple[int, int, int, int, bytes]] = []
        seen: dict[tuple[int, bytes], int] = {}
        done: list[tuple[int, int, int]] = []
        held = 0
        squeeze = zstandard.ZstdCompressor(level=1).compress

        def flush() -> pa.RecordBatch:
            order = sorted(range(len(meta)), key=lambda k: meta[k][0])
            head = np.array([(t, r, d, s, len(b)) for t, r, d, s, b in (meta[k] for k in order)], SEGMENT)
            bucket = (head["top"] * _U(buckets) >> _U(47)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(head) else np.empty(0, np.int64)
            keys, bases, packed = [], [], []
            for a, b in spans(cuts, len(head)):
                keys.append(int(bucket[a]))
                bases.append(int(b - a))
                packed.append(squeeze(head[a:b].tobytes() + b"".join(meta[k][4] for k in order[a:b])))
            if done:
                x = np.array(done, np.int64)
                ranges = range_rows(x[:, 0], x[:, 1], x[:, 2])
                blks = ranges.column("blk").to_pylist()
                keys += [-1 - b for b in blks]
                bases += blks
                packed += ranges.column("ranges").to_pylist()
            meta.clear()
            seen.clear()
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bases, pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "base", "packed"])

        for block, flagged in ((b, part) for b in found for part in _portions(b.flagged)):
            least, starts = minimizers([t for _, t, _ in flagged], length)
            for j, (i, text, tops) in enumerate(flagged):
                a, b = _windows_of(starts, j, length)
                if b <= a:
                    continue
                own = least[a:b]
                fresh = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                top = own[fresh] >> _U(17)
                ends = np.concatenate([fresh[1:], [len(own)]])
                hit = np.isin(top, tops)
                row, key = block.first + i, int(block.ids[i])
                for t, s, e in zip(top[hit].tolist(), fresh[hit].tolist(), ends[hit].tolist(), strict=True):
                    piece = text[s : e + length - 1]
                    k = seen.get((t, piece))
                    if k is None:
                        seen[t, piece] = len(meta)
                        meta.append((t, row, key, s, piece))
                        held += len(piece) + 200
                    elif meta[k][2] < key:
                        done.append((row, s, s + len(piece)))
                    elif meta[k][2] > key:
                        done.append((meta[k][1], meta[k][3], meta[k][3] + len(piece)))
                        meta[k] = (t, row, key, s, piece)
                    else:  # the same id: what holds for one holds for the other
                        meta.append((t, row, key, s, piece))
                        held += len(piece) + 200
            if held > BUFFER:
                yield flush()
                held = 0
        if meta or done:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, bases, packed in buckets_of(batches):
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([pa.array(bases, pa.int64()), pa.array(packed, pa.binary())], names=["blk", "ranges"])
            else:
                yield ordered([(b, p) for b, p in zip(bases, packed, strict=True)], length)

    flags = repeated_anchors(docs, lambda t: anchors(t, length), False, text_col)
    dealt = flagged_blocks(docs, flags, id_col, text_col, segments, "bucket long, base long, packed binary")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, RANGES_SCHEMA)


def _period(piece: bytes, most: int) -> int:
    """The smallest p up to ``most`` with which the whole piece repeats itself, else 0."""
    return next((p for p in range(1, most + 1) if piece[p:] == piece[:-p]), 0)


def _dealt(views: np.ndarray, at: np.ndarray, seg: np.ndarray, offset: np.ndarray) -> Iterator[np.ndarray]:
    """The windows in parts of about AT_ONCE, equal ones together: a minimizer may have any number of segments."""
    n = max(1, -(-len(seg) // AT_ONCE))
    if n == 1:
        yield np.arange(len(seg))
        return
    key = np.empty(len(seg), np.uint64)
    for a in range(0, len(seg), AT_ONCE):
        own = views[at[seg[a : a + AT_ONCE]] + offset[a : a + AT_ONCE]]
        ends = [np.ascontiguousarray(x).view("<u8").ravel() for x in (own[:, :8], own[:, -8:], own[:, 20:28])]
        key[a : a + AT_ONCE] = mix(ends[0] * _U(3) + ends[1] * _U(5) + ends[2] * _U(7))
    for k in range(n):
        part = np.flatnonzero(key % _U(n) == k)
        if len(part):
            yield part


def ordered(parts: list[tuple[int, bytes]], length: int) -> pa.RecordBatch:
    """What the segments of one bucket remove, as ranges."""
    expand = zstandard.ZstdDecompressor().decompress
    heads, texts = [], []
    for count, packed in parts:
        raw = expand(packed)
        heads.append(np.frombuffer(raw, SEGMENT, count))
        texts.append(raw[count * SEGMENT.itemsize :])
    head = np.concatenate(heads)
    joined_ = b"".join(texts)
    ends = np.cumsum(head["size"].astype(np.int64))
    at = ends - head["size"]
    # Equal segments are one variant with its smallest id; any other id loses the whole segment.
    seen: dict[tuple[int, bytes], int] = {}
    variant = np.fromiter((seen.setdefault((t, joined_[a:b]), len(seen)) for t, a, b in zip(head["top"].tolist(), at.tolist(), ends.tolist(), strict=True)), np.int64, len(head))
    least = np.full(len(seen), _LAST, np.int64)
    np.minimum.at(least, variant, head["id"])
    del seen
    whole = head["id"] > least[variant]
    rows, starts, stops = [head["row"][whole]], [head["start"][whole].astype(np.int64)], [(head["start"] + head["size"])[whole].astype(np.int64)]
    # The rest stands for its variant (several rows only where ids are equal): windows decide between variants of a minimizer.
    _, one = np.unique(variant, return_index=True)
    one = one[np.argsort(head["top"][one], kind="stable")]
    top = head["top"][one]
    group = np.cumsum(np.concatenate([[True], top[1:] != top[:-1]])) - 1
    some = np.bincount(group)[group] > 1
    one, group = one[some], group[some]
    counts = head["size"][one].astype(np.int64) - length + 1
    # A segment of one repeated string has only as many different windows as its period is long.
    period = np.zeros(len(one), np.int64)
    for k in np.flatnonzero(counts > length).tolist():
        period[k] = _period(joined_[at[one[k]] : ends[one[k]]], length)
    own_counts = np.where(period > 0, np.minimum(counts, period), counts)
    views = sliding_window_view(np.frombuffer(joined_, np.uint8), length)
    lost: dict[int, np.ndarray] = {}
    cuts = spans(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else [], len(group))
    total = np.concatenate([[0], np.cumsum(own_counts)])
    a = 0
    while a < len(cuts):
        b = a + 1
        while b < len(cuts) and total[cuts[b][1]] - total[cuts[a][0]] <= AT_ONCE:
            b += 1
        first, last = cuts[a][0], cuts[b - 1][1]
        own = own_counts[first:last]
        seg = np.repeat(np.arange(first, last, dtype=np.int32), own)
        offset = np.arange(len(seg), dtype=np.int32) - np.repeat((np.cumsum(own) - own).astype(np.int32), own)
        gone = []
        for part in _dealt(views, at[one], seg, offset):
            _, classes = np.unique(ordered_windows(views[at[one[seg[part]]] + offset[part]], group[seg[part]]).rank, return_inverse=True)
            ids = least[variant[one[seg[part]]]]
            smallest = np.full(classes.max() + 1, _LAST, np.int64)
            np.minimum.at(smallest, classes, ids)
            gone.append(part[smallest[classes] < ids])
        gone = np.sort(np.concatenate(gone))
        for x, y in spans(np.flatnonzero(np.concatenate([[True], seg[gone][1:] != seg[gone][:-1]])) if len(gone) else [], len(gone)):
            k = int(seg[gone[x]])
            found = offset[gone[x:y]].astype(np.int64)
            if period[k]:
                found = (found[:, None] + np.arange(0, counts[k], period[k])[None, :]).ravel()
                found = found[found < counts[k]]
            lost[int(variant[one[k]])] = found
        a = b
    for k in np.flatnonzero(~whole & np.isin(variant, np.fromiter(lost, np.int64, len(lost)))).tolist():
        offset = lost[int(variant[k])] + int(head["start"][k])
        rows.append(np.full(len(offset), head["row"][k]))
        starts.append(offset)
        stops.append(offset + length)
    return range_rows(np.concatenate(rows), np.concatenate(starts), np.concatenate(stops))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Removes each byte (UTF-8) covered by a string of ``length`` bytes that also starts in a text with a smaller id.

    Returns all columns of ``docs`` plus ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept`` (binary:
    a cut may split a character) and ``kept_sha256``; columns of ``docs`` with these names are replaced. Overlaps count;
    strings are judged on the input and never cross texts. A null text is an empty one. A null id is larger than any
    other; rows with equal ids remove nothing from each other. An empty table gives no rows.
    """
    docs = rowed(docs.drop("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"))
    together = with_ranges(docs, repeated_bytes(docs, id_col, text_col, length), text_col).drop(ROW)
    keep = [c for c in together.columns if c != "_ranges"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            n, spans, kept = [], [], []
            for text, ranges in zip(blobs(batch.column(text_col)), batch.column("_ranges").to_pylist(), strict=True):
                pairs = np.frombuffer(ranges or b"", "<u4").reshape(-1, 2).tolist()
                stops = [0, *(x for p in pairs for x in p), len(text)]
                n.append(len(text))
                spans.append(len(pairs))
                kept.append(b"".join(text[a:b] for a, b in zip(stops[::2], stops[1::2], strict=True)))
            arrays = [pa.array(n, pa.int64()), pa.array([a - len(k) for a, k in zip(n, kept, strict=True)], pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *arrays], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return together.mapInArrow(run, _with(together.drop("_ranges"), "n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS win FROM (SELECT doc_id, x, unnest(range(0, CAST(length(x) / 2 AS BIGINT) - 49)) AS p FROM d WHERE length(x) >= 100)),
m AS (SELECT win, min(doc_id) AS least FROM w GROUP BY win HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT DISTINCT w.doc_id, w.p FROM w JOIN m USING (win) WHERE m.least < w.doc_id),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM g),
s AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (prior IS NULL OR prior < i - 1) AS n_spans FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prior FROM r) GROUP BY doc_id),
b AS (SELECT doc_id, i, substr(x, 2 * i + 1, 2) AS h FROM (SELECT doc_id, x, unnest(range(0, CAST(length(x) / 2 AS BIGINT))) AS i FROM d)),
k AS (SELECT b.doc_id, string_agg(b.h, '' ORDER BY b.i) AS kept FROM b LEFT JOIN r USING (doc_id, i) WHERE r.i IS NULL GROUP BY b.doc_id)
SELECT doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)
"""
