"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Items become sequences of word numbers and enter one automaton. The words of each document stream through it; the length
of the longest match that ends at each word says which words lie inside a window of an item.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.bpe import _with
from kinfold.llm.common import ROW, blobs, rowed, slices, table

WINDOW = 10
#: Bytes of item texts in one block: what one broadcast and one automaton hold. More items are matched block after block.
BLOCK_BYTES = 8 << 20
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPANS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """Words of digits, letters a-z and all beyond ASCII; A-Z are lower-cased. A multi-byte character never splits."""
    return text.translate(_WORD).split()


class Automaton:
    """A suffix automaton of several sequences of word numbers.

    ``step`` follows a stream; ``short[state]`` are the lengths of items, shorter than a window, that end a state's
    strings.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items_of: dict[tuple[int, ...], list[str]] = {}
        ends: dict[int, int] = {}
        self.shorts: set[int] = set()
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if not ids:
                continue
            last = 0
            for c in ids:
                last = self._extend(last, c)
            for i in range(max(1, len(ids) - window + 1)):
                names = self.items_of.setdefault(tuple(ids[i : i + window]), [])
                if not names or names[-1] != name:
                    names.append(name)
            if len(ids) < window:
                self.shorts.add(len(ids))
        self.least = min([window, *self.shorts])

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, c)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[p] + 1 == length[q] else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def matches(self, ids: list[int]) -> list[int]:
        """The longest match that ends at each word of the stream."""
        nxt, link, length = self.next, self.link, self.length
        state = run = 0
        out = []
        for c in ids:
            while c not in nxt[state]:
                state = link[state]
                if state < 0:
                    break
                run = length[state]
            if state < 0:
                state = run = 0
            else:
                state = nxt[state][c]
                run += 1
            out.append(run)
        return out

    def search(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie inside an occurrence of a window, as a mask, and the items with such windows."""
        n, least, window = len(words), self.least, self.window
        hit, names = None, set()
        if n >= least and self.vocabulary:
            ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, n)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]])))
            starts, ends = edges[::2], edges[1::2]
            for a, b in zip(starts[(long := ends - starts >= least)].tolist(), ends[long].tolist(), strict=True):
                part = ids[a:b].tolist()
                for e, run in enumerate(self.matches(part), 1):
                    if run < least:
                        continue
                    for size in (*self.shorts, window) if self.shorts else (window,):
                        if run >= size and (found := self.items_of.get(tuple(part[e - size : e]))):
                            hit = np.zeros(n, bool) if hit is None else hit
                            hit[a + e - size : a + e] = True
                            names.update(found)
        return hit, names


def _blocks(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of about ``limit`` bytes of text, dealt by a hash of the text."""
    total = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-2 * total // limit) if total > limit else 1)
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64(text_col), F.lit(n)) == k)
        rows = block.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).collect()
        yield [(r[0], words_of((r[1] or "").encode())) for r in rows]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, clean: bool = False) -> DataFrame:
    """Finds windows of ``window`` item words (an item of fewer words is one window) in each text of ``docs``.

    Returns all columns of ``docs`` plus ``n_words``, ``n_hit`` (words inside an occurrence), ``items`` (ids as
    strings, sorted; an item with a null id has the empty one) and, with ``clean``, ``clean_text``: the text without
    hit words and what stands between two of them (null where nothing is hit). A null or empty text has no words, an
    item without words matches nothing, equal rows give equal results and empty tables no rows or no hits. Columns of
    ``docs`` that have the names of results are replaced. One block needs one pass and no shuffle; further blocks add a
    pass each and one shuffle of the hits by row.
    """
    docs = docs.drop("n_words", "n_hit", "items", "clean_text")
    blocks = _blocks(items, item_id, item_text, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    context = docs.sparkSession.sparkContext
    if second is None:
        return docs.mapInArrow(_searcher(context.broadcast(first), window, text_col, list(docs.columns), clean), _with(docs, "n_words long, n_hit long, items array<string>" + ", clean_text string" * clean))
    docs = rowed(docs)
    parts, block = [], first
    while block is not None:
        parts.append(docs.select(ROW, text_col).mapInArrow(_searcher(context.broadcast(block), window, text_col, [ROW], False, hits=True), f"`{ROW}` long, hits binary, items array<string>"))
        block, second = second, next(blocks, None)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.groupBy(ROW).agg(F.collect_list("hits").alias("_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = docs.join(found, ROW, "left").drop(ROW)
    kind = T.StructType([f for f in merged.schema if f.name not in ("_hits", "items")])
    return merged.mapInArrow(_merger(text_col, [f.name for f in kind], clean), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind) + ", n_words long, n_hit long, items array<string>" + ", clean_text string" * clean)


def without(text: str, hit: np.ndarray) -> str:
    """The text without hit words and without what stands between two hit words next to each other."""
    spans = [m.span() for m in _SPANS.finditer(text)]
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "".join([*out, text[at:]])


_AUTOMATA: dict[int, Automaton] = {}


def _searcher(shared, window: int, text_col: str, keep: list[str], clean: bool, hits: bool = False):
    key = shared._jbroadcast.id() if hasattr(shared, "_jbroadcast") and shared._jbroadcast is not None else id(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[key] = Automaton(shared.value, window)
        machine = _AUTOMATA[key]
        for batch in slices(batches, text_col):
            words, n_hit, names, texts, packed = [], [], [], [], []
            for text in blobs(batch.column(text_col)):
                own = words_of(text)
                hit, found = machine.search(own)
                words.append(len(own))
                n_hit.append(0 if hit is None else int(hit.sum()))
                names.append(sorted(found))
                if hits:
                    packed.append(b"" if hit is None else np.flatnonzero(hit).astype("<i8").tobytes())
                if clean:
                    texts.append(None if hit is None else without(text.decode(), hit))
            out = [*(batch.column(k) for k in keep)]
            if hits:
                yield pa.RecordBatch.from_arrays([*out, pa.array(packed, pa.binary()), pa.array(names, pa.list_(pa.string()))], names=[*keep, "hits", "items"]).filter(pa.array(n_hit, pa.int64()).cast(pa.bool_()))
                continue
            out += [pa.array(words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.string())] * clean, names=[*keep, "n_words", "n_hit", "items", *["clean_text"] * clean])

    return run


def _merger(text_col: str, keep: list[str], clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            words, n_hit, texts = [], [], []
            for text, parts in zip(blobs(batch.column(text_col)), batch.column("_hits").to_pylist(), strict=True):
                n = len(words_of(text))
                hit = np.zeros(n, bool)
                for x in parts or ():
                    hit[np.frombuffer(x, "<i8")] = True
                words.append(n)
                n_hit.append(int(hit.sum()))
                if clean:
                    texts.append(without(text.decode(), hit) if parts else None)
            items = pa.array([x or [] for x in batch.column("items").to_pylist()], pa.list_(pa.string()))
            out = [*(batch.column(k) for k in keep), pa.array(words, pa.int64()), pa.array(n_hit, pa.int64()), items]
            yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.string())] * clean, names=[*keep, "n_words", "n_hit", "items", *["clean_text"] * clean])

    return run


def remove_contamination(docs: DataFrame, items: DataFrame, max_hit: int = 0, max_coverage: float = 0.5, **options) -> DataFrame:
    """``docs`` (same columns) after removal: a text with more than ``max_hit`` hit words loses its hit spans; a text
    of which more than ``max_coverage`` is hit goes as a whole. Other rows stay as they are."""
    found = contamination(docs, items, clean=True, **options)
    over = F.col("n_hit") > max_hit
    kept = found.where(~over | (F.col("n_hit") <= F.col("n_words") * max_coverage))
    return kept.withColumn("text", F.when(over, F.col("clean_text")).otherwise(F.col("text"))).select(*docs.columns)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, least(10, len(w)) AS size, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
hit AS (SELECT doc_id, p, size, win FROM dw WHERE win IN (SELECT win FROM iw)),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS x FROM hit) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit JOIN iw USING (size, win)) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
