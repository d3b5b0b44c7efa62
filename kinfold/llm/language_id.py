"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter, sized by the n-grams of the richest language, holds in each slot one bit for each language. The AND of an n-gram's slots is the
set of languages that contain it. Hits of each language are counted over a text, corrected for false positives, and decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.bpe import _with
from kinfold.llm.common import fold, mix, slices, staged, strings, table

#: Slots of the filter for each n-gram of the richest language, the least and most of them (powers of two), and hashes.
LOAD, FEWEST, SLOTS, HASHES = 8, 1 << 16, 1 << 24, 3
#: A language contains an n-gram if its rate there is at least this share of its highest rate in any language.
SHARE = 0.25
UNKNOWN = "und"
#: Bytes of text that a worker turns into trigrams at once: they take about sixty times as much.
SLICE = 1 << 18
_U = np.uint64
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigram around each letter (three code points of 21 bits; what is no letter is a space) and its text's number."""
    low = [t.lower() for t in texts]
    whole = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le"), "<u4")
    is_letter = _letters()[whole]
    at = np.flatnonzero(is_letter)
    c = np.where(is_letter, whole, 32).astype(np.uint64)
    keys = (c[at - 1] << _U(42)) | (c[at] << _U(21)) | c[at + 1]
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)
    return keys, np.searchsorted(ends, at - 1, "right")


def slots_of(keys: np.ndarray, slots: int, hashes: int = HASHES) -> list[np.ndarray]:
    h = mix(keys + _U(0x9E3779B97F4A7C15))
    step = (h >> _U(32)) | _U(1)
    return [((h + _U(j) * step) & _U(slots - 1)).astype(np.int64) for j in range(hashes)]


class _Tally:
    """Counts of keys, merged now and then."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        found = np.unique(keys, return_counts=True)
        self.parts.append(found)
        self.size += len(found[0])
        if self.size > 1 << 20:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys = np.concatenate([k for k, _ in self.parts])
        n = np.concatenate([n for _, n in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.parts = [(keys[starts], np.add.reduceat(n, starts))] if len(keys) else []
        self.size = len(starts)
        return self.parts[0] if self.parts else (keys, n)


class Filter:
    """What ``fit`` returns: languages, the filter's planes (64 languages each) and each language's false-positive rate."""

    def __init__(self, languages: list[str], planes: np.ndarray, rates: np.ndarray):
        self.languages, self.planes, self.rates = languages, planes, rates

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        keys, at = trigrams(texts)
        total = np.bincount(at, minlength=len(texts))
        hits = np.zeros((len(self.languages), len(texts)))
        places = slots_of(keys, self.planes.shape[1])
        some = np.flatnonzero(total)
        begins = np.concatenate([[0], np.cumsum(total)])[some]
        for p, plane in enumerate(self.planes):
            mask = plane[places[0]]
            for place in places[1:]:
                mask &= plane[place]
            for bit in range(min(64, len(self.languages) - 64 * p)):
                if len(some):
                    hits[64 * p + bit, some] = np.add.reduceat((mask >> _U(bit)) & _U(1), begins)
        names, scores = [], []
        for i, n in enumerate(total.tolist()):
            if not n or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            own = np.clip((hits[:, i] / n - self.rates) / np.maximum(1 - self.rates, 1e-9), 0, 1)
            best = int(own.argmax())
            names.append(self.languages[best])
            scores.append(float(own[best]))
        return names, scores


def size_of(sizes: list[tuple[int, int, int]]) -> tuple[int, int]:
    """The least count of an n-gram and the number of slots, from (language, power of two of the count, n-grams)."""
    least = 0
    while True:
        richest: dict[int, int] = {}
        for language, power, size in sizes:
            if power >= least:
                richest[language] = richest.get(language, 0) + size
        slots = max(FEWEST, 1 << (LOAD * max(richest.values(), default=1) - 1).bit_length())
        if slots <= SLOTS:
            return 1 << least, slots
        least += 1


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Filter:
    """Learns from all rows with a text and a language. Counts are summed by task, then by key.

    The filter has LOAD slots for each n-gram of the richest language, rounded up to a power of two, so about one n-gram in
    thirty is a false positive at most. Where that were over SLOTS slots, n-grams need a higher count to enter, the least
    power of two that makes them fit.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, _Tally] = {}
        for batch in slices(batches, text_col, SLICE):
            texts, langs = strings(batch.column(text_col)), batch.column(lang_col).to_pylist()
            keys, at = trigrams(texts)
            names = sorted({x for x in langs if x is not None})
            number = np.array([names.index(x) if x is not None else -1 for x in langs])
            for k, name in enumerate(names):
                tallies.setdefault(name, _Tally()).add(keys[number[at] == k])
        for name, tally in tallies.items():
            keys, n = tally.merge()
            for a in range(0, len(keys), 1 << 16):
                part = keys[a : a + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part), pa.array(n[a : a + (1 << 16)], pa.int64())], names=["lang", "key", "n"])

    counts = staged(docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, lang_col).mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")), "trigrams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    planes = np.zeros(((len(languages) + 63) // 64, FEWEST), np.uint64)
    if languages:
        spark = docs.sparkSession
        numbered = spark.createDataFrame([(x, i, float(totals[x])) for i, x in enumerate(languages)], "lang string, number int, total double")
        rates = counts.join(F.broadcast(numbered), "lang").withColumn("rate", F.col("n") / F.col("total"))
        best = rates.groupBy("key").agg(F.max("rate").alias("best"))
        held = rates.join(best, "key").where(F.col("rate") >= SHARE * F.col("best")).select("key", "number", "n")
        # How many n-grams of each language have a count of 1, 2 to 3, 4 to 7, ...
        sizes = held.groupBy("number", F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("size")).collect()
        least, slots = size_of([(r.number, r.power, r.size) for r in sizes])
        held = held.where(F.col("n") >= least).select("key", "number")
        planes = np.zeros((len(planes), slots), np.uint64)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(languages) // 64 + 1, slots), np.uint64)
            for batch in batches:
                number = batch.column("number").to_numpy().astype(np.uint64)
                for slot in slots_of(batch.column("key").to_numpy().astype(np.int64).view(np.uint64), slots):
                    for p in range(len(out)):
                        own = number // _U(64) == _U(p)
                        np.bitwise_or.at(out[p], slot[own], _U(1) << (number[own] % _U(64)))
            for p in range(len(out)):
                slot = np.flatnonzero(out[p])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), p, np.int32)), pa.array(slot.astype(np.int32)), pa.array(out[p][slot].view(np.int64))], names=["plane", "slot", "bits"])

        found = held.mapInArrow(place, "plane int, slot int, bits long").groupBy("plane", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
        planes[found.column("plane").to_numpy(), found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    fill = np.array([((planes[i // 64] >> _U(i % 64)) & _U(1)).mean() for i in range(len(languages))])
    return Filter(languages, planes, fill**HASHES)


def predict(docs: DataFrame, model: Filter, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (0 to 1: the share of the text's trigrams that the language contains).

    A text that is null or has no letter is ``und`` with score 0; of equal scores the first name wins. Rows keep all their
    columns, those named like results are replaced; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, SLICE):
            names, scores = shared.value.predict(strings(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, _with(docs, "lang_pred string, lang_score double"))


def training(docs: DataFrame) -> DataFrame:
    return docs.where(fold(F.col("doc_id"), 4) != 2)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), fit(training(docs)))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
