"""Phrase collocations: frequent phrases and how much more often their parts meet than by chance.

Texts are cut into shards of bounded size. In a shard every word has a compressed position bitmap, the nonzero bytes of it;
a slot without a word stands at each piece boundary, so no phrase crosses one. A phrase is extended by a word: its bitmap is
shifted by one position and ANDed with the word's, byte by byte where both have one, and the popcount is how often the longer
phrase occurs. Phrases are extended depth first, a bounded group of first words at a time, and popcounts are added up over
shards.

Whether a phrase is frequent shows only over all shards. A first pass adds up the popcounts of words and word pairs by hash
slot; slots that reach the least count are the bits of a filter of bounded size. The next pass does so for phrases of three
words all of whose parts have their bits, and so on. The last pass counts only phrases that have their bits, exactly. The
filter leaves out nothing that is frequent, so its size decides the work and not the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import blobs, mix, release, slices, staged, table
from kinfold.llm.repeats import partitions

#: Bytes of text in a shard; the least and the most hash slots of the filter as powers of two: a bit each, so 64 MB in the
#: driver and in each worker at most. In between there is a slot for four bytes of input; for input
#: of unknown size the last number holds.
SHARD_BYTES, SLOT_BITS, UNKNOWN_BITS = 12 << 20, (24, 29), 27
#: Bitmap bytes of the first words of a group that is extended at once.
GROUP = 1 << 18
#: Lower case, one kind of space, and one kind of piece boundary.
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t" + b".,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"\n" * 10)
_U = np.uint64


class Bitmaps:
    """Compressed bitmaps of phrases: ``owner``, ``block`` and ``bits`` of each nonzero byte, by owner and block."""

    def __init__(self, owner: np.ndarray, block: np.ndarray, bits: np.ndarray):
        self.owner, self.block, self.bits = owner, block, bits

    def part(self, a: int, b: int) -> Bitmaps:
        return Bitmaps(self.owner[a:b], self.block[a:b], self.bits[a:b])

    def shifted(self) -> Bitmaps:
        """Each phrase's bitmap moved on by one position."""
        over = np.flatnonzero(self.bits & np.uint8(128))
        low = (self.bits << np.uint8(1)).astype(np.uint8)
        kept = np.flatnonzero(low)
        return Bitmaps(np.concatenate([self.owner[kept], self.owner[over]]), np.concatenate([self.block[kept], self.block[over] + 1]), np.concatenate([low[kept], np.ones(len(over), np.uint8)]))


class Shard:
    """The words of some texts, as bitmaps over one line of positions."""

    def __init__(self, texts: list[bytes]):
        line = b"\n".join(texts).translate(_FOLD).replace(b"\n", b" \n ")
        kind = pa.large_binary() if len(line) > 1 << 30 else pa.binary()
        tokens = pc.split_pattern(pa.array([line], kind), b" ").values
        tokens = tokens.filter(pc.greater(pc.binary_length(tokens), 0)).dictionary_encode()
        self.words, ids = tokens.dictionary, tokens.indices.to_numpy(zero_copy_only=False)
        gap = self.words.index(pa.scalar(b"\n", self.words.type)).as_py()
        at = np.flatnonzero(ids != gap)
        self.n = len(at)
        key = ids[at].astype(np.int64) << 32 | at
        key.sort()
        word, at = key >> 32, key & 0xFFFFFFFF
        self.bitmaps = _folded(word, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        self.blocks = int(at.max(initial=-1) >> 3) + 2

    def hashes(self, lang: str) -> np.ndarray:
        """A hash of each word in its language."""
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words.to_pylist()), _U, len(self.words))

    def counts(self) -> np.ndarray:
        """How often each word occurs: the popcount of its bitmap."""
        return np.bincount(self.bitmaps.owner, np.bitwise_count(self.bitmaps.bits), len(self.words)).astype(np.int64)

    def only(self, kept: np.ndarray) -> None:
        """Leaves out the bitmaps of other words; their positions stay empty."""
        m = self.bitmaps
        on = kept[m.owner]
        self.bitmaps = Bitmaps(m.owner[on], m.block[on], m.bits[on])

    def groups(self) -> Iterator[Bitmaps]:
        """The words' bitmaps in groups of whole words."""
        m, a = self.bitmaps, 0
        while a < len(m.owner):
            b = a + GROUP
            # A group ends where a word ends; a word with more bytes is a group of its own.
            b = len(m.owner) if b >= len(m.owner) else int(np.searchsorted(m.owner, m.owner[b], "left"))
            b = b if b > a else int(np.searchsorted(m.owner, m.owner[a], "right"))
            yield m.part(a, b)
            a = b

    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each block's words begin, the words by block, and their bits."""
        m = self.bitmaps
        order = np.argsort(m.block << 32 | m.owner)
        starts = np.searchsorted(m.block[order], np.arange(self.blocks + 1))
        return starts, m.owner[order], m.bits[order]

    def extended(self, phrases: Bitmaps, index: tuple, allowed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, Bitmaps]:
        """Phrases with one more word: ``prefix``, ``word``, ``count`` of each, and their bitmaps, whose owners number them.

        ``allowed(prefix, word)`` leaves out extensions before they are counted.
        """
        starts, words, bits = index
        moved = phrases.shifted()
        sizes = starts[moved.block + 1] - starts[moved.block]
        each = np.repeat(np.arange(len(sizes)), sizes)
        other = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[moved.block], sizes)
        both = moved.bits[each] & bits[other]
        hit = np.flatnonzero(both)
        each, other, both = each[hit], other[hit], both[hit]
        key = moved.owner[each] << 32 | words[other]
        order = np.argsort(key)
        key, block, both = key[order], moved.block[each[order]], both[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        prefix, word = key[first] >> 32, key[first] & 0xFFFFFFFF
        sizes = np.diff(np.append(first, len(key)))
        if allowed is not None:
            ok = allowed(prefix, word)
            on = np.repeat(ok, sizes)
            prefix, word, sizes, block, both = prefix[ok], word[ok], sizes[ok], block[on], both[on]
        owner = np.repeat(np.arange(len(prefix)), sizes)
        count = np.bincount(owner, np.bitwise_count(both), len(prefix)).astype(np.int64)
        return prefix, word, count, _folded(owner, block, both)


def _folded(owner: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Bitmaps:
    """One byte for each owner and block, of rows that come by owner."""
    if not len(owner):
        return Bitmaps(owner, block, bits)
    same = (owner[1:] == owner[:-1]) & (block[1:] == block[:-1])
    if not same.any():
        first = np.arange(len(owner))
    else:
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        bits = np.bitwise_or.reduceat(bits, first)
    return Bitmaps(owner[first], block[first], bits)


def _hashed(h: list[np.ndarray]) -> np.ndarray:
    """A hash of each phrase, from the hashes of its first, second, ... words."""
    out = h[0]
    for x in h[1:]:
        out = mix(out * _U(0x9E3779B97F4A7C15) + (x ^ (x >> _U(29))) * _U(0xD6E8FEB86659FD93))
    return out


class Filter:
    """A bit for each hash slot in which a phrase may be frequent."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, _U(64 - (len(bits) * 8 - 1).bit_length())

    def slots(self, h: np.ndarray) -> np.ndarray:
        return (mix(h.copy()) >> self.shift).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = self.slots(h)
        return (self.bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def extensions(shard: Shard, h: np.ndarray, filtered: Filter, longest: int, exact: bool) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Phrases of 2 to ``longest`` words by depth: the numbers of their first, second, ... words, and their counts.

    ``h`` has the words' hashes. Phrases are extended as long as they have their bits in the filter. The longest ones have
    to have their own only if ``exact``; their first and last parts, a word shorter, always have theirs.
    """
    index = shard.index()
    for group in shard.groups():
        words: list[np.ndarray] = [np.arange(len(h))]
        for n in range(2, longest + 1):
            if not len(group.owner):
                break

            def allowed(prefix: np.ndarray, word: np.ndarray, words=words, n=n) -> np.ndarray:
                own = [h[w[prefix]] for w in words] + [h[word]]
                ok = filtered.has(_hashed(own[1:])) if n > 2 else np.ones(len(word), bool)
                return ok & filtered.has(_hashed(own)) if exact or n < longest else ok

            prefix, word, count, group = shard.extended(group, index, allowed)
            words = [w[prefix] for w in words] + [word]
            yield words, count


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Shard]]:
    """Shards of one language each, from batches of ``text`` and ``lang``."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), blobs(batch.column("text")), strict=True):
            held.setdefault(lang, []).append(text)
            size += len(text)
        if size >= SHARD_BYTES:
            yield from ((lang, Shard(texts)) for lang, texts in held.items())
            held, size = {}, 0
            release()
    yield from ((lang, Shard(texts)) for lang, texts in held.items())
    release()


def _sent(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _received(packed: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def frequent_slots(docs: DataFrame, least: int, longest: int) -> Filter:
    """The filter of phrases of up to ``longest`` words that occur ``least`` times or more over all shards."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bits = min(max(size.bit_length() - 2, SLOT_BITS[0]), SLOT_BITS[1]) if size < 1 << 60 else UNKNOWN_BITS
    found = Filter(np.zeros(1 << (bits - 3), np.uint8))
    for words in range(2, max(longest, 2) + 1):
        found = Filter(found.bits | _surveyed(docs, least, words, found))
    return found


def _surveyed(docs: DataFrame, least: int, words: int, before: Filter) -> np.ndarray:
    """Bits of slots in which phrases of ``words`` words, or of one and two, occur ``least`` times or more."""
    spark, top, n = docs.sparkSession, min(least, 65535), len(before.bits) * 8
    buckets = 1 << max(6, min(12, (partitions(spark, docs) - 1).bit_length()))
    width, shared = n // buckets, spark.sparkContext.broadcast(before)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filtered = shared.value
        for lang, shard in shards(batches):
            h = shard.hashes(lang)
            slots, counts = ([filtered.slots(h)], [shard.counts()]) if words == 2 else ([], [])
            if words > 2:
                shard.only(filtered.has(h))
            for own, count in extensions(shard, h, filtered, words, exact=False):
                if len(own) == words:
                    slots.append(filtered.slots(_hashed([h[w] for w in own])))
                    counts.append(count)
            slot = np.concatenate([np.empty(0, np.int64), *slots])
            count = np.concatenate([np.empty(0, np.int64), *counts])
            # Equal slots add up; more than the least count says no more than it does.
            order = np.argsort(slot)
            slot, count = slot[order], count[order]
            starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.empty(0, np.int64)
            count = np.minimum(np.add.reduceat(count, starts) if len(slot) else count, top).astype(np.uint16)
            slot = slot[starts]
            cuts = np.searchsorted(slot, np.arange(buckets + 1) * width)
            keys = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
            gaps = [_sent(np.diff(slot[cuts[b] : cuts[b + 1]] - b * width, prepend=0).astype(np.uint32)) for b in keys]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(gaps, pa.binary()), pa.array([_sent(count[cuts[b] : cuts[b + 1]]) for b in keys], pa.binary())], names=["bucket", "slots", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, slots, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "slots", "counts")), strict=True):
                total = sums.setdefault(b, np.zeros(width, np.uint16))
                at = np.cumsum(_received(slots, np.uint32), dtype=np.int64)
                total[at] = np.minimum(total[at].astype(np.int64) + _received(counts, np.uint16), top)
        for b, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(total >= top).tobytes()], pa.binary())], names=["bucket", "bits"])

    sent = docs.mapInArrow(survey, "bucket int, slots binary, counts binary")
    bits = np.zeros((buckets, width // 8), np.uint8)
    for row in sent.repartition(buckets, "bucket").mapInArrow(added, "bucket int, bits binary").collect():
        bits[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.ravel()


def phrase_counts(docs: DataFrame, least: int = 10, longest: int = 3) -> DataFrame:
    """``lang``, ``phrase``, ``words``, ``count`` of every phrase of up to ``longest`` words that occurs ``least`` times or
    more in its language; the row with a null phrase counts all word occurrences.

    ``docs`` has text and lang. A phrase's words are joined by one space. A null or empty text has no words, a null language
    is ``und``, and repeated rows count again.
    """
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_slots(docs, least, longest))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filtered = shared.value

        def rows(lang: str, phrases: pa.Array, words: int, count: np.ndarray) -> pa.RecordBatch:
            n = len(phrases)
            return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(n, np.int64))), phrases.cast(pa.string()), pa.array(np.full(n, words, np.int32)), pa.array(count)], names=["lang", "phrase", "words", "count"])

        for lang, shard in shards(batches):
            h, counts = shard.hashes(lang), shard.counts()
            yield rows(lang, pa.nulls(1, pa.string()), 0, np.array([shard.n], np.int64))
            kept = filtered.has(h) & (counts > 0)
            shard.only(kept)
            here = np.flatnonzero(kept)
            yield rows(lang, shard.words.take(pa.array(here)), 1, counts[here])
            space = pa.scalar(b" ", shard.words.type)
            for own, count in extensions(shard, h, filtered, longest, exact=True):
                texts = pc.binary_join_element_wise(*(shard.words.take(pa.array(w)) for w in own), space)
                yield rows(lang, texts, len(own), count)

    found = docs.mapInArrow(counted, "lang string, phrase string, words int, count long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("count").alias("count")).where((F.col("count") >= least) | F.col("phrase").isNull())


def _scored(counts: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``words``, ``a``, ``l``, ``r``, ``score`` of phrases of two words or more, by their lowest cut."""
    whole = counts.where("words >= 2").select("lang", "phrase", "words", F.col("count").alias("a"))
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - words)"))
    part = counts.where("words >= 1")
    for side, n in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part.select("lang", F.col("phrase").alias(side), F.col("count").alias(n)), ["lang", side])
    # Products in decimals of 38 digits; the score itself is 1,000,000 at most, as neither part is rarer than the whole.
    whole_number = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    cuts = cuts.withColumn("above", (whole_number("a", 15) * whole_number("a", 15) * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")).withColumn("below", (whole_number("l", 15) * whole_number("r", 15)).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    lowest = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return lowest.select("lang", "phrase", "words", "a", "x.l", "x.r", "x.score")


def _covered(counts: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``most``: phrases inside longer ones, with the count of the most frequent of these."""
    inside = """flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> array_join(slice(split(phrase, ' '), i, n), ' '))))"""
    longer = counts.where("words >= 3").select("lang", F.explode(F.expr(inside)).alias("phrase"), "count")
    return longer.groupBy("lang", "phrase").agg(F.max("count").alias("most"))


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, first: int = 2000) -> DataFrame:
    """Each language's ``first`` collocations: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase of 2 to ``longest`` words counts from ``least`` occurrences on (``a``). Cut into two parts that occur l and r
    times it scores floor(1,000,000 a a / (l r)); the lowest cut counts, of equal ones the first. Phrases whose words lie
    inside a longer one with ``share`` percent of their occurrences go. Order: score, then a, descending, then the
    phrase by its bytes; ``n`` is the number of the language's words. A language without candidates has no rows.
    """
    counts = staged(phrase_counts(docs, least, longest), "phrases")
    rows = _scored(counts).join(_covered(counts), ["lang", "phrase"], "left")
    rows = rows.where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).select("lang", "phrase", "a", "l", "r", "score")
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))

    def best(df: DataFrame, *by: Column | str) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= first)

    # In parts first, so that a language of any size leaves a bounded number of rows to its last task.
    parts = best(rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))), "lang", "part").drop("rank", "part")
    totals = counts.where("phrase IS NULL").select("lang", F.col("count").alias("n"))
    return best(parts, "lang").join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of two and three words in ``documents``, the first 2,000 of each language."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
o AS (SELECT lang, unnest(flatten(list_transform(range(1, 4), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS phrase FROM w),
c AS (SELECT lang, phrase, len(phrase) - len(replace(phrase, ' ', '')) + 1 AS words, count(*) AS f FROM o GROUP BY lang, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE words = 1 GROUP BY lang),
b AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM c WHERE words >= 2 AND f >= 10),
k AS (SELECT b.*, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM b, (SELECT unnest([1, 2]) AS k) WHERE k < words),
s AS (SELECT k.lang, k.phrase, words, a, k, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM k JOIN (SELECT lang, phrase, f FROM c) l ON l.lang = k.lang AND l.phrase = x JOIN (SELECT lang, phrase, f FROM c) r ON r.lang = k.lang AND r.phrase = y),
z AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
g AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM b WHERE words = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM b WHERE words = 3) GROUP BY lang, phrase)
SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, z.phrase) AS rank, z.phrase, a, l, r, n, score FROM z JOIN n USING (lang) LEFT JOIN g ON g.lang = z.lang AND g.phrase = z.phrase WHERE g.most IS NULL OR 100 * g.most < 50 * a
QUALIFY row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, z.phrase) <= 2000"""
