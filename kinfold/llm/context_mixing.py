"""Language-model scores by logistic context mixing, and the unigram base score.

A text is its UTF-8 bytes and one end byte of zero. Each byte is eight binary decisions. Predictors of orders 0 to 4 and
of the word so far (its last eight bytes) keep bit counts in tables of hashed contexts; their stretched probabilities are
added with weights that a gate chooses by the confidence of the two longest contexts and the bit's place, and an adaptive
map refines the result. The bits of a text are the sum of the costs of its decisions.

Training covers every byte of the training texts. A decision depends on the last bytes only, so the corpus is gathered
once as counts of its distinct windows (four bytes, the word so far, the next byte), which grow with the corpus. Table
counts come from them, and the weights are learnt online, in mini-batches, each window predicted from counts without
itself. Which windows a fitting task has, and their order, follow from their hashes and their number alone, and sums over
tasks are whole numbers: the model doesn't depend on partitions. Scoring keeps the model as it is, so a text's score
doesn't depend on the order of rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import filterfalse, repeat
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import ROW, blobs, fold, joined, mix, release, rowed, slices, spans, staged, table
from kinfold.llm.repeats import _Rows, buckets_of, partitions

#: Most slots of each predictor's table (powers of two), for orders 0 to 4 and the word; smaller corpora get smaller tables.
SLOTS = (1 << 10, 1 << 18, 1 << 20, 1 << 20, 1 << 21, 1 << 22)
ORDERS = range(len(SLOTS))
#: Distinct windows that a task holds while it counts, and while it fits.
HELD, FIT_WINDOWS = 1 << 20, 1 << 21
#: Words in the broadcast tier of the base score, and the most bytes of such a word.
TOP, LONGEST = 200_000, 64
#: Places (a power of two) for windows whose costs a worker keeps.
MET = 1 << 20
BATCH, RATE = 2048, 0.03
#: Mean counts that a window weighs at most in one batch.
_HEAVIEST = 64
_U = np.uint64
_GATES, _STEPS, _BLOCK = 8 * 16, 33, 1 << 15
#: Words, and their bytes, that a task holds while it counts.
_WORDS, _WORD_BYTES = 300_000, 16 << 20


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte (and the end) of each text, and how many of them each text has.

    Low bits: the byte, then the four bytes before it (zeros before the start); above them 24 bits of a hash of the word
    so far.
    """
    whole, starts = joined(texts, 9)  # the end byte, then eight zeros before the next text
    whole = np.concatenate([np.zeros(8, np.uint8), whole])
    n = len(whole) - 8
    x = np.zeros(n, np.uint64)
    for k in range(4, 9):
        x <<= _U(8)
        x |= whole[k : k + n]
    word = np.zeros(n, np.uint32)
    inside = np.ones(n, bool)
    letter = whole > 32
    letters = (whole.astype(np.uint32) + np.uint32(1)) * letter
    for k in range(7, -1, -1):
        inside &= letter[k : k + n]
        word *= np.uint32(0x9E3779B1)
        word += letters[k : k + n] * inside
    x |= (word >> np.uint32(8)).astype(np.uint64) << _U(40)
    texts_only = np.ones(n, bool)
    texts_only[(starts[1:, None] - np.arange(1, 9)).ravel()] = False
    return x[texts_only], np.diff(starts) - 8


_ODD = _U(0x9E3779B97F4A7C15)


def slots_for(windows: int, most: tuple[int, ...] | None = None) -> tuple[int, ...]:
    """Table sizes for a number of distinct windows: each brings up to eight decisions to each table."""
    need = 1 << max(16, (8 * windows - 1).bit_length())
    return tuple(min(size, need) for size in (most or SLOTS))


def context_hash(x: np.ndarray, order: int) -> np.ndarray:
    """A hash of a predictor's context; the last predictor's is the word so far."""
    if order < len(SLOTS) - 1:
        return mix(((x >> _U(8)) & _U((1 << 8 * order) - 1)) << _U(4) | _U(order))
    return mix((x >> _U(40)) << _U(12) | ((x >> _U(8)) & _U(255)) << _U(4) | _U(15))


def context_hashes(x: np.ndarray) -> list[np.ndarray]:
    return [context_hash(x, o) for o in ORDERS]


def node_of(x: np.ndarray, bit: int) -> np.ndarray:
    """The bits of the byte that come before one of its decisions, below a one."""
    return (_U(1) << _U(bit)) | ((x & _U(255)) >> _U(8 - bit))


def slot_of(context: np.ndarray, node: np.ndarray, size: int) -> np.ndarray:
    """The slot of a decision in a table of ``size`` slots."""
    return ((context + node * _ODD) >> _U(65 - size.bit_length())).view(np.int64)


def bit_of(x: np.ndarray, bit: int) -> np.ndarray:
    return ((x >> _U(7 - bit)) & _U(1)).astype(np.float32)


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The stretch of (n1 + 0.2) / (n0 + n1 + 0.4), finite for any counts."""
    return np.log((n1 + np.float32(0.2)) / (n0 + np.float32(0.2)))


def level(n: np.ndarray) -> np.ndarray:
    """How well a context is known, from 0 to 3."""
    return (n > 0).astype(np.uint8) + (n > 3) + (n > 20)


class Mixer:
    """Bit counts, gated weights and the adaptive map."""

    def __init__(self, n0: list[np.ndarray], n1: list[np.ndarray]):
        self.n0, self.n1 = n0, n1  # arrays by predictor
        self.weights = np.full((_GATES, len(ORDERS) + 1), 0.3, np.float32)
        self.weights[:, -1] = 0
        self.map0 = self.map1 = np.zeros((256, _STEPS))

    def inputs(self, x: np.ndarray, contexts: list[np.ndarray], bit: int, without: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Stretched predictions, with one occurrence of the window's own bit taken out of the counts, and gates."""
        node, z, gate = node_of(x, bit), [], bit * 16
        for o in ORDERS:
            slot = slot_of(contexts[o], node, len(self.n0[o]))
            a, b = (np.maximum(n[o][slot].astype(np.float32) - (without == y), 0) for y, n in enumerate((self.n0, self.n1)))
            z.append(stretched(a, b))
            if o >= len(ORDERS) - 2:
                gate = gate + level(a + b).astype(np.int64) * (4 if o == len(ORDERS) - 2 else 1)
        return [*z, np.full(len(x), 0.3, np.float32)], gate

    def logit(self, z: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        total = self.weights[gate, 0] * z[0]
        for k in range(1, len(z)):
            total += self.weights[gate, k] * z[k]
        return total

    def learn(self, x: np.ndarray, n: np.ndarray, seed: int = 0) -> None:
        """Online gradient descent on coding cost over windows with counts, batch after batch."""
        rng = np.random.default_rng(seed)
        # A window weighs as often as it occurs. What a few occur most often goes to several batches, so none drowns.
        most = _HEAVIEST * int(np.ceil(n.mean()))
        times = -(-n // most)
        weight = np.repeat(n / times, times)
        x, weight = np.repeat(x, times), (weight / n.mean()).astype(np.float32)
        order = rng.permutation(len(x))
        for step, a in enumerate(range(0, len(x), BATCH)):
            own = x[order[a : a + BATCH]]
            by, contexts = weight[order[a : a + BATCH]], context_hashes(own)
            rate = RATE / (1 + step / 500)
            for bit in range(8):
                y = bit_of(own, bit)
                z, gate = self.inputs(own, contexts, bit, y)
                error = (y - squash(self.logit(z, gate))) * by
                scale = rate / 8 / np.sqrt(np.maximum(np.bincount(gate, minlength=_GATES), 1))
                for k in range(len(z)):
                    self.weights[:, k] += (scale * np.bincount(gate, error * z[k], _GATES)).astype(np.float32)

    def place(self, x: np.ndarray, logit: np.ndarray) -> np.ndarray:
        """The cell of the adaptive map: the byte before, and the logit in steps."""
        return ((x >> _U(8)) & _U(255)).astype(np.int64) * _STEPS + np.rint((np.clip(logit, -12, 12) + 12) * ((_STEPS - 1) / 24)).astype(np.int64)

    def frozen(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A mixer that learns no more: one stretched prediction for each slot."""

    def __init__(self, mixer: Mixer):
        both = [(a.astype(np.float32), b.astype(np.float32)) for a, b in zip(mixer.n0, mixer.n1, strict=True)]
        self.z = [stretched(a, b) for a, b in both]
        self.levels = [level(a + b) for a, b in both[-2:]]
        self.weights, self.place = mixer.weights, Mixer(mixer.n0[:0], mixer.n1[:0]).place
        self.map0, self.map1 = mixer.map0.ravel(), mixer.map1.ravel()
        self.met = self.paid = None

    def lookup(self) -> None:
        """Places for the windows that a worker meets, by a hash, and their costs, which are the same wherever a window
        stands. An empty place holds a window whose hash leads elsewhere."""
        self.met, self.paid = np.zeros(MET, np.uint64), np.zeros(MET)
        zero = self.spot(self.met[:1])
        self.met[zero] = next(x for x in range(1, 99) if self.spot(np.array([x], np.uint64)) != zero)

    @staticmethod
    def spot(x: np.ndarray) -> np.ndarray:
        h = x * _ODD
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        return (h >> _U(65 - MET.bit_length())).view(np.int64)

    def totals(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The summed costs of the windows of each text; windows that were met before cost a lookup."""
        if self.met is None:
            self.lookup()
        spot = self.spot(x)
        cost = self.paid[spot]
        new = np.flatnonzero(self.met[spot] != x)
        if len(new):
            own, where = np.unique(x[new], return_inverse=True)
            paid = self.costs(own)
            cost[new] = paid[where]
            spot = self.spot(own)
            self.met[spot] = own
            # Of several windows for one place the last was kept: the cost has to be its own.
            kept = self.met[spot] == own
            self.paid[spot[kept]] = paid[kept]
        return np.add.reduceat(cost, np.cumsum(sizes) - sizes)

    def costs(self, x: np.ndarray) -> np.ndarray:
        """Log10 of the probability of each window's last byte after the others."""
        out = np.empty(len(x))
        for a in range(0, len(x), _BLOCK):
            out[a : a + _BLOCK] = self._costs(x[a : a + _BLOCK])
        return out

    def _costs(self, x: np.ndarray) -> np.ndarray:
        contexts, p = context_hashes(x), np.ones(len(x))
        for bit in range(8):
            node = node_of(x, bit)
            slots = [slot_of(contexts[o], node, len(self.z[o])) for o in ORDERS]
            gate = bit * 16 + 4 * self.levels[0][slots[-2]].astype(np.int64) + self.levels[1][slots[-1]]
            logit = self.weights[gate, -1] * np.float32(0.3)
            for o in ORDERS:
                logit += self.weights[gate, o] * self.z[o][slots[o]]
            one = squash(np.clip(logit, -12, 12).astype(np.float64))
            cell = self.place(x, logit)
            n0, n1 = self.map0[cell], self.map1[cell]
            one = np.clip((one + (n1 + 4 * one) / (n0 + n1 + 4)) / 2, 1e-6, 1 - 1e-6)
            p *= np.where(bit_of(x, bit) > 0, one, 1 - one)
        return np.log10(p)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(n, starts)


PAIR = np.dtype([("x", "<u8"), ("n", "<u4")])
WHOLE = np.dtype([("x", "<u8"), ("n", "<i8")])


def place_of(x: np.ndarray, parts: int) -> np.ndarray:
    """The part of each window, by ranges of its hash."""
    return ((mix(x.copy()) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def window_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts of the distinct windows of all texts, packed by bucket: summed in the map task, then by key."""
    parts = partitions(docs.sparkSession)
    buckets = 4 * parts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, rows = 0, _Rows()

        def flush() -> pa.RecordBatch:
            x, n = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            bucket = place_of(x, buckets)
            order = np.argsort(bucket, kind="stable")
            pairs = np.empty(len(x), PAIR)
            pairs["x"], pairs["n"] = x[order], n[order]
            for k, part in enumerate(np.split(pairs, np.searchsorted(bucket[order], np.arange(1, buckets)))):
                if len(part):
                    rows.add(k, 0, part)
            return rows.batch()

        for batch in slices(batches, text_col, 1 << 20):
            x, _ = windows(blobs(batch.column(text_col)))
            found = np.unique(x, return_counts=True)
            held.append(found)
            size += len(found[0])
            if size > HELD:
                merged = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
                held[:] = [merged]
                size = len(merged[0])
                if size > HELD // 2:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, _, packed in buckets_of(batches):
            pairs = np.frombuffer(b"".join(packed), PAIR)
            x, n = _summed(pairs["x"], pairs["n"].astype(np.int64))
            out = np.empty(len(x), np.dtype([("x", "<u8"), ("n", "<i8")]))
            out["x"], out["n"] = x, n
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([len(x)], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["bucket", "size", "packed"])

    dealt = docs.select(text_col).mapInArrow(deal, "bucket long, base long, packed binary")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "bucket long, size long, packed binary")


def _dealt(gathered: DataFrame, tasks: int) -> DataFrame:
    """The windows of each fitting task, by ranges of their hashes."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("packed").to_pylist():
                whole = np.frombuffer(packed, WHOLE)
                part = place_of(whole["x"], tasks)
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]])) if len(part) else []
                found = [(int(part[order[a]]), whole[order[a:b]].tobytes()) for a, b in spans(cuts, len(part))]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["task", "packed"])

    return gathered.select("packed").mapInArrow(deal, "task int, packed binary").repartition(tasks, "task").sortWithinPartitions("task")


def _by_task(batches: Iterator[pa.RecordBatch], run) -> Iterator[pa.RecordBatch]:
    """``run`` on the number, windows and counts of each fitting task of a partition."""
    now, held = None, []
    for batch in batches:
        for task, packed in zip(batch.column("task").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if task != now and held:
                yield from run(now, *_windows_of(held))
                held = []
            now = task
            held.append(packed)
    if held:
        yield from run(now, *_windows_of(held))
    release()


def _windows_of(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    whole = np.concatenate([np.frombuffer(x, WHOLE) for x in held])
    held.clear()
    order = np.argsort(whole["x"], kind="stable")
    return whole["x"][order], whole["n"][order]


_PIECES = "part int, order int, piece int, packed binary"


def _piece(part: int, order: int, piece: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in (part, order, piece)), pa.array([values.astype("<i8").tobytes()], pa.binary())], names=["part", "order", "piece", "packed"])


def _add(part: pa.Table) -> pa.Table:
    whole = 0
    for x in part.column("packed"):
        whole = whole + np.frombuffer(x.as_buffer(), "<i8")
    return pa.table([pa.array([part.column(k)[0].as_py()], pa.int32()) for k in ("part", "order", "piece")] + [pa.array([whole.tobytes()], pa.binary())], names=["part", "order", "piece", "packed"])


def _added(pieces: DataFrame, tasks: int, fan_in: int = 16) -> DataFrame:
    """The sum of each piece over all tasks, in whole numbers, by a tree: no group ever holds more than ``fan_in`` arrays."""
    while True:
        pieces = pieces.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).groupBy("part", "order", "piece").applyInArrow(_add, _PIECES)
        tasks = -(-tasks // fan_in)
        if tasks <= 1:
            return pieces


#: Parts of one in which learnt weights are summed.
_FINE = 1 << 20


def weighted(part: int, n: int, weights: np.ndarray) -> pa.RecordBatch:
    """What a task learnt, as a piece to add: its number of windows in thousands, then its weights times that number."""
    share = max(1, n // 1000)
    return _piece(part, 0, 0, np.concatenate([[share], np.rint(weights.ravel().astype(float) * _FINE).astype(np.int64) * share]))


def averaged(pieces: DataFrame, tasks: int) -> np.ndarray:
    """The mean of the weights of all tasks, by their numbers of windows."""
    whole = np.frombuffer(_added(pieces, tasks).toArrow().column("packed")[0].as_py(), "<i8").astype(float)
    return (whole[1:] / whole[0] / _FINE).reshape(_GATES, -1).astype(np.float32)


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of zeros and ones as 16 bits each: both are halved until they fit, which keeps their ratio."""
    for batch in batches:
        out = []
        for x in batch.column("packed"):
            both = np.frombuffer(x.as_buffer(), "<i8").reshape(2, -1)
            bits = np.maximum(0, np.ceil(np.log2(np.maximum(both.max(axis=0), 1) + 1)).astype(np.int64) - 16)
            out.append((both >> bits).astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("piece"), pa.array(out, pa.binary())], names=["order", "piece", "packed"])


def fit(docs: DataFrame, text_col: str = "text") -> Scorer | None:
    """Trains on every text. None where there are no rows."""
    spark = docs.sparkSession
    gathered = staged(window_counts(docs, text_col), "windows")
    total = gathered.agg(F.sum("size")).first()[0] or 0
    if not total:
        return None
    tasks = max(1, -(-total // FIT_WINDOWS))
    gathered = staged(_dealt(gathered, tasks), "windows-dealt")
    slots = slots_for(total)

    def each(run) -> DataFrame:
        return gathered.repartition(tasks, "task").sortWithinPartitions("task").mapInArrow(lambda b: _by_task(b, run), _PIECES)

    def tables(task: int, x: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for o in ORDERS:
            size, context = slots[o], context_hash(x, o)
            counts = np.zeros((2, size), np.int64)
            for bit in range(8):
                y, slot = bit_of(x, bit) > 0, slot_of(context, node_of(x, bit), size)
                for value in (0, 1):
                    own = y == value
                    counts[value] += np.bincount(slot[own], n[own], size).astype(np.int64)
            for piece in range(16):
                yield _piece(task, o, piece, counts[:, piece * size // 16 : (piece + 1) * size // 16])

    summed = _added(each(tables), tasks).select("order", "piece", "packed").mapInArrow(_halved, "order int, piece int, packed binary").toArrow()
    n0, n1 = [np.zeros(size, np.uint16) for size in slots], [np.zeros(size, np.uint16) for size in slots]
    for o, piece, packed in zip(summed.column("order").to_pylist(), summed.column("piece").to_pylist(), summed.column("packed"), strict=True):
        part = slice(piece * slots[o] // 16, (piece + 1) * slots[o] // 16)
        n0[o][part], n1[o][part] = np.frombuffer(packed.as_buffer(), "<u2").reshape(2, -1)
    del summed
    model = Mixer(n0, n1)
    shared = spark.sparkContext.broadcast(model)

    def learn(task: int, x: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = Mixer(shared.value.n0, shared.value.n1)
        own.learn(x, n)
        yield weighted(task, int(n.sum()), own.weights)

    model.weights = averaged(each(learn), tasks)
    weights = model.weights

    def refine(task: int, x: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(shared.value.n0, shared.value.n1)
        mixer.weights = weights
        both = np.zeros((2, 256 * _STEPS))
        for a in range(0, len(x), _BLOCK):
            own, times = x[a : a + _BLOCK], n[a : a + _BLOCK]
            contexts = context_hashes(own)
            for bit in range(8):
                y = bit_of(own, bit)
                cell = mixer.place(own, mixer.logit(*mixer.inputs(own, contexts, bit, y)))
                for value in (0, 1):
                    both[value] += np.bincount(cell[y == value], times[y == value], 256 * _STEPS)
        yield _piece(task, 0, 0, both)

    maps = _added(each(refine), tasks).toArrow()
    model.map0, model.map1 = np.frombuffer(maps.column("packed")[0].as_py(), "<i8").reshape(2, 256, _STEPS).astype(float)
    shared.destroy()
    return model.frozen()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` (bytes) and ``c`` over all texts: summed in the map task, then by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(counts)
            for a in range(0, len(words), 1 << 16):
                part = words[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "c"])
            counts.clear()

        for batch in slices(batches, text_col):
            for text in blobs(batch.column(text_col)):
                counts.update(text.lower().split())
                held += len(text)
            # Its words take no more bytes than what was read since they were last sent on.
            if len(counts) > _WORDS or held > _WORD_BYTES and sum(map(len, counts)) > _WORD_BYTES:
                yield from flush()
                held = 0
        yield from flush()

    return docs.select(text_col).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def scores(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (``id_col`` and ``held_out`` where it is there) with unigram and model scores learnt from ``training``.

    ``n_tokens`` (words and one end), ``n_known`` (tokens that training has), ``train_tokens``, ``base_score`` (add-one
    unigram, log10), ``score`` (log10 of the model's probability of the text) and ``bits_per_byte``. A null text is an
    empty one: its only token is the end. Without training rows nothing is known and the model gives each byte and end
    1/256. Rows with equal ids are scored each; an empty table gives no rows.

    The counts of the ``TOP`` most frequent words are broadcast; rarer words are joined by a shuffle, summed by text first.
    """
    spark = docs.sparkSession
    counts = staged(word_counts(training, text_col), "words")
    texts = training.count()
    n_words, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_train = n_words + texts
    floor = log10(n_train + types + (texts > 0) + 1)
    short = counts.where(F.octet_length("word") <= LONGEST)
    top = (short.orderBy(F.desc("c"), "word").limit(TOP) if types > TOP else short).toArrow()
    known = dict(zip(top.column("word").to_pylist(), top.column("c").to_pylist(), strict=True))
    del top
    all_known = types == len(known)
    least = min(known.values(), default=0)
    model = fit(training, text_col)
    shared = spark.sparkContext.broadcast((known, model))
    keep = [c for c in (id_col, "held_out") if c in docs.columns]
    docs = rowed(docs.select(*dict.fromkeys([*keep, text_col])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        gain, has = {w: log10(c + 1) for w, c in known.items()}.get, known.__contains__
        for batch in slices(batches, text_col, 1 << 20):
            tokens, found, base, rare, times, size = [], [], [], [], [], []
            raw = blobs(batch.column(text_col))
            for text in raw:
                words = text.lower().split()
                others = Counter(filterfalse(has, words))
                tokens.append(len(words) + 1)
                found.append(len(words) - others.total() + (texts > 0))
                base.append(sum(map(gain, words, repeat(0.0))) + log10(texts + 1))
                others = {} if all_known else others
                rare.append(list(others.keys()))
                times.append(list(others.values()))
                size.append(len(text))
            x, sizes = windows(raw)
            model_score = model.totals(x, sizes) if model else sizes * -log10(256)
            arrays = [pa.array(tokens, pa.int64()), pa.array(found, pa.int64()), pa.array(base), pa.array(model_score), pa.array(size, pa.int64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*keep, ROW)), *arrays], names=[*keep, ROW, "n_tokens", "known", "gain", "score", "size", "rare", "times"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in (*keep, ROW))
    found = docs.mapInArrow(run, f"{kinds}, n_tokens long, known long, gain double, score double, size long, rare array<binary>, times array<long>")
    if not all_known:
        found = staged(found, "scores")
        pairs = found.where(F.size("rare") > 0).select(ROW, F.explode(F.arrays_zip("rare", "times")).alias("w")).select(ROW, F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
        # A short word that is not among the most frequent has no higher count than the last of them.
        joined_ = pairs.join(counts.where((F.col("c") <= least) | (F.octet_length("word") > LONGEST)), "word")
        more = joined_.groupBy(ROW).agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("_gain"))
        found = found.join(more, ROW, "left").withColumns({"known": F.col("known") + F.coalesce("_known", F.lit(0)), "gain": F.col("gain") + F.coalesce("_gain", F.lit(0.0))})
    return found.select(
        *keep,
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("gain") - F.col("n_tokens") * floor).alias("base_score"),
        "score",
        (-F.col("score") / log10(2) / (F.col("size") + 1)).alias("bits_per_byte"),
    )


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 7) == 2)
    return scores(docs, docs.where(~F.col("held_out")).select("text"))
