"""A quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text only: the non-negative risk pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)) of Kiryo et al.
(2017) is minimised, in mini-batches, with a class prior pi that is estimated from positives and unlabelled text alone. No
negative label is ever read. A text is its hashed words and word pairs, and binned numbers that describe its surface.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from kinfold.llm.bpe import _with
from kinfold.llm.common import blobs, fold, joined, mix, slices, table

#: Bounds of the sample that the classifier is fitted on: positives and unlabelled rows.
POSITIVES, UNLABELLED = 10_000, 20_000
#: Bins of a surface number; dimensions of hashed words and word pairs (a power of two).
BINS, HASHED = 8, 1 << 15
#: Steps of the descent (and of the one that estimates the prior), rows of a batch of either kind, rate, weight decay.
STEPS, PRIOR_STEPS, BATCH, RATE, DECAY = 250, 100, 512, 0.05, 1e-3
#: Words whose hashes a worker keeps.
_KEPT = 200_000
_CLASSES = {b"\n": 0, b" \t\r\x0b\x0c": 1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ": 2, b"abcdefghijklmnopqrstuvwxyz": 3, b"0123456789": 4, b".": 5, b",": 6, b"!": 7, b"|": 8, b"#$%&*": 9, b"?;:'\"()-": 10}
_CLASS = np.full(256, 11, np.uint8)
for _chars, _number in _CLASSES.items():
    _CLASS[np.frombuffer(_chars, np.uint8)] = _number
_CLASS[128:] = 12
N_CLASSES = 13


def features(texts: list[bytes]) -> np.ndarray:
    """Numbers that describe each text: shares of kinds of characters, repeated words and lines, lengths."""
    whole, starts = joined(texts)
    hist = np.bincount(np.repeat(np.arange(len(texts)), np.diff(starts)) * N_CLASSES + _CLASS[whole], minlength=len(texts) * N_CLASSES).reshape(-1, N_CLASSES).astype(float)
    n = np.maximum(np.diff(starts), 1).astype(float)
    more = []
    for text in texts:
        words = text.split()
        lines = [x for x in text.split(b"\n") if x]
        w = max(1, len(words))
        more.append((len(words), len(set(words)) / w, sum(map(eq, words, words[1:])) / w, len(set(lines)) / max(1, len(lines)), len(lines)))
    more = np.array(more, float).reshape(len(texts), 5)
    w = np.maximum(more[:, 0], 1)
    letters = np.maximum(hist[:, 2] + hist[:, 3] + hist[:, 12], 1)
    return np.column_stack([hist / n[:, None], hist[:, 2] / letters, (n - hist[:, 0] - hist[:, 1]) / w, hist[:, 5] / w, hist[:, 6] / w, np.log1p(n), np.log1p(more[:, 0]), more[:, 1], more[:, 2], more[:, 3], more[:, 0] / np.maximum(more[:, 4], 1)])


class _Hash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value


_HASH = _Hash()


def hashed(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct dimensions of each text's lower-cased words and pairs of words next to each other."""
    out = []
    for text in texts:
        words = text.lower().split()
        h = np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        out.append(np.unique(mix(np.concatenate([h, pairs])) % np.uint64(HASHED)).astype(np.uint16))
    return out


class Rows:
    """Texts as sparse rows: the numbers of binned surface features and of hashed words, which share a weight of one.

    A hashed word is kept in two bytes; numbers and values are made for the rows that are taken.
    """

    def __init__(self, bins: np.ndarray, words: list[np.ndarray], first: int):
        self.bins, self.first = bins.astype(np.int32), first
        self.starts = np.concatenate([[0], np.cumsum(np.array([len(w) for w in words], np.int64), dtype=np.int64)])
        self.words = np.concatenate([np.empty(0, np.uint16), *words])

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, values, and the places in ``rows`` that they belong to."""
        sizes, k = self.starts[rows + 1] - self.starts[rows], self.bins.shape[1]
        begin = np.cumsum(sizes + k) - sizes - k
        index, value = np.empty(int(sizes.sum()) + k * len(rows), np.int64), np.ones(int(sizes.sum()) + k * len(rows))
        tail = np.ones(len(index), bool)
        head = (begin[:, None] + np.arange(k)).ravel()
        tail[head] = False
        index[head] = self.bins[rows].ravel()
        index[tail] = self.words[np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        index[tail] += self.first
        value[tail] = np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)
        return index, value, np.repeat(np.arange(len(rows)), sizes + k)


class Model:
    """A logistic model over sparse rows."""

    def __init__(self, edges: list[np.ndarray], prior: float):
        self.edges, self.prior = edges, prior
        self.first = len(edges) * (BINS + 1)
        self.weights, self.bias = np.zeros(self.first + HASHED), 0.0

    def rows(self, surface: np.ndarray, words: list[np.ndarray]) -> Rows:
        bins = [np.searchsorted(e, surface[:, j], "right") + j * (BINS + 1) for j, e in enumerate(self.edges)]
        return Rows(np.stack(bins, axis=1), words, self.first)

    def logits(self, rows: Rows) -> np.ndarray:
        out = np.full(len(rows), float(self.bias))
        for a in range(0, len(rows), BATCH):
            which = np.arange(a, min(a + BATCH, len(rows)))
            index, value, at = rows.take(which)
            out[which] += np.bincount(at, self.weights[index] * value, len(which))
        return out

    def score(self, surface: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        """How likely a text is positive if either class were as frequent: a threshold means the same for any prior."""
        return _sigmoid(self.logits(self.rows(surface, words)) - np.log(self.prior / (1 - self.prior)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(model: Model, p: Rows, u: Rows, gradient, steps: int, seed: int = 0) -> None:
    """Adam in mini-batches on ``gradient(logits of positives, logits of unlabelled)``, which gives both derivatives.

    The model is the mean over the second half of the steps, so that it hardly depends on which rows the last batches held.
    """
    rng = np.random.default_rng(seed)
    size = len(model.weights) + 1
    m, v, mean = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        own, other = rng.integers(0, len(p), BATCH), rng.integers(0, len(u), BATCH)
        xp, xu = p.take(own), u.take(other)
        dp, du = gradient(*(np.bincount(at, model.weights[i] * x, BATCH) + model.bias for i, x, at in (xp, xu)))
        g = np.zeros(size)
        for (i, x, at), d in ((xp, dp), (xu, du)):
            g[:-1] += np.bincount(i, d[at] * x, size - 1)
        g[:-1] += DECAY * model.weights
        g[-1] = dp.sum() + du.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE / (1 + 4 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        model.weights -= move[:-1]
        model.bias -= float(move[-1])
        if 2 * step > steps:
            mean[:-1] += model.weights
            mean[-1] += model.bias
    mean /= steps - steps // 2
    model.weights, model.bias = mean[:-1], float(mean[-1])


def _edges(surface: np.ndarray) -> list[np.ndarray]:
    edges = []
    for both in surface.T:
        own = np.unique(np.quantile(both, np.linspace(0, 1, BINS + 1)[1:-1]))
        # Where most values are equal, quantiles of the others still get edges.
        rest = both[both > np.median(both)]
        if len(own) < BINS // 2 and len(rest):
            own = np.unique(np.concatenate([own, np.quantile(rest, [0, 0.25, 0.5, 0.75])]))[:BINS]
        edges.append(own)
    return edges


def estimate_prior(positive: tuple[np.ndarray, list], unlabelled: tuple[np.ndarray, list]) -> float:
    """The share of positives in the unlabelled rows, without any negative label.

    A plain classifier of positives against unlabelled rows is fitted on one half and ranks the other. Above any threshold
    the ratio of unlabelled to positive mass is at least the prior; the least ratio over thresholds is taken, less two of
    its standard errors: a prior that is too high leaves no risk to the negatives.
    """
    part = lambda rows, k: (rows[0][np.arange(len(rows[0])) % 2 == k], [w for i, w in enumerate(rows[1]) if i % 2 == k])
    ratios = []
    for k in (0, 1):
        p, u, p_test, u_test = part(positive, k), part(unlabelled, k), part(positive, 1 - k), part(unlabelled, 1 - k)
        if not all(len(x[0]) for x in (p, u, p_test, u_test)):
            continue
        model = Model(_edges(np.concatenate([u[0], p[0]])), 0.5)
        _descend(model, model.rows(*p), model.rows(*u), lambda x, y: (-_sigmoid(-x) / len(x) / 2, _sigmoid(y) / len(y) / 2), PRIOR_STEPS)
        own, other = model.score(*p_test), model.score(*u_test)
        ratios.append([(other >= c).mean() / (own >= c).mean() for c in np.quantile(own, np.linspace(0.02, 0.3, 30))])
    if not ratios:
        return 0.5
    least = float(np.min(np.mean(ratios, axis=0)))
    error = np.sqrt(max(0.0, least * (1 - least)) / len(unlabelled[0]) + 0.1 * least * least / len(positive[0]))
    return float(np.clip(least - 2 * error, 0.01, 0.99))


def train(positive: tuple[np.ndarray, list], unlabelled: tuple[np.ndarray, list], prior: float | None = None) -> Model:
    """Fits the model on surface numbers and hashed words of trusted positives and unlabelled texts; without a prior it is
    estimated."""
    prior = estimate_prior(positive, unlabelled) if prior is None else prior
    model = Model(_edges(np.concatenate([unlabelled[0], positive[0]])), prior)

    _descend(model, model.rows(*positive), model.rows(*unlabelled), lambda p, x: risk_gradient(prior, p, x), STEPS)
    return model


def risk_gradient(prior: float, p: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the risk by the logits of positives and of unlabelled rows: logistic loss, positives with weight
    ``prior``, and unlabelled rows as negatives less the positives among them. Where that difference is below zero, only it
    is undone."""
    n, u = len(p), len(x)
    negative = np.logaddexp(0, x).mean() - prior * np.logaddexp(0, p).mean()
    if negative < 0:
        return prior * _sigmoid(p) / n, -_sigmoid(x) / u
    return np.full(n, -prior / n), _sigmoid(x) / u


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_positives: int = POSITIVES, max_unlabelled: int = UNLABELLED) -> Model | None:
    """Learns from at most ``max_positives`` texts of label 1 and about ``max_unlabelled`` rows whose labels aren't read.

    Both samples are drawn by a hash of the id. A row of both samples counts in both, so does a repeated row; a document
    that is labelled 1 in any row is a positive whatever its other rows say; null ids and labels are no labels. None where
    there are no positives with a text.
    """
    labels = labels.where(F.col(id_col).isNotNull() & (F.col(label_col) == 1))
    ids = {r[0] for r in labels.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(max_positives).collect()}
    n = docs.count()
    if not ids or not n:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(ids)
    share = min(1.0, max_unlabelled / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            positive = [x in shared.value for x in batch.column(id_col).to_pylist()]
            drawn = batch.column("_draw").to_pylist()
            some = [i for i, (p, d) in enumerate(zip(positive, drawn, strict=True)) if p or d]
            if some:
                texts = blobs(batch.column(text_col))
                texts = [texts[i] for i in some]
                arrays = [pa.array([positive[i] for i in some]), pa.array([drawn[i] for i in some]), pa.array(map(xxh3_128_digest, texts), pa.binary()), pa.array([r.tobytes() for r in features(texts)], pa.binary()), pa.array([w.tobytes() for w in hashed(texts)], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["positive", "drawn", "digest", "x", "words"])

    drawn = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = docs.select(id_col, text_col, drawn.alias("_draw")).mapInArrow(run, "positive boolean, drawn boolean, digest binary, x binary, words binary")
    # In one order whatever the partitions and the last digits of features; sorted here, as a sort in Spark would compute
    # all features twice.
    sample = sample.toArrow()
    x, words = ([v.as_buffer() for v in sample.column(k)] for k in ("x", "words"))  # views: nothing is copied
    flags = [sample.column(k).to_pylist() for k in ("positive", "drawn")]
    digests = sample.column("digest").to_pylist()
    order = sorted(range(len(x)), key=lambda i: (digests[i], flags[0][i], flags[1][i]))
    x, words = np.array([np.frombuffer(x[i], float) for i in order]), [np.frombuffer(words[i], np.uint16) for i in order]
    positive, drawn = (np.flatnonzero([f[i] for i in order]) for f in flags)
    rows = lambda at: (x[at], [words[i] for i in at])
    return train(rows(positive), rows(drawn)) if len(positive) and len(drawn) else None


def score(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with ``out``, from 0 to 1, higher for better text. A null text is an empty one and is scored like it;
    without a model all scores are 0.5. Equal texts have equal scores. Rows keep all their columns; one named ``out`` is replaced."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = blobs(batch.column(text_col))
            found = shared.value.score(features(texts), hashed(texts)) if shared.value else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, _with(docs, f"`{out}` double"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learnt = fold(F.col("doc_id"), 5) != 0
    model = fit(docs.where(learnt), table(spark, sf_dir, "labels").where(learnt))
    found = score(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
