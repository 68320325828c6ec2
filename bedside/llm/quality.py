"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text (shares of character classes, word and line repetition, lengths) are binned
at quantiles; trees are grown level by level from gradient histograms, with logistic loss, and
flattened into arrays (feature, threshold, children, value). Scoring walks all trees of a batch
of documents at once with numpy.

Training uses a bounded sample: at most ``sample`` labelled documents, those of least hash of
their id. Their statistics are collected, never their texts; everything else runs over all
documents where they are read. Neither label, language, source nor id is an input.

Null and empty texts have the statistics of an empty text and a score as any other. Repeated
labels of a document count once (the greatest); null labels not at all. Without a labelled
document every score is 0.5, with labels of one kind the smoothed share of that kind.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedside.llm import common

SAMPLE, TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, RIDGE = 20_000, 80, 4, 48, 0.15, 4.0, 1.0
THRESHOLD = 0.3

_CLASS = np.full(256, 5, dtype=np.int64)  # other signs
_CLASS[ord("a"):ord("z") + 1], _CLASS[ord("A"):ord("Z") + 1], _CLASS[ord("0"):ord("9") + 1] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[128:] = 3, 4
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 6
_CLASS[[ord(c) for c in "!"]] = 7
_CLASS[[ord(c) for c in "#$%&*@"]] = 8
_CLASS[[ord(c) for c in "|<>{}[]=/\\_~^+"]] = 9

NAMES = ("log_bytes", "log_words", "lower", "upper", "digits", "space", "beyond_ascii", "other", "stops", "exclamations",
         "marks", "code_marks", "word_length", "distinct_words", "top_word", "doubled_words", "capital_words", "marked_words",
         "short_words", "long_words", "lines", "repeated_lines", "line_length", "ended_lines", "distinct_bytes", "byte_pairs")


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text, all finite."""
    raw = common.is_null_or(text)
    data = np.frombuffer(raw, dtype=np.uint8)
    n = max(len(data), 1)
    bytes_seen = np.bincount(data, minlength=256)
    shares = np.bincount(_CLASS, weights=bytes_seen, minlength=10) / n
    words = raw.split()
    m = max(len(words), 1)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    k = max(len(lines), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    last = b"".join([w[-1:] for w in words])
    first = b"".join([w[:1] for w in words])
    ends, starts = _CLASS[np.frombuffer(last, np.uint8)], _CLASS[np.frombuffer(first, np.uint8)]
    return [
        np.log1p(len(data)), np.log1p(len(words)), shares[0], shares[1], shares[2], shares[3], shares[4], shares[5],
        shares[6], shares[7], shares[8], shares[9], lengths.mean() if len(words) else 0.0, len(seen) / m,
        max(seen.values(), default=0) / m, sum(map(bytes.__eq__, words, words[1:])) / m, float((starts == 1).sum()) / m,
        float((ends >= 7).sum()) / m, float((lengths <= 2).sum()) / m, float((lengths >= 15).sum()) / m,
        np.log1p(len(lines)), 1 - len(set(lines)) / k, np.log1p(len(data) / k),
        sum(x.endswith((b".", b"?", b"!", b":")) for x in lines) / k, (bytes_seen > 0).sum() / 256.0,
        float((data[1:] == data[:-1]).sum()) / n]


def measured(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    rows = common.packed(docs, keep, _text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(x, pa.list_(pa.float64()))], ["_row", "_x"])

    return rows.mapInArrow(run, common.with_fields(rows.select("_row"), "_x array<double>")).select("_row.*", "_x")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trees:
    """Full trees of one depth as arrays: node i has children 2i + 1 and 2i + 2."""

    def __init__(self, start: float, depth: int) -> None:
        self.start, self.depth = start, depth
        self.feature: np.ndarray = np.empty((0, 2 ** depth - 1), np.int64)
        self.threshold: np.ndarray = np.empty((0, 2 ** depth - 1))
        self.value: np.ndarray = np.empty((0, 2 ** depth))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.value):
            return np.full(len(x), sigmoid(np.array([self.start]))[0])
        tree, row = np.arange(len(self.value))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.value)), np.int64)
        for _ in range(self.depth):
            right = x[row, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        return sigmoid(self.start + self.value[tree, node - (2 ** self.depth - 1)].sum(axis=1))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees by second-order boosting on histograms; a node that gains nothing by a split sends all rows left."""
    kinds = len(set(y.tolist()))
    share = (y.sum() + 1) / (len(y) + 2)
    model = Trees(float(np.log(share / (1 - share))), depth)
    if kinds < 2:
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    total = np.full(len(y), model.start)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = sigmoid(total)
        gradient, hessian = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, np.inf)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            best = np.full(width, 1e-9)
            chosen = [(0, np.inf, BINS)] * width
            for f, b in enumerate(bins):
                at = (node - first) * BINS + b
                g = np.bincount(at, gradient, width * BINS).reshape(width, BINS)
                h = np.bincount(at, hessian, width * BINS).reshape(width, BINS)
                gl, hl = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
                gs, hs = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
                gain = gl ** 2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs ** 2 / (hs + RIDGE)
                gain[(hl < LEAST_WEIGHT) | (hs - hl < LEAST_WEIGHT)] = 0
                gain = gain[:, :len(edges[f])]
                if not gain.shape[1]:
                    continue
                cut = gain.argmax(axis=1)
                for i in np.flatnonzero(gain[np.arange(width), cut] > best):
                    best[i], chosen[i] = gain[i, cut[i]], (f, edges[f][cut[i]], cut[i])
            for i, (f, t, _) in enumerate(chosen):
                feature[first + i], threshold[first + i] = f, t
            limit = np.array([c for *_, c in chosen])[node - first]
            node = 2 * node + 1 + (bins[feature[node], np.arange(len(y))] > limit)
        leaf = node - (2 ** depth - 1)
        value = RATE * np.bincount(leaf, gradient, 2 ** depth) / (np.bincount(leaf, hessian, 2 ** depth) + RIDGE)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    model.feature, model.threshold, model.value = np.stack(features), np.stack(thresholds), np.stack(values)
    return model


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE) -> Trees:
    """Learns from at most ``sample`` labelled documents outside the held-out fifth."""
    chosen = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
              .groupBy(F.col(key).alias("_id")).agg((F.max(label) > 0).alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(sample))
    # the sample is bounded, so it may be broadcast whatever the size of the labels
    few = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = (measured(few, ["_id", "_y"], "_text").groupBy("_id").agg(F.min(F.struct("_x", "_y")).alias("r"))
            .select("_id", "r.*").orderBy("_id").collect())
    x = np.array([r["_x"] for r in rows]).reshape(len(rows), len(NAMES))
    return boost(x, np.array([float(r["_y"]) for r in rows]))


def score(docs: DataFrame, model: Trees, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``score`` double."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = common.packed(docs, keep, _text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column("_text").to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(shared.value.score(x))], ["_row", "score"])

    return rows.mapInArrow(run, common.with_fields(rows.select("_row"), "score double")).select("_row.*", "score")


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels), ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier doesn't reject, with their columns."""
    rows = docs.select(F.struct("*").alias("_doc"), F.col("text").alias("_t"))
    return score(rows, train(docs, labels), ["_doc"], "_t").where(F.col("score") >= THRESHOLD).select("_doc.*")
