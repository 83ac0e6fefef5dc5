"""Quality classifier (7): random-indexing vectors, pooled per document, and a two-layer numpy network.

Two token streams are read from a text: its words (A-Z as a-z) and its words' shapes (runs of capitals,
small letters, digits and each mark put together). Tokens fall into buckets by hash. Every bucket has a
sparse index vector drawn from its number; a bucket's context vector sums, over all documents of the table,
the index vectors of the two tokens on either side. These sums are whole numbers, so no order of adding
changes them. A document is the mean and the spread of its tokens' unit vectors in both streams, with its
length, its share of distinct words and its share of repeated lines.

A network of one hidden layer is trained in numpy on the bounded sample of labelled rows; a fifth of it
calibrates the temperature that the logit is divided by.

Defined results: null text counts as empty; without labels of both kinds the score is the share of label 1,
0.5 where there are none. Rows without an id teach no label and are not ``held_out``; repeated rows count in the
vectors as often as they stand there and get a row each; an empty table gives none; very long texts are read
whole; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .language import held_out
from .words import PIECE, SPACED, U, Alphabet, map_rows, mix, pieces, words_of

OUT = "doc_id long, held_out boolean, score double, predicted int"
BUCKETS, DIMENSIONS, SLICES, GROUPS = 1 << 13, 24, 64, 1024

_LINES = Alphabet({10, 13}, fold=False)
_KIND = np.arange(256, dtype=np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 65, 97, 48, 97
_KIND[[9, 10, 11, 12, 13, 32]] = 32


class _Shapes(Alphabet):
    """Words hashed by shape: a byte counts only where its kind differs from the one before it."""

    def __init__(self) -> None:
        super().__init__({9, 10, 11, 12, 13, 32}, fold=False)
        self.value = mix(_KIND.astype(U), 78) | U(1)
        self.value[self.separator] = 0

    def _piece(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _KIND[data]
        turn = np.ones(len(data), bool)
        turn[1:] = kind[1:] != kind[:-1]
        turn[starts] = True
        # The runs alone, one byte each; a run belongs to a word as its first byte does.
        keep = np.flatnonzero(turn)
        h, at = super()._piece(data[keep], np.searchsorted(keep, starts))
        return h, keep[at]


SHAPES = _Shapes()


def streams(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket numbers and bounds for both streams; shapes use the second half of the buckets."""
    words, _, bounds = words_of(SPACED, data, offsets)
    shapes, _, own = words_of(SHAPES, data, offsets)
    return [((words >> U(40)).astype(np.int64) % BUCKETS, bounds), ((shapes >> U(40)).astype(np.int64) % BUCKETS + BUCKETS, own)]


def _index(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places and two signs for each bucket."""
    h = mix(np.arange(n, dtype=U), 70)
    first = (h % U(DIMENSIONS)).astype(np.int64)
    second = (first + 1 + (mix(h, 1) % U(DIMENSIONS - 1)).astype(np.int64)) % DIMENSIONS
    return np.stack([first, second]), np.stack([(h >> U(50)) & U(1), (h >> U(51)) & U(1)]).astype(np.float64) * 2 - 1


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all buckets, from all documents. Tasks send sums of a fixed size; so does the result."""
    size = 2 * BUCKETS * DIMENSIONS
    step = size // SLICES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = _index(2 * BUCKETS)
        total = np.zeros(size)
        some = False
        for batch in batches:
            for _, data, offsets in pieces(batch.column("text"), PIECE):
                for tokens, bounds in streams(data, offsets):
                    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                    for gap in (1, 2):
                        same = np.flatnonzero(doc[gap:] == doc[:-gap]) if len(doc) > gap else doc[:0]
                        a, b = tokens[same], tokens[same + gap]
                        for x, y in ((a, b), (b, a)):
                            for k in (0, 1):
                                total += np.bincount(x * DIMENSIONS + place[k][y], sign[k][y], size)
                        some = True
        if some:
            group = TaskContext.get().partitionId() % GROUPS
            held = total.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([group] * SLICES, pa.int32()), pa.array(range(SLICES), pa.int32()), pa.array([held[s * step : (s + 1) * step].tobytes() for s in range(SLICES)], pa.binary())], ["part", "slice", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(step, np.int64)
        for x in table.column("sums"):
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"slice": table.column("slice").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(size)
    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(add, "part int, slice int, sums binary")
    # Two levels, so that no worker holds the sums of more than a part of all tasks.
    once = sums.groupBy("slice", "part").applyInArrow(merge, "slice int, sums binary")
    for r in once.groupBy("slice").applyInArrow(merge, "slice int, sums binary").collect():
        out[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["sums"], np.int64)
    out = out.reshape(2 * BUCKETS, DIMENSIONS)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(column: pa.Array, vectors: np.ndarray) -> Iterator[np.ndarray]:
    """A matrix for each run of rows."""
    for _, data, offsets in pieces(column, PIECE):
        n = len(offsets) - 1
        parts = []
        for tokens, bounds in streams(data, offsets):
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            mean, spread = np.zeros((n, DIMENSIONS)), np.zeros((n, DIMENSIONS))
            if len(full):
                v = vectors[tokens]
                mean[full] = np.add.reduceat(v, bounds[full], axis=0) / size[full, None]
                spread[full] = np.sqrt(np.maximum(np.add.reduceat(v * v, bounds[full], axis=0) / size[full, None] - mean[full] ** 2, 0))
            parts += [mean, spread]
        rest = [np.log1p(np.diff(offsets))]
        for alphabet in (SPACED, _LINES):
            h, _, bounds = words_of(alphabet, data, offsets)
            row = np.repeat(np.arange(n), np.diff(bounds))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
            rest.append(np.bincount(row[new], minlength=n) / np.maximum(np.diff(bounds), 1))
        yield np.hstack([*parts, np.stack(rest, 1)])


class Network:
    """tanh layer, logit, temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 400, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.middle, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self._scaled(x)
        check = rng.permutation(len(y)) < len(y) // 5 if len(y) >= 50 else np.zeros(len(y), bool)
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        first, second = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p]
        zt, yt = z[~check], y[~check]
        for t in range(1, rounds + 1):  # Adam on the whole sample
            h = np.tanh(zt @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - yt) / len(yt)
            back = np.outer(d, p[2]) * (1 - h * h)
            grad = [zt.T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
            for k, g in enumerate(grad):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= 0.01 * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if check.any():
            logit = self._logit(x[check])
            loss = lambda t: np.logaddexp(0, np.where(y[check] > 0, -1, 1) * logit / t).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.scale, -6, 6)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._scaled(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -500, 500)))


def score_quality(docs: DataFrame, labels: DataFrame, bound: int = 12_000, threshold: float = 0.7) -> DataFrame:
    """A row for each document. ``bound``: the most labelled rows that the network learns from."""
    vectors = context_vectors(docs)
    held = docs.sparkSession.sparkContext.broadcast(vectors)  # 1.5 MB, whatever the corpus

    def pooled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows:
            x = np.vstack(list(features(batch.column("text"), held.value)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["key", "label", "x"])

    sample = map_rows(labelled_sample(docs, labels, "quality", bound), pooled, "key long, label int, x array<double>").toPandas().sort_values(["key", "label"])
    y = sample.label.to_numpy(float)
    network = Network(np.array(sample.x.tolist()), y) if len(set(y)) == 2 else None
    share = float(y.mean()) if len(y) else 0.5
    model = docs.sparkSession.sparkContext.broadcast(network)

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        score = np.concatenate([model.value(x) if model.value else np.full(len(x), share) for x in features(batch.column("text"), held.value)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, make, OUT)
