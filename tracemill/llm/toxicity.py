"""Toxicity (10): a support vector machine with a gapped subsequence kernel on Nystroem landmarks.

A text is a stream of letters in units: words between white space, all but letters left out, and runs of
one-letter words put together, so ``i.d.i o t`` is a unit like ``idiot``. The kernel of two units counts the
common subsequences of 3 and 4 letters (unit edges count as letters) that span at most 5 and 6 places;
every skipped place costs a factor ``decay``. It is scaled by the units' lengths.

Training, on the bounded sample of labelled rows: distinct sentences with their document's label (copies
count once; a sentence under both labels is clean). Units whose share of toxic sentences can't be chance,
and copies of them with a letter inserted, are the positive examples; a bounded sample of the other units, then those that the first machine rates
highest, are the negative ones. Landmarks are drawn from both; the machine (squared hinge loss) is fitted by
Newton steps in the landmarks' space. As the machine is linear in the kernel with the landmarks, it folds
into one weight for each subsequence, so a unit's value needs no kernel evaluation.

A document's value is that of its highest unit (of long units, of the highest stretch of 12 letters); a
logistic curve fitted on the sample turns it into the score.

Defined results: null or letterless text, and everything where no toxic example was learned, scores 0. Rows
without an id teach nothing and are not ``held_out``; repeated rows get a row each and their sentences count
once; an empty table gives none; very long texts are read whole; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .language import held_out
from .words import map_rows, settle

OUT = "doc_id long, held_out boolean, score double, predicted int"
DECAY = 0.6
STRETCH, LONGEST = 12, 24
SHORTEST = 5  # shorter units are scaled as if they had so many letters
PATTERNS = tuple((0, *inner, last) for n, span in ((3, 5), (4, 6)) for last in range(n - 1, span) for inner in combinations(range(1, last), n - 2))
SIZE = (1 << 15) + (1 << 20)
_CHUNK = 1 << 16


@cache
def letters() -> np.ndarray:
    """Classes of code points: 1 to 26 for a-z, 27 to 31 for other letters, 0 for the rest, 32 for white space."""
    out = np.zeros(0x33480, np.int32)
    for c in range(len(out)):
        x = chr(c)
        if x.isalpha():
            low = ord(x.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low % 5
        elif x.isspace():
            out[c] = 32
    return out


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The stream of all texts, a 0 before, between and after units; and where each text begins in it."""
    table = letters()
    streams, starts, at = [], [], 0
    for text in texts:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        c = table.take(np.minimum(points, len(table) - 1))
        c = c[c > 0]
        word = np.cumsum(c == 32)[c != 32]
        c = c[c != 32]
        if len(c):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            size = np.diff(np.append(first, len(c)))
            lone = size == 1
            begins = first[~(lone & np.append(False, lone[:-1]))]
            stream = np.zeros(len(c) + len(begins), np.int32)
            stream[np.arange(len(c)) + np.searchsorted(begins, np.arange(len(c)), "right")] = c
        else:
            stream = c
        streams.append(stream)
        starts.append(at)
        at += len(stream)
    return np.concatenate([*streams, np.zeros(1, np.int32)]), np.array([*starts, at])


def subsequences(stream: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pattern: the places where it lies within one unit, its codes there, and its weight."""
    n = len(stream)
    edge = np.flatnonzero(stream == 0)
    room = edge[np.minimum(np.searchsorted(edge, np.arange(n), "right"), len(edge) - 1)] - np.arange(n)  # to the next edge
    for offsets in PATTERNS:
        last = offsets[-1]
        if n <= last:
            continue
        code = stream[: n - last].copy()
        for o in offsets[1:]:
            code <<= 5
            code += stream[o : n - last + o]
        yield np.flatnonzero(room[: n - last] >= last), code + ((1 << 15) if len(offsets) == 4 else 0), DECAY ** (last + 1 - len(offsets))


@cache
def _norms() -> np.ndarray:
    """The root of a unit's own kernel by its length, if no subsequence repeats."""
    out = [1.0]
    for n in range(1, 4 * STRETCH):
        out.append(max(sum(w * w * len(at) for at, _, w in subsequences(np.array([0, *[1] * n, 0], np.int32))), 1e-9) ** 0.5)
    return np.array(out)


class Machine:
    """Weights of subsequences, and of the logistic curve."""

    def __init__(self, weight: np.ndarray, bias: float, curve: tuple[float, float] = (1.0, 0.0)) -> None:
        self.weight, self.bias, self.curve = weight.astype(np.float32), bias, curve

    def values(self, texts: list[str]) -> np.ndarray:
        """The highest unit of each text; -inf without letters. Long streams go in overlapping pieces cut at unit edges."""
        stream, starts = units(texts)
        best = np.full(len(texts), -np.inf)
        lo = 0
        while lo < len(stream) - 1:
            hi = min(lo + _CHUNK, len(stream) - 1)
            zero = np.flatnonzero(stream[lo + 1 : hi + 1] == 0)
            if len(zero):
                hi, over = lo + 1 + int(zero[-1]), 0
            else:
                over = min(2 * STRETCH, len(stream) - 1 - hi)  # a unit longer than a piece
            part = stream[lo : hi + over + 1]
            if over:
                part = np.append(part, np.int32(0))
            self._piece(part, lo, starts, best)
            lo = hi
        return best

    def _piece(self, part: np.ndarray, lo: int, starts: np.ndarray, best: np.ndarray) -> None:
        value = np.zeros(len(part))
        for at, code, w in subsequences(part):
            value[at] += w * self.weight[code[at]]
        edge = np.flatnonzero(part == 0)
        edge = edge if len(edge) and edge[0] == 0 else np.append(0, edge)
        sums = np.append(0.0, np.cumsum(value))
        size = np.diff(edge) - 1
        norms = _norms()
        unit = (sums[edge[1:]] - sums[edge[:-1]]) / norms[np.clip(size, SHORTEST, STRETCH)]
        unit[size < 1] = -np.inf
        for k in np.flatnonzero(size > STRETCH).tolist():
            a, b = edge[k], edge[k + 1]
            unit[k] = (sums[a + STRETCH : b + 1] - sums[a : b + 1 - STRETCH]).max() / norms[STRETCH]
        # An edge belongs to the unit after it, so to that unit's text.
        np.maximum.at(best, np.searchsorted(starts, lo + edge[:-1], "right") - 1, unit + self.bias)

    def scores(self, texts: list[str]) -> np.ndarray:
        v = self.values(texts)
        with np.errstate(over="ignore"):
            return np.where(np.isfinite(v), 1 / (1 + np.exp(-np.clip(self.curve[0] * v + self.curve[1], -500, 500))), 0.0)


def _features(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit, subsequence and scaled weight of all entries of the units' feature vectors."""
    stream, starts = units(names)
    rows, codes, weights = [], [], []
    size = np.array([max(int((stream[a:b] > 0).sum()), 1) for a, b in zip(starts[:-1], starts[1:], strict=True)])
    for at, code, w in subsequences(stream):
        row = np.searchsorted(starts, at, "right") - 1
        ok = row < len(names)
        rows.append(row[ok])
        codes.append(code[at[ok]])
        weights.append(w / _norms()[np.clip(size[row[ok]], SHORTEST, STRETCH)])
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(weights)


def fit(positive: dict[str, float], negative: list[str], landmarks: int = 384, cost: float = 4.0) -> Machine | None:
    """The machine over units. Positive ones have weights; both sides weigh alike. The heaviest positive units are landmarks."""
    if not positive or not negative:
        return None
    rng = np.random.default_rng(10)
    half = landmarks // 2
    heavy = sorted(positive, key=lambda u: (-positive[u], u))
    marks = heavy[:half] + [negative[i] for i in sorted(rng.permutation(len(negative))[:half])]
    rows, codes, weights = _features(marks)
    keys, inverse = np.unique(codes, return_inverse=True)
    held = np.zeros((len(keys), len(marks)), np.float32)
    np.add.at(held, (inverse, rows), weights)

    def kernel(names: list[str]) -> np.ndarray:
        out = []
        for lo in range(0, len(names), 200):
            some = names[lo : lo + 200]
            r, c, w = _features(some)
            at = np.minimum(np.searchsorted(keys, c), len(keys) - 1)
            ok = np.flatnonzero(keys[at] == c)
            ok = ok[np.argsort(r[ok], kind="stable")]
            part = np.zeros((len(some), len(marks)), np.float32)
            if len(ok):
                first = np.flatnonzero(np.diff(r[ok], prepend=-1))
                part[r[ok][first]] = np.add.reduceat(held[at[ok]] * w[ok, None].astype(np.float32), first, axis=0)
            out.append(part)
        return np.concatenate(out).astype(np.float64)

    value, vector = np.linalg.eigh(kernel(marks))
    value, vector = value[value > 1e-6], vector[:, value > 1e-6]
    root = vector / np.sqrt(value)
    z = kernel(heavy + negative) @ root
    z = np.hstack([z, np.ones((len(z), 1))])
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    weights = np.array([positive[u] for u in heavy])
    share = cost * np.r_[weights / weights.sum(), np.full(len(negative), 1 / len(negative))] * len(y) / 2
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(20):  # Newton steps of the squared hinge loss
        inside = y * (z @ w) < 1
        zs, ss = z[inside], share[inside][:, None]
        new = np.linalg.solve(ridge + (zs * ss).T @ zs, (zs * ss).T @ y[inside])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    weight = np.zeros(SIZE)
    weight[keys] = held @ (root @ w[:-1])
    return Machine(weight, float(w[-1]))


def varied(unit: str, copies: int = 3) -> list[str]:
    """The unit with one letter inserted, as those do who hide an insult; drawn by the unit itself."""
    if len(unit) < 4:
        return []
    rng = np.random.default_rng(list(unit.encode()))
    return [unit[:k] + chr(97 + int(rng.integers(26))) + unit[k:] for k in rng.integers(1, len(unit), copies).tolist()]


_UNITS = "unit string, toxic long, clean long"


def _unit_counts(sentences: DataFrame) -> DataFrame:
    """How many toxic and clean sentences hold each unit, summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array([v[k] for v in held.values()], pa.int64()) for k in (0, 1))], ["unit", "toxic", "clean"])

        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("sentence").to_pylist(), strict=True):
                for unit in spelled(text):
                    held.setdefault(unit, [0, 0])[0 if label else 1] += 1
            if len(held) > 200_000:
                yield told()
                held.clear()
        yield told()

    return sentences.mapInArrow(count, _UNITS).groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def spelled(text: str) -> set[str]:
    """The units of a text, as words; of longer ones than ``LONGEST``, stretches of that length that overlap by half."""
    out, run = [], []
    for word in text.lower().split():
        unit = "".join(filter(str.isalpha, word))
        if len(unit) == 1:
            run.append(unit)
        elif unit:
            if run:
                out.append("".join(run))
                run = []
            out.append(unit)
    if run:
        out.append("".join(run))
    half = LONGEST // 2
    return {u[k : k + LONGEST] for u in out for k in range(0, max(len(u) - half, 1), half)}


def learn(docs: DataFrame, labels: DataFrame, bound: int = 12_000, most_positive: int = 1500, most_negative: int = 12_000, hard: int = 3000) -> Machine | None:
    """The machine from at most ``bound`` labelled rows; the other bounds are those of examples sent to the driver."""
    sample = labelled_sample(docs, labels, "toxic", bound)
    sentences = settle(sample.select("label", F.explode(F.split("text", r"[.!?\n]+")).alias("sentence")).where("sentence <> ''").groupBy("sentence").agg(F.min("label").alias("label")))
    counted = settle(_unit_counts(sentences))
    total = sentences.agg(F.sum("label").alias("t"), F.count("*").alias("n"), ).first()
    toxic, n = total.t or 0, total.n
    if not toxic or toxic == n:
        return None
    # Likelihood ratio of the unit's toxic share against all sentences' share.
    k, m, p = F.col("toxic"), F.col("toxic") + F.col("clean"), toxic / n
    gain = 2 * (k * F.log(k / m / p) + F.when(m > k, (m - k) * F.log((m - k) / m / (1 - p))).otherwise(0.0))
    frequent = counted.where("toxic >= 2")
    least = 2 * np.log(max(frequent.count(), 1)) + 4
    found = frequent.where((k / m > 2 * p) & (k / m > 0.5) & (gain > float(least))).orderBy(F.desc(gain), "unit").limit(most_positive)
    # An insult weighs as the root of its toxic sentences, a copy with an inserted letter a third of that.
    positive = {r.unit: r.toxic**0.5 for r in found.collect()}
    other = counted.where("clean > 0").where(k / m <= 2 * p)
    negative = sorted(r.unit for r in other.orderBy(F.xxhash64("unit"), "unit").limit(most_negative).collect())
    positive = {v: w / 3 for u, w in sorted(positive.items()) for v in varied(u)} | positive
    machine = fit(positive, negative)
    if machine is None:
        return None
    for _ in range(2):  # the clean units that it rates highest join the negative examples
        first = machine

        @F.arrow_udf("double")
        def rated(names: pa.Array) -> pa.Array:
            return pa.array(np.maximum(first.values(names.to_pylist()), -1e9), pa.float64())

        worst = counted.where("clean > 0 AND toxic * 4 < clean").select("unit", rated("unit").alias("v")).orderBy(F.desc("v"), "unit").limit(hard)
        negative = sorted({*negative, *(r.unit for r in worst.collect())})
        machine = fit(positive, negative)

    last = machine

    def valued(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            v = last.values([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(np.maximum(v, -1e3))], ["label", "v"])

    told = map_rows(sample.select("label", "text"), valued, "label int, v double").toPandas().sort_values(["label", "v"])  # at most ``bound`` rows
    machine.curve = _curve(told.v.to_numpy(), told.label.to_numpy())
    return machine


def _curve(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve over values (cut at -3 and 3) by Newton steps, with smoothed targets and a small ridge."""
    v = np.clip(v, -3, 3)
    x = np.stack([v, np.ones(len(v))], 1)
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (t - p) - 1e-3 * w)
    return max(float(w[0]), 0.0), float(w[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, bound: int = 12_000, threshold: float = 0.3) -> DataFrame:
    """A row for each document."""
    machine = learn(docs, labels, bound)
    held = docs.sparkSession.sparkContext.broadcast(machine)  # 4 MB, whatever the corpus

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            texts = [t or "" for t in part.column("text").to_pylist()]
            score = held.value.scores(texts) if held.value else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, make, OUT)
