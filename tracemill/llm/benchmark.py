"""Benchmark decontamination (9): CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

A text is a sequence of words (runs of ASCII letters, digits and all non-ASCII; A-Z as a-z). The CGK walk
reads it word by word: at step j it writes the word it stands on and moves on if a bit that step and word
decide is set, so that a few insertions or deletions move two walks apart only for a while and edit distance
becomes Hamming distance. A walk over one and a half times an item's words covers the item. Each repetition
uses another walk and samples a few of its steps; an equal sample makes a candidate. The first repetition
samples only steps that lie in the item for sure, so a copy without edits always meets its item.

Items of one length share their windows: for each length, every place of a document may begin a window. Those
without enough neighbouring word pairs of the items of that length can't hold one (an edit spoils two pairs at
most) and are not walked. How many repetitions a length needs is found by simulation: items edited as much as
is allowed, put between other words, until the target recall is reached.

Candidates of a document and item that lie together are verified as one stretch, by exact edit distance in
words between the whole item and any part of the stretch (free ends).

Defined results: a null or empty text or item matches nothing; repeated rows give a row each; items with the
same text match alike, items and documents without an id as well (the row has a null there). Very long texts
are walked whole. Items go to the executors in blocks of bounded bytes, a pass for each block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import ALNUM, U, map_rows, mix, pieces, release, words_of

PAIR = "doc_id long, item_id long, distance int, first_word long, last_word long"
Item = tuple[int | None, str]
_STEP = 16  # repetitions that a simulation tries at once


@dataclass(frozen=True)
class Plan:
    """``max_edits``: share of an item's words that may be edited. Repetitions end at the target recall, or at the most."""

    max_edits: float = 0.2
    target_recall: float = 0.995
    most_repetitions: int = 128
    sampled: int = 2
    trials: int = 256
    block_bytes: int = 1 << 25
    seed: int = 9

    def edits(self, length: int) -> int:
        return int(self.max_edits * length)

    def steps(self, length: int, repetition: int) -> np.ndarray:
        """The sampled steps of a walk."""
        reach = length if repetition == 0 else max(1, 3 * length // 2)
        return np.sort(np.random.default_rng([self.seed, repetition, length]).permutation(reach)[: self.sampled])


def _walks(x: np.ndarray, starts: np.ndarray, plan: Plan, length: int, repetitions: range) -> np.ndarray:
    """Keys (repetition, start): a sum of the sampled words, each times an odd number of its step. x ends each text with a 0, where walks rest."""
    sampled = [plan.steps(length, r) for r in repetitions]
    last = max(int(s[-1]) for s in sampled)
    here = np.zeros((last + 1, len(sampled)), bool)
    for r, s in enumerate(sampled):
        here[s, r] = True
    factor = mix(np.arange(last + 1, dtype=U), plan.seed) | U(1)
    key = np.full((len(sampled), len(starts)), U(length))
    at = np.repeat(starts[None, :], len(sampled), 0)
    salt = mix(np.array(repetitions, U), 1000)[:, None]
    for j in range(last + 1):
        word = x[np.minimum(at, len(x) - 1)]
        if here[j].any():
            key[here[j]] += word[here[j]] * factor[j]
        if j < last:
            at += ((mix(word ^ salt, 2000 + j // 64) >> U(j % 64)) & U(1)).astype(np.int64) & (word != 0)
    return mix(key)


def _pairs(x: np.ndarray) -> np.ndarray:
    """A hash for each word and the next; 0 where a text ends between them."""
    out = mix(x[:-1], 70) ^ x[1:] * U(0x9FB21C651E98DF25)
    out[(x[:-1] == 0) | (x[1:] == 0)] = 0
    return out


class _Table:
    """Sorted keys with a value each, behind a table of flags, 16 for a key or more, that most keys fail."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]
        bits = min(22, max(6, (16 * len(keys)).bit_length()))
        self.shift = U(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.keys >> self.shift] = True

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = self.seen[keys >> self.shift]
        some = np.flatnonzero(out)
        out[some] = self.keys[np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)] == keys[some]
        return out

    def met(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``keys`` and the values found there."""
        some = np.flatnonzero(self.seen[keys >> self.shift])
        left, right = np.searchsorted(self.keys, keys[some], "left"), np.searchsorted(self.keys, keys[some], "right")
        n = right - left
        which = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(some, n), self.values[which]


class Index:
    """Windows, walks and keys for a block of items; ``repetitions`` by length, simulated if not given."""

    def __init__(self, items: list[Item], plan: Plan, repetitions: dict[int, int] | None = None) -> None:
        self.plan = plan
        self.items = [(i, w) for i, t in items if len(w := ALNUM.hash_all(t or ""))]
        self.lengths: dict[int, list[int]] = {}
        for k, (_, w) in enumerate(self.items):
            self.lengths.setdefault(len(w), []).append(k)
        self.grams: dict[int, _Table] = {}
        for n, own in self.lengths.items():
            grams = np.unique(np.concatenate([self.items[k][1] if n == 1 else _pairs(self.items[k][1]) for k in own]))
            self.grams[n] = _Table(grams, grams)
        self.any_pair = _Table(every := np.unique(np.concatenate([np.zeros(1, U), *(t.keys for n, t in self.grams.items() if n > 1)])), every)
        self.repetitions = repetitions if repetitions is not None else self._simulated()
        self.tables: dict[int, list[_Table]] = {}
        for n, own in self.lengths.items():
            keys = self._item_keys(n, own, range(self.repetitions[n]))
            self.tables[n] = [_Table(keys[r], np.array(own)) for r in range(self.repetitions[n])]

    def _item_keys(self, length: int, own: list[int], repetitions: range) -> np.ndarray:
        x = np.zeros((len(own), length + 1), U)
        for r, k in enumerate(own):
            x[r, :length] = self.items[k][1]
        return _walks(x.ravel(), np.arange(len(own)) * (length + 1), self.plan, length, repetitions)

    def _windows(self, x: np.ndarray, hits: np.ndarray, length: int) -> np.ndarray:
        """Places where windows begin that hold enough of the length's word pairs, which stand at ``hits``."""
        edits = self.plan.edits(length)
        if length == 1:
            return hits
        need, wide = max(1, length - 1 - 2 * edits), length + edits - 1
        if len(hits) < need:
            return hits[:0]
        first, last = hits[: len(hits) - need + 1], hits[need - 1 :]
        near = last - first < wide
        lo, hi = np.maximum(last[near] - wide + 1, 0), first[near]
        lo = np.maximum(lo, np.append(-1, hi[:-1]) + 1)
        size = np.maximum(hi - lo + 1, 0)
        starts = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return starts[x[starts] != 0]

    def candidates(self, x: np.ndarray, tables: dict[int, list[_Table]] | None = None, begin: int = 0) -> list[np.ndarray]:
        """Rows (place, item, repetition) for each length; the tables are those of the repetitions from ``begin``. x ends each text with a 0."""
        out = []
        pairs = _pairs(x)
        pairs[pairs == 0] = 1  # no pair
        some = np.flatnonzero(self.any_pair.holds(pairs))
        for n, found in (tables or self.tables).items():
            hits = np.flatnonzero(self.grams[n].holds(x)) if n == 1 else some[self.grams[n].holds(pairs[some])]
            starts = self._windows(x, hits, n)
            for lo in range(0, len(starts), 1 << 14):
                part = starts[lo : lo + (1 << 14)]
                keys = _walks(x, part, self.plan, n, range(begin, begin + len(found)))
                for r, table in enumerate(found):
                    at, item = table.met(keys[r])
                    out.append(np.stack([part[at], item, np.full(len(at), begin + r)], 1))
        return out

    def _simulated(self) -> dict[int, int]:
        """Repetitions by length: as many as find the target share of copies with every allowed edit.

        Lengths within an eighth share the count of the longest of them.
        """
        plan, out, last = self.plan, {}, 0
        for n in sorted(self.lengths, reverse=True):
            if plan.edits(n) == 0:
                out[n] = 1
                continue
            if 8 * last <= 9 * n and last:
                out[n] = out[last]
                continue
            rng, own = np.random.default_rng([plan.seed, n]), self.lengths[n]
            parts, told = [], np.array(own)[np.arange(plan.trials) % len(own)]
            for k in told.tolist():
                around = rng.integers(1, 2**63, 2 * n + 2, dtype=U)
                parts += [around[: n + 1], edited(self.items[k][1], plan.edits(n), rng), around[n + 1 :], np.zeros(1, U)]
            x = np.concatenate(parts)
            ends = np.flatnonzero(x == 0)
            found, out[n] = np.zeros(plan.trials, bool), plan.most_repetitions
            for begin in range(0, plan.most_repetitions, _STEP):
                keys = self._item_keys(n, own, range(begin, min(begin + _STEP, plan.most_repetitions)))
                hits = np.concatenate([np.zeros((0, 3), np.int64), *self.candidates(x, {n: [_Table(k, np.array(own)) for k in keys]}, begin)])
                trial = np.searchsorted(ends, hits[:, 0])
                right = hits[:, 1] == told[trial]
                for r in range(begin, begin + len(keys)):
                    found[trial[right & (hits[:, 2] == r)]] = True
                    if found.mean() >= plan.target_recall:
                        out[n] = r + 1
                        break
                else:
                    continue
                break
            last = n
        return out


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """Words with so many of them replaced, deleted or followed by another."""
    out = words.tolist()
    for at in sorted(rng.permutation(len(words))[:edits].tolist(), reverse=True):
        new = int(rng.integers(1, 2**63))
        out[at : at + 1] = [[new], [], [out[at], new]][int(rng.integers(3))]
    return np.array(out, U)


def edit_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits that turn the item into a stretch of the text; that stretch's first word and end (the earliest end, then the longest)."""
    cost = np.zeros(len(text) + 1, np.int64)
    first = np.arange(len(text) + 1)
    steps = np.arange(len(text) + 1)
    for word in item:
        change = cost[:-1] + (text != word)
        best, origin = np.empty_like(cost), first.copy()
        best[0] = cost[0] + 1
        take = change <= cost[1:] + 1
        best[1:] = np.where(take, change, cost[1:] + 1)
        origin[1:] = np.where(take, first[:-1], first[1:])
        # Insertions: running minimum of best - position, with the origin of the place it comes from.
        run = best - steps
        low = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == low, steps, 0))
        cost, first = low + steps, origin[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(first[end]), end


def _found(column: pa.Array, index: Index) -> Iterator[tuple[int, int, tuple[int, int, int]]]:
    """(row, item number, (edits, first word, last word)) of each item that a row's text holds."""
    share, plan = index.plan.max_edits, index.plan
    for rows, data, offsets in pieces(column) if index.items else ():
        h, _, bounds = words_of(ALNUM, data, offsets)
        n = len(bounds) - 1
        x = np.zeros(len(h) + n, U)  # a 0 after each text
        x[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(bounds))] = h
        end = bounds[1:] + np.arange(n)
        begin = bounds[:-1] + np.arange(n)
        hits = index.candidates(x) if len(h) else []
        if not sum(map(len, hits)):
            continue
        hits = np.unique(np.concatenate(hits)[:, :2], axis=0)
        doc = np.searchsorted(end, hits[:, 0])
        hits = hits[np.lexsort((hits[:, 0], hits[:, 1], doc))]
        doc = np.searchsorted(end, hits[:, 0])
        size = np.array([len(w) for _, w in index.items])[hits[:, 1]]
        slack = 2 * (share * size).astype(np.int64) + 2
        lo, hi = np.maximum(begin[doc], hits[:, 0] - slack), np.minimum(end[doc], hits[:, 0] + size + slack)
        new = np.append(True, (doc[1:] != doc[:-1]) | (hits[1:, 1] != hits[:-1, 1]) | (lo[1:] > hi[:-1]))
        first = np.flatnonzero(new)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, k, a, b in zip(doc[first].tolist(), hits[first, 1].tolist(), lo[first].tolist(), np.maximum.reduceat(hi, first).tolist(), strict=True):
            words = index.items[k][1]
            # Every item word that the stretch lacks is an edit.
            if best.get((d, k), (1,))[0] == 0 or len(words) - np.isin(words, x[a:b]).sum() > plan.edits(len(words)):
                continue
            cost, one, two = edit_within(words, x[a:b])
            if cost <= plan.edits(len(words)):
                told = (cost, int(a - begin[d] + one), int(a - begin[d] + two - 1))
                best[d, k] = min(best.get((d, k), told), told)
        for (d, k), told in sorted(best.items()):
            yield rows.start + d, k, told


def _blocks(benchmark: DataFrame, plan: Plan) -> Iterator[list[Item]]:
    """The items in blocks of about ``block_bytes``; one at a time is on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-total // plan.block_bytes)
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))))
    for block in range(blocks):
        yield sorted(((r.item_id, r.text) for r in numbered.where(F.col("block") == block).collect()), key=lambda r: (r[0] is None, r))


class _Held:
    """An index that each Python worker builds once from what was broadcast; it keeps the last one."""

    built: tuple[str, Index] | None = None

    def __init__(self, spark: SparkSession, items: list[Item], plan: Plan) -> None:
        self.name = uuid.uuid4().hex
        self.held = spark.sparkContext.broadcast((items, plan, Index(items, plan).repetitions))

    def index(self) -> Index:
        if _Held.built is None or _Held.built[0] != self.name:
            _Held.built = (self.name, Index(*self.held.value))
        return _Held.built[1]


def contaminated(docs: DataFrame, benchmark: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row for each document and item that it holds: least edits, first and last word of the best stretch."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], PAIR)
    for number, items in enumerate(_blocks(benchmark, plan)):
        held = _Held(spark, items, plan)

        def matches(batch: pa.RecordBatch, held=held) -> Iterator[pa.RecordBatch]:
            index = held.index()
            rows = [(r, index.items[k][0], *told) for r, k, told in _found(batch.column("text"), index)]
            if rows:
                who, *cols = zip(*rows, strict=True)
                ids = batch.column("doc_id").take(pa.array(who, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "item_id", "distance", "first_word", "last_word"])

        found = map_rows(texts, matches, PAIR)
        out = out.unionByName(found) if number else found
    return out


def _holds(held: _Held, text: Column) -> Column:
    @F.arrow_udf(T.BooleanType())
    def any_item(texts: pa.Array) -> pa.Array:
        flags = np.zeros(len(texts), bool)
        for row, _, _ in _found(texts, held.index()):
            flags[row] = True
        release()
        return pa.array(flags)

    return any_item(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows whose text holds no item; decided row by row, so ids play no part and nothing is shuffled."""
    for items in _blocks(benchmark, plan):
        docs = docs.where(~_holds(_Held(docs.sparkSession, items, plan), F.col("text").cast("string")))
    return docs
