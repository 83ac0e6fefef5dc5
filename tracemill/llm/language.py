"""Language ID (6): rank-order profiles with the out-of-place distance.

A text's letters are lower-cased and put into 255 classes by a fixed rule (a-z, Latin letters with marks,
other letters by code point); all else is a word edge. Its n-grams (1 to 3 letters, edges included) are
ranked by frequency, ties by code. A language's profile is the same ranking over all its training rows.
The distance sums, over a document's ``depth`` most frequent n-grams, how far each is out of place, at most
``depth``; the nearest profile wins, ties by name. Score: how much farther the second profile is, 0 to 1
(with one profile: the closeness itself).

Defined results: null text or no letter gives ``und`` with score 0, as does an empty training set; rows
with null lang or null id teach nothing, and ``held_out`` is false for a null id; repeated rows count as often
as they stand there and get a row each; an empty table gives none; very long texts are counted whole; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import map_rows

OUT = "doc_id long, held_out boolean, lang_pred string, score double"
_CHUNK = 1 << 18


@cache
def letter_classes() -> np.ndarray:
    """The class of each code point up to the last plane with letters; 0 for what is no letter."""
    out = np.zeros(0x33480, np.uint8)
    for c in range(len(out)):
        if (x := chr(c)).isalpha():
            low = ord(x.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low - 0xDF if 0xDF <= low <= 0x17F else 188 + low % 68
    return out


def _runs(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and their counts, or the sums of the counts given."""
    if counts is not None:
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
    else:
        codes = np.sort(codes)
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    n = np.diff(np.append(first, len(codes))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return codes[first], n


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the whole text, in pieces of bounded size."""
    table, parts, total = letter_classes(), [], len(text) + 1 if text else 0
    for lo in range(0, total, _CHUNK):  # n-grams that begin at places lo to hi; place 0 is the edge before the text
        hi = min(lo + _CHUNK, total)
        points = np.frombuffer(text[max(lo - 1, 0) : hi + 1].encode("utf-32-le", "replace"), np.uint32)
        c = np.zeros(hi - lo + 2, np.int32)
        begin = 0 if lo else 1
        c[begin : begin + len(points)] = table.take(np.minimum(points, len(table) - 1))
        a, b, d = c[:-2], c[1:-1], c[2:]
        two, three = (a > 0) | (b > 0), (b > 0) & ((a > 0) | (d > 0))
        parts.append(_runs(np.concatenate([a[a > 0] | 1 << 24, ((a << 8) | b)[two] | 2 << 24, ((a << 16) | (b << 8) | d)[three] | 3 << 24])))
    if len(parts) == 1:
        return parts[0]
    return _runs(*map(np.concatenate, zip(*parts, strict=True))) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def ranked(codes: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """The most frequent codes, in order; ties by code."""
    key = (counts.astype(np.int64) << 27) - codes
    if len(key) > depth:
        key = key[np.argpartition(key, len(key) - depth)[-depth:]]
    key = np.sort(key)[::-1]
    return (-key & ((1 << 27) - 1)).astype(np.int32)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; rows of fold 2 are held out of all learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """Whether a row is held out; a row without an id is not, but nothing learns from it either."""
    return F.coalesce(fold_of(doc_id) == 2, F.lit(False))


def learn_profiles(docs: DataFrame, depth: int = 400, slices: int = 64) -> dict[str, np.ndarray]:
    """Ranked n-grams of each language over all training rows. What reaches the driver is bounded by languages x slices x depth."""
    rows = docs.where((fold_of(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        merge = lambda parts: _runs(*map(np.concatenate, zip(*parts, strict=True)))
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                codes, counts = ngram_counts(text.as_py())
                if len(codes):
                    own = held.setdefault(lang, [])
                    own.append((codes, counts))
                    if len(own) > 100:
                        held[lang] = [merge(own)]
        for lang, own in held.items():
            codes, counts = merge(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes, pa.int32()), pa.array(counts, pa.int64())], ["lang", "code", "n"])

    sums = rows.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang", F.col("code") % slices).orderBy(F.desc("n"), "code")
    top = sums.withColumn("place", F.row_number().over(order)).where(F.col("place") <= depth).drop("place").toPandas()
    return {lang: ranked(own.code.to_numpy(), own.n.to_numpy(), depth) for lang, own in sorted(top.groupby("lang"))}


class _Profiles:
    """Ranks by language in one table over the codes that any profile has."""

    def __init__(self, profiles: dict[str, np.ndarray], depth: int) -> None:
        self.names, self.depth = sorted(profiles), depth
        self.codes = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int32)]))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), 2 * depth, np.int32)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, profiles[name]), k] = np.arange(len(profiles[name]))

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and the distance as a share of the greatest."""
        codes, counts = ngram_counts(text or "")
        if not len(codes) or not self.names:
            return "und", 0.0, 1.0
        own = ranked(codes, counts, self.depth)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at[self.codes[at] != own] = len(self.codes)
        far = np.minimum(np.abs(self.ranks[at] - np.arange(len(own))[:, None]), self.depth).sum(0) / (self.depth * len(own))
        best = int(np.argmin(far))
        rest = np.delete(far, best)
        second = float(rest.min()) if len(rest) else 1.0
        score = 1.0 - float(far[best]) / second if second > 0 else 0.0
        return self.names[best], score, float(far[best])


def identify(docs: DataFrame, depth: int = 400) -> DataFrame:
    """A row for each document. Learns from the training rows of the same table; two passes over the texts."""
    profiles, state = learn_profiles(docs, depth), {}

    def predict(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if "p" not in state:
            state["p"] = _Profiles(profiles, depth)
        told = [state["p"](t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, predict, OUT)


def keep_identified(docs: DataFrame, depth: int = 400) -> DataFrame:
    """The documents whose language could be told, all columns kept; ``und`` goes."""
    profiles, state = learn_profiles(docs, depth), {}

    @F.arrow_udf("boolean")
    def told(texts: pa.Array) -> pa.Array:
        if "p" not in state:
            state["p"] = _Profiles(profiles, depth)
        return pa.array([state["p"](t.as_py())[0] != "und" for t in texts], pa.bool_())

    return docs.where(told(F.col("text")))
