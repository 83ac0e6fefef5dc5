"""Vectorised tokenising and hashing of Arrow text columns; shared by the operators.

A batch's texts lie one after another in one UTF-8 buffer. Words are maximal runs of kept bytes, so the
separators must be ASCII. Each word gets a 64-bit hash: the sum, mod 2^64, of a fixed random number for each
byte times one for its place in the word, finished by a bit mixer. Two different words that were not made
against these numbers share a hash with a chance of about 2^-60, and the operators take equal hashes for
equal words.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 20
U = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser (three xor-shifts, two multiplications) over uint64."""
    x = x + U(((seed + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Places:
    """A random odd number for each place in a word, grown as needed."""

    factor = np.ones(0, U)

    @classmethod
    def to(cls, n: int) -> np.ndarray:
        if len(cls.factor) < n:
            cls.factor = mix(np.arange(max(64, 1 << (n - 1).bit_length()), dtype=U), 55) | U(1)
        return cls.factor


class Alphabet:
    """Which bytes make words, and a value for each: A-Z count as a-z when ``fold`` is set."""

    def __init__(self, separators: set[int], fold: bool = True) -> None:
        order = np.arange(256, dtype=U)
        if fold:
            order[65:91] += U(32)
        self.value = mix(order, 77) | U(1)
        self.separator = np.zeros(256, bool)
        self.separator[list(separators)] = True
        self.value[self.separator] = 0

    def words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes and their byte positions. ``starts``: where texts begin; no word crosses one."""
        hashes, places, lo, n = [], [], 0, len(data)
        while lo < n:
            hi = min(n, lo + PIECE)
            while hi < n and not self._cut(data, starts, hi):
                back = np.flatnonzero(self.separator[data[max(lo, hi - 4096) : hi]])
                if len(back) and max(lo, hi - 4096) + back[-1] > lo:
                    hi = max(lo, hi - 4096) + back[-1]
                    break
                ahead = np.flatnonzero(self.separator[data[hi : hi + PIECE]])
                hi = hi + ahead[0] if len(ahead) else min(n, hi + PIECE)
            h, at = self._piece(data[lo:hi], starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi)] - lo)
            hashes.append(h)
            places.append(at + lo)
            lo = hi
        if not hashes:
            return np.zeros(0, U), np.zeros(0, np.int64)
        return np.concatenate(hashes), np.concatenate(places)

    def _cut(self, data: np.ndarray, starts: np.ndarray, at: int) -> bool:
        k = np.searchsorted(starts, at)
        return bool(self.separator[data[at]]) or (k < len(starts) and starts[k] == at)

    def _piece(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = ~self.separator[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        begin[starts] = inside[starts]
        at = np.flatnonzero(begin)
        if not len(at):
            return np.zeros(0, U), at
        reach = np.diff(at, append=len(data))  # to the next word
        place = np.arange(len(data)) - np.repeat(np.append(0, at), np.append(at[0], reach))
        value = self.value[data]
        value *= _Places.to(int(max(at[0], reach.max())))[place]
        return mix(np.add.reduceat(value, at)), at

    def hash(self, word: str) -> int:
        h, _ = self.words(np.frombuffer(word.encode(), np.uint8), np.zeros(1, np.int64))
        if len(h) != 1:
            raise ValueError(f"not one word: {word!r}")
        return int(h[0])

    def hash_all(self, text: str) -> np.ndarray:
        return self.words(np.frombuffer(text.encode(), np.uint8), np.zeros(1, np.int64))[0]


#: Words of letters and digits: everything below 0x80 but 0-9, A-Z and a-z separates.
ALNUM = Alphabet({b for b in range(128) if not chr(b).isalnum()})
#: Words between white space.
SPACED = Alphabet({9, 10, 11, 12, 13, 32})


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows. Null counts as empty."""
    column = pa.chunked_array([column]).combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count or not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``limit`` bytes (one row at least), with their bytes and offsets."""
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield slice(lo, hi), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words_of(alphabet: Alphabet, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their byte places, and n + 1 bounds: the words of row i are bounds[i] to bounds[i + 1]."""
    starts = np.unique(offsets[:-1])
    h, at = alphabet.words(data, starts[starts < len(data)])
    return h, at, np.searchsorted(at, offsets)


def release() -> None:
    """Gives memory that is free back to the machine: a Python worker outlives its task and waits for the next beside others."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_rows(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``make`` over each Arrow batch."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from make(b)
        release()

    return df.mapInArrow(over, schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one; a local one only on a local master where none is set, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = os.path.join(os.getcwd(), "spark-warehouse", "checkpoints")
    return f"{top.rstrip('/')}/tracemill-{uuid.uuid4().hex}"


_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Rows hold texts or sets of some KB each, so the default of 10,000 makes batches of tens of MB, several of them for each task.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * PIECE),
}


def settle(df: DataFrame, *superseded: DataFrame) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder; a lost executor loses nothing of it.

    The shuffle files of the write go with it, as do the ``superseded`` tables of earlier calls, which no plan may read any more.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    discard(*superseded)
    return out


BROADCAST_ROWS = 200_000


def sized(df: DataFrame) -> DataFrame:
    """A table of a few numbers a row: written, counted, and sent to all executors where that is a few MB; else joined by shuffle."""
    held = df if getattr(df, "_settled", None) else settle(df)
    out = F.broadcast(held) if held.count() <= BROADCAST_ROWS else held
    out._settled = held._settled
    return out


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with ``_`` at its end while the table has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def discard(*settled: DataFrame) -> None:
    """Deletes tables that ``settle`` wrote."""
    for df in settled:
        if path := getattr(df, "_settled", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            df._settled = None


def row_key(column: pa.Array) -> np.ndarray:
    """Ids as int64; null as the smallest."""
    return column.cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
