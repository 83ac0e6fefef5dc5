"""SentencePiece encoding and decoding (4): sampled segmentations by forward filtering, backward sampling.

A public vocabulary file gives the pieces. A text gets one space in front, spaces become U+2581, and it is
cut into segments: before each space and around each line feed. Within a segment, however long, every way to write it in pieces is a path through a lattice. A path's weight is the product of its pieces'
weights, 1 / (rank + 10) in the vocabulary's order, raised to ``sharpness``; a character that is no piece
is written in byte pieces, and so is a literal U+2581. The forward pass sums the weights of all paths to
each place; the backward pass draws pieces from the end in proportion. Each draw comes from a hash of seed,
row id and place, so a row's segmentation depends on nothing else. Decoding joins the pieces' bytes and is
lossless for every text.

Both passes run over all distinct segments of a block at once, place by place, on numpy arrays; segments of
over 48 characters (text without spaces) go one by one, by the same rule.

Defined results: null text gives null ids; an empty text is the one piece U+2581; rows that share id and
text are written alike; a null id counts as one fixed id; an empty table gives none; other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, map_rows, mix, row_key

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LONGEST_SEGMENT = 48  # of those that go together
_SPACE, _LITERAL, _LF = 0x2581, 0x110000, 10
_BLOCK = 1 << 18


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, None where an id is no text; ids of the 256 byte pieces."""

    pieces: tuple[str | None, ...]
    byte_ids: tuple[int, ...]

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        """Read on the driver and sent to the executors: a file of fixed size."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        bytes_ = {model.id_to_piece(i): i for i in range(n) if model.is_byte(i)}
        pieces = tuple(None if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else model.id_to_piece(i) for i in range(n))
        return cls(pieces, tuple(bytes_[f"<0x{b:02X}>"] for b in range(256)))

    def decode(self, ids: list[int]) -> str:
        table = self.table()
        return b"".join(map(table.__getitem__, ids)).decode()[1:]

    def table(self) -> list[bytes]:
        out = [(p or "").replace(chr(_SPACE), " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out


class _Trie:
    """All prefixes of all pieces by rolling hash, in one open-addressing table."""

    def __init__(self, vocabulary: Vocabulary, sharpness: float) -> None:
        chars = sorted({c for p in vocabulary.pieces if p for c in p})
        self.symbol = np.zeros(0x110001, U)
        self.symbol[[ord(c) for c in chars]] = mix(np.arange(1, len(chars) + 1, dtype=U), 5) | U(1)
        nodes: dict[int, int] = {}
        last: dict[int, tuple[int, float]] = {}
        longest = max((len(p) for p in vocabulary.pieces if p), default=1)
        grid = np.zeros((len(vocabulary.pieces), longest), U)
        for i, p in enumerate(vocabulary.pieces):
            if p:
                grid[i, : len(p)] = self.symbol[[ord(c) for c in p]]
        state = np.zeros(len(grid), U)
        for k in range(longest):
            state = self.step(state, grid[:, k])
            for i in np.flatnonzero(grid[:, k]).tolist():
                h = int(state[i])
                nodes.setdefault(h, len(nodes))
                if len(vocabulary.pieces[i]) == k + 1:
                    last[h] = (i, (i + 10.0) ** -sharpness)
        self.longest, self.bits = longest, max(10, math.ceil(math.log2(4 * len(nodes) + 1)))
        size = 1 << self.bits
        self.key, self.piece, self.weight = np.zeros(size, U), np.full(size, -1, np.int32), np.zeros(size)
        for h in nodes:
            at = h >> (64 - self.bits)
            while self.key[at]:
                at = (at + 1) & (size - 1)
            self.key[at] = h
            if h in last:
                self.piece[at], self.weight[at] = last[h]

    @staticmethod
    def step(state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        x = (state ^ symbol) * U(0x9E3779B97F4A7C15)
        return (x ^ (x >> U(32))) * U(0xBF58476D1CE4E5B9) | U(1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots of prefixes, -1 where there is none."""
        at = (h >> U(64 - self.bits)).astype(np.int64)
        held = self.key[at]
        todo = np.flatnonzero((held != h) & (held != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.key) - 1)
            held[todo] = self.key[at[todo]]
            todo = todo[(held[todo] != h[todo]) & (held[todo] != 0)]
        at[held == 0] = -1
        return at


class Sampler:
    def __init__(self, vocabulary: Vocabulary, seed: int = 4, sharpness: float = 1.0) -> None:
        self.vocabulary, self.seed = vocabulary, seed
        self.trie = _Trie(vocabulary, sharpness)
        self.bytes = vocabulary.table()
        self.unknown = (len(vocabulary.pieces) + 10.0) ** -sharpness

    def encode(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, blocks of whole segments at a time."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held, size = [], 0
        for row, text in enumerate(texts):
            points = np.append(np.uint32(32), np.frombuffer(text.encode("utf-32-le"), np.uint32))
            for lo, hi in self._blocks(points):
                held.append((row, lo, points[lo:hi]))
                size += hi - lo
                if size >= _BLOCK:
                    self._flush(held, keys, out)
                    held, size = [], 0
        if held:
            self._flush(held, keys, out)
        return [np.concatenate(x) for x in out]

    @staticmethod
    def _blocks(points: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cuts a long text before a space or line feed: the last one of a block, or the next one after it."""
        lo, n = 0, len(points)
        edge = np.flatnonzero((points == 32) | (points == _LF)) if n > _BLOCK else points[:0]
        while n - lo > _BLOCK:
            at = int(np.searchsorted(edge, lo + _BLOCK))
            hi = int(edge[at - 1]) if at and edge[at - 1] > lo else int(edge[at]) if at < len(edge) else n
            if hi == n:
                break
            yield lo, hi
            lo = hi
        yield lo, n

    def _flush(self, held: list[tuple[int, int, np.ndarray]], keys: np.ndarray, out: list[list[np.ndarray]]) -> None:
        points = np.concatenate([p for _, _, p in held])
        sizes = np.array([len(p) for _, _, p in held])
        ends = np.cumsum(sizes)
        begin = np.zeros(len(points), bool)
        begin[ends - sizes] = True
        begin |= (points == 32) | (points == _LF)
        begin[1:] |= points[:-1] == _LF
        starts = np.flatnonzero(begin)
        lengths = np.diff(np.append(starts, len(points)))
        chars = points.astype(np.int64)
        chars[points == _SPACE] = _LITERAL
        chars[points == 32] = _SPACE
        key, place = self._keys(held, sizes, starts, keys)
        short = lengths <= LONGEST_SEGMENT
        counts, parts = np.zeros(len(starts), np.int64), {}
        for k in np.flatnonzero(~short).tolist():
            parts[k] = self._sample_long(chars[starts[k] : starts[k] + lengths[k]], key[k], place[k])
            counts[k] = len(parts[k])
        some, counts[short] = self._sample_short(chars, starts[short], lengths[short], key[short], place[short])
        first = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), np.int64)
        many = counts[short]
        ids[np.repeat(first[short] - (np.cumsum(many) - many), many) + np.arange(len(some))] = some
        for k, part in parts.items():
            ids[first[k] : first[k] + len(part)] = part
        # Pieces of each block of a row.
        block = np.searchsorted(ends, starts, "right")
        bounds = np.append(0, np.cumsum(np.bincount(block, counts, len(held)).astype(np.int64)))
        for k, (row, _, _) in enumerate(held):
            out[row].append(self._spelled(ids[bounds[k] : bounds[k + 1]]))

    def _sample_short(self, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all segments and how many each has. Equal segments share a lattice."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        position = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        symbol = mix(chars[np.repeat(starts, lengths) + position].astype(U), 3)
        code = np.add.reduceat(mix(symbol + position.astype(U) * U(0x9E3779B97F4A7C15), 8), np.cumsum(lengths) - lengths)
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        order = np.argsort(-lengths[first], kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        return self._sample(chars, starts[first][order], lengths[first][order], rank[which], lengths, key, place)

    def _sample_long(self, chars: np.ndarray, key: np.uint64, place: int) -> np.ndarray:
        """The pieces of one segment: the rule of ``_sample``, place after place."""
        t, n = self.trie, len(chars)
        symbol = t.symbol[chars]
        ends, sizes, pieces, weights = [], [], [], []
        who, state, lone = np.arange(n), np.zeros(n, U), np.ones(n, bool)
        for k in range(1, t.longest + 1):
            inside = who + k <= n
            who, state = who[inside], state[inside]
            state = t.step(state, symbol[who + k - 1])
            slot = t.find(state)
            ok = (slot >= 0) & (symbol[who + k - 1] != 0)
            who, state, slot = who[ok], state[ok], slot[ok]
            real = t.piece[slot] >= 0
            if k == 1:
                lone[who[real]] = False
            ends.append(who[real] + k)
            sizes.append(np.full(int(real.sum()), k))
            pieces.append(t.piece[slot[real]])
            weights.append(t.weight[slot[real]])
            if not len(who):
                break
        odd = np.flatnonzero(lone)
        ends.append(odd + 1)
        sizes.append(np.ones(len(odd), np.int64))
        pieces.append(len(self.vocabulary.pieces) + chars[odd])
        weights.append(np.full(len(odd), self.unknown))
        end, size, piece, weight = map(np.concatenate, (ends, sizes, pieces, weights))
        order = np.lexsort((size, end))
        size, piece, weight = size[order], piece[order], weight[order]
        bounds = np.searchsorted(end[order], np.arange(n + 2))
        share, total = np.empty(len(size)), [1.0]
        for lo in range(1, n + 1, _BLOCK):
            hi = min(lo + _BLOCK, n + 1)
            a = int(bounds[lo])
            span, w, edge = size[a : bounds[hi]].tolist(), weight[a : bounds[hi]].tolist(), (bounds[lo : hi + 1] - a).tolist()
            for e in range(lo, hi):
                sums, first, last = 0.0, edge[e - lo], edge[e - lo + 1]
                for m in range(first, last):
                    sums += w[m] * total[e - span[m]]
                    w[m] = sums
                for m in range(first, last):
                    w[m] /= sums
                total.append(sums)
                if sums < 1e-200:  # only ratios among the last places count
                    for back in range(max(0, e - t.longest), e + 1):
                        total[back] *= 1e200
            share[a : bounds[hi]] = w
        at = np.arange(n + 1).astype(U)
        draws = (mix(key + (U(place) + at) * U(0xD6E8FEB86659FD93), self.seed) >> U(11)).astype(np.float64) * 2.0**-53
        out, e = [], n
        while e > 0:
            a, b = int(bounds[e]), int(bounds[e + 1])
            m = min(a + int(np.searchsorted(share[a:b], draws[e], "right")), b - 1)
            out.append(int(piece[m]))
            e -= int(size[m])
        return np.array(out[::-1], np.int64)

    def _keys(self, held: list[tuple[int, int, np.ndarray]], sizes: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each segment, its row's key and its place in the row."""
        ends = np.cumsum(sizes)
        block = np.searchsorted(ends, starts, "right")
        rows = np.array([r for r, _, _ in held])
        offset = np.array([lo for _, lo, _ in held])
        return mix(keys[rows].astype(np.int64).view(U), self.seed)[block], (starts - (ends - sizes)[block] + offset[block])

    def _sample(self, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray, own_length: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments come longest first, so those that reach a place are a prefix of all."""
        t, deepest = self.trie, int(lengths[0])
        alive = [int(np.searchsorted(-lengths, -k, "right")) for k in range(deepest + 2)]  # with at least k characters
        column = [chars[starts[: alive[k + 1]] + k] for k in range(deepest)]
        symbol = [t.symbol[c] for c in column]
        L = min(t.longest, LONGEST_SEGMENT)
        weight = [np.zeros((L, alive[k])) for k in range(1, deepest + 1)]  # by end: of the piece of each length that ends there
        piece = [np.full((L, alive[k]), -1, np.int32) for k in range(1, deepest + 1)]
        for k in range(deepest):
            who = np.arange(alive[k + 1])
            state = np.zeros(len(who), U)
            for n in range(1, min(L, deepest - k) + 1):
                m = np.searchsorted(who, alive[k + n])  # who stays sorted
                who, state = who[:m], state[:m]
                state = t.step(state, symbol[k + n - 1][who])
                slot = t.find(state)
                ok = (slot >= 0) & (symbol[k + n - 1][who] != 0)
                who, state, slot = who[ok], state[ok], slot[ok]
                if n == 1:
                    lone = np.ones(alive[k + 1], bool)
                    lone[who[t.piece[slot] >= 0]] = False
                    weight[k][0, lone] = self.unknown
                    piece[k][0, lone] = len(self.vocabulary.pieces) + column[k][lone]
                if not len(who):
                    break
                real = t.piece[slot] >= 0
                weight[k + n - 1][n - 1, who[real]] = t.weight[slot[real]]
                piece[k + n - 1][n - 1, who[real]] = t.piece[slot[real]]
        # Forward: total weight of all paths to each place, then each length's share of it, summed up.
        total = [np.ones(alive[0] if 0 < len(alive) else 0)]
        for k in range(1, deepest + 1):
            w, n = weight[k - 1], alive[k]
            for length in range(1, min(L, k) + 1):
                w[length - 1] *= total[k - length][:n]
            np.cumsum(w, axis=0, out=w)
            total.append(w[-1].copy())
            w /= w[-1]
            # Totals shrink by place; no more than 48 places, so they stay far from the least double.
        base = np.append(0, np.cumsum([alive[k] for k in range(1, deepest + 1)]))
        share, pick = np.concatenate(weight, axis=1), np.concatenate(piece, axis=1)
        # Backward: all segments draw their last piece, then the one before it, and so on.
        who, at, drawn, owner = np.arange(len(which)), own_length.astype(np.int64).copy(), [], []
        counts = np.zeros(len(which), np.int64)
        while len(who):
            row = base[at - 1] + which[who]
            u = (mix(key[who] + (place[who] + at).astype(U) * U(0xD6E8FEB86659FD93), self.seed) >> U(11)).astype(np.float64) * 2.0**-53
            n, act, r = np.zeros(len(who), np.int64), np.arange(len(who)), row
            for length in range(L):  # few pieces are long, so few are looked at again
                over = share[length].take(r) <= u
                act, r, u = act[over], r[over], u[over]
                if not len(act):
                    break
                n[act] += 1
            drawn.append(pick[n, row])
            owner.append(who)
            counts[who] += 1
            at -= n + 1
            left = at > 0
            who, at = who[left], at[left]
        last = np.cumsum(counts)
        ids = np.empty(int(last[-1]) if len(last) else 0, np.int64)
        for step, (w, p) in enumerate(zip(owner, drawn, strict=True)):
            ids[last[w] - 1 - step] = p
        return ids, counts

    def _spelled(self, ids: np.ndarray) -> np.ndarray:
        """Writes characters that are no pieces in byte pieces."""
        n = len(self.vocabulary.pieces)
        odd = np.flatnonzero(ids >= n)
        if not len(odd):
            return ids.astype(np.int32)
        which, inverse = np.unique(ids[odd] - n, return_inverse=True)
        spelled = [[self.vocabulary.byte_ids[b] for b in chr(_SPACE if c == _LITERAL else c).encode()] for c in which.tolist()]
        width = np.ones(len(ids), np.int64)
        width[odd] = np.array([len(s) for s in spelled])[inverse]
        first = np.cumsum(width) - width
        out = np.repeat(ids, width)
        for k in range(4):
            has = np.array([len(s) > k for s in spelled])[inverse]
            out[first[odd[has]] + k] = np.array([s[k] if len(s) > k else 0 for s in spelled])[inverse[has]]
        return out.astype(np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))[1:]


def _sampled(batch: pa.RecordBatch, sampler: Sampler) -> Iterator[tuple[int, str | None, np.ndarray | None]]:
    """(row, text, ids) in order."""
    keys, rows, texts, size = row_key(batch.column("doc_id")), [], [], 0
    column = batch.column("text")
    for i in range(len(column)):
        text = column[i].as_py()
        if text is not None:
            rows.append(i)
            texts.append(text)
            size += len(text)
        if texts and (size >= 4 * _BLOCK or i + 1 == len(column)):
            for r, t, ids in zip(rows, texts, sampler.encode(texts, keys[rows]), strict=True):
                yield r, t, ids
            rows, texts, size = [], [], 0


def _mapped(docs: DataFrame, path: str, seed: int, sharpness: float, make, schema: str) -> DataFrame:
    held, state = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path)), {}

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if "s" not in state:
            state["s"] = Sampler(held.value, seed, sharpness)
        yield make(batch, state["s"])

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), over, schema)


def encode(docs: DataFrame, path: str = VOCABULARY, seed: int = 4, sharpness: float = 1.0) -> DataFrame:
    """``doc_id, ids`` (array of int, null for null text)."""

    def make(batch: pa.RecordBatch, sampler: Sampler) -> pa.RecordBatch:
        ids: list[np.ndarray | None] = [None] * batch.num_rows
        for r, _, x in _sampled(batch, sampler):
            ids[r] = x
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _mapped(docs, path, seed, sharpness, make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""
    held = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        table = held.value.table()
        return pa.array([None if x is None else b"".join(map(table.__getitem__, x)).decode()[1:] for x in ids.to_pylist()], pa.string())

    return encoded.select("doc_id", text("ids").alias("text"))


ROUND_TRIP = "doc_id long, n_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean"


def round_trip(docs: DataFrame, path: str = VOCABULARY, seed: int = 4, sharpness: float = 1.0) -> DataFrame:
    """Encodes and decodes each document: counts, digests of the ids (little-endian int32) and of the decoded text."""

    def make(batch: pa.RecordBatch, sampler: Sampler) -> pa.RecordBatch:
        rows: list[tuple] = [(None,) * 4] * batch.num_rows
        for r, text, ids in _sampled(batch, sampler):
            back = sampler.decode(ids)
            rows[r] = (len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == text.encode())
        kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
        cols = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ROUND_TRIP.replace(",", "").split()[::2])

    return _mapped(docs, path, seed, sharpness, make, ROUND_TRIP)
