"""N-gram Jaccard join (3): exact near-duplicate links by a prefix-tree join over globally ordered shingle sets.

A text's set holds the hashes of its distinct 5-word shingles (words between white space, A-Z as a-z; with
fewer words the whole sequence). Two texts link when 100 * intersection >= 75 * union. The steps:

1. Equal sets form a class; from here on a class stands for all its rows.
2. A class keeps going only if enough of its shingles stand in another class too: with a partner it shares
   all but n // 4. Half of the hash space is counted, which is exact as long as more than n // 4 of a set
   lies in it (smaller sets keep going). The shingles travel in packed blocks, not in rows, and those that a
   task itself finds twice are counted there and sent once.
3. Contraction: classes with the same least hash, under any of three hash functions, meet in blocks of
   bounded size and are joined there in a prefix tree; every block hands on one class of each component it
   finds, as long as that makes them fewer. All links are verified, so nothing false is joined.
4. The count of step 2 again over all shingles, now for shingles that stand in two components: what is left
   can still have links across components.
5. Prefix filter, exact: of each class so many shingles, those under the fewest components first, that a link
   must share one. Classes that share one make a pair if their signatures (parities, of which no more can
   differ than elements) allow a link; under hot shingles the signatures meet in cells. The circles that these
   pairs form meet by size band, large ones in blocks pairwise; each meeting is a prefix-tree join of the sets.
6. Components of components: few edges in one task, many by label propagation over written tables.

In the tree, sets with the same beginning share it, with the overlap counted so far; a subtree is left as
soon as the overlap plus what may remain falls short for every size below it. Two classes that are joined
already are not compared again, so a group of m copies costs no m * m links.

Defined results: null, empty and blank texts have 0 shingles and are alone; rows without an id get a null
component and link with nothing; rows that share an id but not a text are apart unless they link.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import BROADCAST_ROWS, SPACED, U, discard, free, map_rows, mix, pieces, release, settle, sized, words_of

WORDS = 5
BLOCK = 192  # classes in a block of a prefix-tree join, about
CELL = 4096  # classes whose signatures meet in a task, about
LIGHT = 64  # classes under a prefix shingle that meet pair by pair; above, by cells
PACK = 750_000  # shingles that a task holds before it sends them, about
BUCKET = 2_000_000  # packed shingles in a bucket, about


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for a sequence of word hashes."""
    s = np.full_like(parts[0], len(parts))
    for p in parts:
        s = (s ^ p) * U(0x9FB21C651E98DF25)
        s ^= s >> U(28)
    return mix(s, 31)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for _, data, offsets in pieces(column):
        h, _, bounds = words_of(SPACED, data, offsets)
        n = len(h) - WORDS + 1
        s = combine([h[k : k + n] for k in range(WORDS)]) if n > 0 else h[:0]
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo >= WORDS:
                x = np.sort(s[lo : hi - WORDS + 1])
                yield x[np.append(True, x[1:] != x[:-1])]
            elif hi > lo:
                yield combine([h[k : k + 1] for k in range(lo, hi)])
            else:
                yield h[:0]


def class_of(x: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    a = mix(np.array([np.bitwise_xor.reduce(mix(x, 1)) ^ U(len(x))], U))
    b = mix(np.array([mix(x, 2).sum(dtype=U)], U))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


_LOW = U(1 << 63)


def low(x: np.ndarray) -> int:
    return int(np.searchsorted(x, _LOW))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def members(docs: DataFrame) -> DataFrame:
    """``doc_id, n, n_low, c, c2``: the size and the class of each row's set."""

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [(len(x), low(x), *(class_of(x) if len(x) else (None, None))) for x in shingle_sets(batch.column("text"))]
        cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n", "n_low", "c", "c2"])

    return map_rows(_texts(docs), make, "doc_id long, n long, n_low long, c long, c2 long")


# -- Steps 2 and 4: how many shingles of a class stand under another tag too


_ANY = np.uint16(0xFFFF)  # owner of a shingle that a pack itself found under two tags
_WORD = U(16)


def _packed(tokens: list[np.ndarray], classes: list[int], tags: list[int], bits: int, shift: int) -> Iterator[pa.RecordBatch]:
    """Rows ``bucket, pack, tokens, owner, classes, tags``: up to 32 bits of a shingle and its class's number in the pack.

    A shingle that stands under two tags in the pack is counted here and sent once, whatever the number of its
    owners, so a hot one costs its bucket a row per pack. Buckets below 0 hold these counts.
    """
    rest = min(32, 48 - bits)
    x = np.concatenate(tokens) << U(shift)
    owner = np.repeat(np.arange(len(tokens), dtype=U), [len(t) for t in tokens])
    x = (x >> U(64 - bits - rest)) << _WORD | owner
    x = np.sort(x)
    x = x[np.append(True, x[1:] != x[:-1])]
    token, owner = x >> _WORD, (x & U(0xFFFF)).astype(np.uint16)
    tag = np.array(tags, np.int64)
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    n = np.diff(first, append=len(token))
    under = tag[owner]
    mixed = np.minimum.reduceat(under, first) != np.maximum.reduceat(under, first)
    here = np.repeat(mixed, n)
    cls = np.array(classes, np.int64)
    pack = int((mix(cls.view(U), 3) * (np.arange(len(cls), dtype=U) * U(2) + U(1))).sum(dtype=U).astype(np.int64))  # the same whenever a task is run again
    counts = np.bincount(owner[here], minlength=len(cls)).astype(np.uint32)
    rows = [(-1 - (pack & ((1 << bits) - 1)), pack, counts.tobytes(), None, cls.tobytes(), None)]
    send = ~here
    send[first] = True
    owner[here] = _ANY
    token, owner = token[send], owner[send]
    bucket = (token >> U(rest)).astype(np.int32)
    token = (token & U((1 << rest) - 1)).astype(np.uint32)
    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
    under = tag.tobytes()
    rows += [(int(bucket[lo]), pack, token[lo:hi].tobytes(), owner[lo:hi].tobytes(), None, under) for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(token)], strict=True)]
    names = ["bucket", "pack", "tokens", "owner", "classes", "tags"]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names)


_COUNTED = "pack long, owner binary, counts binary, classes binary"


def _shared(table: pa.Table) -> pa.Table:
    """One bucket: for each pack, how many shingles of its classes stand under two tags at least."""
    out, tokens, tags, owners, packs, size = [], [], [], [], [], 0
    for row in table.to_pylist():
        if row["bucket"] < 0:
            out.append((row["pack"], None, row["tokens"], row["classes"]))
            continue
        owner, tag = np.frombuffer(row["owner"], np.uint16), np.frombuffer(row["tags"], np.int64)
        tokens.append(np.frombuffer(row["tokens"], np.uint32))
        tags.append(tag[np.where(owner == _ANY, 0, owner)])
        owners.append(np.where(owner == _ANY, -1, owner.astype(np.int64) + size))
        packs.append((row["pack"], size, size + len(tag)))
        size += len(tag)
    if packs:
        t, g, o = map(np.concatenate, (tokens, tags, owners))
        order = np.argsort(t, kind="stable")
        t, g, o = t[order], g[order], o[order]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        mixed = (np.minimum.reduceat(g, first) != np.maximum.reduceat(g, first)) | (np.minimum.reduceat(o, first) < 0)
        keep = np.repeat(mixed, np.diff(first, append=len(t))) & (o >= 0)
        counts = np.bincount(o[keep], minlength=size)
        for pack, lo, hi in packs:
            some = np.flatnonzero(counts[lo:hi])
            if len(some):
                out.append((pack, some.astype(np.uint16).tobytes(), counts[lo:hi][some].astype(np.uint32).tobytes(), None))
    cols = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table({k: pa.array(c, t) for k, c, t in zip(("pack", "owner", "counts", "classes"), cols, (pa.int64(), *[pa.binary()] * 3), strict=True)})


def _by_class(table: pa.Table) -> pa.Table:
    """One pack: the counts of its classes, from all buckets. Packs of the same classes hold the same sets."""
    rows = table.to_pylist()
    own = [r for r in rows if r["owner"] is None]
    cls, total = np.frombuffer(own[0]["classes"], np.int64), np.frombuffer(own[0]["counts"], np.uint32).astype(np.int64)
    for r in rows:
        if r["owner"] is not None:
            total[np.frombuffer(r["owner"], np.uint16)] += np.frombuffer(r["counts"], np.uint32)
    return pa.table({"c": pa.array(cls, pa.int64()), "shared": pa.array(total, pa.int64())})


_PACKED = "bucket int, pack long, tokens binary, owner binary, classes binary, tags binary"


def _bits(total: int) -> int:
    """Buckets of about ``BUCKET`` shingles, as a power of two."""
    return min(24, max(4, int(np.ceil(np.log2(max(1, total / BUCKET))))))


def shared_counts(df: DataFrame, read, half: bool, total: int) -> DataFrame:
    """``c, shared``. ``read``: batch to (class, tag, set); ``total``: about how many shingles come, which sets the buckets.

    A class that stands in several packs has its whole count from each of them.
    """
    bits = _bits(total)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tokens, classes, tags, size = [], [], [], 0
        for batch in batches:
            for c, tag, x in read(batch):
                x = x[: low(x)] if half else x
                if not len(x) or c in seen:
                    continue
                seen.add(c)
                tokens.append(x)
                classes.append(c)
                tags.append(tag)
                size += len(x)
                if size > PACK or len(tokens) >= 65_000:
                    yield from _packed(tokens, classes, tags, bits, int(half))
                    tokens, classes, tags, size = [], [], [], 0
                    seen.clear()
        if tokens:
            yield from _packed(tokens, classes, tags, bits, int(half))
        release()

    counted = df.mapInArrow(pack, _PACKED).groupBy("bucket").applyInArrow(_shared, _COUNTED)
    return counted.groupBy("pack").applyInArrow(_by_class, "c long, shared long").groupBy("c").agg(F.max("shared").alias("shared"))


# -- The prefix tree


class _Node:
    __slots__ = ("children", "ends", "least", "most", "part")

    def __init__(self, part: np.ndarray) -> None:
        self.part, self.children, self.ends, self.least, self.most = part, [], [], 0, 0


def _tree(sets: list[np.ndarray], rows: list[int]) -> _Node:
    """Over sets in lexical order. A node's part is what all below share next."""
    top = _Node(np.zeros(0, U))
    todo = [(top, 0, len(rows), 0)]
    while todo:
        parent, lo, hi, depth = todo.pop()
        a, b = sets[rows[lo]], sets[rows[hi - 1]]
        n = min(len(a), len(b)) - depth
        differ = np.flatnonzero(a[depth : depth + n] != b[depth : depth + n])
        end = depth + (int(differ[0]) if len(differ) else n)
        node = _Node(a[depth:end])
        parent.children.append(node)
        sizes = [len(sets[r]) for r in rows[lo:hi]]
        node.least, node.most = min(sizes), max(sizes)
        while lo < hi and len(sets[rows[lo]]) == end:
            node.ends.append(rows[lo])
            lo += 1
        while lo < hi:
            head, to = sets[rows[lo]][end], lo + 1
            while to < hi and sets[rows[to]][end] == head:
                to += 1
            todo.append((node, lo, to, end))
            lo = to
    return top.children[0]


def tree_join(sets: list[np.ndarray], group: list[int]) -> list[tuple[int, int]]:
    """Links (row, row) that join all rows that can be joined; rows of one ``group`` count as joined already.

    Sets are arrays of uint64, each in the order that is common to all.
    """
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := root.get(x, x)) != x:
            root[x] = root.get(p, p)
            x = root[x]
        return x

    rows = sorted(range(len(sets)), key=lambda r: sets[r].astype(">u8").tobytes())
    if not rows:
        return []
    links: list[tuple[int, int]] = []
    start = _tree(sets, rows)
    # One side of every pair is outside the largest group.
    largest, size = Counter(group).most_common(1)[0]
    for x in rows if size == 1 else [r for r in rows if group[r] != largest]:
        own, n = sets[x], len(sets[x])
        todo = [(start, 0, 0)]
        while todo:
            node, overlap, depth = todo.pop()
            rest = n
            if len(node.part):
                at = np.searchsorted(own, node.part)
                overlap += int((own[np.minimum(at, n - 1)] == node.part).sum())
                depth += len(node.part)
                rest = n - int(np.searchsorted(own, node.part[-1], "right"))
            best = min(max(depth + rest, node.least), node.most)  # the size with the best chance
            if 7 * (overlap + min(best - depth, rest)) < 3 * (n + best):
                continue
            for y in node.ends:
                if y != x and 7 * overlap >= 3 * (n + depth) and find(group[x]) != find(group[y]):
                    a, b = sorted((find(group[x]), find(group[y])))
                    root[b] = a
                    links.append((x, y))
            todo += [(c, overlap, depth) for c in node.children]
    return links


# -- Step 3


_SETS = "c long, n long, rep long, tokens binary, k0 long, k1 long, k2 long"
_KEYS = 3


def _least(x: np.ndarray) -> list[int]:
    """The set's least hash under each hash function."""
    return np.array([x[0], *(mix(x, 40 + k).min() for k in range(1, _KEYS))], U).view(np.int64).tolist()


def _block_links(table: pa.Table) -> pa.Table:
    """One block: for each class, the class that stands for its component here."""
    classes = table.column("c").to_pylist()
    leader = {c: c for c in classes}

    def find(c: int) -> int:
        while leader[c] != c:
            leader[c] = leader[leader[c]]
            c = leader[c]
        return c

    if len(classes) > 1:
        for a, b in tree_join([np.frombuffer(t, U) for t in table.column("tokens").to_pylist()], classes):
            a, b = sorted((find(classes[a]), find(classes[b])))
            leader[b] = a
    told = pa.array([find(c) for c in classes], pa.int64())
    return pa.table({"c": table.column("c"), "leader": told, "key": table.column("key"), "parts": table.column("parts")})


def _contract(sets: DataFrame) -> DataFrame:
    """``a, b``: links found in blocks of about ``BLOCK`` classes that share a least hash.

    A key with more classes has several blocks; each hands on one class of each component, and these meet again
    as long as a round leaves a key three quarters of its classes at most. What is left then, if more than a
    block, is for the late links to find.
    """
    rounds, sizes = [], []
    for k in range(_KEYS):
        live, before, number = sets.select("c", F.col(f"k{k}").alias("key"), "tokens"), None, 0
        while True:
            size = live.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
            if before is not None:
                size = size.join(before.withColumnRenamed("m", "was"), "key").where(F.col("m") <= F.col("was") * F.when(F.col("m") <= BLOCK, 1.0).otherwise(0.75)).drop("was")
            size = sized(size)
            sizes.append(size)
            met = live.join(size.withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int")).drop("m"), "key").withColumn("s", F.pmod(F.xxhash64("c", F.lit(number)), F.col("parts")))
            told = settle(met.groupBy("key", "s").applyInArrow(_block_links, "c long, leader long, key long, parts int"))
            rounds.append(told)
            again = told.where("c = leader AND parts > 1").select("c", "key")
            if again.isEmpty():
                break
            again = sized(again)
            sizes.append(again)
            live, before, number = sets.select("c", "tokens").join(again, "c"), size, number + 1
    links = [told.where("c <> leader").select(F.col("c").alias("a"), F.col("leader").alias("b")) for told in rounds]
    return settle(reduce(DataFrame.unionByName, links).distinct(), *rounds, *sizes)


# -- Step 6


def _forest(table: pa.Table) -> pa.Table:
    """All of a few edges: the least node that each can reach."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
        a, b = sorted((find(a), find(b)))
        up[b] = a
    nodes = list(up)
    return pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array([find(x) for x in nodes], pa.int64())})


def components(edges: DataFrame, few: int = BROADCAST_ROWS) -> DataFrame:
    """``node, root``: the least node that each node of ``a, b`` can reach.

    Up to ``few`` edges (counted) are one task's work; more go by label propagation with tables written at every step.
    """
    own = () if getattr(edges, "_settled", None) else (settle(edges.select("a", "b")),)
    edges = own[0] if own else edges
    if edges.count() <= few:
        return settle(edges.groupBy(F.lit(0).alias("all")).applyInArrow(_forest, "node long, root long"), *own)
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = label.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        new = settle(step.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("root")), label)
        label = new.select("node", "root")
        label._settled = new._settled
        if new.where("old <> root").isEmpty():
            discard(both, *own)
            return label


# -- Step 5


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about half a pack."""
    size = np.cumsum(batch.column("n").to_numpy(zero_copy_only=False)) // (PACK // 2)
    edge = np.flatnonzero(np.diff(size, prepend=-1))
    for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), batch.num_rows], strict=True):
        yield batch.slice(lo, hi - lo)


def _ranked(left: DataFrame, total: int) -> DataFrame:
    """``c, tag, n, parts``: each class's shingles that stand under two tags, with the number of tags, by bucket."""
    bits = _bits(total)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole)):
            c, tag, n, sets = (batch.column(k).to_pylist() for k in ("c", "tag", "n", "tokens"))
            x = np.concatenate([np.frombuffer(t, U) for t in sets])
            owner = np.repeat(np.arange(len(c)), n)
            bucket = (x >> U(64 - bits)).astype(np.int64)
            order = np.argsort(bucket * len(c) + owner, kind="stable")
            x, at = x[order], (bucket * len(c) + owner)[order]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            ends, held = np.append(first[1:], len(x)), x.tobytes()
            who = at[first] % len(c)
            cols = [(at[first] // len(c)).tolist(), *([v[w] for w in who.tolist()] for v in (c, tag, n)), [held[8 * a : 8 * b] for a, b in zip(first.tolist(), ends.tolist(), strict=True)]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int32(), *[pa.int64()] * 3, pa.binary()), strict=True)], ["bucket", "c", "tag", "n", "tokens"])
        release()

    def rank(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(t, U) for t in table.column("tokens").to_pylist()]
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        x, tag = np.concatenate(sets), np.array(table.column("tag").to_numpy())[owner]
        order = np.lexsort((tag, x))
        new = np.append(True, x[order][1:] != x[order][:-1])
        tags = new | np.append(True, tag[order][1:] != tag[order][:-1])
        which = np.cumsum(new) - 1
        spread = np.empty(len(x), np.uint32)
        spread[order] = np.bincount(which, weights=tags)[which]
        at = np.append(0, np.cumsum([len(s) for s in sets])).tolist()
        parts = [(x[a:b][spread[a:b] > 1].tobytes(), spread[a:b][spread[a:b] > 1].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        out = pa.table({"c": table.column("c"), "tag": table.column("tag"), "n": table.column("n"), "tokens": pa.array([p[0] for p in parts], pa.binary()), "spread": pa.array([p[1] for p in parts], pa.binary())})
        return out.filter(pa.array([len(p[0]) > 0 for p in parts]))

    packed = left.select("c", "tag", "n", "tokens").mapInArrow(pack, "bucket int, c long, tag long, n long, tokens binary")
    each = packed.groupBy("bucket").applyInArrow(rank, "c long, tag long, n long, tokens binary, spread binary")
    return each.groupBy("c", "tag", "n").agg(F.collect_list(F.struct("tokens", "spread")).alias("parts"))


def _prefixes(left: DataFrame, total: int) -> DataFrame:
    """``token, c, tag, n``: the shingles under the fewest tags, so many of each class that two classes that link share one.

    A link shares three quarters of either set at least, all of it under two tags; what comes after the prefix
    is one shingle too few. Classes with fewer shingles under two tags can't link and go.
    """

    def prefix(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for c, tag, n, parts in zip(*(batch.column(k).to_pylist() for k in ("c", "tag", "n", "parts")), strict=True):
            x = np.concatenate([np.frombuffer(p["tokens"], U) for p in parts])
            few = len(x) - (n - n // 4) + 1
            if few > 0:
                spread = np.concatenate([np.frombuffer(p["spread"], np.uint32) for p in parts])
                rows.append((c, tag, n, x[np.lexsort((x, spread))[:few]].view(np.int64)))
        if rows:
            size = [len(r[3]) for r in rows]
            cols = [pa.array(np.concatenate([r[3] for r in rows]))] + [pa.array(np.repeat(np.array([r[k] for r in rows], np.int64), size)) for k in range(3)]
            yield pa.RecordBatch.from_arrays(cols, ["token", "c", "tag", "n"])

    return map_rows(_ranked(left, total), prefix, "token long, c long, tag long, n long")


def _light_pairs(table: pa.Table) -> pa.Table:
    """One bucket of prefix shingles: the pairs of classes of two tags and like sizes that share one."""
    token, c, tag, n = (np.array(table.column(k).to_numpy()) for k in ("token", "c", "tag", "n"))
    order = np.lexsort((c, n, token))
    token, c, tag, n = token[order], c[order], tag[order], n[order]
    found, at = [], np.arange(len(token))
    for step in range(1, LIGHT):
        at = at[at + step < len(token)]
        at = at[(token[at] == token[at + step]) & (4 * n[at] >= 3 * n[at + step])]
        if not len(at):
            break
        two = at[tag[at] != tag[at + step]]
        found.append(np.stack([np.minimum(c[two], c[two + step]), np.maximum(c[two], c[two + step])], 1))
        if len(found) % 16 == 0:
            found = [np.unique(np.concatenate(found), axis=0)]
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def signature(x: np.ndarray) -> bytes:
    """Parities of the set's hashes over 2 to 4 bits for each element (64 at least): as many bits differ between two sets as elements, at most."""
    bits = max(64, 1 << int(2 * len(x) - 1).bit_length())
    return np.packbits(np.bincount((mix(x, 60) & U(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ between rows of signatures; the longer ones are folded."""
    while a.shape[-1] > b.shape[-1]:
        a = a[..., : a.shape[-1] // 2] ^ a[..., a.shape[-1] // 2 :]
    while b.shape[-1] > a.shape[-1]:
        b = b[..., : b.shape[-1] // 2] ^ b[..., b.shape[-1] // 2 :]
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _near(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Of pairs with sizes and signatures, those that may link: two linked sets differ in a seventh of their sizes' sum at most."""
    a, b, n, m, s, t = (batch.column(k).to_pylist() for k in ("a", "b", "n", "m", "s", "t"))
    keep = [7 * int(_differ(np.frombuffer(x, U), np.frombuffer(y, U))) <= u + v for x, y, u, v in zip(s, t, n, m, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(col, keep, strict=True) if k], pa.int64()) for col in (a, b)], ["a", "b"])


def _cell_pairs(table: pa.Table) -> pa.Table:
    """One cell of classes under hot shingles: a forest over the pairs of two tags that may link."""
    c, tag, n = (np.array(table.column(k).to_numpy()) for k in ("c", "tag", "n"))
    first, second = (np.flatnonzero(np.array(table.column(k).to_numpy(zero_copy_only=False))) for k in ("first", "second"))
    held = [np.frombuffer(s, U) for s in table.column("sig").to_pylist()]
    words = min(map(len, held))
    flat = np.empty((len(held), words), U)
    for k, s in enumerate(held):
        flat[k] = np.bitwise_xor.reduce(s.reshape(-1, words), axis=0)
    up = {}

    def find(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = up[x]
        return x

    a, b = [], []
    for x in first.tolist():
        near = second[(tag[second] != tag[x]) & (4 * np.minimum(n[second], n[x]) >= 3 * np.maximum(n[second], n[x]))]
        differ = np.zeros(len(near), np.int64)
        for w in range(words):
            differ += np.bitwise_count(flat[near, w] ^ flat[x, w])
        for y in near[7 * differ <= n[near] + n[x]].tolist():
            if find(x) != find(y):
                up[find(x)] = find(y)
                a.append(int(c[x]))
                b.append(int(c[y]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _bands() -> Column:
    """J >= 3/4 keeps sizes within a factor of 4/3, so with that step partners lie in the same band or in neighbouring ones; a group holds two."""
    band = F.floor(F.log(F.col("n") + F.lit(0.0)) / F.log(F.lit(4.0 / 3)) + F.lit(1e-9)).cast("int")
    return F.explode(F.array(band, band - 1))


def _cells(inside: DataFrame, block: int) -> DataFrame:
    """``inside`` (c, n, root and more) dealt into cells: all pairs of the blocks of a circle and size band."""
    post = inside.withColumn("band", _bands())
    size = post.groupBy("root", "band").agg(F.count("*").alias("m")).where("m > 1").select("root", "band", F.ceil(F.col("m") / block).cast("int").alias("parts"))
    part = post.join(size, ["root", "band"]).withColumn("p", F.pmod(F.xxhash64("c"), "parts").cast("int"))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("p", q).alias("i"), F.greatest("p", q).alias("j"))))
    return part.withColumn("cell", cell).withColumn("first", F.col("p") == F.col("cell.i")).withColumn("second", F.col("p") == F.col("cell.j"))


def _candidates(left: DataFrame, total: int) -> DataFrame:
    """``a, b``: pairs of classes of two tags, with all that link in the same circle."""
    post = settle(_prefixes(left, total))
    heavy = sized(post.groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") > LIGHT).select("token"))
    bucket = F.pmod(F.xxhash64("token"), F.lit(1 << _bits(8 * max(1, post.count()))))
    pairs = settle(post.join(heavy, "token", "left_anti").withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_light_pairs, "a long, b long").distinct())

    def sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sigs = pa.array([signature(np.frombuffer(t, U)) for t in batch.column("tokens").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("c", "tag", "n")), sigs], ["c", "tag", "n", "sig"])

    signed = settle(map_rows(left.select("c", "tag", "n", "tokens"), sign, "c long, tag long, n long, sig binary"))
    one, two = signed.select(F.col("c").alias("a"), "n", F.col("sig").alias("s")), signed.select(F.col("c").alias("b"), F.col("n").alias("m"), F.col("sig").alias("t"))
    out = settle(map_rows(pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "s", "t"), _near, "a long, b long"), pairs)
    hot = settle(post.join(heavy, "token").select("token", "c", _bands().alias("band")), post)
    if not hot.isEmpty():
        hubs = sized(hot.groupBy("token", "band").agg(F.min("c").alias("b")))
        circles = components(hot.join(hubs, ["token", "band"]).select(F.col("c").alias("a"), "b").where("a <> b").distinct())
        inside = settle(signed.join(sized(circles).withColumnRenamed("node", "c"), "c"), circles, hubs)
        out = settle(out.unionByName(_cells(inside, CELL).groupBy("root", "band", "cell").applyInArrow(_cell_pairs, "a long, b long")).distinct(), out, inside)
    discard(signed, heavy, hot)
    return out


def _late_links(left: DataFrame, total: int) -> DataFrame | None:
    """``a, b``: links between tags among ``c, tag, n, tokens``; None if there can be none."""
    pairs = _candidates(left, total)
    if pairs.isEmpty():
        return None
    circles = components(pairs)
    inside = settle(left.join(sized(circles).withColumnRenamed("node", "c"), "c").select("c", "tag", "n", "root", "tokens"), pairs, circles)

    def join(table: pa.Table) -> pa.Table:
        tags = table.column("tag").to_pylist()
        links = tree_join([np.frombuffer(t, U) for t in table.column("tokens").to_pylist()], tags) if len(set(tags)) > 1 else []
        return pa.table({"a": pa.array([tags[x] for x, _ in links], pa.int64()), "b": pa.array([tags[y] for _, y in links], pa.int64())})

    cells = _cells(inside, BLOCK).select("tag", "root", "band", "cell", "tokens")
    return settle(cells.groupBy("root", "band", "cell").applyInArrow(join, "a long, b long").distinct(), inside)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``, a row for each row: the least id that its text reaches by links."""
    own = settle(members(docs))
    classes = settle(own.where("n > 0 AND doc_id IS NOT NULL").groupBy("c", "c2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("n_low").alias("n_low")))
    total = int(classes.agg(F.sum("n")).first()[0] or 0)

    def from_texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        for x in shingle_sets(batch.column("text")):
            if len(x):
                c, _ = class_of(x)
                yield c, c, x

    shared = shared_counts(_texts(docs.where("doc_id IS NOT NULL")), from_texts, True, total // 2)
    enough = F.coalesce("shared", F.lit(0)) >= F.col("n_low") - F.floor(F.col("n") / 4)
    alive = settle(classes.join(shared, "c", "left").where(enough).select("c", "c2", "rep"))

    def sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        wanted = zip(batch.column("c").to_pylist(), batch.column("c2").to_pylist(), batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text")), strict=True)
        rows = [(c, len(x), rep, x.tobytes(), *_least(x)) for c, c2, rep, x in wanted if len(x) and class_of(x) == (c, c2)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.int64(),) * 3 + (pa.binary(),) + (pa.int64(),) * _KEYS, strict=True)], ["c", "n", "rep", "tokens", "k0", "k1", "k2"])

    with_text = _texts(docs).join(sized(alive), F.col("doc_id") == F.col("rep")).select("doc_id", "text", "c", "c2")
    held = settle(map_rows(with_text, sets, _SETS))
    if _repeated(own):
        held = settle(held.dropDuplicates(["c"]), held)
    discard(alive)
    edges = _contract(held)
    joined = components(edges)
    roots = settle(held.select("c").join(joined.withColumnRenamed("node", "c"), "c", "left").select("c", F.coalesce("root", "c").alias("root")), edges, joined)
    tagged = held.select("c", "n", "tokens").join(sized(roots).withColumnRenamed("root", "tag"), "c")

    def from_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        for c, tag, t in zip(batch.column("c").to_pylist(), batch.column("tag").to_pylist(), batch.column("tokens"), strict=True):
            yield c, tag, np.frombuffer(t.as_buffer(), U)

    again = sized(shared_counts(tagged.select("c", "tag", "tokens"), from_sets, False, int(held.agg(F.sum("n")).first()[0] or 0)))
    left = settle(tagged.join(again, "c").where(F.col("shared") >= F.col("n") - F.floor(F.col("n") / 4)).select("c", "tag", "n", "tokens"), held, again)
    many = int(left.agg(F.sum("n")).first()[0] or 0)
    late = _late_links(left, many) if many else None
    discard(left)
    if late is not None and not late.isEmpty():
        top = components(late)
        roots = settle(roots.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("c", F.coalesce("top", "root").alias("root")), roots, top, late)
    rooted = classes.select("c", "rep").join(roots, "c", "left").select("c", "rep", F.coalesce("root", "c").alias("root"))
    first = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    told = settle(rooted.join(first, "root").select("c", "component_id"), classes, roots)
    out = own.join(told, "c", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _repeated(own: DataFrame) -> bool:
    """Whether an id stands in more than one row."""
    return not own.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").isEmpty()


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the least id; rows without an id or shingles stay.

    Where ids repeat, rows get numbers of their own in the order of the ids, so that an id stands for one text.
    """
    number, chosen = free(docs, "number", "chosen")
    own = F.col("doc_id").cast("long")
    rows, key = docs.where(own.isNotNull()), own
    if _repeated(docs.select(own.alias("doc_id"))):
        rows = settle(rows.orderBy(own, F.xxhash64("text")).withColumn(number, F.monotonically_increasing_id()))
        key = F.col(number)
    told = near_duplicates(rows.select(key.alias("doc_id"), "text")).where("doc_id = component_id").select(F.col("doc_id").alias(chosen))
    return rows.join(told, key == F.col(chosen), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(own.isNull()))


SQL = r"""WITH RECURSIVE word AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  shingle AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM word WHERE len(w) > 0)),
  size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
  pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN size USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""
