"""N-gram Jaccard self-join by signature trees, and its components.

A document's set is its distinct 5-word shingles (64-bit hashes). Two documents
link when 100 * common >= 75 * united shingles. A signature is a bitmap of the
set and its size; an inner node holds the OR of its children's bitmaps and the
range of their sizes. Two nodes can be pruned when no pair below them can have
enough in common: the bits they share, and the shingles that share a bit with
another of the same set, bound the overlap from above.

Trees over everything would saturate near the root, so the forest's roots are
blocks that no link can leave: of two linked sets at least one shingle is among
the first n - ceil(0.75 n) + 1 of each, in any fixed order. The order puts
shingles of frequent sketch cells last, so shared passages rarely make blocks.

1. In each block all members are paired with its smallest one. These pairs are
   pruned by their signatures and verified on the texts; links make components.
2. Blocks that still hold several components get a signature tree; the dual
   traversal goes down pairs of nodes and returns pairs of documents of different
   components that cannot be pruned. These are verified too.

Every linked pair is thus verified or already joined by verified links, while a
group of near copies never turns into all its pairs.

Defined results: null text counts as empty. Texts without words have an empty
set and are linked with nothing. Equal word sequences are one class, compared
once. A component is named by its smallest id; null ids name nothing (a
component of null ids only has a null name). Repeated rows are members of the
same class. An empty table gives an empty result. Other columns are not read.

Scale: shuffled are (shingle, class) pairs of the prefixes, as packed columns;
signatures of the documents in blocks; texts of pairs that survive their
signatures. The sketch has a fixed size. Frequent shingles are dealt over
several tasks by class, large blocks over tiles of the pair matrix. Hash
classes are checked against a second hash; if two texts met, another seed is
taken. Components come from star contraction in Spark.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import value_positions
from ..sources.tables import materialize
from .common import each_text, small_side, whole

U = np.uint64


@dataclass(frozen=True)
class Join:
    words: int = 5
    sketch_bits: int = 26
    #: Prefix rows of a task that groups them, and of a dealt frequent shingle.
    group_rows: int = 250_000
    salt_rows: int = 65_536
    #: Members of a block that one task compares; larger ones are tiled.
    tile: int = 4096
    fanout: int = 8


# ---- sets -----------------------------------------------------------------


class Shingler:
    """Sorted distinct shingle hashes of a text and its class hashes."""

    def __init__(self, seed: int, words: int):
        self.seed, self.n, self.known = seed, words, {}
        r = np.random.default_rng(20_000 + seed)
        self.factors = r.integers(1, 2**63, words, dtype=np.uint64) * U(2) + U(1)

    def __call__(self, text: str) -> tuple[np.ndarray, int, int]:
        found = text.encode().lower().split()  # bytes: ASCII only
        if not found:
            return np.zeros(0, U), 0, 0
        joined = b" ".join(found)
        both = xxhash.xxh3_128_intdigest(joined, self.seed)
        cls, check = both >> 64, both & 0xFFFFFFFFFFFFFFFF
        if len(found) < self.n:
            return np.array([xxhash.xxh64_intdigest(joined, self.seed)], U), cls, check
        if len(self.known) > 150_000:
            self.known.clear()
        known, digest, seed = self.known, xxhash.xxh64_intdigest, self.seed
        for w in found:
            if w not in known:
                known[w] = digest(w, seed)
        h = np.fromiter(map(known.__getitem__, found), U, len(found))
        m = len(h) - self.n + 1
        s = h[:m] * self.factors[0]
        for i in range(1, self.n):
            s = s + h[i : i + m] * self.factors[i]
        s ^= s >> U(33)
        s *= U(0xFF51AFD7ED558CCD)
        s ^= s >> U(29)
        return np.unique(s), cls, check


def signature(s: np.ndarray) -> bytes:
    """Parity bitmap of 2 to 4 bits a shingle (a power of two), then the OR
    bitmap of half as many, in 64-bit words."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    half = max(64, bits // 2)
    odd, any_ = np.zeros(bits // 64, U), np.zeros(half // 64, U)
    at = s & U(bits - 1)
    np.bitwise_xor.at(odd, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    at = (s >> U(32)) & U(half - 1)
    np.bitwise_or.at(any_, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return odd.tobytes() + any_.tobytes()


def unpack(sig: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmap folded to ``words`` words, OR bitmap to half of that."""
    n = parity_words(sig)
    both = np.frombuffer(sig, U)
    odd, any_ = both[:n], both[n:]
    while len(odd) > words:
        odd = odd[: len(odd) // 2] ^ odd[len(odd) // 2 :]
    while len(any_) > max(1, words // 2):
        any_ = any_[: len(any_) // 2] | any_[len(any_) // 2 :]
    return odd, any_


def parity_words(sig: bytes) -> int:
    return max(1, len(sig) // 8 * 2 // 3)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _describe(how: Join, seed: int):
    """One row per document, and the task's sketch: shingles counted by the
    leading bits of their hashes, as compressed (cell, count) lists of 64
    pieces."""
    names = ["_id", "cls", "chk", "n", "sig", "piece", "cells"]
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.int32(), pa.binary()]

    def sketch(held: list[np.ndarray]) -> pa.RecordBatch:
        cells, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        cut = np.searchsorted(cells, np.arange(65) << (how.sketch_bits - 6))
        used = [i for i in range(64) if cut[i] < cut[i + 1]]
        packed = [zlib.compress(np.diff(cells[cut[i] : cut[i + 1]], prepend=0).astype(np.uint32).tobytes() + counts[cut[i] : cut[i + 1]].astype(np.uint32).tobytes(), 1) for i in used]
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(used), k) for k in kinds[:5]], pa.array(used, kinds[5]), pa.array(packed, kinds[6])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, held, size = Shingler(seed, how.words), [], 0
        for batch in batches:
            out = []
            for t in each_text(batch.column(1)):
                s, cls, check = shingle(t)
                if len(s):
                    held.append((s >> U(64 - how.sketch_bits)).astype(np.uint32))
                    size += len(s)
                out.append((_signed(cls), _signed(check), len(s), signature(s) if len(s) else b""))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds[1:5], strict=True)], *[pa.nulls(len(out), k) for k in kinds[5:]]], names=names)
            if size > 1_000_000:
                size = 0
                yield sketch(held)
        if held:
            yield sketch(held)

    return run


def describe(docs: DataFrame, text: str, id_col: str, how: Join) -> tuple[DataFrame, int]:
    """Written rows of all documents (``_id``, ``cls``, ``n``, ``sig``) and of
    the sketch, and the seed under which no two word sequences share a class."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), whole(text).alias("t"))
    seed = 0
    while True:
        out = materialize(rows.mapInArrow(_describe(how, seed), "_id bigint, cls bigint, chk bigint, n bigint, sig binary, piece int, cells binary"), "shingle_sets")
        met = out.where("n > 0").groupBy("cls").agg(F.min("chk").alias("a"), F.max("chk").alias("b")).where("a <> b")
        if met.isEmpty():
            return out, seed
        seed += 1


def frequent_cells(described: DataFrame, how: Join) -> bytes:
    """Sketch cells that count more than four times the mean (a fourth of the
    cells at most) with the binary logarithm of the count, compressed."""
    total = described.agg(F.sum("n")).first()[0] or 0
    least = 4 * total / (1 << how.sketch_bits) + 8

    def add(table: pa.Table) -> pa.Table:
        piece = table.column("piece")[0].as_py()
        first, cells = piece << (how.sketch_bits - 6), np.zeros(1 << (how.sketch_bits - 6), np.int64)
        for x in table.column("cells").to_pylist():
            at, counts = np.split(np.frombuffer(zlib.decompress(x), np.uint32), 2)
            cells[np.cumsum(at, dtype=np.int64) - first] += counts
        often = np.flatnonzero(cells > least)
        level = np.log2(cells[often]).astype(np.uint8)
        return pa.table({"piece": pa.array([piece], pa.int32()), "cells": pa.array([(often + first).astype(np.uint32).tobytes()], pa.binary()), "level": pa.array([level.tobytes()], pa.binary())})

    got = described.where("piece IS NOT NULL").select("piece", "cells").groupBy("piece").applyInArrow(add, "piece int, cells binary, level binary").collect()
    got = sorted(got, key=lambda r: r["piece"])  # at most 64 rows of bounded size
    return zlib.compress(b"".join(bytes(r["cells"]) for r in got) + b"".join(bytes(r["level"]) for r in got))


class Frequent:
    """Level of each shingle's cell, 0 if it isn't frequent."""

    def __init__(self, packed: bytes, bits: int):
        raw = zlib.decompress(packed)
        n = len(raw) // 5
        self.cells, self.level, self.bits = np.frombuffer(raw[: 4 * n], np.uint32), np.frombuffer(raw[4 * n :], np.uint8), bits

    def __call__(self, s: np.ndarray) -> np.ndarray:
        if not len(self.cells):
            return np.zeros(len(s), np.int64)
        cell = (s >> U(64 - self.bits)).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        return np.where(self.cells[at] == cell, self.level[at], 0).astype(np.int64)


# ---- blocks ---------------------------------------------------------------


def prefix_size(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def _prefixes(how: Join, seed: int, levels: bytes, groups: int):
    """Packed (shingle, class) columns of the documents' prefixes by group. A
    frequent shingle is dealt over several groups by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(seed, how.words)
        level = Frequent(levels, how.sketch_bits)
        keys, owners, seen, rows = [], [], set(), 0

        def flush() -> pa.RecordBatch:
            k = np.concatenate(keys)
            c = np.repeat(np.array([o for o, _ in owners], np.int64), [m for _, m in owners])
            salts = np.maximum((1 << level(k)) // how.salt_rows, 1)
            salt = np.where(salts > 1, (c.view(U) % salts.astype(U)).astype(np.int64), 0)
            group = ((k + salt.astype(U) * U(0x9E3779B97F4A7C15)) % U(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            found, first = np.unique(group[order], return_index=True)
            cut = np.append(first, len(order))
            parts = [order[cut[i] : cut[i + 1]] for i in range(len(found))]
            keys.clear()
            owners.clear()
            pack = lambda x: pa.array([x[p].tobytes() for p in parts], pa.binary())
            short = (k >> U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]  # 40 bits: keys that
            # meet by chance make one block, which costs comparisons only
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pack(short), pack(c), pack(((salts > 1) * (salt + 1)).astype(np.uint32))], names=["g", "keys", "classes", "salts"])

        for batch in batches:
            for t in each_text(batch.column(0)):
                s, cls, _ = shingle(t)
                if not len(s) or cls in seen:
                    continue
                seen.add(cls)
                often = level(s) > 0
                p = prefix_size(len(s))
                keys.append(np.concatenate([s[~often], s[often]])[:p])
                owners.append((_signed(cls), p))
                rows += p
                if rows > 500_000:
                    yield flush()
                    rows = 0
        if keys:
            yield flush()

    return run


def _blocks(table: pa.Table) -> pa.Table:
    """Of a group of prefix rows: pairs (smallest member, member) of the blocks,
    the blocks of three or more members once each, and one member of each part
    of a dealt shingle."""
    joined = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    five = joined("keys", np.uint8).reshape(-1, 5)
    k = np.pad(five, ((0, 0), (0, 3))).copy().view("<u8").ravel().astype(np.int64)
    c, salt = joined("classes", np.int64), joined("salts", np.uint32).astype(np.int64)
    order = np.lexsort((c, salt, k))
    k, c, salt = k[order], c[order], salt[order]
    fresh = np.ones(len(k), bool)  # a class may come from several tasks
    fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (salt[1:] != salt[:-1])
    k, c, salt = k[fresh], c[fresh], salt[fresh]
    start = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (salt[1:] != salt[:-1])])) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(k)))
    many = np.repeat(size >= 2, size)
    first = np.repeat(c[start], size)
    pairs = np.unique(np.stack([first[many], c[many]], 1), axis=0) if many.any() else np.zeros((0, 2), np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    out: dict[int, bytes] = {}
    parts = []
    for i in np.flatnonzero((size >= 3) | (salt[start] > 0)):
        members = c[start[i] : start[i] + size[i]].tobytes()
        if salt[start[i]]:  # part of a dealt shingle: the block is the shingle's
            parts.append((int(k[start[i]]), members))
        else:
            out[_signed(xxhash.xxh64_intdigest(members))] = members
    blocks = [*out.items(), *parts]
    n, m, d = len(pairs), len(blocks), len(parts)
    head = [int(np.frombuffer(x[:8], np.int64)[0]) for _, x in parts]
    return pa.table({
        "a": pa.array([*pairs[:, 0].tolist(), *[None] * m, *head], pa.int64()),
        "b": pa.array([*pairs[:, 1].tolist(), *[None] * (m + d)], pa.int64()),
        "block": pa.array([*[None] * n, *[b for b, _ in blocks], *[b for b, _ in parts]], pa.int64()),
        "members": pa.array([*[None] * n, *[np.frombuffer(x, np.int64) for _, x in blocks], *[None] * d], pa.list_(pa.int64())),
    })


# ---- signature trees ------------------------------------------------------


def _possible(common, slack, size_a, size_b):
    """Whether an overlap bounded by common + slack can reach the threshold:
    100 i >= 75 (x + y - i) is 7 i >= 3 (x + y)."""
    return 7 * (common + slack) >= 3 * (size_a + size_b)


def pair_possible(sig_a: bytes, n_a: int, sig_b: bytes, n_b: int) -> bool:
    """100 i >= 75 (x + y - i) is also 7 d <= x + y for the d = x + y - 2 i
    shingles that aren't common."""
    if 4 * min(n_a, n_b) < 3 * max(n_a, n_b):
        return False
    w = min(parity_words(sig_a), parity_words(sig_b))
    (oa, a), (ob, b) = unpack(sig_a, w), unpack(sig_b, w)
    if 7 * int(np.bitwise_count(oa ^ ob).sum()) > n_a + n_b:
        return False
    return bool(_possible(min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum())), 0, n_a, n_b))


class Tree:
    """Levels of nodes over documents ordered by component and size, leaves
    first: OR of the bitmaps, smallest and largest size, and the most shingles of a set that
    have no bit of their own (``slack``). ``comps``: the smallest and largest component
    below each node (all differ if none are given)."""

    def __init__(self, parity: np.ndarray, bitmaps: np.ndarray, sizes: np.ndarray, fanout: int, comps: np.ndarray | None = None):
        self.parity = parity
        self.comps = None if comps is None else [(comps, comps)]
        slack = sizes - np.bitwise_count(bitmaps).sum(1, dtype=np.int64)
        self.levels = [(bitmaps, sizes, sizes, slack)]
        self.fanout = fanout
        while len(self.levels[-1][1]) > fanout:
            b, lo, hi, sl = self.levels[-1]
            at = np.arange(0, len(lo), fanout)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sl, at)))
            if self.comps is not None:
                least, most = self.comps[-1]
                self.comps.append((np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def height(self) -> int:
        return len(self.levels) - 1


#: Pairs of nodes that go down together.
NODE_PAIRS = 8192


def dual_traversal(x: Tree, y: Tree, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves (i of x, j of y; i < j if both are the ``same`` tree)
    that the bounds leave over, without those of one component if the trees know
    components. Both trees descend together, a bounded number of pairs at a time."""
    top = max(x.height(), y.height())
    size = lambda t: len(t.levels[min(top, t.height())][1])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def down(i: np.ndarray, j: np.ndarray, level: int) -> None:
        la, lb = min(level, x.height()), min(level, y.height())
        a, b = x.levels[la], y.levels[lb]
        if same:
            ahead = i < j if level == 0 else i <= j
            i, j = i[ahead], j[ahead]
        near = (4 * a[2][i] >= 3 * b[1][j]) & (4 * b[2][j] >= 3 * a[1][i])
        if x.comps is not None and y.comps is not None:
            (a_least, a_most), (b_least, b_most) = x.comps[la], y.comps[lb]
            near &= (np.minimum(a_least[i], b_least[j]) != np.maximum(a_most[i], b_most[j]))
        i, j = i[near], j[near]
        keep = np.zeros(len(i), bool)
        for s in range(0, len(i), 8192):  # bounds the bitmaps held at once
            u, v = i[s : s + 8192], j[s : s + 8192]
            common = np.bitwise_count(a[0][u] & b[0][v]).sum(1, dtype=np.int64)
            keep[s : s + 8192] = _possible(common, np.minimum(a[3][u], b[3][v]), a[1][u], b[1][v])
        i, j = i[keep], j[keep]
        if level == 0:
            differ = [np.bitwise_count(x.parity[i[s : s + 8192]] ^ y.parity[j[s : s + 8192]]).sum(1, dtype=np.int64) for s in range(0, len(i), 8192)]
            near = 7 * np.concatenate([*differ, np.zeros(0, np.int64)]) <= a[1][i] + b[1][j]
            left.append(i[near])
            right.append(j[near])
            return
        for s in range(0, len(i), NODE_PAIRS):
            down(*_children(i[s : s + NODE_PAIRS], j[s : s + NODE_PAIRS], x, y, level - 1), level - 1)

    down(*(a.ravel() for a in np.meshgrid(np.arange(size(x)), np.arange(size(y)), indexing="ij")), top)
    return np.concatenate(left), np.concatenate(right)


def _children(i: np.ndarray, j: np.ndarray, x: Tree, y: Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children on ``level``; a tree that is lower waits."""

    def below(t: Tree, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if level >= t.height():
            return at[:, None], np.ones((len(at), 1), bool)
        kids = at[:, None] * t.fanout + np.arange(t.fanout)
        return kids, kids < len(t.levels[level][1])

    (a, oka), (b, okb) = below(x, i), below(y, j)
    ok = oka[:, :, None] & okb[:, None, :]
    shape = ok.shape
    return np.broadcast_to(a[:, :, None], shape)[ok], np.broadcast_to(b[:, None, :], shape)[ok]


def _tree_pairs(how: Join):
    """Of a block (or tile): pairs of different components that may link."""

    def run(table: pa.Table) -> pa.Table:
        cls, comp, n = (table.column(c).to_numpy() for c in ("cls", "comp", "n"))
        side = table.column("side").to_numpy()  # 0: compared inside; 1, 2: across
        sig = table.column("sig").to_pylist()
        words = np.array([parity_words(s) for s in sig])
        out_a, out_b = [], []

        def tree(rows: np.ndarray, w: int) -> tuple[Tree, np.ndarray]:
            rows = rows[np.lexsort((n[rows], comp[rows]))]  # near copies side by side
            maps = [unpack(sig[r], w) for r in rows]
            return Tree(np.stack([m[0] for m in maps]), np.stack([m[1] for m in maps]), n[rows], how.fanout, comp[rows]), rows

        def emit(p: np.ndarray, q: np.ndarray) -> None:
            apart = comp[p] != comp[q]
            p, q = cls[p[apart]], cls[q[apart]]
            out_a.append(np.minimum(p, q))
            out_b.append(np.maximum(p, q))

        # Bitmaps of linked sets differ by a factor of two in length at most.
        for w in np.unique(words):
            for v in (w, 2 * w):
                for s, t in ((0, 0),) if not side.any() else ((1, 2),) if v == w else ((1, 2), (2, 1)):
                    one, two = np.flatnonzero((words == w) & (side == s)), np.flatnonzero((words == v) & (side == t))
                    if not len(one) or not len(two):
                        continue
                    x, rx = tree(one, w)
                    alike = v == w and s == t
                    y, ry = (x, rx) if alike else tree(two, w)
                    i, j = dual_traversal(x, y, alike)
                    emit(rx[i], ry[j])
        a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
        b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


# ---- verification and components -----------------------------------------


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sa, na, sb, nb = (batch.column(c).to_pylist() for c in ("sig_a", "n_a", "sig_b", "n_b"))
        ok = pa.array([pair_possible(*x) for x in zip(sa, na, sb, nb, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(ok)


def _own_texts(how: Join, seed: int):
    """Rows whose text is of the class they were looked up for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(seed, how.words)
        for batch in batches:
            ok = [_signed(shingle(t)[1]) == c for c, t in zip(batch.column(0).to_pylist(), each_text(batch.column(1)), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return run


def _verify(how: Join, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sets = Shingler(seed, how.words), {}

        def of(cls: int, text: str) -> np.ndarray:
            if cls not in sets:
                if len(sets) > 256:
                    sets.clear()
                sets[cls] = shingle(text)[0]
            return sets[cls]

        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            ta, tb = (each_text(batch.column(c)) for c in ("t_a", "t_b"))
            ok = []
            for p, q, x, y in zip(a, b, ta, tb, strict=True):
                x, y = of(p, x), of(q, y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= 75 * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, id_col: str, how: Join, seed: int, name: str) -> DataFrame:
    """The pairs (a, b) of classes that link: pruned by signatures, then
    verified on the texts of one document of each class."""
    side = lambda s: classes.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
    may = pairs.join(side("a"), "a").join(side("b"), "b").where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    may = materialize(may.mapInArrow(_prune, "a bigint, b bigint"), f"{name}_pairs")
    asked = may.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = materialize(classes.select("cls", "_id").join(asked, "cls"), f"{name}_wanted")
    rows = docs.select(F.col(id_col).cast("bigint").alias("_did"), whole(text).alias("t"))
    near = small_side(wanted)
    found = rows.join(near, rows["_did"].eqNullSafe(near["_id"])).select("cls", "t")
    texts = materialize(found.mapInArrow(_own_texts(how, seed), "cls bigint, t string").dropDuplicates(["cls"]), f"{name}_texts")
    side = lambda s: texts.select(F.col("cls").alias(s), F.col("t").alias(f"t_{s}"))
    both = may.join(side("a"), "a").join(side("b"), "b")
    return materialize(both.mapInArrow(_verify(how, seed), "a bigint, b bigint"), f"{name}_links")


def components(edges: DataFrame) -> DataFrame:
    """``cls``, ``comp`` (smallest class reachable) of the classes with edges,
    by alternating large and small star contraction until nothing changes."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = materialize(now, "edges")
    last = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last or not state[0]:
            return now.select(F.col("u").alias("cls"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("cls"), F.col("v").alias("comp"))).distinct()
        last = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), "edges")


INTEGERS = ("tinyint", "smallint", "int", "bigint")


def numbered(docs: DataFrame, id_col: str) -> DataFrame | None:
    """Written ``_name``, ``_no``: the distinct ids in order as longs, which keep
    their order; None if the ids are integers already."""
    if dict(docs.dtypes)[id_col] in INTEGERS:
        return None
    names = docs.select(F.col(id_col).alias("_name"), F.lit(0).alias("_all")).where("_name IS NOT NULL").distinct()
    return materialize(value_positions(names, ["_all"], "_name").select("_name", F.col("_below").alias("_no")), "id_numbers")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", how: Join = Join()) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` (the
    smallest id reachable by links, its own included), ``component_size``.
    Ids may be of any type that has an order."""
    names = numbered(docs, id_col)
    if names is None:
        return _components_of(docs, text, id_col, how)[0].drop("_cls")
    rows = docs.select(F.col(id_col).alias("_name"), F.col(text).alias("_text"))
    rows = materialize(rows.join(small_side(names), "_name", "left").select(F.col("_no").alias("_id"), "_text"), "numbered_docs")
    found = _components_of(rows, "_text", "_id", how)[0]
    of = lambda no, name: small_side(names).select(F.col("_no").alias(no), F.col("_name").alias(name))
    out = found.join(of("_id", id_col), "_id", "left").join(of("component_id", "_component"), "component_id", "left")
    return out.select(id_col, "n_shingles", F.col("_component").alias("component_id"), "component_size")


def _components_of(docs: DataFrame, text: str, id_col: str, how: Join) -> tuple[DataFrame, int]:
    """``near_duplicates`` of integer ids with ``_cls``, the class of the row's
    words (null without words), and the seed of the classes."""
    described, seed = describe(docs, text, id_col, how)
    rows = described.where("piece IS NULL")
    classes = materialize(rows.where("n > 0").groupBy("cls").agg(F.min("_id").alias("_id"), F.max("n").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("docs")), "classes")
    total = classes.agg(F.sum(F.expr("n - ceil(0.75 * n) + 1"))).first()[0] or 0
    groups = max(1, math.ceil(int(total) / how.group_rows))
    levels = frequent_cells(described, how)

    packed = docs.select(whole(text).alias("t")).mapInArrow(_prefixes(how, seed, levels, groups), "g bigint, keys binary, classes binary, salts binary")
    made = packed.groupBy("g").applyInArrow(_blocks, "a bigint, b bigint, block bigint, members array<bigint>")
    made = materialize(made, "blocks")
    heads = made.where("block IS NOT NULL AND a IS NOT NULL").select("block", "a")
    lead = heads.groupBy("block").agg(F.min("a").alias("m"))
    across = heads.join(lead, "block").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    stars = made.where("b IS NOT NULL").select("a", "b").unionByName(across).distinct()
    first = links(stars, classes, docs, text, id_col, how, seed, "star")
    comps = materialize(components(first), "star_components")

    # Blocks that hold several components go on to the trees, all those with
    # the same prevailing component as one, so that their pairs come once.
    members = made.where("members IS NOT NULL").select("block", F.explode("members").alias("cls")).distinct()
    members = materialize(members.join(comps, "cls", "left").select("block", "cls", F.coalesce("comp", "cls").alias("comp")), "block_members")
    shares = members.groupBy("block", "comp").agg(F.count(F.lit(1)).alias("m"))
    several = shares.groupBy("block").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("m", "comp"))["comp"].alias("main")).where("k > 1")
    held = materialize(members.join(several.select("block", "main"), "block").select(F.col("main").alias("block"), "cls", "comp").distinct(), "tree_members")
    sizes = held.groupBy("block").agg(F.count(F.lit(1)).alias("g"))
    held = held.join(sizes, "block").join(classes.select("cls", "n", "sig"), "cls")
    tiles = F.ceil(F.col("g") / how.tile).cast("int")
    own = F.pmod(F.xxhash64("cls"), tiles).cast("int")
    tiled = held.withColumn("_o", own).withColumn("_k", F.explode(F.sequence(F.lit(0), tiles - 1)))
    tiled = tiled.select(
        "block",
        F.least("_o", "_k").alias("i"),
        F.greatest("_o", "_k").alias("j"),
        F.when(F.col("_o") == F.col("_k"), 0).when(F.col("_o") < F.col("_k"), 1).otherwise(2).alias("side"),
        "cls",
        "comp",
        "n",
        "sig",
    )
    more = tiled.groupBy("block", "i", "j").applyInArrow(_tree_pairs(how), "a bigint, b bigint").distinct()
    more = more.join(stars, ["a", "b"], "left_anti")
    second = links(more, classes, docs, text, id_col, how, seed, "tree")
    comps = components(first.unionByName(second)) if not second.isEmpty() else comps

    named = classes.select("cls", "_id", "docs").join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    names = named.groupBy("comp").agg(F.min("_id").alias("component_id"), F.sum("docs").alias("component_size"))
    names = named.select("cls", "comp").join(names, "comp").select("cls", "component_id", "component_size")
    size = F.lit(1).cast("bigint").alias("component_size")
    linked = rows.where("n > 0").join(names, "cls").select("_id", "n", "component_id", "component_size", "cls")
    alone = rows.where("n = 0").select("_id", "n", F.col("_id").alias("component_id"), size, F.lit(None).cast("bigint").alias("cls"))
    out = linked.unionByName(alone)
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "component_size", F.col("cls").alias("_cls")), seed


def drop_near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", how: Join = Join()) -> DataFrame:
    """The rows of ``docs`` that name their component, all columns unchanged; rows
    without an id or without words stay. Rows that share an id are told apart by
    the class of their words: those whose component has a smaller id go, and of
    those that name their component one row stays."""
    names = numbered(docs, id_col)
    no = F.col(id_col).cast("bigint") if names is None else F.col("_no")
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col), F.col(text).alias("_t"))
    if names is not None:
        plain = plain.join(small_side(names), plain[id_col] == names["_name"], "left")
    rows = plain.select("_row", no.alias("_id"), "_t")
    found, seed = _components_of(rows, "_t", "_id", how)
    found = materialize(found.where("_id IS NOT NULL").select("_id", "component_id", "_cls"), "near_duplicate_rows")
    several = materialize(found.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id"), "repeated_ids")
    gone = materialize(found.where("_id <> component_id").select(F.col("_id").alias("_gone")).distinct(), "near_duplicate_ids")
    out = rows.join(small_side(gone, 1_000_000), F.col("_id") == F.col("_gone"), "left_anti").select("_row")
    if several.isEmpty():
        return out.select("_row.*")
    several = small_side(several)
    out = rows.join(small_side(gone, 1_000_000), F.col("_id") == F.col("_gone"), "left_anti").join(several, "_id", "left_anti").select("_row")
    again = materialize(rows.join(several, "_id", "left_semi").withColumn("_k", F.monotonically_increasing_id()), "repeated_id_rows")
    classes = again.select(F.col("_k").alias("_id"), whole(F.col("_t")).alias("t")).mapInArrow(
        _describe(how, seed), "_id bigint, cls bigint, chk bigint, n bigint, sig binary, piece int, cells binary"
    )
    classed = classes.where("piece IS NULL").select(F.col("_id").alias("_k"), F.when(F.col("n") > 0, F.col("cls")).alias("_cls"))
    named = materialize(again.select("_k", "_id").join(classed, "_k").join(found.distinct(), ["_id", "_cls"], "left"), "repeated_id_classes")
    first = named.where("_id = component_id").groupBy("component_id").agg(F.min("_k").alias("_k"))
    stay = first.select("_k").unionByName(named.where("_cls IS NULL").select("_k"))
    return out.unionByName(again.join(small_side(materialize(stay, "repeated_id_stay")), "_k", "left_semi").select("_row")).select("_row.*")
