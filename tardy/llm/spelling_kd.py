"""Spelling variant grouping: k-d trees over the letter-count vectors of words.

One inserted, deleted or replaced letter changes the letter counts by an L1
distance of one or two: a replacement takes one letter up and one down, an
insertion one up. A k-d tree of each word length's count vectors therefore finds
all near words by range searches, one per pair of equal or adjacent lengths: a
box of the tree is entered only where at most one letter must go up and (equal
lengths) at most one down. What a search reaches is compared letter by letter, as
anagrams share a vector.

Counts are held in unary (bit ``t`` of a letter is set where the word holds it
more than ``t`` times), so that distances and distances to boxes are popcounts
(a box is the AND and the OR of its vectors) and a split of the tree, "count of
this letter over t", is one bit. Counts over the bits of a letter only loosen
the pruning; the comparison of letters decides.

On Spark: words are counted by a map-side combined aggregate. The upper levels of
a length's tree are fitted to a bounded sample of words (``SAMPLE``; it shapes the
cells, not the result) until a cell holds about ``POINTS`` words. Every word goes
to its own cell as a point, and as a query to each cell it can reach; a task holds
one cell, builds the rest of the tree and searches it. Cells of too many points or
queries (a poor sample, anagrams) are dealt over a grid of slices, so that
no task is larger than ``POINTS`` by ``QUERIES`` or ``BYTES`` of letters each.
Links leave a task as one row per word: its number of near words and the best.

Defined results: a null text has no words; a null ``doc_id`` counts as an empty
number in the hash; repeated rows count each time; of near words of equal count the
first in code-point order is the form; an empty table gives no rows. Words of any
length are searched; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .common import lower_ascii, small_side, whole

#: Words whose vectors shape the upper levels of the trees.
SAMPLE = 20_000
#: Longer words share one cell per length (which is sliced like any other).
SAMPLED_LENGTH = 64
#: Points and queries of one task, and bytes of either's letters.
POINTS, QUERIES, BYTES = 16_384, 131_072, 1 << 24
#: Points of a leaf, queries searched at once, pairs compared at once.
LEAF, CHUNK, PAIRS = 16, 4096, 1 << 19
#: Unary bits of a letter: four of a-z, one of each of U+00C0 to U+00FF.
WORDS = 3
_BASE = np.full(256, -1, dtype=np.int64)
_BASE[97:123] = np.arange(26) * 4
_BASE[192:256] = 104 + np.arange(64)
_BITS = np.zeros(256, dtype=np.int64)
_BITS[97:123] = 4
_BITS[192:256] = 1


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", damage: int = 31, least_length: int = 7, least_n: int = 2) -> DataFrame:
    """``word``, ``n``: maximal runs of Latin letters, A-Z lower-cased; where
    ``damage`` divides the crc32 of ``<doc_id>:<run>``, one letter is left out."""
    runs = F.regexp_extract_all(lower_ascii(whole(text)), F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    number = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    each = docs.select(number.alias("_i"), F.explode(runs).alias("_w"))
    hashed = each.select("_w", F.crc32(F.encode(F.concat("_i", F.lit(":"), "_w"), "UTF-8")).alias("_h"))
    at = (F.col("_h") % F.length("_w")).cast("int")
    shorter = F.concat(F.substring("_w", F.lit(1), at), F.substring("_w", at + 2, F.length("_w")))
    made = hashed.select(F.when(F.col("_h") % damage == 0, shorter).otherwise(F.col("_w")).alias("word"))
    counted = made.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_n)


def letters(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of Latin-1 bytes."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), length)


def signatures(rows: np.ndarray) -> np.ndarray:
    """The unary letter counts, ``WORDS`` by n."""
    ordered = np.sort(rows, axis=1)
    n, length = ordered.shape
    out = np.zeros((WORDS, n), dtype=np.uint64)
    nth = np.zeros(n, dtype=np.int64)
    index = np.arange(n)
    for i in range(length):
        letter = ordered[:, i]
        nth = np.where(letter == ordered[:, i - 1], nth + 1, 0) if i else nth
        ok = nth < _BITS[letter]
        bit = (_BASE[letter] + nth)[ok]
        out[bit >> 6, index[ok]] |= np.uint64(1) << (bit & 63).astype(np.uint64)
    return out


def _bits(sig: np.ndarray) -> np.ndarray:
    """n by 192 zeros and ones."""
    return np.unpackbits(np.ascontiguousarray(sig.T).view(np.uint8), axis=1, bitorder="little")


def _split(bits: np.ndarray) -> int | None:
    """The bit that halves the rows best; None if all rows are alike."""
    ones = bits.sum(axis=0, dtype=np.int64)
    best = int(np.abs(2 * ones - len(bits)).argmin())
    return best if 0 < ones[best] < len(bits) else None


def plan_cells(sig: np.ndarray, cells: int) -> list[tuple[int, int, int]]:
    """The upper levels of a tree as rows (bit, child without it, child with it);
    a leaf is (-1, its cell number, 0). The fullest leaf is split first."""
    bits = _bits(sig)
    nodes: list[tuple[int, int, int]] = [(-1, 0, 0)]
    members, stuck = {0: np.arange(len(bits))}, set()
    while len(members) < cells:
        open_ = [(len(m), at) for at, m in members.items() if at not in stuck and len(m) > 1]
        if not open_:
            break
        _, at = max(open_)
        rows = members[at]
        bit = _split(bits[rows])
        if bit is None:
            stuck.add(at)
            continue
        has = bits[rows, bit] == 1
        nodes[at] = (bit, len(nodes), len(nodes) + 1)
        del members[at]
        for part in (rows[~has], rows[has]):
            members[len(nodes)] = part
            nodes.append((-1, 0, 0))
    for cell, at in enumerate(sorted(members)):
        nodes[at] = (-1, cell, 0)
    return nodes


def reach(nodes: list[tuple[int, int, int]], sig: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of all cells that a vector can reach by taking ``up`` letters up
    and ``down`` letters down."""
    found = []
    n = sig.shape[1]
    todo = [(0, np.arange(n), np.full(n, up), np.full(n, down))]
    while todo:
        at, rows, u, d = todo.pop()
        bit, without, with_ = nodes[at]
        if bit < 0:
            found.append((rows, np.full(len(rows), without)))
            continue
        has = (sig[bit >> 6, rows] >> np.uint64(bit & 63)) & np.uint64(1) == 1
        for child, cross, left in ((without, has, d), (with_, ~has, u)):
            ok = ~cross | (left > 0)
            spent = cross[ok].astype(int)
            is_down = child == without
            todo.append((child, rows[ok], u[ok] - (0 if is_down else spent), d[ok] - (spent if is_down else 0)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


POINT, SAME, LOWER, SHORTER = 0, 1, 2, 3
ROUTED = "length int, cell int, role int, word string, n bigint"


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    size = np.array([len(w) for w in words])
    for length in np.unique(size):
        yield int(length), np.flatnonzero(size == length)


def _router(trees: dict[int, list[tuple[int, int, int]]]):
    """Deals words to cells: as a point and a query of equal length to their own
    (POINT, SAME), as a query to the later cells in reach (LOWER), and to those
    of the next length (SHORTER)."""
    one = [(-1, 0, 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for length, rows in _by_length(words):
                own_tree, next_tree = trees.get(length, one), trees.get(length + 1, one)
                if len(own_tree) == len(next_tree) == 1:
                    own = np.zeros(len(rows), dtype=np.int64)
                    near = (np.arange(len(rows)), own)
                    longer = near
                else:
                    sig = signatures(letters([words[i] for i in rows], length))
                    at, cell = reach(own_tree, sig, 0, 0)
                    own = np.empty(len(rows), dtype=np.int64)
                    own[at] = cell
                    near, longer = reach(own_tree, sig, 1, 1), reach(next_tree, sig, 1, 0)
                later = near[1] > own[near[0]]
                every = np.arange(len(rows))
                parts = [
                    (length, every, own, POINT), (length, every, own, SAME),
                    (length, near[0][later], near[1][later], LOWER), (length + 1, longer[0], longer[1], SHORTER),
                ]
                of = rows[np.concatenate([p[1] for p in parts])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.full(len(p[1]), p[0], dtype=np.int32) for p in parts])),
                        pa.array(np.concatenate([p[2] for p in parts]).astype(np.int32)),
                        pa.array(np.concatenate([np.full(len(p[1]), p[3], dtype=np.int32) for p in parts])),
                        batch.column("word").take(pa.array(of)),
                        pa.array(n[of]),
                    ],
                    names=["length", "cell", "role", "word", "n"],
                )

    return run


class Tree:
    """A k-d tree over signatures: nodes with their boxes, points in leaf order."""

    def __init__(self, sig: np.ndarray):
        bits = _bits(sig)
        order, nodes, todo = [], [], [(np.arange(sig.shape[1]), -1, 0)]
        filled = 0
        while todo:
            rows, parent, side = todo.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][side] = at
            box = [np.bitwise_and.reduce(sig[:, rows], axis=1), np.bitwise_or.reduce(sig[:, rows], axis=1)]
            bit = _split(bits[rows]) if len(rows) > LEAF else None
            if bit is None:
                nodes.append([-1, -1, filled, filled + len(rows), *box])
                order.append(rows)
                filled += len(rows)
            else:
                nodes.append([-1, -1, 0, 0, *box])
                has = bits[rows, bit] == 1
                todo += [(rows[~has], at, 0), (rows[has], at, 1)]
        self.order = np.concatenate(order)
        self.children = np.array([n[:2] for n in nodes])
        self.span = np.array([n[2:4] for n in nodes])
        self.low = np.array([n[4] for n in nodes]).T
        self.high = np.array([n[5] for n in nodes]).T
        self.sig = sig[:, self.order]

    def search(self, sig: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, point) whose vectors are at most ``up`` letters up and
        ``down`` letters down apart, as far as the unary bits tell."""
        for first in range(0, sig.shape[1], CHUNK):
            q = sig[:, first : first + CHUNK]
            who, at = np.arange(q.shape[1]), np.zeros(q.shape[1], dtype=np.int64)
            leaves = []
            while len(who):
                ok = (_missing(self.low, at, q, who) <= up) & (_missing(q, who, self.high, at) <= down)
                who, at = who[ok], at[ok]
                leaf = self.children[at, 0] < 0
                leaves.append((who[leaf], at[leaf]))
                inner_who, inner = who[~leaf], at[~leaf]
                who = np.concatenate([inner_who, inner_who])
                at = np.concatenate([self.children[inner, 0], self.children[inner, 1]])
            who, at = np.concatenate([x[0] for x in leaves]), np.concatenate([x[1] for x in leaves])
            for a, b in _expand(who, self.span[at]):
                ok = (_missing(self.sig, b, q, a) <= up) & (_missing(q, a, self.sig, b) <= down)
                yield a[ok] + first, self.order[b[ok]]


def _missing(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many bits of ``a[:, i]`` are not in ``b[:, j]``."""
    return sum(np.bitwise_count(a[w][i] & ~b[w][j]) for w in range(WORDS))


def _expand(who: np.ndarray, span: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each query with each point of its leaf, ``PAIRS`` at once at most."""
    size = span[:, 1] - span[:, 0]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    for first in range(0, total, PAIRS):
        pair = np.arange(first, min(first + PAIRS, total))
        of = np.searchsorted(ends, pair, side="right")
        yield who[of], span[of, 0] + pair - (ends[of] - size[of])


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of equal length that differ in exactly one letter."""
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows where dropping one letter of ``long`` gives ``short``."""
    length = short.shape[1]
    head, tail = short == long[:, :length], (short == long[:, 1:])[:, ::-1]
    first = np.where(head.all(axis=1), length, head.argmin(axis=1))
    last = np.where(tail.all(axis=1), length, tail.argmin(axis=1))
    return first + last >= length


class _Best:
    """Per word of a task: number of near words and the best of them."""

    def __init__(self, n: np.ndarray, rank: np.ndarray):
        self.n, self.rank = n, rank
        self.near = np.zeros(len(n), dtype=np.int64)
        self.top = np.zeros(len(n), dtype=np.int64)
        self.first = np.full(len(n), len(n), dtype=np.int64)

    def offer(self, word: np.ndarray, other: np.ndarray) -> None:
        self.near += np.bincount(word, minlength=len(self.n))
        was = self.top.copy()
        np.maximum.at(self.top, word, self.n[other])
        self.first[self.top > was] = len(self.n)
        best = self.n[other] == self.top[word]
        np.minimum.at(self.first, word[best], self.rank[other[best]])


FOUND = "word string, near bigint, best_n bigint, best string"


def _search_cell(table: pa.Table) -> pa.Table:
    """All links between the points and the queries of one task."""
    role, n = table.column("role").to_numpy(), table.column("n").to_numpy()
    words = table.column("word").to_pylist()
    length = int(table.column("length")[0].as_py())
    by_word = np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)
    rank = np.empty(len(words), dtype=np.int64)
    rank[by_word] = np.arange(len(words))
    best = _Best(n, rank)
    points = np.flatnonzero(role == POINT)
    if len(points) and len(points) < len(words):
        rows = letters([words[i] for i in points], length)
        tree = Tree(signatures(rows))
        for kind, down in ((SAME, 1), (LOWER, 1), (SHORTER, 0)):
            asked = np.flatnonzero(role == kind)
            if not len(asked):
                continue
            asked_rows = letters([words[i] for i in asked], length - (kind == SHORTER))
            near = one_inserted if kind == SHORTER else one_replaced
            for a, b in tree.search(signatures(asked_rows), 1, down):
                ok = near(asked_rows[a], rows[b])
                q, p = asked[a[ok]], points[b[ok]]
                best.offer(q, p)
                if kind != SAME:  # a cell's own words meet in both orders
                    best.offer(p, q)
    hit = np.flatnonzero(best.near)
    chosen = pa.array(by_word[best.first[hit]])
    return pa.table({
        "word": table.column("word").take(pa.array(hit)), "near": pa.array(best.near[hit]),
        "best_n": pa.array(best.top[hit]), "best": table.column("word").take(chosen),
    })


def fit_trees(words: DataFrame, points: int = POINTS, sample: int = SAMPLE) -> dict[int, list[tuple[int, int, int]]]:
    """The upper levels of the tree of each length that needs more than a cell."""
    usual = words.where(F.length("word") <= SAMPLED_LENGTH)
    sizes = usual.groupBy(F.length("word").alias("l")).count().collect()  # a row a length
    many = {r["l"]: math.ceil(r["count"] / points) for r in sizes if r["count"] > points}
    if not many:
        return {}
    picked = usual.where(F.length("word").isin(list(many))).orderBy(F.xxhash64("word"), "word").limit(sample)
    taken = [r["word"] for r in picked.select("word").collect()]
    trees = {}
    for length, rows in _by_length(taken):
        trees[length] = plan_cells(signatures(letters([taken[i] for i in rows], length)), many[length])
    return trees


def near_words(words: DataFrame, points: int = POINTS, queries: int = QUERIES, sample: int = SAMPLE) -> DataFrame:
    """``word``, ``n_near``, ``best_n``, ``best`` of each word of a written table
    (``word``, ``n``) that has a near word."""
    routed = materialize(words.mapInArrow(_router(fit_trees(words, points, sample)), ROUTED), "spelling_routed")
    keys = ["length", "cell"]
    is_point = F.col("role") == POINT
    sizes = routed.groupBy(*keys).agg(F.count_if(is_point).alias("p"), F.count_if(~is_point).alias("q"))

    def slices(count: str, most: int) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.col(count) / most), F.ceil(F.col(count) * F.col("length") / BYTES)).cast("int")

    wanted = sizes.where((F.col("p") > 0) & (F.col("q") > 0)).select(*keys, slices("p", points * 2).alias("p"), slices("q", queries).alias("q"))
    large = materialize(wanted.where((F.col("p") > 1) | (F.col("q") > 1)), "spelling_large")
    dealt = routed.join(small_side(large), keys, "left").withColumn("p", F.coalesce("p", F.lit(1))).withColumn("q", F.coalesce("q", F.lit(1)))
    mine = lambda of, seed: F.pmod(F.xxhash64("word", F.lit(seed)), F.col(of)).cast("int")
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    tiles = dealt.select(
        *keys, "role", "word", "n",
        F.when(is_point, F.array(mine("p", 1))).otherwise(every("p")).alias("ps"),
        F.when(is_point, every("q")).otherwise(F.array(mine("q", 2))).alias("qs"),
    )
    tiles = tiles.select(*keys, "role", "word", "n", F.explode("ps").alias("p"), "qs").select(*keys, "role", "word", "n", "p", F.explode("qs").alias("q"))
    found = tiles.groupBy(*keys, "p", "q").applyInArrow(_search_cell, FOUND)
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    merged = found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("_f"))
    return merged.select("word", "n_near", (-F.col("_f.n")).alias("best_n"), F.col("_f.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` from a written table ``word``, ``form``: each round
    doubles the steps taken. A form has ten times its word's count, so that a chain
    of longs has under 32 steps: five rounds at most."""
    jumps = forms.select("word", F.col("form").alias("root"))
    for _ in range(5):
        next_ = jumps.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        jumps = materialize(
            jumps.join(next_, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("on")),
            "spelling_roots",
        )
        if jumps.where("on").isEmpty():
            break
        jumps = jumps.drop("on")
    return jumps.select("word", "root")


def variant_forms(docs: DataFrame, times: int = 10, points: int = POINTS, queries: int = QUERIES, **of_words) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word."""
    words = materialize(word_counts(docs, **of_words), "spelling_words")
    near = near_words(words, points, queries)
    better = F.col("best_n") >= F.col("n") * times
    judged = materialize(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n"),
        ),
        "spelling_judged",
    )
    ends = roots(judged.where(F.col("form").isNotNull()).select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
