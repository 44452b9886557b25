"""LM scoring by subword lattice likelihood.

An existing vocabulary of pieces spans a lattice over each word: every
segmentation of the word into pieces (the first with a marker before the word)
or bytes is a path, weighted by the pieces' unigram probabilities and a stop
symbol. A word known from training has one arc more, over the whole word. A
forward recursion in log space sums over all paths; a document's probability is
the product over its words and one end symbol. Every character has a byte path,
so no text has probability 0, and since paths that differ in a word spell
different texts, the probabilities of all texts sum to 1 at most.

The pieces are taken as they are. Their weights start from the file's scores
and are fitted to the distinct training words by expectation-maximisation over
the same lattices (forward and backward sums); each round runs over all
training words. A whole-word arc has the word's relative frequency less a
discount (estimated from the words seen once and twice); the discounts' mass is
what the pieces share out. So a frequent word counts as frequent, and an unseen
one is judged by its parts.

Defined results: null text counts as empty and holds the end symbol alone.
A-Z is lower-cased, other characters are untouched. A null id counts as
training. Repeated rows count and are scored one by one. An empty table gives
an empty result. Columns other than id and text are not read.

Scale: words are counted in each task before the shuffle. Lattices are computed
once per distinct word, not per occurrence. To look words up without
broadcasting the (unbounded) word table and without a row per occurrence,
documents are dealt into blocks of about ``block_tokens`` tokens; each block
asks for its distinct words once and gets counts and probabilities back. What
reaches the driver is bounded by the piece vocabulary.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .common import each_text, whole

MARK = 0x2581  # begins a word's pieces
FOREIGN = "\U0010ffff"  # stands for the marker inside a word; in no piece


@dataclass(frozen=True)
class Training:
    #: Each over all distinct training words.
    rounds: int = 5
    #: Added to each expected count, so that no piece or byte has probability 0.
    piece_floor: float = 0.01
    byte_floor: float = 1.0
    block_tokens: int = 3_000_000
    batch_words: int = 20_000


class Vocabulary:
    """Pieces with a hash table of their prefixes; ids: pieces, then 256 bytes,
    then the stop symbol."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    SPREAD = np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, pieces: list[str]):
        usable = [p for p in dict.fromkeys(pieces) if p and chr(MARK) not in p[1:] and FOREIGN not in p]
        self.pieces = usable
        self.first_byte = len(usable)
        self.stop = len(usable) + 256
        # A word's first arc is drawn from marked pieces, later ones and the
        # stop symbol from all others: two distributions.
        self.marked = np.array([p[0] == chr(MARK) for p in usable] + [False] * 257)
        self.longest = max(map(len, usable), default=0)
        known: dict[int, int] = {}
        for i, p in enumerate(usable):
            h = 0
            for k, c in enumerate(p):
                h = (h * int(self.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                known[h] = i if k == len(p) - 1 else known.get(h, -1)
        self.bits = max(10, (4 * len(known)).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.values = np.full(1 << self.bits, -2, dtype=np.int32)
        for h, i in known.items():
            at = self._slot(np.array([h], dtype=np.uint64))[0]
            while self.values[at] != -2:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.values[at] = h, i

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * self.SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id, -1 for a mere prefix of a piece, -2 for neither."""
        at = self._slot(h)
        out = self.values[at]
        wrong = np.flatnonzero((self.keys[at] != h) & (out != -2))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.values[at[wrong]]
            wrong = wrong[(self.keys[at[wrong]] != h[wrong]) & (out[wrong] != -2)]
        return out


def read_pieces(model_file: str) -> tuple[list[str], list[float]]:
    """Normal pieces of a SentencePiece file in order, with a starting weight
    from their scores: the score itself where it is a log-probability, or the
    inverse of the rank where it counts merges."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    scores = [sp.get_score(i) for i in ids]
    ranked = all(s == round(s) for s in scores)
    return [sp.id_to_piece(i) for i in ids], [1 / (10 + k) if ranked else math.exp(max(s, -50.0)) for k, s in enumerate(scores)]


class Lattice:
    """Lattices of a batch of words (str, not empty). Nodes lie between
    characters, a marker being the first character of each word."""

    def __init__(self, vocab: Vocabulary, words: list[str]):
        self.vocab, self.n_words = vocab, len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        text = chr(MARK) + chr(MARK).join(w.replace(chr(MARK), FOREIGN) for w in words)
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        room = np.repeat(first + sizes, sizes)
        # Pieces: from each place, one character more as long as there is a
        # piece that begins so.
        at = np.arange(len(chars))
        h = np.zeros(len(chars), dtype=np.uint64)
        begin, size, piece = [], [], []
        for k in range(1, vocab.longest + 1):
            inside = at + (k - 1) < room[at]
            at, h = at[inside], h[inside]
            if not len(at):
                break
            h = h * Vocabulary.BASE + (chars[at + (k - 1)].astype(np.uint64) + np.uint64(1))
            found = vocab.find(h)
            hit = found >= 0
            begin.append(at[hit])
            size.append(np.full(int(hit.sum()), k))
            piece.append(found[hit])
            going = found != -2
            at, h = at[going], h[going]
        self.arc_begin = np.concatenate(begin)
        self.arc_end = self.arc_begin + np.concatenate(size)
        self.arc_piece = np.concatenate(piece).astype(np.int64)
        # Bytes: one arc for each character but the markers.
        octets = np.frombuffer("".join(words).encode("utf-8"), np.uint8)
        starts = np.flatnonzero((octets & 0xC0) != 0x80)
        plain = np.ones(len(chars), dtype=bool)
        plain[first] = False
        self.octets, self.octet_starts = octets.astype(np.int64), starts
        self.char_begin = np.flatnonzero(plain)
        # A node's number: place + word, so that ends and beginnings differ.
        shift = word
        self.b = np.concatenate([self.arc_begin + shift[self.arc_begin], self.char_begin + shift[self.char_begin]])
        self.e = np.concatenate([self.arc_end + shift[self.arc_begin], self.char_begin + 1 + shift[self.char_begin]])
        self.word_of_arc = np.concatenate([word[self.arc_begin], word[self.char_begin]])
        self.first_node = first + np.arange(len(words))
        self.last_node = self.first_node + sizes
        self.n_nodes = int(self.last_node[-1]) + 1
        depth_b = self.b - self.first_node[self.word_of_arc]
        depth_e = self.e - self.first_node[self.word_of_arc]
        self.by_end = _levels(depth_e, self.e)
        self._depth_b = depth_b

    @cached_property
    def by_begin(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return _levels(self._depth_b, self.b)

    def weights(self, logp: np.ndarray) -> np.ndarray:
        """Of the arcs: pieces, then characters as products of bytes."""
        per_octet = logp[self.vocab.first_byte + self.octets]
        return np.concatenate([logp[self.arc_piece], np.add.reduceat(per_octet, self.octet_starts) if len(per_octet) else per_octet])

    def forward(self, w: np.ndarray) -> np.ndarray:
        alpha = np.full(self.n_nodes, -np.inf)
        alpha[self.first_node] = 0.0
        for arcs, starts, nodes in self.by_end:
            alpha[nodes] = _logsum(alpha[self.b[arcs]] + w[arcs], starts)
        return alpha

    def backward(self, w: np.ndarray) -> np.ndarray:
        beta = np.full(self.n_nodes, -np.inf)
        beta[self.last_node] = 0.0
        for arcs, starts, nodes in reversed(self.by_begin):
            beta[nodes] = _logsum(beta[self.e[arcs]] + w[arcs], starts)
        return beta

    def log_prob(self, logp: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's marginal probability."""
        return self.forward(self.weights(logp))[self.last_node] + logp[self.vocab.stop]

    def expected(self, logp: np.ndarray) -> np.ndarray:
        """Expected number of each piece, byte and stop symbol."""
        w = self.weights(logp)
        alpha, beta = self.forward(w), self.backward(w)
        total = alpha[self.last_node]
        share = np.exp(alpha[self.b] + w + beta[self.e] - total[self.word_of_arc])
        n = len(self.arc_piece)
        out = np.bincount(self.arc_piece, share[:n], len(logp))
        out[self.vocab.stop] = self.n_words
        spans = np.diff(np.append(self.octet_starts, len(self.octets)))
        return out + np.bincount(self.vocab.first_byte + self.octets, np.repeat(share[n:], spans), len(logp))


def _levels(depth: np.ndarray, node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arcs by depth, and inside a depth by node: (arcs, starts of the nodes'
    stretches, nodes)."""
    if len(depth) and depth.max() < 1 << 16:
        depth = depth.astype(np.uint16)  # sorted by radix
    order = np.lexsort((node, depth))
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    out = []
    for arcs in np.split(order, cuts):
        own = node[arcs]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        out.append((arcs, starts, own[starts]))
    return out


def _logsum(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(x, starts)
    top = np.where(np.isfinite(top), top, 0.0)
    sizes = np.diff(np.append(starts, len(x)))
    with np.errstate(divide="ignore"):
        return top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, sizes)), starts))


def _word_batches(words: pa.Array, limit: int) -> Iterator[np.ndarray]:
    """Row numbers in batches of similar length (of bounded characters)."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    order = np.argsort(sizes, kind="stable")
    room, start = 16 * limit, 0
    while start < len(order):
        fits = int(np.searchsorted(np.cumsum(sizes[order[start : start + limit]] + 1), room, side="right"))
        stop = start + max(fits, 1)
        yield order[start:stop]
        start = stop


def count_words(docs: DataFrame, text: str, training: Column, limit: int = 400_000) -> DataFrame:
    """``word``, ``n_train``, ``n_all``: counts of lower-cased words, gathered in
    each task (in bounded portions) before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter = Counter()
        rest: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = list(train.keys() | rest.keys())
            a = [train.get(w, 0) for w in words]
            b = [x + rest.get(w, 0) for x, w in zip(a, words, strict=True)]
            train.clear()
            rest.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["word", "n_train", "n_all"])

        for batch in batches:
            for t, own in zip(each_text(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                (train if own else rest).update(t.encode().lower().split())  # bytes: ASCII only
                if len(train) + len(rest) > limit:
                    yield flush()
        if train or rest:
            yield flush()

    rows = docs.select(whole(text).alias("t"), training.alias("own"))
    counted = rows.mapInArrow(run, "word string, n_train bigint, n_all bigint")
    return counted.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def _normalise(expected: np.ndarray, vocab: Vocabulary, how: Training) -> np.ndarray:
    floor = np.full(len(expected), how.piece_floor)
    floor[vocab.first_byte :] = how.byte_floor
    p = expected + floor
    return np.log(np.where(vocab.marked, p / max(p[vocab.marked].sum(), 1e-300), p / p[~vocab.marked].sum()))


def expected_counts(words: DataFrame, vocab: Vocabulary, logp: np.ndarray, how: Training) -> np.ndarray:
    """One E-step over the distinct words of ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(logp))
        for batch in batches:
            names = batch.column(0)
            for rows in _word_batches(names, how.batch_words):
                total += Lattice(vocab, names.take(pa.array(rows)).to_pylist()).expected(logp)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["piece", "n"])

    got = words.select("word").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(logp))
    for r in got:  # at most one row per piece of the vocabulary
        out[r["piece"]] = r["n"]
    return out


def fit_scores(words: DataFrame, vocab: Vocabulary, start: list[float], how: Training = Training()) -> np.ndarray:
    """Natural log-probabilities of pieces, bytes and the stop symbol, fitted
    to the rows of ``words`` (distinct training words)."""
    n_words = words.count()
    first = np.zeros(vocab.stop + 1)
    weight = dict(zip(vocab.pieces, start, strict=True))
    first[: vocab.first_byte] = [weight[p] for p in vocab.pieces]
    first *= 3 * max(n_words, 1) / max(first.sum(), 1e-9)
    first[vocab.stop] = n_words
    logp = _normalise(first, vocab, how)
    if not n_words:
        return logp
    for _ in range(how.rounds):
        logp = _normalise(expected_counts(words, vocab, logp, how), vocab, how)
    return logp


def word_scores(words: DataFrame, vocab: Vocabulary, logp: np.ndarray, how: Training = Training()) -> DataFrame:
    """``word``, ``n_train``, ``logp``: natural logarithm of the probability
    of spelling the word by pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, out = batch.column(0), np.zeros(batch.num_rows)
            for rows in _word_batches(names, how.batch_words):
                out[rows] = Lattice(vocab, names.take(pa.array(rows)).to_pylist()).log_prob(logp)
            yield pa.RecordBatch.from_arrays([names, batch.column(1), pa.array(out)], names=["word", "n_train", "logp"])

    return words.select("word", "n_train").mapInArrow(run, "word string, n_train bigint, logp double")


def score_documents(
    docs: DataFrame,
    training: Column,
    pieces: list[str],
    start: list[float],
    text: str = "text",
    id_col: str = "doc_id",
    how: Training = Training(),
) -> DataFrame:
    """Per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (add-one unigram of whole words) and ``score`` (log10 of the
    lattice model's probability)."""
    own = F.coalesce(training, F.lit(True))
    keyed = dict(zip(pieces, start, strict=True))
    vocab = Vocabulary(pieces)
    words = materialize(count_words(docs, text, own), "word_counts")
    n_docs = docs.where(own).count()
    once, twice = F.col("n_train") == 1, F.col("n_train") == 2
    seen = words.agg(
        F.sum("n_train").alias("n"), F.count_if(F.col("n_train") > 0).alias("v"), F.sum("n_all").alias("all"), F.count_if(once).alias("n1"), F.count_if(twice).alias("n2")
    ).first()
    n_words, v_words = seen["n"] or 0, seen["v"]
    n, v = n_words + n_docs, v_words + (n_docs > 0)
    logp = fit_scores(words.where("n_train > 0").select("word"), vocab, [keyed[p] for p in vocab.pieces], how)
    known = materialize(word_scores(words, vocab, logp, how), "word_scores")
    discount = min(max(seen["n1"] / max(seen["n1"] + 2 * seen["n2"], 1), 0.1), 0.95)
    spelled = math.log((discount * v_words + 1) / (n + 2))  # the pieces' share

    blocks = max(1, math.ceil((seen["all"] or 0) / how.block_tokens))
    rows = docs.select(
        F.col(id_col).alias("_id"), whole(text).alias("t"), own.alias("own"), F.pmod(F.xxhash64(id_col, F.length(text)), F.lit(blocks)).cast("int").alias("block")
    )

    def ask(table: pa.Table) -> pa.Table:
        found: set[bytes] = set()
        for t in each_text(table.column("t")):
            found.update(t.encode().lower().split())
        words = pa.array(list(found), pa.binary()).cast(pa.string())
        block = table.column("block")[0].as_py() if table.num_rows else 0
        return pa.table({"block": pa.array([block] * len(words), pa.int32()), "word": words})

    asked = rows.groupBy("block").applyInArrow(ask, "block int, word string")
    answers = asked.join(known, "word").select("block", "word", "n_train", "logp")
    end_base = math.log10((n_docs + 1) / (n + v + 1))
    end_score = math.log10((n_docs + 1) / (n + 2))

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        at = {w.encode(): i for i, w in enumerate(found.column("word").to_pylist())}
        c = found.column("n_train").to_numpy().astype(float)
        base = np.log10((c + 1) / (n + v + 1))
        with np.errstate(divide="ignore"):  # the whole-word arc joins the paths
            lattice = np.logaddexp(np.log(np.maximum(c - discount, 0) / (n + 2)), spelled + found.column("logp").to_numpy()) / math.log(10)
        out = []
        for t in each_text(texts.column("t")):
            tokens = t.encode().lower().split()
            i = np.fromiter(map(at.__getitem__, tokens), np.int64, len(tokens))
            out.append((len(tokens) + 1, int((c[i] > 0).sum()) + (n_docs > 0), float(base[i].sum()) + end_base, float(lattice[i].sum()) + end_score))
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table({
            "_id": texts.column("_id"),
            "own": texts.column("own"),
            "n_tokens": pa.array(cols[0], pa.int64()),
            "n_known": pa.array(cols[1], pa.int64()),
            "base_score": pa.array(cols[2], pa.float64()),
            "score": pa.array(cols[3], pa.float64()),
        })

    kind = rows.schema["_id"].dataType.simpleString()
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"_id {kind}, own boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(
        F.col("_id").alias(id_col), (~F.col("own")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
