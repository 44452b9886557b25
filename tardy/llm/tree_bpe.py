"""BPE encoding and decoding with tree concatenation of long unsplit text.

Everything that the tokenizer does before merging is local to runs without
ASCII white space, so texts are encoded run by run, each distinct run once per
task. A pre-token of more than ``leaf`` symbols cannot be split by rule. It is
cut into leaves that are encoded in parallel by the merges alone, and put
together pair by pair, as a tree: around each join a window of tokens is
re-encoded and doubled until it begins with the left side's token and ends with
the right side's. All neighbouring tokens then agree pairwise, which for merges
ranked by pair means that the whole is the encoding of the joined text. If the
window has reached an end of the joined text, there is nothing left to agree.

Defined results: null text counts as empty and gives no tokens and an empty
string. Strings of special tokens in a text become special tokens, as the
library does by default. Repeated rows get equal results; an empty table gives
an empty result. Only the kept columns and the text are read.

Scale: texts without very long runs are encoded in one pass without a shuffle;
memory is a batch of texts and a bounded cache. The others are written as
leaves, spread over tasks, and gathered per document.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialize
from .common import WS, whole

LEAF = 4096
CACHE = 300_000
TAIL = b".,;:!?"
#: Letters that normalising leaves alone but for the case.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: The symbol of each byte: itself where it is printable in Latin-1, the others
#: in order from U+0100.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SYMBOLS = {b: b for b in _PRINTED} | {b: 0x100 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
OUT = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]


class Codec:
    """The tokenizer of a file, its merges with and without the word end."""

    _known: dict[str, Codec] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.suffix = content["model"].get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in content["model"]["merges"]]
        vocab = content["model"]["vocab"]
        self.open_model = BPE(vocab=vocab, merges=merges)
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.ids: dict[bytes, bytes] = {}
        self.decoded: dict[bytes, str] = {}
        self.empty: set[bytes] = set()

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def spelled(self, ids) -> str:
        return " ".join(map(self.strings.__getitem__, ids))

    def learn_runs(self, runs: set[bytes]) -> None:
        """Encodes runs that the cache doesn't hold. A tail of common
        punctuation after a letter is a pre-token of its own."""
        new = runs - self.ids.keys()
        if len(self.ids) + len(new) > CACHE:
            for held in (self.ids, self.decoded, self.empty):
                held.clear()
            new = runs
        whole_runs, tailed = [], []
        for r in new:
            stem = r.rstrip(TAIL)
            if stem != r and LETTERS(stem.decode()[-1:]):
                tailed.append((r, stem, r[len(stem) :]))
            else:
                whole_runs.append(r)
        self._learn(whole_runs)
        if tailed:
            self._learn({x for _, *two in tailed for x in two if x not in self.ids})
            for r, stem, tail in tailed:
                self.ids[r] = self.ids[stem] + self.ids[tail]
                self.decoded[r] = f"{self.decoded[stem]} {self.decoded[tail]}"

    def _learn(self, runs) -> None:
        """Words of Latin-1 letters are one pre-token each and go to the merges
        at once, all other runs to the library as they are."""
        other, tokenize, strings = [], self.tok.model.tokenize, self.strings
        for r in runs:
            text = r.decode()
            if not LETTERS(text):
                other.append(text)
                continue
            text = text.lower()
            ids = [t.id for t in tokenize(text if r.isascii() else text.encode().decode("latin-1").translate(BYTE_SYMBOLS))]
            self.ids[r] = array("i", ids).tobytes()
            self.decoded[r] = " ".join([strings[i] for i in ids])
        for text, e in zip(other, self.tok.encode_batch_fast(other, add_special_tokens=False), strict=True):
            r = text.encode()
            self.ids[r], self.decoded[r] = array("i", e.ids).tobytes(), self.spelled(e.ids)
            if not e.ids:
                self.empty.add(r)

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Ids (packed, 4 bytes each) and decoded text of each text; the new
        runs of all texts are encoded together."""
        split = [t.encode("utf-8").split() for t in texts]  # at ASCII white space
        self.learn_runs(set(chain.from_iterable(split)))
        ids, decoded = self.ids.__getitem__, self.decoded.__getitem__
        for runs in split:
            if self.empty and not self.empty.isdisjoint(runs):
                runs = [r for r in runs if r not in self.empty]
            yield b"".join(map(ids, runs)), " ".join(map(decoded, runs))

    def pretokens(self, run: str) -> Iterator[tuple[str, int | None]]:
        """(symbols, None) of each pre-token or (string, id) of a special token."""
        for part in self.special_re.split(run) if self.special_re else [run]:
            if part in self.special:
                yield part, self.special[part]
            elif part:
                norm = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                for symbols, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm):
                    yield symbols, None

    def merge(self, symbols: str, closing: bool) -> list[int]:
        """Ids of a stretch of a pre-token; ``closing`` if its end is the
        pre-token's."""
        return [t.id for t in (self.tok.model if closing else self.open_model).tokenize(symbols)]

    def symbols(self, ids: list[int], closing: bool) -> str:
        text = "".join(map(self.strings.__getitem__, ids))
        return text[: len(text) - len(self.suffix)] if closing and self.suffix else text

    def join(self, left: list[int], right: list[int], closing: bool) -> list[int]:
        """Encoding of the joined text of two encoded stretches."""
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            ends = closing and len(b) == len(right)
            window = self.merge(self.symbols(a, False) + self.symbols(b, ends), ends)
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    def tree(self, leaves: list[list[int]]) -> list[int]:
        """Joins neighbours until one is left; the last leaf is closing."""
        while len(leaves) > 1:
            last = len(leaves) - 1
            leaves = [self.join(leaves[i], leaves[i + 1], i + 1 == last) if i < last else leaves[i] for i in range(0, last + 1, 2)]
        return leaves[0]


def _encode_short(path: str, names: list[str], rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                ids, decoded = zip(*codec.encode(part.column(part.num_columns - 1).to_pylist()), strict=True)
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends), flat)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(decoded, pa.string())], names=[*names, "ids", "decoded"])

    return run


def _cut_long(path: str, leaf: int):
    """Slots of each text in order: encoded stretches (``ids``), and the leaves
    (``symbols``) of its long pre-tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        codec, part, n = Codec.of(path), TaskContext.get().partitionId(), 0
        for pdf in batches:
            out = []
            for text in pdf["_t"]:
                slot, ids = 0, []
                for r in text.encode("utf-8").split():
                    if len(r) <= leaf:
                        codec.learn_runs({r})
                        ids += array("i", codec.ids[r])
                        continue
                    for symbols, special in codec.pretokens(r.decode()):
                        if special is not None:
                            ids.append(special)
                        elif len(symbols) <= leaf:
                            ids += codec.merge(symbols, True)
                        else:
                            out.append((part, n, slot, 0, False, None, ids))
                            cuts = range(0, len(symbols), leaf)
                            out += [(part, n, slot + 1, i, c + leaf >= len(symbols), symbols[c : c + leaf], None) for i, c in enumerate(cuts)]
                            slot, ids = slot + 2, []
                out.append((part, n, slot, 0, False, None, ids))
                n += 1
            yield pd.DataFrame(out, columns=["part", "n", "slot", "leaf", "closing", "symbols", "ids"])

    return run


def _encode_leaves(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(path)
        for pdf in batches:
            pdf["ids"] = [list(i) if s is None else codec.merge(s, c) for s, c, i in zip(pdf["symbols"], pdf["closing"], pdf["ids"], strict=True)]
            yield pdf[["part", "n", "slot", "leaf", "ids"]]

    return run


def _assemble(path: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        codec, ids = Codec.of(path), []
        for _, leaves in pdf.sort_values(["slot", "leaf"]).groupby("slot", sort=True)["ids"]:
            ids += codec.tree([list(map(int, x)) for x in leaves])
        first = pdf.iloc[0]
        return pd.DataFrame({"part": [first["part"]], "n": [first["n"]], "ids": [ids], "decoded": [codec.spelled(ids)]})

    return run


def encode(docs: DataFrame, path: str, keep: list[Column], text: str = "text", leaf: int = LEAF) -> DataFrame:
    """``keep``, ``ids`` and ``decoded`` (their tokens' strings, as the library
    decodes without a decoder) of each text. ``path``: the tokenizer's file,
    readable on every executor; it must have no decoder and no post-processing."""
    rows = docs.select(*keep, whole(text).alias("_t"))
    names = rows.columns[:-1]
    kept = rows.schema.fields[:-1]
    long_run = (F.length("_t") > leaf // 4) & F.exists(F.split("_t", WS + "+"), lambda w: F.octet_length(w) > leaf)
    short = rows.where(~long_run).mapInArrow(_encode_short(path, names), T.StructType([*kept, *OUT]))

    # Texts with long runs are told apart by their place in the task that cut
    # them; what it wrote stays fixed, so later tasks can be run again.
    where = "part int, n bigint, "
    cut_rows = rows.where(long_run)
    cut = materialize(cut_rows.select("_t", F.struct(*names).alias("_keep")).transform(lambda x: _with_slots(x, path, leaf)), "bpe_leaves")
    leaves = cut.select("part", "n", "slot", "leaf", "closing", "symbols", "ids").repartition("part", "n", "slot", "leaf")
    coded = leaves.mapInPandas(_encode_leaves(path), where + "slot int, leaf int, ids array<int>")
    whole_ids = coded.groupBy("part", "n").applyInPandas(_assemble(path), where + "ids array<int>, decoded string")
    heads = cut.where("_keep IS NOT NULL").select("part", "n", "_keep")
    long = heads.join(whole_ids, ["part", "n"]).select("_keep.*", "ids", "decoded")
    return short.unionByName(long)


def _with_slots(rows: DataFrame, path: str, leaf: int) -> DataFrame:
    """Leaf rows; the first row of each text carries its kept columns."""
    keep = rows.schema["_keep"]
    schema = T.StructType([
        T.StructField("part", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("slot", T.IntegerType()),
        T.StructField("leaf", T.IntegerType()),
        T.StructField("closing", T.BooleanType()),
        T.StructField("symbols", T.StringType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("_keep", keep.dataType),
    ])
    cut = _cut_long(path, leaf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[pd.DataFrame]:
            for b in batches:
                held.append(b)
                yield pd.DataFrame({"_t": b.column(0).to_pylist()})

        n = 0
        for pdf in cut(texts()):
            b = held.pop()
            heads = pdf["n"].ne(pdf["n"].shift()).to_numpy()
            at, k = [], 0
            for h in heads:
                at.append(k if h else None)
                k += int(h)
            cols = [pa.array(pdf[c].tolist(), f) for c, f in (("part", pa.int32()), ("n", pa.int64()), ("slot", pa.int32()), ("leaf", pa.int32()), ("closing", pa.bool_()), ("symbols", pa.string()), ("ids", pa.list_(pa.int32())))]
            kept = b.column(1).take(pa.array(at, pa.int32()))
            n += k
            yield pa.RecordBatch.from_arrays([*cols, kept], names=schema.names)

    return rows.mapInArrow(run, schema)
