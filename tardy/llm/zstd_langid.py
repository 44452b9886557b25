"""Language identification by compression.

For each language a raw-content dictionary is put together from a bounded
sample of labelled texts. A text is compressed with the dictionary of each
language; the smallest result names the language, and the decision is marked as
not accepted where the margin to the next language is narrow.

A text is compressed in blocks of ``block_bytes``, each from the dictionary
alone, so the dictionary counts in every part of a long text; blocks are all of
the text, and memory is bounded by a block. Only letters count: case is folded
and each run of other characters becomes a space, in samples and texts alike.

Fitting: for each language the ``sample_docs`` training texts with the smallest
hash of their id (parameter). Each gives ``slices`` evenly spaced slices of its
whole text, of a length by which all sampled texts together fill ``dict_bytes``;
a dictionary is cut to that, or to the shortest language's length if that is at
least half of it, so that no language gains much by a longer dictionary.

Defined results: a text that is null or has no letter is ``und`` with score 0
and not accepted; ties go to the language with more training texts, then
to the first by name. Rows are
judged one by one, so repeated rows get the same result. A null id counts as an
empty one when rows are dealt to training. Without any labelled
training text every text is ``und``. Other columns are not read.

Scale: no shuffle but the top-k per language (cut down in each task first).
The dictionaries (languages x ``dict_bytes``) go to the tasks once, with the
function; the number of languages is the label set's, not the corpus's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTER = r"\p{L}"
UNKNOWN = "und"


@dataclass(frozen=True)
class Fit:
    sample_docs: int = 200
    slices: int = 4
    dict_bytes: int = 96_000
    block_bytes: int = 4096
    level: int = 6
    min_margin: float = 0.01


def letters(text: str) -> bytes:
    return re.sub(r"[\W\d_]+", " ", text.lower()).encode("utf-8", "replace")


def is_training(id_col: str, folds: int, held: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, is not ``held``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds != held


def _slices(text: Column, fit: Fit) -> Column:
    """Evenly spaced slices of a text, joined by spaces (a short text whole)."""
    size = fit.dict_bytes // (fit.sample_docs * fit.slices)
    step = F.floor(F.length(text) / fit.slices)
    part = lambda i: F.substring(text, (step * i + 1).cast("int"), F.least(step, F.lit(size)).cast("int"))
    parts = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(fit.slices - 1)), part), " ")
    return F.when(F.length(text) <= size * fit.slices, text).otherwise(parts)


def fit_dictionaries(train: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", fit: Fit = Fit()) -> dict[str, bytes]:
    """Raw-content dictionaries by language, of bounded size."""
    rows = train.where(F.col(lang).isNotNull() & F.col(text).rlike(LETTER)).select(
        F.col(lang).alias("lang"), F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i"), _slices(F.col(text), fit).alias("t")
    )
    first = Window.partitionBy("lang").orderBy("h", "i", "t")
    chosen = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= fit.sample_docs).collect()
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in chosen:
        texts.setdefault(r["lang"], []).append((r["k"], r["t"]))
    joined = {k: b"\n".join(letters(t) for _, t in sorted(v)) for k, v in texts.items()}
    even = min([len(v) for v in joined.values()] + [fit.dict_bytes])
    cut = even if 2 * even >= fit.dict_bytes else fit.dict_bytes
    total = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()} if joined else {}
    return {k: joined[k][:cut] for k in sorted(joined, key=lambda k: (-total.get(k, 0), k))}


class _Sizes:
    """Compressed sizes of a text by language."""

    def __init__(self, dictionaries: dict[str, bytes], fit: Fit):
        self.fit = fit
        self.coders = [self._coder(d, fit.level) for d in dictionaries.values()]

    @staticmethod
    def _coder(content: bytes, level: int) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)

    def of(self, text: str) -> list[int]:
        data, n = letters(text), self.fit.block_bytes
        blocks = [data[i : i + n] for i in range(0, len(data), n)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]


def predict(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[Column], text: str = "text", fit: Fit = Fit()) -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` (1 minus the smallest size over the
    next one, scaled to 0..1 by ``1 - (1 - margin) ** 16``), ``accepted``."""
    rows = docs.select(F.struct(*keep).alias("_keep"), F.when(F.col(text).rlike(LETTER), F.col(text)).alias("_t"))
    names = list(dictionaries)

    def judge(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sizes = _Sizes(dictionaries, fit)
        for texts in column:
            out = []
            for t in texts:
                if t is None or not names:
                    out.append((UNKNOWN, 0.0, False))
                    continue
                got = sizes.of(t)
                at = min(range(len(got)), key=got.__getitem__)
                rest = min(got[:at] + got[at + 1 :], default=None)
                margin = 1.0 if rest is None else 1 - got[at] / rest
                out.append((names[at], 1 - (1 - margin) ** 16, margin >= fit.min_margin))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "accepted"])

    judged = F.pandas_udf(judge, "lang_pred string, score double, accepted boolean")
    return rows.select("_keep", judged("_t").alias("_j")).select("_keep.*", "_j.*")
