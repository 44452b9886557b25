"""Quality rules judged per host: rule failures are summed by domain, failure
rates are shrunk with an empirical beta prior, and the verdict on a host goes
back to its documents. Only DataFrame functions.

Defined results: a null text has no words and fails the length rule; a null
host is a host of its own; repeated rows are judged and counted one by one; an
empty table gives an empty result. Columns of the input other than the named
ones are never read, so their names cannot clash.

Scale: rules are computed inside the row. Hosts are counted by a partial
aggregate, so a host that holds a third of all rows sends one row per task.
The host table is written and broadcast only if a count shows it to be small;
otherwise the join shuffles and adaptive execution splits the hot host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .common import NOT_WS, bind, small_side, whole, words


@dataclass(frozen=True)
class HostRules:
    """A document fails with fewer than ``min_words`` words, more than
    ``max_repeat`` of its words in repeated 3-word windows, more than
    ``max_symbols`` symbols a word, or more than ``max_dup_lines`` of its
    words' lines repeated. A host is rejected when its shrunk failure rate
    exceeds ``max_host_rate``."""

    min_words: int = 50
    max_repeat_pct: int = 50
    max_symbols_pct: int = 50
    max_dup_lines_pct: int = 50
    max_host_rate: float = 0.5
    # bounds of the prior's weight, in documents
    min_weight: float = 1.0
    max_weight: float = 1000.0


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = r"[#*$%&|<>]"


def metrics(text: Column) -> Column:
    """Struct of the rule inputs (``METRICS``) of a text. All steps are bound
    inside one expression, so a filter on it can be pushed to the scan without
    computing a step again for each element."""
    return bind(text, lambda t: bind(words(t), lambda w: bind(_windows(w), lambda g: bind(_repeated(g), lambda s: _counts(t, w, s)))))


def _windows(w: Column) -> Column:
    """Hashes of the 3-word windows."""
    return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(
        F.array().cast("array<bigint>")
    )


def _repeated(g: Column) -> Column:
    """Windows sorted by hash, so that equal ones are neighbours; null where
    none is repeated, as in most texts, which need no sorting."""
    return F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def _counts(t: Column, w: Column, s: Column) -> Column:
    same = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
    covered = F.transform(F.filter(s, same), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(NOT_WS))
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.size(F.regexp_extract_all(t, F.lit(SYMBOLS), F.lit(0))),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": F.coalesce(F.size(F.array_distinct(F.flatten(covered))), F.lit(0)),
        "n_lines": F.size(lines),
    }
    return F.struct(*[c.cast("bigint").alias(k) for k, c in counts.items()])


def base_failed(m: Column, rules: HostRules = HostRules()) -> Column:
    return (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_pct * m["n_words"])


def rule_failed(m: Column, rules: HostRules = HostRules()) -> Column:
    """Any rule fails; these failures are what a host is judged by."""
    return (
        base_failed(m, rules)
        | (100 * m["n_symbols"] > rules.max_symbols_pct * m["n_words"])
        | (100 * m["n_dup_lines"] > rules.max_dup_lines_pct * m["n_lines"])
    )


def host_verdicts(judged: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """One row per host (``_host``, ``n_docs``, ``n_failed``, ``fail_rate``,
    ``host_kept``) from rows with ``_host`` and a boolean ``_failed``.

    The prior beta(a, b) is fitted by moments to the hosts' rates: mean m, and
    weight a + b = m(1-m)/variance - 1 within the bounds of ``rules``.
    """
    hosts = materialize(
        judged.groupBy("_host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("_failed").cast("bigint")).alias("n_failed")),
        "host_counts",
    )
    rate = F.col("n_failed") / F.col("n_docs")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()  # one row
    m, v = m or 0.0, v or 0.0
    weight = min(max(m * (1 - m) / v - 1 if v > 0 else rules.max_weight, rules.min_weight), rules.max_weight)
    shrunk = (F.col("n_failed") + F.lit(m * weight)) / (F.col("n_docs") + F.lit(weight))
    return materialize(
        hosts.withColumn("fail_rate", shrunk).withColumn("host_kept", F.col("fail_rate") <= rules.max_host_rate), "host_verdicts"
    )


def host_key(host: str) -> Column:
    return whole(F.col(host).cast("string")).alias("_host")


def judge_documents(docs: DataFrame, host: str = "source", text: str = "text", id_col: str = "doc_id", rules: HostRules = HostRules()) -> DataFrame:
    """Per row of ``docs``: id, host, rule inputs, ``base_failed``, the host's
    shrunk ``fail_rate`` and ``kept``. The text is read once; the short rows
    are written before hosts are counted."""
    rows = docs.select(F.col(id_col).alias("_id"), host_key(host), metrics(whole(text)).alias("_m"))
    judged = rows.select("_id", "_host", "_m.*", base_failed(F.col("_m"), rules).alias("base_failed"), rule_failed(F.col("_m"), rules).alias("_failed"))
    judged = materialize(judged, "rule_inputs")
    hosts = host_verdicts(judged, rules)
    out = judged.join(small_side(hosts), "_host")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        *METRICS,
        "base_failed",
        "fail_rate",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"),
    )


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", rules: HostRules = HostRules()) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged. Rules are
    computed twice, so that texts are never shuffled or written: once for the
    hosts' counts, once in the filtering pass, next to the (small) verdicts."""
    hosts = host_verdicts(docs.select(host_key(host), bind(metrics(whole(text)), lambda m: rule_failed(m, rules)).alias("_failed")), rules)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    good = docs.where(bind(metrics(whole(text)), lambda m: ~base_failed(m, rules))).select(host_key(host), row)
    return good.join(small_side(hosts.where("host_kept").select("_host")), "_host", "left_semi").select("_row.*")
