"""Personal data by bootstrapped contextual extraction, DataFrame functions only.

Seeds are what the base patterns (email, ip, card, phone) find. Identifier-like
words (with a digit or ``@``) are instances, and the whole words around one form
its lexical patterns: the two before it, the two after it, and the one on either
side (digits as 0, so that parts of an identifier are context of each other). In
a graph of patterns and instances Spark scores both in turns: a pattern of a kind
is as good as the share of its distinct instances that are of the kind; an instance
is of the kind unless all its patterns err. Patterns of high confidence and
support mark the unseen instances they stand at. An unseen instance found
so that names itself (seven digits or ``@``) is marked wherever it stands.
Marked neighbours of one kind become one span.

Defined results: null text counts as empty and has no spans; positions are code
points, end exclusive; equal rows get equal spans, while an instance counts
once in a pattern however often it is repeated. An empty table gives an empty
result. Other columns are not read by ``find_spans`` and kept by ``redact``.

Scale: matching runs inside the row, with patterns that cannot backtrack over
long runs. Only (pattern, instance) pairs are shuffled, deduplicated before the
shuffle, and only patterns with enough instances go into the iteration, which
goes on until nothing changes: scores only rise, so it ends. The model
is a written table of all confident patterns. It is joined to the unseen
instances, broadcast only if a count shows few, and the marked spans are
gathered per row (``redact``: per digest of the text).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .common import NOT_WS, bind, cut_text, lower_ascii, prefix_sums, small_side, text_blocks, whole, words

# The base patterns, leftmost and non-overlapping. Possessive quantifiers and
# a start that is either the end of the last match or not inside a run give the
# same matches in linear time.
LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(BASE)
#: Cheap conditions without which a pattern cannot match.
NEEDS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
# Identifier-like strings: words with a digit or "@", and what is left of one
# without the punctuation around it.
INSTANCE = rf"(?<!{NOT_WS}){NOT_WS}*?[0-9@]{NOT_WS}*+"
LEAD, CORE = r"^[^\p{L}0-9+@]*+", r"(?s)^[^\p{L}0-9+@]*+(.*[\p{L}0-9])"


@dataclass(frozen=True)
class Bootstrap:
    min_support: float = 3.0
    min_confidence: float = 0.8
    #: An instance of so many digits (or with "@") is the same one elsewhere.
    own_digits: int = 7
    #: Marked spans of one kind so near to each other are one.
    join_chars: int = 3
    #: The rounds end when no confidence rises by more and no pattern is new.
    tolerance: float = 1e-6


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """From the last digit: each second one doubled, nine off if above nine."""
    n = F.length(digits)
    worth = lambda k: F.substring(digits, n - k, F.lit(1)).cast("int") * F.when(k % 2 == 1, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, k: s + bind(worth(k), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.try_to_number(F.substring(part(p), 1, 3), F.lit("999")), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(13, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _matches(rows: DataFrame, pattern: str, needs: str, names: list[str], out: str) -> DataFrame:
    """Adds ``out``: array<struct<s, e, v>> of all matches in ``_t``. The text
    between matches gives their places."""
    none = F.array().cast("array<string>")
    there = F.col("_t").rlike(needs)
    cut = rows.select(
        *names,
        "_t",
        F.when(there, F.regexp_extract_all("_t", F.lit(f"({pattern})"), F.lit(1))).otherwise(none).alias("_m"),
        F.when(there, F.split("_t", pattern, -1)).otherwise(none).alias("_p"),
    )
    lengths = F.transform("_m", lambda v, i: (F.length(F.get("_p", i)) + F.length(v)).cast("bigint"))
    placed = cut.withColumn("_o", F.when(F.size("_m") > 0, bind(lengths, prefix_sums)).otherwise(F.array().cast("array<bigint>")))
    start = lambda i: F.get("_o", i) + F.length(F.get("_p", i))
    spans = F.transform(
        "_m",
        lambda v, i: F.struct(
            start(i).alias("s"),
            (start(i) + F.length(v)).alias("e"),
            v.alias("v"),
        ),
    )
    return placed.select(*names, "_t", spans.alias(out))


def _patterns(ws: Column, at: Column) -> Column:
    """The patterns around word ``at``: two words before it (one at the start of
    the text), two after it, one on either side. Long ones by their digest."""
    word = lambda i: F.when(i >= 0, F.get(ws, i))
    before2, before, after, after2 = word(at - 2), word(at - 1), word(at + 1), word(at + 2)
    made = F.array(
        F.concat(F.lit("L "), F.coalesce(F.concat(before2, F.lit(" ")), F.lit("")), before),
        F.concat(F.lit("R "), after, F.lit(" "), after2),
        F.concat(F.lit("S "), before, F.lit(" "), after),
    )
    plain = F.transform(made, lambda p: F.regexp_replace(lower_ascii(p), "[0-9]", "0"))
    return F.transform(F.filter(plain, lambda p: p.isNotNull()), lambda p: F.when(F.length(p) > 64, F.sha2(p, 256)).otherwise(p))


def _validity(kind: str):
    return lambda x: _valid(kind, x["v"])


def _of_kind(found: Column, n: int) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(n).alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def with_matches(docs: DataFrame, keep: list[Column], text: str | Column = "text", model: Bootstrap = Bootstrap()) -> DataFrame:
    """``keep``, ``_t``, ``_base`` (array<struct<k, s, e>>, k the kind's place)
    and ``_inst`` (array<struct<s, e, v, own, left, k>>: own if the value names
    itself, left its patterns, k null if not a seed)."""
    rows = docs.select(*keep, whole(text).alias("_t"))
    names = [c for c in rows.columns if c != "_t"]
    for kind in KINDS:
        rows = _matches(rows, BASE[kind], NEEDS[kind], names, f"_{kind}")
        names = [*names, f"_{kind}"]
    rows = _matches(rows, INSTANCE, "[0-9@]", names, "_found")
    kept = names[: -len(KINDS)]
    base = F.concat(*[_of_kind(F.filter(f"_{k}", _validity(k)), n) for n, k in enumerate(KINDS)])
    split = F.when(F.size("_found") > 0, words(F.col("_t"))).otherwise(F.array().cast("array<string>"))
    some = rows.select(*kept, "_t", base.alias("_base"), "_found", split.alias("_w"))
    numbered = F.filter(F.transform("_w", lambda w, i: F.when(w.rlike("[0-9@]"), i)), lambda i: i.isNotNull())
    kind = lambda s, e: F.array_min(F.transform(F.filter("_base", lambda b: (b["s"] < e) & (b["e"] > s)), lambda b: b["k"]))
    core = lambda at: F.transform(
        "_found",  # the n-th match is the n-th word with a digit or "@"
        lambda x, n: F.struct(
            (x["s"] + F.length(F.regexp_extract(x["v"], LEAD, 0))).alias("s"), F.regexp_extract(x["v"], CORE, 1).alias("v"), F.get(at, n).alias("at")
        ),
    )
    inst = F.transform(
        F.filter(bind(numbered, core), lambda x: F.length(x["v"]) > 0),
        lambda x: F.struct(
            x["s"].alias("s"),
            (x["s"] + F.length(x["v"])).alias("e"),
            F.xxhash64(x["v"]).alias("v"),
            ((F.length(_digits(x["v"])) >= model.own_digits) | x["v"].contains("@")).alias("own"),
            _patterns(F.col("_w"), x["at"]).alias("left"),
            kind(x["s"], x["s"] + F.length(x["v"])).alias("k"),
        ),
    )
    return some.select(*kept, "_t", "_base", inst.alias("_inst"))


def learn_patterns(matched: DataFrame, model: Bootstrap = Bootstrap()) -> tuple[DataFrame, DataFrame] | None:
    """Written tables ``p`` (pattern), ``k`` (its best kind's place), ``conf`` of
    all confident patterns, and ``v``, ``k``, ``conf`` of the unseen instances that
    they find; None if there is nothing to mark."""
    each = matched.select(F.explode("_inst").alias("x")).select("x.v", "x.k", F.explode("x.left").alias("p"))
    pairs = each.groupBy("p", "v")
    pairs = pairs.agg(F.min("k").alias("k"), F.max(F.col("k").isNull()).alias("unseen"))
    # The support is at most the number of instances, seeds or not.
    often = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= model.min_support)
    edges = materialize(pairs.join(often, "p"), "pattern_instances")
    if edges.where("unseen").isEmpty():
        return None
    seeds = edges.where("k IS NOT NULL").select("v", "k").distinct().withColumn("score", F.lit(1.0))
    scores, patterns = seeds, None
    while True:
        weighed = edges.select("p", "v", "n").join(scores, "v").groupBy("p", "k", "n").agg(F.sum("score").alias("support"))
        now = materialize(
            weighed.withColumn("conf", F.col("support") / F.col("n")).where((F.col("conf") >= model.min_confidence) & (F.col("support") >= model.min_support)),
            "confident_patterns",
        )
        before = now.select("p", "k", F.lit(0.0).alias("conf")) if patterns is None else patterns.select("p", "k", "conf")
        change = now.select("p", "k", "conf").unionByName(before).groupBy("p", "k").agg(F.count(F.lit(1)).alias("in"), (F.max("conf") - F.min("conf")).alias("by"))
        patterns = now
        if change.where((F.col("in") < 2) | (F.col("by") > model.tolerance)).isEmpty():
            break
        erring = F.sum(F.log1p(-F.least(F.col("conf"), F.lit(0.999))))
        found = edges.where("k IS NULL").select("p", "v").join(patterns.select("p", "k", "conf"), "p").groupBy("v", "k").agg((1 - F.exp(erring)).alias("score"))
        scores = materialize(seeds.unionByName(found).groupBy("v", "k").agg(F.max("score").alias("score")), "instance_scores")
    best = patterns.groupBy("p").agg(F.max(F.struct("conf", "support", -F.col("k"))).alias("b"))
    best = materialize(best.select("p", (-F.col("b.col3")).cast("int").alias("k"), F.col("b.conf").alias("conf")), "best_patterns")
    sure = scores.where(F.col("score") >= model.min_confidence).groupBy("v").agg(F.max(F.struct("score", -F.col("k"))).alias("b"))
    new = sure.join(edges.where("k IS NULL").select("v").distinct(), "v", "left_semi")
    return best, materialize(new.select("v", (-F.col("b.col2")).cast("int").alias("k"), F.col("b.score").alias("conf")), "found_instances")


def _joined(spans: Column, gap: int) -> Column:
    """Sorted spans (s, e, k), neighbours of one kind made one."""
    none = F.array().cast("array<struct<s:bigint,e:bigint,k:int>>")
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    merge = lambda acc, x: F.when(
        (F.size(acc) > 0) & (last(acc)["k"] == x["k"]) & (x["s"] - last(acc)["e"] <= gap),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))),
    ).otherwise(F.concat(acc, F.array(x)))
    return F.transform(F.aggregate(F.sort_array(spans), none, merge), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def mark(matched: DataFrame, key: str, patterns: DataFrame, instances: DataFrame, model: Bootstrap = Bootstrap()) -> DataFrame:
    """``key`` and ``_added`` (array<struct<k, s, e>>): the instances that touch
    no base span and stand at a confident pattern, or name themselves and were
    found elsewhere; the surest kind is taken. Rows of one key are equal."""
    unseen = matched.select(key, F.explode("_inst").alias("x")).where("x.k IS NULL").select(key, "x.*")
    by_pattern = unseen.select(key, "s", "e", F.explode("left").alias("p")).join(small_side(patterns), "p").select(key, "s", "e", "k", "conf")
    by_value = unseen.where("own").select(key, "s", "e", "v").join(small_side(instances), "v").select(key, "s", "e", "k", "conf")
    best = by_pattern.unionByName(by_value).groupBy(key, "s", "e").agg(F.max(F.struct("conf", -F.col("k"))).alias("b"))
    spans = best.groupBy(key).agg(F.collect_list(F.struct("s", "e", (-F.col("b.col2")).cast("int").alias("k"))).alias("_l"))
    return materialize(spans.select(key, _joined(F.col("_l"), model.join_chars).alias("_added")), "marked_spans")


def add_spans(rows: DataFrame, key: str, matched: DataFrame, model: Bootstrap) -> DataFrame:
    """``rows`` with ``_added``, by ``key``, from what ``matched`` teaches."""
    none = F.array().cast("array<struct<k:int,s:bigint,e:bigint>>")
    learned = learn_patterns(matched, model)
    if learned is None or learned[0].isEmpty():
        return rows.withColumn("_added", none)
    return rows.join(small_side(mark(matched, key, *learned, model)), key, "left").withColumn("_added", F.coalesce("_added", none))


def all_spans() -> Column:
    """Base spans and added ones, sorted by kind, then start."""
    return F.sort_array(F.concat("_base", "_added"))


def find_spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id", model: Bootstrap = Bootstrap()) -> DataFrame:
    """Per row: id, ``base`` and ``found`` (array<struct<k, s, e>>, sorted).
    The text is read once; the short match lists are written."""
    found = with_matches(docs, [F.col(id_col).alias("_id")], text, model).drop("_t")
    matched = materialize(found.withColumn("_key", F.monotonically_increasing_id()), "pii_matches")
    rows = add_spans(matched.select("_key", "_id", "_base"), "_key", matched, model)
    return rows.select(F.col("_id").alias(id_col), F.sort_array("_base").alias("base"), all_spans().alias("found"))


def spell(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", model: Bootstrap = Bootstrap()) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets (spans
    that overlap by the first one's); ``n_chars``, if there, is updated. Null
    texts stay null. Texts are matched twice, and shuffled (once) only if
    more of them get added spans than are broadcast."""
    key = F.sha2(whole(text), 256).alias("_key")
    # A condition on the instances themselves would compute them a second time.
    some = docs.where(whole(text).rlike("[0-9@]"))
    learned = materialize(with_matches(some, [key], text, model).select("_key", "_inst"), "pii_instances")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = add_spans(docs.select(row, key), "_key", learned, model)
    rows = with_matches(keyed, [F.col("_row"), F.col("_added")], F.col(f"_row.`{text}`"), model)
    by_place = F.sort_array(F.transform(all_spans(), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    none = F.array().cast("array<struct<s:bigint,e:bigint,k:int>>")
    merge = lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["s"] < F.coalesce(F.get(acc, F.size(acc) - 1)["e"], F.lit(0))),
        F.concat(
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
            F.array(F.struct(F.get(acc, F.size(acc) - 1)["s"].alias("s"), F.greatest(F.get(acc, F.size(acc) - 1)["e"], x["e"]).alias("e"), F.get(acc, F.size(acc) - 1)["k"].alias("k"))),
        ),
    ).otherwise(F.concat(acc, F.array(x)))
    marked = rows.select("_row", "_t", F.aggregate(by_place, none, merge).alias("_s"))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    pieces = lambda blocks: F.array_join(
        F.concat(
            F.transform("_s", lambda x, i: F.concat(cut_text(blocks, F.coalesce(F.get("_s", i - 1)["e"], F.lit(0)), x["s"]), names[x["k"]])),
            F.array(cut_text(blocks, F.coalesce(F.get("_s", F.size("_s") - 1)["e"], F.lit(0)), F.length("_t").cast("bigint"))),
        ),
        "",
    )
    new = F.when(F.size("_s") > 0, bind(text_blocks(F.col("_t")), pieces)).otherwise(F.col(f"_row.`{text}`"))
    out = marked.withColumn("_new", new)
    cols = [F.col("_new").alias(c) if c == text else F.length("_new").cast("bigint").alias(c) if c == "n_chars" else F.col(f"_row.`{c}`") for c in docs.columns]
    return out.select(*cols)
