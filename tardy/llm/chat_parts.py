"""Chat formatting with typed content parts, DataFrame functions only.

A visitor goes over the parts of each message: a text part becomes its escaped
text, an image, audio or document part becomes a placeholder in its place,
while its reference and the number of tokens it expands to are recorded, in
order. Turns are marked by control strings; where a text holds a control
string, a backslash goes before its last character (one more if there are
some), which reading back undoes exactly.

Defined results: null texts, roles and lists of parts count as empty; parts of
unknown type become ``<|other|>`` with no tokens. Turns with the same number
are ordered by role, then text; repeated rows stay. Null conversation ids form
one conversation. An empty table gives an empty result.

Scale: texts are escaped row by row before they are gathered. A conversation
is one output row, gathered with one partial list per task; spans are cut out
of blocks of the text, so a very long conversation costs its length once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, cut_text, prefix_sums, text_blocks, whole


@dataclass(frozen=True)
class Template:
    begin: str = "<s>"
    turn: str = "<|turn|>"
    body: str = "<|body|>"
    end: str = "</s>"
    #: Strings of other templates that must not appear unescaped either.
    reserved: tuple[str, ...] = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    #: Tokens for each unit (tile, second, page) of an attachment.
    unit_tokens: dict[str, int] = field(default_factory=lambda: {"image": 256, "audio": 25, "document": 512})
    #: Roles whose text is under the loss mask.
    learned: tuple[str, ...] = ("assistant",)

    def placeholder(self, kind: str) -> str:
        return f"<|{kind}|>"

    @property
    def kinds(self) -> list[str]:
        return [*self.unit_tokens, "other"]

    @property
    def controls(self) -> list[str]:
        return [self.begin, self.turn, self.body, self.end, *self.reserved, *map(self.placeholder, self.kinds)]

    @property
    def _stems(self) -> str:
        return "|".join(re.escape(c[:-1]) for c in sorted(self.controls, key=len, reverse=True))

    @property
    def _closers(self) -> str:
        return "[" + "".join(sorted({re.escape(c[-1]) for c in self.controls})) + "]"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"((?:{self._stems})\\*+)(?={self._closers})", r"$1\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"((?:{self._stems})\\*)\\(?={self._closers})", "$1")


PART = "array<struct<type:string,text:string,ref:string,units:bigint>>"


def text_part(text: Column) -> Column:
    """A message of one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), whole(text).alias("text"), null.cast("string").alias("ref"), null.cast("bigint").alias("units")))


def visit(parts: Column, t: Template) -> dict[str, Column]:
    """``body``: the flattened message; ``attachments``: type, reference and
    expanded tokens of each placeholder, in order."""
    parts = F.coalesce(parts.cast(PART), F.array().cast(PART))
    kind = lambda p: F.when(p["type"].isin(list(t.unit_tokens)), p["type"]).otherwise("other")
    marked = lambda k: F.concat(F.lit("<|"), k, F.lit("|>"))
    is_text = lambda p: p["type"].eqNullSafe("text")
    rate = F.create_map(*[F.lit(x) for kv in t.unit_tokens.items() for x in kv])
    return {
        "body": F.array_join(F.transform(parts, lambda p: F.when(is_text(p), t.escape(whole(p["text"]))).otherwise(marked(kind(p)))), ""),
        "attachments": F.transform(
            F.filter(parts, lambda p: ~is_text(p)),
            lambda p: F.struct(
                kind(p).alias("type"),
                p["ref"].alias("ref"),
                (F.coalesce(p["units"], F.lit(0)) * F.coalesce(F.try_element_at(rate, kind(p)), F.lit(0))).cast("bigint").alias("tokens"),
            ),
        ),
    }


def format_conversations(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", parts: str = "parts", template: Template = Template()) -> DataFrame:
    """One row per conversation: ``formatted``, ``loss_spans`` (code points,
    end exclusive), ``attachments`` in order, ``expanded_tokens`` of all
    placeholders."""
    t = template
    seen = visit(F.col(parts), t)
    name = whole(F.col(role))
    rows = turns.select(
        F.col(conv).alias("_conv"),
        F.col(order).alias("o"),
        name.alias("r"),
        F.concat(F.lit(t.turn), t.escape(name), F.lit(t.body)).alias("head"),
        F.concat(seen["body"], F.lit(t.end)).alias("tail"),
        seen["attachments"].alias("a"),
    )
    row = F.struct("o", "r", "tail", "head", F.length("head").cast("bigint").alias("nh"), F.length("tail").cast("bigint").alias("nt"), "a")
    gathered = rows.groupBy("_conv").agg(F.sort_array(F.collect_list(row)).alias("m"))
    lengths = F.transform("m", lambda x: x["nh"] + x["nt"])
    placed = gathered.select("_conv", "m", bind(lengths, prefix_sums).alias("at"))
    b, e = len(t.begin), len(t.end)
    spans = F.filter(
        F.transform(
            "m",
            lambda x, i: F.struct(
                x["r"].isin(list(t.learned)).alias("learned"),
                (F.col("at")[i] + b + x["nh"]).alias("start"),
                (F.col("at")[i] + b + x["nh"] + x["nt"] - e).alias("end"),
            ),
        ),
        lambda s: s["learned"],
    )
    return placed.select(
        F.col("_conv").alias(conv),
        F.concat(F.lit(t.begin), F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["tail"])), "")).alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss_spans"),
        F.flatten(F.transform("m", lambda x: x["a"])).alias("attachments"),
        F.aggregate(F.flatten(F.transform("m", lambda x: F.transform(x["a"], lambda a: a["tokens"]))), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("expanded_tokens"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> out of a formatted conversation. Placeholders
    stay in the text, unescaped only outside them (see ``read_parts``)."""
    t = template
    ends = F.split(F.substring(formatted, len(t.begin) + 1, 2**31 - 1), re.escape(t.end))
    one = lambda x: F.split(F.substring(x, len(t.turn) + 1, 2**31 - 1), re.escape(t.body), 2)
    pairs = F.transform(F.slice(ends, 1, F.size(ends) - 1), one)
    return F.transform(pairs, lambda p: F.struct(t.unescape(p[0]).alias("role"), t.unescape(p[1]).alias("text")))


def read_parts(body: Column, template: Template = Template()) -> Column:
    """array<struct<type, text>> out of the (still escaped) body of a turn."""
    t = template
    marks = "|".join(re.escape(t.placeholder(k)) for k in t.kinds)
    text = lambda x: F.struct(F.lit("text").alias("type"), t.unescape(x).alias("text"))
    found = F.regexp_extract_all(body, F.lit(f"({marks})"), F.lit(1))
    mark = lambda x: F.struct(F.substring(x, 3, F.length(x) - 4).alias("type"), F.lit("").alias("text"))
    both = F.flatten(F.transform(F.split(body, marks, -1), lambda x, i: F.when(i < F.size(found), F.array(text(x), mark(F.get(found, i)))).otherwise(F.array(text(x)))))
    return F.filter(both, lambda p: (p["type"] != "text") | (p["text"] != ""))


def masked_text(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return bind(text_blocks(formatted), lambda blocks: F.array_join(F.transform(spans, lambda s: template.unescape(cut_text(blocks, s["start"], s["end"]))), ""))
