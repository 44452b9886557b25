"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Words score positive and tags negative;
the article is the contiguous region of the largest sum, found by one linear scan.
Inside it, tags of block elements part the text into blocks.

The weights come from labelled pages: those whose markup names one ``article``
(else one ``main``) element. A tag costs one, and more the oftener it stands
outside the labelled regions than inside (in powers of two). The weight of a word
lies midway (geometric mean) between the least and the largest of ``WORD_WEIGHTS``
that find the labelled words of a sample best. Tags are counted over all labelled
pages; the word weight is fitted on those with the ``SAMPLE`` smallest hashes (a
parameter; copies of a page count each).

Elements that are never part of an article (menus, adverts, forms, scripts, ...;
the lists below) count as one plain tag each, of cost one: their words score
nothing, and their text is left out where the region encloses them.

Map-only but for the counts of about a hundred tag names, so no key or host can
be hot. Defined results: null html is empty text; a page without words has empty
text and n_chars 0; an element that is not closed reaches to the end of the page,
a left-out one only to the next ``article`` or ``main``; a tag or comment cut by the
end of the page is dropped; of equal regions the first is taken; repeated rows are
extracted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text

#: Labelled pages that the word weight is fitted on, and its candidates.
SAMPLE = 2000
WORD_WEIGHTS = (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0)

# Names of HTML.
LABELS = ("article", "main")
RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
LEFT_OUT = (
    "aside", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "header", "iframe", "input", "menu",
    "nav", "noembed", "noframes", "noscript", "object", "option", "script", "select", "style", "svg", "template",
    "textarea", "title", "xmp",
)
INLINE_PARTS = (
    "button", "canvas", "datalist", "iframe", "input", "noscript", "object", "option", "script", "select", "style",
    "svg", "template", "textarea",
)
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = (
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub",
    "sup", "time", "tt", "u", "var", "wbr",
)
BLOCK = (
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "picture", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "video", "audio",
)
# Words that name such parts in class, id and role.
PARTS = (
    "ad", "ads", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "commentlist", "complementary", "consent", "contentinfo", "cookie", "cookies", "dialog", "discussion",
    "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "outbrain", "pager", "pagination", "popup", "promo", "related", "replies", "reply", "respond",
    "responses", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe",
    "taboola", "toolbar",
)
NEGATIONS = ("no", "has", "with", "without", "is", "not")
OF_ARTICLE = ("article", "entry", "post")

_LABELS, _RAW, _LEFT_OUT, _VOID, _INLINE, _PARTS = map(frozenset, (LABELS, RAW, LEFT_OUT, VOID, INLINE + INLINE_PARTS, PARTS))
_NAMES = frozenset(LABELS + RAW + LEFT_OUT + VOID + INLINE + BLOCK)
_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.DOTALL,
)
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)


class Token(NamedTuple):
    """A text (``name`` empty) or a tag; ``closes``: an end tag; ``out``: one that
    starts a part to leave out, whatever its match."""

    name: str
    text: str
    closes: bool
    out: bool
    words: int


@lru_cache(maxsize=4096)
def _names_a_part(attributes: str) -> tuple[bool, bool]:
    """Whether the attributes name a part to leave out, and whether only as a header."""
    found = set()
    for kind, *values in _NAMED.findall(attributes):
        if kind.lower() == "hidden":
            found.add("hidden")
        for name in " ".join(values).lower().split():
            words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
            if not words or words[0] in NEGATIONS or (words[0] in OF_ARTICLE and words[-1] == "header"):
                continue
            found |= {w for w in (words[0], words[-1]) if w in _PARTS}
    return bool(found), found == {"header"}


def tokens(page: str) -> list[Token]:
    """Texts and tags of a page. Comments, declarations and the content of raw text
    elements are dropped; so is a tag that the end of the page cuts."""
    out, at = [], 0
    depth = 0

    def text(upto: int) -> None:
        if upto > at:
            t = entities.unescape(page[at:upto])
            out.append(Token("", t, False, False, len(t.split())))

    while (m := _MARKUP.search(page, at)) is not None:
        text(m.start())
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name or not m[0].endswith(">"):
            continue
        closes = bool(m[1] or m[4])
        if closes:
            depth -= name in _LABELS
            out.append(Token(name, "", True, False, 0))
            continue
        depth += name in _LABELS
        attributes = m[3] or m[6] or ""
        part, as_header = _names_a_part(attributes) if len(attributes) > 2 else (False, False)
        if depth > 0 and (name == "header" or as_header):
            leave = part and not as_header
        else:
            leave = name in _LEFT_OUT or part
        out.append(Token(name, "", False, leave and name not in _LABELS and name not in ("html", "body"), 0))
        if name in _RAW:
            end = re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
    text(len(page))
    return out


def matches(page: list[Token]) -> list[int]:
    """For each start tag its end tag, by name (or the end of the page)."""
    end, open_ = [len(page)] * len(page), {}
    for i, t in enumerate(page):
        if t.name in _VOID:
            end[i] = i
        elif t.name and not t.closes:
            open_.setdefault(t.name, []).append(i)
        elif t.closes and open_.get(t.name):
            end[open_[t.name].pop()] = i
    return end


def without_parts(page: list[Token]) -> list[Token]:
    """Left-out elements become one tag that costs one. An element that holds an article
    is not left out; one that is not closed ends before the next article."""
    end = matches(page)
    next_label, ahead = [len(page)] * (len(page) + 1), len(page)
    for i in range(len(page) - 1, -1, -1):
        if page[i].name in _LABELS and not page[i].closes:
            ahead = i
        next_label[i] = ahead
    out, i = [], 0
    while i < len(page):
        t = page[i]
        if t.out and not (end[i] < len(page) and next_label[i] < end[i]):
            out.append(t)
            i = end[i] + 1 if end[i] < len(page) else max(next_label[i], i + 1)
        else:
            out.append(t)
            out[-1] = t._replace(out=False)
            i += 1
    return out


def labelled(page: list[Token]) -> tuple[int, int] | None:
    """First and last index inside the one article (else the one main) element."""
    for label in LABELS:
        at = [i for i, t in enumerate(page) if t.name == label and not t.closes]
        if at:
            return (at[0] + 1, matches(page)[at[0]]) if len(at) == 1 else None
    return None


def _key(t: Token) -> str:
    return ("/" if t.closes else "") + (t.name if t.name in _NAMES else "other")


def best_region(page: list[Token], word: float, tags: dict[str, float]) -> tuple[int, int]:
    """[start, end) of the tokens of the largest positive sum: one linear scan."""
    best, region, run, start = 0.0, (0, 0), 0.0, 0
    for i, t in enumerate(page):
        if run <= 0.0:
            run, start = 0.0, i
        if not t.name:
            run += word * t.words
        else:
            run += -1.0 if t.out else tags.get(_key(t), -1.0)
        if run > best:
            best, region = run, (start, i + 1)
    return region


def blocks_of(page: list[Token]) -> str:
    """Blocks of text in page order, joined by two line feeds."""
    blocks, now = [], []

    def close() -> None:
        if block := " ".join("".join(now).split()):
            blocks.append(block)
        now.clear()

    for t in page:
        if not t.name:
            now.append(t.text)
        elif t.name == "br":
            now.append(" ")
        elif t.name not in _INLINE:
            close()
    close()
    return "\n\n".join(blocks)


def extract(page: str, word: float, tags: dict[str, float]) -> str:
    kept = without_parts(tokens(page))
    start, end = best_region(kept, word, tags)
    return blocks_of(kept[start:end])


def _count_tags(column: str):
    """Per batch: how often each tag stands inside and outside labelled regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside, outside = Counter(), Counter()
            for page in each_text(batch.column(column)):
                kept = without_parts(tokens(page or ""))
                if (region := labelled(kept)) is not None:
                    for i, t in enumerate(kept):
                        if t.name and not t.out:
                            (inside if region[0] <= i < region[1] else outside)[_key(t)] += 1
            keys = sorted(inside.keys() | outside.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())],
                names=["tag", "inside", "outside"],
            )

    return run


def _try_weights(column: str, tags: dict[str, float]):
    """Per batch and word weight: labelled words found, missed, and others found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [[0, 0, 0] for _ in WORD_WEIGHTS]
            for page in each_text(batch.column(column)):
                kept = without_parts(tokens(page or ""))
                if (region := labelled(kept)) is None:
                    continue
                want = range(*region)
                words = sum(kept[i].words for i in want)
                for row, w in zip(counts, WORD_WEIGHTS, strict=True):
                    got = range(*best_region(kept, w, tags))
                    both = sum(kept[i].words for i in got if i in want)
                    row[0] += both
                    row[1] += words - both
                    row[2] += sum(kept[i].words for i in got) - both
            columns = [pa.array(WORD_WEIGHTS), *(pa.array([r[k] for r in counts], pa.int64()) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=["weight", "found", "missed", "others"])

    return run


def fit_weights(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> tuple[float, dict[str, float]]:
    """The weight of a word and of each tag, from the labelled pages."""
    has_label = F.col(html).rlike(r"(?i)<(article|main)[\s/>]")
    known = pages.where(has_label).select(F.col(html).alias("_html"))
    counts = known.mapInArrow(_count_tags("_html"), "tag string, inside bigint, outside bigint")
    rows = counts.groupBy("tag").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()  # a row a tag name
    tags = {r["tag"]: -1.0 - max(0.0, math.log2((r["o"] + 1) / (r["i"] + 1))) for r in rows}
    # Only hashes are put in order; the pages stay where they are.
    hashes = known.select(F.xxhash64("_html").alias("h"))
    limit = hashes.distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    few = known.where(F.xxhash64("_html") <= F.lit(limit))
    tried = few.mapInArrow(_try_weights("_html", tags), "weight double, found bigint, missed bigint, others bigint")
    scores = {
        r["weight"]: 2.0 * r["f"] / max(2 * r["f"] + r["m"] + r["o"], 1)
        for r in tried.groupBy("weight").agg(F.sum("found").alias("f"), F.sum("missed").alias("m"), F.sum("others").alias("o")).collect()
    }
    top = [w for w in scores if round(scores[w], 6) == round(max(scores.values()), 6)]
    return (math.sqrt(min(top) * max(top)) if top else 4.0), tags


def extract_main_text(pages: DataFrame, keep: list, word: float, tags: dict[str, float], html: str = "html") -> DataFrame:
    """The columns ``keep`` and ``text``, ``n_chars`` of every row."""
    rows = pages.select(*keep, F.col(html).alias("_html"))
    kept = rows.drop("_html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page or "", word, tags) for page in each_text(batch.column("_html"))]
            columns = [batch.column(c) for c in batch.schema.names if c != "_html"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*(c for c in batch.schema.names if c != "_html"), "text", "n_chars"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return rows.mapInArrow(run, f"{fields}, text string, n_chars bigint")
