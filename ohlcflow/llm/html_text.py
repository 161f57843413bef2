"""Main text of web pages as the maximum-scoring stretch of words and tags.

A page is a sequence of tokens: words score positive, tags negative.  One linear scan finds
the contiguous stretch with the largest sum; its blocks are the main text.

Weights are log odds learned from labelled pages, which are those whose own markup names the
content (an ``article`` or ``main`` element): how often words of a kind lie inside and
outside of it, and tags of a kind.  A word's kind is its innermost block element, a tag's
its name; the label elements themselves are no features, so pages without them are judged
alike.  Kinds never seen have fixed prior weights.  Words never score below zero, tags never
above ``LEAST_TAG``.

Elements that are not content by their meaning (``nav``, ``footer``, ``aside``, ``form``, a class
or role such as ``sidebar`` or ``comments``) are one gap each: their own tags score, their
words score zero and are left out of the text, also inside the stretch.  Scripts, styles,
templates, comments and the head are skipped.

Text: character references are decoded, white space inside a block becomes one space, blocks
are joined in page order by one line end, and blocks without text are left out.  Defined
results: null and empty pages, and pages without a word that scores, give an empty text;
unclosed elements end with the element around them, a ``p`` also where a block begins; a tag
that the page's end cuts off is dropped; rows with equal or null ids are judged one by one;
extra columns are ignored.  A page is held whole by one task.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohlcflow.llm.common import small_batches

#: Weight bounds, and weights of kinds that labelled pages do not show.
MOST = 8.0
LEAST_TAG = -0.1
UNSEEN_WORD = 2.0
UNSEEN_TAG = -0.5
GAP_TAG = -MOST

# Element names of HTML by their role, and names that class, id and role attributes
# give to parts of a page that are not its content.
LABEL_ELEMENTS = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes noscript xmp template svg math".split())
GAP_ELEMENTS = frozenset("nav header footer aside form menu dialog search button select fieldset".split())
GAP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies dialog disqus footer gdpr header login masthead menu modal nav "
    "navbar navigation newsletter notice notices pager pagination popup promo recommended related reply respond search "
    "share sharing sidebar signup sponsor sponsored subscribe subscription toolbar widget widgets".split())
COMMENT_NAMES = frozenset("comment comments disqus reply respond".split())
OPEN_ENDED = frozenset("has with no without".split())  # "has-sidebar" tells of a part, it is not one

_ATTRIBUTES = r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+"
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>|<[!?/][^>]*+>", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CUT_OFF = re.compile(r"<[a-zA-Z!?/]")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_PART = re.compile(r"[\s_\-]+")


@dataclass(slots=True)
class Token:
    """A tag (``words`` 0) or a run of words of one kind."""

    kind: str
    words: int
    inside: bool  # of a label element
    gap: bool  # of an element that is no content
    text: str = ""
    breaks: bool = False  # a block begins or ends here


def gap_name(name: str, attributes: str) -> str:
    """What makes an element a gap: its own name or one in its attributes; empty if nothing does."""
    if name in GAP_ELEMENTS:
        return name
    if "=" in attributes and name not in ("html", "body", "main"):
        for found in _NAMES.findall(attributes):
            for value in "".join(found).lower().split():
                parts = _PART.split(value)
                if not OPEN_ENDED.intersection(parts):
                    for part in parts:
                        if part in GAP_NAMES:
                            return "." + part
    return ""


class _Open:
    """Elements that are open, innermost last: (name, block kind, gap name, inside a label element)."""

    def __init__(self):
        self.stack = [("", "body", "", False)]
        self.names: Counter = Counter()

    def push(self, name: str, gap: str) -> None:
        _, block, around, inside = self.stack[-1]
        if name in LABEL_ELEMENTS:
            if around in ("nav", "header"):  # cannot hold content: its end tag is missing
                around = ""
            inside = inside or not (gap or around)
        elif name == "header" and inside:  # of the article, not of the page
            gap = ""
        self.stack.append((name, name if name in BLOCKS else block, around or gap, inside))
        self.names[name] += 1

    def pop(self, name: str) -> bool:
        """Close the innermost ``name`` and all inside it; whether one was open."""
        if not self.names[name]:
            return False
        while True:
            gone = self.stack.pop()[0]
            self.names[gone] -= 1
            if gone == name:
                return True

    @property
    def top(self) -> tuple[str, str, str, bool]:
        return self.stack[-1]


def tokens_of(page: str) -> list[Token]:
    last = page.rfind(">") + 1
    cut = _CUT_OFF.search(page, last)
    page = page[:cut.start()] if cut else page
    out: list[Token] = []
    open_ = _Open()

    def words(a: int, b: int) -> None:
        if a < b:
            text = page[a:b]
            n = len(text.split())
            _, block, gap, inside = open_.top
            out.append(Token(block, n, inside and not gap, bool(gap), text))

    at = 0
    while m := _MARKUP.search(page, at):
        words(at, m.start())
        at = m.end()
        closing, name, attributes = m[1], m[2], m[3]
        if not name:
            continue
        name = name.lower()
        if closing:
            gap, inside = open_.top[2], open_.top[3]
            if open_.names[name]:
                while open_.top[0] != name:
                    open_.pop(open_.top[0])
                _, _, gap, inside = open_.top
                open_.pop(name)
                edge = bool(gap) and not open_.top[2]
            else:
                edge = False
        else:
            if name == "p" or name in BLOCKS:
                while open_.names["p"] and _p_in_scope(open_):
                    open_.pop("p")
            if name == "li" and _in_scope(open_, "li", ("ul", "ol", "menu")):
                open_.pop("li")
            before = open_.top[2]
            own = gap_name(name, attributes)
            if name in RAW:
                gap, inside, edge = open_.top[2], open_.top[3], False
                end = _RAW_END[name].search(page, at) if not attributes.endswith("/") else None
                at = end.start() if end else at if attributes.endswith("/") else len(page)
            elif name in VOID:
                gap, inside, edge = before, open_.top[3], False
            else:
                open_.push(name, own)
                gap, inside = open_.top[2], open_.top[3]
                edge = bool(gap) and not before
        if gap and not edge:
            kind = ""  # within a gap nothing scores
        elif gap:
            kind = gap
        else:
            kind = name if name in BLOCKS or name in VOID or name in RAW else "inline"
        out.append(Token(kind and closing + kind, 0, inside and not gap, bool(gap), " " if name in ("br", "wbr") else "",
                         name in BLOCKS))
    words(at, len(page))
    return out


def _in_scope(open_: _Open, name: str, bounds: tuple[str, ...]) -> bool:
    if not open_.names[name]:
        return False
    for element in reversed(open_.stack):
        if element[0] == name:
            return True
        if element[0] in bounds:
            return False
    return False


def _p_in_scope(open_: _Open) -> bool:
    for element in reversed(open_.stack):
        if element[0] == "p":
            return True
        if element[0] in BLOCKS:
            return False
    return False


@dataclass(frozen=True)
class Weights:
    words: dict[str, float]
    tags: dict[str, float]

    def of(self, token: Token) -> float:
        if token.words:
            return 0.0 if token.gap else token.words * self.words.get(token.kind, UNSEEN_WORD)
        if not token.kind:
            return 0.0
        return self.tags.get(token.kind, GAP_TAG if token.gap else UNSEEN_TAG)


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """First shortest stretch with the largest positive sum, as [begin, end); (0, 0) if none."""
    best, begin, end = 0.0, 0, 0
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0.0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, begin, end = total, start, i + 1
    return begin, end


def main_text(page: str, weights: Weights) -> str:
    tokens = tokens_of(page)
    begin, end = best_stretch([weights.of(t) for t in tokens])
    blocks: list[list[str]] = [[]]
    for t in tokens[begin:end]:
        if t.breaks and blocks[-1]:
            blocks.append([])
        if t.text and not t.gap:
            blocks[-1].append(html.unescape(t.text) if "&" in t.text else t.text)
    return "\n".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def fit(pages: DataFrame) -> Weights:
    """Weights from all labelled rows of ``pages``; what reaches the driver is one row a kind, of
    which there are at most as many as the fixed names above."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for page in b.column("html").to_pylist():
                tokens = tokens_of(page)
                if any(t.inside and t.words for t in tokens):
                    for t in tokens:
                        if t.kind and t.kind.lstrip("/") not in LABEL_ELEMENTS and not (t.gap and t.words):
                            seen[t.kind, t.words > 0, t.inside] += max(1, t.words)
        if seen:
            kinds, is_word, inside = zip(*seen, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(is_word, pa.bool_()), pa.array(inside, pa.bool_()),
                 pa.array(seen.values(), pa.int64())], names=["kind", "is_word", "inside", "n"])

    label = F.rlike(F.col("html"), F.lit("(?i)<(?:" + "|".join(sorted(LABEL_ELEMENTS)) + r")[\s>]"))
    parts = pages.filter(label).select("html").mapInArrow(run, "kind string, is_word boolean, inside boolean, n long")
    counts: dict[tuple[bool, str], dict[bool, int]] = {}
    for r in parts.groupBy("kind", "is_word", "inside").agg(F.sum("n").alias("n")).collect():
        counts.setdefault((r.is_word, r.kind), {})[r.inside] = r.n
    words, tags = {}, {}
    for (is_word, kind), n in counts.items():
        odds = math.log((n.get(True, 0) + 0.5) / (n.get(False, 0) + 0.5))
        if is_word:
            words[kind] = min(max(odds, 0.0), MOST)
        else:
            tags[kind] = max(min(odds, LEAST_TAG), -MOST)
    return Weights(words, tags)


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """``page_id``, ``url``, and the main text of ``html`` as ``text`` of every row."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, weights) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
