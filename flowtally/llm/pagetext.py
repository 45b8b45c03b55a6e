"""Main text of web pages by the ratios of their tag paths."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Elements of HTML by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head script style template noscript iframe object svg math canvas audio video fieldset select textarea button "
                  "datalist nav header footer aside menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr img br input".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What an element closes no further than.
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ROOTS = frozenset({"article", "main"})
#: Words in class, id or role that name what is not the article, unless they name what holds it.
ASIDE = frozenset("ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
                  "disqus footer gdpr header hidden masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pagination "
                  "popup promo promotion related reply replies replylist respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
                  "subscription taboola toolbar widget complementary contentinfo".split())
WORDS = regex.compile(r"[A-Za-z]+")
#: Before such a word it only says something about the page's layout, as in ``no-sidebar``.
LAYOUT = frozenset("no not has have with without hide hides".split())
PUNCTUATION = regex.compile(r"\p{P}")
#: Weights of a block's neighbours and itself when ratios are smoothed.
KERNEL = (0.25, 0.5, 0.25)
#: Share of the best path's score that a path needs.
LEAST = 0.25
#: Share of link text from which a path is a menu.
LINKS = 0.6
#: Text of named articles elsewhere, as a share of an element's own, from which its name decides.
ELSEWHERE = 0.25


@dataclass
class Block:
    path: tuple[str, ...]
    elements: tuple[int, ...]
    #: Text, whether it is linked, and the marked elements around it.
    parts: list[tuple[str, bool, tuple[int, ...]]] = field(default_factory=list)


def _aside_words(value: str) -> set[str]:
    found = set()
    for name in value.split():
        words = [w.lower() for w in WORDS.findall(name)]
        found |= {w for i, w in enumerate(words) if w in ASIDE and (not i or words[i - 1] not in LAYOUT)}
    return found


class _Blocks(HTMLParser):
    """Splits a page into blocks of text with their paths of tags and elements; leaves out elements that never are
    content, and marks forms, elements that class, id or role name aside, and named roots."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []
        self.hidden = self.links = self.count = 0
        self.blocks: list[Block] = []
        self.roots: set[int] = set()
        self.articles: set[int] = set()
        #: The words that name an element aside, by element.
        self.asides: dict[int, frozenset[str]] = {}
        self.marks: tuple[int, ...] = ()
        self.open: Block | None = None

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag, number, hides = self.stack.pop()
            self.hidden -= hides
            if self.marks and self.marks[-1] == number:
                self.marks = self.marks[:-1]
            self.links -= tag == "a"
            if tag not in INLINE:
                self.open = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.open = None
            for i in range(len(self.stack) - 1, -1, -1):  # a block ends an open paragraph
                if self.stack[i][0] == "p":
                    self._pop(i)
                    break
                if self.stack[i][0] not in INLINE:
                    break
            if tag in CLOSES:
                for i in range(len(self.stack) - 1, -1, -1):
                    if self.stack[i][0] in WALLS[tag]:
                        break
                    if self.stack[i][0] in CLOSES[tag]:
                        self._pop(i)
                        break
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        named = {k: v or "" for k, v in attrs}
        aside = set().union(*(_aside_words(named[k]) for k in ("class", "id", "role") if k in named)) if tag not in ("html", "body") else set()
        if tag == "form":
            aside.add("form")
        hides = tag in NEVER or "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "")
        self.count += 1
        self.stack.append((tag, self.count, hides))
        self.hidden += hides
        self.links += tag == "a"
        if tag in ROOTS or named.get("role") == "main":
            self.roots.add(self.count)
        if tag == "article":
            self.articles.add(self.count)
        if aside:
            self.asides[self.count] = frozenset(aside)
        if aside or self.count in self.roots:
            self.marks += (self.count,)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop(i)
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.open is None:
            if not data.strip():
                return
            outer = [s for s in self.stack if s[0] not in INLINE]
            self.open = Block(tuple(s[0] for s in outer), tuple(s[1] for s in outer))
            self.blocks.append(self.open)
        self.open.parts.append((data, self.links > 0, self.marks))

    def unknown_decl(self, data: str) -> None:
        pass

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A section of a name that the parser doesn't know is a comment up to the next angle bracket."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)


_TAG = re.compile(r"<[A-Za-z/!?]")


def _closed(html: str) -> str:
    """The page without a comment or tag at its end that never closes, as browsers read it: no text comes after one,
    and the parser need not look for its end again and again."""
    comment = html.find("<!--", html.rfind("-->") + 1)
    if comment >= 0:
        html = html[:comment]
    tag = _TAG.search(html, html.rfind(">") + 1)
    return html[:tag.start()] if tag else html


def _smooth(values: list[float]) -> list[float]:
    left, mid, right = KERNEL
    n = len(values)
    return [mid * v + left * values[max(0, i - 1)] + right * values[min(n - 1, i + 1)] for i, v in enumerate(values)]


def _left_out(reader: _Blocks) -> set[int]:
    """The marked elements that are left out with all they hold.

    A name alone does not drop what holds the article: an element goes if named roots elsewhere have text of their
    own beside it, or if it holds no named root and all elements of its names together have at most half of the
    page's text. A named root goes only as a part of another article, as comments are.
    """
    if not reader.asides:
        return set()
    held: dict[tuple[int, ...], int] = {}
    for b in reader.blocks:
        for data, _, marks in b.parts:
            held[marks] = held.get(marks, 0) + sum(map(len, data.split()))
    total = sum(held.values())
    own: dict[int, int] = {}
    around: set[int] = set()
    outside: dict[int, tuple[int, ...]] = {}
    for marks, n in held.items():
        for i, e in enumerate(marks):
            own[e] = own.get(e, 0) + n
            outside[e] = marks[:i]
            if n and any(x in reader.roots for x in marks[i + 1:]):
                around.add(e)
    minor = {e for e in own if e in reader.asides and e not in reader.roots and e not in around and 2 * own[e] <= total}
    named: dict[frozenset[str], int] = {}
    for marks, n in held.items():
        for words in {reader.asides[e] for e in marks if e in minor}:
            named[words] = named.get(words, 0) + n
    # a root named aside is no part of another article as long as it lies in none
    doubtful = {e for e in own if e in reader.asides and not (e in reader.roots and reader.articles.isdisjoint(outside[e]))}
    beside: dict[tuple[tuple[int, ...], bool], int] = {}
    out = set()
    for e in own:
        if e not in reader.asides:
            continue
        place = outside[e], e in reader.roots
        if place not in beside:
            above = set(outside[e])
            sides = above & reader.articles if e in reader.roots else reader.roots - above
            beside[place] = sides and sum(n for marks, n in held.items() if not sides.isdisjoint(marks) and not any(x in doubtful and x not in above for x in marks)) or 0
        n = beside[place]
        if n and n >= ELSEWHERE * own[e] or e in minor and 2 * named[reader.asides[e]] <= total:
            out.add(e)
    return out


def main_blocks(html: str) -> list[str]:
    """The article's blocks in page order, white space as single blanks."""
    reader = _Blocks()
    reader.feed(_closed(html))
    reader.close()
    for out in (_left_out(reader), set()):  # a page of nothing but small parts named aside is read by its elements alone
        blocks, texts, linked = [], [], []
        for b in reader.blocks:
            parts = [p for p in b.parts if out.isdisjoint(p[2])] if out else b.parts
            if text := " ".join("".join(p[0] for p in parts).split()):
                blocks.append(b)
                texts.append(text)
                linked.append(sum(len(p[0].strip()) for p in parts if p[1]))
        if blocks:
            break
    if not blocks:
        return []
    sums: dict[tuple, list[float]] = {}
    for b, t, n in zip(blocks, texts, linked):
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        for k, x in enumerate((1, len(t), len(PUNCTUATION.findall(t)), n)):
            s[k] += x
    lengths = _smooth([sums[b.path][1] / sums[b.path][0] for b in blocks])
    points = _smooth([sums[b.path][2] / sums[b.path][0] for b in blocks])
    fused: dict[tuple, list[float]] = {}
    for b, x, y in zip(blocks, lengths, points):
        fused.setdefault(b.path, []).append(math.sqrt(x * (1 + y)))
    menu = {p for p, s in sums.items() if s[3] > LINKS * s[1]}
    score = {p: math.fsum(v) / len(v) for p, v in fused.items() if p not in menu}
    if not score:
        return []
    bound = LEAST * max(score.values())
    chosen = [i for i, b in enumerate(blocks) if score.get(b.path, -1.0) >= bound]
    weight: dict[int, int] = {}
    for i in chosen:
        for e in blocks[i].elements:
            weight[e] = weight.get(e, 0) + len(texts[i])
    total = sum(len(texts[i]) for i in chosen)
    marked = [e for e in weight if e in reader.roots and 2 * weight[e] >= total]
    if marked:  # the innermost named root that has most of the text
        root = max(marked)
    else:  # the innermost element around all content blocks
        around = [e for e in weight if weight[e] == total]
        root = max(around, default=0)
    return [t for b, t in zip(blocks, texts) if b.path not in menu and (not root or root in b.elements)]


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` with text, n_chars (code points) and n_blocks of every page, one row for each row.

    Scripts, menus, headers, footers and asides go by their elements; forms and what is named a sidebar, notice,
    advert or comment go unless they hold the article or most of the text. Text length and punctuation of the blocks left are summed by path of block elements; the ratios per
    block are smoothed along the page, fused as the root of their product, and paths above a share of the
    best one are content. Paths of mostly link text are menus. The element around the content blocks (or the
    named article that holds most of them) gives the text: all its blocks but menus. Null, empty and broken
    html give an empty text or what can be read; nothing is cut. Every page is read on its own.
    """
    fields = [pages.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string, n_chars long, n_blocks int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = [], []
            for value in batch.column(len(keep)):
                found = main_blocks(value.as_py() or "")
                texts.append(" ".join(found))
                sizes.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes, pa.int32())],
                [*keep, "text", "n_chars", "n_blocks"])

    return pages.select(*keep, html_col).mapInArrow(run, schema)
