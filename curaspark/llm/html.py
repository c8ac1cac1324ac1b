"""Main text of HTML pages by tag-path ratios.

A scanner reads a page once, in time linear in its length, and cuts it into blocks of text, each in an element of block
level; an element knows its path of tags and class words from the root as a number. For every distinct path the text
length, punctuation, link text and number of blocks are summed; the ratios (text and punctuation per block) are smoothed
over the paths that follow each other in the page, fused into one score and lowered by the share of link text. Paths
above a share of the best score hold content, and all of it is kept. The smallest element that holds nearly all content
gives its other blocks too (headings, short paragraphs), but for paths whose ratios are those of a menu: many short
blocks, nearly all of them links. If that element is the whole body, it gives headings and what stands between content.

Names only weigh: elements whose tag, role, hidden attribute or class and id words name boilerplate have weight 0,
articles and main parts a bonus. A class or id names boilerplate if all its words do so or say nothing (``site-footer``);
words such as ``has`` or ``story`` beside them (``has-sidebar``, ``story-related``) undo that, unless the name is a strong
one (comments, adverts, navigation). An element with a weak name, an aside or a form that holds most of the page's text
is no boilerplate, if no article or main part elsewhere holds text.

Defined results: null or empty html, and pages of boilerplate alone, give an empty text; broken markup is read as far as
it goes (unclosed elements end with their parent, a tag that never ends is dropped with what follows, a quote that never
ends is an ordinary character); repeated rows are read one by one; an empty table gives no rows; extra columns stay, but
for those named text or n_chars.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_STOP = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'<>`]++)))?+""")
_LONG_NUMBER = re.compile(r"&#(?:0*+([0-9]{8,})|[xX]0*+([0-9a-fA-F]{7,}));?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、]")

# Kinds of elements, and words of class, id and role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mi mn mo mrow ms msub msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style noscript template svg iframe textarea title".split()}
#: An element ends the last open one of these kinds within the innermost scope.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table select body article section div".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_WEAK_TAGS = frozenset("aside form menu".split())
_STRONG_TAGS = frozenset("head nav footer button select".split())
_STRONG_WORDS = frozenset(
    "ad ads advert adverts advertisement adbox sponsor sponsored promo promotion cookie cookies consent gdpr nav navbar navigation breadcrumb breadcrumbs "
    "comment comments commentlist disqus reply replies respond share sharing social newsletter subscribe subscription pagination pager".split()
)
_WEAK_WORDS = frozenset(
    "banner notice notices alert popup modal overlay sidebar side menu toolbar header masthead footer foot copyright related recommended recommendations "
    "signup login search widget complementary contentinfo hidden".split()
)
_NEUTRAL_WORDS = frozenset("site page main top bottom left right global box wrap wrapper container inner outer section area block list bar form module unit holder panel row col column items item links link the primary secondary sticky fixed mobile desktop".split())
_MAIN_WORDS = frozenset("article articlebody content entry post posts story main".split())


class _Element:
    __slots__ = ("tag", "path", "boiler", "main", "parent", "plain", "out")

    def __init__(self, tag: str, path: int, boiler: int, main: bool, parent: _Element | None):
        """boiler: 2 strong, 1 weak, 0 no boilerplate by its own name."""
        self.tag, self.path, self.boiler, self.main, self.parent, self.plain, self.out = tag, path, boiler, main, parent, 0, False


def _name_weight(name: str, inside: bool) -> int:
    """Whether a class, id or role names boilerplate: 2 strongly, 1 weakly."""
    words = [w.lower() for w in _WORD.findall(name)]
    strong = any(w in _STRONG_WORDS for w in words)
    weak = any(w in _WEAK_WORDS and not (inside and w in ("header", "masthead")) for w in words)
    rest = [w for w in words if len(w) > 1 and w not in _STRONG_WORDS and w not in _WEAK_WORDS and w not in _NEUTRAL_WORDS]
    if strong and all(w in _MAIN_WORDS for w in rest):
        return 2
    return int(weak and not rest)


class _Page:
    """blocks: (text with white space folded, element, characters in links) in page order; elements: parents first."""

    def __init__(self, page: str):
        self.blocks: list[tuple[str, _Element, int]] = []
        self.root = _Element("", 0, 0, False, None)
        self.elements = [self.root]
        self._paths: dict[tuple[int, str], int] = {}
        self._stack = [self.root]
        self._open: dict[str, list[int]] = defaultdict(list)  # places in the stack
        self._scopes = [0]
        self._held: list[str] = []
        self._linked = self._links = 0
        self._unseen: list[str] = []  # open inline elements of one name that are not shown, the first hides
        self._read(page)

    def _read(self, page: str) -> None:
        at, size, quotes = 0, len(page), True
        last = {q: page.rfind(q) for q in "\"'>"}
        while True:
            start = page.find("<", at)
            if start < 0:
                self._text(page[at:])
                break
            self._text(page[at:start])
            kind = page[start + 1 : start + 2]
            if kind in ("!", "?") or kind == "/" and not page[start + 2 : start + 3].isalpha():
                ends, mark = (page.find("-->", start + 4), 3) if page.startswith("<!--", start) else (page.find(">", start), 1)
                if ends < 0:
                    break
                at = ends + mark
                continue
            closing = kind == "/"
            name = _NAME.match(page, start + 1 + closing)
            if name is None:
                self._text("<")
                at = start + 1
                continue
            if start > last[">"]:
                break  # a tag that never ends
            end = -1
            if quotes and not closing:
                end = self._tag_end(page, name.end(), last)
                quotes = end >= 0  # at most one search in vain
            if end < 0:
                end = page.find(">", start)
            tag, attributes = name[0].lower(), page[name.end() : end]
            at = end + 1
            if closing:
                self._close(tag)
            else:
                self._start(tag, attributes)
                if tag in _RAW:
                    found = _RAW[tag].search(page, at)
                    at = found.start() if found else size
        self._end()

    @staticmethod
    def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
        """Where the tag's > is, outside quotes."""
        while True:
            m = _STOP.search(page, at)
            if m is None:
                return -1
            at = m.start()
            if m[0] == ">":
                return at
            if at < last[m[0]]:
                at = page.find(m[0], at + 1)
            at += 1

    def _text(self, piece: str) -> None:
        if piece and not self._unseen:
            if "&" in piece:
                piece = entities.unescape(_LONG_NUMBER.sub("\ufffd", piece))
            self._held.append(piece)
            if self._links:
                self._linked += len(piece.strip())

    def _end(self) -> None:
        """A block is over."""
        if self._held:
            t = " ".join("".join(self._held).split())
            if t:
                here = self._stack[-1]
                self.blocks.append((t, here, self._linked))
                here.plain += max(len(t) - self._linked, 0)
            self._held.clear()
        self._linked = 0

    def _pop_to(self, size: int) -> None:
        while len(self._stack) > size:
            e = self._stack.pop()
            self._open[e.tag].pop()
            if e.tag in _SCOPES:
                self._scopes.pop()

    def _close(self, tag: str) -> None:
        if tag in _INLINE:
            if self._unseen and self._unseen[-1] == tag:
                self._unseen.pop()
            if tag == "a":
                self._links = 0
            return
        if self._open[tag]:
            self._end()
            self._pop_to(self._open[tag][-1])
            self._links = 0
        elif tag == "p":
            self._end()

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _INLINE:
            if tag == "br":
                self._text(" ")
            elif tag not in _VOID and not attributes.endswith("/"):
                self._links = int(tag == "a" or self._links)
                if self._unseen and self._unseen[-1] == tag or attributes and self._not_shown(dict(self._named(attributes))):
                    self._unseen.append(tag)
            return
        self._end()
        self._links = 0
        self._unseen.clear()
        if tag in _VOID or tag == "body" and self._open["body"]:
            return
        ends = [self._open[t][-1] for t in (*_ENDS.get(tag, ()), "p") if self._open[t] and self._open[t][-1] > self._scopes[-1]]
        if ends:
            self._pop_to(min(ends))
        if tag in _HEADING and self._stack[-1].tag in _HEADING:
            self._pop_to(len(self._stack) - 1)
        self._stack.append(self._element(tag, attributes))
        self.elements.append(self._stack[-1])
        self._open[tag].append(len(self._stack) - 1)
        if tag in _SCOPES:
            self._scopes.append(len(self._stack) - 1)

    @staticmethod
    def _named(attributes: str) -> Iterator[tuple[str, str]]:
        return ((m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes))

    @staticmethod
    def _not_shown(found: dict[str, str]) -> bool:
        return "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()

    def _element(self, tag: str, attributes: str) -> _Element:
        parent = self._stack[-1]
        boiler, main, own = 0, tag in ("article", "main"), tag
        if tag in _STRONG_TAGS or tag in _RAW:
            boiler = 2
        elif tag in _WEAK_TAGS or tag == "header" and not parent.main:
            boiler = 1
        if attributes and not attributes.isspace():
            found = dict(self._named(attributes))
            names = [n for k in ("class", "id", "role") for n in found.get(k, "").split()]
            if tag == "dialog":
                boiler = 1 if "open" in found else 2
            if self._not_shown(found):
                boiler = 2
            elif names and tag not in ("html", "body"):
                weight = max(_name_weight(n, parent.main) for n in names)
                if tag in ("article", "main") and weight < 2:
                    weight = 0
                boiler = max(boiler, weight)
                words = {w.lower() for n in names for w in _WORD.findall(n)}
                main = main or bool(words & _MAIN_WORDS)
                own = f"{tag}.{'.'.join(sorted(words))}"
        elif tag == "dialog":
            boiler = 2
        path = self._paths.setdefault((parent.path, own), len(self._paths) + 1)
        return _Element(tag, path, boiler, not boiler and (main or parent.main), parent)

    def judge_names(self, least: int = 100) -> None:
        """Which elements are out: boilerplate by name and all inside, but for weak names that hold most of the text."""
        for e in self.elements[:0:-1]:
            if e.boiler < 2:
                e.parent.plain += e.plain
        free, mains, whole = [False] * len(self.elements), 0, self.root.plain
        for i, e in enumerate(self.elements):
            parent_main = e.parent is not None and e.parent.main
            free[i] = e.main and not parent_main
        weak_above: dict[int, bool] = {id(self.root): False}
        for i, e in enumerate(self.elements[1:], 1):
            weak_above[id(e)] = bool(e.boiler) or weak_above[id(e.parent)]
            if free[i] and not weak_above[id(e)]:
                mains += e.plain
        for e in self.elements[1:]:
            rescued = mains < least and e.plain >= max(2 * least, whole / 2)
            e.out = e.parent.out or e.boiler == 2 or e.boiler == 1 and not rescued


def _scores(found: list, smooth: float) -> tuple[dict[int, float], set[int]]:
    """Fused score of each path, and the paths of menus."""
    size, marks, linked, count, order, weight = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int), [], {}
    for t, e, k in found:
        if e.path not in count:
            order.append(e.path)
        size[e.path] += len(t)
        marks[e.path] += len(_PUNCTUATION.findall(t))
        linked[e.path] += min(k, len(t))
        count[e.path] += 1
        weight[e.path] = max(weight.get(e.path, 0.0), 0.0 if e.out else 3.0 if e.main else 1.0)
    ratio = [(math.sqrt(size[p]) * size[p] / count[p], marks[p] / count[p]) for p in order]
    out, menus = {}, set()
    for i, p in enumerate(order):
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(order) and weight[order[j]]]
        a, b = ((1 - smooth) * ratio[i][k] + smooth * (sum(ratio[j][k] for j in near) / len(near) if near else ratio[i][k]) for k in (0, 1))
        out[p] = weight[p] * math.log1p(a) * (1 + math.log1p(b)) * (1 - linked[p] / size[p]) ** 2
        if count[p] >= 3 and linked[p] >= 0.8 * size[p] and size[p] < 40 * count[p]:
            menus.add(p)
    return out, menus


def main_text(page: str, smooth: float = 0.2, share: float = 0.5) -> str:
    """The blocks of content, one a line."""
    read = _Page(page)
    read.judge_names()
    found = read.blocks
    if not found:
        return ""
    scores, menus = _scores(found, smooth)
    best = max(scores.values())
    if best <= 0:
        return ""
    chosen = [scores[e.path] >= share * best and not e.out for _, e, _ in found]
    held: dict[int, int] = defaultdict(int)
    for (t, e, _), c in zip(found, chosen, strict=True):
        held[id(e)] += len(t) * c
    total = sum(held.values())
    for e in read.elements[:0:-1]:
        held[id(e.parent)] += held[id(e)]
    holder = next(e for e in reversed(read.elements) if held[id(e)] >= 0.9 * total)  # of nested ones the last began last
    if holder.tag == "p" or holder.tag in _HEADING:
        holder = holder.parent
    while holder.parent is not None and holder.parent.main and holder.main:
        holder = holder.parent
    rest = [not e.out and e.path not in menus for _, e, _ in found]
    if holder.tag in ("", "html", "body"):
        first, last = chosen.index(True), len(chosen) - 1 - chosen[::-1].index(True)
        keep = [c or r and (e.tag in _HEADING or first < i < last) for i, ((_, e, _), c, r) in enumerate(zip(found, chosen, rest, strict=True))]
    else:
        inside = {id(holder)}
        for e in read.elements:
            if id(e.parent) in inside:
                inside.add(id(e))
        keep = [c or r and id(e) in inside for (_, e, _), c, r in zip(found, chosen, rest, strict=True)]
    return "\n".join(t for (t, _, _), c in zip(found, keep, strict=True) if c)


def extract(pages: DataFrame) -> DataFrame:
    """All columns of pages, with text (the main text) and n_chars."""

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in common.leanly(batches):
            yield pd.Series([main_text(x) if x else "" for x in batch], dtype=object)

    out = common.in_small_batches(pages).withColumn("__text", read.asNondeterministic()(F.col("html").cast("string")))
    t = F.col("__text")
    return common.replace_columns(out, {"text": t, "n_chars": F.length(t).cast("long")}).drop("__text")
