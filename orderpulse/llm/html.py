"""HTML extraction: words score positive, tags negative, and a linear scan keeps the best contiguous region.

A page becomes a sequence of words and tags. What is never content by its element (menus, footers, sidebars, scripts,
styles) counts as one tag however long it is. So does what a form or a hint of its class, id or role (adverts, notices,
reader comments, ...) sets apart, but only while all of that is a minor share of the page's words: the largest such
elements, likely wrappers, become strongly negative tags until it is, and the scan decides about their words. Weights are the log odds of each kind of word and tag inside and outside the marked content (`article` or
`main`) of pages that mark it; those pages also teach pages that don't. The blocks of the best region are joined.

Defined cases: a null or empty html, or one without content, gives an empty text; a null url or id is returned as it
is; rows that repeat are extracted as often as they come; without marked pages the weights are those of the smoothing,
+0.5 for words and -0.5 for tags; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the weights are learnt from, by hash of their id and text, of those with a tag that marks content.
SAMPLE = 2000
_MARKS = r"(?i)<(?:article|main)[\s/>]"

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|textarea|iframe|title|xmp|noframes|noembed)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("nav aside footer form head button menu dialog label option fieldset".split())
_OUT = frozenset("nav footer aside head template svg select canvas".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar status form".split())
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup social share sharing"
    " related recommended recommendations widget pagination pager login search toolbar copyright disclaimer topbar skip".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: Parts of a class or id that say what a page has or is like, not what the element is ('no-sidebar', 'ad-hoc').
_STATES = frozenset("no not non has have with without on off open closed enabled disabled hoc".split())
#: Elements of running text: a hint in a longer name ('related-work') says nothing there.
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 dt dd blockquote pre em strong b i figcaption".split())
#: Controls that are words of a sentence where they stand in running text, and the blocks of such text.
_SPOKEN = frozenset("button label".split())
_SENTENCES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption".split())
#: Weight of the tags of an element that a hint doesn't exclude, where none was learnt.
_HINT = -4.0
_INLINE = frozenset("a b br i em strong span img".split())
_CLOSES_P = _BLOCKS - {"body", "html", "head"}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _named(name: str, values: str) -> set[str]:
    """The parts of classes and ids that may be hints of an element of this name."""
    found: set[str] = set()
    for value in values.split():
        parts = {p.lower() for p in _PART.findall(value)}
        if not parts & _STATES and (name not in _RUNNING or parts <= _HINTS | _COMMENTS | {"header"}):
            found |= parts
    return found


def _in_sentence(up: "Element | None") -> bool:
    """Whether the nearest block around is one of running text and no form is further up."""
    while up is not None and up.name not in _BLOCKS:
        up = up.up
    if up is None or up.name not in _SENTENCES:
        return False
    while up is not None and up.name not in ("form", "fieldset"):
        up = up.up
    return up is None


class Element:
    """An open or closed element: whether it is out by its kind, whether a hint sets it apart, and what it holds."""

    __slots__ = ("name", "up", "out", "hard", "hinted", "kept", "key", "comment", "marked", "content", "inside", "link", "words", "outermost")

    def __init__(self, name: str, up: "Element | None", attributes: str):
        self.name, self.up, self.content, self.outermost, self.words, self.kept = name, up, False, (), 0, False
        found = {m[0].lower(): (m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(attributes)} if attributes and not attributes.isspace() else {}
        self.key = (name, found.get("class", ""))
        parts = _named(name, found.get("class", "") + " " + found.get("id", "")) if found else set()
        comment = bool(parts & _COMMENTS) and name not in ("html", "body")
        inside = up is not None and up.inside
        self.comment = comment or up is not None and up.comment
        self.marked = name in ("article", "main") and not self.comment
        self.inside = inside or self.marked
        self.link = name == "a" or up is not None and up.link and name not in _BLOCKS
        hidden = "hidden" in found or found.get("aria-hidden", "") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
        hint = bool(parts & _HINTS) or ("header" in parts and not inside) or found.get("role", "").lower() in _ROLES or (name in _NEVER and not (name in _SPOKEN and inside and _in_sentence(up))) or (name == "header" and not inside)
        self.out = bool(hidden) or name in _OUT
        self.hard = self.out or up is not None and up.hard
        # A wrapper with a hint is not out if it holds the marked content.
        self.hinted = comment or hint and name not in ("html", "body", "main", "article")
        if self.marked:
            node = up
            while node is not None and not node.out and not node.content:
                node.content = True
                node = node.up

    def apart(self) -> bool:
        """Whether a hint may exclude it."""
        return self.hinted and not self.content and not self.kept

    def excluded(self) -> "Element | None":
        """The outermost element around it that is out; to be asked when the page is read."""
        way, node = [], self
        while node is not None and node.outermost == ():
            way.append(node)
            node = node.up
        found = None if node is None else node.outermost
        for node in reversed(way):
            node.outermost = found = found or (node if node.out or node.apart() else None)
        return found


class Page:
    """The blocks and tags of a page in order: ("tag", name, element), ("text", raw, element, in a link) or ("gap",)."""

    def __init__(self, source: str | None):
        self.items: list[tuple] = []
        self.open: Counter = Counter()
        self.node = Element("", None, "")
        self.elements = [self.node]
        at = 0
        source = source or ""
        for m in _MARKUP.finditer(source):
            if m.start() > at:
                self._text(source[at:m.start()])
            at = m.end()
            if m[1]:
                continue
            name = m[3] or m[6]
            if not name:
                continue
            self._tag(name.lower(), bool(m[2] or m[5]), m[4] or m[7] or "")
        self._text(source[at:])
        if any(e.apart() and not e.hard for e in self.elements):
            self._keep_wrappers()

    def _keep_wrappers(self) -> None:
        """Keeps the largest elements that are set apart until the others hold a minor share of the words outside links
        of the marked content or, without marks, of the page. Elements of one name and class are kept together; reader
        comments only where there is nothing else."""
        texts = [(i[2], len(i[1].split())) for i in self.items if i[0] == "text" and not i[3] and not i[2].hard]
        others = [t for t in texts if not t[0].comment]
        comments = not any(n for _, n in others)
        texts = texts if comments else others
        marked = any(n and e.inside for e, n in texts)
        total = 0
        for e, n in texts:
            if e.inside or not marked:
                e.words += n
                total += n
        # Elements come after those that hold them.
        for e in reversed(self.elements[1:]):
            e.up.words += e.words
        around: dict[int, int] = {}
        within: dict[int, list[Element]] = {0: []}
        alike: dict[tuple, list[Element]] = {}
        for e in self.elements:
            up = around.get(id(e.up), 0)
            around[id(e)] = up
            if e.apart() and not e.hard and (e.inside or not marked) and (comments or not e.comment):
                within[up].append(e)
                within[id(e)] = []
                around[id(e)] = id(e)
                alike.setdefault(e.key, []).append(e)
        heap: list[tuple] = []
        outer: set[int] = set()
        left, number, enter = 0, 0, within[0]
        while True:
            while enter:
                e = enter.pop()
                if e.kept:
                    enter.extend(within[id(e)])
                else:
                    outer.add(id(e))
                    left, number = left + e.words, number + 1
                    heapq.heappush(heap, (-e.words, number, e))
            if not left or 2 * left < total:
                return
            key = heapq.heappop(heap)[2].key
            for e in alike.pop(key, ()):
                e.kept = True
                if id(e) in outer:
                    left -= e.words
                    enter.extend(within[id(e)])

    def _text(self, raw: str) -> None:
        if raw:
            self.items.append(("text", raw, self.node, self.node.link))

    def _close(self, name: str, stop: frozenset | set) -> None:
        if not self.open[name]:
            return
        node = self.node
        while node.name != name:
            if node.name in stop:
                return
            node = node.up
        while self.node is not node.up:
            self.open[self.node.name] -= 1
            self.node = self.node.up

    def _tag(self, name: str, end: bool, attributes: str) -> None:
        if name == "br":
            self.items.append(("text", " ", self.node, False))
        if end:
            open_before = self.node
            self._close(name, frozenset() if name in _BLOCKS else _BLOCKS)
            self.items.append(("tag", name, open_before))
            return
        if name in _CLOSES_P:
            self._close("p", {"article", "main", "section", "div", "td", "li", "body", "blockquote", "form", "aside", "nav", "footer", "header"})
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._close(name, {"ul", "ol", "menu", "dl", "table"} if name != "tr" else {"table"})
        element = Element(name, self.node, attributes)
        self.elements.append(element)
        if name not in _VOID and not attributes.rstrip().endswith("/"):
            self.node = element
            self.open[name] += 1
        self.items.append(("tag", name, element))


def _kinds(page: Page, marks: bool) -> list[tuple]:
    """Items (kind, block or text): words by kind, tags by name, an excluded element once. With marks, what is outside
    the marked content is a kind of its own; without, the marks are not looked at."""
    found, skipped, marked = [], None, False
    if marks:
        marked = any(i[0] == "text" and not i[1].isspace() and i[2].inside and i[2].excluded() is None for i in page.items)
    for item in page.items:
        node = item[2]
        if (out := node.excluded()) is not None:
            if out is not skipped:
                within = out.up is not None and out.up.inside
                found.append(("out:within" if marked and within else f"out:{out.name if out.name in _BLOCKS else 'inline'}", None, within))
            skipped = out
            if item[0] == "tag":
                found.append(("", item[1], None))
            continue
        skipped = None
        if item[0] == "tag":
            name = "within" if marked and node.inside else "hint" if node.kept else item[1] if item[1] in _BLOCKS or item[1] in _INLINE else "other"
            found.append((f"tag:{name}", item[1], node.inside))
        else:
            kind = "word:outside" if marked and not node.inside else "word:link" if item[3] and not marked else "word"
            found.append((kind, item[1], node.inside))
    return found


def count(source: str | None) -> Counter:
    """(kind, inside the marked content) of a page that marks it; nothing for other pages."""
    page, found = Page(source), Counter()
    for marks in (True, False):
        kinds = _kinds(page, marks)
        if not any(k == "word" and i for k, _, i in kinds):
            return Counter()
        for kind, text, within in kinds:
            if kind:
                found[kind, bool(within)] += len(text.split()) if kind.startswith("word") else 1
    return found


def weigh(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of each kind, halves added; words of content stay positive, tags and all else negative, those within
    marked content the least: they only part its words."""
    kinds = {k for k, _ in counts}
    n_in = sum(v for (_, i), v in counts.items() if i) + len(kinds) / 2
    n_out = sum(v for (_, i), v in counts.items() if not i) + len(kinds) / 2
    found = {}
    for kind in kinds:
        odds = math.log((counts.get((kind, True), 0) + 0.5) / n_in) - math.log((counts.get((kind, False), 0) + 0.5) / n_out)
        found[kind] = min(3.0, max(0.5, odds)) if kind == "word" else max(-8.0, min(-0.001 if kind.endswith(":within") else -0.1, odds))
    return found | {kind: -0.001 for kind in ("tag:within", "out:within") if kind not in found}


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run of the greatest sum, the first and shortest of equals; empty if none is positive."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for k, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += x
        if total > best:
            best, bounds = total, (start, k + 1)
    return bounds


def _in_block(item: tuple) -> bool:
    """Whether an item belongs to the block around it: a word or an inline tag."""
    return item[0] in ("word", "word:link") or item[0].startswith("tag:") and item[1] not in _BLOCKS


def extract(source: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best region, white space made single, joined by an empty line."""
    items = _kinds(Page(source), True)
    scores = []
    for kind, text, _ in items:
        if kind.startswith("word"):
            scores.append(len(text.split()) * weights.get(kind, 0.5 if kind == "word" else -0.5))
        else:
            scores.append(weights.get(kind, _HINT if kind == "tag:hint" else -0.5) if kind else 0.0)
    a, z = best_region(scores)
    # A block is kept whole.
    while a > 0 and z > a and _in_block(items[a]) and _in_block(items[a - 1]):
        a -= 1
    while a < z < len(items) and _in_block(items[z]):
        z += 1
    blocks, now = [], []
    for kind, text, _ in items[a:z]:
        if kind in ("word", "word:link"):
            now.append(text)
        elif text in _BLOCKS and (kind.startswith("tag:") or not kind):
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def fit(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most `sample` pages with an `article` or `main` tag; only the counts of some 150 kinds reach the driver."""
    # Only pages that mark content teach, so that the sample is taken from those, however rare they are.
    hashed = pages.where(F.col("html").rlike(_MARKS)).select("html", F.xxhash64("page_id", "html").alias("h"))
    # The sample's pages are named first, so that only hashes are ordered; equal pages are learnt from as often as they come.
    some = hashed.join(F.broadcast(hashed.select("h").distinct().orderBy("h").limit(sample)), "h")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            total: Counter = Counter()
            for source in frame["html"]:
                total.update(count(source))
            yield pd.DataFrame([(k, i, n) for (k, i), n in total.items()], columns=["kind", "inside", "n"])

    counts = some.mapInPandas(work, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    return weigh({(r["kind"], r["inside"]): r["n"] for r in counts.collect()})


def main_text(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield pd.Series([extract(s, weights) for s in sources], dtype=object)

    return pages.select("page_id", "url", text(F.col("html")).alias("text"))
