"""Main text of web pages by composite text density.

The page is parsed into a tree (a forgiving parser: void and implied end tags, raw text of
scripts, comments, tags cut off at the end).  What is never article text by its element or
role goes first: menus, headers, footers, sidebars, notices, forms, scripts and styles.  The header
of an article is part of it; a form that wraps the page or holds the article is only a wrapper.
Class and id words are hints and count with size, place and link share: a block named for
furniture alone (``ad``, ``cookie-notice``, ``sidebar-left``, ``comments``) goes unless it holds the article or,
on a page without such an element, most of the text; a paragraph so named goes only if it is short or mostly links; a name that
merely contains such a word (``related-work``, ``form-of-verbs``) says nothing unless the block is
mostly links.  For every node left

    density = C / T * log(C / LC * T / LT) to the base ln(C / nLC * LC + LCb / Cb * C + e)

with C characters, T tags, LC and LT those inside links, nLC characters outside links, and
b the body.  A node's sum is that of its children's densities.  The node with the largest
sum is the core; the smallest density on its path to the body is the threshold, and in
every part of the body whose density reaches it the node with the largest sum is content.
A core that is only a paragraph or a piece of one stands for the element around it, and a core
inside an ``article`` (or else ``main``) brings along the rest of that element, such as its title and
its short paragraphs; what the densities chose elsewhere stays chosen.  Of equal sums the
node with more text wins, then the first.

Text: character references decoded, white space inside a block made one space, blocks
trimmed and joined in page order by two newlines; ``br`` is white space.  A null or empty
page, or one without content, gives the empty text.  Nothing is capped.  Repeated rows give
a row each, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"caption", "option", "optgroup", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}
#: start tag -> (open elements that it ends, elements at which the search stops)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
DROPPED = frozenset(
    "script style noscript template iframe object svg canvas annotation annotation-xml head title nav footer aside button input select textarea option "
    "label fieldset dialog menu audio video applet search".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promos promotion banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead footer copyright sidebar sidebars aside "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "share sharing social related recommended widget widgets form".split()
)
#: names that a single line of furniture bears
LINE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsored promo promos copyright cookie cookies consent gdpr newsletter subscribe subscription paywall".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: words that only say where or of what shape a block is
SHAPE_WORDS = frozenset(
    "site page main top bottom left right side box boxes container wrapper wrap list item items area block section inner outer primary secondary "
    "global sticky fixed bar link links row col column grid panel group module slot unit zone desktop mobile user reader readers visitor thread js is has".split()
)
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote span b i em strong a small font cite q code mark u s sub sup time abbr figcaption caption".split())
SHORT_WORDS, LINKED, MOST = 25, 1 / 3, 1 / 2
INLINE = frozenset("span b i em strong a small font cite q code mark u s sub sup time abbr".split())
HEADINGS = frozenset(("h1", "h2", "h3"))
HOLDERS = frozenset(("article", "main"))
CONTAINERS = frozenset(("article", "main", "section", "div", "td", "body", "html", "table", "blockquote", "center", "#root"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


#: how sure an element's own tag and names are that it is furniture
NONE, HINT, NAMED, TOLD, COMMENTS, WRAPPER, HEADER, CERTAIN = range(8)


def _kind(tag: str, attrs: str) -> int:
    if tag in DROPPED:
        return CERTAIN
    if tag in HOLDERS or tag in ("body", "html"):
        return NONE
    kind = HEADER if tag == "header" else WRAPPER if tag == "form" else NONE
    for name, *values in _ATTR.findall(attrs) if attrs else ():
        value = values[0] or values[1] or values[2]
        if name.lower() == "role":
            kind = max(kind, NAMED if value.strip().lower() in DROPPED_ROLES else NONE)
        else:
            for token in value.split():
                words = {w.lower() for w in _WORDS.findall(token)}
                if words & (FURNITURE_WORDS | COMMENT_WORDS):
                    alone = not words - FURNITURE_WORDS - COMMENT_WORDS - SHAPE_WORDS
                    kind = max(kind, (COMMENTS if words & COMMENT_WORDS else TOLD if words & LINE_WORDS else NAMED) if alone else HINT)
    return kind


class Page:
    """Nodes as parallel lists, a parent always before its children; texts and block edges as events in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.kind, self.events = ["#root"], [-1], [NONE], []
        stack, at, low = [0], 0, None
        for m in _TOKEN.finditer(source):
            if m.start() < at:  # inside raw text
                continue
            if m.start() > at:
                self._text(stack, source[at : m.start()])
            at = m.end()
            tag = (m["tag"] or m["tag2"] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self._text(stack, m[0][9:].removesuffix("]]>"))
                continue
            if m["end"] or m["end2"]:
                self._close(stack, tag)
                continue
            if m["tag2"] and not m[0].endswith(">"):
                continue  # cut off at the end of the page
            attrs = m["attrs"] or m["attrs2"] or ""
            self._open(stack, tag, attrs)
            if tag in RAW:
                low = source.lower() if low is None else low
                end = low.find(f"</{tag}", at)
                at = len(source) if end < 0 or len(low) != len(source) and (end := self._find(source, tag, at)) < 0 else end
        if at < len(source):
            self._text(stack, source[at:])

    @staticmethod
    def _find(source: str, tag: str, at: int) -> int:
        m = re.compile(f"</{tag}", re.I | re.A).search(source, at)
        return m.start() if m else -1

    def _text(self, stack: list[int], text: str) -> None:
        self.events.append((stack[-1], text))

    def _edge(self, node: int, tag: str) -> None:
        if tag in BLOCK:
            self.events.append((node, None))

    def _pop_to(self, stack: list[int], depth: int) -> None:
        while len(stack) > depth:
            n = stack.pop()
            self._edge(n, self.tag[n])

    def _close(self, stack: list[int], tag: str) -> None:
        if tag == "br":
            self.events.append((stack[-1], " "))
        for k in range(len(stack) - 1, 0, -1):
            name = self.tag[stack[k]]
            if name == tag:
                return self._pop_to(stack, k)
            if name in ("td", "th", "table", "article", "main", "body") and tag not in BLOCK:
                return None  # a stray inline end tag does not leave its block
        return None

    def _open(self, stack: list[int], tag: str, attrs: str) -> None:
        if tag == "br":
            self.events.append((stack[-1], " "))
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                name = self.tag[stack[k]]
                if name == "p":
                    self._pop_to(stack, k)
                    break
                if name in CONTAINERS or name in ("li", "dd", "th", "button"):
                    break
        if tag in IMPLIED:
            ended, stop = IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1):
                name = self.tag[stack[k]]
                if name in stop:
                    break
                if name in ended:
                    self._pop_to(stack, k)
                    if tag not in ("tr",):
                        break
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.kind.append(_kind(tag, attrs))
        self._edge(node, tag)
        if tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
        elif tag not in VOID and tag in BLOCK | {"span", "a", "b", "i", "em", "strong"}:
            stack.append(node)  # html ignores the slash on these

    def _prune(self) -> None:
        """``drop``: is the node in furniture, from its kind and the size, place and link share of its text."""
        tag, parent, kind, n = self.tag, self.parent, self.kind, len(self.tag)
        chars, linked, words, holds = [0] * n, [0] * n, [0] * n, [False] * n
        certain, link, inside = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            p = parent[i]
            certain[i] = certain[p] or kind[i] == CERTAIN
            link[i] = link[p] or tag[i] == "a"
            inside[i] = inside[p] or tag[p] in HOLDERS
        for i, text in self.events:
            if text is not None and not certain[i]:
                parts = text.split()
                c = sum(map(len, parts))
                chars[i] += c
                linked[i] += c * link[i]
                words[i] += len(parts)
        for i in range(n - 1, 0, -1):
            p = parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            words[p] += words[i]
            holds[p] = holds[p] or holds[i] or tag[i] in HOLDERS
        self.drop = [False] * n
        speaks = [False] * n  # has text of its own beside its elements
        last = [-1] * n  # its last text in page order
        for k, (i, text) in enumerate(self.events):
            if text is not None and text.strip():
                speaks[i], last[i] = True, k
        for i in range(n - 1, 0, -1):
            last[parent[i]] = max(last[parent[i]], last[i])
        told = any(tag[i] in HOLDERS and chars[i] for i in range(1, n))  # the page says itself where its text is
        for i in range(1, n):
            mostly_links = linked[i] >= LINKED * chars[i]
            if kind[i] == NONE:
                gone = False
            elif kind[i] == CERTAIN:
                gone = True
            elif kind[i] == HEADER:
                gone = not inside[i]
            elif holds[i]:
                gone = False
            elif kind[i] == HINT:
                gone = mostly_links
            elif tag[i] in TEXT_LEVEL and kind[i] != WRAPPER:  # names alone take no text: a sentence keeps its words, a page its headings
                if tag[i] in INLINE and speaks[parent[i]]:
                    gone = False
                else:  # a line that says of itself what it is goes from the end of its block
                    gone = mostly_links or tag[i] not in HEADINGS and (kind[i] == COMMENTS or kind[i] == TOLD and last[i] == last[parent[i]])
            else:
                gone = kind[i] == COMMENTS or mostly_links or told or words[i] < SHORT_WORDS or chars[i] < MOST * chars[0]
            self.drop[i] = self.drop[parent[i]] or gone

    def content(self) -> list[int]:
        """The nodes whose whole text is content."""
        self._prune()
        tag, parent, n = self.tag, self.parent, len(self.tag)
        link = [False] * n
        for i in range(1, n):
            link[i] = link[parent[i]] or tag[i] == "a"
        C, LC, T, LT = [0] * n, [0] * n, [0] * n, [0] * n
        for i, text in self.events:
            if text is not None and not self.drop[i]:
                c = sum(map(len, text.split()))
                C[i] += c
                LC[i] += c * link[i]
        for i in range(n - 1, 0, -1):
            if not self.drop[i]:
                p = parent[i]
                C[p] += C[i]
                LC[p] += LC[i]
                T[p] += T[i] + 1
                LT[p] += LT[i] + (tag[i] == "a")
        body = next((i for i in range(n) if tag[i] == "body"), 0)
        cb, lcb = max(1, C[body]), LC[body]
        density = [0.0] * n
        for i in range(n):
            if C[i] and not self.drop[i]:
                t, lc, lt, plain = max(1, T[i]), max(1, LC[i]), max(1, LT[i]), max(1, C[i] - LC[i])
                base = math.log(C[i] / plain * LC[i] + lcb / cb * C[i] + math.e)
                density[i] = C[i] / t * max(0.0, math.log(C[i] / lc * t / lt) / math.log(base)) if base > 1 + 1e-12 else C[i] / t * math.log(max(1.0, C[i] * t))
        total = [0.0] * n
        for i in range(1, n):
            total[parent[i]] += density[i]
        if not C[body]:
            body = 0
        if not C[body]:
            return []
        inside = [False] * n
        inside[body] = True
        for i in range(body + 1, n):
            inside[i] = inside[parent[i]] and not self.drop[i]
        core = max((i for i in range(n) if inside[i] and C[i]), key=lambda i: (total[i], C[i], -i))
        threshold, i = density[core], core
        while i != body:
            i = parent[i]
            threshold = min(threshold, density[i])
        best = list(range(n))  # the node with the largest sum in each subtree
        for i in range(n - 1, body, -1):
            if inside[i] and (total[best[i]], -best[i]) > (total[best[parent[i]]], -best[parent[i]]):
                best[parent[i]] = best[i]
        chosen, covered = set(), [False] * n
        for i in range(body, n):
            covered[i] = i > body and covered[parent[i]]
            if inside[i] and C[i] and not covered[i] and density[i] >= threshold - 1e-9 and (i != body or core == body):
                target = self._widen(best[i], body)
                chosen.add(target)
                if target <= i:
                    covered[i] = True
        chosen.add(self._widen(core, body))
        chosen |= {h for c in chosen if (h := self._holder(c)) is not None}  # an article comes whole
        if self._holder(core) is None:
            chosen |= self._headline(self._widen(core, body), body, inside, C, LC)
        return sorted(chosen)

    def _holder(self, i: int) -> int | None:
        """The outermost article around a node, or else main."""
        article = main = None
        while i > 0:
            if self.tag[i] == "article":
                article = i
            elif self.tag[i] == "main":
                main = i
            i = self.parent[i]
        return article if article is not None else main

    def _headline(self, core: int, body: int, inside: list[bool], C: list[int], LC: list[int]) -> set[int]:
        """What stands before the core in the nearest wrapper that has a heading there, from that heading on; nothing if the core has one."""
        tag, parent, n = self.tag, self.parent, len(self.tag)
        headed = [inside[i] and tag[i] in HEADINGS and C[i] > 0 for i in range(n)]
        for i in range(n - 1, 0, -1):
            headed[parent[i]] = headed[parent[i]] or headed[i]
        if headed[core]:
            return set()
        while core != body:
            before = [i for i in range(parent[core] + 1, core) if parent[i] == parent[core] and inside[i] and C[i] and LC[i] < LINKED * C[i]]
            first = max((i for i in before if headed[i]), default=None)
            if first is not None:
                return {i for i in before if i >= first}
            core = parent[core]
        return set()

    def _widen(self, i: int, body: int) -> int:
        while i != body and i > 0 and self.tag[i] not in CONTAINERS:
            i = self.parent[i]
        return i

    def text(self) -> str:
        chosen = set(self.content())
        if not chosen:
            return ""
        n = len(self.tag)
        on = [i in chosen for i in range(n)]
        for i in range(1, n):
            on[i] = (on[i] or on[self.parent[i]]) and not self.drop[i]
        blocks, parts = [], []
        for i, text in [*self.events, (0, None)]:
            if text is None:
                if parts and (block := " ".join(_html.unescape("".join(parts)).split())):
                    blocks.append(block)
                parts = []
            elif on[i]:
                parts.append(text)
        return "\n\n".join(blocks)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def _extract(batches):
    for b in batches:
        texts = [main_text(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
