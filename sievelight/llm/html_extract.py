"""HTML main-text extraction by a minimum cut over the blocks of each page.

A page becomes a list of text blocks with their place in the DOM. A small linear classifier turns each block's features
into log-odds, the terminal capacities. Neighbouring blocks, the more of the DOM path they share, and blocks of the same
parent are tied by smoothness edges of the same scale, so a block without telling features goes with its surroundings,
but no tie leads into or out of a subtree whose tag or names announce adverts, asides, notices, comments and the like,
and standing inside the article doesn't speak for such a subtree. The minimum cut labels all blocks at once; its source side is the main text.

Text that is never shown (scripts, styles, the head, and so on) makes no blocks; menus, footers and forms do, with costs
of their own. A node whose terminal costs differ by more than all its ties can't change sides, so it's settled before
the max-flow and its ties become costs of its neighbours; that keeps the cut exact and the flow network small.

Parsing takes time in proportion to the page, however its tags are nested or left open.

Edge cases: null or empty html gives an empty text; markup that never closes is closed at the end of the page; very long
pages are handled whole; a node that either side of the cut would hold at the same cost is boilerplate; repeated pages
give repeated rows; an empty table gives an empty result; only the columns asked for are kept.
"""

from __future__ import annotations

import html as _html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm import textscan as ts

# Fixed element lists of HTML.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas".split())
NEVER = frozenset("script style noscript template head button select textarea iframe svg math object canvas title option".split())
FRAME = frozenset("nav footer form menu dialog".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*>")
_ATTR = re.compile(r"(?i)\b(class|id|role|aria-label|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
# Fixed word patterns of class, id and role.
BAD = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|sidebar|side|aside|widget\w*|menu|nav\w*|breadcrumbs?|header|masthead|footer|foot|cookie\w*|consent|notice\w*|notification|gdpr|popup|modal|overlay|comments?|commentlist|disqus|replies|reply|respond|related|recommend\w*|share\w*|sharing|social|subscribe|newsletter|signup|login|search|toolbar|pagination|pager|copyright|legal|disclaimer|tags?|alert|complementary|contentinfo|navigation|hidden)(?=$|[\s_-])")
GOOD = re.compile(r"(?i)(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|text|body|article-?body|hentry|page-?content)(?=$|[\s_-])")
#: What may turn out to be content once the page is known: headers within named content, articles within noise.
TITLE, ARTICLE = "title", "article"
#: Of the bad words, those that name a title where an article is open.
TITLES = frozenset(("header", "masthead"))
_SPACE = re.compile(r"\s+")


IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Block:
    __slots__ = ("text", "node", "tag", "links", "bad", "good", "frame", "noise", "held")

    def __init__(self, text, node, tag, links, bad, good, frame, noise, held):
        self.text, self.node, self.tag, self.links, self.bad, self.good, self.frame, self.noise, self.held = text, node, tag, links, bad, good, frame, noise, held


class Page:
    """The text blocks of a page in order, and the tree of its elements: the parent and depth of each, the root being 0."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parent, self.depth = [0], [0]
        self.has_article = False
        # Open elements: tag, node, never shown, bad, good, frame, outermost element of noise (0: none), TITLE
        # or ARTICLE; places of the block elements among them; how often each tag is open.
        self._stack: list[tuple[str, int, bool, int, int, bool, int, str]] = [("", 0, False, 0, 0, False, 0, "")]
        self._block_at: list[int] = []
        self._open: dict[str, int] = {}
        self._text: list[str] = []
        self._linked = 0
        self._read(page)

    def _flush(self) -> None:
        if self._text:
            joined = _SPACE.sub(" ", _html.unescape("".join(self._text))).strip()
            _, node, never, bad, good, frame, noise, held = self._stack[-1]
            if joined and not never:
                tag = self._stack[self._block_at[-1]][0] if self._block_at else ""
                self.blocks.append(Block(joined, node, tag, min(1.0, self._linked / len(joined)), bad, good, frame, noise, held))
        self._text, self._linked = [], 0

    def _pop(self) -> str:
        tag = self._stack.pop()[0]
        self._open[tag] -= 1
        if self._block_at and self._block_at[-1] == len(self._stack):
            self._block_at.pop()
        return tag

    def _words(self, piece: str) -> None:
        if piece and not self._stack[-1][2]:
            self._text.append(piece)
            if self._open.get("a"):
                self._linked += len(piece)

    def _read(self, page: str) -> None:
        at, last = 0, page.rfind(">")
        while (mark := page.find("<", at)) >= 0:
            if page.startswith("<!--", mark):
                self._words(page[at:mark])
                end = page.find("-->", mark + 4)
                at = len(page) if end < 0 else end + 3
                continue
            name = _NAME.match(page, mark)
            if name is None and page[mark + 1 : mark + 2] not in ("!", "?") or mark > last:
                self._words(page[at : mark + 1])
                at = mark + 1
                continue
            self._words(page[at:mark])
            if page.startswith("<![CDATA[", mark):
                end = page.find("]]>", mark)
                at = len(page) if end < 0 else end + 3
                continue
            rest = _REST.match(page, name.end()) if name else None
            at = rest.end() if rest else page.find(">", mark) + 1
            if name is None:
                continue
            tag = name[1].lower()
            if page[mark + 1] == "/":
                self._end(tag)
            elif self._start(tag, page[name.end() : at - 1]) and tag in RAW:
                close = re.compile(rf"(?i)</{re.escape(tag)}\s*>").search(page, at)
                at = len(page) if close is None else close.start()
        self._words(page[at:])
        self._flush()
        self._settle()

    def _settle(self) -> None:
        """Without an article, headers of the named content are its titles; without that too, noise may be a frame around it all."""
        if not self.has_article:
            for b in self.blocks:
                if b.held == TITLE:
                    b.bad, b.good, b.noise = 0, 1, 0
        if not any(b.good and not b.noise for b in self.blocks):
            size: dict[int, int] = {}
            for b in self.blocks:
                if b.held == ARTICLE:
                    size[b.noise] = size.get(b.noise, 0) + len(b.text)
            around = max(size, key=size.__getitem__, default=None)  # the frame is what holds the longest articles
            for b in self.blocks:
                if b.held == ARTICLE and b.noise == around:
                    b.bad, b.good, b.noise, self.has_article = 0, 1, 0, True

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if self._open.get(tag):
            while True:
                if self._stack[-1][0] in BLOCK:
                    self._flush()
                if self._pop() == tag:
                    return

    def _start(self, tag: str, attributes: str) -> bool:
        """Whether the element is open now."""
        if tag == "br":
            self._words(" ")
            return False
        if tag in BLOCK:
            self._flush()
        if (tag in CLOSES_P or tag in IMPLIED) and self._block_at and self._stack[self._block_at[-1]][0] in IMPLIED.get(tag, ("p",)):
            keep = self._block_at[-1]  # with the inline elements in it
            while len(self._stack) > keep:
                self._pop()
        if tag in VOID:
            return False
        _, node, never, bad, good, frame, noise, held = self._stack[-1]
        never, inside = never or tag in NEVER, bool(self._open.get("article") or self._open.get("main"))
        odd, head = tag == "aside", tag == "header"
        named = ""
        if attributes:
            attrs = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attributes)}
            named = " ".join(attrs.get(k, "") for k in ("class", "id", "role", "aria-label", "itemprop"))
            never = never or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
            if named and tag not in ("html", "body"):  # their names tell of the layout
                words = {m[0].strip(" \t\n\r\f_-").lower() for m in BAD.finditer(named)}
                odd, head = odd or bool(words - TITLES), head or bool(words)
        title = head and not odd and not inside and not noise and good > 0
        odd = odd or head and not inside
        main = tag == "main" and not inside or tag == "article" and not noise
        held = TITLE if title else "" if odd else held or (ARTICLE if tag == "article" and noise and bad == 1 else "")
        if odd:
            # A subtree that announces itself as noise doesn't share in the goodness around it.
            bad, good = bad + 1, 0
        if main or not (noise or odd) and named and GOOD.search(named):
            good += 1 + (main and not (noise or odd) and bool(named and GOOD.search(named)))
            noise = noise if odd or not main else 0
        if (odd or tag in FRAME) and not noise:
            noise = len(self.parent)
        self.has_article |= main
        if attributes.endswith("/") and tag not in BLOCK:
            return False
        self.parent.append(node)
        self.depth.append(self.depth[node] + 1)
        if tag in BLOCK:
            self._block_at.append(len(self._stack))
        self._stack.append((tag, len(self.parent) - 1, never, bad, good, frame or tag in FRAME, noise, held))
        self._open[tag] = self._open.get(tag, 0) + 1
        return True

    def shared(self, a: int, b: int) -> int:
        """The elements, with the root, that hold both; from one block to the next that takes as many steps as the parser took."""
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
        return self.depth[a] + 1


# Weights of the linear block classifier, as log-odds: positive is content.
BIAS, W_GOOD, W_BAD, W_FRAME, W_OUTSIDE, W_LENGTH, W_LINK, W_HEADING, W_STOP, W_PARAGRAPH = -0.6, 1.6, -3.2, -6.0, -1.2, 0.5, -1.6, 0.4, 0.4, 0.5
TIE_NEXT, TIE_PARENT = 1.2, 0.8


def score(b: Block, has_article: bool) -> float:
    """The log-odds of a block. ``outside``: the page names its article, and the block isn't in it."""
    words = b.text.count(" ") + 1
    outside = has_article and not b.good
    return (
        BIAS + W_GOOD * min(b.good, 2) + W_BAD * min(b.bad, 2) + W_FRAME * b.frame + W_OUTSIDE * outside + W_LENGTH * min(3.0, words / 12) + W_LINK * b.links * (1 if words < 40 else 0.3)
        + W_HEADING * (b.tag in HEADINGS) + W_STOP * (b.text[-1] in ".!?…\"'”") + W_PARAGRAPH * (b.tag in ("p", "blockquote", "pre"))
    )


def ties(page: Page) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in the page, stronger the more of the DOM path they share, and the next block of the same parent.

    None crosses the border of a subtree that announces itself as noise.
    """
    edges, last, found = [], {}, page.blocks
    for i, b in enumerate(found):
        if i and found[i - 1].noise == b.noise:
            p = found[i - 1]
            edges.append((i - 1, i, TIE_NEXT * page.shared(b.node, p.node) / (max(page.depth[b.node], page.depth[p.node]) + 1)))
        parent = page.parent[b.node]
        if parent in last and last[parent] != i - 1 and found[last[parent]].noise == b.noise:
            edges.append((last[parent], i, TIE_PARENT))
        last[parent] = i
    return edges


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source (content) side of a minimum cut; a positive cost ties a node to the source."""
    n = len(costs)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for u, v, w in edges:
        near[u].append((v, w))
        near[v].append((u, w))
    net, weight, side = list(costs), [sum(w for _, w in x) for x in near], [None] * n
    work = list(range(n))
    while work:  # settle nodes that no neighbour can turn
        u = work.pop()
        if side[u] is None and abs(net[u]) > weight[u] + 1e-12 or side[u] is None and not weight[u]:
            side[u] = net[u] > 0
            for v, w in near[u]:
                if side[v] is None:
                    net[v] += w if side[u] else -w
                    weight[v] -= w
                    work.append(v)
    rest = [u for u in range(n) if side[u] is None]
    if rest:
        at = {u: i for i, u in enumerate(rest)}
        arcs = [(at[u], at[v], w, w) for u, v, w in edges if u in at and v in at]
        arcs += [(len(rest), at[u], net[u], 0.0) if net[u] > 0 else (at[u], len(rest) + 1, -net[u], 0.0) for u in rest]
        for u, content in zip(rest, _source_side(len(rest) + 2, arcs, len(rest), len(rest) + 1), strict=False):
            side[u] = content
    return side


def _source_side(n: int, arcs: list[tuple[int, int, float, float]], s: int, t: int) -> list[bool]:
    """Which nodes are reached from s when a flow to t is greatest; arcs are (u, v, capacity, capacity back). By blocking flows along levels."""
    near: list[list[int]] = [[] for _ in range(n)]
    head, cap = [], []
    for u, v, forth, back in arcs:
        near[u].append(len(head))
        near[v].append(len(head) + 1)
        head += [v, u]
        cap += [forth, back]
    while True:
        level = [-1] * n
        level[s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for e in near[u]:
                if cap[e] > 1e-12 and level[head[e]] < 0:
                    level[head[e]] = level[u] + 1
                    queue.append(head[e])
        if level[t] < 0:
            return [x >= 0 for x in level]
        nxt, path, u = [0] * n, [], s
        while True:
            if u == t:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                first = next(i for i, e in enumerate(path) if cap[e] <= 1e-12)
                u = head[path[first] ^ 1]
                del path[first:]
                continue
            while nxt[u] < len(near[u]) and (cap[near[u][nxt[u]]] <= 1e-12 or level[head[near[u][nxt[u]]]] != level[u] + 1):
                nxt[u] += 1
            if nxt[u] < len(near[u]):
                path.append(near[u][nxt[u]])
                u = head[path[-1]]
            elif path:
                u = head[path.pop() ^ 1]
                nxt[u] += 1
            else:
                break


def main_text(page: str | None) -> str:
    found = Page(page or "")
    keep = min_cut([score(b, found.has_article) for b in found.blocks], ties(found))
    return "\n\n".join(b.text for b, k in zip(found.blocks, keep, strict=True) if k)


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with the main text and its length in code points."""
    schema = ts.widened(pages.select(*keep), "text string, n_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, F.col("html").cast("string").alias("__html")).transform(ts.in_batches, run, schema)
