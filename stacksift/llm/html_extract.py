"""Main text of web pages by minimum cut.

A page becomes blocks of text in page order, and a tree of the elements that hold them. A logistic model prices each block
as content or boilerplate by its text and mark-up, and elements that name a region (nav, article, class words) have a price
of their own; the prices are the capacities to the two terminals. Smoothness edges tie each block to the region that it lies
in, to the next block and to the one after it, these the stronger the fewer steps of the tree lie between them and the less
their regions and shares of links differ. Maximum flow gives the minimum cut, which separates content from boilerplate.

The model's weights for text, mark-up and class words are fitted to blocks that pages mark themselves: a bounded sample of
pages with an article or main element, where that element's own blocks are content and the rest isn't. The elements that
gave the labels aren't inputs of the fit; their odds are fixed and of the same size.

A region's class or element speaks against what is inside, but not if it holds the page's main element, its largest article
or, where there is neither, three quarters of its prose: a layout's name (has-sidebar) isn't a sidebar.

Defined cases: a null or empty page, and one without content, gives an empty text. Unclosed tags, comments and quotes
end with the page. Elements nest as deep as they like. Repeated rows get equal results; a null page_id or url is kept.
Without pages that mark their content the model's prior weights hold. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>", re.S)
HINTS = re.compile(r"""\b(class|id|role|itemprop|aria-hidden|style|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
HINT_WORD = re.compile(r"[a-z0-9]+")
#: Elements without shown text, elements that break lines, elements that end an open one of their own kind.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "object", "canvas", "audio", "video", "math", "title"}
#: Of these, elements that a slash at the end of their start tag closes.
FOREIGN = {"svg", "math"}
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SAME = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Log-odds of content by element that a block lies in (a header inside an article has none), and the most that a block's
#: own text says.
ELEMENT = {"nav": -4.5, "menu": -4.5, "footer": -4.5, "header": -3.5, "aside": -4, "form": -4, "dialog": -4.5, "select": -5, "button": -4.5, "fieldset": -4, "label": -3.5, "article": 2.5, "main": 2}
LOUDEST = 3.0
#: Words of class, id and role that name boilerplate or content; of the former those of readers' comments; what before them
#: makes them the name of a layout.
BAD = set("ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar side widget footer masthead topbar copyright cookie cookies consent gdpr notice alert popup modal overlay dialog comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login signin register search pagination pager toolbar skip legal disclaimer contentinfo complementary form feedback rating reviews".split())
COMMENT = set("comment comments commentlist reply replies respond disqus discussion reviews feedback".split())
GOOD = set("article articlebody content main post entry story text body".split())
LAYOUT = set("has with without no not is hide hides".split())
#: What before the word header makes it the page's own; in front of others it is a heading of the content.
OUTER = ("", "site", "global", "top")
#: Ties: between neighbours at all, between those under one parent besides, and across one block; tree steps beyond which
#: they don't matter; difference of regions that takes a tie to a third, and how fast a difference in the share of links does.
NEAR, KIN, ACROSS, REACH, CONTRAST, LINKED = 0.2, 2.2, 0.5, 10, 2.5, 1.2
#: Features of a block and the weights that the fit starts from and is drawn to.
FEATURES = ("bias", "length", "links", "sentence", "paragraph", "heading", "item", "copyright", "bad", "good")
PRIOR = np.array([-1.2, 0.9, -4.5, 0.6, 0.8, 0.6, -0.6, -3.0, -4.5, 1.2])
BAD_AT, GOOD_AT = FEATURES.index("bad"), FEATURES.index("good")
MARKS_ONLY = np.zeros(len(FEATURES))
#: Pages of the fit at most, the longest that it takes, how strongly the prior draws, and how far a weight may go.
FIT_PAGES, FIT_CHARS, DRAW, STRAY = 300, 200_000, 0.02, 2.0


@dataclass
class Page:
    """Blocks, and the elements that hold them: parent, tag and class words' odds by number; 0 is the page."""

    blocks: list = field(default_factory=list)
    parent: list = field(default_factory=lambda: [0])
    tag: list = field(default_factory=lambda: [""])
    bad: list = field(default_factory=lambda: [False])
    good: list = field(default_factory=lambda: [False])
    comment: list = field(default_factory=lambda: [False])
    depth: list = field(default_factory=lambda: [0])


class Block:
    __slots__ = ("text", "links", "node", "tag")

    def __init__(self, text: str, links: int, node: int, tag: str):
        self.text, self.links, self.node, self.tag = text, links, node, tag


def _hints(attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether class, id and role name boilerplate, readers' comments or content, and whether the element is hidden."""
    bad = comment = good = hidden = False
    for name, value in HINTS.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
        elif name != "style":
            before = ""
            for word in HINT_WORD.findall(value):
                if before not in LAYOUT:
                    bad |= word in BAD or word == "header" and before in OUTER
                    comment |= word in COMMENT
                    good |= word in GOOD
                before = word
    return bad, comment, good and not bad, hidden


def parsed(text: str) -> Page:
    """Shown text by block, with its open elements."""
    page = Page()
    # open elements: tag, number, hidden, inline elements inside that aren't kept themselves
    stack: list[tuple[str, int, bool, dict]] = [("", 0, False, {})]
    is_open: Counter = Counter()
    parts: list[str] = []
    links = anchor = at = 0
    end = len(text)

    def flush() -> None:
        nonlocal parts, links
        if parts:
            said = " ".join(html.unescape("".join(parts)).split())
            if said and not stack[-1][2]:
                page.blocks.append(Block(said, links, stack[-1][1], stack[-1][0]))
            parts, links = [], 0

    def leave(i: int) -> None:
        for x in stack[i:]:
            is_open[x[0]] -= 1
        del stack[i:]

    while at < end:
        found = TOKEN.search(text, at)
        stop = found.start() if found else end
        if stop > at and not stack[-1][2]:
            parts.append(text[at:stop])
            if anchor:
                links += stop - at
        if not found:
            break
        at, closing, tag, attributes = found.end(), found[1], (found[2] or "").lower(), found[3]
        if not tag:
            continue
        if not closing and tag in FOREIGN and attributes.endswith("/"):
            parts.append(" ")
        elif not closing and tag in RAW:
            shut = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            at = shut.end() if shut else end
            parts.append(" ")
        elif tag == "a":
            anchor = 0 if closing else 1
        elif tag in VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" " if tag in ("br", "img") else "")
        elif closing:
            inside = stack[-1][3]
            if inside.get(tag):
                inside[tag] -= 1
            elif is_open[tag]:
                flush()
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                leave(i)
            elif tag in BLOCK:
                flush()
        else:
            inline = tag not in BLOCK
            bad, comment, good, hidden = _hints(attributes) if attributes else (False,) * 4
            if tag in ("html", "body"):
                bad = comment = good = False
            if inline and (attributes.endswith("/") or not (bad or hidden)):
                if not attributes.endswith("/"):
                    stack[-1][3][tag] = stack[-1][3].get(tag, 0) + 1
                continue
            flush()
            if not inline:
                anchor = 0
            if tag in SAME and is_open[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        leave(i)
                        break
                    if stack[i][0] not in SAME:
                        break
            if tag == "body" and is_open["head"]:
                leave(next(i for i, x in enumerate(stack) if x[0] == "head"))
            up = stack[-1]
            number = len(page.parent)
            page.parent.append(up[1])
            page.tag.append(tag)
            page.bad.append(bad)
            page.comment.append(comment)
            page.good.append(good)
            page.depth.append(page.depth[up[1]] + 1)
            stack.append((tag, number, up[2] or hidden, {}))
            is_open[tag] += 1
    flush()
    return page


def _prose(block: Block) -> int:
    return len(block.text) - block.links if block.text[-1] in SENTENCE_ENDS and len(block.text) >= 40 else 0


SENTENCE_ENDS = ".!?…:;\"'»”)"


def waived(page: Page) -> list[bool]:
    """Elements that hold the page's main part, so that their name doesn't speak against it."""
    n = len(page.parent)
    prose = [0] * n
    for b in page.blocks:
        prose[b.node] += _prose(b)
    for i in range(n - 1, 0, -1):
        prose[page.parent[i]] += prose[i]
    out = [False] * n
    mains = [i for i in range(n) if page.tag[i] == "main"]
    articles = [i for i in range(n) if page.tag[i] == "article"]
    said = list(page.comment)
    for i in range(1, n):
        said[i] = said[i] or said[page.parent[i]]
    heart = mains[0] if mains else max(articles, key=lambda i: (not said[i], prose[i])) if articles else None
    if heart is not None:
        i = heart
        while i:
            out[i] = True
            i = page.parent[i]
    else:
        whole = prose[0]
        for i in range(1, n):
            out[i] = whole > 0 and prose[i] >= 0.75 * whole and not page.comment[i] and page.tag[i] not in ("nav", "footer", "menu", "select", "button")
    return out


def regions(page: Page, weights: np.ndarray) -> tuple[list[int], list[float], list[bool], list[bool]]:
    """By element: the region that it lies in (an element, or 0), that region's log-odds, and whether class words around
    name boilerplate or content. Boilerplate within content is a region of its own; content within boilerplate isn't."""
    free, n = waived(page), len(page.parent)
    of, odds, bad, good, inside = [0] * n, [0.0] * n, [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        up, tag = page.parent[i], page.tag[i]
        element = 0.0 if tag == "header" and inside[up] else ELEMENT.get(tag, 0.0)
        own = page.bad[i] and not free[i]
        against = 0.0 if free[i] else min(element, 0.0)
        if own:
            against = min(against, float(weights[BAD_AT]))
        around = odds[up]
        spoken = max(element, float(weights[GOOD_AT]) if page.good[i] and not own else 0.0)
        if against < 0:
            of[i], odds[i] = i, against
        elif spoken > max(around, 0.0) and around >= 0:
            of[i], odds[i] = i, spoken
        else:
            of[i], odds[i] = of[up], around
        bad[i] = bad[up] or own
        good[i] = (good[up] or page.good[i]) and not bad[i]
        inside[i] = inside[up] or tag == "article"
    return of, odds, bad, good


def features(block: Block, bad: bool, good: bool) -> list[float]:
    """As FEATURES names them."""
    text = block.text
    n = len(text)
    return [
        1.0,
        math.log1p(n / 20),
        min(1.0, block.links / n),
        text[-1] in SENTENCE_ENDS,
        block.tag in ("p", "pre", "blockquote"),
        block.tag in ("h1", "h2", "h3"),
        block.tag == "li",
        text[0] == "©",
        bad,
        good,
    ]


def labelled_blocks(text: str) -> tuple[list[list[float]], list[int]]:
    """Features and labels of a page that marks its content with a main or article element; else nothing."""
    page = parsed(text)
    if not {"main", "article"}.intersection(page.tag):
        return [], []
    marks = regions(page, MARKS_ONLY)[1]
    bad, good = regions(page, PRIOR)[2:]
    return [features(b, bad[b.node], good[b.node]) for b in page.blocks], [int(marks[b.node] > 0) for b in page.blocks]


def fit(pages: list[str]) -> np.ndarray:
    """Weights of least logistic loss over the pages' own marks, drawn to the prior; by damped Newton steps."""
    rows, marks = [], []
    for text in pages:
        x, y = labelled_blocks(text)
        rows += x
        marks += y
    weights = PRIOR.copy()
    if not 0 < sum(marks) < len(marks):
        return weights
    x, y = np.array(rows, float), np.array(marks, float)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (share * (p - y)) + DRAW * (weights - PRIOR)
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + DRAW * np.eye(len(PRIOR))
        step = np.linalg.solve(curve, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-9:
            break
    return np.clip(weights, PRIOR - STRAY, PRIOR + STRAY)


def steps_between(page: Page, a: int, b: int) -> int:
    """Tree steps from an element to another, REACH at most."""
    n, depth, parent = 0, page.depth, page.parent
    while a != b and n < REACH:
        if depth[a] >= depth[b]:
            a, n = parent[a], n + 1
            if a == b or n >= REACH:
                break
        if depth[b] > depth[a]:
            b, n = parent[b], n + 1
    return n


def graph(page: Page, weights: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Log-odds of content of each block and then of each region, and the edges between them.

    A region's odds count once for each of its blocks, and tie each of them to it as strongly."""
    of, odds, *_ = regions(page, weights)
    found, w = page.blocks, [*weights[:BAD_AT].tolist(), 0.0, 0.0]
    value = [max(-LOUDEST, min(LOUDEST, sum(map(float.__mul__, w, map(float, features(b, False, False)))))) for b in found]
    share = [b.links / len(b.text) for b in found]
    node, edges = {}, []
    for i, b in enumerate(found):
        r = of[b.node]
        if r:
            if r not in node:
                node[r] = len(value)
                value.append(odds[r])
            value[node[r]] += odds[r]
            edges.append((i, node[r], abs(odds[r])))
    for i in range(len(found) - 1):
        for j, most in ((i + 1, KIN), (i + 2, ACROSS)):
            if j < len(found):
                a, b = found[i].node, found[j].node
                steps = steps_between(page, a, b)
                tie = (NEAR if j == i + 1 else 0.0) + (most * 2.0 ** min(0, 2 - steps) if steps < REACH else 0.0)
                unlike = abs(odds[a] - odds[b]) / CONTRAST + LINKED * abs(share[i] - share[j])
                edges.append((i, j, tie * math.exp(-unlike)))
    return value, edges


def minimum_cut(value: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side. value: capacity from the source less that to the sink."""
    ties: list[dict[int, float]] = [{} for _ in value]
    for a, b, c in edges:
        ties[a][b] = ties[a].get(b, 0.0) + c
        ties[b][a] = ties[b].get(a, 0.0) + c
    return _max_flow(value, ties)


def _max_flow(value: list[float], ties: list[dict[int, float]]) -> list[bool]:
    """Dinic's algorithm; the source's side of the residual graph."""
    n = len(value)
    source, sink = n, n + 1
    room: list[dict[int, float]] = [*map(dict, ties), {}, {}]
    for i, v in enumerate(value):
        if v > 0:
            room[source][i], room[i][source] = v, 0.0
        else:
            room[i][sink], room[sink][i] = -v, 0.0
    tiny = 1e-12
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > tiny and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return [i in level for i in range(n)]
        ways = [list(x) for x in room]
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                path = [source]
                continue
            while ways[i]:
                j = ways[i][-1]
                if room[i][j] > tiny and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
                ways[i].pop()
            else:
                path.pop()
                if path:
                    ways[path[-1]].pop()


def main_text(text: str, weights: np.ndarray = PRIOR) -> tuple[str, int, int]:
    """The page's main text, its blocks of content, and all blocks."""
    page = parsed(text)
    side = minimum_cut(*graph(page, weights))
    kept = [b.text for b, content in zip(page.blocks, side, strict=False) if content]
    return "\n".join(kept), len(kept), len(page.blocks)


def _extract(weights: np.ndarray):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [main_text(x or "", weights) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_content", "n_blocks"],
            )

    return extract


def fitted(pages: DataFrame, most: int = FIT_PAGES) -> np.ndarray:
    """Weights from a sample of at most ``most`` pages, chosen by hash and not by order: only theirs leave their tasks."""
    slot = F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 30))
    marked = pages.filter((F.length("html") <= FIT_CHARS) & F.col("html").rlike("(?i)<(article|main)[ >]")).select("html", slot.alias("slot"))
    share = min(1.0, most / max(1, marked.count()))
    rows = marked.filter(F.col("slot") < int(share * (1 << 30))).limit(2 * most).collect()  # bounded: pages and their length
    return fit([r["html"] for r in sorted(rows, key=lambda r: (r["slot"], r["html"]))[:most]])


def extract(pages: DataFrame, most: int = FIT_PAGES) -> DataFrame:
    """Per page: page_id, url, text, n_chars, and the counts of content blocks and of all blocks."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_extract(fitted(pages, most)), "page_id long, url string, text string, n_chars long, n_content long, n_blocks long")
