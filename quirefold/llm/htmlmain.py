"""HTML extraction by minimum-cut labelling.

A page becomes a row of text blocks. A classifier of block features (names of elements and classes, words, stops, links, legal
lines, the share of the page's prose that stands in the same container) gives each block a cost for either label; the costs
are capacities from the source (content) and to the sink (boilerplate). Blocks next to each other, and blocks that follow
each other in one container, are joined by smoothness edges, heavier the nearer they are in the DOM. Max-flow finds the
cheapest labelling; blocks left on the source's side are the main text. All costs are of one scale: names weigh as much as
several edges, and where names say nothing a block's own text weighs about as much as its neighbours.

Defined results: a null or empty page, or one without content, has the empty text. Character references are decoded, runs
of white space inside a block (``<br>`` included) become one space, blocks are trimmed and joined by one line feed in page
order. Whole pages are processed, repeated rows each on their own; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.common import read

#: Elements that start and end a block (fixed values, from the HTML standard).
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never shown as text of the page.
HIDDEN = frozenset("script style noscript template title textarea iframe svg math object select option button canvas audio video xmp noembed noframes datalist".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements of boilerplate, and words of class, id and role that name it.
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset search".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert"
    " sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies discussion disqus"
    " newsletter subscribe subscription signup login share sharing social related recommended recommendations popup modal overlay widget pagination pager"
    " complementary contentinfo search toolbar skip toc copyright".split()
)
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_WORDS = frozenset("article content main story post entry body articlebody".split())
#: Capacities, in hundredths: log-odds of content by feature, and smoothness.
NAMED, INSIDE, OUTSIDE, HEADING, LONG, PROSE, STOP, BARE, LINKS, LEGAL = -700, 220, -300, 60, 180, 100, 20, -70, -250, -300
#: What the share of the page's prose in a block's container adds at most, and what it takes away without any.
SHARE, NO_SHARE = 170, -160
NEXT, SAME_PARENT, CONTAINER = 30, 90, 30
#: Words of a block that is prose, and of a long one.
PROSE_WORDS, LONG_WORDS = 12, 40
#: How lines that reserve rights or name the publisher begin or what they hold, in the languages of the corpus.
LEGAL_LINE = re.compile(
    r"\A(?:©|\(c\) |copyright\b)|\b(?:all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados"
    r"|impressum|datenschutzerklärung|privacy policy|terms of (?:use|service)|mentions légales|aviso legal)\b",
    re.I,
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/"'>]|\Z)""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
SPACE = re.compile(r"\s+")
#: Elements whose short text is still read as prose ("": no element at all).
PLAIN = frozenset(("p", "", "body", "blockquote", "pre", "td", "dd"))
CLOSES_P = BLOCK - {"body", "html"}


class Block:
    __slots__ = ("text", "links", "tag", "path", "boiler", "content", "words")

    def __init__(self, text, links, tag, path, boiler, content):
        self.text, self.links, self.tag, self.path, self.boiler, self.content = text, links, tag, path, boiler, content
        self.words = text.count(" ") + 1


def _marks(attrs: str, headed: bool) -> tuple[int, bool, bool]:
    """Of an element's attributes: boilerplate words, whether it is named as content, whether it is hidden.

    ``headed``: the element may well be called a header, as it stands inside an article.
    """
    boiler, content, hidden = 0, False, False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
        elif name in ("class", "id", "role"):
            words = SPLIT.split(CAMEL.sub(" ", html.unescape(value)).lower())
            boiler += sum(w in BOILER_WORDS and not (headed and w == "header") for w in words)
            content |= any(w in CONTENT_WORDS for w in words)
    return boiler, content, hidden


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, with what the classifier sees of them."""
    out: list[Block] = []
    # An open block element: tag, serial number, boilerplate depth, content depth, hidden depth.
    stack: list[tuple[str, int, int, int, int]] = [("", 0, 0, 0, 0)]
    text: list[str] = []
    linked, in_link, serial, at, n = 0, False, 0, 0, len(page)

    def flush():
        nonlocal linked
        if text:
            got = SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            tag, _, boiler, content, hidden = stack[-1]
            if got and not hidden:  # what is hidden is no text of the page
                out.append(Block(got, linked / len(got), tag, tuple(s[1] for s in stack[-4:]), boiler, content))
        linked = 0

    def add(raw: str):
        nonlocal linked
        text.append(raw)
        if in_link:
            linked += len(raw)

    search = TOKEN.search
    while at < n:
        m = search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[1] is None:
            continue
        tag = m[1].lower()
        if m[0][1] == "/":
            if tag == "a":
                in_link = False
            elif tag == "br":
                add(" ")
            elif tag in BLOCK:
                flush()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            continue
        if tag in HIDDEN:
            if m[2].rstrip().endswith("/") and tag in ("svg", "math", "canvas"):
                continue
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = n if end is None else end.start()
            if end is not None:
                at = m.end() if (m := search(page, at)) else n
            continue
        if tag == "a":
            in_link = True
        elif tag == "br":
            add(" ")
        elif tag in BLOCK:
            flush()
            in_link = False
            if tag in CLOSES_P and stack[-1][0] == "p":
                stack.pop()
            if tag in ("li", "dt", "dd", "td", "th", "tr") and stack[-1][0] == tag:
                stack.pop()
            if tag in VOID:
                continue
            _, _, boiler, content, dark = stack[-1]
            inside = bool(content) or tag in CONTENT_TAGS
            words, named, hidden = _marks(m[2], inside) if m[2] else (0, False, False)
            serial += 1
            # A header outside the article is the site's; one inside belongs to it.
            other = tag in BOILER_TAGS or (tag == "header" and not inside) or (words and not (named and tag in CONTENT_TAGS) and tag not in ("body", "html", "article", "main") and not re.fullmatch("h[1-6]", tag))
            stack.append((tag, serial, boiler + bool(other), content + (tag in CONTENT_TAGS or named), dark + hidden))
    flush()
    return out


def costs_of(blocks: list[Block]) -> list[int]:
    """The classifier: for each block, positive, the cost of calling it boilerplate; negative, of calling it content."""
    prose: dict[int, int] = {}
    for b in blocks:
        if b.words >= PROSE_WORDS and b.links <= 0.5:
            box = b.path[-2] if len(b.path) > 1 else 0
            prose[box] = prose.get(box, 0) + b.words
    total = sum(prose.values())
    named = any(b.content and not b.boiler for b in blocks)
    out = []
    for b in blocks:
        score = LONG if b.words >= LONG_WORDS else PROSE if b.words >= PROSE_WORDS else 0
        score += STOP if b.text[-1] in ".!?:;…。！？\"”»" else 0 if b.tag in PLAIN or score else BARE
        score += HEADING if b.tag in ("h1", "h2", "h3") else 0
        score += int(LINKS * b.links) if b.links > 0.5 else 0
        score += LEGAL if LEGAL_LINE.search(b.text) and b.words < LONG_WORDS else 0
        if b.boiler:
            score += NAMED
        if b.content:
            score += INSIDE
        elif named:  # the page names its article: what stands outside is less likely part of it
            score += OUTSIDE
        else:
            share = prose.get(b.path[-2] if len(b.path) > 1 else 0, 0) / total if total else 1
            score += int(NO_SHARE + (SHARE - NO_SHARE) * share)
        out.append(score)
    return out


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness: neighbours in the page, and blocks that follow each other in one container."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            shared = len(set(a.path).intersection(b.path))
            out.append((i - 1, i, NEXT + (SAME_PARENT if a.path[:-1] == b.path[:-1] else SAME_PARENT * shared // 8)))
        box = b.path[-2] if len(b.path) > 1 else 0
        if box in last and last[box] < i - 1:
            out.append((last[box], i, CONTAINER))
        last[box] = i
    return out


def min_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node whether it stays with the source in a minimum cut; of several, the one with the most such nodes.

    Positive costs are capacities from the source, negative ones to the sink; an edge costs its weight if it is cut.
    Max-flow by blocking flows (levels, then depth first), without recursion.
    """
    n = len(costs)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[int] = []

    def link(u, v, c, back):
        head[u].append(len(to))
        to.append(v)
        cap.append(c)
        head[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            link(s, i, c, 0)
        elif c < 0:
            link(i, t, -c, 0)
    for u, v, w in edges:
        link(u, v, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue and level[t] < 0:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            break
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                full = next(i for i, e in enumerate(path) if not cap[e])
                u = to[path[full] ^ 1]
                del path[full:]
            while nxt[u] < len(head[u]):
                e = head[u][nxt[u]]
                if cap[e] and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            if nxt[u] < len(head[u]):
                path.append(head[u][nxt[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                nxt[u] += 1
            else:
                break
    # Nodes that can still reach the sink fall to it; the rest stays.
    falls = [False] * (n + 2)
    falls[t] = True
    queue = deque([t])
    while queue:
        v = queue.popleft()
        for e in head[v]:
            if cap[e ^ 1] and not falls[to[e]]:
                falls[to[e]] = True
                queue.append(to[e])
    return [not f for f in falls[:n]]


def labels_of(page: str | None) -> tuple[list[Block], list[int], list[bool]]:
    """A page's blocks, what the classifier says of each, and whether the cut keeps it."""
    blocks = blocks_of(page) if page else []
    costs = costs_of(blocks)
    return blocks, costs, min_cut(costs, edges_of(blocks)) if blocks else []


def main_text(page: str | None) -> str:
    blocks, _, keep = labels_of(page)
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every row of ``pages``."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):  # bounded memory with very long pages
                part = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([main_text(h.as_py()) for h in part.column(1)], pa.string())], [id_col, "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    keyed = pages.select(F.struct("page_id", "url").alias("row"), "html")
    return extract(keyed, "row").select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
ORACLE_SQL: dict[str, str] = {}
