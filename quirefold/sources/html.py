"""Blocks of HTML pages: headings, paragraphs and list items in document order.

An element inside another gives its text twice, once for each; pages without any block give their text nodes as lines.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements taken as blocks, and elements left out with all they hold.
BLOCKS = ("h1", "h2", "h3", "h4", "p", "li")
LEFT_OUT = ("script", "style", "noscript", "nav", "footer", "header")
#: Elements whose start ends an open paragraph.
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[list[str]] = []
        self.stack: list[tuple[str, list[str] | None]] = []
        self.nodes: list[str] = []
        self.out = 0

    def _pop(self, to: int):
        for tag, _ in self.stack[to:]:
            self.out -= tag in LEFT_OUT
        del self.stack[to:]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            open_p = [i for i, (t, _) in enumerate(self.stack) if t == "p"]
            if open_p:
                self._pop(open_p[-1])
        if tag == "li":
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in ("ul", "ol"):
                    break
                if self.stack[i][0] == "li":
                    self._pop(i)
                    break
        if tag in VOID:
            return
        block = None
        if tag in BLOCKS and not self.out:
            block = []
            self.blocks.append(block)
        self.out += tag in LEFT_OUT
        self.stack.append((tag, block))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop(i)
                return

    def handle_data(self, data):
        text = data.strip()
        if text and not self.out:
            self.nodes.append(text)
            for _, block in self.stack:
                if block is not None:
                    block.append(text)


def blocks_of(page: str | None) -> list[str]:
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    blocks = [" ".join(b) for b in reader.blocks if b]
    return blocks or [line.strip() for node in reader.nodes for line in node.splitlines() if line.strip()]


@F.arrow_udf(T.ArrayType(T.StringType()))
def html_blocks(page: pa.Array) -> pa.Array:
    return pa.array([blocks_of(p) for p in page.to_pylist()], pa.list_(pa.string()))


def page_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(doc_id, pos, line) of every block of every page."""
    return pages.select(F.col(id_col).alias("doc_id"), F.posexplode(html_blocks(F.col(html_col))).alias("pos", "line"))
