"""Texts of HTML pages, in Arrow-batched functions around the standard parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content isn't text, elements that begin a block, and what stands before a heading or an item.
SKIPPED = {"head", "style", "script"}
BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "blockquote", "h1", "h2", "h3", "li"}
LEADS = {"h1": "# ", "h2": "## ", "h3": "### ", "li": "- "}


class Untagger(HTMLParser):
    """Collects blocks of text, and for each the element that holds it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[list[str]] = [[""]]
        self.skipped = 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipped += 1
        elif tag in BLOCKS:
            self.blocks.append([LEADS.get(tag, "")])
        elif tag == "br":
            self.blocks[-1].append("\n")
        elif tag == "hr":
            self.blocks += [["---"], [""]]

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag in BLOCKS:
            self.blocks.append([""])

    def handle_data(self, data):
        if not self.skipped:
            self.blocks[-1].append(data)

    def texts(self) -> list[str]:
        lines = ("\n".join(" ".join(x.split()) for x in "".join(b).split("\n")).strip() for b in self.blocks)
        return [x for x in lines if x and x not in ("#", "##", "###", "-")]


def blocks_of(page: str) -> list[str]:
    parser = Untagger()
    parser.feed(page)
    parser.close()
    return parser.texts()


def untagged_texts(pages: pa.Array) -> pa.Array:
    """``untagged`` of a slice of pages."""
    return pa.array([None if p is None else "\n\n".join(blocks_of(p)) for p in pages.to_pylist()], pa.string())


@F.pandas_udf(T.StringType())
def untagged(pages: pd.Series) -> pd.Series:
    """The page's text: a paragraph for each block, headings and items marked; null for null."""
    return pages.map(lambda p: None if p is None else "\n\n".join(blocks_of(p)))


#: Elements that hold text, elements that never do, and elements without an end: fixed values.
TEXTUAL = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "ul", "ol", "dl", "li", "dt", "dd", "table", "th", "td"}
IGNORED = {"style", "script"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Page(HTMLParser):
    """The page's nodes in the order of their starts, node 0 the page itself: tag (None for texts), attributes, text, parent, and the last node below.

    An end closes the nearest open element of its name, and a block closes an open paragraph. Elements may lie as deep as they do.
    """

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.tag: list[str | None] = [""]
        self.attributes: list[dict | None] = [{}]
        self.text: list[str | None] = [None]
        self.parent, self.last, self.open = [-1], [0], [0]
        self.named: dict[str, list[int]] = {}  # the places of open elements by name, so that an end needs no search
        self.feed(page)
        self.close()
        self.shut(0)

    def add(self, tag: str | None, attributes: dict | None, text: str | None) -> int:
        node = len(self.tag)
        for held, x in ((self.tag, tag), (self.attributes, attributes), (self.text, text), (self.parent, self.open[-1]), (self.last, node)):
            held.append(x)
        return node

    def shut(self, k: int) -> None:
        """Closes the open elements from the k-th on."""
        for node in self.open[k:]:
            self.last[node] = len(self.tag) - 1
            if self.named.get(self.tag[node]):
                self.named[self.tag[node]].pop()
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and self.tag[self.open[-1]] == "p":
            self.shut(len(self.open) - 1)
        node = self.add(tag, {k: v or "" for k, v in reversed(attrs)}, None)
        if tag not in VOID:
            self.named.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_endtag(self, tag):
        if self.named.get(tag):
            self.shut(self.named[tag][-1])

    def handle_data(self, data):
        self.add(None, None, data)

    def texts(self, node: int) -> str:
        """All text below a node."""
        return "".join(t for t in self.text[node : self.last[node] + 1] if t is not None)

    def lines(self, node: int) -> str:
        """The text below, blocks and breaks on lines of their own, scripts and styles left out."""
        out, ends, at = [], [], node
        while at <= self.last[node] + 1:
            while ends and ends[-1] < at:
                ends.pop()
                out.append("\n")
            if at > self.last[node]:
                break
            tag = self.tag[at]
            if tag in IGNORED:
                at = self.last[at]
            elif tag is None:
                out.append(self.text[at].replace("\n", " "))
            elif tag == "br":
                out.append("\n")
            elif tag in BLOCKS:
                out.append("\n")
                ends.append(self.last[at])
            at += 1
        return "".join(out)

    def densest(self) -> int | None:
        """The element with the highest density, the first of equals to end; None if no element has any.

        A text weighs the square of its length. A textual element without any below it has the weights in it as its density;
        any other has its children's densities, times the share (one more each) of textual ones among its child elements.
        """
        n = len(self.tag)
        weight, density, elements, textual, best, found = [0.0] * n, [0.0] * n, [0] * n, [0] * n, 0.0, None
        open_: list[int] = []

        def end(node: int) -> None:
            nonlocal best, found
            up, tag = self.parent[node], self.tag[node]
            own = weight[node] if tag in TEXTUAL and not density[node] else density[node] * (textual[node] + 1) / (elements[node] + 1)
            if tag and own > best and tag not in IGNORED:
                best, found = own, node
            if up >= 0:
                elements[up] += 1
                textual[up] += tag in TEXTUAL
                if tag not in IGNORED:
                    weight[up] += weight[node]
                    density[up] += own

        at = 0
        while at < n:
            while open_ and self.last[open_[-1]] < at:
                end(open_.pop())
            if self.tag[at] is None:
                weight[self.parent[at]] += len(" ".join(self.text[at].split())) ** 2
            else:
                open_.append(at)
                if self.tag[at] in IGNORED:
                    at = self.last[at]
            at += 1
        while open_:
            end(open_.pop())
        return found


def main_of(page: str) -> str | None:
    parsed = Page(page)
    node = parsed.densest()
    lines = [] if node is None else [" ".join(x.split()) for x in parsed.lines(node).split("\n")]
    return "\n".join(x for x in lines if x) or None


def main_texts(pages: pa.Array) -> pa.Array:
    """``main_text`` of a slice of pages."""
    return pa.array([None if p is None else main_of(p) for p in pages.to_pylist()], pa.string())


@F.pandas_udf(T.StringType())
def main_text(pages: pd.Series) -> pd.Series:
    """The text of the page's densest element; null for null and for pages without textual elements."""
    return pages.map(lambda p: None if p is None else main_of(p))
