"""Pages as numbered nodes, and the statements that their microdata make."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.html import Page
from facetry.functions.slices import exploded, in_slices

NODES = "array<struct<node:int,last:int,parent:int,tag:string,attributes:map<string,string>,text:string>>"
_NODE = pa.struct([("node", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string())])
STATED = "array<struct<s:string,p:string,o:string,kind:string>>"
_STATED = pa.struct([("s", pa.string()), ("p", pa.string()), ("o", pa.string()), ("kind", pa.string())])


def page_nodes(html: Column) -> Column:
    """The nodes of a page in the order of their starts: number, the last number below, the parent's, tag (null for texts), attributes, text. What is below a node has the numbers after its own up to its last. Null for null."""

    return F.arrow_udf(lambda pages: in_slices(pages, nodes_of_pages), NODES)(html)


def page_rows(rows: DataFrame, keep: list[str], html: Column) -> DataFrame:
    """A row for each node (of ``page_nodes``), with the columns to keep; a slice of a batch's pages is held at once."""
    return exploded(rows, keep, html, nodes_of_pages, NODES)


def nodes_of_pages(pages: pa.Array) -> pa.Array:
    out = []
    for html in pages.to_pylist():
        p = None if html is None else Page(html)
        out.append(p and [{"node": k, "last": p.last[k], "parent": p.parent[k], "tag": p.tag[k], "attributes": None if p.attributes[k] is None else list(p.attributes[k].items()), "text": p.text[k]} for k in range(len(p.tag))])
    return pa.array(out, pa.list_(_NODE))


# Where the value of a property is, by tag, and whether it names something; other tags have their text.
VALUES = {"meta": "content", "data": "value", "meter": "value", "time": "datetime"}
NAMES = {"audio": "src", "embed": "src", "iframe": "src", "img": "src", "source": "src", "track": "src", "video": "src", "a": "href", "area": "href", "link": "href", "object": "data"}
_SPACE = re.compile("[\t\n\f\r ]+")
_ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:\S+\Z")


def words(text: str | None) -> list[str]:
    """The words of an attribute, each once, in order."""
    return list(dict.fromkeys(w for w in _SPACE.split(text or "") if w))


class Microdata:
    """Items of a page. An item's properties are on the elements below it and on those that it refers to by identifier, not below inner items; a circle of references is walked once."""

    def __init__(self, page: Page, base: str, vocabulary: str):
        self.page, self.base, self.vocabulary = page, base, vocabulary
        self.children: dict[int, list[int]] = {}
        self.ids: dict[str, int] = {}
        for node, tag in enumerate(page.tag):
            if tag is not None:
                self.children.setdefault(page.parent[node], []).append(node)
                if name := page.attributes[node].get("id"):
                    self.ids.setdefault(name, node)

    def name_of(self, item: int) -> str:
        own = self.page.attributes[item].get("itemid", "").strip("\t\n\f\r ")
        name = urljoin(self.base, own) if own else ""
        return name if _ABSOLUTE.match(name) else f"_:{self.base}#{item}"

    def value_of(self, node: int) -> tuple[str, str]:
        tag, attributes = self.page.tag[node], self.page.attributes[node]
        if (at := NAMES.get(tag)) and at in attributes:
            return urljoin(self.base, attributes[at].strip()), "iri"
        if tag in VALUES and VALUES[tag] in attributes:
            return attributes[VALUES[tag]], "literal"
        return " ".join(self.page.texts(node).split()), "literal"

    def statements(self) -> Iterator[tuple[str, str, str, str]]:
        inner = set()
        for item, tag in enumerate(self.page.tag):
            if tag is None or "itemscope" not in self.page.attributes[item]:
                continue
            if item not in inner:  # items below are told with the outer one
                todo = [item]
                while todo:
                    one = todo.pop()
                    if one in inner:
                        continue
                    inner.add(one)
                    yield from self.item(one, todo)

    def item(self, item: int, todo: list[int]) -> Iterator[tuple[str, str, str, str]]:
        attributes, name = self.page.attributes[item], self.name_of(item)
        types = [t for t in words(attributes.get("itemtype")) if _ABSOLUTE.match(t)]
        for t in types:
            yield name, "rdf:type", t, "iri"
        space = re.sub(r"[^/#]*\Z", "", types[0]) if types else self.vocabulary
        pending = deque([*self.children.get(item, []), *(self.ids[r] for r in words(attributes.get("itemref")) if r in self.ids)])
        seen = {item}
        while pending:
            node = pending.popleft()
            if node in seen:
                continue
            seen.add(node)
            own = self.page.attributes[node]
            properties = [p if _ABSOLUTE.match(p) else space + p for p in words(own.get("itemprop"))]
            if "itemscope" in own:
                yield from ((name, p, self.name_of(node), "iri") for p in properties)
                todo.append(node)
            else:
                if properties:
                    value, kind = self.value_of(node)
                    yield from ((name, p, value, kind) for p in properties if value)
                pending.extend(self.children.get(node, []))


def microdata(html: Column, base: Column, vocabulary: str = "terms#") -> Column:
    """The statements (s, p, o, kind) of a page's microdata, each once. Relative names are resolved against ``base``; an item without one is named by its place; properties of an item without a type are of the ``vocabulary``. Null for null pages."""

    def run(pages: pa.Array, bases: pa.Array) -> pa.Array:
        found = [None if html is None else list(dict.fromkeys(Microdata(Page(html), at or "", vocabulary).statements())) for html, at in zip(pages.to_pylist(), bases.to_pylist(), strict=True)]
        return pa.array([f and [dict(zip(("s", "p", "o", "kind"), x, strict=True)) for x in f] for f in found], pa.list_(_STATED))

    return F.arrow_udf(run, STATED)(html, base)
