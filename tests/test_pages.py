"""Steps over pages against walks of their trees, and microdata case by case."""

import random

from pyspark.sql import functions as F

from facetry.functions import html, pages
from facetry.operators import axes

BASE = "http://example.net/"
PARTS = ["<p>", "</p>", "<div class='a'>", "<div id=x>", "</div>", "<ul>", "<li>", "</li>", "</ul>", "text", " x ", "<b>", "</b>", "<br>", "<img src=i>", "<!-- c -->", "&amp;"]


def some_page():
    return "".join(random.choices(PARTS, k=random.randint(0, 25)))


def test_axes_against_tree_walks(spark):
    random.seed(7)
    texts = [some_page() for _ in range(40)] + ["", "<div>" * 1200 + "deep" + "</div>" * 1200, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, html string").select("k", pages.page_nodes(F.col("html")).alias("nodes"))
    nodes = axes.nodes_of(rows, "k", F.col("nodes")).cache()
    trees = {k: html.Page(t) for k, t in enumerate(texts) if t is not None}
    ups = {k: {n: set(ancestors(p, n)) for n in range(len(p.tag))} for k, p in trees.items()}
    walks = {
        "self": lambda u, p, a, b: a == b, "child": lambda u, p, a, b: p[b] == a, "parent": lambda u, p, a, b: p[a] == b, "descendant": lambda u, p, a, b: a in u[b], "descendant-or-self": lambda u, p, a, b: a == b or a in u[b],
        "ancestor": lambda u, p, a, b: b in u[a], "ancestor-or-self": lambda u, p, a, b: a == b or b in u[a], "following": lambda u, p, a, b: b > a and a not in u[b], "preceding": lambda u, p, a, b: b < a and b not in u[a],
        "following-sibling": lambda u, p, a, b: p[a] == p[b] and b > a, "preceding-sibling": lambda u, p, a, b: p[a] == p[b] and b < a,
    }
    few = nodes.where("page < 41")
    context = few.where("tag = 'div' OR tag = 'li'")
    starts = [(k, n) for k, p in trees.items() if k < 41 for n, t in enumerate(p.tag) if t in ("div", "li")]
    for axis, holds in walks.items():
        told = {(k, b) for k, a in starts for b, t in enumerate(trees[k].tag) if t and holds(ups[k], trees[k].parent, a, b)}
        assert {(r.page, r.node) for r in axes.stepped(context, few, axis, "*").collect()} == told, axis
        second = {(k, found[1]) for k, a in starts for found in [sorted((b for b, t in enumerate(trees[k].tag) if t and holds(ups[k], trees[k].parent, a, b)), reverse=axis.startswith(("anc", "prec")))] if len(found) > 1}
        assert {(r.page, r.node) for r in axes.stepped(context, few, axis, "*", nth=2).collect()} == second, axis
    deep = axes.along(nodes.where("page = 41"), ("descendant", "div"), ("child", "#text")).collect()
    assert [r.text for r in deep] == ["deep"]
    values = {(r.page, r.node): r.value for r in axes.string_values(context, few).collect()}
    assert values == {(k, n): trees[k].texts(n) for k, n in starts}
    with_item = {(r.page, r.node) for r in axes.having(context, few, ("child", "li"), ("child", "#text")).collect()}
    assert with_item == {(k, a) for k, a in starts for b, t in enumerate(trees[k].tag) if t == "li" and trees[k].parent[b] == a and any(trees[k].parent[c] == b and x is None for c, x in enumerate(trees[k].tag))}
    by_class = {(r.page, r.node) for r in axes.along(few, ("descendant", "div", axes.attribute("class") == "a")).collect()}
    assert by_class == {(k, n) for k, p in trees.items() if k < 41 for n, t in enumerate(p.tag) if t == "div" and p.attributes[n].get("class") == "a"}


def ancestors(page, node):
    while (node := page.parent[node]) >= 0:
        yield node


def stated(text, base=BASE):
    return list(dict.fromkeys(pages.Microdata(html.Page(text), base, "terms#").statements()))


def test_items():
    thing = "https://schema.org/Thing"
    assert stated("<div></div>") == [] and stated("<b itemprop=x>y</b>") == []
    two = stated(f"<p><b itemscope itemtype='{thing}'></b><b itemscope itemtype='{thing}'></b></p>")
    assert len({s for s, *_ in two}) == 2 and {x[1:] for x in two} == {("rdf:type", thing, "iri")}
    assert len({s for s, *_ in stated(f"<div itemscope itemtype='{thing}'><div itemscope itemtype='{thing}'></div></div>")}) == 2
    assert stated(f"<div itemscope itemid=' http://example.net/id\t' itemtype='{thing}'></div>")[0][0] == "http://example.net/id"
    assert stated(f"<div itemscope itemid='id' itemtype='{thing}'></div>")[0][0] == BASE + "id"
    assert [x[2] for x in stated(f"<div itemscope itemtype=' {thing}\t\thttps://schema.org/Event {thing} Other'></div>")] == [thing, "https://schema.org/Event"]


def test_properties():
    assert [x[1:] for x in stated("<div itemscope><span itemprop='x y x'> some  value </span></div>")] == [("terms#x", "some value", "literal"), ("terms#y", "some value", "literal")]
    assert [x[1:] for x in stated("<div itemscope itemtype='https://schema.org/Thing'><i itemprop='name http://x.y/z'>v</i></div>")][1:] == [("https://schema.org/name", "v", "literal"), ("http://x.y/z", "v", "literal")]
    assert [x[1:] for x in stated("<div itemscope><b itemprop='\t'>v</b><b itemprop=x></b></div>")] == []
    address = "<div itemscope itemid=a><address itemprop='address' itemscope itemtype='https://schema.org/PostalAddress' itemid='b'><div><span itemprop='streetAddress'>road</span></div></address></div>"
    assert stated(address) == [(BASE + "a", "terms#address", BASE + "b", "iri"), (BASE + "b", "rdf:type", "https://schema.org/PostalAddress", "iri"), (BASE + "b", "https://schema.org/streetAddress", "road", "literal")]
    values = "<div itemscope><meta itemprop=a content=m><img itemprop=b src=/i.png><a itemprop=c href='../x'>t</a><object itemprop=d data=o></object><data itemprop=e value=7>seven</data><meter itemprop=f value=2>2 of 3</meter><time itemprop=g datetime=2020-01-01>then</time><time itemprop=h>2021</time><a itemprop=i>no link</a></div>"
    assert [x[2:] for x in stated(values)] == [("m", "literal"), (BASE + "i.png", "iri"), (BASE + "x", "iri"), (BASE + "o", "iri"), ("7", "literal"), ("2", "literal"), ("2020-01-01", "literal"), ("2021", "literal"), ("no link", "literal")]


def test_references_and_circles():
    found = stated("<div itemscope itemref='one two none'><i itemprop=a>A</i></div><p id=one><b itemprop=b>B</b></p><p id=two itemprop=c>C</p><b id=lost itemprop=d>D</b>")
    assert sorted(x[1:3] for x in found) == [("terms#a", "A"), ("terms#b", "B"), ("terms#c", "C")]
    circle = stated("<div itemscope id=x itemid=x itemref=y><i itemprop=a>A</i></div><div itemscope id=y itemid=y itemprop=p itemref=x></div>")
    assert (BASE + "x", "terms#p", BASE + "y", "iri") in circle and len(circle) == len(set(circle)) < 6
    assert stated("<div itemscope id=x itemid=x itemref=x><i itemprop=a>A</i></div>") == [(BASE + "x", "terms#a", "A", "literal")]


def test_nulls(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "<div itemscope><b itemprop=x>y</b></div>", None), (3, "", "http://b/")], "k long, html string, url string")
    found = rows.select("k", pages.microdata(F.col("html"), F.col("url")).alias("m")).collect()
    assert [r.m and [tuple(x) for x in r.m] for r in found] == [None, [("_:#1", "terms#x", "y", "literal")], []]
    assert html.main_of("<div>" * 2000 + "<p>deep text</p>" + "</div>" * 2000) == "deep text"


def test_node_rows_of_slices_are_those_of_arrays(spark):
    from facetry.functions import pages

    texts = [None, "", "<p id=a>x<b y>z</b>", *(f"<ul>{'<li a=1>t' * k}</ul>" for k in range(60))]
    rows = spark.createDataFrame(list(enumerate(texts)), "page long, html string").coalesce(1)
    told = lambda found: sorted((r.page, r.node, r.last, r.parent, r.tag or "", str(r.attributes), r.text or "") for r in found.collect())
    whole = told(axes.nodes_of(rows.select("page", pages.page_nodes(F.col("html")).alias("n")), "page", F.col("n")))
    assert told(pages.page_rows(rows, ["page"], F.col("html"))) == whole and len(whole) > 3000
