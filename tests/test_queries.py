"""Every query that has SQL gives its rows, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import facetry.language  # noqa: F401
import facetry.modelling  # noqa: F401
import facetry.more  # noqa: F401
import facetry.queries as core
import facetry.reasoning  # noqa: F401
import facetry.vocabulary  # noqa: F401
import facetry.webpages  # noqa: F401
import facetry.wider  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in Path(FOLDER).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([x[i] for i in order]) for x in found)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_matches_sql(spark, sql, name):
    found = core.Q[name](spark, FOLDER)
    told = sql.execute(core.SQL[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == sorted(found.columns)
    assert rows(found.columns, found.collect()) == rows(names, told.fetchall())


def test_pruned_intervals_do_not_overlap(spark):
    kept = core.Q["flow_prune"](spark, FOLDER).toPandas().sort_values(["user_id", "start"])
    before = kept.groupby("user_id")["end"].shift()
    assert len(kept) and not (kept["start"] < before).any()


def test_pruning_keeps_the_greedy_set(spark):
    from facetry.operators import flow

    random = __import__("random").Random(3)
    rows = [(k, a, a + random.randint(1, 30)) for k in range(3) for a in (random.randint(0, 300) for _ in range(60))]
    rows += rows[:5]
    found = sorted(tuple(r) for r in flow.pruned(spark.createDataFrame(rows, "k long, a long, b long"), "k", "a", "b").collect())
    told: list = []
    for k, a, b in sorted(rows, key=lambda r: (r[1] - r[2], r[1])):
        if all(k != x or b <= y or z <= a for x, y, z in told):
            told.append((k, a, b))
    assert found == sorted(told)
    assert flow.pruned(spark.createDataFrame([], "k long, a long, b long"), "k", "a", "b").count() == 0
    for seed in range(3):  # few keys, over many parts: clusters that cross them
        random.seed(seed)
        rows = [(random.choice([1, 1, 1, 2, None]), a, a + random.choice([1, 2, 5, 200]), f"n{i}") for i, a in enumerate(random.randint(0, 2000) for _ in range(400))] + [(1, None, 5, "x"), (2, 7, None, "y")]
        frame = spark.createDataFrame(rows, "k long, a long, b long, name string").repartition(3)
        found = sorted(map(repr, map(tuple, flow.pruned(frame, "k", "a", "b").collect())))
        told = [r for r in rows if None in r[1:3]]
        for k, a, b, n in sorted((r for r in rows if None not in r[1:3]), key=lambda r: (r[1] - r[2], *r[1:])):
            if all(k != x or y is None or z is None or b <= y or z <= a for x, y, z, _ in told):
                told.append((k, a, b, n))
        assert found == sorted(map(repr, told))


def test_densest_element():
    from facetry.functions import html

    page = "<html><head><title>Title</title></head><body><ul><li>one<li>two</ul><div><p>A long paragraph of plain text.</p><p>Another one that goes on.</p></div><p>short</p><script>var x = 'much longer than any text here, but a script';</script></body></html>"
    assert html.main_of(page) == "A long paragraph of plain text.\nAnother one that goes on."
    assert html.main_of("<p>only</p>") == "only" and html.main_of("") is None and html.main_of("<div>no textual element</div>") is None
    assert html.blocks_of("<h1>Top</h1><p>a<br>b</p><ul><li>x</li></ul><style>p{}</style>") == ["# Top", "a\nb", "- x"]


def test_facet_queries_that_are_errors(spark):
    from facetry.plans import facets
    from facetry.sources.catalog import trade

    catalog = trade(spark, FOLDER)
    for text in ("{", ".limit=-1", ".offset=x", '{">= balance": "much"}', "a..b=1"):
        with pytest.raises(facets.Malformed):
            facets.parsed(catalog, "customer", text)
    for text in ("colour=red", "nation.flag=1", "name.x=1", ".terms=size"):
        with pytest.raises(facets.UnknownStep):
            facets.parsed(catalog, "customer", text)
    assert facets.parsed(catalog, "customer", "")["shape"] is True
    assert facets.decoded("a=1,2&a=3&.terms=x,y&.limit=5") == {"a": ["1", "2", "3"], ".terms": "x,y", ".limit": 5}


def test_borders_of_spans(spark):
    from facetry.operators import spans

    left = spark.createDataFrame([(1, 0, 10), (1, 20, 35), (2, 0, 5)], "k long, start long, end long")
    right = spark.createDataFrame([(1, 10, 20), (1, 35, 36), (2, 6, 7), (1, 5, 25)], "k long, start long, end long")
    found = sorted((r.k, r.start, r._start) for r in spans.joined(left, right, "k", "borders", 7).collect())
    assert found == [(1, 0, 10), (1, 20, 10), (1, 20, 35)]
    assert spans.joined(left, right, "k", "intersects", 4).count() == 2


def test_spans_of_all_lengths_against_pairs(spark):
    from facetry.operators import spans

    random = __import__("random").Random(9)
    span = lambda: (random.choice([1, 1, 2, None]), a := random.randint(-50, 400), a + random.choice([1, 2, 7, 40, 300, 5000]))
    left, right = [span() for _ in range(60)] + [(1, None, 5)], [span() for _ in range(60)] + [(1, 3, None)]
    frames = [spark.createDataFrame(rows, "k long, start long, end long") for rows in (left, right)]
    for how, test in {"contains": lambda a, b, c, d: a <= c and d <= b, "intersects": lambda a, b, c, d: a < d and c < b, "borders": lambda a, b, c, d: b == c or d == a}.items():
        told = sorted((k, a, b, c, d) for k, a, b in left for x, c, d in right if k is not None and k == x and None not in (a, b, c, d) and test(a, b, c, d))
        found = sorted((r.k, r.start, r.end, r._start, r._end) for r in spans.joined(*frames, "k", how, 5).collect())
        assert found == told, how
    assert spans.joined(frames[0].limit(0), frames[1].limit(0), "k", "contains", 5).count() == 0


def test_held_spans_are_counted_without_pairs(spark):
    from facetry.operators import spans

    random = __import__("random").Random(5)
    some = lambda n, most: [(random.choice(["a", "b", None]), a, a + random.randint(0, most)) for a in (random.randint(0, 40) for _ in range(n))]
    for most in ((9, 9), (30, 4), (3, 30)):  # spans of one length, holders, and held ones that are longer
        outer, inner = some(60, most[0]), some(90, most[1])
        outer, inner = [*outer, *outer[:5], ("a", None, 3), ("b", 3, None)], [*inner, *inner[:9], ("a", 2, None), ("b", None, 9)]
        left, right = (spark.createDataFrame(x, "k string, start long, end long") for x in (outer, inner))
        holds = lambda x, y: None not in (*x, *y) and x[0] == y[0] and x[1] <= y[1] and y[2] <= x[2]
        found = sorted(map(repr, (tuple(r) for r in spans.held(left, right, "k").collect())))
        assert found == sorted(repr((*x, sum(holds(x, y) for y in inner))) for x in outer)
        assert {r.held for r in spans.held(left, right.limit(0), "k").collect()} == {0}
