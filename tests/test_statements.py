"""Closures and inference against plain versions."""

import random

import pytest

from facetry.operators import flow, graph, inference


def test_a_chain_of_a_thousand_takes_few_rounds(spark, monkeypatch):
    rounds, grow = [], flow.Grown.grow
    monkeypatch.setattr(flow.Grown, "grow", lambda self, rows: rounds.append(1) or grow(self, rows))
    chain = spark.createDataFrame([(i, i + 1) for i in range(1000)] + [(None, 3), (5, None), (7, 8)], "a long, b long")
    assert graph.closure(chain).count() == 1000 * 1001 // 2
    assert len(rounds) <= 12


def test_closure_of_cycles_and_nothing(spark):
    random.seed(1)
    edges = {(random.randint(0, 30), random.randint(0, 30)) for _ in range(40)}
    told = set(edges)
    while more := {(a, d) for a, b in told for c, d in edges if b == c} - told:
        told |= more
    assert {tuple(r) for r in graph.closure(spark.createDataFrame(sorted(edges), "a long, b long")).collect()} == told
    assert graph.closure(spark.createDataFrame([], "a long, b long")).count() == 0


def test_loops_go_on_until_nothing_is_new(spark):
    start = spark.createDataFrame([(0,)], "n long")
    step = lambda rows: rows.where("n < 104").selectExpr("n + 1 AS n")
    assert flow.looped(start, step).count() == 105  # over a hundred steps, parts written together on the way
    with pytest.raises(RuntimeError):
        flow.looped(start, step, most=5)
    nulls = spark.createDataFrame([(None, 1)], "a long, n long")
    assert flow.looped(nulls, lambda r: r.selectExpr("a", "least(n + 1, 3) AS n")).count() == 3


def plain(store):
    known = set(store)
    while True:
        more = set()
        for s, p, o in known:
            for a, q, b in known:
                if q == inference.SUBPROPERTY and a == p:
                    more.add((s, b, o))
                if q == inference.DOMAIN and a == p:
                    more.add((s, inference.TYPE, b))
                if q == inference.RANGE and a == p:
                    more.add((o, inference.TYPE, b))
                if q == inference.SUBCLASS and p == inference.TYPE and a == o:
                    more.add((s, inference.TYPE, b))
                if p == q and q in (inference.SUBCLASS, inference.SUBPROPERTY) and o == a:
                    more.add((s, q, b))
        if more <= known:
            return known
        known |= more


def test_inference_against_a_fixpoint(spark):
    random.seed(3)
    names = [f"n{i}" for i in range(6)]
    words = [inference.TYPE, inference.SUBCLASS, inference.SUBPROPERTY, inference.DOMAIN, inference.RANGE]
    for seed in range(3):
        random.seed(seed)
        store = [(random.choice(names), random.choice([*names[:3], *words]), random.choice(names)) for _ in range(9)]
        store += [("n1", inference.SUBPROPERTY, inference.SUBCLASS)] * (seed % 2) + [("n2", inference.SUBPROPERTY, inference.DOMAIN), (inference.TYPE, inference.SUBPROPERTY, "n0")] * (seed // 2)
        frame = spark.createDataFrame([("g", *x) for x in store] + [("g", None, "n1", "n2")], graph.STATEMENT)
        assert {tuple(r) for r in inference.inferred(frame).collect()} == plain(store)
    assert inference.inferred(spark.createDataFrame([], "graph string, s string, p string, o string")).count() == 0


def test_literals_have_no_type_from_a_range(spark):
    store = spark.createDataFrame([("g", "p", inference.RANGE, "C"), ("g", "x", "p", '"text"'), ("g", "x", "p", "y")], graph.STATEMENT)
    found = {tuple(r) for r in inference.inferred(store, ~store.o.startswith('"')).collect()}
    assert ("y", inference.TYPE, "C") in found and ('"text"', inference.TYPE, "C") not in found


def test_a_closure_joins_each_pair_of_a_chain_once(spark, monkeypatch):
    made, unknown = [], graph.unknown
    monkeypatch.setattr(graph, "unknown", lambda first, then, known: made.append(first.join(then.selectExpr("a AS b", "b AS c"), "b").count()) or unknown(first, then, known))
    assert graph.closure(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")).count() == 200 * 201 // 2
    assert sum(made) <= 200 * 201 // 2 + 200  # as many rows as pairs, a pair of exactly twice the length perhaps once more
