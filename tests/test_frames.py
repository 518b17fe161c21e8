"""Trees of cyclic statements, and back."""

import json
import random

from facetry.plans import shapes as s
from facetry.sources import frames

SCHEMA = "graph string, s string, p string, o string, lang string"


def tree(store, node, shape, context, path):
    """The tree of a node by recursion."""
    out = {"@id": node}
    for label, inner in s.fields_of(shape).items():
        p = context.get(label, label)
        found = {(x[0], x[3]) if p[0] == "^" else (x[2], x[3]) for x in store if x[1] == p.lstrip("^") and (x[2] if p[0] == "^" else x[0]) == node}
        nested, texts, one = frames.kinds_of(inner)
        if texts:
            by: dict = {}
            for o, lang in found:
                if lang:
                    by.setdefault(lang, []).append(o)
            value = {k: sorted(v)[0] if frames.alone(inner) else sorted(v) for k, v in by.items()}
        else:
            names = sorted({o for o, _ in found})
            value = [({"@id": o} if o in path else tree(store, o, inner, context, {*path, o})) if nested else o for o in names]
            value = value[0] if value and one else value
        if value:
            out[label] = value
    return out


def test_frames_of_cyclic_graphs(spark):
    random.seed(6)
    store = sorted({(f"n{random.randint(0, 5)}", random.choice("pq"), f"n{random.randint(0, 5)}", None) for _ in range(14)})
    store += [("n0", "name", "zero", "en"), ("n0", "name", "null", "de"), ("n0", "name", "nul", "de"), ("n1", "name", "no language", None), ("n1", "code", "1", None), ("n1", "code", "01", None)]
    leaf = s.both(s.field("code", s.max_count(1)), s.field("name", s.localized()))
    shape = s.both(s.field("p", s.field("p", s.field("q", leaf)), s.field("back", leaf)), s.field("name", s.lang()), s.field("q", s.max_count(1), leaf), s.field("code", True))
    context = {"back": "^p"}
    rows = spark.createDataFrame([("g", *x) for x in store] + [("h", *store[0]), ("g", None, "p", "n1", None)], SCHEMA)
    foci = spark.createDataFrame([(f"n{i}",) for i in range(7)] + [(None,), ("n1",)], "x string")
    found = {r.focus: json.loads(r.json) for r in frames.framed(rows, foci, shape, context).collect()}
    assert found == {f"n{i}": tree(store, f"n{i}", shape, context, {f"n{i}"}) for i in range(7)}
    plain = frames.framed(rows.drop("lang"), foci, s.field("code", s.multiple()), name="id").where("focus = 'n1'").first()
    assert json.loads(plain.json) == {"id": "n1", "code": ["01", "1"]}
    assert frames.framed(rows, foci.limit(0), shape, context).count() == 0


def test_round_trip(spark):
    store = [("a", "knows", "b", None), ("b", "knows", "a", None), ("b", "knows", "c", None), ("a", "name", "A", "en"), ("b", "name", "B", "it"), ("c", "name", "C1", "en"), ("c", "name", "C2", "en"), ("a", "age", "3", None)]
    shape = s.both(s.field("name", s.lang()), s.field("age", s.max_count(1)), s.field("knows", s.field("name", s.lang()), s.field("knows", s.field("name", s.lang()))))
    rows = spark.createDataFrame([("g", *x) for x in store], SCHEMA)
    made = frames.framed(rows, spark.createDataFrame([("a",)], "x string"), shape)
    assert sorted(map(repr, map(tuple, frames.unframed(made, shape).collect()))) == sorted(map(repr, store))
    assert frames.unframed(spark.createDataFrame([("no json",), (None,)], "json string"), shape).count() == 0
