"""Typed tokens, labels in texts, against plain versions."""

import random

from pyspark.sql import functions as F

from facetry.functions import models as md
from facetry.functions import tokens as tk
from facetry.operators import labels as lb
from facetry.operators import linker as ln


def told(text):
    return [f"{t}/{kind}" if kind else t for t, kind, _, _ in tk.Tokenizer()(text)]


def test_rules_in_order():
    assert told("Say: a this-and-that") == ["Say", ":", "a", "this", "-", "and", "-", "that"]
    assert told("U-turn e-sports") == ["U-turn", "e-sports"]
    assert told("Škoda €") == ["Škoda", "€/SYM"]
    assert told("1 1.2 .1 +1,234 -1,234.56") == [f"{x}/CD" for x in "1 1.2 .1 +1,234 -1,234.56".split()]
    assert "http://example.com/x/y/NNP" in told("from http://example.com/x/y, c@pcs")
    found = told("10 c@pcs from x.y@example.com")
    assert "x.y@example.com/NNP" in found and "c@pcs/NNP" not in found
    for text in ("e-Crafter e-troFit E.ON itMoves iPod", "R&D EV", "L7E-CU U6ion Cov19 Cov-19B 9x ABC/12"):
        assert told(text) == [f"{x}/NNP" for x in text.split()]
    assert told("well... so. (no)") == ["well", "...", "so", ".", "(", "no", ")"]
    assert told("") == told(" \n\t ") == []


def test_own_rules():
    tokenizer = tk.Tokenizer((tk.Rule(r"\w+", "CUSTOM"),))
    assert tokenizer("test, me") == [("test", "CUSTOM", 0, 4), ("me", "CUSTOM", 6, 8)]


def test_offsets_give_the_texts(spark):
    random.seed(3)
    parts = ["word", "U-turn", "R&D", "9x", "1,234.5", "-", "...", "é", "日本語", "🙂", "a@b.cc", "http://x.y/z?q=1.", "A", " ", "\n", " ", "_", "+€", ".5"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(400)] + [None, "", "x" * 200_000, "a-" * 20_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", "text", tk.typed_tokens(F.col("text")).alias("tokens"))
    for r in rows.collect():
        assert (r.tokens is None) == (r.text is None)
        last = 0
        for t in r.tokens or []:
            assert t.text == r.text[t.start : t.end] and t.text and t.start >= last and not r.text[last : t.start].strip()
            last = t.end
        assert not (r.text or "")[last:].strip()
    whole = rows.where("k < 400").select("text", tk.chunk_text(F.col("tokens")).alias("chunk")).collect()
    assert all(r.chunk == " ".join(r.text.split()) for r in whole)


def test_label_matches_against_a_scan(spark):
    random.seed(5)
    words = ["a", "b", "A", "c", "d", "dd", "E.ON", ","]
    texts = [(k, " ".join(random.choices(words, k=random.randint(0, 40)))) for k in range(120)] + [(1000, None), (1001, ""), (None, "a b"), (1002, "a " * 3000)]
    labels = [(e, " ".join(random.choices(words, k=random.randint(1, 4)))) for e in range(60)] + [(1, "a"), (1, "a"), (2, "A b"), (3, "missing a"), (4, ""), (5, None), (None, "a"), (6, "a  B")]
    weights = spark.createDataFrame([(1, 10), (2, 20)], "entity long, weight long")
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("token", F.lit("extra")).withColumn("at", F.lit(1))
    entities = spark.createDataFrame(labels, "e long, name string").withColumn("weight", F.lit("extra"))
    found = lb.label_matches(frame, "doc_id", "text", lb.labelled(entities, "e", "name", weights))
    tokenizer, expected = tk.Tokenizer(), []
    for e, label in {(e, x) for e, x in labels if e is not None and x}:
        want = [t[0].lower() for t in tokenizer(label)]
        for k, text in texts:
            have = tokenizer(text or "") if k is not None else []
            for i in range(len(have) - len(want) + 1):
                if [t[0].lower() for t in have[i : i + len(want)]] == want:
                    expected.append((k, e, label, {1: 10, 2: 20}.get(e, 0), i, len(want), have[i][2], have[i + len(want) - 1][3]))
    assert sorted(map(tuple, found.collect())) == sorted(expected) and len(expected) > 1000
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lb.label_matches(none, "doc_id", "text", lb.labelled(entities, "e", "name")).count() == 0
    assert lb.label_matches(frame, "doc_id", "text", lb.labelled(entities.limit(0), "e", "name")).count() == 0


def lengths(model, tokens, i):
    """How many tokens a model, told as nested tuples, matches at a place, or -1: the rules, by recursion."""
    kind, *parts = model
    if kind == "token":
        return 1 if i < len(tokens) and parts[0](*tokens[i][:2]) else -1
    if kind == "then":
        a = lengths(parts[0], tokens, i)
        b = lengths(parts[1], tokens, i + a) if a >= 0 else -1
        return a + b if b >= 0 else -1
    if kind == "or":
        return max(lengths(p, tokens, i) for p in parts)
    n = lengths(parts[0], tokens, i)
    if kind == "optional":
        return max(0, n)
    if kind == "repeated":
        total = 0
        while n > 0:
            total += n
            n = lengths(parts[0], tokens, i + total)
        return total if total or not parts[1] else -1
    if kind == "ahead":
        return 0 if n >= 0 else -1
    if kind == "not":
        return -1 if n >= 0 else 0
    hits = sum(parts[1](*t[:2]) for t in tokens[i : i + max(n, 0)])
    return n if n > 0 and {"every": hits == n, "some": hits > 0, "none": hits == 0}[kind] else -1


def built(model):
    kind, *parts = model
    if kind == "token":
        return md.token(parts[0])
    first = built(parts[0])
    if kind in ("then", "or"):
        return first + built(parts[1]) if kind == "then" else first | built(parts[1])
    if kind == "not":
        return ~first
    return getattr(first, kind)(*parts[1:])


TESTS = [md.upper, md.lower, md.typed("CD"), md.typed(), md.among("OF", "the"), lambda t, k: t == "a"]


def some_model(depth):
    if not depth or random.random() < 0.2:
        return "token", random.choice(TESTS)
    kind = random.choice(["then", "then", "or", "optional", "repeated", "repeated", "ahead", "not", "every", "some", "none"])
    inner = some_model(depth - 1)
    if kind in ("then", "or"):
        return kind, inner, some_model(depth - 1)
    if kind == "repeated":
        return kind, inner, random.choice([0, 1])
    return (kind, inner, random.choice(TESTS)) if kind in ("every", "some", "none") else (kind, inner)


def test_models_against_recursion(spark):
    random.seed(11)
    words = ["a", "b", "The", "of", "A", "12", "R&D", "Big", ","]
    texts = [" ".join(random.choices(words, k=random.randint(0, 12))) for _ in range(60)] + ["", "a " * 500]
    tokenizer = tk.Tokenizer()
    every = [tokenizer(t) for t in texts]
    flat = [x for tokens in every for x in [*tokens, (None, None)]]
    batch = md.Tokens([x[0] for x in flat], [x[1] for x in flat])
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k long, text string").select("k", tk.typed_tokens(F.col("text")).alias("t")).coalesce(1)
    for n in range(120):
        model = some_model(3)
        told = [lengths(model, tokens, i) for tokens in every for i in range(len(tokens) + 1)]
        found = built(model).lengths(batch).tolist()
        ends = {sum(len(t) + 1 for t in every[: k + 1]) - 1 for k in range(len(every))}
        assert [x for i, x in enumerate(found) if i not in ends] == [x for i, x in enumerate(told) if i not in ends], model
        if n < 8:
            expected = []
            for k, tokens in enumerate(every):
                i = 0
                while i < len(tokens):
                    size = lengths(model, tokens, i)
                    if size > 0:
                        expected.append((k, "X", i, size, tokens[i][2], tokens[i + size - 1][3]))
                    i += max(size, 1)
            got = rows.select("k", F.inline(md.model_matches(F.col("t"), built(model), "X"))).collect()
            assert sorted(map(tuple, got)) == sorted(expected), model
    assert rows.where("k = 62").select(md.model_matches(F.col("t"), md.token(md.upper))).first()[0] is None


def test_ngrams_and_corpora(spark):
    rows = spark.createDataFrame([("The big R&D lab of Ada 7",), ("",), (None,)], "text string").select(tk.typed_tokens(F.col("text")).alias("t"))
    found = rows.select(F.inline(md.ngrams(F.col("t"), 1, 3))).collect()
    assert sorted((r.first, r.words) for r in found) == [(0, 1), (0, 3), (2, 1), (5, 1), (5, 2)]
    words = spark.createDataFrame([("Red", ""), ("red", "NN"), ("blue", ""), (None, ""), ("Blue", None)], "text string, type string")
    corpora = spark.createDataFrame([("RED", "C1", 1), ("red", "C2", 0), ("blue", "C3", 5), (None, "C4", 0)], "entry string, type string, rank int")
    assert sorted(map(repr, map(tuple, ln.tagged(words, corpora).collect()))) == sorted(map(repr, [("Red", "C2"), ("red", "NN"), ("blue", "C3"), (None, ""), ("Blue", None)]))


def test_linking_against_a_plain_loop(spark):
    random.seed(21)
    matches = [(d, e, f"L{e % 4}", random.randint(0, 5), s, s + random.choice([3, 5, 8])) for d in range(30) for _ in range(random.randint(1, 9)) for e in [random.randint(0, 9)] for s in [random.choice([0, 2, 4, 6, 10, 20])]]
    targets = [(d, s, s + 2) for d in range(30) for s in random.sample(range(0, 24), 6)] + [(None, 0, 9)]
    edges = [(random.randint(0, 9), random.randint(0, 9)) for _ in range(25)]
    found = ln.linked(
        spark.createDataFrame([(d, e, n, w, s, z) for d, e, n, w, s, z in matches], "doc_id long, entity long, label string, weight long, start int, end int"),
        spark.createDataFrame(targets, "doc_id long, start int, end int"),
        spark.createDataFrame(edges, "s long, o long"),
    )
    expected = []
    for d in range(30):
        own = {m for m in matches if m[0] == d and any(t[0] == d and m[4] <= t[1] and t[2] <= m[5] for t in targets)}
        kept: list = []
        for s, z in sorted({m[4:] for m in own}, key=lambda p: (p[0] - p[1], p)):
            if all(z <= a or b <= s for a, b in kept):
                kept.append((s, z))
        own = {m for m in own if m[4:] in kept}
        low, high = min((m[3] for m in own), default=0), max((m[3] for m in own), default=0)
        known = {m[1] for m in own}
        alike = {(a[1], b[1]) for a in own for b in own if a[2] == b[2]}
        for s, z in kept:
            ways = []
            for e in {m[1] for m in own if m[4:] == (s, z)}:
                near = {o for x, y in edges for a, o in ((x, y), (y, x)) if a == e and o != e and o in known and (e, o) not in alike}
                for m in own:
                    if m[1] == e and m[4:] == (s, z):
                        ways.append((-((0.1 * (m[3] - low) / (high - low) if high > low else 0.1) + len(near)), e))
            weight, e = min(ways)
            expected.append((d, s, z, e, -weight))
    got = sorted((r.doc_id, r.start, r.end, r.entity, r.weight) for r in found.collect())
    assert [x[:4] for x in got] == [x[:4] for x in sorted(expected)] and all(abs(a[4] - b[4]) < 1e-9 for a, b in zip(got, sorted(expected), strict=True))


def test_rows_of_slices(spark):
    """Tokens and matches by slices of rows are those by whole arrays, and no more than a slice is told at once."""
    from facetry.functions import slices

    texts = ["Ada of the Lab 9x", None, "", "x　Y\u0085Z", *(f"The E.ON{k} R&D é 🙂 {'Ab ' * k}." for k in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").coalesce(1)
    plain = rows.select("k", tk.typed_tokens(F.col("text")).alias("t"))
    tokens = sorted(map(tuple, tk.token_rows(rows, ["k"], F.col("text"), "at").collect()))
    assert tokens == sorted((r.k, i, *x) for r in plain.collect() for i, x in enumerate(r.t or []))
    assert [x for x in tokens if x[0] == 3] == [(3, 0, "x", "", 0, 1), (3, 1, "Y", "", 2, 3), (3, 2, "Z", "", 4, 5)]
    name = md.token(md.upper).repeated(1)
    matches = sorted(map(tuple, md.model_rows(rows, ["k"], F.col("text"), name, "N").collect()))
    assert matches == sorted(map(tuple, plain.select("k", F.inline(md.model_matches(F.col("t"), name, "N"))).collect())) and len(matches) > 300
    batch = rows.toArrow().to_batches()[0]
    parts = list(slices.slices(batch, "text", 4000))
    assert len(parts) > 5 and sum(p.num_rows for p in parts) == batch.num_rows
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p["text"].to_pylist()) <= 4000 for p in parts)


def test_links_of_texts_are_those_of_matches_and_targets(spark):
    """Places told in one pass link as matches and targets joined afterwards; a label of many words, over other powers of two, is found in texts of its words only."""
    random.seed(9)
    words = ["Ada", "of", "Lab", "x", "the", "E.ON", "y"]
    texts = [(k, " ".join(random.choices(words, k=random.randint(0, 60)))) for k in range(150)] + [(500, None), (None, "Ada Lab"), (501, "x " * 900), (502, "")]
    names = sorted({" ".join(random.choices(words, k=random.randint(1, 6))) for _ in range(80)})
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    entities = lb.labelled(spark.createDataFrame([(k % 30, n) for k, n in enumerate(names)] + [(77, "x " * 37)], "e long, name string"), "e", "name")
    edges = spark.createDataFrame([(random.randint(0, 40), random.randint(0, 40)) for _ in range(200)], "s long, o long")
    model = md.token(md.upper).repeated(1)
    targets = md.model_rows(frame, ["doc_id"], F.col("text"), model)
    matches = lb.label_matches(frame, "doc_id", "text", entities)
    assert matches.where("entity = 77").select("doc_id", "first").distinct().count() == 900 - 37 + 1
    plans = ln.linked_texts(frame, "doc_id", "text", entities, model, edges)
    found = sorted(map(tuple, plans.collect()))
    assert found == sorted(map(tuple, ln.linked(matches, targets, edges).collect())) and len(found) > 100
    assert "Exchange" not in lb.label_places(frame, "doc_id", "text", lb.keyed(entities))._jdf.queryExecution().executedPlan().toString()  # words aren't shuffled
