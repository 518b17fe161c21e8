"""Fill-in-the-middle against a plain version with a regular expression."""

import hashlib
import re

from helpers import FOLDER, documents

from facetry.llm import middle, queries


def plain(doc_id, text):
    text, h = text or "", hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


EDGES = [None, "", "\n", "\n\n", "a", "a\nb", "é𝕏\n\U0001f600 b\r\nc", "<", "<P", "x<S", "<<\n<P>", "has <M> inside\n", "tail\n", "line\n" * 40_000, "z" * 200_000, " \x85\n\x0b", "same\nsame", "same\nsame", "<\nS>\nM>"]


def test_edges_against_a_plain_version(spark):
    rows = [(k, t) for k, t in enumerate(EDGES)] + [(None, "no\nidentifier\nhere"), (2, "again\n\nand"), (2, "again\n\nand")]
    frame = documents(spark, rows).selectExpr("*", "'extra' AS draws", "1 AS n", "'x' AS form", "'y' AS output")
    made = middle.fill_in_middle(frame)
    found = made.withColumn("back", middle.restored(made.output, made.form)).collect()
    told = [(k, *plain(k, t), t or "") for k, t in rows]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, told))
    assert middle.fill_in_middle(documents(spark, [])).count() == 0


def test_rates(spark):
    docs = documents(spark, [(k, "a\nb\nc\n") for k in range(600)])
    forms = [r.form for r in middle.fill_in_middle(docs, rate=50, spm=100).collect()]
    assert 220 < forms.count("plain") < 380 and forms.count("spm") == 600 - forms.count("plain")
    assert {r.form for r in middle.fill_in_middle(docs, spm=0).collect()} == {"psm"}


def test_query_gives_whole_texts_back(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in queries.op12_fill_in_middle(spark, FOLDER).collect():
        *told, output = plain(r.doc_id, texts[r.doc_id])
        assert [r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256] == [*told, digest(output), digest(texts[r.doc_id] or "")]
