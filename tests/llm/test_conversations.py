"""Repair of conversations against all edits tried one by one, and against SQL."""

import hashlib
import random
import re
import zlib

import duckdb
from helpers import FOLDER, LARGER

from facetry.llm import conversations as c
from facetry.llm import queries, repair_sql

SCHEMA = "conv_id long, turn long, role string, text string"
NO_TEXT = hashlib.sha256(b"").hexdigest()


def cheapest(signature: str) -> tuple[int, str]:
    """All edits of a signature, tried one by one."""
    best = [(c.DELETE * len(signature), "D" * len(signature))]

    def go(rest, out, cost, audit, inserts):
        if cost > best[0][0]:
            return
        if not rest:
            if re.fullmatch("(s?(ua)+)?", out):
                best[0] = min(best[0], (cost, audit))
        else:
            row, cut = rest[0].lower(), c.CUT if rest[0].isupper() else 0
            go(rest[1:], out, cost + c.DELETE, audit + "D", 0)
            if rest[0] != c.GONE:
                if row in "sua":
                    go(rest[1:], out + row, cost + cut, audit + "K", 0)
                for role in "ua":
                    go(rest[1:], out + role, cost + c.REROLE + cut, audit + "R", 0)
        if inserts < 2:
            for role in "ua":
                go(rest, out + role, cost + c.INSERT, audit + "I", inserts + 1)

    go(signature, "", 0, "", 0)
    return best[0]


def test_cheapest_edits_of_signatures():
    random.seed(4)
    signatures = sorted({"".join(random.choices("suaSUAxoO", k=random.randint(0, 5))) for _ in range(250)})
    trie = c.Trie()
    for s in signatures:
        cost, edits = trie.insert(s)
        assert (cost, "".join(e for e, _ in edits)) == cheapest(s), s
    nodes = len({s[:k] for s in signatures for k in range(1, len(s) + 1)})
    assert trie.made == nodes  # a layer for each node of the trie, no more


def plain_report(rows):
    """The contract, row by row in Python."""
    kept = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        if hit:
            kept += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults, signature = set(), [], ""
        for _, _, role, text in own:
            body = text.strip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            code = role[:1] if role[:1] in tuple("sua") else c.OTHER
            signature += c.GONE if fault in ("blank", "duplicate") else code.upper() if fault else code
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:], strict=False)]
        cost, audit = cheapest(signature) if own else (0, "")
        told, left = [], iter(own)
        for e in audit:
            role, text = ("", "") if e == "I" else next(left)[2:]
            last = told[-1][0][:1] if told else ""
            if e != "D":
                told.append((role if e == "K" else "assistant" if last == "u" else "user", text))
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in told).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


def test_edges_against_a_plain_version(spark):
    random.seed(8)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User"], ["Well.", "Well", "", " \t\n", None, "Ends here! ", "é?", "a.b"]
    rows = [(k, random.choice([t, t, t + 2, None]), random.choice(roles[: 3 + (k or 0) % 3 * 2]), random.choice(texts)) for k in [*range(40), None] for t in range(random.randint(0, 4))]
    rows += [(100, None, None, None), (101, 3, "user", "same."), (101, 3, "user", "same."), (102, 5, "user", "x" * 300_000 + ".")]
    told = plain_report(rows)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'extra' AS position", "1 AS fault", "'k' AS code", "0 AS cost", "'y' AS audit", "'z' AS _conv")
    found = c.damage_report(frame).collect()
    assert len(found) == len(told) and {r[0]: tuple(r)[1:] for r in found} == told
    assert c.damage_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repaired_rows_are_in_order(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "Late."), (1, 0, "assistant", "Hi."), (2, 0, "user", "  "), (3, 0, "system", "Rules."), (3, 1, "tool", "x"), (4, 9, "assistant", "Only.")], SCHEMA)
    plans, repaired = c.repaired_conversations(rows)
    assert {r.conv_id: (r.audit, r.cost) for r in plans.collect()} == {1: ("RK", 3), 2: ("D", 4), 3: ("DD", 8), 4: ("IK", 3)}
    assert [tuple(r)[2:] for r in repaired.orderBy("conv_id", "position").collect()] == [("user", "Hi."), ("assistant", "Late."), ("user", ""), ("assistant", "Only.")]


def test_a_signature_of_many_conversations_falls_into_several_tasks(spark):
    many = spark.range(20_000).selectExpr("id AS conv_id", "'ua' AS signature")
    found = c.repair_plans(many).selectExpr("spark_partition_id() AS part", "audit").groupBy("part", "audit").count().collect()
    assert len(found) > 1 and {r.audit for r in found} == {"KK"}


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{LARGER}/conversations.parquet' UNION ALL SELECT NULL, 1, NULL, 'x.' UNION ALL SELECT 5000000, NULL, 'user', NULL")
    told = con.execute(repair_sql.report_sql())
    names = [x[0] for x in told.description]
    spark.read.parquet(f"{LARGER}/conversations.parquet").createOrReplaceTempView("c_all")
    rows = spark.sql("SELECT * FROM c_all UNION ALL SELECT NULL, 1, NULL, 'x.' UNION ALL SELECT 5000000, NULL, 'user', NULL")
    found = [tuple(r[k] for k in names) for r in c.damage_report(rows).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, told.fetchall()))
    assert queries.op11_conversation_repair(spark, FOLDER).columns == names
