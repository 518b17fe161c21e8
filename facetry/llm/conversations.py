"""Repair of conversations: the cheapest edits after which roles read ``(s?(ua)+)?``, by dynamic programming over a trie of signatures.

A conversation's signature has a character a row: its role's initial and whether the row must go or is cut off. Conversations are dealt
out by ranges of their signatures and come sorted: a task walks the trie of its signatures depth first, holds the layers along
one path, and computes a layer once for all signatures that share the prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from facetry.llm.texts import bucket_of, checkpointed, parallelism

#: Costs of the edits, whose initials make the audit; CUT is added for each row that stays and is cut off.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States by the roles told so far: none, a system row, a user row last, an assistant row last. The first and last may end a conversation.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Where the roles that may follow a state lead.
NEXT = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: In a signature a row that must go; other rows have their role's initial or OTHER, in upper case if they are cut off.
GONE, OTHER = "x", "o"

#: What is no character of a word.
SPACES = " \t\n\v\f\r"

#: A layer has for each state reached: cost, rank of its audit among the states' audits, and the way here: state before, inserted rows, edit.
Layer = dict[int, tuple[int, int, int, int, str]]


def inserted(state: int, n: int) -> int:
    """The state after n rows are inserted: each is a user's or an assistant's, whichever may follow."""
    for _ in range(n):
        state = ASSISTANT if state == USER else USER
    return state


def next_layer(layer: Layer, row: str) -> Layer:
    """The layer after one more row. No audit of a layer begins another, as all have its number of rows and end with one, so ranks and the edits since compare them."""
    best: dict[int, tuple] = {}
    role, cut = row.lower(), CUT if row.isupper() else 0
    for state, (cost, rank, *_) in layer.items():
        for n in range(3):
            here = inserted(state, n)
            ways = [("D", here, DELETE)]
            if row != GONE:
                ways.append(("R", inserted(here, 1), REROLE + cut))
                ways += [("K", NEXT[here][role], KEEP + cut)] if role in NEXT[here] else []
            for edit, to, more in ways:
                way = (cost + n * INSERT + more, rank, "I" * n + edit, state, n, edit)
                if to not in best or way < best[to]:
                    best[to] = way
    order = sorted(best, key=lambda q: best[q][1:3])
    return {q: (best[q][0], k, *best[q][3:]) for k, q in enumerate(order)}


def ending(layers: list[Layer]) -> tuple[int, list[tuple[str, int]]]:
    """The least cost of the whole, and its edits: letter, and the state after it."""
    ends = []
    for state, (cost, rank, *_) in layers[-1].items():
        for n in range(3):
            if inserted(state, n) in (NOTHING, ASSISTANT):
                ends.append((cost + n * INSERT, rank, n, state))
                break
    cost, _, n, state = min(ends)
    edits = [("I", inserted(state, k + 1)) for k in reversed(range(n))]
    for layer in reversed(layers[1:]):
        _, _, before, n, edit = layer[state]
        edits.append((edit, state))
        edits += [("I", inserted(before, k + 1)) for k in reversed(range(n))]
        state = before
    return cost, edits[::-1]


class Trie:
    """The layers along the path of the last signature; sorted signatures visit each node of their trie once."""

    def __init__(self):
        self.path, self.layers, self.made = "", [{NOTHING: (0, 0, NOTHING, 0, "")}], 0
        self.answer = ending(self.layers)

    def insert(self, signature: str) -> tuple[int, list[tuple[str, int]]]:
        if signature != self.path:
            same = next((i for i, (a, b) in enumerate(zip(signature, self.path, strict=False)) if a != b), min(len(signature), len(self.path)))
            del self.layers[same + 1 :]
            for row in signature[same:]:
                self.layers.append(next_layer(self.layers[-1], row))
            self.made += len(signature) - same
            self.path, self.answer = signature, ending(self.layers)
        return self.answer


def spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes out ``[.!?]``, 3 repeats it, 4 makes it a user's. Nulls of role, text and in the key are one space."""
    fault = bucket_of(F.concat_ws(":", spaced("conv_id"), spaced("turn")), 20)
    text = F.when(fault == 1, "").when(fault == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(fault == 4, "user").otherwise(spaced("role"))
    copies = F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_")).drop("_")


def with_faults(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``position`` in the conversation, ``fault`` (the first of blank, duplicate, truncated; else null) and ``code``, the row's character of the signature.

    The order is by turn, nulls first, then role and text, so that it doesn't hang on how rows lie. Rows are dealt out once, by
    conversation, and sorted within the partitions, where sorts may spill.
    """
    dealt = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text")).repartition(parallelism(rows.sparkSession), "conv_id")
    turn = F.col("turn").asc_nulls_first()
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(turn, "role", "text"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("position")) > 1
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(end == "", "blank").when(again, "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise(OTHER)
    code = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(plain)).otherwise(plain)
    return dealt.withColumn("position", at).withColumn("fault", fault).withColumn("code", code)


def summaries(rows: DataFrame) -> DataFrame:
    """A row for each conversation with rows left: gaps, faults, adjacent roles that don't follow, and the signature."""
    before = F.lag(F.substring("role", 1, 1)).over(Window.partitionBy("conv_id").orderBy("position"))
    pair = F.concat(before, F.substring("role", 1, 1))
    first = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("position"))
    counted = rows.select("conv_id", "turn", "position", "fault", "code", (pair.isNotNull() & ~pair.isin("su", "ua", "au")).alias("bad"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(first)).alias("new"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum(F.col("new").cast("long")), F.lit(0)).cast("long")
    count = lambda test: F.sum(test.cast("long"))
    faults = [F.coalesce(count(F.col("fault") == k), F.lit(0)).alias(k) for k in ("blank", "duplicate", "truncated")]
    code = F.sort_array(F.collect_list(F.struct("position", "code")))
    return counted.groupBy("conv_id").agg(gaps.alias("gaps"), *faults, count(F.col("bad")).alias("illegal"), F.array_join(F.transform(code, lambda x: x["code"]), "").alias("signature"))


def repair_plans(conversations: DataFrame) -> DataFrame:
    """Adds ``cost``, ``audit`` and ``states`` (the state after each edit) to conversations with a ``signature``. A signature that very many share falls into several tasks."""
    schema = conversations.select("*", F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"), F.lit("").alias("states")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            found = [(cost, "".join(e for e, _ in edits), "".join(str(q) for _, q in edits)) for cost, edits in map(trie.insert, batch["signature"].to_pylist())]
            new = [pa.array(list(x), kind) for x, kind in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)] if found else [pa.array([], k) for k in (pa.int64(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    dealt = conversations.repartitionByRange(parallelism(conversations.sparkSession), "signature", F.xxhash64("conv_id"))
    return dealt.sortWithinPartitions("signature").mapInArrow(run, schema)


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv_id``, ``position``, ``role``, ``text`` of the repaired conversations, a conversation's rows one after the other.

    A conversation's plan comes first, then its rows, sorted: they pass through a task one by one and are never held together.
    """
    told = plans.select("conv_id", F.lit(0).alias("position"), F.col("audit").alias("role"), F.col("states").alias("text"))
    both = told.unionByName(rows.select("conv_id", "position", "role", "text")).repartition(parallelism(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "position")
    schema = both.select("conv_id", F.col("position").cast("long").alias("position"), "role", "text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(walked(batches), to_arrow_schema(schema))

    return both.mapInArrow(run, schema)


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The repaired rows of conversations that come as position 0 with audit and states, then their rows."""
    conv, steps, at = None, iter(()), 0
    for batch in batches:
        for key, position, role, text in zip(*(batch[k].to_pylist() for k in ("conv_id", "position", "role", "text")), strict=True):
            if position == 0:
                for _, named in steps:  # inserted after the last row of the conversation before
                    at += 1
                    yield conv, at, named, ""
                conv, at, steps = key, 0, iter([(e, NAMES.get(int(q))) for e, q in zip(role, text, strict=True)])
                continue
            for edit, named in steps:
                if edit != "D":
                    at += 1
                    yield conv, at, role if edit == "K" else named, "" if edit == "I" else text
                if edit != "I":
                    break
    for _, named in steps:
        at += 1
        yield conv, at, named, ""


def in_batches(rows: Iterator[tuple], arrow: pa.Schema, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of a few MB of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[-1] or "")
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)


def digests(repaired_rows: DataFrame) -> DataFrame:
    """``conv_id`` and ``repaired_sha256``, of ``role:text`` joined by newlines, from what ``repaired`` gives, in its order; a conversation without rows has none."""
    schema = repaired_rows.select("conv_id", F.lit("").alias("repaired_sha256")).schema

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, found = None, None
        for batch in batches:
            for key, position, role, text in zip(*(batch[k].to_pylist() for k in ("conv_id", "position", "role", "text")), strict=True):
                if position == 1:
                    if found:
                        yield conv, found.hexdigest()
                    conv, found = key, hashlib.sha256()
                found.update(("\n" * (position > 1) + f"{role}:{text}").encode())
        if found:
            yield conv, found.hexdigest()

    return repaired_rows.mapInArrow(lambda batches: in_batches(hashed(batches), to_arrow_schema(schema)), schema)


def repaired_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each ``conv_id`` of a table (``conv_id``, ``turn``, ``role``, ``text``) its report, and the rows of its repaired form.

    The rows are taken as they are, but for nulls of role and text, which are one space. A null identifier is a conversation of its own,
    null turns come first, rows of equal turn in the order of role and text, and extra columns are left out. An empty role, or one of another
    initial than s, u, a, can't be kept. Conversations without rows aren't reported.
    """
    rows = checkpointed(with_faults(conversations))
    plans = checkpointed(repair_plans(summaries(rows)))
    return plans, repaired(rows, plans)


def damage_report(conversations: DataFrame) -> DataFrame:
    """A row for each identifier of the table: the report of its conversation after ``damaged``, and the digest of the repaired form. Conversations that lose all rows have zeros, an empty audit and the digest of no text."""
    plans, rows = repaired_conversations(damaged(conversations))
    every = conversations.select(F.col("conv_id").alias("_conv")).distinct()
    same = lambda name: F.col("_conv").eqNullSafe(F.col(f"{name}.conv_id"))
    found = every.join(plans.alias("plans"), same("plans"), "left").join(digests(rows).alias("texts"), same("texts"), "left")
    zero = [F.coalesce(F.col(k), F.lit(0).cast("long")).alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("_conv").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
