"""Byte-pair encoding by tree concatenation, and decoding.

A long text is cut into leaves, which are encoded in parallel; neighbours are then joined level by level. Most cuts lie where the
vocabulary's pre-tokenizer parts the text anyway, and the leaves' tokens are simply put together. Where a long text isn't parted, a cut
lies inside a run, and the join re-encodes a growing window of tokens around it until its first token is the left side's and its last
one the right side's. That is exact: merges apply in the order of their ranks and from the left, so tokens are a text's encoding if
each two neighbours are the encoding of their own text, and each two neighbours of the result stand beside each other in the
left side, in the window or in the right side.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.texts import id_type, keyed, map_rows, parallelism, shared_folder
from facetry.llm.vocabularies import BYTE_BPE_PATTERN, FOLDER, broadcast_file

#: Characters of a leaf, at about which a longer text is cut.
LEAF = 1 << 15
#: Nodes that are joined at once: a level of the tree.
FAN = 8
#: Characters that are searched at once for a place to cut.
SEEK = 512
#: Length of a run in whose middle a cut may lie.
RUN = 16
#: Parts whose tokens a task keeps.
MOST = 300_000
#: Tokens of the first window on each side of a join.
WINDOW = 8

_EDGE = re.compile("[!-~](?=[ \n])")


@dataclass
class Node:
    """Tokens of a part of a text. ``head`` and ``tail`` are the counts of those in its first and in its last run that the pre-tokenizer doesn't part."""

    ids: np.ndarray
    head: int
    tail: int


class JoinedBpe:
    def __init__(self, file: bytes, leaf: int = LEAF):
        from tokenizers import Tokenizer

        self.tokenizer, self.leaf = Tokenizer.from_buffer(file), leaf
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("an added token that looks at its neighbours")
        self.added = [t.content for t in added]
        told = json.loads(file)
        split = told.get("pre_tokenizer") or {}
        #: Whether the parts of a text can be found, and encoded, by themselves.
        self.by_parts = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not (told.get("normalizer") or told.get("post_processor"))
        self.parts = regex.compile(BYTE_BPE_PATTERN)
        self.known: dict[str, bytes] = {}
        self.alike: dict[str, bool] = {}

    def agreed(self, c: str) -> bool:
        """Whether the expression takes a character for a letter, number, space or other as the library's pre-tokenizer does."""
        if c not in self.alike:
            probe = f"a{c}a 1{c}1 !{c}! {c} {c}{c}\n{c}"
            self.alike[c] = [m.span() for m in self.parts.finditer(probe)] == self.parted(probe)
        return self.alike[c]

    def split(self, text: str) -> list[str] | None:
        """The parts that the pre-tokenizer makes of a text; None where it holds an added token or a character that isn't agreed on."""
        if not self.by_parts or any(a in text for a in self.added) or not all(map(self.agreed, set(text))):
            return None
        return self.parts.findall(text)

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, int, int]]:
        """For each text its tokens as 32-bit numbers, and how many its first and last parts have. A part has the same tokens wherever it stands, so that each is encoded once."""
        split = [self.split(t) for t in texts]
        if len(self.known) > MOST:
            self.known.clear()
        fresh = list({p for parts in split if parts for p in parts} - self.known.keys())
        for part, found in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
            self.known[part] = np.array(found.ids, "<u4").tobytes()
        out = []
        for text, parts in zip(texts, split, strict=True):
            if parts is None:
                whole = self.whole(text)
                out.append((whole.ids.tobytes(), whole.head, whole.tail))
            else:
                found = list(map(self.known.__getitem__, parts))
                out.append((b"".join(found), len(found[0]) // 4 if found else 0, len(found[-1]) // 4 if found else 0))
        return out

    def parted(self, text: str) -> list[tuple[int, int]]:
        return [at for _, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def letter(self, c: str) -> bool:
        """Whether the pre-tokenizer takes a character, no space, for a letter: it stays beside one."""
        return not c.isspace() and len(self.parted(c + "a")) == 1

    def in_added(self, text: str, at: int) -> bool:
        return any(text.find(a, max(0, at - len(a) + 1), at + len(a) - 1) >= 0 for a in self.added)

    def place(self, text: str, at: int) -> tuple[int, bool] | None:
        """The first place from ``at`` on, within SEEK characters or the next ones, where the text can be cut, and whether it lies inside a run."""
        while at < len(text) - RUN:
            seen = text[at : at + SEEK]
            for m in _EDGE.finditer(seen):  # what is no space before a space: the pre-tokenizer parts them whatever surrounds them
                if not self.in_added(text, at + m.end()):
                    return at + m.end(), False
            spans = self.parted(seen)
            for (_, end), _ in zip(spans, spans[1:], strict=False):  # a letter before what is none, likewise
                if not seen[end].isspace() and self.letter(seen[end - 1]) and not self.letter(seen[end]) and not self.in_added(text, at + end):
                    return at + end, False
            for start, end in spans:
                if end - start >= RUN and not self.in_added(text, middle := at + (start + end) // 2):
                    return middle, True
            at += SEEK
        return None

    def leaves(self, text: str) -> list[tuple[str, bool]]:
        """The text's leaves, none empty but for an empty text, and whether each begins inside a run."""
        out, start, inside = [], 0, False
        while len(text) - start > self.leaf and (found := self.place(text, start + self.leaf)):
            out.append((text[start : found[0]], inside))
            start, inside = found
        return [*out, (text[start:], inside)]

    def node(self, text: str) -> Node:
        ids, head, tail = self.encode_all([text])[0]
        return Node(np.frombuffer(ids, "<u4"), head, tail)

    def whole(self, text: str) -> Node:
        """As the library encodes it."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        ids, runs = np.array(found.ids, "<u4"), np.array([-1 if w is None else w for w in found.word_ids], np.int64)
        if not len(ids):
            return Node(ids, 0, 0)
        ends = np.flatnonzero(np.diff(runs)) + 1
        return Node(ids, int(ends[0]) if len(ends) else len(ids), len(ids) - int(ends[-1]) if len(ends) else len(ids))

    def join(self, left: Node, right: Node, inside: bool) -> Node:
        """Both nodes' tokens as those of the joined text."""
        if not inside:
            return Node(np.concatenate([left.ids, right.ids]), left.head or right.head, right.tail or left.tail)
        tail, head, size = left.ids[len(left.ids) - left.tail :], right.ids[: right.head], WINDOW
        while True:
            a, b = tail[max(0, len(tail) - size) :], head[:size]
            window = np.array([t.id for t in self.tokenizer.model.tokenize("".join(map(self.tokenizer.id_to_token, [*a.tolist(), *b.tolist()])))], "<u4")
            if (size >= len(tail) or window[0] == a[0]) and (size >= len(head) or window[-1] == b[-1]):
                break
            size *= 2
        run = left.tail - len(a) + len(window) + right.head - len(b)
        ids = np.concatenate([left.ids[: len(left.ids) - len(a)], window, right.ids[len(b) :]])
        return Node(ids, run if left.tail == len(left.ids) else left.head, run if right.head == len(right.ids) else right.tail)

    def encode(self, text: str) -> np.ndarray:
        """All levels of the tree over one text."""
        level = [(self.node(part), inside) for part, inside in self.leaves(text)]
        while len(level) > 1:
            level = [(self.fold(level[i : i + 2]), level[i][1]) for i in range(0, len(level), 2)]
        return level[0][0].ids

    def fold(self, nodes: list[tuple[Node, bool]]) -> Node:
        return reduce(lambda a, b: self.join(a, b[0], b[1]), nodes[1:], nodes[0][0])

    def decode(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    def results(self, all_ids: list[np.ndarray], with_ids: bool) -> dict[str, list]:
        decoded = self.tokenizer.decode_batch([x.tolist() for x in all_ids], skip_special_tokens=False)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        found = {"n_tokens": [len(x) for x in all_ids], "ids_sha256": [digest(x.astype("<u4", copy=False).tobytes()) for x in all_ids], "decoded_sha256": [digest(x.encode()) for x in decoded]}
        return found | {"ids": [x.astype(np.int32) if with_ids else None for x in all_ids], "decoded": [x if with_ids else None for x in decoded]}


def in_batches(texts: list[str], most: int = 1 << 20):
    """Runs of the texts of about so many characters at most."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield texts[start:]


def encode_bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{FOLDER}/byte_bpe_50k.json", with_ids: bool = True, leaf: int = LEAF) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids`` and ``decoded`` of each row, a null text counting as empty.

    The tokens are those of the library for the whole text, its added tokens found in the text included. Texts of over ``leaf``
    characters are cut into leaves, which Spark deals out by row and place and joins FAN at a time; others are one leaf. Equal
    rows stay apart, by their place in the input; extra columns are left out.
    """
    spark = docs.sparkSession
    shared = broadcast_file(spark, vocabulary)  # a vocabulary's fixed size
    kind = id_type(docs, id_col)
    more = ", ids array<int>, decoded string" if with_ids else ""
    told = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}"
    size = F.coalesce(F.length(F.col(f"`{text_col}`").cast("string")), F.lit(0))

    def encoding():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        return JoinedBpe(shared.value, leaf)

    def short():
        bpe = encoding()

        def each(batch):
            texts = [(x or b"").decode("utf-8", "replace") for x in batch["text"].to_pylist()]
            out: dict[str, list] = {}
            for few in in_batches(texts):
                ids = [np.frombuffer(x, "<u4") for x, _, _ in bpe.encode_all(few)]
                for name, x in bpe.results(ids, with_ids).items():
                    out.setdefault(name, []).extend(x)
            return out | {"doc_id": batch["doc_id"]}

        return each

    def cut():
        bpe = encoding()

        def each(batch):
            out: dict[str, list] = {k: [] for k in ("row", "doc_id", "k", "inside", "text")}
            for row, doc_id, raw in zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for k, (part, inside) in enumerate(bpe.leaves(raw.decode("utf-8", "replace"))):
                    for name, x in zip(out, (row, doc_id, k, inside, part), strict=True):
                        out[name].append(x)
            return out

        return each

    def leaf_nodes():
        bpe = encoding()

        def each(batch):
            nodes = [bpe.node(t) for t in batch["text"].to_pylist()]
            return {k: batch[k] for k in ("row", "doc_id", "k", "inside")} | columns_of(nodes)

        return each

    def joined_nodes():
        bpe = encoding()

        def each(batch):
            nodes, inside = [], []
            for few in batch["nodes"].to_pylist():
                inside.append(few[0]["inside"])
                nodes.append(bpe.fold([(Node(np.frombuffer(x["ids"], "<u4"), x["head"], x["tail"]), x["inside"]) for x in few]))
            return {k: batch[k] for k in ("row", "doc_id", "k")} | {"inside": inside} | columns_of(nodes)

        return each

    def finished():
        bpe = encoding()
        return lambda batch: bpe.results([np.frombuffer(x, "<u4") for x in batch["ids"].to_pylist()], with_ids) | {"doc_id": batch["doc_id"]}

    small = map_rows(keyed(docs.where(size <= leaf), id_col, text_col), short, told)
    placed = in_place(docs.where(size > leaf), id_col, text_col)
    longest = placed.agg(F.max(F.length(F.col("text").cast("string")))).first()[0]
    if longest is None:
        return small
    node = f"row string, doc_id {kind}, k long, inside boolean"
    n = parallelism(spark)
    nodes = map_rows(map_rows(placed, cut, f"{node}, text string").repartition(n, "row", "k"), leaf_nodes, f"{node}, head long, tail long, ids binary")
    leaves = -(-longest // leaf)
    while leaves > 1:
        leaves = -(-leaves // FAN)
        of = F.struct("k", "inside", "head", "tail", "ids")
        up = nodes.groupBy("row", F.floor(F.col("k") / FAN).alias("up")).agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(of)).alias("nodes"))
        nodes = map_rows(up.withColumnRenamed("up", "k"), joined_nodes, f"{node}, head long, tail long, ids binary")
    return small.unionByName(map_rows(nodes, finished, told))


def columns_of(nodes: list[Node]) -> dict[str, list]:
    return {"head": [x.head for x in nodes], "tail": [x.tail for x in nodes], "ids": [x.ids.tobytes() for x in nodes]}


def in_place(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row``, which no other row has, ``doc_id`` and ``text``: a row's file and place in it; rows that aren't read from files are written to the shared folder first."""
    try:
        if "_metadata" in docs.columns:
            raise AnalysisException("a column of that name")
        return keyed(docs, id_col, text_col, row=F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index")))
    except AnalysisException:
        folder = shared_folder(docs.sparkSession)
        keyed(docs, id_col, text_col, row=F.monotonically_increasing_id().cast("string")).write.parquet(folder)
        return docs.sparkSession.read.parquet(folder)
