"""Byte-pair encoding by tree concatenation against the library's encoding of whole texts."""

import hashlib
import random

import numpy as np
from helpers import FOLDER, documents
from tokenizers import Tokenizer

from facetry.llm import joined_bpe as j
from facetry.llm import queries

FILE = open(f"{j.FOLDER}/byte_bpe_50k.json", "rb").read()
WHOLE = Tokenizer.from_buffer(FILE)
ALPHABETS = ["a", "ab", "abcdefgh", "aaab ", " \n", "  ab", "0123456789", "!?#'s", "'", "日本語", "éàa ", "-=_", "a \t 　", "the quick 12 ", "🙂👍🏽a", "'s're", "，。中文a"]


def whole(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


def texts(n, most=1500):
    random.seed(6)
    for _ in range(n):
        letters = random.choice(ALPHABETS) + random.choice(ALPHABETS) * (random.random() < 0.5)
        size = random.randint(1, most)
        text = "".join(random.choices(letters, k=size)) if random.random() < 0.5 else "".join(c * random.randint(1, 90) for c in random.choices(letters, k=size // 30 + 1))
        for _ in range(3 * (random.random() < 0.2)):
            at = random.randint(0, len(text))
            text = text[:at] + "<|endoftext|>" + text[at:]
        yield text


def test_tree_equals_the_whole():
    bpe, inside = j.JoinedBpe(FILE, leaf=64), 0
    for text in texts(1200):
        parts = bpe.leaves(text)
        assert "".join(p for p, _ in parts) == text
        assert bpe.encode(text).tolist() == whole(text), text[:100]
        inside += sum(x for _, x in parts)
    assert inside > 500  # cuts inside runs that the pre-tokenizer doesn't part


def test_windows_grow_until_both_sides_agree():
    bpe = j.JoinedBpe(FILE, leaf=64)
    random.seed(2)
    for n in (1, 2, 3, 7, 50, 200):
        for letters in ("a", "ab", "aab", "eht ", "01", "-", " "):
            text = "".join(random.choices(letters.strip() or " ", k=4 * n))
            for cut in {4, len(text) // 2, len(text) - 4}:
                if 4 <= cut <= len(text) - 4:
                    joined = bpe.join(bpe.node(text[:cut]), bpe.node(text[cut:]), True)
                    assert joined.ids.tolist() == whole(text), (letters, n, cut)


def told(doc_id, text):
    ids = whole(text or "")
    return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(WHOLE.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_rows_short_and_long(spark):
    long = ["x" * 9000, "word " * 4000, "ab" * 5000 + "<|endoftext|>" + " " * 3000 + "z", "日本語" * 3000, "7" * 5000, "!" * 3000 + "\n" * 3000]
    rows = list(enumerate([None, "", " ", "a", *long, *texts(30)])) + [(None, "w" * 3000), (1, "twice " * 900), (1, "twice " * 900)]
    frame = documents(spark, rows).selectExpr("*", "'extra' AS row", "1 AS k", "'x' AS inside", "'y' AS ids", "2 AS head", "'z' AS nodes")
    found = j.encode_bpe(frame, leaf=200)
    assert sorted(map(repr, (tuple(r)[:4] for r in found.collect()))) == sorted(repr(told(k, t)) for k, t in rows)
    assert all(list(r.ids) == whole(t or "") for (k, t), r in zip([(k, t) for k, t in rows if k in (4, 7)], found.where("doc_id IN (4, 7)").orderBy("doc_id").collect(), strict=True))
    assert j.encode_bpe(documents(spark, [])).count() == 0


def test_query_matches_the_library(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op13_joined_bpe(spark, FOLDER)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr(told(*d)) for d in docs)
