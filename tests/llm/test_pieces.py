"""N-best segmentation against all segmentations, and the round trip."""

import hashlib
import random
import time

import numpy as np
from helpers import FOLDER, documents

from facetry.llm import pieces, queries

NAMES = ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "bab", "c", "▁c", "cab", "abc"]


def small() -> pieces.Pieces:
    random.seed(9)
    return pieces.Pieces([""] * 256 + NAMES, [0.0] * 256 + [-random.uniform(1, 9) for _ in NAMES], 0, -20.0)


def all_ways(text: str, p: pieces.Pieces) -> list[float]:
    score = dict(zip(p.names[256:], p.scores[256:], strict=True))
    ways = [[] for _ in range(len(text) + 1)]
    ways[0] = [0.0]
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = text[start:end]
            step = score.get(piece, p.unknown if end - start == 1 else None)
            if step is not None:
                ways[end] += [w + step for w in ways[start]]
    return sorted(ways[-1], reverse=True)


def test_n_best_scores_match_all_segmentations():
    p = small()
    lattice = pieces.Lattice(p)
    random.seed(3)
    texts = ["", "a", "abab", "ab ab cab", "bb  a", "aßb", " a b "] + ["".join(random.choices("abc ", k=random.randint(1, 12))) for _ in range(60)]
    for text, found in zip(texts, lattice.encode(texts, 4), strict=True):
        told = all_ways("▁" + text.replace(" ", "▁"), p)[:4] if text else [0.0]
        assert np.allclose([s for s, _, _ in found], told), text
        assert all(alike and lattice.decode(ids) == text.encode() for _, ids, alike in found)
        assert len({ids.tobytes() for _, ids, _ in found}) == len(found)
        assert all(abs(sum_of(p, ids) - s) < 1e-9 for s, ids, _ in found)


def sum_of(p: pieces.Pieces, ids) -> float:
    """The score of a segmentation, from its ids: a character's byte pieces count once, as unknown."""
    total, data = 0.0, b""
    for i in ids.tolist():
        if p.byte <= i < p.byte + 256:
            data += bytes([i - p.byte])
        else:
            total += p.scores[i]
    return total + p.unknown * len(data.decode())


def test_a_star_gives_paths_in_order():
    lattice = pieces.Lattice(small())
    found = lattice.n_best("▁abcabab", 10)
    assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
    assert len({tuple(ids) for _, ids in found}) == len(found)
    assert np.allclose([s for s, _ in found], all_ways("▁abcabab", lattice.pieces)[:10])


def test_real_pieces_against_all_ways():
    p = pieces.Pieces.load(f"{pieces.FOLDER}/piece_bpe_32k.model")
    lattice, id_of = pieces.Lattice(p), {n: i for i, n in enumerate(p.names) if n}
    for text in ["the", "naïve", "banana", "don't", "αβγδ", "日本語", "3.14159", "----------", "\t\t\n", "x" * 12]:
        unit = "▁" + text
        best: list[list[float]] = [[0.0]] + [[] for _ in unit]  # the four best scores of each beginning
        for end in range(1, len(unit) + 1):
            for start in range(end):
                i = id_of.get(unit[start:end])
                step = p.scores[i] if i is not None else p.unknown if end - start == 1 else None
                if step is not None:
                    best[end] += [w + step for w in best[start]]
            best[end] = sorted(best[end], reverse=True)[:4]
        (found,) = lattice.encode([text], 4)
        assert np.allclose([s for s, _, _ in found], best[-1]), text
        assert np.allclose([s for s, _ in lattice.n_best(unit, 4)], best[-1]), text
        assert all(lattice.decode(ids) == text.encode() and abs(sum_of(p, ids) - s) < 1e-6 for s, ids, _ in found)


def test_long_runs_of_a_character_and_forgetting():
    lattice = pieces.Lattice(pieces.Pieces.load(f"{pieces.FOLDER}/piece_bpe_32k.model"), most=50)
    began = time.process_time()
    found = lattice.n_best("▁" + "-" * 20_000, 2)
    assert len(found) == 2 and found[0][0] >= found[1][0] and found[0][1] != found[1][1] and time.process_time() - began < 10
    texts = [f"word{i % 40} and other{i}" for i in range(300)]
    alone = pieces.Lattice(lattice.pieces)
    for i in range(0, 300, 30):
        for a, b in zip(lattice.encode(texts[i : i + 30]), alone.encode(texts[i : i + 30]), strict=True):
            assert [(s, x.tolist()) for s, x, _ in a] == [(s, x.tolist()) for s, x, _ in b]
    assert len(lattice.known) < len(alone.known)


def test_texts_come_back(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = queries.op8_nbest_pieces(spark, FOLDER).collect()
    assert len(found) == len(docs)
    for r in found:
        assert r.decoded_1 or "▁" in docs[r.doc_id]
        assert all(x in (None, r.decoded_1) for x in (r.decoded_2, r.decoded_3, r.decoded_4))
        scores = [s for s in (r.score_1, r.score_2, r.score_3, r.score_4) if s is not None]
        assert scores == sorted(scores, reverse=True)


def test_long_units_and_nulls(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "x" * 500), (4, "日本語 テキスト \U0001f600"), (5, " "), (5, " ")])
    found = {r.doc_id: r for r in pieces.encode_pieces(docs).collect()}
    assert found[1].scores == found[2].scores == [0.0] and found[1].segmentations == [[]]
    assert all(all(r.decoded) for r in found.values())
    for r in found.values():
        assert [len(x) for x in r.segmentations] == r.n_pieces and len(set(r.md5)) == len(r.scores)
        assert r.md5 == [hashlib.md5(np.array(x, "<i4").tobytes()).hexdigest() for x in r.segmentations]


def test_repeated_words_and_a_cheaper_unit_after_them():
    lattice = pieces.Lattice(pieces.Pieces.load(f"{pieces.FOLDER}/piece_bpe_32k.model"))
    words = ["people", "the", "water", "of", "banana", "x", "naïve"]
    random.seed(12)
    texts = ["people " * 40 + "the", "the " + "people " * 40, "people " * 500] + [" ".join(random.choices(words[: random.randint(1, 7)], k=random.randint(50, 200))) for _ in range(12)]
    texts += [r[0] for r in short_texts()]
    for text, found in zip(texts, lattice.encode(texts), strict=True):
        told = lattice.n_best("▁" + text.replace(" ", "▁"), 4)
        assert np.allclose([s for s, _, _ in found], [s for s, _ in told]), text[:60]
    gaps = [found[0][0] - s for found in lattice.encode(texts[:2]) for s, _, _ in found]
    assert np.allclose(gaps[:4], gaps[4:])


def short_texts():
    """All short texts of a table."""
    import duckdb

    return duckdb.connect().execute(f"SELECT text FROM '{FOLDER.replace('0.001', '0.01')}/documents.parquet' WHERE length(text) BETWEEN 1 AND 300").fetchall()
