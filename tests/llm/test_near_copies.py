"""Near copies against brute-force Jaccard similarities of whole shingle sets."""

import corpus_pipeline
import numpy as np
from helpers import FOLDER, documents, groups_of

from facetry.llm import near_copies, simhash


def plain_shingles(text: str) -> set:
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(x: set, y: set) -> bool:
    return bool(x) and len(x & y) >= 0.8 * len(x | y)


def test_near_copies_match_brute_force(spark):
    random = np.random.default_rng(8)
    texts = []
    for i in range(60):
        words = [f"w{x}" for x in random.integers(3000, size=int(random.integers(60, 400)))]
        texts.append(" ".join(words))
        for _ in range(4):  # a chain of copies, a few words further each
            changed = list(words)
            for at in random.choice(len(words), size=1 + int(len(words) * random.choice([0.005, 0.01, 0.02, 0.03])), replace=False):
                changed[at] = f"x{random.integers(10**6)}"
            texts.append(" ".join(changed))
            words = changed if i % 2 else words
    order = random.permutation(len(texts)).tolist()
    texts = dict(enumerate(texts[i] for i in order))
    sets, prints = {k: plain_shingles(t) for k, t in texts.items()}, {k: simhash.fingerprint(t.encode()) for k, t in texts.items()}
    bits = [(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    links = [(a, b) for a in texts for b in texts if a < b and near(sets[a], sets[b])]
    told = groups_of(list(texts), bits + links)
    assert len(set(told.values())) < len(set(groups_of(list(texts), bits).values())) - 10  # most aren't within 4 bits
    kept = corpus_pipeline.keep_first_copies(spark, documents(spark, list(texts.items())), FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(told.values()))


def test_bands_of_texts_at_the_least_similarity():
    random = np.random.default_rng(9)
    found = 0
    for _ in range(300):
        h = random.integers(1 << 63, size=300, dtype=np.uint64)
        x, y = near_copies.bands_of([np.sort(h[:270]), np.sort(np.concatenate([h[:240], h[270:]]))])  # 240 of 300
        found += bool((x == y).any())
    assert found >= 298


def test_pairs_that_no_leader_links(spark, monkeypatch):
    words = [f"w{i}" for i in range(200)]
    rows = [" ".join(words[:k] + ["x"] + words[k + 1 :] + [f"t{k}"] * n) for k in range(0, 200, 20) for n in (0, 6)]
    sets = dict(enumerate(map(plain_shingles, rows)))
    links = [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])]
    monkeypatch.setattr(near_copies, "HOT", 2)
    kept = near_copies.first_of_near_copies(documents(spark, list(enumerate(rows))))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups_of(list(sets), links).values()))


def test_one_row_of_each_group_with_null_and_repeated_identifiers(spark):
    text, other = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    docs = documents(spark, [(None, text), (None, text), (5, text), (5, other), (7, other + " end"), (None, "alone"), (None, "alone"), (9, "at last"), (9, "at last")])
    kept = corpus_pipeline.keep_first_copies(spark, docs, FOLDER)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(5, text), (5, other), (0, "alone"), (9, "at last")])
