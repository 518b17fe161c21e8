"""Near-duplicate and repeated-passage operators against brute force."""

import hashlib
import math

import numpy as np
import pytest
from helpers import FOLDER, documents, groups_of

from facetry.llm import golay, hnsw, queries, simhash, suffixes
from facetry.llm.components import connected_components


def test_every_word_is_within_three_bits_of_some_codeword():
    words = np.random.default_rng(0).integers(1 << 22, size=500)
    ids, n = golay.nearby(words)
    assert (n >= 1).all() and ids.shape == (500, 6)


def test_fingerprints_at_most_four_bits_apart_are_linked():
    random = np.random.default_rng(1)
    base = random.integers(1 << 63, size=1500, dtype=np.uint64)
    other = base.copy()
    for i in range(len(base)):
        for b in random.choice(64, size=random.integers(1, 5), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    bits = np.concatenate([base, other])
    keys, where, own = simhash.keys_of(bits)
    a, b = simhash.linked(keys, bits[where], own)
    root = dict(zip(a.tolist(), b.tolist()))
    assert all(root.get(int(x), int(x)) == root.get(int(y), int(y)) for x, y in zip(base, other))


def test_fingerprint_is_the_majority_of_shingle_hashes():
    from xxhash import xxh64_intdigest

    text = "The cat sat on THE cat sat on the mat"
    words = text.lower().split()
    hashes = [xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    told = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode()) == told
    assert simhash.fingerprint(b"") == 0 == simhash.fingerprint(b" \n")
    assert simhash.fingerprint(b"Two words") == xxh64_intdigest(b"two words", 42)


def test_simhash_groups_match_brute_force(spark):
    found = {r.doc_id: r for r in queries.op6_golay_simhash(spark, FOLDER).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    prints = {k: simhash.fingerprint((t or "").encode()) for k, t in texts.items()}
    assert {k: r.fingerprint for k, r in found.items()} == {k: f"{v:016x}" for k, v in prints.items()}
    ids = sorted(prints)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {k: r.component_id for k, r in found.items()} == groups_of(ids, links)


def test_simhash_of_nulls_and_repeated_rows(spark):
    docs = documents(spark, [(3, None), (1, ""), (None, "a b c"), (2, "a b c"), (2, "a b c")])
    found = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_groups(docs).collect())
    assert found == [(0, 2), (1, 1), (2, 2), (2, 2), (3, 1)]
    kept = simhash.first_of_groups(docs).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 2]


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1100)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert {found[i] for i in range(100, 161)} == {100} and {found[i] for i in range(1000, 1100)} == {7}


def brute_ranges(texts: dict, first_stays: bool, length: int = 400) -> dict:
    """Bytes to remove of each text, from all its strings of so many bytes."""
    places: dict = {}
    for k in sorted(texts):
        for i in range(len(texts[k]) - length + 1):
            places.setdefault(hashlib.blake2b(texts[k][i : i + length], digest_size=16).digest(), []).append((k, i))
    gone = {k: bytearray(len(t)) for k, t in texts.items()}
    for found in places.values():
        for k, i in found[1:] if first_stays else found if len(found) > 1 else []:
            gone[k][i : i + length] = b"\1" * length
    return gone


def check_suffixes(found: dict, texts: dict) -> None:
    gone = brute_ranges(texts, first_stays=False)
    for k, t in texts.items():
        kept = bytes(b for b, g in zip(t, gone[k]) if not g)
        spans = sum(g and not (i and gone[k][i - 1]) for i, g in enumerate(gone[k]))
        assert (found[k].n_bytes, found[k].n_removed, found[k].n_spans, found[k].kept_sha256) == (len(t), sum(gone[k]), spans, hashlib.sha256(kept).hexdigest()), k


def test_repeated_passages_match_brute_force(spark):
    found = {r.doc_id: r for r in queries.op7_suffix_dedup(spark, FOLDER).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    check_suffixes(found, texts)


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_passages_of_odd_texts(spark, monkeypatch, hot):
    random = np.random.default_rng(5)
    word = lambda n: "".join(chr(97 + x) for x in random.integers(26, size=n))
    passage, other = word(430), "é" + word(500) + "é"
    texts = {1: passage + word(50), 2: word(30) + passage, 3: word(9) + other + word(60) + other, 4: "x" * 1500, 5: None, 6: "", 7: word(399), 8: word(400), 9: passage[:399], 10: "ab" * 300, 11: word(20) + passage + passage + word(3), 12: "x" * 400}
    if hot:
        monkeypatch.setattr(suffixes, "HOT", 1)
    docs = documents(spark, list(texts.items()))
    found = {r.doc_id: r for r in suffixes.without_repeats(docs, first_stays=False, characters=False).collect()}
    check_suffixes(found, {k: (t or "").encode() for k, t in texts.items()})


def test_factors_match_all_pairs_of_suffixes():
    random = np.random.default_rng(8)
    for trial in range(10):
        length = [3, 7, 8, 20, 40][trial % 5]
        spans = [bytes(random.choice([97, 98, 0, 255][: 2 + 2 * (trial % 2)], size=length + 12)) for _ in range(3)]
        spans += [spans[0], b"x" * (length + 9)]
        found, joined = suffixes.Suffixes(spans, length), b"".join(spans)
        previous, later, end = suffixes.longest_factors(found).tolist(), suffixes.longest_factors(found, later=True).tolist(), found.end.tolist()

        def common(i, j):
            most = min(end[i] - i, end[j] - j)
            return next((n for n in range(most) if joined[i + n] != joined[j + n]), most)

        starts = found.starts.tolist()
        for k, i in enumerate(starts):
            for told, others in ((previous[k], starts[:k]), (later[k], starts[k + 1 :])):
                most = max((common(i, j) for j in others), default=0)
                assert min(told, length) == min(most, length) or max(told, most) < found.least


def test_nearest_smaller_values():
    random = np.random.default_rng(9)
    for x in (random.permutation(700), np.append(np.arange(1, 3000), 0), np.arange(900)[::-1], np.zeros(0, int)):
        told, stack = [], []
        for i, v in enumerate(x):
            while stack and x[stack[-1]] > v:
                stack.pop()
            told.append(stack[-1] if stack else -1)
            stack.append(i)
        assert suffixes.nearest_smaller(x).tolist() == told


def test_pieces_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 3000)
    random = np.random.default_rng(12)
    texts = [bytes(random.integers(97, 123, size=n)) for n in (10_000, 399, 3000, 400, 7001)]
    found = []
    for group in suffixes.pieces_of([*texts, None, b""]):
        runs = suffixes.window_runs([p for _, _, p in group])
        row, offset = np.array([g[0] for g in group]), np.array([g[1] for g in group])
        for i, lo, n in zip(row[runs["text"]], (runs["lo"] + offset[runs["text"]]).tolist(), runs["n"].tolist(), strict=True):
            found += [(i, lo + k) for k in range(n)]
    assert sorted(found) == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 399)]


@pytest.mark.parametrize("length", [250, 400])
def test_a_text_of_several_pieces(spark, length):
    random = np.random.default_rng(13)
    word = lambda n: "".join(map(chr, random.integers(97, 123, size=n)))
    passage = word(900)
    texts = {1: word(suffixes.PIECE - 500) + passage + word(300_000), 2: word(800) + passage[:700], 3: word(2000)}
    found = {r.doc_id: r.n_removed for r in suffixes.without_repeats(documents(spark, list(texts.items())), first_stays=False, length=length).collect()}
    assert found == {1: 700, 2: 700, 3: 0}


def test_first_copy_of_a_passage_stays(spark):
    passage = "".join(chr(97 + x) for x in np.random.default_rng(6).integers(26, size=600))
    docs = documents(spark, [(1, passage), (2, "before " + passage + " after"), (3, passage[100:] + " end")])
    kept = {r.doc_id: bytes(r.kept).decode() for r in suffixes.without_repeats(docs).collect()}
    assert kept == {1: passage, 2: "before  after", 3: "end"}  # the space after the passage is in 2 as well


def brute_embeddings(rows: list) -> dict:
    fit = {k: np.array(v, float) for k, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = []
    ids = sorted(fit)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(fit[a]) == len(fit[b]) and fit[a] @ fit[b] / np.linalg.norm(fit[a]) / np.linalg.norm(fit[b]) >= 0.9:
                links.append((a, b))
    count = dict.fromkeys((k for k, _ in rows), 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    group = groups_of([k for k, _ in rows], links)
    return {k: (count[k], group[k], group[k] == k) for k, _ in rows}


def test_embedding_groups_match_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op5_hnsw_near_dedup(spark, FOLDER).collect()}
    told = brute_embeddings(rows)
    assert sum(found[k][0] for k in told) >= 0.99 * sum(v[0] for v in told.values())
    assert sum(found[k] == told[k] for k in told) >= 0.99 * len(told)
    assert all(found[k][0] <= told[k][0] for k in told)  # none below the limit


def test_embeddings_that_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0]), (9, [float("inf"), 0.0]), (10, [0.0, 1.0])]
    found = hnsw.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found.collect()} == brute_embeddings(rows)


def test_planted_links_match_brute_force(spark):
    """A few pairs at about 0.9, one large group, repeated rows and clashing columns among vectors that link with nothing."""
    random = np.random.default_rng(21)
    x = hnsw.unit(random.normal(size=(2500, 32)))
    for k in range(60):
        off = random.normal(size=32)
        off -= off @ x[k] * x[k]
        cosine = (0.899, 0.901, 0.95)[k % 3]
        x[100 + k] = cosine * x[k] + math.sqrt(1 - cosine**2) * off / np.linalg.norm(off)
    x[300:500] = hnsw.unit(x[299] + 0.05 * random.normal(size=(200, 32)))
    rows = [(i, v.tolist(), 7, "extra") for i, v in enumerate(x)] + [(5000 + i, x[i].tolist(), 7, "extra") for i in range(10)]
    found = hnsw.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node long, shard string")).collect()
    y = np.array([r[1] for r in rows])
    near = y @ y.T >= hnsw.COSINE
    told = dict(zip([r[0] for r in rows], (near.sum(axis=1) - 1).tolist(), strict=True))
    assert sum(r.n_links for r in found) >= 0.995 * sum(told.values()) and all(r.n_links <= told[r.vec_id] for r in found)
    assert all(r.recall >= hnsw.RECALL for r in found)
    ids = [r[0] for r in rows]
    group = groups_of(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b])
    assert sum(r.component_id == group[r.vec_id] for r in found) >= 0.995 * len(rows)


def test_graph_search_finds_near_vectors():
    random = np.random.default_rng(2)
    centres = random.normal(size=(300, 16))
    x = hnsw.unit((centres[:, None] + 0.05 * random.normal(size=(300, 10, 16))).reshape(-1, 16))
    graph = hnsw.Graph(x)
    q, node = graph.matches(graph.exact, np.arange(len(x)))
    told = (graph.exact @ graph.exact.T >= hnsw.COSINE).sum() - len(x)
    assert len(q) >= 0.99 * told


def test_vectors_are_searched_in_the_cells_of_their_links_only(spark, monkeypatch):
    """With many cells most are left out, and hardly any pair at the limit lies in one; with cells of several shards links are the same."""
    random = np.random.default_rng(22)
    x = hnsw.unit(random.normal(size=(6000, 24)))
    x[3000:] = hnsw.at_limit(x[:3000], random.normal(size=(3000, 24)))
    x[3000:] = hnsw.unit(0.95 * x[3000:] + 0.05 * x[:3000])
    monkeypatch.setattr(hnsw, "CELLS", 60)
    centres, gap = hnsw.fitted_cells(x[::2], len(x))
    home, away = hnsw.gaps(x, centres)
    rows, met = np.arange(3000), away <= gap
    assert len(centres) == 60 and met.mean() < 0.5
    assert (met[rows, home[3000:]] | met[rows + 3000, home[:3000]]).mean() >= 0.995
    near = x @ x.T >= hnsw.COSINE
    told = (near.sum(axis=1) - 1).tolist()
    group = groups_of(range(len(x)), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for shard in (hnsw.SHARD, 700):
        monkeypatch.setattr(hnsw, "SHARD", shard)
        monkeypatch.setattr(hnsw, "CELLS", 6)
        found = sorted(hnsw.embedding_groups(table).collect())
        assert sum(r.n_links for r in found) >= 0.995 * sum(told) and all(r.n_links <= told[r.vec_id] for r in found)
        assert sum(r.component_id == group[r.vec_id] for r in found) >= 0.99 * len(found)


def test_spans_of_many_grams_are_sorted_a_few_at_a_time(monkeypatch):
    import pyarrow as pa

    spans = [str(i).encode() * 120 + b"x" * 10 * (i % 7) for i in range(1000, 7000) for _ in range(2)]
    rows = {"h": [i // 2 for i in range(len(spans))], "k1": list(range(len(spans))), "k2": [0] * len(spans), "lo": [5] * len(spans), "span": spans}
    table, sizes, real = pa.table(rows), [], suffixes.repeated_windows
    monkeypatch.setattr(suffixes, "repeated_windows", lambda spans, *more: sizes.append(sum(map(len, spans))) or real(spans, *more))
    found = [r for out in suffixes.sort_spans(True, 400)(iter(table.to_batches(max_chunksize=10_000))) for r in out.to_pylist()]
    assert sum(sizes) == sum(map(len, spans)) and max(sizes) <= 1.25 * suffixes.SORT
    whole = {r["k1"]: (r["s"], r["e"]) for r in found}
    assert all(whole[k] == (5, 5 + len(spans[k])) for k in range(1, len(spans), 2))
    assert list(suffixes.sort_spans(True, 400)(iter([table.to_batches()[0].slice(0, 0)]))) == []
