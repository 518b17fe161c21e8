"""Classifiers by held-out accuracy; context mixing by its base counts and by summing to one."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from helpers import FOLDER, LARGER, documents

from facetry.llm import language, mixing_lm, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(k, n):
    return zlib.crc32(str(k).encode()) % n


def test_quality_on_held_out_labels(spark):
    found = {r.doc_id: r for r in queries.op3_quality_classifier(spark, LARGER).collect()}
    assert all(r.held_out == (crc(k, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for k, r in found.items())
    labels = [(r.quality, found[r.doc_id].score) for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect() if r.doc_id in found and found[r.doc_id].held_out and r.quality is not None]
    good, bad = [s for q, s in labels if q], [s for q, s in labels if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.85


def test_quality_without_labels_or_texts(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "a good text"), (3, "a good text"), (None, "more")])
    model = quality.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score_quality(docs, model).collect()] == [0.5] * 5


def test_language_on_held_out_texts(spark):
    found = queries.op4_language_codes(spark, LARGER).collect()
    texts = {r.doc_id: r for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    for r in found:
        letter = any(c.isalpha() for c in texts[r.doc_id].text or "")
        assert r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and (r.lang_pred == "und") == (not letter)
    held = [r for r in found if r.held_out and r.lang_pred != "und" and texts[r.doc_id].lang]
    assert np.mean([r.lang_pred == texts[r.doc_id].lang for r in held]) > 0.95


def test_codewords_differ_in_many_bits():
    for n in (2, 3, 5, 9, 40):
        code = language.codewords(n)
        assert min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)
        assert (abs(code.sum(axis=0)) < n).all()


def test_language_without_letters_or_training(spark):
    docs = documents(spark, [(1, None), (2, "123 !?"), (3, "hello world")])
    found = language.identify(docs, language.fit_codes(docs.where("false"))).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)] * 3


def test_base_scores_match_plain_ones(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {k: [*WORD.findall((t or "").translate(lower)), None] for k, t in docs.items()}
    counts = Counter(w for k, ws in tokens.items() if crc(k, 5) != 1 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    found = queries.op9_context_mixing(spark, FOLDER).collect()
    assert len(found) == len(docs)
    for r in found:
        ws = tokens[r.doc_id]
        told = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), total, crc(r.doc_id, 5) == 1)
        assert abs(r.base_score - told) < 1e-6 * max(1.0, -told) and r.score <= 0
    held = [(docs[r.doc_id].encode(), r.score) for r in found if r.held_out and r.n_tokens > 20]
    n = np.bincount(np.frombuffer(b"".join(t for t, _ in held), np.uint8))
    plain = -(n[n > 0] * np.log2(n[n > 0] / n.sum())).sum() / n.sum()  # what the held-out texts' own byte counts give
    assert -sum(s for _, s in held) * math.log2(10) / n.sum() < 0.9 * plain


def test_bytes_after_a_context_sum_to_one():
    random = np.random.default_rng(3)
    tables = [mixing_lm.levels_of(random.integers(0, 50, size=(1 << b, 2))) for b in mixing_lm.SLOT_BITS]
    model = mixing_lm.ContextMixing.new(tables)
    for context in (0, 0x20746865, 0xFFFFFFFF):
        keys, word = np.uint64(context << 8) | np.arange(256, dtype=np.uint64), np.uint64(context * 77 << 8) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** model.log10(keys, word)).sum() - 1) < 1e-9


def test_sites_of_words():
    texts = [[b"the", b"then"], [], [b"in", b"the"]]
    keys, words, size = mixing_lm.sites_of(texts)
    assert size.tolist() == [9, 1, 7] and bytes((keys & np.uint64(255)).astype(np.uint8)) == b"the then\xff\xffin the\xff"
    assert (words[0:3] == words[4:7]).all() and (words[0:3] == words[13:16]).all()  # a word so far, wherever it starts
    assert words[3] != words[7] and words[8] != words[9] and len(set((words >> np.uint64(8)).tolist())) == 7
    assert [len(x) for x in mixing_lm.slices([[b"a" * mixing_lm.SLICE], [b"b"], []])] == [1, 2]


def test_levels_keep_small_counts():
    pair = np.array([[0, 0], [3, 31], [0, 1], [5_000_000, 1], [40, 7]])
    code = mixing_lm.levels_of(pair)
    found = mixing_lm.LEVELS[np.stack([code & 255, code >> 8], axis=1)]
    assert found[:3].tolist() == pair[:3].tolist() and found[3][1] == 1 and abs(found[4][0] - 40) <= 2 and found[4][1] == 7


def test_counts_summed_in_levels(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 60").coalesce(2)
    told = {r.doc_id: r for r in mixing_lm.score_texts(docs, mixing_lm.learnable(), block=20_000).collect()}
    found = mixing_lm.score_texts(docs, mixing_lm.learnable(), block=20_000, fan=4).collect()
    assert len(found) == len(told)
    for r in found:
        t = told[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (t.n_tokens, t.n_known, t.train_tokens)
        assert abs(r.base_score - t.base_score) < 1e-6 and abs(r.score - t.score) < 1e-3 * -t.score


def test_scores_of_a_plain_loop():
    """Bit by bit: each predictor's slot, its counts, the gate, the mix and the refinement."""
    random = np.random.default_rng(4)
    model = mixing_lm.ContextMixing.new([mixing_lm.levels_of(random.integers(0, 60, size=(1 << b, 2))) for b in mixing_lm.SLOT_BITS])
    model.weights = random.uniform(-0.5, 1, size=model.weights.shape).astype(np.float32)
    keys, words, size = mixing_lm.sites_of([[b"the", b"cat"], [b"the"]])
    found, n_orders = model.log10(keys, words), len(mixing_lm.ORDERS)
    for site in range(len(keys)):
        total, byte = 0.0, int(keys[site]) & 255
        for j in range(8):
            bit, inputs, gate = byte >> (7 - j) & 1, [], 0
            for order in range(n_orders):
                slot = mixing_lm.nodes_of((keys if mixing_lm.ORDERS[order] else words)[site : site + 1], order)[0, j]
                code = int(model.tables[order][slot])
                zeros, ones = mixing_lm.LEVELS[code & 255], mixing_lm.LEVELS[code >> 8]
                inputs.append(float(np.clip(math.log((ones + mixing_lm.PRIOR) / (zeros + mixing_lm.PRIOR)), -mixing_lm.CLIP, mixing_lm.CLIP)))
                if zeros + ones > 0:
                    gate = (order + 1) * mixing_lm.SEEN + sum(zeros + ones >= x for x in (2, 6, 40))
            odds = sum(w * x for w, x in zip(model.weights[gate].tolist(), [*inputs, 0.3]))
            odds = max(-1.5 * mixing_lm.CLIP, min(1.5 * mixing_lm.CLIP, odds))
            refined = np.interp(odds, np.linspace(-mixing_lm.CLIP, mixing_lm.CLIP, mixing_lm.CELLS), model.refined[gate // mixing_lm.SEEN])
            p = min(1 - 1e-6, max(1e-6, (1 - mixing_lm.REFINED) / (1 + math.exp(-odds)) + mixing_lm.REFINED * refined))
            total += math.log10(p if bit else 1 - p)
        assert abs(found[site] - total) < 0.02 * max(1, -total)  # odds are rounded to STEPS


def test_context_mixing_of_nulls_and_untrained_texts(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "Some words here"), (3, "Some words here")])
    found = {r.doc_id: r for r in mixing_lm.score_texts(docs, mixing_lm.F.lit(False)).collect()}
    assert found[1].n_tokens == found[2].n_tokens == 1 and found[3].n_tokens == 4 and found[3].n_known == 0 and found[3].train_tokens == 0
    assert abs(found[1].score - 8 * math.log10(0.5)) < 0.5


def test_counts_packed_and_read_again():
    for top in (0, 200, 300, 70_000, 1 << 40):
        counts = np.array([0, 1, top])
        assert mixing_lm.widened(mixing_lm.narrow(counts), 3).tolist() == counts.tolist()


def test_all_languages_are_learned(spark, monkeypatch):
    names = [f"l{i:03}" for i in range(620)]

    def text(i):
        own = random.Random(i)
        return " ".join(own.choices(["".join(own.choices("abcdefghijklmnopqrstuvwxyzàéîöü", k=own.randint(3, 8))) for _ in range(40)], k=300))

    docs = documents(spark, [(i, text(i % 620), names[i % 620], "web") for i in range(700)] + [(5000, "12 !", "digits", "web"), (5001, "more", None, "web"), (5002, None, "none", "web")])
    monkeypatch.setattr(language, "HELD", 50)
    model = language.fit_codes(docs)
    assert model.names == names
    counts = {x: np.zeros(language.SLOTS) for x in names}
    for r in docs.where("doc_id < 5000").collect():
        counts[r.lang] += language.counts_of(r.text)
    share = np.array([(counts[x] + 0.5) / (counts[x] + 0.5).sum() for x in names])
    for b in (0, 7, model.code.shape[1] - 1):
        on, off = share[model.code[:, b] > 0].mean(axis=0), share[model.code[:, b] < 0].mean(axis=0)
        assert np.allclose(model.weights[:, b], np.log(on / off))
    found = language.identify(docs, model).where("doc_id < 5000").collect()
    assert sum(r.lang_pred == names[r.doc_id % 620] for r in found) > 690


def test_codewords_of_many_languages_differ():
    for n in (2, 3, 5, 6, 40, language.COMPARED, 2000):
        code = language.codewords(n)
        assert len(np.unique(code, axis=0)) == n and all(len(set(bit)) == 2 for bit in code.T)


def test_pieces_of_long_texts_have_all_sequences(monkeypatch):
    texts = ["", " 1 2 ", "ab", "Ein Satz, mit  vielen; Wörtern. " * 30, "ΟΔΟΣ ΣΑΣ " * 9, "x" * 200, "   a   b" * 50, "1" * 40 + "a" + "2" * 40, "İstanbul " * 8]
    for text in texts:
        slots = language.slots_of(text)
        for size in (1, 2, 3, 16, 31):
            if size < 16 and "Σ" in text:
                continue  # a word longer than a piece: its last letter's lower case depends on the rest
            monkeypatch.setattr(language, "PIECE", size)
            found = language.counts_of(text)
            assert (found is None) == (slots is None)
            if slots is not None:
                assert (found == np.bincount(slots, minlength=language.SLOTS)).all(), (size, text[:20])


def test_sites_and_their_first_places():
    import numpy as np

    from facetry.llm import mixing_lm as m

    texts = [[b"ab", b"abc"], [], [b"ab", b"ab"]]
    keys, words, size = m.sites_of(texts)
    assert size.tolist() == [7, 1, 6]
    told, seen = [], {}
    for t in texts:
        line = bytes([m.END]) * 4 + b" ".join(t) + bytes([m.END])
        told += [int.from_bytes(line[i - 4 : i + 1], "big") for i in range(4, len(line))]
    assert keys.tolist() == told
    some, own, back, n = m.distinct_sites(keys, words)
    for pair in zip(keys.tolist(), words.tolist(), strict=True):
        seen.setdefault(pair, len(seen))
    assert list(zip(some.tolist(), own.tolist(), strict=True)) == list(seen) and back.tolist() == [seen[p] for p in zip(keys.tolist(), words.tolist(), strict=True)] and n.sum() == len(keys)
    model = m.ContextMixing.new([np.random.default_rng(1).integers(0, 1 << 16, 1 << b).astype(np.uint16) for b in m.SLOT_BITS])
    assert np.array_equal(model.log10(some, own)[back], model.log10(keys, words))


def test_counts_come_back_to_each_word():
    """Replies hold counts of a cell's words in their order, and cells without words have none."""
    hashes = np.random.default_rng(14).integers(1 << 63, size=2000, dtype=np.uint64)
    for fan in (4, 256):
        found = [mixing_lm.replies(0, cell, own, [1], [np.arange(len(own))]) for cell, _, own in mixing_lm.dealt(hashes, np.arange(2000), fan)]
        rows = [{"cell": r["cell"][0], "counts": r["counts"][0]} for r in found]
        assert mixing_lm.counts_of(hashes, rows[::-1], fan).tolist() == list(range(2000))
    assert mixing_lm.counts_of(hashes[:0], [], 4).tolist() == []


def test_weight_sets_tell_the_longest_context_seen():
    n = len(mixing_lm.ORDERS)
    for times in ([0] * n, [4, 0, 0, 0, 0], [1, 2, 3, 0, 0], [4, 4, 4, 4, 1], [0, 0, 0, 0, 4], [3, 0, 2, 0, 0]):
        told = max(((k + 1) * mixing_lm.SEEN + t - 1 for k, t in enumerate(times) if t), default=0)
        assert mixing_lm._SETS[sum(t << 3 * k for k, t in enumerate(times))] == told
