"""Word figures, fertility bands, source mixing and token counts against plain versions."""

import math
import re
import unicodedata
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
import sentencepiece
from helpers import FOLDER, LARGER, documents

from facetry.llm import fertility, lengths, mixing, queries, vocabularies
from facetry.llm.vocabularies import FOLDER as VOCABULARIES
from facetry.llm.vocabularies import byte_bpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_figures(text: str) -> tuple:
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside)


def test_figures_match_plain_ones(spark):
    found = {r.doc_id: r for r in queries.op1_tokeniser_fertility(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        r = found[d.doc_id]
        told = plain_figures(d.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == told
        assert r.base_failed == (told[0] < 50 or 100 * told[4] > 50 * told[0])
        assert not (r.base_failed and r.kept)


def test_figures_of_odd_texts():
    for text in ("", " \n\t", "a b c a b c a b c", "x\nx\n x\nx ", "é é #*$", "a\rb\vc\fd", "one\n\none\n"):
        assert fertility.word_figures(text.encode()) == plain_figures(text), text


def test_most_clean_documents_stay(spark):
    measured = [r for r in queries.op1_tokeniser_fertility(spark, FOLDER).collect() if not r.base_failed]
    assert sum(r.kept for r in measured) >= 0.9 * len(measured)


def test_texts_of_noise_are_rejected(spark):
    import random

    random.seed(4)
    prose = "the river runs over the old stones and the people of the town walk along its banks each evening to talk of the day".split()
    clean = [(i, " ".join(random.choices(prose, k=200))) for i in range(60)]
    noise = [(1000, " ".join("".join(random.choices("qxzjkvw0123456789", k=9)) for _ in range(200)))]
    measured = fertility.measure(documents(spark, clean + noise))
    kept = {r.doc_id: r.kept for r in fertility.fertility_rules(measured, fertility.bands(measured)).collect() if not r.base_failed}
    assert not kept[1000]


def test_a_null_language_is_banded_by_script(spark):
    docs = documents(spark, [(1, "привет мир " * 30, None, "web"), (2, None, None, None), (3, "hello", "en", None)])
    found = {r.doc_id: r.band_key for r in fertility.measure(docs).collect()}
    assert {r.doc_id: r.script for r in fertility.measure(docs).collect()} == {1: "cyrillic", 2: "none", 3: "latin"}
    assert found == {1: "script:cyrillic", 2: "script:none", 3: "lang:en"}


def plain_entropy(ids, window=128):
    """Mean entropy of windows that start at each multiple, the last one moved back to end with the text."""
    width = min(len(ids), window)
    starts = [i for i in range(0, len(ids) - width + 1, width)] + [len(ids) - width] * bool(len(ids) % width)
    bits = [-sum(n / width * math.log2(n / width) for n in Counter(ids[i : i + width]).values()) for i in starts]
    return sum(bits) / len(bits) * math.log2(window) / math.log2(width)


def plain_measures(text):
    out = {}
    for name, path in fertility.VOCABULARIES.items():
        if path.endswith(".model"):
            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            ids = pieces.encode(text)
            parts = sum(bool(re.fullmatch("<0x[0-9A-F]{2}>", pieces.id_to_piece(i))) for i in ids)
        else:
            encoding = byte_bpe(Path(path).read_bytes())
            ids = encoding.encode_ordinary(text)
            parts = sum("\ufffd" in encoding.decode_single_token_bytes(i).decode("utf-8", "replace") for i in ids)
        out |= {f"n_tokens_{name}": len(ids)} | dict.fromkeys((f"{m}_{name}" for m in fertility.MEASURES))
        if ids:
            out |= {f"chars_per_token_{name}": len(text) / len(ids), f"byte_share_{name}": parts / len(ids)}
        if len(ids) > 1:
            out[f"token_entropy_{name}"] = plain_entropy(ids)
    return out


def test_measures_match_plain_ones(spark):
    texts = ["", "a", "the", "straße für alle 🙂 " * 20, "日本語の文 " * 9, "x\ny\t z  w" * 70, "word " * 300, "été 𐍈 \u2581 \u0000"]
    texts += [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(25).collect() if r.text]
    for r in fertility.measure(documents(spark, list(enumerate(texts)))).collect():
        for name, told in plain_measures(texts[r.doc_id]).items():
            assert r[name] == (told if told is None else pytest.approx(told)), (name, texts[r.doc_id][:40])


def test_parts_of_long_texts_are_encoded_as_the_whole(monkeypatch):
    encode = vocabularies.encoder(Path(fertility.VOCABULARIES["piece"]).read_bytes(), "x.model")[0]
    for text in ("one two  three\n four \u2581 five 日本 語 " * 40, " a  b ", "x" * 900, "-" * 90 + " é " + " " * 90 + "z"):
        told = encode(text)
        for size in (1, 7, 50):
            monkeypatch.setattr(vocabularies, "AT_ONCE", size)
            assert encode(text) == told
        monkeypatch.undo()


def test_scripts_count_whole_texts():
    for text in ("", "12 3", "abcd" + "привет" * 2, "a" * 3000 + "п" * 3001, "é" * 9 + "語" * 9, "ab語日"):
        names = Counter(unicodedata.name(c).split(" ")[0].split("-")[0].lower() for c in text if c.isalpha())
        assert fertility.script(text) == (min(names, key=lambda k: (-names[k], k)) if names else "none")


def plain_verdicts(rows, least=30):
    def median(values):
        return sorted(values)[(len(values) - 1) // 2]

    groups = defaultdict(list)
    for r in rows:
        if not r.base_failed:
            for key in {r.band_key, f"script:{r.script}", "all"}:
                groups[key].append(r)
    taken = {r.doc_id: next((k for k in (r.band_key, f"script:{r.script}", "all") if len(groups[k]) >= least), None) for r in rows if not r.base_failed}
    limits = {}
    for key in set(taken.values()) - {None}:
        for m in (f"{m}_{v}" for v in fertility.VOCABULARIES for m in fertility.MEASURES):
            values = [math.floor(r[m] * 1000 + 0.5) for r in groups[key] if r[m] is not None]
            mid = median(values)
            half = max(6.0 * 1.4826 * median([abs(x - mid) for x in values]), 0.02 * mid, 20)
            limits[key, m] = (mid - half) / 1000, (mid + half) / 1000
    out = {}
    for r in rows:
        bad = [0, 0, 0]
        if key := taken.get(r.doc_id):
            for v in fertility.VOCABULARIES:
                c, b, e = (f"{m}_{v}" for m in fertility.MEASURES)
                bad[0] += not limits[key, c][0] <= r[c] <= limits[key, c][1]
                bad[1] += r[b] > limits[key, b][1]
                bad[2] += r[e] is not None and r[e] < limits[key, e][0]
        out[r.doc_id] = key if r.doc_id in taken else None, tuple(x >= 2 for x in bad), not r.base_failed and max(bad) < 2
    return out


@pytest.mark.parametrize("folder", (FOLDER, LARGER))
def test_bands_and_verdicts_match_plain_ones(spark, folder):
    rows = queries.op1_tokeniser_fertility(spark, folder).collect()
    told = plain_verdicts(rows)
    for r in rows:
        band, bad, kept = told[r.doc_id]
        assert r.kept == kept, r.doc_id
        assert r.base_failed or ((r.bad_fertility, r.bad_bytes, r.bad_entropy), r.band) == (bad, band), r.doc_id


def test_rare_languages_take_the_band_of_their_script(spark):
    import random

    random.seed(5)
    prose = "the river runs over the old stones and the people of the town walk along its banks each evening to talk of the day".split()
    clean = [(i, " ".join(random.choices(prose, k=200)), "en", "web") for i in range(60)]
    noise = [(500, " ".join(f"qx{i}zj{i * 7919 % 997}kv" for i in range(90)), "zz", "web")]
    measured = fertility.measure(documents(spark, clean + noise))
    found = {r.doc_id: r for r in fertility.fertility_rules(measured, fertility.bands(measured, least=10)).collect() if not r.base_failed}
    assert found[500].band == "script:latin" and not found[500].kept
    few = fertility.fertility_rules(measured, fertility.bands(measured, least=1000)).collect()
    assert all(r.kept != r.base_failed and r.band is None for r in few)  # too few rows in all: no band


def test_mix_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    told = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({queries.OP2_SQL})").fetchall()}
    found = {r.doc_id: (r["size"], r.source_size, round(r.target, 6), r.taken) for r in queries.op2_source_mixing(spark, FOLDER).collect()}
    assert found == told


def test_targets_reshare_what_exceeds_a_limit(spark):
    sources = spark.createDataFrame([("a", 10, 3.0), ("b", 1000, 1.0), ("c", 1000, 2.0)], "source string, source_size long, weight double")
    found = {r.source: r.target for r in mixing.targets(sources).collect()}
    assert found["a"] == 20.0 and abs(sum(found.values()) - 1.5 * 2010) < 1e-6 and abs(found["c"] - 2 * found["b"]) < 1e-6


def test_mix_emits_each_row_as_often_as_planned(spark):
    docs = documents(spark, [(i, "a b c", "en", s) for i in range(300) for s in (("x", "y", None)[i % 3],)] + [(900, None), (901, "")])
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect()}
    out = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert out == Counter({k: n for k, n in plan.items() if n}) and max(plan.values()) <= 2
    assert mixing.mixed(docs).columns == docs.columns


def test_sources_beyond_the_broadcast_bound_give_the_same(spark, monkeypatch):
    docs = documents(spark, [(i, "a b " * (i % 5), "en", f"s{i % 7}" if i % 7 else None) for i in range(100)])
    small = sorted((r.doc_id, r.target, r.copies) for r in mixing.mix_plan(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted((r.doc_id, r.target, r.copies) for r in mixing.mix_plan(docs).collect()) == small


def test_token_counts_match_plain_ones(spark):
    encoding = byte_bpe(Path(f"{VOCABULARIES}/byte_bpe_50k.tiktoken").read_bytes())
    sizes = [len(encoding.encode_ordinary(r.text or "")) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    table = queries.op10_token_counts(spark, FOLDER).cache()
    rows = table.collect()
    assert sorted((r.n_tokens, r.n_docs) for r in rows) == sorted(Counter(sizes).items())
    for r in rows:
        assert r.tokens_truncated == sum(min(x, r.n_tokens) for x in sizes)
        assert r.n_docs_ge == sum(x >= r.n_tokens for x in sizes) and r.tokens_ge == sum(x for x in sizes if x >= r.n_tokens)
        assert r.n_docs_le == sum(x <= r.n_tokens for x in sizes) and r.tokens_dropped == sum(sizes) - r.tokens_truncated
    for limit in (0, 7, 100, 10**6):
        got = lengths.total_at(table, limit).first()
        assert (got.n_docs_over, got.tokens_truncated) == (sum(x > limit for x in sizes), sum(min(x, limit) for x in sizes))
    assert lengths.length_quantile(table, 0.5).first()[0] == sorted(sizes)[(len(sizes) + 1) // 2 - 1]
