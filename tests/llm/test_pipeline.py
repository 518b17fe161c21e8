"""The pipeline's stages, each against a plain version on its own input."""

from collections import Counter

import corpus_pipeline as pipeline
from helpers import LARGER, groups_of
from test_dedup import brute_ranges
from test_near_copies import near, plain_shingles

from facetry.llm import mixing, simhash, suffixes


def test_stages_one_after_the_other(spark, tmp_path):
    docs, names = spark.read.parquet(f"{LARGER}/documents.parquet").where("doc_id < 300"), []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, LARGER)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        names.append(name)
        before, after = docs.collect(), out.collect()
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            assert 0 < len(after) < len(before) and {r.doc_id for r in after} <= {r.doc_id for r in before}
        elif k == 1:
            prints = {r.doc_id: simhash.fingerprint((r.text or "").encode()) for r in before}
            ids = sorted(prints)
            sets = {r.doc_id: plain_shingles(r.text or "") for r in before}
            links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4 or near(sets[a], sets[b])]
            assert sorted(r.doc_id for r in after) == sorted(set(groups_of(ids, links).values()))
        elif k == 2:
            texts = {r.doc_id: (r.text or "").encode() for r in before}
            gone = brute_ranges(texts, first_stays=True, length=pipeline.PASSAGE)
            for r in after:
                t, spans, at = texts[r.doc_id], [], 0
                while at < len(t):
                    if gone[r.doc_id][at]:
                        end = at
                        while end < len(t) and gone[r.doc_id][end]:
                            end += 1
                        spans.append((at, end))
                        at = end
                    at += 1
                told, last = b"", 0
                for s, e in suffixes.whole_characters(t, spans):
                    told, last = told + t[last:s], e
                assert (r.text or "").encode() == told + t[last:] and r.n_chars == len(r.text)
        elif k == 3:
            copies = {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect()}
            assert Counter(r.doc_id for r in after) == Counter({i: n for i, n in copies.items() if n})
        else:
            assert len(after) == len(before) and all(r.decoded_1 for r in after)
        docs = out
    assert names == ["quality classifier", "simhash near-dedup", "suffix-array dedup", "source mixing", "sentencepiece"]


def test_run_gives_the_last_stages_rows(spark):
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
