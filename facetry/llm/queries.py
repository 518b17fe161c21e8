"""The corpus operators as queries: each applies its operator with its production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm import conversations, fertility, hnsw, joined_bpe, language, lengths, middle, mixing, mixing_lm, pieces, quality, repair_sql, simhash, suffixes
from facetry.llm.texts import checkpointed, documents


def op1_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's word figures, its measures by each vocabulary and the verdict. Null and empty texts have no words and fail the base rules; repeated rows agree."""
    measured = checkpointed(fertility.measure(documents(spark, sf_dir)))
    return fertility.fertility_rules(measured, fertility.bands(measured))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words that the mix takes of it. Null texts have size 0; null sources are one source, the last; repeated rows with one identifier draw alike."""
    plan = mixing.mix_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP2_SQL = (
    r"WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),"
    + mixing.PLAN_SQL.format(docs="d")
    + "SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM planned"
)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's score. Null and empty texts are scored as texts without words; a null identifier isn't learned from and isn't held out; repeated rows agree."""
    docs = documents(spark, sf_dir)
    model = quality.fit_quality(docs, documents(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (~quality.learnable() & F.col("doc_id").isNotNull()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's language. Null texts and texts without a letter are ``und`` with score 0; rows without a language, or with a null identifier, teach nothing."""
    docs = documents(spark, sf_dir)
    found = language.identify(docs, language.fit_codes(docs.where(F.coalesce(language.bucket_of(F.col("doc_id"), 5) != 0, F.lit(False)))))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component. Null, zero and non-finite vectors link with nothing and are components of their own; equal vectors link."""
    return hnsw.embedding_groups(documents(spark, sf_dir, "embeddings"))


def op6_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's fingerprint and component. Null texts and texts without words have the fingerprint zero and link as others do."""
    return simhash.near_groups(documents(spark, sf_dir)).select("doc_id", simhash.hexadecimal(F.col("bits")).alias("fingerprint"), "component_id")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes of repeated passages. Null texts are empty and lose nothing; repeated rows are places of their own, so that long ones lose all their bytes."""
    found = suffixes.without_repeats(documents(spark, sf_dir), first_stays=False, characters=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def segmented(docs: DataFrame) -> DataFrame:
    """The digests of each text's n best segmentations, all of which are made; null where there are fewer. Null and empty texts have one, without pieces."""
    found = pieces.encode_pieces(docs, with_ids=False)
    of = {"score": "scores", "n_pieces": "n_pieces", "n_fallback": "n_fallback", "pieces_md5": "md5", "decoded": "decoded"}
    return found.select("doc_id", *(F.get(c, F.lit(i)).alias(f"{k}_{i + 1}") for i in range(pieces.N_BEST) for k, c in of.items()))


def op8_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of every text's n best segmentations. Null and empty texts have one, of no pieces."""
    return segmented(documents(spark, sf_dir))


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's base score and score. Null texts are an end alone; a null identifier isn't learned from; repeated rows count as often as they occur."""
    found = mixing_lm.score_texts(documents(spark, sf_dir), mixing_lm.learnable())
    return found.withColumn("held_out", mixing_lm.held_out())


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, quantiles and truncated totals for every context limit. Null and empty texts have length 0; an empty table gives no rows."""
    return lengths.length_table(checkpointed(lengths.length_histogram(lengths.encoded_lengths(documents(spark, sf_dir)))))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: gaps, faults, illegal neighbours, the cheapest edits and the digest of what they give. Null identifiers are one conversation; one that loses all rows has zeros."""
    return conversations.damage_report(documents(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's units and its form, and the digests of the output and of the text that is rebuilt from it. Null texts are empty."""
    made = middle.fill_in_middle(documents(spark, sf_dir))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^
]*
|[^
]+') AS units, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS r FROM d),
c AS (SELECT *, len(units) AS n, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS a, greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS b, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 100 AS plain FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM c)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
sha256(CASE WHEN plain THEN text WHEN r[4] % 100 < 50 THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


def op13_joined_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's token count, and the digests of its tokens and of what they decode to. Null texts are empty."""
    return joined_bpe.encode_bpe(documents(spark, sf_dir), with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_tokeniser_fertility, op2_source_mixing, op3_quality_classifier, op4_language_codes, op5_hnsw_near_dedup, op6_golay_simhash, op7_suffix_dedup, op8_nbest_pieces, op9_context_mixing, op10_token_counts, op11_conversation_repair, op12_fill_in_middle, op13_joined_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": OP2_SQL, "op11_conversation_repair": repair_sql.report_sql(), "op12_fill_in_middle": OP12_SQL}
