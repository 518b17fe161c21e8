"""Quality rules on tokeniser fertility: how a public vocabulary splits a text, against bands for its language or script."""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm.texts import checkpointed, id_type, keyed, map_rows
from facetry.llm.vocabularies import FOLDER, broadcast_file, encoder

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
#: The vocabularies that measure: a byte-level one for many languages, and one of pieces with byte fallback.
VOCABULARIES = {"multi": f"{FOLDER}/byte_bpe_multi_50k.tiktoken", "piece": f"{FOLDER}/piece_bpe_32k.model"}
#: Bands are medians of measures in so many parts of one, which bounds the values that a histogram holds.
PARTS = 1000
MIN_WORDS = 50
#: Percent of words in repeated three-word windows above which a text fails.
MAX_REPEATED = 50
#: Up to so many pairs of language and script, their table is broadcast; beyond, it is joined on salted keys.
BROADCAST_BANDS, SALTS = 2000, 16


def word_figures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    words = text.split()  # of bytes: at space and \\x09-\\x0D, as WORD has it
    spaces = len(text) - len(text.translate(None, b" \t\n\x0b\x0c\r"))
    characters = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    return len(words), characters - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, n)
    v = len(first)
    if v == n:
        return 0
    _, pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)  # pairs numbered anew: products stay below 2 ** 63
    _, which, count = np.unique(pair[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[which] > 1)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[again + k] = True
    return int(covered.sum())


def entropy_bits(ids: np.ndarray, window: int) -> float | None:
    """Mean entropy in bits of windows of tokens, so that it doesn't rise with the length; the last window may overlap the one before.

    A shorter text is one window, whose entropy is scaled by the greatest that it could have; None for less than two tokens.
    """
    m = len(ids)
    if m < 2:
        return None
    width = min(m, window)
    rows = ids[: m // width * width].reshape(-1, width)
    if m % width:
        rows = np.vstack([rows, ids[-width:]])
    rows = np.sort(rows, axis=1)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    counts = np.diff(np.append(np.flatnonzero(new), rows.size))
    bits = np.log2(width) - (counts * np.log2(counts)).sum() / rows.size
    return float(bits * np.log2(window) / np.log2(width))


@cache
def script_of(point: int) -> str | None:
    return unicodedata.name(chr(point), "other").split(" ")[0].split("-")[0].lower() if chr(point).isalpha() else None


def script(text: str) -> str:
    """The script of most letters, by the first word of their Unicode names, at equal counts the first by name; "none" without letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    names: Counter[str] = Counter()
    for point, n in zip(*(x.tolist() for x in np.unique(points, return_counts=True)), strict=True):
        if name := script_of(point):
            names[name] += n
    return min(names, key=lambda x: (-names[x], x)) if names else "none"


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", vocabularies: dict[str, str] = VOCABULARIES, window: int = 128) -> DataFrame:
    """Word figures and each vocabulary's measures of each row, its script, and its language or else the script as ``band_key``.

    The columns of a vocabulary end in its name. A null or empty text has no words or tokens and null measures.
    ``byte_share`` is the share of tokens that are less than whole characters; ``token_entropy`` is null for texts of less
    than two tokens. Repeated rows are measured each.
    """
    files = {k: broadcast_file(docs.sparkSession, path) for k, path in vocabularies.items()}  # of fixed sizes

    def make():
        encoders = {k: encoder(files[k].value, path) for k, path in vocabularies.items()}
        of_words = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

        def each(batch):
            out: dict[str, list] = {k: [] for k in (*of_words, "band_key", "script", *columns(vocabularies))}
            for raw, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                raw = raw or b""
                for k, v in zip(of_words, word_figures(raw), strict=True):
                    out[k].append(v)
                text = raw.decode("utf-8", "replace")
                for k, (encode, part) in encoders.items():
                    ids = np.array(encode(text), np.int32)
                    out[f"n_tokens_{k}"].append(len(ids))
                    out[f"chars_per_token_{k}"].append(len(text) / len(ids) if len(ids) else None)
                    out[f"byte_share_{k}"].append(float(part[ids].mean()) if len(ids) else None)
                    out[f"token_entropy_{k}"].append(entropy_bits(ids, window))
                written = script(text)
                out["script"].append(written)
                out["band_key"].append(f"lang:{lang}" if lang is not None else f"script:{written}")
            return out | {"doc_id": batch["doc_id"]}

        return each

    lang = F.col(f"`{lang_col}`").cast("string") if lang_col else F.lit(None).cast("string")
    kinds = ", ".join(f"{k} {'long' if k.startswith('n_tokens') else 'double'}" for k in columns(vocabularies))
    longs = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return map_rows(keyed(docs, id_col, text_col, lang=lang), make, f"doc_id {id_type(docs, id_col)}, {longs}, band_key string, script string, {kinds}")


def columns(vocabularies) -> list[str]:
    return [f"{m}_{k}" for k in vocabularies for m in ("n_tokens", *MEASURES)]


def measures_of(measured: DataFrame) -> list[str]:
    return [c for c in measured.columns if c.startswith(MEASURES)]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def with_bands(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Joins the bands of each row's language and script. One language may hold a third of all rows, which therefore aren't dealt out by it."""
    table = checkpointed(table)
    if table.count() <= BROADCAST_BANDS:
        return rows.join(F.broadcast(table), ["band_key", "script"], "left")
    salted = table.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, ["band_key", "script", "salt"], "left").drop("salt")


def medians(histogram: DataFrame) -> DataFrame:
    """The lower median ``mid`` of each key's measure, and how many values it has. A window holds a key's different values, not its rows."""
    w = Window.partitionBy("key", "measure")
    upto = histogram.withColumn("upto", F.sum("n").over(w.orderBy("value"))).withColumn("n", F.sum("n").over(w))
    return upto.where(F.col("upto") * 2 >= F.col("n")).groupBy("key", "measure").agg(F.min("value").alias("mid"), F.max("n").alias("n"))


def bands(measured: DataFrame, spread: float = 6.0, least: int = 30) -> DataFrame:
    """For each pair of band key and script the median and the band around it of each measure, from all rows that pass the base rules.

    The half width is ``spread`` times the scaled median absolute deviation, and at least 2% of the median or 0.02. Medians
    are exact, of measures rounded to 1 / PARTS. A key with fewer than ``least`` such rows has the band of its script, and a
    script with fewer that of all rows; so few rows in all give no band.
    """
    names = measures_of(measured)
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.round(F.col(m) * PARTS).cast("long").alias("value")) for m in names))).alias("of")
    counts = measured.where(~base_failed()).select("band_key", "script", values).select("band_key", "script", "of.*").where("value IS NOT NULL")
    counts = checkpointed(counts.groupBy("band_key", "script", "measure", "value").agg(F.count("*").alias("n")))
    keys = F.col("band_key"), F.concat(F.lit("script:"), "script"), F.lit("all")
    each = counts.withColumn("key", F.explode(F.array_distinct(F.array(*keys)))).groupBy("key", "measure", "value").agg(F.sum("n").alias("n"))
    middle = checkpointed(medians(each))
    off = each.join(middle.select("key", "measure", "mid"), ["key", "measure"]).groupBy("key", "measure", F.abs(F.col("value") - F.col("mid")).alias("value")).agg(F.sum("n").alias("n"))
    found = middle.join(medians(off).select("key", "measure", F.col("mid").alias("off")), ["key", "measure"])
    half = F.greatest(spread * 1.4826 * F.col("off"), 0.02 * F.col("mid"), F.lit(0.02 * PARTS))
    found = found.select("key", "measure", "n", ((F.col("mid") - half) / PARTS).alias("low"), ((F.col("mid") + half) / PARTS).alias("high"))
    limits = [F.max(F.when(F.col("measure") == m, F.col(e))).alias(f"{m}_{e}") for m in names for e in ("low", "high")]
    table = found.groupBy("key").agg(F.max("n").alias("rows"), *limits).where(F.col("rows") >= least).drop("rows")
    table = checkpointed(table)
    pairs = counts.select("band_key", "script").distinct()
    ranked = pairs.select("band_key", "script", F.posexplode(F.array(*keys)).alias("at", "key")).join(table.select("key"), "key")
    taken = ranked.groupBy("band_key", "script").agg(F.min_by("key", "at").alias("key"))
    return taken.join(table, "key").withColumnRenamed("key", "band")


def fertility_rules(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``base_failed``, the verdict of each kind of band, ``band``, the key of the band that was taken, and ``kept``.

    A text is rejected if its base fails, or if by most of the vocabularies (of two: both, so that the gaps of one reject
    nothing) it has fewer or more characters a token than its band, a higher share of byte tokens, or a lower entropy. A missing measure or
    band rejects nothing.
    """
    names = measures_of(measured)
    vocabularies = [m.removeprefix(f"{MEASURES[0]}_") for m in names if m.startswith(MEASURES[0])]
    value, low, high = (lambda m, k, e=e: F.col(f"{m}_{k}{e}") for e in ("", "_low", "_high"))
    outside = {
        "bad_fertility": lambda k: (value(MEASURES[0], k) < low(MEASURES[0], k)) | (value(MEASURES[0], k) > high(MEASURES[0], k)),
        "bad_bytes": lambda k: value(MEASURES[1], k) > high(MEASURES[1], k),
        "bad_entropy": lambda k: value(MEASURES[2], k) < low(MEASURES[2], k),
    }
    out = with_bands(measured, limits).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed")
    for name, test in outside.items():
        votes = sum((F.coalesce(test(k), F.lit(False)).cast("int") for k in vocabularies), F.lit(0))
        out = out.withColumn(name, votes * 2 > len(vocabularies))
        kept = kept & ~F.col(name)
    return out.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *columns(vocabularies), "band_key", "script", "band", *outside)
