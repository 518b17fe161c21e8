"""Fill-in-the-middle: a text's units become prefix, middle and suffix, the middle told last, so that a model learns to fill gaps.

The units are the matches that the tokenizers library's Split pre-tokenizer isolates: it gives their code-point offsets without
any training. The number of offsets is n; offsets picked by rank cut the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm.texts import id_type, keyed, map_rows

#: A line with its end, or the last one without.
UNITS = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of the seed and the identifier in decimal; a null identifier counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cut_units(text: str, splitter) -> list[int]:
    """Code-point offsets of the units' ends, after a first 0."""
    return [0, *(end for _, (_, end) in splitter.pre_tokenize_str(text))]


def rearranged(text: str, offsets: list[int], draw: list[int], rate: int, spm: int) -> tuple[str, str, int | None, int | None]:
    """Form, output, and the characters of prefix and middle of one text."""
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or draw[2] % 100 >= rate:
        return "plain", text, None, None
    first, last = sorted(offsets[d % len(offsets)] for d in draw[:2])  # offsets rise, so the smaller rank has the smaller offset
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if draw[3] % 100 < spm:
        return "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", first, last - first
    return "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", first, last - first


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: str = UNITS, rate: int = 100, spm: int = 50, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of each row.

    ``rate`` percent of the texts are rearranged, ``spm`` percent of these with the suffix first; the rest, empty texts and
    texts that hold a mark are ``plain``: the text itself, the two counts null. A null text counts as empty. What happens to a
    row depends on its identifier and text alone, so that repeated rows agree; extra columns are left out.
    """

    def make():
        from tokenizers import Regex, pre_tokenizers

        splitter = pre_tokenizers.Split(Regex(units), "isolated")

        def each(batch):
            out: dict[str, list] = {k: [] for k in ("n", "form", "output", "prefix_chars", "middle_chars")}
            for raw, draw in zip(batch["text"].to_pylist(), batch["draws"].to_pylist(), strict=True):
                text = (raw or b"").decode("utf-8", "replace")
                offsets = cut_units(text, splitter)
                for name, x in zip(out, (len(offsets) - 1, *rearranged(text, offsets, draw, rate, spm)), strict=True):
                    out[name].append(x)
            return out | {"doc_id": batch["doc_id"]}

        return each

    rows = keyed(docs, id_col, text_col, draws=F.array(*draws(F.col(f"`{id_col}`"), seed)))
    return map_rows(rows, make, f"doc_id {id_type(docs, id_col)}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from: its parts between the marks, put back in order."""
    s, p, m = (F.instr(output, mark) for mark in (SUFFIX, PREFIX, MIDDLE))
    part = lambda start, end: F.substr(output, start + len(MIDDLE), end - start - len(MIDDLE))
    middle = F.substr(output, m + len(MIDDLE))
    return F.when(form == "psm", F.concat(part(p, s), middle, part(s, m))).when(form == "spm", F.concat(part(p, m), middle, part(s, p))).otherwise(output)
