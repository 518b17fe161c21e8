"""Scalar functions on texts, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def root_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1)


def point(c: Column) -> tuple[Column, Column]:
    """Latitude and longitude of ``Point(lon lat)``."""
    number = r"(-?\d+(?:\.\d+)?)"
    text = rf"^Point\({number} {number}\)$"
    return F.regexp_extract(c, text, 2).try_cast("double"), F.regexp_extract(c, text, 1).try_cast("double")


#: A name in a template, and what may stand before it: fixed values of the template language.
_PLACE = re.compile(r"([\\%])?\{(\w+)\}")


def parts_of(template: str, known) -> list[tuple[str, str]]:
    """The template as texts ('', text) and places (mark, name); places of unknown names are texts, and so are those behind a backslash, without it."""
    out, last = [], 0
    for m in _PLACE.finditer(template):
        mark, name = m.group(1) or "{", m.group(2)
        if mark == "\\" or name in known:
            out += [("", template[last : m.start()]), ("", m.group()[1:]) if mark == "\\" else (mark, name)]
            last = m.end()
    return [x for x in [*out, ("", template[last:])] if x[1]]


def put(parts: list[tuple[str, str]], values: dict[str, Column]) -> Column:
    one = {"": lambda x: F.lit(x), "{": lambda x: values[x], "%": lambda x: F.url_encode(values[x])}
    return F.concat(F.lit(""), *(one[mark](x) for mark, x in parts))


def filled(template: str, **values: Column) -> Column:
    """The template with ``{name}`` replaced by values and ``%{name}`` by values as URLs have them, missing ones by nothing; ``\\{name}`` stays as ``{name}``. A value that looks like a name stays."""
    return put(parts_of(template, values), {k: F.coalesce(v.cast("string"), F.lit("")) for k, v in values.items()})


def json_at(c: Column, path: str) -> Column:
    return F.get_json_object(c, "$." + path)


def tokens(c: Column) -> Column:
    """Runs of letters and digits, in order."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, joined by spaces."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1))


def date_of(c: Column, american: bool = False) -> Column:
    """The date that a text of the form d/M/yyyy (or M/d/yyyy) names; null for other texts."""
    whole = c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    return F.when(whole, F.try_to_timestamp(c, F.lit("M/d/yyyy" if american else "d/M/yyyy")).cast("date"))


def parameters(c: Column) -> Column:
    """The name and value pairs of a query string, in order, decoded; a name without a sign has an empty value."""
    pairs = F.filter(F.split(c, "&"), lambda x: x != "")
    plain = lambda x: F.try_url_decode(x)
    return F.transform(pairs, lambda x: F.struct(plain(F.substring_index(x, "=", 1)).alias("name"), plain(F.when(F.instr(x, "=") > 0, F.regexp_extract(x, "=(.*)$", 1)).otherwise("")).alias("value")))


def rewritten(iri: Column, external: str, internal: str) -> Column:
    """An external name as an internal one with its hash; others stay."""
    return F.when(iri.startswith(external), F.concat(F.lit(internal), F.md5(iri))).otherwise(iri)


def clipped(c: Column, most: int = 80) -> Column:
    """A text of at most so many characters, the middle left out where it is longer."""
    half = most // 2 - 1
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, half), F.lit("…"), F.right(c, F.lit(half))))


def smart_plain(c: Column) -> Column:
    """Curly quotes and long dashes as plain ones, control characters as spaces."""
    return F.regexp_replace(F.translate(c, "‘’‚“”„–—", "'''\"\"\"--"), r"\p{Cntrl}", " ")


def filled_each(template: str, **values: Column) -> Column:
    """The template filled as ``filled`` does with every combination of the values of arrays, as an array: names vary, the last one fastest; an empty array gives none."""
    parts = parts_of(template, values)

    def with_each(names: list[str], held: dict[str, Column]) -> Column:
        if not names:
            return F.array(put(parts, held))
        return F.flatten(F.transform(values[names[0]], lambda x: with_each(names[1:], held | {names[0]: F.coalesce(x.cast("string"), F.lit(""))})))

    return with_each(list(values), {})
