"""Terms of statements as columns (kind, text, datatype, lang): tests, parts, conversions, names and plain forms; JSON by paths; cleaned texts."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the data types that numbers have, and of those that a term's kind implies: fixed values.
NUMBERS = ("integer", "decimal", "double", "float", "int", "long", "short", "byte")
IRI, BLANK, LITERAL = "iri", "blank", "literal"


def term(text: Column, kind: Column | str = LITERAL, datatype: Column | str | None = None, lang: Column | None = None) -> Column:
    """A term; a literal without a data type is a string, one with a language a langString. Null for a null text."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    own = F.lit(datatype) if isinstance(datatype, str) else F.lit(None).cast("string") if datatype is None else datatype
    tongue = F.lit(None).cast("string") if lang is None else lang
    of = F.when(kind == LITERAL, F.when(tongue.isNotNull(), "langString").otherwise(F.coalesce(own, F.lit("string"))))
    return F.when(text.isNotNull(), F.struct(kind.alias("kind"), text.cast("string").alias("text"), of.alias("datatype"), tongue.alias("lang")))


def is_iri(t: Column) -> Column:
    return t["kind"] == IRI


def is_blank(t: Column) -> Column:
    return t["kind"] == BLANK


def is_literal(t: Column) -> Column:
    return t["kind"] == LITERAL


def is_numeric(t: Column) -> Column:
    """A literal of a number's type that reads as one."""
    return is_literal(t) & t["datatype"].isin(*NUMBERS) & t["text"].try_cast("double").isNotNull()


def bound(t: Column) -> Column:
    return t.isNotNull()


def text_of(t: Column) -> Column:
    return t["text"]


def lang_of(t: Column) -> Column:
    """The language, nothing for literals without one; null for what is no literal."""
    return F.when(is_literal(t), F.coalesce(t["lang"], F.lit("")))


def type_of(t: Column) -> Column:
    """The data type of a literal, ``iri`` or ``blank``."""
    return F.when(is_literal(t), t["datatype"]).otherwise(t["kind"])


def has_type(t: Column, name: str) -> Column:
    """Whether a term is of a data type, or of one that it holds: any, resource, literal."""
    holders = {"any": t.isNotNull(), "resource": t["kind"].isin(IRI, BLANK), "literal": is_literal(t)}
    return F.coalesce(holders.get(name, type_of(t) == name), F.lit(False))


def converted(t: Column, kind: str) -> Column:
    """A literal's value as ``boolean``, ``integer``, ``decimal``, ``double``, ``string``, ``date`` or ``dateTime``; null if its text isn't one, and for names, but as strings."""
    text = t["text"]
    if kind == "string":
        return text
    plain = {
        "boolean": F.when(F.lower(text).isin("true", "1"), True).when(F.lower(text).isin("false", "0"), False),
        "integer": F.when(text.rlike(r"\A[+-]?\d+\z"), text.try_cast("decimal(38,0)")),
        "decimal": F.when(text.rlike(r"\A[+-]?(?:\d+\.?\d*|\.\d+)\z"), text.try_cast("decimal(38,10)")),
        "double": F.when(text.rlike(r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"), text.try_cast("double")),
        "date": F.when(text.rlike(r"\A\d{4}-\d\d-\d\d"), F.substring(text, 1, 10).try_cast("date")),
        "dateTime": F.when(text.rlike(r"\A\d{4}-\d\d-\d\dT\d\d:\d\d"), text.try_cast("timestamp")),
    }
    return F.when(is_literal(t), plain[kind])


def quoted(text: Column) -> Column:
    """In single quotes, with backslashes before backslashes and quotes and for line ends and tabs."""
    out = text
    for old, new in (("\\", "\\\\"), ("'", "\\'"), ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.concat(F.lit("'"), out, F.lit("'"))


def formatted(t: Column) -> Column:
    """The plain form of a term: names in angle brackets (``a`` for the type's), numbers and truth values bare, other literals quoted with their language or type."""
    text, dt = t["text"], t["datatype"]
    bare = F.when((dt == "boolean") & converted(t, "boolean").isNotNull(), converted(t, "boolean").cast("string")).when((dt == "integer") & converted(t, "integer").isNotNull(), converted(t, "integer").cast("string"))
    literal = F.coalesce(bare, F.when(dt == "string", quoted(text)).when(t["lang"].isNotNull(), F.concat(quoted(text), F.lit("@"), t["lang"])).otherwise(F.concat(quoted(text), F.lit("^^<"), dt, F.lit(">"))))
    named = F.when(text == "rdf:type", "a").otherwise(F.concat(F.lit("<"), text, F.lit(">")))
    return F.when(is_iri(t), named).when(is_blank(t), F.concat(F.lit("_:"), text)).when(is_literal(t), literal)


def indented(text: Column) -> Column:
    return F.regexp_replace(text, "\n", "\n\t")


def named_uuid(text: Column) -> Column:
    """The version 3 UUID of a text: its MD5 with version and variant set."""
    h = F.md5(text.cast("binary"))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def iri_parts(iri: Column) -> Column:
    """``scheme``, ``host`` (with user and port), ``path``, ``query`` and ``fragment`` of a name, empty where it has none."""
    pattern = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
    return F.struct(*(F.regexp_extract(iri, pattern, k + 1).alias(name) for k, name in enumerate(("scheme", "host", "path", "query", "fragment"))))


def vocabulary(iri: Column, host: str = "schema.org") -> Column:
    """Names of a vocabulary under its secure address, whichever they were told under."""
    return F.regexp_replace(iri, rf"\Ahttp://{re.escape(host)}/", f"https://{host}/")


def normalised(value: Column, *rules) -> Column:
    """The value after rules, each applied to what the ones before gave; a rule that gives null leaves it."""
    return reduce(lambda v, rule: F.coalesce(rule(v), v), rules, value)


# --- expressions


def group(text: Column, expression: str, n: int) -> Column:
    """A group of an expression that matches all of the text; null if it doesn't."""
    return F.when(text.rlike(rf"\A(?:{expression})\z"), F.regexp_extract(text, rf"\A(?:{expression})\z", n))


def results(text: Column, expression: str, n: int = 0) -> Column:
    """A group of each match anywhere in the text, in order."""
    return F.regexp_extract_all(text, F.lit(expression), F.lit(n))


# --- JSON


def json_values(json: Column, path: str) -> Column:
    """The values at the end of a dotted path, as an array of variants: names step into objects, numbers into arrays, ``*`` into all values. Null for text that is no JSON."""
    whole = F.try_parse_json(json)
    found = F.array(whole)
    for step in [p.strip() for p in path.split(".") if p.strip()]:
        found = F.flatten(F.transform(found, stepping(step)))
    return F.when(whole.isNotNull(), found)


def stepping(step: str):
    """What one step leads to from a JSON value, as an array."""

    def each(v: Column) -> Column:
        none = F.array().cast("array<variant>")
        values, fields = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$", "map<string,variant>")
        if step == "*":
            return F.coalesce(values, F.map_values(fields), none)
        own = F.when(fields.isNotNull() & F.map_contains_key(fields, step), F.array(F.element_at(fields, step)))
        if step.isdigit():
            own = F.coalesce(own, F.when(values.isNotNull() & (F.size(values) > int(step)), F.array(F.get(values, F.lit(int(step))))))
        return F.coalesce(own, none)

    return each


def json_texts(json: Column, path: str) -> Column:
    return _typed(json_values(json, path), lambda k: k == "STRING", "string")


def json_booleans(json: Column, path: str) -> Column:
    return _typed(json_values(json, path), lambda k: k == "BOOLEAN", "boolean")


def json_decimals(json: Column, path: str) -> Column:
    return _typed(json_values(json, path), lambda k: k.isin("BIGINT", "DOUBLE") | k.startswith("DECIMAL"), "decimal(38,10)")


def json_integers(json: Column, path: str) -> Column:
    """Numbers without what follows the point."""
    return F.transform(json_decimals(json, path), lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long"))


def _typed(values: Column, test, kind: str) -> Column:
    return F.transform(F.filter(values, lambda v: test(F.schema_of_variant(v))), lambda v: F.try_variant_get(v, "$", kind))


# --- cleaning


#: Plain forms of quotes, dashes and spaces.
PLAIN = str.maketrans(dict.fromkeys("‘’‚‛′", "'") | dict.fromkeys("“”„‟″", '"') | dict.fromkeys("‐‑‒–—―", "-") | {"…": "..."} | dict.fromkeys("\u00a0\u2002\u2003\u2007\u2009\u200a\u202f\u205f\u3000", " "))


def cleaned_text(text: str, space: bool, marks: bool, smart: bool) -> str:
    out, gap = [], False
    for c in unicodedata.normalize("NFD" if marks else "NFC", text):
        kind = unicodedata.category(c)
        if kind in ("Cc", "Zs", "Zl", "Zp") and space:
            gap = bool(out)
            continue
        if kind in ("Me", "Mn", "Mc") and marks:
            continue
        if gap and kind not in ("Me", "Mn", "Mc"):
            out.append(" ")
            gap = False
        out.append(c.translate(PLAIN) if smart else c)
    return "".join(out)


def cleaned(text: Column, space: bool = True, marks: bool = False, smart: bool = False) -> Column:
    """Texts in composed form: runs of spaces and controls as one space, none at the ends (``space``); without combining marks, and then decomposed (``marks``); quotes, dashes and spaces as plain ones (``smart``). Null for null."""

    def run(texts: pa.Array) -> pa.Array:
        known: dict = {}
        return pa.array([None if t is None else known.get(t) or known.setdefault(t, cleaned_text(t, space, marks, smart)) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)
