"""Shapes: composable constraints on the values that a path reaches, and their rewriting: guards, inference, languages, outlines."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Focus:
    """The item that a shape is applied to, or a name relative to its name."""

    path: str = ""

    def of(self, name: str) -> str:
        return name + self.path


@dataclass(frozen=True)
class Value:
    """A test of one value: the name of the test and its arguments."""

    kind: str
    args: tuple = ()

    def test(self, c: Column, whole: bool = False) -> Column:
        """``whole``: patterns match all of the text, as validation has it; selection finds them anywhere."""
        return TESTS["whole_pattern" if whole and self.kind == "pattern" else self.kind](c, *self.args)

    @property
    def rule(self) -> str:
        return f"{self.kind}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Values:
    """A test of the set of values: sizes, or values that must all or partly be there, or a test of each."""

    least: int | None = None
    most: int | None = None
    all: tuple = ()
    any: tuple = ()
    every: Value | None = None

    @property
    def rule(self) -> str:
        if self.least is not None or self.most is not None:
            return f"{self.least or ''}..{'' if self.most is None else self.most} values"
        return f"all({', '.join(map(str, self.all))})" if self.all else f"any({', '.join(map(str, self.any))})" if self.any else f"every {self.every.rule}"


@dataclass(frozen=True)
class Lang:
    """Texts in one of the languages; in any language if there are no tags."""

    tags: tuple = ()

    @property
    def rule(self) -> str:
        return f"lang({', '.join(self.tags)})"


@dataclass(frozen=True)
class Localized:
    """One text a language at most."""

    rule = "localized"


@dataclass(frozen=True)
class Clazz:
    """Membership of a class or of any class below it."""

    name: str

    @property
    def rule(self) -> str:
        return f"class({self.name})"


@dataclass(frozen=True)
class Field:
    name: str
    shape: object


@dataclass(frozen=True)
class Link:
    """A shape of the principal that an alias leads to by the named step."""

    name: str
    shape: object


@dataclass(frozen=True)
class And:
    shapes: tuple


@dataclass(frozen=True)
class Or:
    shapes: tuple


@dataclass(frozen=True)
class Guard:
    """Open for some values of an axis such as role, task, view or mode."""

    axis: str
    values: tuple


@dataclass(frozen=True)
class When:
    test: object
    then: object
    other: object


def _pattern(c: Column, expression: str, flags: str = "") -> Column:
    return c.cast("string").rlike((f"(?{flags})" if flags else "") + expression)


def _whole(c: Column, expression: str, flags: str = "") -> Column:
    return c.cast("string").rlike((f"(?{flags})" if flags else "") + rf"\A(?:{expression})\z")


def _lexical(c: Column, name: str) -> Column:
    text = c.cast("string")
    if name == "any":
        return F.coalesce(text.isNotNull(), F.lit(False)) | F.lit(True)
    fits = text.rlike(LEXICAL[name])
    if name == "date":
        return F.when(fits, F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).isNotNull()).otherwise(fits)
    if name == "dateTime":
        return F.when(fits, F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()).otherwise(fits)
    return fits


#: What texts of a data type look like: fixed values of the type definitions.
LEXICAL = {
    "string": r"(?s)\A.*\z", "boolean": r"\A(?:true|false|0|1)\z", "integer": r"\A[+-]?\d+\z", "decimal": r"\A[+-]?(?:\d+(?:\.\d*)?|\.\d+)\z",
    "double": r"\A(?:[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|-?INF|NaN)\z", "date": r"\A\d{4}-\d\d-\d\d(?:Z|[+-]\d\d:\d\d)?\z",
    "dateTime": r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)?\z", "iri": r"\A[A-Za-z][A-Za-z0-9+.-]*:\S+\z", "blank": r"\A_:\S+\z",
    "resource": r"\A(?:_|[A-Za-z][A-Za-z0-9+.-]*):\S+\z", "literal": r"(?s)\A.*\z", "langString": r"(?s)\A.*\z",
}
#: The data types that hold another one's values.
HOLDERS = {"iri": {"resource", "any"}, "blank": {"resource", "any"}, "resource": {"any"}, "literal": {"any"}, "any": set()} | {k: {"literal", "any"} for k in ("string", "boolean", "integer", "decimal", "double", "date", "dateTime", "langString")}

TESTS: dict[str, Callable[..., Column]] = {
    "min_inclusive": lambda c, v: c >= F.lit(v),
    "max_inclusive": lambda c, v: c <= F.lit(v),
    "min_exclusive": lambda c, v: c > F.lit(v),
    "max_exclusive": lambda c, v: c < F.lit(v),
    "min_length": lambda c, n: F.length(c.cast("string")) >= n,
    "max_length": lambda c, n: F.length(c.cast("string")) <= n,
    "pattern": _pattern,
    "whole_pattern": _whole,
    "stem": lambda c, prefix: c.cast("string").startswith(prefix),
    "like": lambda c, keywords, stemming=True: _pattern(c, expression, "i") if (expression := keyword_pattern(keywords, stemming)) else c.isNotNull(),
    "datatype": _lexical,
    "column_type": lambda c, fits, name: c.isNotNull() & F.lit(fits),
    "one_of": lambda c, *values: c.isin(*values),
}


def min_inclusive(v) -> Value:
    return Value("min_inclusive", (v,))


def max_inclusive(v) -> Value:
    return Value("max_inclusive", (v,))


def min_exclusive(v) -> Value:
    return Value("min_exclusive", (v,))


def max_exclusive(v) -> Value:
    return Value("max_exclusive", (v,))


def min_length(n: int) -> Value:
    return Value("min_length", (n,))


def max_length(n: int) -> Value:
    return Value("max_length", (n,))


def pattern(expression: str, flags: str = "") -> Value:
    """Selecting finds the pattern anywhere; validation matches all of the text."""
    return Value("pattern", (expression, flags) if flags else (expression,))


def stem(prefix: str) -> Value:
    return Value("stem", (prefix,))


def keyword_pattern(keywords: str, stemming: bool = True) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", keywords) if not unicodedata.combining(c))
    end = "" if stemming else r"\b"
    return ".*".join(rf"\b{w}{end}" for w in re.findall(r"\w+", plain))


def like(keywords: str, stemming: bool = True) -> Value:
    """Words in order, each at the start of a word, all in one line, without regard to case; marks are taken off the keywords only."""
    return Value("like", (keywords,) if stemming else (keywords, False))


def datatype(name: str) -> Value:
    """The value's text is one of the data type's."""
    if name not in HOLDERS:
        raise ValueError(f"{name!r} is no data type: {', '.join(HOLDERS)}")
    return Value("datatype", (name,))


def one_of(*values) -> Value:
    return Value("one_of", values)


def lang(*tags: str) -> Lang:
    return Lang(tags)


def localized() -> Localized:
    return Localized()


def min_count(n: int) -> Values:
    return Values(least=n)


def max_count(n: int) -> Values:
    return Values(most=n)


def has_all(*values) -> Values:
    return Values(all=values)


def has_any(*values) -> Values:
    return Values(any=values)


def in_range(*values) -> Values:
    """No value outside the set."""
    return Values(every=one_of(*values))


def field(name: str, *shapes) -> Field:
    return Field(name, both(*shapes))


def link(name: str, *shapes):
    """Nothing is asked of an alias whose principal could have no value."""
    inner = both(*shapes)
    return True if inner is False else Link(name, inner)


def required(*shapes) -> object:
    """One value."""
    return both(min_count(1), max_count(1), *shapes)


def optional(*shapes) -> object:
    return both(max_count(1), *shapes)


def repeatable(*shapes) -> object:
    return both(min_count(1), *shapes)


def multiple(*shapes) -> object:
    return both(*shapes)


def narrower(a: Value, b: Value) -> Value:
    """Of two data types the one whose values the other holds; an error if neither does."""
    x, y = a.args[0], b.args[0]
    if x == y or y in HOLDERS[x]:
        return a
    if x in HOLDERS[y]:
        return b
    raise ValueError(f"a value can't be of data types {x} and {y}")


def met(a: Lang, b: Lang) -> Lang:
    if not a.tags or not b.tags:
        return a if a.tags else b
    if not (tags := tuple(t for t in a.tags if t in b.tags)):
        raise ValueError(f"no language is in {a.rule} and {b.rule}")
    return Lang(tags)


def merged(parts: list) -> list:
    """Parts of a conjunction with one of each kind that can be told as one: sizes, ranges, required values, data types, languages."""
    out: list = []
    for s in parts:
        for i, was in enumerate(out):
            if isinstance(s, Values) and isinstance(was, Values):
                if s.least is not None and was.least is not None and s.most is was.most is None:
                    out[i] = Values(least=max(s.least, was.least))
                elif s.most is not None and was.most is not None and s.least is was.least is None:
                    out[i] = Values(most=min(s.most, was.most))
                elif s.every and was.every and s.every.kind == was.every.kind == "one_of":
                    out[i] = Values(every=one_of(*(v for v in was.every.args if v in s.every.args)))
                elif s.all and was.all:
                    out[i] = Values(all=(*was.all, *(v for v in s.all if v not in was.all)))
                else:
                    continue
                break
            if isinstance(s, Value) and isinstance(was, Value) and s.kind == was.kind == "datatype":
                out[i] = narrower(was, s)
                break
            if isinstance(s, Lang) and isinstance(was, Lang):
                out[i] = met(was, s)
                break
        else:
            out.append(s)
    return out


def both(*shapes) -> object:
    """Conjunction; nested ones are flattened, equal parts and true dropped, false absorbs, fields and links of one name merge, and so do sizes, ranges, data types and languages; contradictory ones are errors."""
    flat: list = []
    for s in shapes:
        flat += s.shapes if isinstance(s, And) else [s]
    if any(s is False for s in flat):
        return False
    steps: dict[tuple, list] = {}
    out: list = []
    for s in flat:
        if s is True or s in out:
            continue
        if isinstance(s, (Field, Link)):
            steps.setdefault((type(s), s.name), []).append(s.shape)
        else:
            out.append(s)
    out = merged(out) + [kind(n, x[0] if len(x) == 1 else both(*x)) for (kind, n), x in steps.items()]
    return True if not out else out[0] if len(out) == 1 else And(tuple(out))


def either(*shapes) -> object:
    """Disjunction; nested ones are flattened, equal parts and false dropped, true absorbs, and ranges and languages are united."""
    flat: list = []
    for s in shapes:
        flat += s.shapes if isinstance(s, Or) else [s]
    if any(s is True for s in flat):
        return True
    out: list = []
    for s in flat:
        if s is False or s in out:
            continue
        for i, was in enumerate(out):
            if isinstance(s, Values) and isinstance(was, Values) and s.every and was.every and s.every.kind == was.every.kind == "one_of":
                out[i] = Values(every=one_of(*was.every.args, *(v for v in s.every.args if v not in was.every.args)))
                break
            if isinstance(s, Lang) and isinstance(was, Lang):
                out[i] = Lang(() if not s.tags or not was.tags else (*was.tags, *(t for t in s.tags if t not in was.tags)))
                break
        else:
            out.append(s)
    return False if not out else out[0] if len(out) == 1 else Or(tuple(out))


def conditional(test, then, other=True):
    """One shape where the test holds, another where it doesn't; a test that is known settles it."""
    return then if test is True else other if test is False else When(test, then, other)


def rewritten(shape, each: Callable):
    """A shape whose parts are rewritten by ``each``, steps and connectives kept."""
    if isinstance(shape, (Field, Link)):
        return type(shape)(shape.name, each(shape.shape))
    if isinstance(shape, (And, Or)):
        return (both if isinstance(shape, And) else either)(*map(each, shape.shapes))
    if isinstance(shape, When):
        return conditional(each(shape.test), each(shape.then), each(shape.other))
    return shape


def redact(shape, axis: str, *values):
    """Settles an axis' guards: open if one of its values is given, or for any value without values."""
    if isinstance(shape, Guard) and shape.axis == axis:
        return not values or bool(set(values) & set(shape.values))
    if isinstance(shape, (Field, Link)):
        inner = redact(shape.shape, axis, *values)
        return False if inner is False else replace(shape, shape=inner)
    if isinstance(shape, And):
        kept = [redact(s, axis, *values) for s in shape.shapes]
        return both(*(s for s, was in zip(kept, shape.shapes, strict=True) if not (s is False and isinstance(was, (Field, Link)))))
    if isinstance(shape, Or):
        return either(*(redact(s, axis, *values) for s in shape.shapes))
    if isinstance(shape, When):
        return conditional(*(redact(s, axis, *values) for s in (shape.test, shape.then, shape.other)))
    return shape


def expanded(shape):
    """The shape with all that follows from it: sizes and data types of ranges, classes, languages and required values, and that whatever has fields is no literal. A shape that contradicts what follows from it is an error.

    Names of inverse steps begin with ``^``; what they lead to is no literal either.
    """
    if isinstance(shape, Value) and shape.kind == "datatype" and shape.args == ("boolean",):
        return both(shape, in_range(False, True), max_count(1))
    if isinstance(shape, Clazz):
        return both(shape, datatype("resource"))
    if isinstance(shape, Values):
        if shape.every and shape.every.kind == "one_of":
            kinds = {type_of(v) for v in shape.every.args}
            return both(shape, max_count(len(shape.every.args)), datatype(kinds.pop()) if len(kinds) == 1 else True)
        return both(shape, min_count(len(shape.all)) if shape.all else True, min_count(1) if shape.any else True)
    if isinstance(shape, (Lang, Localized)):
        return both(shape, datatype("langString"))
    if isinstance(shape, Link):
        return both(Link(shape.name, both(expanded(shape.shape), datatype("resource"))), datatype("resource"))
    if isinstance(shape, Field):
        inner = expanded(shape.shape)
        if shape.name.startswith("^"):
            return Field(shape.name, both(inner, datatype("resource")))
        return both(Field(shape.name, both(inner, datatype("iri")) if shape.name == "type" else inner), datatype("resource"))
    out = rewritten(shape, expanded)
    if isinstance(out, And) and (tags := max((len(x.tags) for x in parts(out) if isinstance(x, Lang)), default=0)) and any(isinstance(x, Localized) for x in parts(out)):
        out = both(out, max_count(tags))
    return out


def type_of(value) -> str:
    if isinstance(value, Focus):
        return "iri"
    return {bool: "boolean", int: "integer", float: "double"}.get(type(value), "iri" if isinstance(value, str) and re.match(LEXICAL["iri"].replace(r"\z", r"\Z"), value) else "string")


def parts(shape) -> Iterator:
    """The parts of a conjunction, those of links included."""
    for s in shape.shapes if isinstance(shape, And) else [shape]:
        if isinstance(s, Link):
            yield from parts(s.shape)
        yield s


def localised(shape, *tags: str):
    """Languages cut to those asked for; where none of a shape's is among them, or it names none, those asked for take their place. ``*`` asks for all."""
    if "*" in tags:
        return shape
    if isinstance(shape, Lang):
        kept = tuple(t for t in shape.tags if t in tags)
        return Lang(kept or tags or shape.tags)
    return rewritten(shape, lambda s: localised(s, *tags))


def pruned(shape, mode: str):
    """What a shape holds for a mode: ``filter`` keeps what filters ask of values, and the steps to it; ``convey`` keeps the steps that an answer shows, and what conveying guards hold."""
    if isinstance(shape, Guard):
        return mode in shape.values if shape.axis == "mode" else shape
    if isinstance(shape, (Field, Link)):
        inner = pruned(shape.shape, mode)
        return True if mode == "filter" and inner is True else replace(shape, shape=inner)
    if isinstance(shape, When):
        test = pruned(shape.test, mode)
        return conditional(test, shape.then, shape.other) if test in (True, False) else When(test, pruned(shape.then, mode), pruned(shape.other, mode))
    if isinstance(shape, (And, Or)):
        return rewritten(shape, lambda s: pruned(s, mode))
    return True


def resolved(shape, name: str):
    """The shape of one item, its name in the place of the focus."""
    if isinstance(shape, Value):
        return replace(shape, args=tuple(v.of(name) if isinstance(v, Focus) else v for v in shape.args))
    if isinstance(shape, Values):
        put = lambda values: tuple(v.of(name) if isinstance(v, Focus) else v for v in values)
        return replace(shape, all=put(shape.all), any=put(shape.any), every=shape.every and resolved(shape.every, name))
    return rewritten(shape, lambda s: resolved(s, name))


def outlined(shape, *sources) -> list[tuple]:
    """The statements that a shape makes of its sources: their classes, and the values that their fields must all have. Values are told of in turn by the shapes beside them; a step before which ``^`` stands points back."""
    if isinstance(shape, Clazz):
        return [(s, "type", shape.name) for s in sources]
    if isinstance(shape, Link):
        return outlined(shape.shape, *sources)
    if isinstance(shape, Field):
        back, name = shape.name.startswith("^"), shape.name.lstrip("^")
        own = [(t, name, s) if back else (s, name, t) for t in all_of(shape.shape) for s in sources]
        return own + outlined(shape.shape)
    if isinstance(shape, And):
        out = [x for s in shape.shapes for x in outlined(s, *sources)]
        return out + ([x for s in shape.shapes for x in outlined(s, *values)] if (values := all_of(shape)) else [])
    return []


def all_of(shape) -> tuple:
    """The values that a shape requires."""
    return tuple(v for s in parts(shape) if isinstance(s, Values) for v in s.all)


def sizes(shape) -> tuple[int | None, int | None]:
    """The least and the greatest count of values that a shape allows."""
    found = [s for s in parts(shape) if isinstance(s, Values)]
    return max((s.least for s in found if s.least is not None), default=None), min((s.most for s in found if s.most is not None), default=None)


def type_name(shape) -> str | None:
    return next((s.args[0] for s in parts(shape) if isinstance(s, Value) and s.kind == "datatype"), None)


def class_name(shape) -> str | None:
    return next((s.name for s in parts(shape) if isinstance(s, Clazz)), None)


def limits(shape) -> dict[str, object]:
    """The arguments of the tests of values by name, the closer ones where a test stands twice."""
    out: dict[str, object] = {}
    for s in parts(shape):
        if isinstance(s, Value) and len(s.args) == 1 and s.kind != "one_of":
            pick = max if s.kind.startswith("min") else min if s.kind.startswith("max") else lambda a, b: a
            out[s.kind] = pick(out[s.kind], s.args[0]) if s.kind in out else s.args[0]
    return out


def range_of(shape) -> tuple | None:
    return next((s.every.args for s in parts(shape) if isinstance(s, Values) and s.every and s.every.kind == "one_of"), None)


def languages_of(shape) -> tuple | None:
    return next((s.tags for s in parts(shape) if isinstance(s, Lang)), None)


def fields_of(shape) -> dict[str, object]:
    """The fields that a shape knows, with their shapes, those in alternatives and branches included."""
    out: dict[str, object] = {}
    if isinstance(shape, Field):
        return {shape.name: shape.shape}
    inner = shape.shapes if isinstance(shape, (And, Or)) else (shape.then, shape.other) if isinstance(shape, When) else (shape.shape,) if isinstance(shape, Link) else ()
    for s in inner:
        for name, x in fields_of(s).items():
            out[name] = both(out[name], x) if name in out else x
    return out


def walked(shape, *path: str):
    """The shape at the end of a path; an error where the shape has no such field."""
    for k, step in enumerate(path):
        known = fields_of(shape)
        if step not in known:
            raise KeyError(".".join(path[: k + 1]))
        shape = known[step]
    return shape


def guarded(axis: str, values: tuple, *shapes):
    return When(Guard(axis, values), both(*shapes), True)


def listed(value) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]
