"""Shapes and queries as DataFrame plans: predicates on columns, semi-joins along references, late projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.plans import shapes as sh
from facetry.plans.shapes import And, Clazz, Field, Guard, Lang, Link, Localized, Or, Value, Values, When
from facetry.sources.catalog import Catalog, Reference

#: Items of a page unless a query asks for fewer.
PAGE = 100


def conjunction(shape) -> list:
    return list(shape.shapes) if isinstance(shape, And) else [] if shape is True else [shape]


def joined_by(parts: list[Column], shape) -> Column:
    return reduce((lambda a, b: a | b) if isinstance(shape, Or) else (lambda a, b: a & b), parts)


def on_column(shape, column: Column, lang: Column | None = None) -> Column | None:
    """A shape of a single value as a predicate; None if it has steps. ``lang`` is the language of a text."""
    if shape is True or shape is False:
        return F.lit(shape)
    if isinstance(shape, Guard):
        raise ValueError(f"a guard of {shape.axis} that isn't settled: redact the shape first")
    if isinstance(shape, Value):
        return shape.test(column)
    if isinstance(shape, Lang):
        if lang is None:
            raise ValueError("a value without a language")
        return lang.isin(*shape.tags) if shape.tags else lang.isNotNull()
    if isinstance(shape, Localized):
        return F.lit(True)
    if isinstance(shape, Values):
        parts = [F.lit(True)]
        if shape.least is not None:
            parts.append(column.isNotNull() if shape.least == 1 else F.lit(shape.least < 1))
        if shape.most is not None and shape.most < 1:
            parts.append(column.isNull())
        if shape.all:
            parts.append(column == F.lit(shape.all[0]) if len(set(shape.all)) == 1 else F.lit(False))
        if shape.any:
            parts.append(column.isin(*shape.any))
        if shape.every:
            parts.append(F.coalesce(shape.every.test(column), F.lit(True)))
        return joined_by(parts, True)
    if isinstance(shape, (And, Or, When)):
        parts = [on_column(s, column, lang) for s in ((shape.test, shape.then, shape.other) if isinstance(shape, When) else shape.shapes)]
        if any(p is None for p in parts):
            return None
        return F.when(parts[0], parts[1]).otherwise(parts[2]) if isinstance(shape, When) else joined_by(parts, shape)
    return None


def is_name(shape) -> bool:
    """Whether a shape asks no more of an item than that it has a name."""
    return isinstance(shape, Value) and shape.kind == "datatype" and shape.args[0] in ("iri", "resource", "any")


def language(entity, label: str) -> Column | None:
    return F.col(entity.langs[label]) if label in entity.langs else None


def own_test(catalog: Catalog, name: str, shape) -> Column | None:
    """A shape that looks at an entity's own columns only, as one predicate; None if it follows a reference."""
    entity = catalog[name]
    if shape is True or shape is False:
        return F.lit(shape)
    if isinstance(shape, Clazz):
        return F.col(entity.kind).isin(*below(catalog.classes, shape.name))
    if is_name(shape):
        return F.lit(True)
    if isinstance(shape, (Value, Values, Guard)):
        return on_column(shape, F.col(entity.key))
    if isinstance(shape, Field):
        step = entity.fields[shape.name]
        return on_column(shape.shape, F.col(step), language(entity, shape.name)) if isinstance(step, str) else None
    if isinstance(shape, (And, Or, When)):
        parts = [own_test(catalog, name, x) for x in (shape.shapes if isinstance(shape, (And, Or)) else (shape.test, shape.then, shape.other))]
        if any(p is None for p in parts):
            return None
        return F.when(parts[0], parts[1]).otherwise(parts[2]) if isinstance(shape, When) else joined_by(parts, shape)
    return None


def rooted(catalog: Catalog, name: str, shape):
    """A shape whose fields are an entity's own: fields of a principal, and links, become steps to it. Those of one principal merge, so that an alias costs one join wherever it stands."""
    if isinstance(shape, Link):
        return Field(shape.name, rooted(catalog, catalog[name].fields[shape.name].entity, shape.shape))
    if isinstance(shape, Field):
        *hops, label = catalog.steps(name, shape.name)
        for hop in hops:
            name = catalog[name].fields[hop].entity
        step = catalog[name].fields[label]
        out = Field(label, rooted(catalog, step.entity, shape.shape) if isinstance(step, Reference) else shape.shape)
        for hop in reversed(hops):
            out = Field(hop, out)
        return out
    if isinstance(shape, (And, Or)):
        return (sh.both if isinstance(shape, And) else sh.either)(*(rooted(catalog, name, x) for x in shape.shapes))
    if isinstance(shape, When):
        return sh.conditional(*(rooted(catalog, name, x) for x in (shape.test, shape.then, shape.other)))
    return shape


def below(classes: list[tuple[str, str]], clazz: str) -> list[str]:
    """A class and all below it, by the catalog's pairs, which the driver holds."""
    found, todo = {clazz}, [clazz]
    under: dict[str, list[str]] = {}
    for a, b in classes:
        under.setdefault(b, []).append(a)
    while todo:
        fresh = [c for c in under.get(todo.pop(), []) if c not in found]
        found.update(fresh)
        todo += fresh
    return sorted(found)


def members(catalog: Catalog, name: str, clazz: str, rows: DataFrame) -> DataFrame:
    """The rows of a class or of one below it: a filter that reaches the scan."""
    return rows.where(F.col(catalog[name].kind).isin(*below(catalog.classes, clazz)))


def selected(catalog: Catalog, name: str, shape, rows: DataFrame | None = None) -> DataFrame:
    """An entity's rows that a shape selects. Conditions on own columns are one filter, which reaches the scan; others are semi-joins."""
    return picked(catalog, name, rooted(catalog, name, shape), rows)


def picked(catalog: Catalog, name: str, shape, rows: DataFrame | None = None) -> DataFrame:
    entity = catalog[name]
    rows = catalog.rows(name) if rows is None else rows
    if shape is True:
        return rows
    if shape is False:
        return rows.where(F.lit(False))
    if isinstance(shape, Clazz):
        return members(catalog, name, shape.name, rows)
    if (test := own_test(catalog, name, shape)) is not None:
        return rows.where(test)
    if isinstance(shape, And):
        own = [s for s in shape.shapes if isinstance(s, Field) and isinstance(entity.fields[s.name], str)]
        for s in [*own, *(s for s in shape.shapes if s not in own)]:
            rows = picked(catalog, name, s, rows)
        return rows
    if isinstance(shape, Or):
        ids = reduce(DataFrame.union, (picked(catalog, name, s).select(entity.key) for s in shape.shapes))
        return rows.join(ids.distinct(), entity.key, "left_semi")
    if isinstance(shape, When):
        hit = picked(catalog, name, shape.test).select(entity.key)
        then = picked(catalog, name, shape.then, rows.join(hit, entity.key, "left_semi"))
        return then.unionByName(picked(catalog, name, shape.other, rows.join(hit, entity.key, "left_anti")))
    if not isinstance(shape, Field):
        raise ValueError(f"{shape!r} selects nothing by itself")
    step = entity.fields[shape.name]
    return rows.join(*reached(catalog, step, shape.shape), "left_semi") if not wants_set(shape.shape) else by_set(catalog, name, rows, shape)


def reached(catalog: Catalog, step: Reference, shape):
    """The other side of a semi-join along a reference, and its condition."""
    found = picked(catalog, step.entity, shape)
    if step.inverse:
        return found.select(F.col(step.column).alias("_to")), F.col(catalog_key(catalog, step)) == F.col("_to")
    return found.select(F.col(catalog[step.entity].key).alias("_to")), F.col(step.column) == F.col("_to")


def catalog_key(catalog: Catalog, step: Reference) -> str:
    owner = next(e for e in catalog.entities.values() for f in e.fields.values() if f is step or f == step)
    return owner.key


def wants_set(shape) -> bool:
    """Whether a shape below a step looks at all values together."""
    sets = lambda x: isinstance(x, Localized) or isinstance(x, Values) and (x.all or x.every)
    return any(isinstance(s, Values) or isinstance(s, Field) and any(map(sets, conjunction(s.shape))) for s in conjunction(shape))


def by_set(catalog: Catalog, name: str, rows: DataFrame, shape: Field) -> DataFrame:
    """Counts, division, ranges and languages over the values that a reference reaches: sums by root, pre-aggregated, then a semi- or anti-join."""
    entity, step = catalog[name], catalog[name].fields[shape.name]
    far = catalog[step.entity]
    root = step.column if step.inverse else far.key
    own = entity.key if step.inverse else step.column
    table = catalog.rows(step.entity)

    def join(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
        return rows.join(found.select(F.col(root).alias("_to")), F.col(own) == F.col("_to"), how)

    for s in conjunction(shape.shape):
        plain = isinstance(s, Field) and isinstance(far.fields[s.name], str)
        column = F.col(far.fields[s.name]) if plain else F.col(far.key)
        sets = [x for x in (conjunction(s.shape) if plain else [s]) if isinstance(x, (Values, Localized))]
        rest = sh.both(*(x for x in conjunction(s.shape) if x not in sets)) if plain else True if sets else s
        if rest is not True:
            rows = rows.join(*reached(catalog, step, Field(s.name, rest) if plain else rest), "left_semi")
        for values in sets:
            if isinstance(values, Localized):
                texts = table.where(column.isNotNull()).groupBy(root, language(far, s.name).alias("_lang")).agg(F.countDistinct(column).alias("_n"))
                rows = join(rows, texts.where("_n > 1"), "left_anti")
                continue
            if values.all:
                hit = table.where(column.isin(*values.all)).select(root, column.alias("_v")).distinct().groupBy(root).count()
                rows = join(rows, hit.where(F.col("count") == len(set(values.all))), "left_semi")
            if values.any:
                rows = join(rows, table.where(column.isin(*values.any)), "left_semi")
            if values.every:
                rows = join(rows, table.where(~values.every.test(column)), "left_anti")
            if values.least is not None or values.most is not None:
                sized = table.where(column.isNotNull()).groupBy(root).agg(F.countDistinct(column).alias("_n"))
                if values.least:
                    rows = join(rows, sized.where(F.col("_n") >= values.least), "left_semi")
                if values.most is not None:
                    rows = join(rows, sized.where(F.col("_n") > values.most), "left_anti")
    return rows


def followed(catalog: Catalog, name: str, path: str, rows: DataFrame, outer: bool = True) -> tuple[DataFrame, Column]:
    """Rows joined along a dotted path, and the column at its end; missing values stay unless ``outer`` is false."""
    entity, how = catalog[name], "left" if outer else "inner"
    out, prefix = rows, ""
    steps = catalog.along(name, path)
    at = F.col(entity.key)
    for k, label in enumerate(steps):
        step = entity.fields[label]
        if isinstance(step, str):
            if k < len(steps) - 1:
                raise KeyError(f"{label} has no fields")
            return out, F.col(prefix + step)
        here, prefix = prefix, f"{prefix}{label}__"
        far = catalog.rows(step.entity)
        far = far.select(*(F.col(c).alias(prefix + c) for c in far.columns))
        left, right = (here + entity.key, prefix + step.column) if step.inverse else (here + step.column, prefix + catalog[step.entity].key)
        if prefix + catalog[step.entity].key not in out.columns:  # paths that begin alike share their joins
            out = out.join(far, F.col(left) == F.col(right), how)
        entity = catalog[step.entity]
        at = F.col(prefix + entity.key)
    return out, at


def items(catalog: Catalog, name: str, shape=True, project: dict[str, str] | None = None, orders=(), offset: int = 0, limit: int = 0, page: int = PAGE) -> DataFrame:
    """Selected items, ordered, sliced, then projected.

    Orders are (path, descending) pairs; missing values come first rising and last falling; of several values the first in
    order counts; the key breaks ties. A limit of 0 or above the page is the page. What projects is joined only to the slice.
    """
    key = catalog[name].key
    rows = selected(catalog, name, shape)
    sorts: list[Column] = []
    keys = rows
    for k, (path, down) in enumerate(orders):
        joined, at = followed(catalog, name, path, rows)
        best = joined.groupBy(key).agg((F.max if down else F.min)(at).alias(f"_o{k}"))
        single = "." not in path and isinstance(catalog[name].fields.get(path), str)
        keys = keys.withColumn(f"_o{k}", F.col(catalog[name].fields[path])) if single else keys.join(best, key)
        sorts.append(F.col(f"_o{k}").desc_nulls_last() if down else F.col(f"_o{k}").asc_nulls_first())
    sliced = keys.orderBy(*sorts, key).offset(offset).limit(min(limit or page, page))
    out = sliced
    columns = []
    for label, path in (project or {}).items():
        out, at = followed(catalog, name, path, out)
        columns.append(at.alias(label))
    return out.select(F.col(key).alias("id"), *columns)


def terms(catalog: Catalog, name: str, path: str, shape=True, offset: int = 0, limit: int = 0) -> DataFrame:
    """Values at the end of a path and how many selected items reach each: most first, then by value."""
    key = catalog[name].key
    joined, at = followed(catalog, name, path, selected(catalog, name, shape), outer=False)
    out = joined.where(at.isNotNull()).groupBy(at.alias("value")).agg(F.countDistinct(key).alias("count"))
    return sliced(out, [F.desc("count"), F.asc("value")], offset, limit)


def stats(catalog: Catalog, name: str, path: str, shape=True) -> DataFrame:
    """Count, least and greatest of the values at the end of a path; rows count as often as they are reached, and none gives 0."""
    joined, at = followed(catalog, name, path, selected(catalog, name, shape), outer=False)
    return joined.agg(F.count(at).alias("count"), F.min(at).alias("min"), F.max(at).alias("max"))


def sliced(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    if not offset and not limit:
        return rows
    rows = rows.orderBy(*order).offset(offset)
    return rows.limit(limit) if limit else rows


def items_grouped(catalog: Catalog, name: str, shape=True, project: dict[str, str] | None = None, orders=(), offset: int = 0, limit: int = 0) -> DataFrame:
    """A row for each item, with its ``position`` and, for each projected path, the sorted set of its values: several paths don't multiply."""
    key = catalog[name].key
    page = items(catalog, name, shape, {}, orders, offset, limit)
    page = page.coalesce(1).withColumn("position", F.monotonically_increasing_id())  # a page at most
    roots = catalog.rows(name).join(F.broadcast(page.select(F.col("id").alias("_id"))), F.col(key) == F.col("_id"), "left_semi")
    out = page
    for label, path in (project or {}).items():
        joined, at = followed(catalog, name, path, roots, outer=False)
        values = joined.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_set(at)).alias(label))
        out = out.join(values, "id", "left")
    return out


def labelled_terms(catalog: Catalog, name: str, path: str, shape=True, offset: int = 0, limit: int = 0) -> DataFrame:
    """Terms of a path with the label of each value that is an entity, which is joined to the slice; null for other values."""
    out, entity = terms(catalog, name, path, shape, offset, limit), catalog[name]
    for step in catalog.along(name, path):
        found = entity.fields[step] if entity else None
        entity = catalog[found.entity] if isinstance(found, Reference) else None
    label = entity and next((entity.fields[f] for f in ("label", "name") if isinstance(entity.fields.get(f), str)), None)
    if not label:
        return out.withColumn("label", F.lit(None).cast("string"))
    return out.join(catalog.rows(entity.name).select(F.col(entity.key).alias("value"), F.col(label).alias("label")), "value", "left").select("value", "count", "label")


def typed_stats(values: DataFrame, value: str, kind: str, offset: int = 0, limit: int = 0) -> DataFrame:
    """Count, least and greatest of the values of each kind, the most frequent kind first, then by name."""
    return sliced(values.groupBy(F.col(kind).alias("type")).agg(F.count("*").alias("count"), F.min(value).alias("min"), F.max(value).alias("max")), [F.desc("count"), F.asc("type")], offset, limit)


def alternatives(catalog: Catalog, name: str, paths: list[str], value: str = "value") -> DataFrame:
    """``id`` and the values that any of the paths reaches, as often as they are reached."""
    key, parts = catalog[name].key, []
    for path in paths:
        joined, at = followed(catalog, name, path, catalog.rows(name), outer=False)
        parts.append(joined.select(F.col(key).alias("id"), at.alias(value)).where(F.col(value).isNotNull()))
    return reduce(DataFrame.union, parts)


def violations(catalog: Catalog, name: str, shape) -> DataFrame:
    """A row (``focus``, ``path``, ``rule``) for each test that an item fails, nested ones included. Missing values fail no test of a value, patterns match whole texts; of alternatives one must hold.

    Tests of own columns are one pass over a table; a step adds a join and one pass over the table that it leads to.
    """
    return broken(catalog, name, rooted(catalog, name, shape), catalog.rows(name))


def told(rows: DataFrame, key: str, path: str, rule: str) -> DataFrame:
    return rows.select(F.col(key).alias("focus"), F.lit(path).alias("path"), F.lit(rule).alias("rule"))


def broken(catalog: Catalog, name: str, shape, rows: DataFrame) -> DataFrame:
    entity, tests, out = catalog[name], [], []
    key = entity.key

    def test(path: str, rule: str, valid: Column) -> None:
        tests.append(F.when(~valid, F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule"))))

    for part in conjunction(shape):
        step = entity.fields[part.name] if isinstance(part, Field) else None
        if isinstance(step, str):
            for x in conjunction(part.shape):
                test(part.name, rule_of(x), valid_column(x, F.col(step), language(entity, part.name)))
        elif step is not None:
            out += broken_step(catalog, name, part, rows)
        elif isinstance(part, When):
            if (known := told_test(catalog, name, part.test, rows)) is not None:
                some, known = known
                branches = [(x, t) for x, t in ((part.then, known), (part.other, ~known)) if x is not True]
                if all(own_parts(catalog, name, x) for x, _ in branches):  # one pass for both
                    found = [F.when(t & ~valid, F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule"))) for x, t in branches for path, rule, valid in own_parts(catalog, name, x)]
                    out += [exploded(some, key, found)] if found else []
                else:
                    out += [broken(catalog, name, x, some.where(t).select(rows.columns)) for x, t in branches]
            else:
                fails = broken(catalog, name, part.test, rows).select(F.col("focus").alias("_no")).distinct()
                for x, how in ((part.then, "left_anti"), (part.other, "left_semi")):
                    if x is not True:
                        out.append(broken(catalog, name, x, rows.join(fails, F.col(key) == F.col("_no"), how)))
        elif (known := valid_test(catalog, name, part)) is not None:
            test("", rule_of(part), known)
        else:  # alternatives, some of which follow references: those that fail all
            fails = [broken(catalog, name, x, rows).select("focus").distinct() for x in part.shapes]
            every = reduce(DataFrame.union, fails).groupBy("focus").count().where(F.col("count") == len(fails))
            out.append(told(every, "focus", "", rule_of(part)))
    if tests:
        out.insert(0, exploded(rows, key, tests))
    return reduce(DataFrame.union, out) if out else told(rows.limit(0), key, "", "")


def exploded(rows: DataFrame, key: str, tests: list[Column]) -> DataFrame:
    found = F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("x")
    return rows.select(F.col(key).alias("focus"), found).select("focus", "x.path", "x.rule")


def own_parts(catalog: Catalog, name: str, shape) -> list[tuple[str, str, Column]] | None:
    """The tests (path, rule, whether it holds) of a shape whose parts are fields in an entity's own columns; None for others."""
    entity, out = catalog[name], []
    for part in conjunction(shape):
        step = entity.fields[part.name] if isinstance(part, Field) else None
        if not isinstance(step, str):
            return None
        out += [(part.name, rule_of(x), valid_column(x, F.col(step), language(entity, part.name))) for x in conjunction(part.shape)]
    return out


def told_test(catalog: Catalog, name: str, shape, rows: DataFrame) -> tuple[DataFrame, Column] | None:
    """Rows and, as a column, whether each passes a shape of own columns and of single items that references lead to; None for other shapes.

    What fails is gathered among the items referred to, of which there are fewer, and joined to the rows by the reference.
    """
    if (known := valid_test(catalog, name, shape)) is not None:
        return rows, known
    if isinstance(shape, (And, Or)):
        found = []
        for x in shape.shapes:
            if (one := told_test(catalog, name, x, rows)) is None:
                return None
            rows, passes = one
            found.append(passes)
        return rows, joined_by(found, shape)
    step = catalog[name].fields[shape.name] if isinstance(shape, Field) else None
    if not isinstance(step, Reference) or step.inverse or any(isinstance(x, Values) for x in conjunction(shape.shape)):
        return None
    k = sum(c.startswith("_fails") for c in rows.columns)
    fails = broken(catalog, step.entity, shape.shape, catalog.rows(step.entity)).select(F.col("focus").alias(f"_fails{k}")).distinct()
    return rows.join(fails, F.col(step.column) == F.col(f"_fails{k}"), "left"), F.col(f"_fails{k}").isNull()


def broken_step(catalog: Catalog, name: str, part: Field, rows: DataFrame) -> list[DataFrame]:
    """What fails along a reference: the set of what it leads to, and each of these."""
    entity, step = catalog[name], catalog[name].fields[part.name]
    far, key = catalog[step.entity], entity.key
    if step.inverse:
        pairs = catalog.rows(step.entity).select(F.col(step.column).alias("_from"), F.col(far.key).alias("_to")).dropna()
    else:
        pairs = rows.select(F.col(key).alias("_from"), F.col(step.column).alias("_to")).dropna()
    out, rest = [], []
    for x in conjunction(part.shape):
        if not isinstance(x, Values):
            rest.append(x)
            continue
        value, same = F.col("_to"), F.col(key) == F.col("_from")
        if x.least is not None or x.most is not None:
            sized = rows.join(pairs.groupBy("_from").agg(F.countDistinct("_to").alias("_n")), same, "left")
            n = F.coalesce("_n", F.lit(0))
            out.append(told(sized.where((n < x.least if x.least is not None else F.lit(False)) | (n > x.most if x.most is not None else F.lit(False))), key, part.name, x.rule))
        if x.all:
            hit = pairs.where(value.isin(*x.all)).groupBy("_from").agg(F.countDistinct("_to").alias("_n")).where(F.col("_n") == len(set(x.all)))
            out.append(told(rows.join(hit, same, "left_anti"), key, part.name, x.rule))
        if x.any:
            out.append(told(rows.join(pairs.where(value.isin(*x.any)), same, "left_anti"), key, part.name, x.rule))
        if x.every:
            out.append(told(rows.join(pairs.where(~x.every.test(value, True)), same, "left_semi"), key, part.name, x.rule))
    if rest:
        below = broken(catalog, step.entity, sh.both(*rest), catalog.rows(step.entity)).withColumnRenamed("focus", "_far")
        mine = rows.select(F.col(key).alias("focus")).join(pairs, F.col("focus") == F.col("_from"))
        path = F.when(F.col("path") == "", part.name).otherwise(F.concat(F.lit(f"{part.name}."), "path")).alias("path")
        out.append(mine.join(below, F.col("_to") == F.col("_far")).select("focus", path, "rule"))
    return out


def rule_of(shape) -> str:
    return {Or: "or", When: "when", And: "and", bool: "none"}.get(type(shape)) or shape.rule


def valid_column(shape, c: Column, lang: Column | None = None) -> Column:
    """Whether a column's value, a set of one or none, passes a shape."""
    if isinstance(shape, bool):
        return F.lit(shape)
    if isinstance(shape, Value):
        return F.coalesce(shape.test(c, True), F.lit(True))
    if isinstance(shape, Values):
        out = F.lit(True)
        if shape.least is not None:
            out = out & (c.isNotNull().cast("int") >= shape.least)
        if shape.most is not None:
            out = out & (c.isNotNull().cast("int") <= shape.most)
        if shape.all:
            out = out & (F.coalesce(c == F.lit(shape.all[0]), F.lit(False)) if len(set(shape.all)) == 1 else F.lit(False))
        if shape.any:
            out = out & F.coalesce(c.isin(*shape.any), F.lit(False))
        return out & F.coalesce(shape.every.test(c, True), F.lit(True)) if shape.every else out
    if isinstance(shape, (And, Or)):
        return joined_by([valid_column(x, c, lang) for x in shape.shapes], shape)
    if isinstance(shape, When):
        return F.when(valid_column(shape.test, c, lang), valid_column(shape.then, c, lang)).otherwise(valid_column(shape.other, c, lang))
    if isinstance(shape, Lang):
        return c.isNull() | F.coalesce(on_column(shape, c, lang), F.lit(False))
    if isinstance(shape, Localized):
        return F.lit(True)
    return on_column(shape, c, lang) if isinstance(shape, Guard) else F.lit(False)  # a value without fields


def valid_test(catalog: Catalog, name: str, shape) -> Column | None:
    """Whether an item passes a shape of its own columns; None if it follows a reference."""
    entity = catalog[name]
    if isinstance(shape, Field):
        step = entity.fields[shape.name]
        return valid_column(shape.shape, F.col(step), language(entity, shape.name)) if isinstance(step, str) else None
    if isinstance(shape, Clazz):
        return F.coalesce(own_test(catalog, name, shape), F.lit(False))
    if isinstance(shape, (And, Or, When)):
        parts = [valid_test(catalog, name, x) for x in ((shape.test, shape.then, shape.other) if isinstance(shape, When) else shape.shapes)]
        if any(p is None for p in parts):
            return None
        return F.when(parts[0], parts[1]).otherwise(parts[2]) if isinstance(shape, When) else joined_by(parts, shape)
    return F.lit(True) if is_name(shape) else valid_column(shape, F.col(entity.key))


def conveyed(catalog: Catalog, name: str, shape) -> tuple[DataFrame, dict]:
    """The items that a shape's filters select, and the tree of the fields that it conveys, as ``jsonld.encoded`` takes it."""
    def tree(x) -> dict:
        return {k: tree(v) or None for k, v in sh.fields_of(x).items()}

    rows = selected(catalog, name, sh.pruned(shape, "filter"))
    return rows, tree(sh.pruned(shape, "convey"))


def outlines(rows: DataFrame, key: str, prefix: str, shape) -> DataFrame:
    """``s``, ``p``, ``o``: the statements that a shape makes of each item, whose name is the prefix and its key."""
    name = F.concat(F.lit(prefix), F.col(key).cast("string"))
    term = lambda v: F.concat(name, F.lit(v.path)) if isinstance(v, sh.Focus) else F.lit(v).cast("string")
    found = [F.struct(*(term(v).alias(k) for k, v in zip("spo", t, strict=True))) for t in sh.outlined(shape, sh.Focus())]
    if not found:
        return rows.limit(0).select(*(name.alias(k) for k in "spo"))
    return rows.select(F.explode(F.array(*found)).alias("x")).select("x.*").distinct()
