"""Projections and mutations of typed rows as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.errors import RecordError, UnsupportedPath
from ..lang.mutation import ADD, REMOVE, SET, Action
from ..lang.paths import CHILD, DEEP, ELEMENT, MEMBER, Wild
from ..lang.projection import Projection
from ..records.reader import quick
from .columns import _number_literal


def project(df: DataFrame, projection: Projection) -> DataFrame:
    """The selected values, nested as in the rows, keys sorted; rows that have none of them go."""
    columns, seen = _built([(p, _at(df, p)) for p in projection.paths], 0), []
    for p in projection.paths:
        col, _ = _at(df, p)
        if col is not None:
            seen.append(col.isNotNull())
    if not seen:
        return df.select(F.lit(None).alias("_")).where(F.lit(False)).drop("_")
    any_found = seen[0]
    for s in seen[1:]:
        any_found = any_found | s
    return df.where(any_found).select(*[c.alias(n) for n, c in columns])


def _at(df: DataFrame, path) -> tuple[Column | None, T.DataType | None]:
    col, kind = None, df.schema
    for step in path:
        if isinstance(kind, T.StructType):
            if step not in kind.names:
                return None, None
            col = F.col(f"`{step}`") if col is None else col.getField(str(step))
            kind = kind[str(step)].dataType
        elif isinstance(kind, T.ArrayType) and step.index is not None:
            col, kind = F.get(col, F.lit(step.index)), kind.elementType
        elif isinstance(kind, T.MapType):
            col, kind = F.try_element_at(col, F.lit(str(step))), kind.valueType
        else:
            return None, None
    return col, kind


def _built(found: list, depth: int) -> list[tuple[str, Column]]:
    """(name, column) of each member under one value, in key order."""
    groups: dict = {}
    for path, at in found:
        if at[0] is not None:
            groups.setdefault(path[depth], []).append((path, at))
    out = []
    for key in sorted(groups, key=str.encode):
        inner = groups[key]
        if len(inner[0][0]) == depth + 1:
            out.append((str(key), inner[0][1][0]))
            continue
        steps = {p[depth + 1] for p, _ in inner}
        present = None
        for _, (c, _) in inner:
            present = c.isNotNull() if present is None else present | c.isNotNull()
        members = _built(inner, depth + 1)
        if all(s.index is not None for s in steps):
            if len(members) != len(steps):
                raise RecordError("elements and members are selected under one value")
            size = 1 + max(s.index for s in steps)
            at = {int(n): c for n, c in members}
            value = F.array(*[at.get(i, F.lit(None)) for i in range(size)])
        else:
            value = F.struct(*[c.alias(n) for n, c in members])
        out.append((str(key), F.when(present, value)))
    return out


def mutate(df: DataFrame, actions: list[Action], when: Column | None = None) -> DataFrame:
    """Rows with the actions applied in order, where ``when`` holds.

    A typed column keeps its type. What would need another one is refused here and belongs to the text
    path: a set of another type or of a number that the type cannot hold, a fractional step of a whole-number column, a
    step or a number finer than a decimal column's scale, and, under a condition, members that come or go.
    """
    for a in actions:
        df = _one(df, a, when)
    return df


def _one(df: DataFrame, a: Action, when: Column | None) -> DataFrame:
    head, rest = a.path[0], a.path[1:]
    if isinstance(head, Wild):
        if head == ELEMENT:
            return df
        if head == DEEP:
            raise UnsupportedPath("recursive changes need the text path")
        names = list(df.columns)
    else:
        names = [str(head)]
    for name in names:
        if a.kind == REMOVE and not rest:
            if when is not None:
                raise UnsupportedPath("a column cannot go from some rows only")
            df = df.drop(name)
            continue
        if name in df.columns:
            kind = df.schema[name].dataType
            new = _changed(F.col(f"`{name}`"), kind, rest, a)
            if when is not None and df.select(new.alias("_")).schema["_"].dataType.simpleString() != kind.simpleString():
                raise UnsupportedPath("members cannot come or go in some rows only")
            same = new if when is None else F.when(when, new).otherwise(F.col(f"`{name}`"))
            df = df.withColumn(name, same)
        elif a.kind != REMOVE and not a.wild:
            new = _fresh(rest, a)
            df = df.withColumn(name, new if when is None else F.when(when, new))
    return df


def _held(number: str, kind: T.DataType) -> Column:
    """The number as a value of the column's type, if that can hold it."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.lit(float(number)).cast(kind)
    literal, off = _number_literal(number, kind)
    if literal is None or off:
        raise UnsupportedPath(f"a column of type {kind.simpleString()} cannot hold {number}")
    return literal


def _value(a: Action) -> Column:
    found = quick(a.value)
    if isinstance(found, (bool, type(None))) or type(found) is str:
        return F.lit(found)
    number = str(found)
    return F.lit(int(number)) if number.lstrip("-").isdigit() else F.lit(float(number))


def _fresh(path, a: Action) -> Column:
    value = _value(a) if a.kind == SET else F.lit(a.delta)
    for step in reversed(path):
        value = F.struct(value.alias(str(step)))
    return value


def _typed(value: Column, a: Action, kind: T.DataType) -> Column:
    found = quick(a.value)
    fits = (
        found is None
        or isinstance(found, bool) and isinstance(kind, T.BooleanType)
        or type(found) is str and isinstance(kind, T.StringType)
        or not isinstance(found, bool) and type(found) is not str and isinstance(kind, T.NumericType)
    )
    if not fits:
        raise UnsupportedPath("a set of another type needs the text path")
    if isinstance(kind, T.NumericType) and found is not None:
        return _held(str(found), kind)
    return value.cast(kind)


def _end(col: Column, kind: T.DataType, a: Action) -> Column:
    if a.kind == SET:
        return _typed(_value(a), a, kind)
    if not isinstance(kind, T.NumericType):
        raise RecordError("a step needs a number")
    step = _held(repr(a.delta), kind)
    # steps are sums of doubles, as in the text path
    return F.coalesce((col.cast("double") + F.lit(a.delta)).cast(kind), step)


def _changed(col: Column, kind: T.DataType, path, a: Action) -> Column:
    """The column with the rest of the path applied inside it."""
    if not path:
        return _end(col, kind, a)
    step, rest = path[0], path[1:]
    if isinstance(step, Wild):
        if step == DEEP:
            raise UnsupportedPath("recursive changes need the text path")
        if isinstance(kind, T.ArrayType) and step in (ELEMENT, CHILD):
            if a.kind == REMOVE and not rest:
                return F.transform(col, lambda x: F.lit(None).cast(kind.elementType))
            return F.transform(col, lambda x: F.when(x.isNotNull(), _changed(x, kind.elementType, rest, a)))
        if isinstance(kind, T.MapType) and step in (MEMBER, CHILD):
            if a.kind == REMOVE and not rest:
                return F.map_filter(col, lambda k, v: F.lit(False))
            return F.transform_values(col, lambda k, v: _changed(v, kind.valueType, rest, a))
        if isinstance(kind, T.StructType) and step in (MEMBER, CHILD):
            for f in kind.fields:
                col = _member(col, f.name, f.dataType, rest, a)
            return col
        return col
    if isinstance(kind, T.StructType):
        if step in kind.names:
            return _member(col, str(step), kind[str(step)].dataType, rest, a)
        return col if a.kind == REMOVE or a.wild else col.withField(f"`{step}`", _fresh(rest, a))
    if isinstance(kind, T.ArrayType) and step.index is not None and (a.kind == REMOVE or a.wild):
        if a.kind == REMOVE and not rest:
            return F.transform(col, lambda x, i: F.when(i != step.index, x))
        return F.transform(col, lambda x, i: F.when(i == step.index, _changed(x, kind.elementType, rest, a)).otherwise(x))
    if isinstance(kind, T.MapType):
        if a.kind == REMOVE and not rest:
            return F.map_filter(col, lambda k, v: k != str(step))
        if a.kind != REMOVE and not rest:
            kept = F.map_filter(col, lambda k, v: k != str(step))
            return F.map_concat(kept, F.create_map(F.lit(str(step)), _end(F.try_element_at(col, F.lit(str(step))), kind.valueType, a)))
        return F.transform_values(col, lambda k, v: F.when(k == str(step), _changed(v, kind.valueType, rest, a)).otherwise(v))
    if a.kind == REMOVE or a.wild:
        return col
    raise UnsupportedPath("a change of a column's type needs the text path")


def _member(col: Column, name: str, kind: T.DataType, rest, a: Action) -> Column:
    if a.kind == REMOVE and not rest:
        return col.dropFields(f"`{name}`")
    return col.withField(f"`{name}`", _changed(col.getField(name), kind, rest, a))
