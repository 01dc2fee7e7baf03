"""Selectors as Catalyst expressions over typed columns.

SQL NULL is an absent path. Leaves stay plain comparisons, so scans see them as filters; only a
negation and the published boolean are made two-valued. Recursive segments are spread over the
schema, which is finite.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang import numbers, temporal
from ..lang.errors import UnsupportedPath
from ..lang.paths import CHILD, DEEP, ELEMENT, MEMBER, Wild
from ..lang.selector import Scalar, Selector
from ..lang.text import fold

_INTEGERS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
_NEVER = None


def _any(columns: list[Column | None]) -> Column | None:
    found = [c for c in columns if c is not None]
    return reduce(lambda a, b: a | b, found) if found else _NEVER


def _fields(col: Column, kind: T.StructType):
    return [(f.name, col.getField(f.name), f.dataType) for f in kind.fields]


def reach(col: Column, kind: T.DataType, path: tuple, leaf) -> Column | None:
    """OR of ``leaf(column, type)`` over what the path reaches from a column; None if the schema has nothing there."""
    if not path:
        return leaf(col, kind)
    step, rest = path[0], path[1:]
    if isinstance(step, Wild):
        if step == DEEP:
            return _any([reach(col, kind, rest, leaf), *_below(col, kind, path, leaf, True, True)])
        return _any(_below(col, kind, rest, leaf, step in (MEMBER, CHILD), step in (ELEMENT, CHILD)))
    if isinstance(kind, T.StructType):
        return _any([reach(c, t, rest, leaf) for n, c, t in _fields(col, kind) if n == step])
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return reach(F.try_element_at(col, F.lit(str(step))), kind.valueType, rest, leaf)
    if isinstance(kind, T.ArrayType) and step.index is not None:
        return reach(F.get(col, F.lit(step.index)), kind.elementType, rest, leaf)
    return _NEVER


def _below(col, kind, path, leaf, members: bool, elements: bool) -> list[Column | None]:
    """The path on from each child of a column."""
    if isinstance(kind, T.StructType) and members:
        return [reach(c, t, path, leaf) for _, c, t in _fields(col, kind)]
    if isinstance(kind, T.MapType) and members:
        return [_exists(F.map_values(col), kind.valueType, path, leaf)]
    if isinstance(kind, T.ArrayType) and elements:
        return [_exists(col, kind.elementType, path, leaf)]
    return []


def _exists(array: Column, kind: T.DataType, path, leaf) -> Column | None:
    if reach(F.lit(None).cast(kind), kind, path, leaf) is None:
        return _NEVER
    return F.exists(array, lambda x: F.coalesce(reach(x, kind, path, leaf), F.lit(False)))


# leaves


def _time_parts(col: Column, kind: T.DataType):
    """(seconds and nanoseconds, day as written, whether a bare date, whether a time) of a column, or None."""
    if isinstance(kind, T.StringType):
        text = F.trim(F.regexp_replace(col, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", ""))
        shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}:[0-5][0-9](\.[0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?)?$"
        day = F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))
        bare = F.length(text) == 10
        clock = F.try_to_timestamp(F.when(bare, F.concat(text, F.lit("T00:00:00"))).otherwise(F.substring(text, 1, 19)), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
        zone = F.regexp_extract(text, r"T.*([+-])(\d\d):(\d\d)$", 1)
        offset = F.coalesce(F.regexp_extract(text, r"T.*[+-](\d\d):\d\d$", 1).try_cast("int") * 3600 + F.regexp_extract(text, r"T.*[+-]\d\d:(\d\d)$", 1).try_cast("int") * 60, F.lit(0))
        seconds = F.unix_timestamp(clock) - F.when(zone == "-", -offset).otherwise(offset)
        nanos = F.coalesce(F.rpad(F.substring(F.regexp_extract(text, r"\.([0-9]+)", 1), 1, 9), 9, "0").try_cast("int"), F.lit(0))
        valid = text.rlike(shape) & (F.length(col) < temporal.MAX_TEXT) & day.isNotNull() & clock.isNotNull()
        return F.struct(seconds.alias("s"), nanos.alias("n")), F.substring(text, 1, 10), bare, valid
    if isinstance(kind, T.DateType):
        at = F.unix_date(col).cast("long") * 86400
        return F.struct(at.alias("s"), F.lit(0).alias("n")), col.cast("string"), F.lit(True), col.isNotNull()
    return None


def _timestamp(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType))


def _literal_time(t: temporal.Temporal, kind: T.DataType) -> Column | None:
    """The time as a literal of a timestamp column's type; None if it is finer than microseconds."""
    if t.nanos % 1000:
        return None
    year, *rest = temporal.civil(t.seconds)
    name, zone = ("TIMESTAMP_NTZ", "") if isinstance(kind, T.TimestampNTZType) else ("TIMESTAMP", "+00:00")
    written = f"{year:04d}" if 0 <= year <= 9999 else f"{year:+05d}"
    return F.expr("{} '{}-{:02d}-{:02d} {:02d}:{:02d}:{:02d}.{:06d}{}'".format(name, written, *rest, t.nanos // 1000, zone))


_COMPARE = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def _time_bound(col, kind, name, t: temporal.Temporal) -> Column | None:
    if _timestamp(kind):
        exact = _literal_time(t, kind)
        if exact is not None:
            return _COMPARE[name](col, exact)
        below = _literal_time(temporal.Temporal(t.seconds, t.nanos // 1000 * 1000, t.day, False), kind)
        return col > below if name in ("gt", "gte") else col <= below
    parts = _time_parts(col, kind)
    if parts is None:
        return _NEVER
    bound = F.struct(F.lit(t.seconds).cast("long").alias("s"), F.lit(t.nanos).alias("n"))
    return parts[3] & _COMPARE[name](parts[0], bound)


def _time_equal(col, kind, t: temporal.Temporal) -> Column | None:
    if _timestamp(kind):
        if t.date_only:
            start = _literal_time(temporal.Temporal(t.seconds, 0, t.day, False), kind)
            stop = _literal_time(temporal.Temporal(t.seconds + 86400, 0, t.day, False), kind)
            return (col >= start) & (col < stop)
        exact = _literal_time(t, kind)
        return F.lit(False) if exact is None else col == exact
    parts = _time_parts(col, kind)
    if parts is None:
        return _NEVER
    at, day, bare, valid = parts
    same_day = day == "{:04d}-{:02d}-{:02d}".format(*t.day)
    if t.date_only:
        return valid & same_day
    same = at == F.struct(F.lit(t.seconds).cast("long").alias("s"), F.lit(t.nanos).alias("n"))
    return valid & F.when(bare, same_day).otherwise(same)


#: Powers of ten beyond which every value of every column type lies on one side.
_FAR = 400


def _number_literal(text: str, kind: T.DataType) -> tuple[Column | None, int]:
    """The number as a literal of the column's type, and the sign of its distance from the exact number.

    The literal is the type's next value below where there is no equal one; floating columns count as
    the numbers that their shortest spelling names. None: every value of the type is on one side.
    """
    sign, exponent, _ = numbers.canonical(text)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        near = float(text)
        if isinstance(kind, T.FloatType):
            with np.errstate(over="ignore"):
                near = np.float32(near)
        if not np.isfinite(near):
            return None, -sign
        literal = F.lit(float(near))
        return literal.cast(kind) if isinstance(kind, T.FloatType) else literal, numbers.compare(str(near), text)
    if exponent > _FAR:
        return None, -sign
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    floor, exact = numbers.floor_at(text, scale)
    bits = _INTEGERS.get(type(kind))
    least, most = (-(1 << bits - 1), (1 << bits - 1) - 1) if bits else (1 - 10**kind.precision, 10**kind.precision - 1)
    if not least <= floor <= most:
        return None, -sign
    if bits:
        return F.lit(floor).cast(kind), 0 if exact else -1
    digits = f"{abs(floor):0{scale + 1}d}"
    point = len(digits) - scale
    value = f"{'-' * (floor < 0)}{digits[:point]}" + (f".{digits[point:]}" if scale else "")
    return F.lit(value).cast(kind), 0 if exact else -1


def _finite(col, kind, name: str) -> Column:
    """Infinities and NaN, which JSON spells as strings, are no numbers: keep them out of an open side."""
    most = F.lit(float(np.finfo(np.float32 if isinstance(kind, T.FloatType) else np.float64).max)).cast(kind)
    return col <= most if name in ("gt", "gte") else col >= -most


def _number_bound(col, kind, name: str, text: str) -> Column | None:
    if not isinstance(kind, T.NumericType):
        return _NEVER
    floating = isinstance(kind, (T.FloatType, T.DoubleType))
    literal, off = _number_literal(text, kind)
    if literal is None:  # beyond the type: every value is on one side
        if (name in ("gt", "gte")) != (off > 0):
            return F.lit(False)
        return _finite(col, kind, "gt") & _finite(col, kind, "lt") if floating else col.isNotNull()
    if off < 0:  # the literal is the next value below
        name = {"gte": "gt", "lt": "lte"}.get(name, name)
    elif off > 0:
        name = {"gt": "gte", "lte": "lt"}.get(name, name)
    bound = _COMPARE[name](col, literal)
    return bound & _finite(col, kind, name) if floating else bound


def _equal(col, kind, c: Scalar, timed: bool = True) -> Column | None:
    time = c.time if timed else None
    if time is not None:
        return _time_equal(col, kind, time)
    if c.kind == "string":
        return col == c.text if isinstance(kind, T.StringType) else _NEVER
    if c.kind == "number":
        if not isinstance(kind, T.NumericType):
            return _NEVER
        literal, off = _number_literal(c.text, kind)
        return F.lit(False) if literal is None or off else col == literal
    if c.kind == "bool":
        return col == F.lit(c.text == "true") if isinstance(kind, T.BooleanType) else _NEVER
    return _NEVER


def _member(col, kind, items: tuple[Scalar, ...]) -> Column | None:
    if isinstance(kind, T.StringType):
        texts = [c.text for c in items if c.kind == "string"]
        return col.isin(texts) if texts else _NEVER
    return _any([_equal(col, kind, c, timed=False) for c in items if c.kind != "string"])


def _as_text(col, kind) -> Column | None:
    if isinstance(kind, T.StringType):
        return col
    return col.cast("string") if isinstance(kind, (T.NumericType, T.BooleanType)) else None


def _needle(col, kind, name: str, needle: str) -> Column | None:
    text = _as_text(col, kind)
    if text is None:
        return _NEVER
    if name in ("icontains", "iprefix"):
        text, needle = F.lower(F.translate(text, "İΣ", "iσ")), fold(needle)
    return text.contains(needle) if name.endswith("contains") else text.startswith(needle)


def _leaf(s: Selector, now: datetime):
    def test(col: Column, kind: T.DataType) -> Column | None:
        if s.kind == "exists":
            return col.isNotNull()
        if s.kind == "eq":
            return _equal(col, kind, s.value if s.value is not None else Scalar("string", ""))
        if s.kind == "in":
            return _member(col, kind, s.any)
        if s.kind in ("range", "date"):
            parts = [_number_bound(col, kind, n, b.text) if b.kind == "number" else _time_bound(col, kind, n, temporal.parse(b.text)) for n, b in s.bounds]
            if s.since:
                parts.append(_time_bound(col, kind, "gte", temporal.since(s.since, now)))
            if s.kind == "date" and s.value is not None:
                parts.append(_equal(col, kind, s.value))
            return _NEVER if any(p is None for p in parts) else reduce(lambda a, b: a & b, parts)
        if s.any:
            return _any([_needle(col, kind, s.kind, c.text) for c in s.any])
        return col.isNotNull() if s.value is None else _needle(col, kind, s.kind, s.value.text)

    return test


def predicate(s: Selector, schema: T.StructType, now: datetime | None = None) -> Column:
    """A condition for ``DataFrame.where``: true exactly where the selector holds, else false or null."""
    now = now or datetime.now(timezone.utc)
    if s.kind == "all":
        return F.lit(True)
    if s.kind in ("and", "or"):
        parts = [predicate(c, schema, now) for c in s.children]
        if not parts:
            return F.lit(s.kind == "and")
        return reduce(lambda a, b: a & b if s.kind == "and" else a | b, parts)
    if s.kind == "not":
        return ~F.coalesce(predicate(s.children[0], schema, now), F.lit(False))
    path, leaf = s.segments, _leaf(s, now)
    first, rest = path[0], path[1:]
    tops = [(f.name, F.col(f"`{f.name}`"), f.dataType) for f in schema.fields]
    if isinstance(first, Wild):
        if first == ELEMENT:
            return F.lit(False)
        if first == DEEP:
            found = _any([reach(c, t, path, leaf) for _, c, t in tops] + ([reach(c, t, rest[1:], leaf) for n, c, t in tops if rest and n == rest[0]] if rest and not isinstance(rest[0], Wild) else []))
            if s.kind == "exists" and not rest:
                return F.lit(True)
            if rest and isinstance(rest[0], Wild) and rest[0] in (MEMBER, CHILD):
                found = _any([found, *[reach(c, t, rest[1:], leaf) for _, c, t in tops]])
        else:
            found = _any([reach(c, t, rest, leaf) for _, c, t in tops])
    else:
        found = _any([reach(c, t, rest, leaf) for n, c, t in tops if n == first])
    return F.lit(False) if found is None else found


def matched(s: Selector, schema: T.StructType, now: datetime | None = None) -> Column:
    """The selector as a boolean that is never null."""
    return F.coalesce(predicate(s, schema, now), F.lit(False))


def require_typed(path) -> None:
    if any(isinstance(p, Wild) for p in path):
        raise UnsupportedPath("wildcards need the text path here")
