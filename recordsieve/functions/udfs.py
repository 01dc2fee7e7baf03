"""The language as column functions, in Python and in SQL."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..records import reader
from ..records.program import program


def matches(col, where: str, **how) -> Column:
    """Whether each JSON record of the column matches."""
    request = program(where, **how)

    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        one = request.runner()
        return values.map(lambda v: None if v is None else one(v)[0])

    return run(col)


def transformed(col, where: str = "", fields: list[str] = (), mutations=(), **how) -> Column:
    """The line that a request writes for each JSON record of the column, else null."""
    request = program(where, fields=fields, mutations=mutations, **how)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        one = request.runner()
        return values.map(lambda v: None if v is None else one(v)[1])

    return run(col)


@lru_cache(64)
def _runner(kind: str, text: str):
    """A worker parses each distinct text once."""
    if kind == "matches":
        return program(text).runner()
    return program("", fields=text.split("\n")).runner() if kind == "project" else program("", mutations=text).runner()


def _each(kind: str, part: int, values: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or t is None else _runner(kind, t)(v)[part] for v, t in zip(values, texts, strict=True)], dtype=object)


@F.udtf(returnType="record_index int, value string")
class RecordFrames:
    """The strict records of a text, which may fill several lines each."""

    def eval(self, text: str):
        if text is not None:
            yield from enumerate(reader.frames(text))


def register(spark: SparkSession) -> None:
    """SQL functions record_matches(value, selector), record_project(value, paths), record_mutate(value, mutations), and the table function record_frames(text)."""
    spark.udtf.register("record_frames", RecordFrames)

    @F.pandas_udf("boolean")
    def record_matches(values: pd.Series, texts: pd.Series) -> pd.Series:
        return _each("matches", 0, values, texts)

    @F.pandas_udf("string")
    def record_project(values: pd.Series, texts: pd.Series) -> pd.Series:
        return _each("project", 1, values, texts)

    @F.pandas_udf("string")
    def record_mutate(values: pd.Series, texts: pd.Series) -> pd.Series:
        return _each("mutate", 1, values, texts)

    for name, f in (("record_matches", record_matches), ("record_project", record_project), ("record_mutate", record_mutate)):
        spark.udf.register(name, f)
