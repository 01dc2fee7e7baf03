"""Operators over typed columns: everything is Catalyst expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lang import mutation, projection, selector
from ..lang.selector import Selector
from ..plans import columns, shapes


def _parsed(where: str | Selector, any_of: bool = False) -> Selector:
    return where if isinstance(where, Selector) else selector.parse(where, any_of)


def matched(df: DataFrame, where: str | Selector, any_of: bool = False, now: datetime | None = None) -> Column:
    """The selector's decision about each row, never null."""
    return columns.matched(_parsed(where, any_of), df.schema, now)


def where(df: DataFrame, expression: str | Selector, any_of: bool = False, now: datetime | None = None) -> DataFrame:
    """The rows that the selector matches."""
    s = _parsed(expression, any_of)
    return df if s.kind == "all" else df.where(columns.predicate(s, df.schema, now))


def decisions(df: DataFrame, expression: str | Selector, keys: list[str], **how) -> DataFrame:
    """The key columns and ``matched`` of every row."""
    return df.select(*keys, matched(df, expression, **how).alias("matched"))


def count(df: DataFrame, expression: str | Selector, **how) -> DataFrame:
    """One row: how many rows match."""
    return where(df, expression, **how).agg(F.count(F.lit(1)).alias("matches"))


def counters(df: DataFrame, expression: str | Selector, **how) -> DataFrame:
    """One row: rows seen and matched."""
    return df.agg(F.count(F.lit(1)).alias("seen"), F.count_if(matched(df, expression, **how)).alias("matched"))


def project(df: DataFrame, paths: list[str], expression: str | Selector = "") -> DataFrame:
    """The paths of matching rows, nested under their keys; rows without any of them go."""
    return shapes.project(where(df, expression), projection.parse(paths))


def mutate(df: DataFrame, mutations: list[str] | str, expression: str | Selector = "", matched_only: bool = True, now: datetime | None = None) -> DataFrame:
    """The actions on matching rows; with matched_only off the others pass unchanged."""
    s = _parsed(expression)
    actions = mutation.parse(mutations, now)
    if s.kind == "all":
        return shapes.mutate(df, actions)
    if matched_only:
        return shapes.mutate(where(df, s, now=now), actions)
    hit = df.withColumn("__hit", columns.matched(s, df.schema, now))  # decided on the row as it was
    return shapes.mutate(hit, actions, F.col("__hit")).drop("__hit")


def project_mutate(df: DataFrame, paths: list[str], mutations: list[str] | str, expression: str | Selector = "", now: datetime | None = None) -> DataFrame:
    """The paths of matching rows, and the actions on what was projected; the selection is on the row as it was."""
    return shapes.mutate(project(df, paths, expression), mutation.parse(mutations, now))


def limited(df: DataFrame, expression: str | Selector, order: list[str], max_records: int | None = None, max_matches: int | None = None, **how) -> DataFrame:
    """Matching rows of the first ``max_records`` rows by the order, at most ``max_matches`` of them.

    Both are top-k plans: each task keeps its first rows, and only those meet.
    """
    if max_records is not None:
        df = df.orderBy(*order).limit(max_records)
    out = where(df, expression, **how)
    return out if max_matches is None else out.orderBy(*order).limit(max_matches)
