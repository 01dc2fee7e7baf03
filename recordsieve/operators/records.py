"""Operators over raw JSON records: one exact evaluation a record, in Arrow batches."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.errors import RecordError
from ..records.program import Program, program

STOP_NONE, STOP_RECORD, STOP_MATCH, STOP_BYTE = "none", "record", "match", "byte"
#: Numbers of records whose sizes are summed together first.
RUN = 1 << 16


def evaluated(df: DataFrame, request: Program, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all by default) with ``matched`` and ``output`` (null where the request writes no line).

    Works on batch and streaming frames alike. The first record that is not strict JSON, or that an
    action cannot take, fails the query.
    """

    def made():
        one = request.runner()

        def run(texts):
            found = [one(_record(t)) for t in texts]
            return [pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.string())], None

        return run

    return _mapped(df, made, value, keep, [T.StructField("matched", T.BooleanType()), T.StructField("output", T.StringType())])


def _record(text: str | None) -> str:
    if text is None:
        raise RecordError("a record is null")
    return text


def _mapped(df: DataFrame, made, value: str, keep: list[str] | None, results: list[T.StructField]) -> DataFrame:
    """The kept columns beside what a task's ``made()`` makes of the texts: (arrays, indexes of the rows that stay or None for all)."""
    names = [f.name for f in results]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    n = len(kept)

    def batches_of(batches):
        run = made()
        for b in batches:
            arrays, stay = run(b.column(n).to_pylist())
            columns = b.columns[:n] if stay is None else [c.take(pa.array(stay, pa.int64())) for c in b.columns[:n]]
            yield pa.RecordBatch.from_arrays([*columns, *arrays], names=[*kept, *names])

    given = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{value}`").alias("__record"))
    return given.mapInArrow(batches_of, T.StructType([*given.schema.fields[:-1], *results]))


def decisions(df: DataFrame, where, value: str = "value", keep: list[str] | None = None, **how) -> DataFrame:
    """The columns to keep (all by default) with ``matched``; no line is written."""
    return decided(df, program(where, **how), value, keep)


def decided(df: DataFrame, request: Program, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """As :func:`evaluated`, without applying any action: only ``matched``."""

    def made():
        test = request.decider()
        return lambda texts: ([pa.array([test(_record(t)) for t in texts], pa.bool_())], None)

    return _mapped(df, made, value, keep, [T.StructField("matched", T.BooleanType())])


def output(df: DataFrame, request: Program, value: str = "value") -> DataFrame:
    """The rows that write a line, the line as ``value``. Only those leave the worker."""
    def made():
        one = request.runner()

        def run(texts):
            found = [one(_record(t))[1] for t in texts]
            stay = [i for i, line in enumerate(found) if line is not None]
            return [pa.array([found[i] for i in stay], pa.string())], stay

        return run

    return _mapped(df, made, value, [c for c in df.columns if c not in (value, "matched", "output")], [T.StructField(value, T.StringType())])


def select(df: DataFrame, where, value: str = "value", matched_only: bool = True, **how) -> DataFrame:
    return output(df, program(where, matched_only=matched_only, **how), value)


def project(df: DataFrame, paths: list[str], where="", value: str = "value", **how) -> DataFrame:
    return output(df, program(where, fields=paths, **how), value)


def mutate(df: DataFrame, mutations, where="", value: str = "value", **how) -> DataFrame:
    return output(df, program(where, mutations=mutations, **how), value)


def count(df: DataFrame, where, value: str = "value", any_of: bool = False, now: datetime | None = None) -> DataFrame:
    return decisions(df, where, value, [], any_of=any_of, now=now).agg(F.count_if("matched").alias("matches"))


def counters(df: DataFrame, where, value: str = "value", **how) -> DataFrame:
    """One row: records seen and matched, and their bytes."""
    sized = df.select(F.octet_length(value).alias("__size"), value)
    got = decisions(sized, where, value, ["__size"], **how)
    return got.agg(F.count(F.lit(1)).alias("seen"), F.count_if("matched").alias("matched"), F.coalesce(F.sum("__size"), F.lit(0)).alias("bytes"))


def _reached(sizes: DataFrame, order: str, most: int) -> int | None:
    """The number of the first record at which the sum of ``__size`` so far is ``most`` or more.

    Sums of runs of ``RUN`` numbers tell the run; only its records are summed one by one.
    """
    run = F.floor(F.col(order) / RUN)
    sums = sizes.groupBy(run.alias("__run")).agg(F.sum("__size").alias("__sum"))
    sums = sums.withColumn("__upto", F.sum("__sum").over(Window.orderBy("__run")))
    first = sums.where(F.col("__upto") >= most).orderBy("__run").first()
    if first is None:
        return None
    own = sizes.where(run == first["__run"]).withColumn("__upto", F.sum("__size").over(Window.orderBy(order)) + F.lit(first["__upto"] - first["__sum"]))
    return own.where(F.col("__upto") >= most).agg(F.min(order)).first()[0]


def limited(df: DataFrame, request: Program, order: str = "record_index", value: str = "value", max_records: int | None = None, max_matches: int | None = None, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(output rows, a row of seen, matched, bytes, reason) of a request that stops early.

    ``order`` numbers the records 0, 1, ... A record limit stops before the record of that number; a match
    limit after that many matches; a byte limit after the record that reaches it. A match limit's stop beats the others, a
    record limit's the byte limit's. Stops and counters come from decisions alone; lines are made only before the stop.
    """
    if max_records is not None:
        df = df.where(F.col(order) < max_records)
    sized = df.select(order, (F.octet_length(value) + 1).alias("__size"), value)
    got = decided(sized, request, value, [order, "__size"])
    stops = []
    if max_matches is not None:
        hits = got.where("matched").orderBy(order).limit(max_matches)
        last = hits.agg(F.count(F.lit(1)).alias("c"), F.max(order).alias("at")).first()
        if last["c"] == max_matches:
            stops.append((last["at"] + 1 if max_matches else 0, 0, STOP_MATCH))
    if max_bytes is not None:
        reached = _reached(sized.select(order, "__size"), order, max_bytes)
        if reached is not None:
            stops.append((reached + 1, 2, STOP_BYTE))
    if max_records is not None:
        seen = df.agg(F.max(order)).first()[0]
        if max_records == 0 or seen is not None and seen + 1 >= max_records:
            stops.append((max_records, 1, STOP_RECORD))
    end, _, reason = min(stops, default=(None, 0, STOP_NONE))
    early = F.lit(True) if end is None else F.col(order) < end
    stats = decided(sized.where(early), request, value, ["__size"])
    stats = stats.agg(F.count(F.lit(1)).alias("seen"), F.count_if("matched").alias("matched"), F.coalesce(F.sum("__size"), F.lit(0)).alias("bytes")).withColumn("reason", F.lit(reason))
    return output(df.where(early), request, value), stats
