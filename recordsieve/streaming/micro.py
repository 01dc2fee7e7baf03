"""Requests over streams. All but the limits are stateless, so plans are those of batches."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import records
from ..records.program import Program, program

CONTINUE, STOP = "continue", "stop"


def lines(df: DataFrame, request: Program, value: str = "value") -> DataFrame:
    """The stream of lines that the request writes."""
    return records.output(df, request, value)


def start(df: DataFrame, where="", fields=(), mutations=(), sink: Callable[[DataFrame, int], None] = None, decide: Callable[[int, int], str] | None = None, checkpoint: str | None = None, available_now: bool = False, **how) -> StreamingQuery:
    """Run a request on a stream. Relative dates are settled anew for each micro-batch.

    ``sink(rows, batch)`` gets each batch's output; ``decide(seen, matched)`` may answer STOP, which ends the
    query after that batch.
    """
    holder: dict[str, StreamingQuery] = {}

    def batch(rows: DataFrame, number: int) -> None:
        request = program(where, fields=fields, mutations=mutations, now=datetime.now(timezone.utc), **how)
        got = records.evaluated(rows, request).persist()
        try:
            if sink:
                sink(got.where(F.col("output").isNotNull()).drop("matched", "value").withColumnRenamed("output", "value"), number)
            if decide:
                seen, hit = got.agg(F.count(F.lit(1)), F.count_if("matched")).first()
                if decide(seen, hit) == STOP and "query" in holder:
                    holder["query"].stop()
        finally:
            got.unpersist()

    writer = df.writeStream.foreachBatch(batch)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    holder["query"] = writer.start()
    return holder["query"]
