"""The engine's front: sessions, requests over files, versions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lang.errors import RecordError, SieveError
from .lang.mutation import ADD, REMOVE, SET
from .lang.selector import LEAVES
from .operators import records
from .records.program import Program, program
from .sources import ndjson

VERSION = "0.1.0"


def capabilities() -> dict:
    return {"version": VERSION, "formats": ["ndjson", "typed columns"], "predicates": ["all", "and", "or", "not", *LEAVES], "mutations": [SET, ADD, REMOVE], "modes": ["decision", "select", "project", "mutate", "project+mutate", "count"]}


@dataclass
class Result:
    seen: int
    matched: int
    bytes: int
    reason: str


class Engine:
    """Requests over newline-delimited JSON files in a Spark session."""

    def __init__(self, spark: SparkSession, clock: Callable[[], datetime] | None = None):
        self.spark = spark
        self.clock = clock

    def read(self, path: str, line_framed: bool = False, on_error: str = "raise") -> DataFrame:
        """Rows (record_index, value); ``line_framed`` asserts one record a line, which saves a pass."""
        return ndjson.lines(self.spark, path) if line_framed else ndjson.framed(self.spark, path, on_error)

    def read_from(self, source, line_framed: bool = False, on_error: str = "raise") -> DataFrame:
        """As :meth:`read`, of anything with ``read(size) -> bytes``; what it gives is first put where all executors can read it."""
        return self.read(ndjson.spooled(self.spark, source), line_framed, on_error)

    def request(self, where="", fields=(), mutations=(), **how) -> Program:
        return program(where, fields=fields, mutations=mutations, now=how.pop("now", self.clock() if self.clock else None), **how)

    def run(self, path: str, request: Program, max_records: int | None = None, max_matches: int | None = None, max_bytes: int | None = None, line_framed: bool = False) -> tuple[DataFrame, Result]:
        """Output rows in input order by record_index, and the counters of the run."""
        lines, stats = records.limited(self.read(path, line_framed), request, max_records=max_records, max_matches=max_matches, max_bytes=max_bytes)
        return lines, Result(**stats.first().asDict())

    def count(self, paths: list[str], request: Program, line_framed: bool = False) -> int:
        return sum(records.decided(self.read(p, line_framed), request, keep=[]).agg(F.count_if("matched")).first()[0] for p in paths)

    def lines(self, path: str, request: Program, **limits) -> Iterator[str]:
        return ndjson.ordered(self.run(path, request, **limits)[0])

    def each(self, path: str, request: Program, on_record: Callable[[int, bool, str | None], bool | None], cancelled: Callable[[], bool] | None = None, line_framed: bool = False) -> Result:
        """Call ``on_record(index, matched, output)`` in input order, a partition at a time on the driver.

        An answer of False stops after that record, with reason "callback"; a true ``cancelled()`` before the next
        record, with reason "cancelled".
        """
        rows = self.read(path, line_framed).withColumn("size", F.octet_length("value"))
        rows = records.evaluated(rows, request, keep=["record_index", "size"])
        result = Result(0, 0, 0, records.STOP_NONE)
        for r in rows.orderBy("record_index").toLocalIterator():
            if cancelled and cancelled():
                result.reason = "cancelled"
                break
            result.seen += 1
            result.matched += r["matched"]
            result.bytes += r["size"] + 1
            if on_record(r["record_index"], r["matched"], r["output"]) is False:
                result.reason = "callback"
                break
        return result

    def filter_file(self, path: str, request: Program, out: str) -> None:
        """Write the request's lines to a new folder of text files."""
        if ndjson.same_file(path, out):
            raise SieveError("input and output are the same file")
        ndjson.write(records.output(self.read(path), request).orderBy("record_index"), out)

    def rewrite_file(self, path: str, request: Program) -> None:
        """Replace the file by the request's lines, all or nothing."""
        if path == "-" or not ndjson.is_regular(path):
            raise RecordError("only regular files are rewritten")
        ndjson.rewrite(path, self.lines(path, request))
