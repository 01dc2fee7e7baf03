"""Shared folder, materialised tables and small-side joins for the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of narrow keys that a broadcast side may have at most (a few MB of longs).
BROADCAST_ROWS = 500_000
#: Bytes of its strings, binaries and arrays.
BROADCAST_BYTES = 64 << 20
#: Rows of an Arrow batch that holds texts.
TEXT_ROWS = 1500


def _libc():
    """The C library where it can be asked to return freed memory."""
    found = ctypes.CDLL(None) if sys.platform.startswith("linux") else None
    return found if hasattr(found, "malloc_trim") else None


_LIBC = _libc()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one of a local session without it."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="recordsieve-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


_watched: list[list[str]] = []


def scratch(spark: SparkSession, label: str = "t") -> str:
    path = f"{shared_dir(spark)}/recordsieve-{label}-{uuid.uuid4().hex}"
    for names in _watched:
        names.append(path)
    return path


@contextlib.contextmanager
def cleaning(spark: SparkSession):
    """Delete the scratch tables that are named inside the block when it ends; a caller takes what it keeps off the list."""
    names: list[str] = []
    _watched.append(names)
    try:
        yield names
    finally:
        _watched[:] = [w for w in _watched if w is not names]
        drop(spark, names)


@contextlib.contextmanager
def shuffles_go(spark: SparkSession):
    """Shuffle files of an action inside the block go when it ends, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, label: str = "t", keep: list[str] | None = None) -> DataFrame:
    """The frame, written to the shared folder and read again: its lineage ends there, and its shuffle files go.

    ``keep`` collects the path for a later :func:`drop`.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    with shuffles_go(spark):
        df.write.parquet(path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Fewer rows an Arrow batch, for actions inside the block whose rows are wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Lower the session's Arrow batches to ``rows``: whole texts of ten thousand rows are much for one buffer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Return freed memory of this worker, which is kept for later tasks, to the system."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def tidy(run):
    """A function for mapInArrow that returns its freed memory when its task is done."""

    def through(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return through


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables written by :func:`written` that no frame still needs."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast only if a count shows at most ``rows`` rows and ``size`` bytes in columns of any length; else left to a shuffled join."""
    length = F.lit(0)
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            length = length + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            length = length + F.octet_length(F.to_json(F.struct(f"`{f.name}`")))
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def clashing(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of df that have one of the names, in any case."""
    low = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() in low]
