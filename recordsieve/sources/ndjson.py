"""Newline-delimited JSON as rows (record_index, value), and sinks for such rows."""

from __future__ import annotations

import contextlib
import fcntl
import os
import shutil
import stat
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lang.errors import RecordError, SieveError
from ..records import reader

SCHEMA = "record_index long, value string"
#: An input of at most so many bytes, by the optimizer's estimate, is dealt out to all cores, in parts of at least PART_BYTES.
SPREAD_BYTES, PART_BYTES = 1 << 30, 1 << 16
#: A JSON string, without backtracking; no raw line feed can be in one.
_STRINGS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if it is small: a file of one split would else be one task's work.

    Larger inputs come in many splits and are left as they are.
    """
    if df.isStreaming:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(min(df.sparkSession.sparkContext.defaultParallelism, 1 + size // PART_BYTES)) if size <= SPREAD_BYTES else df


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Input whose records each fill one line: splittable, blank lines left out.

    Indexes follow the file's order: every task counts its lines, and starts from the counts of the tasks before.
    """
    rows = spark.read.text(path, lineSep="\n").where(F.col("value").rlike(r"[^ \t\r]"))
    rows = rows.withColumn("__id", F.monotonically_increasing_id())
    rows = rows.withColumns({"__part": F.shiftright("__id", 33), "__own": F.col("__id").bitwiseAND((1 << 33) - 1)})
    counts = rows.groupBy("__part").agg((F.max("__own") + 1).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__before"))  # a row a task
    return rows.join(F.broadcast(starts), "__part").select((F.col("__before") + F.col("__own")).alias("record_index"), "value")


def framed(spark: SparkSession, paths: str | list[str], on_error: str = "raise") -> DataFrame:
    """Any strict input, records over several lines included, as (path, record_index, value); a file is read in splits.

    A strict string holds no raw line feed, so every line's change of nesting is known by itself. One pass
    sums it up by split, which gives the nesting that each split starts with. In the next, every split frames its own
    records as they come, and only the pieces of those that cross into other splits are put together by a shuffle. A
    worker holds one record at a time.

    ``on_error="stop"`` keeps a file's records before the first that is malformed; the row after them has the
    index, a null value and the error, so that callers can tell.
    """
    if on_error not in ("raise", "stop"):
        raise ValueError("on_error is raise or stop")
    bare = F.regexp_replace("value", _STRINGS, "")
    change = 2 * F.length(F.translate(bare, "]}", "")) - F.length(F.translate(bare, "[]{}", "")) - F.length(bare)  # opened less closed
    raw = spark.read.text(paths, lineSep="\n")
    text = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), change.cast("long").alias("change"), F.col("value").rlike(r"[^ \t\r]").alias("full"), F.col("value").cast("binary").alias("line"))
    splits = _nesting(text.select("path", "start", "change", "full").mapInArrow(_sums, "path string, start long, total long, low long, ends long"))
    splits = splits.select(F.col("path").alias("__path"), F.col("start").alias("__start"), "depth", "owner", "closes", "base")  # a row a split
    rows = text.join(F.broadcast(splits), (F.col("path") == F.col("__path")) & (F.col("start") == F.col("__start"))).drop("__path", "__start")
    raising = on_error == "raise"

    def run(batches):
        for found in _records(batches):
            yield _checked(found, raising)

    found = rows.mapInArrow(run, "path string, record_index long, owner long, start long, line binary, value string, error string")
    whole = found.where("owner is null").select("path", "record_index", "value", "error")
    pieces = found.where("owner is not null").groupBy("path", "owner").agg(F.max("record_index").alias("record_index"), F.sort_array(F.collect_list(F.struct("start", "line"))).alias("l"))

    def joined(batches):
        for b in batches:
            texts = [b"\n".join(x["line"] for x in pieces) for pieces in b.column(2).to_pylist()]
            yield _checked([(path, i, None, None, None, t, None) for path, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, strict=True)], raising).select(["path", "record_index", "value", "error"])

    whole = whole.unionByName(pieces.select("path", "record_index", "l").mapInArrow(joined, "path string, record_index long, value string, error string"))
    if raising:
        return whole.drop("error")
    first = whole.where("error is not null").groupBy(F.col("path").alias("__path")).agg(F.min("record_index").alias("__end"))
    kept = whole.join(first, F.col("path") == F.col("__path"), "left").where("__end is null or record_index <= __end")
    return kept.drop("__path", "__end")


def _sums(batches):
    """Of every split: the sum of its lines' changes, the least sum at a line's end, and how many records end at that."""
    key, total, low, ends, open_ = None, 0, None, 0, False
    done: list[tuple] = []
    for b in batches:
        for path, start, change, full in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
            if (path, start) != key:
                if key is not None:
                    done.append((*key, total, low, ends))
                key, total, low, ends, open_ = (path, start), 0, None, 0, False
            total += change
            open_ = open_ or full
            if low is None or total < low:
                low, ends = total, 0
            if total == low:
                ends += open_
                open_ = False
    if key is not None:
        done.append((*key, total, low, ends))
    kinds = [pa.string()] + [pa.int64()] * 4
    yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=["path", "start", "total", "low", "ends"])


def _nesting(sums: DataFrame) -> DataFrame:
    """Of every split the nesting it starts with, the split where the record open there began, whether what is open at its end closes, and its first index."""
    file = Window.partitionBy("path").orderBy("start")
    before, after = file.rowsBetween(Window.unboundedPreceding, -1), file.rowsBetween(1, Window.unboundedFollowing)
    s = sums.withColumn("depth", F.coalesce(F.sum("total").over(before), F.lit(0)))
    s = s.withColumn("reaches", F.col("depth") + F.col("low") <= 0)  # a record ends here
    s = s.withColumn("owner", F.coalesce(F.last(F.when(F.col("reaches") | (F.col("depth") == 0), F.col("start")), ignorenulls=True).over(before), F.first("start").over(file)))
    s = s.withColumn("closes", F.coalesce(F.max("reaches").over(after), F.lit(False)))
    left = (F.col("depth") + F.col("total") > 0).cast("long")
    begun = F.when(F.col("reaches"), F.col("ends") - (F.col("depth") > 0).cast("long") + left).otherwise((F.col("depth") == 0).cast("long"))
    return s.withColumn("base", F.coalesce(F.sum(begun).over(before), F.lit(0)))


def _records(batches):
    """Lists of (path, index, owner, start, piece, record, error) from lines in order: a record, or a piece of the owner's record."""
    key, depth, held, out = None, 0, [], []
    owner = index = closes = None

    def ended(by):
        """What a split leaves open is a piece of a record, if that record closes anywhere."""
        if not held:
            return
        if not closes:
            if by is None:  # the record began here and has no end
                out.append((key[0], index, None, None, None, None, "a record is not closed at the end of the file"))
        else:
            out.append((key[0], index if by is None else -1, key[1] if by is None else by, key[1], b"\n".join(held), None, None))

    for b in batches:
        for path, start, change, full, line, at, by, c, base in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
            if (path, start) != key:
                if key is not None:
                    ended(owner)
                key, depth, held, owner, index, closes = (path, start), at, [], by if at > 0 else None, base, c
            if full or held:
                held.append(line)
            depth += change
            if depth <= 0 and held:
                text = b"\n".join(held)
                if owner is not None:
                    out.append((path, -1, owner, start, text, None, None))
                    owner = None
                else:
                    out.append((path, index, None, None, None, text, None))
                    index += 1
                held = []
        if out:
            yield out
            out = []
    if key is not None:
        ended(owner)
    if out:
        yield out


def _checked(found: list[tuple], raising: bool) -> pa.RecordBatch:
    """Records as text, or their error. Pieces stay as they are."""
    rows = []
    for path, index, owner, start, piece, record, error in found:
        text = None
        if record is not None:
            try:
                text = reader.utf8(record).strip(" \t\r\n")
                reader.quick(text)
            except RecordError as e:
                text, error = None, str(e)
        if error is not None and raising:
            raise RecordError(f"{path}, record {index}: {error}")
        rows.append((path, index, owner, start, piece, text, error))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "record_index", "owner", "start", "line", "value", "error"])


def spooled(spark: SparkSession, source) -> str:
    """The bytes of a stream as a file that all executors can read; the caller deletes it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise SieveError("standard input needs spark.checkpoint.dir, a folder that executors share")
        with tempfile.NamedTemporaryFile("wb", suffix=".ndjson", delete=False) as held:
            shutil.copyfileobj(source, held)
        return held.name
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/stdin-{uuid.uuid4().hex}.ndjson")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, False)
    try:
        while chunk := source.read(1 << 20):
            out.write(bytearray(chunk))
    finally:
        out.close()
    return path.toString()


def delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)


def stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A stream of the lines of files that arrive in a folder."""
    return spark.readStream.format("text").options(**options).load(folder)


def of_rows(df: DataFrame, key: str) -> DataFrame:
    """Typed rows as records: (key, value) with each row's JSON."""
    return spread(df).select(F.col(key), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write(rows: DataFrame, path: str, value: str = "value") -> None:
    """One record a line, a file a task."""
    rows.select(value).write.text(path)


def ordered(rows: DataFrame, order: str = "record_index", value: str = "value") -> Iterator[str]:
    """The records in order, a partition at a time on the driver."""
    for r in rows.select(order, value).orderBy(order).toLocalIterator():
        yield r[value]


def is_regular(path: str) -> bool:
    """Whether the path names a regular file, without opening it."""
    try:
        return stat.S_ISREG(os.stat(path).st_mode)
    except OSError:
        return False


def same_file(a: str, b: str) -> bool:
    try:
        return os.path.samefile(a, b)
    except OSError:
        return False


def rewrite(path: str, records: Iterator[str]) -> None:
    """Replace a regular file by the records: a sibling is written, flushed to disk and renamed over it.

    The file is locked meanwhile, so that of two rewrites one is refused; mode and, where permitted, owner stay.
    """
    if os.path.islink(path) or not is_regular(path):
        raise RecordError("only regular files are rewritten")
    with open(path, "rb") as held:
        try:
            fcntl.flock(held, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as e:
            raise RecordError("the file is being rewritten") from e
        if not os.path.samestat(os.fstat(held.fileno()), os.stat(path)):
            raise RecordError("the file was replaced meanwhile")
        _replace(path, records, os.fstat(held.fileno()))


def _replace(path: str, records: Iterator[str], before: os.stat_result) -> None:
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".rewrite-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as out:
            for r in records:
                out.write(r + "\n")
            out.flush()
            os.fsync(out.fileno())
        os.chmod(temp, stat.S_IMODE(before.st_mode))
        with contextlib.suppress(PermissionError):
            os.chown(temp, before.st_uid, before.st_gid)
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise
