"""Sources, sinks, the engine's front, the command line, SQL functions and streams."""

import io
import os
from datetime import datetime, timezone

import pytest

from recordsieve import cli
from recordsieve.engine import Engine, capabilities
from recordsieve.functions import udfs
from recordsieve.lang.errors import RecordError, SieveError
from recordsieve.records import reader
from recordsieve.records.program import program
from recordsieve.sources import ndjson
from recordsieve.streaming import micro

TEXT = '{"id":1,"s":"open"}\n{"id":2,\n "s":"shut"}\n\n{"id":3,"s":"open"}\n7\n'


@pytest.fixture
def path(tmp_path):
    p = tmp_path / "in.ndjson"
    p.write_text(TEXT)
    return str(p)


def test_engine(spark, path, tmp_path):
    e = Engine(spark)
    assert list(e.lines(path, e.request("/s=open"))) == ['{"id":1,"s":"open"}', '{"id":3,"s":"open"}']
    assert e.count([path, path], e.request("/s=open")) == 4
    lines, result = e.run(path, e.request("/s=open"), max_matches=1)
    assert (result.seen, result.matched, result.reason) == (1, 1, "match")
    e.filter_file(path, e.request("/s=open", fields=["/id"]), str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"id":1}', '{"id":3}']
    with pytest.raises(SieveError):
        e.filter_file(path, e.request(""), path)
    assert capabilities()["formats"]


def test_callbacks(spark, path):
    e, seen = Engine(spark), []
    result = e.each(path, e.request("/s=open"), lambda i, hit, line: seen.append((i, hit, line)))
    assert (result.seen, result.matched, result.reason) == (4, 2, "none") and seen[1] == (1, False, None)
    assert e.each(path, e.request(""), lambda i, hit, line: i < 1).reason == "callback"
    result = e.each(path, e.request(""), lambda i, hit, line: None, cancelled=lambda: True)
    assert (result.seen, result.reason) == (0, "cancelled")


def test_rewrite(spark, path, tmp_path):
    e = Engine(spark)
    os.chmod(path, 0o640)
    e.rewrite_file(path, e.request("/s=open", mutations="/id=+10"))
    assert open(path).read() == '{"id":11,"s":"open"}\n{"id":13,"s":"open"}\n'
    assert os.stat(path).st_mode & 0o777 == 0o640
    os.symlink(path, tmp_path / "link")
    with pytest.raises(RecordError):
        e.rewrite_file(str(tmp_path / "link"), e.request(""))
    with pytest.raises(RecordError):
        e.rewrite_file("-", e.request(""))
    bad = tmp_path / "bad"
    bad.write_text('{"id":"x"}\n')
    with pytest.raises(Exception):
        e.rewrite_file(str(bad), e.request("", mutations="/id++"))
    assert bad.read_text() == '{"id":"x"}\n'


def test_lines_have_indexes(spark, tmp_path):
    p = tmp_path / "lines"
    p.write_text("".join(f'{{"n":{i}}}\n' + ("\n" if i % 5 == 0 else "") for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = ndjson.lines(spark, str(p)).orderBy("record_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["value"] for r in rows] == [f'{{"n":{i}}}' for i in range(5000)]


def _framed(spark, text, split, **how):
    """What framed() reads of a text in splits of so many bytes, and what one reader makes of it."""
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        for name in ("a", "b"):
            with open(os.path.join(folder, name), "wb") as f:
                f.write(text.encode())
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            rows = ndjson.framed(spark, folder, **how).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    found = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["record_index"])):
        found.setdefault(r["path"][-1], []).append((r["record_index"], r["value"]))
    assert not found or found["a"] == found["b"]
    return found.get("a", [])


@pytest.mark.parametrize("split", [41, 1 << 20])
def test_framed_in_splits(spark, split):
    import json
    import random

    r = random.Random(split)
    out = []
    for i in range(25):
        record = {"i": i, "s": r.choice(['"{[', "}]", "\\", "\u2028é"]) * r.randint(0, 4), "l": [[]] * r.randint(0, 3), "o": {"x": {}}}
        out.append(r.choice([json.dumps(record, ensure_ascii=False), json.dumps(record, indent=1), json.dumps(record, indent=3, ensure_ascii=False).replace("\n", "\r\n"), "  7 ", '"}"', "null"]))
        out += [r.choice(["", " \t"])] * r.randint(0, 2)
    text = "\n".join(out) + r.choice(["", "\n"])
    assert _framed(spark, text, split) == list(enumerate(reader.frames(text)))
    assert _framed(spark, "\n \n", split) == [] == _framed(spark, "", split)


@pytest.mark.parametrize("split", [16])
@pytest.mark.parametrize("bad", ["{,}", "[2]", '{"a":1} {"b":2}', '{"a":\n', '{"open":"', "}", '{"x":1}}'])
def test_framed_stops(spark, split, bad):
    text = '{"a":1}\n{"b":\n[2]}\n\n' + bad + '\n{"c":3}\n'
    got = _framed(spark, text, split, on_error="stop")
    assert got[:2] == [(0, '{"a":1}'), (1, '{"b":\n[2]}')] and got[2:] == [(2, None)]
    with pytest.raises(Exception, match="RecordError"):
        _framed(spark, text, split)


def test_reader_source(spark):
    e = Engine(spark)
    rows = e.read_from(io.BytesIO(TEXT.encode()))
    assert [r["value"] for r in rows.orderBy("record_index").collect()] == list(reader.frames(TEXT))


def test_malformed(spark, tmp_path):
    p = tmp_path / "bad"
    p.write_text('{"a":1}\n[2]\n{"a":3}\n')
    rows = ndjson.framed(spark, str(p), "stop").orderBy("record_index").collect()
    assert [(r["value"], r["error"] is None) for r in rows] == [('{"a":1}', True), (None, False)]
    with pytest.raises(Exception, match="array"):
        ndjson.framed(spark, str(p)).collect()


def test_command_line(spark, path, capsys, tmp_path):
    def run(*words):
        out = io.StringIO()
        return cli.main(list(words), spark, out), out.getvalue()

    assert run("/s=open", path) == (0, '{"id":1,"s":"open"}\n{"id":3,"s":"open"}\n')
    assert run("--count", "/s=open", path) == (0, "2\n")
    assert run("-O", "/id=1", "/id=2", path)[1] == '{"id":1,"s":"open"}\n{"id":2,"s":"shut"}\n'
    assert run("-f", "/id", "/id>=2", path)[1] == '{"id":2}\n{"id":3}\n'
    assert run("-m", "/x=1", "/id=3", path)[1].splitlines()[2:] == ['{"id":3,"s":"open","x":1}', "7"]
    assert run("-M", "-m", "/x=1", "/id=3", path)[1] == '{"id":3,"s":"open","x":1}\n'
    assert run("-i", "-M", "-m", "rm:/s", "/id<3", path)[0] == 0
    assert open(path).read() == '{"id":1}\n{"id":2}\n'
    assert run("nonsense", path)[0] == 1
    empty = tmp_path / "empty"
    empty.write_text("")
    assert run("-m", "/x=1", str(empty))[0] == 1


def test_sql_functions(spark):
    udfs.register(spark)
    spark.createDataFrame([('{"a":1,"b":2}',), ('{"a":3}',), (None,)], "v string").createOrReplaceTempView("raw")
    got = spark.sql("SELECT record_matches(v, '/a=1') AS m, record_project(v, '/b') AS p, record_mutate(v, '/a++') AS u FROM raw").collect()
    assert [tuple(r) for r in got] == [(True, '{"b":2}', '{"a":2,"b":2}'), (False, None, '{"a":4}'), (None, None, None)]
    assert [r[0] for r in spark.table("raw").select(udfs.transformed("v", "/a=3", mutations="/c=x")).collect()] == [None, '{"a":3,"c":"x"}', None]


def test_stream(spark, tmp_path):
    folder = tmp_path / "arrivals"
    folder.mkdir()
    (folder / "one").write_text('{"id":1,"s":"open"}\n{"id":2,"s":"shut"}\n')
    (folder / "two").write_text('{"id":3,"s":"open"}\n')
    got = []
    q = micro.start(ndjson.stream(spark, str(folder)), "/s=open", fields=["/id"], sink=lambda rows, n: got.extend(r["value"] for r in rows.collect()), checkpoint=str(tmp_path / "c"), available_now=True)
    q.awaitTermination(60)
    assert sorted(got) == ['{"id":1}', '{"id":3}']
    plain = micro.lines(ndjson.stream(spark, str(folder)), program("/id>=2"))
    q = plain.writeStream.format("memory").queryName("lines_out").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("lines_out").count() == 2


def test_clock(spark, tmp_path):
    p = tmp_path / "t"
    p.write_text('{"t":"2024-02-29T23:59:59Z"}\n{"t":"2024-03-01T00:00:00Z"}\n')
    e = Engine(spark, clock=lambda: datetime(2024, 3, 1, 12, tzinfo=timezone.utc))
    assert e.count([str(p)], e.request("date{f=/t,since=today}")) == 1
    assert e.count([str(p)], e.request("date{f=/t,since=yesterday}")) == 2


def test_flags():
    assert cli._flags(["--or=true", "--count=F", "-M=1", "/a=true"]) == ["--or", "-M", "/a=true"]
    assert cli._flags(["-O", "-O=0", "--inline=T"]) == ["--inline"]
    with pytest.raises(SieveError):
        cli._flags(["--or=yes"])


def test_rewrite_is_locked(tmp_path):
    p = tmp_path / "held"
    p.write_text("1\n")

    def lines():
        with pytest.raises(RecordError):
            ndjson.rewrite(str(p), iter(["3"]))
        yield "2"

    ndjson.rewrite(str(p), lines())
    assert p.read_text() == "2\n"
