"""The typed and the text path agree, and results do not depend on partitions."""

import json
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from recordsieve.lang.errors import UnsupportedPath
from recordsieve.operators import records, typed
from recordsieve.records.program import program
from recordsieve.sources import ndjson

SCHEMA = "id long, n long, s string, b boolean, a array<struct<x: long, y: string>>, m map<string, string>, t string"
ROWS = [
    (0, 1, "alpha", True, [(1, "p"), (5, "q")], {"k": "v"}, "2024-01-01"),
    (1, None, "", False, [], {}, "2024-01-01T10:00:00+02:00"),
    (2, 10, "1", None, None, None, "2024-01-01T08:00:00.5Z"),
    (3, -7, None, True, [(None, None), (3, "İx")], {"1": "p", "k": ""}, " 2024-02-29T23:59:59 "),
    (4, 2**40, "ΑΣ", False, [(5, "p")], {"k": "p"}, "2024-02-30"),
    (5, 5, "true", True, [(5, "5"), (6, "p")], {"y": "v"}, "x"),
]
LEAVES = [
    "/n=1", "/n=1.0", "/n!=1", "/n>=5", "/n<5.5", "/n>1e30", "/n=1.5", "range{f=/n,gt=-8,lt=2}", "in{f=/n,any=1|10|x}", '/s="1"', "/s=1", "/s=alpha", "/s!=alpha", "eq{f=/s}", "contains{f=/s,v=a}", "contains{f=/n,v=1}",
    "icontains{f=/s,v=ας}", "icontains{f=/s,v=ΑΣ}", "iprefix{f=/a[]/y,v=i}", "prefix{f=/s,v=a}", "contains{f=/s}", "exists{/s}", "/b=true", "/b!=true", "contains{f=/b,v=ru}", "/a[]/x=5", "/a/1/x>2", "exists{/a/1}", "/a/**/y=p",
    "/a/*/y=p", "/m/*=p", "/m/k=v", "/m/1=p", "/.../y=p", "/...=p", "/.../x>=5", "exists{/...}", "/m/...=p", "/t=2024-01-01", '/t="2024-01-01T08:00:00Z"', "/t>=2024-01-01T08:00:00.5Z", "date{f=/t,after=2024-01-01,before=2024-03-01}", "date{f=/t,value=2024-02-29}", "in{f=/a[]/y,any=p|q}", "/nothing=1", "exists{/nothing}", "/nothing!=1",
]


def _frames(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    text = [(r[0], json.dumps({k: v for k, v in zip(("id", "n", "s", "b", "a", "m", "t"), r, strict=True) if v is not None} | ({"a": [{k: x for k, x in (("x", e[0]), ("y", e[1])) if x is not None} for e in r[4]]} if r[4] is not None else {}), ensure_ascii=False)) for r in ROWS]
    return rows, text


def test_leaves_agree(spark):
    rows, text = _frames(spark)
    got = rows.select("id", *[typed.matched(rows, s).alias(f"c{i}") for i, s in enumerate(LEAVES)]).collect()
    for i, s in enumerate(LEAVES):
        run = program(s).runner()
        assert {r["id"]: r[f"c{i}"] for r in got} == {k: run(v)[0] for k, v in text}, s


tree = st.recursive(st.sampled_from(LEAVES).map(lambda s: [s]), lambda inner: st.tuples(st.sampled_from(["and", "or", "not"]), st.lists(inner, min_size=1, max_size=3)).map(list), max_leaves=6)


def _selector(t):
    from recordsieve.lang import selector as S

    if len(t) == 1:
        return S.parse(t[0])
    kids = [_selector(x) for x in t[1]]
    return S.negated(S.both(kids)) if t[0] == "not" else S.Selector(t[0], tuple(kids))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tree)
def test_trees_agree(spark, t):
    rows, text = _frames(spark)
    s = _selector(t)
    run = program(s).runner()
    assert sorted(r["id"] for r in typed.where(rows, s).select("id").collect()) == [k for k, v in text if run(v)[0]]


NUMBERS = "id long, i int, l long, d decimal(10,2), w decimal(38,0), x double, f float, ts timestamp, tn timestamp_ntz"
NUMBER_ROWS = [
    "(0L, 3, 9007199254740993L, 0.10BD, 99999999999999999999999999999999999999BD, 9007199254740992D, 0.1F, timestamp'0001-01-01 00:00:00', timestamp_ntz'0001-01-01 00:00:00')",
    "(1L, -2147483648, -9223372036854775808L, -12345678.99BD, -1BD, 0.1D, 3.5F, timestamp'9999-12-31 23:59:59.999999', timestamp_ntz'9999-12-31 23:59:59.999999')",
    "(2L, 2147483647, 9223372036854775807L, 99999999.99BD, 0BD, 1.7976931348623157E308D, -16777217F, timestamp'2024-02-29 12:00:00', timestamp_ntz'2024-02-29 12:00:00')",
    "(3L, null, null, null, null, null, null, null, null)",
    "(4L, 0, 0L, 2.00BD, 1BD, double('NaN'), float('inf'), null, null)",
    "(5L, 2, 9007199254740992L, 3.01BD, 2BD, double('-inf'), float('NaN'), timestamp'1970-01-01 00:00:00', timestamp_ntz'1970-01-01 00:00:00')",
    "(6L, -1, -1L, -0.01BD, 4BD, -0.0D, -0.0F, null, null)",
]
BOUNDS = ["0", "-0", "0.1", "0.10000000000000001", "0.100000001490116", "3.5", "2.675", "3.005", "-12345678.995", "99999999.991", "1e39", "-1e39", "1e38", "99999999999999999999999999999999999999.5", "9007199254740993", "9007199254740992.5", "2147483647.5", "9223372036854775808", "1e400", "-1e400", "1e-400", "-1e-400", "1e" + "9" * 5000, "-1e-" + "9" * 5000, "1.7976931348623157e308", "1.8e308", "16777217"]
TIMES = ["0000-01-01", "0001-01-01", "0001-01-01T00:00:00+05:00", "0000-12-31T23:59:59.999999999Z", "9999-12-31T23:59:59-10:00", "9999-12-31", "9999-12-31T23:59:59.9999995Z", "2024-02-29T12:00:00.000000001Z", "2024-02-29"]


def _as_json(r):
    out = {}
    for k, v in r.asDict().items():
        if v is None or k == "id":
            continue
        if k in ("ts", "tn"):
            v = json.dumps(v)
        elif k in ("x", "f") and v in ("NaN", "Infinity", "-Infinity"):
            v = json.dumps(v)
        out[k] = v
    return "{" + ",".join(f'"{k}":{v}' for k, v in out.items()) + "}"


def _number_frames(spark):
    rows = spark.sql(f"select * from values {', '.join(NUMBER_ROWS)} as t({', '.join(c.split()[0] for c in NUMBERS.split(', '))})")
    rows = rows.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in NUMBERS.split(", ")])
    spelled = rows.selectExpr("id", *[f"cast({c} as string) as {c}" for c in ("i", "l", "d", "w", "x", "f")], "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") as ts", "date_format(tn, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") as tn")
    return rows, [(r["id"], _as_json(r)) for r in spelled.collect()]


def test_bounds_agree(spark):
    rows, text = _number_frames(spark)
    asked = [f"/{c}{op}{b}" for c in ("i", "l", "d", "w", "x", "f") for op in (">", ">=", "<", "<=", "=") for b in BOUNDS]
    asked += [f"/{c}{op}{t}" for c in ("ts", "tn") for op in (">", ">=", "<", "<=", "=") for t in TIMES]
    got = {}
    for a in range(0, len(asked), 200):
        part = rows.select("id", *[typed.matched(rows, s).alias(f"c{i}") for i, s in enumerate(asked[a : a + 200])]).collect()
        for i, s in enumerate(asked[a : a + 200]):
            got[s] = {r["id"]: r[f"c{i}"] for r in part}
    for s in asked:
        run = program(s).runner()
        assert got[s] == {k: run(v)[0] for k, v in text}, s


def test_mutations_agree_or_are_refused(spark):
    rows = spark.createDataFrame([(1, 3, Decimal("0.10"), 0.1, ("s", 1)), (2, -7, Decimal("5.25"), 2.5, None)], "id long, n int, d decimal(10,2), x double, m struct<st: string, k: int>")
    asked = ["/n=+1", "/n=+0.5", "/n=2", "/n=2.7", "/n=3000000000", "/d=+0.2", "/d=+0.005", "/d=7.5", "/d=0.005", "/d=1e39", "/x=+0.2", "/x=1e39", "/x=-2.5", "/m/k=+1", "/m/k=+0.5", "/n=x", "/n=null"]
    refused = set()
    for m in asked:
        try:
            got = typed.mutate(rows, m)
            assert got.dtypes == rows.dtypes, m
        except UnsupportedPath:
            refused.add(m)
            continue
        name = m[1]
        run = program(mutations=m).runner()
        for r, new in zip(rows.collect(), got.collect(), strict=True):
            if name == "m" and r["m"] is None:
                continue  # a missing parent: a struct column stays null
            before = json.dumps({"n": r["n"], "d": float(r["d"]), "x": r["x"], "m": r["m"] and r["m"].asDict()})
            want = json.loads(run(before)[1])[name]
            have = new[name] if name != "m" else new["m"].asDict()
            assert (float(have) if isinstance(have, Decimal) else have) == (round(want, 2) if name == "d" else want), m
    assert refused == {"/n=+0.5", "/n=2.7", "/n=3000000000", "/d=+0.005", "/d=0.005", "/d=1e39", "/m/k=+0.5", "/n=x"}
    for m in ("rm:/m/st", "/m/other=1"):
        with pytest.raises(UnsupportedPath):
            typed.mutate(rows, m, "/n=3", matched_only=False)
        assert typed.mutate(rows, m).count() == 2


def test_partitions_do_not_matter(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    one = sorted(map(tuple, records.mutate(rows.coalesce(1), ["/k++"], "/k>=50", value="props").collect()))
    many = sorted(map(tuple, records.mutate(rows.repartition(7), ["/k++"], "/k>=50", value="props").collect()))
    assert one == many


def test_limits(spark):
    rows = spark.createDataFrame([(i, '{"n":%d}' % (i % 3)) for i in range(20)], "record_index long, value string").repartition(5)
    request = program("/n=0")

    def run(**how):
        lines, stats = records.limited(rows, request, **how)
        return sorted(r["record_index"] for r in lines.collect()), tuple(stats.first())

    assert run() == ([0, 3, 6, 9, 12, 15, 18], (20, 7, 160, "none"))
    assert run(max_records=4) == ([0, 3], (4, 2, 32, "record"))
    assert run(max_records=20)[1][3] == "record"
    assert run(max_matches=2) == ([0, 3], (4, 2, 32, "match"))
    assert run(max_bytes=17) == ([0], (3, 1, 24, "byte"))
    assert run(max_records=4, max_matches=2)[1][3] == "match"
    assert run(max_records=3, max_bytes=17)[1][3] == "record"
    assert run(max_records=9, max_matches=2, max_bytes=9)[1] == (2, 1, 16, "byte")


def test_json_of_rows(spark):
    rows, _ = _frames(spark)
    assert ndjson.of_rows(rows, "id").count() == len(ROWS)
