"""The registered queries of the record engine and the SQL that states their results."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import udfs
from .operators import records, typed
from .records.program import program
from .sources import ndjson

#: The clock of queries with relative dates.
NOW = datetime(1996, 7, 1, 12, 0, tzinfo=timezone.utc)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _orders_with_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line items as an array of structs, and a struct and a map of order facts."""
    items = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")).alias("items")
    )
    o = _table(spark, sf_dir, "orders").join(items, "o_orderkey", "left")
    meta = F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority")).alias("sale"))
    labels = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    return o.select("o_orderkey", "o_custkey", "items", meta.alias("meta"), labels.alias("labels"))


def _typed(name: str, table: str, selector: str, key: str, condition: str, **how):
    """A selection over typed columns and the same over raw records of those rows."""
    sql = f"SELECT {key} FROM {table} WHERE {condition}"
    QUERIES[f"typed_{name}"] = lambda spark, sf_dir: typed.where(_table(spark, sf_dir, table), selector, **how).select(key)
    QUERIES[f"text_{name}"] = lambda spark, sf_dir: records.select(ndjson.of_rows(_table(spark, sf_dir, table), key), selector, **how).select(key)
    SQL[f"typed_{name}"] = SQL[f"text_{name}"] = sql


def _nested(name: str, selector: str, condition: str):
    """A selection over orders with nested items, typed and as raw records."""
    sql = f"SELECT o_orderkey FROM orders o WHERE {condition}"
    QUERIES[f"typed_{name}"] = lambda spark, sf_dir: typed.where(_orders_with_items(spark, sf_dir), selector).select("o_orderkey")
    QUERIES[f"text_{name}"] = lambda spark, sf_dir: records.select(ndjson.of_rows(_orders_with_items(spark, sf_dir), "o_orderkey"), selector).select("o_orderkey")
    SQL[f"typed_{name}"] = SQL[f"text_{name}"] = sql


@_query("flagship", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def flagship(spark, sf_dir):
    return typed.project(_table(spark, sf_dir, "orders"), ["/o_totalprice", "/o_orderkey"], '/o_orderstatus="F",/o_totalprice>=100000')


# predicates
_typed("all", "orders", "/", "o_orderkey", "true")
_typed("eq_string", "orders", '/o_orderstatus="F"', "o_orderkey", "o_orderstatus = 'F'")
_typed("eq_number", "lineitem", "/l_linenumber=3.0", "l_orderkey", "l_linenumber = 3")
_typed("eq_mistyped", "orders", '/o_custkey="1"', "o_orderkey", "false")
_typed("eq_time", "orders", "/o_orderdate=1995-03-05", "o_orderkey", "CAST(o_orderdate AS DATE) = DATE '1995-03-05'")
_typed("ne", "orders", "/o_orderstatus!=F", "o_orderkey", "o_orderstatus IS DISTINCT FROM 'F'")
_typed("ne_missing", "orders", "/nothing!=1", "o_orderkey", "true")
_typed("contains", "part", "contains{f=/p_name,v=a}", "p_partkey", "contains(p_name, 'a')")
_typed("contains_any", "part", "contains{f=/p_name,any=an|el|ar}", "p_partkey", "contains(p_name, 'an') OR contains(p_name, 'el') OR contains(p_name, 'ar')")
_typed("icontains", "part", "icontains{f=/p_name,v=AR}", "p_partkey", "contains(lower(p_name), 'ar')")
_typed("contains_ignore_case", "part", "contains{f=/p_type,v=eCo,ic=t}", "p_partkey", "contains(lower(p_type), 'eco')")
_typed("contains_number", "orders", "contains{f=/o_custkey,v=12}", "o_orderkey", "contains(CAST(o_custkey AS VARCHAR), '12')")
_typed("prefix", "orders", "prefix{f=/o_orderpriority,v=1}", "o_orderkey", "starts_with(o_orderpriority, '1')")
_typed("iprefix", "part", "iprefix{f=/p_brand,v=brand#1}", "p_partkey", "starts_with(lower(p_brand), 'brand#1')")
_typed("present", "orders", "prefix{f=/o_orderpriority}", "o_orderkey", "o_orderpriority IS NOT NULL")
_typed("exists", "orders", "exists{/o_orderdate}", "o_orderkey", "o_orderdate IS NOT NULL")
_typed("exists_missing", "orders", "exists{/nothing}", "o_orderkey", "false")
_typed("range", "lineitem", "range{f=/l_quantity,gte=10,lt=20}", "l_orderkey", "l_quantity >= 10 AND l_quantity < 20")
_typed("range_fraction", "lineitem", "/l_linenumber>2.5", "l_orderkey", "l_linenumber > 2.5")
_typed("range_huge", "orders", "/o_totalprice<1e400", "o_orderkey", "o_totalprice IS NOT NULL")
_typed("range_time", "orders", 'range{f=/o_orderdate,gte="1995-01-01T00:00:00Z",lt=1996-01-01}', "o_orderkey", "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
_typed("date_window", "orders", "date{f=/o_orderdate,after=1995-01-01,before=1996-01-01}", "o_orderkey", "o_orderdate > TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
_typed("date_value", "orders", "date{f=/o_orderdate,value=1996-01-02}", "o_orderkey", "CAST(o_orderdate AS DATE) = DATE '1996-01-02'")
_typed("date_since", "orders", "date{f=/o_orderdate,since=yesterday}", "o_orderkey", "o_orderdate >= TIMESTAMP '1996-06-30'", now=NOW)
_typed("in", "events", "in{f=/event_type,any=click|view}", "event_id", "event_type IN ('click', 'view')")
_typed("in_numbers", "lineitem", "in{f=/l_linenumber,any=1|2.0|x}", "l_orderkey", "l_linenumber IN (1, 2)")
_typed("and", "lineitem", '/l_returnflag="R",/l_quantity>=25,prefix{f=/l_linestatus,v=O}', "l_orderkey", "l_returnflag = 'R' AND l_quantity >= 25 AND starts_with(l_linestatus, 'O')")
_typed("or", "orders", "or.eq{f=/o_orderstatus,v=P},or.range{f=/o_totalprice,lt=5000}", "o_orderkey", "o_orderstatus = 'P' OR o_totalprice < 5000")
_typed("or_mode", "orders", '/o_orderstatus="P"\n/o_totalprice<5000', "o_orderkey", "o_orderstatus = 'P' OR o_totalprice < 5000", any_of=True)
_typed("not", "orders", "not.range{f=/o_totalprice,gte=50000}", "o_orderkey", "NOT coalesce(o_totalprice >= 50000, false)")
_typed("indexed_groups", "orders", "or.0.eq{f=/o_orderstatus,v=F},or.0.range{f=/o_totalprice,gt=200000},or.1.eq{f=/o_orderstatus,v=O},or.1.range{f=/o_totalprice,lt=20000}", "o_orderkey", "(o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderstatus = 'O' AND o_totalprice < 20000)")



def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a boolean, a column that is often null, and an exact price."""
    o, price = _table(spark, sf_dir, "orders"), F.col("o_totalprice")
    return o.select("o_orderkey", (price > 150000).alias("big"), F.when(F.col("o_orderstatus") != "F", F.lit(1)).alias("note"), price.cast("decimal(12,2)").alias("price"))


@_query("typed_eq_bool", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000")
def typed_eq_bool(spark, sf_dir):
    return typed.where(_facts(spark, sf_dir), "/big=true").select("o_orderkey")


@_query("text_eq_bool", "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 150000)")
def text_eq_bool(spark, sf_dir):
    return records.select(ndjson.of_rows(_facts(spark, sf_dir), "o_orderkey"), "/big=false").select("o_orderkey")


@_query("text_eq_null", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def text_eq_null(spark, sf_dir):
    return records.select(ndjson.of_rows(_facts(spark, sf_dir), "o_orderkey"), "/note=null").select("o_orderkey")


@_query("typed_range_decimal", "SELECT o_orderkey FROM orders WHERE CAST(o_totalprice AS DECIMAL(12,2)) > 150000.00 AND CAST(o_totalprice AS DECIMAL(12,2)) < 300000")
def typed_range_decimal(spark, sf_dir):
    return typed.where(_facts(spark, sf_dir), "range{f=/price,gte=150000.005,lt=3e5},/price<1e39").select("o_orderkey")


@_query("json_export", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice >= 100000.5 OR o_orderpriority = '1-URGENT')")
def json_export(spark, sf_dir):
    from .lang import selector as s

    exported = s.to_json(s.parse('/o_orderstatus="F",or.range{f=/o_totalprice,gte=100000.5},or.eq{f=/o_orderpriority,v=1-URGENT}'))
    return typed.where(_table(spark, sf_dir, "orders"), s.from_json(exported)).select("o_orderkey")


# paths
_nested("member", '/meta/sale/priority="1-URGENT"', "o_orderpriority = '1-URGENT'")
_nested("elements", '/items[]/l_returnflag="R"', "EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
_nested("elements_interval", "range{f=/items[]/l_quantity,gt=48,lt=50}", "EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 48 AND l_quantity < 50)")
_nested("elements_apart", "/items[]/l_quantity>48,/items[]/l_quantity<3", "EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 48) AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity < 3)")
_nested("any_member", '/labels/*="F"', "o_orderstatus = 'F'")
_nested("any_child", '/items/**/l_linestatus="O"', "EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linestatus = 'O')")
_nested("recursive", "/.../l_linenumber=7", "EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linenumber = 7)")
_nested("recursive_end", '/meta/...="1-URGENT"', "o_orderpriority = '1-URGENT'")
_nested("element_index", "exists{/items/5}", "(SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) > 5")
_nested("no_element", '/items/*/l_returnflag="R"', "false")


@_query("json_selector", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT (o_totalprice < 100000)")
def json_selector(spark, sf_dir):
    from .lang.selector import from_json

    s = from_json('{"and":[{"eq":{"field":"/o_orderstatus","value":"F"}},{"not":{"range":{"field":"/o_totalprice","lt":100000}}}]}')
    return typed.where(_table(spark, sf_dir, "orders"), s).select("o_orderkey")


@_query("builder_selector", "SELECT event_id FROM events WHERE event_type = 'purchase' OR value > 100")
def builder_selector(spark, sf_dir):
    from .lang import selector as s

    return typed.where(_table(spark, sf_dir, "events"), s.either([s.eq("/event_type", "purchase"), s.within("/value", gt=100)])).select("event_id")


# raw records as they are in the table
_PROPS = "CAST(json_extract(props, '$.k') AS INTEGER)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ndjson.spread(_table(spark, sf_dir, "events").select("event_id", "props"))


@_query("json_text_range", f"SELECT event_id FROM events WHERE {_PROPS} >= 90")
def json_text_range(spark, sf_dir):
    return records.select(_events(spark, sf_dir), "/k>=90", value="props").select("event_id")


@_query("json_text_udf", f"SELECT event_id FROM events WHERE {_PROPS} = 7")
def json_text_udf(spark, sf_dir):
    return _table(spark, sf_dir, "events").where(udfs.matches("props", "/k=7")).select("event_id")


@_query("json_text_decisions", f"SELECT event_id, {_PROPS} < 10 AS matched FROM events")
def json_text_decisions(spark, sf_dir):
    return records.decisions(_events(spark, sf_dir), "/k<10", value="props", keep=["event_id"])


@_query("json_text_project", f"SELECT event_id, {_PROPS} AS k FROM events WHERE {_PROPS} >= 50")
def json_text_project(spark, sf_dir):
    got = records.project(_events(spark, sf_dir), ["/k"], "/k>=50", value="props")
    return got.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@_query("json_text_mutate", f"SELECT event_id, {_PROPS} + 5 AS k, 'seen' AS state FROM events WHERE {_PROPS} >= 50")
def json_text_mutate(spark, sf_dir):
    got = records.mutate(_events(spark, sf_dir), ["/k=+5", "/state=seen"], "/k>=50", value="props")
    return got.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.state").alias("state"))


@_query("json_text_mutate_all", f"SELECT event_id, CASE WHEN {_PROPS} >= 50 THEN {_PROPS} + 5 ELSE {_PROPS} END AS k FROM events")
def json_text_mutate_all(spark, sf_dir):
    got = records.mutate(_events(spark, sf_dir), ["/k=+5"], "/k>=50", value="props", matched_only=False)
    return got.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@_query("json_text_remove", f"SELECT event_id, CAST(NULL AS VARCHAR) AS k, '2' AS n FROM events WHERE {_PROPS} < 50")
def json_text_remove(spark, sf_dir):
    got = records.mutate(_events(spark, sf_dir), ["/n++", "rm:/k", "/n++"], "/k<50", value="props")
    return got.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.n").alias("n"))


@_query("json_text_project_mutate", f"SELECT event_id, {_PROPS} AS k, true AS flag FROM events WHERE {_PROPS} = 1 UNION ALL SELECT event_id, {_PROPS}, NULL FROM events WHERE {_PROPS} <> 1")
def json_text_project_mutate(spark, sf_dir):
    rows = _events(spark, sf_dir)
    got = records.output(rows, program("/k=1", fields=["/k"], mutations=["/flag=true"], matched_only=False), "props")
    return got.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.flag").cast("boolean").alias("flag"))


@_query("json_text_time", f"SELECT event_id, '1996-07-01T12:00:00Z' AS at FROM events WHERE {_PROPS} = 3")
def json_text_time(spark, sf_dir):
    got = records.mutate(_events(spark, sf_dir), ["time:/at=NOW"], "/k=3", value="props", now=NOW)
    return got.select("event_id", F.get_json_object("props", "$.at").alias("at"))


@_query("json_text_file", f"SELECT event_id, 'two\nlines' AS note, 'AAH/' AS raw FROM events WHERE {_PROPS} = 3")
def json_text_file(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:  # read here, before any record
        Path(folder, "note.txt").write_text("two\nlines")
        Path(folder, "raw.bin").write_bytes(b"\x00\x01\xff")
        got = records.mutate(_events(spark, sf_dir), ["textfile:/note=note.txt", "base64file:/raw=raw.bin"], "/k=3", value="props", files=True, folder=folder)
    return got.select("event_id", F.get_json_object("props", "$.note").alias("note"), F.get_json_object("props", "$.raw").alias("raw"))


@_query("sql_project_mutate", f"SELECT event_id, {_PROPS} AS k, {_PROPS} + 1 AS more FROM events WHERE {_PROPS} < 20")
def sql_project_mutate(spark, sf_dir):
    udfs.register(spark)
    rows = _events(spark, sf_dir).where(F.expr("record_matches(props, '/k<20')"))
    rows = rows.select("event_id", F.expr("record_project(props, '/k')").alias("p"), F.expr("record_mutate(props, '/k++')").alias("m"))
    return rows.select("event_id", F.get_json_object("p", "$.k").cast("int").alias("k"), F.get_json_object("m", "$.k").cast("int").alias("more"))


@_query("sql_frames", f"SELECT event_id, n AS record_index, CASE n WHEN 0 THEN {_PROPS} ELSE event_id END AS k FROM events, (VALUES (0), (1)) t(n) WHERE {_PROPS} = 5")
def sql_frames(spark, sf_dir):
    udfs.register(spark)
    rows = records.select(_events(spark, sf_dir), "/k=5", value="props")
    texts = rows.withColumn("text", F.concat("props", F.lit('\n\n{"k":\n'), "event_id", F.lit("\n}\n")))
    texts.createOrReplaceTempView("__texts")
    out = spark.sql("SELECT t.event_id, f.record_index, f.value FROM __texts t, LATERAL record_frames(t.text) f")
    return out.select("event_id", "record_index", F.get_json_object("value", "$.k").cast("long").alias("k"))


def _folder(spark: SparkSession) -> str:
    """A new name in the folder that executors share, or a local one for a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
    return f"{shared.rstrip('/')}/recordsieve-records-{uuid.uuid4().hex}"


@_query("text_framed", f"SELECT event_id, {_PROPS} AS k FROM events WHERE {_PROPS} >= 50")
def text_framed(spark, sf_dir):
    """Records over several lines, read back from files in splits."""
    path = _folder(spark)
    k = F.get_json_object("props", "$.k")
    _events(spark, sf_dir).select(F.concat(F.lit('{"event_id": '), "event_id", F.lit(',\n  "s": "}{",\n\n "k": ['), k, F.lit("]\n}\n"))).write.text(path)
    got = records.select(ndjson.framed(spark, path), "/k[]>=50")
    return got.select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), F.get_json_object("value", "$.k[0]").cast("int").alias("k"))


# counts and counters
@_query("typed_count", "SELECT count(*) AS matches FROM lineitem WHERE l_returnflag = 'R'")
def typed_count(spark, sf_dir):
    return typed.count(_table(spark, sf_dir, "lineitem"), '/l_returnflag="R"')


@_query("text_count", f"SELECT count(*) AS matches FROM events WHERE {_PROPS} >= 90")
def text_count(spark, sf_dir):
    return records.count(_events(spark, sf_dir), "/k>=90", value="props")


@_query("typed_counters", "SELECT count(*) AS seen, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS matched FROM orders")
def typed_counters(spark, sf_dir):
    return typed.counters(_table(spark, sf_dir, "orders"), '/o_orderstatus="F"')


@_query("text_counters", f"SELECT count(*) AS seen, CAST(count(*) FILTER ({_PROPS} = 5) AS BIGINT) AS matched, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events")
def text_counters(spark, sf_dir):
    return records.counters(_events(spark, sf_dir), "/k=5", value="props")


@_query("typed_decisions", "SELECT o_orderkey, coalesce(o_totalprice > 150000, false) AS matched FROM orders")
def typed_decisions(spark, sf_dir):
    return typed.decisions(_table(spark, sf_dir, "orders"), "/o_totalprice>150000", ["o_orderkey"])


# projections
@_query("typed_project", "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'")
def typed_project(spark, sf_dir):
    return typed.project(_table(spark, sf_dir, "orders"), ["/o_orderpriority", "/o_orderkey", "/o_custkey"], "/o_orderstatus!=F")


@_query("typed_project_mutate", "SELECT o_orderkey, o_custkey + 1 AS o_custkey, true AS done FROM orders WHERE o_orderstatus = 'F'")
def typed_project_mutate(spark, sf_dir):
    return typed.project_mutate(_table(spark, sf_dir, "orders"), ["/o_orderkey", "/o_custkey"], ["/o_custkey++", "/done=true"], '/o_orderstatus="F"')


@_query("typed_project_nested", "SELECT o_orderkey, o_totalprice AS total, (SELECT l_quantity FROM lineitem l WHERE l.l_orderkey = o.o_orderkey ORDER BY l_linenumber, l_quantity LIMIT 1) AS first FROM orders o")
def typed_project_nested(spark, sf_dir):
    o = _orders_with_items(spark, sf_dir).withColumn("items", F.sort_array("items"))
    got = typed.project(o, ["/o_orderkey", "/meta/sale/total", "/items/0/l_quantity"])
    return got.select("o_orderkey", F.col("meta.sale.total").alias("total"), F.get("items", F.lit(0)).getField("l_quantity").alias("first"))


@_query("text_project_nested", "SELECT o_orderkey, o_totalprice AS total FROM orders WHERE o_orderstatus = 'O'")
def text_project_nested(spark, sf_dir):
    o = ndjson.of_rows(_orders_with_items(spark, sf_dir), "o_orderkey")
    got = records.project(o, ["/meta/sale/total"], '/meta/status="O"')
    return got.select("o_orderkey", F.get_json_object("value", "$.meta.sale.total").cast("double").alias("total"))


# mutations
@_query("typed_mutate_set", "SELECT o_orderkey, 'done' AS o_orderstatus, true AS flag FROM orders WHERE o_orderstatus = 'F'")
def typed_mutate_set(spark, sf_dir):
    return typed.mutate(_table(spark, sf_dir, "orders"), ["/o_orderstatus=done", "/flag=true"], '/o_orderstatus="F"').select("o_orderkey", "o_orderstatus", "flag")


@_query("typed_mutate_step", "SELECT l_orderkey, l_linenumber + 10 AS l_linenumber, l_quantity - 2.5 AS l_quantity FROM lineitem")
def typed_mutate_step(spark, sf_dir):
    return typed.mutate(_table(spark, sf_dir, "lineitem"), ["/l_linenumber=+10", "/l_quantity=-2.5"]).select("l_orderkey", "l_linenumber", "l_quantity")


@_query("typed_mutate_step_fraction", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) + 0.25 AS DOUBLE) AS price FROM orders")
def typed_mutate_step_fraction(spark, sf_dir):
    return typed.mutate(_facts(spark, sf_dir), "/price=+0.25").select("o_orderkey", F.col("price").cast("double").alias("price"))


@_query("typed_mutate_remove", "SELECT o_orderkey, o_custkey FROM orders")
def typed_mutate_remove(spark, sf_dir):
    return typed.mutate(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["rm:/o_orderstatus"])


@_query("typed_mutate_unmatched", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders")
def typed_mutate_unmatched(spark, sf_dir):
    return typed.mutate(_table(spark, sf_dir, "orders"), ["/o_custkey++"], '/o_orderstatus="F"', matched_only=False).select("o_orderkey", "o_custkey")


@_query("typed_mutate_nested", "SELECT o_orderkey, 'x' AS priority, o_totalprice + 1 AS total, (SELECT sum(l_quantity + 1) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS quantity FROM orders o")
def typed_mutate_nested(spark, sf_dir):
    o = typed.mutate(_orders_with_items(spark, sf_dir), ["/meta/sale/priority=x", "/meta/sale/total++", "/items[]/l_quantity=+1", "rm:/labels/status"])
    return o.select("o_orderkey", F.col("meta.sale.priority").alias("priority"), F.col("meta.sale.total").alias("total"), F.when(F.size("items") > 0, F.aggregate("items", F.lit(0.0), lambda a, x: a + x["l_quantity"])).alias("quantity"))


@_query("text_mutate_nested", "SELECT o_orderkey, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS marks FROM orders o")
def text_mutate_nested(spark, sf_dir):
    o = ndjson.of_rows(_orders_with_items(spark, sf_dir), "o_orderkey")
    got = records.mutate(o, ["/items[]/l_returnflag=marked"])
    return got.select("o_orderkey", F.regexp_count("value", F.lit('"l_returnflag":"marked"')).cast("long").alias("marks"))


# limits
@_query("typed_max_records", "SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500) WHERE o_orderstatus = 'F'")
def typed_max_records(spark, sf_dir):
    return typed.limited(_table(spark, sf_dir, "orders"), '/o_orderstatus="F"', ["o_orderkey"], max_records=500).select("o_orderkey")


@_query("typed_max_matches", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20")
def typed_max_matches(spark, sf_dir):
    return typed.limited(_table(spark, sf_dir, "orders"), '/o_orderstatus="F"', ["o_orderkey"], max_matches=20).select("o_orderkey")


@_query("text_max_matches", f"SELECT event_id FROM events WHERE {_PROPS} >= 50 ORDER BY event_id LIMIT 25")
def text_max_matches(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return records.limited(rows, program("/k>=50"), "event_id", "props", max_matches=25)[0].select("event_id")


@_query("text_max_bytes", f"SELECT event_id FROM (SELECT *, sum(strlen(props) + 1) OVER (ORDER BY event_id) - strlen(props) - 1 AS before FROM events) WHERE before < 3000 AND {_PROPS} >= 50")
def text_max_bytes(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return records.limited(rows, program("/k>=50"), "event_id", "props", max_bytes=3000)[0].select("event_id")


@_query(
    "text_limit_precedence",
    f"""WITH e AS (SELECT event_id, strlen(props) + 1 AS size, {_PROPS} >= 50 AS hit, sum(strlen(props) + 1) OVER (ORDER BY event_id) AS upto, sum(CASE WHEN {_PROPS} >= 50 THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS hits FROM events),
    s AS (SELECT 'match' AS reason, 0 AS rank, min(event_id) + 1 AS stop FROM e WHERE hits = 20 UNION ALL SELECT 'record', 1, 60 UNION ALL SELECT 'byte', 2, min(event_id) + 1 FROM e WHERE upto >= 2000),
    f AS (SELECT reason, stop FROM s WHERE stop IS NOT NULL ORDER BY stop, rank LIMIT 1)
    SELECT count(*) AS seen, CAST(count(*) FILTER (hit) AS BIGINT) AS matched, CAST(sum(size) AS BIGINT) AS bytes, reason FROM e, f WHERE event_id < stop GROUP BY reason""",
)
def text_limit_precedence(spark, sf_dir):
    return records.limited(_events(spark, sf_dir), program("/k>=50"), "event_id", "props", max_records=60, max_matches=20, max_bytes=2000)[1]
