"""URL filters by redirect equivalence.

A rule is (verdict, host, path): it fits its host and all subdomains when the url's path starts
with the rule's. The longest fitting rule judges a url; of equally long ones an allow. Pages that
no rule fits are judged by their aliases: redirect (meta refresh) and canonical-link edges join
urls to equivalence classes by distributed connected components, a block of any alias blocks the
class, and an explicit allow of any alias takes precedence. Without either the verdict is allow.

All of it is DataFrame expressions. Defined cases: null urls, and such without ``://``, have an
empty host and path, no rule and no aliases; null html has no edges; the fragment of a url is no
part of its identity; repeated rows are each judged; other columns are not read. The rules are a list on the
driver; a table of up to ``MAX_RULES`` is broadcast, a longer one is joined by a shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import small, written
from .components import components

MAX_RULES = 100_000

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = r"(?is)<{0}\b[^>]*\b{1}\s*=\s*[\"']?{2}\b[^>]*>"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(urls: DataFrame, rules: list[tuple[str, str, str]], keep: list[str]) -> DataFrame:
    """The columns to keep of urls (host, path, ..) with the longest fitting rule as text and its verdict; both null without one.

    A host has one domain of each number of labels, and the rules stand in a table by host: for every number
    of labels that rules have, one join finds the rules of a url's domain. So a url's cost does not grow with the
    number of rules, but for those of one host.
    """
    spark, found = urls.sparkSession, []
    given = F.from_json(F.lit(json.dumps([{"v": v, "h": h, "p": p} for v, h, p in rules])), "array<struct<v: string, h: string, p: string>>")
    table = spark.range(1).select(F.explode(given).alias("r")).select("r.*")
    table = table.groupBy("h").agg(F.collect_set(F.struct((-F.length(F.concat("h", "p"))).alias("size"), (F.col("v") != "allow").alias("late"), F.concat("h", "p").alias("rule"), "v", "p")).alias("found"))
    out = urls.select(*keep, "host", "path")
    for labels in sorted({h.count(".") + 1 for _, h, _ in rules}):
        some = table.where(F.length("h") - F.length(F.replace("h", F.lit("."), F.lit(""))) == labels - 1).select(F.col("h").alias(f"__h{labels}"), F.col("found").alias(f"__r{labels}"))
        out = out.join(F.broadcast(some) if len(rules) <= MAX_RULES else some, F.substring_index("host", ".", -labels) == F.col(f"__h{labels}"), "left")
        found.append(F.filter(F.coalesce(f"__r{labels}", F.array().cast(some.schema[1].dataType)), lambda r: F.col("path").startswith(r["p"])))
    best = F.array_min(F.concat(*found)) if found else F.lit(None).cast("struct<rule: string, v: string>")
    return out.withColumn("__best", best).select(*keep, "host", "path", F.col("__best.rule").alias("rule"), F.col("__best.v").alias("verdict"))


def _node(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)#.*$", ""))


def _targets(html: Column) -> Column:
    """Hrefs of canonical links and urls of meta refreshes."""
    link = F.transform(F.regexp_extract_all(html, F.lit(_TAG.format("link", "rel", "canonical")), 0), lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    meta = F.transform(F.regexp_extract_all(html, F.lit(_TAG.format("meta", "http-equiv", "refresh")), 0), lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    return F.transform(F.concat(link, meta), lambda t: F.replace(t, F.lit("&amp;"), F.lit("&")))


def _absolute(t: Column, base: Column) -> Column:
    scheme = F.substring_index(base, "://", 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(_rest(base), r"^([^/?#]*)", 1))
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    return (
        F.when(F.length(t) == 0, F.lit(None).cast("string"))
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("/"), F.concat(origin, t))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), t))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): alias edges that the pages' own markup states, between different urls."""
    p = pages.where("url is not null and html is not null").where(F.lower("html").rlike("canonical|refresh"))
    p = p.select(_node(F.col("url")).alias("src"), F.col("url").alias("base"), F.explode(_targets(F.col("html"))).alias("t"))
    return p.select("src", _node(_absolute(F.col("t"), F.col("base"))).alias("dst")).where("src is not null and dst is not null and src <> dst")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict, alias of every page.

    ``redirects`` (src, dst) adds redirects known from elsewhere, such as a crawl's log. ``alias`` is
    the smallest url of the page's class, or null where it has none.
    """
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(_node(F.col("src")).alias("src"), _node(F.col("dst")).alias("dst")).where("src is not null and dst is not null"))
    classes = components(edges, "src", "dst")
    judged = fitting(classes.withColumns({"host": host(F.col("node")), "path": path(F.col("node"))}), rules, ["label"])
    said = judged.groupBy("label").agg(F.max((F.col("verdict") == "allow").cast("int")).alias("allows"), F.max((F.col("verdict") == "block").cast("int")).alias("blocks"))
    said = said.select("label", F.when(F.col("allows") == 1, "allow").when(F.col("blocks") == 1, "block").alias("by_class"))
    nodes = small(written(classes.join(said, "label").select(F.col("node").alias("__node"), F.col("label").alias("alias"), "by_class"), "aliases"))
    out = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), _node(F.col("url")).alias("__node"))
    out = fitting(out, rules, ["page_id", "url", "__node"]).join(nodes, "__node", "left")
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("verdict", "by_class", F.lit("allow")).alias("verdict"), "alias")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH RECURSIVE p AS (SELECT page_id, url, html, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest,
             CASE WHEN position('://' IN url) > 0 THEN regexp_replace(url, '(?s)#.*$', '') END AS node FROM pages),
tags AS (SELECT node, url, unnest(list_concat(
           list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
           list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS t
         FROM p WHERE node IS NOT NULL AND html IS NOT NULL),
tg AS (SELECT node AS src, replace(t, '&amp;', '&') AS t, split_part(url, '://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS h,
         regexp_extract(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '^(.*/)', 1) AS folder FROM tags WHERE t <> ''),
e0 AS (SELECT src, regexp_replace(CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t
         WHEN starts_with(t, '/') THEN scheme || '://' || h || t ELSE scheme || '://' || h || CASE WHEN folder = '' THEN '/' ELSE folder END || t END, '(?s)#.*$', '') AS dst FROM tg),
e AS (SELECT src, dst FROM e0 WHERE src <> dst UNION SELECT dst, src FROM e0 WHERE src <> dst),
reach(a, b) AS (SELECT src, src FROM e UNION SELECT reach.a, e.dst FROM reach JOIN e ON e.src = reach.b),
rules(v, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT DISTINCT node AS url FROM p WHERE node IS NOT NULL UNION SELECT src FROM e),
hp AS (SELECT url, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM u),
fit AS (SELECT url, host, path, r.v, r.h || r.p AS rule, row_number() OVER (PARTITION BY url ORDER BY length(r.h || r.p) DESC NULLS LAST, r.v, r.h || r.p) AS n
        FROM hp LEFT JOIN rules r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)),
best AS (SELECT * FROM fit WHERE n = 1),
cls AS (SELECT a, max(v = 'allow') AS allows, max(v = 'block') AS blocks FROM reach JOIN best ON best.url = reach.b GROUP BY a)
SELECT p.page_id, coalesce(best.host, '') AS host, coalesce(best.path, '') AS path, best.rule,
       coalesce(best.v, CASE WHEN cls.allows THEN 'allow' WHEN cls.blocks THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best ON best.url = p.node LEFT JOIN cls ON cls.a = p.node
"""
