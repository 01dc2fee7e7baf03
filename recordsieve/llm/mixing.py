"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes are words of ``[^\\x20\\x09-\\x0D]+``. Sources in order of code point, null last, weigh 5, 2,
   1, repeating, and share ``share`` times all words; a target stops at ``cap`` times its source's
   size and the excess is reshared by weight (one water level over the sources finds this).
2. Documents fall into blocks of a source by a hash of their id, or of their text where that is null. A source's draw sequence is its
   blocks in a permuted order, over and over, until its target is reached; only the last block is
   drawn in part, document by document in hash order, its last document up to the word.
3. The exact numbers of drawn blocks are the root's quotas. Every tree node splits its quotas at
   random without replacement between two halves of its output shards (so the split of the sources
   is multivariate hypergeometric and sums are exact), down to one shard a leaf.
4. Each shard gets the next disjoint run of every source's draw sequence, and its rows are ordered
   by a hash.

Everything is DataFrame expressions. Hashes are of ids and a seed, so reruns agree. Documents are
never gathered by source: only blocks (at most ``MAX_BLOCKS`` a source) meet in a window, and the
documents of the one block that is drawn in part.

Defined cases: null or blank text has size 0 and is never taken; a null source is a source, the
last; repeated rows are each mixed, and rows of one id and size are told apart by their text; without words all
targets are 0; an empty table gives no rows; a column of docs with the name of a result is left
out of :func:`plan`'s rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import clashing, small, written

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
SEED = "mix-1"
BLOCK_WORDS = 65_536
MAX_BLOCKS = 1 << 20
SHARD_WORDS = 16_000_000
#: Hashes of tickets fall into 4096 buckets by their highest bits.
BUCKET_SHIFT = 52
WORD = r"[^\x20\x09-\x0D]+"
RESULTS = ["size", "source_size", "target", "taken", "copies"]


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _key(doc_id: str, text: str) -> Column:
    """A hash of the id; of the text where that is null."""
    return F.md5(F.concat(F.lit(SEED + "|"), F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("|"), F.md5(F.coalesce(text, F.lit("")))))))


def _number(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row a source: source, sid, source_size, target, blocks, epochs (full ones), rest (words of the last)."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    s = s.withColumn("sid", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1))
    rising = everything.orderBy((F.col("source_size") * cap / F.col("w")).asc(), "sid")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("n", F.row_number().over(rising))
    s = s.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    s = s.withColumn("over", F.col("source_size") * cap > F.col("w") * F.col("level"))
    s = s.withColumn("first", F.min(F.when(F.col("over"), F.col("n"))).over(everything))
    s = s.withColumn("level", F.min(F.when(F.col("n") == F.col("first"), F.col("level"))).over(everything))
    s = s.withColumn("target", F.when(F.col("n") >= F.col("first"), F.col("w") * F.col("level")).otherwise((F.col("source_size") * cap).cast("double")))
    words = F.floor("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    s = s.withColumn("epochs", full).withColumn("rest", words - F.col("epochs") * F.col("source_size"))
    s = s.withColumn("blocks", F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / BLOCK_WORDS))).cast("long"))
    return s.select("source", "sid", "source_size", "target", "blocks", "epochs", "rest")


def _tree(quotas: DataFrame, shards: int) -> DataFrame:
    """(sid, shard, quota) from the root's (sid, drawn): each level halves every node's range of shards.

    A node's left half gets its tickets with the least hashes, which is a draw without replacement. Hashes
    are counted by their highest bits first: only the tickets of the one bucket that the border crosses
    are put in order, so that not even the root meets in one task.
    """
    t = quotas.where("drawn > 0").select("sid", F.explode(F.sequence(F.lit(1), F.col("drawn"))).alias("ticket"))
    t = t.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(shards))
    for level in range(max(0, math.ceil(math.log2(shards)))):
        t = t.withColumn("hash", F.xxhash64(F.lit(SEED), F.lit(level), "lo", "sid", "ticket")).withColumn("bucket", F.shiftright("hash", BUCKET_SHIFT))
        node = Window.partitionBy("lo", "hi")
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        c = t.groupBy("lo", "hi", "bucket").agg(F.count(F.lit(1)).alias("c"))
        c = c.withColumn("left", F.floor(F.sum("c").over(node) * (mid - F.col("lo")) / (F.col("hi") - F.col("lo"))))
        c = c.withColumn("before", F.sum("c").over(node.orderBy("bucket")) - F.col("c"))
        t = t.join(small(c), ["lo", "hi", "bucket"])
        leaf = F.col("hi") - F.col("lo") <= 1
        crossed = ~leaf & (F.col("before") < F.col("left")) & (F.col("left") < F.col("before") + F.col("c"))
        rank = F.row_number().over(Window.partitionBy("lo", "hi", "bucket").orderBy("hash", "sid", "ticket"))
        border = t.where(crossed).withColumn("rank", F.col("before") + rank)
        t = t.where(~crossed).withColumn("rank", F.col("before") + F.col("c")).unionByName(border).withColumn("mid", mid)
        goes_left = leaf | (F.col("rank") <= F.col("left"))
        # the ticket only counts; which blocks a shard draws is settled by the quotas' order
        t = t.select("sid", "ticket", F.when(goes_left, F.col("lo")).otherwise(F.col("mid")).alias("lo"), F.when(leaf | ~goes_left, F.col("hi")).otherwise(F.col("mid")).alias("hi"))
        t = written(t, "mix-tickets")  # a level reads the one before, not the whole chain
    return t.groupBy("sid", F.col("lo").alias("shard")).agg(F.count(F.lit(1)).alias("quota"))


def _with_source(df: DataFrame, sources: DataFrame) -> DataFrame:
    s = sources.select(F.col("source").alias("__source"), *[F.col(c).alias(f"__{c}") for c in sources.columns if c != "source"])
    return df.join(small(s), F.col("__src").eqNullSafe(F.col("__source")), "left").drop("__source")


def plan(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", shard_words: int = SHARD_WORDS, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """docs with size, source_size, target, taken and copies: an array of (epoch, shard, words)."""
    base = docs.drop(*clashing(docs, RESULTS))
    base = base.withColumns({"size": word_count(text), "__src": F.col(source), "__key": _key(doc_id, text)})
    sizes = written(base.select(F.col("__src").alias("source"), "size", "__key"), "mix-sizes")
    sources = written(targets(sizes, weights, share, cap), "mix-targets")
    block = F.pmod(_number(F.col("__key")), F.col("__blocks")).alias("__block")
    blocks = _with_source(sizes.withColumnRenamed("source", "__src"), sources).select("__src", "__sid", "__epochs", "__rest", "__blocks", block, "size")
    blocks = blocks.groupBy("__sid", "__block").agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("__src", "__epochs", "__rest", "__blocks")])
    order = Window.partitionBy("__sid").orderBy(F.md5(F.concat(F.lit(SEED + "|"), F.coalesce("__src", F.lit("")), F.lit("|"), F.col("__block").cast("string"))), "__block")
    blocks = blocks.withColumn("at", F.row_number().over(order) - 1).withColumn("__before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    blocks = blocks.withColumn("__left", F.greatest(F.lit(0), F.col("__rest") - F.col("__before")))  # words that the last epoch may still take here
    blocks = written(blocks, "mix-blocks")
    drawn = blocks.groupBy("__sid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__left") > 0).alias("part"), F.first("__epochs").alias("epochs"))
    drawn = drawn.select(F.col("__sid").alias("sid"), "n", (F.col("n") * F.col("epochs") + F.col("part")).alias("drawn"))
    total = sources.agg(F.sum("target")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_words))
    quotas = _tree(drawn, shards)
    runs = quotas.withColumn("start", F.sum("quota").over(Window.partitionBy("sid").orderBy("shard")) - F.col("quota"))
    runs = runs.join(drawn.select("sid", "n"), "sid").select("sid", "shard", "n", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("quota") - 1)).alias("p"))
    draws = runs.select(F.col("sid").alias("__sid"), (F.col("p") % F.col("n")).alias("at"), F.struct(F.floor(F.col("p") / F.col("n")).alias("epoch"), F.col("shard")).alias("c"))
    draws = draws.groupBy("__sid", "at").agg(F.sort_array(F.collect_list("c")).alias("__draws"))
    blocks = written(blocks.withColumn("at", F.col("at").cast("long")).join(draws, ["__sid", "at"], "left").select("__sid", "__block", "words", "__left", "__draws"), "mix-draws")

    rows = _with_source(base, sources).withColumn("__block", block)
    rows = rows.join(small(blocks.withColumnRenamed("words", "__words")), ["__sid", "__block"], "left")
    whole = F.col("__left") >= F.col("__words")
    in_block = Window.partitionBy("__sid", "__block").orderBy("__key", "size", F.xxhash64(text)).rowsBetween(Window.unboundedPreceding, 0)
    cut = (F.col("__left") > 0) & ~whole
    part = rows.where(cut).withColumn("__extra", F.greatest(F.lit(0), F.least("size", F.col("__left") - F.sum("size").over(in_block) + F.col("size"))))
    rest = rows.where(~cut).withColumn("__extra", F.when(whole, F.col("size")).otherwise(F.lit(0)))
    both = rest.unionByName(part)
    copies = F.transform("__draws", lambda c: F.struct(c["epoch"].alias("epoch"), c["shard"].alias("shard"), F.when(c["epoch"] < F.col("__epochs"), F.col("size")).otherwise(F.col("__extra")).cast("long").alias("words")))
    copies = F.filter(F.coalesce(copies, F.array().cast("array<struct<epoch:bigint,shard:int,words:bigint>>")), lambda c: c["words"] > 0)
    names = [c for c in docs.columns if c not in clashing(docs, RESULTS)]
    return both.select(
        *names,
        "size",
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__epochs") * F.col("size") + F.col("__extra")).cast("long").alias("taken"),
        copies.alias("copies"),
    )


def mix(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The mixture: one row a copy with the columns of docs, ``shard`` and ``epoch``, grouped and shuffled by shard.

    The one document of a source that is drawn in part keeps its first words, white space included.
    """
    p = plan(docs, text=text, **how).withColumn("__c", F.explode("copies"))
    words = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + WORD), 0)
    cut = F.when(F.col("__c.words") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("__c.words").cast("int")), "")).otherwise(F.col(text))
    names = [c for c in docs.columns if c.lower() not in ("shard", "epoch", "size", "source_size", "target", "taken", "copies")]
    out = p.select(*[cut.alias(c) if c == text else F.col(c) for c in names], F.col("__c.shard").alias("shard"), F.col("__c.epoch").alias("epoch"))
    return out.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(SEED), "epoch", *names))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '|' || md5(coalesce(text, '')))) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS z FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s0),
s2 AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY z * 2 / w, sid) AS n,
         (CAST(sum(z) OVER () AS DOUBLE) * 1.5 - CAST(coalesce(sum(z) OVER (ORDER BY z * 2 / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2 AS DOUBLE))
         / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY z * 2 / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS lv FROM s2),
f AS (SELECT min(n) AS n0, arg_min(lv, n) AS l0 FROM s3 WHERE z * 2 > w * lv),
s AS (SELECT source, sid, z, target, CAST(least(1048576, greatest(1, ceil(z / 65536))) AS BIGINT) AS nb,
        CASE WHEN z > 0 THEN CAST(floor(floor(target) / z) AS BIGINT) ELSE 0 END AS e
      FROM (SELECT *, CASE WHEN n >= n0 THEN w * l0 ELSE CAST(z * 2 AS DOUBLE) END AS target FROM s3, f)),
r AS (SELECT *, CAST(floor(target) AS BIGINT) - e * z AS rest FROM s),
x AS (SELECT d.*, r.sid, r.z, r.target, r.e, r.rest, CAST('0x' || substr(h, 1, 8) AS BIGINT) % r.nb AS blk FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
b AS (SELECT sid, blk, rest, sum(size) AS words, md5('mix-1|' || coalesce(source, '') || '|' || CAST(blk AS VARCHAR)) AS bh FROM x GROUP BY sid, blk, rest, source),
b2 AS (SELECT sid, blk, greatest(0, rest - (sum(words) OVER (PARTITION BY sid ORDER BY bh, blk ROWS UNBOUNDED PRECEDING) - words)) AS lft FROM b),
y AS (SELECT x.*, b2.lft, sum(size) OVER (PARTITION BY x.sid, x.blk ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS c FROM x JOIN b2 ON x.sid = b2.sid AND x.blk = b2.blk)
SELECT doc_id, size, z AS source_size, target, CAST(e * size + greatest(0, least(size, lft - c + size)) AS BIGINT) AS taken FROM y
"""
