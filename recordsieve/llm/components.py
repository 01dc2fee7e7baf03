"""Distributed connected components by alternating large and small stars.

Only DataFrame operations. Each round is written to the shared folder, so a lost executor costs a
reread. Minima are pre-aggregated before they meet their neighbours, and dealt out once more, so that the join
that hands a minimum to the neighbours of a node reads nothing but exchanges and adaptive execution can
split it where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import drop, written

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (a, b), a > b: every node's kept neighbours are hung under its minimum."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).hint("rebalance")
        return both.join(low, "a").where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(low.hint("rebalance"), "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(low.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node of an edge; label is the smallest node of its component.

    Self loops, repeated and null edges change nothing. No edges: no rows.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    own: list[str] = []
    e = written(e, "edges", own)
    state = _state(e)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        old, own = own, []
        e = written(_star(_star(e, True).distinct(), False).distinct(), "edges", own)
        drop(spark, old)
        last, state = state, _state(e)
        if state == last:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
