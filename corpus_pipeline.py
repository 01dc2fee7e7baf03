"""A training-data pipeline over documents, in stages that are each written and read again.

Toxic documents go, one document of each near-duplicate group stays, documents with a whole window
of a benchmark item or with passages of two items go, what is left is mixed to the sources' targets, and the mixture is
sharded. Every stage works on all rows that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordsieve.llm import cluster, decontaminate, mixing, ngram_join, sharding, toxicity


def toxic_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the model of the labels outside the held-out fold doesn't call toxic."""
    return toxicity.reject(docs, toxicity.taught(spark, sf_dir))


def near_duplicates_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group: runs of five words, Jaccard similarity of 0.8 or more."""
    return ngram_join.deduplicate(docs)


def benchmark_passages_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without a whole window (eight words) of any benchmark item, and without windows of two items or more."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mixture draws, with the columns of docs; a cut document's n_chars follows its text."""
    apart = {c: f"__own_{i}" for i, c in enumerate(cluster.clashing(docs, [*mixing.RESULTS, "shard", "epoch"]))}
    mix = mixing.mix(docs.withColumnsRenamed(apart)).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return mix.drop("shard", "epoch").withColumnsRenamed({a: c for c, a in apart.items()}).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as read back from a compacted store."""
    return sharding.shard(docs).read()


STAGES = [
    ("toxicity", toxic_go),
    ("near duplicates", near_duplicates_go),
    ("decontamination", benchmark_passages_go),
    ("mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages. Scratch tables of a stage, and what it read, go when its rows are written."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with cluster.cleaning(spark) as spare:
            kept: list[str] = []
            docs = cluster.written(stage(spark, docs, sf_dir), name.replace(" ", "-"), kept)
            spare.remove(kept[0])
            spare += held
            held = kept
    return docs


#: Toxicity's model and the mixture's hashes of whole rows have no SQL; the tests hold every stage against plain Python.
ORACLE_SQL = None
