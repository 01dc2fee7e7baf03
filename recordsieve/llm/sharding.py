"""Size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder in the shared file system:

* ``data/<id>/part-*.parquet``: immutable shard files; one append writes one small shard a task.
* ``manifest/lists/<id>.json``: immutable lists of up to ``LIST`` shards each (path, bytes, rows).
* ``manifest/v<20 digits>.json``: a version: the lists that together name its live shards. A commit writes lists
  for new shards, and for what is left of lists that lost some, and names all others again; so an append
  costs as much as it brings. A version is committed by renaming a finished temporary file to its name, which fails
  if the name exists: two writers cannot commit the same version, readers see whole versions only.
  That holds on HDFS and on local file systems; an object store whose rename replaces needs one writer.

Compaction takes runs of similarly sized shards: tier t holds sizes below ``target / fanout**t``
(tier 0 is done). A tier with at least ``min_run`` shards is merged, file by whole file and without
a shuffle, into about ``bytes / target`` files; the last partial run is merged across tiers.
Reading the store reads the files that the newest (or a given) manifest names.

Defined cases: rows are kept exactly, nulls, empty texts, repeated rows and columns of any name
included; an empty append commits a version without new shards; an empty store reads as no rows
of its schema. A lost executor's task is rerun by Spark's committer; a job that dies before the
rename leaves files that no manifest names, which :meth:`ShardStore.vacuum` removes after a time of grace.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import scratch

TARGET_BYTES = 128 << 20
FANOUT = 4
MIN_RUN = 2
#: Seconds that a file no manifest names is kept: longer than any write takes until its commit.
GRACE = 7 * 86400
#: Shards in a list.
LIST = 10_000


class CommitConflict(RuntimeError):
    """Another writer committed the version first; read it again and retry."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, min_run: int = MIN_RUN):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.fanout, self.min_run = target_bytes, fanout, min_run
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, value) -> None:
        out = self._fs.create(self._path(path), False)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()

    def manifest(self, version: int | None = None) -> dict:
        """The given or newest manifest: version, schema, lists (path to shards) and shards."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "schema": None, "lists": {}, "shards": []}
        found = json.loads(self._text(f"{self.root}/manifest/v{version or versions[-1]:020d}.json"))
        lists = {name: [Shard(**s) for s in json.loads(self._text(f"{self.root}/manifest/lists/{name}"))] for name in found["lists"]}
        return found | {"lists": lists, "shards": [s for shards in lists.values() for s in shards]}

    def _commit(self, base: dict, schema: str, shards: list[Shard]) -> dict:
        version = base["version"] + 1
        live = set(shards)
        lists = [name for name, held in base["lists"].items() if held and live.issuperset(held)]
        live.difference_update(s for name in lists for s in base["lists"][name])
        more = [s for s in shards if s in live]
        for a in range(0, len(more), LIST):
            lists.append(f"{uuid.uuid4().hex}.json")
            self._put(f"{self.root}/manifest/lists/{lists[-1]}", [asdict(s) for s in more[a : a + LIST]])
        temp = f"{self.root}/manifest/.{uuid.uuid4().hex}.tmp"
        self._put(temp, {"version": version, "schema": schema, "lists": lists})
        final = self._path(f"{self.root}/manifest/v{version:020d}.json")
        # a newer version may stand where a vacuum has removed this one
        if any(v >= version for v in self._versions()) or not self._fs.rename(self._path(temp), final):
            self._fs.delete(self._path(temp), False)
            raise CommitConflict(f"version {version} exists")
        return self.manifest(version)

    # shards

    def _write(self, df: DataFrame) -> list[Shard]:
        """The frame as new files, one a non-empty partition, with their sizes and rows."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        sizes = {}
        for s in self._fs.listStatus(self._path(folder)):
            if s.getPath().getName().startswith("part-"):
                sizes[s.getPath().toString()] = s.getLen()
        counted = self.spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("p")).count().collect()
        rows = {r["p"].rsplit("/", 1)[-1]: r["count"] for r in counted}
        return sorted((Shard(p, n, rows[p.rsplit("/", 1)[-1]]) for p, n in sizes.items() if rows.get(p.rsplit("/", 1)[-1])), key=lambda s: s.path)

    def append(self, df: DataFrame) -> dict:
        """Arrivals as small immutable shards and a new version that names them too."""
        base = self.manifest()
        schema = df.schema.json()
        if base["schema"] and [(f.name, f.dataType) for f in T.StructType.fromJson(json.loads(base["schema"]))] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError("the arrivals' columns differ from the store's")
        return self._commit(base, base["schema"] or schema, [*base["shards"], *self._write(df)])

    def tier(self, size: int) -> int:
        """0 for finished shards (at least half the target); each further tier is ``fanout`` times smaller."""
        t, least = 0, self.target / 2
        while size < least and t < 32:
            t, least = t + 1, least / self.fanout
        return t

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """What compaction merges: by tier, smallest first; what a tier leaves goes up with the next."""
        by_tier: dict[int, list[Shard]] = {}
        for s in shards:
            by_tier.setdefault(self.tier(s.bytes), []).append(s)
        out, left = [], []
        for t in sorted((t for t in by_tier if t), reverse=True):
            run = left + by_tier[t]
            if len(run) >= self.min_run and sum(s.bytes for s in run) * self.fanout >= self.target:
                out.append(run)
                left = []
            else:
                left = run
        if len(left) >= self.min_run:
            out.append(left)
        return out

    def compact(self) -> dict:
        """Merge every run into target-sized files; one commit swaps inputs for outputs."""
        base = self.manifest()
        runs = self.runs(base["shards"])
        if not runs:
            return base
        schema = T.StructType.fromJson(json.loads(base["schema"]))
        merged, gone = [], set()
        for run in runs:
            files = max(1, round(sum(s.bytes for s in run) / self.target))
            merged += self._write(self.spark.read.schema(schema).parquet(*[s.path for s in run]).coalesce(files))
            gone |= {s.path for s in run}
        return self._commit(base, base["schema"], [*(s for s in base["shards"] if s.path not in gone), *merged])

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> None:
        """Delete manifests older than the ``keep`` newest, and the files that only those name.

        Files that no manifest names may belong to a write that is still to be committed; they go when they
        have not been changed for ``grace`` seconds.
        """
        versions = self._versions()
        old, kept = ([self.manifest(v) for v in part] for part in (versions[:-keep], versions[-keep:]))
        named = {s.path for m in kept for s in m["shards"]}
        gone = {s.path for m in old for s in m["shards"]} - named
        listed = {name for m in kept for name in m["lists"]}
        unlisted = {name for m in old for name in m["lists"]} - listed
        for m in old:
            self._fs.delete(self._path(f"{self.root}/manifest/v{m['version']:020d}.json"), False)
        before = (time.time() - grace) * 1000
        for f in self._files("manifest/lists"):
            name = f.getPath().getName()
            if name in unlisted or name not in listed and f.getModificationTime() < before:
                self._fs.delete(f.getPath(), False)
        for d in self._files("data"):
            files = [f for f in self._fs.listStatus(d.getPath()) if f.getPath().getName() != "_SUCCESS"]
            left = [f for f in files if f.getPath().toString() in named or f.getPath().toString() not in gone and f.getModificationTime() >= before]
            if not left and (files or d.getModificationTime() < before):
                self._fs.delete(d.getPath(), True)
                continue
            for f in files:
                if f not in left:
                    self._fs.delete(f.getPath(), True)

    def _files(self, folder: str) -> list:
        at = self._path(f"{self.root}/{folder}")
        return list(self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if not found["schema"]:
            raise ValueError("the store has no version yet")
        schema = T.StructType.fromJson(json.loads(found["schema"]))
        if not found["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s.path for s in found["shards"]])


def shard(docs: DataFrame, root: str | None = None, target_bytes: int = TARGET_BYTES) -> ShardStore:
    """A store of docs: appended as small shards, compacted, older versions removed."""
    spark = docs.sparkSession
    store = ShardStore(spark, root or scratch(spark, "store"), target_bytes)
    store.append(docs)
    store.compact()
    store.vacuum()
    return store


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """The documents as read back from the compacted store."""
    back = shard(spark.read.parquet(f"{sf_dir}/documents.parquet")).read()
    return back.select("doc_id", "lang", "source", "n_chars", F.length("text").cast("long").alias("text_chars"), F.md5("text").alias("text_md5"))


OP1_SQL = "SELECT doc_id, lang, source, n_chars, CAST(length(text) AS BIGINT) AS text_chars, md5(text) AS text_md5 FROM documents"
