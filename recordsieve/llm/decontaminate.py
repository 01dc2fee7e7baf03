"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are maximal runs of letters, digits and non-ASCII characters after A-Z are lowered.
An item's windows are its runs of ``width`` consecutive words; an item with fewer words, but not
none, is one window. The scan hashes every window of the whole document text, probes a bit filter
and a sorted hash array, and verifies each hit against the words themselves, so a hash collision
never marks a word.

Defined cases: null or empty texts have no words and no hits; repeated rows are each judged;
items with null id or without words are ignored; ids of any type are carried as text; an empty
benchmark hits nothing; other columns, also such with names of results, are not read by
:func:`scan` and are kept by :func:`clean`.

The hash set grows with the benchmark only. Its number of words is counted first; beyond
``BROADCAST_WINDOWS`` the benchmark is split by item into broadcasts below that bound, which pass the
driver one at a time. A worker then holds one hash set at a time and ``HELD_BYTES`` of texts, which it
scans with every set, so a set is built once for that many bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .cluster import text_batches, tidy

WIDTH = 8
#: Windows in one broadcast hash set (about 100 bytes each with its words).
BROADCAST_WINDOWS = 1_000_000
#: Texts that a worker gathers before it goes through several hash sets.
HELD_BYTES = 64 << 20

HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("whole", T.BooleanType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
])

_HITS_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("whole", pa.bool_()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int64())))])


class HashSet:
    """Windows of the items: by length a bit filter and sorted hashes, and items by exact words."""

    def __init__(self, ids: list[str], texts: list[str], width: int = WIDTH):
        self.width = width
        self.items: dict[bytes, list[str]] = {}
        lengths: dict[int, set[int]] = {}
        for t in K.slices(pa.array(texts, pa.large_string())):
            w = K.words(t, K.WORD_ALNUM)
            h = K.word_hash(w)
            for d in range(len(t)):
                a, b = w.first[d], w.first[d + 1]
                if a == b:
                    continue
                k = min(width, b - a)
                hashes = K.window_hash(h[a:b], k)
                lengths.setdefault(int(k), set()).update(hashes.tolist())
                for i in range(a, b - k + 1):
                    self.items.setdefault(w.key(i, i + k), []).append(ids[t.first_row + d])
        self.sets = {}
        for k, found in sorted(lengths.items()):
            bits = max(16, (16 * len(found)).bit_length())
            s = np.sort(np.fromiter(found, np.uint64, len(found)))
            f = np.zeros(1 << bits, bool)
            f[(s >> K.U64(64 - bits)).astype(np.int64)] = True
            self.sets[k] = (s, f, bits)

    def hits(self, w: K.Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, end word, items) of every verified occurrence."""
        if not self.sets or not len(w.start):
            return
        h = K.word_hash(w)
        for k, (s, f, bits) in self.sets.items():
            g = K.window_hash(h, k)
            at = np.flatnonzero(f[(g >> K.U64(64 - bits)).astype(np.int64)] & K.same_doc(w.doc, k)) if len(g) else ()
            if not len(at):
                continue
            j = np.minimum(np.searchsorted(s, g[at]), len(s) - 1)
            for i in at[s[j] == g[at]].tolist():
                if (items := self.items.get(w.key(i, i + k))) is not None:
                    yield i, i + k, items


def _batch(text: pa.Array, blocks) -> pa.StructArray:
    """One struct a document; ``blocks`` yields hash sets, and hits of all of them count."""
    out = []
    held = list(K.slices(text))
    starts: list[list[int]] = [[] for _ in held]
    ends: list[list[int]] = [[] for _ in held]
    whole: list[set[int]] = [set() for _ in held]
    found: list[dict[int, set[str]]] = [{} for _ in held]
    for hash_set in blocks():
        for n, t in enumerate(held):
            w = K.words(t, K.WORD_ALNUM)
            for i, j, items in hash_set.hits(w):
                starts[n].append(i)
                ends[n].append(j)
                found[n].setdefault(int(w.doc[i]), set()).update(items)
                if j - i == hash_set.width:
                    whole[n].add(int(w.doc[i]))
    for n, t in enumerate(held):
        w = K.words(t, K.WORD_ALNUM)
        n_words = np.diff(w.first)
        hit = K.cover(np.array(starts[n], np.int64), np.array(ends[n], np.int64), len(w.start))
        for d in range(len(t)):
            if d not in found[n]:
                out.append({"n_words": int(n_words[d]), "n_hit": 0, "whole": False, "items": [], "spans": []})
                continue
            a, b = w.first[d], w.first[d + 1]
            s, e = K.runs(hit[a:b])
            spans = [[int(w.start[a + x] - t.offsets[d]), int(w.end[a + y - 1] - t.offsets[d])] for x, y in zip(s, e, strict=True)]
            out.append({"n_words": int(b - a), "n_hit": int(hit[a:b].sum()), "whole": d in whole[n], "items": sorted(found[n][d]), "spans": spans})
    return pa.array(out, _HITS_ARROW)


def _held(batches, at: int, several: bool):
    """The batches as they come, or, where several hash sets follow each other, gathered to ``HELD_BYTES``."""
    waiting, size = [], 0
    for b in batches:
        waiting.append(b)
        size += b.column(at).nbytes
        if not several or size >= HELD_BYTES:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting, size = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _broadcast(benchmark: DataFrame, width: int) -> list:
    """The items' texts as broadcasts of at most about BROADCAST_WINDOWS words each."""
    sc = benchmark.sparkSession.sparkContext
    text_batches(benchmark.sparkSession)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    n = -(-2 * total // BROADCAST_WINDOWS) if total > BROADCAST_WINDOWS else 1
    out = []
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        out.append(sc.broadcast(([r[0] for r in rows], [r[1] for r in rows])))
    return out


_built: dict = {}


def _hash_sets(blocks: list, width: int):
    """One hash set is kept by the worker; of several, one at a time is in memory."""

    def each():
        for b in blocks:
            key = (b._path if hasattr(b, "_path") else id(b), width)
            if key not in _built:
                _built.clear()
                _built[key] = HashSet(*b.value, width)
                b.__dict__.pop("_value", None)
            yield _built[key]

    return each


def scan(docs: DataFrame, benchmark: DataFrame, columns: list[str], text: str = "text", width: int = WIDTH, name: str = "hits") -> DataFrame:
    """The given columns of docs with a struct ``name``: n_words, n_hit, items, byte spans of hit words."""
    blocks = _broadcast(benchmark, width)

    def run(batches):
        sets = _hash_sets(blocks, width)
        for t in _held(batches, len(columns), len(blocks) > 1):
            found = _batch(_flat(t.column(len(columns))), sets)
            yield pa.RecordBatch.from_arrays([*map(_flat, t.columns[:-1]), found], names=[*columns, name])

    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField(name, HITS)])
    return docs.select(*columns, F.col(text).alias("__text")).mapInArrow(tidy(run), schema)


def contaminated(hits, min_items: int = 2) -> bool:
    """Whether a document goes: a whole window of any item occurs in it, or windows of ``min_items`` items.

    A short item alone, of fewer words than a window, is no reason: its few words stand in clean texts too.
    """
    return hits["whole"] or len(hits["items"]) >= min_items


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WIDTH, min_items: int = 2, remove: str = "documents") -> DataFrame:
    """docs without the :func:`contaminated` documents, or, with remove="spans", without hit spans.

    All columns of docs are returned as they are; with spans the text column is shortened.
    """
    blocks = _broadcast(benchmark, width)
    at = docs.columns.index(text)
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")

    def run(batches):
        sets = _hash_sets(blocks, width)
        for t in _held(batches, at, len(blocks) > 1):
            column = _flat(t.column(at))
            found = _batch(column, sets).to_pylist()
            if remove == "documents":
                yield from t.filter(pa.array([not contaminated(f, min_items) for f in found], pa.bool_())).to_batches()
                continue
            new = [x if not f["spans"] else _cut(x, f["spans"]) for x, f in zip(column.to_pylist(), found, strict=True)]
            yield from t.set_column(at, t.schema.field(at), pa.array(new, t.schema.field(at).type)).to_batches()

    return docs.mapInArrow(tidy(run), docs.schema)


def _cut(text: str, spans: list[list[int]]) -> str:
    raw, out, last = text.encode(), [], 0
    for s, e in spans:
        out.append(raw[last:s])
        last = e
    return b"".join([*out, raw[last:]]).decode()


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = scan(docs, bench, ["doc_id"])
    n = F.size("hits.items").cast("long")
    return hits.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        F.col("hits.n_hit").alias("n_hit"),
        n.alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hits.items"), ","), 256).alias("items_sha256"),
        (n >= 2).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(8, len(w)) AS k, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) > 0 AND item_id IS NOT NULL)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dw.doc_id, dw.k, dw.i, win.item_id FROM dw JOIN win ON dw.g = win.g AND dw.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(it.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
