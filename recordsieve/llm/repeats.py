"""Removal of every repeated passage: suffix arrays of shards by induced sorting.

A text is its UTF-8 bytes. Each byte that lies in a string of ``length`` bytes which also starts
anywhere else in the corpus (the same text included) is removed; strings are judged on the input, so
all copies go and overlaps count.

Shards that need no exchange of their own:

1. Every window of ``length`` bytes is assigned to its anchor, the run of ``ANCHOR`` bytes in it whose
   hash is least (the leftmost of equals). The anchor depends on the window's content only, so equal
   windows have equal anchors at equal distances. Neighbouring windows of one anchor form a region.
2. Regions whose anchor occurs once have no repeats. Equal regions (by 128 bits) of one anchor repeat
   whole; only one of them goes on, as a partner.
3. The other regions of shared anchors, which are the edges of repeats, go to shards by anchor. A shard
   builds the suffix array of its regions and the permuted common prefixes; a window whose prefix
   with a neighbour reaches ``length`` bytes repeats.
4. An anchor with more than ``CROWD`` different regions (a passage inside very many texts) is not
   sent to one shard: its regions are cut by window distance into narrower ones, keyed by the
   longer bytes their windows share, and judged again. At the narrowest a region is one window.

Defined cases: null text is empty, and shorter texts than ``length`` have no windows; rows of equal
texts, repeated rows included, are copies of each other; null ids are allowed; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .cluster import small, text_batches, tidy, written
from .suffix_array import permuted_prefixes, suffix_array

LENGTH, ANCHOR = 200, 64
CROWD = 2048
#: Grid of window distances that crowded regions are cut to, one after the other.
GRIDS = (35, 9, 3, 1)
SHARD_BYTES = 1 << 20
_SALT = K.U64(0x2545F4914F6CDD1D)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _text_keys(t: K.Text) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text."""
    p = K.prefix_hash(t.data)
    a = K.span_hash(p, t.offsets[:-1], t.offsets[1:])
    q = K.prefix_hash(t.data ^ np.uint8(0x5A))  # the same kernel over other codes
    return a, K.mix(K.span_hash(q, t.offsets[:-1], t.offsets[1:]) ^ _SALT)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row, by blocks (van Herk)."""
    n = len(x)
    if n < w:
        return x[:0]
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    blocks = full.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def regions(t: K.Text, length: int = LENGTH, contents: bool = True):
    """Of each region: document, first window, last window, anchor's place, anchor hash, content hash.

    Without ``contents`` documents and content hashes are left out.
    """
    n = len(t.data)
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, np.empty(0, np.uint64), np.empty(0, np.uint64)
    p = K.prefix_hash(t.data)
    h = K.run_hash(p, ANCHOR)
    low = _sliding_min((h & K.U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), length - ANCHOR + 1)
    anchor = (low & K.U64(0xFFFFFFFF)).astype(np.int64)  # of the window that starts here
    valid = np.ones(len(anchor) + length, bool)  # whether the window that starts here ends inside its document
    for end in t.offsets[1:].tolist():
        valid[max(0, end - length + 1) : end] = False
    valid = valid[: len(anchor)]
    new = np.append(True, anchor[1:] != anchor[:-1])
    inner = t.offsets[1:-1]
    new[inner[inner < len(new)]] = True
    cut = np.flatnonzero(valid & (new | ~np.append(False, valid[:-1])))
    stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    a = anchor[cut]
    if not contents:
        return empty, cut, stop, a, h[a], np.empty(0, np.uint64)
    doc = np.searchsorted(t.offsets, cut, "right") - 1
    content = K.mix(K.span_hash(p, cut, stop + length) ^ K.mix((a - cut).astype(np.uint64) + _SALT))
    return doc, cut, stop, a, h[a], content


def _shared_anchors(docs: DataFrame, length: int) -> DataFrame:
    """(h) of the anchors that occur twice or more; every task counts its own first."""

    def run(batches):
        for b in batches:
            for t in K.slices(b.column(0)):
                h, count = np.unique(regions(t, length, contents=False)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(h), pa.array(count.astype(np.int64))], names=["h", "k"])

    return docs.select("text").mapInArrow(tidy(run), "h long, k long").groupBy("h").agg(F.sum("k").alias("k")).where("k > 1").select("h")


def _regions_of(docs: DataFrame, length: int) -> DataFrame:
    """(h, g, t1, t2, pos, anchor, doc_id): pos holds first window << 16 | windows - 1, anchor its distance."""

    def run(batches):
        for b in batches:
            ids = b.column(0)
            for t in K.slices(b.column(1)):
                doc, first, last, a, h, g = regions(t, length)
                if not len(doc):
                    continue
                t1, t2 = _text_keys(t)
                pos = ((first - t.offsets[doc]) << 16) | (last - first)
                yield pa.RecordBatch.from_arrays(
                    [_signed(h), _signed(g), _signed(t1[doc]), _signed(t2[doc]), pa.array(pos), pa.array((a - first).astype(np.int32)), ids.take(pa.array(t.first_row + doc))],
                    names=["h", "g", "t1", "t2", "pos", "anchor", "doc_id"],
                )

    return docs.mapInArrow(tidy(run), f"h long, g long, t1 long, t2 long, pos long, anchor int, doc_id {docs.schema[0].dataType.simpleString()}")


def _judged(rows: DataFrame) -> DataFrame:
    """rows with n (rows of equal regions), kinds (different regions of the anchor), rep (one of the equal ones)."""
    mark = F.xxhash64("t1", "t2", "pos")
    same = rows.groupBy("h", "g").agg(F.sum("c").alias("n"), F.min(mark).alias("least"))
    # both are dealt out once more, so that joins read exchanges alone and can be split where an anchor is hot
    kinds = same.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).hint("rebalance")
    same = written(same.join(kinds, "h"), "kinds")
    return rows.join(same, ["h", "g"]).withColumn("rep", mark == F.col("least")).drop("least")


def _whole(judged: DataFrame, length: int) -> DataFrame:
    """Spans of the regions that occur again as they are."""
    first = F.shiftright("pos", 16)
    return judged.where("n > 1").select("t1", "t2", first.alias("first"), (first + F.col("pos").bitwiseAND(0xFFFF) + length).alias("end"))


def _edges(judged: DataFrame) -> DataFrame:
    """The regions that share an anchor with different ones; of equal ones one."""
    return judged.where((F.col("kinds") > 1) & ((F.col("n") == 1) | F.col("rep")))


def _bytes_of(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """rows (t1, t2, h, c, pos, anchor, kinds) with the bytes of their regions."""
    ids = rows.select(F.col("doc_id").alias("__id")).distinct()
    chosen = docs.join(small(ids), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")

    def keyed(batches):
        for b in batches:
            for t in K.slices(b.column(0)):
                t1, t2 = _text_keys(t)
                yield pa.RecordBatch.from_arrays([_signed(t1), _signed(t2), b.column(0).slice(t.first_row, len(t))], names=["t1", "t2", "text"])

    texts = chosen.mapInArrow(tidy(keyed), "t1 long, t2 long, text string").join(small(rows.select("t1", "t2").distinct()), ["t1", "t2"], "left_semi")
    texts = texts.dropDuplicates(["t1", "t2"])
    wanted = rows.groupBy("t1", "t2").agg(F.collect_set(F.struct("h", F.col("n").alias("c"), "pos", "anchor", "kinds")).alias("r"))

    def cut(batches):
        for b in batches:
            out = {c: [] for c in ("t1", "t2", "h", "c", "pos", "anchor", "kinds", "bytes")}
            for t1, t2, text, found in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                for r in found:
                    s, more = r["pos"] >> 16, r["pos"] & 0xFFFF
                    for c, v in (("t1", t1), ("t2", t2), ("h", r["h"]), ("c", r["c"]), ("pos", r["pos"]), ("anchor", r["anchor"]), ("kinds", r["kinds"]), ("bytes", raw[s : s + more + length])):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[c], k) for c, k in zip(out, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()], strict=True)],
                names=list(out),
            )

    both = texts.join(wanted, ["t1", "t2"]).select("t1", "t2", "text", "r")
    return both.mapInArrow(tidy(cut), "t1 long, t2 long, h long, c long, pos long, anchor int, kinds long, bytes binary")


def _shard_repeats(parts: list[bytes], length: int) -> list[np.ndarray]:
    """Of each region the starts of windows that occur in another place of the shard."""
    sizes = np.array([len(p) for p in parts])
    data = np.frombuffer(b"\x00".join(parts) + b"\x00", np.uint8)
    begin = np.append(0, np.cumsum(sizes + 1))[:-1]
    t = data.astype(np.int64) + 2
    t[begin + sizes] = 1  # between regions: a symbol that no text has
    sa = suffix_array(np.append(t, 0), 258)[1:]
    owner_end = np.repeat(begin + sizes, sizes + 1)
    room = owner_end - np.arange(len(data))
    plcp = permuted_prefixes(data, room, sa, length)
    hit = plcp >= length
    before = np.full(len(data), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    hit[before[np.flatnonzero(hit)]] = True
    return [np.flatnonzero(hit[b : b + n]) for b, n in zip(begin, sizes, strict=True)]


def _shards(rows: DataFrame, length: int) -> DataFrame:
    """(t1, t2, first, end) of repeated bytes: rows meet by anchor, and whole anchors fill a suffix array."""

    def judged(held):
        found = _shard_repeats([r[4] for r in held], length)
        out = [[], [], [], []]
        for (t1, t2, _, pos, _), at in zip(held, found, strict=True):
            if len(at):
                brk = np.flatnonzero(np.diff(at) > 1)
                for a, b in zip(at[np.append(0, brk + 1)], at[np.append(brk, len(at) - 1)], strict=True):
                    for c, v in enumerate((t1, t2, (pos >> 16) + int(a), (pos >> 16) + int(b) + length)):
                        out[c].append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["t1", "t2", "first", "end"])

    def run(batches):
        held, size, last = [], 0, None
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if r[2] != last and size >= SHARD_BYTES:
                    yield judged(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
                last = r[2]
        if held:
            yield judged(held)

    rows = rows.select("t1", "t2", "h", "pos", "bytes").repartition("h").sortWithinPartitions("h")
    return rows.mapInArrow(tidy(run), "t1 long, t2 long, first long, end long")


def _narrowed(rows: DataFrame, grid: int, length: int) -> DataFrame:
    """Crowded regions cut to cells of ``grid`` window distances, under the hash of what a cell's windows share."""

    def run(batches):
        for b in batches:
            out = {c: [] for c in ("h", "g", "t1", "t2", "pos", "anchor", "c", "bytes")}
            for t1, t2, h, c, pos, anchor, raw in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                s0, more = pos >> 16, pos & 0xFFFF
                k = 0  # window k starts k bytes into the region, at distance anchor - k from the anchor
                while k <= more:
                    cell = (anchor - k) // grid
                    upto = min(more, anchor - cell * grid)
                    shared = raw[anchor - cell * grid : anchor - cell * grid - grid + 1 + length]
                    key = hashlib.blake2b(b"%d %d %d " % (h, cell, grid) + shared, digest_size=8)
                    part = raw[k : upto + length]
                    same = hashlib.blake2b(b"%d " % (anchor - k) + part, digest_size=8)
                    for name, v in (("h", key), ("g", same)):
                        out[name].append(int.from_bytes(v.digest(), "little", signed=True))
                    for name, v in (("t1", t1), ("t2", t2), ("pos", (s0 + k) << 16 | (upto - k)), ("anchor", anchor - k), ("c", c), ("bytes", part)):
                        out[name].append(v)
                    k = upto + 1
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return rows.select("t1", "t2", "h", "c", "pos", "anchor", "bytes").mapInArrow(tidy(run), "h long, g long, t1 long, t2 long, pos long, anchor int, c long, bytes binary")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(t1, t2, spans) of the texts with repeats, by text key, and the ids that may have such texts."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    text_batches(docs.sparkSession)
    if length % 8 or length <= ANCHOR or length - ANCHOR >= 1 << 16:
        raise ValueError(f"length is a multiple of 8 above {ANCHOR}")
    shared = _shared_anchors(docs, length).hint("rebalance")
    rows = written(_regions_of(docs, length).join(shared, "h").withColumn("c", F.lit(1).cast("long")), "regions")
    judged = written(_judged(rows), "judged")
    spans = [_whole(judged, length).distinct()]
    edges = written(_bytes_of(docs, _edges(judged), length), "edges")
    crowd = edges.where(F.col("kinds") > CROWD)
    spans.append(_shards(edges.where(F.col("kinds") <= CROWD), length))
    for grid in GRIDS:
        if not crowd.limit(1).count():
            break
        narrow = written(_judged(_narrowed(crowd, grid, length)), "narrow")
        spans.append(_whole(narrow, length))
        left = _edges(narrow).withColumn("c", F.col("n"))
        spans.append(_shards(left.where(F.col("kinds") <= CROWD), length))
        crowd = left.where(F.col("kinds") > CROWD)
    both = spans[0]
    for more in spans[1:]:
        both = both.unionByName(more)
    found = both.groupBy("t1", "t2").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("spans"))
    return written(found, "spans"), written(judged.where("n > 1 or kinds > 1").select("doc_id").distinct(), "ids")


def remove(docs: DataFrame, columns: list[str], doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The given columns with n_bytes, removed (maximal runs as [first, end)) and kept (the remaining bytes) of every row."""
    spans, ids = find(docs, doc_id, text, length)
    ids = small(ids.select(F.col("doc_id").alias("__id")))
    same = F.col(doc_id).eqNullSafe(F.col("__id"))
    k = len(columns)
    names = [f"c{i}" for i in range(k)]
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))

    def keyed(batches):
        for b in batches:
            for t in K.slices(b.column(k)):
                t1, t2 = _text_keys(t)
                yield pa.RecordBatch.from_arrays([*(c.slice(t.first_row, len(t)) for c in b.columns), _signed(t1), _signed(t2)], names=[*names, "text", "t1", "t2"])

    def cut(batches):
        pair = pa.list_(pa.int64())
        for b in batches:
            n_bytes, removed, kept = [], [], []
            for text_, found in zip(b.column(k).to_pylist(), b.column(k + 1).to_pylist() if b.num_columns > k + 1 else [None] * b.num_rows, strict=True):
                raw = (text_ or "").encode()
                runs, out, last = [], [], 0
                for s in found or ():
                    a, e = s["first"], s["end"]
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([a, e])
                for a, e in runs:
                    out.append(raw[last:a])
                    last = e
                n_bytes.append(len(raw))
                removed.append(runs)
                kept.append(b"".join([*out, raw[last:]]))
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(n_bytes, pa.int64()), pa.array(removed, pa.list_(pair)), pa.array(kept, pa.binary())], names=[*names, "n_bytes", "removed", "kept"])

    schema = f"{kinds}, n_bytes long, removed array<array<long>>, kept binary"
    clear = docs.join(ids, same, "left_anti").select(*columns, F.col(text).alias("text")).mapInArrow(tidy(cut), schema)
    some = docs.join(ids, same, "left_semi").select(*columns, F.col(text).alias("text")).mapInArrow(tidy(keyed), f"{kinds}, text string, t1 long, t2 long")
    some = some.join(spans, ["t1", "t2"], "left").select(*names, "text", "spans").mapInArrow(tidy(cut), schema)
    return clear.unionByName(some).withColumnsRenamed(dict(zip(names, columns, strict=True)))


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    found = remove(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
