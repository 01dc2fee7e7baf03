"""N-gram Jaccard self-join: size-banded tiles with hashed bitmap signatures, then exact sets.

A document's set is its distinct runs of ``k`` words ([^\\x20\\x09-\\x0D]+, A-Z lowered); with fewer
words the whole sequence is its one element; without words it is empty and linked with nothing.
Two documents link when 100 * |A and B| >= percent * |A or B|. The result is whole: no cap on
partners, groups or lengths.

1. Documents of equal sets (by 128 bits of digest) are one node, which gets a number.
2. In any common order of elements, linked sets share one of each set's first n - ceil(t n) + 1. The
   order is by length, then hash: long runs of words are rare, so few documents meet by chance. But
   elements found in many prefixes come last (a bounded broadcast list that only affects speed), so a
   passage or line that very many documents share is no meeting point.
3. Nodes that meet at an element are first held against the element's least and greatest node (stars, linear
   in the members). Verified links are merged by connected components.
4. Members of an element that are still in different components meet in tiles: a size band and the
   next one, in blocks of at most ``BLOCK``; a pair is judged in the tile of its smaller set's band. There, bitmap
   signatures about as wide as the sets are xor-ed; the bit count bounds the overlap from above. A task answers
   with a forest of the admitted pairs.
5. Each tree of that forest is a cluster that holds both ends of every admitted pair. Blocks of a
   cluster, by size band, form tiles whose nodes send their sorted arrays once, for the exact intersections
   of the admitted pairs. A tile answers with the links that connect its nodes, not with all pairs.

Defined cases: null text is an empty set; null ids take part, and a component's id is its smallest
id that is not null (null if none); repeated rows are copies; other columns are not read by
:func:`link` and kept as they are by :func:`deduplicate`; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .cluster import arrow_rows, drop, small, text_batches, tidy, written
from .components import components

SHINGLE, PERCENT = 5, 80
#: Elements met by more rows than this in prefixes may be put last, at most so many of them.
HEAVY_ROWS, HEAVY_LIST = 256, 200_000
LOCAL = 4
#: Repeated elements whose bit filter (of fixed size) is broadcast.
FILTER_ROWS, FILTER_BITS = 8_000_000, 27
#: Members in a tile's block.
BLOCK = 512
#: Nodes in a block whose sets meet in a tile.
SET_BLOCK = 256
#: Admitted pairs that a task holds before it joins them to its forest; rows of sets in an Arrow batch.
WAITING, SET_ROWS = 1 << 17, 256
#: Bits of a signature at most. Unrelated sets of more than 1.5 times as many elements can't be told apart by it.
MAX_BITS = 1 << 15


def shingle_sets(column: pa.Array, k: int):
    """The sorted distinct elements of each document: 6 bits that fall with the words' bytes, 58 of hash.

    Their order is the join's common order: long runs, which are rare, come first.
    """
    for t in K.slices(column):
        w = K.words(t, K.WORD_LOWER)
        h = K.word_hash(w)
        size = np.append(0, np.cumsum(w.end - w.start))
        ordered = lambda g, n: (np.maximum(0, 63 - n).astype(np.uint64) << K.U64(58)) | (g >> K.U64(6))
        g = ordered(K.window_hash(h, k), (size[k:] - size[:-k])) if len(h) >= k else h[:0]
        for d in range(len(t)):
            a, b = w.first[d], w.first[d + 1]
            if b - a >= k:
                yield np.unique(g[a : b - k + 1])
            elif b > a:
                yield ordered(K.window_hash(h[a:b], int(b - a)), size[b : b + 1] - size[a])
            else:
                yield np.empty(0, np.uint64)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = int(K.mix(s + K.U64(1)).sum(dtype=np.uint64))
        b = int(K.mix(s ^ K.U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(a ^ len(s)), signed(b)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))


def _prefixes(docs: DataFrame, k: int, percent: int, heavy) -> DataFrame:
    """(doc_id, n, d1, d2, sig, tokens) of every row; d1 and d2, the set's digest, are null for empty sets."""

    def run(batches):
        late = heavy.value if heavy is not None else None
        for b in batches:
            ns, firsts, seconds, sigs, tokens = [], [], [], [], []
            for s in shingle_sets(b.column(1), k):
                ns.append(len(s))
                if not len(s):
                    firsts.append(None)
                    seconds.append(None)
                    sigs.append(None)
                    tokens.append(s)
                    continue
                x, y = _digest(s)
                firsts.append(x)
                seconds.append(y)
                sigs.append(_signature(s))
                p = prefix_length(len(s), percent)
                first = s[:p]
                if late is not None and _isin(first, late).any():
                    m = _isin(s, late)
                    first = np.concatenate([s[~m], s[m]])[:p]
                tokens.append(first)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ns, pa.int64()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), pa.array(sigs, pa.binary()), _lists(tokens)],
                names=["doc_id", "n", "d1", "d2", "sig", "tokens"],
            )

    return docs.mapInArrow(tidy(run), f"doc_id {docs.schema[0].dataType.simpleString()}, n long, d1 long, d2 long, sig binary, tokens array<long>")


def _isin(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    j = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[j] == x


def _heavy(rows: DataFrame) -> np.ndarray:
    """Elements of very many prefixes, counted where a batch of rows holds one ``LOCAL`` times or more."""

    def run(batches):
        for b in batches:
            token, count = np.unique(b.column(0).flatten().to_numpy(), return_counts=True)
            often = count >= LOCAL
            yield pa.RecordBatch.from_arrays([pa.array(token[often]), pa.array(count[often])], names=["token", "c"])

    found = rows.select("tokens").mapInArrow(tidy(run), "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    found = found.where(F.col("c") > HEAVY_ROWS).orderBy(F.desc("c"), "token").select("token").limit(HEAVY_LIST)
    return np.sort(np.array([r[0] for r in found.collect()], np.int64).view(np.uint64))


def _members(rows: DataFrame, nodes: DataFrame, own: list[str]) -> DataFrame:
    """(token, node) of elements that two rows or more have in their prefixes, among one row a node.

    The repeated elements are found by counting. Where they are at most ``FILTER_ROWS``, a bit filter of
    fixed size goes to the rows and drops most others before the shuffle; beyond that all rows
    are joined. What the filter lets through by chance is sorted out by the caller's exact grouping.
    """
    lead = small(nodes.select("node", F.col("d1").alias("__d1"), F.col("d2").alias("__d2"), F.col("doc_id").alias("__lead")))
    one = rows.join(lead, (F.col("d1") == F.col("__d1")) & (F.col("d2") == F.col("__d2")) & F.col("doc_id").eqNullSafe(F.col("__lead"))).select("node", "tokens")
    repeated = one.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    repeated = written(repeated, "repeated", own)
    every = one.select("node", F.explode("tokens").alias("token"))
    if repeated.count() > FILTER_ROWS:
        return every.join(repeated, "token")
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for batch in repeated.toArrow().to_batches():
        at = K.mix(batch.column(0).to_numpy().view(np.uint64)) >> K.U64(64 - FILTER_BITS)
        np.bitwise_or.at(bits, (at >> K.U64(3)).astype(np.int64), (1 << (at & K.U64(7)).astype(np.int64)).astype(np.uint8))
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for b in batches:
            node, tokens = b.column(0).to_numpy(), b.column(1)
            flat = tokens.flatten().to_numpy()
            owner = np.repeat(node, np.diff(tokens.offsets.to_numpy()))
            at = K.mix(flat.view(np.uint64)) >> K.U64(64 - FILTER_BITS)
            keep = (held.value[(at >> K.U64(3)).astype(np.int64)] >> (at & K.U64(7)).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([pa.array(owner[keep]), pa.array(flat[keep])], names=["node", "token"])

    return one.mapInArrow(tidy(run), "node long, token long")


def _bits(size: float) -> int:
    """Bits of the signature of a set: a power of two, about its size."""
    return int(min(MAX_BITS, max(64, 1 << math.ceil(math.log2(max(size, 1))))))


def _signature(s: np.ndarray) -> bytes:
    bits = _bits(len(s))
    out = np.zeros(bits, bool)
    out[s.astype(np.int64) & (bits - 1)] = True
    return np.packbits(out, bitorder="little").tobytes()


def _fold(rows: list[bytes], bits: int) -> np.ndarray:
    """Signatures of at least ``bits``, each or-ed down to ``bits``, as rows of uint64."""
    out = np.zeros((len(rows), bits // 64), np.uint64)
    widths = np.array([len(r) for r in rows])
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        x = np.frombuffer(b"".join([rows[i] for i in at]), np.uint64).reshape(len(at), -1)
        while x.shape[1] * 64 > bits:
            half = x.shape[1] // 2
            x = x[:, :half] | x[:, half:]
        out[at] = x
    return out


def _sets(docs: DataFrame, leads: DataFrame, k: int, own: list[str]) -> DataFrame:
    """(node, elements) of the leads (node, doc_id, d1, d2), read from rows with the leads' ids."""
    ids = leads.select(F.col("doc_id").alias("__lead")).distinct()
    chosen = docs.join(small(ids), F.col("doc_id").eqNullSafe(F.col("__lead")), "left_semi").select("text")

    def run(batches):
        for b in batches:
            sets = [s for s in shingle_sets(b.column(0), k) if len(s)]
            both = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in both], pa.int64()), pa.array([d[1] for d in both], pa.int64()), _lists(sets)], names=["d1", "d2", "elements"])

    # an id, or its absence, may be on rows of several texts; other nodes than the leads' go
    found = chosen.mapInArrow(tidy(run), "d1 long, d2 long, elements array<long>").join(small(leads.select("node", "d1", "d2")), ["d1", "d2"]).select("node", "elements")
    with arrow_rows(docs.sparkSession, SET_ROWS):
        found = written(found, "elements", own)
    if found.groupBy("node").count().where("count > 1").limit(1).count():  # rows of one id and text
        found = written(found.dropDuplicates(["node"]), "elements", own)
    return found


def _admitted(n1, n2, differing, percent):
    """Whether sets of these sizes can still link when so many bits differ."""
    return differing * (100 + percent) <= (100 - percent) * (n1 + n2)


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmap signatures admit."""
    x = nodes.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("sig").alias("s1"))
    y = nodes.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("sig").alias("s2"))
    sizes = 100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")
    both = pairs.join(y, "b").join(x, "a").where(sizes).select("a", "b", "n1", "n2", "s1", "s2")

    def run(batches):
        for batch in batches:
            n1, n2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            s1, s2 = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            width = np.array([8 * min(len(p), len(q)) for p, q in zip(s1, s2, strict=True)], np.int64)
            apart = np.zeros(len(n1), np.int64)
            for bits in np.unique(width).tolist():
                at = np.flatnonzero(width == bits)
                apart[at] = np.bitwise_count(_fold([s1[i] for i in at], bits) ^ _fold([s2[i] for i in at], bits)).sum(1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(_admitted(n1, n2, apart, percent)))

    return both.mapInArrow(tidy(run), "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int, own: list[str]) -> DataFrame:
    """Pairs (a, b) that link, enough to connect whatever the given pairs' links connect.

    Pairs meet in tiles of two blocks of nodes, so a set is sent once to a tile, not once to a pair. A
    block is part of the nodes that have the same least neighbour. In a tile, a pair that verified
    pairs connect already needs no intersection.
    """
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    home = ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("home"))
    size = home.groupBy("home").agg(F.count(F.lit(1)).alias("c")).hint("rebalance")  # so the join can be split where a home is hot
    home = home.join(size, "home").select("node", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / SET_BLOCK).cast("long"))).alias("block"))
    home = written(home, "homes", own)
    sets = _sets(docs, nodes.join(home.select("node"), "node", "left_semi").select("node", "doc_id", "d1", "d2"), k, own)
    placed = pairs.join(home.select(F.col("node").alias("a"), F.col("block").alias("p")), "a").join(home.select(F.col("node").alias("b"), F.col("block").alias("q")), "b")
    placed = placed.select(F.xxhash64(F.least("p", "q"), F.greatest("p", "q")).alias("tile"), "a", "b")
    who = placed.select("tile", F.col("a").alias("node")).unionByName(placed.select("tile", F.col("b").alias("node"))).distinct()
    rows = who.join(sets, "node").select("tile", F.lit(0).alias("kind"), F.col("node").alias("a"), F.col("node").alias("b"), "elements")
    rows = rows.unionByName(placed.select("tile", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("array<long>").alias("elements")))
    rows = rows.repartition("tile").sortWithinPartitions("tile", "kind")

    def run(batches):
        last, sets_, up = None, {}, {}

        def root(x):
            while up.get(x, x) != x:
                up[x] = x = up.get(up[x], up[x])
            return x

        for batch in batches:
            tile, kind, first, second = (batch.column(c).to_numpy() for c in range(4))
            e = batch.column(4)
            off, values = e.offsets.to_numpy(), e.values.to_numpy(zero_copy_only=False).view(np.uint64)
            out = []
            for i in range(len(tile)):
                if tile[i] != last:
                    last, sets_, up = tile[i], {}, {}
                x, y = int(first[i]), int(second[i])
                if kind[i] == 0:
                    sets_[x] = values[off[i] : off[i + 1]].copy()
                    continue
                rx, ry = root(x), root(y)
                if rx == ry:
                    continue
                p, q = sets_[x], sets_[y]
                common = int(_isin(p, q).sum())
                if 100 * common >= percent * (len(p) + len(q) - common):
                    up[rx] = ry
                    out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["a", "b"])

    return rows.select("tile", "kind", "a", "b", "elements").mapInArrow(tidy(run), "a long, b long")


def _admitted_forest(rows: DataFrame, percent: int, ratio: float) -> DataFrame:
    """Edges (a, b) that connect whatever pairs of different labels meet in a tile and are admitted by their bits.

    A task answers with a forest over its nodes, so with no more edges than nodes.
    """
    names = ["token", "tile", "i", "j"]

    # both sets of a pair in the tile's upper band: the next tile judges them, by signatures that are wide enough
    def groups(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if not len(t):
                continue
            keys = np.stack([t.column(c).to_numpy() for c in names])
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            cut = int(new[-1]) if len(new) else 0
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut)
        if held is not None and len(held):
            yield held

    def join(up, found):
        pairs = np.unique(np.ascontiguousarray(np.concatenate(found)).view("i8,i8").ravel())
        for x, y in zip(pairs["f0"].tolist(), pairs["f1"].tolist(), strict=True):
            while up.get(x, x) != x:
                up[x] = x = up.get(up[x], up[x])
            while up.get(y, y) != y:
                up[y] = y = up.get(up[y], up[y])
            if x != y:
                up[max(x, y)] = min(x, y)

    def run(batches):
        found, waiting, up = [], 0, {}
        for t in groups(batches):
            keys = np.stack([t.column(c).to_numpy() for c in names])
            group = np.concatenate(([0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(0))))
            tile, node, label, n, blk = (t.column(c).to_numpy() for c in ("tile", "node", "label", "n", "blk"))
            low = t.column("low").to_numpy()
            full = t.column("sig").to_pylist()
            bands, of = np.unique(tile, return_inverse=True)
            width = np.array([_bits(0.99 * ratio ** -float(x)) for x in bands])[of]  # not wider than the smallest set's
            for bits in np.unique(width):
                at = np.flatnonzero(width == bits)
                sig = _fold([full[i] for i in at], int(bits))
                g, v, lab, size, bl, lo = group[at], node[at], label[at], n[at], blk[at], low[at]
                two = keys[2][at] != keys[3][at]
                d = 1
                left = np.flatnonzero(g[:-1] == g[1:]) if len(g) > 1 else np.empty(0, np.int64)
                while len(left):
                    p, q = left, left + d
                    ok = (lab[p] != lab[q]) & (lo[p] | lo[q]) & (v[p] != v[q]) & (~two[p] | (bl[p] != bl[q]))
                    ok &= 100 * np.minimum(size[p], size[q]) >= percent * np.maximum(size[p], size[q])
                    p, q = p[ok], q[ok]
                    if len(p):
                        apart = np.bitwise_count(sig[p] ^ sig[q]).sum(1, dtype=np.int64)
                        ok = _admitted(size[p], size[q], apart, percent)
                        x, y = v[p[ok]], v[q[ok]]
                        if len(x):
                            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
                            waiting += len(x)
                            if waiting > WAITING:
                                join(up, found)
                                found, waiting = [], 0
                    d += 1
                    left = left[left + d < len(g)]
                    left = left[g[left] == g[left + d]]
        if found:
            join(up, found)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array(list(up.values()), pa.int64())], names=["a", "b"])

    cols = [*names, "blk", "node", "label", "n", "low", "sig"]
    return rows.select(*cols).repartition(*names).sortWithinPartitions(*names).mapInArrow(tidy(run), "a long, b long")


def _tiles(clusters: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(tile, side, node): blocks of a cluster (node, label) in a size band, against each other and the next band's."""
    band = F.floor(F.log("n") / F.lit(-math.log(percent / 100))).cast("int")
    at = clusters.select("node", F.col("label").alias("cluster")).join(nodes.select("node", band.alias("band")), "node")
    size = at.groupBy("cluster", "band").agg(F.ceil(F.count(F.lit(1)) / SET_BLOCK).cast("int").alias("blocks"))
    at = at.join(size, ["cluster", "band"]).select("node", F.xxhash64("cluster", "band", F.pmod(F.xxhash64("node"), "blocks").cast("int")).alias("block"))
    size = size.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", "band", F.xxhash64("cluster", "band", "part").alias("block"))
    both = size.toDF("cluster", "b1", "p").join(size.toDF("cluster", "b2", "q"), "cluster").where((F.abs(F.col("b1") - F.col("b2")) <= 1) & (F.col("p") <= F.col("q")))
    tiles = both.select("p", "q", F.xxhash64("p", "q").alias("tile"))
    sides = tiles.select("tile", F.lit(0).alias("side"), F.col("p").alias("block")).unionByName(tiles.where("p <> q").select("tile", F.lit(1).alias("side"), F.col("q").alias("block")))
    return sides.join(at, "block").select("tile", "side", "node")


def _groups(batches, column: int = 0):
    """Tables of whole tiles from batches sorted by tile."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        if not len(t):
            continue
        tile = t.column(column).to_numpy()
        new = np.flatnonzero(tile[1:] != tile[:-1]) + 1
        starts = [0, *new.tolist()]
        for a, z in zip(starts[:-1], starts[1:], strict=True):
            yield t.slice(a, z - a)
        held = t.slice(starts[-1])
    if held is not None and len(held):
        yield held


def _candidates(t: pa.Table, percent: int) -> np.ndarray:
    """Of a tile's rows (tile, side, node, label, n, sig): which pairs (row, column) sizes and bits admit across labels."""
    side, node, label, n = (t.column(c).to_numpy() for c in ("side", "node", "label", "n"))
    sigs = t.column("sig").to_pylist()
    bits = 8 * min(map(len, sigs))
    x = _fold(sigs, bits)
    ok = (label[:, None] != label[None, :]) & (node[:, None] < node[None, :])
    if side.any():
        ok &= side[:, None] != side[None, :]
    ok &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    rows = np.flatnonzero(ok.any(1))
    for r in rows:
        cols = np.flatnonzero(ok[r])
        apart = np.bitwise_count(x[r] ^ x[cols]).sum(1, dtype=np.int64)
        ok[r, cols] = _admitted(n[r], n[cols], apart, percent)
    return ok


def _common(parts: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every row's with every column's sorted set.

    Elements are taken in slices of their hash, so that little but the sets is in memory; those of two sets or more
    become 0/1 columns, whose products count what is common.
    """
    values = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    slices = 1 + len(values) // (1 << 17)
    out = np.zeros((len(rows), len(cols)), np.float32)
    for k in range(slices):
        at = np.flatnonzero((values >> K.U64(20)) % K.U64(slices) == k)
        if not len(at):
            continue
        own = owner[at]
        _, inverse, count = np.unique(values[at], return_inverse=True, return_counts=True)
        often = count > 1
        place = (np.cumsum(often) - 1).astype(np.int32)
        keep = often[inverse]
        own, place = own[keep], place[inverse[keep]]
        for a in range(0, int(often.sum()), 4096):
            here = (place >= a) & (place < a + 4096)
            has = np.zeros((len(parts), 4096), np.float32)
            has[own[here], place[here] - a] = 1
            out += has[rows] @ has[cols].T
    return out


def _tile_links(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that link, as many as connect what the tiles' links connect."""

    def run(batches):
        for t in _groups(batches):
            ok = _candidates(t, percent)
            r, c = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
            if not len(r):
                continue
            e = t.column("elements").combine_chunks()
            e = e.chunk(0) if isinstance(e, pa.ChunkedArray) else e
            off, values = e.offsets.to_numpy(), e.values.to_numpy(zero_copy_only=False).view(np.uint64)
            parts = [values[off[i] : off[i + 1]] for i in range(len(e))]
            n = t.column("n").to_numpy()
            both = _common(parts, r, c).astype(np.int64)
            linked = ok[np.ix_(r, c)] & (100 * both >= percent * (n[r][:, None] + n[c][None, :] - both))
            node, up, out = t.column("node").to_numpy(), {}, []
            for i, j in zip(*np.nonzero(linked), strict=True):
                x, y = int(node[r[i]]), int(node[c[j]])
                while up.get(x, x) != x:
                    x = up[x]
                while up.get(y, y) != y:
                    y = up[y]
                if x != y:
                    up[max(x, y)] = min(x, y)
                    out.append((node[r[i]], node[c[j]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["a", "b"])

    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(tidy(run), "a long, b long")


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return _linked(docs, doc_id, text, k, percent)


def _linked(docs: DataFrame, doc_id: str, text: str, k: int, percent: int, keyed: bool = False) -> DataFrame:
    """link()'s rows; ``keyed`` adds the digest of the set and label, which no two components share."""
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    own: list[str] = []
    spare: list[str] = []  # tables that the result does not need
    rows = written(_prefixes(docs, k, percent, None), "sets", own)
    nodes = rows.where("d1 is not null").groupBy("d1", "d2").agg(F.first("sig").alias("sig"), F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", spare)
    late = _heavy(rows)
    if len(late):
        rows = written(_prefixes(docs, k, percent, spark.sparkContext.broadcast(late)), "sets")
        drop(spark, own)
    # elements met by two nodes or more, and who meets there
    gone: list[str] = []  # tables that the next step does not need
    members = written(_members(rows, nodes, gone), "members", gone)
    hubs = members.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last")
    met_at: list[str] = []
    met = written(members.join(hubs, "token").groupBy("token", "node").agg(F.min("hub").alias("hub"), F.min("last").alias("last")), "met", met_at)
    drop(spark, gone)
    stars = met.select(F.col("node").alias("b"), F.explode(F.array("hub", "last")).alias("a")).where("a <> b")
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars = written(_possible(stars, nodes, percent), "stars", gone)
    with arrow_rows(spark, SET_ROWS):
        links = written(_verified(stars, docs, nodes, k, percent, gone), "links", spare)
    drop(spark, gone)
    labels = written(components(links, "a", "b"), "labels", spare)

    # members of an element that are not joined yet meet in tiles
    now = met.join(labels, "node", "left").select("token", "node", F.coalesce("label", "node").alias("label"))
    open_ = now.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
    ratio = percent / 100
    band = F.floor(F.log("n") / F.lit(-math.log(ratio))).cast("long")
    left = now.join(open_, "token").join(nodes.select("node", "n"), "node").select("token", "node", "label", "n", F.explode(F.array(F.struct(band.alias("tile"), F.lit(True).alias("low")), F.struct((band - 1).alias("tile"), F.lit(False).alias("low")))).alias("at"))
    left = written(left.select("token", "node", "label", "n", "at.*"), "open", gone)
    drop(spark, met_at)
    count = left.groupBy("token", "tile").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("x"), F.max("label").alias("y"), F.max("low").alias("low")).where("x <> y and low")
    left = left.join(count.select("token", "tile", F.ceil(F.col("c") / BLOCK).cast("long").alias("blocks")), ["token", "tile"])
    left = left.withColumn("blk", F.pmod(F.xxhash64("node"), "blocks")).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    left = written(left.withColumns({"i": F.least("blk", "o"), "j": F.greatest("blk", "o")}).drop("blocks", "o"), "tiled", gone)
    clusters = written(components(_admitted_forest(left.join(nodes.select("node", "sig"), "node"), percent, ratio), "a", "b"), "clusters", spare)
    drop(spark, gone)
    about = nodes.select("node", "n", "sig").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sets = _sets(docs, nodes.join(clusters.select("node"), "node", "left_semi").select("node", "doc_id", "d1", "d2"), k, spare)
    full = _tiles(clusters, nodes, percent).join(about, "node").join(sets, "node").select("tile", "side", "node", "label", "n", "sig", "elements")
    with arrow_rows(spark, SET_ROWS):
        more = written(_tile_links(full, percent), "links", spare)
    if more.limit(1).count():
        labels = written(components(links.unionByName(more), "a", "b"), "labels", spare)

    of_node = nodes.select("node", "d1", "d2", "doc_id").join(labels, "node", "left").select("d1", "d2", "doc_id", F.coalesce("label", "node").alias("label"))
    smallest = of_node.groupBy("label").agg(F.min("doc_id").alias("component_id")).hint("rebalance")
    keys = ["d1", "d2", "label"] if keyed else []
    of_node = written(of_node.join(smallest, "label").select("d1", "d2", *keys[2:], "component_id"), "components")
    drop(spark, spare)
    out = rows.select("doc_id", "n", "d1", "d2").join(small(of_node), ["d1", "d2"], "left")
    component = F.when(F.col("d1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), *keys)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group: the one of the smallest id.

    Rows with a null id stay only where no linked row has an id, and then one of a group. An id on several
    texts is judged text by text; of rows with one id and no words, one stays.
    """
    found = _linked(docs, doc_id, text, k, percent, keyed=True)
    found = written(found.select(F.col(doc_id).alias("__id"), "d1", "d2", "label"), "dedup")
    first = F.min(F.struct(F.col("__id").isNull().alias("absent"), F.col("__id").alias("id"), F.col("d1").alias("lead1"), F.col("d2").alias("lead2"))).alias("first")
    first = written(found.where("d1 is not null").groupBy("label").agg(first).select("label", "first.*"), "first")
    named = found.where("__id is not null").groupBy("__id").agg(F.count(F.lit(1)).alias("c"))
    twice = written(named.where("c > 1").select("__id"), "twice")
    # an id on one row tells the row
    gone = found.where("__id is not null and d1 is not null").join(small(first), "label").where("absent or __id <> id").select("__id").distinct()
    several = F.col(doc_id) == F.col("__id")
    out = docs.join(small(gone.join(small(twice), "__id", "left_anti")), several, "left_anti")
    if not twice.limit(1).count() and not found.where("__id is null").limit(1).count():
        return out.select(*docs.columns)
    alone = out.where(F.col(doc_id).isNotNull()).join(small(twice), several, "left_anti")
    rest = out.where(F.col(doc_id).isNull()).unionByName(out.join(small(twice), several, "left_semi"))
    rest = _with_digest(rest, text, k)
    lead = first.join(small(twice), F.col("id") == F.col("__id"), "left_semi").unionByName(first.where("absent")).select(F.col("id").alias("__first"), "lead1", "lead2")
    same = (F.col("__d1") == F.col("lead1")) & (F.col("__d2") == F.col("lead2")) & F.col(doc_id).eqNullSafe(F.col("__first"))
    kept = rest.join(small(lead), same, "left_semi").dropDuplicates(["__d1", "__d2"])
    blank = rest.where("__d1 is null")
    blank = blank.where(F.col(doc_id).isNull()).unionByName(blank.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]))
    return alone.select(*docs.columns).unionByName(kept.unionByName(blank).select(*docs.columns))


def _with_digest(docs: DataFrame, text: str, k: int) -> DataFrame:
    """docs and __d1, __d2, the digest of each row's set, null for an empty one."""
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            both = [_digest(s) if len(s) else (None, None) for s in shingle_sets(b.column(at), k)]
            digests = [pa.array([d[i] for d in both], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*b.columns, *digests], names=[*b.schema.names, "__d1", "__d2"])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField("__d1", T.LongType()), T.StructField("__d2", T.LongType())]))


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = w.doc_id
"""
