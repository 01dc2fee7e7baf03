"""Toxic passages by maximum-scoring segments over token log-odds.

* Tokens are runs of letters (A-Z lowered, all non-ASCII). A token's log-odds between toxic and
  clean text is a sum along its chain of prefixes of 4, 5 and 6 bytes and the whole token: every
  step's class probabilities are smoothed by a Dirichlet prior of ``PRIOR`` counts shaped as both
  classes together (Monroe et al. 2008), so a rare inflected form leans on its stem and an unseen
  token is neutral. A text counts a token once, which keeps a repeated rare word from looking like
  many witnesses. Steps whose likelihood ratio has a root below ``Z`` count as 0.
* A text's token scores, less a drift, are scanned once by the linear-time algorithm of Ruzzo and
  Tompa (1999), which finds every maximal scoring segment of the whole text.
* Scores are log-likelihood ratios in nats, so the extreme-value decay is 1: a segment of score S in a
  text of n tokens has E = K n exp(-S), K by maximum likelihood on clean training texts. Segments
  with E <= ``MAX_E`` are passages. The text's score is a logistic calibration of -log E of its best
  segment, plus the evidence of the passages after it.

Learning reads a bounded sample of labelled rows (``TRAIN_ROWS``, by a hash of the id). The broadcast model has
the features of that sample that ``LEAST_TOXIC`` toxic texts or more hold and whose step is not 0. Scoring reads every
whole text; labels, lang, source and ids are no inputs of a score. Training texts of one label that share the
smallest hash of their 5-word runs (copies) count once, so what only copies of one text share is no evidence.

Defined cases: null and empty texts have no tokens and get the calibrated score of no evidence; null
labels and labels of absent documents teach nothing; several labels of one id count as their
maximum; without labels of both classes every score is 0; repeated rows are each scored; columns
of other names are kept by :func:`reject` and not read by :func:`score`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .cluster import text_batches, tidy, written

TRAIN_ROWS = 20_000
LEAST_TOXIC = 4
PRIOR, Z, DRIFT = 2.0, 4.2, 1.0
MAX_E = 0.01
STEMS = (4, 5, 6)

_LETTERS = K.byte_table(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


def _chain(w: K.Words) -> list[np.ndarray]:
    """Feature hashes of each token, shortest prefix first; 0 where the token is no longer than the prefix."""
    p = K.prefix_hash(w.norm)
    out = []
    for size in STEMS:
        h = K.span_hash(p, w.start, np.minimum(w.start + size, w.end))
        h[w.end - w.start <= size] = 0
        out.append(h)
    out.append(K.mix(K.span_hash(p, w.start, w.end) ^ K.U64(0x5851F42D4C957F2D)))
    return out


def _tables(rows: pa.Table):
    """(f, p, a, b): the toxic and clean texts of a batch of (text, toxic) that hold a feature, and its parent."""
    label = np.asarray(rows.column(1).to_numpy(zero_copy_only=False), np.int64) == 1
    for t in K.slices(rows.column(0)):
        w = K.words(t, _LETTERS)
        parent = np.zeros(len(w.start), np.uint64)
        feats, parents, docs = [np.zeros(len(t), np.uint64)], [np.zeros(len(t), np.uint64)], [np.arange(len(t))]
        for h in _chain(w):
            here = h != 0
            feats.append(h[here])
            parents.append(parent[here])
            docs.append(w.doc[here])
            parent = np.where(here, h, parent)
        f, up, doc = map(np.concatenate, (feats, parents, docs))
        once = np.unique(K.mix(f + K.U64(1)) ^ K.mix(doc.astype(np.uint64)), return_index=True)[1]
        f, up, doc = f[once], up[once], doc[once]
        f, first, inverse = np.unique(f, return_index=True, return_inverse=True)
        y = label[t.first_row + doc]
        a = np.bincount(inverse, weights=y, minlength=len(f)).astype(np.int64)
        n = np.bincount(inverse, minlength=len(f))
        yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(up[first].view(np.int64)), pa.array(a), pa.array(n - a)], names=["f", "p", "a", "b"])


def _keyed(batches):
    """Rows (id, text, label) with the smallest hash of their 5-word runs: copies and most near copies share it."""
    for b in batches:
        keys = np.zeros(b.num_rows, np.uint64)
        for t in K.slices(b.column(1)):
            w = K.words(t, _LETTERS)
            h = K.word_hash(w)
            for d in range(len(t)):
                a, e = w.first[d], w.first[d + 1]
                if e > a:
                    keys[t.first_row + d] = K.window_hash(h[a:e], int(min(5, e - a))).min()
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(0).cast(pa.string()), b.column(1).cast(pa.string()), b.column(2)], names=["key", "id", "text", "y"])


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    steps: np.ndarray  # log-odds each adds
    k: float = 1e-3
    slope: float = 0.0
    offset: float = 0.0
    known: bool = True

    def token_scores(self, w: K.Words) -> np.ndarray:
        s = np.full(len(w.start), -DRIFT)
        for h in _chain(w):
            j = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
            s += np.where(self.features[j] == h, self.steps[j], 0.0)
        return s

    def combined(self, found: list[float], n: int) -> float:
        """The best segment's score, and what further segments have beyond chance in so long a text."""
        chance = np.log(max(n, 1) * max(self.k, 1e-9))
        found = sorted(found, reverse=True)
        return float(sum(found[:1]) + sum(max(0.0, z - max(0.0, chance) - 2.0) for z in found[1:]))

    def evidence(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        return best - np.log(np.maximum(n, 1) * self.k)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -40, 40))) if self.known else np.zeros(len(x))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Ruzzo and Tompa's maximal scoring segments as (start, end, score), left to right, in linear time."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[list] = []  # start, end, total before, total after, index of the nearest earlier with a smaller total before
    for i in np.flatnonzero(scores > 0).tolist():
        s, e, lo, hi = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= lo:
                j = found[j][4]
            if j < 0 or found[j][3] >= hi:
                found.append([s, e, lo, hi, j])
                break
            s, lo = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, float(hi - lo)) for s, e, lo, hi, _ in found]


def _scan(column: pa.Array, model: Model):
    """Of each text: tokens, best segment's score, and its segments as (byte start, byte end, score)."""
    for t in K.slices(column):
        w = K.words(t, _LETTERS)
        s = model.token_scores(w)
        for d in range(len(t)):
            a, b = w.first[d], w.first[d + 1]
            segments = maximal_segments(s[a:b])
            base = int(t.offsets[d])
            yield int(b - a), model.combined([x[2] for x in segments], int(b - a)), [(int(w.start[a + x]) - base, int(w.end[a + y - 1]) - base, z) for x, y, z in segments]


def _log_odds(rows: list) -> Model:
    f = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(f)
    f = f[order]
    p = np.array([r[1] for r in rows], np.int64).view(np.uint64)[order]
    a, b = (np.array([r[c] for r in rows], float)[order] for c in (2, 3))
    up = np.searchsorted(f, p)  # a parent counts at least what its feature counts, so it is there
    up = np.minimum(up, len(f) - 1)
    pa_, pb = a[up], b[up]
    share = (a + b) / np.maximum(pa_ + pb, 1)
    x, y = a + PRIOR * share, b + PRIOR * share
    delta = np.log(x / (pa_ + PRIOR)) - np.log(y / (pb + PRIOR))
    # root of the likelihood ratio against the parent's shares: holds for counts of 0 too
    rate = pa_ / np.maximum(pa_ + pb, 1)
    term = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    z = np.sqrt(np.maximum(0, 2 * (term(a, (a + b) * rate) + term(b, (a + b) * (1 - rate)))))
    delta[(z < Z) | (f == 0) | (f[up] != p)] = 0
    keep = (delta != 0) | (f == 0)
    return Model(f[keep], delta[keep])


def _calibrated(model: Model, n: np.ndarray, best: np.ndarray, toxic: np.ndarray) -> Model:
    clean = ~toxic
    model.k = float(clean.sum() / max(1.0, (np.maximum(n, 1) * np.exp(-np.minimum(best, 50)))[clean].sum()))
    x = model.evidence(best, n)
    v = np.stack([x, np.ones(len(x))], 1)
    beta, y = np.array([0.1, 0.0]), toxic.astype(float)
    for _ in range(40):  # ridge-penalised Newton steps
        q = 1 / (1 + np.exp(-np.clip(v @ beta, -30, 30)))
        grad = v.T @ (q - y) + np.array([1.0, 0.0]) * beta
        hess = (v * (q * (1 - q))[:, None]).T @ v + np.diag([1.0, 1e-6])
        step = np.linalg.solve(hess, grad)
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.offset = max(0.0, float(beta[0])), float(beta[1])
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """A model from at most ``rows`` labelled documents."""
    spark = docs.sparkSession
    text_batches(spark)
    none = Model(np.zeros(1, np.uint64), np.zeros(1), known=False)
    ids = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    taught = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(ids), "__id")
    taught = taught.mapInArrow(tidy(_keyed), "key long, id string, text string, y int").groupBy("key", "y").agg(F.min(F.struct("id", "text")).alias("r"))
    taught = written(taught.select("r.text", "y"), "taught")

    def count(batches):
        for b in batches:
            yield from _tables(pa.Table.from_batches([b]))

    seen = taught.mapInArrow(tidy(count), "f long, p long, a long, b long").groupBy("f").agg(F.min("p").alias("p"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = seen.where(F.col("a") >= LEAST_TOXIC).collect()
    if not found or not any(r[0] == 0 and r[3] for r in found):
        return none
    model = _log_odds(found)
    held = spark.sparkContext.broadcast(model)

    def scan(batches):
        for b in batches:
            got = [x[:2] for x in _scan(b.column(0), held.value)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.float64()), b.column(1)], names=["n", "best", "y"])

    got = taught.mapInArrow(tidy(scan), "n long, best double, y int").toArrow()
    n, best, y = (got.column(c).to_numpy() for c in range(3))
    if not (y == 1).any() or not (y != 1).any():
        return none
    return _calibrated(model, n.astype(float), best, y == 1)


def score(docs: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """The given columns with n_tokens, score, predicted and passages (byte start, byte end, score, E) of every row."""
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    k = len(columns)

    def run(batches):
        m = held.value
        for b in batches:
            got = list(_scan(b.column(k), m))
            n, best = np.array([x[0] for x in got], float), np.array([x[1] for x in got], float)
            p = m.probability(m.evidence(best, n))
            passages = [[{"start": s, "end": e, "score": z, "e": float(m.k * max(x[0], 1) * np.exp(-z))} for s, e, z in x[2] if m.k * max(x[0], 1) * np.exp(-z) <= MAX_E] for x in got]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:k], pa.array(n.astype(np.int64)), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(passages, kind)],
                names=[*columns, "n_tokens", "score", "predicted", "passages"],
            )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    results = "n_tokens long, score double, predicted int, passages array<struct<start: long, end: long, score: double, e: double>>"
    return docs.select(*columns, F.col(text).alias("__text")).mapInArrow(tidy(run), f"{kinds}, {results}")


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the documents that the model calls toxic; all columns as they are."""
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        m = held.value
        for b in batches:
            got = list(_scan(b.column(at), m))
            n, best = np.array([x[0] for x in got], float), np.array([x[1] for x in got], float)
            yield b.filter(pa.array(m.probability(m.evidence(best, n)) < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def taught(spark, sf_dir: str) -> Model:
    """The model of the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return train(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, taught(spark, sf_dir), ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_tokens", F.size("passages").alias("n_passages"))
