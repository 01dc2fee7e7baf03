"""LM scoring by masked pseudo-likelihood with a bidirectional window network in numpy.

* Words ([^\\x20\\x09-\\x0D]+, A-Z lowered) of all texts are counted, whole corpus, no cut: the ``VOCAB`` commonest
  are tokens of their own, every other word is a member of one of ``RARE`` classes by its first and last bytes
  and length. A rare word's probability is its class's, given the context, times its own share of the class's
  count in the corpus (add-half, with one place for words never counted).
* Network: the vectors of the ``SIDE`` tokens on each side of a masked token, each in its own place,
  meet in a tanh layer that predicts the masked token by a two-level softmax (class, then token).
* Training: texts are encoded once as token numbers. Every executor task runs stochastic gradient descent over the
  windows of its own tokens, starting from common weights; the tasks' weights are averaged, weighted by their
  windows, for ``ROUNDS`` rounds. The rounds share the tokens out by a hash of the text up to the token, so that
  every token of every text is learned from once.
* Score: every token of a whole text is masked in turn; the sum of its conditional log-probabilities
  is the text's pseudo-log-likelihood, and its mean per token the score.

The network has a fixed size (about ``(VOCAB + RARE) * WIDTH * 2`` numbers); tasks' weights are summed part by
part in two shuffled steps before the driver reads one sum. The word counts grow with the corpus: those of at most
``KNOWN`` words, the commonest, are broadcast, and the counts of all others meet the texts that hold them in a join.
Averaged weights depend on how tasks share the rows out; reruns over the same files agree.

Defined cases: null and blank texts have no tokens, a sum of 0 and a null mean; repeated rows are
each scored (and each counted in training); a corpus without words scores nothing; other columns
are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .cluster import drop, text_batches, tidy, written

VOCAB, RARE, SIDE, WIDTH = 2000, 240, 3, 24
ROUNDS, BATCH, RATE = 2, 4096, 0.2
#: Words whose counts are broadcast at most (12 bytes each).
KNOWN = 1 << 19
#: Tokens, in whole texts, that are learned from or scored at a time.
CHUNK = 1 << 18
SEED = 11
_EDGE = 0  # token 0 stands beyond both ends of a text
_PLACES = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])


def rare_class(w: K.Words) -> np.ndarray:
    """0 .. RARE-1 of each word, by its length and outer bytes."""
    if not len(w.start):
        return np.empty(0, np.int64)
    size = np.minimum(w.end - w.start, 15).astype(np.uint64)
    key = (size * K.U64(31) + w.norm[w.start]) * K.U64(257) + w.norm[w.end - 1]
    return (K.mix(key) % K.U64(RARE)).astype(np.int64)


def _find(ordered: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in the sorted array, and whether it is there."""
    if not len(ordered):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    j = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return j, ordered[j] == x


@dataclass
class Vocabulary:
    hashes: np.ndarray  # of the words with a token, sorted
    tokens: np.ndarray  # token of each: 1 ..
    unigram: np.ndarray
    known: np.ndarray  # hashes of rare words, sorted
    known_log: np.ndarray  # log of each one's count and a half
    class_log: np.ndarray  # log of each rare class's total of those, and one half more for words never counted
    words: str = ""  # the folder of all counted words (h, n)
    complete: bool = True  # whether known holds all rare words

    @property
    def size(self) -> int:
        return len(self.unigram)

    def encode(self, w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word the token, the log of its share of the token as far as known, its hash, and whether its count is not known."""
        h, k = K.word_hash(w), rare_class(w)
        j, common = _find(self.hashes, h)
        token = (self.size - RARE + k).astype(np.uint16)
        if common.any():
            token[common] = self.tokens[j[common]]
        share, left = np.zeros(len(h)), np.zeros(len(h), bool)
        at = np.flatnonzero(~common)
        j, found = _find(self.known, h[at])
        share[at] = np.where(found, self.known_log[j] if len(self.known) else 0.0, math.log(0.5) if self.complete else 0.0) - self.class_log[k[at]]
        if not self.complete:
            left[at[~found]] = True
        return token, share, h, left


def _count_bin(n: F.Column) -> F.Column:
    """The count cut to its 7 highest bits."""
    low = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin(n)) - 7)).cast("long")
    return n - n % low


def vocabulary(docs: DataFrame, text: str = "text", size: int = VOCAB, own: list[str] | None = None) -> Vocabulary | None:
    """Counts all words of all texts. The table of counts stays in the shared folder; ``own`` collects its path."""
    if size + RARE >= 1 << 16:
        raise ValueError("tokens are numbers of 16 bits")

    def count(batches):
        for b in batches:
            for t in K.slices(b.column(0)):
                w = K.words(t, K.WORD_LOWER)
                h, first, n = np.unique(K.word_hash(w), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rare_class(w)[first]), pa.array(n)], names=["h", "k", "n"])

    found = docs.select(text).mapInArrow(tidy(count), "h long, k long, n long").groupBy("h").agg(F.min("k").alias("k"), F.sum("n").alias("n"))
    own = [] if own is None else own
    words = written(found, "words", own)
    bins = sorted(((r["b"], r["c"]) for r in words.groupBy(_count_bin(F.col("n")).alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    if not bins:
        return None
    least, held = bins[0][0], 0
    for b, c in bins:
        if held + c > max(KNOWN, size):
            break
        least, held = b, held + c
    top = words.where(F.col("n") >= least).select("h", "k", "n").toArrow()
    h, k, n = (top.column(c).to_numpy() for c in range(3))
    h = h.view(np.uint64)
    order = np.lexsort((h, -n))
    h, k, n = h[order], k[order], n[order]
    classes = words.groupBy("k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).collect()
    count_of, kinds_of = np.zeros(RARE), np.zeros(RARE)
    for r in classes:
        count_of[r["k"]], kinds_of[r["k"]] = r["n"], r["d"]
    np.subtract.at(count_of, k[:size], n[:size])
    np.subtract.at(kinds_of, k[:size], 1)
    unigram = np.concatenate([[0.0], n[:size], count_of]) + 0.5
    common, rare = np.argsort(h[:size]), size + np.argsort(h[size:])
    class_log = np.log(count_of + 0.5 * (kinds_of + 1))
    return Vocabulary(h[common], (1 + common).astype(np.uint16), unigram / unigram.sum(), h[rare], np.log(n[rare] + 0.5), class_log, own[-1], len(h) == sum(c for _, c in bins))


class Network:
    """e: input vectors; w, b: the hidden layer by place; k, d: output classes; o, c: tokens inside their class.

    Tokens are ordered by count and lie in about sqrt(size) classes of equal size, so a probability is
    a class's times the token's in the class.
    """

    def __init__(self, unigram: np.ndarray, seed: int = SEED):
        g = np.random.default_rng(seed)
        size = len(unigram)
        self.m = math.isqrt(size - 1) + 1
        self.classes = -(-size // self.m)
        padded = np.full(self.classes * self.m, 1e-12)
        padded[:size] = unigram
        self.e = (g.normal(size=(size, WIDTH)) * 0.1).astype(np.float32)
        self.w = (g.normal(size=(2 * SIDE, WIDTH, WIDTH)) / np.sqrt(2 * SIDE * WIDTH)).astype(np.float32)
        self.b = np.zeros(WIDTH, np.float32)
        self.k = np.zeros((self.classes, WIDTH), np.float32)
        self.d = np.log(padded.reshape(self.classes, -1).sum(1)).astype(np.float32)
        self.o = np.zeros((self.classes, self.m, WIDTH), np.float32)
        self.c = np.log(padded).astype(np.float32).reshape(self.classes, self.m)

    def parts(self):
        return [self.e, self.w, self.b, self.k, self.d, self.o, self.c]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, x: np.ndarray) -> Network:
        a = 0
        for p in self.parts():
            p[...] = x[a : a + p.size].reshape(p.shape)
            a += p.size
        return self

    # Examples are columns in what follows: sums and maxima over classes then run along many examples at a time.

    def _keys(self, around: np.ndarray) -> np.ndarray:
        """(2 * SIDE, n): the rows of :meth:`_placed` that meet in each example."""
        return around.T.astype(np.int64) + len(self.e) * np.arange(2 * SIDE)[:, None]

    def _placed(self) -> np.ndarray:
        """Every token's part of the hidden layer in every place."""
        return np.matmul(self.e, self.w).reshape(-1, WIDTH)

    def _hidden(self, placed: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The tanh layer of examples, and a last row of ones for the biases."""
        h = placed.take(keys[0], 0)
        h += self.b
        for k in keys[1:]:
            h += placed.take(k, 0)
        out = np.ones((WIDTH + 1, len(h)), h.dtype)
        np.tanh(h.T, out=out[:-1])
        return out

    def _by_class(self, token: np.ndarray):
        """The order of examples by class, their classes, and (class, from, to) of each run."""
        cls = token // self.m
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        cls = cls[order].astype(np.int64)
        first = np.flatnonzero(np.diff(cls, prepend=-1))
        return order, cls, list(zip(cls[first].tolist(), first.tolist(), [*first[1:].tolist(), len(cls)], strict=True))

    def _outer(self) -> tuple[np.ndarray, np.ndarray]:
        """The output weights of classes and of tokens inside them, with their biases."""
        return np.concatenate((self.k, self.d[:, None]), 1), np.concatenate((self.o, self.c[..., None]), 2)

    def _inner(self, inside: np.ndarray, h: np.ndarray, runs) -> np.ndarray:
        """Logits of the tokens in each example's class; examples lie by class."""
        z = np.empty((self.m, h.shape[1]), h.dtype)
        for c, a, b in runs:
            np.matmul(inside[c], h[:, a:b], out=z[:, a:b])
        return z

    def log_probability(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Of each token, given the (n, 2 * SIDE) tokens around it."""
        placed = self._placed()
        classes, inside = self._outer()
        out = np.empty(len(token), np.float32)
        for a in range(0, len(token), 1 << 12):
            t = token[a : a + (1 << 12)]
            order, cls, runs = self._by_class(t)
            h = self._hidden(placed, self._keys(around[a : a + (1 << 12)][order]))
            row = np.arange(len(t))
            out[a + order] = _log_softmax_at(classes @ h, cls, row) + _log_softmax_at(self._inner(inside, h, runs), t[order] % self.m, row)
        return out

    def gradients(self, around: np.ndarray, token: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log-probability, in the order of parts()."""
        n, row = len(token), np.arange(len(token))
        order, cls, runs = self._by_class(token)
        token, keys = token[order], self._keys(around[order])
        classes, inside = self._outer()
        h = self._hidden(self._placed(), keys)
        z = _softmax(classes @ h)
        z[cls, row] -= 1
        z /= n
        dk, dh = z @ h.T, self.k.T @ z
        z = _softmax(self._inner(inside, h, runs))
        z[token % self.m, row] -= 1
        z /= n
        do = np.zeros_like(inside)
        for c, a, b in runs:
            np.matmul(z[:, a:b], h[:, a:b].T, out=do[c])
            dh[:, a:b] += self.o[c].T @ z[:, a:b]
        h = h[:-1]
        dh *= 1 - h * h
        # the parts of one token in one place are added up before they go back through the layer
        keys, part = keys.ravel(), np.empty((2 * SIDE, n))
        placed = np.empty((2 * SIDE, WIDTH, len(self.e)), dh.dtype)
        for j in range(WIDTH):
            part[:] = dh[j]
            placed[:, j] = np.bincount(keys, part.ravel(), 2 * SIDE * len(self.e)).reshape(2 * SIDE, -1)
        de = np.matmul(self.w, placed).sum(0).T
        return [de, np.matmul(placed, self.e).transpose(0, 2, 1), dh.sum(1), dk[:, :-1], dk[:, -1], do[..., :-1], do[..., -1]]

    def learn(self, around: np.ndarray, token: np.ndarray, squares: list[np.ndarray]) -> None:
        """One Adagrad step."""
        for p, g, s in zip(self.parts(), self.gradients(around, token), squares, strict=True):
            root = g * g
            s += root
            np.sqrt(s, out=root)
            root += 1e-4
            g /= root
            g *= RATE
            p -= g


def _softmax(z: np.ndarray) -> np.ndarray:
    """Of every column."""
    z -= z.max(0)
    np.exp(z, out=z)
    z /= z.sum(0)
    return z


def _log_softmax_at(z: np.ndarray, at: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The log-probability at one place of each column."""
    z -= z.max(0)
    got = z[at, column]
    np.exp(z, out=z)
    return got - np.log(z.sum(0))


def _chunks(column: pa.Array):
    """(first row, tokens, offsets of the texts) of runs of whole encoded texts."""
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    flat = data[off[0] : off[-1]].copy().view(np.uint16)
    off = (off - off[0]) // 2
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK, "right")) - 1)
        yield a, flat[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def _padded(token: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' tokens with ``SIDE`` edges before each and after the last, and each token's place there."""
    at = np.arange(len(token)) + SIDE * (1 + np.repeat(np.arange(len(off) - 1), np.diff(off)))
    out = np.full(len(token) + SIDE * len(off), _EDGE, np.uint16)
    out[at] = token
    return out, at


def _around(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The tokens on both sides of the places."""
    out = np.empty((len(at), 2 * SIDE), np.uint16)
    for k, d in enumerate(_PLACES.tolist()):
        out[:, k] = padded[at + d]
    return out


def _turn(token: np.ndarray, off: np.ndarray, number: int, examples: int) -> np.ndarray:
    """Whether a round learns from each token: rounds take successive slices of marks that hang on a text's tokens alone."""
    total = np.append(K.U64(0), np.cumsum(token.astype(np.uint64) + K.U64(1)))
    mark = K.mix((total[1:] - np.repeat(total[off[:-1]], np.diff(off))) ^ K.U64(SEED)) % K.U64(1_000_000)
    return (mark.astype(np.int64) - number * examples) % 1_000_000 < examples


def encode(docs: DataFrame, v: Vocabulary, columns: list[str], text: str = "text") -> DataFrame:
    """Of every row the given columns (as c0, c1 ..), a row number, its words, the sum of their shares, token numbers, and hashes whose counts are not known."""
    held = docs.sparkSession.sparkContext.broadcast(v)
    k = len(columns)

    def run(batches):
        voc, number = held.value, TaskContext.get().partitionId() << 40
        for b in batches:
            for t in K.slices(b.column(k)):
                w = K.words(t, K.WORD_LOWER)
                token, share, h, left = voc.encode(w)
                off = pa.array((2 * w.first).astype(np.int32)).buffers()[1]
                tokens = pa.Array.from_buffers(pa.binary(), len(t), [None, off, pa.py_buffer(token.tobytes())])
                gone = np.append(0, np.cumsum(left))[w.first]
                tails = pa.ListArray.from_arrays(pa.array(gone.astype(np.int32)), pa.array(h[left].view(np.int64)))
                cols = [c.slice(t.first_row, len(t)) for c in b.columns[:k]]
                row = pa.array(np.arange(number, number + len(t)))
                number += len(t)
                sums = pa.array(np.bincount(w.doc, weights=share, minlength=len(t)).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*cols, row, pa.array(np.diff(w.first)), sums, tokens, tails], names=[*(f"c{i}" for i in range(k)), "row", "n", "share", "tokens", "tail"])

    kinds = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(columns))
    return docs.select(*columns, F.col(text).alias("__text")).mapInArrow(tidy(run), f"{kinds}row long, n long, share double, tokens binary, tail array<long>")


def learn(encoded: DataFrame, v: Vocabulary, rounds: int = ROUNDS, examples: int | None = None) -> Network:
    """The network after ``rounds`` rounds, each over ``examples`` in a million of the tokens: by default all, once."""
    examples = -(-1_000_000 // rounds) if examples is None else examples
    net = Network(v.unigram)
    for number in range(rounds):
        held = encoded.sparkSession.sparkContext.broadcast((v.unigram, net.flat()))

        def run(batches, held=held, number=number):
            unigram, start = held.value
            own = Network(unigram).load(start)
            seen, waiting, size = 0, [], 0
            squares = [np.full_like(p, 1e-6) for p in own.parts()]

            def steps():
                around, token = np.concatenate([x[0] for x in waiting]), np.concatenate([x[1] for x in waiting])
                order = np.random.default_rng(SEED + number).permutation(len(token))
                for part in np.array_split(order, -(-len(order) // BATCH)):
                    own.learn(around[part], token[part], squares)
                waiting.clear()

            for b in batches:
                for _, token, off in _chunks(b.column(0)):
                    pick = np.flatnonzero(_turn(token, off, number, examples))
                    if not len(pick):
                        continue
                    padded, at = _padded(token, off)
                    waiting.append((_around(padded, at[pick]), token[pick]))
                    seen += len(pick)
                    size += len(pick)
                    if size >= CHUNK // 2:
                        steps()
                        size = 0
            if waiting:
                steps()
            if seen:
                x = own.flat().astype(np.float64) * seen
                width = 1024
                rows = -(-len(x) // width)
                x = np.pad(x, (0, rows * width - len(x))).reshape(rows, width)
                salt = TaskContext.get().partitionId() % 64
                for a in range(0, rows, 64):
                    part = x[a : a + 64]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part))), pa.array([salt] * len(part), pa.int64()), pa.array([float(seen)] * len(part)), pa.array(list(part), pa.list_(pa.float64()))], names=["part", "salt", "seen", "x"])

        got = encoded.select("tokens").mapInArrow(tidy(run), "part long, salt long, seen double, x array<double>")
        net = _averaged(got, net, v) or net
    return net


def _averaged(rows: DataFrame, net: Network, v: Vocabulary) -> Network | None:
    """The weighted mean of the tasks' weights: vectors of a part are summed by groups of tasks, then over the groups."""

    def add(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        weight: dict[tuple[int, int], float] = {}
        for b in batches:
            for part, salt, seen, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                total[part, salt] = total.get((part, salt), 0.0) + x.values.to_numpy()
                weight[part, salt] = weight.get((part, salt), 0.0) + seen
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([weight[k] for k in keys], pa.float64()), pa.array([total[k] for k in keys], pa.list_(pa.float64()))],
            names=["part", "salt", "seen", "x"],
        )

    schema = "part long, salt long, seen double, x array<double>"
    groups = rows.repartition("part", "salt").mapInArrow(tidy(add), schema)
    summed = groups.withColumn("salt", F.lit(0).cast("long")).repartition("part").mapInArrow(tidy(add), schema).toArrow()
    if not summed.num_rows:
        return None
    order = np.argsort(summed.column(0).to_numpy())
    seen = summed.column(2).to_numpy()[order]
    x = np.stack([np.asarray(p) for p in summed.column(3).to_pylist()])[order]
    flat = (x / seen[:, None]).ravel()[: sum(p.size for p in net.parts())]
    return Network(v.unigram).load(flat.astype(np.float32))


def train(docs: DataFrame, text: str = "text", size: int = VOCAB, rounds: int = ROUNDS, examples: int | None = None) -> tuple[Vocabulary, Network] | None:
    """The model of all texts, or None for a corpus without words."""
    text_batches(docs.sparkSession)
    v = vocabulary(docs, text, size)
    if v is None:
        return None
    own: list[str] = []
    net = learn(written(encode(docs, v, [], text), "encoded", own), v, rounds, examples)
    drop(docs.sparkSession, own)
    return v, net


def score(docs: DataFrame, model: tuple[Vocabulary, Network] | None, columns: list[str], text: str = "text") -> DataFrame:
    """The given columns with n_tokens, pll (sum of masked log-probabilities) and mean_pll of every row."""
    text_batches(docs.sparkSession)
    if model is None:  # no words were counted, so none is likely
        none = F.lit(0.0)
        return docs.select(*columns, F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"), none.alias("pll"), F.lit(None).cast("double").alias("mean_pll"))
    return _scored(written(encode(docs, model[0], columns, text), "encoded"), model, columns)


def _scored(encoded: DataFrame, model: tuple[Vocabulary, Network], columns: list[str]) -> DataFrame:
    v, net = model
    held = encoded.sparkSession.sparkContext.broadcast((v.unigram, net.flat()))
    k = len(columns)
    names = [f"c{i}" for i in range(k)]

    def run(batches):
        unigram, weights = held.value
        own = Network(unigram).load(weights)
        for b in batches:
            s = b.column(k + 2).to_numpy().copy()
            for first, token, off in _chunks(b.column(k + 3)):
                if len(token):
                    padded, at = _padded(token, off)
                    lp = own.log_probability(_around(padded, at), token)
                    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
                    s[first : first + len(off) - 1] += np.bincount(doc, weights=lp, minlength=len(off) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns[: k + 2], pa.array(s)], names=[*names, "row", "n_tokens", "pll"])

    kinds = "".join(f"{f} {encoded.schema[f].dataType.simpleString()}, " for f in names)
    out = encoded.drop("tail").mapInArrow(tidy(run), f"{kinds}row long, n_tokens long, pll double")
    if not v.complete:
        # words beyond the broadcast meet their counts; none of them is common
        counts = encoded.sparkSession.read.schema("h long, k long, n long").parquet(v.words).select("h", "n")
        tails = encoded.select("row", F.explode("tail").alias("h")).join(counts, "h", "left")
        tails = tails.groupBy(F.col("row").alias("__row")).agg(F.sum(F.log(F.coalesce("n", F.lit(0)) + 0.5)).alias("__more"))
        out = out.join(tails, F.col("row") == F.col("__row"), "left").withColumn("pll", F.col("pll") + F.coalesce("__more", F.lit(0.0)))
    out = out.select(*names, "n_tokens", "pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).alias("mean_pll"))
    return out.withColumnsRenamed(dict(zip(names, columns, strict=True)))


def fit_and_score(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """:func:`score` under the model of the same texts, which are encoded once."""
    text_batches(docs.sparkSession)
    v = vocabulary(docs, text)
    if v is None:
        return score(docs, None, columns, text)
    encoded = written(encode(docs, v, columns, text), "encoded")
    return _scored(encoded, (v, learn(encoded, v)), columns)


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    return fit_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
