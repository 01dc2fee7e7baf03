"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Fixed base rules fail a text of fewer than 10 words, or one where more than 20 % of the words lie
in 5-word runs that occur twice or more. All other thresholds come from the data: of the texts that
pass the base, every language and source keeps a quantile sketch of four measures, and a text is
kept if each of its measures is inside its group's fences.

The sketch is a histogram over values cut to 7 significant bits (relative error below 1/64). It is
exact integer arithmetic, so partial sketches merge by adding counts, in any order, before and after
the shuffle, and a hot group costs no more than its bins. Fences are the upper quartile plus
``REACH`` spreads (for the word length also the lower quartile minus those); the spread is the
quartiles' distance, at least the measure's ``FLOORS``. A group with fewer than ``LEAST`` texts
takes its language's sketch, the sum of the sources'; fewer there, the sum of all.

Defined cases: null and empty texts have no words and fail the base; null languages and sources
are groups of their own; repeated rows all count and get equal verdicts; an empty table gives no
rows; other columns, also such with names of results, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .cluster import small, text_batches, tidy, written

LEAST_WORDS, REPEAT_PERCENT, RUN = 10, 20, 5
REACH, LEAST = 6, 50
#: Least spread of each measure: word length in hundredths, the others in thousandths. Repeats can only act below the base's 200.
FLOORS = {"word_length": 25, "symbols": 10, "dup_lines": 50, "repeats": 30}

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _duplicates(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (document, hash): whether the pair occurs again, and whether it is a later occurrence."""
    key = K.mix(h ^ K.mix(doc.astype(np.uint64)))
    _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(key), bool)
    later[first] = False
    return count[inverse] > 1, later


def _stats(t: K.Text) -> list[np.ndarray]:
    w = K.words(t, K.WORD_RAW)
    n = len(t)
    sums = lambda at_word: np.bincount(w.doc, weights=at_word, minlength=n).astype(np.int64)
    chars = np.concatenate(([0], np.cumsum((t.data & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[t.data])))
    # repeated runs of words
    g = K.window_hash(K.word_hash(w), RUN)
    at = np.flatnonzero(K.same_doc(w.doc, RUN))
    again = at[_duplicates(w.doc[at], g[at])[0]] if len(at) else at
    repeated = K.cover(again, again + RUN, len(w.start))
    # lines
    feeds = np.flatnonzero(t.data == 10)
    starts = np.unique(np.concatenate([feeds + 1, t.offsets[:-1]]))
    starts = starts[starts < len(t.data)]
    doc = np.searchsorted(t.offsets, starts, "right") - 1
    stop = np.minimum(np.append(feeds, len(t.data))[np.searchsorted(feeds, starts)], t.offsets[doc + 1])
    has = np.searchsorted(w.start, stop) > np.searchsorted(w.start, starts)
    p = K.prefix_hash(t.data)
    s, e, doc = starts[has], stop[has], doc[has]
    later = _duplicates(doc, K.span_hash(p, s, e))[1] if len(s) else np.zeros(0, bool)
    return [
        np.diff(w.first),
        sums(chars[w.end] - chars[w.start]),
        symbols[t.offsets[1:]] - symbols[t.offsets[:-1]],
        np.bincount(doc, minlength=n),
        np.bincount(doc, weights=later, minlength=n).astype(np.int64),
        sums(repeated),
    ]


def measure(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The given columns with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    text_batches(docs.sparkSession)
    k = len(columns)

    def run(batches):
        for b in batches:
            parts = [_stats(t) for t in K.slices(b.column(k))]
            got = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *(pa.array(g.astype(np.int64)) for g in got)], names=[f"c{i}" for i in range(k)] + STATS)

    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    out = docs.select(*columns, F.col(text).alias("__text")).mapInArrow(tidy(run), f"{kinds}, " + ", ".join(f"{s} long" for s in STATS))
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(columns)})


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def measures() -> dict[str, Column]:
    """Whole-number measures of a text with words.

    The mean word length is drawn towards 5 characters with the weight of 20 words, as the mean of few
    words says little.
    """
    per = lambda a, b, m: F.expr(f"{m} * {a} div greatest({b}, 1)")
    return {"word_length": F.expr("100 * (word_chars + 100) div (n_words + 20)"), "symbols": per("n_symbols", "word_chars", 1000), "dup_lines": per("n_dup_lines", "n_lines", 1000), "repeats": per("n_repeat_words", "n_words", 1000)}


def cut(x: Column) -> Column:
    """The value's 7 highest bits: the sketch's bin, named by its least value."""
    drop = F.greatest(F.lit(0), F.length(F.bin(x)) - 7)
    low = F.pow(F.lit(2.0), drop).cast("long")
    return x - x % low


def sketches(stats: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, bin, c of the texts that pass the base."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), cut(x).alias("bin")) for m, x in measures().items()])
    each = stats.where(~base_failed()).select(*keys, F.explode(pairs).alias("m"))
    return each.groupBy(*keys, F.col("m.measure").alias("measure"), F.col("m.bin").alias("bin")).agg(F.count(F.lit(1)).alias("c"))


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups: the sums of finer ones."""
    return parts.groupBy(*keys, "measure", "bin").agg(F.sum("c").alias("c"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, n, q1, q3: the bins that reach a quarter and three quarters of the rows."""
    group = Window.partitionBy(*keys, "measure")
    s = sketch.withColumn("n", F.sum("c").over(group)).withColumn("upto", F.sum("c").over(group.orderBy("bin")))
    q = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("n"), F.col("bin")))
    return s.groupBy(*keys, "measure").agg(F.max("n").alias("n"), q(25).alias("q1"), q(75).alias("q3"))


def fences(stats: DataFrame) -> DataFrame:
    """One row a (lang, source): low and high of each measure."""
    own = written(sketches(stats, ["lang", "source"]), "sketches")
    by_lang = merge(own, ["lang"])
    rows = quartiles(own, ["lang", "source"])
    for more, keys in ((quartiles(by_lang, ["lang"]), ["lang"]), (quartiles(merge(by_lang, []), []), [])):
        tag = "".join(keys) or "all"
        more = more.select(*[F.col(c).alias(f"{tag}_{c}") for c in [*keys, "measure", "n", "q1", "q3"]])
        on = F.col("measure") == F.col(f"{tag}_measure")
        for c in keys:
            on &= F.col(c).eqNullSafe(F.col(f"{tag}_{c}"))
        rows = rows.join(more, on)
    pick = lambda c: F.when(F.col("n") >= LEAST, F.col(c)).when(F.col("lang_n") >= LEAST, F.col(f"lang_{c}")).otherwise(F.col(f"all_{c}"))
    floor = F.create_map(*[F.lit(x) for kv in FLOORS.items() for x in kv])[F.col("measure")]
    rows = rows.select("lang", "source", "measure", pick("q1").alias("q1"), pick("q3").alias("q3"), floor.alias("floor"))
    reach = REACH * F.greatest(F.col("q3") - F.col("q1"), F.col("floor"))
    rows = rows.select("lang", "source", "measure", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    of = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}")
    return rows.groupBy("lang", "source").agg(*[of(m, "high") for m in FLOORS], of("word_length", "low"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang, source, the base's counts, base_failed, kept and reasons (measures outside their fences)."""
    stats = written(measure(docs, [doc_id, "lang", "source"], text), "stats")
    f = fences(stats)
    f = f.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[c for c in f.columns if c not in ("lang", "source")])
    f = small(written(f, "fences"))
    rows = stats.join(f, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    outside = [F.when((x > F.col(f"{m}_high")) | ((x < F.col("word_length_low")) if m == "word_length" else F.lit(False)), F.lit(m)) for m, x in measures().items()]
    rows = rows.withColumn("base_failed", base_failed()).withColumn("reasons", F.filter(F.array(*outside), lambda r: r.isNotNull()))
    return rows.select(doc_id, "lang", "source", *STATS, "base_failed", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), "reasons")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
s AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 100 * (word_chars + 100) // (n_words + 20) AS word_length, 1000 * n_symbols // greatest(word_chars, 1) AS symbols,
        1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats FROM s),
u AS (SELECT lang, source, measure, x - x % CAST(pow(2, greatest(0, length(bin(x)) - 7)) AS BIGINT) AS bin
      FROM (SELECT lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS measure, unnest([word_length, symbols, dup_lines, repeats]) AS x FROM b WHERE NOT base_failed)),
k AS (SELECT lang, source, measure, bin, 0 AS lv FROM u UNION ALL SELECT lang, NULL, measure, bin, 1 FROM u UNION ALL SELECT NULL, NULL, measure, bin, 2 FROM u),
c AS (SELECT *, count(*) OVER (PARTITION BY lv, lang, source, measure) AS n, count(*) OVER (PARTITION BY lv, lang, source, measure ORDER BY bin) AS upto FROM k),
q AS (SELECT lv, lang, source, measure, max(n) AS n, min(CASE WHEN 100 * upto >= 25 * n THEN bin END) AS q1, min(CASE WHEN 100 * upto >= 75 * n THEN bin END) AS q3 FROM c GROUP BY lv, lang, source, measure),
p AS (SELECT x.lang, x.source, x.measure, CASE WHEN x.n >= 50 THEN x.q1 WHEN y.n >= 50 THEN y.q1 ELSE z.q1 END AS q1, CASE WHEN x.n >= 50 THEN x.q3 WHEN y.n >= 50 THEN y.q3 ELSE z.q3 END AS q3,
        CASE x.measure WHEN 'word_length' THEN 25 WHEN 'symbols' THEN 10 WHEN 'dup_lines' THEN 50 ELSE 30 END AS fl
      FROM q x JOIN q y ON y.lv = 1 AND y.lang IS NOT DISTINCT FROM x.lang AND y.measure = x.measure JOIN q z ON z.lv = 2 AND z.measure = x.measure WHERE x.lv = 0),
f AS (SELECT lang, source, max(CASE WHEN measure = 'word_length' THEN q1 - 6 * greatest(q3 - q1, fl) END) AS lo, max(CASE WHEN measure = 'word_length' THEN q3 + 6 * greatest(q3 - q1, fl) END) AS h1,
        max(CASE WHEN measure = 'symbols' THEN q3 + 6 * greatest(q3 - q1, fl) END) AS h2, max(CASE WHEN measure = 'dup_lines' THEN q3 + 6 * greatest(q3 - q1, fl) END) AS h3,
        max(CASE WHEN measure = 'repeats' THEN q3 + 6 * greatest(q3 - q1, fl) END) AS h4 FROM p GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(word_length >= lo AND word_length <= h1 AND symbols <= h2 AND dup_lines <= h3 AND repeats <= h4, true) AS kept
FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""
