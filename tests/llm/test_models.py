"""Trained operators: held-out accuracy, brute force where there is one, defined cases."""

import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from recordsieve.llm import html_extract, lm_score, toxicity

from llm_helpers import bag


def kadane(scores):
    best = here = 0.0
    for s in scores:
        here = max(0.0, here + s)
        best = max(best, here)
    return best


def test_maximal_segments():
    g = np.random.default_rng(3)
    for _ in range(300):
        s = g.integers(-4, 5, g.integers(0, 30)).astype(float)
        found = toxicity.maximal_segments(s)
        assert math.isclose(max((x[2] for x in found), default=0.0), kadane(s))
        assert all(math.isclose(s[a:b].sum(), z) and z > 0 for a, b, z in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))
        # maximal: recursively the best segment, then those of what lies left and right of it
        assert sorted(z for _, _, z in found) == pytest.approx(sorted(_recursive(list(s))))


def _recursive(s):
    best = max(((sum(s[a:b]), a - b, a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0, 0, 0, 0), key=lambda x: (x[0], x[1]))
    if best[0] <= 0:
        return []
    _, _, a, b = best
    return [best[0], *_recursive(s[:a]), *_recursive(s[b:])]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    vocab = ["".join(r.choice("etaonishr") for _ in range(r.randint(3, 8))) for _ in range(400)]
    bad = ["vileword", "nastyone", "foulterm"]
    rows, labels = [], []
    for d in range(600):
        w = [r.choice(vocab) for _ in range(r.randint(20, 120))]
        toxic = int(d % 6 == 0)
        if toxic:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", "s", "ly"]))
        rows.append((d, " ".join(w)))
        labels.append((d, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, corpus, odd, none):
    docs, labels = corpus
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    got = toxicity.score(docs, model, ["doc_id"]).join(labels, "doc_id").where(toxicity.held_out()).collect()
    assert sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in got) >= 0.97 * len(got)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
    one = toxicity.score(spark.createDataFrame([(1, "so a vilewords here")], "doc_id long, text string"), model, ["doc_id"]).first()
    assert "so a vilewords here"[one["passages"][0]["start"] : one["passages"][0]["end"]] == "vilewords"
    scored = toxicity.score(odd, model, ["doc_id"]).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.reject(odd, model).columns == odd.columns
    assert toxicity.score(none, model, ["doc_id"]).count() == 0
    unknown = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(docs, unknown, ["doc_id"]).collect()} == {0.0}
    odd_labels = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (99999, 1)], "doc_id long, toxic int"))
    assert toxicity.train(docs, odd_labels).known


def test_html_held_out():
    net, r = html_extract.default_labeller(), random.Random(1234)
    wrong = blocks = 0
    for _ in range(150):
        x, y = html_extract.labelled(*html_extract.generated_page(r))
        wrong += int(((net.probabilities([x])[0] >= 0.5) != (y > 0.5)).sum())
        blocks += len(y)
    assert wrong <= 0.02 * blocks


def test_html_gradients():
    net, r = html_extract.Labeller(hidden=3, seed=2), random.Random(8)
    pages = [html_extract.labelled(*html_extract.generated_page(r)) for _ in range(3)]
    x, mask = html_extract._padded([p[0] for p in pages])
    y = np.zeros(mask.shape, np.float32)
    for k, p in enumerate(pages):
        y[: len(p[1]), k] = p[1]
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)

    def loss():
        p = net.forward(x.astype(np.float64), mask)[0]
        return -(np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0)).sum() / mask.sum()

    grad, _ = net.gradients(x.astype(np.float64), mask, y)
    for name in ("o", "hf", "xb", "cf", "hb"):
        flat = net.w[name].reshape(-1)
        i = int(np.argmax(np.abs(grad[name].reshape(-1))))
        held = flat[i]
        flat[i] = held + 1e-3
        up = loss()
        flat[i] = held - 1e-3
        down = loss()
        flat[i] = held
        assert grad[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-4)


def test_html_pages(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><article><h1>Head &amp; line</h1><p><b>One  two\n three<br>four<p>Five&nbsp;six</p></article><div class=comments><p>me too</p></div><footer>&copy; us</footer>"
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<div>" * 2000 + "x"), (None, "u", page), (5, "u", "<script>var a='<p>no</p>'</script>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages, ["page_id", "url"]).collect()}
    assert got[1] == got[None] == "Head & line\n\nOne two three four\n\nFive six"
    assert got[2] == got[3] == got[5] == ""
    assert html_extract.extract(pages.where("false"), ["page_id"]).count() == 0


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>When <math><mi>x</mi></math> is small, all is well.</p>", ["When x is small, all is well."]),
        ("<noscript><p>Shown without scripts.</p></noscript><p>Shown always.</p>", ["Shown without scripts.", "Shown always."]),
        ("<object><p>In place of an object.</p></object>", ["In place of an object."]),
        ("<p>Before <svg><title>icon</title><path d=x></svg>after</p><p>next</p>", ["Before after", "next"]),
        ("<p>one</p><svg><g><p>two</p><p>three</p>", ["one", "two", "three"]),
        ("<p>one<svg><path></p><p>two</p>", ["one", "two"]),
        ("<div><template><p>never</div><p>two</p>", ["two"]),
        ("<div><svg><style>never{}</style><text>drawn</text></svg></div><p>two</p>", ["drawn", "two"]),
        ("<p>a<script>never</script>b</p><style>never</style>c<!-- never -->d", ["a", "b", "cd"]),
        ("<svg/><math/><p>two</p><template/><p>three", ["two", "three"]),
    ],
)
def test_html_loses_no_text(html, want):
    assert [t for _, t, _ in html_extract.blocks(html)] == want


def test_query_on_pages(spark, sf_dir):
    import re
    from html import unescape

    from recordsieve.llm.queries import QUERIES

    want = {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        parts = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?(?:b|article)>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want[r["page_id"]] = "\n\n".join(p for p in parts if p)
    got = {r["page_id"]: r["text"] for r in QUERIES["op6_html"](spark, sf_dir).collect()}
    assert got == want


# language model


def test_lm_probabilities_sum_to_one():
    g = np.random.default_rng(1)
    net = lm_score.Network(np.full(60, 1 / 60))
    for p in net.parts():
        p += g.normal(size=p.shape).astype(np.float32) * 0.3
    net.c.reshape(-1)[60:] = -30
    around = np.repeat(g.integers(0, 60, (1, 2 * lm_score.SIDE)), 60, 0)
    assert np.exp(net.log_probability(around, np.arange(60))).sum() == pytest.approx(1, abs=1e-3)


def test_lm_gradients():
    g = np.random.default_rng(2)
    net = lm_score.Network(np.full(30, 1 / 30))
    for p in net.parts():
        p += g.normal(size=p.shape).astype(np.float32) * 0.2
    around, token = g.integers(0, 30, (40, 2 * lm_score.SIDE)), g.integers(0, 30, 40)
    for p, d in zip(net.parts(), net.gradients(around, token), strict=True):
        i = np.unravel_index(np.argmax(np.abs(d)), d.shape)
        held = p[i]
        p[i] = held + 1e-2
        up = -net.log_probability(around, token).mean()
        p[i] = held - 1e-2
        down = -net.log_probability(around, token).mean()
        p[i] = held
        assert d[i] == pytest.approx((up - down) / 2e-2, rel=0.1, abs=1e-3)


def gradients_by_rows(net, around, token):
    """The gradients with an example a row, and the parts of the hidden layer added up by reduceat."""
    n, row = len(token), np.arange(len(token))
    order = np.argsort(token // net.m, kind="stable")
    token, key = token[order], around[order].astype(np.int32) + np.arange(2 * lm_score.SIDE, dtype=np.int32) * len(net.e)
    cls, at = token // net.m, token % net.m
    placed = np.matmul(net.e, net.w).reshape(-1, lm_score.WIDTH)
    h = np.tanh(sum((placed[key[:, k]] for k in range(1, 2 * lm_score.SIDE)), placed[key[:, 0]] + net.b))

    def error(z, at):
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[row, at] -= 1
        return z / n

    z = error(h @ net.k.T + net.d, cls)
    dk, dd, dh = z.T @ h, z.sum(0), z @ net.k
    runs = [(c, *np.searchsorted(cls, [c, c + 1])) for c in np.unique(cls)]
    z = np.empty((n, net.m), np.float32)
    for c, a, b in runs:
        z[a:b] = h[a:b] @ net.o[c].T + net.c[c]
    z = error(z, at)
    do, dc = np.zeros_like(net.o), np.zeros_like(net.c)
    for c, a, b in runs:
        do[c], dc[c] = z[a:b].T @ h[a:b], z[a:b].sum(0)
        dh[a:b] += z[a:b] @ net.o[c]
    da = dh * (1 - h * h)
    key = key.ravel()
    by_key = np.argsort(key.astype(np.uint16), kind="stable")
    key = key[by_key]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    placed = np.zeros_like(placed)
    placed[key[first]] = np.add.reduceat(da[by_key // (2 * lm_score.SIDE)], first, axis=0)
    placed = placed.reshape(2 * lm_score.SIDE, -1, lm_score.WIDTH)
    return [np.matmul(placed, net.w.transpose(0, 2, 1)).sum(0), np.matmul(net.e.T, placed), da.sum(0), dk, dd, do, dc]


def test_lm_gradients_cost():
    """A full batch over a full vocabulary: the same gradients as by rows, for clearly less CPU time."""
    g = np.random.default_rng(4)
    size = 1 + lm_score.VOCAB + lm_score.RARE
    net = lm_score.Network(1 / np.arange(1, size + 1))
    for p in net.parts():
        p += g.normal(size=p.shape).astype(np.float32) * 0.2
    draw = lambda *shape: (size ** g.random(shape)).astype(np.uint16)
    around, token = draw(lm_score.BATCH, 2 * lm_score.SIDE), draw(lm_score.BATCH)

    def least(f):
        took = []
        for _ in range(15):
            began = time.thread_time()
            f(around, token)
            took.append(time.thread_time() - began)
        return min(took)

    for p, q in zip(net.gradients(around, token), gradients_by_rows(net, around, token), strict=True):
        assert np.abs(p - q).max() <= 1e-4 * np.abs(q).max()
    assert least(net.gradients) < 0.85 * least(lambda a, t: gradients_by_rows(net, a, t))


def chained(r, n):
    rows = []
    for d in range(n):
        w = r.choice("abcdefgh")
        rows.append((d, " ".join(f"{w}{r.randrange(3)}" for _ in range(60))))
    return rows


def test_lm_cases(spark, odd, none):
    r = random.Random(6)
    docs = spark.createDataFrame(chained(r, 250), "doc_id long, text string")
    v, net = model = lm_score.train(docs)
    learned = lm_score.score(docs, model, ["doc_id"]).selectExpr("avg(mean_pll)").first()[0]
    mixed = spark.createDataFrame([(d, " ".join(f"{r.choice('abcdefgh')}{r.randrange(3)}" for _ in range(60))) for d in range(30)], "doc_id long, text string")
    assert lm_score.score(mixed, model, ["doc_id"]).selectExpr("avg(mean_pll)").first()[0] < learned - 0.3
    got = lm_score.score(odd, model, ["doc_id"]).collect()
    assert len(got) == odd.count() and all((x["mean_pll"] is None) == (x["n_tokens"] == 0) for x in got)
    assert lm_score.train(none) is None
    assert lm_score.fit_and_score(none, ["doc_id"]).count() == 0
    assert [(x["n_tokens"], x["pll"]) for x in lm_score.score(docs.limit(1), None, ["doc_id"]).collect()] == [(60, 0.0)]


def brute_pll(texts, v, net, counts, classes):
    """The pseudo-log-likelihood of each text, word by word in float64, with softmaxes over whole classes."""
    from recordsieve.llm import textkernel as K

    out = []
    for text in texts:
        words = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
        token, share = [], 0.0
        for x in words:
            w = K.words(next(K.slices(pa.array([x.decode()]))), K.WORD_LOWER)
            h, k = int(K.word_hash(w)[0]), int(lm_score.rare_class(w)[0])
            at = np.flatnonzero(v.hashes == np.uint64(h))
            token.append(int(v.tokens[at[0]]) if len(at) else v.size - lm_score.RARE + k)
            if not len(at):
                share += math.log((counts.get(x, 0) + 0.5) / (sum(n for y, n in counts.items() if classes[y] == k) + 0.5 * (1 + sum(c == k for c in classes.values()))))
        total = share
        for i, t in enumerate(token):
            a = net.b.astype(np.float64)
            for place, d in enumerate([-3, -2, -1, 1, 2, 3]):
                other = token[i + d] if 0 <= i + d < len(token) else 0
                a = a + net.e[other].astype(np.float64) @ net.w[place].astype(np.float64)
            hidden = np.tanh(a)
            z = net.k @ hidden + net.d
            y = net.o[t // net.m] @ hidden + net.c[t // net.m]
            total += z[t // net.m] - np.log(np.exp(z).sum()) + y[t % net.m] - np.log(np.exp(y).sum())
        out.append(total)
    return out


@pytest.mark.parametrize("known", [lm_score.KNOWN, 12])
def test_lm_brute_force(spark, known, monkeypatch):
    """Every text's score against word-by-word sums, with all counts broadcast and with most of them joined."""
    from collections import Counter

    from recordsieve.llm import textkernel as K

    monkeypatch.setattr(lm_score, "KNOWN", known)
    r = random.Random(9)
    texts = [t for _, t in chained(r, 40)] + [" ".join(r.choice("xyz") + str(r.randrange(300)) for _ in range(30)) for _ in range(20)] + ["never", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    v, net = lm_score.train(docs, size=12)
    assert v.complete == (known > 12)
    counts = Counter(x.encode() for t in texts for x in t.split())
    rare = {}
    for x in counts:
        w = K.words(next(K.slices(pa.array([x.decode()]))), K.WORD_LOWER)
        if int(K.word_hash(w)[0]) not in set(v.hashes.tolist()):
            rare[x] = int(lm_score.rare_class(w)[0])
    texts.append("a0 unheard words x5")
    more = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [x["pll"] for x in sorted(lm_score.score(more, (v, net), ["doc_id"]).collect())]
    assert got == pytest.approx(brute_pll(texts, v, net, {x: counts[x] for x in rare}, rare), rel=1e-4, abs=1e-3)


def test_lm_tells_texts_that_occur_twice(spark):
    """Rare words are weighed by their own counts: a text that stands twice is likelier than one that stands once."""
    r = random.Random(12)
    texts = [" ".join("".join(r.choice("etaonishr") for _ in range(7)) for _ in range(80)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:20])), "doc_id long, text string")
    got = {x["doc_id"]: x["mean_pll"] for x in lm_score.fit_and_score(docs, ["doc_id"]).collect()}
    assert min(got[d] for d in range(20)) > max(got[d] for d in range(20, 60))


def test_lm_learns_from_every_token():
    g = np.random.default_rng(3)
    lengths = np.array([0, 1, 2, 50, 700, 700, 0])
    off = np.append(0, np.cumsum(lengths))
    token = g.integers(0, 9, off[-1]).astype(np.uint16)
    for rounds in (1, lm_score.ROUNDS, 3):
        turns = sum(lm_score._turn(token, off, k, -(-1_000_000 // rounds)).astype(int) for k in range(rounds))
        assert len(turns) == len(token) and (turns == 1).all()


def test_lm_learns_by_default(spark):
    docs = spark.createDataFrame(chained(random.Random(6), 300), "doc_id long, text string")
    v, net = lm_score.train(docs.where("doc_id < 250"))
    held = docs.where("doc_id >= 250")
    learned, plain = (lm_score.score(held, (v, x), ["doc_id"]).selectExpr("sum(pll) / sum(n_tokens)").first()[0] for x in (net, lm_score.Network(v.unigram)))
    assert learned > plain + 0.3


def brute_segments(s):
    """Scores of the maximal segments: the best one (the shortest of ties, the leftmost), then those on both its sides."""
    found, todo = [], [(0, len(s))]
    while todo:
        a, b = todo.pop()
        best, here, start, at = 0.0, 0.0, a, None
        for i in range(a, b):
            if here <= 0:
                here, start = 0.0, i
            here += s[i]
            if here > best + 1e-9:
                best, at = here, (start, i + 1)
        if at:
            found.append(best)
            todo += [(a, at[0]), (at[1], b)]
    return found


def brute_toxic(model, text):
    """The score of a text from the model's steps alone, token by token."""
    from recordsieve.llm import textkernel as K

    steps = dict(zip(model.features.tolist(), model.steps.tolist(), strict=True))
    scores = []
    for token in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode()):
        w = K.Words(np.array([0]), np.array([len(token)]), np.array([0]), np.frombuffer(token.lower(), np.uint8), np.array([0, 1]))
        hashes = [int(h[0]) for h in toxicity._chain(w)]
        scores.append(sum(steps.get(h, 0.0) for h in hashes if h or 0 in steps) - toxicity.DRIFT)
    found = sorted(brute_segments(scores), reverse=True)
    n = max(len(scores), 1)
    chance = max(0.0, math.log(n * max(model.k, 1e-9)))
    total = sum(found[:1]) + sum(max(0.0, z - chance - 2) for z in found[1:])
    x = model.slope * (total - math.log(n * model.k)) + model.offset
    return 1 / (1 + math.exp(-min(40, max(-40, x))))


def test_pipeline(spark, sf_dir):
    """Every stage on what the one before kept, held against plain Python."""
    import corpus_pipeline as c
    from recordsieve.llm import cluster
    from test_exact import WORDS, brute_components, brute_contaminated

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    words = next(t for _, t in items if len(t.split()) >= 12).split()
    planted = " ".join(f"plain{i}" for i in range(30)) + " " + " ".join(words[:10])
    docs = docs.unionByName(spark.createDataFrame([(10**9, planted, "en", "a", len(planted))], docs.schema))
    model = toxicity.taught(spark, sf_dir)
    kept = [docs]
    for name, stage in c.STAGES:
        kept.append(cluster.written(stage(spark, kept[-1], sf_dir), name.replace(" ", "")))
        assert kept[-1].columns == docs.columns
    rows = [[tuple(r) for r in k.collect()] for k in kept]
    texts = [[(r[0], r[1]) for r in x] for x in rows]
    scores = {d: brute_toxic(model, t) for d, t in texts[0]}
    assert sorted(d for d, _ in texts[1]) == sorted(d for d, s in scores.items() if s < 0.5)
    import ast

    groups = {ast.literal_eval(x)[2] for x in brute_components(texts[1], 5, 80)}
    assert sorted(d for d, _ in texts[2]) == sorted(groups) and len(groups) < len(texts[1])
    gone = brute_contaminated([t for _, t in texts[2]], items)
    assert sorted(d for d, _ in texts[3]) == sorted(d for (d, _), g in zip(texts[2], gone, strict=True) if not g)
    assert 10**9 in {d for d, _ in texts[2]} - {d for d, _ in texts[3]}
    source, size, taken, cuts = {r[0]: r for r in rows[3]}, {}, {}, {}
    for d, text, lang, src, n in rows[4]:
        whole = source[d]
        size[d] = len(WORDS.findall(whole[1]))
        assert (lang, src) == (whole[2], whole[3]) and n == len(text) and whole[1].startswith(text)
        taken[d] = taken.get(d, 0) + len(WORDS.findall(text))
        cuts[src] = cuts.get(src, 0) + (text != whole[1])
    assert all(t <= 2 * size[d] for d, t in taken.items()) and all(n <= 1 for n in cuts.values())
    assert abs(sum(taken.values()) - 1.5 * sum(len(WORDS.findall(r[1] or "")) for r in rows[3])) <= len(cuts)
    assert sorted(map(repr, rows[4])) == sorted(map(repr, rows[5]))


def test_pipeline_odd_and_empty(spark, sf_dir, odd, none):
    import corpus_pipeline as c
    from recordsieve.llm import cluster

    rows = odd
    for name, stage in c.STAGES:
        rows = cluster.written(stage(spark, rows, sf_dir), name.replace(" ", ""))
        assert rows.columns == odd.columns and rows.where("n_words <> 'extra' or shard <> 'extra' or size <> 'extra'").count() == 0
    assert rows.where("doc_id = 6").count() >= 1
    for name, stage in c.STAGES:
        if name != "near duplicates":  # test_deduplicate has that one
            assert stage(spark, none, sf_dir).count() == 0


def test_toxicity_by_brute_force(spark, corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score(docs, model, ["doc_id"]).collect():
        assert r["score"] == pytest.approx(brute_toxic(model, texts[r["doc_id"]]), abs=1e-6)
