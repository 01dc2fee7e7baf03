"""Operators against brute force, and their defined cases."""

import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordsieve.llm import components, decontaminate, mixing, ngram_join, quality, repeats, sharding, suffix_array, url_filter

from llm_helpers import bag

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


# suffix arrays and repeats


@pytest.mark.parametrize("dense", [1, 4, 64])
def test_suffix_array(dense, monkeypatch):
    monkeypatch.setattr(suffix_array, "DENSE", dense)
    g = np.random.default_rng(dense)
    for trial in range(60):
        t = g.integers(1, g.integers(2, 6), g.integers(1, 300))
        t = np.append(np.tile(t, 3) if trial % 3 == 0 else t, 0)
        assert suffix_array.suffix_array(t, int(t.max()) + 1).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def brute_repeats(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for i, r in enumerate(raws):
        for j in range(len(r) - length + 1):
            seen.setdefault(r[j : j + length], []).append((i, j))
    cover = [np.zeros(len(r) + 1, int) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for i, j in places:
                cover[i][j] += 1
                cover[i][j + length] -= 1
    out = []
    for r, c in zip(raws, cover, strict=True):
        gone = np.cumsum(c)[: len(r)] > 0
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


def found_repeats(docs):
    rows = repeats.remove(docs, ["doc_id"]).collect()
    return sorted((r["n_bytes"], sum(e - s for s, e in r["removed"]), len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows)


@pytest.mark.parametrize("crowd", [2, 2048])
def test_repeats(spark, sf_dir, odd, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    texts = [r["text"] for r in docs.collect()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert found_repeats(docs) == sorted(brute_repeats(texts))
    small = odd.where("doc_id is null or doc_id <> 6")
    assert found_repeats(small) == sorted(brute_repeats([r["text"] for r in small.collect()]))


def test_repeats_edges(spark, none):
    passage = "".join(chr(97 + i * 7 % 26) for i in range(230))
    texts = [f"{i:03d}" * 40 + passage + f"x{i * 31:05d}" * 30 for i in range(30)] + ["ab" * 400, "z" * 199, "z" * 201]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found_repeats(docs) == sorted(brute_repeats(texts))
    assert repeats.remove(none, ["doc_id"]).count() == 0


# n-gram join


def brute_components(rows, k, percent):
    sets = []
    for _, text in rows:
        w = WORDS.findall(lower(text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return sorted(repr((d, len(sets[i]), d if not sets[i] else ids.get(root(i)))) for i, (d, _) in enumerate(rows))


def near_copies(n, edits):
    g = np.random.default_rng(5)
    base = [f"word{i}" for i in range(200)]
    rows = []
    for d in range(n):
        w = list(base)
        for at in g.choice(200, edits, replace=False):
            w[at] = f"new{d}x{at}"
        rows.append((d, " ".join(w)))
    return rows


@pytest.mark.parametrize(("k", "percent", "block"), [(4, 85, 512), (5, 80, 8), (1, 50, 4)])
def test_ngram_join(spark, odd, k, percent, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SET_BLOCK", block)
    monkeypatch.setattr(ngram_join, "HEAVY_ROWS", 8)
    rows = near_copies(40, 4) + [(100 + d, t) for d, t in near_copies(20, 9)] + [(200, "one two"), (201, "ONE two"), (202, "two one"), (203, ""), (204, None), (200, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(repr(tuple(r)) for r in ngram_join.link(docs, k=k, percent=percent).collect())
    assert got == brute_components(rows, k, percent)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(repr(tuple(r)) for r in ngram_join.link(odd, k=k, percent=percent).collect()) == brute_components(rows, k, percent)


def test_signatures_of_long_texts():
    """Unrelated texts of very many words are told apart by their bits; near copies of them are not lost."""
    from recordsieve.llm.textkernel import mix

    for n in (2000, 12_000, 30_000):
        a, b = (np.unique(mix(np.arange(n, dtype=np.uint64) + np.uint64(s))) for s in (1, 1_000_000))
        apart = lambda p, q: int(np.bitwise_count(np.frombuffer(ngram_join._signature(p), np.uint64) ^ np.frombuffer(ngram_join._signature(q), np.uint64)).sum())
        assert not ngram_join._admitted(n, n, apart(a, b), 80)
        near = np.concatenate([a[: n * 9 // 10], b[n * 9 // 10 :]])
        assert ngram_join._admitted(n, n, apart(a, near), 80)


def test_pairs_are_judged_in_the_band_of_the_smaller_set(spark):
    """Sets of one size band, in its own tile and as the upper band of the tile before, whose signatures are too narrow for them."""
    from recordsieve.llm.textkernel import mix

    n, band = 1560, 32  # 0.8 ** -32 is 1262, 0.8 ** -31 is 1010
    rows = []
    for node in range(20):
        sig = ngram_join._signature(mix(np.arange(n, dtype=np.uint64) + np.uint64(node * 10_000)))
        rows += [(1, tile, 0, 0, 0, node, node, n, tile == band, bytearray(sig)) for tile in (band - 1, band)]
    rows += [(1, band, 0, 0, 0, 20, 20, n, True, rows[-1][-1])]  # a copy of the last
    docs = spark.createDataFrame(rows, "token long, tile long, i long, j long, blk long, node long, label long, n long, low boolean, sig binary")
    assert [tuple(r) for r in ngram_join._admitted_forest(docs, 80, 0.8).collect()] == [(20, 19)]


def test_written_lets_shuffle_files_go(spark):
    from recordsieve.llm.cluster import drop, written

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, own = spark.conf.get(key, None), []
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles
    held = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", folder().toString()))
    files = held()
    out = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t", own)
    for _ in range(20):
        if held() <= files:
            break
        time.sleep(0.1)
    assert held() <= files and out.count() == 7
    assert spark.conf.get(key, None) == before
    drop(spark, own)


def test_deduplicate(spark, odd, none):
    got = ngram_join.deduplicate(odd)
    assert got.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(["1", "3", "4", "5", "6", "7", "8", "None"])  # (null, base) is linked with 1
    assert ngram_join.deduplicate(none).count() == 0


def test_deduplicate_by_row(spark):
    text = lambda a: " ".join(f"{a}{i}" for i in range(60))
    rows = [
        (1, text("a"), "one"),
        (None, text("a") + " tail", "near copy without an id"),
        (7, text("a"), "copy of 1"),
        (7, text("b"), "a text of its own under the same id"),
        (8, text("c"), "one"),
        (8, text("d"), "another text under one id"),
        (8, text("d"), "a copy"),
        (None, text("e"), "no id"),
        (None, text("e"), "no id, copy"),
        (9, text("f"), "alone"),
        (5, None, "blank"),
        (5, " ", "blank"),
        (None, "", "blank, no id"),
        (None, None, "blank, no id"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string").selectExpr("*", "'x' AS id", "'x' AS lead")
    got = sorted(f"{r['doc_id']} {(r['text'] or '').strip()[:1]}" for r in ngram_join.deduplicate(docs).collect())
    assert got == sorted(["1 a", "7 b", "8 c", "8 d", "None e", "9 f", "5 ", "None ", "None "])


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (1, 2), (None, 4)] + [(100 + i, 101 + i) for i in range(60)] + [(500, 501 + i) for i in range(50)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got[3] == 1 and got[9] == 8 and got[160] == 100 and got[550] == 500 and 5 not in got
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# decontamination


def test_decontamination(spark, odd, none):
    base = "the quick brown fox jumps over the lazy dog while seven wise owls"
    items = spark.createDataFrame([(1, base), (2, "Short Text"), (3, None), (4, "!!!"), (None, base), (10, "日本語"), (1, base)], "item_id long, text string")
    got = {(r["doc_id"], r["hits"]["n_words"]): r["hits"] for r in decontaminate.scan(odd, items, ["doc_id"]).collect()}
    assert got[(1, 72)]["items"] == ["1"] and got[(1, 72)]["n_hit"] == 39 and len(got[(1, 72)]["spans"]) == 3
    assert got[(None, 2)]["items"] == ["2"] and got[(None, 2)]["n_hit"] == 2
    assert got[(3, 0)]["n_hit"] == 0
    text = "x The QUICK brown fox jumps over the lazy dog, y"
    docs = spark.createDataFrame([(1, text), (2, "short text and the quick brown fox jumps over the lazy")], "doc_id long, text string")
    assert [r["text"] for r in decontaminate.clean(docs.where("doc_id = 1"), items, remove="spans").collect()] == ["x , y"]
    assert decontaminate.clean(docs, items).count() == 0  # a whole window of one item; two items
    short = docs.selectExpr("doc_id", "'just a short text here' AS text").limit(1)
    assert decontaminate.clean(short, items).count() == 1  # a short item alone
    assert decontaminate.clean(odd, items).columns == odd.columns
    named = items.selectExpr("concat('item-', item_id) AS item_id", "text")
    assert decontaminate.scan(docs.where("doc_id = 2"), named, ["doc_id"]).first()["hits"]["items"] == ["item-1", "item-2"]
    assert decontaminate.scan(none, items, ["doc_id"]).count() == 0
    assert decontaminate.clean(odd, items.where("false")).count() == odd.count()


def test_decontamination_in_blocks(spark, sf_dir, monkeypatch):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = bag(decontaminate.scan(docs, items, ["doc_id"]))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 300)
    assert bag(decontaminate.scan(docs, items, ["doc_id"])) == whole


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows(text, k=8):
    w = ALNUM.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_contaminated(texts, items):
    """Of each text whether it goes: plain sets of 8-grams, and items by their own windows."""
    grams = {}
    for i, t in items:
        w = ALNUM.findall(lower(t or ""))
        if i is not None and w:
            grams.setdefault(i, set()).update(windows(t, min(8, len(w))))
    out = []
    for text in texts:
        own = {k: windows(text, k) for k in range(1, 9)}
        hits = [i for i, g in grams.items() if any(x in own[len(x)] for x in g)]
        out.append(len(hits) >= 2 or any(len(x) == 8 and x in own[8] for i in hits for x in grams[i]))
    return out


def test_clean_by_brute_force(spark, sf_dir, odd):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    known = [(r["item_id"], r["text"]) for r in items.collect()]
    words = next(t for _, t in known if len(ALNUM.findall(t)) >= 12).split()
    more = spark.createDataFrame([(-1, "x " + " ".join(words[:9]) + " y"), (-2, " ".join(words[:7]) + " y"), (-3, None)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more)
    texts = [(r["doc_id"], r["text"]) for r in rows.collect()]
    gone = brute_contaminated([t for _, t in texts], known)
    assert any(gone) and not all(gone)
    want = sorted(d for (d, _), g in zip(texts, gone, strict=True) if not g)
    assert -1 not in want and -2 in want and -3 in want
    assert sorted(r["doc_id"] for r in decontaminate.clean(rows, items).collect()) == want


# mixing


def test_mixing(spark, sf_dir, odd, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = mixing.plan(docs, shard_words=4000)
    rows = plan.collect()
    total = sum(r["size"] for r in rows)
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - 1.5 * total) < 1e-6 * total
    by = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"] and r["taken"] == sum(c["words"] for c in r["copies"])
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(int(t) == n for t, n in by.values())
    assert bag(plan) == bag(mixing.plan(docs.repartition(5), shard_words=4000))
    mix = mixing.mix(docs, shard_words=4000)
    assert sum(len(WORDS.findall(r["text"])) for r in mix.collect()) == sum(n for _, n in by.values())
    shards = [r["shard"] for r in mix.select("shard").distinct().collect()]
    assert len(shards) > 4
    drawn = mixing.plan(odd.drop("size", "target", "shard")).collect()
    assert len(drawn) == odd.count() and all(r["taken"] == 0 for r in drawn if not (r["text"] or "").strip())
    assert "extra" not in {r["target"] for r in mixing.plan(odd).collect()}
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_splitting_tree(spark):
    quotas = spark.createDataFrame([(1, 40), (2, 25), (3, 0), (4, 1)], "sid int, drawn long")
    got = mixing._tree(quotas, 7).collect()
    by_source, by_shard = {}, {}
    for r in got:
        by_source[r["sid"]] = by_source.get(r["sid"], 0) + r["quota"]
        by_shard[r["shard"]] = by_shard.get(r["shard"], 0) + r["quota"]
    assert by_source == {1: 40, 2: 25, 4: 1}
    assert set(by_shard) == set(range(7)) and max(by_shard.values()) - min(by_shard.values()) <= 2


def test_splitting_tree_by_a_plain_sort(spark):
    """The left half of every node holds its tickets with the least hashes."""
    quotas = {1: 40, 2: 25, 4: 90}
    tickets = [(sid, k) for sid, n in quotas.items() for k in range(1, n + 1)]
    nodes = {(0, 5): tickets}
    for level in range(3):
        below = {}
        for (lo, hi), found in nodes.items():
            if hi - lo <= 1:
                below[lo, hi] = found
                continue
            rows = spark.createDataFrame(found, "sid int, ticket long")
            marked = rows.selectExpr("sid", "ticket", f"xxhash64('{mixing.SEED}', {level}, {lo}, sid, ticket) AS h").collect()
            order = [(r["sid"], r["ticket"]) for r in sorted(marked, key=lambda r: (r["h"], r["sid"], r["ticket"]))]
            mid = (lo + hi) // 2
            cut = len(order) * (mid - lo) // (hi - lo)
            below[lo, mid], below[mid, hi] = order[:cut], order[cut:]
        nodes = below
    want = {}
    for (lo, _), found in nodes.items():
        for sid, _ in found:
            want[sid, lo] = want.get((sid, lo), 0) + 1
    got = mixing._tree(spark.createDataFrame(list(quotas.items()), "sid int, drawn long"), 5).collect()
    assert {(r["sid"], r["shard"]): r["quota"] for r in got} == want


def test_mixing_ties(spark):
    """Rows of one id, or without one, that differ in their text only: the mixture is the same in any order of rows."""
    rows = [(d if d % 3 else None, "ab"[d % 2], " ".join(f"{chr(97 + k)}{d}" for k in range(6))) for d in range(60)] + [(1, "a", f"one two three {k}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert bag(mixing.mix(docs)) == bag(mixing.mix(docs.orderBy(F.desc("text")).repartition(3)))


# quality


def test_quality_odd(spark, odd, none):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.judge(odd).collect()}
    assert got[(3, 0)]["base_failed"] and not got[(3, 0)]["kept"]
    assert got[(1, 72)]["base_failed"] and got[(1, 72)]["n_repeat_words"] == 72
    assert got[(6, 40000)]["kept"]
    assert quality.judge(none).count() == 0


def test_sketch_merges(spark):
    rows = spark.range(5000).selectExpr("id % 7 AS g", "id * id AS x")
    bins = rows.select("g", quality.cut(rows["x"]).alias("bin")).groupBy("g", "bin").count().selectExpr("g", "'m' AS measure", "bin", "count AS c")
    whole = quality.quartiles(quality.merge(bins, []), []).first()
    exact = sorted(i * i for i in range(5000))
    assert abs(whole["q1"] - exact[1249]) <= exact[1249] / 64 and abs(whole["q3"] - exact[3749]) <= exact[3749] / 64
    assert whole["n"] == 5000


# urls


def test_aliases(spark):
    rows = [
        (1, "http://a.net/en/1", '<link rel="canonical" href="http://b.net/fr/x">'),
        (2, "http://c.org/a/b", '<meta http-equiv="refresh" content="0; url=/es">'),
        (3, "http://c.org/es#x", '<LINK href="http://z.com/" rel=canonical>'),
        (4, "http://z.com/", None),
        (5, None, "x"),
        (6, "nope", '<link rel="canonical" href="http://b.net/fr/x">'),
        (7, "http://d.org/q", '<link rel="canonical" href="http://a.net/en/1">'),
        (8, "HTTP://WWW.Example.COM/en/x?y#z", None),
        (9, "http://example.com", None),
        (9, "http://example.com", None),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1][3] == "block" and got[7][3] == "block"  # an alias is blocked
    assert got[2][3] == "allow" and got[3][3] == "allow"  # an alias is allowed
    assert got[4] == ("z.com", "/", "com/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[8] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[9] == ("example.com", "", None, "allow")
    both = [(1, "http://p.org/1", '<link rel="canonical" href="http://b.net/fr/x">'), (2, "http://p.org/2", '<link rel="canonical" href="http://p.org/1"><link rel="canonical" href="http://q.com/">')]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(both, "page_id long, url string, html string")).collect()}
    assert got == {1: "allow", 2: "allow"}  # an explicit allow goes before a block
    redirects = spark.createDataFrame([("http://r.org/", "http://n.net/es/1"), (None, "x")], "src string, dst string")
    pages = spark.createDataFrame([(1, "http://r.org/", None)], "page_id long, url string, html string")
    assert url_filter.judge(pages, redirects=redirects).first()["verdict"] == "block"
    assert url_filter.judge(pages.where("false")).count() == 0


def test_many_rules(spark):
    """Thousands of rules, by a plain scan of all rules for every url."""
    import random

    r = random.Random(5)
    hosts = [f"{a}.{b}" for a in ("x", "y", "www.x", "a.b.c") for b in ("com", "net", "co.uk")] + ["com", "net"]
    rules = [(r.choice(["allow", "block"]), r.choice(hosts), "/" + "/".join(r.choice("pqrs") for _ in range(r.randint(0, 5)))) for _ in range(3000)]
    urls = [(i, f"http://{r.choice(['', 'm.'])}{r.choice(hosts)}/" + "/".join(r.choice("pqrs") for _ in range(r.randint(0, 7))), None, 1, "x") for i in range(200)]

    def best(url):
        rest = url.split("://")[1]
        h, _, p = rest.partition("/")
        fits = [(-len(a + b), v != "allow", a + b, v) for v, a, b in rules if (h == a or h.endswith("." + a)) and ("/" + p).startswith(b)]
        return min(fits)[2:] if fits else (None, "allow")

    pages = spark.createDataFrame(urls, "page_id long, url string, html string, verdict long, host string")  # columns that clash
    got = {x["page_id"]: (x["rule"], x["verdict"]) for x in url_filter.judge(pages, rules).collect()}
    assert got == {i: best(u) for i, u, *_ in urls}
    assert {x["verdict"] for x in url_filter.judge(pages, []).collect()} == {"allow"}


# sharding


def test_store(spark, odd, none, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=60_000)
    store.append(odd.repartition(9))
    store.append(odd.repartition(9))
    before = store.manifest()
    assert len(before["lists"]) == 2  # an append writes the list of its own shards
    store.compact()
    after = store.manifest()
    assert after["version"] == before["version"] + 1 and len(after["shards"]) < len(before["shards"])
    assert bag(store.read()) == bag(odd.unionByName(odd)) == bag(store.read(before["version"]))
    store.vacuum()
    assert bag(store.read()) == bag(odd.unionByName(odd))
    assert sum(s.rows for s in after["shards"]) == 2 * odd.count()
    # a write that is not committed yet outlives a vacuum
    base, more = store.manifest(), store._write(odd)
    store.vacuum()
    store._commit(base, base["schema"], [*base["shards"], *more])
    assert store.read().count() == 3 * odd.count() and set(base["lists"]) < set(store.manifest()["lists"])
    lost = store._write(odd)
    store.vacuum(grace=-60)
    assert {f.getPath().getName() for f in store._files("manifest/lists")} == set(store.manifest()["lists"])
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND"):
        spark.read.parquet(lost[0].path).count()
    assert store.read().count() == 3 * odd.count()
    with pytest.raises(sharding.CommitConflict):
        store._commit(before | {"version": after["version"] - 1}, after["schema"], [])
    with pytest.raises(ValueError):
        store.append(odd.drop("score"))
    assert sharding.shard(none, f"file://{tmp_path}/n").read().count() == 0
