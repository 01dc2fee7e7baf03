"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf sequence: text blocks in page order, each with the path of open
elements (tags, class and id words, roles) above it. A bidirectional LSTM in numpy reads a vector of
hashed path words, hashed text words and a few counts for every block, and labels each as article
text or not with the whole page as context. Kept blocks are joined by two line feeds.

The labeller is trained here, on ``TRAIN_PAGES`` generated pages of known labels (menus, headers,
footers, side bars, notices, adverts, forms, comments around articles, in semantic and in class
markup, with unclosed elements), from a fixed seed; ``train`` takes other labelled pages as well.

Defined cases: null or empty html and pages without text give the empty text; text outside any
element is a block; scripts, styles, templates, the metadata of drawings and markup comments are
never text, and end with the element around them at the latest; formulas and drawings are inline, and what
noscript, object and iframe hold is read like any other block; character references are decoded once; white space of any kind inside a block becomes one space; blocks of
any length are read whole; repeated rows give equal texts; other columns are not read.
"""

from __future__ import annotations

import random
import re
import zlib
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .cluster import text_batches, tidy

TRAIN_PAGES, EPOCHS, HIDDEN, SEED = 600, 8, 16, 7
PATH_DIM, WORD_DIM, COUNTS = 96, 24, 6
STEPS = 20_000

#: Elements whose contents are no text of the page. Their end, or that of an element around them, ends them.
_SKIP = {"script", "style", "template"}
#: Elements of other vocabularies: all tags inside are inline, but for the metadata of drawings.
_FOREIGN, _METADATA = {"svg", "math"}, {"title", "desc", "metadata"}
#: Elements whose contents stand for something else: they are read as if the element were not there.
_TRANSPARENT = {"noscript", "object", "iframe"}
#: Elements that end an open foreign element.
_BREAKOUT = {"address", "article", "aside", "blockquote", "body", "center", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An element of the key ends when one of these starts inside it.
_CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_WORDS = re.compile(r"[a-z]+")


class _Reader(HTMLParser):
    """Blocks of (path, text, link characters)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.blocks: list[tuple[str, str, int]] = []
        self.parts: list[str] = []
        self.links = self.in_link = self.skip = self.foreign = self.quiet = 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((" ".join(x for _, x in self.stack), text, self.links))
        self.parts, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in _FOREIGN:
            self.foreign += 1
            return
        if self.foreign and tag not in _SKIP:
            if tag not in _BREAKOUT:
                self.quiet += tag in _METADATA
                return
            self.foreign = self.quiet = 0
        if tag in _INLINE:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "a":
                self.in_link = 1
            return
        self.flush()
        self.in_link = 0
        if tag in _VOID:
            return
        for name, enders in _CLOSED_BY.items():
            if self.stack and self.stack[-1][0] == name and (enders is None or tag in enders):
                self.stack.pop()
        named = dict(attrs)
        words = [] if tag in _TRANSPARENT else [tag, *(f"{tag}.{w}" if k == "role" else w for k in ("class", "id", "role") for w in _WORDS.findall((named.get(k) or "").lower()))]
        if words and ("hidden" in named or "display:none" in (named.get("style") or "").replace(" ", "")):
            words.append("hidden")
        self.stack.append((tag, " ".join(words)))
        self.skip += tag in _SKIP

    def handle_startendtag(self, tag, attrs):
        if tag not in _SKIP and tag not in _FOREIGN and not self.foreign:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in _FOREIGN:
            self.foreign = max(0, self.foreign - 1)
            self.quiet *= self.foreign > 0
            return
        if self.foreign and tag not in _SKIP:
            if not any(t == tag for t, _ in self.stack):
                self.quiet = max(0, self.quiet - (tag in _METADATA))
                return
            self.foreign = self.quiet = 0
        if tag in _INLINE:
            if tag == "a":
                self.in_link = 0
            return
        self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.skip -= sum(t in _SKIP for t, _ in self.stack[i:])
                del self.stack[i:]
                break

    def handle_data(self, data):
        if not self.skip and not self.quiet:
            self.parts.append(data)
            if self.in_link:
                self.links += len(data)


def blocks(html: str | None) -> list[tuple[str, str, int]]:
    """(path words, text, characters in links) of each text block, in page order."""
    if not html:
        return []
    r = _Reader()
    r.feed(html)
    r.close()
    r.flush()
    return r.blocks


@lru_cache(100_000)
def _path_vector(path: str) -> bytes:
    v = np.zeros(PATH_DIM, np.float32)
    for w in path.split():
        h = zlib.crc32(w.encode())
        v[h % PATH_DIM] = 1
        v[(h >> 12) % PATH_DIM] = 1
    return v.tobytes()


def vectors(page: list[tuple[str, str, int]]) -> np.ndarray:
    out = np.zeros((len(page), PATH_DIM + WORD_DIM + COUNTS), np.float32)
    if not page:
        return out
    out[:, :PATH_DIM] = np.frombuffer(b"".join(_path_vector(p) for p, _, _ in page), np.float32).reshape(len(page), -1)
    text = pa.array([t for _, t, _ in page], pa.large_string())
    for t in K.slices(text):
        w = K.words(t, K.WORD_ALNUM)
        rows = t.first_row + w.doc
        np.add.at(out, (rows, PATH_DIM + (K.word_hash(w) % K.U64(WORD_DIM)).astype(np.int64)), 1)
        n = np.diff(w.first)
        size = np.diff(t.offsets)
        at = slice(t.first_row, t.first_row + len(t))
        out[at, PATH_DIM : PATH_DIM + WORD_DIM] /= np.maximum(n, 1)[:, None]
        out[at, -COUNTS] = np.log1p(n) / 5
        out[at, -COUNTS + 1] = np.log1p(size) / 8
        ends = np.add.reduceat(np.append(np.isin(t.data, list(b".!?,")), False).astype(np.float32), t.offsets[:-1])
        out[at, -COUNTS + 2] = np.minimum(1, 10 * ends / np.maximum(size, 1))
    out[:, -COUNTS + 3] = [min(1.0, c / max(1, len(t))) for _, t, c in page]
    out[:, -COUNTS + 4] = np.arange(len(page)) / len(page)
    out[:, -COUNTS + 5] = 1
    return out


class Labeller:
    """A bidirectional LSTM with a logistic output for every block."""

    def __init__(self, hidden: int = HIDDEN, seed: int = SEED):
        g = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + COUNTS
        self.hidden = hidden
        self.w = {}
        for side in "fb":
            self.w[f"x{side}"] = (g.normal(size=(d, 4 * hidden)) / np.sqrt(d)).astype(np.float32)
            self.w[f"h{side}"] = (g.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            b = np.zeros(4 * hidden, np.float32)
            b[hidden : 2 * hidden] = 1  # the forget gates start open
            self.w[f"c{side}"] = b
        self.w["o"] = (g.normal(size=2 * hidden) / np.sqrt(hidden)).astype(np.float32)
        self.w["d"] = (g.normal(size=d) * 0.01).astype(np.float32)

    def _run(self, x, mask, side):
        """States (T, B, H) of one direction, and what the backward pass needs."""
        n, b, _ = x.shape
        h = c = np.zeros((b, self.hidden), np.float32)
        z = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        out, kept = np.zeros((n, b, self.hidden), np.float32), []
        for t in range(n) if side == "f" else range(n - 1, -1, -1):
            a = z[t] + h @ self.w[f"h{side}"]
            i, f, o = (1 / (1 + np.exp(-a[:, k * self.hidden : (k + 1) * self.hidden])) for k in range(3))
            g = np.tanh(a[:, 3 * self.hidden :])
            m = mask[t][:, None]
            new = f * c + i * g
            kept.append((t, h, c, i, f, o, g, new))
            c = np.where(m, new, c)
            h = np.where(m, o * np.tanh(new), h)
            out[t] = h
        return out, kept

    def forward(self, x, mask):
        hf, kf = self._run(x, mask, "f")
        hb, kb = self._run(x, mask, "b")
        h = np.concatenate([hf, hb], 2)
        return 1 / (1 + np.exp(-np.clip(h @ self.w["o"] + x @ self.w["d"], -30, 30))), h, kf, kb

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Of each page the blocks' probabilities of being article text."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b + 1 - a) * len(pages[order[b]]) <= STEPS:
                b += 1
            x, mask = _padded([pages[i] for i in order[a:b]])
            p = self.forward(x, mask)[0]
            for k, i in enumerate(order[a:b]):
                out[i] = p[: len(pages[i]), k]
            a = b
        return out

    def gradients(self, x, mask, y):
        p, h, kf, kb = self.forward(x, mask)
        dz = np.where(mask, p - y, 0).astype(np.float32) / mask.sum()
        g = {"o": np.einsum("tbh,tb->h", h, dz), "d": np.einsum("tbd,tb->d", x, dz)}
        for side, kept in (("f", kf), ("b", kb)):
            at = slice(0, self.hidden) if side == "f" else slice(self.hidden, None)
            da = np.zeros((*x.shape[:2], 4 * self.hidden), np.float32)
            dh = dc = np.zeros((x.shape[1], self.hidden), np.float32)
            gh = np.zeros_like(self.w[f"h{side}"])
            for t, h0, c0, i, f, o, gg, c1 in reversed(kept):
                m = mask[t][:, None]
                dh = dh + dz[t][:, None] * self.w["o"][at]
                tc = np.tanh(c1)
                dcn = np.where(m, dc + dh * o * (1 - tc * tc), 0)
                a = np.concatenate([dcn * gg * i * (1 - i), dcn * c0 * f * (1 - f), np.where(m, dh * tc * o * (1 - o), 0), dcn * i * (1 - gg * gg)], 1)
                da[t] = a
                gh += h0.T @ a
                dh = np.where(m, 0, dh) + a @ self.w[f"h{side}"].T
                dc = np.where(m, 0, dc) + dcn * f
            g[f"h{side}"], g[f"c{side}"] = gh, da.sum((0, 1))
            g[f"x{side}"] = np.einsum("tbd,tbk->dk", x, da, optimize=True)
        return g, p


def _padded(pages):
    n = max(map(len, pages))
    x = np.zeros((n, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((n, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller from pages of (block vectors, labels), by Adam on whole pages."""
    net, g = Labeller(seed=seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(w) for k, w in net.w.items()}
    pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
    groups = [pages[i : i + 24] for i in range(0, len(pages), 24)]
    step = 0
    for _ in range(epochs):
        for i in g.permutation(len(groups)):
            x, mask = _padded([p[0] for p in groups[i]])
            y = np.zeros(mask.shape, np.float32)
            for k, p in enumerate(groups[i]):
                y[: len(p[1]), k] = p[1]
            grad, _ = net.gradients(x, mask, y)
            step += 1
            for k, d in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                net.w[k] -= (0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def generated_page(r: random.Random) -> tuple[str, list[str]]:
    """A page and the texts of its article's blocks."""
    letters = "etaonishrdlu"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a, b: words(a, b).capitalize() + r.choice([".", ".", "!", "?", "", " ***"])
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    pick = r.choice

    def boxed(kinds, inner):
        tag, names = pick(kinds)
        name = pick(names) if names else ""
        attr = f' {pick(["class", "class", "id"])}="{name}{pick(["", "", " " + word()])}"' if name else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(a, b):
        items = [link() for _ in range(r.randint(a, b))]
        return "<ul>" + "".join(f"<li>{x}" + pick(["</li>", "</li>", ""]) for x in items) + "</ul>" if r.random() < 0.7 else " | ".join(items)

    menu = lambda: boxed([("nav", None), ("nav", ["menu", "breadcrumb"]), ("div", ["menu", "nav", "navbar", "navigation", "breadcrumbs", "topnav"]), ("ul", ["menu", "nav"])], links(2, 9))
    head = lambda: boxed([("header", None), ("header", ["site", "masthead"]), ("div", ["header", "masthead", "banner", "top"])], pick(["", f"<h1>{words(1, 3)}</h1>", f"<p>{words(1, 6)}</p>", menu(), f'<div class="logo">{words(1, 2)}</div>']) + pick(["", menu()]))
    advert = lambda: boxed([("div", ["ad", "ads", "advert", "sponsored", "promo", "banner", "advertisement"]), ("aside", ["ad", "promo"])], pick([sentence(3, 14), f"<p>{sentence(3, 20)}</p>", link(), sentence(30, 60)]))
    notice = lambda: boxed([("div", ["cookie", "notice", "consent", "gdpr", "alert", "newsletter", "popup", "modal", "cookie banner"])], pick([f"<p>{sentence(4, 25)}</p>", sentence(4, 25)]) + pick(["", f"<button>{words(1, 2)}</button>", link()]))
    form = lambda: f"<form>{pick(['', '<label>' + words(1, 3) + '</label>', '<p>' + sentence(2, 8) + '</p>'])}<input name=q><button>{words(1, 2)}</button>{pick(['', '<select><option>' + word() + '<option>' + word() + '</select>', '<textarea>' + words(1, 4) + '</textarea>'])}</form>"
    side = lambda: boxed([("aside", None), ("aside", ["sidebar"]), ("div", ["sidebar", "side", "widget", "related", "recommended", "share", "social", "tags", "rail"])], pick(["", f"<h3>{words(1, 4)}</h3>"]) + pick([links(2, 6), f"<p>{sentence(4, 25)}</p>", form(), f"<p>{sentence(4, 18)}</p><p>{sentence(4, 18)}</p>"]))
    said = lambda: boxed([("div", ["comment", "reply", "comment body"]), ("li", ["comment"]), ("article", ["comment"])], pick(["", f"<h4>{words(1, 2)}</h4>", f'<span class="author">{word()}</span>']) + "".join(f"<p>{sentence(3, 40)}</p>" for _ in range(r.randint(1, 2))))
    comments = lambda: boxed([("section", ["comments"]), ("div", ["comments", "disqus", "discussion", "responses"]), ("section", ["reader comments"])], pick(["", f"<h2>{words(1, 3)}</h2>"]) + "".join(said() for _ in range(r.randint(1, 5))) + pick(["", form()]))
    foot = lambda: boxed([("footer", None), ("footer", ["site"]), ("div", ["footer", "foot", "copyright", "legal", "bottom"])], pick([f"&copy; {word()}.example &middot; {sentence(3, 12)}", f"<p>&copy; {sentence(2, 10)}</p>", links(2, 6), links(2, 5) + f"<p>{sentence(3, 15)}</p>"]))

    kept: list[str] = []

    def text(a, b):
        s = sentence(a, b)
        kept.append(" ".join(s.split()))
        return pick([s, s, s, f"<b>{s}</b>", f"<b>{s}<br>", s.replace(" ", pick(["  ", "\n", " "]))]) if "<" not in s else s

    def body():
        out = []
        if r.random() < 0.9:
            out.append(f"<h1>{text(1, 14)}</h1>")
        for _ in range(r.randint(1, 10)):
            kind = r.random()
            if kind < 0.7:
                out.append(f"<p>{text(*pick([(1, 2), (3, 12), (10, 60), (30, 120)]))}" + pick(["</p>", "</p>", "</p>", ""]))
            elif kind < 0.78:
                out.append(f"<h{(n := r.randint(2, 4))}>{text(1, 8)}</h{n}>")
            elif kind < 0.86:
                out.append(pick(["<ul>", '<ol class="steps">']) + "".join(f"<li>{text(1, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{text(4, 30)}</blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{text(1, 3)}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
            else:
                out.append(pick([advert, notice, side, lambda: f"<!-- {word()} -->", lambda: "<script>var t='</p>';</script>"])())
        return "".join(out)

    parts = [pick(["", head()]), pick(["", menu(), menu()]), pick(["", "", notice()]), pick(["", advert()])]
    article = body()
    tag, attr = pick([("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("div", ' class="article body"'), ("div", ' class="post entry"'), ("section", ' class="story"')])
    inner = f"<{tag}{attr}>{article}" + pick(["", "", "", comments(), side(), form()]) + f"</{tag}>"
    parts.append(pick([inner, inner, f"<main>{inner}</main>", f'<div class="wrapper">{inner}{pick(["", side()])}</div>']))
    parts += [pick(["", "", comments()]), pick(["", side()]), pick(["", "", form()]), pick(["", foot(), foot()])]
    title = words(2, 12)
    page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style></head><body>" + "".join(parts) + pick(["</body></html>", ""])
    return page, kept


def labelled(page: str, article: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels: the article's texts are matched in page order."""
    found, y, k = blocks(page), [], 0
    for _, text, _ in found:
        hit = k < len(article) and text == article[k]
        y.append(hit)
        k += hit
    return vectors(found), np.array(y, np.float32)


@lru_cache(1)
def default_labeller() -> Labeller:
    r = random.Random(SEED)
    return train([labelled(*generated_page(r)) for _ in range(TRAIN_PAGES)])


def extract(pages: DataFrame, columns: list[str], html: str = "html", net: Labeller | None = None) -> DataFrame:
    """The given columns with the main text of every page."""
    text_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(net or default_labeller())
    k = len(columns)
    names = [f"c{i}" for i in range(k)]

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                found = [blocks(h) for h in part.column(k).to_pylist()]
                probabilities = held.value.probabilities([vectors(f) for f in found])
                texts = ["\n\n".join(t for (_, t, _), p in zip(f, q, strict=True) if p >= 0.5) for f, q in zip(found, probabilities, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(texts, pa.string())], names=[*names, "text"])

    kinds = ", ".join(f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    return pages.select(*columns, html).mapInArrow(tidy(run), f"{kinds}, text string").withColumnsRenamed(dict(zip(names, columns, strict=True)))


def op6_html(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
