"""HTML extraction with a recurrent block labeller.

A page becomes its sequence of leaf blocks.  Each block has a vector of its tag
path and of its hashed words; a bidirectional LSTM (numpy) reads the sequence
both ways, so that every block is labelled in the light of the whole document.
The labeller is trained from pages whose markup names its parts (article, nav,
aside ...), with their wrappers renamed and boilerplate planted, so that it
learns tag paths in context and not one template.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import shared

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr img picture source "
                   # formulas and drawings
                   "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd "
                   "mspace mpadded mphantom menclose mstyle merror mmultiscripts semantics annotation svg g path circle "
                   "ellipse rect line polyline polygon text tspan textpath defs use symbol lineargradient radialgradient "
                   "stop clippath mask pattern marker filter desc".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold, up to their end tag, is never text of a page; all others are ordinary elements.
RAW = "script|style|textarea|title|iframe"
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:title|style)(?:\s[^>]*)?/>|"
    rf"<(?P<raw>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|"
    r"<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)"
    # a quoted value begins right after its '='; other quotes are ordinary characters
    r"(?P<attrs>(?>[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>", re.S | re.I)
ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z]+")
#: A block start closes an open element of the same group.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}

PATH_DIM, WORD_DIM = 96, 32
DIM = PATH_DIM + WORD_DIM + 4
HIDDEN = 16
#: Bounds of the training sample: pages, and characters of one.
TRAIN_PAGES, TRAIN_CHARS = 240, 60_000
EPOCHS = 8
SEED = 11

MAIN = {"article", "main", "articlebody", "post", "entry", "story", "content", "body-text"}
OTHER = {"nav", "header", "footer", "aside", "form", "menu", "sidebar", "ad", "ads", "advert", "advertisement", "promo",
         "sponsored", "banner", "cookie", "notice", "consent", "popup", "modal", "comment", "comments", "discussion",
         "replies", "related", "share", "social", "newsletter", "subscribe", "breadcrumb", "breadcrumbs", "pagination",
         "navigation", "complementary", "contentinfo", "search", "widget", "toolbar", "head"}


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, bool]]:
    """(tag path, text, all in links) of the leaf blocks in page order.

    The path holds the open block elements with the words of their class, id and
    role.  Character references are decoded, white space is one blank; inline
    elements do not end a block, ``br`` is white space.  Comments and elements
    that hold no text (script, style, ...) go.  Broken markup: an end tag without
    a start is ignored, open elements end with the page.
    """
    out, stack, text, linked = [], [], [], []
    link = 0
    at = 0

    def flush():
        t = " ".join("".join(text).split())
        if t:
            inside = sum(map(len, linked))
            out.append((tuple(n for _, names in stack for n in names), t, inside >= 0.6 * len(t)))
        text.clear()
        linked.clear()

    def add(raw):
        if raw:
            t = html.unescape(raw)
            text.append(t)
            if link:
                linked.append(t)

    page = page or ""
    for m in TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and m["raw"].lower() != "title":
                continue
            if m["raw"]:
                flush()
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
            continue
        if tag == "a":
            link = 0 if m["end"] else 1
        if tag in INLINE:
            continue
        flush()
        link = 0
        if m["end"]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if k is not None:
                del stack[k:]
            continue
        while stack and (stack[-1][0] in CLOSES.get(tag, ()) or stack[-1][0] == "p"):
            stack.pop()
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        names = [tag]
        for a in ATTR.findall(m["attrs"]) if m["attrs"] else ():
            names += NAME.findall("".join(a).lower())
        stack.append((tag, names))
    add(page[at:])
    flush()
    return out


def is_main(path: tuple[str, ...]) -> bool:
    """What the markup itself says, for training: inside a main element, and in
    nothing else that names a part of the page below the body."""
    inside = False
    for name in path:
        if name in OTHER:
            return False
        inside = inside or name in MAIN
    return inside


def vectors(page_blocks, cache: dict) -> np.ndarray:
    """One row per block: hashed tag path (with its last names apart), hashed
    words, and four measures of its text."""
    x = np.zeros((len(page_blocks), DIM), np.float32)
    for k, (path, text, linked) in enumerate(page_blocks):
        for j, name in enumerate(path):
            x[k, zlib.crc32(name.encode()) % PATH_DIM] = 1.0
        if path:
            x[k, zlib.crc32(b"last " + path[-1].encode()) % PATH_DIM] += 0.5
        words = text.split(" ")
        if len(cache) > 200_000:
            cache.clear()
        ids = []
        for w in words:
            h = cache.get(w)
            if h is None:
                h = cache[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_DIM
            ids.append(h)
        x[k, PATH_DIM:PATH_DIM + WORD_DIM] = np.bincount(ids, minlength=WORD_DIM) / len(words)
        x[k, -4:] = (np.log1p(len(words)) / 5, float(linked), float(text[-1] in ".!?:;\""), 1.0)
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class BiLstm:
    """Two LSTMs, one for each direction, and a logistic output on both states."""

    def __init__(self, rng):
        def init(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p[d + "x"], self.p[d + "h"] = init(DIM, 4 * HIDDEN), init(HIDDEN, 4 * HIDDEN)
            self.p[d + "b"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[d + "b"][HIDDEN:2 * HIDDEN] = 1.0  # remember at first
        self.p["o"], self.p["ob"] = init(2 * HIDDEN, 1)[:, 0], np.zeros(1, np.float32)

    def _run(self, d, x, mask, keep):
        """States of one direction over (pages, blocks, DIM), padding masked out."""
        n, t, _ = x.shape
        wx = x @ self.p[d + "x"] + self.p[d + "b"]
        h = c = np.zeros((n, HIDDEN), np.float32)
        states, trace = np.zeros((n, t, HIDDEN), np.float32), []
        for k in (range(t) if d == "f" else range(t - 1, -1, -1)):
            z = wx[:, k] + h @ self.p[d + "h"]
            i, f, o = (_sigmoid(z[:, a * HIDDEN:(a + 1) * HIDDEN]) for a in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[:, k:k + 1]
            c2 = m * (f * c + i * g) + (1 - m) * c
            th = np.tanh(c2)
            h2 = m * (o * th) + (1 - m) * h
            if keep:
                trace.append((k, h, c, i, f, o, g, th, m))
            h, c = h2, c2
            states[:, k] = h
        return states, trace

    def logits(self, x, mask, keep=False):
        sf, tf = self._run("f", x, mask, keep)
        sb, tb = self._run("b", x, mask, keep)
        s = np.concatenate([sf, sb], axis=2)
        return s @ self.p["o"] + self.p["ob"][0], (s, tf, tb)

    def gradients(self, x, mask, y):
        z, (s, tf, tb) = self.logits(x, mask, keep=True)
        dz = ((_sigmoid(z) - y) * mask / max(1.0, mask.sum())).astype(np.float32)
        g = {"o": (s * dz[..., None]).sum(axis=(0, 1)), "ob": np.array([dz.sum()], np.float32)}
        ds = dz[..., None] * self.p["o"]
        for d, trace, part in (("f", tf, ds[..., :HIDDEN]), ("b", tb, ds[..., HIDDEN:])):
            gx, gh = np.zeros_like(self.p[d + "x"]), np.zeros_like(self.p[d + "h"])
            gb = np.zeros_like(self.p[d + "b"])
            dh = dc = np.zeros((len(x), HIDDEN), np.float32)
            for k, h0, c0, i, f, o, u, th, m in reversed(trace):
                dh = dh + part[:, k]
                dct = dc + m * dh * o * (1 - th * th)
                da = np.concatenate([dct * u * i * (1 - i), dct * c0 * f * (1 - f), dh * th * o * (1 - o),
                                     dct * i * (1 - u * u)], axis=1) * m
                gx += x[:, k].T @ da
                gh += h0.T @ da
                gb += da.sum(axis=0)
                dh = da @ self.p[d + "h"].T + (1 - m) * dh
                dc = m * dct * f + (1 - m) * dct
            g[d + "x"], g[d + "h"], g[d + "b"] = gx, gh, gb
        return g


def _padded(seqs):
    t = max(map(len, seqs))
    x = np.zeros((len(seqs), t, DIM), np.float32)
    mask = np.zeros((len(seqs), t), np.float32)
    for k, s in enumerate(seqs):
        x[k, :len(s)] = s
        mask[k, :len(s)] = 1
    return x, mask


PLANTS = ["aside", "nav", "header", "footer", "form", "section class=comments", "div class=comment", "div class=sidebar",
          "div class=ad", "div class=advert", "div class=cookie-notice", "div class=related", "div class=share", "div class=menu",
          "div class=newsletter", "div class=promo", "div class=notice", "div class=breadcrumb", "div class=widget",
          "div id=comments", "div id=sidebar", "div class=banner", "div class=social", "ul class=pagination"]
WRAPS = ["article", "main", "div class=main", "div class=content", "div class=post", "div role=main", "section class=entry",
         "div class=story", "article class=post", "div id=content"]


def _path(element: str) -> list[str]:
    tag, _, attrs = element.partition(" ")
    return [tag] + [n for n in NAME.findall(attrs) if n not in ("class", "id", "role")]


def varied(page_blocks, rng: random.Random):
    """A variant of a page: its main wrapper renamed, boilerplate planted around
    and inside it, of text taken from the page itself."""
    wrap = _path(rng.choice(WRAPS))
    out = []
    texts = [t for _, t, _ in page_blocks] or ["x"]
    if rng.random() < 0.2:
        out.append((("html", "body", "div"), rng.choice(texts), False))
    for path, text, linked in page_blocks:
        if "article" in path:
            k = path.index("article")
            path = path[:k] + tuple(wrap) + path[k + 1:]
        out.append((path, text, linked))
        if rng.random() < 0.12:
            outer = path[:2] if rng.random() < 0.5 else tuple(p for p in path if p not in ("p", "h"))
            spot = tuple(_path(rng.choice(PLANTS)))
            for _ in range(rng.randint(1, 3)):
                out.append((outer + spot + rng.choice([(), ("p",), ("div",), ("ul", "li"), ("div", "p")]),
                            rng.choice(texts), rng.random() < 0.3))
    return out


def train(pages: DataFrame) -> BiLstm:
    """The labeller, from about TRAIN_PAGES pages of at most TRAIN_CHARS characters,
    chosen by a hash of the page id.  No such pages: an untrained model, whose
    answers ``label`` replaces by what the markup says."""
    rows = pages.filter(F.length("html") <= TRAIN_CHARS)
    share = min(1.0, TRAIN_PAGES / max(1, rows.count()))
    some = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "page_id"), F.lit(1 << 20)) < share * (1 << 20))
    texts = [r["html"] for r in some.select("page_id", "html").orderBy("page_id", "html").limit(2 * TRAIN_PAGES).collect()]
    rng, np_rng, cache = random.Random(SEED), np.random.default_rng(SEED), {}
    seqs = []
    for t in texts:
        b = blocks(t)
        for v in (b, varied(b, rng), varied(b, rng)):
            if v:
                v = v[:120]  # a training sequence; whole pages are labelled
                seqs.append((vectors(v, cache), np.array([is_main(p) for p, _, _ in v], np.float32)))
    model = BiLstm(np_rng)
    model.trained = bool(seqs)
    seqs.sort(key=lambda s: len(s[0]))
    batches = [seqs[k:k + 24] for k in range(0, len(seqs), 24)]
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(batches)
        for batch in batches:
            x, mask = _padded([s for s, _ in batch])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, t) in enumerate(batch):
                y[k, :len(t)] = t
            step += 1
            for k, g in model.gradients(x, mask, y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                model.p[k] -= 0.02 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.99 ** step)) + 1e-8)
    return model


def label(pages_blocks: list, model: BiLstm, cache: dict, together: int = 4000) -> list[np.ndarray]:
    """Main or not, for every block of every page; pages of like length share a run."""
    out = [np.zeros(0, bool)] * len(pages_blocks)
    order = sorted((k for k in range(len(pages_blocks)) if pages_blocks[k]), key=lambda k: len(pages_blocks[k]))
    while order:
        longest = len(pages_blocks[order[-1]])
        part = order[-max(1, together // longest):]
        del order[-len(part):]
        if not model.trained:
            for k in part:
                out[k] = np.array([is_main(p) for p, _, _ in pages_blocks[k]])
            continue
        x, mask = _padded([vectors(pages_blocks[k], cache) for k in part])
        z, _ = model.logits(x, mask)
        for j, k in enumerate(part):
            out[k] = z[j, :len(pages_blocks[k])] > 0
    return out


def extract(pages: DataFrame, model: BiLstm, html_col: str = "html") -> DataFrame:
    """``pages`` plus ``text``, its main blocks joined by line ends; '' for null or
    empty html or a page without main text.  A present ``text`` is replaced; all
    rows and other columns pass through."""
    given = shared(pages.sparkSession, model)

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, cache = given(), {}
        for pages in batches:
            out = []
            for k in range(0, len(pages), 256):
                found = [blocks(p) for p in pages.iloc[k:k + 256]]
                for b, main in zip(found, label(found, model, cache)):
                    out.append("\n".join(t for (_, t, _), keep in zip(b, main) if keep))
            yield pd.Series(out, dtype="object")

    return pages.drop("text").withColumn("text", main_text(F.col(html_col)))


def op2_html_extraction(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, train(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
