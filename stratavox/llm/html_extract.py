"""Main text of web pages, by a recurrent labeller of their leaf blocks.

A bidirectional LSTM in numpy reads a page's blocks in order, each as a vector of its
hashed tag path and hashed words, and labels every block as main text or not with the
whole page in view. It is trained on the driver from a bounded sample of pages: their own
markup labels their blocks, and their texts are set again in other layouts so that the
labeller knows more than one markup.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns
from .html_blocks import Block, Element, blocks

TAGS, PARENT, WORDS, OTHER = 128, 32, 48, 6
#: Names that mark what is and is not main text where a page uses them.
MAIN = frozenset("article main".split())
ASIDE = frozenset("nav aside footer form menu button select dialog".split())
ASIDE_MARKS = frozenset("nav navbar menu sidebar footer ad ads advert banner cookie notice comment comments share social related promo breadcrumb login signup newsletter popup widget sponsored".split())


@dataclass(frozen=True)
class LabellerSettings:
    sample_pages: int = 300
    sample_chars: int = 60_000
    layouts_per_page: int = 3
    hidden: int = 24
    epochs: int = 7
    batch: int = 24
    rate: float = 0.01
    seed: int = 5


def slot(kind: str, word: str, size: int) -> int:
    return zlib.crc32(f"{kind}:{word}".encode()) % size


class Vectors:
    """Input vectors of blocks. Slots of words are remembered up to a fixed number."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.paths: dict[tuple[int, str], np.ndarray] = {}
        self.elements: dict[tuple[str, ...], int] = {}

    def path(self, element: Element | None) -> np.ndarray:
        """Slots of all elements around a block, and of the innermost one's tag."""
        above = []
        while element is not None and element.slots is None:
            above.append(element)
            element = element.up
        bits = element.slots or 0 if element is not None else 0
        for element in reversed(above):
            bits |= self.own(element.tag, tuple(element.marks))
            element.slots = bits
        key = (bits, element.tag if element is not None else "")
        at = self.paths.get(key)
        if at is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            slots = [k for k in range(TAGS) if bits >> k & 1]
            if element is not None:
                slots.append(TAGS + slot("p", element.tag, PARENT))
            at = self.paths[key] = np.array(slots, np.int64)
        return at

    def own(self, tag: str, marks: tuple[str, ...]) -> int:
        bits = self.elements.get((tag, *marks))
        if bits is None:
            if len(self.elements) > 20_000:
                self.elements.clear()
            bits = 1 << slot("t", tag, TAGS)
            for x in marks:
                bits |= 1 << slot("m", x, TAGS)
            self.elements[tag, *marks] = bits
        return bits

    def word(self, w: str) -> int:
        if len(self.words) > 200_000:
            self.words.clear()
        at = self.words[w] = slot("w", w.lower(), WORDS)
        return at

    def page(self, found: list[Block]) -> np.ndarray:
        """One row for each block, from all its words and all elements around it."""
        out = np.zeros((len(found), TAGS + PARENT + WORDS + OTHER), np.float32)
        known = self.words
        for row, block in zip(out, found, strict=True):
            row[self.path(block.path)] = 1.0
            words = block.text.split()
            counts = np.bincount([known[w] if w in known else self.word(w) for w in words], minlength=WORDS)
            row[TAGS + PARENT : TAGS + PARENT + WORDS] = counts / np.sqrt(counts @ counts)
            row[-OTHER:] = (
                np.log1p(len(block.text)) / 8,
                block.linked,
                sum(w[-1] in ".,;:!?" for w in words) / len(words),
                min(1.0, block.path.depth / 12) if block.path else 0.0,
                block.text[-1] in ".!?",
                1.0,
            )
        return out


class Lstm:
    """One direction: hidden states of a padded batch, and the gradients of its weights."""

    def __init__(self, rng: np.random.Generator, inputs: int, hidden: int) -> None:
        self.h = hidden
        self.w = (rng.standard_normal((inputs + hidden, 4 * hidden)) / np.sqrt(inputs / 8 + hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden : 2 * hidden] = 1.0

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        steps, rows, _ = x.shape
        n = self.h
        projected = x @ self.w[: x.shape[2]] + self.b
        recurrent = self.w[x.shape[2] :]
        h = np.zeros((rows, n), np.float32)
        c = np.zeros((rows, n), np.float32)
        out = np.empty((steps, rows, n), np.float32)
        past = []
        for t in range(steps):
            z = projected[t] + h @ recurrent
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * n], -30, 30)))
            g = np.tanh(z[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            m = mask[t][:, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                past.append((h, c, i, f, o, g, tc, m))
            h = np.where(m, o * tc, h)
            c = np.where(m, c_new, c)
            out[t] = h
        return (out, past) if keep else out

    def grads(self, x: np.ndarray, past: list, dout: np.ndarray):
        steps, rows, inputs = x.shape
        n = self.h
        dw, db = np.zeros_like(self.w), np.zeros_like(self.b)
        dh, dc = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
        recurrent = self.w[inputs:]
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tc, m = past[t]
            dh = dh + dout[t]
            live = dh * m
            dcn = (dc + live * o * (1 - tc * tc)) * m
            dz = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), live * tc * o * (1 - o), dcn * i * (1 - g * g)], axis=1)
            dw[:inputs] += x[t].T @ dz
            dw[inputs:] += h.T @ dz
            db += dz.sum(0)
            dh = dh * ~m + dz @ recurrent.T
            dc = dc * ~m + dcn * f
        return dw, db


class BlockLabeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, settings: LabellerSettings) -> None:
        rng = np.random.default_rng(settings.seed)
        inputs = TAGS + PARENT + WORDS + OTHER
        self.forward, self.backward = Lstm(rng, inputs, settings.hidden), Lstm(rng, inputs, settings.hidden)
        self.v = (rng.standard_normal(2 * settings.hidden) / 8).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.forward.w, self.forward.b, self.backward.w, self.backward.b, self.v, self.bias]

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(p) for p in pages)
        x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
        mask = np.zeros((steps, len(pages)), bool)
        for k, p in enumerate(pages):
            x[: len(p), k] = p
            mask[: len(p), k] = True
        return x, mask

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Log-odds of main text for each block of each page; pages are padded in sorted groups of bounded size."""
        out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            rows = max(1, min(128, 8_000 // len(pages[order[-1]])))
            taken, order = order[-rows:], order[:-rows]
            x, mask = self.padded([pages[k] for k in taken])
            n = self.forward.h
            z = self.forward.run(x, mask) @ self.v[:n] + self.backward.run(x[::-1], mask[::-1])[::-1] @ self.v[n:] + self.bias
            for column, k in enumerate(taken):
                out[k] = z[: len(pages[k]), column]
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], settings: LabellerSettings) -> None:
        rng = np.random.default_rng(settings.seed)
        weights = self.weights()
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step, n = 0, self.forward.h
        for epoch in range(settings.epochs):
            order = rng.permutation(len(pages))
            groups = [order[k : k + settings.batch] for k in range(0, len(order), settings.batch)]
            for group in groups:
                x, mask = self.padded([pages[k] for k in group])
                y = np.zeros(mask.shape, np.float32)
                for column, k in enumerate(group):
                    y[: len(labels[k]), column] = labels[k]
                hf, pf = self.forward.run(x, mask, keep=True)
                hb, pb = self.backward.run(x[::-1], mask[::-1], keep=True)
                hb = hb[::-1]
                z = hf @ self.v[:n] + hb @ self.v[n:] + self.bias
                dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * mask / mask.sum()).astype(np.float32)
                grads = [
                    *self.forward.grads(x, pf, dz[:, :, None] * self.v[:n]),
                    *self.backward.grads(x[::-1], pb, (dz[:, :, None] * self.v[n:])[::-1]),
                    np.concatenate([(hf * dz[:, :, None]).sum((0, 1)), (hb * dz[:, :, None]).sum((0, 1))]),
                    dz.sum(keepdims=True).reshape(1),
                ]
                step += 1
                scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((g * g).sum() for g in grads)))))
                rate = settings.rate * (1 - 0.9 * epoch / settings.epochs)
                for w, g, a, b in zip(weights, grads, first, second, strict=True):
                    g = g * scale
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)


def label_by_markup(found: list[Block]) -> np.ndarray:
    """1 for blocks whose nearest telling element is an article or main element."""
    return np.array([in_main(block.path) for block in found], np.float32)


def in_main(element: Element | None) -> bool:
    """Whether the nearest telling element is an article or main element."""
    above, main = [], False
    while element is not None and element.main is None:
        above.append(element)
        if element.tag in ASIDE or not ASIDE_MARKS.isdisjoint(element.marks):
            break
        if element.tag in MAIN:
            main = True
            break
        element = element.up
    else:
        main = bool(element is not None and element.main)
    for x in above:
        x.main = main
    return main


class Layouts:
    """Sets the texts of a page in other layouts, with the label of each block known.

    Every block is marked by a leading character from a private-use area: one for main
    text, another for the rest. The marks are taken off after parsing.
    """

    YES, NO = "", ""
    #: The names and short texts that common page layouts use.
    BODY = ['<article>|</article>', '<main>|</main>', '<main><article>|</article></main>', '<div class="content">|</div>', '<div id="content"><div class="post">|</div></div>', '<div class="post-body entry-content">|</div>', '<div class="container"><div class="row"><div class="main">|</div></div></div>', '<section class="story">|</section>', '<div><div>|</div></div>', '<table><tr><td>|</td></tr></table>', '<article class="post"><div class="article-body">|</div></article>', '<div id="main"><article>|</article></div>']
    PARAGRAPH = ["<p>|</p>", "<p>|</p>", "<p>|", "<div>|</div>", "<p><b>|</b></p>", "<p><b>|<br>", "<blockquote>|</blockquote>", "<ul><li>|</li></ul>", '<p class="text"><span>|</span></p>', "<pre>|</pre>", "<h2>|</h2>", "<p><a href=x>|</a></p>"]
    BEFORE = ['<header>|</header>', '<div class="header site-header">|</div>', '<div id="masthead">|</div>', '<nav>|</nav>', '<nav class="navbar"><ul>|</ul></nav>', '<ul class="menu">|</ul>', '<div class="topbar">|</div>', '<div class="breadcrumb">|</div>', '<div class="cookie-notice">|</div>', '<div id="cookie-banner" role="dialog">|</div>', '<div class="notice alert">|</div>', '<div class="ad">|</div>', '<div class="ads banner">|</div>', '<aside>|</aside>', '<div class="sidebar">|</div>', '<form class="search">|</form>', '<div class="consent gdpr">|</div>', '<div class="popup newsletter">|</div>']
    AFTER = ['<aside>|</aside>', '<aside class="sidebar">|</aside>', '<div class="sidebar widget">|</div>', '<div id="secondary">|</div>', '<div class="related">|</div>', '<section class="comments">|</section>', '<section id="comments">|</section>', '<div id="comments" class="comment-list">|</div>', '<ol class="commentlist">|</ol>', '<div class="reader-comments">|</div>', '<footer>|</footer>', '<div class="footer">|</div>', '<div id="footer">|</div>', '<div class="share social">|</div>', '<form action="s">|</form>', '<form class="subscribe">|</form>', '<div class="ad sponsored">|</div>', '<div class="promo">|</div>', '<div class="copyright">|</div>', '<div class="newsletter signup">|</div>', '<div class="tags meta">|</div>']
    INSIDE = ['<div class="ad">|</div>', '<aside>|</aside>', '<div class="advert">|</div>', '<div class="share">|</div>', '<form>|</form>', '<div class="related">|</div>', '<div class="notice">|</div>', '<nav class="toc">|</nav>', '<div class="comments">|</div>', '<footer>|</footer>', '<header class="byline">|</header>']
    ITEM = ["<li><a href=x>|</a></li>", "<a href=x>|</a>", "<p>|</p>", "<span>|</span>", "<div>|</div>", "<li>|</li>", '<div class="comment"><p>|</p></div>', "<label>|</label><input>", "<button>|</button>", "<h3>|</h3>", "<p>|</p><p>|</p>"]
    SHORT = ["Home", "About us", "Contact", "Log in", "Sign up", "Subscribe", "Share", "Read more", "Privacy policy", "All rights reserved.", "We use cookies to improve this site.", "Accept", "Advertisement", "Leave a reply", "Search", "Next", "Previous", "Related articles", "Menu", "Follow us", "Posted by", "Comments", "Terms"]

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def fill(self, frame: str, inner: str) -> str:
        left, right = frame.split("|", 1)
        return left + inner + right

    def items(self, own: list[str], main: list[str]) -> str:
        """Items of a side part: short texts, side texts of pages, and sentences as long as main text."""
        r, kind, out = self.r, self.r.choice(self.ITEM), ""
        for _ in range(r.choice([1, 1, 2, 3, 4, 6])):
            x = r.choice([r.choice(self.SHORT), r.choice(own or self.SHORT), r.choice(main), r.choice(main)])
            words = x.split()
            x = " ".join(words[: r.choice([2, 4, 12, 30])])
            out += kind.replace("|", self.NO + x)
        return out

    def page(self, main: list[str], side: list[str], others: list[str]) -> str:
        r = self.r
        paragraph, body = r.choice(self.PARAGRAPH), ""
        if r.random() < 0.7:
            body += f"<{(h := r.choice(['h1', 'h1', 'h2', 'h1 class=title']))}>{self.YES}{' '.join(main[0].split()[:9])}</{h.split()[0]}>"
        for x in main:
            if r.random() < 0.08:
                body += self.fill(r.choice(self.INSIDE), self.items(side, others))
            body += self.fill(paragraph if r.random() < 0.8 else r.choice(self.PARAGRAPH), self.YES + x)
        before = "".join(self.fill(r.choice(self.BEFORE), self.items(side, others)) for _ in range(r.choice([0, 1, 1, 2, 3])))
        after = "".join(self.fill(r.choice(self.AFTER), self.items(side, others)) for _ in range(r.choice([0, 1, 1, 2, 3])))
        wrap = r.choice(["|", "|", '<div id="page">|</div>', '<div class="wrapper"><div class="container">|</div></div>'])
        return "<html><body>" + self.fill(wrap, before + self.fill(r.choice(self.BODY), body) + after) + "</body></html>"

    def parsed(self, page: str) -> tuple[list[Block], np.ndarray]:
        found = blocks(page)
        label = np.array([b.text.count(self.YES) > b.text.count(self.NO) for b in found], np.float32)
        clean = [b._replace(text=" ".join(b.text.replace(self.YES, "").replace(self.NO, "").split()) or "-") for b in found]
        return clean, label


def train(pages: list[str], settings: LabellerSettings = LabellerSettings()) -> BlockLabeller | None:
    """A labeller from pages that use article or main elements; the same pages give the same weights.

    None if no page has such elements.
    """
    vectors, layouts = Vectors(), Layouts(settings.seed)
    parsed = [(b, label_by_markup(b)) for b in map(blocks, pages)]
    parsed = [(b, y) for b, y in parsed if y.any() and len(b) <= 400]
    model = BlockLabeller(settings)
    x, y = [vectors.page(b) for b, _ in parsed], [label for _, label in parsed]
    mains = [[b.text for b, k in zip(found, label, strict=True) if k][:40] for found, label in parsed]
    others = [t for m in mains for t in m[:4]]
    for (found, label), main in zip(parsed, mains, strict=True):
        side = [b.text for b, k in zip(found, label, strict=True) if not k]
        for _ in range(settings.layouts_per_page):
            made, truth = layouts.parsed(layouts.page(layouts.r.sample(main, layouts.r.randint(1, len(main))), side, others))
            x.append(vectors.page(made))
            y.append(truth)
    if not x:
        return None
    model.fit(x, y, settings)
    return model


def sampled_pages(pages: DataFrame, html: str, page_id: str, settings: LabellerSettings) -> list[str]:
    """A bounded sample of pages by smallest hash of their id, and no page above ``sample_chars``."""
    keys = pages.select(F.col(f"`{page_id}`").alias("k")).where("k is not null").distinct().orderBy(F.xxhash64("k"), "k").limit(settings.sample_pages)
    ids = [r.k for r in keys.collect()]
    if not ids:
        return []
    rows = pages.where(F.col(f"`{page_id}`").isin(ids)).select(F.col(f"`{page_id}`").alias("k"), F.col(f"`{html}`").alias("h"))
    rows = rows.where(F.length("h") <= settings.sample_chars).dropDuplicates(["k"])
    return [r.h for r in sorted(rows.collect(), key=lambda r: (str(r.k), r.h))]


def extract(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url", settings: LabellerSettings = LabellerSettings(), labeller: BlockLabeller | None = None) -> DataFrame:
    """Main text of every row: ``page_id, url, text, n_chars, n_blocks, n_main``.

    Blocks with log-odds above 0 are joined by one newline. Null or empty html, and pages
    without main text, give an empty text. Where no page of the sample has labelling
    markup, there is no labeller and each block's own markup decides. Repeated rows give
    repeated rows; other columns are not read.
    """
    if labeller is None:
        labeller = train(sampled_pages(pages, html, page_id, settings), settings)
    model = labeller

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [blocks(x.as_py()) for x in part.column(2)]
                texts, counts, mains = [], [], []
                scores = model.scores([vectors.page(b) for b in found]) if model else [label_by_markup(b) for b in found]
                for page, score in zip(found, scores, strict=True):
                    kept = [b.text for b, s in zip(page, score, strict=True) if s > 0]
                    texts.append("\n".join(kept))
                    counts.append(len(page))
                    mains.append(len(kept))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array(mains, pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"],
                )

    taken = columns(pages, page_id, url, html).toDF("page_id", "url", "html")
    kind = dict(taken.dtypes)["page_id"]
    return taken.mapInArrow(label, f"page_id {kind}, url string, text string, n_chars long, n_blocks long, n_main long")
