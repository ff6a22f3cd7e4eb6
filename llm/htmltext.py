"""Main text of HTML pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks (runs of text between block-level
tags), each with the path of tags, classes and ids above it. A bidirectional
LSTM in numpy reads the sequence - hashed tag-path vectors, hashed word vectors
and a few measures of each block - and labels every block as article or not
with the whole page in view.

The labeller is fitted on a bounded sample of pages (``SAMPLE_PAGES``, by hash of
the id, pages above ``SAMPLE_CHARS`` characters left out). Its labels are weak:
blocks inside ``article`` or ``main`` are article text unless something between
says otherwise. Each sample page is also seen in rebuilt forms: other containers,
renamed or dropped classes, and menus, notices, forms, sidebars, adverts and
comments put around and inside the article, so that the labeller learns to go
by the context too. Labelling itself reads every page whole.

Text: character references are decoded, white space inside a block becomes one
space, blocks are joined by ``\\n`` in page order. Scripts, styles, templates,
titles and comments are never text.

Defined cases: null, empty and text-free pages give the empty text; broken or
unclosed markup is read as far as it goes (a tag cut off at the end is dropped);
repeated pages get a row each; an empty table gives an empty table; columns
named like a result give way to it.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm._batches import SPACE, Texts, add_columns, hash_sample, table, word_hashes

SAMPLE_PAGES, SAMPLE_CHARS, FORMS, EPOCHS, SEED = 200, 30_000, 3, 12, 11
PATH_BUCKETS, WORD_BUCKETS, PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 1024, 512, 24, 8, 6, 20

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
_RAW = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "title", "noscript", "template", "textarea", "iframe", "svg", "select")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    link_chars: int


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, none empty."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # tag, path entry
    open_: dict[str, int] = {}
    parts: list[str] = []
    links = at = 0

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(tuple(e for _, e in stack if e), text, min(links, len(text))))
        parts, links = [], 0

    def close(tag: str) -> None:
        while stack:
            top = stack.pop()[0]
            open_[top] -= 1
            if top == tag:
                break

    def add(text: str) -> None:
        nonlocal links
        if text:
            parts.append(text)
            if open_.get("a"):
                links += len(text)

    pos, end = 0, len(page)
    while True:
        m = _TOKEN.search(page, pos)
        if m is None:
            add(page[at:end])
            break
        add(page[at:m.start()])
        pos = at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in _INLINE:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m[1]:
            if open_.get(tag):
                close(tag)
            continue
        if tag in _RAW and not (m[3] or "").endswith("/"):
            stop = _RAW[tag].search(page, pos)
            pos = at = stop.start() if stop else end
            continue
        if tag not in _INLINE and open_.get("p"):
            close("p")
        if tag == "li" and open_.get("li") and stack and stack[-1][0] not in ("ul", "ol"):
            close("li")
        if tag not in _VOID and not (m[3] or "").endswith("/"):
            names = [tag] if tag not in _INLINE else []
            for a in _ATTRIBUTE.findall(m[3] or ""):
                names += [f"{tag}.{n}" if tag in _INLINE else f".{n}" for n in _NAME.findall("".join(a).lower())]
            stack.append((tag, " ".join(names)))
            open_[tag] = open_.get(tag, 0) + 1
    flush()
    return out


# --- features -----------------------------------------------------------------


def features(pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all blocks of all pages: hashed path names and where each block's
    begin, hashed words and where each block's begin, measures."""
    names: list[int] = []
    first = [0]
    known: dict[tuple[str, ...], list[int]] = {}
    for page in pages:
        for b in page:
            if b.path not in known:
                words = [w for e in b.path for w in e.split()]
                last = b.path[-1].split()[:1] if b.path else []
                known[b.path] = [zlib.crc32(w.encode()) % PATH_BUCKETS for w in set(words)] + [zlib.crc32(("/" + w).encode()) % PATH_BUCKETS for w in last] or [0]
            names += known[b.path]
            first.append(len(names))
    flat = [b for page in pages for b in page]
    t = Texts.of(pa.array([b.text.lower().encode() for b in flat], type=pa.large_binary()))
    starts, ends, word_first = t.words(SPACE)
    words = (word_hashes(t.data, starts, ends) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    size = np.array([len(b.text) for b in flat], dtype=np.float64)
    count = np.diff(word_first)
    place = np.concatenate([np.linspace(0, 1, len(p)) for p in pages]) if flat else np.zeros(0)
    measures = np.stack([np.log1p(size) / 8, np.log1p(count) / 6, np.array([b.link_chars for b in flat]) / np.maximum(size, 1),
                         np.array([b.text[-1] in ".!?\"»”" for b in flat], dtype=float), place, np.ones(len(flat))], axis=1) if flat else np.zeros((0, MEASURES))
    return np.array(names, dtype=np.int64), np.array(first), words, word_first, measures


def _mean(table_: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    if len(first) < 2:
        return np.zeros((0, table_.shape[1]))
    return np.add.reduceat(table_[rows], first[:-1], axis=0) / np.diff(first)[:, None].astype(table_.dtype)


# --- the labeller ---------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Parameters: two embedding tables, an LSTM for each direction, an output."""

    def __init__(self, rng: np.random.Generator):
        n = PATH_DIM + WORD_DIM + MEASURES
        self.p = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM)),
                  "out": rng.normal(0, 0.2, 2 * HIDDEN + n), "bias": np.zeros(1)}
        for d in ("f", "b"):
            self.p["w" + d] = rng.normal(0, 1 / np.sqrt(n + HIDDEN), (n + HIDDEN, 4 * HIDDEN))
            self.p["c" + d] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])

    def _inputs(self, f) -> np.ndarray:
        names, first, words, word_first, measures = f
        return np.concatenate([_mean(self.p["path"], names, first), _mean(self.p["word"], words, word_first), measures.astype(self.p["out"].dtype)], axis=1)

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, pages, HIDDEN) for inputs (steps, pages, n)."""
        h = np.zeros((x.shape[1], HIDDEN), dtype=x.dtype)
        c = np.zeros_like(h)
        out = np.empty((len(x), *h.shape), dtype=x.dtype)
        w, bias = self.p["w" + d], self.p["c" + d]
        given = x @ w[:x.shape[2]] + bias
        again = w[x.shape[2]:]
        for i in range(len(x)):
            z = given[i] + h @ again
            gates = _sigmoid(z[:, :3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN:])
            before, c_before = h, c
            c = gates[:, :HIDDEN] * c + gates[:, HIDDEN:2 * HIDDEN] * g
            tc = np.tanh(c)
            h = gates[:, 2 * HIDDEN:] * tc
            out[i] = h
            if keep is not None:
                keep.append((gates, g, c_before, tc, before))
        return out

    @staticmethod
    def _padded(x: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(steps, pages) grids forwards and backwards, and where each block is."""
        row = np.concatenate([np.arange(n) for n in sizes])
        col = np.repeat(np.arange(len(sizes)), sizes)
        back = np.repeat(sizes, sizes) - 1 - row
        grid = np.zeros((max(sizes), len(sizes), x.shape[1]), dtype=x.dtype)
        grid[row, col] = x
        rev = np.zeros_like(grid)
        rev[back, col] = x
        return grid, rev, np.stack([row, col]), np.stack([back, col])

    def chances(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Chance of being article text, for each block of each page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):  # pages of similar length together, 64k cells at most
            end = at + 1
            while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= 1 << 16:
                end += 1
            some = [pages[i] for i in order[at:end]]
            x = self._inputs(features(some))
            grid, rev, f, b = self._padded(x, [len(p) for p in some])
            logit = np.concatenate([self._run(grid, "f")[f[0], f[1]], self._run(rev, "b")[b[0], b[1]], x], axis=1) @ self.p["out"] + self.p["bias"]
            for i, part in zip(order[at:end], np.split(_sigmoid(logit), np.cumsum([len(p) for p in some])[:-1])):
                out[i] = part
            at = end
        return out

    def _gradients(self, f, sizes: list[int], labels: np.ndarray) -> dict[str, np.ndarray]:
        names, first, words, word_first, _ = f
        x = self._inputs(f)
        n = x.shape[1]
        grid, rev, place_f, place_b = self._padded(x, sizes)
        kept_f: list = []
        kept_b: list = []
        hf, hb = self._run(grid, "f", kept_f), self._run(rev, "b", kept_b)
        top = np.concatenate([hf[place_f[0], place_f[1]], hb[place_b[0], place_b[1]], x], axis=1)
        error = (_sigmoid(top @ self.p["out"] + self.p["bias"]) - labels) / len(labels)
        g = {"out": top.T @ error, "bias": np.array([error.sum()])}
        down = error[:, None] * self.p["out"]
        dx = down[:, 2 * HIDDEN:].copy()
        for d, kept, inputs, place, part in (("f", kept_f, grid, place_f, down[:, :HIDDEN]), ("b", kept_b, rev, place_b, down[:, HIDDEN:2 * HIDDEN])):
            w = self.p["w" + d]
            above = np.zeros((*inputs.shape[:2], HIDDEN))
            above[place[0], place[1]] = part
            dz = np.zeros((*inputs.shape[:2], 4 * HIDDEN))
            dh = np.zeros((inputs.shape[1], HIDDEN))
            dc = np.zeros_like(dh)
            gw = np.zeros_like(w)
            for i in range(len(inputs) - 1, -1, -1):
                gates, cand, c_before, tc, before = kept[i]
                fg, ig, og = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
                dh = dh + above[i]
                dc = dc + dh * og * (1 - tc * tc)
                z = dz[i]
                z[:, :HIDDEN] = dc * c_before * fg * (1 - fg)
                z[:, HIDDEN:2 * HIDDEN] = dc * cand * ig * (1 - ig)
                z[:, 2 * HIDDEN:3 * HIDDEN] = dh * tc * og * (1 - og)
                z[:, 3 * HIDDEN:] = dc * ig * (1 - cand * cand)
                gw[n:] += before.T @ z
                dh, dc = z @ w[n:].T, dc * fg
            gw[:n] = np.einsum("tbi,tbj->ij", inputs, dz, optimize=True)
            g["w" + d], g["c" + d] = gw, dz.sum(axis=(0, 1))
            dx += (dz @ w[:n].T)[place[0], place[1]]
        for key, rows, starts, part in (("path", names, first, dx[:, :PATH_DIM]), ("word", words, word_first, dx[:, PATH_DIM:PATH_DIM + WORD_DIM])):
            g[key] = np.zeros_like(self.p[key])
            each = np.repeat(part / np.diff(starts)[:, None], np.diff(starts), axis=0)
            for j in range(each.shape[1]):
                g[key][:, j] = np.bincount(rows, weights=each[:, j], minlength=len(g[key]))
        return g

    def fit(self, pages: list[list[Block]], labels: list[np.ndarray], rng: np.random.Generator, epochs: int = EPOCHS, rate: float = 0.01) -> None:
        """Adam over batches of 24 pages of similar length, slower every epoch."""
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        batches = [order[a:a + 24] for a in range(0, len(order), 24)]
        data = [(features([pages[i] for i in b]), [len(pages[i]) for i in b], np.concatenate([labels[i] for i in b])) for b in batches]
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(epochs):
            pace = rate * (1 - epoch / epochs)
            for i in rng.permutation(len(data)):
                g = self._gradients(*data[i])
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] -= pace * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}


# --- weak labels ------------------------------------------------------------------

#: Names on a path that say a block is no article text.
BOILERPLATE = frozenset(
    "nav header footer aside form menu sidebar ad ads advert banner promo sponsor notice cookie consent popup comment comments reply "
    "share social related newsletter subscribe breadcrumb pagination widget toolbar login search copyright button".split())
_CONTAINERS = ["article", "main", "div.content", "div.post", "section.entry", "div.article-body", "div", "section.story"]
_AROUND = [
    ("nav", "ul li a"), ("div.menu", "ul li a"), ("header", "div"), ("header.site-header", "p"), ("div.header", "span"), ("div.breadcrumb", "a"),
    ("aside", "p"), ("aside.sidebar", "ul li a"), ("div.sidebar", "p"), ("div.widget", "h3"), ("div.ad", ""), ("div.advert", "p"), ("div.banner", "a"),
    ("div.promo", "p"), ("div.sponsored", "p"), ("ins.ads", ""), ("div.notice", "p"), ("div.cookie-notice", "p"), ("div.consent", "button"),
    ("div.popup", "p"), ("form", "label"), ("form.newsletter", "p"), ("form.search", "button"), ("div.share", "a"), ("div.related", "ul li a"),
    ("section.comments", "p"), ("div.comments", "div.comment p"), ("ol.comment-list", "li p"), ("div.reply", "p"), ("section#comments", "article p"),
    ("footer", ""), ("footer", "p"), ("div.footer", "p"), ("div.copyright", "")]


def weak_labels(page: list[Block]) -> np.ndarray | None:
    """1 for article blocks; None for a page whose markup does not tell."""
    out = []
    told = False
    for b in page:
        words = [w.lstrip(".") for e in b.path for w in e.split()]
        starts = [i for i, w in enumerate(words) if w in ("article", "main")]
        told |= bool(starts)
        out.append(float(bool(starts) and not any(w.split(".")[-1] in BOILERPLATE for w in words)))
    return np.array(out) if told and any(out) else None


def _element(spec: str, inside: str) -> str:
    name, mark, value = re.match(r"([a-z0-9]+)([.#]?)(.*)", spec).groups()
    attribute = "" if not mark else f' {"class" if mark == "." else "id"}="{value}"'
    return f"<{name}{attribute}>{inside}</{name}>"


def _nested(spec: str, texts: list[str]) -> str:
    """Texts as elements of a path ("ul li a": one ul, an li with an a each)."""
    steps = spec.split()
    if not steps:
        return " ".join(texts)
    outer, each = (steps[0], steps[1:]) if steps[0] in ("ul", "ol") else (None, steps)
    items = []
    for text in texts:
        for s in reversed(each):
            text = _element(s, text)
        items.append(text)
    return _element(outer, "".join(items)) if outer else "".join(items)


def rebuilt(article: list[str], prose: list[str], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A page with the article's texts in some container, and other parts around
    and inside it that hold words and sentences of ``prose``."""
    def escape(x: str) -> str:
        return html.escape(x, quote=False)

    def part(inner: bool) -> str:
        spec, each = _AROUND[rng.integers(len(_AROUND))]
        text = escape(prose[rng.integers(len(prose))])
        words = text.split()
        if "a" in each.split() or "button" in each.split() or "label" in each.split() or (rng.random() < 0.3 and "comment" not in spec):
            texts = [" ".join(words[i:i + 2]) for i in range(0, min(len(words), 2 * int(rng.integers(2, 9))), 2)]
        else:
            texts = [text] if rng.random() < 0.6 else [text, escape(prose[rng.integers(len(prose))])]
        return _element(spec, _nested(each, texts or ["."])).replace(">", ' data-x="0">', 1)

    article = [" ".join(t.split()[:int(rng.integers(1, 3))]) if i and rng.random() < 0.15 else t for i, t in enumerate(article)]
    body = [f"<{'h1' if i == 0 else 'p' if rng.random() < 0.9 else 'h2'} data-x=\"1\">{escape(t)}</p>" for i, t in enumerate(article)]
    for _ in range(int(rng.integers(0, 3))):
        body.insert(int(rng.integers(1, len(body) + 1)), part(True))
    container = _element(_CONTAINERS[rng.integers(len(_CONTAINERS))], "".join(body))
    before, after = ("".join(part(False) for _ in range(int(rng.integers(lo, hi)))) for lo, hi in ((1, 6), (1, 6)))
    page = blocks(f"<html><body>{before}\n{container}\n{after}</body></html>")
    want = {" ".join(t.split()) for t in article}
    plain = [float(b.text in want and not _in_part(b)) for b in page]
    return page, np.array(plain)


def _in_part(b: Block) -> bool:
    names = {w.lstrip(".").split(".")[-1] for e in b.path for w in e.split()}
    return bool(names & (BOILERPLATE | {"sponsored", "list"}))


def fit(sample: list[str], seed: int = SEED, forms: int = FORMS) -> Labeller:
    """A labeller from sample pages, each as it is and in rebuilt forms."""
    rng = np.random.default_rng(seed)
    read = [(p, y) for p in (blocks(x) for x in sample) if (y := weak_labels(p)) is not None and len(p) <= 400]
    syllables = "an be co di er fo ga hi in ko lo me no or pe ra st ti un ve".split()
    def sentence() -> str:
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(int(rng.integers(5, 40)))]
        return " ".join(words).capitalize() + "."
    articles = [[b.text for b, k in zip(p, y) if k] for p, y in read] + [[sentence() for _ in range(int(rng.integers(2, 9)))] for _ in range(40)]
    prose = [t for a in articles for t in a] + [b.text for p, y in read for b, k in zip(p, y) if not k]
    pages, labels = [p for p, _ in read], [y for _, y in read]
    for a in articles:
        for _ in range(forms):
            page, y = rebuilt(a[:40], prose, rng)
            pages.append(page)
            labels.append(y)
    model = Labeller(rng)
    model.fit(pages, labels, rng)
    return model


def extract(model: Labeller, pages: list[str]) -> list[str]:
    """The main text of each page."""
    read = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, c in zip(page, chance) if c >= 0.5) for page, chance in zip(read, model.chances(read))]


def sample_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> list[str]:
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").alias("html")).where(F.length("html").between(1, SAMPLE_CHARS))
    return sorted(r.html for r in hash_sample(rows, SAMPLE_PAGES, "id", "html").collect())


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None, model: Labeller | None = None) -> DataFrame:
    """``pages`` with ``text`` (main text) and ``n_chars``."""
    model = model or fit(sample_pages(pages, id_col, html_col))

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            texts = extract(model, [x or "" for x in column.to_pylist()])
            return [pa.array(texts, type=pa.string()), pa.array([len(x) for x in texts], type=pa.int64())]
        return work

    return add_columns(pages, html_col, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make, keep)


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    """One row per page: url, main text and its length."""
    return main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
