"""Main text of web pages: a recurrent labeller reads a page's blocks in order and says which belong to the article.

**Blocks.** A page is read tag by tag, once and without going back (``read_page``). Text between block-level tags is a
block; inline tags do not end one, a line break is a white space. Each block knows its path: the distinct names of the
elements around it, and the words of their class, id and role. Comments, scripts, styles and what else is never shown
are left out here; missing end tags are put in as browsers do. An unclosed tag or comment swallows the rest of the page.

**Labeller.** Every block becomes a vector: the sum of learnt vectors of its hashed path names, the mean of learnt
vectors of its hashed words, and a few measures (length, share of linked text, marks, digits). A bidirectional LSTM in numpy
reads the sequence both ways, so each block is judged within the whole page. Blocks with a probability of 0.5 or more
are the text.

**Training** (``trained``): on ``PAGES`` made-up pages whose blocks are labelled as they are made (``made_page``), in
layouts with named elements, with classes, and with neither; no row of a table is used, so the model is the same for any input. It
takes about twenty seconds on the driver, once a process, and is sent to the tasks: 1.4 MB whatever the input.

Pages are rows of a map without a shuffle. Null, empty and text-free pages give an empty text, repeated rows repeated
results; ids and urls may be null; a page of any length is read whole, in time and memory in proportion to it; other
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import small_batches, table

PAGES, ROUNDS, BATCH, SEED = 2400, 4, 24, 13
NAMES, WORDS, NAME_DIM, WORD_DIM, HIDDEN, MEASURES = 8192, 8192, 24, 16, 24, 8
# Pages that are labelled together, and blocks at most (a longer page is labelled alone).
TOGETHER, BLOCKS = 128, 20_000

# Elements by the part that they play in HTML.
BLOCK_TAGS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
# Their content is text up to their own end tag, and none of it is shown in the page.
HIDDEN_TEXT = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "noscript", "template", "xmp", "svg", "math", "object", "canvas")}
# A start tag of the first kind ends an open element of the second, unless one of the third lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCK_TAGS - {"body", "button", "caption", "html", "label", "legend", "optgroup", "option", "select", "tbody", "td", "tfoot", "th", "thead", "tr"}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>[^>"'=]+|=\s*+(?:"[^"]*"|'[^']*')?|["'])*+)>""")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_WORD = re.compile(r"\w+")


class Buckets(dict):
    """Bucket of a word by its checksum; words are remembered, but not without end."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = got = zlib.crc32(word.encode("utf-8", "replace")) % self.size
        return got


_NAME_BUCKETS, _WORD_BUCKETS = Buckets(NAMES), Buckets(WORDS)


class Page:
    """Blocks of a page: text, node of its element, linked characters; nodes know their parent and their new names."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.nodes: list[int] = []
        self.linked: list[int] = []
        self.parents: list[int] = [-1]
        self.names: list[list[int]] = [[]]


def read_page(source: str | None) -> Page:
    page, text = Page(), source or ""
    # Open elements: name, node, names that it brought into the path.
    stack: list[tuple[str, int, list[int]]] = []
    opened: dict[str, int] = {}
    path: dict[int, int] = {}
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            words = "".join(parts).split()
            parts.clear()
            if words:
                page.texts.append(" ".join(words))
                page.nodes.append(stack[-1][1] if stack else 0)
                page.linked.append(linked)
        linked = 0

    def push(name: str, attributes: str) -> None:
        names = [_NAME_BUCKETS["<" + name]]
        if attributes:
            for found in _ATTRIBUTE.finditer(attributes):
                value = found[1] or found[2] or found[3] or ""
                names += [_NAME_BUCKETS[part.lower()] for part in _PART.findall(value)]
        new = [n for n in dict.fromkeys(names) if not path.get(n)]
        for n in new:
            path[n] = 1
        page.parents.append(stack[-1][1] if stack else 0)
        page.names.append(new)
        stack.append((name, len(page.parents) - 1, new))
        opened[name] = opened.get(name, 0) + 1

    def pop() -> str:
        nonlocal links
        name, _, new = stack.pop()
        for n in new:
            path[n] = 0
        opened[name] -= 1
        links -= name == "a"
        return name

    def pop_to(name: str) -> None:
        while pop() != name:
            pass

    at, size = 0, len(text)
    while at < size:
        mark = text.find("<", at)
        chunk = text[at : mark if mark >= 0 else size]
        if chunk:
            if "&" in chunk:
                chunk = html.unescape(chunk)
            parts.append(chunk)
            if links > 0:
                linked += len(chunk)
        if mark < 0:
            break
        found = _TAG.match(text, mark)
        if found is None:
            after = text[mark + 1 : mark + 2]
            if text.startswith("<!--", mark):
                end = text.find("-->", mark + 2)
                at = size if end < 0 else end + 3
            elif after in ("!", "?", "/") and after:
                end = text.find(">", mark)
                at = size if end < 0 else end + 1
            elif after.isascii() and after.isalpha():
                at = size
            else:
                parts.append("<")
                at = mark + 1
            continue
        at = found.end()
        closing, name, attributes = found[1], found[2].lower(), found[3]
        if name in BLOCK_TAGS:
            flush()
        elif name == "br":
            parts.append(" ")
        if closing:
            if opened.get(name):
                pop_to(name)
            continue
        if name in HIDDEN_TEXT:
            end = HIDDEN_TEXT[name].search(text, at) if not attributes.endswith("/") else None
            if end is None:
                at = at if attributes.endswith("/") else size
            else:
                close = text.find(">", end.end())
                at = size if close < 0 else close + 1
            continue
        if name in VOID_TAGS:
            continue
        if name in ENDS_P and opened.get("p"):
            pop_to("p")
        if name in CLOSES:
            ended, walls = CLOSES[name]
            if any(opened.get(e) for e in ended):
                for depth in range(len(stack) - 1, max(len(stack) - 40, -1), -1):
                    if stack[depth][0] in walls:
                        break
                    if stack[depth][0] in ended:
                        while len(stack) > depth:
                            pop()
                        break
        push(name, attributes)
        links += name == "a"
    flush()
    return page


def _bags(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of buckets as one array and the owner of each."""
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum())), np.repeat(np.arange(len(lists)), sizes)


def _summed(vectors: np.ndarray, bags: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Sum of the vectors of each list."""
    out = np.zeros((n, vectors.shape[1]), np.float32)
    flat, owner = bags
    step = 1 << 18
    for s in range(0, len(flat), step):
        part, who = vectors[flat[s : s + step]], owner[s : s + step]
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        out[who[first]] += np.add.reduceat(part, first, axis=0)
    return out


def word_lists(page: Page) -> list[list[int]]:
    """Buckets of each block's distinct words."""
    return [[_WORD_BUCKETS[w] for w in dict.fromkeys(_WORD.findall(t.lower()))] for t in page.texts]


def measures(page: Page) -> np.ndarray:
    out = np.zeros((len(page.texts), MEASURES), np.float32)
    for i, text in enumerate(page.texts):
        n = len(text)
        out[i, :5] = (np.log1p(n) / 6, min(page.linked[i] / n, 1.0), n <= 24, text[-1] in ".!?:…", text[0].isupper())
        out[i, 5:] = (sum(map(text.count, ".,;")) / n * 20, page.linked[i] > 0, min(n / 2000, 1.0))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _order(lengths: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows step by step over pages sorted by length, longest first, and how many pages are still there at each step."""
    starts = np.append(0, np.cumsum(lengths)[:-1])
    alive = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")
    step = np.repeat(np.arange(len(alive)), alive)
    who = np.arange(len(step)) - np.repeat(np.append(0, np.cumsum(alive)[:-1]), alive)
    return (starts[who] + (lengths[who] - 1 - step if backwards else step)), alive


class Labeller:
    """Weights of the network; all arithmetic in 32-bit floats."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        size = NAME_DIM + WORD_DIM + MEASURES
        normal = lambda *shape, by: (draw.standard_normal(shape) * by).astype(np.float32)
        self.w = {"names": normal(NAMES, NAME_DIM, by=0.1), "words": normal(WORDS, WORD_DIM, by=0.05), "out": normal(2 * HIDDEN, 1, by=0.2), "bias": np.zeros(1, np.float32)}
        for way in ("ahead", "back"):
            self.w[way + "_x"] = normal(size, 4 * HIDDEN, by=size**-0.5)
            self.w[way + "_h"] = normal(HIDDEN, 4 * HIDDEN, by=HIDDEN**-0.5)
            # The forget gate starts open.
            self.w[way + "_b"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)

    def _way(self, x: np.ndarray, lengths: np.ndarray, way: str) -> tuple[np.ndarray, dict]:
        """Hidden states of one direction, by row, and what the way back needs."""
        rows, alive = _order(lengths, way == "back")
        gates = (x @ self.w[way + "_x"] + self.w[way + "_b"])[rows]
        inner, states, h = self.w[way + "_h"], np.zeros((len(rows), HIDDEN), np.float32), np.zeros((len(lengths), HIDDEN), np.float32)
        c, cells, befores = np.zeros_like(h), np.zeros_like(states), np.zeros_like(states)
        at = 0
        for n in alive.tolist():
            g = gates[at : at + n]
            befores[at : at + n] = h[:n]
            g += h[:n] @ inner
            g[:, : 3 * HIDDEN] = _sigmoid(g[:, : 3 * HIDDEN])
            g[:, 3 * HIDDEN :] = np.tanh(g[:, 3 * HIDDEN :])
            c[:n] = g[:, HIDDEN : 2 * HIDDEN] * c[:n] + g[:, :HIDDEN] * g[:, 3 * HIDDEN :]
            h[:n] = g[:, 2 * HIDDEN : 3 * HIDDEN] * np.tanh(c[:n])
            cells[at : at + n], states[at : at + n] = c[:n], h[:n]
            at += n
        out = np.empty_like(states)
        out[rows] = states
        return out, {"rows": rows, "alive": alive, "gates": gates, "cells": cells, "befores": befores}

    def _vectors(self, names: np.ndarray, words: tuple[np.ndarray, np.ndarray], extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.maximum(np.bincount(words[1], minlength=len(extra)), 1).astype(np.float32)[:, None]
        return np.concatenate([names, _summed(self.w["words"], words, len(extra)) / counts, extra], 1), counts

    def _run(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict, dict]:
        ahead, kept = self._way(x, lengths, "ahead")
        back, also = self._way(x, lengths, "back")
        h = np.concatenate([ahead, back], 1)
        return _sigmoid(h @ self.w["out"] + self.w["bias"])[:, 0], h, kept, also

    def path_vectors(self, page: Page) -> np.ndarray:
        """Sum of the vectors of the path's names for each block: each node adds its own to those of its parent."""
        own = _summed(self.w["names"], _bags(page.names), len(page.names))
        for node, parent in enumerate(page.parents[1:], 1):
            own[node] += own[parent]
        return own[page.nodes]

    def probabilities(self, pages: list[Page]) -> list[np.ndarray]:
        """Probability of each block to be main text."""
        order = sorted((i for i, p in enumerate(pages) if p.texts), key=lambda i: -len(pages[i].texts))
        out = [np.zeros(0, np.float32) for _ in pages]
        if not order:
            return out
        bags = [word_lists(pages[i]) for i in order]
        names = np.concatenate([self.path_vectors(pages[i]) for i in order])
        extra = np.concatenate([measures(pages[i]) for i in order])
        lengths = np.array([len(pages[i].texts) for i in order])
        got = self._run(self._vectors(names, _bags([w for bag in bags for w in bag]), extra)[0], lengths)[0]
        for i, part in zip(order, np.split(got, np.cumsum(lengths)[:-1]), strict=True):
            out[i] = part
        return out

    def _back(self, dh: np.ndarray, x: np.ndarray, kept: dict, way: str, grads: dict[str, np.ndarray]) -> np.ndarray:
        """Gradients of one direction; returns those of its input."""
        rows, alive, g, H = kept["rows"], kept["alive"], kept["gates"], HIDDEN
        dh, dg = dh[rows], np.zeros_like(g)
        i, f, o, u = (g[:, k * H : (k + 1) * H] for k in range(4))
        tc = np.tanh(kept["cells"])
        pages = int(alive[0])
        carry_h, carry_c = np.zeros((pages, H), np.float32), np.zeros((pages, H), np.float32)
        ends = np.cumsum(alive)
        for t in range(len(alive) - 1, -1, -1):
            n, e = int(alive[t]), int(ends[t])
            s = slice(e - n, e)
            h = dh[s] + carry_h[:n]
            c = h * o[s] * (1 - tc[s] ** 2) + carry_c[:n]
            before = kept["cells"][e - n - int(alive[t - 1]) : e - n][:n] if t else 0
            dg[s, :H] = c * u[s] * i[s] * (1 - i[s])
            dg[s, H : 2 * H] = c * before * f[s] * (1 - f[s])
            dg[s, 2 * H : 3 * H] = h * tc[s] * o[s] * (1 - o[s])
            dg[s, 3 * H :] = c * i[s] * (1 - u[s] ** 2)
            carry_c[:n], carry_h[:n] = c * f[s], dg[s] @ self.w[way + "_h"].T
        grads[way + "_x"], grads[way + "_h"], grads[way + "_b"] = x[rows].T @ dg, kept["befores"].T @ dg, dg.sum(0)
        dx = np.zeros_like(x)
        dx[rows] = dg @ self.w[way + "_x"].T
        return dx

    def gradients(self, paths: list[list[int]], words: list[list[int]], extra: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients over a batch of pages, longest first."""
        names, bags = _bags(paths), _bags(words)
        x, counts = self._vectors(_summed(self.w["names"], names, len(paths)), bags, extra)
        p, h, ahead, back = self._run(x, lengths)
        d = ((p - labels) / len(labels)).astype(np.float32)[:, None]
        grads = {"out": h.T @ d, "bias": d.sum(0)}
        dh = d @ self.w["out"].T
        dx = self._back(dh[:, :HIDDEN], x, ahead, "ahead", grads) + self._back(dh[:, HIDDEN:], x, back, "back", grads)
        for name, (flat, owner), part in (("names", names, dx[:, :NAME_DIM]), ("words", bags, dx[:, NAME_DIM : NAME_DIM + WORD_DIM] / counts)):
            grads[name] = np.zeros_like(self.w[name])
            np.add.at(grads[name], flat, part[owner])
        loss = -np.mean(np.where(labels > 0, np.log(p + 1e-7), np.log(1 - p + 1e-7)))
        return float(loss), grads


# What made-up pages consist of: names that mark a part of a page, and words that stand there.
_MAIN = "content post entry article story body main text page-content entry-content post-body article-body post-content story-body articleBody main-content hentry prose markdown-body mw-parser-output".split()
_NOISE = {
    "menu": "nav navbar menu navigation main-menu topnav breadcrumb breadcrumbs pagination pager toc skip-links tabs submenu sitemap site-nav".split(),
    "header": "header masthead top site-header branding logo banner-top page-header topbar site-title tagline".split(),
    "footer": "footer site-footer bottom copyright colophon legal foot footer-links credits imprint".split(),
    "sidebar": "sidebar widget side aside right-rail secondary related related-posts recommended trending popular tags more-stories archive recent-posts blogroll".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert popup modal overlay disclaimer toast announcement message-bar paywall privacy-notice".split(),
    "advert": "ad ads advert advertisement sponsored promo sponsor adsense banner ad-slot dfp outbrain taboola commercial promoted".split(),
    "form": "form search newsletter signup subscribe login search-form contact-form comment-form register feedback".split(),
    "social": "share social sharing share-buttons follow social-links addthis like-buttons".split(),
    "comment": "comments comment comment-list responses discussion disqus_thread replies reader-comments commentlist reply user-comments".split(),
}
_SAYS = {
    "menu": "home about contact products services blog news login help support pricing archive search next previous page download sports world business more menu",
    "header": "welcome official site your daily source since sign in menu search subscribe edition",
    "footer": "copyright all rights reserved privacy policy terms of use contact us imprint powered by theme sitemap cookies inc ltd",
    "sidebar": "related posts recent popular trending tags categories you may also like read more most viewed archives follow",
    "notice": "we use cookies to improve your experience accept decline by continuing you agree privacy policy settings notice this site important subscribe to continue reading",
    "advert": "advertisement sponsored buy now save off free shipping offer click here limited deal shop ad promoted best price",
    "form": "subscribe to our newsletter email address name password submit send search sign up log in remember me message required",
    "social": "share on facebook twitter email print pin tweet like follow us whatsapp linkedin",
    "comment": "comments reply says leave a comment posted by anonymous great thanks agree likes ago report",
}
_SOUNDS = "a e i o u an en in on er re ti th st nd ha es or ing ion ou ble ly the ra se la do mi ko ne de le ment que il aux ge sch ung ver ich ó ñ é ä ü ci za".split()


@lru_cache(maxsize=1)
def _made_words() -> list[str]:
    """Invented words, short ones often."""
    draw = random.Random(SEED)
    return ["".join(draw.choices(_SOUNDS, k=draw.choice((1, 1, 2, 2, 3, 4)))) for _ in range(30_000)]


def _sentence(draw: random.Random, least: int = 1, most: int = 18) -> str:
    words = draw.choices(_made_words(), k=draw.randint(least, most))
    if draw.random() < 0.15:
        words.insert(draw.randrange(len(words) + 1), str(draw.randrange(10 ** draw.randint(1, 8))))
    inside = draw.choice((",", ",", " |", "***", "!!", " -")) if draw.random() < 0.2 else ""
    made = " ".join([w + inside if inside and draw.random() < 0.5 else w for w in words])
    made = made.upper() if draw.random() < 0.04 else made.capitalize()
    return made + draw.choice((".", ".", ".", ".", "", "?", "!"))


def _prose(draw: random.Random) -> str:
    if draw.random() < 0.2:
        return _sentence(draw, 1, 3)
    text = " ".join([_sentence(draw) for _ in range(draw.choice((1, 1, 2, 4, 8)))])
    if draw.random() < 0.2:
        words = text.split()
        i = draw.randrange(len(words))
        words[i] = draw.choice(('<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "<code>{}</code>", "<span>{}</span>", "<b>{}", "{}<br>", "{} &amp;")).format(words[i])
        text = " ".join(words)
    return text


def _said(draw: random.Random, part: str) -> str:
    """Words of a part that is not the article: its own, invented ones, or whole sentences."""
    kind = draw.random()
    if kind < 0.35:
        return _sentence(draw, 1, 14)
    own = _SAYS[part].split()
    start = draw.randrange(len(own))
    words = own[start : start + draw.randint(1, 6)] + draw.choices(_made_words(), k=draw.choice((0, 0, 1, 3)))
    return draw.choice((str.title, str.capitalize, str))(" ".join(words))


# A block of a made-up page: markup before, text, markup after, and whether it is main text.
Piece = tuple[str, str, str, int]


def _wrapped(pieces: list[Piece], tag: str, names: str = "") -> list[Piece]:
    if not pieces:
        return pieces
    before, text, after, label = pieces[0]
    pieces = [(f"<{tag}{names}>{before}", text, after, label), *pieces[1:]]
    before, text, after, label = pieces[-1]
    return [*pieces[:-1], (before, text, f"{after}</{tag}>", label)]


def _named(draw: random.Random, choices: list[str], chance: float = 1.0) -> str:
    if draw.random() > chance:
        return ""
    name = draw.choice(choices)
    if draw.random() < 0.3:
        name += draw.choice((" ", "-", "_")) + draw.choice(("box", "wrap", "container", "area", "inner", "section", "block", "1", "2", "list", "item"))
    if draw.random() < 0.15:
        name = draw.choice(("site", "my", "js", "c", "wp", "l", "block")) + "-" + name
    return f' {draw.choice(("class", "class", "class", "id"))}="{name}"'


def _noise(draw: random.Random, part: str, marked: bool) -> list[Piece]:
    """A part that is not the article; unmarked ones only differ by what they hold and where they stand."""
    item = lambda tag, linked: (f"<{tag}>" + ('<a href="/x">' if linked else ""), _said(draw, part), ("</a>" if linked else "") + f"</{tag}>", 0)
    if part == "menu" or (part in ("sidebar", "footer", "social", "header") and draw.random() < 0.5):
        pieces = _wrapped([item("li", True) for _ in range(draw.randint(1, 9))], draw.choice(("ul", "ul", "ol")))
        if part == "sidebar" and draw.random() < 0.6:
            pieces.insert(0, item(draw.choice(("h2", "h3", "h4", "div")), False))
    elif part == "form":
        pieces = [item(draw.choice(("label", "p", "button", "div", "h3")), False) for _ in range(draw.randint(1, 4))]
        if draw.random() < 0.8:
            pieces = _wrapped(pieces, "form", ' action="/go"')
    elif part == "comment":
        pieces = []
        for _ in range(draw.randint(1, 6)):
            one = [("<p>", _prose(draw), "</p>", 0) for _ in range(draw.randint(1, 3))]
            if draw.random() < 0.5:
                one.insert(0, item(draw.choice(("div", "h4", "span", "cite")), draw.random() < 0.3))
            pieces += _wrapped(one, draw.choice(("li", "div", "article")), _named(draw, _NOISE[part], 0.8 if marked else 0.0))
        if draw.random() < 0.7:
            pieces.insert(0, item(draw.choice(("h2", "h3")), False))
    else:
        pieces = [(f"<{tag}>" if tag else "", draw.choice((_said(draw, part), _prose(draw))), f"</{tag}>" if tag else "", 0) for tag in draw.choices(("p", "div", "", "span", "h3"), k=draw.choice((1, 1, 2, 3)))]
        if any(not p[0] or p[0] == "<span>" for p in pieces):
            pieces = pieces[:1]
    if not marked:
        return _wrapped(pieces, "div")
    own = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "comment": "section"}.get(part, "div")
    if own not in ("div", "section") and draw.random() < 0.55:
        return _wrapped(pieces, own, _named(draw, _NOISE[part], 0.3))
    return _wrapped(pieces, draw.choice(("div", "div", "section", "aside" if part in ("advert", "notice") else "div")), _named(draw, _NOISE[part]))


def _article(draw: random.Random) -> list[Piece]:
    pieces: list[Piece] = []
    if draw.random() < 0.85:
        pieces.append(("<h1>", _sentence(draw, 1, 10), "</h1>", 1))
    for _ in range(draw.choice((0, 1, 1, 2, 4, 7, 12, 20))):
        kind = draw.random()
        if kind < 0.7:
            pieces.append(("<p>" + draw.choice(("", "", "", "<b>")), _prose(draw), draw.choice(("</p>", "</p>", "</p>", "<br>")), 1))
        elif kind < 0.78:
            pieces.append(("<h2>", _sentence(draw, 1, 6), "</h2>", 1))
        elif kind < 0.86:
            tag = draw.choice(("ul", "ol"))
            pieces += _wrapped([("<li>", _prose(draw), "</li>", 1) for _ in range(draw.randint(1, 5))], tag)
        elif kind < 0.9:
            pieces += _wrapped([("<p>", _prose(draw), "</p>", 1)], draw.choice(("blockquote", "section", "div", "figure")))
        elif kind < 0.93:
            pieces.append(("<pre>", _prose(draw), "</pre>", 1))
        elif kind < 0.96:
            cells = [("<td>", _sentence(draw, 1, 4), "</td>", 1) for _ in range(draw.randint(2, 6))]
            pieces += _wrapped(_wrapped(cells, "tr"), "table")
        else:
            pieces.append(("<figcaption>", _sentence(draw), "</figcaption>", 1))
    return pieces


def made_page(draw: random.Random) -> tuple[str, list[int]]:
    """A page as HTML, and the label of each of its blocks."""
    marked = draw.random() < 0.92
    article = _article(draw)
    for _ in range(draw.choice((0, 0, 1, 1, 2)) if article else 0):
        # Something foreign between the paragraphs, told by its name.
        part = draw.choice(("advert", "social", "sidebar", "form", "notice", "comment"))
        i = draw.choice([0, len(article), *(i for i, p in enumerate(article) if p[3] and p[0].startswith(("<p>", "<h2>", "<h1>")))])
        article[i:i] = _noise(draw, part, True)
    kind = draw.random()
    if kind < 0.5:
        article = _wrapped(article, draw.choice(("article", "article", "main")), _named(draw, _MAIN, 0.3))
        if draw.random() < 0.3:
            article = _wrapped(article, draw.choice(("main", "div")), _named(draw, _MAIN, 0.5))
    elif marked or kind < 0.8:
        article = _wrapped(article, draw.choice(("div", "div", "section")), _named(draw, _MAIN))
    before = [p for p in ("header", "menu", "notice", "advert", "form") if draw.random() < (0.6 if p in ("header", "menu") else 0.25)]
    after = [p for p in ("social", "sidebar", "comment", "form", "advert", "footer", "menu", "notice") if draw.random() < (0.65 if p == "footer" else 0.3)]
    draw.shuffle(before)
    if draw.random() < 0.3:
        # The plainest page: a menu, an advert, the article and a footer.
        before, after = ["menu", "advert"], ["footer"]
    pieces = [x for p in before for x in _noise(draw, p, marked)] + article + [x for p in after for x in _noise(draw, p, marked)]
    if draw.random() < 0.35:
        pieces = _wrapped(pieces, "div", _named(draw, "wrapper page site container layout app root with-sidebar has-menu no-ads content-and-sidebar".split()))
    body = "<body>" + "".join(b + t + a for b, t, a, _ in pieces) + draw.choice(("</body></html>", ""))
    head = "<!DOCTYPE html><html><head><title>" + _sentence(draw) + "</title><script>var a='</p>';</script></head>"
    return head + body, [label for *_, label in pieces]


def examples(seed: int, pages: int) -> list[tuple[Page, list[int]]]:
    """Made-up pages as they are read, with labels."""
    draw, out = random.Random(seed), []
    while len(out) < pages:
        source, labels = made_page(draw)
        page = read_page(source)
        if labels and len(page.texts) == len(labels):
            out.append((page, labels))
    return out


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, rounds: int = ROUNDS, seed: int = SEED) -> Labeller:
    """The labeller, fitted by stochastic descent with running moments of the gradients."""
    made, model = examples(seed, pages), Labeller(seed)
    ready = []
    for page, labels in made:
        paths: list[list[int]] = []
        for node in page.nodes:
            names = []
            while node >= 0:
                names += page.names[node]
                node = page.parents[node]
            paths.append(names)
        words = word_lists(page)
        ready.append((paths, words, measures(page), labels))
    draw = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step, steps = 0, rounds * -(-len(ready) // BATCH)
    for _ in range(rounds):
        order = draw.permutation(len(ready))
        for s in range(0, len(order), BATCH):
            batch = sorted((ready[i] for i in order[s : s + BATCH]), key=lambda r: -len(r[3]))
            lengths = np.array([len(r[3]) for r in batch])
            labels = np.array([x for r in batch for x in r[3]], np.float32)
            # Half of the blocks are shown without their words, so that no block hangs on these alone.
            words = [w if x else [] for w, x in zip([w for r in batch for w in r[1]], draw.random(len(labels)) < 0.5, strict=True)]
            _, grads = model.gradients([p for r in batch for p in r[0]], words, np.concatenate([r[2] for r in batch]), lengths, labels)
            step += 1
            rate = 0.01 * (1 - step / (steps + 1)) + 0.0005
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                # Vectors of words learn slowly: most of them are seen too seldom to mean anything.
                model.w[k] -= (rate / 4 if k == "words" else rate) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def main_text(pages: list[Page], model: Labeller) -> list[str]:
    return ["\n".join([t for t, x in zip(page.texts, p.tolist(), strict=True) if x >= 0.5]) for page, p in zip(pages, model.probabilities(pages), strict=True)]


def extract_main_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """Per page: page_id, url and text, the blocks of its article joined by line breaks."""
    weights = (model or trained()).w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller.__new__(Labeller)
        labeller.w = weights
        for batch in batches:
            texts: list[str] = []
            part: list[Page] = []
            for source in batch.column(2).to_pylist():
                part.append(read_page(source))
                if len(part) == TOGETHER or sum(len(p.texts) for p in part) > BLOCKS:
                    texts += main_text(part, labeller)
                    part = []
            texts += main_text(part, labeller)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string")


def op13_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: main text of all pages."""
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


# The pages of the tables hold their text in one article element; the statement reads that, the labeller knows no such rule.
_PLAIN = "regexp_replace(piece, '<[^>]*>', '', 'g')"
for _name, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_name}', '{_sign}')"
OP13_SQL = f"""
WITH pieces AS (
  SELECT page_id, unnest(regexp_split_to_array(replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<br>', ' '), '</?(p|h1)>')) AS piece,
    generate_subscripts(regexp_split_to_array(replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<br>', ' '), '</?(p|h1)>'), 1) AS place FROM pages),
blocks AS (SELECT page_id, place, trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g')) AS block FROM pieces),
texts AS (SELECT page_id, string_agg(block, chr(10) ORDER BY place) AS text FROM blocks WHERE block <> '' GROUP BY page_id)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM pages LEFT JOIN texts USING (page_id)
"""
