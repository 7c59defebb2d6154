"""Main text of web pages by a recurrent labeller of blocks.

A page becomes the sequence of its leaf blocks. Each block has a vector of its
tag path (tags, classes and ids of all ancestors), one of its hashed words, and
a few measures. A bidirectional LSTM in numpy reads the whole sequence and
decides for every block whether it belongs to the main text. It is trained on a
bounded sample of the pages, labelled by the meaning of their tags, and on the
same blocks set into other layouts, so that it knows names that the sample lacks.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.frames import map_texts, sampled, table, texts
from tillflow.llm.registry import query

# pages to train on: at most so many of at most so many bytes
SAMPLE_PAGES, SAMPLE_BYTES, LAYOUTS, EPOCHS = 150, 1 << 15, 2, 36
PATH, WORDS, MEASURES, HIDDEN = 128, 32, 5, 12
INPUT = PATH + WORDS + MEASURES
# sequences padded to one length are read together, as many as have so many blocks
TOGETHER = 1 << 15

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|textarea|iframe|title)\b(?:\"[^\"<]*\"|'[^'<]*'|[^'\">])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"<]*\"|'[^'<]*'|[^'\"<>])*+)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^<>]*>", re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[a-z]+")
# fixed values: elements without content, and elements that do not end a block
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr li main nav ol p pre section table ul".split())
# fixed values: what tags and names say about a block, to label the sample
MAIN = frozenset("article main".split())
OTHER = frozenset("nav header footer aside form button select menu dialog ad ads advert adverts advertisement banner "
                  "breadcrumb breadcrumbs comment comments cookie cookies consent disqus login masthead menubar "
                  "navbar navigation newsletter notice popup promo related replies share sharing sidebar social "
                  "sponsor sponsored subscribe toolbar widget".split())


class Place:
    """A place in the tree of a page, known by its parent: an element costs as much as its own names, however deep it lies."""

    __slots__ = ("parent", "own", "slots")

    def __init__(self, parent: Place | None, own: tuple[str, ...]):
        self.parent, self.own = parent, own
        above = parent.slots if parent else frozenset()
        mine = {zlib.crc32(t.encode()) % PATH for t in own}
        self.slots = above if mine <= above else above | mine

    def path(self) -> tuple[str, ...]:
        out, at = [], self
        while at is not None:
            out.append(at.own)
            at = at.parent
        return tuple(t for own in reversed(out) for t in own)


@dataclass(slots=True)
class Block:
    text: str
    place: Place
    links: float  # share of the characters inside links

    @property
    def path(self) -> tuple[str, ...]:
        """The names of all elements around the block but the inline ones."""
        return self.place.path()


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    if attributes:
        for m in NAMES.finditer(attributes):
            out += ["." + w for w in PART.findall((m[1] or m[2] or m[3] or "").lower())]
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order: decoded text with single spaces, tag path, share of links."""
    # open elements, each with the place it stands for; inline ones stand for the place around them
    stack: list[tuple[str, Place]] = []
    opened: Counter[str] = Counter()
    out: list[Block] = []
    pieces: list[str] = []
    linked = 0
    root = Place(None, ())
    place: Place | None = None

    def end_block():
        nonlocal linked, place
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, place or root, min(1.0, linked / len(text))))
            pieces.clear()
        linked, place = 0, None

    def close(k: int):
        for tag, _ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    def add(text: str):
        nonlocal linked, place
        if not text:
            return
        if place is None and not text.isspace():
            place = stack[-1][1] if stack else root
        pieces.append(text)
        if opened["a"]:
            linked += len(text)

    at = 0
    for m in MARKUP.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            pieces.append(" ")
        elif m[2]:
            if tag not in INLINE:
                end_block()
            # most stray ends are known without a search
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break  # a stray end of an inline element closes no block
        else:
            if tag not in INLINE:
                end_block()
                if tag in CLOSES_P:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == "p" or tag == stack[k][0] == "li":
                            close(k)
                            break
                        if stack[k][0] not in INLINE:
                            break
            if tag not in VOID:
                around = stack[-1][1] if stack else root
                stack.append((tag, around if tag in INLINE else Place(around, _tokens(tag, m[4]))))
                opened[tag] += 1
    add(page[at:])
    end_block()
    return out


def vectors(sequence: list[Block]) -> np.ndarray:
    """One row a block: tag path, hashed words, measures."""
    x = np.zeros((len(sequence), INPUT), np.float32)
    crc = zlib.crc32
    for i, b in enumerate(sequence):
        x[i, [*b.place.slots, *[crc(b"last " + t.encode()) % PATH for t in b.place.own[-1:]]]] = 1
        words = b.text.lower().encode("utf-8", "surrogatepass").split()
        counts = np.bincount([crc(w) % WORDS for w in words], minlength=WORDS)
        x[i, PATH:PATH + WORDS] = 0.3 * counts / np.sqrt((counts ** 2).sum())
        x[i, PATH + WORDS:] = (b.links, np.log1p(len(words)) / 5, i == 0, i + 1 == len(sequence),
                               (i + 0.5) / len(sequence))
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """A bidirectional LSTM over sequences of block vectors, with one output for each block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {"out": rng.normal(0, 0.2, (2 * h + INPUT, 1)), "out_b": np.zeros(1)}
        for side in ("f", "b"):
            self.p["x" + side] = rng.normal(0, 0.1, (INPUT, 4 * h))
            self.p["h" + side] = rng.normal(0, 0.2, (h, 4 * h))
            self.p["c" + side] = np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]  # the forget gate starts open
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x, mask, side, trace):
        """x: (time, rows, INPUT), read from the last to the first for side b."""
        h = HIDDEN
        wx = x @ self.p["x" + side] + self.p["c" + side]
        times = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
        state = cell = np.zeros((x.shape[1], h), np.float32)
        out = np.zeros((len(x), x.shape[1], h), np.float32)
        for t in times:
            z = wx[t] + state @ self.p["h" + side]
            i, f, o = (_sigmoid(z[:, k * h:(k + 1) * h]) for k in (0, 1, 2))
            g, m = np.tanh(z[:, 3 * h:]), mask[t][:, None]
            new = f * cell + i * g
            squashed = np.tanh(new)
            if trace is not None:
                trace.append((t, state, cell, i, f, o, g, squashed, m))
            cell = np.where(m, new, cell)
            state = np.where(m, o * squashed, state)
            out[t] = state
        return out

    def _back(self, x, d_out, side, trace, grads):
        h = HIDDEN
        d_state = d_cell = np.zeros((x.shape[1], h), np.float32)
        dz_all = np.zeros((len(x), x.shape[1], 4 * h), np.float32)
        for t, state, cell, i, f, o, g, squashed, m in reversed(trace):
            d = d_state + d_out[t]
            live, kept = np.where(m, d, 0), np.where(m, 0, d)
            dc = np.where(m, d_cell, 0) + live * o * (1 - squashed ** 2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), live * squashed * o * (1 - o),
                                 dc * i * (1 - g ** 2)], axis=1)
            dz_all[t] = dz
            grads["h" + side] += state.T @ dz
            d_state = kept + dz @ self.p["h" + side].T
            d_cell = dc * f + np.where(m, 0, d_cell)
        grads["x" + side] += x.reshape(-1, INPUT).T @ dz_all.reshape(-1, 4 * h)
        grads["c" + side] += dz_all.sum((0, 1))

    def judge(self, x, mask, traces=None):
        """Each block's probability, (time, rows)."""
        sides = [self._run(x, mask, s, None if traces is None else traces[s]) for s in ("f", "b")]
        all_in = np.concatenate([*sides, x], axis=2)
        return _sigmoid((all_in @ self.p["out"])[..., 0] + self.p["out_b"][0]), all_in

    def train(self, sequences: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.03):
        order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
        batches = [order[k:k + 48] for k in range(0, len(order), 48)]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            for batch in batches:
                x, mask = padded([sequences[k] for k in batch])
                y = np.zeros(mask.shape, np.float32)
                for r, k in enumerate(batch):
                    y[:len(labels[k]), r] = labels[k]
                traces = {"f": [], "b": []}
                p, all_in = self.judge(x, mask, traces)
                d = np.where(mask, p - y, 0) / mask.sum()
                grads = {k: np.zeros_like(v) for k, v in self.p.items()}
                grads["out"] += all_in.reshape(-1, all_in.shape[2]).T @ d.reshape(-1, 1)
                grads["out_b"] += d.sum()
                back = d[..., None] * self.p["out"][:, 0]
                for n, side in enumerate(("f", "b")):
                    self._back(x, back[..., n * HIDDEN:(n + 1) * HIDDEN], side, traces[side], grads)
                step += 1
                slowed = rate * (1 - 0.9 * epoch / epochs)
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - slowed * (first[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-7)

    def keep(self, sequences: list[list[Block]]) -> list[list[bool]]:
        out: list[list[bool]] = [[] for _ in sequences]
        order = sorted((k for k in range(len(sequences)) if sequences[k]), key=lambda k: len(sequences[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(sequences[order[end]]) <= TOGETHER:
                end += 1
            group = order[at:end]
            x, mask = padded([vectors(sequences[k]) for k in group])
            p, _ = self.judge(x, mask)
            for r, k in enumerate(group):
                out[k] = (p[:len(sequences[k]), r] >= 0.5).tolist()
            at = end
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, rows))
    x, mask = np.zeros((longest, len(rows), INPUT), np.float32), np.zeros((longest, len(rows)), bool)
    for r, v in enumerate(rows):
        x[:len(v), r], mask[:len(v), r] = v, True
    return x, mask


def meant(sequence: list[Block]) -> list[bool]:
    """What tags and names say: labels to train on."""
    bare = [{t.lstrip(".") for t in b.path} for b in sequence]
    marked = any(names & MAIN and not names & OTHER for names in bare)
    return [not names & OTHER and (bool(names & MAIN) or not marked and b.links < 0.5) for names, b in zip(bare, sequence)]


# layouts that the blocks of the sample are set into: paths of main text, and of what is not
AROUND = [("html", "body"), ("html", "body", "div", ".page"), ("html", "body", "div", ".wrapper", "div", ".container")]
INSIDE = [("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".article", ".body"),
          ("section", ".post"), ("div", ".entry", ".content"), ("article", "section"), ("div", ".main"), ("td", ".text")]
LEAVES = [("p",), ("p",), ("p",), ("h2",), ("ul", "li"), ("blockquote", "p"), ("div",), ("pre",), ("table", "tr", "td")]
OUTSIDE = [("nav", "ul", "li"), ("nav",), ("header", "h1"), ("header", "div"), ("footer",), ("footer", "p"), ("aside", "p"),
           ("aside", "div"), ("div", ".ad"), ("div", ".ads", "p"), ("div", ".advert"), ("div", ".advertisement", "p"),
           ("div", ".sidebar", "p"), ("div", ".sidebar", "ul", "li"), ("div", ".menu", "ul", "li"), ("ul", ".menu", "li"),
           ("form", "p"), ("form", "div"), ("form", "button"), ("form", "select", "option"), ("div", ".cookie", ".notice"),
           ("div", ".notice", "p"), ("div", ".banner"), ("div", ".comments", "p"), ("section", ".comments", "div", ".comment", "p"),
           ("ol", ".comments", "li", "p"), ("div", ".comment", "p"), ("div", ".footer"), ("div", ".header"), ("div", ".nav"),
           ("div", ".promo", "p"), ("div", ".related", "li"), ("div", ".share"), ("div", ".social"), ("div", ".breadcrumbs"),
           ("div", ".newsletter", "p"), ("div", ".popup", "p"), ("div", ".sponsored", "p"), ("div", ".consent", "p")]


def another_layout(page: list[Block], labels: list[bool], others: list[str], rng: random.Random) -> tuple[list[Block], list[bool]]:
    """The page's main blocks in another layout, with blocks around, between and behind that do not belong."""
    around, inside = rng.choice(AROUND), rng.choice(INSIDE)
    out, marks = [], []

    def stray(within: tuple[str, ...]):
        path = within + rng.choice(OUTSIDE)
        for _ in range(rng.choice((1, 1, 2, 4))):
            words = rng.choice(others).split()
            start = rng.randrange(len(words))
            text = " ".join(words[start:start + rng.choice((1, 2, 4, 12, 40))])
            out.append(Block(text, Place(None, path), rng.choice((0.0, 0.0, 1.0))))
            marks.append(False)

    for _ in range(rng.randrange(4)):
        stray(around)
    first = True
    for b, main in zip(page, labels):
        if main:
            leaf = ("h1",) if first else rng.choice(LEAVES)
            out.append(Block(b.text, Place(None, around + inside + leaf), b.links))
            marks.append(True)
            first = False
            if rng.random() < 0.05:
                stray(around + inside)
    for _ in range(rng.randrange(4)):
        stray(rng.choice((around, around + inside)))
    return out, marks


def trained(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Labeller:
    """A labeller trained on the pages with the smallest hashes of their ids, each as it is and in other layouts."""
    sample = sampled(texts(pages, id_col, text=html_col), id_col, SAMPLE_PAGES, SAMPLE_BYTES)
    model, rng = Labeller(), random.Random(3)
    found = [s for s in (blocks(t) for t in sample) if s]
    if found:
        marked = [(s, meant(s)) for s in found]
        others = [b.text for s in found for b in s]
        training = marked + [another_layout(s, m, others, rng) for s, m in marked for _ in range(LAYOUTS)]
        training = [(s, m) for s, m in training if s]
        model.train([vectors(s) for s, _ in training], [np.array(m, np.float32) for _, m in training])
    return model


def main_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``(id, url, text, n_chars)`` for every row: the main text of the whole page.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined in page order by a line feed. Null or empty pages
    and pages without main text give an empty text and 0. Repeated rows and
    repeated or null ids give one row each, an empty table none. Broken markup
    is read as far as it goes; extra columns are left out.
    """
    model = trained(pages, id_col, html_col)

    def extract(batch: list[str]) -> dict[str, list]:
        sequences = [blocks(page) for page in batch]
        kept = model.keep(sequences)
        return {"main": ["\n".join(b.text for b, k in zip(s, ks) if k) for s, ks in zip(sequences, kept)]}

    found = map_texts(texts(pages, id_col, url_col, text=html_col), extract, "main string")
    return found.select(id_col, url_col, F.col("main").alias("text"), F.length("main").cast("long").alias("n_chars"))


@query("op2_main_text")
def op2_main_text(spark, folder):
    """The main text of every page."""
    return main_texts(table(spark, folder, "pages"))
