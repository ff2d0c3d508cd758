"""Main text of web pages: a recurrent labeller over the sequence of text blocks.

A page becomes its leaf blocks in page order: text between block-level tags, with the path of
tags (and class, id and role words) that leads to it. Every block is a vector: the mean of
learned vectors of its hashed path words and of its hashed text words, and a few measures
(length, share of linked text, punctuation, place). A bidirectional LSTM reads the whole
sequence both ways and gives every block a chance of being main text, so a block is judged by
the whole page around it. Training and inference are numpy.

Pages carry no labels, so the model learns from composed pages: ``compose`` puts paragraphs,
menus, notices, adverts, sidebars, forms, comments and footers together in many layouts and
knows what each block is. Their texts come from a bounded sample of the table
(``train_pages`` pages of at most ``train_chars`` characters, by hash of the page id), with prose in all
roles, so that text alone doesn't give the answer. The fit is seeded and its size doesn't
depend on the table.

Defined results: a null or empty html, and a page without main text, give the empty text with
0 characters; tags that are never closed, stray end tags and a page cut off inside a tag are
read as far as they go; very long pages are one sequence, whole; rows that repeat
an id are extracted each, null ids and urls stay null; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridorwatch.llm.common import map_rows

# Elements of HTML.
#: Elements that end the block before them and begin a new one.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without text of the page; the first ones hold raw characters up to their end tag.
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN_TAGS = frozenset("head template noscript svg canvas math object audio video datalist".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the key is closed by the start of one of the values, up to one of LIMITS.
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]),
}
LIMITS = frozenset("table ul ol dl select body html article section div".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+>|[^>]*>)|[^<]++|<""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

BUCKETS = 4096
WIDTH = 16
HIDDEN = 24
MEASURES = 12


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int
    #: Known for composed pages only.
    main: bool = False


class _Open:
    """The open elements, with how often each tag is open, so a stray end tag costs nothing."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.count: dict[str, int] = {}
        #: How many open elements hide their text.
        self.hidden = 0

    def push(self, tag: str, path: tuple[str, ...]) -> None:
        self.stack.append((tag, path))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.hidden += tag in HIDDEN_TAGS

    def pop_to(self, tag: str) -> bool:
        if not self.count.get(tag):
            return False
        while True:
            top, _ = self.stack.pop()
            self.count[top] -= 1
            self.hidden -= top in HIDDEN_TAGS
            if top == tag:
                return True

    def path(self) -> tuple[str, ...]:
        return self.stack[-1][1] if self.stack else ()

    def begin(self, tag: str) -> None:
        """Closes what the start of ``tag`` closes without an end tag."""
        if tag in BLOCK_TAGS and self.count.get("p"):
            self.pop_to("p")
        for at in range(len(self.stack) - 1, -1, -1):
            inner = self.stack[at][0]
            if tag in CLOSED_BY.get(inner, ()):
                self.pop_to(inner)
                return
            if inner in LIMITS:
                return


#: Path words kept per block: the innermost ones; a path is a feature, no text is lost.
PATH_WORDS = 48


def _words_of(tag: str, attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return (tag,)
    found = [tag]
    for name, *values in _ATTRIBUTE.findall(attributes):
        found += [f"{name.lower()}:{w.lower()}" for w in _NAME_PART.findall("".join(values))]
    return tuple(found)


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page, in page order, white space and character references resolved."""
    if not page:
        return []
    found: list[Block] = []
    open_tags = _Open()
    pieces: list[str] = []
    linked_pieces: list[str] = []
    # behind the last ">" no tag can end
    last = page.rfind(">") + 1

    def flush() -> None:
        if pieces:
            text = "".join(pieces)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                found.append(Block(open_tags.path(), text, min(sum(map(len, linked_pieces)), len(text))))
            pieces.clear()
            linked_pieces.clear()

    at = 0
    while at < last:
        token = _TAG.match(page, at, last)
        at = token.end()
        tag = token[2]
        if tag is None:
            piece = token[0]
            if (piece[0] != "<" or piece == "<") and not open_tags.hidden:
                pieces.append(piece)
                if open_tags.count.get("a"):
                    linked_pieces.append(piece)
            continue
        tag = tag.lower()
        if token[1]:
            if tag in BLOCK_TAGS:
                flush()
            open_tags.pop_to(tag)
            continue
        attributes = token[3]
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = len(page) if end is None else page.find(">", end.start()) + 1 or len(page)
            pieces.append(" ") if pieces else None
            continue
        if tag in BLOCK_TAGS:
            flush()
            open_tags.begin(tag)
        elif tag == "br":
            pieces.append(" ")
        if tag in VOID_TAGS or attributes.endswith("/>") and tag not in BLOCK_TAGS:
            continue
        open_tags.push(tag, (open_tags.path() + _words_of(tag, attributes))[-PATH_WORDS:])
    if not open_tags.hidden and at < len(page):
        # the rest has text up to where a tag would begin
        pieces.append(re.split(r"<[A-Za-z/!?]", page[at:], maxsplit=1)[0])
    flush()
    return found


_KNOWN: dict[str, int] = {}


def _bucket(word: str) -> int:
    found = _KNOWN.get(word)
    if found is None:
        if len(_KNOWN) > 300_000:
            _KNOWN.clear()
        found = _KNOWN[word] = 1 + zlib.crc32(word.encode("utf-8", "replace")) % (BUCKETS - 1)
    return found


@dataclass
class Ragged:
    """Lists of bucket numbers, one per block; an empty list holds the neutral bucket 0."""

    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(lists: list[list[int]]) -> Ragged:
        lists = [x or [0] for x in lists]
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        return Ragged(np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(sizes.sum())), np.cumsum(sizes) - sizes, sizes)

    def mean(self, table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[self.flat], self.starts, axis=0) / self.sizes[:, None].astype(np.float32)

    def spread(self, gradient: np.ndarray, size: int) -> np.ndarray:
        """The gradient of the table from that of the means."""
        each = np.repeat(gradient / self.sizes[:, None], self.sizes, axis=0)
        return np.stack([np.bincount(self.flat, each[:, j], minlength=size) for j in range(each.shape[1])], axis=1).astype(np.float32)


def _measures(page: list[Block]) -> np.ndarray:
    rows = []
    n = len(page)
    for i, b in enumerate(page):
        t, tag = b.text, next((w for w in reversed(b.path) if ":" not in w and w in BLOCK_TAGS), "")
        marks = t.count(".") + t.count(",") + t.count(";") + t.count("!") + t.count("?")
        rows.append(
            (
                np.log1p(len(t)) / 8, np.log1p(t.count(" ")) / 6, b.linked / len(t), min(20 * marks / len(t), 2.0), t[-1] in ".!?\"'”»…",
                tag[:1] == "h" and tag[1:].isdigit(), tag == "li", tag == "p", len(b.path) / 10, i / n, (n - 1 - i) / n, min(n, 100) / 50,
            )
        )
    return np.array(rows, dtype=np.float32).reshape(n, MEASURES)


@dataclass
class Batch:
    """Pages side by side: ``place`` maps blocks to (step, page); steps beyond a page's end are masked."""

    paths: Ragged
    words: Ragged
    measures: np.ndarray
    step: np.ndarray
    page: np.ndarray
    shape: tuple[int, int]
    target: np.ndarray

    @staticmethod
    def of(pages: list[list[Block]]) -> Batch:
        flat = [b for p in pages for b in p]
        return Batch(
            Ragged.of([[_bucket(w) for w in b.path] for b in flat]),
            Ragged.of([[_bucket(w) for w in b.text.lower().split()] for b in flat]),
            np.concatenate([_measures(p) for p in pages]),
            np.concatenate([np.arange(len(p)) for p in pages]),
            np.repeat(np.arange(len(pages)), [len(p) for p in pages]),
            (max(map(len, pages)), len(pages)),
            np.array([b.main for b in flat], dtype=np.float32),
        )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _run(inputs: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """An LSTM over the steps; masked steps leave the state as it is."""
    steps, pages, _ = inputs.shape
    h = c = np.zeros((pages, HIDDEN), dtype=np.float32)
    from_input = inputs @ w + b
    out, trace = np.zeros((steps, pages, HIDDEN), dtype=np.float32), []
    for t in range(steps):
        z = from_input[t] + h @ u
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new_c = f * c + i * g
        squashed = np.tanh(new_c)
        if keep:
            trace.append((h, c, i, f, o, g, squashed, m))
        c = np.where(m, new_c, c)
        h = np.where(m, o * squashed, h)
        out[t] = h
    return out, trace


def _run_back(inputs: np.ndarray, trace: list, u: np.ndarray, w: np.ndarray, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the inputs, w, u and b."""
    steps, pages, _ = inputs.shape
    d_h = d_c = np.zeros((pages, HIDDEN), dtype=np.float32)
    d_z = np.zeros((steps, pages, 4 * HIDDEN), dtype=np.float32)
    d_u = np.zeros_like(u)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, squashed, m = trace[t]
        d_h = d_h + d_out[t]
        live_h, live_c = np.where(m, d_h, 0), np.where(m, d_c, 0)
        d_new = live_c + live_h * o * (1 - squashed**2)
        d_z[t] = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), live_h * squashed * o * (1 - o), d_new * i * (1 - g**2)], axis=1)
        d_u += h.T @ d_z[t]
        d_h = np.where(m, 0, d_h) + d_z[t] @ u.T
        d_c = np.where(m, d_new * f, d_c)
    flat = d_z.reshape(-1, 4 * HIDDEN)
    return d_z @ w.T, inputs.reshape(len(flat), -1).T @ flat, d_u, flat.sum(axis=0)


@dataclass
class Labeller:
    """Parameters: tables of path and word vectors, an LSTM each way, and the output layer."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(rng: np.random.Generator) -> Labeller:
        size = 2 * WIDTH + MEASURES

        def normal(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        bias = np.zeros(4 * HIDDEN, dtype=np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        # words never met in training stay at zero
        p = {"paths": np.zeros((BUCKETS, WIDTH), np.float32), "words": np.zeros((BUCKETS, WIDTH), np.float32)}
        for way in ("f", "b"):
            p |= {f"w_{way}": normal(size, 4 * HIDDEN), f"u_{way}": normal(HIDDEN, 4 * HIDDEN), f"b_{way}": bias.copy()}
        return Labeller(p | {"out": normal(2 * HIDDEN), "bias": np.zeros(1, np.float32)})

    def _inputs(self, batch: Batch) -> np.ndarray:
        x = np.zeros((*batch.shape, 2 * WIDTH + MEASURES), dtype=np.float32)
        x[batch.step, batch.page] = np.concatenate([batch.paths.mean(self.p["paths"]), batch.words.mean(self.p["words"]), batch.measures], axis=1)
        return x

    def _states(self, batch: Batch, keep: bool) -> tuple[np.ndarray, np.ndarray, list, list, np.ndarray]:
        p, x = self.p, self._inputs(batch)
        mask = np.zeros(batch.shape, dtype=bool)
        mask[batch.step, batch.page] = True
        ahead, trace_f = _run(x, mask, p["w_f"], p["u_f"], p["b_f"], keep)
        back, trace_b = _run(x[::-1], mask[::-1], p["w_b"], p["u_b"], p["b_b"], keep)
        return x, np.concatenate([ahead, back[::-1]], axis=2)[batch.step, batch.page], trace_f, trace_b, mask

    def chances(self, batch: Batch) -> np.ndarray:
        return _sigmoid(self._states(batch, False)[1] @ self.p["out"] + self.p["bias"])

    def gradients(self, batch: Batch) -> dict[str, np.ndarray]:
        p = self.p
        x, states, trace_f, trace_b, _ = self._states(batch, True)
        error = (_sigmoid(states @ p["out"] + p["bias"]) - batch.target) / len(states)
        d_states = np.zeros((*batch.shape, 2 * HIDDEN), dtype=np.float32)
        d_states[batch.step, batch.page] = error[:, None] * p["out"]
        d_xf, d_wf, d_uf, d_bf = _run_back(x, trace_f, p["u_f"], p["w_f"], d_states[:, :, :HIDDEN])
        d_xb, d_wb, d_ub, d_bb = _run_back(x[::-1], trace_b, p["u_b"], p["w_b"], d_states[::-1, :, HIDDEN:])
        d_x = (d_xf + d_xb[::-1])[batch.step, batch.page]
        found = {"w_f": d_wf, "u_f": d_uf, "b_f": d_bf, "w_b": d_wb, "u_b": d_ub, "b_b": d_bb}
        found |= {"paths": batch.paths.spread(d_x[:, :WIDTH], BUCKETS), "words": batch.words.spread(d_x[:, WIDTH : 2 * WIDTH], BUCKETS)}
        found["paths"][0] = found["words"][0] = 0
        return found | {"out": states.T @ error, "bias": error.sum(keepdims=True)}


@dataclass(frozen=True)
class LabellerConfig:
    #: Bounds of the sample whose texts go into composed pages.
    train_pages: int = 300
    train_chars: int = 100_000
    composed: int = 3000
    #: Characters of a sampled text that a composed block takes at most.
    block_chars: int = 400
    passes: int = 5
    pages_per_step: int = 16
    rate: float = 0.01
    seed: int = 20


# Layout of composed pages: what sites commonly call the parts of a page.
_MAIN = ["content", "post", "entry content", "article body", "story", "main", "post content", "text", "article", "page content", "entry", "body copy"]
_SHELL = ["wrapper", "container", "page", "row", "col main", "inner", "site", "layout", "grid"]
_MENU = ["menu", "navbar", "navigation", "breadcrumb", "top bar", "main nav", "site nav", "toc", "pagination", "tabs", "links", "tags"]
_NOTICE = ["cookie notice", "notice", "banner", "alert", "consent", "gdpr", "announcement", "message", "newsletter", "popup", "modal", "subscribe", "warning"]
_ADVERT = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "ad slot", "sponsor", "banner ad", "outbrain"]
_ASIDE = ["sidebar", "widget", "related", "rail", "recommended", "side", "trending", "more", "author box", "popular", "aside", "share", "social"]
_COMMENTS = ["comments", "comment list", "discussion", "responses", "replies", "comment", "disqus", "reader comments", "user comments"]
_FOOTER = ["footer", "site footer", "copyright", "colophon", "bottom", "legal", "foot"]
_HEADER = ["header", "masthead", "site header", "branding", "logo", "top", "hero", "site title"]


class Composer:
    """Random pages with known blocks; ``prose`` and ``short`` are texts to fill them with."""

    def __init__(self, rng: np.random.Generator, prose: list[str], short: list[str]):
        self.rng, self.prose, self.short = rng, prose, short
        self.found: list[Block] = []

    def any(self, choices: list) -> object:
        return choices[int(self.rng.integers(len(choices)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def named(self, tag: str, names: list[str], plain: float = 0.0) -> tuple[str, ...]:
        """Path words of an element that is called one of the names."""
        if self.chance(plain):
            return (tag,)
        kind = self.any(["class", "class", "class", "id", "role"]) if tag in ("div", "section") else self.any(["class", "id"])
        return (tag, *(f"{kind}:{w}" for w in self.any(names).split()))

    def add(self, path: tuple[str, ...], text: str, main: bool, linked: float = 0.0) -> None:
        if text:
            self.found.append(Block(path[-PATH_WORDS:], text, int(linked * len(text)), main))

    def links(self, path: tuple[str, ...], main: bool = False) -> None:
        for _ in range(int(self.rng.integers(2, 8))):
            self.add((*path, "ul", "li") if self.chance(0.7) else (*path, "div"), self.any(self.short), main, 1.0)

    def paragraphs(self, path: tuple[str, ...], n: int, main: bool) -> None:
        inner = self.any(["p", "p", "p", "p", "div"])
        few = self.chance(0.3)
        for _ in range(n):
            at = (*path, inner, self.any(["b", "em", "span", "a"])) if self.chance(0.1) else (*path, inner)
            self.add(at, self.any(self.short if self.chance(0.6 if few else 0.15) else self.prose), main, 0.1 * self.chance(0.2))

    def aside(self, path: tuple[str, ...]) -> None:
        kind = int(self.rng.integers(7))
        if kind == 0:
            self.links((*path, *(("nav",) if self.chance(0.5) else self.named(self.any(["div", "ul", "nav"]), _MENU))))
        elif kind == 1:
            at = (*path, *self.named(self.any(["div", "section", "p"]), _NOTICE))
            self.paragraphs(at, int(self.rng.integers(1, 3)), False) if self.chance(0.5) else self.add(at, self.any(self.prose), False)
        elif kind == 2:
            at = (*path, *self.named(self.any(["div", "aside", "section", "ins"]), _ADVERT))
            self.paragraphs(at, 1, False) if self.chance(0.4) else self.add(at, self.any(self.prose + self.short), False, float(self.chance(0.4)))
        elif kind == 3:
            at = (*path, *(("aside",) if self.chance(0.4) else self.named(self.any(["div", "aside", "section"]), _ASIDE)))
            if self.chance(0.6):
                self.add((*at, self.any(["h2", "h3", "h4"])), self.any(self.short), False)
            self.links(at) if self.chance(0.5) else self.paragraphs(at, int(self.rng.integers(1, 4)), False)
        elif kind == 4:
            at = (*path, "form", *(() if self.chance(0.5) else ("class:form",)))
            for tag in ("p", "label", "label", "button"):
                self.add((*at, tag), self.any(self.prose if tag == "p" else self.short), False)
        elif kind == 5:
            self.add((*path, *self.named("div", _MENU)), " ".join(self.any(self.short) for _ in range(4)), False, 0.9)
        else:
            self.add((*path, *self.named("div", _ASIDE)), self.any(self.short), False, float(self.chance(0.6)))

    def article(self, path: tuple[str, ...]) -> None:
        form = int(self.rng.integers(6))
        at = (*path, *[("article",), ("main",), ("main", "article"), self.named("div", _MAIN), self.named("section", _MAIN), ("div",)][form])
        if self.chance(0.3):
            at = (*at, *self.named("div", _MAIN))
        if self.chance(0.85):
            self.add((*at, *(("header",) if self.chance(0.15) else ()), self.any(["h1", "h1", "h2"])), self.any(self.short + self.prose), True)
        for _ in range(1 if self.chance(0.15) else int(self.rng.integers(1, 6))):
            if self.chance(0.1):
                self.add((*at, "p", *(("b",) if self.chance(0.5) else ())), self.any(self.short), True)
                continue
            self.paragraphs(at, int(self.rng.integers(1, 30 if self.chance(0.05) else 6)), True)
            kind = int(self.rng.integers(12))
            if kind == 0:
                for _ in range(int(self.rng.integers(2, 6))):
                    self.add((*at, self.any(["ul", "ol"]), "li"), self.any(self.prose + self.short), True)
            elif kind == 1:
                self.add((*at, "blockquote", *(("p",) if self.chance(0.5) else ())), self.any(self.prose), True)
            elif kind in (2, 3):
                self.add((*at, self.any(["h2", "h3"])), self.any(self.short), True)
            elif kind == 4:
                self.add((*at, self.any(["pre", "table", "figure"]), self.any(["td", "figcaption"])), self.any(self.short + self.prose), True)
            elif kind in (5, 6):
                self.aside(at)

    def comments(self, path: tuple[str, ...]) -> None:
        at = (*path, *self.named(self.any(["div", "section", "ol"]), _COMMENTS))
        if self.chance(0.5):
            self.add((*at, self.any(["h2", "h3"])), self.any(self.short), False)
        inner = self.any([("div", "class:comment"), ("li",), ("article",), ("article", "class:comment"), ("div",), ()])
        for _ in range(int(self.rng.integers(1, 6))):
            self.paragraphs((*at, *inner), int(self.rng.integers(1, 3)), False)

    def page(self) -> list[Block]:
        self.found = []
        base: tuple[str, ...] = ("html", "body")
        if self.chance(0.5):
            self.aside(base)
        if self.chance(0.6):
            at = (*base, *(("header",) if self.chance(0.5) else self.named(self.any(["div", "header"]), _HEADER)))
            self.add((*at, self.any(["div", "p", "h1", "h2"])), self.any(self.short + self.prose[:20]), False, float(self.chance(0.5)))
            if self.chance(0.5):
                self.links((*at, "nav"))
        for _ in range(int(self.rng.integers(0, 4))):
            self.aside(base)
        inside = base
        for _ in range(int(self.rng.integers(0, 3))):
            inside = (*inside, *self.named("div", _SHELL, 0.4))
        if self.chance(0.3):
            self.aside(inside)
        if self.chance(0.97):
            self.article(inside)
        if self.chance(0.35):
            self.comments(self.any([base, inside]))
        for _ in range(int(self.rng.integers(0, 3))):
            self.aside(self.any([base, inside]))
        if self.chance(0.7):
            at = (*base, *(("footer",) if self.chance(0.6) else self.named("div", _FOOTER)))
            self.add(at if self.chance(0.5) else (*at, "p"), self.any(["© ", "Copyright ", ""]) + self.any(self.prose + self.short), False)
            if self.chance(0.4):
                self.links(at)
        # names are not always given or known: the rest of the page must do
        lost = 0.1 * self.chance(0.5)
        return [Block(tuple(w for w in b.path if ":" not in w or not self.chance(lost)), b.text, b.linked, b.main) for b in self.found]


def texts_of(sample: list[str], most: int) -> tuple[list[str], list[str]]:
    """Prose and short texts of sampled pages, cut at word borders to ``most`` characters."""
    prose, short = [], []
    for page in sample:
        for b in blocks(page):
            text = b.text if len(b.text) <= most else b.text[:most].rsplit(" ", 1)[0] + "."
            (prose if len(text) >= 60 else short).append(text)
    return sorted(set(prose)) or ["A few words of running text, for pages that hold none. They end with a stop."], sorted(set(short)) or ["Home", "About us", "Next"]


def train(sample: list[str], config: LabellerConfig = LabellerConfig()) -> Labeller:
    rng = np.random.default_rng(config.seed)
    composer = Composer(rng, *texts_of(sample, config.block_chars))
    pages = [p for p in (composer.page() for _ in range(config.composed)) if p]
    model = Labeller.fresh(rng)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    # pages of like length share a step
    pages.sort(key=len)
    batches = [Batch.of(pages[i : i + config.pages_per_step]) for i in range(0, len(pages), config.pages_per_step)]
    step, steps = 0, config.passes * len(batches)
    for _ in range(config.passes):
        for k in rng.permutation(len(batches)):
            step += 1
            rate = config.rate * (1 - step / (steps + 1))
            for name, gradient in model.gradients(batches[k]).items():
                first[name] += 0.1 * (gradient - first[name])
                second[name] += 0.01 * (gradient**2 - second[name])
                model.p[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return model


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", config: LabellerConfig = LabellerConfig()) -> Labeller:
    """The model from a sample of ``train_pages`` pages; about twice as many leave the tasks, whatever their number."""
    share = min(1.0, 2 * config.train_pages / max(pages.count(), 1))
    order = F.xxhash64(F.col(key).cast("string"), F.col(html))
    given = pages.where(F.length(F.col(html)).between(1, config.train_chars)).select(order.alias("order"), F.col(html).alias("html"))
    drawn = given.where(F.pmod("order", F.lit(1 << 30)) < share * (1 << 30)).orderBy("order", "html").limit(config.train_pages)
    return train([r["html"] for r in drawn.collect()], config)


#: Blocks that go through the network side by side, at most, unless one page has more.
CELLS = 4096


def extract(model: Labeller, pages: list[str | None]) -> list[str]:
    parsed = [blocks(p) for p in pages]
    out = [""] * len(pages)
    waiting = sorted((i for i, p in enumerate(parsed) if p), key=lambda i: len(parsed[i]))
    start = 0
    while start < len(waiting):
        stop = start + 1
        while stop < len(waiting) and (stop + 1 - start) * len(parsed[waiting[stop]]) <= CELLS:
            stop += 1
        group = [parsed[i] for i in waiting[start:stop]]
        main = iter((model.chances(Batch.of(group)) >= 0.5).tolist())
        for i, page in zip(waiting[start:stop], group):
            out[i] = " ".join(b.text for b in page if next(main))
        start = stop
    return out


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", config: LabellerConfig = LabellerConfig()) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    sent = pages.sparkSession.sparkContext.broadcast(fit(pages, key, html, config))

    def run(batch: dict) -> dict:
        texts = extract(sent.value, batch["html"])
        return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    given = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return map_rows(given, run, "page_id bigint, url string, text string, n_chars bigint")
