"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks (``html_blocks``). Each becomes a vector: its tag path (tags, words of class, id and
role, signed hashing), its words (hashed) and a few measures of its text. A bidirectional LSTM in numpy reads the whole
sequence of a page, so each block is labelled with the whole page in view; blocks labelled main text are joined.

The labeller is trained when it is first needed, always alike: on ``Training.made`` pages from a generator that places menus, headers,
footers, sidebars, notices, adverts, forms and reader comments around and inside articles, and on at most
``Training.read`` pages of the table, drawn by hash among those of fewer than ``Training.longest`` characters, that mark their article
(``article`` or ``main``). The model has some 60,000 weights and is
sent to the executors. Pages are labelled where they are read; nothing is shuffled. Vectors are made and projected in parts, so a page
takes some two hundred numbers for each block, however long it is.

Defined results: a null or empty page, or one without main text, gives an empty text; pages are labelled whole, however
long; rows that repeat give rows that repeat; further columns pass through (text and n_chars are replaced).
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .html_blocks import Block, blocks_of

PATH, WORDS, MEASURES = 256, 32, 6
WIDTH = PATH + WORDS + MEASURES
#: Stands at the beginning of each main text of a generated page.
MARK = "\ue000"


@dataclass(frozen=True)
class Training:
    made: int = 1600
    read: int = 100
    #: Characters that a page of the table may have to be trained on; all pages are labelled.
    longest: int = 50_000
    hidden: int = 24
    rounds: int = 8
    batch: int = 24
    rate: float = 0.012
    seed: int = 11


# ---- vectors ---------------------------------------------------------------------------------------------------------

_PATHS: dict[tuple[str, ...], np.ndarray] = {}
_BUCKETS: dict[str, int] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    if (v := _PATHS.get(path)) is None:
        v = np.zeros(PATH, np.float32)
        names = [x.split(" ") for x in path if x not in ("html", "body")]
        seen = {tag for tag, *_ in names} | {f".{w}" for _, *words in names for w in words}
        if names:
            seen.add(f"leaf {names[-1][0]}")
        for name in seen:
            h = xxhash.xxh3_64_intdigest(name)
            v[h % PATH] += 1.0 if h >> 63 else -1.0
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        _PATHS[path] = v
    return v


def _bucket(word: str) -> int:
    if (b := _BUCKETS.get(word)) is None:
        if len(_BUCKETS) > 300_000:
            _BUCKETS.clear()
        _BUCKETS[word] = b = xxhash.xxh3_64_intdigest(word.lower()) % WORDS
    return b


def vectors(blocks: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
    """A row for each block; ``first`` and ``total`` place a part of a page's blocks in the page."""
    total = len(blocks) if total is None else total
    out = np.zeros((len(blocks), WIDTH), np.float32)
    for k, (row, b) in enumerate(zip(out, blocks, strict=True), first):
        row[:PATH] = _path_vector(b.path)
        words = b.text.split(" ")
        counts = np.bincount([_bucket(w) for w in words], minlength=WORDS)
        row[PATH : PATH + WORDS] = counts / (np.sqrt((counts * counts).sum()) + 1e-6)
        n = max(1, len(b.text))
        ends = b.text.count(".") + b.text.count(",") + b.text.count("!") + b.text.count("?")
        row[PATH + WORDS :] = (np.log1p(n) / 5, b.link_share, min(1.0, 10 * ends / n), len(b.path) / 8, k / total, 1 / (1 + k))
    return out


# ---- the network -----------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pass(given: np.ndarray, mask: np.ndarray, wh: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """One direction over the projected vectors (time, page, gates); where the mask is 0 the state stays empty."""
    t, n, _ = given.shape
    size = len(wh)
    h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    out, trace = np.zeros((t, n, size), np.float32), []
    for k in range(t):
        z = given[k] + h @ wh
        gates = _sigmoid(z[:, : 3 * size])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        g = np.tanh(z[:, 3 * size :])
        before, h_before = c, h
        c = (f * c + i * g) * mask[k]
        s = np.tanh(c)
        h = o * s * mask[k]
        out[k] = h
        if keep:
            trace.append((i, f, o, g, before, s, h_before))
    return out, trace


def _pass_back(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, trace: list, grad: np.ndarray) -> list[np.ndarray]:
    """Gradients of wx, wh and b."""
    t, n, _ = x.shape
    size = len(wh)
    dz_all, dwh = np.zeros((t, n, 4 * size), np.float32), np.zeros_like(wh)
    dh, dc = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    for k in range(t - 1, -1, -1):
        i, f, o, g, before, s, h_before = trace[k]
        dh = (dh + grad[k]) * mask[k]
        dc = (dc + dh * o * (1 - s * s)) * mask[k]
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dz_all[k] = dz
        dwh += h_before.T @ dz
        dh, dc = dz @ wh.T, dc * f
    return [x.reshape(t * n, -1).T @ dz_all.reshape(t * n, -1), dwh, dz_all.sum(axis=(0, 1))]


def _flip(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's sequence backwards, padding left at the end."""
    t = np.arange(len(x))[:, None]
    return np.take_along_axis(x, np.where(t < lengths, lengths - 1 - t, t)[..., None], axis=0)


class Labeller:
    """Weights: for either direction (wx, wh, b), then the output's (w, b)."""

    def __init__(self, hidden: int, seed: int) -> None:
        r = np.random.default_rng(seed)
        draw = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        bias = np.zeros(4 * hidden, np.float32)
        bias[hidden : 2 * hidden] = 1  # remember at first
        self.weights = [w for _ in range(2) for w in (draw(WIDTH, 4 * hidden), draw(hidden, 4 * hidden), bias.copy())]
        self.weights += [draw(2 * hidden, 1), np.zeros(1, np.float32)]

    def _forward(self, there: np.ndarray, back: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Scores from what both directions are given, the backward one in its own order."""
        w = self.weights
        mask = (np.arange(len(there))[:, None] < lengths)[..., None].astype(np.float32)
        forth, trace = _pass(there, mask, w[1], keep)
        again, trace_back = _pass(back, mask, w[4], keep)
        h = np.concatenate([forth, _flip(again, lengths)], axis=2)
        return (h @ w[6] + w[7])[..., 0], (mask, trace, trace_back, h)

    def _projected(self, blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
        """What both directions are given for a page's blocks, in page order."""
        w, n = self.weights, len(blocks)
        there, back = np.empty((n, w[0].shape[1]), np.float32), np.empty((n, w[3].shape[1]), np.float32)
        for at in range(0, n, 2048):
            x = vectors(blocks[at : at + 2048], at, n)
            there[at : at + 2048], back[at : at + 2048] = x @ w[0] + w[2], x @ w[3] + w[5]
        return there, back

    def gradients(self, x: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean loss of the blocks and its gradients."""
        w = self.weights
        t, many, _ = x.shape
        project = lambda y, k: (y.reshape(t * many, -1) @ w[k]).reshape(t, many, -1) + w[k + 2]
        back = _flip(x, lengths)
        z, (mask, trace, trace_back, h) = self._forward(project(x, 0), project(back, 3), lengths, keep=True)
        m, p = mask[..., 0], _sigmoid(z)
        n = m.sum()
        loss = float((-(labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9)) * m).sum() / n)
        dz = ((p - labels) * m / n)[..., None].astype(np.float32)
        dh = dz * w[6][:, 0]
        size = len(w[1])
        there = _pass_back(x, mask, w[0], w[1], trace, dh[..., :size])
        again = _pass_back(back, mask, w[3], w[4], trace_back, _flip(dh[..., size:], lengths))
        out = h.reshape(-1, h.shape[2]).T @ dz.reshape(-1, 1)
        return loss, [*there, *again, out, dz.sum(axis=(0, 1))]

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page's blocks, whether each is main text. Pages of like length go together, long ones alone."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            group = [order[at]]
            while at + len(group) < len(order) and len(group) < 128 and len(pages[order[at + len(group)]]) * (len(group) + 1) <= 8192:
                group.append(order[at + len(group)])
            at += len(group)
            lengths = np.array([len(pages[k]) for k in group])
            shape = (int(lengths.max()), len(group))
            there = np.zeros((*shape, self.weights[0].shape[1]), np.float32)
            back = np.zeros((*shape, self.weights[3].shape[1]), np.float32)
            for j, k in enumerate(group):
                forth, again = self._projected(pages[k])
                there[: lengths[j], j], back[: lengths[j], j] = forth, again[::-1]
                del forth, again
            z, _ = self._forward(there, back, lengths)
            for j, k in enumerate(group):
                out[k] = z[: lengths[j], j] > 0
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((lengths.max(), len(pages), WIDTH), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
    return x, lengths


# ---- training pages --------------------------------------------------------------------------------------------------

#: Words that sites use in class, id and role for each kind of block.
NAMES = {
    "main": "article content post entry main story body text page single blog news detail copy richtext prose".split(),
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs tabs topnav mainmenu links toc pagination pager skip dropdown".split(),
    "header": "header head masthead top logo branding site banner topbar title tagline".split(),
    "footer": "footer foot bottom copyright legal colophon credits".split(),
    "side": "sidebar side aside widget related recommended trending popular more rail secondary tags categories archive teaser".split(),
    "notice": "notice cookie cookies consent gdpr alert banner warning popup modal overlay privacy toast disclaimer".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion adsense adbox commercial affiliate banner".split(),
    "form": "form newsletter subscribe signup login search contact register feedback field".split(),
    "comments": "comment comments reply replies discussion respond reader disqus thread commentlist".split(),
    "share": "share social sharing follow like byline meta author date".split(),
}
#: Words that name a box of the article itself.
_BOXES = "info note fact facts box highlight summary key quote pull figure caption lead intro code example tip step list inner row wrap".split()
_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section"}


class _Maker:
    def __init__(self, r: random.Random) -> None:
        self.r = r
        syllables = ["".join(r.choice("bcdfghjklmnprstvwzéñüß") + r.choice("aeiouöèó") for _ in range(r.randint(1, 2))) for _ in range(40)]
        self.words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(300)]

    def text(self, most: int) -> str:
        r = self.r
        n = max(1, int(most ** r.random()))
        words = [r.choice(self.words) + (r.choice(",.!;") if r.random() < 0.15 else "") for _ in range(n)]
        if r.random() < 0.7:
            words[0], words[-1] = words[0].capitalize(), words[-1] + "."
        return " ".join(words)

    def names(self, kind: str) -> str:
        """Attributes of an element of a kind; sometimes none, or of no meaning."""
        r = self.r
        if r.random() < (0.25 if kind == "main" else 0.05):
            return f' class="{r.choice(["c", "col", "row", "box", "wrap", "x", "l"])}{r.randint(1, 99)}"'
        words = r.sample(NAMES[kind], r.randint(1, 2))
        value = r.choice("-_ ").join(words) + (r.choice(["", "", "-wrap", "-box", " left", "-1", " inner"]))
        return f' {r.choice(["class", "class", "class", "id"])}="{value}"'

    def inline(self, text: str) -> str:
        """Text with inline tags, some of them never closed."""
        r, words = self.r, text.split(" ")
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(words))
            tag = r.choice(["b", "i", "em", "strong", "span", "a href='/x'", "br", "img src='y'"])
            end = "" if tag.startswith(("br", "img")) or r.random() < 0.2 else f"</{tag.split(' ')[0]}>"
            words[k] = f"<{tag}>{words[k]}{end}"
        return " ".join(words)

    def links(self) -> str:
        r = self.r
        items = [f'<a href="/{r.randint(1, 99)}">{self.text(4)}</a>' for _ in range(r.randint(1, 9))]
        if r.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return r.choice([" ", " | ", ""]).join(items) if r.random() < 0.5 else "".join(f"<div>{x}</div>" for x in items)

    def around(self, kind: str) -> str:
        """An element that isn't main text."""
        r = self.r
        tag = _TAGS.get(kind, "div")
        if r.random() < 0.4:
            tag, names = "div", self.names(kind)
        else:
            names = self.names(kind) if tag in ("div", "section") or r.random() < 0.4 else ""
        paragraphs = lambda k: "".join(f"<p>{self.inline(self.text(40))}</p>" for _ in range(r.randint(1, k)))
        if kind == "menu":
            inner = self.links()
        elif kind == "header":
            inner = r.choice([f"<h1>{self.text(5)}</h1>", f"<a href='/'>{self.text(3)}</a>", self.text(8)]) + (self.links() if r.random() < 0.4 else "")
        elif kind == "footer":
            inner = r.choice(["&copy; ", "", "© "]) + self.text(15) + (self.links() if r.random() < 0.4 else "") + (paragraphs(2) if r.random() < 0.3 else "")
        elif kind == "side":
            inner = f"<h{r.randint(2, 4)}>{self.text(4)}</h{r.randint(2, 4)}>" * (r.random() < 0.7) + r.choice([self.links(), paragraphs(3)])
        elif kind == "form":
            inner = "".join(f"<label>{self.text(4)}</label><input name='q'>" for _ in range(r.randint(1, 3))) + f"<button>{self.text(2)}</button>" + (paragraphs(1) if r.random() < 0.4 else "")
        elif kind == "comments":
            one = lambda: f"<div{self.names('comments')}>" * (r.random() < 0.7) + f"<b>{self.text(2)}</b>" * (r.random() < 0.5) + paragraphs(2)
            inner = f"<h3>{self.text(3)}</h3>" * (r.random() < 0.6) + "".join(f"{x}</div>" if (x := one()).startswith("<div") else x for _ in range(r.randint(1, 5)))
        else:
            inner = r.choice([self.text(25), paragraphs(2), f"<span>{self.text(12)}</span><a href='/y'>{self.text(3)}</a>"])
        return f"<{tag}{names}>{inner}</{tag}>"

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            out.append(f"<h{r.randint(1, 2)}>{MARK}{self.text(12)}</h1>")
        for _ in range(r.randint(1, 12) if r.random() < 0.9 else r.randint(12, 60)):
            kind = r.random()
            body = MARK + self.inline(self.text(90))
            if kind < 0.7:
                out.append(f"<p>{body}" + "</p>" * (r.random() < 0.9))
            elif kind < 0.78:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.text(12)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.84:
                out.append(f"<h{r.randint(2, 4)}>{MARK}{self.text(8)}</h3>")
            elif kind < 0.89:
                out.append(f"<blockquote><p>{body}</p></blockquote>")
            elif kind < 0.93:
                out.append("<table><tr>" + "".join(f"<td>{MARK}{self.text(4)}</td>" for _ in range(r.randint(2, 4))) + "</tr></table>")
            elif kind < 0.95:
                names = f' class="{r.choice(_BOXES)}"' if r.random() < 0.7 else ""
                out.append(f"<{(t := r.choice(['div', 'div', 'figure', 'section', 'pre']))}{names}>{body}</{t}>")
            else:
                out.append(self.around(r.choice(["advert", "advert", "advert", "notice", "side", "share", "form", "comments"])))
        if r.random() < 0.35:
            out.append(self.around(r.choice(["comments", "comments", "comments", "share", "side", "advert"])))
        inner = "".join(out)
        kind = r.random()
        if kind < 0.12:
            return inner
        if kind < 0.34:
            return f"<div>{inner}</div>"
        if kind < 0.65:
            tag, names = r.choice(["article", "article", "main"]), self.names("main") if r.random() < 0.3 else ""
        else:
            tag, names = r.choice(["div", "section"]), self.names("main")
        inner = f"<{tag}{names}>{inner}</{tag}>"
        return f"<{(t := r.choice(['div', 'main', 'section']))}{self.names('main') if r.random() < 0.5 else ''}>{inner}</{t}>" if r.random() < 0.25 else inner

    def page(self) -> str:
        r = self.r
        some = lambda kinds: [self.around(k) for k in kinds if r.random() < 0.45]
        first = some(["notice", "header", "menu", "menu", "advert", "form", "side", "notice"])
        last = some(["share", "advert", "side", "comments", "form", "advert", "notice", "footer"])
        if r.random() < 0.7:
            last.append(self.around("footer"))
        body = "".join([*first, self.article(), *last])
        page = f"<html><head><title>{self.text(5)}</title></head><body>{body}</body></html>"
        return page[: r.randrange(len(page))] if r.random() < 0.05 else page


def made_pages(count: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    r, out = random.Random(seed), []
    while len(out) < count:
        blocks = blocks_of(_Maker(r).page())
        if blocks:
            labels = np.array([MARK in b.text for b in blocks], np.float32)
            out.append(([b._replace(text=b.text.replace(MARK, "")) for b in blocks], labels))
    return out


#: Kinds of elements that are no main text wherever they stand, also inside an article.
_APART = ("menu", "footer", "side", "notice", "advert", "form", "comments", "share")
_BESIDE = {w for kind in _APART for w in NAMES[kind]} - {*NAMES["main"], *NAMES["header"]}


def marked_page(page: str | None) -> tuple[list[Block], np.ndarray] | None:
    """A page that marks its article: blocks inside ``article`` or ``main``, but not inside what such an element may hold beside it.

    That is, elements whose tag, class, id or role says that they are menus, sidebars, notices, adverts, forms or reader comments.
    """
    blocks = blocks_of(page)
    aside = {"nav", "aside", "footer", "form"}

    def main(path: tuple[str, ...]) -> bool:
        names = [x.split(" ") for x in path]
        first = next((k for k, (tag, *_) in enumerate(names) if tag in ("article", "main")), None)
        return first is not None and not any(tag in aside for tag, *_ in names) and not any(w in _BESIDE for _, *words in names[first + 1 :] for w in words)

    labels = np.array([main(b.path) for b in blocks], np.float32)
    return (blocks, labels) if labels.any() else None


def train(pages: DataFrame, t: Training = Training()) -> Labeller:
    """The labeller for a table with a column ``html``."""
    n = max(1, pages.count())
    h = F.xxhash64("html")
    drawn = pages.select("html", h.alias("h")).where((F.length("html") < t.longest) & (F.pmod("h", F.lit(n)) < 2 * t.read)).orderBy("h").limit(t.read)
    read = [x for r in drawn.collect() if (x := marked_page(r["html"]))]
    return fit([*made_pages(t.made, t.seed), *read], t)


def fit(pages: list[tuple[list[Block], np.ndarray]], t: Training) -> Labeller:
    """Adam over batches of pages of like length."""
    model, r = Labeller(t.hidden, t.seed), np.random.default_rng(t.seed)
    data = sorted(((vectors(b), y) for b, y in pages), key=lambda x: len(x[1]))
    batches = [data[k : k + t.batch] for k in range(0, len(data), t.batch)]
    first, second = ([np.zeros_like(w) for w in model.weights] for _ in range(2))
    step, steps = 0, t.rounds * len(batches)
    for _ in range(t.rounds):
        for k in r.permutation(len(batches)):
            x, lengths = padded([v for v, _ in batches[k]])
            labels = np.zeros(x.shape[:2], np.float32)
            for j, (_, y) in enumerate(batches[k]):
                labels[: len(y), j] = y
            # features are left out now and then: no single one decides
            x = x * (r.random((1, 1, WIDTH)) > 0.01)
            _, grads = model.gradients(x.astype(np.float32), lengths, labels)
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            rate = t.rate * min(1, step / 20) * (1 - step / (steps + 1))
            for w, g, a, b in zip(model.weights, grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / (size + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


# ---- the operator ----------------------------------------------------------------------------------------------------


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    blocks = [blocks_of(p) for p in pages]
    labels = model.label(blocks)
    return [" ".join(b.text for b, keep in zip(bs, ls.tolist(), strict=True) if keep) for bs, ls in zip(blocks, labels, strict=True)]


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """Adds text and n_chars; html itself is dropped."""
    shared = pages.sparkSession.sparkContext.broadcast((model or train(pages)).weights)
    keep = [f for f in pages.schema.fields if f.name not in ("html", "text", "n_chars")]
    schema = StructType([*keep]).add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller.__new__(Labeller)
        own.weights = shared.value
        for whole in batches:
            for at in range(0, len(whole), 64):
                batch = whole.slice(at, 64)
                texts = main_texts(batch.column("html").to_pylist(), own)
                passed = batch.select([f.name for f in keep])
                yield pa.RecordBatch.from_arrays([*passed.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*passed.schema.names, "text", "n_chars"])

    return pages.select("html", *(f.name for f in keep)).mapInArrow(run, schema)
