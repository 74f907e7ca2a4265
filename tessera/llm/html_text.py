"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with the path of open tags.
A bidirectional LSTM (numpy) reads the sequence of all blocks of the page; a block's input is its tag path
(tags, classes, ids, hashed) and its words (hashed counts), so each block is judged with the whole
document around it. Blocks labelled as main text are joined.

The labeller is trained here, on pages that :func:`lesson` writes from common templates with invented words, whose
blocks' labels are known; the seed is fixed, so it is the same everywhere. Pages in the table are
not used for training.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt

PATH_BUCKETS, WORD_BUCKETS, HIDDEN = 1024, 64, 24
LESSONS, STEPS, BATCH, SEED = 1200, 220, 48, 7
#: Pages labelled together in a task.
PAGES = 128

#: Tags that don't end a block, tags without content, tags whose content isn't text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object".split())
#: What an opening tag ends where its end tag was left out, and what it doesn't look beyond.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody"), ("table",)), "tfoot": (("thead", "tbody"), ("table",)),
}
#: Blocks times pages whose inputs are held at once; longer pages are read piece by piece.
CELLS = 1 << 16

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Za-z]+")
_WORD = re.compile(r"\w+")


@lru_cache(maxsize=20_000)
def _element(tag: str, attributes: str) -> tuple[str, ...]:
    names = [tag]
    for kind, *values in _NAMES.findall(attributes):
        for value in values:
            names += [f"{'#' if kind.lower() == 'id' else '.'}{p.lower()}" for p in _PART.findall(value)]
    return tuple(names)


@lru_cache(maxsize=20_000)
def _buckets_of(names: tuple[str, ...]) -> frozenset[int]:
    return frozenset(zlib.crc32(n.encode()) % PATH_BUCKETS for n in names)


@lru_cache(maxsize=20_000)
def _joined(outer: frozenset[int], own: frozenset[int]) -> frozenset[int]:
    """One set for all elements that stand alike, instead of one each."""
    return outer if own <= outer else outer | own


class Path:
    """An open element and, through its parent, those around it; a page's paths share their nodes. Iterates from the outermost element. ``buckets``
    are the hashed names of all of them, the parent's own set where the element adds none, so that depth takes no room."""

    __slots__ = ("element", "parent", "buckets")

    def __init__(self, element: tuple[str, ...], parent: Path | None):
        self.element, self.parent = element, parent
        self.buckets = _joined(parent.buckets if parent else frozenset(), _buckets_of(element))

    def __iter__(self) -> Iterator[tuple[str, ...]]:
        found, node = [], self
        while node is not None:
            found.append(node.element)
            node = node.parent
        return reversed(found)


def blocks(page: str) -> list[tuple[Path | tuple, str]]:
    """(path, text) of the leaf blocks of a page, in order; text with character references decoded and white space joined. Time and room are in
    proportion to the page, whatever it leaves open or closes for nothing."""
    out: list[tuple[Path | tuple, str]] = []
    stack: list[Path] = []
    opened: Counter[str] = Counter()
    held: list[str] = []
    path: Path | tuple | None = None
    at, size = 0, len(page)

    def end() -> None:
        nonlocal path
        if held:
            text = " ".join(_html.unescape("".join(held)).split())
            if text:
                out.append((path or (), text))
            held.clear()
        path = None

    def add(text: str) -> None:
        nonlocal path
        if text and (held or not text.isspace()):
            if path is None:
                path = stack[-1] if stack else ()
            held.append(text)

    def close(tags: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        """Ends the nearest open element of tags, and what is open in it, unless one of within comes first."""
        if any(opened[t] for t in tags):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].element[0] in tags:
                    for node in stack[i:]:
                        opened[node.element[0]] -= 1
                    del stack[i:]
                    return
                if stack[i].element[0] in within:
                    return

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m[1] or m[4])
        if tag in INLINE:
            if tag == "a" and not closing and not held:
                path = Path(_element(tag, ""), stack[-1] if stack else None)  # a block that begins with a link
            continue
        end()
        if closing:
            close((tag,))
        elif tag in RAW:
            ending = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at)
            at = ending.end() if ending else size
        elif tag not in VOID:
            if tag == "p" and stack and stack[-1].element[0] == "p":
                close(("p",))
            elif tag in IMPLIED:
                close(*IMPLIED[tag])
            stack.append(Path(_element(tag, m[3] or m[6] or ""), stack[-1] if stack else None))
            opened[tag] += 1
    end()
    return out


def _key(path: Path | tuple) -> tuple[frozenset[int], str]:
    """What the labeller reads of a path: all its names, and the innermost tag."""
    return (path.buckets, path.element[0]) if isinstance(path, Path) else (frozenset(), "")


def _path_buckets(path: Path | tuple) -> np.ndarray:
    buckets, leaf = _key(path)
    return np.array(sorted(buckets | {zlib.crc32(f"leaf:{leaf}".encode()) % PATH_BUCKETS}), dtype=np.int64)


_word_bucket: dict[str, int] = {}


def _word_counts(text: str) -> np.ndarray:
    memo = _word_bucket
    if len(memo) > 200_000:
        memo.clear()
    words = _WORD.findall(text)
    for w in set(words).difference(memo):
        memo[w] = zlib.crc32(w.lower().encode()) % (WORD_BUCKETS - 2)
    counts = np.bincount(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)), minlength=WORD_BUCKETS).astype(np.float32)
    n = max(1, len(words))
    counts = np.sqrt(counts / n)
    counts[-2], counts[-1] = np.log1p(n) / 5, 1.0
    return counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over blocks; p(main text) for each. Parameters are in ``self.p``, by name."""

    def __init__(self, p: dict[str, np.ndarray] | None = None):
        rng, h = np.random.default_rng(SEED), HIDDEN
        self.p = p or {
            **{f"x{d}": (rng.standard_normal((PATH_BUCKETS + WORD_BUCKETS, 4 * h)) * 0.1).astype(np.float32) for d in "fb"},
            **{f"u{d}": (rng.standard_normal((h, 4 * h)) / np.sqrt(h)).astype(np.float32) for d in "fb"},
            **{f"b{d}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32) for d in "fb"},
            "o": (rng.standard_normal((2 * h, 1)) * 0.1).astype(np.float32), "c": np.zeros(1, np.float32),
        }
        self._paths: dict[tuple, np.ndarray] = {}

    def inputs(self, page: list[tuple[tuple, str]]) -> np.ndarray:
        """Projected inputs of both directions, a row for each block."""
        if len(self._paths) > 10_000:
            self._paths.clear()
        weights = np.concatenate([self.p["xf"], self.p["xb"]], axis=1) if not hasattr(self, "_w") else self._w
        self._w = weights
        rows = []
        for path, _ in page:
            key = _key(path)
            if key not in self._paths:
                self._paths[key] = weights[_path_buckets(path)].sum(axis=0)
            rows.append(self._paths[key])
        return np.stack(rows) + np.stack([_word_counts(t) for _, t in page]) @ weights[PATH_BUCKETS:]

    def run(self, z: np.ndarray, d: str, keep: list | None = None, carry: list | None = None) -> np.ndarray:
        """Hidden states (time, batch, hidden) for projected inputs (time, batch, 4 hidden). carry: state and cell to begin with, if any, and then those at the end."""
        h, u = HIDDEN, self.p["u" + d]
        state = cell = np.zeros((z.shape[1], h), np.float32)
        if carry:
            state, cell = carry
        out = np.empty((*z.shape[:2], h), np.float32)
        z = z + self.p["b" + d]
        for t in range(len(z)):
            a = z[t] + state @ u
            gates = _sigmoid(a[:, : 3 * h])
            g = np.tanh(a[:, 3 * h :])
            before, old = cell, state
            cell = gates[:, h : 2 * h] * cell + gates[:, :h] * g
            th = np.tanh(cell)
            state = gates[:, 2 * h :] * th
            out[t] = state
            if keep is not None:
                keep.append((gates, g, before, th, old))
        if carry is not None:
            carry[:] = state, cell
        return out

    def _in_pieces(self, pages: list[list], sizes: np.ndarray) -> np.ndarray:
        """p(main text) (time, page) for pages whose inputs are too many to be held: each direction goes through them piece by piece, and only what it adds to
        a block's score is kept."""
        score = np.full((sizes.max(), len(pages)), self.p["c"][0], np.float32)
        step, h = max(1, CELLS // len(pages)), HIDDEN
        for d, half, share in (("f", slice(0, 4 * h), self.p["o"][:h]), ("b", slice(4 * h, 8 * h), self.p["o"][h:])):
            carry: list = []
            for at in range(0, len(score), step):
                z = np.zeros((min(step, len(score) - at), len(pages), 4 * h), np.float32)
                spans = [(at, min(at + step, n)) if d == "f" else (max(0, n - at - step), n - at) for n in sizes]
                for k, (a, b) in enumerate(spans):
                    if a < b:
                        z[: b - a, k] = self.inputs(pages[k][a:b])[:: 1 if d == "f" else -1, half]
                out = (self.run(z, d, carry=carry) @ share)[:, :, 0]
                for k, (a, b) in enumerate(spans):
                    if a < b:
                        score[a:b, k] += out[: b - a, k][:: 1 if d == "f" else -1]
        return _sigmoid(score)

    def _reversed(self, z: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each sequence back to front, in place of itself."""
        out = z.copy()
        for i, n in enumerate(sizes):
            out[:n, i] = z[:n, i][::-1]
        return out

    def label(self, pages: list[list[tuple[tuple, str]]]) -> list[np.ndarray]:
        """p(main text) of the blocks of each page."""
        full = [i for i, p in enumerate(pages) if p]
        out = [np.zeros(0, np.float32)] * len(pages)
        # pages of about one length go together, so padding and memory stay small
        full.sort(key=lambda i: len(pages[i]))
        at = 0
        while at < len(full):
            end = at + 1
            while end < len(full) and end - at < PAGES and len(pages[full[end]]) <= 2 * len(pages[full[at]]) + 8:
                end += 1
            some = full[at:end]
            sizes = np.array([len(pages[i]) for i in some])
            if sizes.max() * len(some) > CELLS:
                p = self._in_pieces([pages[i] for i in some], sizes)
            else:
                z = np.zeros((sizes.max(), len(some), 8 * HIDDEN), np.float32)
                for k, i in enumerate(some):
                    z[: sizes[k], k] = self.inputs(pages[i])
                f = self.run(z[:, :, : 4 * HIDDEN], "f")
                b = self._reversed(self.run(self._reversed(z[:, :, 4 * HIDDEN :], sizes), "b"), sizes)
                p = _sigmoid(np.concatenate([f, b], axis=2) @ self.p["o"] + self.p["c"])[:, :, 0]
            for k, i in enumerate(some):
                out[i] = p[: sizes[k], k]
            at = end
        return out

    def _backward(self, x: np.ndarray, d: str, keep: list, dout: np.ndarray, grads: dict) -> None:
        h, u = HIDDEN, self.p["u" + d]
        dstate = dcell = np.zeros((x.shape[1], h), np.float32)
        da_all = np.empty((*x.shape[:2], 4 * h), np.float32)
        du = np.zeros_like(u)
        for t in range(len(x) - 1, -1, -1):
            gates, g, before, th, old = keep[t]
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            ds = dout[t] + dstate
            dc = ds * o * (1 - th * th) + dcell
            da = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), ds * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            da_all[t] = da
            du += old.T @ da
            dstate, dcell = da @ u.T, dc * f
        flat = da_all.reshape(-1, 4 * h)
        grads["u" + d], grads["b" + d] = du, flat.sum(axis=0)
        grads["x" + d] = x.reshape(-1, x.shape[2]).T @ flat

    def learn(self, lessons: list[tuple[list[tuple[tuple, str]], np.ndarray]], steps: int = STEPS) -> None:
        rng = np.random.default_rng(SEED + 1)
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        rows = []
        for page, y in lessons:
            x = np.zeros((len(page), PATH_BUCKETS + WORD_BUCKETS), np.float32)
            for t, (path, text) in enumerate(page):
                x[t, _path_buckets(path)] = 1
                x[t, PATH_BUCKETS:] = _word_counts(text)
            rows.append((x, y))
        for step in range(1, steps + 1):
            some = [rows[i] for i in rng.choice(len(rows), BATCH, replace=False)]
            sizes = np.array([len(y) for _, y in some])
            x = np.zeros((sizes.max(), BATCH, PATH_BUCKETS + WORD_BUCKETS), np.float32)
            y, mask = np.zeros((2, sizes.max(), BATCH), np.float32)
            for k, (a, b) in enumerate(some):
                # path names are left out now and then, so that no one of them decides alone
                hidden = (rng.random((1, PATH_BUCKETS)) > 0.05).astype(np.float32)
                x[: sizes[k], k] = a
                x[: sizes[k], k, :PATH_BUCKETS] *= hidden
                y[: sizes[k], k], mask[: sizes[k], k] = b, 1
            xr = self._reversed(x, sizes)
            kf, kb, grads = [], [], {}
            f = self.run(x @ self.p["xf"], "f", kf)
            b = self._reversed(self.run(xr @ self.p["xb"], "b", kb), sizes)
            both = np.concatenate([f, b], axis=2)
            p = _sigmoid(both @ self.p["o"] + self.p["c"])[:, :, 0]
            e = ((p - y) * mask / mask.sum())[:, :, None].astype(np.float32)
            grads["o"] = both.reshape(-1, 2 * HIDDEN).T @ e.reshape(-1, 1)
            grads["c"] = e.sum(axis=(0, 1))
            back = e @ self.p["o"].T
            self._backward(x, "f", kf, back[:, :, :HIDDEN], grads)
            self._backward(xr, "b", kb, self._reversed(back[:, :, HIDDEN:], sizes), grads)
            for k, g in grads.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                self.p[k] -= (0.015 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        self._paths.clear()
        if hasattr(self, "_w"):
            del self._w


#: How templates name what holds the main text, and what doesn't.
MAIN = ["<article>", "<main>", '<div class="article">', '<div class="post-content">', '<div id="content">', '<section class="entry">', '<div class="story body">', '<article class="post">', '<main id="main"><article>', '<div role="main">']
OTHER = ["<nav>", "<header>", "<footer>", "<aside>", '<div class="ad">', '<div class="ads banner">', '<div class="advert">', '<div id="sidebar">', '<ul class="menu">', '<div class="cookie-notice">', '<div class="notice">', '<div class="related">', '<div class="share social">', "<form>", '<div id="footer">', '<div class="header">', '<div class="breadcrumb nav">', '<div class="newsletter promo">', '<div class="navigation">', '<div class="popup">']
#: Cells of table layouts, beside the main text and around it.
SIDE_CELLS = ['<td class="leftnav">', '<td width="150">', '<td class="side">', '<td id="left">', '<td class="links">', "<td>"]
MAIN_CELLS = ['<td class="content">', '<td id="main">', '<td valign="top">', '<td class="text">', "<td>"]
REMARKS = ['<div class="comments">', '<section id="comments">', '<ol class="comment-list">', '<div class="comment">']


def lesson(rng: np.random.Generator) -> tuple[list[tuple[tuple, str]], np.ndarray]:
    """Blocks of an invented page and their labels."""
    syllables = ["an", "the", "ver", "ión", "eau", "ing", "st", "lo", "ca", "ri", "de", "ung", "ou", "nt"]

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(rng.integers(low, high + 1)))

    def shut(opening: str) -> str:
        return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))

    def other(kind: str) -> str:
        style = rng.integers(0, 4)
        if style == 0 or kind.startswith(("<nav", "<ul")):
            inner = "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(rng.integers(2, 8)))
            inner = inner if kind.startswith("<ul") else f"<ul>{inner}</ul>"
        elif style == 1:
            inner = "".join(f"<p>{words(2, 30)}</p>" for _ in range(rng.integers(1, 4)))
        elif style == 2:
            inner = words(2, 25)
        else:
            inner = f"<h3>{words(1, 4)}</h3><div>{words(3, 20)}</div>"
        return f'<div data-no="1">{kind}{inner}{shut(kind)}</div>' if rng.random() < 0.2 else f"{kind}{inner}{shut(kind)}"

    def pick(kinds: list[str]) -> str:
        return kinds[rng.integers(0, len(kinds))]

    mark = "\x01"  # before each text that is main
    body = f"<h1>{mark}{words(2, 9)}</h1>" if rng.random() < 0.8 else ""
    for _ in range(rng.integers(1, 14)):
        kind = rng.random()
        if kind < 0.7:
            body += f"<p>{'<b>' if rng.random() < 0.15 else ''}{mark}{words(1, 70)}" + ("</p>" if rng.random() < 0.85 else "<br>")
        elif kind < 0.78:
            body += f"<h2>{mark}{words(1, 6)}</h2>"
        elif kind < 0.86:
            body += "<ul>" + "".join(f"<li>{mark}{words(1, 12)}</li>" for _ in range(rng.integers(1, 5))) + "</ul>"
        elif kind < 0.92:
            body += f"<blockquote>{mark}{words(3, 40)}</blockquote>"
        elif kind < 0.96:
            body += f"<table><tr><td>{mark}{words(1, 4)}</td><td>{mark}{words(1, 4)}</td></tr></table>"
        elif rng.random() < 0.6:
            body += other(pick(OTHER))
    if rng.random() < 0.15:
        body += other(pick(REMARKS))
    if rng.random() < 0.12:  # a table layout: links in a cell beside the main text, without markup that says so
        link = lambda: f'<a href="/x">{words(1, 3)}</a>'
        between = ["<br>", " | ", "<p>", "</div><div>"][rng.integers(0, 4)]
        links = between.join(link() for _ in range(rng.integers(2, 9)))
        cells = [f"{pick(SIDE_CELLS)}<div>{links}</div></td>", f"{pick(MAIN_CELLS)}{body}</td>"]
        head = f"<tr><td colspan=2>{link()} {link()} {link()}</td></tr>" if rng.random() < 0.3 else ""
        foot = f"<tr><td colspan=2>&copy; {words(2, 8)}</td></tr>" if rng.random() < 0.5 else ""
        body = f"<table>{head}<tr>{''.join(cells if rng.random() < 0.8 else cells[::-1])}</tr>{foot}</table>"
        return _labelled(f"<html><head><title>{words(2, 8)}</title></head><body>{body}</body></html>", mark)
    holder = pick(MAIN) if rng.random() < 0.6 else "<article>"
    parts = [other(pick(OTHER)) for _ in range(rng.integers(0, 5))]
    if rng.random() < 0.6:
        parts.append(other("<nav>"))
    parts.append(f"{holder}{body}{shut(holder)}")
    parts += [other(pick(OTHER)) for _ in range(rng.integers(0, 4))]
    if rng.random() < 0.6:
        parts.append(f"<footer>&copy; {words(2, 12)}</footer>")
    if rng.random() < 0.25:
        parts.append(other(pick(REMARKS)))
    inner = "".join(parts)
    inner = f'<div id="page" class="wrapper">{inner}</div>' if rng.random() < 0.4 else inner
    page = f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>{inner}</body></html>"
    return _labelled(page, mark)


def _labelled(page: str, mark: str) -> tuple[list[tuple[tuple, str]], np.ndarray]:
    """Blocks of a page without the mark, and which had it."""
    found = blocks(page)
    return [(p, t.replace(mark, "").strip()) for p, t in found], np.array([mark in t for _, t in found], np.float32)


@lru_cache(maxsize=1)
def trained() -> Labeller:
    rng = np.random.default_rng(SEED + 2)
    model = Labeller()
    model.learn([lesson(rng) for _ in range(LESSONS)])
    return model


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (its main text; empty if there is none) and n_chars (code points).

    Null html is empty; a null page_id or url stays null; repeated rows are each extracted; an empty table gives
    no rows; other columns are ignored. A very long page is read whole, its blocks labelled as one sequence, piece by piece.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained().p)  # about 0.8 MB

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * PAGES):
                some = batch.slice(at, 4 * PAGES)
                found = [blocks(h) if h else [] for h in some.column(2).to_pylist()]
                texts = [" ".join(t for (_, t), main in zip(page, p >= 0.5, strict=True) if main) for page, p in zip(found, model.label(found), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])
        _word_bucket.clear()  # the worker lives on

    return dealt(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html"))).mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
