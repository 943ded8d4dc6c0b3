"""Main text of web pages, by a recurrent labeller of blocks.

A page is cut into its leaf sequence: runs of text between block-level tags, each with the
path of tags (and words of class and id) above it. A bidirectional LSTM in numpy reads the
sequence, path and words hashed into vectors, and decides for every block, from what
stands before and after it on the whole page, whether it is article text.

The network is fitted where the query runs, on at most ``SAMPLE_PAGES`` pages that mark
their article, each rebuilt into several layouts in which that mark, class names and order
vary and menus, notices, forms, adverts, sidebars and reader comments are put around it.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import table

SAMPLE_PAGES, SAMPLE_CHARS, LAYOUTS = 160, 20_000, 5
PATH_BINS, WORD_BINS, SHAPE = 128, 32, 8
HIDDEN, EPOCHS, BATCH, RATE = 24, 10, 32, 6e-3
#: Training takes more epochs where few pages make few batches.
LEAST_STEPS = 250

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = "script|style|noscript|template|title|svg|iframe"
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                 "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol p pre section table ul".split())
_TAG = re.compile(
    # an svg that ends itself hides nothing
    r"<!--.*?(?:-->|\Z)|<svg\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*/>"
    rf"|<({_HIDDEN})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",  # with a quote that never ends
    re.S | re.I)
_SEEMS_MARKED = (r"(?i)<(?:article|main)\b|(?:class|id|role)\s*=\s*[\"']?[^\"'>]*\b"
                 r"(?:article|content|main|entry|story)\b")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters inside links) of every block that has text."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    found, parts, linked, links, above, blank = [], [], 0, 0, (), True

    def close():
        nonlocal parts, linked, blank
        text = " ".join("".join(parts).split())
        if text:
            found.append((above, text, linked))
        parts, linked, blank = [], 0, True

    def say(raw: str):
        nonlocal linked, above, blank
        text = html.unescape(raw)
        if blank:
            above = tuple(part for tag, names in stack for part in (tag, *names))
            blank = not text.strip()
        parts.append(text)
        linked += len(text) if links else 0

    at = 0
    for tag in _TAG.finditer(page):
        if tag.start() > at:
            say(page[at:tag.start()])
        at = tag.end()
        closing, name, inside = tag.group(2, 3, 4) if tag.group(3) else tag.group(5, 6, 7)
        name = (name or "").lower()
        if not name:
            continue
        if name == "br":
            say(" ")
            continue
        if name not in _INLINE:
            close()
        if closing:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == name:
                    links -= sum(open_tag == "a" for open_tag, _ in stack[n:])
                    del stack[n:]
                    break
            continue
        if name in _VOID:
            continue
        ended = _SELF_CLOSING.get(name, set()) | ({"p"} if name in _CLOSES_P else set())
        for n in range(len(stack) - 1, -1, -1):
            if stack[n][0] in ended:
                links -= sum(open_tag == "a" for open_tag, _ in stack[n:])
                del stack[n:]
                break
            if stack[n][0] not in _INLINE:
                break
        names = tuple("." + part for values in _NAMED.findall(inside or "")
                      for part in re.split(r"[^a-z0-9]+", "".join(values).lower()) if part)
        stack.append((name, names))
        links += name == "a"
    if at < len(page):
        say(page[at:])
    close()
    return found


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    if path not in _PATHS:
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        vector = np.zeros(PATH_BINS, np.float32)
        for part in path:
            if part not in ("html", "body"):
                vector[zlib.crc32(part.encode()) % PATH_BINS] = 1
        _PATHS[path] = vector
    return _PATHS[path]


def features(pages: list[list[tuple]]) -> np.ndarray:
    """A row per block of all pages."""
    flat = [block for page in pages for block in page]
    out = np.zeros((len(flat), PATH_BINS + WORD_BINS + SHAPE), np.float32)
    if not flat:
        return out
    raw = [text.encode() for _, text, _ in flat]
    limits = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, first = words.split(data, limits)
    hashes = words.hash_words(data, starts, ends, words.BYTES_LOWER)
    count = np.diff(first)
    cell = (np.repeat(np.arange(len(flat)), count) * WORD_BINS
            + (hashes % np.uint64(WORD_BINS)).astype(np.int64))
    bag = np.bincount(cell, minlength=len(flat) * WORD_BINS).reshape(len(flat), WORD_BINS)
    out[:, :PATH_BINS] = np.stack([_path_vector(path) for path, _, _ in flat])
    out[:, PATH_BINS:-SHAPE] = bag / np.maximum(count, 1)[:, None]
    length = np.array([len(text) for _, text, _ in flat])
    place = np.concatenate([np.arange(len(page)) for page in pages])
    size = np.concatenate([np.full(len(page), len(page)) for page in pages])
    shape = out[:, -SHAPE:]
    shape[:, 0], shape[:, 1] = np.log1p(length) / 6, np.log1p(count) / 5
    shape[:, 2] = np.array([linked for _, _, linked in flat]) / np.maximum(length, 1)
    shape[:, 3] = [text[-1] in ".!?" for _, text, _ in flat]
    shape[:, 4], shape[:, 5] = place / size, 1 - (place + 1) / size
    shape[:, 6] = [any(name in path for name in ("h1", "h2", "h3")) for path, _, _ in flat]
    shape[:, 7] = np.array([len(path) for path, _, _ in flat]) / 10
    return out


class Labeller:
    """A bidirectional LSTM with one output per block."""

    def __init__(self, seed: int = 5) -> None:
        draw = np.random.default_rng(seed)
        inputs = PATH_BINS + WORD_BINS + SHAPE
        self.weights = {"out": draw.normal(0, 0.2, 2 * HIDDEN).astype(np.float32),
                        "bias": np.zeros(1, np.float32)}
        for way in "fb":
            gate = np.zeros(4 * HIDDEN, np.float32)
            gate[HIDDEN:2 * HIDDEN] = 1
            self.weights |= {
                f"x{way}": draw.normal(0, inputs ** -0.5, (inputs, 4 * HIDDEN)).astype(np.float32),
                f"h{way}": draw.normal(0, HIDDEN ** -0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32),
                f"g{way}": gate}

    @staticmethod
    def _sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, way: str, sent: np.ndarray, steps: np.ndarray, keep: list | None):
        """States for each (step, page); ``sent`` is padded, pages are sorted longest first."""
        hidden = np.zeros((*sent.shape[:2], HIDDEN), np.float32)
        state, cell = (np.zeros((sent.shape[1], HIDDEN), np.float32) for _ in range(2))
        recurrent = self.weights[f"h{way}"]
        for t in range(len(sent)):
            live = int(steps[t])
            gates = sent[t, :live] + state[:live] @ recurrent
            i, f, o = (self._sigmoid(gates[:, n * HIDDEN:(n + 1) * HIDDEN]) for n in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN:])
            before = cell[:live].copy()
            cell[:live] = f * before + i * g
            squashed = np.tanh(cell[:live])
            if keep is not None:
                keep.append((live, i, f, o, g, before, squashed, state[:live].copy()))
            state[:live] = o * squashed
            hidden[t, :live] = state[:live]
        return hidden

    def _forward(self, rows: np.ndarray, lengths: np.ndarray, keep: dict | None = None):
        """Scores of the blocks in ``rows``, pages one after the other, longest first."""
        limits = np.concatenate([[0], np.cumsum(lengths)])
        most, pages = int(lengths.max()), len(lengths)
        page = np.repeat(np.arange(pages), lengths)
        ahead = np.arange(len(rows)) - limits[page]
        steps = (lengths[None, :] > np.arange(most)[:, None]).sum(axis=1)
        states = []
        for way, place in (("f", ahead), ("b", lengths[page] - 1 - ahead)):
            sent = np.zeros((most, pages, 4 * HIDDEN), np.float32)
            sent[place, page] = rows @ self.weights[f"x{way}"] + self.weights[f"g{way}"]
            trail = [] if keep is not None else None
            states.append(self._run(way, sent, steps, trail)[place, page])
            if keep is not None:
                keep[way] = (trail, place, page, most, pages)
        both = np.concatenate(states, axis=1)
        if keep is not None:
            keep["both"] = both
        return both @ self.weights["out"] + self.weights["bias"][0]

    def probabilities(self, rows: np.ndarray, lengths: np.ndarray, padded: int = 60_000) -> np.ndarray:
        """Article probability of every block; pages of like length run together."""
        out = np.zeros(len(rows), np.float32)
        limits = np.concatenate([[0], np.cumsum(lengths)])
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        at = 0
        while at < len(order):
            some = order[at:at + max(1, padded // int(lengths[order[at]]))]
            where = np.concatenate([np.arange(limits[p], limits[p + 1]) for p in some])
            out[where] = self._sigmoid(self._forward(rows[where], lengths[some]))
            at += len(some)
        return out

    def gradients(self, rows, lengths, labels) -> tuple[float, dict[str, np.ndarray]]:
        keep: dict = {}
        chance = self._sigmoid(self._forward(rows, lengths, keep))
        loss = -np.mean(np.where(labels, np.log(chance + 1e-9), np.log(1 - chance + 1e-9)))
        error = ((chance - labels) / len(rows)).astype(np.float32)
        found = {"out": keep["both"].T @ error, "bias": np.array([error.sum()], np.float32)}
        back = error[:, None] * self.weights["out"][None, :]
        for n, way in enumerate("fb"):
            trail, place, page, most, pages = keep[way]
            from_above = np.zeros((most, pages, HIDDEN), np.float32)
            from_above[place, page] = back[:, n * HIDDEN:(n + 1) * HIDDEN]
            to_gates = np.zeros((most, pages, 4 * HIDDEN), np.float32)
            recurrent = self.weights[f"h{way}"]
            d_state, d_cell = (np.zeros((pages, HIDDEN), np.float32) for _ in range(2))
            d_recurrent = np.zeros_like(recurrent)
            for t in range(most - 1, -1, -1):
                live, i, f, o, g, before, squashed, state = trail[t]
                d_hidden = from_above[t, :live] + d_state[:live]
                d_c = d_cell[:live] + d_hidden * o * (1 - squashed ** 2)
                d_gate = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f),
                                         d_hidden * squashed * o * (1 - o), d_c * i * (1 - g ** 2)], axis=1)
                to_gates[t, :live] = d_gate
                d_recurrent += state.T @ d_gate
                d_state[:live] = d_gate @ recurrent.T
                d_cell[:live] = d_c * f
            d_sent = to_gates[place, page]
            found |= {f"x{way}": rows.T @ d_sent, f"h{way}": d_recurrent, f"g{way}": d_sent.sum(axis=0)}
        return float(loss), found

    def fit(self, pages: list[tuple[list[tuple], list[bool]]], epochs: int = EPOCHS) -> list[float]:
        """Train with Adam; returns the mean loss of each epoch."""
        draw = np.random.default_rng(9)
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        losses, step = [], 0
        pages = [page for page in pages if page[0]]
        made = [(features([found]), np.array(marks, np.float32)) for found, marks in pages]
        for _ in range(epochs):
            order, total = draw.permutation(len(made)), []
            for at in range(0, len(order), BATCH):
                some = sorted((made[n] for n in order[at:at + BATCH]), key=lambda x: -len(x[1]))
                rows = np.concatenate([x for x, _ in some])
                # some paths are hidden, so that what stands around a block counts as well
                rows = rows * np.where(np.arange(rows.shape[1]) < PATH_BINS,
                                       draw.random((len(rows), 1)) > 0.1, True)
                loss, found = self.gradients(rows.astype(np.float32), np.array([len(y) for _, y in some]),
                                             np.concatenate([y for _, y in some]))
                total.append(loss)
                step += 1
                for name, gradient in found.items():
                    gradient = np.clip(gradient, -1, 1)
                    first[name] += 0.1 * (gradient - first[name])
                    second[name] += 0.01 * (gradient ** 2 - second[name])
                    self.weights[name] -= (RATE * (first[name] / (1 - 0.9 ** step))
                                           / (np.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-8)
                                           ).astype(np.float32)
            losses.append(float(np.mean(total)))
        return losses


_ARTICLE = ("article", "main", ".article", ".content", ".main", ".entry", ".story")
_ASIDE = {
    "menu": (("nav",), ("div", ".menu"), ("ul", ".navigation"), ("div", ".breadcrumbs")),
    "header": (("header",), ("div", ".header"), ("div", ".masthead"), ("div", ".banner")),
    "footer": (("footer",), ("div", ".footer"), ("div", ".copyright"), ("div", ".bottom")),
    "sidebar": (("aside",), ("div", ".sidebar"), ("div", ".related"), ("div", ".widget")),
    "notice": (("div", ".notice"), ("div", ".cookie"), ("div", ".consent"), ("section", ".alert")),
    "advert": (("div", ".ad"), ("div", ".advert"), ("div", ".sponsored"), ("div", ".promo"),
               ("ins", ".ads")),
    "form": (("form",), ("div", ".newsletter"), ("form", ".search"), ("div", ".subscribe")),
    "comments": (("section", ".comments"), ("div", ".comment"), ("ol", ".comments"), ("div", ".replies")),
}
_BODY = (("article",), ("main",), ("div", ".article"), ("div", ".content"), ("main", "article"),
         ("div", ".entry"), ("div", ".story"), ("section", ".main"), ("div",))


def marked(page: list[tuple]) -> list[bool]:
    """Blocks that a page itself marks as its article."""
    inner = {part for kind in _ASIDE.values() for path in kind for part in path} - {"div", "section", "ul", "ol"}
    return [any(part in _ARTICLE for part in path) and not any(part in inner for part in path)
            for path, _, _ in page]


def layouts(page: list[tuple], draw: np.random.Generator, count: int) -> list[tuple[list, list]]:
    """The page itself and rebuilt forms of it, with a mark for every block."""
    marks = marked(page)
    own = [block for block, mark in zip(page, marks) if mark]
    other = [text for (_, text, _), mark in zip(page, marks) if not mark]
    if not own:
        return []
    pool = other + [" ".join(text.split()[:12]) for _, text, _ in own]

    def around(kind: str, prefix: tuple) -> list[tuple[list, bool]]:
        path = prefix + _ASIDE[kind][draw.integers(len(_ASIDE[kind]))]
        rows = []
        for _ in range(1 if kind == "advert" else draw.integers(1, 5)):
            text = pool[draw.integers(len(pool))]
            if kind in ("menu", "sidebar"):
                text, tail, link = " ".join(text.split()[:3]), ("ul", "li"), True
            elif kind == "comments":
                text, tail, link = own[draw.integers(len(own))][1], ("p",), False
            else:
                tail, link = (("p",), ())[draw.integers(2)], False
            rows.append(((path + tail, text, len(text) if link else 0), False))
        return rows

    out = [(page, marks)]
    for _ in range(count - 1):
        root = _BODY[draw.integers(len(_BODY))]
        before = [row for kind in ("header", "menu", "notice", "advert", "sidebar") if draw.random() < 0.6
                  for row in around(kind, ())]
        after = [row for kind in ("sidebar", "form", "comments", "advert", "footer") if draw.random() < 0.6
                 for row in around(kind, root if kind in ("form", "comments") and draw.random() < 0.5 else ())]
        body = []
        for path, text, linked in own:
            tail = path[-1:] if path[-1:] and path[-1] in ("p", "h1", "h2", "h3", "li", "td", "blockquote") else ("p",)
            body.append(((root + tail, text, linked), True))
            if draw.random() < 0.05:
                body += around(("advert", "form", "notice")[draw.integers(3)], root)
        rows = before + body + after
        out.append(([block for block, _ in rows], [mark for _, mark in rows]))
    return out


def train(sample: list[str]) -> Labeller | None:
    """A labeller from the pages that mark their article; None where none does."""
    draw = np.random.default_rng(3)
    made = [layout for page in sample for layout in layouts(blocks(page), draw, LAYOUTS)]
    if not made:
        return None
    model = Labeller()
    model.fit(made, max(EPOCHS, -(-LEAST_STEPS // -(-len(made) // BATCH))))
    return model


def outside_asides(page: list[tuple]) -> list[bool]:
    """The rule where no page could teach a labeller: blocks that stand in no menu, header, footer
    or the like, and of which less than half is links."""
    asides = {part for kind in _ASIDE.values() for path in kind for part in path} - {"div", "section", "ul", "ol"}
    return [2 * linked < len(text) and not any(part in asides for part in path) for path, text, linked in page]


def main_texts(model: Labeller | None, pages: list[str | None]) -> list[str]:
    found = [blocks(page or "") for page in pages]
    if model is None:
        kept = [mark for page in found for mark in outside_asides(page)]
    else:
        kept = model.probabilities(features(found), np.array([len(x) for x in found], np.int64)) > 0.5
    out, at = [], 0
    for page in found:
        out.append(" ".join(text for (_, text, _), keep in zip(page, kept[at:at + len(page)]) if keep))
        at += len(page)
    return out


def _extract(model: Labeller | None):
    def run(batches):
        for batch, _, _ in words.chunks(batches, "html"):
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            yield pa.RecordBatch.from_arrays(
                [column["page_id"], column["url"],
                 pa.array(main_texts(model, column["html"].to_pylist()), pa.string())],
                ["page_id", "url", "text"])
    return run


def sample_pages(rows: DataFrame) -> list[str]:
    """At most ``SAMPLE_PAGES`` different pages, those that seem to mark an article first.

    Drawn by the hash of the html, so copies of a page count once, however many there are.
    """
    short = rows.where(F.length("html") <= SAMPLE_CHARS).select(
        F.xxhash64("html", F.lit("draw")).alias("key"), F.col("html").rlike(_SEEMS_MARKED).alias("marks"), "html")
    drawn = short.select("key", "marks").distinct().orderBy(F.desc("marks"), "key").limit(SAMPLE_PAGES)
    found = (short.join(F.broadcast(drawn.select("key")), "key")
             .groupBy("key").agg(F.min("html").alias("html")).orderBy("key"))
    return [row.html for row in found.collect()]


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
            html_column: str = "html", model: Labeller | None = None) -> DataFrame:
    """One row per page: page_id, url, text (empty if there is none), n_chars.

    Blocks judged to be article text are joined by one space, in page order; nothing of them
    is cut. NULL pages have an empty text; ids and urls are carried as they are, repeated rows
    are judged one by one, other columns are ignored. Without a model one is trained on pages
    of this table; where none of them marks its article there is none, and ``outside_asides``
    decides. An empty table gives no rows.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"),
                        F.col(html_column).cast("string").alias("html"))
    if model is None:
        model = train(sample_pages(rows))
    return rows.mapInArrow(_extract(model), "page_id long, url string, text string").select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_html_extraction(spark, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))
