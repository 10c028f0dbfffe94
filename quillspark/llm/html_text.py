"""HTML extraction: a bidirectional LSTM in numpy labels a page's leaf blocks as main text or not.

A page is a sequence of blocks, runs of text between block-level tags. The
network reads each block's tag path and its words, both hashed to vectors,
and some shape figures, and labels every block in the light of all blocks
before and behind it. It is trained here, on pages that a generator lays out.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_hash import word_hashes

#: Fixed values of HTML: elements whose text is no text, elements without an end tag, elements inside a line.
SKIPPED = frozenset("script style template noscript svg head title iframe textarea select option".split())
#: Skipped elements that part the text around them.
PARTING = frozenset("head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow ms msqrt msub msup mtext q s samp small span strike strong sub sup time tt u var wbr br img input button".split())
#: Open elements that a start tag ends.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that an unclosed element inside does not outlive.
SCOPES = frozenset("article aside section nav header footer main div body td th table form ul ol figure blockquote details".split())

#: By the rules of HTML: comments, with their short and faulty forms; declarations; faulty end tags; tags, in which a quote opens a value
#: only behind the equals sign of a named attribute. A cut tag costs no more than its length.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|$))|<[!?][^>]*(?:>|$)|</(?:[^a-zA-Z>][^>]*)?(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$)|[^\s>\"'][^\s>]*+)?+)?+)*+)(?:>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"[\s\x00]+")
WORD = re.compile(r"\w+")
#: Dimensions of the hashed path, words and shape; units each way.
PATH, TEXT, SHAPE, UNITS = 64, 16, 12, 16
DIM = PATH + TEXT + SHAPE
#: The logit over which a block is main text; below 0, as a lost paragraph is worse than a stray line.
LEAST = -1.5
#: Blocks of a page that are read at once; longer pages go by windows of so many.
WINDOW = 4096


class Place:
    """An open block-level element and those that it is in; a page's blocks share them."""

    __slots__ = ("above", "entry", "of", "size")

    def __init__(self, entry: str, above: Place | None):
        self.entry, self.above, self.of, self.size = entry, above, None, 0


class Block:
    __slots__ = ("linked", "place", "raw", "text")

    def __init__(self, place: Place | None):
        self.place, self.raw, self.linked, self.text = place, [], 0, ""


class _Open:
    """The open elements. What a tag closes is found by where each name was last opened, not by a look through them all."""

    def __init__(self):
        self.stack: list[tuple[str, Place | None]] = []
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.links = 0

    def place(self) -> Place | None:
        return self.stack[-1][1] if self.stack else None

    def last(self, name: str) -> int:
        return self.at[name][-1] if self.at.get(name) else -1

    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else -1

    def push(self, name: str, entry: str) -> None:
        above = self.place()
        self.at.setdefault(name, []).append(len(self.stack))
        if name in SCOPES:
            self.scopes.append(len(self.stack))
        self.links += name == "a"
        self.stack.append((name, above if name in INLINE else Place(entry, above)))

    def cut(self, to: int) -> None:
        while len(self.stack) > to:
            name, _ = self.stack.pop()
            self.at[name].pop()
            if name in SCOPES:
                self.scopes.pop()
            self.links -= name == "a"


def blocks(page: str) -> list[Block]:
    """The page's runs of text between block-level tags, in order, decoded, with white space made single; in time that grows as the page."""
    out: list[Block] = []
    opened = _Open()
    unended: set[str] = set()
    current: Block | None = None
    at, size = 0, len(page)

    def say(piece: str) -> None:
        nonlocal current
        if not piece:
            return
        if current is None:
            if piece.isspace():
                return
            current = Block(opened.place())
            out.append(current)
        current.raw.append(piece)
        if opened.links:
            current.linked += len(piece)

    while at < size:
        found = TOKEN.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            to = opened.last(name)
            if to < 0 and name == "p":
                current = None
            if to >= 0 and (name in SCOPES or to > opened.scope()):
                if name not in INLINE:
                    current = None
                opened.cut(to)
            continue
        if name in SKIPPED:
            if name == "head":  # its elements that hold text are skipped one by one
                continue
            if found[3].endswith("/") or name in unended:
                continue
            end = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(page, at)
            if end is None and name in ("option", "select", "iframe", "svg", "template", "noscript"):
                unended.add(name)
                continue
            at = end.end() if end else size
            if name in PARTING:
                current = None
            continue
        if name in ("br", "wbr", "img", "input"):
            if current is not None and name == "br":
                current.raw.append(" ")
            continue
        if name in VOID:
            current = None
            continue
        if name not in INLINE:
            current = None
            to = max(map(opened.last, ENDS[name])) if name in ENDS else opened.last("p") if name in CLOSES_P else -1
            if to >= 0 and to >= opened.scope():
                opened.cut(to)
        if found[3].endswith("/") and name not in INLINE:
            continue
        marks = " ".join(f"{v or w or x}".lower() for _, v, w, x in ATTRIBUTE.findall(found[3])) if found[3] else ""
        opened.push(name, f"{name} {marks}" if marks else name)
    kept = []
    for b in out:
        b.text = SPACE.sub(" ", html.unescape("".join(b.raw))).strip()
        if b.text:
            kept.append(b)
    return kept


@functools.lru_cache(1 << 16)
def _slot(word: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "replace"))
    return h % size, 1.0 if h >> 31 else -1.0


@functools.lru_cache(1 << 14)
def _entry(entry: str) -> tuple[np.ndarray, np.ndarray, int]:
    """The hashed words of a path entry, as far and as near ones, and their number."""
    far, near, words = np.zeros(PATH, np.float32), np.zeros(PATH, np.float32), WORD.findall(entry)
    for w in words:
        for v, x in ((far, w), (near, f"{w}.near")):
            i, s = _slot(x, PATH)
            v[i] += s
    return far, near, len(words)


def _path_vector(place: Place | None) -> np.ndarray:
    """The words of all open elements, those of the last two once more as near ones."""
    new, p = [], place
    while p is not None and p.of is None:
        new.append(p)
        p = p.above
    for p in reversed(new):
        far, _, n = _entry(p.entry)
        p.of, p.size = (far, n) if p.above is None else (p.above.of + far, p.above.size + n)
    if place is None:
        return np.zeros(PATH, np.float32)
    v, size = place.of, place.size
    for p in (place, place.above):
        if p is not None:
            _, near, n = _entry(p.entry)
            v, size = v + near, size + n
    return v / max(1.0, float(np.sqrt(size)))


def vectors(page: list[Block], first: int = 0, of: int | None = None) -> np.ndarray:
    """A row for each block: its path, the mean of its words' hashed vectors, its shape; `first` and `of` place the blocks in their page."""
    of = len(page) if of is None else of
    out = np.zeros((len(page), DIM), np.float32)
    at, word = word_hashes([b.text.encode() for b in page])
    sign = np.where(word >> np.uint64(63), 1.0, -1.0)
    mean = np.bincount(at * TEXT + (word % np.uint64(TEXT)).astype(np.int64), weights=sign, minlength=len(page) * TEXT)
    out[:, PATH : PATH + TEXT] = mean.reshape(-1, TEXT) / np.maximum(4.0, np.bincount(at, minlength=len(page)))[:, None]
    for i, b in enumerate(page):
        out[i, :PATH] = _path_vector(b.place)
        n = len(b.text)
        leaf = b.place.entry.split(" ")[0] if b.place else ""
        raw = sum(map(len, b.raw)) or 1
        out[i, PATH + TEXT :] = (
            np.log1p(n) / 8, min(1.0, b.linked / raw), b.text.count(".") / (n / 40 + 1), float(b.text[-1] in ".!?:;"), n < 25, n > 200,
            leaf == "p", leaf[:1] == "h" and leaf[1:].isdigit(), leaf == "li", leaf in ("div", "span", "td"), (first + i) / max(1, of - 1), min(1.0, of / 100),
        )
    return out


# ------------------------------------------------------------------ network

def start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for d in "fb":
        w[f"x{d}"] = rng.normal(0, 0.15, (DIM, 4 * UNITS)).astype(np.float32)
        w[f"h{d}"] = rng.normal(0, 0.15, (UNITS, 4 * UNITS)).astype(np.float32)
        w[f"o{d}"] = np.concatenate([np.zeros(UNITS), np.ones(UNITS), np.zeros(2 * UNITS)]).astype(np.float32)
    w["v"] = rng.normal(0, 0.2, 2 * UNITS + DIM).astype(np.float32)
    w["c"] = np.zeros(1, np.float32)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _one_way(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, bias: np.ndarray, mask: np.ndarray, keep: bool, state: list | None = None):
    """Hidden states of a padded batch (batch, steps, DIM), in step order; with `keep` what training needs; `state` is where to go on from."""
    n, steps, _ = x.shape
    given = x @ wx + bias
    h, c = state or [np.zeros((n, UNITS), np.float32)] * 2
    out, tape = np.zeros((n, steps, UNITS), np.float32), []
    for t in range(steps):
        z = given[:, t] + h @ wh
        i, f, o = _sigmoid(z[:, :UNITS]), _sigmoid(z[:, UNITS : 2 * UNITS]), _sigmoid(z[:, 2 * UNITS : 3 * UNITS])
        g = np.tanh(z[:, 3 * UNITS :])
        m = mask[:, t, None]
        c_new = m * (f * c + i * g) + (1 - m) * c
        tc = np.tanh(c_new)
        h_new = m * (o * tc) + (1 - m) * h
        if keep:
            tape.append((h, c, i, f, o, g, tc, m))
        h, c = h_new, c_new
        out[:, t] = h
    if state is not None:
        state[:] = h, c
    return out, tape


def _flip(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sequence of a padded batch reversed in its own length."""
    at = np.arange(x.shape[1])[None, :]
    at = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return np.take_along_axis(x, at[..., None], 1) if x.ndim == 3 else np.take_along_axis(x, at, 1)


def scores(w: dict[str, np.ndarray], pages: list[np.ndarray], keep: bool = False):
    """A logit for each block of each page: positive for main text."""
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), max(1, lengths.max(initial=0)), DIM), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)] = p
    mask = (np.arange(x.shape[1])[None, :] < lengths[:, None]).astype(np.float32)
    xb = _flip(x, lengths)
    hf, tf = _one_way(x, w["xf"], w["hf"], w["of"], mask, keep)
    hb, tb = _one_way(xb, w["xb"], w["hb"], w["ob"], mask, keep)
    both = np.concatenate([hf, _flip(hb, lengths), x], 2)
    logit = both @ w["v"] + w["c"]
    return (logit, mask, (x, xb, both, tf, tb, lengths)) if keep else [logit[i, :n] for i, n in enumerate(lengths)]


def long_scores(w: dict[str, np.ndarray], page: list[Block], window: int = WINDOW) -> np.ndarray:
    """The logits of one page as scores() gives them, a window of blocks at a time: each way's state goes on from window to window."""
    logit = np.zeros(len(page), np.float32)
    starts = range(0, len(page), window)
    for way, order, cut in (("f", starts, slice(0, UNITS)), ("b", reversed(starts), slice(UNITS, 2 * UNITS))):
        state = [np.zeros((1, UNITS), np.float32)] * 2
        for a in order:
            x = vectors(page[a : a + window], a, len(page))[None]
            step = 1 if way == "f" else -1
            h, _ = _one_way(x[:, ::step], w["x" + way], w["h" + way], w["o" + way], np.ones(x.shape[:2], np.float32), False, state)
            logit[a : a + window] += h[0, ::step] @ w["v"][cut]
            if way == "f":
                logit[a : a + window] += x[0] @ w["v"][2 * UNITS :] + w["c"]
    return logit


def gradient(w: dict[str, np.ndarray], pages: list[np.ndarray], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    logit, mask, (x, xb, both, tf, tb, lengths) = scores(w, pages, keep=True)
    y = np.zeros_like(logit)
    for i, v in enumerate(labels):
        y[i, : len(v)] = v
    p = _sigmoid(logit)
    total = mask.sum()
    loss = float(-(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total)
    d = (mask * (p - y) / total).astype(np.float32)
    g = {"v": np.einsum("nt,ntk->k", d, both), "c": np.array([d.sum()], np.float32)}
    for way, tape, given, cut in (("f", tf, x, slice(0, UNITS)), ("b", tb, xb, slice(UNITS, 2 * UNITS))):
        dh_all = d[..., None] * w["v"][cut]
        if way == "b":
            dh_all = _flip(dh_all, lengths)
        dz_all = np.zeros((*d.shape, 4 * UNITS), np.float32)
        gh = np.zeros_like(w["h" + way])
        dh = dc = np.zeros((len(pages), UNITS), np.float32)
        for t in range(d.shape[1] - 1, -1, -1):
            h, c, i, f, o, gg, tc, m = tape[t]
            dh = dh + dh_all[:, t]
            on = dh * m
            dc_on = dc * m + on * o * (1 - tc * tc)
            dz = np.concatenate([dc_on * gg * i * (1 - i), dc_on * c * f * (1 - f), on * tc * o * (1 - o), dc_on * i * (1 - gg * gg)], 1)
            dz_all[:, t] = dz
            gh += h.T @ dz
            dh = dz @ w["h" + way].T + dh * (1 - m)
            dc = dc_on * f + dc * (1 - m)
        g["x" + way] = np.einsum("ntk,ntz->kz", given, dz_all)
        g["h" + way] = gh
        g["o" + way] = dz_all.sum((0, 1))
    return loss, g


def train(pages: list[np.ndarray], labels: list[np.ndarray], steps: int = 900, batch: int = 32, rate: float = 0.01, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights by Adam."""
    rng = np.random.default_rng(seed)
    w = start_weights(rng)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        at = rng.choice(len(pages), batch, replace=False)
        _, g = gradient(w, [pages[i] for i in at], [labels[i] for i in at])
        lr = rate * (1 - step / (steps + 1))
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.999 * s[k] + 0.001 * g[k] * g[k]
            w[k] = w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return w


WEIGHTS = Path(__file__).with_name("html_text.npz")


@functools.cache
def weights() -> dict[str, np.ndarray]:
    """The network that train_html_text.py made."""
    with np.load(WEIGHTS) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def extract_pages(pages: list[str], w: dict[str, np.ndarray]) -> list[str]:
    """The main text of each page; pages of like length share a batch."""
    laid = [blocks(p) for p in pages]
    out = [""] * len(pages)
    joined = lambda page, logits: "\n".join(b.text for b, v in zip(page, logits, strict=True) if v > LEAST)
    for i, page in enumerate(laid):
        if len(page) > WINDOW:
            out[i] = joined(page, long_scores(w, page))
    made = [vectors(b) if len(b) <= WINDOW else None for b in laid]
    order = sorted((i for i in range(len(pages)) if 0 < len(laid[i]) <= WINDOW), key=lambda i: len(laid[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and to - at < 128 and (to - at + 1) * len(laid[order[to]]) <= 1 << 15:
            to += 1
        for i, s in zip(order[at:to], scores(w, [made[i] for i in order[at:to]]), strict=True):
            out[i] = joined(laid[i], s)
        at = to
    return out


def extract(df: DataFrame, page: str = "html", out: str = "text", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `carry`, then `out`: the main text of each page, blocks joined by line breaks.

    Null and empty pages give empty text; repeated rows are each read; other
    columns stay behind. Whole pages are read, cut tags and references too.
    """
    fields = [*(df.schema[c] for c in carry)]
    w = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            got: list[str] = []
            for i in range(0, len(texts), 256):
                got += extract_pages([t or "" for t in texts[i : i + 256]], w)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.string())], names=[*carry, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{out}` string"])
    return df.select(*carry, F.coalesce(F.col(page), F.lit("")).alias("__page")).mapInArrow(run, schema)
