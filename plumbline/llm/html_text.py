"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block has a vector: hashed tags, classes and ids of
its path, hashed words, and a few measures (length, share of links, punctuation, place). A bidirectional
LSTM in numpy reads the whole sequence, so each block is judged in the context of the document, and a
logistic unit says main text or not. It is trained here, on pages made by ``training_pages`` from layouts
with known labels; weights are a few thousand numbers and go to every task.

Blocks: text between block-level tags; character references are decoded, white space becomes one space,
blocks are joined by two newlines in page order. Scripts, styles, templates, drawings, frames, titles and
comments are never text; a start tag of these without an end leaves what follows, but for scripts and styles. Null or empty html gives the empty text; html of any length is read whole. Rows repeat as they come,
null ids and urls are kept, and extra columns are left out.
"""

from __future__ import annotations

import html as htmllib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.textops import span_hashes, word_spans

PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 160, 32, 6, 16
# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template title svg iframe canvas".split())
RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in ("script", "style", "title", "iframe")}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mover mrow ms msqrt mstyle msub msubsup msup mtext munder munderover noscript object q ruby s samp semantics small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div nav aside main header footer body form select blockquote".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


def _tags(page: str) -> Iterator[tuple[re.Match, str, int]]:
    """(tag, its name in lower case, where what follows begins); past a raw text's end tag, past all of an unclosed script."""
    at, open_ended = 0, set()
    while m := _TAG.search(page, at):
        at, name = m.end(), (m[2] or "").lower()
        if name in RAW and not m[1] and not m[3].endswith("/") and name not in open_ended:
            end = RAW[name].search(page, at)
            if end or name in ("script", "style"):
                at = end.end() if end else len(page)
            else:
                open_ended.add(name)
        yield m, name, at


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path tokens, text, characters inside links) of each leaf block in page order."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    path: tuple[str, ...] = ()
    linked, links, at = 0, 0, 0
    tags = list(_tags(page))
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for k, (m, name, _) in enumerate(tags):
        if name in SKIPPED and name not in RAW:
            if not m[1]:
                if not m[3].endswith("/"):
                    opened.setdefault(name, []).append(k)
            elif opened.get(name):
                ends[opened[name].pop()] = k

    def flush():
        nonlocal linked, parts
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            if text:
                out.append((path, text, linked))
            parts, linked = [], 0

    def pop_to(k: int):
        nonlocal links
        for name, _ in stack[k:]:
            links -= name == "a"
        del stack[k:]

    skip_to = -1
    for k, (m, name, after) in enumerate(tags):
        if k <= skip_to:
            at = after
            continue
        if m.start() > at:
            piece = page[at : m.start()]
            if not parts:
                path = stack[-1][1] if stack else ()
            parts.append(piece)
            if links > 0:
                linked += len(piece)
        at = after
        if not name:
            continue
        if m[1]:
            if name not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop_to(i)
                    break
            continue
        if name in SKIPPED or name == "head":
            flush()
            skip_to = ends.get(k, k)
            continue
        if name == "br":
            if parts:
                parts.append(" ")
            continue
        if name not in INLINE:
            flush()
            if any(x[0] == "p" for x in stack[-6:]):
                last = max(i for i, x in enumerate(stack) if x[0] == "p")
                if not any(x[0] in SCOPES for x in stack[last:]):
                    pop_to(last)
            for other in CLOSES.get(name, ()):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == other:
                        pop_to(i)
                        break
                    if stack[i][0] in SCOPES and stack[i][0] != "tr":
                        break
        if name in VOID or m[3].endswith("/"):
            continue
        tokens = [f"t:{name}"]
        if m[3]:
            for x in _NAMES.finditer(m[3]):
                tokens += [f"c:{w}" for w in _SPLIT.split((x[1] or x[2] or x[3] or "").lower()) if w]
        stack.append((name, (stack[-1][1] if stack else ()) + tuple(tokens)))
        links += name == "a"
    if at < len(page):
        if not parts:
            path = stack[-1][1] if stack else ()
        parts.append(page[at:])
    flush()
    return out


_paths: dict[tuple[str, ...], np.ndarray] = {}


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed tokens of the path; the last element counts once more under its own name."""
    got = _paths.get(path)
    if got is None:
        got = np.zeros(PATH_DIM, np.float32)
        last = next((t for t in reversed(path) if t.startswith("t:")), "")
        for token in {*path, f"last{last}"}:
            h = zlib.crc32(token.encode())
            got[h % PATH_DIM] += 1.0 if h >> 31 else -1.0
        if len(_paths) < 50_000:
            _paths[path] = got
    return got


def vectors(pages: list[list[tuple[tuple[str, ...], str, int]]]) -> np.ndarray:
    """Vectors of all blocks of all pages, one after another."""
    every = [b for p in pages for b in p]
    out = np.zeros((len(every), PATH_DIM + WORD_DIM + MEASURES), np.float32)
    if not every:
        return out
    raw = [b[1].encode() for b in every]
    size = np.array([len(x) for x in raw])
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first)
    h = span_hashes(data, starts, ends)
    cell = np.repeat(np.arange(len(every)), words) * WORD_DIM + (h % np.uint64(WORD_DIM)).astype(np.int64)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    bag = np.bincount(cell, sign, len(every) * WORD_DIM).reshape(len(every), WORD_DIM)
    out[:, :PATH_DIM] = [path_vector(b[0]) for b in every]
    out[:, PATH_DIM : PATH_DIM + WORD_DIM] = 0.3 * bag / np.maximum(np.sqrt((bag * bag).sum(1)), 1)[:, None]
    marks = np.isin(data, np.frombuffer(b".,;:!?", np.uint8))
    many = np.diff(np.concatenate([[0], np.cumsum(marks)])[offsets])
    m = out[:, PATH_DIM + WORD_DIM :]
    m[:, 0] = np.minimum(1.5, np.log1p(words) / 4)
    m[:, 1] = [min(1.0, b[2] / max(1, len(b[1]))) for b in every]
    m[:, 2] = np.minimum(1, many / np.maximum(words, 1))
    counts = np.array([len(p) for p in pages])
    place = np.arange(len(every)) - np.repeat(np.cumsum(counts) - counts, counts)
    m[:, 3] = place / np.repeat(np.maximum(counts, 1), counts)
    m[:, 4] = place == 0
    m[:, 5] = 1
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over block vectors with a logistic unit on top."""

    def __init__(self, rng: np.random.Generator, inputs: int = PATH_DIM + WORD_DIM + MEASURES, hidden: int = HIDDEN):
        self.hidden = hidden
        self.w = {}
        for d in ("f", "b"):
            self.w[f"x{d}"] = rng.normal(0, 0.15, (inputs, 4 * hidden)).astype(np.float32)
            self.w[f"h{d}"] = rng.normal(0, 0.2, (hidden, 4 * hidden)).astype(np.float32)
            self.w[f"c{d}"] = np.repeat(np.float32([0, 1, 0, 0]), hidden)
        self.w["o"] = rng.normal(0, 0.2, 2 * hidden).astype(np.float32)
        self.w["s"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        n, t, _ = x.shape
        k = self.hidden
        z = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out = np.zeros((n, t, k), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            g = z[:, i] + h @ self.w[f"h{d}"]
            gi, gf, go, gc = _sigmoid(g[:, :k]), _sigmoid(g[:, k : 2 * k]), _sigmoid(g[:, 2 * k : 3 * k]), np.tanh(g[:, 3 * k :])
            m = mask[:, i, None]
            c2 = gf * c + gi * gc
            tc = np.tanh(c2)
            h2 = go * tc
            if keep is not None:
                keep.append((i, h, c, gi, gf, go, gc, tc, m))
            c, h = np.where(m, c2, c), np.where(m, h2, h)
            out[:, i] = h
        return out

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probability of main text for padded sequences (pages, blocks, inputs)."""
        h = np.concatenate([self._run(x, mask, "f", None), self._run(x, mask, "b", None)], 2)
        return _sigmoid(h @ self.w["o"] + self.w["s"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        k = self.hidden
        keep: dict[str, list] = {"f": [], "b": []}
        parts = {d: self._run(x, mask, d, keep[d]) for d in "fb"}
        h = np.concatenate([parts["f"], parts["b"]], 2)
        e = (_sigmoid(h @ self.w["o"] + self.w["s"]) - y) * mask / mask.sum()
        grad = {"o": np.einsum("nt,ntk->k", e, h), "s": np.array([e.sum()], np.float32)}
        up = e[:, :, None] * self.w["o"]
        for d, part in (("f", up[:, :, :k]), ("b", up[:, :, k:])):
            wh = self.w[f"h{d}"]
            dz = np.zeros((*x.shape[:2], 4 * k), np.float32)
            gh = np.zeros_like(wh)
            dh, dc = np.zeros((len(x), k), np.float32), np.zeros((len(x), k), np.float32)
            for i, h0, c0, gi, gf, go, gc, tc, m in reversed(keep[d]):
                dh = dh + part[:, i]
                a, b = np.where(m, dh, 0), np.where(m, dc, 0)
                b = b + a * go * (1 - tc * tc)
                g = np.concatenate([b * gc * gi * (1 - gi), b * c0 * gf * (1 - gf), a * tc * go * (1 - go), b * gi * (1 - gc * gc)], 1)
                dz[:, i] = g
                gh += h0.T @ g
                dh, dc = np.where(m, g @ wh.T, dh), np.where(m, b * gf, dc)
            grad[f"x{d}"] = np.tensordot(x, dz, ((0, 1), (0, 1)))
            grad[f"h{d}"] = gh
            grad[f"c{d}"] = dz.sum((0, 1))
        return grad

    def fit(self, batches: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rounds: int, rate: float = 0.01) -> None:
        """Adam on the logistic loss."""
        a = {k: np.zeros_like(v) for k, v in self.w.items()}
        b = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for r in range(rounds):
            for x, mask, y in batches:
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    a[k] = 0.9 * a[k] + 0.1 * g
                    b[k] = 0.99 * b[k] + 0.01 * g * g
                    self.w[k] = (self.w[k] - rate * (0.3 if r > rounds * 2 / 3 else 1) * (a[k] / (1 - 0.9**step)) / (np.sqrt(b[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


# Names that layouts use for parts of a page, by what the part holds.
MAIN = [("article", ""), ("main", ""), ("div", "content"), ("div", "post body"), ("section", "story"), ("div", "entry text"), ("div", "article")]
REST = [("nav", ""), ("header", ""), ("footer", ""), ("aside", ""), ("div", "ad"), ("div", "ads banner"), ("div", "advert"), ("div", "sidebar"), ("ul", "menu"), ("div", "nav"), ("div", "footer"), ("div", "header"), ("div", "cookie notice"),
        ("div", "notice"), ("form", ""), ("form", "search"), ("div", "comments"), ("section", "comments"), ("div", "comment"), ("ol", "comment list"), ("div", "related"), ("div", "share social"), ("div", "breadcrumb"), ("div", "login"), ("div", "subscribe newsletter"), ("div", "promo sponsor"), ("div", "widget"), ("div", "copyright")]


def training_pages(n: int, seed: int = 5) -> list[tuple[str, list[bool]]]:
    """(html, main text or not for each block) of made-up pages."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda x: x[int(rng.integers(len(x)))]
    out = []

    def words(a: int, b: int) -> str:
        some = ["".join(pick("aeioustnrlhdmc") for _ in range(int(rng.integers(1, 9)))) for _ in range(int(rng.integers(a, b)))]
        return (" ".join(some).capitalize() + pick([".", ".", ".", "!", ""])) if b > 6 else " ".join(some).capitalize()

    def part(tag: str, name: str, inner: str) -> str:
        given = f' {pick(["class", "class", "id"])}="{name}"' if name else ""
        return f"<{tag}{given}>{inner}</{tag}>"

    for _ in range(n):
        marks: list[bool] = []

        def rest() -> str:
            tag, name = pick(REST)
            kind, inner = int(rng.integers(4)), []
            for _ in range(int(rng.integers(1, 6))):
                marks.append(False)
                t = words(1, 4) if kind < 2 else words(3, 25)
                link = rng.random() < (0.8 if kind < 2 else 0.2)
                t = f'<a href="/x">{t}</a>' if link else t
                inner.append(f"<li>{t}</li>" if kind < 2 or tag in ("ul", "ol") else f"<p>{t}</p>" if kind == 2 else f"<div>{t}</div>")
            if tag not in ("ul", "ol") and kind == 3 and rng.random() < 0.5:
                del marks[-len(inner) :]
                marks.append(False)
                inner = [words(2, 20)]
            body = "".join(inner)
            return part(tag, name, f"<ul>{body}</ul>" if "<li>" in body and tag not in ("ul", "ol") else body)

        def main() -> str:
            tag, name = pick(MAIN)
            inner = []
            if rng.random() < 0.8:
                marks.append(True)
                inner.append(f"<h1>{words(2, 14)}</h1>")
            for _ in range(int(rng.integers(1, 9) if rng.random() < 0.88 else rng.integers(10, 70))):
                roll = rng.random()
                if roll < 0.05:
                    inner.append(rest())
                    continue
                marks.append(True)
                t = words(1, 70) if roll < 0.9 else words(2, 8)
                if rng.random() < 0.2:
                    t = f'{t} <a href="/y">{words(1, 3)}</a> {words(1, 6)}'
                inner.append(f"<h2>{t}</h2>" if roll > 0.94 else f"<p><b>{t}<br>" if roll > 0.9 else f"<ul><li>{t}</li></ul>" if roll > 0.87 else f"<p>{t}</p>")
            return part(tag, name, "".join(inner))

        body = "".join(rest() for _ in range(int(rng.integers(0, 4))))
        body += main()
        body += "".join(rest() for _ in range(int(rng.integers(0, 4))))
        if rng.random() < 0.4:
            body = f'<div class="{pick(["page", "wrap", "container", "row"])}">{body}</div>'
        out.append((f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{body}</body></html>", marks))
    return out


def padded(x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of ``counts`` rows of x as (pages, blocks, inputs), and where there is a block."""
    t = int(counts.max(initial=1))
    mask = np.arange(t) < counts[:, None]
    out = np.zeros((len(counts), t, x.shape[1]), np.float32)
    out[mask] = x
    return out, mask


_model: dict[tuple, Labeller] = {}


def trained(pages: int = 600, rounds: int = 14, seed: int = 5) -> Labeller:
    """The labeller, trained once per process; the same on every run."""
    key = (pages, rounds, seed)
    if key not in _model:
        made = training_pages(pages, seed)
        batches = []
        for i in range(0, len(made), 50):
            got = [blocks(h) for h, _ in made[i : i + 50]]
            x, mask = padded(vectors(got), np.array([len(b) for b in got]))
            y = np.zeros(mask.shape, np.float32)
            y[mask] = [m for _, marks in made[i : i + 50] for m in marks]
            batches.append((x, mask, y))
        model = Labeller(np.random.Generator(np.random.PCG64(seed)))
        model.fit(batches, rounds)
        _model[key] = model
    return _model[key]


def extract(pages: list[str | None], model: Labeller, cells: int = 24_000) -> list[str]:
    """Main text of each page."""
    got = [blocks(p or "") for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if got[i]), key=lambda i: len(got[i]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a + 1) * len(got[order[b]]) <= cells:
            b += 1
        some = [got[i] for i in order[a:b]]
        p = model.predict(*padded(vectors(some), np.array([len(x) for x in some])))
        for row, i in enumerate(order[a:b]):
            out[i] = "\n\n".join(x[1] for x, q in zip(got[i], p[row]) if q >= 0.5)
        a = b
    return out


def main_text(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``."""
    model = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                text = extract(part.column(2).to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, "page_id long, url string, text string, n_chars long")
