"""Main text of web pages: a recurrent labeller over a page's text blocks.

A page becomes a sequence of leaf blocks: the text between two borders of block
elements, with its tag path, hashed words and a few measures. A bidirectional
LSTM in numpy reads the sequence and labels each block as main text or not, so
every decision sees the whole page. It is trained here, on generated pages in
many layouts (menus, notices, adverts, sidebars, forms, comments, footers, with
telling and with meaningless class names) whose main text is known.
"""

from __future__ import annotations

import html
import inspect
import io
import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.common import checkpoint_dir

#: For a page up to its last ``>``: each tag or piece of text is read once, whatever is left open.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|[^<]+|<""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden|rel|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
PARTS = re.compile(r"[a-z]+")
# The HTML standard's element kinds.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source output progress math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg canvas audio video select annotation annotation-xml".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
TAG_BUCKETS, WORD_BUCKETS, WIDTH, HIDDEN, MEASURES = 4096, 8192, 16, 24, 10


@dataclass
class Block:
    text: str
    path: tuple[int, ...]  # buckets of the tags and name parts of all elements around it, each once, and again of the innermost
    link_chars: int
    measures: list[float] = field(default_factory=list)


def named_parts(attributes: str) -> list[str]:
    """Words in the class, id and role of a tag, and marks of hidden elements."""
    out = []
    for name, value in NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            out.append("!hidden")
        elif name in ("class", "id", "role", "itemprop"):
            out += [f".{p}" for p in PARTS.findall(value)]
    return out


_tag_buckets: dict[str, int] = {}
_word_buckets: dict[str, int] = {}


def bucket(known: dict[str, int], word: str, n: int) -> int:
    got = known.get(word)
    if got is None:
        if len(known) > 400_000:
            known.clear()
        got = known[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % n
    return got


class Stack:
    """Open elements. What an end tag closes is found without a walk over those that stay open."""

    def __init__(self):
        self.items: list[tuple[str, tuple[int, ...], tuple[int, ...]]] = []  # tag, path, and what the innermost block element adds
        self.at: dict[str, list[int]] = {}  # places of the open elements of each tag
        self.blocks: list[int] = []  # places of those that aren't inline
        self.walls: list[int] = []  # places of those that are neither inline nor p
        self.links = 0

    @property
    def path(self) -> tuple[int, ...]:
        return self.items[-1][1] + self.items[-1][2] if self.items else ()

    def push(self, tag: str, names: list[str]) -> None:
        path, own = self.items[-1][1:] if self.items else ((), ())
        if tag not in INLINE:
            own = tuple(bucket(_tag_buckets, "@" + x, TAG_BUCKETS) for x in (tag, *names))
            self.blocks.append(len(self.items))
            if tag != "p":
                self.walls.append(len(self.items))
            for x in (tag, *names):
                k = bucket(_tag_buckets, x, TAG_BUCKETS)
                if k not in path:
                    path += (k,)
        self.links += tag == "a"
        self.at.setdefault(tag, []).append(len(self.items))
        self.items.append((tag, path, own))

    def pop_to(self, k: int) -> None:
        while len(self.items) > k:
            tag = self.items.pop()[0]
            self.at[tag].pop()
            self.links -= tag == "a"
            if tag not in INLINE:
                self.blocks.pop()
                if tag != "p":
                    self.walls.pop()

    def close(self, tag: str) -> None:
        """An end tag; that of an inline element doesn't close block elements."""
        places = self.at.get(tag)
        if places and not (tag in INLINE and self.blocks and self.blocks[-1] > places[-1]):
            self.pop_to(places[-1])

    def close_any(self, tags: tuple[str, ...]) -> None:
        """What a start tag closes unsaid: the last of these tags, unless another block is open inside it."""
        k = max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)
        if k >= 0 and not (self.walls and self.walls[-1] > k):
            self.pop_to(k)


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order; scripts, styles, comments and the head give none."""
    out: list[Block] = []
    stack = Stack()
    held: list[str] = []
    links = skip_to = 0
    whole_head = True  # a head that isn't closed is no reason to look for its end again

    def flush():
        nonlocal links
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, stack.path, min(links, len(text))))
            held.clear()
        links = 0

    def hold(piece: str):
        nonlocal links
        held.append(html.unescape(piece) if "&" in piece else piece)
        if stack.links:
            links += len(held[-1].strip())

    last = page.rfind(">") + 1
    for m in TOKEN.finditer(page, 0, last):
        if m.start() < skip_to:
            continue
        tag = m.group(2)
        if tag is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                hold(piece)
            elif piece.startswith("<!--") and not piece.endswith("-->"):
                skip_to = len(page)
            continue
        tag = tag.lower()
        if m.group(1):
            if tag not in INLINE:
                flush()
            stack.close(tag)
            continue
        if tag in RAW or (tag == "head" and whole_head):
            end = re.compile(rf"</{re.escape(tag)}\s*>|<body[\s>]" if tag == "head" else rf"</{re.escape(tag)}\s*>", re.I).search(page, m.end())
            if tag not in INLINE:
                flush()
            whole_head = tag != "head" or end is not None
            skip_to = (end.start() if end.group()[1] != "/" else end.end()) if end else (m.end() if tag == "head" else len(page))
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P:
                stack.close_any(("p",))
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                stack.close_any({"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}.get(tag, (tag,)))
        if tag not in VOID and not m.group(3).endswith("/"):
            stack.push(tag, named_parts(m.group(3)) if m.group(3) else [])
    if skip_to <= last < len(page):
        hold(page[last:].partition("<!--")[0])
    flush()
    return out


def features(found: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Tag buckets and word buckets of each block, and its measures."""
    n = len(found)
    tags, words_, measures = [], [], np.zeros((n, MEASURES), np.float32)
    same: dict[tuple, int] = {}
    for b in found:
        same[b.path] = same.get(b.path, 0) + len(b.text)
    total = sum(len(b.text) for b in found) or 1
    for i, b in enumerate(found):
        tags.append(np.array(b.path or [0], np.int64))
        ws = b.text.lower().split()
        get = _word_buckets.get
        words_.append(np.array([v if (v := get(w)) is not None else bucket(_word_buckets, w, WORD_BUCKETS) for w in ws], np.int64))
        t = b.text
        measures[i] = (
            np.log1p(len(t)) / 5, np.log1p(len(ws)) / 4, b.link_chars / len(t), t[-1] in ".!?…\"”", min(t.count(",") / len(ws), 1), i / n,
            same[b.path] / total, np.log1p(n) / 5, t[:1].isupper(), min(sum(c.isdigit() for c in t) / len(t), 1),
        )
    return tags, words_, measures


@dataclass
class Labeller:
    """Embeddings of tags and words, LSTM weights both ways, output weights."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int) -> Labeller:
        r = np.random.default_rng(seed)
        width = 2 * WIDTH + MEASURES
        p = {"tag": r.normal(0, 0.3, (TAG_BUCKETS, WIDTH)), "word": r.normal(0, 0.05, (WORD_BUCKETS, WIDTH)), "out": r.normal(0, 0.2, (2 * HIDDEN + width, 1)), "out_b": np.zeros(1)}
        for way in "fb":
            p[f"w{way}"] = r.normal(0, 0.2, (width + HIDDEN, 4 * HIDDEN))
            p[f"b{way}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        return Labeller({k: v.astype(np.float32) for k, v in p.items()})

    def embed(self, tags, words_, measures) -> np.ndarray:
        def mean(table, lists):
            flat = np.concatenate(lists)
            starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])[:-1]
            return np.add.reduceat(table.take(flat, axis=0), starts, axis=0) / np.array([len(x) for x in lists], np.float32)[:, None]

        return np.concatenate([mean(self.p["tag"], tags), mean(self.p["word"], words_), measures], axis=1)

    def lstm(self, x: np.ndarray, way: str, keep: bool = False):
        """States (time, page, HIDDEN); for the backward way time runs from the end."""
        w, b = self.p[f"w{way}"], self.p[f"b{way}"]
        t, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, trace = np.zeros((t, n, HIDDEN), np.float32), []
        pre = x @ w[: x.shape[2]] + b
        for s in range(t):
            z = pre[s] + h @ w[x.shape[2] :]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            if keep:
                trace.append((h, c, i, f, o, g))
            c = f * c + i * g
            h = o * np.tanh(c)
            out[s] = h
            if keep:
                trace[-1] += (c,)
        return (out, trace) if keep else out

    @staticmethod
    def reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each page's sequence turned round inside its own length."""
        t = np.arange(x.shape[0])[:, None]
        index = np.where(t < lengths[None, :], lengths[None, :] - 1 - t, t)
        return np.take_along_axis(x, index[:, :, None], axis=0)

    def scores(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        """Log odds of being main text, for each block of each page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(xs)
        order = sorted((i for i in range(len(xs)) if len(xs[i])), key=lambda i: len(xs[i]))
        for a in range(0, len(order), 128):
            group = order[a : a + 128]
            lengths = np.array([len(xs[i]) for i in group])
            x = np.zeros((lengths.max(), len(group), xs[group[0]].shape[1]), np.float32)
            for k, i in enumerate(group):
                x[: lengths[k], k] = xs[i]
            forward = self.lstm(x, "f")
            backward = self.reverse(self.lstm(self.reverse(x, lengths), "b"), lengths)
            z = np.concatenate([forward, backward, x], axis=2) @ self.p["out"] + self.p["out_b"]
            for k, i in enumerate(group):
                out[i] = z[: lengths[k], k, 0]
        return out


def train_labeller(pages: list[tuple[list[Block], np.ndarray]], seed: int = 7, epochs: int = 6, batch: int = 32, rate: float = 0.006) -> Labeller:
    """Adam on the blocks' logistic losses, with back-propagation through whole pages."""
    model, r = Labeller.fresh(seed), np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    prepared = [(*features(b), y) for b, y in pages]
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(prepared))
        for a in range(0, len(order), batch):
            group = [prepared[i] for i in order[a : a + batch]]
            lengths = np.array([len(g[3]) for g in group])
            tags, words_ = [x for g in group for x in g[0]], [x for g in group for x in g[1]]
            flat = model.embed(tags, words_, np.concatenate([g[2] for g in group]))
            quiet = (r.random(len(flat)) < 0.5).astype(np.float32)  # half of the blocks learn without their words
            flat[:, WIDTH : 2 * WIDTH] *= 1 - quiet[:, None]
            t_max, n = lengths.max(), len(group)
            x, y, mask = np.zeros((t_max, n, flat.shape[1]), np.float32), np.zeros((t_max, n), np.float32), np.zeros((t_max, n), np.float32)
            at = np.concatenate([[0], np.cumsum(lengths)])
            for k, g in enumerate(group):
                x[: lengths[k], k], y[: lengths[k], k], mask[: lengths[k], k] = flat[at[k] : at[k + 1]], g[3], 1
            xr = model.reverse(x, lengths)
            hf, tf = model.lstm(x, "f", keep=True)
            hr, tb = model.lstm(xr, "b", keep=True)
            top = np.concatenate([hf, model.reverse(hr, lengths), x], axis=2)
            q = 1 / (1 + np.exp(-np.clip((top @ model.p["out"])[:, :, 0] + model.p["out_b"], -30, 30)))
            d = ((q - y) * mask / mask.sum())[:, :, None].astype(np.float32)
            g: dict[str, np.ndarray] = {"out": np.tensordot(top, d, axes=([0, 1], [0, 1])), "out_b": d.sum((0, 1))}
            dtop = d @ model.p["out"].T
            dx = dtop[:, :, 2 * HIDDEN :].copy()
            for way, trace, dh_all, inp in (("f", tf, dtop[:, :, :HIDDEN], x), ("b", tb, model.reverse(dtop[:, :, HIDDEN : 2 * HIDDEN], lengths), xr)):
                w = model.p[f"w{way}"]
                dw, db = np.zeros_like(w), np.zeros_like(model.p[f"b{way}"])
                dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
                dxin = np.zeros_like(x)
                for s in range(t_max - 1, -1, -1):
                    h0, c0, i, f, o, gg, c = trace[s]
                    dh = dh + dh_all[s]
                    tc = np.tanh(c)
                    dc = dc + dh * o * (1 - tc**2)
                    dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg**2)], axis=1)
                    dw += np.concatenate([inp[s], h0], axis=1).T @ dz
                    db += dz.sum(0)
                    back = dz @ w.T
                    dxin[s] = back[:, : x.shape[2]]
                    dh, dc = back[:, x.shape[2] :], dc * f
                g[f"w{way}"], g[f"b{way}"] = dw, db
                dx += dxin if way == "f" else model.reverse(dxin, lengths)
            dflat = np.concatenate([dx[: lengths[k], k] for k in range(n)])
            dflat[:, WIDTH : 2 * WIDTH] *= 1 - quiet[:, None]
            for name, lists, cols in (("tag", tags, slice(0, WIDTH)), ("word", words_, slice(WIDTH, 2 * WIDTH))):
                size = np.array([len(v) for v in lists])
                table = np.zeros_like(model.p[name])
                np.add.at(table, np.concatenate(lists), np.repeat(dflat[:, cols] / size[:, None], size, axis=0))
                g[name] = table
            step += 1
            scale = min(1.0, 1.0 / (np.sqrt(sum(float((v**2).sum()) for v in g.values())) + 1e-9))
            for k, v in g.items():
                m1, m2 = moments[k]
                m1 += 0.1 * (v * scale - m1)
                m2 += 0.01 * ((v * scale) ** 2 - m2)
                fall = rate * (1 - epoch / epochs * 0.8)
                model.p[k] -= (fall * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            model.p["word"] *= 1 - 0.02 * fall / rate  # words of a few pages are forgotten
    return model


@lru_cache(maxsize=2)
def labeller(pages: int = 2200, seed: int = 7) -> Labeller:
    from quernel.llm.html_pages import generate

    r = np.random.default_rng(seed)
    made = []
    for _ in range(pages):
        page, main = generate(r)
        found = blocks(page)
        made.append((found, np.array([b.text in main for b in found], np.float32)))
    return train_labeller([m for m in made if m[0]], seed)


_trained: dict[tuple[int, int], Labeller] = {}


def kept_in(spark: SparkSession, pages: int, seed: int) -> str:
    """Where the weights of a training are kept: in the shared folder, under a name that changes with the code that makes them."""
    from quernel.llm import html_pages

    code = zlib.crc32((inspect.getsource(html_pages) + inspect.getsource(sys.modules[__name__])).encode())
    return f"{checkpoint_dir(spark)}/quernel-labeller-{pages}-{seed}-{code:08x}"


def trained(spark: SparkSession, pages: int = 2200, seed: int = 7) -> Labeller:
    """``labeller``, trained by a task once and kept as a table; the driver only gets the weights."""
    if (pages, seed) not in _trained:

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                held = io.BytesIO()
                np.savez(held, **labeller(pages, seed).p)
                yield pa.RecordBatch.from_arrays([pa.array([held.getvalue()], pa.binary())], ["weights"])

        folder = kept_in(spark, pages, seed)
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            spark.range(0, 1, 1, 1).mapInArrow(learn, "weights binary").write.mode("overwrite").parquet(folder)
        with np.load(io.BytesIO(spark.read.parquet(folder).first()["weights"])) as held:
            _trained[pages, seed] = Labeller({k: held[k] for k in held.files})
    return _trained[pages, seed]


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    """Main text of each page; empty for a null or empty page."""
    found = [blocks(p or "") for p in pages]
    parts = [features(b) for b in found]
    full = [i for i, b in enumerate(found) if b]
    xs: list[np.ndarray] = [np.zeros((0, 1))] * len(found)
    if full:
        flat = model.embed([t for i in full for t in parts[i][0]], [w for i in full for w in parts[i][1]], np.concatenate([parts[i][2] for i in full]))
        at = 0
        for i in full:
            xs[i] = flat[at : at + len(found[i])]
            at += len(found[i])
    return ["\n".join(b.text for b, s in zip(bs, z) if s > 0) for bs, z in zip(found, model.scores(xs))]


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; a null or empty page gives the empty text, null ids and urls stay, repeated rows are read each for itself.

    Pages are read whole, in time that grows with their length; a very long one takes a task's memory in proportion to its blocks.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = main_texts(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), trained(spark))
