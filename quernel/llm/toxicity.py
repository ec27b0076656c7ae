"""Toxicity by a support vector machine over a gap-weighted subsequence kernel.

Units of a text are its words with inner signs taken out ("id.iot"), and runs of
single letters put together ("i d i o t"). The string kernel of two units sums
their common letter subsequences, each gap letter costing a factor, so inserted
and dropped letters, and unknown endings, still match. Nyström landmarks turn the
kernel into a few numbers; a squared-hinge SVM on those scores a unit, and a
logistic curve over the three worst units of a text makes that 0 to 1.

Only texts carry labels, so the units that make a text toxic are found as in
multiple-instance learning: each toxic text hands its weight first to units that
are in many toxic and few clean texts, then to those that the last model suspects.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import claim, crc_mod

SAMPLE_ROWS = 4000  # labelled documents that the model is fitted on, about
SAMPLE_LETTERS = 32_000_000  # letters of their units, at most
DECAY = 0.6
ORDERS = (3, 5)  # each over 1
SHORTEST = 3  # letters of a unit; fewer have no subsequence of the least order
WINDOW = 24
CACHE_ENTRIES = 1_000_000
CLEAN = -1.0  # the lowest score of a unit; that of texts without units
SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
SIGNS = re.compile(r"[\W\d_]+")


def chunks(text: str) -> list[str]:
    """White-space parts of the lower-cased text, and spelled-out runs as one part each."""
    text = text.lower()
    out = text.split()
    if " " in text:
        out += ["".join(m.split()) for m in SPELLED.findall(text)]
    return out


def units(text: str) -> set[str]:
    return {u for u in (SIGNS.sub("", c) for c in chunks(text)) if len(u) >= SHORTEST}


def windows(unit: str) -> list[str]:
    """A unit with a mark before it, so that beginnings count; over ``WINDOW`` letters as overlapping windows that cover it all."""
    if len(unit) <= WINDOW:
        return ["^" + unit]
    return ["^" * (i == 0) + unit[i : i + WINDOW] for i in range(0, len(unit) - WINDOW // 2, WINDOW // 2)]


def codes(strings: list[str]) -> np.ndarray:
    """Code points by row, padded with 0."""
    out = np.zeros((len(strings), max(map(len, strings), default=0)), np.int32)
    for i, s in enumerate(strings):
        out[i, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def kernel(s: np.ndarray, t: np.ndarray, paired: bool = False) -> np.ndarray:
    """Subsequence kernels of ``ORDERS``, (order, row of s, row of t); with ``paired`` rows meet one to one.

    ``ends[n][j]`` sums common subsequences of n letters whose last is t's letter j
    and one of s so far, without their decay: that is a power of the last places
    alone, once the first letter is divided by its own. Places too near the
    beginning to end n letters, or the end to go on to an order, are left out.
    """
    top, width, length = max(ORDERS), t.shape[1], s.shape[1]
    more = {n: min(m - n for m in ORDERS if m > n) for n in range(1, top)}  # letters that must follow
    shape = (len(s),) if paired else (len(s), len(t))
    t = np.where(t == 0, -1, t)
    ends = np.zeros((top, width, *shape), np.float32)
    total = np.zeros((top + 1, *shape), np.float32)
    match, before, met, part = np.zeros((width, *shape), np.float32), np.zeros(shape, np.float32), np.zeros(shape, np.float32), np.zeros(shape, np.float32)
    power = [np.float32(DECAY**k) for k in range(s.shape[1] + width)]
    for i in range(s.shape[1]):
        here = s[:, i] if paired else s[:, i, None]
        for j in range(width):
            match[j] = here == (t[:, j] if paired else t[None, :, j])
        for order in range(min(top, i + 1), 1, -1):
            goes_on = order < top and i + more[order] < length
            if not goes_on and order not in ORDERS:
                continue
            before[...] = 0
            for j in range(order - 1, width if order in ORDERS else width - more[order]):
                before += ends[order - 1, j - 1]
                np.multiply(match[j], before, out=met)
                if goes_on and j + more[order] < width:
                    ends[order, j] += met
                if order in ORDERS:
                    np.multiply(met, power[i + j], out=part)
                    total[order] += part
        if i + more[1] < length:
            for j in range(width - more[1]):
                np.multiply(match[j], np.float32(DECAY ** (2 - i - j)), out=met)
                ends[1, j] += met
    return total[list(ORDERS)]


def normal_kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Mean over the orders of the kernels, each 1 for a string with itself; (string, landmark)."""
    t = codes(landmarks)
    own_t = kernel(t, t, paired=True)
    out = np.zeros((len(strings), len(landmarks)), np.float32)
    order = sorted(range(len(strings)), key=lambda i: len(strings[i]))
    # landmarks of like length together: the kernel's work goes with the longest
    by_length = np.argsort([len(x) for x in landmarks], kind="stable")
    parts = [p for p in np.array_split(by_length, max(2, -(-len(landmarks) // 20))) if len(p)]  # memory is for 20 landmarks
    tight = [t[p][:, : max(len(landmarks[i]) for i in p)] for p in parts]
    for a in range(0, len(order), 2048):
        rows = order[a : a + 2048]
        s = codes([strings[i] for i in rows])
        own_s = kernel(s, s, paired=True)
        for p, some in zip(parts, tight):
            value = kernel(s, some) / np.sqrt(np.maximum(own_s[:, :, None] * own_t[:, None, p], 1e-20))
            out[np.ix_(rows, p)] = value.mean(0)
    return out


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # of the kernels with the landmarks
    bias: float
    curve: np.ndarray  # logistic weights of ``features``, the last for a constant 1

    def unit_scores(self, names: list[str]) -> np.ndarray:
        if not self.landmarks or not names:
            return np.full(len(names), CLEAN)
        parts = [windows(n) for n in names]
        flat = [w for p in parts for w in p]
        values = normal_kernel(flat, self.landmarks) @ self.weights + self.bias
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1]
        return np.maximum(np.maximum.reduceat(values, starts), CLEAN)

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.curve, -30, 30)))


@dataclass
class Shared:
    """A broadcast model, and a name that tells it from other models."""

    id: str
    model: Broadcast

    @property
    def value(self) -> Model:
        return self.model.value


#: Of a worker: parts' units and units' scores under one model, over all its tasks until another operator claims the memory.
_cache: dict = {}


def features(tops: list[list[float]], sizes: list[int]) -> np.ndarray:
    """The three highest unit scores of a text, its size, and 1."""
    out = np.full((len(tops), 5), CLEAN)
    for row, top in zip(out, tops):
        row[: len(top)] = top
    out[:, 3], out[:, 4] = np.log1p(sizes), 1
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 30, rows: int = 8192) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge losses, weighted by ``c``, by Newton steps; sums are taken ``rows`` rows at a time."""
    width = x.shape[1] + 1
    ridge = np.eye(width)
    ridge[-1, -1] = 1e-3
    w = np.zeros(width)
    for _ in range(rounds):
        left, right = ridge.copy(), np.zeros(width)
        for i in range(0, len(x), rows):
            z = np.column_stack([x[i : i + rows].astype(np.float64), np.ones(len(x[i : i + rows]))])
            part = slice(i, i + rows)
            active = y[part] * (z @ w) < 1
            z, weight = z[active], c[part][active]
            left += z.T @ (z * weight[:, None])
            right += z.T @ (weight * y[part][active])
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def surely(toxic: int, clean: int, share: float, tried: int) -> bool:
    """Whether so many toxic and clean texts are too many toxic ones for chance, at 5 % over all ``tried`` units (Chernoff's bound)."""
    n, q = toxic + clean, toxic / (toxic + clean)
    divergence = q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0)
    return q > share and n * divergence > math.log(20 * tried)


def spread(weight: dict[str, float], least: int, apart: float = 0.5, sure: set[str] | None = None) -> list[str]:
    """Units that are unlike each other, heaviest first, until every sure one (all, if not given) is like one of them and there are ``least``; then the heaviest of the rest, up to ``least``. Ties to the lesser string."""
    sure = set(weight) if sure is None else sure
    ranked = sorted(weight, key=lambda u: (-weight[u], u))
    chosen, left = [], ranked
    while left and (len(chosen) < least or any(u in sure for u in left)):
        if len(chosen) >= least:
            left = [u for u in left if u in sure]
        chosen.append(left[0])
        like = normal_kernel([windows(u)[0] for u in left[1:]], [windows(left[0])[0]])[:, 0]
        left = [u for u, x in zip(left[1:], like) if x < apart]
    known = set(chosen)
    return chosen + [u for u in ranked if u not in known][: max(0, least - len(chosen))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic weights, both labels weighing the same, by Newton steps."""
    c = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (c * q * (1 - q))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (c * (q - y)) + ridge * w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


def train(rows: list[tuple[set[str], int]], n_landmarks: int = 32, rounds: int = 3) -> Model:
    """Fit on (units of a text, label). Without both labels, or without units that tell them apart, every text gets the same score."""
    rows = sorted({(tuple(sorted(u)), y) for u, y in rows})  # a copied text counts once
    toxic, clean = ([list(u) for u, y in rows if y == v] for v in (1, 0))
    prior = (len(toxic) + 0.5) / (len(rows) + 2)  # under a half without labels: nothing is toxic for want of evidence
    flat = Model([], np.zeros(0), 0.0, np.array([0, 0, 0, 0, np.log(prior / (1 - prior))]))
    if not toxic or not clean:
        return flat
    in_toxic, in_clean = (Counter(u for t in ts for u in t) for ts in (toxic, clean))
    able = {u: n for u, n in in_toxic.items() if n >= 3 and n / len(toxic) >= 6 * (in_clean[u] + 0.5) / len(clean)}
    if not able:
        return flat
    weight: dict[str, float] = Counter()
    for t in toxic:  # each text hands one unit of weight to its suspects, mostly to those that are in many toxic texts
        shares = {u: float(able[u]) ** 2 for u in t if u in able}
        for u, x in shares.items():
            weight[u] += x / sum(shares.values())
    share, tried = len(toxic) / len(rows), len(in_toxic.keys() | in_clean.keys())
    # those that chance doesn't explain, nor heavier units of the same texts: they carry half of a text at least
    sure = {u for u, x in weight.items() if x >= 0.5 and surely(in_toxic[u], in_clean[u], share, tried)}
    usual = [u for u, _ in sorted(in_clean.items(), key=lambda x: (-x[1], x[0])) if u not in weight]
    landmarks = list(dict.fromkeys(windows(u)[0] for u in spread(weight, n_landmarks, sure=sure) + usual[:8]))
    values, vectors = np.linalg.eigh(normal_kernel(landmarks, landmarks).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-4))) @ vectors.T  # Nyström map
    names = sorted({*in_toxic, *in_clean})
    parts = [windows(n) for n in names]
    near = normal_kernel([w for p in parts for w in p], landmarks)
    phi = near @ root.astype(np.float32)
    sizes = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    at = {n: i for i, n in enumerate(names)}
    bags = [np.array([at[u] for u in t], np.int64) for t in toxic + clean]
    marks = np.array([1] * len(toxic) + [0] * len(clean))
    good = np.zeros(len(names))
    good[[at[u] for u in weight]] = list(weight.values())
    bad = np.array([in_clean[n] for n in names], float)
    usual_rows = np.array([at[u] for u in usual], np.int64)
    hard = np.zeros(0, np.int64)
    value = near.max(axis=1)
    for step in range(rounds):
        p = np.nonzero(good)[0]
        n = np.unique(np.concatenate([usual_rows, hard, p[bad[p] > 0]]))
        n = n[bad[n] > 0]
        # a long suspect trains by its worst window, a usual unit by all of its windows
        worst = np.array([starts[i] + int(np.argmax(value[starts[i] : starts[i] + sizes[i]])) for i in p], np.int64)
        every = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in n]) if len(n) else n
        x = phi[np.concatenate([worst, every])]
        y = np.array([1.0] * len(worst) + [-1.0] * len(every))
        c = 400 * np.concatenate([good[p] / len(toxic), np.repeat(bad[n] / sizes[n], sizes[n]) / len(clean) / max(1.0, (bad[n] / len(clean)).sum() / 4)])
        w, bias = squared_hinge(x, y, c)
        value = phi @ w + bias
        scores = np.maximum(np.maximum.reduceat(value, starts), CLEAN)
        if step == rounds - 1:
            break
        good[:] = 0
        for b in bags[: len(toxic)]:  # what the model finds suspect takes the text's weight
            suspect = b[scores[b] > 0]
            if len(suspect):
                force = np.exp(4 * scores[suspect])
                good[suspect] += force / force.sum()
        tops = [b[np.argsort(-scores[b], kind="stable")[:3]] for b in bags[len(toxic) :]]
        hard = np.unique(np.concatenate([t[scores[t] > -0.7] for t in tops])) if tops else hard
        if not good.any():
            good[[at[u] for u in weight]] = list(weight.values())
    tops = [np.sort(scores[b])[::-1][:3].tolist() for b in bags]
    return Model(landmarks, root @ w, bias, logistic(features(tops, [len(b) for b in bags]), marks))


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(h, toxic, text): one text of each of about ``sample_rows`` labelled ids, chosen by a limit on their hash."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample_rows / max(1, marked.count()))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")  # about sample_rows rows of two numbers
    return found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select(F.xxhash64("doc_id").alias("h"), "toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_letters: int = SAMPLE_LETTERS) -> Model:
    """Fit, in a task, on about ``sample_rows`` labelled ids, chosen by hash, outside the held-out fold (crc32 of doc_id mod 5 is 0).

    Null labels and labels other than 0 and 1 don't count; a doc_id with both
    labels counts as toxic, and of the texts of a repeated doc_id one is taken. In
    the order of the hash, texts beyond ``sample_letters`` letters of units are left out.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [sorted(units(t or "")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("toxic"), pa.array(texts, pa.list_(pa.string()))], ["h", "toxic", "units"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", lambda: None)
        known: dict[str, str] = {}
        rows, letters = [], 0
        for b in batches:
            for y, us in zip(b.column("toxic").to_pylist(), b.column("units").to_pylist()):
                letters += sum(map(len, us))
                if letters > sample_letters:
                    break
                rows.append(({known.setdefault(u, u) for u in us}, y))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows))], pa.binary())], ["model"])

    rows = sample(docs, labels, sample_rows).mapInArrow(reduce, "h long, toxic int, units array<string>")
    one = rows.repartition(1).sortWithinPartitions("h", "toxic").mapInArrow(learn, "model binary")  # the sample is bounded
    got = one.first()
    return pickle.loads(got["model"]) if got else train([])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, worst_unit) of every row. A text without units, null included, scores as clean units do."""
    return with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score``, ``predicted`` and ``worst_unit`` to every row, in place of columns so named."""
    from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

    added = {"score": (DoubleType(), pa.float64()), "predicted": (IntegerType(), pa.int32()), "worst_unit": (StringType(), pa.string())}
    docs = docs.drop(*added).withColumn("text", F.col("text").cast("string"))
    schema = StructType([*docs.schema.fields])
    for name, (kind, _) in added.items():
        schema = schema.add(name, kind)
    shared = Shared(uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        claim("toxicity", _cache.clear)
        if _cache.get("model") != shared.id:
            _cache.clear()
            _cache["model"] = shared.id
        unit_of: dict[str, str] = _cache.setdefault("units", {})
        value_of: dict[str, float] = _cache.setdefault("values", {})
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                if len(unit_of) > CACHE_ENTRIES // 4:
                    unit_of.clear()
                if len(value_of) > CACHE_ENTRIES:
                    value_of.clear()
                split = [set(chunks(t or "")) for t in part.column("text").to_pylist()]
                for c in set().union(*split).difference(unit_of):
                    u = SIGNS.sub("", c)
                    unit_of[c] = u if len(u) >= SHORTEST else ""
                bags = [list(set(map(unit_of.__getitem__, cs)) - {""}) for cs in split]
                new = sorted(set().union(*bags).difference(value_of))
                value_of.update(zip(new, model.unit_scores(new).tolist()))
                values = [list(map(value_of.__getitem__, b)) for b in bags]
                tops = [sorted(v)[:-4:-1] for v in values]
                worst = [min(u for u, x in zip(b, v) if x == t[0]) if t and t[0] > CLEAN else "" for b, v, t in zip(bags, values, tops)]
                p = model.probability(features(tops, [len(b) for b in bags]))
                new_columns = [pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(worst, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new_columns], [*part.schema.names, *added])

    return docs.mapInArrow(run, schema)


def op7_toxicity(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit(docs, labels))
    return scored.withColumn("held_out", crc_mod("doc_id", 5) == 0).select("doc_id", "held_out", "score", "predicted", "worst_unit")
