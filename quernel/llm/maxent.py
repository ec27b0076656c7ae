"""Hashed maximum-entropy language model with a class-factored softmax.

log P(word | history) = log P(class | features) + log P(word | class, features).
Features are hashed: the word before, the pair of words before (n-grams), and
the words second and third before (skips). The most frequent words are in
classes of ``CLASS_SIZE`` with a softmax inside; classes and weight rows grow
with the square roots of the vocabulary and of the tokens, until the tables have
``MOST_WEIGHTS`` numbers, which a task must hold twice. All other words belong to open classes by their last bytes; inside an open class a word has its share of
the class's corpus count, add-one smoothed with one place for unseen words, so
the model sums to one with no bound on the vocabulary.

Counts come from all training tokens. Training: each partition runs minibatch
AdaGrad over its documents from the shared start, and the weight rows are then
averaged by how often each partition touched them, through a tree of sums. The
number of partitions follows the tokens and the size of the tables, not the cores;
which texts share one is as the table's files are split.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import crc_mod, cut, release

END = b"\n"  # no word holds it
HOT_WORDS = 131_072  # known to every task at most; any other word has about 1/131072 of all tokens or less
CLASS_SIZE, CLASSES, OPEN = 64, 16, 16  # CLASSES and ROWS at least
IN_MODEL = CLASS_SIZE * CLASSES
START = HOT_WORDS + OPEN
ROWS = 1 << 15
MOST_WEIGHTS = 1 << 28  # one GiB
BLOCK = 1024  # weight rows that travel together
LN10 = float(np.log(10))


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and 0x09 to 0x0D, A-Z in lower case; the end token last."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def open_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % OPEN


def open_class_of(word: str) -> Column:
    """``open_class`` of a column on the JVM."""
    return (F.crc32(F.expr(f"substring({word}, -3, 3)")) % OPEN).cast("int")


class Ids(dict):
    """Number of a word: its rank if hot, else a number for its open class."""

    def __missing__(self, word: bytes) -> int:
        return HOT_WORDS + open_class(word)


@dataclass
class Lexicon:
    """What every task knows of the corpus: the hot words with counts, and totals."""

    hot: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    open_tokens: np.ndarray
    open_distinct: np.ndarray
    n_classes: int = CLASSES
    n_rows: int = ROWS

    @property
    def in_model(self) -> int:
        return CLASS_SIZE * self.n_classes

    def prepare(self) -> None:
        in_model = self.in_model
        self.ids = Ids(zip(self.hot, range(len(self.hot))))
        self.classes = np.zeros(START + 1, np.int32)
        n = len(self.hot)
        self.classes[: min(n, in_model)] = np.arange(min(n, in_model)) // CLASS_SIZE
        self.classes[in_model:n] = [self.n_classes + open_class(w) for w in self.hot[in_model:]]
        self.classes[HOT_WORDS : HOT_WORDS + OPEN] = self.n_classes + np.arange(OPEN)
        inside = np.full(in_model, -1e9)
        inside[: min(n, in_model)] = np.log(self.counts[:in_model])
        self.word_bias = inside.reshape(self.n_classes, CLASS_SIZE).astype(np.float32)
        mass = np.exp(self.word_bias.astype(np.float64)).sum(1)
        whole = np.concatenate([mass, self.open_tokens + 1.0])
        self.class_bias = np.where(whole > 0, np.log(np.maximum(whole, 1e-300)), -1e9).astype(np.float32)
        self.base = np.log10((self.counts + 1) / (self.tokens + self.distinct + 1))
        share = np.zeros(START + 1)
        if n > in_model:
            j = self.classes[in_model:n] - self.n_classes
            share[in_model:n] = np.log10((self.counts[in_model:] + 1) / (self.open_tokens + self.open_distinct + 1)[j])
        self.share = share


def word_counts(docs: DataFrame, keep: int = 200_000) -> DataFrame:
    """(word, n) over all texts; tasks add up before the shuffle, with ``keep`` words in hand."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(words(text))
                if len(held) > keep:
                    yield rows()
                    held.clear()
        yield rows()

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def sizes(tokens: int, distinct: int) -> tuple[int, int]:
    """Classes and weight rows (a power of two) for a corpus of so many tokens and distinct words."""
    classes = min(HOT_WORDS // CLASS_SIZE, max(CLASSES, math.isqrt(distinct) // 32))
    rows = max(ROWS, 1 << (math.isqrt(tokens) * 8 - 1).bit_length() if tokens else 0)
    while rows > ROWS and rows * (classes + OPEN + CLASS_SIZE) > MOST_WEIGHTS:
        rows //= 2
    return classes, rows


def gather_lexicon(counts: DataFrame) -> Lexicon:
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    # the least step of a fine scale of counts above which there are no more than HOT_WORDS words; of the next step a share, by hash
    step = F.floor(F.log2("n") * 8)
    steps = sorted(((r["s"], r["v"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("v")).collect()), reverse=True)
    above, wanted = 0, F.lit(False)
    for s, v in steps:
        if above + v > HOT_WORDS:
            part = int((HOT_WORDS - above) / v * 0.98 * (1 << 30))
            wanted = wanted | ((step == s) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < part))
            break
        above += v
        wanted = step >= s
    table = counts.where(wanted).toArrow()  # about HOT_WORDS rows at most
    hot = sorted(zip(table.column("word").to_pylist(), table.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))[:HOT_WORDS]
    names, n = [w for w, _ in hot], np.array([c for _, c in hot], np.float64)
    tokens, distinct = np.zeros(OPEN), np.zeros(OPEN)
    for r in counts.groupBy(open_class_of("word").alias("j")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["j"]], distinct[r["j"]] = r["n"], r["v"]
    n_classes, n_rows = sizes(int(totals["n"] or 0), int(totals["v"] or 0))
    in_model = n_classes * CLASS_SIZE
    for w, c in zip(names[:in_model], n[:in_model]):
        tokens[open_class(w)] -= c
        distinct[open_class(w)] -= 1
    return Lexicon(names, n, int(totals["n"] or 0), int(totals["v"] or 0), tokens, distinct, n_classes, n_rows)


def positions(ids: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Target and the three words before it, for every place of the texts."""
    pad = np.full(3, START, np.int64)
    flat = np.concatenate([x for a in ids for x in (pad, a)])
    lengths = np.array([len(a) for a in ids])
    ends = np.cumsum(lengths + 3)
    at = np.arange(lengths.sum()) + np.repeat(ends - np.cumsum(lengths), lengths)
    return flat[at], [flat[at - 1], flat[at - 2], flat[at - 3]]


def hashed(before: list[np.ndarray]) -> list[np.ndarray]:
    """64-bit hashes of the features of each place; a third word before that isn't given is before the start."""
    a, b, c = (x.astype(np.uint64) for x in [*before, np.full(len(before[0]), START)][:3])
    m1, m2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    raw = [a * m1, (b + np.uint64(1 << 21)) * m1, (a * m2 + b + np.uint64(1 << 40)) * m1, (c + np.uint64(1 << 22)) * m1]
    return [(x ^ (x >> np.uint64(29))) * m2 for x in raw]


def rows_of(hashes: list[np.ndarray], salt: np.ndarray | None = None, n_rows: int = ROWS) -> list[np.ndarray]:
    """Weight rows of ``n_rows``, a power of two; ``salt`` parts the rows of one class from those of another."""
    if salt is not None:
        s = (salt.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        hashes = [(h ^ s) * np.uint64(0x9E3779B97F4A7C15) for h in hashes]
    shift = np.uint64(65 - n_rows.bit_length())
    return [(h >> shift).astype(np.uint16 if n_rows <= 1 << 16 else np.uint32) for h in hashes]


def probabilities(weights: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    z += bias
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def descend(weights, squares, touched, rows, p, target, rate) -> None:
    """One AdaGrad step on the mean loss of a minibatch; ``p`` is used up.

    ``rate`` is for three features and 32 columns: features add up, and the mean square of a gradient falls with unused columns.
    """
    rate = rate * 3 / len(rows) * (32 / p.shape[1]) ** 0.5
    p[np.arange(len(p)), target] -= 1

    def step(which, g, n):
        squares[which] += np.einsum("ij,ij->i", g, g) / g.shape[1]
        touched[which] += n
        g *= (rate / np.sqrt(squares[which] + 1e-6))[:, None]
        weights[which] -= g

    for r in rows:
        order = np.argsort(r, kind="stable")
        sorted_rows = r[order]
        starts = np.nonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))[0]
        n = np.diff(np.append(starts, len(r)))
        once = n == 1  # rows of one place need no sum
        step(sorted_rows[starts[once]], p.take(order[starts[once]], axis=0), 1)
        if not once.all():
            many = n[~once]
            g = p.take(order[np.repeat(~once, n)], axis=0)
            step(sorted_rows[starts[~once]], np.add.reduceat(g, np.cumsum(many) - many, axis=0), many)


def learn(texts: Iterator[list[str | None]], lexicon: Lexicon, start: list[np.ndarray], batch: int = 8192, rate: float = 0.15) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Weights after one pass over the texts, and how often each row was touched."""
    tables = [w.copy() for w in start]
    squares = [np.zeros(len(w), np.float32) for w in tables]
    touched = [np.zeros(len(w), np.float32) for w in tables]
    get = lexicon.ids.__getitem__
    held: list[np.ndarray] = []

    def run():
        target, before = positions(held)
        for a in range(0, len(target), batch):
            t, hashes = target[a : a + batch], hashed([x[a : a + batch] for x in before])
            cls = lexicon.classes[t]
            rows = rows_of(hashes, n_rows=lexicon.n_rows)
            descend(tables[0], squares[0], touched[0], rows, probabilities(tables[0], rows, lexicon.class_bias), cls, rate)
            inside = np.nonzero(t < min(len(lexicon.hot), lexicon.in_model))[0]
            if len(inside):
                c = cls[inside]
                rows = rows_of([h[inside] for h in hashes], c, lexicon.n_rows)
                descend(tables[1], squares[1], touched[1], rows, probabilities(tables[1], rows, lexicon.word_bias[c]), t[inside] % CLASS_SIZE, rate)

    size = 0
    for group in texts:
        for text in group:
            held.append(np.fromiter(map(get, words(text)), np.int64))
            size += len(held[-1])
            if size >= 8 * batch:
                run()
                held.clear()
                size = 0
    if held:
        run()
    return tables, touched


def fresh(n_classes: int = CLASSES, n_rows: int = ROWS) -> list[np.ndarray]:
    return [np.zeros((n_rows, n_classes + OPEN), np.float32), np.zeros((n_rows, CLASS_SIZE), np.float32)]


def train(docs: DataFrame, lexicon: Lexicon, rounds: int = 1, fan_in: int = 16, tokens_per_part: int = 2_500_000, tokens_per_weight: float = 0.5) -> list[np.ndarray]:
    """Weight tables after ``rounds`` passes of distributed updates over all texts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon)
    tables = fresh(lexicon.n_classes, lexicon.n_rows)
    for _ in range(rounds):
        start = spark.sparkContext.broadcast(tables)

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
            known = shared.value
            known.prepare()
            got = learn((b["text"].tolist() for b in batches), known, start.value)
            part = TaskContext.get().partitionId()
            for k, (w, n) in enumerate(zip(*got)):
                for b in range(0, len(w), BLOCK):
                    if n[b : b + BLOCK].any():
                        moved = w[b : b + BLOCK] - start.value[k][b : b + BLOCK]
                        yield pd.DataFrame({"part": [part], "tab": [k], "block": [b // BLOCK], "w": [moved.astype("<f4").tobytes()], "n": [n[b : b + BLOCK].astype("<f4").tobytes()]})

        schema = "part int, tab int, block int, w binary, n binary"
        texts = docs.select(F.col("text").cast("string").alias("text"))
        # a partition gives tables, so larger tables take more tokens: what travels stays in proportion to the input
        least = max(tokens_per_part, int(tokens_per_weight * sum(t.size for t in tables)))
        texts = texts.coalesce(max(1, -(-lexicon.tokens // least)))
        parts = max(1, texts.rdd.getNumPartitions())
        sums = texts.mapInPandas(local, schema)  # not written: what goes up the tree is shuffled by block at once

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part")
            first = pdf.iloc[0]
            ns = [np.frombuffer(x, "<f4").astype(np.float64) for x in pdf["n"]]
            n = sum(ns)
            w = sum(np.frombuffer(x, "<f4").reshape(BLOCK, -1) * m[:, None] for x, m in zip(pdf["w"], ns)) / np.maximum(n, 1)[:, None]
            return pd.DataFrame({"part": [first.part // fan_in], "tab": [first.tab], "block": [first.block], "w": [w.astype("<f4").tobytes()], "n": [n.astype("<f4").tobytes()]})

        while parts > 1:  # fan_in blocks meet in a task, however many partitions there are
            sums = cut(sums.groupBy("tab", "block", F.floor(F.col("part") / fan_in)).applyInPandas(add, schema))
            parts = -(-parts // fan_in)
            release(spark)
        for r in sums.toLocalIterator():  # the tables: 2 * n_rows rows
            w = np.frombuffer(r["w"], "<f4").reshape(BLOCK, -1)
            tables[r["tab"]][r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += w
        del sums
        release(spark)  # the parts' weights, before the words of the texts are shuffled
    return tables


def log10_model(ids: list[np.ndarray], lexicon: Lexicon, tables: list[np.ndarray], batch: int = 16_384) -> np.ndarray:
    """Model part of each text's log10 probability, without the shares of words that aren't hot."""
    target, before = positions(ids)
    out = np.zeros(len(target))
    for a in range(0, len(target), batch):
        t, hashes = target[a : a + batch], hashed([x[a : a + batch] for x in before])
        cls = lexicon.classes[t]
        p = probabilities(tables[0], rows_of(hashes, n_rows=lexicon.n_rows), lexicon.class_bias)
        value = np.log10(np.maximum(p[np.arange(len(t)), cls], 1e-30)) + lexicon.share[t]
        inside = np.nonzero(t < min(len(lexicon.hot), lexicon.in_model))[0]
        if len(inside):
            c = cls[inside]
            p = probabilities(tables[1], rows_of([h[inside] for h in hashes], c, lexicon.n_rows), lexicon.word_bias[c])
            value[inside] += np.log10(np.maximum(p[np.arange(len(inside)), t[inside] % CLASS_SIZE], 1e-30))
        out[a : a + batch] = value
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])[:-1]
    return np.add.reduceat(out, starts)


PARTIAL = "doc_id long, mark long, size long, word binary, n long, head long, n_tokens long, n_known long, base double, score double"


def score(docs: DataFrame, counts: DataFrame, lexicon: Lexicon, tables: list[np.ndarray]) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row; a null text counts as empty.

    A task gives one row for a text and one for each of its words that aren't
    hot; those meet the count table by word. Rows that are equal in doc_id and
    text are added up together and parted again, so repeated rows come back as
    often as they came.
    """
    sc = docs.sparkSession.sparkContext
    shared, weights = sc.broadcast(lexicon), sc.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tabs = shared.value, weights.value
        known.prepare()
        get = known.ids.__getitem__
        names = [f.split()[0] for f in PARTIAL.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                docs_, marks, sizes = (part.column(i).to_pylist() for i in (0, 1, 2))
                split = [words(t) for t in part.column(3).to_pylist()]
                ids = [np.fromiter(map(get, w), np.int64, len(w)) for w in split]
                model = log10_model(ids, known, tabs)
                cols: list[list] = [[] for _ in names]
                for k, (w, x) in enumerate(zip(split, ids)):
                    hot = x[x < HOT_WORDS]
                    rest = Counter([w[i] for i in np.nonzero(x >= HOT_WORDS)[0].tolist()])
                    head = (docs_[k], marks[k], sizes[k], b"\n%d %d" % (docs_[k] or 0, marks[k]), 0, 1, len(w), len(hot), float(known.base[hot].sum()), float(model[k]))
                    for c, v in zip(cols, head):
                        c.append(v)
                    m = len(rest)
                    for c, v in zip(cols, ([docs_[k]] * m, [marks[k]] * m, [sizes[k]] * m, rest.keys(), rest.values(), [0] * m, [0] * m, [0] * m, [0.0] * m, [0.0] * m)):
                        c.extend(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(text, F.lit(""))), F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), text)
    partial = slim.mapInArrow(run, PARTIAL)
    c = F.coalesce("c", F.lit(0))
    whole = float(lexicon.tokens + lexicon.distinct + 1)
    inside = F.array(*[F.lit(float(x)) for x in lexicon.open_tokens + lexicon.open_distinct + 1])
    j = open_class_of("word")
    rest = F.col("head") == 0
    met = partial.join(counts.withColumnRenamed("n", "c"), "word", "left").select(
        "doc_id", "mark", "size", "head", "n_tokens",
        F.when(rest & (c > 0), F.col("n")).otherwise(F.col("n_known")).alias("n_known"),
        F.when(rest, F.col("n") * F.log10((c + 1) / F.lit(whole))).otherwise(F.col("base")).alias("base"),
        F.when(rest, F.col("n") * F.log10((c + 1) / F.get(inside, j))).otherwise(F.col("score")).alias("score"),
    )
    summed = met.groupBy("doc_id", "mark", "size").agg(*[F.sum(x).alias(x) for x in ("head", "n_tokens", "n_known", "base", "score")])
    each = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("head"))))
    k = F.col("head")
    return each.select(
        "doc_id", (F.col("n_tokens") / k).cast("long").alias("n_tokens"), (F.col("n_known") / k).cast("long").alias("n_known"),
        (F.col("base") / k).alias("base_score"), (F.col("score") / k).alias("score"),
    )


def fit_and_score(docs: DataFrame, training: DataFrame, rounds: int = 1) -> DataFrame:
    """Counts and weights from ``training``, scores of ``docs``. Without training rows every base score is 0."""
    counts = cut(word_counts(training))
    lexicon = gather_lexicon(counts)
    return score(docs, counts, lexicon, train(training, lexicon, rounds)).withColumn("train_tokens", F.lit(lexicon.tokens).cast("long"))


def op1_maxent_scoring(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_mod("doc_id", 7) == 2
    scored = fit_and_score(docs, docs.where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
