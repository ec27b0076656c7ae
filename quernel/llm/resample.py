"""Importance resampling towards a target: texts are drawn by how much likelier their hashed n-grams are in it.

The n-grams of a slice of texts come from its suffix array over word numbers,
sorted by as many words as the longest n-gram has. Neighbours that share so many
words at least (their longest common prefix) are one run, which is one n-gram: it
is hashed once, and its bucket is written back to all places of the run.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import cut, table
from quernel.llm.words import WORD, Words, map_texts, quoted, slices, words

MOST_WORDS = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024


def suffix_array(ids: np.ndarray, left: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the ``most`` words from there on, and how many of them each shares with the place before it in that order.

    ``left`` tells how many words a place has to the end of its text; n-grams end there.
    """
    columns = []
    for k in range(most):
        ahead = np.full(len(ids), -1, ids.dtype)
        ahead[: len(ids) - k] = ids[k:]
        columns.append(np.where(left > k, ahead, -1))
    order = np.lexsort(columns[::-1])
    shared, still = np.zeros(len(ids), np.int64), np.ones(max(len(ids) - 1, 0), bool)
    for column in columns:
        held = column[order]
        still &= (held[1:] == held[:-1]) & (held[1:] >= 0)
        shared[1:] += still
    return order, shared


def scattered(found: Words, most: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length up to ``most``: the places that have an n-gram of it, and their buckets."""
    ids, first = found.ids, found.first
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(ids))
    order, shared = suffix_array(ids, left, most)
    vocabulary = found.vocabulary.to_pylist()
    for size in range(1, most + 1):
        whole = left[order] >= size
        places, heads = order[whole], np.flatnonzero((shared < size)[whole])
        hashed = np.empty(len(heads), np.int64)
        for i, p in enumerate(places[heads].tolist()):
            gram = vocabulary[ids[p]] if size == 1 else b" ".join([vocabulary[x] for x in ids[p : p + size].tolist()])
            hashed[i] = zlib.crc32(gram) % buckets
        yield places, np.repeat(hashed, np.diff(np.append(heads, len(places))))


def bucket_counts(texts: DataFrame, column: str = "text", most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all n-grams of a column; each task adds its own up, so ``buckets`` rows a task are shuffled at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, size in slices(batch.column(0)):
                for _, hashed in scattered(words(batch.column(0).slice(at, size), WORD), most_words, buckets):
                    total += np.bincount(hashed, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    counted = texts.select(F.col(quoted(column)).cast("string").alias("t")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket floor(1000 ln) of its share in the target over its share in the source, both smoothed by one. ``buckets`` rows come to the driver."""

    def held(counts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets)
        for r in counts.collect():  # ``buckets`` rows at most
            out[r["bucket"]] = r["n"]
        return out

    s, t = held(source), held(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def with_weights(docs: DataFrame, gains: np.ndarray, text: str = "text", keep: list[str] | None = None, most_words: int = MOST_WORDS) -> DataFrame:
    """The columns ``keep`` (all, if None) and n_words, n_features and weight: the sum of the gains of a text's n-grams, 0 without any."""

    def run(texts: pa.Array) -> dict:
        found = words(texts, WORD)
        n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for places, hashed in scattered(found, most_words, len(gains)):
            at_place, there = np.zeros(len(found.ids), np.int64), np.zeros(len(found.ids), np.int64)
            at_place[places], there[places] = gains[hashed], 1
            for total, values in ((weight, at_place), (n, there)):
                upto = np.append(0, np.cumsum(values))
                total += upto[found.first[1:]] - upto[found.first[:-1]]
        return {"n_words": np.diff(found.first), "n_features": n, "weight": weight}

    return map_texts(docs, text, docs.columns if keep is None else keep, "n_words long, n_features long, weight long", run)


def noise(key: str, seed: int) -> Column:
    """A Gumbel draw in thousandths, from seed and key: the highest sums of weight and draw are a sample without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(key)).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, wanted: Column, best_first: list[Column], percent: int) -> DataFrame:
    """``scored`` with rank: 1, 2, 3... in that order for floor(``percent`` / 100) of the rows that are ``wanted``, else null.

    Rows are sorted by ranges; a row's rank is its place in its range after the
    numbers of rows of the ranges before, one for each partition. What orders last
    is where a row was read, so that even a third of all rows alike spreads over ranges.
    """
    rows = cut(scored.withColumn("__in", F.coalesce(wanted, F.lit(False))).withColumn("__read", F.monotonically_increasing_id()))
    ordered = cut(rows.orderBy(F.desc("__in"), *best_first, "__read").withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("n"), F.count_if("__in").alias("wanted")).collect()  # a row for each partition
    before, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["__part"]):
        before[r["__part"]], total = total, total + r["n"]
    drawn = percent * sum(r["wanted"] for r in sizes) // 100
    starts = ordered.sparkSession.createDataFrame(list(before.items()), "__part int, __before long")
    out = ordered.withColumn("__part", part.cast("int")).join(F.broadcast(starts), "__part")  # a row for each partition
    number = F.col("__before") + place + 1
    return out.withColumn("rank", F.when(number <= drawn, number)).drop("__in", "__read", "__at", "__part", "__before")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", key: str = "doc_id", keep: list[str] | None = None, most_words: int = MOST_WORDS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The columns ``keep`` (all, if None) with n_words, n_features, weight, score and rank; drawn are the rows that have a rank.

    Words are runs of ASCII letters and digits and all that isn't ASCII, A-Z lowered;
    features are runs of up to ``most_words`` of them, repeats counted. Null and empty
    texts have none: their weight is 0, they are never drawn if ``least_words`` is
    positive. Equal scores go to the smaller key, null keys last, then to the lesser
    number of features and weight; repeated rows are drawn each for itself. An empty
    target only smooths. Texts are never cut; a slice holds one very long text by
    itself, about 30 bytes for each of its own. A column of the input that is named
    like one of the result is replaced.
    """
    gains = bucket_gains(bucket_counts(docs, text, most_words, buckets), bucket_counts(target, target_text, most_words, buckets), buckets)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "rank")]
    inner = docs.withColumn("__key", F.col(quoted(key)))
    scored = with_weights(inner, gains, text, ["__key", *keep], most_words)
    scored = scored.withColumn("score", F.col("weight") + noise("__key", seed))
    out = ranked(scored, F.col("n_words") >= least_words, [F.desc("score"), F.asc_nulls_last("__key"), F.asc("n_features"), F.asc("weight")], percent)
    return out.drop("__key")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 by its table, which eight halvings of each number below 256 give.
OP11_SQL = r"""
WITH RECURSIVE halved AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END, k + 1 FROM halved WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM halved WHERE k = 8),
texts AS (SELECT 0 AS target, doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 1, NULL, coalesce(text, '') FROM benchmark),
lists AS (SELECT target, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
used AS (SELECT DISTINCT unnest(w) AS w FROM lists),
bytes AS (SELECT w, hex(encode(w)) AS x FROM used),
hashed AS (SELECT w, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT), lambda a, b: xor(a // 256, tab[xor(a % 256, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS b FROM bytes, tab),
places AS (SELECT target, doc_id, unnest(w) AS w FROM lists),
counts AS (SELECT b, sum(CASE WHEN target = 0 THEN 1 ELSE 0 END) AS s, sum(target) AS t FROM places JOIN hashed USING (w) GROUP BY b),
sums AS (SELECT sum(s) AS s, sum(t) AS t FROM counts),
gains AS (SELECT b, floor(1000 * ln((c.t + 1)::DOUBLE * (sums.s + 10000)::DOUBLE / ((c.s + 1)::DOUBLE * (sums.t + 10000)::DOUBLE)))::BIGINT AS g FROM counts c, sums),
weights AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM places JOIN hashed USING (w) JOIN gains USING (b) WHERE target = 0 GROUP BY doc_id),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM lists LEFT JOIN weights USING (doc_id) WHERE target = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank FROM placed
"""
