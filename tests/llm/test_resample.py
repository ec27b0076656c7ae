"""Importance resampling against brute force; runs of suffix arrays against plain n-grams."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quernel.llm import resample, words

TEXTS = [(1, "The the THE fox"), (2, None), (3, ""), (4, "  ,;\n "), (5, "été ÉTÉ été 12 a-b a_b"), (None, "fox fox " * 30), (7, "x " * 60_000), (7, "x y z " * 9), (8, "same words here " * 8), (9, "same words here " * 8), (9, "same words here " * 8), (10, "word" * 500_000)]
ROWS = TEXTS + [(100 + i, " ".join(f"w{(i * k + k) % 37}" for k in range(1, 5 + i % 40))) for i in range(120)]
TARGET = ["the fox w1 w2 w3 w5", None, "", "w7 w7 w7 fox"]


def grams(text, most):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, most=1, buckets=10_000, percent=10, least=20, seed=2024):
    hashed = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            counts.update(map(hashed, grams(x, most)[1]))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    out = []
    for d, x in rows:
        w, g = grams(x, most)
        weight = sum(gain(hashed(f)) for f in g)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(order[: percent * len(order) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("most,buckets,percent,least", [(1, 10_000, 10, 20), (2, 97, 50, 3), (3, 1000, 100, 0)])
def test_draws(spark, most, buckets, percent, least):
    df = spark.createDataFrame([(*r, "x", 1.5, 1) for r in ROWS], "doc_id long, text string, Score string, weight double, `a.b` int").repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    out = resample.resample(df, target, most_words=most, buckets=buckets, percent=percent, least_words=least)
    assert out.columns == ["doc_id", "text", "a.b", "n_words", "n_features", "weight", "score", "rank"]
    got = [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(brute(ROWS, TARGET, most, buckets, percent, least), key=repr)


def test_empty_tables(spark):
    none, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resample.resample(none, target).collect() == []
    some = resample.resample(spark.createDataFrame(ROWS, "doc_id long, text string"), target)
    assert sorted([(r["doc_id"], r["weight"], r["rank"]) for r in some.collect()], key=repr) == sorted([(d, w, k) for d, _, w, _, k in brute(ROWS, [])], key=repr)


def test_runs_of_suffix_arrays():
    """Each place gets the bucket of its n-gram, none goes over the end of a text, and each n-gram is hashed once."""
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 4, r.integers(0, 30))) for _ in range(20)]
    found = words.words(pa.array(texts), words.WORD)
    vocabulary = [v.decode() for v in found.vocabulary.to_pylist()]
    for size, (places, hashed) in enumerate(resample.scattered(found, 4, 1 << 20), 1):
        want = {}
        for k in range(len(texts)):
            a, b = found.first[k], found.first[k + 1]
            for p in range(a, b - size + 1):
                want[p] = zlib.crc32(" ".join(vocabulary[i] for i in found.ids[p : p + size]).encode()) % (1 << 20)
        assert dict(zip(places.tolist(), hashed.tolist())) == want


def test_slices_hold_all_texts():
    texts = pa.array(["a" * 3_000_000, None, "b" * 3_000_000, "c" * 9_000_000, "", "d"])
    cuts = list(words.slices(texts))
    assert [a for a, _ in cuts] == [0, *np.cumsum([n for _, n in cuts])[:-1]] and sum(n for _, n in cuts) == 6 and len(cuts) >= 3
    assert list(words.slices(pa.array([], pa.string()))) == []
