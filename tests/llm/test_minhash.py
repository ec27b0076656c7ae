"""Near-duplicate groups by one-permutation hashing against all pairs."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from quernel.llm import minhash

ROWS = [
    (1, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (2, "A B c d e f g h i j k l m n o p q r s t u v w x y z"), (3, "a b c d e f g h i j k l m n o p q r s t u v w x y Z1"),
    (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "ONE"), (9, "one two"), (None, "one"), (None, "alone and unlike all others here"), (10, "İ ß 😀 ç x"), (11, "İ ß 😀 ç x"), (11, "İ ß 😀 ç x"),
    (12, "x " * 300_000), (13, "x x"), (14, "a b c"), (3, "quite another text under a number that is there already"),
]


def brute(rows, size=2, percent=80):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), c := least.get(find(i)), d == c) for i, (d, _) in enumerate(rows))


def got(spark, rows, **params):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component string").repartition(3)
    return Counter(tuple(r) for r in minhash.near_duplicates(df, **params).collect())


def test_edges(spark):
    assert got(spark, ROWS) == brute(ROWS)
    assert got(spark, []) == Counter() and got(spark, [(1, None), (2, "")]) == Counter([(1, 0, 1, True), (2, 0, 2, True)])


def test_groups_at_the_limit(spark):
    """Groups in which pairs are just above and just below the limit, stars leave some apart, and others are unlike all."""
    r = np.random.default_rng(5)
    rows = []
    for g, words in enumerate((60, 150, 24)):
        base = [f"g{g}w{r.integers(400)}" for _ in range(words)]
        for _ in range(70):
            w = list(base)
            for _ in range(int(r.integers(0, words // 8))):
                w[int(r.integers(words))] = f"x{r.integers(40)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(f"o{r.integers(300)}" for _ in range(40))) for i in range(60)]
    want = brute(rows)
    assert len({c for _, _, c, _ in want}) > 70
    for params in ({}, {"percent": 70}, {"shingle": 3}):
        assert got(spark, rows, **params) == brute(rows, params.get("shingle", 2), params.get("percent", 80))


def test_signatures_agree_with_similarity():
    """Equal bins are as frequent as the similarity, in small sets too, whose empty bins are filled."""
    r = np.random.default_rng(2)
    for n in (6, 40, 2000):
        shared, rounds = int(n * 0.8), 60
        agree = []
        for _ in range(rounds):
            pool = r.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(pool[:n]), np.sort(pool[n - shared :])
            sig = minhash.signatures(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            agree.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(agree) - shared / (2 * n - shared)) < 0.05
    assert (minhash.signatures(np.zeros(0, np.uint64), np.array([0, 0])) == 0).all()


def test_sets_are_whole():
    h, first = minhash.sets(pa.array(["a b a b", None, "b a", "A\tB\nc", "solo"]), 2)
    sizes = np.diff(first).tolist()
    assert sizes == [2, 0, 1, 2, 1] and set(h[first[2] : first[3]]) < set(h[: first[1]])


def test_no_row_stands_for_a_pair(spark, monkeypatch):
    """Near copies that are nearly all just below the limit: their pairs are compared in blocks, and what goes on grows with the texts."""
    r = np.random.default_rng(8)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for k in range(160):
        w = list(base)
        for p in r.choice(100, int(r.integers(3, 7)), replace=False):
            w[int(p)] = f"x{k}p{p}"
        rows.append((k, " ".join(w)))
    met, linked = [], minhash.linked

    def counted(edges, *rest):
        met.append(edges.count())
        return linked(edges, *rest)

    monkeypatch.setattr(minhash, "linked", counted)
    want = brute(rows)
    assert got(spark, rows) == want and len({c for _, _, c, _ in want}) > 40
    assert sum(met) <= 5 * len(rows)
    met.clear()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash.similar_nodes, "__defaults__", (2, 16))  # star rounds first, then many blocks
    assert Counter(tuple(r) for r in minhash.near_duplicates(df).collect()) == want
