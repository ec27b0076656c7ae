"""Near-duplicate groups far larger than a bucket, at the default parameters, against all pairs."""

import numpy as np

from quernel.llm import jaccard


def all_links(texts, threshold=0.8):
    """Links of each text, from the products of token indicators."""
    sets = [jaccard.shingles(t) for t in texts]
    tokens, where = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros((len(sets), len(tokens)), np.float32)
    held[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), where] = 1
    both, n = held @ held.T, held.sum(1)
    return (both >= threshold * (n[:, None] + n[None, :] - both) - 1e-6).sum(1) - 1


def near_copies(r, n, words=120, most=6):
    base = [f"b{r.integers(9999)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(int(r.integers(0, most))):
            w[int(r.integers(words))] = f"x{r.integers(10**6)}"
        out.append(" ".join(w))
    return out


def test_recall_in_large_groups(spark):
    """Four groups of 700 near copies, some pairs above and some below the threshold: every link is found."""
    r = np.random.default_rng(9)
    texts = [t for _ in range(4) for t in near_copies(r, 700)] + [" ".join(f"w{r.integers(5000)}" for _ in range(60)) for _ in range(400)]
    want = all_links(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = np.array([r["n_links"] for r in sorted(jaccard.jaccard_join(df).collect(), key=lambda r: r["doc_id"])])
    assert (got <= want).all() and got.sum() >= 0.9999 * want.sum() and 0 < want[:2800].mean() < 699


def test_pivots_settle_what_blocks_would(spark):
    """One pivot, several and none give the same links."""
    r = np.random.default_rng(2)
    texts = near_copies(r, 60) + near_copies(r, 50, words=90, most=9) + near_copies(r, 30, words=40, most=12)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = all_links(texts).tolist()
    for pivots in (0, 1, 4):
        got = {r["doc_id"]: r["n_links"] for r in jaccard.jaccard_join(df, block=8, pivots=pivots, margin=0.5).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_classes_of_a_group_share_their_heads_edges(spark, monkeypatch):
    """However many buckets of a large group a class is in, one edge of its own goes on to the components."""
    r = np.random.default_rng(4)
    texts = near_copies(r, 500)
    met, components = [], jaccard.connected_components

    def counted(edges, bound):
        met.append(edges.count())
        return components(edges, bound)

    monkeypatch.setattr(jaccard, "connected_components", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in jaccard.jaccard_join(df, small=128).collect()}
    assert [got[i] for i in range(len(texts))] == all_links(texts).tolist()
    assert met[0] <= 2 * len(texts)
