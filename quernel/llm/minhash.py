"""Near-duplicate groups by one-permutation MinHash, bands and stars.

A text's set holds the hashes of its word shingles. The hashes' range is cut into
``BINS`` equal parts; the least hash of each part is the signature (one permutation
for all bins). A bin without a hash takes the value of the first bin with one in an
order of its own (optimal densification), so it agrees between two sets with their
similarity whatever their sizes. ``ROWS`` bins are a band, and equal bands a bucket.

Equal sets are one node. A bucket gives edges from its members to one centre, never
pairs: each node meets the least centres of all its buckets, and, if asked for, in
buckets that still hold several components each member meets other centres in
rounds. Edges are checked on signatures, which drops what is far from similar, then
on the full sets. What the stars leave apart is settled exactly: nodes that share
rare shingles are found by these, and for all others what isn't rare bounds their
similarity, so that few of a bucket's pairs are left to compare. They are compared
inside blocks, which give links between components and no row for a pair. So no link
of two nodes with a common bucket is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import cut, cut_small, may_hold, meet, release, table
from quernel.llm.components import connected_components
from quernel.llm.jaccard import in_groups
from quernel.llm.words import NOT_SPACE, map_texts, quoted, words

SHINGLE = 2
PERCENT = 80
#: A pair of similarity 0.8 has no common bucket with probability (1 - 0.8 ** 6) ** 40 = 5e-6.
ROWS = 6
BANDS = 40
BINS = ROWS * BANDS
#: The stars that a node is first an end of: those of the least centres of its buckets.
CENTRES = 3
#: More star rounds in the buckets that hold several components; blocks of that many members do the rest.
STARS = 0
BLOCK = 1024
#: A shingle that so many nodes have at most is rare among what the stars left apart.
RARE = 64
#: A signature's share of equal bins is off by 0.026 at 0.8; pairs 4.5 times that below aren't links, but for 3 in a million.
SURELY_LESS = 0.8 - 4.5 * 0.026
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: For each bin the order in which it looks for a bin with a hash.
_LOOKS = np.argsort(np.random.default_rng(13).random((BINS, BINS)), axis=1).astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts one after the other, and where each text's begin."""
    import xxhash

    found = words(texts, NOT_SPACE)
    first, n = found.first, np.diff(found.first)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in found.vocabulary.to_pylist()], np.uint64)
    w = hashes[found.ids] if len(hashes) else np.zeros(0, np.uint64)
    of, left = np.repeat(np.arange(len(n)), n), np.repeat(first[1:], n) - np.arange(len(w))
    parts, owners = [], []
    for k in range(1, size + 1):  # a text of fewer words than a shingle is one shingle
        at = np.flatnonzero(left >= size) if k == size else first[:-1][n == k]
        h = np.full(len(at), k, np.uint64)
        for i in range(k):
            h = h * _ODD + w[at + i]
        parts.append(mixed(h))
        owners.append(of[at])
    h, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(n) + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of ``BINS`` values for each set; all zero for an empty one."""
    rows = len(first) - 1
    owner = np.repeat(np.arange(rows), np.diff(first))
    place = owner * BINS + (((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    heads = np.flatnonzero(np.diff(place, prepend=-1))  # hashes are sorted: the first of a bin is its least
    sig, held = np.zeros(rows * BINS, np.uint64), np.zeros(rows * BINS, bool)
    sig[place[heads]], held[place[heads]] = h[heads], True
    sig, held = sig.reshape(rows, BINS), held.reshape(rows, BINS)
    r, c = np.nonzero(~held & (first[1:] > first[:-1])[:, None])
    for look in range(BINS):
        if not len(r):
            break
        there = _LOOKS[c, look]
        hit = held[r, there]
        sig[r[hit], c[hit]] = sig[r[hit], there[hit]]
        r, c = r[~hit], c[~hit]
    return sig


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def described(texts: pa.Array, size: int) -> dict:
    h, first = sets(texts, size)
    sig = signatures(h, first)
    bands = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(sig), axis=0)
    for i in range(ROWS):
        bands = mixed(bands * _ODD + sig[:, i::ROWS])
    some = first[1:] > first[:-1]
    at = np.arange(len(sig) + 1) * BANDS
    return {
        "digest": [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if a < b else None for a, b in zip(first[:-1].tolist(), first[1:].tolist())],
        "n_shingles": np.diff(first), "bands": lists(bands.reshape(-1), at), "sketch": [s if o else None for s, o in zip(map(bytes, (sig & np.uint64(255)).astype(np.uint8)), some)],
    }


def may_link(a, b, common, percent: int):
    """Whether sets of sizes a and b with so many common shingles at most may be similar enough."""
    return 100 * common >= percent * (a + b - common)


def equal_bins(percent: int) -> float:
    """So many bins of the sketches of a link are equal at least; a byte is equal by chance once in 256."""
    return BINS * ((SURELY_LESS - (0.8 - percent / 100)) * (1 - 1 / 256) + 1 / 256)


def linked(edges: DataFrame, nodes: DataFrame, members: DataFrame, percent: int, bound: int) -> DataFrame:
    """The edges (a, b) whose sets have a Jaccard similarity of ``percent`` or more; b may be the end of any number of them."""
    ends = edges.groupBy("b").agg(F.count("*").alias("n"))
    signs = nodes.select("node", "sketch", "n_shingles")

    def near(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
            same = (a == b).sum(axis=1) if len(a) else np.zeros(0)
            yield batch.filter(pa.array(same >= equal_bins(percent))).select([0, 1])

    rows = edges.join(signs.select(F.col("node").alias("a"), F.col("sketch").alias("s"), F.col("n_shingles").alias("x")), "a")
    there = ends.join(signs.select(F.col("node").alias("b"), F.col("sketch").alias("o"), F.col("n_shingles").alias("y")), "b")
    both = meet(rows, there, ["b"], bound).where(may_link(F.col("x"), F.col("y"), F.least("x", "y"), percent))
    rows = cut(both.select("a", "b", "s", "o").mapInArrow(near, "a long, b long"))
    ends = rows.groupBy("b").agg(F.count("*").alias("n"))
    rows = rows.join(members.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    there = ends.join(members.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    both = meet(rows, there, ["b"], bound).withColumn("common", F.size(F.array_intersect("x", "y")).cast("long"))
    return both.where(may_link(F.size("x"), F.size("y"), F.col("common"), percent)).select("a", "b")


def sets_of(docs: DataFrame, text: str, wanted: DataFrame, size: int) -> DataFrame:
    """(node, set) for nodes (node, t1, t2), from one text of each."""
    texts = docs.select(F.col(quoted(text)).cast("string").alias("t")).withColumns(text_keys("t"))
    texts = may_hold(texts.withColumn("h", F.col("t1")), wanted.select(F.col("t1").alias("h"))).drop("h")
    one = texts.groupBy("t1", "t2").agg(F.first("t").alias("t")).join(wanted, ["t1", "t2"])
    return map_texts(one, "t", ["node"], "set array<long>", lambda t: {"set": lists(*sets(t, size))})


def text_keys(text: str) -> dict:
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(13), F.col(text))}


def labels(links: DataFrame, bound: int) -> DataFrame:
    return cut_small(connected_components(links, bound), bound, let_go=True)


def apart(live: DataFrame, label: DataFrame, bound: int) -> DataFrame:
    """(band, node, component, n) of the buckets, of n members, that hold several components."""
    rows = live.select("band", "node").join(label, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    several = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    return cut(meet(rows, several, ["band"], bound).select("band", "node", "component", "n"))


def similar_nodes(nodes: DataFrame, docs: DataFrame, text: str, size: int, percent: int, bound: int, stars: int = STARS, block: int = BLOCK) -> DataFrame:
    """(node, component) of nodes that are linked with another."""
    bands = nodes.select("node", F.explode("bands").alias("band"))
    buckets = cut(bands.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1"))
    some = may_hold(bands.withColumn("h", F.col("band")), buckets.select(F.col("band").alias("h"))).drop("h")
    live = cut(meet(some, buckets, ["band"], bound * BANDS).select("band", "node", "centre"))
    least = F.slice(F.array_sort(F.collect_set("centre")), 1, CENTRES)  # a node has ``BANDS`` centres at most
    edges = live.where("node != centre").groupBy("node").agg(least.alias("least")).select(F.col("node").alias("a"), F.explode("least").alias("b"))
    wanted = live.select("node").distinct().join(nodes.select("node", "t1", "t2"), "node")
    members = cut(sets_of(docs, text, wanted, size))
    links = cut_small(linked(cut(edges), nodes, members, percent, bound * CENTRES), bound * CENTRES)
    label = labels(links, bound * CENTRES)
    live = live.select("band", "node")
    for turn in range(stars + 1):
        live = apart(live, label, bound * BANDS)
        left = live.count()
        if not left:
            break
        if turn < stars:
            # of the other centres of a node's buckets those that come first; the order is the nodes' own, so buckets have the same centres
            p = F.xxhash64(F.lit(turn), F.col("node"))
            centres = live.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct(p.alias("p"), F.col("node").alias("b"), F.col("component").alias("other"))).alias("first"))
            met = meet(live.drop("n"), centres, ["band"], left).where(F.col("component") != F.col("first.other"))
            first = F.slice(F.array_sort(F.collect_set(F.struct("first.p", "first.b"))), 1, CENTRES)
            edges = cut(met.groupBy("node").agg(first.alias("first")).select(F.col("node").alias("a"), F.explode("first.b").alias("b")))
            n = max(1, edges.count())
            found = linked(edges, nodes, members, percent, n)
        else:
            listed, rows = blocks(live, nodes, members, percent, block)
            n = max(1, listed.count())
            found = linked(listed, nodes, members, percent, n).unionByName(rows)
        found = cut_small(found, max(n, left))
        new = found.count()
        if new:
            links = cut_small(links.unionByName(found), bound * CENTRES + new, let_go=True)
            label = labels(links, bound * CENTRES + new)
    release(docs.sparkSession)
    return label


def rare_pairs(held: DataFrame, rare: int) -> tuple[DataFrame, DataFrame]:
    """Of nodes and their shingles (node, h): how many of a node's shingles ``rare`` nodes have at most (node, rare), and how many of these two nodes share (a, b, shared)."""
    few = held.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") <= rare).select("h")
    rows = cut(may_hold(held, few).join(few, "h"))
    nodes = F.array_sort(F.collect_list("node"))  # ``rare`` of them at most
    lists = rows.groupBy("h").agg(nodes.alias("nodes")).where(F.size("nodes") > 1)
    pairs = F.flatten(F.transform("nodes", lambda x, i: F.transform(F.slice("nodes", i + 2, F.lit(rare)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    shared = lists.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("shared"))
    return rows.groupBy("node").agg(F.count("*").alias("rare")), shared


def blocks(live: DataFrame, nodes: DataFrame, members: DataFrame, percent: int, block: int, rare: int = RARE) -> tuple[DataFrame, DataFrame]:
    """(a, b): the pairs of nodes in different components that share rare shingles and may be similar enough; and links between the components of all others.

    Two nodes have in common the rare shingles that lists of their nodes tell, and at
    most as many others as the one with fewer has. Pairs that share rare ones come
    from those lists; of the rest the members of a bucket's largest component meet
    the others only, in blocks, and a pair is compared if what isn't rare may be enough.
    """
    label = live.groupBy("node").agg(F.min("component").alias("component"))
    held = members.join(label.select("node"), "node", "left_semi").select("node", F.explode("set").alias("h"))
    counts, shared = rare_pairs(held, rare)
    about = label.join(nodes.select("node", "n_shingles", "bands", "sketch"), "node").join(counts, "node", "left")
    about = cut(about.select("node", "component", "bands", "sketch", F.col("n_shingles").alias("size"), (F.col("n_shingles") - F.coalesce("rare", F.lit(0))).alias("common")))
    ends = [about.select(F.col("node").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("component", "size", "common")]) for n in ("a", "b")]
    enough = may_link(F.col("size_a"), F.col("size_b"), F.least("common_a", "common_b") + F.col("shared"), percent)
    listed = cut(shared.join(ends[0], "a").join(ends[1], "b").where((F.col("component_a") != F.col("component_b")) & enough).select("a", "b"))
    rows = cut(live.select("band", "node").join(about.where(may_link(F.col("size"), F.col("common"), F.col("common"), percent)).select("node", "component"), "node"))
    parts = rows.groupBy("band", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("band").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("all"))
    main = main.select("band", F.col("m.component").alias("main"), *[F.ceil(n / block).cast("int").alias(name) for name, n in (("few", F.col("all") - F.col("m.n")), ("many", F.col("all")))], F.col("all").alias("n")).where("few > 0")
    rows = meet(rows, main, ["band"], 1 << 62)
    deal = lambda to: F.pmod(F.xxhash64("node", "band"), F.col(to)).cast("int")
    over = lambda to: F.explode(F.sequence(F.lit(0), F.col(to) - 1))
    left = rows.where("component != main").select("band", "node", F.lit(True).alias("left"), deal("few").alias("i"), over("many").alias("j"))
    right = rows.select("band", "node", F.lit(False).alias("left"), deal("many").alias("j"), over("few").alias("i")).select(*left.columns)
    whole = left.unionByName(right).join(about.join(members, "node"), "node")
    return listed, in_groups(whole, ["band", "i", "j"], lambda pdf: compared(pdf, percent), "a long, b long")


def compared(pdf: pd.DataFrame, percent: int) -> pd.DataFrame | None:
    """Links (a, b) that join the components of a block's left and right nodes, as few as do it; a pair of several common buckets is met in the first of them."""
    x, y = pdf[pdf["left"]], pdf[~pdf["left"]]
    if not len(x) or not len(y):
        return None
    band = np.int64(pdf["band"].iloc[0])
    (sx, sy), (bx, by) = ([np.frombuffer(b"".join(f["sketch"]), np.uint8).reshape(-1, BINS) for f in (x, y)], [np.stack(f["bands"].to_list()) for f in (x, y)])
    (nx, ny), (px, py), (cx, cy), (ax, ay), (hx, hy) = ([f[c].to_numpy() for f in (x, y)] for c in ("size", "common", "component", "node", "set"))
    at, least = int(np.flatnonzero(bx[0] == band)[0]), equal_bins(percent)
    top: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := top.get(c, c)) != c:
            top[c] = top.get(up, up)
            c = up
        return c

    found = []
    for k in range(0, len(x), 32):
        part = slice(k, k + 32)
        may = (cx[part, None] != cy[None]) & may_link(nx[part, None], ny[None], np.minimum(px[part, None], py[None]), percent)
        i, j = np.nonzero(may)
        i += k
        for step in range(0, len(i), 8192):
            p, q = i[step : step + 8192], j[step : step + 8192]
            ok = (sx[p] == sy[q]).sum(axis=1) >= least
            p, q = p[ok], q[ok]
            ok = (bx[p] == by[q]).argmax(axis=1) == at
            for u, v in zip(p[ok].tolist(), q[ok].tolist()):
                r, s = find(int(cx[u])), find(int(cy[v]))
                if r != s and may_link(int(nx[u]), int(ny[v]), len(np.intersect1d(hx[u], hy[v], assume_unique=True)), percent):
                    top[max(r, s)] = min(r, s)
                    found.append((ax[u], ay[v]))
    return pd.DataFrame(found, columns=["a", "b"]) if found else None


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    A set holds the distinct runs of ``shingle`` words (parted by ASCII white space,
    A-Z lowered), or the only run of a text that has fewer. Rows whose sets have a
    Jaccard similarity of ``percent`` / 100 or more are linked; component_id is the
    least key that links reach, kept tells whether that is the row's own. Null, empty
    and blank texts have no set and no link. Repeated rows are copies of each other;
    rows that share a key with different texts are rows of their own. A null key is
    the least only where no row has another. Texts are taken whole, of any length.
    """
    given = docs.select(F.col(quoted(key)).cast("long").alias("key"), F.col(quoted(text)).cast("string").alias("t"))
    keys = given.withColumns(text_keys("t"))
    rows = cut(map_texts(keys, "t", ["key", "t1", "t2"], "digest binary, n_shingles long, bands array<long>, sketch binary", lambda t: described(t, shingle)))
    n = rows.count()
    with_words = rows.where("digest IS NOT NULL")
    one = with_words.groupBy("digest").agg(F.min("key").alias("least"), F.count("*").alias("copies"), F.min(F.struct("t1", "t2", "n_shingles", "sketch", "bands")).alias("r"))
    nodes = cut(one.select(F.monotonically_increasing_id().alias("node"), "digest", "least", "copies", "r.*"))
    label = similar_nodes(nodes, docs, text, shingle, percent, max(1, n))
    named = label.join(nodes.select("node", "least"), "node")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    reached = meet(named.select("node", "component"), least, ["component"], n).select("node", "component_id")
    about = nodes.select("node", "digest", "least", "copies").join(reached, "node", "left").select("digest", "copies", F.coalesce("component_id", "least").alias("component_id"))
    told = meet(with_words.select("key", "n_shingles", "digest"), about, ["digest"], n, "copies").select("key", "n_shingles", "component_id")
    alone = rows.where("digest IS NULL").select("key", "n_shingles", F.col("key").alias("component_id"))
    return told.unionByName(alone).select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same rows by counting the common shingles of all pairs that have one.
OP13_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
lists AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM lists),
often AS (SELECT g, count(*) AS c FROM s GROUP BY g),
ordered AS (SELECT s.*, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS k FROM s JOIN often USING (g)),
heads AS (SELECT * FROM ordered WHERE k <= n - ceil(0.8 * n) + 1),
maybe AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM heads a JOIN heads b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9),
pairs AS (SELECT x, y, len(list_intersect(p.g, q.g)) AS c, len(p.g) + len(q.g) AS n FROM maybe JOIN lists p ON p.doc_id = x JOIN lists q ON q.doc_id = y),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 80 * (n - c) UNION ALL SELECT y, x FROM pairs WHERE 100 * c >= 80 * (n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM lists UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(g) AS n_shingles, component_id, doc_id = component_id AS kept FROM lists JOIN least USING (doc_id)
"""
