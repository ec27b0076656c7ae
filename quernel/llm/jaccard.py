"""N-gram Jaccard self-join by chosen paths, exact where a pair is found.

A text's set holds the hashes of its runs of five words (of all its words, if
fewer). Equal sets are one class, joined once. A class is embedded as ``WIDTH``
tokens (position, least hash), of which two classes share about their Jaccard
similarity. Each run walks a tree of chosen paths: at a node every set is split
on the same two sampled positions, sets that share the token go on together;
buckets of at most ``small`` classes are compared by brute force on the
embedding, larger ones lose what is much like their head and are split again, and
what is still together at the last depth is compared as it is. A pair of similarity
0.8 stays together in a run with probability 0.93 at least at any depth; all runs
share one embedding, over whose errors ``runs`` of 5 miss about 2 pairs in 100,000,
and the comparison by the embedding, at 0.55, fewer still.

Buckets only give edges of candidate components (one less than there are
members, never all pairs). Components are then verified on the exact sets, as
``verified`` says: small ones as one block; in a large one every member is compared
with a pivot, which settles most pairs by the triangle inequality of Jaccard
distances, and what that leaves open is compared in blocks. Links are counted where
they are found and only a spanning forest of them goes on, so no row stands for a
pair of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import aside, claim, cut, cut_small, may_hold, meet, release
from quernel.llm.components import connected_components

WORDS = 5
WIDTH = 64
THRESHOLD = 0.8
BRANCHES = 2
SETS = "doc_id long, text_hash long, key binary, size long, sig binary"
_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_hashes = WordHashes()


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``n`` lower-case words; of its only run if it has fewer; none without words."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(29)))


def signature(s: np.ndarray) -> np.ndarray:
    """Least hash of the set at each of ``WIDTH`` positions."""
    out = np.full(WIDTH, 0xFFFFFFFF, np.uint64)
    for a in range(0, len(s), 4096):
        out = np.minimum(out, ((s[None, a : a + 4096] * _MULTIPLIERS[:, None]) >> np.uint64(32)).min(axis=1))
    return out.astype("<u4")


def set_key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def set_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard", _hashes.clear)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                sets = [shingles(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["doc_id", "text_hash", "key", "size", "sig"],
                )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), text).mapInArrow(run, SETS)


def mixed(*parts: int) -> int:
    x = 0
    for p in parts:
        x = ((x ^ p) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 29
    return x


def positions(run: int, path: int) -> list[int]:
    """The positions that a node of a run is split on."""
    out: list[int] = []
    k = 0
    while len(out) < BRANCHES:
        p = mixed(run + 1, path & 0xFFFFFFFFFFFFFFFF, k) % WIDTH
        if p not in out:
            out.append(p)
        k += 1
    return out


def split_further(rows: DataFrame, first_runs: int | None = None) -> DataFrame:
    """Children (bucket, run, key, sig) of rows; of the roots of ``first_runs`` runs for classes, without sig."""
    root = first_runs is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key")
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(-1, WIDTH)
            if first_runs is not None:
                todo = [(r, 0, np.arange(len(keys))) for r in range(first_runs)]
            else:
                runs, paths = batch.column("run").to_numpy(), batch.column("bucket").to_numpy()
                _, where = np.unique(paths, return_inverse=True)
                todo = [(int(runs[rows_[0]]), int(paths[rows_[0]]), rows_) for rows_ in np.split(np.argsort(where, kind="stable"), np.cumsum(np.bincount(where))[:-1])] if len(paths) else []
            for r, path, rows_ in todo:
                for p in positions(r, path):
                    salt = np.uint64(mixed(r + 1, path & 0xFFFFFFFFFFFFFFFF, 1000 + p))
                    h = (sigs[rows_, p].astype(np.uint64) ^ salt) * np.uint64(0xC2B2AE3D27D4EB4F)
                    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                    at = pa.array(rows_)
                    out = [pa.array((h ^ (h >> np.uint64(29))).astype(np.int64)), pa.array(np.full(len(rows_), r, np.int32)), keys.take(at)]
                    names = ["bucket", "run", "key"]
                    if not root:
                        out.append(batch.column("sig").take(at))
                        names.append("sig")
                    yield pa.RecordBatch.from_arrays(out, names)

    return rows.mapInArrow(run, "bucket long, run int, key binary" + ("" if root else ", sig binary"))


def in_groups(df: DataFrame, by: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """``fn`` on each group of rows equal in ``by``. For many small groups: a task sorts its rows and takes the groups as they come."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None

        def whole(parts):
            return fn(parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True))

        for f in frames:
            if not len(f):
                continue
            change = (f[by] != f[by].shift()).any(axis=1).to_numpy()
            change[0] = last is not None and tuple(f[by].iloc[0]) != last
            starts = np.nonzero(change)[0].tolist()
            edges = [0, *[s for s in starts if s], len(f)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                if (k or change[0]) and held:
                    if (got := whole(held)) is not None and len(got):
                        yield got
                    held = []
                held.append(f.iloc[a:b])
            last = tuple(f[by].iloc[-1])
        if held and (got := whole(held)) is not None and len(got):
            yield got

    return df.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, schema)


def forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of an undirected graph, as (root, member) edges."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(int(a)), find(int(b))
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(find(x), x) for x in range(n) if find(x) != x]


EDGES = "a binary, b binary"


def alike(pdf: pd.DataFrame, least: float) -> pd.DataFrame | None:
    """Edges between classes of a small bucket whose embeddings agree in a share of ``least``."""
    sigs = np.frombuffer(b"".join(pdf["sig"]), "<u4").reshape(-1, WIDTH)
    near = np.concatenate([(sigs[a : a + 64, None, :] == sigs[None, :, :]).sum(axis=2) >= least * WIDTH for a in range(0, len(sigs), 64)])
    found = forest(len(pdf), np.argwhere(np.triu(near, 1)))
    keys = pdf["key"].tolist()
    return pd.DataFrame({"a": [keys[x] for x, _ in found], "b": [keys[y] for _, y in found]}) if found else None


NEAR = 0.45  # of embeddings; by it a row hangs on its bucket's head
#: A partner of similarity THRESHOLD that isn't near the head keeps a row at least 1 - NEAR - (1 - THRESHOLD) from it;
#: the rest allows for the errors of two estimates.
CORE = NEAR + (1 - THRESHOLD) + 0.1


def judge(rows: DataFrame) -> DataFrame:
    """Add ``like``: how a row's embedding agrees with that of its bucket's head, 2 in ``CORE``, 1 in ``NEAR``, 0 in less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "run", "key", "sig", "head"]
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, WIDTH) for c in ("sig", "head_sig"))
            same = (a == b).mean(axis=1) if len(a) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array((same >= NEAR).astype(np.int32) + (same >= CORE))], [*names, "like"])

    return rows.mapInArrow(run, "bucket long, run int, key binary, sig binary, head binary, like int")


def candidate_edges(classes: DataFrame, n: int, runs: int, small: int, depth: int, least: float) -> DataFrame:
    """Edges whose components hold every pair of the ``n`` classes that some run kept together.

    In a large bucket all that is near the head hangs on it. What is at the
    head's core then leaves: by the triangle inequality of Jaccard distances its
    partners are near the head too. So groups of near copies are peeled off and
    only the rest is split further.
    """
    order = F.xxhash64("key", "bucket")  # another head in every bucket of a class
    rows, edges, size = split_further(classes, runs), None, n * runs * BRANCHES
    for level in range(depth):
        if level:
            heads = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by(F.struct("key", "sig"), order).alias("h")).where("n > 1")
            met = meet(rows, heads.select("bucket", "n", F.col("h.key").alias("head"), F.col("h.sig").alias("head_sig")), ["bucket"], size)
        else:
            heads = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("key", order).alias("head")).where("n > 1")
            # a class's embedding comes to those rows only that share their bucket
            met = meet(rows, heads, ["bucket"], size).join(classes.select("key", "sig"), "key")
        met = cut_small(met, size, let_go=True)
        found = in_groups(met.where(F.col("n") <= small).select("bucket", "key", "sig"), ["bucket"], lambda pdf: alike(pdf, least), EDGES)
        edges = found if edges is None else edges.unionByName(found)
        large = met.where(F.col("n") > small)
        if not large.take(1):
            return edges
        if not level:
            first = large.where("key = head").select("bucket", F.col("sig").alias("head_sig"), "n").dropDuplicates(["bucket"])
            large = meet(large.drop("n"), first, ["bucket"], size)
        last = level == depth - 1
        judged = cut_small(judge(large.select("bucket", "run", "key", "sig", "head", "head_sig")), size)
        hung = judged.where(F.lit(last) | (F.col("like") > 0)).where("key != head")
        edges = edges.unionByName(hung.select(F.col("head").alias("a"), F.col("key").alias("b")))
        if last:
            return edges
        kept = judged.where("like < 2")
        size = BRANCHES * kept.count()
        rows = cut_small(split_further(kept.select("bucket", "run", "key", "sig")), size)  # read twice
    return edges


def bundled(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of the same components: each b hangs on the least of its heads, which hangs on the others.

    A class has one head a bucket at most, so the heads of a class are a bounded
    list. In a group of near copies most classes have the same few heads in many
    buckets: what they say of these is one edge, however many say it.
    """
    heads = edges.groupBy("b").agg(F.min("a").alias("a"), F.collect_set("a").alias("heads"))
    others = heads.where(F.size("heads") > 1).select("a", F.explode("heads").alias("b")).where("a != b").distinct()
    return heads.select("a", "b").unionByName(others)


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of ``x`` shares with each of ``y``."""
    if len(x) * len(y) <= 16:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in y] for a in x])
    tokens, where = np.unique(np.concatenate(x + y), return_inverse=True)
    owner = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in x + y])
    in_x = np.bincount(where[owner < len(x)], minlength=len(tokens)) > 0
    in_y = np.bincount(where[owner >= len(x)], minlength=len(tokens)) > 0
    shared = np.nonzero(in_x & in_y)[0]
    place = np.full(len(tokens), -1)
    place[shared] = np.arange(len(shared))
    column = place[where]
    ok = column >= 0
    owner, column = owner[ok], column[ok]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(x), len(y)), np.float64)
    step = 4096
    cuts = np.searchsorted(column, np.arange(0, len(shared) + step, step))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        m = np.zeros((len(x) + len(y), step), np.float32)
        m[owner[a:b], column[a:b] - k * step] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return out


LINKS = "key binary, other binary, links long"


def verify(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame | None:
    """Links inside a block, or between two: rows (key, null, rows linked to) and forest edges (key, other, 0)."""
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    pdf = pdf.drop_duplicates("key")
    left = pdf[pdf["block"] == i]
    right = left if i == j else pdf[pdf["block"] == j]
    if not len(left) or not len(right):
        return None
    x, y = ([np.frombuffer(s, "<u8") for s in f["shingles"]] for f in (left, right))
    both = common_counts(x, y)
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    hit = both >= threshold * (nx[:, None] + ny[None, :] - both) - 1e-9
    mx, my = left["copies"].to_numpy(), right["copies"].to_numpy()
    kx, ky = left["key"].tolist(), right["key"].tolist()
    if i == j:
        np.fill_diagonal(hit, False)
        pairs, names, sums = np.argwhere(np.triu(hit, 1)), kx, [(kx, hit @ my)]
    else:
        pairs = np.argwhere(hit) + np.array([0, len(kx)])
        names, sums = kx + ky, [(kx, hit @ my), (ky, mx @ hit)]
    if not len(pairs):
        return None
    edges = forest(len(names), pairs)
    rows = [(k, None, int(n)) for ks, ns in sums for k, n in zip(ks, ns) if n] + [(names[b], names[a], 0) for a, b in edges]
    return pd.DataFrame(rows, columns=["key", "other", "links"])


def fetch_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The exact set of each wanted class (key, text_hash, ...), from one text that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            ok = pa.array([set_key(s) == k for s, k in zip(sets, batch.column("key").to_pylist())])
            names = [n for n in batch.schema.names if n != "text"]
            kept = pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([s.tobytes() for s in sets], pa.binary())], [*names, "shingles"])
            yield kept.filter(ok)

    text = F.col("text").cast("string")
    texts = docs.select(F.xxhash64(text).alias("h"), F.crc32(text).alias("c"), F.octet_length(text).alias("size"), text.alias("text"))
    # one of equal texts, before they meet their class; texts that only share the hash stay apart, and ``run`` tells which has the set
    some = may_hold(texts, wanted.select(F.col("text_hash").alias("h"))).groupBy("h", "c", "size").agg(F.min("text").alias("text"))
    one = wanted.join(some.withColumnRenamed("h", "text_hash").drop("c", "size"), "text_hash").select(*wanted.columns, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.select(*wanted.columns).schema) + ", shingles binary"
    return one.mapInArrow(run, schema)


CELLS = 10  # parts of the greatest distance of a link; a member's cell is its distance from the pivot in such parts


def distances(members: DataFrame, threshold: float) -> DataFrame:
    """Add ``cell`` to members (..., shingles, pivot_shingles): distance from the pivot in parts of (1 - threshold) / ``CELLS``."""
    part = (1 - threshold) / CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for s, p in zip(batch.column("shingles").to_pylist(), batch.column("pivot_shingles").to_pylist()):
                x, y = np.frombuffer(s, "<u8"), np.frombuffer(p, "<u8")
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                cells.append(int((1 - both / (len(x) + len(y) - both)) / part))
            names = [n for n in batch.schema.names if n != "pivot_shingles"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(cells, pa.int32())], [*names, "cell"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema if f.name != "pivot_shingles") + ", cell int"
    return members.mapInArrow(run, schema)


def settled(big: DataFrame, n: int, threshold: float, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(link rows, tasks for ``verify``, members that stay open) of large components of ``n`` members together.

    Distances obey the triangle inequality. So two members whose distances from
    the pivot add up to no more than a link's are linked: these are counted by
    cells. Two whose distances differ by more are not. Other pairs with one member
    within a link's distance are compared, in blocks of a cell; pairs farther out
    are left open, for another pivot.
    """
    chosen = big.where("key = pivot").select("component", F.col("shingles").alias("pivot_shingles"), "n")
    near = cut_small(distances(meet(big.drop("n"), chosen, ["component"], n).drop("n"), threshold), n, rows_per_part=20_000)
    cells = near.groupBy("component", "cell").agg(F.count("*").alias("n"), F.sum("copies").alias("in_cell"))
    cells = cells.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    all_cells = cells.groupBy("component").agg(F.collect_list(F.struct("cell", "in_cell", "blocks")).alias("cells"))  # a fixed number of cells at most
    sure = F.filter("cells", lambda x: x["cell"] + F.col("cell") + 2 <= CELLS)
    asked = F.filter("cells", lambda x: (x["cell"] + F.col("cell") + 2 > CELLS) & (F.abs(x["cell"] - F.col("cell")) < CELLS + 2) & (F.least(x["cell"], "cell") < CELLS))
    other = lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda k: (x["cell"] * (1 << 20) + k).cast("int"))
    told = cells.join(all_cells, "component").select(
        "component", "cell", "n", "blocks", F.aggregate(sure, F.lit(0).cast("long"), lambda t, x: t + x["in_cell"]).alias("sure"), F.flatten(F.transform(asked, other)).alias("others"),
    )
    rows = meet(near, told, ["component", "cell"], n)
    rows = rows.withColumn("block", (F.col("cell") * (1 << 20) + F.pmod(F.xxhash64("key"), F.col("blocks"))).cast("int"))
    within = F.col("cell") * 2 + 2 <= CELLS  # a member's own copies are among the sure ones
    counted = rows.where("sure > 0").select("key", F.lit(None).cast("binary").alias("other"), (F.col("sure") - F.when(within, F.col("copies")).otherwise(0)).alias("links"))
    hung = rows.where((F.col("cell") + 2 <= CELLS) & (F.col("key") != F.col("pivot"))).select("key", F.col("pivot").alias("other"), F.lit(0).cast("long").alias("links"))
    tasks = rows.withColumn("with", F.explode("others")).select(
        "component", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "key", "copies", "shingles"
    )
    return counted.where("links > 0").unionByName(hung), tasks, near.where(F.col("cell") >= CELLS)


def verified(members: DataFrame, n: int, threshold: float, block: int, pivots: int) -> DataFrame:
    """``LINKS`` among ``n`` members (component, key, copies, shingles): every link once for each of its ends, and a spanning forest.

    A component of up to ``block`` members is one block. In a larger one ``pivots``
    balls are settled, one after another; what is then still open is compared in
    blocks, each with every other of its component.
    """
    still, out, level = members, None, 0
    while True:
        sizes = still.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("copies")).alias("c"), "key")).alias("first"))
        told = cut_small(meet(still, sizes.select("component", "n", F.col("first.key").alias("pivot")), ["component"], n), n, rows_per_part=20_000)
        zero = F.lit(0)
        tasks = told.where(F.col("n") <= block).select("component", zero.alias("i"), zero.alias("j"), zero.alias("block"), "key", "copies", "shingles")
        big = told.where(F.col("n") > block)
        rest = found = None
        if big.take(1):
            if level < pivots:
                found, more, rest = settled(big, n, threshold, block)
            else:
                parts = F.ceil(F.col("n") / block).cast("int")
                dealt = big.withColumn("block", F.pmod(F.xxhash64("key"), parts).cast("int")).withColumn("with", F.explode(F.sequence(zero, parts - 1)))
                more = dealt.select("component", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "key", "copies", "shingles")
            tasks = tasks.unionByName(more)
        links = in_groups(tasks, ["component", "i", "j"], lambda pdf: verify(pdf, threshold), LINKS)
        links = cut_small(links if found is None else links.unionByName(found), 3 * n, let_go=True)
        out = links if out is None else out.unionByName(links)
        if rest is None:
            return out
        still, level = rest.select(F.concat("component", F.lit("+").cast("binary")).alias("component"), "key", "copies", "shingles"), level + 1


def jaccard_join(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, copy_class, class_id, n_links) of every row; see ``groups``."""
    return groups(docs, **params).select("doc_id", "copy_class", "class_id", "n_links")


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one row of each group of linked texts: the least doc_id, null last, then the least text hash.

    Rows whose text has no words are in no group and stay; of rows equal in
    doc_id and text the one whose other columns come first as JSON stays.
    """
    docs, names = aside(docs, ["doc_id", "text"])
    last = F.lit((1 << 63) - 1)
    told = groups(docs, **params).select(F.coalesce("doc_id", last).alias("__d"), "text_hash", "group")
    kept = told.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct("__d", "text_hash")).alias("k")).select("k.*")
    kept = kept.unionByName(told.where("group IS NULL").select("__d", "text_hash")).distinct().withColumnRenamed("text_hash", "__t")
    rows = docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), last), "__t": F.xxhash64(F.col("text").cast("string"))})
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    row = F.min_by(F.struct(*docs.columns), order).alias("row")
    return rows.join(kept, ["__d", "__t"], "left_semi").groupBy("__d", "__t").agg(row).select("row.*").toDF(*names)


def groups(docs: DataFrame, threshold: float = THRESHOLD, runs: int = 5, small: int = 512, depth: int = 5, block: int = 256, margin: float = 0.25, pivots: int = 3) -> DataFrame:
    """(doc_id, text_hash, group, copy_class, class_id, n_links) of every row.

    ``group`` is a key that all rows of a component share, null without words.

    ``copy_class``: least doc_id among rows of the same set of five-word runs.
    ``class_id``: least doc_id of the connected component of links; a link is a
    Jaccard similarity of ``threshold`` or more. ``n_links``: rows linked to this
    one, copies included. Texts without words, null ones too, link to nothing
    and are their own class. A null doc_id stays null and is the least only of
    classes without another. Repeated rows are copies of each other.
    """
    rows = cut(set_rows(docs))
    n = rows.count()
    classes = cut_small(
        rows.where("key IS NOT NULL").groupBy("key").agg(F.min("text_hash").alias("text_hash"), F.count("*").alias("copies"), F.min("doc_id").alias("copy_class"), F.min("sig").alias("sig")), n
    )
    edges = candidate_edges(classes.select("key", "sig"), n, runs, small, depth, threshold - margin)
    grouped = connected_components(bundled(edges), n * runs * BRANCHES).withColumnRenamed("node", "key")
    placed = grouped.join(classes.select("key", "text_hash", "copies"), "key").select("key", "text_hash", "copies", "component")
    members = cut_small(fetch_sets(docs, placed), n, rows_per_part=20_000, let_go=True)
    found = verified(members.drop("text_hash"), n, threshold, block, pivots)
    release(docs.sparkSession)
    links = found.where("other IS NULL").groupBy("key").agg(F.sum("links").alias("links"))
    linked = connected_components(found.where("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")), 3 * n).withColumnRenamed("node", "key")
    named = linked.join(classes.select("key", "copy_class"), "key")
    least = named.groupBy("component").agg(F.min("copy_class").alias("class_id"), F.count("*").alias("n"))
    by_key = meet(named.select("key", "component"), least, ["component"], n).select("key", "class_id", F.col("component").alias("group"))
    about = classes.select("key", "copies", "copy_class").join(by_key, "key", "left").join(links, "key", "left")
    about = cut_small(about.select("key", "copies", F.coalesce("group", "key").alias("group"), "copy_class", F.coalesce("class_id", "copy_class").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links")), n)
    columns = ["doc_id", "text_hash", "group", "copy_class", "class_id", "n_links"]
    told = meet(rows.where("key IS NOT NULL").select("doc_id", "text_hash", "key"), about, ["key"], n, "copies").select(*columns)
    alone = rows.where("key IS NULL").select("doc_id", "text_hash", F.lit(None).cast("binary").alias("group"), F.col("doc_id").alias("copy_class"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return told.unionByName(alone)


def op5_ngram_jaccard(spark, sf_dir):
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows by counting the common runs of all pairs that have one.
OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
lists AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
keys AS (SELECT doc_id, len(g) AS n, CASE WHEN len(g) > 0 THEN md5(array_to_string(list_sort(g), '|')) ELSE 'none' || doc_id END AS k FROM lists),
s AS (SELECT doc_id, unnest(g) AS g FROM lists),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN keys p ON p.doc_id = x JOIN keys q ON q.doc_id = y WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
reach AS (SELECT doc_id AS x, doc_id AS y FROM keys UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
labels AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY 1)
SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS copy_class, class_id, (SELECT count(*) FROM links WHERE x = keys.doc_id) AS n_links FROM keys JOIN labels USING (doc_id)
"""
