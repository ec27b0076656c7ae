"""Exact top-k inner products over integer vectors.

Candidates are sorted by falling length into blocks, which are searched in rounds:
the longest block first, then three, twelve and so on. After each round the k-th
score of each query is a lower limit for what follows. Partial sums over the
leading axes of an SVD rotation plus the Cauchy-Schwarz limit of the remaining
axes show which candidates can still enter the result; the exact integer products
of those are computed. Tiles, some blocks of queries against some of candidates,
are dropped before anything is shipped where even the longest vector can't reach
a limit. A tile's candidates and queries meet in one task, which holds the
candidates and takes one block of queries after another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import cut, release

SCALE = 64
NARROW = (1 << 31) - 1  # components up to this are kept as 32-bit integers
LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1
NONE = -(1 << 63)  # below every score
VECTORS = "rid long, vec_id long, x binary, wide boolean, norm double"
BLOCKS = "part int, block long, ids binary, rids binary, xs binary, wide boolean, longest double"
HITS = "q_block long, q_rid long, query_id long, vec_id long, rid long, score long"


def lengths_of(y: np.ndarray) -> np.ndarray:
    """Lengths of rows, without overflow of squares."""
    top = np.maximum(np.abs(y).max(axis=1, initial=0), 1e-300)
    return np.where(np.isfinite(top), top * np.sqrt(((y / top[:, None]) ** 2).sum(1)), np.inf)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(rid, vec_id, x, wide, norm): one row for each vector; ``rid`` tells rows apart.

    ``x`` holds floor(64 * component) as little-endian int32, or the components
    themselves as float64 where those don't fit (``wide``). Null ids, null vectors,
    and vectors with null or non-finite components are left out.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components are nan
            broken = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            good = (broken[offsets[1:]] == broken[offsets[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                y = np.floor(flat * SCALE)
            data, wide, norms = [], [], []
            for i in np.nonzero(good)[0].tolist():
                part = y[offsets[i] : offsets[i + 1]]
                is_wide = not np.all(np.abs(part) <= NARROW)
                data.append((flat[offsets[i] : offsets[i + 1]].astype("<f8") if is_wide else part.astype("<i4")).tobytes())
                wide.append(is_wide)
                norms.append(float(lengths_of(part[None])[0]))
            rows = [pa.array(np.arange(rid, rid + len(data)), pa.int64()), ids.filter(pa.array(good)), pa.array(data, pa.binary()), pa.array(wide, pa.bool_()), pa.array(norms, pa.float64())]
            rid += len(data)
            yield pa.RecordBatch.from_arrays(rows, ["rid", "vec_id", "x", "wide", "norm"])

    slim = df.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))
    return slim.mapInArrow(convert, VECTORS)


def components(data, wide, dim: int) -> np.ndarray:
    """Rows of components before scaling if any is wide, else of integers; shorter ones end in zeros."""
    any_wide = any(wide)
    kind = np.dtype("<f8") if any_wide else np.dtype("<i4")
    if not any_wide and all(len(x) == 4 * dim for x in data):
        return np.frombuffer(b"".join(data), kind).reshape(len(data), dim)
    out = np.zeros((len(data), dim), kind)
    for row, x, w in zip(out, data, wide):
        v = np.frombuffer(x, "<f8" if w else "<i4")
        row[: len(v)] = v / SCALE if any_wide and not w else v
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """The integer components as float64, infinite where they overflow."""
    with np.errstate(over="ignore"):
        return np.floor(x * SCALE) if x.dtype.kind == "f" else x.astype(np.float64)


def integers(x: np.ndarray) -> np.ndarray:
    """The integer components as Python's integers."""
    if x.dtype.kind == "i":
        return x.astype(object)
    rows = [[int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE) for v in row] for row in x.tolist()]
    return np.array(rows, object).reshape(x.shape)


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors of all vectors, from their second moments; dim * dim numbers are gathered."""

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for f in frames:
            m = scaled(components(f["x"].tolist(), f["wide"].tolist(), dim))
            top = np.abs(m).max(axis=1, initial=0)
            m = np.where(np.isfinite(top), 1 / np.maximum(1.0, top / 1e60), 0.0)[:, None] * np.nan_to_num(m, posinf=0, neginf=0)
            total += m.T @ m
        yield pd.DataFrame({"i": range(dim), "row": list(total)})

    rows = vectors.select("x", "wide").mapInPandas(moments, "i int, row array<double>")
    sums = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((dim, dim))
    for r in sums:
        total[r["i"], r["j"]] = r["v"]
    _, axes = np.linalg.eigh((total + total.T) / 2)
    return np.ascontiguousarray(axes[:, ::-1])


def blocks(vectors: DataFrame, dim: int, rows: int, keys: list) -> DataFrame:
    """``BLOCKS`` of ``rows`` vectors at most, in the order of ``keys``."""

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block(f):
            xs = components(f["x"].tolist(), f["wide"].tolist(), dim)
            return pd.DataFrame({"part": [part], "block": [(part << 20) + k], "ids": [f["vec_id"].to_numpy("<i8").tobytes()], "rids": [f["rid"].to_numpy("<i8").tobytes()], "xs": [xs.tobytes()], "wide": [xs.dtype.kind == "f"], "longest": [float(f["norm"].max())]})

        for f in frames:
            held.append(f)
            size += len(f)
            while size >= rows:
                whole = pd.concat(held, ignore_index=True)
                yield block(whole.iloc[:rows])
                k, held, size = k + 1, [whole.iloc[rows:]], size - rows
        if size:
            yield block(pd.concat(held, ignore_index=True))

    n = max(1, -(-vectors.count() // rows))
    return vectors.repartitionByRange(n, *keys).coalesce(n).mapInPandas(gather, BLOCKS)


class Side:
    """A block in a task: ids, row numbers, components, and their rotated forms."""

    def __init__(self, row, dim: int, axes: np.ndarray, lead: int):
        self.ids, self.rids = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.rids, "<i8")
        self.raw = np.frombuffer(row.xs, "<f8" if row.wide else "<i4").reshape(-1, dim)
        self.x = scaled(self.raw)
        with np.errstate(all="ignore"):
            turned = self.x @ axes
            self.lead, self.rest = np.ascontiguousarray(turned[:, :lead]), lengths_of(turned[:, lead:])
        self.norms = lengths_of(self.x)
        self.top = float(np.abs(self.x).max(initial=0))


def exact_products(q: Side, rows: np.ndarray, c: Side, columns: np.ndarray) -> np.ndarray:
    """Integer inner products, held at the ends of 64 bits."""
    size = q.top * c.top * max(1, q.x.shape[1])
    if size < 2**52:  # float64 products and sums are exact integers
        return (q.x[rows] @ c.x[columns].T).astype(np.int64)
    if size < 2**62:
        return q.x[rows].astype(np.int64) @ c.x[columns].astype(np.int64).T
    whole = integers(q.raw[rows]) @ integers(c.raw[columns]).T
    return np.array([[min(max(v, LEAST), MOST) for v in row] for row in whole.tolist()], np.int64).reshape(len(rows), len(columns))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row of ``scores``, ties to the smaller id; ``NONE`` is no score."""
    m = scores.shape[1]
    n = min(k, m)
    limit = np.partition(scores, m - n, axis=1)[:, m - n]
    r, c = np.nonzero((scores >= limit[:, None]) & (scores > NONE))
    order = np.lexsort((ids[c], -scores[r, c], r))
    r, c = r[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep]


def search_pair(q: Side, limits: np.ndarray, c: Side, k: int, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, candidate row, score) of what can reach ``limits``, the k best of each query."""
    with np.errstate(all="ignore"):  # an infinite or undefined limit prunes nothing
        reach = q.norms * c.norms.max()
        live = np.nonzero(~(reach < limits - 1e-9 * reach - 1e-6))[0]
        for a in range(0, len(live), step):
            rows = live[a : a + step]
            bound = q.lead[rows] @ c.lead.T
            bound += q.rest[rows][:, None] * c.rest[None, :]
            able = ~(bound < (limits[rows] - 1e-9 * reach[rows] - 1e-6)[:, None])
            able &= q.rids[rows][:, None] != c.rids[None, :]
            columns = np.nonzero(able.any(0))[0]
            if len(columns):
                exact = exact_products(q, rows, c, columns)
                exact[~able[:, columns]] = NONE
                r, j = best(c.ids[columns], exact, k)
                yield rows[r], columns[j], exact[r, j]


def top_k(
    df: DataFrame,
    k: int = 20,
    query_mod: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = 8192,
    query_rows: int = 1024,
    lead_share: float = 0.5,
    candidate_tile: int = 4,
    query_tile: int = 16,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best integer inner products of each query vector.

    Queries are the rows whose id is divisible by ``query_mod``; candidates are
    all rows but the query's own, so a row that repeats a query's id is one too,
    and a query of its own. Vectors of differing sizes meet as if the shorter
    ended in zeros; an empty vector scores 0 with all. Scores beyond 64 bits are
    held at the ends of the range. With fewer than k candidates all are given;
    without queries or candidates the result is empty. Rows with a null id, a null
    vector, or null or non-finite components take no part.
    """
    spark = df.sparkSession
    vectors = cut(integer_vectors(df, id_col, vector_col))
    size = F.octet_length("x") / F.when(F.col("wide"), 8).otherwise(4)
    dim = max(1, int(vectors.agg(F.max(size)).first()[0] or 1))
    axes = spark.sparkContext.broadcast(rotation(vectors, dim))  # dim * dim numbers
    lead = max(1, int(dim * lead_share))
    # ties of length fall apart by a hash, so many copies of a vector spread over blocks
    candidates = cut(blocks(vectors, dim, block_rows, [F.desc("norm"), F.xxhash64("rid")])).withColumn("c_group", F.floor(F.col("part") / candidate_tile))
    queries = vectors.where(F.pmod("vec_id", F.lit(query_mod)) == 0)
    asked = cut(blocks(queries, dim, query_rows, [F.xxhash64("rid")])).withColumn("q_group", F.floor(F.col("part") / query_tile))

    def limits_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query's k-th score so far, and the length a candidate needs to reach one of the block's."""
        for f in frames:
            limits, need = [], []
            for row in f.itertuples(index=False):
                known = dict(row.known) if row.known is not None else {}
                lim = np.array([known.get(i, -np.inf) for i in np.frombuffer(row.rids, "<i8").tolist()], "<f8")
                norms = lengths_of(scaled(np.frombuffer(row.xs, "<f8" if row.wide else "<i4").reshape(-1, dim)))
                with np.errstate(all="ignore"):
                    least = np.where((lim > 0) & (norms > 0), (lim * (1 - 1e-9) - 1e-6) / norms, -np.inf)
                limits.append(lim.tobytes())
                need.append(float(np.nan_to_num(least, nan=-np.inf, neginf=-np.inf).min(initial=np.inf)))
            yield f[["q_group", "block", "ids", "rids", "xs", "wide"]].assign(limits=limits, need=need)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, held = None, []
        for f in frames:
            for row in f.itertuples(index=False):
                if (row.c_group, row.q_group) != tile:
                    tile, held = (row.c_group, row.q_group), []
                side = Side(row, dim, axes.value, lead)
                if row.limits is None:
                    held.append(side)
                    continue
                limits = np.frombuffer(row.limits, "<f8")
                for c in held:
                    for r, j, s in search_pair(side, limits, c, k):
                        yield pd.DataFrame({"q_block": row.block, "q_rid": side.rids[r], "query_id": side.ids[r], "vec_id": c.ids[j], "rid": c.rids[j], "score": s})

    n_parts = candidates.agg(F.max("part")).first()[0]
    order = Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id", "rid")
    hits, begin, end = None, 0, 1
    while begin <= (n_parts if n_parts is not None else -1):
        if hits is None:
            known = asked.withColumn("known", F.lit(None).cast("array<struct<q_rid:long,score:double>>"))
        else:
            kth = hits.where(F.col("rank") == k).groupBy(F.col("q_block").alias("block")).agg(F.collect_list(F.struct("q_rid", F.col("score").cast("double"))).alias("known"))  # query_rows at most
            known = asked.join(kth, "block", "left")
        limited = known.select("q_group", "block", "ids", "rids", "xs", "wide", "known").mapInPandas(limits_of, "q_group long, block long, ids binary, rids binary, xs binary, wide boolean, limits binary, need double")
        limited = cut(limited)
        some = candidates.where((F.col("part") >= begin) & (F.col("part") < end))
        # the stated queries against all rows, in blocks: a row for each tile that can hold a hit
        tiles = limited.groupBy("q_group").agg(F.min("need").alias("need")).crossJoin(some.groupBy("c_group").agg(F.max("longest").alias("longest")))
        tiles = cut(tiles.where("longest >= need").select("c_group", "q_group"))
        columns = ["c_group", "q_group", "block", "ids", "rids", "xs", "wide", "limits"]
        both = some.withColumn("limits", F.lit(None).cast("binary")).join(tiles, "c_group").select(*columns).unionByName(limited.join(tiles, "q_group").select(*columns))
        both = both.repartition("c_group", "q_group").sortWithinPartitions("c_group", "q_group", F.col("limits").isNotNull(), "block")
        found = both.mapInPandas(search, HITS)
        if hits is not None:
            found = found.unionByName(hits.drop("rank"))
        hits = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        release(spark)
        begin, end = end, 4 * end
    if hits is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return hits.select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same rows from all products.
OP9_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.rid <> c.rid),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
