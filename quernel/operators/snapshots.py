"""Snapshots as trees of hashes, and what differs between two of them.

An entry (kind, scope, name, hash) has a place in the tree by the hash of its key.
The lowest nodes hash the entries of a key prefix, every node above the hashes of
its children, two hexadecimal digits of the prefix a level. Two trees are compared
from the root down, and only below nodes whose hashes differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.checkpoint import cut
from quernel.functions.identity import framed

DOMAIN = "ws/q2"
DEPTH = 2
#: The kinds of entries besides files, whose kind is told by the caller.
ENTRY_POINT, VALUE, OBSERVED = "entry-point", "value", "observed"


def entries(kind: Column, name: Column, content: Column, scope: Column | None = None) -> list[Column]:
    """The columns of entries; ``content`` (text or bytes) is hashed, null as empty."""
    return [kind.alias("kind"), (F.lit(None).cast("string") if scope is None else scope).alias("scope"), name.alias("name"), F.sha2(F.coalesce(content.cast("binary"), F.lit(b"")), 256).alias("hash")]


def depth_for(rows: int) -> int:
    """The levels at which the lowest nodes hold about 256 entries at most."""
    depth = 1
    while rows > 256 ** (depth + 1):
        depth += 1
    return depth


def keyed(rows: DataFrame) -> DataFrame:
    """(key, kind, scope, name, hash): an entry for each key; a key that comes twice is an error."""
    scope = F.when(F.col("scope").isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), framed(F.col("scope"))))
    key = F.sha2(F.concat(framed(F.col("kind")), scope, framed(F.col("name"))), 256)
    told = F.concat(F.lit("the snapshot has two entries "), F.coalesce("kind", F.lit("")), F.lit(" "), F.coalesce("name", F.lit("")))
    one = rows.select(key.alias("key"), "kind", "scope", "name", "hash").groupBy("key", "kind", "scope", "name").agg(F.min("hash").alias("hash"), F.count("*").alias("n"))
    return one.withColumn("hash", F.when(F.col("n") == 1, F.col("hash")).otherwise(F.raise_error(told))).drop("n")


def tree(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(level, node, hash, n) of ``keyed`` entries: all nodes but those without entries; the root is level 0 and the empty prefix."""
    joined = lambda a, b: F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(a, b))), ""), 256).alias("hash")
    lowest = rows.groupBy(F.left("key", F.lit(2 * depth)).alias("node")).agg(joined("key", "hash"), F.count("*").alias("n"))
    levels = [cut(lowest)]
    for level in range(depth - 1, -1, -1):
        levels.append(levels[-1].groupBy(F.left("node", F.lit(2 * level)).alias("node")).agg(joined("node", "hash"), F.sum("n").alias("n")))
    out = None
    for level, nodes in enumerate(reversed(levels)):
        told = nodes.select(F.lit(level).alias("level"), "node", "hash", "n")
        out = told if out is None else out.unionByName(told)
    return out


def identity_of(nodes: DataFrame, *header: str) -> DataFrame:
    """(snapshot, entries): one identity of a tree and what it is a snapshot for; an empty tree has one too."""
    root = nodes.where("level = 0").agg(F.coalesce(F.max("hash"), F.lit("")).alias("hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"))
    parts = [*map(F.lit, header), F.col("hash"), F.col("entries").cast("string")]
    return root.select(F.concat(F.lit(DOMAIN + ":"), F.sha2(F.concat(*map(framed, parts)), 256)).alias("snapshot"), "entries")


def workspace_snapshot(files: DataFrame, values: DataFrame | None = None, entry_point: tuple[str, str] | None = None, depth: int = DEPTH) -> DataFrame:
    """(snapshot, entries) of files (kind, path, content), values (kind, scope, name, value) and the selected entry point (kind, path).

    The order of rows doesn't count. A path of a kind, or a value of a kind, name and
    scope, that comes twice is an error. Null contents count as empty ones.
    """
    rows = files.select(*entries(F.concat(F.lit("file/"), "kind"), F.col("path"), F.col("content")))
    if values is not None:
        rows = rows.unionByName(values.select(*entries(F.concat(F.lit(VALUE + "/"), "kind"), F.col("name"), F.col("value"), F.col("scope"))))
    if entry_point is not None:
        one = files.sparkSession.createDataFrame([entry_point], "k string, p string")
        rows = rows.unionByName(one.select(*entries(F.concat(F.lit(ENTRY_POINT + "/"), "k"), F.col("p"), F.lit(None).cast("string"))))
    return identity_of(tree(keyed(rows), depth), "workspace")


def query_snapshot(observed: DataFrame, query: str, mode: str, depth: int = DEPTH) -> DataFrame:
    """(snapshot, entries) of what one query saw: its text and mode, and each path with the status and content that it had."""
    about = F.concat(framed(F.col("status")), F.coalesce(F.col("content").cast("binary"), F.lit(b"")))
    return identity_of(tree(keyed(observed.select(*entries(F.lit(OBSERVED), F.col("path"), about))), depth), "query", query, mode)


def _unequal(old: DataFrame, new: DataFrame, level: int, below: DataFrame | None) -> DataFrame:
    """(node): those of a level whose hashes differ, of the children of ``below`` if given."""
    a, b = (t.where(F.col("level") == level).select("node", "hash", F.left("node", F.lit(2 * (level - 1))).alias("up")) for t in (old, new))
    if below is not None:
        a, b = (t.join(below, t["up"] == below["node"], "left_semi") for t in (a, b))
    both = a.select("node", F.col("hash").alias("x")).join(b.select("node", F.col("hash").alias("y")), "node", "full")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).select("node")


def unequal_nodes(old: DataFrame, new: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(node): the lowest nodes that differ; a level is read only below nodes of the level above that do."""
    found = None
    for level in range(depth + 1):
        found = _unequal(old, new, level, found)
    return found


def difference(old: DataFrame, new: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, scope, name, change) between ``keyed`` entries: added, removed or changed; those of nodes with equal hashes are never joined."""
    nodes = cut(unequal_nodes(tree(old, depth), tree(new, depth), depth))
    return _changes(*(rows.join(nodes, F.left(rows["key"], F.lit(2 * depth)) == nodes["node"], "left_semi") for rows in (old, new)))


def _changes(old: DataFrame, new: DataFrame) -> DataFrame:
    a, b = old.select("key", F.struct("kind", "scope", "name").alias("a"), F.col("hash").alias("x")), new.select("key", F.struct("kind", "scope", "name").alias("b"), F.col("hash").alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed")
    both = a.join(b, "key", "full").withColumn("change", change).where("change IS NOT NULL")
    return both.select(F.coalesce("a", "b").alias("e"), "change").select("e.*", "change")


def write(rows: DataFrame, folder: str, depth: int = DEPTH) -> None:
    """Keep a snapshot: its tree, and its entries in a folder for each node of the first level."""
    cut(tree(rows, depth)).write.mode("errorifexists").parquet(f"{folder}/tree")
    top = F.left("key", F.lit(2))
    rows.withColumn("top", top).repartition(top).write.mode("errorifexists").partitionBy("top").parquet(f"{folder}/entries")


def written_difference(spark: SparkSession, old: str, new: str) -> DataFrame:
    """``difference`` of kept snapshots of one depth; only the folders of first-level nodes that differ are read."""
    trees = [spark.read.parquet(f"{f}/tree") for f in (old, new)]
    depths = [t.agg(F.max("level")).first()[0] for t in trees]
    if depths[0] != depths[1]:
        raise ValueError(f"snapshots of depths {depths} can't be compared")
    tops = [r["node"] for r in _unequal(*trees, 1, _unequal(*trees, 0, None)).collect()]  # 256 at most
    nodes = unequal_nodes(*trees, depths[0])
    sides = [spark.read.schema("key string, kind string, scope string, name string, hash string, top string").parquet(f"{f}/entries").where(F.col("top").isin(tops)) for f in (old, new)]
    return _changes(*(s.join(nodes, F.left(s["key"], F.lit(2 * depths[0])) == nodes["node"], "left_semi") for s in sides))
