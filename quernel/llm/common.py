"""What the operators of this folder share: tables, checkpoints, batches."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_held: dict[str, Callable[[], None]] = {}


def claim(owner: str, clear: Callable[[], None]) -> None:
    """In a worker: ``owner`` is about to fill its caches, so those of other operators are cleared by what they gave here."""
    for other in [o for o in _held if o != owner]:
        _held.pop(other)()
    _held[owner] = clear


def forget(spark: SparkSession) -> None:
    """Let the Python workers drop what operators cached in them, before a step that runs none: a short task for each core.

    Idle workers live on for a minute beside the JVM. A worker that no task reaches keeps its cache, which is bounded.
    """
    cores = spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("", lambda: None)
        gc.collect()
        time.sleep(0.1)  # so that no worker takes two tasks
        yield from batches

    spark.range(0, cores, 1, cores).mapInArrow(run, "id long").count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Unset, a temporary one in local mode only, where all tasks share this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quernel-checkpoint-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there; survives lost executors.

    A checkpoint keeps the size that Spark estimated for its plan. Each join
    multiplies the estimates of its sides, so in a loop their digits would grow
    with the power of the round until the driver's memory is full; here they are dropped.
    """
    checkpoint_dir(df.sparkSession)
    jdf = df.checkpoint(eager=True)._jdf
    return DataFrame(jdf.sparkSession().internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), df.sparkSession)


def cut_small(df: DataFrame, rows: int, rows_per_part: int = 100_000, let_go: bool = False) -> DataFrame:
    """``cut`` of a table of so many rows at most into as few partitions as they need; with ``let_go`` what earlier rounds shuffled is deleted."""
    spark = df.sparkSession
    out = cut(df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_part))))
    if let_go:
        release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing can read any more; it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder, read again; ``discard`` deletes it, or whoever clears the folder."""
    path = f"{checkpoint_dir(df.sparkSession)}/quernel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote; nothing may read it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.rpartition("/")[2].startswith("quernel-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def meet(rows: DataFrame, groups: DataFrame, by: list[str], bound: int, count: str = "n", most: int = 100_000, least: int = 1000, salts: int = 64, look: bool = False) -> DataFrame:
    """Inner join of rows, ``bound`` at most, with a table of one row a key that has the number of the key's rows in ``count``; hot keys are salted.

    Hot is a key with over ``least`` rows and over 1/``most`` of the bound, so there
    are fewer than ``most`` of them: they are broadcast to mark their rows, which
    are dealt over ``salts`` parts, and their groups come to every part. A plan
    reads ``groups`` several times; what it shuffles for them it shuffles once.
    With ``look``, for groups that are written, rows are only marked if some key is hot.
    """
    limit = max(least, bound // most)
    if bound <= least or (look and (groups.agg(F.max(count)).first()[0] or 0) <= limit):
        return rows.join(groups, by)
    hot = F.col(count) > limit
    hot_keys = groups.where(hot).select(*by, F.lit(True).alias("__hot"))  # fewer than ``most`` rows
    names = rows.columns
    place = F.pmod(F.xxhash64(*[c for c in names if c not in by]), F.lit(salts)).cast("int")
    salted = rows.join(F.broadcast(hot_keys), by, "left").withColumn("__salt", F.when(F.col("__hot"), place).otherwise(0)).drop("__hot")
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(groups.withColumn("__salt", F.explode(copies)), [*by, "__salt"]).drop("__salt")


def bitmap(hashes: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """One row with the bits that the hashes (h) set, in longs; its size is fixed. With many hashes it only filters less."""
    at = F.pmod(F.xxhash64("h"), F.lit(bits))
    words = hashes.select(F.shiftrightunsigned(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(h), {bits}) & 63 as int))").alias("b"))
    words = words.groupBy("w").agg(F.expr("bit_or(b)").alias("b"))
    rows = hashes.sparkSession.range(bits // 64).select(F.col("id").alias("w")).join(words, "w", "left")
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))), lambda x: x["b"]).alias("bits"))


def may_hold(rows: DataFrame, hashes: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """Rows whose ``h`` is among the hashes, and a few others: keeps a later join's shuffle small."""
    at = f"pmod(xxhash64(h), {bits})"
    hit = F.expr(f"(shiftrightunsigned(get(bits, cast(shiftrightunsigned({at}, 6) as int)), cast({at} & 63 as int)) & 1L) = 1L")
    return rows.join(F.broadcast(cut(bitmap(hashes, bits))), hit, "left_semi")  # one row of bits / 8 bytes


def aside(df: DataFrame, own: list[str], dropped: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns ``own`` under these names, in whatever letter case they come, and all others as ``__c0``, ``__c1``...; and the names as they were.

    So an operator's own columns clash with none of its input's; ``toDF`` gives the names back. Columns named like one of ``dropped`` are left out.
    """
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in dropped]
    names, place = [df.columns[i] for i in kept], {}
    for name in own:
        found = [c for c in names if c == name] or [c for c in names if c.lower() == name.lower()]
        if not found:
            raise ValueError(f"there is no column {name}")
        place[names.index(found[0])] = name
    slim = df.toDF(*[f"__in{i}" for i in range(len(df.columns))]).select(*[F.col(f"__in{i}").alias(place.get(k, f"__c{k}")) for k, i in enumerate(kept)])
    return slim, names


def crc_mod(column: str, n: int):
    """crc32 of a value as text, modulo ``n``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def arrow_map(
    df: DataFrame, fn: Callable[[list[dict]], dict[str, list]], schema: str, rows: int = 2048
) -> DataFrame:
    """Apply ``fn`` to column lists of at most ``rows`` rows. ``fn`` gets {column: values}, gives the same."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                got = fn({n: part.column(j).to_pylist() for j, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got[f.name], type=f.type) for f in out], schema=out
                )

    return df.mapInArrow(run, schema)
