"""Changed scopes: set algebra over worktree entries and committed changes, and their coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entry_paths(entries: DataFrame) -> DataFrame:
    """Paths of worktree entries (path, original_path, conflict): both names of a rename."""
    return entries.select(F.explode(F.array_compact(F.array("path", "original_path"))).alias("path")).distinct()


def diff_paths(diff: DataFrame) -> DataFrame:
    """Paths of a committed diff (status, path, original_path): a copy gives its new path, a rename both."""
    names = F.when(F.col("status").startswith("R"), F.array("path", "original_path")).otherwise(F.array("path"))
    return diff.select(F.explode(F.array_compact(names)).alias("path")).distinct()


def conflicts(entries: DataFrame) -> DataFrame:
    return entries.where("conflict").select("path").distinct()


def worktree_scope(entries: DataFrame) -> DataFrame:
    return entry_paths(entries).subtract(conflicts(entries))


def merge_base_scope(entries: DataFrame, diff: DataFrame) -> DataFrame:
    return diff_paths(diff).union(entry_paths(entries)).distinct().subtract(conflicts(entries))


def three_dot_scope(entries: DataFrame, diff: DataFrame) -> DataFrame:
    """(path, state): committed paths; those in conflict are told and are no part of the scope."""
    hit = diff_paths(diff).intersect(conflicts(entries)).withColumn("state", F.lit("conflict"))
    return diff_paths(diff).subtract(conflicts(entries)).withColumn("state", F.lit("changed")).unionByName(hit)


def coverage(changed: DataFrame, selectable: DataFrame, observed: DataFrame) -> DataFrame:
    """(path, disposition) of changed paths (path, conflict): failed, excluded, analyzed or remaining, the first that holds.

    ``observed`` has (path, status); a status other than "searched" failed.
    """
    s = selectable.select("path").distinct().withColumn("selectable", F.lit(True))
    o = observed.groupBy("path").agg(F.max("status").alias("status"))
    rule = (
        F.when(F.col("conflict"), "failed").when(F.col("selectable").isNull(), "excluded")
        .when(F.col("status") == "searched", "analyzed").when(F.col("status").isNotNull(), "failed").otherwise("remaining")
    )
    return changed.join(s, "path", "left").join(o, "path", "left").select("path", rule.alias("disposition"))


def dispositions(rows: DataFrame) -> DataFrame:
    """One row of counts that add up to ``considered``."""
    names = ("analyzed", "excluded", "failed", "remaining")
    counts = [F.count_if(F.col("disposition") == n).alias(n) for n in names]
    return rows.agg(*counts, F.count("*").alias("considered"))
