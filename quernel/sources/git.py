"""Version-control output as tables: porcelain status and name-status diffs, NUL-separated.

An output is split at its NULs into slots. A letter for each slot tells what it
looks like; one replacement from left to right over those letters finds where
records begin, since a rename takes the slot after it whatever that looks like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.operators.text import let


def _records(outputs: DataFrame, letter, record: str, starts: str, width: int) -> DataFrame:
    """(repository, slots): the slots of each record, ``width`` at most."""
    text = F.expr("make_valid_utf8(cast(output as string))")
    slots = F.split(text, "\\x00", -1)
    rows = outputs.where("output IS NOT NULL").select("repository", slots.alias("slots"))

    def begun(marks, ss):
        return F.filter(F.transform(ss, lambda s, i: F.struct(F.get(marks, i).alias("mark"), F.slice(ss, i + 1, F.lit(width)).alias("s"))), lambda r: r["mark"] == "S")

    def split(ss):
        letters = F.array_join(F.transform(ss, letter), "")
        return let(F.split(F.regexp_replace(letters, record, starts), ""), lambda marks: begun(marks, ss))

    return rows.select("repository", F.explode(let(F.col("slots"), split)).alias("r")).select("repository", F.col("r.s").alias("slots"))


def _fields(slot: Column, n: int) -> Column:
    return F.split(slot, " ", n)


def status_entries(outputs: DataFrame) -> DataFrame:
    """(repository, path, original_path, tracking, index_status, worktree_status, conflict) of ``status --porcelain=v2 -z`` outputs (repository, output).

    Ordinary, renamed (the old path is the next slot), unmerged, untracked and
    ignored entries; headers and records that lack fields give no entry. Bytes that
    are no UTF-8 are replaced. A null output has no entries.
    """
    looks = lambda s: F.when(s.startswith("2 "), F.lit("2")).otherwise(F.lit("x"))
    found = _records(outputs, looks, "2(.)|x", "S$1", 2)
    slot, first = F.get("slots", F.lit(0)), F.left(F.get("slots", F.lit(0)), F.lit(2))
    width = F.when(first == "1 ", 9).when(first == "2 ", 10).when(first == "u ", 11)
    f = F.when(first == "1 ", _fields(slot, 9)).when(first == "2 ", _fields(slot, 10)).when(first == "u ", _fields(slot, 11))
    rows = found.select("repository", "slots", slot.alias("slot"), first.alias("kind"), f.alias("f"), width.alias("width"))
    tracked = F.col("width").isNotNull()
    rows = rows.where((tracked & (F.size("f") == F.col("width"))) | F.col("kind").isin("? ", "! "))
    state = lambda i: F.when(tracked, F.substring(F.get("f", F.lit(1)), i, 1)).otherwise(".")
    return rows.select(
        "repository", F.when(tracked, F.element_at("f", -1)).otherwise(F.expr("substring(slot, 3)")).alias("path"),
        F.when(F.col("kind") == "2 ", F.get("slots", F.lit(1))).alias("original_path"),
        F.when(tracked, "tracked").when(F.col("kind") == "? ", "untracked").otherwise("ignored").alias("tracking"),
        state(1).alias("index_status"), state(2).alias("worktree_status"), (F.col("kind") == "u ").alias("conflict"),
    )


def diff_entries(outputs: DataFrame) -> DataFrame:
    """(repository, status, path, original_path) of ``diff --name-status -z`` outputs (repository, output); renames and copies have their old path first."""
    looks = lambda s: F.when(s.rlike("^[RC]"), F.lit("r")).otherwise(F.lit("m"))
    found = _records(outputs, looks, "r(.)(.)|m(.)", "S$1$2$3", 3)
    two = F.get("slots", F.lit(0)).rlike("^[RC]")
    return found.select(
        "repository", F.get("slots", F.lit(0)).alias("status"), F.when(two, F.get("slots", F.lit(2))).otherwise(F.get("slots", F.lit(1))).alias("path"),
        F.when(two, F.get("slots", F.lit(1))).alias("original_path"),
    )
