"""Results that carry their evidence: the first rows, their total and what was looked at, from one reading of the input.

Each partition sorts its rows, keeps the first ``limit`` and counts the rest; these
summaries, of a bounded size each, are merged by the same step once for each
shuffle partition and once at the end. So the plan scans its input a single time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESOLUTIONS = ("text", "syntax", "semantic")
CONFIDENCES = ("candidate", "verified", "heuristic", "unknown")
LEVELS = ("not-applicable", "partial", "complete")
#: Parts of what was considered, and what a result says of it where it isn't complete.
PARTS = ("analyzed", "remaining", "excluded", "failed")
LIMIT_REASON = "Collection stopped at the requested result limit."
TIMEOUT_REASON = "One or more files exceeded the regular-expression timeout."
_PLACE = (1 << 33) - 1


def _merged(df: DataFrame, order: list[Column], limit: int, names: list[str], sums: list[str], by: Column | None) -> DataFrame:
    """One row for each partition (or in all, where ``by`` is None): (rows, sums). ``__is`` tells rows from mere counts."""
    placed = df.sortWithinPartitions(F.desc("__is"), *order)
    first = F.monotonically_increasing_id().bitwiseAND(_PLACE) < limit
    placed = placed.withColumn("__kept", F.col("__is") & first)
    if by is not None:
        placed = placed.withColumn("__by", by)
    row = F.when(F.col("__kept"), F.struct(*[F.col(f"`{n}`") for n in names]))
    return placed.groupBy(*([] if by is None else ["__by"])).agg(F.collect_list(row).alias("__rows"), *[F.sum(s).alias(s) for s in sums])


def _opened(summaries: DataFrame, names: list[str], sums: list[str]) -> DataFrame:
    """The rows of summaries again, each summary's counts on one of them."""
    opened = summaries.select(*sums, F.posexplode_outer("__rows").alias("__at", "__row"))
    counted = [F.when(F.coalesce("__at", F.lit(0)) == 0, F.col(s)).otherwise(0).alias(s) for s in sums]
    return opened.select(F.col("__row").isNotNull().alias("__is"), *[F.col("__row")[n].alias(n) for n in names], *counted)


def one_pass(df: DataFrame, order: list[Column], limit: int, counts: dict[str, Column] | None = None, is_row: Column | None = None) -> DataFrame:
    """One row: ``rows``, the first ``limit`` in order, ``total`` and a sum for each of ``counts``; an empty input gives no rows and zeros.

    ``is_row`` tells rows from those that only count (a file without a match).
    Ties beyond the order fall as they come. Names that begin with two underscores are the function's own.
    """
    names, counts = df.columns, counts or {}
    sums = [f"__c{i}" for i in range(len(counts) + 1)]
    is_row = F.lit(True) if is_row is None else F.coalesce(is_row, F.lit(False))
    rows = df.withColumn("__is", is_row)
    rows = rows.withColumns({sums[0]: F.col("__is").cast("long"), **{s: F.coalesce(c.cast("long"), F.lit(0)) for s, c in zip(sums[1:], counts.values())}})
    by_task = _merged(rows, order, limit, names, sums, F.spark_partition_id())
    by_shuffle = _merged(_opened(by_task, names, sums), order, limit, names, sums, F.spark_partition_id())
    last = _merged(_opened(by_shuffle, names, sums).repartition(1), order, limit, names, sums, None)
    return last.select(F.col("__rows").alias("rows"), *[F.coalesce(s, F.lit(0)).alias(n) for s, n in zip(sums, ["total", *counts])])


def coverage(considered: Column, analyzed: Column, remaining: Column, excluded: Column, failed: Column, reason: Column) -> Column:
    """A checked coverage: partial, with its reason, where something remains or failed, else complete."""
    open_ = (F.coalesce(remaining, F.lit(0)) > 0) | (F.coalesce(failed, F.lit(0)) > 0) | reason.isNotNull()
    level = F.when(open_, "partial").otherwise("complete")
    return checked(F.struct(level.alias("level"), considered.cast("long").alias("considered"), *[c.cast("long").alias(n) for c, n in zip((analyzed, remaining, excluded, failed), PARTS)], reason.alias("partial_reason")))


def violation(c: Column) -> Column:
    """What is wrong with a coverage (level, considered, analyzed, remaining, excluded, failed, partial_reason), else null."""
    parts = [c[p] for p in PARTS]
    numbers = [c["considered"], *parts]
    known = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))
    all_known = ~_any([p.isNull() for p in parts])
    blank = F.trim(F.coalesce(c["partial_reason"], F.lit(""))) == ""
    rules = [
        (~F.coalesce(c["level"], F.lit("")).isin(*LEVELS), "the level is unknown"),
        (_any([F.coalesce(n < 0, F.lit(False)) for n in numbers]), "a count is negative"),
        ((c["level"] == "partial") & blank, "partial coverage needs a reason"),
        ((c["level"] != "partial") & c["partial_reason"].isNotNull(), "only partial coverage has a reason"),
        ((c["level"] == "complete") & ((F.coalesce(c["remaining"], F.lit(0)) > 0) | (F.coalesce(c["failed"], F.lit(0)) > 0)), "complete coverage leaves nothing and fails nowhere"),
        ((c["level"] == "not-applicable") & _any([n.isNotNull() for n in numbers]), "coverage that doesn't apply has no counts"),
        (c["considered"].isNotNull() & (known > c["considered"]), "the parts exceed what was considered"),
        (c["considered"].isNotNull() & all_known & (known != c["considered"]), "the parts don't make up what was considered"),
    ]
    return F.coalesce(*[F.when(broken, F.lit(text)) for broken, text in rules])


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def checked(c: Column) -> Column:
    """The coverage itself; one that breaks a rule ends the query with an error."""
    return F.when(violation(c).isNull(), c).otherwise(F.raise_error(F.concat(F.lit("coverage: "), violation(c))))


def envelope(result: DataFrame, covered: Column, resolution: str, confidence: str, portion: str, root: str = ".", paths: list[str] = (), projects: list[str] = (), snapshot: Column | None = None) -> DataFrame:
    """``result`` (of ``one_pass``) with the struct ``evidence``: snapshot, resolution, coverage, confidence, scope."""
    if resolution not in RESOLUTIONS or confidence not in CONFIDENCES:
        raise ValueError(f"resolution is one of {RESOLUTIONS}, confidence of {CONFIDENCES}")
    if not portion.strip() or not root.strip():
        raise ValueError("a scope names its root and what of it was looked at")
    texts = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    scope = F.struct(F.lit(root).alias("workspace_root"), F.lit(portion).alias("analyzed_portion"), texts(sorted(set(projects))).alias("projects"), texts(sorted(set(paths))).alias("paths"))
    told = F.struct(
        (F.lit(None).cast("string") if snapshot is None else snapshot).alias("snapshot"), F.lit(resolution).alias("resolution"),
        covered.alias("coverage"), F.lit(confidence).alias("confidence"), scope.alias("scope"),
    )
    return result.withColumn("evidence", told)


def rows_of(result: DataFrame, *more: str) -> DataFrame:
    """The rows of a result one by one, with its columns ``more``."""
    return result.select(F.inline("rows"), *more)
