"""Bounded results: limits with totals, early stops, budgets, texts, plans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.operators.evidence import one_pass, rows_of


def evidence_order(*columns: str) -> list[Column]:
    """The total order of results; nulls last in each column."""
    return [F.asc_nulls_last(c) for c in columns]


def project(df: DataFrame, declared: list[str], default: list[str], requested: Iterable[str] = ()) -> DataFrame:
    """Defaults and requested columns, once each, in declared order; unknown names are an error."""
    asked = [x.strip() for r in requested for x in r.split(",") if x.strip()]
    unknown = [x for x in asked if x not in declared]
    if unknown:
        raise ValueError(f"unknown fields {unknown}; there are {declared}")
    return df.select(*[c for c in declared if c in default or c in asked])


def limited(df: DataFrame, order: list[Column], limit: int | None = 100) -> DataFrame:
    """The first ``limit`` rows and, in each, ``total`` and ``truncated``; all rows without a limit. With one the input is read once."""
    if limit is None:
        out = df.crossJoin(F.broadcast(df.agg(F.count("*").alias("total")))).orderBy(*order)  # one row; a join's inputs need not keep their order
        return out.withColumn("truncated", F.lit(False))
    return rows_of(one_pass(df, order, limit), "total").withColumn("truncated", F.col("total") > limit)


def early_stop(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows; the total is told only if that was all, as a search that stops there knows no more."""
    out = rows_of(one_pass(df, order, limit), "total").withColumn("total_known", F.col("total") <= limit)
    return out.withColumn("total", F.when(F.col("total_known"), F.col("total")))


def enveloped(df: DataFrame, order: list[Column], limit: int | None, retrieval: str | None = None) -> DataFrame:
    """``limited`` with ``omitted`` and ``retrieval``, how to get what is left out; without one nothing may be left out."""
    out = limited(df, order, limit)
    omitted = F.lit(0).cast("long") if limit is None else F.greatest(F.col("total") - limit, F.lit(0).cast("long"))
    told = F.lit(retrieval) if retrieval is not None else F.raise_error(F.lit("rows are left out, but no way to get them is given"))
    return out.withColumn("omitted", omitted).withColumn("retrieval", F.when(F.col("omitted") > 0, told.cast("string")))


def capped(df: DataFrame, by: list[str], order: list[str], most: int = 20) -> DataFrame:
    """The first ``most`` rows of each group, with the group's ``total`` and how many are ``omitted``."""
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.asc_nulls_last(c) for c in order])))
    totals = df.groupBy(*by).agg(F.count("*").alias("total"))
    kept = ranked.where(F.col("place") <= most)  # the limit is taken before rows of a group meet
    return kept.join(totals, by).withColumn("omitted", F.greatest(F.col("total") - most, F.lit(0).cast("long")))


def first_per(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order, nulls first; tasks keep one row a key before rows are shuffled."""
    key = F.struct(*[x for c in order for x in (F.col(c).isNotNull().alias(f"{c}_given"), F.col(c).alias(c))])
    return df.groupBy(*by).agg(F.min_by(F.struct(*[c for c in df.columns if c not in by]), key).alias("row")).select(*by, "row.*")


def utf16_order(column: str) -> Column:
    """The order of a text by UTF-16 units, nulls last; Spark's own is by UTF-8 bytes, which differs above U+FFFF."""
    return F.asc_nulls_last(F.encode(F.col(column), "UTF-16BE"))


def bounded_text(text: Column, most: int) -> tuple[Column, Column, Column]:
    """A text's first ``most`` characters, how many it has, and whether some are left out."""
    return F.left(text, F.lit(most)), F.length(text), F.length(text) > most


def whole_sections(df: DataFrame, by: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Per group: which sections fit a budget when taken in order, each whole or not at all; later smaller ones may still fit.

    (by, included, omitted, used). The fold needs a group's sizes together, so
    groups must be of bounded length, as the sections of one context are.
    """
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(size).cast("int").alias("size"))))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("included"), F.lit(0).alias("omitted"))

    def step(acc, x):
        fits = acc["used"] + x["size"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + x["size"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, acc["included"] + 1).otherwise(acc["included"]).alias("included"),
            F.when(fits, acc["omitted"]).otherwise(acc["omitted"] + 1).alias("omitted"),
        )

    folded = df.groupBy(*by).agg(rows.alias("rows")).withColumn("f", F.aggregate("rows", start, step))
    return folded.select(*by, "f.included", "f.omitted", "f.used")


def best_plan(plans: DataFrame, order: list[Column]) -> DataFrame:
    return plans.orderBy(*order).limit(1)


def suggestions(rows: DataFrame, n: int = 3) -> DataFrame:
    """The first distinct (priority, arguments)."""
    return rows.select("priority", "arguments").distinct().orderBy("priority", "arguments").limit(n)
