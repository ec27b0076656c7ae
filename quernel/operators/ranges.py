"""Running sums and last values over a table in one total order, by ranges: no key, however many rows it has, is one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.checkpoint import cut

_PLACE = (1 << 33) - 1


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], last: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``number`` (from 1 in that order), the sum of each of ``sums`` up to and with a row, and for each of
    ``last`` the latest value that isn't null.

    Rows are sorted into ranges. What each range adds up to, and its last values, are
    a row for each partition; they come to the driver, which hands every range what
    those before it hold.
    """
    last = last or {}
    totals, lasts = [f"__s{i}" for i in range(len(sums))], [f"__l{i}" for i in range(len(last))]
    rows = df.withColumns({**{t: c.cast("long") for t, c in zip(totals, sums.values())}, **dict(zip(lasts, last.values()))})
    rows = cut(rows.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftright("__id", 33).cast("int"))
    told = rows.groupBy("__part").agg(
        F.count("*").alias("n"), *[F.sum(t).alias(t) for t in totals], *[F.max_by(x, F.when(F.col(x).isNotNull(), F.col("__id"))).alias(x) for x in lasts]
    ).collect()  # a row for each partition
    carried, n, held, latest = [], 0, [0] * len(totals), [None] * len(lasts)
    for r in sorted(told, key=lambda r: r["__part"]):
        carried.append((r["__part"], n, *held, *latest))
        n += r["n"]
        held = [h + (r[t] or 0) for h, t in zip(held, totals)]
        latest = [r[x] if r[x] is not None else was for x, was in zip(lasts, latest)]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(["__part int", "__n long", *[f"__b{t} long" for t in totals], *[f"__b{x} {kinds[x]}" for x in lasts]])
    before = F.broadcast(df.sparkSession.createDataFrame(carried, schema))  # a row for each partition
    inside = Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({**{f"__w{t}": F.sum(t).over(inside) for t in totals}, **{f"__w{x}": F.last(x, True).over(inside) for x in lasts}}).join(before, "__part")
    made = {"number": F.col("__n") + F.col("__id").bitwiseAND(_PLACE) + 1}
    made |= {name: F.coalesce(F.col(f"__w{t}"), F.lit(0)) + F.col(f"__b{t}") for name, t in zip(sums, totals)}
    made |= {name: F.coalesce(F.col(f"__w{x}"), F.col(f"__b{x}")) for name, x in zip(last, lasts)}
    return out.select(*df.columns, *[c.alias(name) for name, c in made.items()])
