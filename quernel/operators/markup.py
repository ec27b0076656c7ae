"""Structural queries over HTML files: calls, attributes, elements, outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTHS = {"nav": 1, "article": 1, "footer": 1, "h1": 2, "ul": 2, "p": 3, "li": 3}


def _each(files: DataFrame, pattern: str, *groups: str) -> DataFrame:
    """(path, seq, groups...) of all matches of a pattern, in order."""
    lists = [F.regexp_extract_all("html", F.lit(pattern), i) for i in range(1, len(groups) + 1)]
    zipped = files.select("path", F.posexplode(F.arrays_zip(*[x.alias(g) for x, g in zip(lists, groups)])).alias("at", "m"))
    return zipped.select("path", (F.col("at") + 1).alias("seq"), *[F.col("m")[g].alias(g) for g in groups])


def invocations(files: DataFrame, name: str | None = None) -> DataFrame:
    """(path, seq, name, argument): calls ``name(argument)`` in statements."""
    found = _each(files, r"([A-Za-z_][A-Za-z0-9_]*)\(([^()]*)\);", "name", "argument")
    return found if name is None else found.where(F.col("name") == name)


def attributes(files: DataFrame, attribute: str) -> DataFrame:
    """(path, seq, element, value): elements with a quoted attribute, in order."""
    return _each(files, rf"<([a-z][a-z0-9]*) [^<>]*?{attribute}=\"([^\"]*)\"", "element", "value")


def elements(files: DataFrame, names: list[str]) -> DataFrame:
    """(path, seq, element): opened elements of some names, in order."""
    return _each(files, rf"<({'|'.join(names)})(?:>| )", "element")


def empty_elements(files: DataFrame, names: list[str]) -> DataFrame:
    """(path, element, n): elements that are closed at once."""
    parts = [_each(files, rf"<({n})(?: [^<>]*)?></{n}>", "element") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("path", "element").agg(F.count("*").alias("n"))


def outline(files: DataFrame, most: int = 50) -> DataFrame:
    """(path, seq, element, depth, total): the first ``most`` items of a file in source order, and how many it has."""
    depth = F.lit(None).cast("int")
    for name, d in DEPTHS.items():
        depth = F.when(F.col("element") == name, d).otherwise(depth)
    found = F.regexp_extract_all("html", F.lit(rf"<({'|'.join(DEPTHS)})(?:>| )"), 1)
    rows = files.select("path", F.size(found).alias("total"), F.posexplode(F.slice(found, 1, most)).alias("at", "element"))
    return rows.select("path", (F.col("at") + 1).alias("seq"), "element", depth.alias("depth"), "total")
