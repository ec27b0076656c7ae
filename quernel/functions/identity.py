"""Content-derived identities: SHA-256 over length-framed parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def framed(part: Column) -> Column:
    """The part's UTF-8 bytes after their number as four big-endian bytes; null counts as empty."""
    data = F.coalesce(part.cast("string"), F.lit("")).cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data).cast("long")), 8, "0")), data)


def identity(domain: str, *parts: Column) -> Column:
    """``domain`` and the hash of domain and parts, so that equal parts in other domains differ."""
    return F.concat(F.lit(domain + ":"), F.sha2(F.concat(framed(F.lit(domain)), *map(framed, parts)), 256))


#: Parts of each kind of identity, in order. Equal parts give the same identity wherever they are read.
PARTS = {
    "file": ("path", "external"),
    "text": ("content_hash", "path", "start", "length", "query", "mode"),
    "syntax": ("kind", "query", "path", "external", "content_hash", "start", "length", "text"),
    "reference": ("identity", "project", "configuration", "framework", "path", "start", "length"),
    "implementation": ("identity", "project", "configuration", "framework", "path", "start", "length"),
}


def entity_id(kind: str, /, **parts: Column) -> Column:
    """The identity of a file, text match, syntax fact, reference or implementation from its named parts, all of them."""
    wanted = PARTS[kind]
    if set(parts) != set(wanted):
        raise ValueError(f"a {kind} identity has the parts {wanted}")
    return identity(f"{kind}/q1", *[parts[p] for p in wanted])


def base64url(text: Column) -> Column:
    return F.rtrim(F.translate(F.base64(text.cast("binary")), "+/", "-_"), F.lit("="))


def symbol_id(name: Column, stable: Column, location: Column) -> Column:
    """``symbol/q2:`` with the name, the hash of what a declaration is, and the hash of where it is."""
    return F.concat_ws(":", F.lit("symbol/q2"), base64url(name), stable, location)


def parsed_symbol_id(symbol: Column) -> Column:
    """(name, stable, location) of a symbol identity; null for all else."""
    parts = F.split(symbol, ":", -1)
    ok = (F.size(parts) == 4) & (F.get(parts, F.lit(0)) == "symbol/q2") & F.get(parts, F.lit(1)).rlike("^[A-Za-z0-9_-]+$")
    ok = ok & F.get(parts, F.lit(2)).rlike("^[0-9a-f]{64}$") & F.get(parts, F.lit(3)).rlike("^[0-9a-f]{64}$")
    name = F.decode(F.unbase64(F.translate(F.get(parts, F.lit(1)), "-_", "+/")), "UTF-8")
    return F.when(ok, F.struct(name.alias("name"), F.get(parts, F.lit(2)).alias("stable"), F.get(parts, F.lit(3)).alias("location")))


def snapshot(rows: DataFrame, *parts: Column, domain: str = "ws/q1") -> DataFrame:
    """(snapshot, files): one identity of all rows, in whatever order they come.

    A tree of hashes: no group holds more than a share of the rows, the last at most 256.
    """
    leaf = rows.select(F.sha2(F.concat(*map(framed, parts)), 256).alias("h"))
    bucket = leaf.groupBy(F.left("h", F.lit(4)).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n"))
    both = F.concat("b", "h")
    top = bucket.groupBy(F.left("b", F.lit(2)).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(both)), ""), 256).alias("h"), F.sum("n").alias("n"))
    hashed = F.sha2(F.array_join(F.array_sort(F.collect_list(both)), ""), 256)
    return top.agg(F.concat(F.lit(domain + ":"), hashed).alias("snapshot"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))
