"""Tables and their reading as a corpus of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id.txt``."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select(path.alias("path"), "text", "doc_id", "lang", "source")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files named by their address without scheme, query and fragment."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(path.alias("path"), "html", "page_id")


def binary_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder: (path, content), the path relative to it."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    clean = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/*", "/")
    root = "/" + folder.split("://")[-1].strip("/") + "/"
    return read.select(F.substring_index(clean, root, -1).alias("path"), "content")


def utf16(content: Column, little: bool) -> Column:
    """The text of UTF-16 bytes without a mark; null where a unit is half or a surrogate has no partner."""
    hexed = F.hex(content)
    units = F.regexp_replace(hexed, "(..)(..)", "$2$1 " if little else "$1$2 ")  # high byte first, a space after each
    alone = units.rlike("(?<![0-9A-F])D[89AB].. (?!D[C-F])") | units.rlike("(?<!D[89AB].. )(?<![0-9A-F])D[C-F].. ")
    bad = (F.octet_length(content) % 2 == 1) | alone
    return F.when(~bad, F.decode(content, "UTF-16LE" if little else "UTF-16BE"))


def decoded(files: DataFrame) -> DataFrame:
    """(path, status, encoding, has_bom, byte_count, total_lines, text) of files with binary ``content``.

    By byte order mark: UTF-8, UTF-16 LE and BE; UTF-32 is unsupported; a NUL
    byte without a mark means binary; broken UTF-8 and UTF-16 are undecodable.
    """
    c = F.col("content")
    head = F.hex(F.substring(c, 1, 4))
    utf32 = (head == "0000FEFF") | (head == "FFFE0000")
    kind = F.when(utf32, "utf-32").when(head.startswith("EFBBBF"), "utf-8-bom").when(head.startswith("FFFE"), "utf-16le").when(head.startswith("FEFF"), "utf-16be").otherwise("utf-8")
    raw = F.expr("try_validate_utf8(cast(content as string))")
    text = (
        F.when(F.col("kind") == "utf-8-bom", F.expr("try_validate_utf8(cast(substring(content, 4, octet_length(content)) as string))"))
        .when(F.col("kind") == "utf-16le", utf16(F.expr("substring(content, 3, octet_length(content))"), True))
        .when(F.col("kind") == "utf-16be", utf16(F.expr("substring(content, 3, octet_length(content))"), False))
        .when(F.col("kind") == "utf-8", raw)
    )
    status = (
        F.when(c.isNull(), "unreadable").when(F.col("kind") == "utf-32", "unsupported")
        .when((F.col("kind") == "utf-8") & F.hex(c).rlike("^(?:..)*?00"), "binary").when(F.col("t").isNull(), "undecodable").otherwise("success")
    )
    out = files.withColumn("kind", kind).withColumn("t", text).withColumn("status", status)
    ok = F.col("status") == "success"
    lines = F.when(F.length("t") == 0, 0).otherwise(F.size(F.split("t", "\r\n|\n|\r", -1)) - F.when(F.col("t").rlike("[\r\n]\\z"), 1).otherwise(0))
    return out.select(
        "path", "status", F.when(ok, F.regexp_replace("kind", "-bom", "")).alias("encoding"), (F.col("kind").isin("utf-8-bom", "utf-16le", "utf-16be")).alias("has_bom"),
        F.octet_length(c).cast("long").alias("byte_count"), F.when(ok, lines).cast("long").alias("total_lines"), F.when(ok, F.col("t")).alias("text"),
    )
