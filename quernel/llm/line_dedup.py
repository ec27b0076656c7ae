"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line goes if an equal line, or one within one edit (a character put in, left
out or changed), comes earlier; the earliest stays. Equal lines go at any length,
near ones from ``min_chars`` characters on. Two lines within one edit
share all before the edit and all after it. So the variants of a line are what
is left when a window around each place is deleted, as hashed keys, and lines
that share a variant are joined. Deleting single characters at once would make
as many variants as the corpus has characters, so the windows narrow by steps:

1. half windows: two lines within one edit share their first or their last
   ``K`` characters (K a power of two, at most half of the length);
2. windows of a quarter to an eighth of the line, then of an eighth of those,
   and so on to single characters, each time for lines that met another at the
   step before. Any two lines that share a one-character variant are within one
   edit, so the earliest line of a key is enough; its edit distance is verified.

A key's lines are only ever summed (least and greatest hash, earliest place),
so no pairs are made. Lines then meet their key's sum; a key that many lines
share is salted there (``meet``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import aside, cut, cut_small, discard, may_hold, meet, stored

MIN_CHARS = 20  # of lines that are compared by edits; one edit in a shorter line is a large part of it
LAST_ID = (1 << 63) - 1


def texts_of(docs: DataFrame) -> DataFrame:
    """(d, t, text): place and identity of each document. Null ids come last; equal rows count as one document."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))


def lines_of(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(d, t, l, line, h): trimmed lines of at least ``min_chars`` characters, none of them blank, with a 128-bit hash."""
    split = texts_of(docs).select("d", "t", F.posexplode(F.split("text", "\n", -1)).alias("l", "raw"))
    odd = F.col("raw").contains("\t") | F.col("raw").contains("\r")  # translate is slow and seldom needed
    trimmed = split.where(F.octet_length("raw") >= min_chars).select("d", "t", "l", F.trim(F.when(odd, F.translate("raw", "\t\r", "  ")).otherwise(F.col("raw"))).alias("line"))
    return trimmed.where(F.length("line") >= max(1, min_chars)).withColumn("h", F.unhex(F.md5("line")))


def sizes(n: Column) -> Column:
    """Exponents of two that a line of ``n`` characters is filed under; two where one character more or less changes it."""
    b = F.floor(F.log2(n + 0.5)).cast("int")
    power = F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2.0), b)
    return F.when(n == power, F.array(b - 1, b)).when(n == power * 2 - 1, F.array(b, b + 1)).otherwise(F.array(b))


#: A line's first and last K characters, for each size it is filed under.
HALVES = """
flatten(transform(bs, b -> array(
  xxhash64('head', b, left(line, cast(pow(2, b - 1) as int))),
  xxhash64('tail', b, right(line, cast(pow(2, b - 1) as int))))))
"""


def live_keys(rows: DataFrame) -> DataFrame:
    """(key, rows): keys that two or more different lines share, and how many rows they have."""
    return rows.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("rows")).where("lo != hi").select("key", "rows")


#: Deleted windows (i, j) of width v inside a window of width w: i * v characters before and j * v after them stay.
CHILDREN = """
flatten(transform(
  sequence(p_lo div v, p_hi div v),
  i -> transform(
    sequence(
      greatest(s_lo, n - 1 - least(p_hi, i * v + v - 1)) div v,
      greatest(greatest(s_lo, n - 1 - least(p_hi, i * v + v - 1)) div v, least(s_hi, n - greatest(p_lo, i * v)) div v)),
    j -> named_struct('i', i, 'j', j))))
"""


def variants(rows: DataFrame) -> DataFrame:
    """(key, h, b, v, i, j, n): keys of the lines (h, line, b, v, p_lo, p_hi, s_lo, s_hi), for each deleted window of width v."""
    window = rows.withColumn("n", F.length("line")).withColumn("w", F.explode(F.expr(CHILDREN))).select("*", "w.i", "w.j")
    window = window.where("i * v + j * v <= n")
    key = F.xxhash64(F.lit("window"), "b", "v", "i", "j", F.expr("left(line, i * v)"), F.expr("right(line, j * v)"))
    return window.select(key.alias("key"), "h", "b", "v", "i", "j", "n")


def narrowed(v: Column) -> Column:
    return F.greatest(F.lit(1), (v / 8).cast("int"))


def earlier_neighbours(slim: DataFrame, n: int, lines: DataFrame, first: DataFrame) -> DataFrame:
    """(h): lines that have an earlier line within one edit. ``first`` has each line's first place; there are ``n`` lines."""
    keys = slim.select(F.explode("halves").alias("key"), "h")
    met = cut_small(meet(keys, cut_small(live_keys(keys), n), ["key"], 4 * n, "rows", look=True).select("h").distinct(), n)
    # the text of a line comes from its first place only
    wanted = met.join(first, "h").select("h", "place.d", "place.t", "place.l", "place")
    some = may_hold(lines, met)
    found = wanted.join(some.select("d", "t", "l", "line"), ["d", "t", "l"]).select("h", "place", "line")
    found = cut_small(found.dropDuplicates(["h"]), n)
    start = found.select("h", "line", F.explode(sizes(F.length("line"))).alias("b"))
    start = start.withColumn("v", F.greatest(F.lit(1), F.pow(F.lit(2.0), F.col("b") - 2).cast("int")))
    start = start.select("*", F.lit(0).alias("p_lo"), F.length("line").alias("p_hi"), F.lit(0).alias("s_lo"), F.length("line").alias("s_hi"))
    rows, done = cut(variants(start)), None
    while True:
        size = rows.count()
        live = cut_small(meet(rows, live_keys(rows), ["key"], size, "rows").drop("rows"), size)
        last = live.where("v = 1").select("key", "h")
        done = last if done is None else done.unionByName(last)
        more = live.where("v > 1")
        if not more.take(1):
            break
        parent = more.join(found.select("h", "line"), "h").select(
            "h", "line", "b", narrowed(F.col("v")).alias("v"),
            (F.col("i") * F.col("v")).alias("p_lo"), F.least(F.col("i") * F.col("v") + F.col("v") - 1, F.col("n")).alias("p_hi"),
            (F.col("j") * F.col("v")).alias("s_lo"), F.least(F.col("j") * F.col("v") + F.col("v") - 1, F.col("n")).alias("s_hi"),
        )
        rows = cut(variants(parent).distinct())
    size = done.count()
    placed = cut_small(done.join(found.select("h", "place"), "h"), size)
    lead = placed.groupBy("key").agg(F.min(F.struct("place", "h")).alias("lead"), F.count("*").alias("n"))
    pairs = meet(placed, lead, ["key"], size).where(F.col("lead.place") < F.col("place")).select("h", F.col("lead.h").alias("by")).distinct()
    text = found.select("h", "line")
    checked = pairs.join(text, "h").join(text.select(F.col("h").alias("by"), F.col("line").alias("by_line")), "by")
    return checked.where(F.levenshtein("line", "by_line", 1) >= 0).select("h").distinct()


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = 1) -> DataFrame:
    """(d, t, l): the lines that go."""
    lines = lines_of(docs)
    b = F.when(F.length("line") >= min_chars, sizes(F.length("line"))).otherwise(F.array().cast("array<int>"))
    slim = stored(lines.withColumn("bs", b).select("d", "t", "l", "h", F.expr(HALVES).alias("halves")))
    places = slim.select("h", F.struct("d", "t", "l").alias("place"))
    n = slim.count()
    first = cut_small(places.groupBy("h").agg(F.min("place").alias("place"), F.count("*").alias("n")), n)
    marks = first.where("n > 1").select("h", "place", "n", F.lit(False).alias("near"))
    if max_edits:
        near = earlier_neighbours(slim, n, lines_of(docs, min_chars), first.select("h", "place"))
        no_place = F.lit(None).cast(first.schema["place"].dataType)
        marks = marks.unionByName(near.select("h", no_place.alias("place"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("near")))
        marks = marks.groupBy("h").agg(F.min("place").alias("place"), F.max("n").alias("n"), F.max("near").alias("near"))
    marks = cut_small(marks.withColumnRenamed("place", "kept"), n)
    gone = meet(places, marks, ["h"], n, look=True).where(F.col("near") | (F.col("place") != F.col("kept")))
    gone = cut_small(gone.select("place.d", "place.t", "place.l"), n)
    discard(slim)
    return gone


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = 1) -> DataFrame:
    """``docs`` with repeated and nearly repeated lines taken out of ``text``, and ``lines_removed``.

    Order is by doc_id, null ids last, then by line. Lines are compared trimmed,
    with tabs as spaces; blank lines stay, and those of under ``min_chars``
    characters go for equal ones only. ``max_edits`` is 0 or 1. Rows equal in doc_id and text count as one document
    and all keep the same lines. A null text stays null; other columns stay as
    they are, whatever their names. An empty table gives an empty table.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    docs, names = aside(docs, ["doc_id", "text"], ("lines_removed",))
    gone = removed_lines(docs, min_chars, max_edits).groupBy("d", "t").agg(F.sort_array(F.collect_set("l")).alias("gone_lines"))
    gone = gone.withColumnsRenamed({"d": "__d", "t": "__t", "gone_lines": "__gone"})
    text = F.col("text").cast("string")
    joined = docs.join(gone, (F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID)) == F.col("__d")) & (F.xxhash64(text) == F.col("__t")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("__gone", i)), "\n")
    out = [F.when(F.col("__gone").isNull(), text).otherwise(kept).alias("text") if c == "text" else docs[c] for c in docs.columns]
    return joined.select(*out, F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("lines_removed")).toDF(*names, "lines_removed")


def op4_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "text", "lines_removed")


#: The same rows by comparing all lines of like length that share half their characters.
OP4_SQL = """
WITH docs AS (SELECT doc_id, text, coalesce(doc_id, 9223372036854775807) AS d FROM documents),
split AS (SELECT d, doc_id, text, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS l FROM docs),
lines AS (SELECT *, trim(translate(raw, chr(9) || chr(13), '  '), ' ') AS line FROM split),
first_lines AS (SELECT line, min((d, l)) AS place, length(line) AS n FROM lines WHERE length(line) >= 1 GROUP BY line),
firsts AS (SELECT * FROM first_lines WHERE n >= 20),
pairs AS (
  SELECT a.line, b.line AS by_line FROM firsts a JOIN firsts b ON left(a.line, 10) = left(b.line, 10) WHERE b.place < a.place AND abs(a.n - b.n) <= 1
    AND (left(a.line, (least(a.n, b.n) - 1) // 2) = left(b.line, (least(a.n, b.n) - 1) // 2) OR right(a.line, (least(a.n, b.n) - 1) // 2) = right(b.line, (least(a.n, b.n) - 1) // 2))
  UNION
  SELECT a.line, b.line FROM firsts a JOIN firsts b ON right(a.line, 10) = right(b.line, 10) WHERE b.place < a.place AND abs(a.n - b.n) <= 1
    AND right(a.line, (least(a.n, b.n) - 1) // 2) = right(b.line, (least(a.n, b.n) - 1) // 2)),
near AS (SELECT DISTINCT line FROM pairs WHERE len(list_filter(range(0, length(line) + 1), lambda i: left(line, i) = left(by_line, i) AND (
  substring(line, i + 2) = substring(by_line, i + 2) OR substring(line, i + 2) = substring(by_line, i + 1) OR substring(line, i + 1) = substring(by_line, i + 2)))) > 0),
told AS (SELECT s.doc_id, s.text, s.l, s.raw, length(s.line) >= 1 AND (s.line IN (SELECT line FROM near) OR (s.d, s.l) > f.place) AS gone
  FROM lines s LEFT JOIN first_lines f ON f.line = s.line)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY l) FILTER (WHERE NOT coalesce(gone, false)), '') AS text, count(*) FILTER (WHERE gone) AS lines_removed
FROM told GROUP BY doc_id, text
UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE text IS NULL
"""
