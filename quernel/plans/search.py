"""Queries over whole texts: patterns across lines, deadlines, decoding, results with their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.operators import evidence, text
from quernel.plans.catalog import DOC_FILES, PREVIEW, query
from quernel.sources.tables import decoded, document_files, table

#: Places of matches (path, text, start, match) in whole texts that have line feeds only.
PLACED = f"""placed AS (SELECT path, match, text, start, substring(text, 1, start) AS before FROM found),
lined AS (SELECT path, match, start, CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS INT) AS line,
  CAST(length(string_split(before, chr(10))[-1]) AS INT) AS col0, string_split(text, chr(10))[length(before) - length(replace(before, chr(10), '')) + 1] AS content FROM placed),
shown AS (SELECT path, line, col0 + 1 AS "column", match, content, greatest(0, least(col0 - 80, length(content) - 160)) AS first FROM lined),
hits_shown AS (SELECT path, line, "column", match, {PREVIEW} AS preview FROM shown)"""
MULTILINE = r"[a-z]+[.]\n[A-Z][a-z]*"


@query(f"""WITH {DOC_FILES}, hits AS (SELECT path, text, regexp_extract_all(text, '{MULTILINE}') AS m, string_split_regex(text, '{MULTILINE}') AS p FROM doc_files WHERE regexp_matches(text, '{MULTILINE}')),
found AS (SELECT path, text, m[k] AS match, CAST(list_sum([length(x) for x in p[:k]]) + coalesce(list_sum([length(x) for x in m[:k - 1]]), 0) AS INT) AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM hits)),
{PLACED} SELECT * FROM hits_shown""")
def regex_multiline(spark, sf_dir):
    """The end of a sentence and of its line, with the word that begins the next."""
    return text.search_regex(document_files(spark, sf_dir), MULTILINE)


@query(f"""WITH {DOC_FILES}, firsts AS (SELECT path, text, regexp_extract(text, '^[A-Za-z]+') AS a FROM doc_files), ends AS (SELECT *, regexp_extract(substring(text, length(a) + 1), '[a-z]+[.]?\\s*$') AS z FROM firsts),
found AS (SELECT path, text, a AS match, 0 AS start FROM ends WHERE a <> '' UNION ALL SELECT path, text, z, CAST(length(text) - length(z) AS INT) FROM ends WHERE z <> ''),
{PLACED} SELECT * FROM hits_shown""")
def regex_anchors(spark, sf_dir):
    """The first word of a text, where it begins with one, and the last, with what ends it; not of every line."""
    return text.search_regex(document_files(spark, sf_dir), r"\A[A-Za-z]+|[a-z]+[.]?\s*\z")


HANGS = "(?:a|aa)+$|[0-9]{4,}"


@query(f"""WITH {DOC_FILES} SELECT path, CASE WHEN length(text) % 97 = 5 THEN 'regular_expression_timeout' ELSE 'analyzed' END AS status,
CASE WHEN length(text) % 97 = 5 THEN 0 ELSE len(regexp_extract_all(text, 'a+$|[0-9]{{4,}}')) END AS matches FROM doc_files""")
def regex_timeout(spark, sf_dir):
    """Texts of some lengths are followed by what a pattern backtracks on without end: they exceed their deadline, all others are searched."""
    hard = F.when(F.length("text") % 97 == 5, F.concat("text", F.lit("\n" + "a" * 60 + "!"))).otherwise(F.col("text"))
    found = text.regex_files(document_files(spark, sf_dir).select("path", hard.alias("text")), HANGS, deadline=0.5)
    return found.select("path", "status", F.size("found").cast("long").alias("matches"))


@query(f"""WITH {DOC_FILES}, seen AS (SELECT *, quality IS NOT NULL AND quality = 0 AS broken, toxic IS NOT NULL AND toxic = 1 AS nul FROM doc_files LEFT JOIN labels USING (doc_id)),
s AS (SELECT *, CASE lang WHEN 'de' THEN 'utf-16le' WHEN 'fr' THEN 'utf-16be' ELSE 'utf-8' END AS e, length(text) + len(regexp_extract_all(text, '[\\x{{10000}}-\\x{{10FFFF}}]')) AS units FROM seen),
t AS (SELECT *, CASE WHEN e = 'utf-8' AND lang <> 'es' AND nul THEN 'binary' WHEN broken THEN 'undecodable' ELSE 'success' END AS status FROM s)
SELECT path, status, CASE WHEN status = 'success' THEN e END AS encoding, lang <> 'en' AS has_bom,
  CASE lang WHEN 'de' THEN 2 + 2 * units WHEN 'fr' THEN 2 + 2 * units WHEN 'es' THEN 3 + strlen(text) ELSE strlen(text) END + CASE WHEN broken THEN CASE WHEN e = 'utf-8' THEN 1 ELSE 2 END ELSE 0 END
    + CASE WHEN nul THEN CASE WHEN e = 'utf-8' THEN 1 ELSE 2 END ELSE 0 END AS byte_count,
  CASE WHEN status = 'success' THEN sha256(CASE WHEN nul THEN text || chr(0) ELSE text END) END AS text_hash FROM t""")
def decoded_files(spark, sf_dir):
    """Documents as bytes of four encodings, some with a lone surrogate or a broken byte, some with a NUL, decoded again."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = document_files(spark, sf_dir).join(labels, "doc_id", "left")
    broken, nul = F.coalesce(F.col("quality") == 0, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))

    def content(mark: str, charset: str, bad: str, zero: str):
        part = lambda when, x: F.when(when, F.unhex(F.lit(x))).otherwise(F.unhex(F.lit("")))
        return F.concat(F.unhex(F.lit(mark)), F.encode("text", charset), part(broken, bad), part(nul, zero))

    coded = F.when(F.col("lang") == "de", content("FFFE", "UTF-16LE", "00D8", "0000")).when(F.col("lang") == "fr", content("FEFF", "UTF-16BE", "DC00", "0000"))
    coded = coded.when(F.col("lang") == "es", content("EFBBBF", "UTF-8", "FF", "00")).otherwise(content("", "UTF-8", "C3", "00"))
    out = decoded(docs.select("path", coded.alias("content")))
    return out.select("path", "status", "encoding", "has_bom", "byte_count", F.sha2("text", 256).alias("text_hash"))


def _read(spark, sf_dir) -> DataFrame:
    """Files of which some could not be decoded or read, by their labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    status = F.when(F.col("quality") == 0, "undecodable").when(F.col("toxic") == 1, "unreadable").otherwise("success")
    return document_files(spark, sf_dir).join(labels, "doc_id", "left").select("path", "text", status.alias("status"))


SEEN = f"""{DOC_FILES}, seen AS (SELECT path, text, CASE WHEN quality = 0 THEN 'undecodable' WHEN toxic = 1 THEN 'unreadable' ELSE 'success' END AS status FROM doc_files LEFT JOIN labels USING (doc_id)),
read AS (SELECT path, text, string_split(lower(text), '{{q}}') AS a FROM seen WHERE status = 'success'),
spots AS (SELECT path, text, a, unnest(range(1, len(a))) AS k FROM read),
found AS (SELECT path, text, CAST(list_sum([length(x) for x in a[:k]]) + (k - 1) * {{n}} AS INT) AS start FROM spots),
first_found AS (SELECT path, text, start, substring(text, start + 1, {{n}}) AS match FROM found),
t AS (SELECT (SELECT count(*) FROM found) AS total, (SELECT count(*) FROM seen) AS considered, (SELECT count(*) FROM seen WHERE status = 'success') AS analyzed,
  (SELECT count(*) FROM seen WHERE status = 'undecodable') AS excluded, (SELECT count(*) FROM seen WHERE status = 'unreadable') AS failed)"""


def _flat(result: DataFrame, *rows: str) -> DataFrame:
    c = F.col("evidence.coverage")
    return result.select(*rows, "total", "total_known", "truncated", F.col("evidence.resolution").alias("resolution"), F.col("evidence.confidence").alias("confidence"), *[c[n].alias(n) for n in ("level", "considered", *evidence.PARTS, "partial_reason")])


def _told(limit: int) -> str:
    return f"""CASE WHEN total <= {limit} THEN total END AS total, total <= {limit} AS total_known, total > {limit} AS truncated, 'text' AS resolution, 'verified' AS confidence,
CASE WHEN total > {limit} OR failed > 0 THEN 'partial' ELSE 'complete' END AS level, considered, analyzed, 0 AS remaining, excluded, failed,
CASE WHEN total > {limit} THEN '{evidence.LIMIT_REASON}' WHEN failed > 0 THEN 'One or more files could not be read.' END AS partial_reason"""


@query(f"WITH {SEEN.format(q='license', n=7)} SELECT {_told(1_000_000)} FROM t")
def evidence_envelope(spark, sf_dir):
    """What a search looked at, what it left out and failed to read, and why it isn't complete."""
    return _flat(text.search_evidence(_read(spark, sf_dir), "license", 1_000_000))


@query(f"""WITH {SEEN.format(q='ation', n=5).replace("first_found AS", "first_rows AS (SELECT * FROM found ORDER BY path, start LIMIT 100), first_found AS").replace("AS match FROM found)", "AS match FROM first_rows)")},
{PLACED.replace("FROM found)", "FROM first_found)")} SELECT path, line, "column", match, preview, {_told(100)} FROM hits_shown, t""")
def search_one_pass(spark, sf_dir):
    """The first matches with total and coverage, from one reading of the files."""
    result = text.search_evidence(_read(spark, sf_dir), "ation", 100)
    return _flat(result.withColumn("row", F.explode("rows")), "row.*")
