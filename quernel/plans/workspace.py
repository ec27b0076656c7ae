"""Queries over snapshots, listed worktrees and version-control output."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.operators import snapshots
from quernel.plans.catalog import DOC_FILES, query
from quernel.plans.search import _read
from quernel.sources import git, listing
from quernel.sources.tables import document_files, table


def _f(x: str) -> str:
    """SQL of a part after its length in four bytes."""
    return f"unhex(printf('%08x', strlen({x}))) || encode({x})"


def _tree(leaves: str) -> str:
    """SQL of the root (hash, n) of the tree over ``leaves`` (key, hash)."""
    return f"""lowest AS (SELECT key[1:4] AS node, sha256(string_agg(key || hash, '' ORDER BY key)) AS hash, count(*) AS n FROM {leaves} GROUP BY 1),
upper AS (SELECT node[1:2] AS node, sha256(string_agg(node || hash, '' ORDER BY node)) AS hash, sum(n) AS n FROM lowest GROUP BY 1),
root AS (SELECT sha256(string_agg(node || hash, '' ORDER BY node)) AS hash, CAST(sum(n) AS BIGINT) AS n FROM upper)"""


def _identity(*header: str) -> str:
    return f"'{snapshots.DOMAIN}:' || sha256({' || '.join(_f(repr(h)) for h in header)} || {_f('hash')} || {_f('n::VARCHAR')})"


# -- snapshots --------------------------------------------------------------------------------


@query(f"""WITH {DOC_FILES}, seen AS (SELECT path, text, CASE WHEN quality = 0 THEN 'undecodable' WHEN toxic = 1 THEN 'unreadable' ELSE 'success' END AS status FROM doc_files LEFT JOIN labels USING (doc_id)),
leaves AS (SELECT sha256({_f("'observed'")} || unhex('00') || {_f('path')}) AS key, sha256({_f('status')} || encode(CASE WHEN status = 'success' THEN text ELSE '' END)) AS hash FROM seen), {_tree('leaves')}
SELECT status, count(*) AS paths, (SELECT {_identity('query', 'license', 'ordinal')} FROM root) AS snapshot FROM seen GROUP BY status""")
def snapshot_query(spark, sf_dir):
    """The identity of what a search saw, with its paths by status."""
    seen = _read(spark, sf_dir).withColumn("content", F.when(F.col("status") == "success", F.col("text")))
    told = snapshots.query_snapshot(seen, "license", "ordinal")
    return seen.groupBy("status").agg(F.count("*").alias("paths")).crossJoin(F.broadcast(told.select("snapshot")))  # one row


@query(f"""WITH {DOC_FILES}, files AS (SELECT 'file/' || CASE WHEN lang = 'en' THEN 'source' ELSE 'additional' END AS kind, CAST(NULL AS VARCHAR) AS scope, path AS name, text AS content FROM doc_files),
vals AS (SELECT 'value/property' AS kind, r_name AS scope, n_name AS name, n_name || n_nationkey AS content FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'value/property', NULL, r_name, r_regionkey::VARCHAR FROM region),
rows AS (SELECT * FROM files UNION ALL SELECT * FROM vals UNION ALL SELECT 'entry-point/solution', NULL, 'all.sln', ''),
leaves AS (SELECT sha256({_f('kind')} || CASE WHEN scope IS NULL THEN unhex('00') ELSE unhex('01') || {_f('scope')} END || {_f('name')}) AS key, sha256(encode(content)) AS hash FROM rows), {_tree('leaves')}
SELECT {_identity('workspace')} AS snapshot, n AS entries FROM root""")
def snapshot_workspace(spark, sf_dir):
    """One identity of files of two kinds, values with and without a scope, and the selected entry point."""
    kind = F.when(F.col("lang") == "en", "source").otherwise("additional")
    files = document_files(spark, sf_dir).select(kind.alias("kind"), "path", F.col("text").alias("content"))
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # five rows
    values = nation.select(F.lit("property").alias("kind"), F.col("r_name").alias("scope"), F.col("n_name").alias("name"), F.concat("n_name", F.col("n_nationkey").cast("string")).alias("value"))
    values = values.unionByName(region.select(F.lit("property").alias("kind"), F.lit(None).cast("string").alias("scope"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("value")))
    return snapshots.workspace_snapshot(files, values, ("solution", "all.sln"))


@query(f"""WITH {DOC_FILES} SELECT 'file/source' AS kind, path AS name, CASE WHEN source = 'src3' THEN 'removed' ELSE 'changed' END AS change FROM doc_files WHERE source = 'src3' OR contains(text, 'license')
UNION ALL SELECT 'file/page', page_id::VARCHAR || '.html', 'added' FROM pages""")
def snapshot_difference(spark, sf_dir):
    """Between the documents and a later state: texts that name a license are edited, a source is gone, pages are new."""
    docs, pages = document_files(spark, sf_dir), table(spark, sf_dir, "pages")
    old = docs.select(*snapshots.entries(F.lit("file/source"), F.col("path"), F.col("text")))
    edited = F.when(F.contains("text", F.lit("license")), F.concat("text", F.lit("\n// edited"))).otherwise(F.col("text"))
    new = docs.where("source != 'src3'").select(*snapshots.entries(F.lit("file/source"), F.col("path"), edited))
    new = new.unionByName(pages.select(*snapshots.entries(F.lit("file/page"), F.concat(F.col("page_id").cast("string"), F.lit(".html")), F.col("html"))))
    return snapshots.difference(snapshots.keyed(old), snapshots.keyed(new)).select("kind", "name", "change")


# -- listed worktrees -------------------------------------------------------------------------


@query("SELECT view_name || '.parquet' AS path, false AS external FROM duckdb_views() WHERE NOT internal")
def worktree_listed(spark, sf_dir):
    """The tables of the table folder itself, listed as a worktree; the parts of a table that is a folder are told as the table, once."""
    return listing.listed(spark, sf_dir).select(F.regexp_replace("path", r"^([^/]+\.parquet)/.*", "$1").alias("path"), "external").distinct()


# -- version control --------------------------------------------------------------------------


def _outputs(spark, sf_dir):
    """For each document a status output: an ordinary entry, a rename whose old path looks like a record, by language a conflict or an untracked path."""
    docs = document_files(spark, sf_dir)
    more = F.when(F.col("lang") == "de", F.concat(F.lit("u UU N... 1 1 1 1 a b c both "), "path", F.lit("\0"))).when(F.col("lang") == "fr", F.concat(F.lit("? new "), "path", F.lit("\0! bin/"), "path", F.lit("\0"))).otherwise("")
    status = F.concat(
        F.lit("# branch.oid 1\x00" "1 .M N... 100644 100644 100644 a b "), "path", F.lit("\0"),
        F.lit("2 R. N... 100644 100644 100644 a b R100 "), F.concat("path", F.lit(".new")), F.lit("\0"), F.concat(F.lit("2 was "), "path"), F.lit("\0"), more,
    )
    change = F.when(F.col("lang") == "es", F.concat(F.lit("C075\0Rold "), "path", F.lit("\0"), "path", F.lit("\0"))).otherwise(F.concat(F.lit("M\0R1"), "path", F.lit("\0")))
    diff = F.concat(change, F.lit("D\0C/"), "path", F.lit("\0"))
    return docs.select(F.col("doc_id").cast("string").alias("repository"), status.cast("binary").alias("status"), diff.cast("binary").alias("diff"))


@query(f"""WITH {DOC_FILES}, d AS (SELECT doc_id::VARCHAR AS repository, path, lang FROM doc_files)
SELECT repository, path, NULL AS original_path, 'tracked' AS tracking, '.' AS index_status, 'M' AS worktree_status, false AS conflict FROM d
UNION ALL SELECT repository, path || '.new', '2 was ' || path, 'tracked', 'R', '.', false FROM d
UNION ALL SELECT repository, 'both ' || path, NULL, 'tracked', 'U', 'U', true FROM d WHERE lang = 'de'
UNION ALL SELECT repository, 'new ' || path, NULL, 'untracked', '.', '.', false FROM d WHERE lang = 'fr'
UNION ALL SELECT repository, 'bin/' || path, NULL, 'ignored', '.', '.', false FROM d WHERE lang = 'fr'""")
def git_status(spark, sf_dir):
    return git.status_entries(_outputs(spark, sf_dir).select("repository", F.col("status").alias("output")))


@query(f"""WITH {DOC_FILES}, d AS (SELECT doc_id::VARCHAR AS repository, path, lang FROM doc_files)
SELECT repository, CASE WHEN lang = 'es' THEN 'C075' ELSE 'M' END AS status, CASE WHEN lang = 'es' THEN path ELSE 'R1' || path END AS path, CASE WHEN lang = 'es' THEN 'Rold ' || path END AS original_path FROM d
UNION ALL SELECT repository, 'D', 'C/' || path, NULL FROM d""")
def git_diff(spark, sf_dir):
    return git.diff_entries(_outputs(spark, sf_dir).select("repository", F.col("diff").alias("output")))
