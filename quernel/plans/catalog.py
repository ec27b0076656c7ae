"""Registry of the code-intelligence queries on the driver's tables, with DuckDB oracles.

Documents are read as files ``source/lang/doc_id.txt`` and pages as files named
by their address; parts, suppliers and line items stand for declarations,
projects and facts. Every query reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import identity as identities
from quernel.functions.identity import identity
from quernel.functions.paths import normal_path
from quernel.operators import bounded, changed, files, graph, markup, relations, symbols, text
from quernel.sources.tables import document_files, page_files, table

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


DOC_FILES = "doc_files AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, text, doc_id, lang, source FROM documents)"
PAGE_FILES = r"page_files AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, html, page_id FROM pages)"
LINES = r"lines AS (SELECT path, unnest(l) AS content, unnest(range(1, len(l) + 1)) AS line FROM (SELECT path, string_split_regex(text, '\r\n|\n|\r') AS l FROM doc_files))"
PREVIEW = """CASE WHEN trim(content) = '' THEN '…' ELSE
    CASE WHEN first > 0 THEN '…' ELSE '' END || substring(content, first + 1, 160) || CASE WHEN first + 160 < length(content) THEN '…' ELSE '' END END"""


# -- files ------------------------------------------------------------------------------------

RANKED = f"""WITH {PAGE_FILES}, f AS (SELECT DISTINCT path, lower(path) AS p FROM page_files WHERE contains(lower(path), 'blog')),
n AS (SELECT *, string_split(p, '/')[-1] AS name, string_split(p, '/')[:-2] AS dirs, len(string_split(p, '/')) AS depth FROM f),
r AS (SELECT path, CAST(CASE WHEN p = 'blog' THEN 0 WHEN name = 'blog' THEN 1 WHEN regexp_replace(name, '^(.+)\\.[^.]*$', '\\1') = 'blog' THEN 2
  WHEN starts_with(name, 'blog') THEN 3 WHEN contains(name, 'blog') THEN 4 WHEN list_contains(dirs, 'blog') THEN 5
  WHEN len(list_filter(dirs, lambda d: starts_with(d, 'blog'))) > 0 THEN 6 ELSE 7 END AS INT) AS rank,
  CAST(instr(p, 'blog') AS INT) AS match_index, CAST(length(name) AS INT) AS name_length, CAST(depth AS INT) AS depth FROM n)
SELECT path, rank, match_index, name_length, depth, (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM r) > 100 AS truncated
FROM r ORDER BY rank, match_index, name_length, depth, length(path), path LIMIT 100"""


@query(RANKED)
def file_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.search_files(page_files(spark, sf_dir), "blog")
    return bounded.limited(found, [*[F.col(c) for c in files.SEARCH_ORDER], F.length("path"), F.col("path")], 100)


@query(f"""WITH {DOC_FILES} SELECT path FROM doc_files WHERE (regexp_matches(path, '^src1[^/]*/en/.*$') OR regexp_matches(path, '^(?:.*/)?[^/]*7\\.txt(?:/.*)?$')) AND path LIKE '%.txt'""")
def file_search_glob_ext(spark, sf_dir):
    return files.matching(document_files(spark, sf_dir), extensions=["txt"], globs=["src1*/en/**", "*7.txt"]).select("path")


@query(f"""WITH {PAGE_FILES}, n AS (SELECT path, string_split(path, '/')[-1] AS name FROM page_files),
e AS (SELECT CASE WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN lower(string_split(name, '.')[-1]) END AS e FROM n)
SELECT CASE e WHEN 'cs' THEN 'source' WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' WHEN 'html' THEN 'markup' WHEN 'xml' THEN 'markup' WHEN 'json' THEN 'data'
WHEN 'csproj' THEN 'project' WHEN 'sln' THEN 'solution' ELSE 'other' END AS kind, count(*) AS n FROM e GROUP BY 1""")
def file_kinds(spark, sf_dir):
    return page_files(spark, sf_dir).groupBy(files.kind(F.col("path")).alias("kind")).agg(F.count("*").alias("n"))


IGNORE_RULES = [(1, "src1[^/]*", False), (2, "src10", True), (3, "(?:.*/)?de", False), (4, "(?:.*/)?[^/]*7\\.txt", False), (5, "src3/de/[^/]*7\\.txt", True)]
_RULES_SQL = ", ".join(f"({o}, '{r}', {str(n).lower()})" for o, r, n in IGNORE_RULES)


@query(f"""WITH {DOC_FILES}, rules(ord, regex, negated) AS (VALUES {_RULES_SQL}),
x AS (SELECT DISTINCT path, unnest([source, source || '/' || lang, path]) AS prefix FROM doc_files),
m AS (SELECT path, prefix, arg_max(negated, ord) AS negated FROM x JOIN rules ON regexp_full_match(prefix, regex) GROUP BY 1, 2)
SELECT path, path IN (SELECT path FROM m WHERE NOT negated) AS ignored FROM doc_files""")
def ignore_rules(spark, sf_dir):
    rules = spark.createDataFrame([(o, f"^{r}$", n) for o, r, n in IGNORE_RULES], "ord int, regex string, negated boolean")
    return files.ignored(document_files(spark, sf_dir).select("path"), rules)


@query(f"""WITH {DOC_FILES} SELECT lang, count(*) AS n, CAST(sum(CASE WHEN contains(lower(substring(text, 1, 4096)), 'license') THEN 1 ELSE 0 END) AS BIGINT) AS marked FROM doc_files GROUP BY 1""")
def generated_files(spark, sf_dir):
    marked = files.generated(F.col("path"), F.col("text"), "license")
    return document_files(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(marked).alias("marked"))


@query("""SELECT page_id, CASE WHEN url LIKE 'https%' THEN NULL ELSE array_to_string(list_filter(string_split(regexp_replace(url, '^http://', ''), '/'), lambda s: s <> ''), '/') END AS path FROM pages""")
def path_normalise(spark, sf_dir):
    raw = F.when(F.col("url").startswith("https"), F.concat(F.lit("/"), "url")).otherwise(F.concat(F.lit("./x/..\\"), F.regexp_replace("url", "^http://", "")))
    return table(spark, sf_dir, "pages").select("page_id", normal_path(raw).alias("path"))


def _projects(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("source").alias("directory")).union(docs.select(F.concat_ws("/", "source", "lang"))).distinct()


OWNERS = f"""{DOC_FILES}, projects AS (SELECT DISTINCT source AS directory FROM doc_files UNION SELECT DISTINCT source || '/' || lang FROM doc_files),
owners AS (SELECT DISTINCT path, directory AS project FROM doc_files JOIN projects ON starts_with(path, directory || '/'))"""


@query(f"""WITH {OWNERS} SELECT path, array_to_string(list_sort(list(project)), ',') AS owning_projects, CAST(count(*) AS INT) AS owner_count FROM owners GROUP BY path""")
def ownership(spark, sf_dir):
    docs = document_files(spark, sf_dir)
    owned = files.owned(docs, files.owners(docs, _projects(docs)))
    return owned.select("path", F.array_join("owning_projects", ",").alias("owning_projects"), "owner_count")


@query(f"""WITH {OWNERS}, deep AS (SELECT path, project, len(string_split(project, '/')) AS d, max(len(string_split(project, '/'))) OVER (PARTITION BY path) AS most FROM owners)
SELECT path, bool_and(len(list_filter(string_split_regex(project, '[/\\\\.\\-_]'), lambda s: lower(s) IN ('fr', 'src2') OR ends_with(lower(s), 'tests'))) > 0) AS is_test FROM deep WHERE d = most GROUP BY path""")
def test_classification(spark, sf_dir):
    docs = document_files(spark, sf_dir)
    return files.is_test(files.owned(docs, files.owners(docs, _projects(docs))), ["fr", "src2"]).select("path", "is_test")


# -- text -------------------------------------------------------------------------------------

LITERAL = """hits AS (SELECT path, line, content, string_split({fold}, '{q}') AS a FROM lines WHERE contains({fold}, '{q}')),
starts AS (SELECT path, line, content, unnest([CAST(list_sum([length(x) for x in a[:k]]) + (k - 1) * {n} AS INT) for k in range(1, len(a))]) AS start FROM hits),
found AS (SELECT path, CAST(line AS INT) AS line, CAST(start + 1 AS INT) AS "column", substring(content, start + 1, {n}) AS match, content,
  greatest(0, least(start - 80, length(content) - 160)) AS first FROM starts)"""


def _literal(q: str, sensitive: bool) -> str:
    return f"WITH {DOC_FILES}, {LINES}, " + LITERAL.format(q=q, n=len(q), fold="content" if sensitive else "lower(content)")


@query(_literal("tionth", False) + f""", t AS (SELECT count(*) AS total FROM found)
SELECT path, line, "column", match, {PREVIEW} AS preview, total, total > 100 AS truncated FROM found, t ORDER BY path, line, "column" LIMIT 100""")
def text_literal(spark, sf_dir):
    found = text.search_literal(document_files(spark, sf_dir), "tionth")
    return bounded.limited(found, [F.col("path"), F.col("line"), F.col("column")], 100)


@query(_literal("Th", True) + f"SELECT path, count(*) AS matches, count(DISTINCT line) AS lines FROM found GROUP BY path")
def text_literal_counts(spark, sf_dir):
    found = text.search_literal(document_files(spark, sf_dir), "Th", case_sensitive=True)
    return found.groupBy("path").agg(F.count("*").alias("matches"), F.countDistinct("line").alias("lines"))


@query(f"""WITH {DOC_FILES}, {LINES}, hits AS (SELECT path, line, content, regexp_extract_all(content, '[0-9]+[a-f]+') AS m, string_split_regex(content, '[0-9]+[a-f]+') AS p FROM lines WHERE regexp_matches(content, '[0-9]+[a-f]+')),
s AS (SELECT path, line, content, m, p, unnest(range(1, len(m) + 1)) AS k FROM hits),
f AS (SELECT path, CAST(line AS INT) AS line, content, m[k] AS match, CAST(list_sum([length(x) for x in p[:k]]) + coalesce(list_sum([length(x) for x in m[:k - 1]]), 0) AS INT) AS start FROM s),
g AS (SELECT *, greatest(0, least(start - 80, length(content) - 160)) AS first FROM f)
SELECT path, line, CAST(start + 1 AS INT) AS "column", match, {PREVIEW} AS preview FROM g""")
def text_regex(spark, sf_dir):
    return text.search_regex(document_files(spark, sf_dir), "[0-9]+[a-f]+")


@query(_literal("the", False) + """SELECT path, line, "column", false AS total_known, CAST(NULL AS BIGINT) AS total FROM found ORDER BY path, line, "column" LIMIT 10""")
def text_limit_total_unknown(spark, sf_dir):
    return text.first_matches(document_files(spark, sf_dir), "the", 10).select("path", "line", "column", "total_known", "total")


STATUS = "CASE WHEN quality IS NULL THEN 'unobserved' WHEN quality = 0 THEN 'undecodable' ELSE 'searched' END"


def _observed(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    status = F.when(F.col("quality").isNull(), "unobserved").when(F.col("quality") == 0, "undecodable").otherwise("searched")
    return document_files(spark, sf_dir).drop("text").join(labels, "doc_id", "left").withColumn("status", status)


@query(f"SELECT {STATUS} AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def text_skip_counts(spark, sf_dir):
    return text.status_counts(_observed(spark, sf_dir))


@query(f"""WITH {DOC_FILES}, l AS (SELECT path, string_split_regex(text, '\\r\\n|\\n|\\r') AS a FROM doc_files), s AS (SELECT path, len(a) AS n, array_to_string(a[3:6], chr(10)) AS t FROM l)
SELECT path, CASE WHEN n >= 3 THEN 'ok' ELSE 'out_of_range' END AS status, CASE WHEN n >= 3 THEN 3 END AS first_line, CAST(CASE WHEN n >= 3 THEN least(6, n) END AS INT) AS last_line,
CASE WHEN n >= 3 THEN left(t, 4000) END AS text, CAST(CASE WHEN n >= 3 THEN greatest(length(t) - 4000, 0) END AS INT) AS omitted FROM s""")
def line_span(spark, sf_dir):
    return text.line_span(document_files(spark, sf_dir), 3, 6)


@query(f"""WITH {DOC_FILES} SELECT path, strlen(text) AS byte_count, length(text) AS scalar_count, length(text) + len(regexp_extract_all(text, '[\\x{{10000}}-\\x{{10FFFF}}]')) AS utf16_count,
CASE WHEN text = '' THEN 0 ELSE len(string_split_regex(text, '\\r\\n|\\n|\\r')) - CASE WHEN regexp_matches(text, '[\\r\\n]$') THEN 1 ELSE 0 END END AS total_lines, sha256(text) AS content_hash FROM doc_files""")
def documents_read(spark, sf_dir):
    return text.documents_read(document_files(spark, sf_dir))


# -- changed scopes ---------------------------------------------------------------------------


def _entries(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Worktree entries: French and German documents, the latter renamed, conflicts where the quality is 0. Diff: labelled documents."""
    seen = _observed(spark, sf_dir)
    entries = seen.where(F.col("lang").isin("fr", "de")).select("path", F.when(F.col("lang") == "de", F.concat(F.lit("old/"), "path")).alias("original_path"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("conflict"))
    status = F.when(F.col("toxic") == 1, "R100").when(F.col("lang") == "es", "C75").otherwise("M")
    diff = seen.where("toxic IS NOT NULL").select(status.alias("status"), "path", F.when(status != "M", F.concat(F.lit("was/"), "path")).alias("original_path"))
    return entries, diff


CHANGED = f"""{DOC_FILES}, seen AS (SELECT path, lang, quality, toxic FROM doc_files LEFT JOIN labels USING (doc_id)),
w AS (SELECT path FROM seen WHERE lang IN ('fr', 'de') UNION SELECT 'old/' || path FROM seen WHERE lang = 'de'),
c AS (SELECT path FROM seen WHERE lang IN ('fr', 'de') AND quality = 0),
d AS (SELECT path FROM seen WHERE toxic IS NOT NULL UNION SELECT 'was/' || path FROM seen WHERE toxic = 1)"""


@query(f"WITH {CHANGED} SELECT path FROM w EXCEPT SELECT path FROM c")
def changed_worktree(spark, sf_dir):
    return changed.worktree_scope(_entries(spark, sf_dir)[0])


@query(f"WITH {CHANGED} (SELECT path FROM w UNION SELECT path FROM d) EXCEPT SELECT path FROM c")
def changed_merge_base(spark, sf_dir):
    return changed.merge_base_scope(*_entries(spark, sf_dir))


@query(f"WITH {CHANGED} SELECT path, 'changed' AS state FROM (SELECT path FROM d EXCEPT SELECT path FROM c) UNION ALL SELECT path, 'conflict' FROM (SELECT path FROM d INTERSECT SELECT path FROM c)")
def changed_three_dot(spark, sf_dir):
    return changed.three_dot_scope(*_entries(spark, sf_dir))


@query(f"""WITH {DOC_FILES}, seen AS (SELECT path, lang, source, quality, toxic FROM doc_files LEFT JOIN labels USING (doc_id)),
r AS (SELECT CASE WHEN coalesce(toxic = 1, false) THEN 'failed' WHEN lang = 'es' THEN 'excluded' WHEN quality = 1 THEN 'analyzed' WHEN quality IS NOT NULL THEN 'failed' ELSE 'remaining' END AS x FROM seen)
SELECT count(*) FILTER (x = 'analyzed') AS analyzed, count(*) FILTER (x = 'excluded') AS excluded, count(*) FILTER (x = 'failed') AS failed, count(*) FILTER (x = 'remaining') AS remaining, count(*) AS considered FROM r""")
def changed_coverage(spark, sf_dir):
    seen = _observed(spark, sf_dir)
    paths = seen.select("path", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("conflict"))
    observed = seen.where("quality IS NOT NULL").select("path", "status")
    return changed.dispositions(changed.coverage(paths, seen.where("lang != 'es'"), observed))


# -- declarations -----------------------------------------------------------------------------


def declarations(spark, sf_dir) -> DataFrame:
    """Parts as declarations: the name in Pascal case, qualified by the brand, the type as signature."""
    name = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    space = F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), space.alias("namespace"), F.concat_ws(".", space, name).alias("qualified"), F.col("p_type").alias("signature"), F.col("p_size").alias("size"))


DECLARATIONS = """declarations AS (SELECT p_partkey AS id, list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])) AS words,
array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), '') AS name, replace(p_brand, '#', '') AS namespace,
replace(p_brand, '#', '') || '.' || array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), '') AS qualified, p_type AS signature, p_size AS size FROM part)"""


def _ranked_sql(q: str) -> str:
    low = q.lower()
    return f"""{DECLARATIONS}, ranked AS (SELECT *, CAST(CASE WHEN qualified = '{q}' THEN 0 WHEN name = '{q}' THEN 1 WHEN lower(name) = '{low}' OR lower(qualified) = '{low}' THEN 2
WHEN starts_with(lower(name), '{low}') THEN 3
WHEN len(list_filter(words, lambda w: starts_with(lower(w), '{low}'))) > 0 OR starts_with(lower(array_to_string(list_transform(words, lambda w: w[1]), '')), '{low}') THEN 4
WHEN contains(lower(name), '{low}') THEN 5 END AS INT) AS rank FROM declarations)"""


SYMBOL = "s"


@query(f"WITH {_ranked_sql(SYMBOL)}, r AS (SELECT * FROM ranked WHERE rank IS NOT NULL) SELECT id, name, qualified, rank, (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM r) > 100 AS truncated FROM r ORDER BY rank, qualified, id LIMIT 100")
def symbol_rank(spark, sf_dir):
    found = symbols.search_symbols(declarations(spark, sf_dir), SYMBOL).select("id", "name", "qualified", "rank")
    return bounded.limited(found, [F.col("rank"), F.col("qualified"), F.col("id")], 100)


@query(f"WITH {_ranked_sql('ed')} SELECT id, qualified, rank FROM ranked WHERE rank = (SELECT min(rank) FROM ranked)")
def symbol_best_tier(spark, sf_dir):
    return symbols.best_tier(symbols.search_symbols(declarations(spark, sf_dir), "ed")).select("id", "qualified", "rank")


def _framed_sql(*parts: str) -> str:
    return " || ".join(f"from_hex(printf('%08X', octet_length(encode({p})))) || encode({p})" for p in parts)


@query(f"WITH {DECLARATIONS} SELECT id, 'symbol/q1:' || sha256({_framed_sql(chr(39) + 'symbol/q1' + chr(39), 'qualified', 'signature')}) AS symbol FROM declarations")
def symbol_id(spark, sf_dir):
    d = declarations(spark, sf_dir)
    return d.select("id", identity("symbol/q1", F.col("qualified"), F.col("signature")).alias("symbol"))


@query(f"""WITH {DECLARATIONS}, r AS (SELECT id, name, namespace || '.' || signature AS stable, name || size AS exact FROM declarations),
c AS (SELECT a.id AS request, count(*) FILTER (b.exact = a.exact) AS exact, count(*) FILTER (b.stable = a.stable) AS same, count(b.exact) AS named FROM r a LEFT JOIN r b USING (name) GROUP BY 1)
SELECT request, CASE WHEN exact = 1 OR same = 1 THEN 'resolved' WHEN same > 1 THEN 'ambiguous' WHEN named > 0 THEN 'stale' ELSE 'not_found' END AS state,
CASE WHEN exact = 1 THEN 1 WHEN same > 0 THEN same ELSE named END AS matches FROM c""")
def symbol_resolution(spark, sf_dir):
    d = declarations(spark, sf_dir).select("id", "name", F.concat_ws(".", "namespace", "signature").alias("stable"), F.concat("name", F.col("size").cast("string")).alias("exact"))
    return symbols.resolve(d.withColumnRenamed("id", "request"), d)


@query(f"WITH {DECLARATIONS} SELECT namespace, name, count(*) AS overloads FROM declarations GROUP BY 1, 2")
def symbol_siblings(spark, sf_dir):
    return symbols.siblings(declarations(spark, sf_dir), "namespace", "name")


SNAPSHOT = f"""WITH {DOC_FILES}, leaf AS (SELECT sha256({_framed_sql('path', 'sha256(text)')}) AS h FROM doc_files),
bucket AS (SELECT left(h, 4) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM leaf GROUP BY 1),
top AS (SELECT left(b, 2) AS b, sha256(string_agg(b || h, '' ORDER BY b)) AS h FROM bucket GROUP BY 1)
SELECT 'ws/q1:' || sha256(string_agg(b || h, '' ORDER BY b)) AS snapshot, (SELECT count(*) FROM leaf) AS files FROM top"""


@query(SNAPSHOT)
def snapshot(spark, sf_dir):
    return identities.snapshot(document_files(spark, sf_dir), F.col("path"), F.sha2("text", 256))


# -- markup -----------------------------------------------------------------------------------


def _matches_sql(pattern: str, groups: list[str]) -> str:
    lists = ", ".join(f"regexp_extract_all(html, '{pattern}', {i}) AS {g}s" for i, g in enumerate(groups, 1))
    each = ", ".join(f"unnest({g}s) AS {g}" for g in groups)
    return f"{PAGE_FILES}, m AS (SELECT path, {lists} FROM page_files) SELECT path, CAST(unnest(range(1, len({groups[0]}s) + 1)) AS INT) AS seq, {each} FROM m"


@query("WITH " + _matches_sql(r"([A-Za-z_][A-Za-z0-9_]*)\(([^()]*)\);", ["name", "argument"]))
def syntax_invocation(spark, sf_dir):
    return markup.invocations(page_files(spark, sf_dir))


@query("WITH " + _matches_sql(r'<([a-z][a-z0-9]*) [^<>]*?href="([^"]*)"', ["element", "value"]))
def syntax_attribute(spark, sf_dir):
    return markup.attributes(page_files(spark, sf_dir), "href")


@query("WITH " + _matches_sql("<(script|style|article)(?:>| )", ["element"]))
def syntax_creation(spark, sf_dir):
    return markup.elements(page_files(spark, sf_dir), ["script", "style", "article"])


@query(f"""WITH {PAGE_FILES}, e AS (SELECT path, 'p' AS element, len(regexp_extract_all(html, '<p(?: [^<>]*)?></p>')) AS n FROM page_files UNION ALL
SELECT path, 'li', len(regexp_extract_all(html, '<li(?: [^<>]*)?></li>')) FROM page_files) SELECT path, element, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY 1, 2 HAVING sum(n) > 0""")
def syntax_empty_block(spark, sf_dir):
    return markup.empty_elements(page_files(spark, sf_dir), ["p", "li"])


@query(f"""WITH {PAGE_FILES}, m AS (SELECT path, regexp_extract_all(html, '<(nav|article|footer|h1|ul|p|li)(?:>| )', 1) AS a FROM page_files),
s AS (SELECT path, len(a) AS total, unnest(a[:50]) AS element, unnest(range(1, least(50, len(a)) + 1)) AS seq FROM m)
SELECT path, CAST(seq AS INT) AS seq, element, CAST(CASE WHEN element IN ('nav', 'article', 'footer') THEN 1 WHEN element IN ('h1', 'ul') THEN 2 ELSE 3 END AS INT) AS depth, CAST(total AS INT) AS total FROM s""")
def outline(spark, sf_dir):
    return markup.outline(page_files(spark, sf_dir))


# -- facts ------------------------------------------------------------------------------------

VOTE = """v AS (SELECT l_partkey AS id, CASE WHEN l_discount >= 0.08 THEN 'verified' WHEN l_tax >= 0.05 THEN 'unresolved' ELSE 'rejected' END AS status,
CASE WHEN l_discount >= 0.08 THEN NULL WHEN l_tax >= 0.05 THEN 'binding.' || lower(l_returnflag) ELSE 'kind.' || lower(l_linestatus) END AS reason, l_returnflag || l_linestatus AS variant FROM lineitem),
r AS (SELECT p_partkey AS id, coalesce(status, 'unresolved') AS status, CASE WHEN variant IS NULL THEN 'ownership.not_found' ELSE reason END AS reason, variant FROM part LEFT JOIN v ON v.id = p_partkey),
voted AS (SELECT id, ['rejected', 'unresolved', 'verified'][CAST(max(CASE status WHEN 'verified' THEN 2 WHEN 'unresolved' THEN 1 ELSE 0 END) AS INT) + 1] AS status, count(variant) AS variants,
coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (reason IS NOT NULL)), '; '), '') AS reasons FROM r GROUP BY id)"""


def _voted(spark, sf_dir) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_discount") >= 0.08, "verified").when(F.col("l_tax") >= 0.05, "unresolved").otherwise("rejected")
    reason = F.when(F.col("l_discount") >= 0.08, None).when(F.col("l_tax") >= 0.05, F.concat(F.lit("binding."), F.lower("l_returnflag"))).otherwise(F.concat(F.lit("kind."), F.lower("l_linestatus")))
    variants = item.select(F.concat("l_returnflag", "l_linestatus").alias("variant"), F.array("l_partkey").alias("sources"), status.alias("status"), reason.alias("reason"))
    candidates = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("source"))
    return relations.vote(relations.candidate_variants(candidates, variants))


@query(f"WITH {VOTE} SELECT * FROM voted")
def verify_vote(spark, sf_dir):
    return _voted(spark, sf_dir)


@query(f"WITH {VOTE} SELECT count(*) AS discovered, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'unresolved') AS unresolved FROM voted")
def verify_totals(spark, sf_dir):
    return relations.vote_totals(_voted(spark, sf_dir))


@query("""WITH p AS (SELECT DISTINCT source AS project FROM documents), c AS (SELECT DISTINCT source AS project, lang AS configuration FROM documents),
f AS (SELECT DISTINCT source AS project, 'q' || quality AS framework FROM documents JOIN labels USING (doc_id))
SELECT project, configuration, framework FROM p LEFT JOIN c USING (project) LEFT JOIN f USING (project)""")
def compiler_variants(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("project"), "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    projects = docs.groupBy("project").agg(F.collect_set("lang").alias("configurations"), F.collect_set(F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("frameworks"))
    return relations.variants_of(projects)


def _coverage_rows(spark, sf_dir) -> DataFrame:
    """Suppliers as projects, return flags as frameworks, and a state by the account balance and the line status."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_acctbal")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct().join(supplier, "l_suppkey")
    state = F.when(F.col("s_acctbal") < 0, "broken").when(F.col("l_linestatus") == "F", "supported").when(F.col("l_returnflag") == "N", "unrestored").otherwise("unsupported")
    return rows.select(F.col("s_name").alias("project"), F.col("l_returnflag").alias("framework"), F.col("l_linestatus").alias("configuration"), state.alias("coverage"))


COVERAGE = """rows AS (SELECT DISTINCT s_name AS project, l_returnflag AS framework, l_linestatus AS configuration,
CASE WHEN s_acctbal < 0 THEN 'broken' WHEN l_linestatus = 'F' THEN 'supported' WHEN l_returnflag = 'N' THEN 'unrestored' ELSE 'unsupported' END AS coverage FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


@query(f"""WITH {COVERAGE}, p AS (SELECT *, coverage IN ('supported', 'unrestored') AS able FROM rows)
SELECT project, framework, configuration, coverage, CASE WHEN able AND framework <> 'N' THEN 'remaining' WHEN able THEN 'analyzed' WHEN coverage = 'unsupported' THEN 'excluded' ELSE 'failed' END AS disposition,
CASE WHEN able AND framework <> 'N' THEN 'framework.not_selected' WHEN able THEN NULL WHEN coverage = 'unsupported' THEN 'project.unsupported' ELSE 'project.failed' END AS reason FROM p""")
def variant_plan(spark, sf_dir):
    return relations.plan(_coverage_rows(spark, sf_dir), None, "N")


@query(f"""WITH {COVERAGE}, p AS (SELECT CASE WHEN coverage IN ('supported', 'unrestored') THEN CASE WHEN framework <> 'N' THEN 'remaining' ELSE 'analyzed' END WHEN coverage = 'unsupported' THEN 'excluded' ELSE 'failed' END AS x FROM rows)
SELECT count(*) FILTER (x = 'analyzed') AS analyzed, count(*) FILTER (x = 'excluded') AS excluded, count(*) FILTER (x = 'failed') AS failed, count(*) FILTER (x = 'remaining') AS remaining, count(*) AS considered FROM p""")
def coverage_report(spark, sf_dir):
    return changed.dispositions(relations.plan(_coverage_rows(spark, sf_dir), None, "N"))


@query(f"WITH {COVERAGE} SELECT project, min(framework) AS framework FROM rows WHERE coverage = 'supported' GROUP BY 1")
def default_framework(spark, sf_dir):
    return relations.default_framework(_coverage_rows(spark, sf_dir).withColumn("position", F.ascii("framework")))


@query(f"""WITH {COVERAGE} SELECT project, ['supported', 'unsupported', 'unrestored', 'broken'][max(list_position(['supported', 'unsupported', 'unrestored', 'broken'], coverage))] AS state,
array_to_string(list_sort(list(DISTINCT lower(framework) || '.' || coverage)), ',') AS failures, min(configuration) AS configuration FROM rows GROUP BY 1""")
def project_merge(spark, sf_dir):
    rows = _coverage_rows(spark, sf_dir).select("project", F.col("coverage").alias("state"), F.array(F.concat_ws(".", F.lower("framework"), "coverage")).alias("failures"), "configuration")
    merged = relations.merge_projects(rows, ["supported", "unsupported", "unrestored", "broken"])
    return merged.withColumn("failures", F.array_join("failures", ","))


@query(f"""WITH {COVERAGE}, l AS (SELECT project, configuration, list_sort(list(DISTINCT framework)) AS f FROM rows GROUP BY 1, 2),
p AS (SELECT project, arg_min(f, (-len(f), array_to_string(f, ','))) AS p, list_distinct(flatten(list(f))) AS a FROM l GROUP BY 1)
SELECT project, array_to_string(list_concat(p, list_sort(list_filter(a, lambda x: NOT list_contains(p, x)))), ',') AS frameworks FROM p""")
def framework_merge(spark, sf_dir):
    lists = _coverage_rows(spark, sf_dir).groupBy("project", "configuration").agg(F.array_sort(F.collect_set("framework")).alias("frameworks"))
    return relations.merge_frameworks(lists).select("project", F.array_join("frameworks", ",").alias("frameworks"))


def _dependencies(spark, sf_dir) -> DataFrame:
    """Supplier k depends on supplier k div 2."""
    keys = table(spark, sf_dir, "supplier").where("s_suppkey > 1")
    return keys.select(F.col("s_suppkey").alias("src"), F.expr("s_suppkey div 2").alias("dst"))


def _seeds(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_suppkey IN (3, 5)").select(F.col("s_suppkey").alias("node"))


DEPENDENTS = """RECURSIVE e AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier WHERE s_suppkey > 1),
x AS (SELECT s_suppkey AS node, 0 AS depth FROM supplier WHERE s_suppkey IN (3, 5) UNION SELECT e.src, depth + 1 FROM x JOIN e ON e.dst = x.node),
reach AS (SELECT node, CAST(min(depth) AS INT) AS depth FROM x GROUP BY 1)"""


@query(f"WITH {DEPENDENTS} SELECT node, depth FROM reach")
def reverse_closure(spark, sf_dir):
    return graph.closure(graph.reverse(_dependencies(spark, sf_dir)), _seeds(spark, sf_dir))


@query(f"WITH {DEPENDENTS} SELECT node FROM reach WHERE depth <= 1")
def direct_reverse(spark, sf_dir):
    return graph.neighbours(graph.reverse(_dependencies(spark, sf_dir)), _seeds(spark, sf_dir))


@query(f"WITH {DEPENDENTS} SELECT count(*) AS affected, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (s_nationkey < 10) AS tests, max(depth) AS farthest FROM reach JOIN supplier ON s_suppkey = node WHERE depth > 0")
def impact(spark, sf_dir):
    tests = table(spark, sf_dir, "supplier").where("s_nationkey < 10").select(F.col("s_suppkey").alias("node"))
    return graph.impact(_dependencies(spark, sf_dir), _seeds(spark, sf_dir), tests)


def _functional(spark, sf_dir) -> DataFrame:
    """Nation k points at k * k + 1 modulo the number of nations."""
    n = table(spark, sf_dir, "nation")
    size = n.agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(size)).select(F.col("n_nationkey").cast("long").alias("src"), F.expr("pmod(cast(n_nationkey as bigint) * n_nationkey + 1, n)").alias("dst"))


REACH = """RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS src, (CAST(n_nationkey AS BIGINT) * n_nationkey + 1) % (SELECT count(*) FROM nation) AS dst FROM nation),
r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
scc AS (SELECT node, least(node, coalesce((SELECT min(a.dst) FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src = node), node)) AS component, node IN (SELECT src FROM r WHERE src = dst) AS cyclic FROM nodes)"""


@query(f"WITH {REACH} SELECT node, component, cyclic FROM scc")
def scc(spark, sf_dir):
    return graph.components(_functional(spark, sf_dir))


@query(f"WITH {REACH} SELECT component, count(*) AS size, min(node) AS first, max(node) AS last FROM scc WHERE cyclic GROUP BY 1")
def cycles(spark, sf_dir):
    return graph.cycles(_functional(spark, sf_dir))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey // 2 AS src, s_suppkey AS dst FROM supplier WHERE s_suppkey > 1 UNION SELECT s_suppkey // 3, s_suppkey FROM supplier WHERE s_suppkey > 2),
x AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth, [CAST(1 AS BIGINT)] AS path UNION ALL SELECT dst, depth + 1, list_append(path, dst) FROM x JOIN e ON e.src = node WHERE depth < 32),
d AS (SELECT node, min(depth) AS depth FROM x GROUP BY 1)
SELECT node, CAST(depth AS INT) AS depth, array_to_string(min(path), '>') AS path FROM x JOIN d USING (node, depth) GROUP BY 1, 2""")
def shortest_path(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("dst"))
    edges = keys.where("dst > 1").select(F.expr("dst div 2").alias("src"), "dst").union(keys.where("dst > 2").select(F.expr("dst div 3"), "dst"))
    return graph.shortest_paths(edges, 1).select("node", "depth", F.array_join("path", ">").alias("path"))


REFERENCES = f"""WITH {DEPENDENTS}, t AS (SELECT p_partkey FROM part WHERE p_size <= 5)
SELECT l_orderkey, l_linenumber, l_partkey AS identity, l_suppkey AS project FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM t) AND l_suppkey IN (SELECT node FROM reach)
AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""


@query(REFERENCES)
def references(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("identity"), F.col("l_suppkey").alias("project"), F.col("l_orderkey").alias("path"))
    targets = table(spark, sf_dir, "part").where("p_size <= 5").select(F.col("p_partkey").alias("identity"))
    scope = graph.closure(graph.reverse(_dependencies(spark, sf_dir)), _seeds(spark, sf_dir)).select(F.col("node").alias("project"))
    eligible = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path"))
    return relations.references(facts, targets, scope, eligible).select("l_orderkey", "l_linenumber", "identity", "project")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey >= 3),
x AS (SELECT p_partkey AS node FROM part WHERE p_partkey = 2 UNION SELECT e.src FROM x JOIN e ON e.dst = x.node)
SELECT p_partkey AS id, p_type AS signature FROM x JOIN part ON p_partkey = node WHERE p_partkey <> 2""")
def implementations(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    derived = part.where("p_partkey >= 3").select(F.expr("p_partkey div 3").alias("src"), F.col("p_partkey").alias("dst"))
    roots = part.where("p_partkey = 2").select(F.col("p_partkey").alias("node"))
    found = graph.closure(derived, roots).where("depth > 0")
    return found.join(part, F.col("node") == F.col("p_partkey")).select(F.col("p_partkey").alias("id"), F.col("p_type").alias("signature"))


# -- bounded results --------------------------------------------------------------------------


@query("SELECT doc_id, quality, toxic, (SELECT count(*) FROM labels) AS total, (SELECT count(*) FROM labels) > 50 AS truncated FROM labels ORDER BY toxic DESC, doc_id LIMIT 50")
def bounded_rows(spark, sf_dir):
    return bounded.limited(table(spark, sf_dir, "labels"), [F.desc("toxic"), F.col("doc_id")], 50)


@query("SELECT p_partkey, p_name, p_size FROM part")
def field_projection(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return bounded.project(part, part.columns, ["p_partkey", "p_name"], [" p_size, p_name", "p_partkey"])


@query("""SELECT doc_id, quality, total, truncated FROM (SELECT doc_id, quality, (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM documents) > 60 AS truncated
FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality NULLS LAST, doc_id LIMIT 60)""")
def evidence_order(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return bounded.limited(rows, bounded.evidence_order("quality", "doc_id"), 60)


@query("""WITH s AS (SELECT conv_id, list(length(text) ORDER BY CASE role WHEN 'user' THEN 0 ELSE 1 END, turn, length(text)) AS a FROM conversations GROUP BY 1),
f AS (SELECT conv_id, len(a) AS n, list_reduce(list_prepend(CAST({'used': 0, 'included': 0} AS STRUCT(used INT, included INT)), list_transform(a, lambda x: CAST({'used': CAST(x AS INT), 'included': 1} AS STRUCT(used INT, included INT)))),
 lambda p, q: CASE WHEN p.used + q.used <= 600 THEN {'used': p.used + q.used, 'included': p.included + 1} ELSE p END) AS r FROM s)
SELECT conv_id, CAST(r.included AS INT) AS included, CAST(n - r.included AS INT) AS omitted, CAST(r.used AS INT) AS used FROM f""")
def context_budget(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("role") == "user", 0).otherwise(1).alias("priority"), "turn", F.length("text").alias("chars"))
    return bounded.whole_sections(turns, ["conv_id"], ["priority", "turn"], "chars", 600)


@query("SELECT doc_id, left(text, 200) AS text, CAST(length(text) AS INT) AS total, length(text) > 200 AS truncated FROM documents")
def bounded_text(spark, sf_dir):
    kept, total, more = bounded.bounded_text(F.col("text"), 200)
    return table(spark, sf_dir, "documents").select("doc_id", kept.alias("text"), total.alias("total"), more.alias("truncated"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(json_extract_string(props, '$.missing')) AS missing FROM events GROUP BY 1")
def json_assets_probe(spark, sf_dir):
    k, missing = F.get_json_object("props", "$.k"), F.get_json_object("props", "$.missing")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k.cast("long")).alias("k"), F.count(missing).alias("missing"))


@query("""SELECT p_type AS plan, min(p_retailprice) AS cost, count(*) AS parts FROM part GROUP BY 1 ORDER BY cost, parts DESC, plan LIMIT 1""")
def plan_choice(spark, sf_dir):
    plans = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("plan")).agg(F.min("p_retailprice").alias("cost"), F.count("*").alias("parts"))
    return bounded.best_plan(plans, [F.col("cost"), F.desc("parts"), F.col("plan")])


@query("SELECT DISTINCT o_orderpriority AS priority, 'orders --status ' || o_orderstatus AS arguments FROM orders ORDER BY 1, 2 LIMIT 3")
def suggestions(spark, sf_dir):
    return bounded.suggestions(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.concat(F.lit("orders --status "), "o_orderstatus").alias("arguments")))


@query(f"""WITH {DOC_FILES} SELECT (SELECT count(DISTINCT source) FROM documents) AS projects, (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM pages) AS pages,
(SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) AS changed""")
def home_view(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    pages = table(spark, sf_dir, "pages").agg(F.count("*").alias("pages"))
    counts = docs.agg(F.countDistinct("source").alias("projects"), F.count("*").alias("files"), F.count_if(F.col("toxic") == 1).alias("changed"))
    return counts.crossJoin(F.broadcast(pages)).select("projects", "files", "pages", "changed")  # one row each


from quernel.plans import code, search, semantic, structure, workspace  # noqa: E402, F401 - they register their queries here
