"""Queries over C# sources and worktrees, with oracles.

A part stands for a source file: its template is filled from the part's columns,
so what a file declares, calls and catches is known without reading it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel import commands
from quernel.functions.identity import entity_id, parsed_symbol_id, symbol_id
from quernel.operators import analysis, bounded, context, csharp, files, symbols, text
from quernel.plans.catalog import DOC_FILES, LINES, _framed_sql, _literal, query
from quernel.sources import projects, worktree
from quernel.sources.tables import document_files, table

NAME_SQL = "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), '')"
#: Lines of a source; words in braces are columns, [a|b] is chosen by the key.
SOURCE = [
    "namespace {space};", "/// <summary>{type}</summary>", "{attribute}", "public class {name}{base}", "{{", "    private int size = {size};",
    "    public int Run(string text, List<int> values)", "    {{", "        Console.WriteLine(text);", "        {creation}", "        try {{ Process<int>(text); }}",
    "        {catch}", "        return size;", "    }}", "}}",
]
CHOICES = {
    "attribute": ["[Serializable]", '[Fact, Trait("a", "b")]'],
    "base": [" : IBase", "", ""],
    "creation": ["var a = new Widget({size});", "Widget a = new({size});"],
    "catch": ["catch (IOException) {{ }}", "catch (System.Exception e) {{ Log(e); }}", "catch {{ }}"],
}


def sources(spark, sf_dir) -> DataFrame:
    """(path, text, k, name, space, type, size) of one C# file a part."""
    name = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), name.alias("name"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("space"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))

    def filled(template: str):
        parts, rest = [], template
        while rest:
            at = rest.find("{")
            close = rest.find("}}")
            if at < 0 and close < 0:
                parts.append(F.lit(rest))
                break
            if close >= 0 and (at < 0 or close < at):
                parts.append(F.lit(rest[:close] + "}"))
                rest = rest[close + 2 :]
            elif rest.startswith("{{", at):
                parts.append(F.lit(rest[:at] + "{"))
                rest = rest[at + 2 :]
            else:
                end = rest.index("}", at)
                key = rest[at + 1 : end]
                options = CHOICES.get(key)
                parts.append(F.lit(rest[:at]))
                parts.append(F.col(key).cast("string") if options is None else F.element_at(F.array(*[filled(o) for o in options]), (F.col("k") % len(options) + 1).cast("int")))
                rest = rest[end + 1 :]
        return F.concat(*parts) if parts else F.lit("")

    body = F.concat_ws("\n", *[filled(x) for x in SOURCE])
    path = F.concat(F.lit("src/"), "space", F.lit("/"), "name", F.lit("_"), F.col("k").cast("string"), F.lit(".cs"))
    return part.select(path.alias("path"), body.alias("text"), "k", "name", "space", "type", "size")


def _filled_sql(template: str) -> str:
    out = template.replace("'", "''")
    for key, options in CHOICES.items():
        if "{" + key + "}" in out:
            chosen = "CASE k % " + str(len(options)) + " " + " ".join(f"WHEN {i} THEN {_filled_sql(o)}" for i, o in enumerate(options)) + " END"
            out = out.replace("{" + key + "}", f"' || {chosen} || '")
    for key in ("name", "space", "type", "size"):
        out = out.replace("{" + key + "}", f"' || {key} || '")
    return "'" + out.replace("{{", "{").replace("}}", "}") + "'"


SOURCES = f"""p AS (SELECT p_partkey AS k, {NAME_SQL} AS name, replace(p_brand, '#', '') AS space, p_type AS type, p_size AS size FROM part),
sources AS (SELECT 'src/' || space || '/' || name || '_' || k || '.cs' AS path, {" || chr(10) || ".join(_filled_sql(x) for x in SOURCE)} AS text, * FROM p)"""


def _facts(spark, sf_dir, *kinds: str) -> DataFrame:
    return csharp.syntax_facts(sources(spark, sf_dir), list(kinds))


@query(f"WITH {SOURCES} SELECT path, 'Process' AS name, CAST(11 AS INT) AS line, CAST(15 AS INT) AS \"column\" FROM sources")
def cs_invocation(spark, sf_dir):
    return csharp.invocations(_facts(spark, sf_dir, "invocation"), "Process").select("path", "name", "line", "column")


@query(f"WITH {SOURCES} SELECT path, name, 'Fact,Trait' AS attributes, CAST(4 AS INT) AS line, CAST(8 AS INT) AS \"column\" FROM sources WHERE k % 2 = 1")
def cs_class_attribute(spark, sf_dir):
    return csharp.classes_with(_facts(spark, sf_dir, "class"), "FactAttribute").select("path", "name", F.array_join("attributes", ",").alias("attributes"), "line", "column")


@query(f"""WITH {SOURCES} SELECT path, CASE WHEN k % 2 = 0 THEN 'exact' ELSE 'unresolved' END AS type_match, CAST(10 AS INT) AS line, CAST(CASE WHEN k % 2 = 0 THEN 17 ELSE 20 END AS INT) AS "column" FROM sources""")
def cs_object_creation(spark, sf_dir):
    return csharp.object_creations(_facts(spark, sf_dir, "object_creation"), "Widget").select("path", "type_match", "line", "column")


@query(f"""WITH {SOURCES} SELECT path, CASE WHEN k % 3 = 0 THEN 'IOException' ELSE '' END AS name, CAST(12 AS INT) AS line, CAST(9 AS INT) AS "column" FROM sources WHERE k % 3 <> 1""")
def cs_catch_empty(spark, sf_dir):
    return csharp.catches(_facts(spark, sf_dir, "catch"), empty=True).select("path", "name", "line", "column")


@query(f"WITH {SOURCES} SELECT path, 'body' AS detail FROM sources WHERE k % 3 = 1")
def cs_catch_type(spark, sf_dir):
    return csharp.catches(_facts(spark, sf_dir, "catch"), "Exception").select("path", "detail")


@query(f"""WITH {SOURCES}, d(kind, member, accessibility, signature, line, "column") AS (VALUES ('class', NULL, 'public', '', 4, 8), ('field', 'size', 'private', '', 6, 5), ('method', 'Run', 'public', '(string, List<int>)', 7, 5))
SELECT path, kind, coalesce(member, name) AS name, space || '.' || name || coalesce('.' || member, '') AS qualified, space AS namespace, accessibility, signature, CAST(line AS INT) AS line, CAST("column" AS INT) AS "column" FROM sources, d""")
def cs_declarations(spark, sf_dir):
    return csharp.declarations(_facts(spark, sf_dir, *csharp.DECLARED)).select("path", "kind", "name", "qualified", "namespace", "accessibility", "signature", "line", "column")


@query(f"""WITH {SOURCES}, d(seq, kind, member, signature, depth) AS (VALUES (1, 'class', NULL, '', 0), (2, 'field', 'size', '', 1))
SELECT path, CAST(seq AS INT) AS seq, kind, coalesce(member, name) AS name, signature, CAST(depth AS INT) AS depth, CAST(3 AS INT) AS total FROM sources, d""")
def cs_outline(spark, sf_dir):
    return csharp.outline(_facts(spark, sf_dir, *csharp.DECLARED), 2)


@query(f"""WITH {SOURCES}, d(kind, member, parameters, members, lines) AS (VALUES ('class', NULL, 0, 2, 12), ('field', 'size', 0, 0, 1), ('method', 'Run', 2, 0, 8))
SELECT path, kind, coalesce(member, name) AS name, CASE WHEN kind = 'class' THEN '<summary>' || type || '</summary>' ELSE '' END AS documentation, CAST(CASE WHEN kind = 'class' THEN 1 + k % 2 ELSE 0 END AS INT) AS attributes,
CAST(parameters AS INT) AS parameters, CAST(0 AS INT) AS type_parameters, CAST(members AS BIGINT) AS members, CAST(CASE WHEN kind = 'class' AND k % 3 = 0 THEN 1 ELSE 0 END AS INT) AS bases, CAST(1 AS BIGINT) AS overloads, CAST(lines AS INT) AS lines FROM sources, d""")
def cs_show_symbol(spark, sf_dir):
    s = sources(spark, sf_dir)
    shown = context.show_symbol(csharp.syntax_facts(s, csharp.DECLARED), s)
    return shown.select("path", "kind", "name", "documentation", "attributes", "parameters", "type_parameters", "members", "bases", "overloads", "lines")


@query(f"""WITH {SOURCES}, c AS (SELECT *, instr(text, 'Process<int>') - 1 AS start, 'Process<int>(text)' AS body FROM sources)
SELECT path, 'syntax/q1:' || sha256({_framed_sql("'syntax/q1'", "'invocation'", "'invocation:Process'", "path", "'false'", "sha256(text)", "CAST(start AS VARCHAR)", "CAST(length(body) AS VARCHAR)", "body")}) AS id FROM c""")
def syntax_id(spark, sf_dir):
    s = sources(spark, sf_dir)
    return csharp.identified(csharp.invocations(csharp.syntax_facts(s, ["invocation"]), "Process"), s, "invocation:Process").select("path", "id")


@query(f"WITH {DOC_FILES} SELECT path, 'file/q1:' || sha256({_framed_sql(chr(39) + 'file/q1' + chr(39), 'path', chr(39) + 'false' + chr(39))}) AS id FROM doc_files")
def file_id(spark, sf_dir):
    return document_files(spark, sf_dir).select("path", entity_id("file", path=F.col("path"), external=F.lit(False)).alias("id"))


@query(_literal("tionth", False) + f""" SELECT f.path, line, "column", 'text/q1:' || sha256({_framed_sql("'text/q1'", "sha256(text)", "f.path", "CAST(line AS VARCHAR) || ':' || CAST(\"column\" AS VARCHAR)", "'6'", "'tionth'", "'ignore-case'")}) AS id FROM found f JOIN doc_files d ON d.path = f.path""")
def text_id(spark, sf_dir):
    docs = document_files(spark, sf_dir)
    found = text.search_literal(docs, "tionth").join(docs.select("path", F.sha2("text", 256).alias("h")), "path")
    place = F.concat_ws(":", "line", "column")
    return found.select("path", "line", "column", entity_id("text", content_hash=F.col("h"), path=F.col("path"), start=place, length=F.length("match"), query=F.lit("tionth"), mode=F.lit("ignore-case")).alias("id"))


@query(f"WITH {SOURCES} SELECT k, name, sha256(name) AS stable, sha256(path) AS location FROM sources")
def symbol_id_parse(spark, sf_dir):
    """Identities are written and read back."""
    made = sources(spark, sf_dir).select("k", symbol_id(F.col("name"), F.sha2("name", 256), F.sha2("path", 256)).alias("id"))
    return made.select("k", parsed_symbol_id(F.col("id")).alias("x")).select("k", "x.name", "x.stable", "x.location")


KINDS_SQL = "['class', 'struct', 'interface', 'enum-member'][k % 4 + 1]"
ACCESS_SQL = "['public', 'internal', 'private'][k % 3 + 1]"


def _declared(spark, sf_dir) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("k") % n + 1).cast("int"))
    return sources(spark, sf_dir).select(
        F.col("k").alias("id"), "path", "name", F.concat_ws(".", "space", F.concat(F.lit("N"), (F.col("k") % 5).cast("string"))).alias("namespace"), F.concat_ws(".", "space", "name").alias("qualified"),
        pick(["class", "struct", "interface", "enum-member"], 4).alias("kind"), pick(["public", "internal", "private"], 3).alias("accessibility"), F.array("space").alias("owning_projects"),
        (F.col("size") % 7 == 0).alias("is_test"), (F.col("size") % 11 == 0).alias("is_generated"),
    )


@query(f"""WITH {SOURCES} SELECT k AS id, name, {KINDS_SQL} AS kind, {ACCESS_SQL} AS accessibility FROM sources
WHERE {KINDS_SQL} IN ('class', 'enum-member') AND {ACCESS_SQL} IN ('public', 'private') AND (space || '.N' || k % 5 = 'Brand1' OR starts_with(space || '.N' || k % 5, 'Brand1.') OR space || '.N' || k % 5 = 'Brand2.N3' OR starts_with(space, 'Brand2.N3.'))
AND size % 7 <> 0 AND size % 11 <> 0""")
def symbol_filters(spark, sf_dir):
    d = _declared(spark, sf_dir)
    common = dict(kinds=["class", "enum-member"], accessibilities=["public", "private"], include_tests=False, include_generated=False)
    found = symbols.filtered(d, namespace="Brand1", **common).unionByName(symbols.filtered(d, namespace="Brand2.N3", **common))
    return found.select("id", "name", "kind", "accessibility")


@query(f"""WITH {SOURCES}, n AS (SELECT k, name, row_number() OVER (PARTITION BY name ORDER BY k) AS place, count(*) OVER (PARTITION BY name) AS total FROM sources)
SELECT a.k AS request, b.k AS id, CAST(b.place AS INT) AS place, b.total, greatest(b.total - 3, 0) AS omitted FROM sources a JOIN n b USING (name) WHERE a.k % 50 = 0 AND b.place <= 3""")
def symbol_replacements(spark, sf_dir):
    """Stale identities: what they name has other stable parts now."""
    d = sources(spark, sf_dir).select(F.col("k").alias("id"), "name", F.concat("name", F.lit("!")).alias("stable"), F.col("k").cast("string").alias("exact"))
    asked = sources(spark, sf_dir).where("k % 50 = 0").select(F.col("k").alias("request"), "name", F.lit("gone").alias("stable"), F.lit("gone").alias("exact"))
    return symbols.replacements(symbols.resolve(asked, d), asked, d, 3)


# -- text -------------------------------------------------------------------------------------


@query(f"""WITH {DOC_FILES} SELECT path, CAST(len(string_split(lower(text), 'e.' || chr(10))) - 1 AS BIGINT) AS matches FROM doc_files WHERE contains(lower(text), 'e.' || chr(10))""")
def text_literal_lines(spark, sf_dir):
    """A query that goes over a line end."""
    found = text.search_literal(document_files(spark, sf_dir), "E.\n")
    return found.groupBy("path").agg(F.count("*").alias("matches"))


@query(_literal("thing", False) + """ SELECT path, line, "column", match FROM found""")
def text_literal_ci(spark, sf_dir):
    return text.search_literal(document_files(spark, sf_dir), "Thing").select("path", "line", "column", "match")


@query("""WITH n AS (SELECT n_name AS path, length(n_name) AS n FROM nation), p AS (SELECT path, n, unnest(range(0, n + 1)) AS pos FROM n),
d AS (SELECT path, pos, pos < n AND regexp_matches(substring(path, pos + 1, 1), '[0-9]') AS digit, pos > 0 AND regexp_matches(substring(path, pos, 1), '[0-9]') AS before FROM p)
SELECT path, CAST(1 AS INT) AS line, CAST(pos + 1 AS INT) AS "column", CASE WHEN digit THEN regexp_extract(substring(path, pos + 1), '^[0-9]+') ELSE '' END AS match FROM d WHERE (digit AND NOT before) OR NOT digit""")
def text_regex_empty(spark, sf_dir):
    """A pattern that may match nothing: it does wherever it can't match more."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.col("n_name").alias("text"))
    return text.search_regex(nations, "[0-9]*").select("path", "line", "column", "match")


@query(_literal("the", False) + " SELECT path, count(*) AS matches FROM found GROUP BY path")
def text_match_counts(spark, sf_dir):
    return text.match_counts(document_files(spark, sf_dir), "the")


SKIPPED = f"""WITH {DOC_FILES}, s AS (SELECT path, CASE WHEN quality IS NULL THEN 'unobserved' WHEN quality = 0 THEN 'undecodable' ELSE 'searched' END AS status FROM doc_files LEFT JOIN labels USING (doc_id)),
x AS (SELECT * FROM s WHERE status <> 'searched'), n AS (SELECT status, count(*) AS n FROM x GROUP BY 1), f AS (SELECT status, path FROM x ORDER BY path LIMIT 20)
SELECT status, n, path FROM n LEFT JOIN f USING (status)"""


@query(SKIPPED)
def text_skip_details(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    status = F.when(F.col("quality").isNull(), "unobserved").when(F.col("quality") == 0, "undecodable").otherwise("searched")
    return text.skip_details(document_files(spark, sf_dir).join(labels, "doc_id", "left").select("path", status.alias("status")), 20)


@query(f"""WITH {DOC_FILES}, l AS (SELECT path, string_split_regex(text, '\\r\\n|\\n|\\r') AS a, sha256(text) AS h FROM doc_files WHERE path = (SELECT min(path) FROM doc_files))
SELECT path, 'ok' AS status, CAST(1 AS INT) AS first_line, CAST(least(2, len(a)) AS INT) AS last_line, left(array_to_string(a[1:2], chr(10)), 100) AS text, CAST(greatest(length(array_to_string(a[1:2], chr(10))) - 100, 0) AS INT) AS omitted, h AS content_hash FROM l
UNION ALL SELECT path, 'changed', NULL, NULL, NULL, NULL, h FROM l""")
def document_changed(spark, sf_dir):
    """One document shown as it is, and held against the hash of an older text."""
    docs = document_files(spark, sf_dir)
    path = docs.agg(F.min("path")).first()[0]
    return context.show_document(docs, path, 1, 2, 100).unionByName(context.show_document(docs, path, 1, 2, 100, expected="older"))


# -- worktrees --------------------------------------------------------------------------------

IGNORE_FILES = [("", "# comment\n*7.txt\n!src2/**/17.txt\n/src9\nde/\n"), ("src3", "fr/*\n!fr/1*.txt\n"), ("src4/es", "\n*.txt\n!3*.txt\n")]


@query(rf"""WITH {DOC_FILES}, f AS (SELECT path, source AS s, lang AS l, doc_id || '.txt' AS n FROM doc_files)
SELECT path FROM f WHERE s = 'src9' OR l = 'de'
OR CASE WHEN s = 'src4' AND l = 'es' THEN NOT regexp_matches(n, '^3[^/]*\.txt$') WHEN s = 'src3' AND l = 'fr' THEN NOT regexp_matches(n, '^1[^/]*\.txt$') ELSE regexp_matches(n, '7\.txt$') AND NOT (s = 'src2' AND n = '17.txt') END""")
def ignore_files(spark, sf_dir):
    """Rule files of three directories; deeper ones come later."""
    rules = spark.createDataFrame([(f"{d}/.ignore".lstrip("/"), t) for d, t in IGNORE_FILES], "path string, text string")
    return worktree.ignored_paths(document_files(spark, sf_dir), worktree.ignore_rules(rules))


PLACED = f"""{SOURCES}, placed AS (SELECT CASE k % 6 WHEN 0 THEN path WHEN 1 THEN 'bin/' || path WHEN 2 THEN 'lib/OBJ/' || path WHEN 3 THEN '.git/' || path WHEN 4 THEN '../' || path ELSE replace(path, '.cs', '.g.cs') END AS path, k FROM sources)"""


def _placed(spark, sf_dir) -> DataFrame:
    p = F.col("path")
    where = F.when(F.col("k") % 6 == 0, p).when(F.col("k") % 6 == 1, F.concat(F.lit("bin/"), p)).when(F.col("k") % 6 == 2, F.concat(F.lit("lib/OBJ/"), p)).when(F.col("k") % 6 == 3, F.concat(F.lit(".git/"), p)).when(F.col("k") % 6 == 4, F.concat(F.lit("../"), p))
    return sources(spark, sf_dir).select(where.otherwise(F.replace(p, F.lit(".cs"), F.lit(".g.cs"))).alias("path"), "text", "k")


@query(f"WITH {PLACED} SELECT path, k % 6 = 4 AS external FROM placed WHERE k % 6 = 0 OR (k % 6 = 4 AND starts_with(path, '../src/Brand1/'))")
def worktree_files(spark, sf_dir):
    """Without version-control data, build output, generated code and unnamed roots outside."""
    return worktree.traversed(_placed(spark, sf_dir), external=["../src/Brand1"]).select("path", "external")


@query(f"WITH {PLACED} SELECT path FROM placed WHERE k % 6 IN (0, 5) AND (starts_with(path, 'src/Brand2/') OR starts_with(path, 'src/Brand3/')) UNION ALL SELECT path FROM placed WHERE k % 6 = 1 AND starts_with(path, 'bin/src/')")
def worktree_scopes(spark, sf_dir):
    """Explicit scopes, one of them inside build output."""
    return worktree.traversed(_placed(spark, sf_dir), scopes=["src/Brand2", "src/Brand3", "bin/src"], include_generated=True).select("path")


@query("SELECT 'src2' AS root, 'solution' AS kind UNION ALL SELECT '', 'version-control' UNION ALL SELECT 'src1/en', 'directory'")
def workspace_root(spark, sf_dir):
    docs = document_files(spark, sf_dir).select("path")
    with_solution = docs.unionByName(spark.createDataFrame([("src2/all.sln",), ("src2/en/one.csproj",)], "path string"))
    with_git = with_solution.unionByName(spark.createDataFrame([(".git/HEAD",)], "path string"))
    return worktree.workspace(with_solution, "src2/en").unionByName(worktree.workspace(with_git, "src2/en")).unionByName(worktree.workspace(docs, "src1/en"))


@query("""SELECT 'selected' AS state, 'explicit-project' AS source, 'src2/en/one.csproj' AS path, 1 AS n UNION ALL SELECT 'not_found', 'explicit-solution', 'x.sln', 1
UNION ALL SELECT 'selected', 'configuration', 'src2/en/one.csproj', 1 UNION ALL SELECT 'ambiguous', NULL, NULL, 2 UNION ALL SELECT 'selection_required', NULL, NULL, 0""")
def entry_points(spark, sf_dir):
    docs = document_files(spark, sf_dir).select("path").unionByName(spark.createDataFrame([("src2/en/one.csproj",)], "path string"))
    two = docs.unionByName(spark.createDataFrame([("a.sln",), ("b.slnx",)], "path string"))
    found = worktree.entry_point(docs, project="src2/en/one.csproj").unionByName(worktree.entry_point(two, solution="x.sln")).unionByName(worktree.entry_point(two, configured="src2/en/one.csproj"))
    found = found.unionByName(worktree.entry_point(two)).unionByName(worktree.entry_point(docs))
    return found.select("state", "source", "path", F.size("candidates").alias("n"))


@query(f"WITH {SOURCES}, c AS (SELECT path, space FROM sources) SELECT CASE WHEN space IN ('Brand1', 'Brand2') THEN 'owned' ELSE 'file-based-source' END AS kind, count(*) AS n FROM c WHERE space NOT IN ('Brand1', 'Brand2') GROUP BY 1 UNION ALL SELECT 'solution-filter', 1 UNION ALL SELECT 'unsupported-project', 1")
def workspace_capabilities(spark, sf_dir):
    extra = spark.createDataFrame([("src/Brand1/a.csproj",), ("src/Brand2/b.csproj",), ("x.slnf",), ("y.fsproj",)], "path string")
    return worktree.capabilities(sources(spark, sf_dir).select("path").unionByName(extra)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {DOC_FILES}, c AS (SELECT path FROM doc_files JOIN labels USING (doc_id) WHERE toxic = 1) SELECT path FROM doc_files WHERE path IN (SELECT path FROM c) AND source = 'src1'""")
def changed_files(spark, sf_dir):
    docs = document_files(spark, sf_dir)
    changed = docs.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id").select("path")
    return files.in_changed(files.matching(docs, scopes=["src1"]), changed).select("path")


@query(f"""WITH {DOC_FILES}, o AS (SELECT path, source AS project FROM doc_files WHERE source IN ('src1', 'src2') UNION SELECT path, 'tool' FROM doc_files WHERE doc_id % 10 = 3),
x AS (SELECT path, doc_id % 10 = 7 AS external FROM doc_files)
SELECT path, external FROM x WHERE external OR path IN (SELECT path FROM o)""")
def ownership_scope(spark, sf_dir):
    """Files below a project, files that a project links, and external ones."""
    docs = document_files(spark, sf_dir).withColumn("external", F.col("doc_id") % 10 == 7)
    projects_ = spark.createDataFrame([("src1",), ("src2",)], "directory string")
    linked = docs.where("doc_id % 10 = 3").select(F.lit("tool").alias("project"), "path")
    return files.in_ownership(docs, files.owners(docs, projects_, linked)).select("path", "external")


@query("SELECT s_name || '/' || s_name || '.csproj' AS project, 'net' || s_nationkey || CASE WHEN s_nationkey = 9 THEN '' ELSE ',net9' END AS frameworks, s_name || '/../lib/x.csproj' AS raw, 'lib/x.csproj' AS reference FROM supplier")
def xml_projects(spark, sf_dir):
    """Project files made from suppliers, and read."""
    s = table(spark, sf_dir, "supplier")
    body = F.concat(F.lit("<Project><PropertyGroup><TargetFrameworks>net"), F.col("s_nationkey").cast("string"), F.lit(";net9;$(More)</TargetFrameworks></PropertyGroup><ItemGroup><ProjectReference Include=\"..\\lib\\x.csproj\" /></ItemGroup></Project>"))
    made = s.select(F.concat("s_name", F.lit("/"), "s_name", F.lit(".csproj")).alias("path"), body.alias("text"), "s_name")
    read = projects.project_metadata(made).join(made.select(F.col("path").alias("project"), "s_name"), "project")
    return read.select("project", F.array_join("frameworks", ",").alias("frameworks"), F.concat("s_name", F.lit("/../lib/x.csproj")).alias("raw"), F.get("references", F.lit(0)).alias("reference"))


# -- analysis and commands --------------------------------------------------------------------


@query(f"""WITH {SOURCES} SELECT path, 12 AS line, 'catch.empty' AS rule, 'warning' AS severity, 'scan,syntax' AS engines FROM sources WHERE k % 3 = 0
UNION ALL SELECT path, 12, 'catch.empty', 'warning', 'syntax' FROM sources WHERE k % 3 = 2 UNION ALL SELECT path, 11, 'call.process', 'info', 'syntax' FROM sources""")
def analyze_findings(spark, sf_dir):
    """Two engines find the same places; a finding is told once, with both."""
    facts = _facts(spark, sf_dir, "catch", "invocation")
    rules = {"catch.empty": ("warning", (F.col("kind") == "catch") & (F.col("detail") == "empty")), "call.process": ("info", (F.col("kind") == "invocation") & (F.col("name") == "Process"))}
    scanned = text.search_literal(sources(spark, sf_dir), "catch (IOException) { }", True).select("path", "line", F.lit("catch.empty").alias("rule"), F.lit("info").alias("severity"), F.lit("scan").alias("engine"))
    return analysis.merged_findings(analysis.findings(facts, rules, "syntax").unionByName(scanned))


@query(f"""WITH {SOURCES} SELECT 'has-name' AS "check", 'passed' AS state, CAST(0 AS BIGINT) AS broken, count(*) AS considered FROM sources
UNION ALL SELECT 'small', CASE WHEN count(*) FILTER (size > 40) = 0 THEN 'passed' ELSE 'failed' END, count(*) FILTER (size > 40), count(*) FROM sources""")
def validate_profile(spark, sf_dir):
    return analysis.validated(sources(spark, sf_dir), [analysis.Check("has-name", F.col("name") == ""), analysis.Check("small", F.col("size") > 40)])


@query(f"""WITH {SOURCES}, f AS (SELECT path, name, space FROM sources WHERE contains(lower(path), 'red')), r AS (SELECT path, CASE WHEN contains(lower(regexp_extract(path, '[^/]*$')), 'red') THEN CASE WHEN starts_with(lower(regexp_extract(path, '[^/]*$')), 'red') THEN 3 ELSE 4 END ELSE 7 END AS rank FROM f)
SELECT path, 'source' AS kind, total, total > 30 AS truncated, greatest(total - 30, 0) AS omitted, CASE WHEN total > 30 THEN 'search file --full' END AS retrieval FROM (SELECT path, count(*) OVER () AS total,
row_number() OVER (ORDER BY rank, instr(lower(path), 'red'), length(regexp_extract(path, '[^/]*$')), length(path), path) AS n FROM r) WHERE n <= 30""")
def command_search_file(spark, sf_dir):
    return commands.search_file(commands.Corpus(sources(spark, sf_dir)), "red", extensions=["cs"], limit=30, fields=["kind"])


@query(f"""WITH {SOURCES}, m AS (SELECT path AS file, 9 AS line, 17 AS "column" FROM sources WHERE space = 'Brand3') SELECT file, CAST(line AS INT) AS line, CAST("column" AS INT) AS "column", '        Console.WriteLine(text);' AS preview,
CASE WHEN (SELECT count(*) FROM m) <= 5 THEN (SELECT count(*) FROM m) END AS total, (SELECT count(*) FROM m) <= 5 AS total_known FROM m ORDER BY file LIMIT 5""")
def command_search_text(spark, sf_dir):
    return commands.search_text(commands.Corpus(sources(spark, sf_dir)), "writeline", paths=["src/Brand3"], limit=5, fields=["column"])


@query(f"""WITH {SOURCES}, m AS (SELECT path, name, CASE WHEN lower(name) = 'redbolt' THEN 2 WHEN starts_with(lower(name), 'red') THEN 3 ELSE 4 END AS rank FROM sources WHERE starts_with(lower(name), 'red') OR len(list_filter(string_split_regex(name, '(?=[A-Z])'), lambda x: starts_with(lower(x), 'red'))) > 0)
SELECT 'class' AS kind, name, path AS file, CAST(4 AS INT) AS line, (SELECT count(*) FROM sources WHERE starts_with(name, 'Red')) AS total, (SELECT count(*) FROM sources WHERE starts_with(name, 'Red')) > 1000000 AS truncated, CAST(0 AS BIGINT) AS omitted, CAST(NULL AS VARCHAR) AS retrieval FROM sources WHERE starts_with(name, 'Red')""")
def command_search_symbol(spark, sf_dir):
    """Classes whose name begins with a word that no other hump begins with."""
    return commands.search_symbol(commands.Corpus(sources(spark, sf_dir)), "Red", kinds=["class"], include_tests=True, limit=1_000_000)


@query(f"""WITH {SOURCES} SELECT path AS file, CAST(12 AS INT) AS line, 'catch' AS construct, (SELECT count(*) FROM sources WHERE k % 3 = 0) AS total, (SELECT count(*) FROM sources WHERE k % 3 = 0) > 25 AS truncated,
greatest((SELECT count(*) FROM sources WHERE k % 3 = 0) - 25, 0) AS omitted, CASE WHEN (SELECT count(*) FROM sources WHERE k % 3 = 0) > 25 THEN 'search syntax --full' END AS retrieval FROM sources WHERE k % 3 = 0 ORDER BY path LIMIT 25""")
def command_search_syntax(spark, sf_dir):
    return commands.search_syntax(commands.Corpus(sources(spark, sf_dir)), "catch", "IOException", empty=True, limit=25, fields=["construct"])


@query(f"WITH {SOURCES} SELECT '' AS root, 'project' AS kind, CAST(0 AS BIGINT) AS solutions, CAST(1 AS BIGINT) AS projects, count(*) AS sources, (SELECT count(*) FROM sources WHERE k % 5 = 0) AS changed, CAST(0 AS BIGINT) AS capabilities FROM sources")
def command_home(spark, sf_dir):
    s = sources(spark, sf_dir)
    with_project = s.select("path", "text").unionByName(spark.createDataFrame([("all.csproj", "")], "path string, text string"))
    return commands.home(commands.Corpus(with_project, changed=s.where("k % 5 = 0").select("path")))


@query(f"""WITH {SOURCES}, one AS (SELECT * FROM sources WHERE path = (SELECT min(path) FROM sources))
SELECT CAST(x.seq AS INT) AS seq, x.kind, coalesce(x.member, name) AS name, x.signature, CAST(x.depth AS INT) AS depth, CAST(3 AS INT) AS total, path AS file
FROM one, (VALUES (1, 'class', NULL, '', 0), (2, 'field', 'size', '', 1), (3, 'method', 'Run', '(string, List<int>)', 1)) AS x(seq, kind, member, signature, depth)""")
def command_outline(spark, sf_dir):
    s = sources(spark, sf_dir)
    return commands.outline(commands.Corpus(s), s.agg(F.min("path")).first()[0])


@query("SELECT l_suppkey AS supplier, l_orderkey AS orderkey, place, total, omitted FROM (SELECT l_suppkey, l_orderkey, CAST(row_number() OVER w AS INT) AS place, count(*) OVER (PARTITION BY l_suppkey) AS total, greatest(count(*) OVER (PARTITION BY l_suppkey) - 4, 0) AS omitted FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey)) WHERE place <= 4")
def capped_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_orderkey").alias("orderkey")).distinct()
    return bounded.capped(rows, ["supplier"], ["orderkey"], 4)
