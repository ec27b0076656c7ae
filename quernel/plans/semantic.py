"""Queries over semantic fact tables, with oracles.

Suppliers stand for projects, return flags for frameworks, line statuses for
configurations, parts for symbols and line items for facts about them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.operators import bounded, graph, relationships, semantics
from quernel.plans.catalog import DECLARATIONS, DEPENDENTS, _dependencies, _framed_sql, _functional, _seeds, declarations, query
from quernel.sources.tables import table

# -- coverage ---------------------------------------------------------------------------------

EVIDENCE = """ev AS (SELECT DISTINCT s_name || CASE WHEN s_suppkey % 9 = 4 THEN '.fsproj' ELSE '.csproj' END AS project, s_suppkey AS k, l_linestatus AS configuration, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS framework,
CAST(CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END * 10 + CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS INT) AS position,
CASE WHEN s_suppkey % 10 = 3 THEN false WHEN s_suppkey % 10 = 7 THEN NULL ELSE true END AS sdk_style, CASE WHEN s_suppkey % 11 = 5 THEN 'F#' WHEN s_suppkey % 11 = 6 THEN NULL ELSE 'C#' END AS language,
CASE WHEN s_suppkey % 8 = 2 AND l_returnflag = 'A' THEN 'failed' ELSE 'evaluated' END AS state,
CASE WHEN s_suppkey % 6 = 1 AND l_linestatus = 'O' THEN ['missing_assets'] WHEN s_suppkey % 6 = 5 AND l_returnflag = 'N' THEN ['missing_assets', 'import'] ELSE [] END AS failures
FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_suppkey % 13 <> 0),
pr AS (SELECT s_name || CASE WHEN s_suppkey % 9 = 4 THEN '.fsproj' ELSE '.csproj' END AS project, s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'failed' ELSE 'evaluated' END AS state FROM supplier),
al AS (SELECT project, configuration, framework, position, sdk_style, language, state, failures FROM ev UNION ALL SELECT project, NULL, NULL, CAST(0 AS INT), NULL, NULL, state, [] FROM pr WHERE project NOT IN (SELECT project FROM ev)),
cl AS (SELECT *, CASE WHEN sdk_style = false THEN 'unsupported.shape' WHEN lower(language) <> 'c#' THEN 'unsupported.language' WHEN sdk_style AND NOT ends_with(project, '.csproj') THEN 'unsupported.shape'
  WHEN len(failures) > 0 AND len(list_filter(failures, lambda f: f <> 'missing_assets')) = 0 AND state <> 'failed' THEN 'unrestored.missing_assets' WHEN state <> 'evaluated' OR len(failures) > 0 THEN 'broken.evaluation'
  WHEN sdk_style IS NULL THEN 'unsupported.shape' WHEN language IS NULL THEN 'unsupported.language' WHEN NOT ends_with(project, '.csproj') THEN 'unsupported.shape' ELSE 'supported.' END AS x FROM al),
cv AS (SELECT project, configuration, framework, position, split_part(x, '.', 1) AS coverage, nullif(split_part(x, '.', 2), '') AS issue FROM cl),
se AS (SELECT *, coverage = 'supported' AND position = min(CASE WHEN coverage = 'supported' THEN position END) OVER (PARTITION BY project) AS sel FROM cv),
variants AS (SELECT project, configuration, framework, position, coverage, issue, coalesce(sel, false) AS selected FROM se)"""


def _project(key: str = "s_suppkey"):
    return F.concat("s_name", F.when(F.col(key) % 9 == 4, ".fsproj").otherwise(".csproj"))


def _evidence(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag", "l_linestatus").distinct().join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").hint("merge"), "s_suppkey").where("s_suppkey % 13 != 0")
    k, flag, status = F.col("s_suppkey"), F.col("l_returnflag"), F.col("l_linestatus")
    position = F.when(flag == "N", 1).when(flag == "A", 2).otherwise(3) * 10 + F.when(status == "F", 1).otherwise(2)
    none = F.array().cast("array<string>")
    failures = F.when((k % 6 == 1) & (status == "O"), F.array(F.lit("missing_assets"))).when((k % 6 == 5) & (flag == "N"), F.array(F.lit("missing_assets"), F.lit("import"))).otherwise(none)
    return rows.select(
        _project().alias("project"), status.alias("configuration"), F.when(flag != "R", flag).alias("framework"), position.alias("position"),
        F.when(k % 10 == 3, False).when(k % 10 != 7, True).alias("sdk_style"), F.when(k % 11 == 5, "F#").when(k % 11 != 6, "C#").alias("language"),
        F.when((k % 8 == 2) & (flag == "A"), "failed").otherwise("evaluated").alias("state"), failures.alias("failures"),
    )


def _all_projects(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(_project().alias("project"), F.when(F.col("s_suppkey") % 2 == 0, "failed").otherwise("evaluated").alias("state"), F.col("s_suppkey").alias("k"))


def _coverage(spark, sf_dir, complete: bool = False) -> DataFrame:
    return semantics.project_coverage(_all_projects(spark, sf_dir), _evidence(spark, sf_dir), complete)


@query(f"WITH {EVIDENCE} SELECT * FROM variants")
def coverage_classes(spark, sf_dir):
    """Classes of all project variants; a project without evidence keeps one row."""
    return _coverage(spark, sf_dir)


@query(f"""WITH {EVIDENCE} SELECT CASE WHEN count(*) FILTER (coverage = 'supported' AND selected) = count(*) THEN 'complete' ELSE 'partial' END AS level, count(*) AS considered, count(*) FILTER (coverage = 'supported' AND selected) AS analyzed,
count(*) FILTER (coverage = 'supported' AND NOT selected) AS remaining, count(*) FILTER (coverage = 'unsupported') AS excluded, count(*) FILTER (coverage IN ('broken', 'unrestored')) AS failed FROM variants""")
def coverage_level(spark, sf_dir):
    return semantics.coverage_counts(_coverage(spark, sf_dir))


PLANS = EVIDENCE + """, scope AS (SELECT project FROM pr WHERE k % 3 <> 0 UNION SELECT 'lost' || k || '.csproj' FROM pr WHERE k % 20 = 0), wanted AS (SELECT project FROM pr WHERE k % 3 = 1),
pl AS (SELECT *, project IN (SELECT project FROM wanted) AS w, coverage IN ('supported', 'unrestored') AS usable, selected OR (coverage = 'unrestored' AND position = min(position) OVER (PARTITION BY project)) AS chosen FROM variants WHERE project IN (SELECT project FROM scope)),
plans AS (SELECT project, configuration, framework, CASE WHEN usable AND w AND chosen THEN 'analyzed' WHEN usable THEN 'remaining' WHEN coverage = 'unsupported' THEN 'excluded' ELSE 'failed' END AS disposition,
CASE WHEN usable AND w AND chosen THEN NULL WHEN usable AND w THEN 'framework.not_selected' WHEN usable THEN 'project.not_selected' ELSE 'project.' || issue END AS reason FROM pl
UNION ALL SELECT project, NULL, NULL, 'failed', 'project.coverage_unavailable' FROM scope WHERE project NOT IN (SELECT project FROM variants))"""


def _plans(spark, sf_dir) -> DataFrame:
    p = _all_projects(spark, sf_dir)
    lost = p.where("k % 20 = 0").select(F.concat(F.lit("lost"), F.col("k").cast("string"), F.lit(".csproj")).alias("project"))
    return semantics.variant_plans(_coverage(spark, sf_dir), p.where("k % 3 != 0").select("project").unionByName(lost), p.where("k % 3 = 1").select("project"))


@query(f"WITH {PLANS} SELECT * FROM plans")
def reference_plans(spark, sf_dir):
    """Dispositions of all variants in scope; a project in scope without a variant fails."""
    return _plans(spark, sf_dir)


@query(f"""WITH {PLANS}, co AS (SELECT project, configuration, framework, md5(project) AS fingerprint, CASE WHEN k % 7 = 2 THEN 'compiler.failed' END AS failure FROM ev WHERE k % 5 <> 1)
SELECT p.project, p.configuration, p.framework, CASE WHEN p.disposition = 'analyzed' AND (c.project IS NULL OR c.failure IS NOT NULL) THEN 'failed' ELSE p.disposition END AS disposition,
CASE WHEN p.disposition = 'analyzed' AND c.project IS NULL THEN 'variant.not_found' WHEN p.disposition = 'analyzed' AND c.failure IS NOT NULL THEN c.failure ELSE p.reason END AS reason, CASE WHEN p.disposition = 'analyzed' THEN c.fingerprint END AS fingerprint
FROM plans p LEFT JOIN co c ON c.project IS NOT DISTINCT FROM p.project AND c.configuration IS NOT DISTINCT FROM p.configuration AND c.framework IS NOT DISTINCT FROM p.framework""")
def compiler_join(spark, sf_dir):
    """Plans meet compiler variants; null frameworks equal each other."""
    keys = _all_projects(spark, sf_dir).select("project", "k")
    compiled = _evidence(spark, sf_dir).join(keys, "project").where("k % 5 != 1").select("project", "configuration", "framework", F.md5("project").alias("fingerprint"), F.when(F.col("k") % 7 == 2, "compiler.failed").alias("failure"))
    return semantics.with_compiler(_plans(spark, sf_dir), compiled)


@query("""WITH m AS (SELECT 'all.sln' AS solution, s_suppkey AS k FROM supplier UNION ALL SELECT 'some.sln', s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)
SELECT solution, 'P' || k || '/p.csproj' AS project FROM m WHERE k % 4 <> 0 GROUP BY ALL""")
def solution_members(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), "s_suppkey")
    path = F.concat(F.lit("P"), "k", F.lit("/p.csproj"))
    members = s.select(F.lit("all.sln").alias("solution"), F.upper(path).alias("project")).unionByName(s.where("s_suppkey % 3 = 0").select(F.lit("some.sln").alias("solution"), path.alias("project"))).unionByName(s.select(F.lit("all.sln").alias("solution"), path.alias("project")))
    return semantics.solution_projects(members, s.where("s_suppkey % 4 != 0").select(path.alias("project")))


# -- targets ----------------------------------------------------------------------------------

#: Candidates of a target are the parts of a name; a part's symbol in a variant goes by its key, so some parts share one.
TARGETS = """c AS (SELECT p_name AS target, p_partkey AS id, CAST(p_partkey % 3 AS INT) AS rank, 'f' || p_partkey AS source, 'o' || p_partkey % 40 AS owner FROM part),
v AS (SELECT 'v' || g AS variant, g FROM range(0, 4) t(g)),
held AS (SELECT id, variant, CASE WHEN id % 7 = 3 THEN 'unresolved' ELSE 'resolved' END AS status, CASE WHEN id % 7 <> 3 THEN 's' || (id // 40) || '.' || (id % 40 // 20) END AS symbol, CASE WHEN id % 7 = 3 THEN 'binding.failed' END AS reason FROM c, v WHERE (id + g) % 4 < 2 AND id % 9 <> 5),
failed AS (SELECT id, 'bad' || (id % 40) AS variant, 'unresolved' AS status, CAST(NULL AS VARCHAR) AS symbol, 'project.failed' AS reason FROM c WHERE id % 40 < 5),
best AS (SELECT * FROM c QUALIFY rank = min(rank) OVER (PARTITION BY target)),
either AS (SELECT * FROM held UNION SELECT * FROM failed),
states AS (SELECT target, id AS candidate, variant, status, symbol, reason FROM best JOIN either USING (id) UNION ALL SELECT target, id, NULL, 'unresolved', NULL, 'ownership.not_found' FROM best WHERE id NOT IN (SELECT id FROM either))"""


def _candidates(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("target"), k.alias("id"), (k % 3).cast("int").alias("rank"), F.concat(F.lit("f"), k.cast("string")).alias("source"), F.concat(F.lit("o"), (k % 40).cast("string")).alias("owner"))


def _variants(spark, sf_dir) -> DataFrame:
    """Each part in two of four variants, as a row of one source; and failed variants of five owners."""
    k = F.col("id")
    held = _candidates(spark, sf_dir).where("id % 9 != 5").withColumn("g", F.explode(F.array(*[F.lit(i) for i in range(4)]))).where("(id + g) % 4 < 2")
    resolved = k % 7 != 3
    symbol = F.concat(F.lit("s"), F.expr("cast(id div 40 as string)"), F.lit("."), F.expr("cast(id % 40 div 20 as string)"))
    rows = held.select(
        F.concat(F.lit("v"), F.col("g").cast("string")).alias("variant"), F.lit(None).cast("string").alias("project"), F.array("source").alias("sources"),
        F.when(resolved, "resolved").otherwise("unresolved").alias("status"), F.when(resolved, symbol).alias("symbol"), F.when(~resolved, "binding.failed").alias("reason"),
    )
    failed = spark.range(5).select(
        F.concat(F.lit("bad"), F.col("id").cast("string")).alias("variant"), F.concat(F.lit("o"), F.col("id").cast("string")).alias("project"), F.array().cast("array<string>").alias("sources"),
        F.lit("failed").alias("status"), F.lit(None).cast("string").alias("symbol"), F.lit("project.failed").alias("reason"),
    )
    return rows.unionByName(failed)


def _best(spark, sf_dir) -> DataFrame:
    c = _candidates(spark, sf_dir)
    return c.join(c.groupBy("target").agg(F.min("rank").alias("best")), "target").where("rank = best").drop("best")


@query(f"WITH {TARGETS} SELECT * FROM states")
def target_states(spark, sf_dir):
    """Candidates in every variant that holds their source, or failed in their owner."""
    return semantics.states_of(_best(spark, sf_dir), _variants(spark, sf_dir))


GROUPS = f"""RECURSIVE {TARGETS}, sh AS (SELECT DISTINCT target, candidate, variant, symbol FROM states WHERE status = 'resolved'),
e AS (SELECT DISTINCT a.target, a.candidate AS x, b.candidate AS y FROM sh a JOIN sh b USING (target, variant, symbol)),
r AS (SELECT DISTINCT target, candidate AS x, candidate AS y FROM states UNION SELECT r.target, r.x, e.y FROM r JOIN e ON e.target = r.target AND e.x = r.y),
grouped AS (SELECT target, x AS candidate, min(y) AS grouping FROM r GROUP BY 1, 2)"""


@query(f"WITH {GROUPS} SELECT * FROM grouped")
def same_symbol_groups(spark, sf_dir):
    return semantics.same_symbol(semantics.states_of(_best(spark, sf_dir), _variants(spark, sf_dir)))


@query(f"""WITH {TARGETS}, o AS (SELECT *, row_number() OVER (PARTITION BY target, variant ORDER BY CASE WHEN status = 'resolved' THEN 0 ELSE 1 END, candidate) AS n FROM states WHERE variant IS NOT NULL)
SELECT target, variant, status, symbol, reason FROM o WHERE n = 1""")
def variant_merge(spark, sf_dir):
    """One row a variant, a resolved one before others."""
    return semantics.merged_variants(semantics.states_of(_best(spark, sf_dir), _variants(spark, sf_dir)), ["target"])


RESOLVED = f"""{GROUPS}, t AS (SELECT DISTINCT target FROM c UNION SELECT 'no such name' UNION SELECT 'file/q1:x' UNION SELECT 'symbol/q9:x'),
n AS (SELECT target, count(*) AS candidates FROM best GROUP BY 1), g AS (SELECT target, count(DISTINCT grouping) AS groups FROM grouped WHERE candidate IN (SELECT candidate FROM states WHERE status = 'resolved') GROUP BY 1),
res AS (SELECT target, CASE WHEN starts_with(target, 'file/') OR starts_with(target, 'symbol/') THEN 'unsupported' WHEN candidates IS NULL THEN 'not_found' WHEN groups = 1 THEN 'resolved' WHEN groups > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status,
coalesce(candidates, 0) AS candidates, coalesce(groups, 0) AS groups FROM t LEFT JOIN n USING (target) LEFT JOIN g USING (target))"""


def _resolved(spark, sf_dir) -> DataFrame:
    c = _candidates(spark, sf_dir)
    asked = c.select("target").unionByName(spark.createDataFrame([("no such name",), ("file/q1:x",), ("symbol/q9:x",)], "target string"))
    return semantics.resolve_targets(asked, c, _variants(spark, sf_dir))


@query(f"WITH {RESOLVED} SELECT * FROM res")
def target_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query(f"""WITH {RESOLVED}, a AS (SELECT target, id, CAST(row_number() OVER (PARTITION BY target ORDER BY rank, id) AS INT) AS place, count(*) OVER (PARTITION BY target) AS total FROM c WHERE target IN (SELECT target FROM res WHERE status = 'ambiguous'))
SELECT target, id, place, total, greatest(total - 20, 0) AS omitted FROM a WHERE place <= 20""")
def target_ambiguity(spark, sf_dir):
    return semantics.ambiguity(_resolved(spark, sf_dir), _candidates(spark, sf_dir))


# -- verification -----------------------------------------------------------------------------

BOUND = """b AS (SELECT p_partkey AS id, p_type AS name, 'method' AS symbol_kind, 'h' || p_size AS asked FROM part),
f AS (SELECT l_partkey AS id, l_returnflag || l_linestatus AS variant, CASE WHEN l_quantity > 45 THEN 'h-old' ELSE 'h' || p_size END AS content_hash, CASE WHEN l_discount > 0.08 THEN 'failed' ELSE 'bound' END AS status,
CASE WHEN l_discount > 0.08 AND l_tax > 0.04 THEN 'binding.ambiguous' END AS reason, CASE WHEN l_linenumber = 1 THEN p_type ELSE 'OTHER' END AS name, CASE WHEN l_linenumber = 3 THEN NULL ELSE 'method' END AS symbol_kind FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT b.id, variant, CASE WHEN variant IS NULL OR asked <> content_hash OR status <> 'bound' THEN 1 WHEN f.name = b.name AND f.symbol_kind IS NOT DISTINCT FROM b.symbol_kind THEN 2 ELSE 0 END AS s,
CASE WHEN variant IS NULL THEN 'ownership.not_found' WHEN asked <> content_hash THEN 'evidence.stale' WHEN status <> 'bound' THEN coalesce(reason, 'binding.unresolved') WHEN NOT (f.name = b.name AND f.symbol_kind IS NOT DISTINCT FROM b.symbol_kind) THEN 'invocation.other_symbol' END AS reason
FROM b LEFT JOIN f ON f.id = b.id)"""


@query(f"WITH {BOUND} SELECT id, ['rejected', 'unresolved', 'verified'][max(s) + 1] AS status, count(variant) AS variants, coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (reason IS NOT NULL)), '; '), '') AS reasons FROM m GROUP BY 1")
def verify_invocations(spark, sf_dir):
    """Candidates held against what compilers bound at their places: stale, unbound, other and equal symbols."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("p_type"), F.concat(F.lit("h"), F.col("p_size").cast("string")).alias("h"))
    candidates = part.select("id", F.col("h").alias("content_hash"), F.lit("method").alias("symbol_kind"), F.col("p_type").alias("name"))
    item = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_partkey")).join(part.hint("merge"), "id")
    failed = F.col("l_discount") > 0.08
    bound = item.select(
        "id", F.concat("l_returnflag", "l_linestatus").alias("variant"), F.when(F.col("l_quantity") > 45, "h-old").otherwise(F.col("h")).alias("content_hash"), F.when(failed, "failed").otherwise("bound").alias("status"),
        F.when(failed & (F.col("l_tax") > 0.04), "binding.ambiguous").alias("reason"), F.when(F.col("l_linenumber") == 1, F.col("p_type")).otherwise("OTHER").alias("name"), F.when(F.col("l_linenumber") != 3, "method").alias("symbol_kind"),
    )
    return semantics.verified(candidates, bound, "invocation")


@query("""WITH h AS (SELECT p_partkey AS id, l_returnflag AS variant, 'verified' AS status, CAST(NULL AS VARCHAR) AS reason FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_linenumber = 1 AND l_returnflag <> 'R'),
f AS (SELECT p_partkey AS id, 'R' || p_size % 10 AS variant, 'unresolved' AS status, 'project.failed' AS reason FROM part WHERE p_size % 10 < 4),
a AS (SELECT * FROM h UNION SELECT * FROM f) SELECT * FROM a UNION ALL SELECT p_partkey, NULL, 'unresolved', 'ownership.not_found' FROM part WHERE p_partkey NOT IN (SELECT id FROM a)""")
def verify_plan(spark, sf_dir):
    """Candidates with their variants, and with the failed variants of the projects that own them."""
    candidates = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("source"), (F.col("p_size") % 10).alias("owner"))
    none = F.lit(None).cast("string")
    ok = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_returnflag != 'R'").select(F.col("l_returnflag").alias("variant"), F.lit(None).cast("int").alias("project"), F.array("l_partkey").alias("sources"), F.lit("verified").alias("status"), none.alias("reason"))
    bad = spark.range(4).select(F.concat(F.lit("R"), F.col("id").cast("string")).alias("variant"), F.col("id").cast("int").alias("project"), F.array().cast("array<bigint>").alias("sources"), F.lit("failed").alias("status"), F.lit("project.failed").alias("reason"))
    return semantics.verification_plan(candidates, ok.unionByName(bad))


# -- relationships ----------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier WHERE s_suppkey > 1),
x AS (SELECT s_suppkey AS node, 0 AS depth FROM supplier WHERE s_suppkey IN (3, 5) UNION SELECT e.src, depth + 1 FROM x JOIN e ON e.dst = x.node WHERE e.src % 7 <> 0) SELECT node, CAST(min(depth) AS INT) AS depth FROM x GROUP BY 1""")
def scope_without_tests(spark, sf_dir):
    """Dependents of projects; those of test projects are not gone through."""
    tests = table(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("node"))
    return semantics.relationship_scope(_dependencies(spark, sf_dir), _seeds(spark, sf_dir), tests)


FACTS = """facts AS (SELECT 'p' || l_partkey AS identity, 'a' || l_partkey % 3 AS assembly, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS framework, l_suppkey AS project, l_linestatus AS configuration,
'o' || l_orderkey AS path, l_linenumber AS start, CAST(l_quantity AS INT) AS length FROM lineitem)"""


@query(f"""WITH {DEPENDENTS}, {FACTS}, asked AS (SELECT DISTINCT f.framework, 'p' || p_partkey AS identity, 'a' || p_size % 3 AS assembly FROM part, (VALUES ('N'), (NULL)) AS f(framework) WHERE p_size <= 20)
SELECT DISTINCT 'reference/q1:' || sha256({_framed_sql("'reference/q1'", "f.identity", "CAST(project AS VARCHAR)", "configuration", "coalesce(f.framework, '')", "path", "CAST(start AS VARCHAR)", "CAST(length AS VARCHAR)")}) AS id, f.identity, f.framework, project, path
FROM facts f JOIN asked a ON a.identity = f.identity AND a.assembly = f.assembly AND a.framework IS NOT DISTINCT FROM f.framework WHERE project IN (SELECT node FROM reach) AND path IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def reference_search(spark, sf_dir):
    """References by identity, assembly and framework in the scope's projects and eligible files, with their identities."""
    item = table(spark, sf_dir, "lineitem")
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    facts = item.select(
        text("p", "l_partkey").alias("identity"), F.concat(F.lit("a"), (F.col("l_partkey") % 3).cast("string")).alias("assembly"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("framework"),
        F.col("l_suppkey").alias("project"), F.col("l_linestatus").alias("configuration"), text("o", "l_orderkey").alias("path"), F.col("l_linenumber").alias("start"), F.col("l_quantity").cast("int").alias("length"),
    )
    asked = table(spark, sf_dir, "part").where("p_size <= 20").select(F.explode(F.array(F.lit("N"), F.lit(None).cast("string"))).alias("framework"), text("p", "p_partkey").alias("identity"), F.concat(F.lit("a"), (F.col("p_size") % 3).cast("string")).alias("assembly"))
    scope = semantics.relationship_scope(_dependencies(spark, sf_dir), _seeds(spark, sf_dir)).select(F.col("node").alias("project"))
    eligible = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(text("o", "o_orderkey").alias("path"))
    return semantics.references(facts, asked, scope, eligible).select("id", "identity", "framework", "project", "path")


@query(f"""WITH {TARGETS} SELECT DISTINCT CASE WHEN variant IN ('v0', 'v1') THEN 'N' END AS framework, symbol AS identity, 'asm' || variant AS assembly FROM states WHERE status = 'resolved' AND variant <> 'v3'""")
def target_descriptors(spark, sf_dir):
    known = spark.createDataFrame([("v0", "N", "asmv0"), ("v1", "N", "asmv1"), ("v2", None, "asmv2")], "variant string, framework string, assembly string")
    return semantics.descriptors(semantics.states_of(_best(spark, sf_dir), _variants(spark, sf_dir)), known)


TYPES = """RECURSIVE te AS (SELECT p_partkey AS t, p_partkey // 3 AS b FROM part WHERE p_partkey >= 3 UNION SELECT p_partkey, p_partkey // 5 FROM part WHERE p_partkey % 4 = 0 AND p_partkey >= 5),
down AS (SELECT t, 1 AS d FROM te WHERE b = 2 AND t <> 2 UNION SELECT te.t, d + 1 FROM down JOIN te ON te.b = down.t WHERE d < 30),
me AS (SELECT p_partkey AS m, p_partkey // 2 AS b, CASE WHEN p_size % 3 = 0 THEN 'explicit' ELSE 'override' END AS kind FROM part WHERE p_partkey >= 2),
ov AS (SELECT m FROM me WHERE kind = 'override' AND b = 2 UNION SELECT me.m FROM ov JOIN me ON me.b = ov.m WHERE me.kind = 'override')"""


def _type_edges(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("type"))
    bases = part.where("type >= 3").select("type", F.expr("type div 3").alias("base"))
    return bases.unionByName(part.where("type % 4 = 0 AND type >= 5").select("type", F.expr("type div 5").alias("base")))


def _member_edges(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey >= 2").select(F.col("p_partkey").alias("member"), F.expr("p_partkey div 2").alias("base"), F.when(F.col("p_size") % 3 == 0, "explicit").otherwise("override").alias("kind"))


def _two(spark) -> DataFrame:
    return spark.createDataFrame([(2,)], "node long")


@query(f"WITH {TYPES} SELECT t AS symbol, CAST(min(d) AS INT) AS depth FROM down GROUP BY 1")
def derived_types(spark, sf_dir):
    return semantics.derived_types(_type_edges(spark, sf_dir), _two(spark))


@query(f"WITH {TYPES} SELECT m AS symbol, 'override' AS kind FROM ov WHERE m <> 2 UNION SELECT m, 'explicit' FROM me WHERE kind = 'explicit' AND b = 2")
def member_overrides(spark, sf_dir):
    return semantics.overriding_members(_member_edges(spark, sf_dir), _two(spark))


@query(f"""WITH {TYPES}, found AS (SELECT t AS s FROM down UNION SELECT m FROM ov WHERE m <> 2 UNION SELECT m FROM me WHERE kind = 'explicit' AND b = 2 UNION SELECT p_partkey FROM part WHERE p_partkey % 500 = 1)
SELECT p_partkey AS symbol, p_type AS kind, p_name AS name FROM part WHERE p_partkey IN (SELECT s FROM found) AND p_size > 5 AND p_type <> 'SMALL'""")
def implementation_search(spark, sf_dir):
    """Types below a target, members that override or implement it, and what another finder told, once each; in sources only, no interfaces."""
    part = table(spark, sf_dir, "part")
    declared = part.select(F.col("p_partkey").alias("symbol"), F.when(F.col("p_type") == "SMALL", "interface").otherwise(F.col("p_type")).alias("kind"), (F.col("p_size") > 5).alias("in_source"), F.col("p_name").alias("name"))
    elsewhere = part.where("p_partkey % 500 = 1").select(F.col("p_partkey").alias("symbol"))
    return semantics.implementations(_type_edges(spark, sf_dir), _member_edges(spark, sf_dir), declared, _two(spark), elsewhere).select("symbol", "kind", "name")


CALLS = "calls AS (SELECT DISTINCT l_suppkey AS caller, l_partkey % 100 AS callee FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 4)"


def _calls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_quantity < 4").select(F.col("l_suppkey").alias("caller"), (F.col("l_partkey") % 100).alias("callee"))


@query(f"WITH RECURSIVE {CALLS}, x AS (SELECT CAST(2 AS BIGINT) AS node, 0 AS depth UNION SELECT caller, depth + 1 FROM x JOIN calls ON callee = node WHERE depth < 2) SELECT node AS symbol, CAST(min(depth) AS INT) AS depth FROM x GROUP BY 1 HAVING min(depth) > 0")
def callers(spark, sf_dir):
    return semantics.callers(_calls(spark, sf_dir), _two(spark), 2)


@query(f"WITH {CALLS} SELECT DISTINCT callee AS symbol, CAST(1 AS INT) AS depth FROM calls WHERE caller = 2 AND callee <> 2")
def callees(spark, sf_dir):
    return semantics.callees(_calls(spark, sf_dir), _two(spark))


@query("""WITH i AS (SELECT s_suppkey AS id, 'p' || s_suppkey % 40 AS path, s_suppkey < 40 AND s_suppkey % 2 = 0 AS outer_ FROM supplier), r AS (SELECT s_suppkey AS src, 'p' || (s_suppkey * 7) % 45 AS path FROM supplier),
o AS (SELECT id AS o, path FROM i WHERE outer_), n AS (SELECT id AS n, path FROM i WHERE NOT outer_), single AS (SELECT path, min(n) AS dst FROM n WHERE path NOT IN (SELECT path FROM o) GROUP BY 1 HAVING count(*) = 1),
t AS (SELECT path, o AS dst FROM o UNION SELECT path, n FROM o JOIN n USING (path) UNION SELECT * FROM single)
SELECT o AS src, n AS dst FROM o JOIN n USING (path) UNION SELECT src, dst FROM r JOIN t USING (path) WHERE src IN (SELECT n FROM n)""")
def build_edges(spark, sf_dir):
    """Outer builds lead to their inner ones, references to both."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    instances = s.select("id", F.concat(F.lit("p"), (F.col("id") % 40).cast("string")).alias("path"), ((F.col("id") < 40) & (F.col("id") % 2 == 0)).alias("outer"))
    return graph.build_edges(instances, s.select(F.col("id").alias("src"), F.concat(F.lit("p"), (F.col("id") * 7 % 45).cast("string")).alias("path")))


@query("""WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS src, (CAST(n_nationkey AS BIGINT) * n_nationkey + 1) % (SELECT count(*) FROM nation) AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + 1) % 6 FROM nation WHERE n_nationkey < 6),
x AS (SELECT [src] AS path, dst AS nxt FROM e WHERE dst >= src UNION ALL SELECT list_append(path, nxt), e.dst FROM x JOIN e ON e.src = nxt WHERE nxt > path[1] AND NOT list_contains(path, nxt) AND len(path) < 8)
SELECT array_to_string(path, '>') AS cycle, CAST(len(path) AS INT) AS size FROM x WHERE nxt = path[1]""")
def cycle_paths(spark, sf_dir):
    """Every simple cycle once, from its least node on."""
    ring = table(spark, sf_dir, "nation").where("n_nationkey < 6").select(F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") + 1) % 6).cast("long").alias("dst"))
    found = graph.cycle_paths(_functional(spark, sf_dir).unionByName(ring))
    return found.select(F.array_join("cycle", ">").alias("cycle"), F.size("cycle").alias("size"))


# -- bounded results and maps -----------------------------------------------------------------


@query("SELECT p_partkey, p_size, total, truncated, total - 40 AS omitted, 'parts --full' AS retrieval FROM (SELECT p_partkey, p_size, (SELECT count(*) FROM part) AS total, (SELECT count(*) FROM part) > 40 AS truncated FROM part ORDER BY p_size, p_partkey LIMIT 40)")
def bounded_envelope(spark, sf_dir):
    return bounded.enveloped(table(spark, sf_dir, "part").select("p_partkey", "p_size"), [F.col("p_size"), F.col("p_partkey")], 40, "parts --full")


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'own' ELSE 'global' END AS configuration, 'net' || s_nationkey AS framework, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 3 END AS INT) AS n FROM supplier")
def property_maps(spark, sf_dir):
    """Global properties, a project's own over them, some taken out; names in lower case."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    base = F.create_map(F.lit("configuration"), F.lit("global"), F.lit("platform"), F.lit("any"))
    own = F.create_map(F.lit("targetframework"), F.concat(F.lit("net"), F.col("s_nationkey").cast("string")))
    own = F.when(F.col("k") % 2 == 0, F.map_concat(own, F.create_map(F.lit("configuration"), F.lit("own")))).otherwise(own)
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)
    kept = F.map_filter(merged, lambda k, _: (k != "platform") | (F.col("k") % 3 != 0))
    return s.select("k", F.try_element_at(kept, F.lit("configuration")).alias("configuration"), F.try_element_at(kept, F.lit("targetframework")).alias("framework"), F.size(kept).alias("n"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_per_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return bounded.first_per(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


# -- from a target's name to references and coverage ------------------------------------------


@query(f"""WITH RECURSIVE {EVIDENCE}, names AS (SELECT s_suppkey AS k, s_name || CASE WHEN s_suppkey % 9 = 4 THEN '.fsproj' ELSE '.csproj' END AS project FROM supplier),
up AS (SELECT 3 AS k UNION SELECT s_suppkey FROM up JOIN supplier ON s_suppkey > 1 AND s_suppkey // 2 = up.k), scope AS (SELECT project FROM names JOIN up USING (k)),
pl AS (SELECT *, coverage IN ('supported', 'unrestored') AS usable, selected OR (coverage = 'unrestored' AND position = min(position) OVER (PARTITION BY project)) AS chosen FROM variants WHERE project IN (SELECT project FROM scope)),
plans AS (SELECT project, configuration, framework, CASE WHEN usable AND chosen THEN 'analyzed' WHEN usable THEN 'remaining' WHEN coverage = 'unsupported' THEN 'excluded' ELSE 'failed' END AS disposition FROM pl
  UNION ALL SELECT project, NULL, NULL, 'failed' FROM scope WHERE project NOT IN (SELECT project FROM variants)),
{DECLARATIONS}, t AS (SELECT qualified AS q FROM declarations ORDER BY id LIMIT 1), f AS (SELECT names.project, l_linestatus AS configuration, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS framework, 'o' || l_orderkey AS path, l_linenumber AS start
  FROM lineitem JOIN declarations ON id = l_partkey JOIN names ON k = l_suppkey WHERE split_part(qualified, '.', 1) = (SELECT split_part(q, '.', 1) FROM t) AND (l_returnflag IS NULL OR l_returnflag <> 'A')),
r AS (SELECT DISTINCT f.* FROM f JOIN plans p ON p.project = f.project AND p.configuration IS NOT DISTINCT FROM f.configuration AND p.framework IS NOT DISTINCT FROM f.framework AND disposition = 'analyzed'),
c AS (SELECT count(*) AS considered, count(*) FILTER (disposition = 'analyzed') AS analyzed, count(*) FILTER (disposition = 'remaining') AS remaining, count(*) FILTER (disposition = 'excluded') AS excluded, count(*) FILTER (disposition = 'failed') AS failed FROM plans)
SELECT path, start, project, configuration, framework, (SELECT count(*) FROM r) AS total, CASE WHEN considered > analyzed THEN 'partial' ELSE 'complete' END AS level, considered, analyzed, remaining, excluded, failed
FROM r, c ORDER BY path, start LIMIT 50""")
def reference_end_to_end(spark, sf_dir):
    """The references of a brand's symbol, named by the least declaration of it: resolution, scope, plans, facts and coverage in one query."""
    d = declarations(spark, sf_dir).select("id", "name", "qualified", "namespace", F.sha2(F.concat("qualified", "signature"), 256).alias("stable"), F.sha2(F.col("id").cast("string"), 256).alias("location"))
    name = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), _project().alias("project"))
    owner = name.where("k = 3").select(F.col("project").alias("owner"))
    d = d.withColumn("source", F.concat(F.lit("f"), F.col("id").cast("string"))).crossJoin(F.broadcast(owner))  # one row
    frameworks = F.explode(F.array(F.lit("N"), F.lit(None).cast("string")))
    none = F.lit(None).cast("string")
    bound = d.select("*", frameworks.alias("framework")).groupBy("namespace", "framework").agg(F.collect_set("source").alias("sources"))
    variants = bound.select(F.concat(F.col("namespace"), F.lit("/"), F.coalesce("framework", F.lit("any"))).alias("variant"), none.alias("project"), "sources", F.lit("resolved").alias("status"), F.col("namespace").alias("symbol"), none.alias("reason"), "framework", F.lit("lib").alias("assembly"))
    up = name.select("k", "project").where("k > 1").withColumn("b", F.expr("k div 2"))
    edges = up.join(name.select(F.col("k").alias("b"), F.col("project").alias("dst")).hint("merge"), "b").select(F.col("project").alias("src"), "dst")
    # both grow with the input, though their compressed tables stay under the limit of bytes for a broadcast
    item = table(spark, sf_dir, "lineitem").join(d.select(F.col("id").alias("l_partkey"), "namespace").hint("merge"), "l_partkey").join(name.withColumnRenamed("k", "l_suppkey").hint("merge"), "l_suppkey")
    facts = item.select(
        F.col("namespace").alias("identity"), F.lit("lib").alias("assembly"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("framework"), "project", F.col("l_linestatus").alias("configuration"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("path"), F.col("l_linenumber").alias("start"), F.lit(1).alias("length"),
    )
    target = d.agg(F.min_by("qualified", "id")).first()[0] or "none"
    out = relationships.references_of(target, d, variants, edges, _coverage(spark, sf_dir), facts, 50)
    c = F.col("evidence.coverage")
    rows = out.select(F.explode("rows").alias("r"), "total", *[c[n].alias(n) for n in ("level", "considered", "analyzed", "remaining", "excluded", "failed")])
    return rows.select("r.path", "r.start", "r.project", "r.configuration", "r.framework", "total", "level", "considered", "analyzed", "remaining", "excluded", "failed")


# -- candidates of the other kinds ------------------------------------------------------------


def _kind_sql(kind: str, same: str) -> str:
    return f"""WITH b AS (SELECT p_partkey AS id, p_type AS type, 'constructor' AS symbol_kind, 'h' || p_size AS asked FROM part),
f AS (SELECT l_partkey AS id, l_returnflag || l_linestatus AS variant, CASE WHEN l_quantity > 45 THEN 'h-old' ELSE 'h' || p_size END AS content_hash, CASE WHEN l_discount > 0.08 THEN 'failed' ELSE 'bound' END AS status,
CASE WHEN l_linenumber <= 2 THEN p_type ELSE 'OTHER' END AS type, CASE WHEN l_linenumber = 2 THEN 'method' ELSE 'constructor' END AS symbol_kind FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT b.id, variant, CASE WHEN variant IS NULL OR asked <> content_hash OR status <> 'bound' THEN 1 WHEN {same} THEN 2 ELSE 0 END AS s,
CASE WHEN variant IS NULL THEN 'ownership.not_found' WHEN asked <> content_hash THEN 'evidence.stale' WHEN status <> 'bound' THEN 'binding.unresolved' WHEN NOT ({same}) THEN '{kind}.other_symbol' END AS reason FROM b LEFT JOIN f ON f.id = b.id)
SELECT id, ['rejected', 'unresolved', 'verified'][max(s) + 1] AS status, count(variant) AS variants, coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (reason IS NOT NULL)), '; '), '') AS reasons FROM m GROUP BY 1"""


def _held(spark, sf_dir, kind: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_type", F.concat(F.lit("h"), F.col("p_size").cast("string")).alias("h"))
    candidates = part.select("id", F.col("h").alias("content_hash"), F.lit("constructor").alias("symbol_kind"), F.col("p_type").alias("type"))
    item = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_partkey")).join(part.hint("merge"), "id")
    bound = item.select(
        "id", F.concat("l_returnflag", "l_linestatus").alias("variant"), F.when(F.col("l_quantity") > 45, "h-old").otherwise(F.col("h")).alias("content_hash"), F.when(F.col("l_discount") > 0.08, "failed").otherwise("bound").alias("status"),
        F.lit(None).cast("string").alias("reason"), F.when(F.col("l_linenumber") <= 2, F.col("p_type")).otherwise("OTHER").alias("type"), F.when(F.col("l_linenumber") == 2, "method").otherwise("constructor").alias("symbol_kind"),
    )
    return semantics.verified(candidates, bound, kind)


@query(_kind_sql("attribute", "f.type = b.type AND f.symbol_kind = b.symbol_kind"))
def verify_attributes(spark, sf_dir):
    """An attribute is one if its type and the kind of its symbol agree."""
    return _held(spark, sf_dir, "attribute")


@query(_kind_sql("object_creation", "f.type = b.type"))
def verify_creations(spark, sf_dir):
    return _held(spark, sf_dir, "object_creation")


@query(_kind_sql("catch", "f.type = b.type"))
def verify_catches(spark, sf_dir):
    return _held(spark, sf_dir, "catch")
