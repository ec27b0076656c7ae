"""Queries over project graphs, instances, nested declarations and batches of targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.checkpoint import cut
from quernel.functions.identity import symbol_id
from quernel.operators import graph, nesting, targets
from quernel.plans.catalog import DECLARATIONS, declarations, query
from quernel.sources.tables import table

# -- graphs -----------------------------------------------------------------------------------

#: Part k depends on k div 3, even ones on k div 2 too; parts of size 7 and their next ones on each other.
EDGES = """g AS (SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey >= 3 UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey >= 2 AND p_size % 2 = 0
UNION SELECT a.p_partkey, b.p_partkey FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 AND a.p_size = 7 UNION SELECT b.p_partkey, a.p_partkey FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 AND a.p_size = 7)"""


def _edges(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), "p_size")
    thirds = part.where("k >= 3").select(F.col("k").alias("src"), F.expr("k div 3").alias("dst"))
    halves = part.where("k >= 2 AND p_size % 2 = 0").select(F.col("k").alias("src"), F.expr("k div 2").alias("dst"))
    pairs = part.where("p_size = 7").select(F.col("k").alias("a"), (F.col("k") + 1).alias("k")).join(part, "k").select("a", "k")
    return thirds.union(halves).union(pairs.select("a", "k")).union(pairs.select("k", "a")).distinct()


@query(f"""WITH RECURSIVE {EDGES}, n AS (SELECT p_partkey AS node FROM part), r AS (SELECT node AS x, node AS y FROM n UNION SELECT r.x, g.dst FROM r JOIN g ON g.src = r.y),
c AS (SELECT a.x AS node, min(a.y) AS component FROM r a JOIN r b ON a.x = b.y AND a.y = b.x GROUP BY 1),
d AS (SELECT DISTINCT p.component AS a, q.component AS b FROM g JOIN c p ON p.node = g.src JOIN c q ON q.node = g.dst WHERE p.component <> q.component),
l AS (SELECT DISTINCT component, 0 AS level FROM c UNION SELECT d.a, l.level + 1 FROM l JOIN d ON d.b = l.component),
m AS (SELECT component, CAST(max(level) AS INT) AS level FROM l GROUP BY 1)
SELECT node, component, level FROM c JOIN m USING (component)""")
def graph_levels(spark, sf_dir):
    """How deep each part's dependencies go, those on each other taken as one."""
    return graph.levels(_edges(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node")))


BROKEN = f"""{EDGES}, h AS (SELECT * FROM g UNION SELECT p_partkey, -p_partkey FROM part WHERE p_size = 50 AND p_retailprice > 1500),
k AS (SELECT p_partkey AS node, CASE WHEN p_size = 13 AND p_retailprice > 1400 THEN 'failed' ELSE 'evaluated' END AS state FROM part UNION ALL SELECT DISTINCT dst, 'incomplete' FROM h WHERE dst < 0),
up AS (SELECT node FROM k WHERE state <> 'evaluated' UNION SELECT h.src FROM up JOIN h ON h.dst = up.node),
below AS (SELECT src AS node, count(*) AS broken_below FROM h JOIN k ON k.node = dst AND k.state <> 'evaluated' GROUP BY 1),
s AS (SELECT node, state, CASE WHEN state <> 'evaluated' THEN 'failed' WHEN node IN (SELECT node FROM up) THEN 'partial' ELSE 'complete' END AS usable, coalesce(broken_below, 0) AS broken_below FROM k LEFT JOIN below USING (node))"""


def _salvaged(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    missing = part.where("p_size = 50 AND p_retailprice > 1500").select(F.col("p_partkey").cast("long").alias("src"), (-F.col("p_partkey")).cast("long").alias("dst"))
    state = F.when((F.col("p_size") == 13) & (F.col("p_retailprice") > 1400), "failed").otherwise("evaluated")
    return graph.salvaged(part.select(F.col("p_partkey").cast("long").alias("node"), state.alias("state")), _edges(spark, sf_dir).union(missing))


@query(f"WITH RECURSIVE {BROKEN} SELECT * FROM s")
def graph_salvage(spark, sf_dir):
    """What is left of a graph in which some projects failed and some are named but missing."""
    return _salvaged(spark, sf_dir)


@query(f"""WITH RECURSIVE {BROKEN} SELECT CASE WHEN count(*) = count(*) FILTER (usable = 'failed') THEN 'failed' WHEN count(*) FILTER (usable = 'failed') > 0 THEN 'partial' ELSE 'complete' END AS completeness,
count(*) AS projects, count(*) FILTER (usable = 'complete') AS complete, count(*) FILTER (usable = 'partial') AS partial, count(*) FILTER (usable = 'failed') AS failed FROM s""")
def graph_completeness(spark, sf_dir):
    return graph.completeness(_salvaged(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES}, p AS (SELECT (SELECT max(p_partkey) FROM part) AS node, [(SELECT max(p_partkey) FROM part)] AS path, 0 AS length
UNION ALL SELECT g.dst, list_append(path, g.dst), length + 1 FROM p JOIN g ON g.src = p.node WHERE NOT list_contains(path, g.dst) AND length < 16)
SELECT 'found' AS status, length, array_to_string(path, '>') AS path FROM p WHERE node = 1 ORDER BY length, p.path LIMIT 1""")
def path_between(spark, sf_dir):
    """The shortest way from the last part to the first, of several the one of least nodes."""
    last = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    return graph.path_between(_edges(spark, sf_dir), last, 1).select("status", "length", F.array_join("path", ">").alias("path"))


@query("""WITH RECURSIVE s AS (SELECT s_suppkey AS k, (SELECT max(s_suppkey) FROM supplier) AS n FROM supplier),
refs AS (SELECT k AS src, k // 2 AS dst, CASE WHEN k % 3 = 0 THEN 'net' || k % 4 END AS framework, k % 5 = 0 AS drop_configuration, CASE WHEN k % 4 = 1 THEN 'any' END AS platform FROM s WHERE k > 1
  UNION ALL SELECT k, 1 + k * 7 % n, NULL, k % 7 = 3, NULL FROM s WHERE k % 10 = 1),
i AS (SELECT k AS path, 'debug' AS configuration, CAST(NULL AS VARCHAR) AS framework, CAST(NULL AS VARCHAR) AS platform FROM s WHERE k = n
  UNION SELECT r.dst, CASE WHEN NOT drop_configuration THEN i.configuration END, coalesce(r.framework, i.framework), coalesce(r.platform, i.platform) FROM i JOIN refs r ON r.src = i.path)
SELECT path, configuration, framework, platform FROM i""")
def project_instances(spark, sf_dir):
    """The instances that the last supplier's project leads to: references go in cycles, set a framework or platform and drop the configuration."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    n = supplier.agg(F.max("k")).first()[0] or 0
    k = F.col("k")
    pair = lambda key, value: F.create_map(F.lit(key), value)
    none = F.create_map().cast("map<string,string>")
    own = F.when(k % 3 == 0, pair("Framework", F.concat(F.lit("net"), (k % 4).cast("string")))).otherwise(none)
    adds = F.when(k % 4 == 1, F.map_concat(own, pair("PLATFORM", F.lit("any")))).otherwise(own)
    dropped = lambda when: F.when(when, F.array(F.lit("CONFIGURATION"))).otherwise(F.array().cast("array<string>"))
    refs = supplier.where("k > 1").select(k.alias("src"), F.expr("k div 2").alias("dst"), adds.alias("adds"), dropped(k % 5 == 0).alias("removes"))
    refs = refs.unionByName(supplier.where("k % 10 = 1").select(k.alias("src"), (1 + k * 7 % max(n, 1)).alias("dst"), none.alias("adds"), dropped(k % 7 == 3).alias("removes")))
    roots = supplier.where(k == n).select(k.alias("path"), pair("configuration", F.lit("debug")).alias("properties"))
    found, _ = graph.project_instances(roots, refs)
    return found.select("path", *[F.try_element_at("properties", F.lit(p)).alias(p) for p in ("configuration", "framework", "platform")])


# -- nesting ----------------------------------------------------------------------------------

#: Parts as declarations that halve the one around them, 64 in a row; a third of all in one file.
INTERVALS = """p AS (SELECT p_partkey AS id, p_size, p_partkey // 3 AS j, p_partkey % 3 AS f FROM part),
q AS (SELECT *, j % 64 AS i, j // 64 AS row, greatest(CAST(floor(log2(greatest(j % 64, 1)) + 1e-9) AS BIGINT), 0) AS l FROM p),
iv AS (SELECT CASE WHEN f = 0 THEN 'hot.cs' ELSE 'f' || f || '_' || row % 5 || '.cs' END AS path, id, p_size, 64 * row + CASE WHEN i = 0 THEN 0 ELSE (i - CAST(2 ** l AS BIGINT)) * (64 // CAST(2 ** l AS BIGINT)) END AS a, 64 // CAST(2 ** l AS BIGINT) AS w FROM q),
v AS (SELECT path, id, p_size, a AS "start", a + w AS "end" FROM iv),
holds AS (SELECT x.path, x.id, y.id AS up, y."start" AS s, y."end" AS e FROM v x JOIN v y ON x.path = y.path AND y."start" <= x."start" AND y."end" >= x."end" AND (y."start" < x."start" OR y."end" > x."end" OR y.id < x.id)),
nests AS (SELECT v.path, v.id, v.p_size, v."start", v."end", count(up) AS depth, arg_max(up, (s, -e, up)) AS parent FROM v LEFT JOIN holds h ON h.path = v.path AND h.id = v.id GROUP BY ALL)"""


def _intervals(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), "p_size")
    part = part.withColumns({"j": F.expr("id div 3"), "f": F.col("id") % 3}).withColumns({"i": F.col("j") % 64, "row": F.expr("j div 64")})
    part = part.withColumn("w", F.expr("64 div cast(pow(2, floor(log2(greatest(i, 1)) + 1e-9)) as bigint)"))
    start = 64 * F.col("row") + F.when(F.col("i") == 0, 0).otherwise(F.expr("(i - 64 div w) * w"))
    path = F.when(F.col("f") == 0, "hot.cs").otherwise(F.concat(F.lit("f"), F.col("f").cast("string"), F.lit("_"), (F.col("row") % 5).cast("string"), F.lit(".cs")))
    return part.select(path.alias("path"), "id", "p_size", start.alias("start"), (start + F.col("w")).alias("end"))


@query(f"""WITH {INTERVALS} SELECT path, id, depth, parent FROM nests""")
def nesting_of(spark, sf_dir):
    """The parent and depth of each declaration, by where they begin and end."""
    return nesting.nested(_intervals(spark, sf_dir)).select("path", "id", "depth", "parent")


@query(f"""WITH {INTERVALS}, w AS (SELECT path, id FROM v WHERE p_size = 1)
SELECT w.path, w.id AS root, 'holds' AS relation, h.id, n.depth FROM w JOIN holds h ON h.path = w.path AND h.up = w.id JOIN nests n ON n.path = h.path AND n.id = h.id
UNION ALL SELECT w.path, w.id, 'within', h.up, n.depth FROM w JOIN holds h ON h.path = w.path AND h.id = w.id JOIN nests n ON n.path = h.path AND n.id = h.up""")
def context_by_id(spark, sf_dir):
    """For the declarations of size 1: what each holds, and what it is in."""
    given = _intervals(spark, sf_dir)
    nests, wanted = cut(nesting.nested(given)), given.where("p_size = 1").select("path", "id")
    below = nesting.subtrees(nests, wanted).where("root != id").select("path", "root", F.lit("holds").alias("relation"), "id", "depth")
    above = nesting.enclosing(nests, wanted).where("of != id").select("path", F.col("of").alias("root"), F.lit("within").alias("relation"), "id", "depth")
    return below.unionByName(above)


# -- targets ----------------------------------------------------------------------------------

BATCH = f"""{DECLARATIONS}, d AS (SELECT *, sha256(qualified || signature) AS stable, sha256(id::VARCHAR) AS location FROM declarations),
s AS (SELECT d.* FROM d JOIN supplier ON s_suppkey = id),
asked AS (SELECT DISTINCT unnest([qualified, name, lower(name), words[1][1:4], words[2] || words[1], words[1][1] || words[2][1], lower(name)[3:7], words[2][1:3] || words[1][1:2], 'Zz' || name, 'file/q1:' || id, 'symbol/q9:' || id]) AS target FROM s)"""
RANKED_BATCH = f"""{BATCH}, words_of AS (SELECT target, lower(target) AS q, list_transform(list_filter(string_split(trim(regexp_replace(target, '([a-z])([A-Z])', '\\1 \\2', 'g')), ' '), lambda x: x <> ''), lambda x: lower(x)) AS qw FROM asked WHERE NOT contains(target, '/')),
split_words AS (SELECT target, q, CASE WHEN contains(target, '.') THEN list_concat([lower(split_part(target, '.', 1))], list_transform(string_split(regexp_replace(split_part(target, '.', 2), '([a-z])([A-Z])', '\\1 \\2', 'g'), ' '), lambda x: lower(x))) ELSE qw END AS qw FROM words_of),
ranked AS (SELECT target, id, CASE WHEN qualified = target THEN 0 WHEN name = target THEN 1 WHEN lower(name) = q OR lower(qualified) = q THEN 2 WHEN starts_with(lower(name), q) THEN 3
  WHEN len(list_filter(qw, lambda w: len(list_filter(words, lambda x: starts_with(lower(x), w))) = 0)) = 0 OR (len(qw) <= 1 AND starts_with(lower(array_to_string(list_transform(words, lambda x: x[1]), '')), q)) THEN 4
  WHEN contains(lower(name), q) THEN 5 END AS rank FROM split_words, d),
best AS (SELECT target, min(rank) AS rank FROM ranked GROUP BY 1), matches AS (SELECT target, id, CAST(rank AS INT) AS rank FROM ranked JOIN best USING (target, rank))"""


def _asked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = declarations(spark, sf_dir).select("id", "name", "qualified", F.sha2(F.concat("qualified", "signature"), 256).alias("stable"), F.sha2(F.col("id").cast("string"), 256).alias("location"))
    words = F.split(F.regexp_replace("name", "([a-z])([A-Z])", "$1 $2"), " ")
    a, b = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    left = lambda x, n: F.left(x, F.lit(n))
    some = d.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), "id")
    forms = [F.col("qualified"), F.col("name"), F.lower("name"), left(a, 4), F.concat(b, a), F.concat(left(a, 1), left(b, 1)), F.substring(F.lower("name"), 3, 5), F.concat(left(b, 3), left(a, 2)), F.concat(F.lit("Zz"), "name")]
    forms += [F.concat(F.lit("file/q1:"), F.col("id").cast("string")), F.concat(F.lit("symbol/q9:"), F.col("id").cast("string"))]
    return some.select(F.explode(F.array(*forms)).alias("target")).distinct(), d


@query(f"WITH {RANKED_BATCH} SELECT target, id, rank FROM matches")
def target_matches(spark, sf_dir):
    """The best matches of many queries at once: names, their beginnings, words in any order, acronyms, pieces."""
    asked, d = _asked(spark, sf_dir)
    return targets.ranked_matches(targets.forms(asked).where("form = 'query'"), d)


@query(f"""WITH {RANKED_BATCH}, ids AS (SELECT 'same place' AS kind, id, id AS means FROM s UNION ALL SELECT 'moved', id, id FROM s UNION ALL SELECT 'gone', id, NULL FROM s),
idm AS (SELECT kind || ids.id AS target, d.id FROM ids JOIN d ON d.id = means WHERE kind = 'same place' UNION ALL
  SELECT 'moved' || ids.id, e.id FROM ids JOIN d ON d.id = means JOIN d e ON e.name = d.name AND e.stable = d.stable WHERE kind = 'moved'),
al AS (SELECT target, id FROM matches UNION ALL SELECT target, id FROM idm),
every AS (SELECT target, CASE WHEN contains(target, '/') THEN 'unsupported' ELSE 'query' END AS form FROM asked UNION ALL SELECT kind || id, 'id' FROM ids),
c AS (SELECT target, count(*) AS candidates, count(DISTINCT CASE WHEN id % 7 <> 3 THEN stable END) AS groups FROM al JOIN d USING (id) GROUP BY 1)
SELECT target, form, CASE WHEN form = 'unsupported' THEN 'unsupported' WHEN candidates IS NULL AND form = 'id' THEN 'stale' WHEN candidates IS NULL THEN 'not_found' WHEN groups = 1 THEN 'resolved' WHEN groups > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status,
coalesce(candidates, 0) AS candidates, coalesce(groups, 0) AS groups FROM every LEFT JOIN c USING (target)""")
def target_batch(spark, sf_dir):
    """What many targets mean: queries, qualified names, identities at their place, moved and gone, identities of other things."""
    asked, d = _asked(spark, sf_dir)
    k = F.col("id").cast("string")
    some = d.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), "id")
    other = F.sha2(F.concat(F.lit("elsewhere"), k), 256)
    ids = some.select(F.explode(F.array(
        F.struct(F.concat(F.lit("same place"), k).alias("label"), symbol_id(F.col("name"), F.col("stable"), F.col("location")).alias("target")),
        F.struct(F.concat(F.lit("moved"), k).alias("label"), symbol_id(F.col("name"), F.col("stable"), other).alias("target")),
        F.struct(F.concat(F.lit("gone"), k).alias("label"), symbol_id(F.col("name"), other, F.col("location")).alias("target")),
    )).alias("x")).select("x.*")
    placed = d.withColumns({"source": F.concat(F.lit("f"), k), "owner": F.lit("o")})
    bound = F.col("id") % 7 != 3
    variants = placed.select(F.lit("v").alias("variant"), F.lit(None).cast("string").alias("project"), F.array("source").alias("sources"), F.when(bound, "resolved").otherwise("unresolved").alias("status"), F.when(bound, F.col("stable")).alias("symbol"), F.when(~bound, "binding.failed").alias("reason"))
    out, _ = targets.resolve_batch(asked.unionByName(ids.select("target")), placed, variants)
    named = out.join(ids.withColumnRenamed("target", "t").hint("merge"), F.col("target") == F.col("t"), "left")
    return named.select(F.coalesce("label", "target").alias("target"), "form", "status", "candidates", "groups")
