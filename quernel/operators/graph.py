"""Graph queries over edge tables: closures, components, cycles, paths, impact.

Edges are (src, dst). Loops run on the driver, rows never do: each round is one
join with the edges and one anti-join with what is known, cut by a checkpoint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.checkpoint import cut


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def closure(edges: DataFrame, seeds: DataFrame, most: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(node, depth): all that the seeds (node) reach, seeds at depth 0, within ``most`` steps and over ``allowed`` nodes if given.

    What a round adds is written once; what is known is read from the rounds.
    """
    edges = edges.select("src", "dst").distinct()
    if allowed is not None:
        edges = edges.join(allowed.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    edges = cut(edges)
    known = frontier = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while most is None or depth < most:
        depth += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.take(1):
            break
        known = known.unionByName(frontier)
        if depth % 16 == 0:  # a plan of few parts
            known = cut(known)
    return known


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): direct successors of the seeds, and the seeds."""
    return edges.join(seeds.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).union(seeds.select("node")).distinct()


def spread_least(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (node, label) lowered along edges to the least label that reaches a node."""
    labels = cut(labels)
    while True:
        sent = labels.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "label")
        new = cut(labels.unionByName(sent).groupBy("node").agg(F.min("label").alias("label")))
        changed = new.alias("n").join(labels.alias("o"), "node").where(F.col("n.label") != F.col("o.label"))
        if not changed.take(1):
            return new
        labels = new


def components(edges: DataFrame) -> DataFrame:
    """(node, component, cyclic): strongly connected components by trimming and colouring.

    Nodes without predecessors or successors are components of their own. In
    each round the least ancestor colours a node; those that reach back to their
    colour's node inside the colour are its component. A node alone is cyclic
    only with a loop.
    """
    edges = cut(edges.select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    loops = edges.where("src = dst").select(F.col("src").alias("node")).withColumn("loop", F.lit(True))
    left, rest, done = cut(nodes), cut(edges.where("src != dst")), []
    while left.take(1):
        stay = cut(rest.select(F.col("src").alias("node")).distinct().intersect(rest.select(F.col("dst").alias("node")).distinct()))
        lone = cut(left.join(stay, "node", "left_anti").withColumn("component", F.col("node")))
        if not lone.take(1):
            color = spread_least(rest, left.withColumn("label", F.col("node")))
            inside = rest.join(color.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(color.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
            back = closure_within(reverse(inside), color.where("node = label"))
            lone = cut(back.select("node", F.col("label").alias("component")))
            stay = cut(left.join(lone.select("node"), "node", "left_anti"))
        done.append(lone)  # what is done is written once, but for a plan of few parts
        if len(done) == 16:
            done = [cut(reduce(DataFrame.unionByName, done))]
        left = stay
        rest = cut(rest.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    done = reduce(DataFrame.unionByName, done) if done else nodes.withColumn("component", F.col("node"))
    sizes = done.groupBy("component").agg(F.count("*").alias("n"))
    out = done.join(sizes, "component").join(loops, "node", "left")
    return out.select("node", "component", ((F.col("n") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic"))


def closure_within(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, label): what each root (node, label) reaches over edges that stay inside its label."""
    known = frontier = cut(roots.select("node", "label"))
    edges = cut(edges.select("src", "dst"))
    while True:
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "label").distinct()
        frontier = cut(step.join(known, ["node", "label"], "left_anti"))
        if not frontier.take(1):
            return known
        known = cut(known.unionByName(frontier))


def cycles(edges: DataFrame) -> DataFrame:
    """(component, size, first, last) of the cyclic components; members come by ``components``."""
    return components(edges).where("cyclic").groupBy("component").agg(F.count("*").alias("size"), F.min("node").alias("first"), F.max("node").alias("last"))


def shortest_paths(edges: DataFrame, source: int, most: int = 32) -> DataFrame:
    """(node, depth, path): a shortest path from the source to each node within ``most`` steps; of several the least by its nodes."""
    spark = edges.sparkSession
    edges = cut(edges.select("src", "dst").distinct())
    kind = edges.schema["src"].dataType
    start = spark.range(1).select(F.lit(source).cast(kind).alias("node"), F.lit(0).alias("depth"), F.array(F.lit(source).cast(kind)).alias("path"))
    known = frontier = cut(start)
    for depth in range(1, most + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("node").agg(F.min("path").alias("path")).withColumn("depth", F.lit(depth)).select("node", "depth", "path")
        frontier = cut(step.join(known.select("node"), "node", "left_anti"))
        if not frontier.take(1):
            break
        known = cut(known.unionByName(frontier))
    return known


def impact(edges: DataFrame, seeds: DataFrame, tests: DataFrame) -> DataFrame:
    """One row: how many nodes depend on the seeds, directly or not, and how many of them are tests (node)."""
    hit = closure(reverse(edges), seeds).where("depth > 0").join(tests.select("node").distinct().withColumn("t", F.lit(1)), "node", "left")
    return hit.agg(F.count("*").alias("affected"), F.count_if(F.col("depth") == 1).alias("direct"), F.count("t").alias("tests"), F.max("depth").alias("farthest"))


def cycle_paths(edges: DataFrame, most: int = 8) -> DataFrame:
    """(cycle): every simple cycle of up to ``most`` nodes once, as its nodes from the least on.

    Only edges inside cyclic components are followed, and a path only goes on over
    nodes above the one that it began with.
    """
    edges = edges.select("src", "dst").distinct()
    member = components(edges).where("cyclic").select("node", "component")
    inside = edges.join(member.withColumnsRenamed({"node": "src", "component": "a"}), "src").join(member.withColumnsRenamed({"node": "dst", "component": "b"}), "dst").where("a = b")
    inside = cut(inside.select("src", "dst"))
    paths = cut(inside.where("dst >= src").select(F.array("src").alias("cycle"), F.col("dst").alias("next")))
    found = None
    for _ in range(most):
        closed = paths.where(F.col("next") == F.get("cycle", F.lit(0))).select("cycle")
        found = closed if found is None else found.unionByName(closed)
        open_ = paths.where((F.col("next") > F.get("cycle", F.lit(0))) & ~F.array_contains("cycle", F.col("next")))
        paths = cut(open_.join(inside, F.col("next") == F.col("src")).select(F.array_append("cycle", F.col("next")).alias("cycle"), F.col("dst").alias("next")))
        if not paths.take(1):
            break
    return found


#: Parts that the references to one project are dealt over.
SALTS = 16


def build_edges(instances: DataFrame, references: DataFrame) -> DataFrame:
    """(src, dst): edges between project instances (id, path, outer) with references (src, path) to projects.

    An outer build leads to the inner builds of its project; a reference leads to
    a project's outer build and its inner ones, or to the only build of a project
    that has no outer one. References of outer builds lead nowhere. An id is one
    instance, of one path.
    """
    instances, references = instances.distinct(), references.select("src", "path").distinct()
    outer = instances.where("outer").select(F.col("id").alias("o"), "path")
    inner = instances.where("NOT outer").select(F.col("id").alias("i"), "path")
    children = outer.join(inner, "path").select(F.col("o").alias("src"), F.col("i").alias("dst"))
    single = inner.join(outer, "path", "left_anti")
    one = single.groupBy("path").agg(F.min("i").alias("dst"), F.count("*").alias("n")).where("n = 1").select("path", "dst")
    targets = outer.select("path", F.col("o").alias("dst")).unionByName(inner.join(outer, "path", "left_semi").select("path", F.col("i").alias("dst"))).unionByName(one)
    sources = instances.where("NOT outer").select(F.col("id").alias("src"))
    # edges are as many as references times builds: all inputs are distinct, so no edge need meet its like, and a path's references are dealt over tasks
    dealt = references.join(sources, "src", "left_semi").withColumn("salt", F.pmod(F.xxhash64("src"), F.lit(SALTS)).cast("int"))
    each = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = dealt.join(each.hint("merge"), ["path", "salt"]).select("src", "dst")
    return children.unionByName(met)


# -- levels, completeness, paths between two nodes, instances ---------------------------------


def levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component, level): the steps of the longest way down from a node's component; 0 where nothing but itself is below.

    Components of the graph are one node each. A round peels off the components
    that no other one leads to, with their edges, so that each edge is read in few
    rounds where most nodes are far up; back from the last layer, what a layer leads
    to is known. Each layer is written once.
    """
    parts = cut(components(edges).select("node", "component"))
    if nodes is not None:
        parts = parts.unionByName(nodes.select("node").distinct().join(parts, "node", "left_anti").select("node", F.col("node").alias("component")))
    a, b = (parts.select(F.col("node").alias(end), F.col("component").alias(name)) for end, name in (("src", "a"), ("dst", "b")))
    rest = cut(edges.select("src", "dst").join(a, "src").join(b, "dst").where("a != b").select("a", "b").distinct())
    layers = []
    while rest.take(1):
        entered = rest.select(F.col("b").alias("a")).distinct().withColumn("entered", F.lit(True))
        marked = cut(rest.join(entered, "a", "left"))
        layers.append(marked.where("entered IS NULL").select("a", "b"))
        rest = marked.where("entered").select("a", "b")
    known = parts.select("component", F.lit(0).alias("level")).limit(0)
    for done, layer in enumerate(reversed(layers), 1):
        below = layer.join(known.select(F.col("component").alias("b"), "level"), "b", "left")
        level = below.groupBy(F.col("a").alias("component")).agg((F.max(F.coalesce("level", F.lit(0))) + 1).alias("level"))
        known = cut(level) if done == 1 else known.unionByName(cut(level))
        if done % 16 == 0:
            known = cut(known)
    return parts.join(known, "component", "left").select("node", "component", F.coalesce("level", F.lit(0)).alias("level"))


def salvaged(projects: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, state, usable, broken_below): what of a graph can be used where projects (node, state) failed or are missing.

    A project that was "evaluated" is complete if all that it leads to is, else
    partial; another is failed. Nodes that only edges name are incomplete.
    ``broken_below`` counts the projects that are not evaluated among a node's direct successors.
    """
    named = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().join(projects.select("node"), "node", "left_anti").withColumn("state", F.lit("incomplete"))
    known = cut(projects.select("node", "state").unionByName(named))
    bad = known.where("state != 'evaluated'").select("node")
    above = closure(reverse(edges), bad).where("depth > 0").select("node").withColumn("hit", F.lit(True))
    direct = edges.distinct().join(bad.select(F.col("node").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("broken_below"))
    out = known.join(above, "node", "left").join(direct, "node", "left")
    usable = F.when(F.col("state") != "evaluated", "failed").when(F.col("hit"), "partial").otherwise("complete")
    return out.select("node", "state", usable.alias("usable"), F.coalesce("broken_below", F.lit(0).cast("long")).alias("broken_below"))


def completeness(salvage: DataFrame) -> DataFrame:
    """One row (completeness, projects, complete, partial, failed): "failed" where nothing was evaluated, "partial" where something wasn't; an empty graph has failed."""
    u = F.col("usable")
    counts = salvage.agg(F.count("*").alias("projects"), F.count_if(u == "complete").alias("complete"), F.count_if(u == "partial").alias("partial"), F.count_if(u == "failed").alias("failed"))
    told = F.when(F.col("projects") == F.col("failed"), "failed").when(F.col("failed") > 0, "partial").otherwise("complete")
    return counts.select(told.alias("completeness"), "*")


def path_between(edges: DataFrame, source, target, most: int = 64) -> DataFrame:
    """One row (status, length, path, rounds): a shortest path of ``most`` steps at most, of several the least by its nodes.

    Levels grow from both ends, always on the side whose last level is smaller, until
    a level of one side holds a node of the other's last; the path is put together
    from the levels. "none" if a side can't go on, "open" if the bound is reached before.
    """
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    edges = cut(edges.select("src", "dst").where("src != dst").distinct())
    one = lambda x: spark.range(1).select(F.lit(x).cast(kind).alias("node"))
    # forward levels are sets; backward ones hold the least way on to the target
    front, back = [cut(one(source))], [cut(one(target).withColumn("path", F.array("node")))]
    seen = {True: front[0], False: back[0].select("node")}
    sizes, rounds, status = {True: 1, False: 1}, 0, None
    meeting = front[0].join(back[0], "node")
    while not meeting.take(1):
        if rounds >= most:
            status = "open"
            break
        rounds += 1
        ahead = sizes[True] <= sizes[False]
        if ahead:
            step = front[-1].join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        else:
            met = edges.join(back[-1], F.col("dst") == F.col("node")).select(F.col("src").alias("node"), F.concat(F.array("src"), "path").alias("path"))
            step = met.groupBy("node").agg(F.min("path").alias("path"))
        new = cut(step.join(seen[ahead], "node", "left_anti"))
        sizes[ahead] = new.count()
        if not sizes[ahead]:
            status = "none"
            break
        (front if ahead else back).append(new)
        grown = seen[ahead].unionByName(new.select("node"))
        seen[ahead] = cut(grown) if rounds % 16 == 0 else grown
        meeting = front[-1].join(back[-1], "node")
    found = meeting.select("node", "path") if status is None else None
    for level in reversed(front[:-1] if found is not None else []):
        on = level.join(edges, F.col("node") == F.col("src")).select("node", "dst").join(found.select(F.col("node").alias("dst"), "path"), "dst")
        found = cut(on.groupBy("node").agg(F.min(F.concat(F.array("node"), "path")).alias("path")))
    none = spark.range(1).select(F.lit(None).cast(f"array<{kind.simpleString()}>").alias("path"))
    out = none if found is None else found.select("path")
    return out.select(F.lit(status or "found").alias("status"), (F.size("path") - 1).alias("length"), "path", F.lit(rounds).alias("rounds")).withColumn("length", F.when(F.col("path").isNotNull(), F.col("length")))


def canonical(properties):
    """A property map by its names in lower case, in order; values as they are. Equal maps give equal texts."""
    pairs = F.array_sort(F.transform(F.map_entries(properties), lambda e: F.concat(F.lower(e["key"]), F.lit("="), e["value"])))
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.length(p).cast("string"), F.lit(":"), p)), "")


def lower_keys(properties):
    return F.map_from_entries(F.transform(F.map_entries(properties), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def project_instances(roots: DataFrame, references: DataFrame, most: int = 256) -> tuple[DataFrame, DataFrame]:
    """The instances (instance, path, properties, depth) that roots (path, properties) lead to, and the edges (src, dst) between them.

    A reference (src, dst, adds, removes) hands the effective properties of its
    source on, without those it removes and with those it adds over them, names in
    any letter case. Instances are a path and a map: equal maps are met by the hash of
    their canonical text, so cyclic references end. Raises if ``most`` rounds don't suffice.
    """
    key = F.sha2(F.concat_ws("|", F.length("path").cast("string"), "path", canonical(F.col("properties"))), 256)
    rules = cut(references.select("src", F.col("dst").alias("to"), lower_keys(F.col("adds")).alias("adds"), F.transform("removes", F.lower).alias("removes")))
    start = roots.select("path", lower_keys(F.col("properties")).alias("properties")).withColumn("instance", key)
    known = frontier = cut(start.groupBy("instance").agg(F.first("path").alias("path"), F.first("properties").alias("properties")).withColumn("depth", F.lit(0)))
    links = None
    for depth in range(1, most + 1):
        kept = F.map_filter("properties", lambda k, _: ~F.array_contains(F.col("removes"), k) & ~F.array_contains(F.map_keys("adds"), k))
        step = frontier.select(F.col("instance").alias("from"), F.col("path").alias("src"), "properties").join(rules, "src")
        step = cut(step.select("from", F.col("to").alias("path"), F.map_concat(kept, F.col("adds")).alias("properties")).withColumn("instance", key))
        edge = step.select(F.col("from").alias("src"), F.col("instance").alias("dst")).distinct()
        links = edge if links is None else links.unionByName(edge)
        one = step.groupBy("instance").agg(F.first("path").alias("path"), F.first("properties").alias("properties"))
        frontier = cut(one.join(known.select("instance"), "instance", "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.take(1):
            return known.select("instance", "path", "properties", "depth"), links
        known = known.unionByName(frontier)
        if depth % 16 == 0:
            known, links = cut(known), cut(links)
    raise RuntimeError(f"project instances are not done after {most} rounds")
