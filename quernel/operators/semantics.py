"""Semantic queries over fact tables: coverage, plans, targets, references, implementations, calls.

What only a compiler can tell comes in as tables: evaluated variants of projects,
symbols that declarations have in a variant, references, type and member edges.
Here is what is asked of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.checkpoint import cut
from quernel.functions.identity import entity_id
from quernel.operators import graph
from quernel.operators.bounded import capped
from quernel.operators.relations import candidate_variants, vote


# -- coverage ---------------------------------------------------------------------------------


def classified(evidence: DataFrame) -> DataFrame:
    """Add ``coverage`` and ``issue`` to evidence of project variants (project, sdk_style, language, state, failures): the first rule that holds.

    A project of another shape or language is unsupported, one that lacks only its
    restored assets is unrestored, one that failed is broken; what isn't known to
    be of the supported shape and language is unsupported too.
    """
    sdk, language = F.col("sdk_style"), F.lower("language")
    known_other = (language != "c#") & language.isNotNull()
    other_file = ~F.lower("project").endswith(".csproj")
    failures = F.coalesce("failures", F.array().cast("array<string>"))
    only_assets = (F.size(failures) > 0) & F.forall(failures, lambda f: f == "missing_assets") & (F.col("state") != "failed")
    broken = (F.col("state") != "evaluated") | (F.size(failures) > 0)
    rules = [
        (F.coalesce(~sdk, F.lit(False)), "unsupported", "shape"), (known_other, "unsupported", "language"), (F.coalesce(sdk, F.lit(False)) & other_file, "unsupported", "shape"),
        (only_assets, "unrestored", "missing_assets"), (broken, "broken", "evaluation"), (sdk.isNull(), "unsupported", "shape"), (language.isNull(), "unsupported", "language"), (other_file, "unsupported", "shape"),
    ]
    coverage, issue = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for rule, c, i in rules[1:]:
        coverage, issue = coverage.when(rule, c), issue.when(rule, i)
    return evidence.withColumns({"coverage": coverage.otherwise("supported"), "issue": issue})


def project_coverage(projects: DataFrame, evidence: DataFrame, complete: bool = False) -> DataFrame:
    """(project, configuration, framework, position, coverage, issue, selected) of all projects (project, state).

    A project without evidence keeps one row that goes by its own state. Of a
    project's supported variants the first by position is selected, or all.
    """
    seen = evidence.select("project", "configuration", "framework", "position", "sdk_style", "language", "state", "failures")
    absent = projects.join(evidence.select("project").distinct(), "project", "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    fallback = absent.select("project", none("string").alias("configuration"), none("string").alias("framework"), F.lit(0).alias("position"), none("boolean").alias("sdk_style"), none("string").alias("language"), "state", F.array().cast("array<string>").alias("failures"))
    told = classified(seen.unionByName(fallback)).drop("sdk_style", "language", "state", "failures")
    supported = F.col("coverage") == "supported"
    if complete:
        return told.withColumn("selected", supported)
    key = F.struct("position", F.coalesce("framework", F.lit("")).alias("framework"), F.coalesce("configuration", F.lit("")).alias("configuration"))
    first = told.where(supported).groupBy("project").agg(F.min(key).alias("first"))
    return told.withColumn("key", key).join(first, "project", "left").withColumn("selected", F.coalesce(supported & (F.col("key") == F.col("first")), F.lit(False))).drop("key", "first")


def coverage_counts(variants: DataFrame, graph_completeness: str = "complete") -> DataFrame:
    """One row (level, considered, analyzed, remaining, excluded, failed); the four add up to considered. It is partial where a variant wasn't analyzed or the project graph isn't complete."""
    s, c = F.col("selected"), F.col("coverage")
    counts = variants.agg(
        F.count("*").alias("considered"), F.count_if((c == "supported") & s).alias("analyzed"), F.count_if((c == "supported") & ~s).alias("remaining"),
        F.count_if(c == "unsupported").alias("excluded"), F.count_if(c.isin("broken", "unrestored")).alias("failed"),
    )
    whole = (F.col("analyzed") == F.col("considered")) & F.lit(graph_completeness == "complete")
    return counts.select(F.when(whole, "complete").otherwise("partial").alias("level"), "*")


def variant_plans(coverage: DataFrame, complete_scope: DataFrame, selected_scope: DataFrame, complete: bool = False) -> DataFrame:
    """(project, configuration, framework, disposition, reason) of the variants of all projects in scope (project).

    Of a selected project the selected variants are analyzed, and unrestored ones
    that are first of their project, or all; other usable ones remain. A project
    in scope that has no variant fails.
    """
    rows = coverage.join(complete_scope.select("project").distinct(), "project", "left_semi")
    rows = rows.join(selected_scope.select("project").distinct().withColumn("wanted", F.lit(True)), "project", "left")
    first = rows.groupBy("project").agg(F.min("position").alias("first"))
    rows = rows.join(first, "project")
    wanted, c = F.coalesce("wanted", F.lit(False)), F.col("coverage")
    usable = c.isin("supported", "unrestored")
    chosen = F.col("selected") | ((c == "unrestored") & (F.lit(complete) | (F.col("position") == F.col("first"))))
    disposition = F.when(usable & wanted & chosen, "analyzed").when(usable, "remaining").when(c == "unsupported", "excluded").otherwise("failed")
    reason = F.when(usable & wanted & chosen, None).when(usable & wanted, "framework.not_selected").when(usable, "project.not_selected").otherwise(F.concat(F.lit("project."), "issue"))
    planned = rows.select("project", "configuration", "framework", disposition.alias("disposition"), reason.alias("reason"))
    missing = complete_scope.select("project").distinct().join(coverage.select("project").distinct(), "project", "left_anti")
    none = F.lit(None).cast("string")
    return planned.unionByName(missing.select("project", none.alias("configuration"), none.alias("framework"), F.lit("failed").alias("disposition"), F.lit("project.coverage_unavailable").alias("reason")))


def with_compiler(plans: DataFrame, compiled: DataFrame) -> DataFrame:
    """Plans with the compiler variant (project, configuration, framework, fingerprint, failure) that is theirs; a null configuration or framework equals null.

    A plan to analyze without a compiler variant, or with one that failed, fails.
    """
    p, v = plans.alias("p"), compiled.alias("v")
    same = F.col("p.project").eqNullSafe(F.col("v.project")) & F.col("p.configuration").eqNullSafe(F.col("v.configuration")) & F.col("p.framework").eqNullSafe(F.col("v.framework"))
    met = p.join(v, same, "left")
    planned = F.col("p.disposition") == "analyzed"
    failure = F.when(planned & F.col("v.project").isNull(), "variant.not_found").when(planned, F.col("v.failure"))
    return met.select(
        "p.project", "p.configuration", "p.framework", F.when(failure.isNotNull(), "failed").otherwise(F.col("p.disposition")).alias("disposition"),
        F.coalesce(failure, F.col("p.reason")).alias("reason"), F.when(planned, F.col("v.fingerprint")).alias("fingerprint"),
    )


def solution_projects(members: DataFrame, discovered: DataFrame) -> DataFrame:
    """(solution, project): members of solutions (solution, project) that were discovered (project), once each whatever the letter case of their paths."""
    found = members.withColumn("k", F.lower("project")).join(discovered.select(F.lower("project").alias("k"), F.col("project").alias("found")), "k")
    return found.groupBy("solution", "k").agg(F.min("found").alias("project")).select("solution", "project")


# -- targets ----------------------------------------------------------------------------------


def states_of(candidates: DataFrame, variants: DataFrame) -> DataFrame:
    """(target, candidate, variant, status, symbol, reason): candidates (target, id, source, owner) in every compiler variant (variant, project, sources, status, symbol, reason).

    A variant is a candidate's if its sources hold the candidate's, or if it failed and its project owns the candidate.
    A candidate without one keeps one unresolved row. A source or an owner is a group of candidates that a variant meets by equality.
    """
    held = variants.where("status != 'failed'").select("variant", "status", "symbol", "reason", F.explode("sources").alias("source"))
    failed = variants.where("status = 'failed'").select("variant", F.lit("unresolved").alias("status"), F.lit(None).cast("string").alias("symbol"), "reason", F.col("project").alias("owner"))
    met = candidates.select("target", F.col("id").alias("candidate"), "source").join(held.hint("merge"), "source").drop("source")
    owned = candidates.select("target", F.col("id").alias("candidate"), "owner").join(failed, "owner").drop("owner")
    both = met.unionByName(owned).distinct()
    alone = candidates.select("target", F.col("id").alias("candidate")).join(both.select("target", "candidate").distinct(), ["target", "candidate"], "left_anti")
    none = F.lit(None).cast("string")
    return both.unionByName(alone.select("target", "candidate", none.alias("variant"), F.lit("unresolved").alias("status"), none.alias("symbol"), F.lit("ownership.not_found").alias("reason")))


def same_symbol(states: DataFrame) -> DataFrame:
    """(target, candidate, grouping): candidates that have the same symbol in the same variant are one group, also by way of others.

    Labels fall along shared symbols until none changes; a symbol's candidates only meet their least label.
    """
    resolved = cut(states.where("status = 'resolved'").select("target", "candidate", "variant", "symbol").distinct())
    labels = cut(states.select("target", "candidate").distinct().withColumn("label", F.col("candidate")))
    while True:
        shared = resolved.join(labels, ["target", "candidate"]).groupBy("target", "variant", "symbol").agg(F.min("label").alias("least"))
        lowered = resolved.join(shared, ["target", "variant", "symbol"]).groupBy("target", "candidate").agg(F.min("least").alias("least"))
        new = cut(labels.join(lowered, ["target", "candidate"], "left").select("target", "candidate", F.least("label", "least").alias("label"), (F.col("label") > F.col("least")).alias("changed")))
        labels = new.select("target", "candidate", "label")
        if not new.where("changed").take(1):
            return labels.withColumnRenamed("label", "grouping")


def merged_variants(states: DataFrame, by: list[str]) -> DataFrame:
    """(by, variant, status, symbol, reason): one row a variant, a resolved one before others, then by candidate."""
    order = F.struct((F.col("status") != "resolved").alias("late"), "candidate")
    best = states.where("variant IS NOT NULL").groupBy(*by, "variant").agg(F.min_by(F.struct("status", "symbol", "reason"), order).alias("best"))
    return best.select(*by, "variant", "best.status", "best.symbol", "best.reason")


def resolve_targets(targets: DataFrame, ranked: DataFrame, variants: DataFrame) -> DataFrame:
    """(target, status, candidates, groups): what each target means.

    ``ranked`` has matches (target, id, rank, source, owner); only those of the
    best rank count. One group of a symbol is resolved, several are ambiguous, none
    is unresolved; no match is not found; another kind of identity is unsupported.
    """
    best = ranked.groupBy("target").agg(F.min("rank").alias("best"))
    chosen = ranked.join(best, "target").where("rank = best")
    states = cut(states_of(chosen, variants))
    groups = same_symbol(states).join(states.where("status = 'resolved'").select("target", "candidate").distinct(), ["target", "candidate"], "left_semi")
    counts = chosen.groupBy("target").agg(F.count("*").alias("candidates"))
    told = groups.groupBy("target").agg(F.countDistinct("grouping").alias("groups"))
    out = targets.select("target").distinct().join(counts, "target", "left").join(told, "target", "left")
    n, g = F.coalesce("candidates", F.lit(0).cast("long")), F.coalesce("groups", F.lit(0).cast("long"))
    other = F.col("target").rlike("^(file|text|syntax|reference|implementation)/q[0-9]+:") | (F.col("target").startswith("symbol/") & ~F.col("target").startswith("symbol/q2:"))
    status = F.when(other, "unsupported").when(n == 0, "not_found").when(g == 1, "resolved").when(g > 1, "ambiguous").otherwise("unresolved")
    return out.select("target", status.alias("status"), n.alias("candidates"), g.alias("groups"))


def ambiguity(resolved: DataFrame, ranked: DataFrame, most: int = 20) -> DataFrame:
    """(target, id, place, total, omitted): the first candidates of ambiguous targets."""
    asked = ranked.join(resolved.where("status = 'ambiguous'").select("target"), "target", "left_semi")
    return capped(asked, ["target"], ["rank", "id"], most).select("target", "id", "place", "total", "omitted")


def descriptors(states: DataFrame, variants: DataFrame) -> DataFrame:
    """(framework, identity, assembly): what resolved targets are, in each framework, whatever variant told it (variant, framework, assembly)."""
    return states.where("status = 'resolved'").join(variants.select("variant", "framework", "assembly"), "variant").select("framework", F.col("symbol").alias("identity"), "assembly").distinct()


# -- candidates -------------------------------------------------------------------------------

#: How a syntactic candidate of each kind is held against what a compiler found at its place: the columns that must agree.
VERIFIED_BY = {"invocation": ("symbol_kind", "name"), "attribute": ("symbol_kind", "type"), "object_creation": ("type",), "catch": ("type",)}


def verified(candidates: DataFrame, bound: DataFrame, kind: str) -> DataFrame:
    """(id, status, variants, reasons) of candidates (id, source, content_hash, and the columns of ``VERIFIED_BY``) of one kind.

    ``bound`` has what a compiler found (variant, id, content_hash, status, reason
    and the same columns). A file that changed is stale and unresolved, what was
    not bound is unresolved, what differs is rejected. A candidate in no variant keeps one row that says so.
    """
    columns = VERIFIED_BY[kind]
    asked = candidates.select("id", F.col("content_hash").alias("asked_hash"), *[F.col(c).alias(f"asked_{c}") for c in columns])
    met = asked.join(bound, "id", "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"asked_{c}"))
    none = F.col("variant").isNull()
    stale = F.col("asked_hash") != F.col("content_hash")
    status = F.when(none | stale | (F.col("status") != "bound"), "unresolved").when(same, "verified").otherwise("rejected")
    reason = F.when(none, "ownership.not_found").when(stale, "evidence.stale").when(F.col("status") != "bound", F.coalesce("reason", F.lit("binding.unresolved"))).when(~same, f"{kind}.other_symbol")
    return vote(met.select("id", "variant", status.alias("status"), reason.alias("reason")))


def verification_plan(candidates: DataFrame, variants: DataFrame) -> DataFrame:
    """``candidate_variants`` of candidates (id, source, owner), and the variants that failed in the projects that own them (variant, project, status, reason)."""
    held = candidate_variants(candidates.select("id", "source"), variants.where("status != 'failed'"))
    failed = variants.where("status = 'failed'").select("variant", F.col("project").alias("owner"), F.lit("unresolved").alias("status"), "reason")
    owned = candidates.select("id", "owner").join(failed, "owner").select("id", "variant", "status", "reason")
    none = held.where("variant IS NULL").join(owned.select("id").distinct(), "id", "left_anti")
    return held.where("variant IS NOT NULL").unionByName(owned).unionByName(none).distinct()


# -- relationships ----------------------------------------------------------------------------


def relationship_scope(edges: DataFrame, targets: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """(node, depth): projects that depend on the targets' (node), the targets first; test projects (node) are not gone through unless they are targets."""
    allowed = None
    if tests is not None:
        nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
        allowed = nodes.join(tests.select("node").distinct(), "node", "left_anti")
    return graph.closure(graph.reverse(edges), targets, allowed=allowed)


def references(facts: DataFrame, asked: DataFrame, scope: DataFrame, eligible: DataFrame | None = None) -> DataFrame:
    """References (identity, assembly, framework, project, configuration, path, start, length) of the targets ``asked`` (framework, identity, assembly), with ``id``, once each.

    A symbol is the same in another project only with its assembly, and only in the same framework; null equals null.
    """
    f, a = facts.alias("f"), asked.select("framework", "identity", "assembly").distinct().alias("a")
    same = (F.col("f.identity") == F.col("a.identity")) & (F.col("f.assembly") == F.col("a.assembly")) & F.col("f.framework").eqNullSafe(F.col("a.framework"))
    found = f.join(a, same, "left_semi").join(scope.select("project").distinct(), "project", "left_semi")
    if eligible is not None:
        found = found.join(eligible.select("path").distinct(), "path", "left_semi")
    parts = {c: F.col(c) for c in ("identity", "project", "configuration", "framework", "path", "start", "length")}
    return found.withColumn("id", entity_id("reference", **parts)).dropDuplicates(["id"])


def derived_types(type_edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(symbol, depth): types below the targets (node) by edges (type, base), bases and interfaces alike."""
    found = graph.closure(type_edges.select(F.col("base").alias("src"), F.col("type").alias("dst")), targets)
    return found.where("depth > 0").select(F.col("node").alias("symbol"), "depth")


def overriding_members(member_edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(symbol, kind): members that override a target (node), also over others, or implement it explicitly, by edges (member, base, kind)."""
    up = member_edges.select(F.col("base").alias("src"), F.col("member").alias("dst"))
    over = graph.closure(up.join(member_edges.where("kind = 'override'").select(F.col("member").alias("dst"), F.col("base").alias("src")), ["src", "dst"], "left_semi"), targets).where("depth > 0")
    explicit = member_edges.where("kind = 'explicit'").join(targets.select(F.col("node").alias("base")).distinct(), "base", "left_semi").select(F.col("member").alias("symbol"), F.lit("explicit").alias("kind"))
    return over.select(F.col("node").alias("symbol"), F.lit("override").alias("kind")).unionByName(explicit).distinct()


def implementations(type_edges: DataFrame, member_edges: DataFrame, declared: DataFrame, targets: DataFrame, found_elsewhere: DataFrame | None = None) -> DataFrame:
    """(symbol, and the columns of ``declared``): source types below target types (node) and members that implement target members.

    ``declared`` has (symbol, kind, in_source, ...); interfaces and what is in no
    source are no implementations. What a compiler's finder gave (symbol) is added, once each.
    """
    types = derived_types(type_edges, targets).select("symbol")
    members = overriding_members(member_edges, targets).select("symbol")
    both = types.unionByName(members)
    if found_elsewhere is not None:
        both = both.unionByName(found_elsewhere.select("symbol"))
    return declared.where("in_source AND kind != 'interface'").join(both.distinct(), "symbol", "left_semi")


def callers(calls: DataFrame, targets: DataFrame, most: int | None = 1) -> DataFrame:
    """(symbol, depth): members that call the targets (node) by calls (caller, callee), within ``most`` steps."""
    found = graph.closure(calls.select(F.col("callee").alias("src"), F.col("caller").alias("dst")), targets, most)
    return found.where("depth > 0").select(F.col("node").alias("symbol"), "depth")


def callees(calls: DataFrame, targets: DataFrame, most: int | None = 1) -> DataFrame:
    """(symbol, depth): members that the targets (node) call, within ``most`` steps."""
    found = graph.closure(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), targets, most)
    return found.where("depth > 0").select(F.col("node").alias("symbol"), "depth")


class Session:
    """What one query builds, once: graphs, variants and facts by name, written to the checkpoint folder when first asked for."""

    def __init__(self) -> None:
        self.built: dict[tuple, DataFrame] = {}

    def get(self, build, *key) -> DataFrame:
        """``build()`` under its key; asked for again, the same rows without building them."""
        if key not in self.built:
            self.built[key] = cut(build())
        return self.built[key]
