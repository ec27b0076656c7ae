"""A relationship query from its target's name to rows and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.checkpoint import cut
from quernel.operators import evidence, semantics, targets

INCOMPLETE = "Project or framework coverage is incomplete; inspect variant issues and graph failures."


def references_of(
    target: str, declarations: DataFrame, target_variants: DataFrame, edges: DataFrame, coverage: DataFrame, facts: DataFrame, limit: int,
    compiled: DataFrame | None = None, tests: DataFrame | None = None, eligible: DataFrame | None = None, complete: bool = False, graph_completeness: str = "complete",
) -> DataFrame:
    """One row: the target's ``status`` and ``candidates``, the first references as ``rows``, ``total``, ``truncated`` and ``evidence``.

    The target (an identity, a qualified name or a query) is resolved among
    ``declarations`` in ``target_variants`` (as in ``targets.resolve_batch``, with
    framework and assembly). Projects that depend on its owners are the scope, by
    ``edges`` (src, dst); not gone through are ``tests`` (node). ``coverage`` has the
    variants of projects, of which those to analyze, and that ``compiled`` has if
    given, tell their ``facts``. What wasn't analyzed makes the coverage partial; a
    target that isn't one symbol has no rows and no coverage.
    """
    asked = declarations.sparkSession.createDataFrame([(target,)], "target string")
    resolved, matches = targets.resolve_batch(asked, declarations, target_variants)
    one = resolved.where("status = 'resolved'").select("target")
    chosen = cut(matches.join(one, "target", "left_semi").join(declarations.select("id", "source", "owner").hint("merge"), "id"))
    what = semantics.descriptors(semantics.states_of(chosen, target_variants), target_variants)
    scope = semantics.relationship_scope(edges, chosen.select(F.col("owner").alias("node")).distinct(), tests).select(F.col("node").alias("project"))
    plans = semantics.variant_plans(cut(coverage), scope, scope, complete)  # which reads it several times
    if compiled is not None:
        plans = semantics.with_compiler(plans, compiled)
    analyzed = plans.where("disposition = 'analyzed'").select("project", "configuration", "framework").alias("p")
    found = semantics.references(facts, what, scope, eligible).alias("f")
    same = F.col("f.project") == F.col("p.project")
    for c in ("configuration", "framework"):
        same = same & F.col(f"f.{c}").eqNullSafe(F.col(f"p.{c}"))
    found = found.join(analyzed, same, "left_semi")
    order = [F.asc(c) for c in ("path", "start", "length", "project")] + [F.asc_nulls_last("configuration"), F.asc_nulls_last("framework"), F.asc("id")]
    first = evidence.one_pass(found, order, limit)
    d = F.col("disposition")
    counts = plans.agg(F.count("*").alias("considered"), *[F.count_if(d == p).alias(p) for p in evidence.PARTS])
    out = first.crossJoin(counts).crossJoin(resolved.select("status", "candidates"))  # one row each
    parts = [F.col(p) for p in evidence.PARTS]
    short = (F.col("considered") > F.col("analyzed")) | F.lit(graph_completeness != "complete")
    reason = F.when(short, INCOMPLETE).when(F.col("total") > limit, evidence.LIMIT_REASON)
    covered = evidence.coverage(F.col("considered"), *parts, reason)
    none = F.lit(None).cast("long")
    nothing = F.struct(F.lit("not-applicable").alias("level"), none.alias("considered"), *[none.alias(p) for p in evidence.PARTS], F.lit(None).cast("string").alias("partial_reason"))
    told = evidence.envelope(out, F.when(F.col("status") == "resolved", covered).otherwise(nothing), "semantic", "verified", "dependent projects")
    return told.select("status", "candidates", "rows", "total", (F.col("total") > limit).alias("truncated"), "evidence")
