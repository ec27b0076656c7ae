"""Verification votes, variant plans, coverage, references and implementations over fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITY = {"rejected": 0, "unresolved": 1, "verified": 2}


def candidate_variants(candidates: DataFrame, variants: DataFrame) -> DataFrame:
    """(id, variant, status, reason) of candidates (id, source) with variants (variant, sources, status, reason).

    A candidate whose source is in no variant keeps one row that says so.
    """
    each = variants.select("variant", "status", "reason", F.explode("sources").alias("source"))
    met = candidates.join(each, "source", "left")
    none = F.col("variant").isNull()
    return met.select("id", "variant", F.when(none, "unresolved").otherwise(F.col("status")).alias("status"), F.when(none, "ownership.not_found").otherwise(F.col("reason")).alias("reason"))


def vote(rows: DataFrame) -> DataFrame:
    """(id, status, variants, reasons): verified beats unresolved beats rejected; reasons distinct and sorted."""
    severity = F.when(F.col("status") == "verified", 2).when(F.col("status") == "unresolved", 1).otherwise(0)
    voted = rows.groupBy("id").agg(F.max(severity).alias("s"), F.count("variant").alias("variants"), F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"))
    return voted.select("id", F.element_at(F.array(F.lit("rejected"), F.lit("unresolved"), F.lit("verified")), F.col("s") + 1).alias("status"), "variants", "reasons")


def vote_totals(voted: DataFrame) -> DataFrame:
    return voted.agg(F.count("*").alias("discovered"), *[F.count_if(F.col("status") == s).alias(s) for s in ("verified", "rejected", "unresolved")])


def variants_of(projects: DataFrame) -> DataFrame:
    """(project, configuration, framework): each project's declared configurations with its frameworks; null stands for none declared."""
    def some(c: str):
        return F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit(None).cast("string")))

    one = projects.select("project", F.explode(some("configurations")).alias("configuration"), "frameworks")
    return one.select("project", "configuration", F.explode(some("frameworks")).alias("framework"))


def plan(rows: DataFrame, project: str | None, framework: str | None) -> DataFrame:
    """Add ``disposition`` and ``reason`` to variants (project, framework, coverage): the first rule that holds."""
    unwanted_p = F.lit(False) if project is None else ~F.col("project").eqNullSafe(F.lit(project))
    unwanted_f = F.lit(False) if framework is None else ~F.col("framework").eqNullSafe(F.lit(framework))
    able = F.col("coverage").isin("supported", "unrestored")
    disposition = F.when(able & (unwanted_p | unwanted_f), "remaining").when(able, "analyzed").when(F.col("coverage") == "unsupported", "excluded").otherwise("failed")
    reason = F.when(able & unwanted_f, "framework.not_selected").when(able & unwanted_p, "project.not_selected").when(able, None).when(F.col("coverage") == "unsupported", "project.unsupported").otherwise("project.failed")
    return rows.withColumns({"disposition": disposition, "reason": reason})


def default_framework(rows: DataFrame) -> DataFrame:
    """(project, framework): the first supported framework by its declared position (project, framework, position, coverage)."""
    return rows.where("coverage = 'supported'").groupBy("project").agg(F.min_by("framework", F.struct("position", "framework")).alias("framework"))


def merge_projects(rows: DataFrame, states: list[str]) -> DataFrame:
    """(project, state, failures, configuration) of instances (project, state, failures, configuration): the worst state by its place in ``states``, all failures, the first configuration."""
    ordinal = F.array_position(F.array(*[F.lit(s) for s in states]), F.col("state"))
    merged = rows.groupBy("project").agg(F.max(ordinal).alias("o"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("failures")))).alias("failures"), F.min("configuration").alias("configuration"))
    return merged.select("project", F.element_at(F.array(*[F.lit(s) for s in states]), F.col("o").cast("int")).alias("state"), "failures", "configuration")


def merge_frameworks(rows: DataFrame) -> DataFrame:
    """(project, frameworks) of lists (project, frameworks): the longest list first, ties to the least, then the others' values sorted."""
    merged = rows.groupBy("project").agg(F.collect_set("frameworks").alias("lists"))
    primary = F.array_sort("lists", lambda a, b: F.when(F.size(a) != F.size(b), F.size(b) - F.size(a)).when(F.array_join(a, ",") < F.array_join(b, ","), -1).when(F.array_join(a, ",") > F.array_join(b, ","), 1).otherwise(0))
    first = merged.withColumn("p", F.element_at(primary, 1))
    return first.select("project", F.concat("p", F.array_sort(F.array_except(F.array_distinct(F.flatten("lists")), "p"))).alias("frameworks"))


def references(facts: DataFrame, targets: DataFrame, scope: DataFrame, eligible: DataFrame | None = None) -> DataFrame:
    """Facts (identity, project, path, ...) of the targets (identity) in the scope's projects (project), in eligible paths if given; distinct by id."""
    found = facts.join(targets.select("identity").distinct(), "identity", "left_semi").join(scope.select("project").distinct(), "project", "left_semi")
    if eligible is not None:
        found = found.join(eligible.select("path").distinct(), "path", "left_semi")
    return found.dropDuplicates(["id"]) if "id" in found.columns else found.distinct()
