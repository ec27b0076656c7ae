"""Findings of rules over facts, checks of a profile, and what an operation may do."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def findings(facts: DataFrame, rules: dict[str, tuple[str, Column]], engine: str) -> DataFrame:
    """(path, line, rule, severity, engine): facts (path, line, ...) for which a rule, (severity, condition), holds."""
    hits = F.array(*[F.when(c, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, (severity, c) in rules.items()])
    each = facts.select("path", "line", F.explode(F.array_compact(hits)).alias("x"))
    return each.select("path", "line", "x.rule", "x.severity", F.lit(engine).alias("engine"))


def merged_findings(found: DataFrame) -> DataFrame:
    """(path, line, rule, severity, engines): one finding a place and rule, with all engines that told it and the worst severity."""
    levels = F.array(*[F.lit(x) for x in ("info", "warning", "error")])
    merged = found.groupBy("path", "line", "rule").agg(F.max(F.array_position(levels, F.col("severity"))).alias("s"), F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"))
    return merged.select("path", "line", "rule", F.element_at(levels, F.col("s").cast("int")).alias("severity"), "engines")


@dataclass(frozen=True)
class Check:
    """A check of a profile: which rows of a table break it. One that writes sources is not allowed."""

    name: str
    broken: Column
    writes_source: bool = False

    def __post_init__(self) -> None:
        if self.writes_source:
            raise ValueError(f"the check {self.name} would write sources")


def validated(rows: DataFrame, checks: list[Check]) -> DataFrame:
    """(check, state, broken, considered) of each check over one table, in one pass."""
    names = [c.name for c in checks]
    if len(set(names)) < len(names):
        raise ValueError("two checks have one name")
    counted = rows.agg(F.count("*").alias("n"), *[F.count_if(c.broken).alias(f"c{i}") for i, c in enumerate(checks)])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("broken")) for i, n in enumerate(names)]))
    return counted.select("n", each.alias("x")).select("x.check", F.when(F.col("x.broken") == 0, "passed").otherwise("failed").alias("state"), "x.broken", F.col("n").alias("considered"))


@dataclass(frozen=True)
class Policy:
    """What an operation may do. A passive one reads only; an executing one runs the repository's code."""

    executing: bool = False
    network: bool = False
    writes_artifacts: bool = False
    writes_source: bool = False

    def __post_init__(self) -> None:
        if not self.executing and (self.network or self.writes_source):
            raise ValueError("a passive operation uses no network and writes no source")


PASSIVE, EXECUTING = Policy(), Policy(executing=True, network=True, writes_artifacts=True)


def policy_of(command: str, options: tuple[str, ...] = ()) -> Policy:
    """A command's policy; an option that verifies by a compiler makes a passive command an executing one."""
    if command not in POLICIES:
        raise ValueError(f"unknown command {command!r}; there are {sorted(POLICIES)}")
    return EXECUTING if "verify" in options else POLICIES[command]


POLICIES = {
    name: PASSIVE
    for name in (
        "home", "version", "help", "search file", "search text", "search symbol", "search syntax invocation", "search syntax class", "search syntax object-creation", "search syntax catch",
        "show symbol", "show document", "context symbol", "outline",
    )
} | {"search references": EXECUTING, "search implementations": EXECUTING}
