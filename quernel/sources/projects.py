"""Project and solution files as tables, read passively from their XML or text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.paths import normal_path


METADATA = "project string, state string, frameworks array<string>, configurations array<string>, refs array<string>, links array<string>"


def _tree(text: str | None):
    """The root of an XML text without name spaces, or None where it is broken."""
    try:
        root = ElementTree.fromstring((text or "").lstrip("\ufeff").strip())
    except ElementTree.ParseError:
        return None
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    return root


def _values(root, group: str, name: str, attribute: str | None = None) -> list[str]:
    """Distinct literal parts, by semicolons; those with variables are left out."""
    found = [e.get(attribute) if attribute else e.text for g in root.findall(group) for e in g.findall(name)]
    parts = [x.strip() for v in found if v for x in v.split(";")]
    return list(dict.fromkeys(x for x in parts if x and "$(" not in x))


def _beside(path, part):
    """A path written in a file, from the root: relative to the file's directory."""
    folder = F.regexp_replace(path, "/?[^/]*$", "")
    return normal_path(F.when(folder == "", part).otherwise(F.concat_ws("/", folder, part)))


def project_metadata(files: DataFrame) -> DataFrame:
    """(project, state, frameworks, configurations, references, linked): literal values of project files (path, text).

    A broken file has the state "broken" and no values.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, text in zip(f["path"], f["text"]):
                root = _tree(text)
                if root is None:
                    rows.append((path, "broken", [], [], [], []))
                    continue
                frameworks = dict.fromkeys([*_values(root, "PropertyGroup", "TargetFramework"), *_values(root, "PropertyGroup", "TargetFrameworks")])
                rows.append((path, "read", list(frameworks), _values(root, "PropertyGroup", "Configurations"), _values(root, "ItemGroup", "ProjectReference", "Include"), _values(root, "ItemGroup", "Compile", "Include")))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in METADATA.split(", ")])

    read = files.select("path", "text").mapInPandas(run, METADATA)
    here = F.col("project")
    return read.select("project", "state", "frameworks", "configurations", *[F.transform(old, lambda r: _beside(here, r)).alias(new) for old, new in (("refs", "references"), ("links", "linked"))])


def project_edges(metadata: DataFrame) -> DataFrame:
    """(src, dst): distinct project references; those that leave the root are left out."""
    return metadata.select(F.col("project").alias("src"), F.explode("references").alias("dst")).where("dst IS NOT NULL").distinct()


def solution_members(files: DataFrame) -> DataFrame:
    """(solution, project): members of solution files, XML or classic (path, text). Broken ones have none."""
    classic = re.compile(r'(?m)^Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]*proj)"')

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, text in zip(f["path"], f["text"]):
                root = _tree(text) if path.endswith(".slnx") else None
                names = classic.findall(text or "") if path.endswith(".sln") else [] if root is None else [e.get("Path") for e in root.iter("Project")]
                rows += [(path, n) for n in names if n]
            yield pd.DataFrame(rows, columns=["solution", "member"])

    read = files.select("path", "text").where(F.col("path").rlike(r"\.slnx?$")).mapInPandas(run, "solution string, member string")
    return read.select("solution", _beside(F.col("solution"), F.col("member")).alias("project")).where("project IS NOT NULL").distinct()


def catalogue(files: DataFrame) -> DataFrame:
    """(kind, n): solutions, projects and sources of a worktree (path)."""
    kind = (
        F.when(F.col("path").rlike(r"(?i)\.slnx?$"), "solution").when(F.col("path").rlike(r"(?i)\.[a-z]+proj$"), "project")
        .when(F.col("path").rlike(r"(?i)\.cs$"), "source").otherwise("other")
    )
    return files.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def entry_point(files: DataFrame, explicit: str | None = None) -> DataFrame:
    """One row (state, path, candidates): explicit, else the only root solution, else the only root project; several are ambiguous."""
    root = files.where(~F.col("path").contains("/"))
    solutions = F.sort_array(F.collect_set(F.when(F.col("path").rlike(r"(?i)\.slnx?$"), F.col("path"))))
    projects = F.sort_array(F.collect_set(F.when(F.col("path").rlike(r"(?i)\.[a-z]+proj$"), F.col("path"))))
    found = root.agg(solutions.alias("s"), projects.alias("p"))
    if explicit is not None:
        known = files.where(F.col("path") == explicit).agg(F.count("*").alias("n"))
        return known.select(F.when(F.col("n") > 0, "selected").otherwise("not_found").alias("state"), F.lit(explicit).alias("path"), F.array(F.lit(explicit)).alias("candidates"))
    c = F.when(F.size("s") > 0, F.col("s")).otherwise(F.col("p"))
    return found.select(F.when(F.size(c) == 1, "selected").when(F.size(c) > 1, "ambiguous").otherwise("not_found").alias("state"), F.when(F.size(c) == 1, F.get(c, F.lit(0))).alias("path"), c.alias("candidates"))
