"""A worktree as a table of paths: what is left out, where its root is, and which file a query starts from."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.paths import ancestors, glob_regex, name_of
from quernel.operators.files import generated

RULES = "base string, depth int, ord int, regex string, whole boolean, top boolean, directory boolean, negated boolean"
CONFIGURATION = "quernel.yml"


def ignore_rule(line: str) -> tuple[str, bool, bool, bool, bool] | None:
    """(regex, whole, top, directory, negated) of a line of an ignore file; None for blank lines and comments.

    ``whole`` patterns hold a slash and match the path below the file's directory,
    others its last part; ``top`` ones only directly in that directory.
    """
    text = re.sub(r"(?<!\\)((?:\\\\)*) +$", r"\1", line.rstrip("\r\n"))  # an escaped space stays
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated or text.startswith(("\\#", "\\!")) else text
    directory = re.search(r"(?<!\\)(?:\\\\)*/$", text) is not None
    text = text[:-1] if directory else text
    top = text.startswith("/")
    text = text[1:] if top else text
    if not text:
        return None
    whole = "/" in text
    return glob_regex(text, escapes=True), whole, top and not whole, directory, negated


def ignore_rules(rule_files: DataFrame) -> DataFrame:
    """Rules of ignore files (path, text), each for its own directory; later lines and deeper files come later."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, text in zip(f["path"], f["text"]):
                base = path.rpartition("/")[0]
                parsed = [(k, ignore_rule(x)) for k, x in enumerate((text or "").split("\n"))]
                rows += [(base, base.count("/") + 1 if base else 0, k, *r) for k, r in parsed if r]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RULES.split(", ")])

    return rule_files.select("path", "text").mapInPandas(run, RULES)


def ignored_paths(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path): ignored files. For a path and each directory above it the last rule that matches decides; an ignored directory takes all below with it.

    Rules meet the paths below their directory by equality on the directories
    above a path; those of the root, one file's, are sent to all tasks.
    """
    up = ancestors(F.col("path"))
    prefixes = files.select("path").distinct().select("path", F.explode(F.array_distinct(F.concat(F.when(F.col("path").contains("/"), up).otherwise(F.array().cast("array<string>")), F.array("path")))).alias("prefix"))
    bases = prefixes.select("path", "prefix", F.explode(F.when(F.col("prefix").contains("/"), ancestors(F.col("prefix"))).otherwise(F.array().cast("array<string>"))).alias("base"))
    below = bases.join(rules.where("base != ''"), "base").withColumn("candidate", F.expr("substring(prefix, length(base) + 2, length(prefix))"))
    at_root = prefixes.crossJoin(F.broadcast(rules.where("base = ''"))).withColumn("candidate", F.col("prefix"))
    met = below.unionByName(at_root.select(*below.columns))
    hit = F.expr("CASE WHEN whole THEN candidate RLIKE regex ELSE substring_index(candidate, '/', -1) RLIKE regex END")
    met = met.where(hit & (~F.col("directory") | (F.col("prefix") != F.col("path"))) & (~F.col("top") | ~F.col("candidate").contains("/")))
    last = met.groupBy("path", "prefix").agg(F.max_by("negated", F.struct("depth", "ord")).alias("negated"))
    return last.where("NOT negated").select("path").distinct()


def build_output(path: Column) -> Column:
    """Whether a path is below a directory that builds write to."""
    return F.exists(F.split(F.lower(path), "/", -1), lambda s: s.isin("bin", "obj"))


def within(path: Column, scopes: list[str]) -> Column:
    able = F.lit(False)
    for s in scopes:
        able = able | (path == s) | path.startswith(s.rstrip("/") + "/")
    return able


def traversed(files: DataFrame, rules: DataFrame | None = None, scopes: list[str] = (), external: list[str] = (), include_generated: bool = False) -> DataFrame:
    """The files that every search sees, with ``external`` and ``is_generated``.

    Left out are version-control data, linked directories' content (``linked``,
    if files have it), ignored files, build output, and generated code unless
    wanted. What lies in an explicit scope is not left out as build output, and
    files of ``external`` roots are seen only if these are named.
    """
    path = F.col("path")
    out = files.where(~F.exists(F.split(path, "/", -1), lambda s: s == ".git"))
    if "linked" in files.columns:
        out = out.where(~F.col("linked"))
    outside = path.startswith("/") | path.startswith("../")
    out = out.withColumn("external", outside).where(~outside | within(path, list(external)))
    if scopes:
        out = out.where(within(path, list(scopes)) | F.col("external"))
    out = out.where(~build_output(path) | within(path, [s for s in scopes if re.search("(?i)(^|/)(bin|obj)(/|$)", s)]))
    if rules is not None:
        out = out.join(ignored_paths(out, rules), "path", "left_anti")
    text = F.col("text") if "text" in files.columns else F.lit(None).cast("string")
    out = out.withColumn("is_generated", F.coalesce(generated(path, text), path.rlike(r"(?i)(\.g\.cs|\.g\.i\.cs|\.designer\.cs|\.generated\.cs)$")))
    return out if include_generated else out.where(~F.col("is_generated"))


def workspace(files: DataFrame, current: str = "") -> DataFrame:
    """One row (root, kind): the nearest directory at or above ``current`` with a mark of version control, else of a
    configuration, else a solution, else a project; else ``current`` itself."""
    parts = [p for p in current.split("/") if p]
    above = ["/".join(parts[:n]) for n in range(len(parts), -1, -1)]
    path = F.col("path")
    folder, name = F.regexp_replace(path, "/?[^/]*$", ""), F.lower(name_of(path))
    kind = (
        F.when(path.rlike(r"(^|/)\.git(/|$)"), "version-control").when(name == CONFIGURATION, "configuration")
        .when(name.rlike(r"\.slnx?$"), "solution").when(name.rlike(r"\.csproj$"), "project")
    )
    place = F.when(kind == "version-control", F.regexp_replace(path, r"/?\.git(/.*)?$", "")).otherwise(folder)
    marks = files.select(kind.alias("kind"), place.alias("root")).where(F.col("kind").isNotNull() & F.col("root").isin(above))
    order = F.array_position(F.array(*[F.lit(k) for k in ("version-control", "configuration", "solution", "project")]), F.col("kind"))
    best = marks.agg(F.min(F.struct(order.alias("o"), (-F.length("root")).alias("n"), "root", "kind")).alias("m"))
    return best.select(F.coalesce("m.root", F.lit(current)).alias("root"), F.coalesce("m.kind", F.lit("directory")).alias("kind"))


def capabilities(files: DataFrame) -> DataFrame:
    """(path, kind): what a worktree holds beyond solutions and C# projects: filters, other projects, sources of no project."""
    path = F.col("path")
    folder = F.regexp_replace(path, "/?[^/]*$", "")
    projects = files.where(path.rlike(r"(?i)\.csproj$")).select(folder.alias("directory")).distinct()
    sources = files.where(path.rlike(r"(?i)\.cs$")).select("path")
    up = sources.select("path", F.explode(F.array_append(F.when(path.contains("/"), ancestors(path)).otherwise(F.array().cast("array<string>")), F.lit(""))).alias("directory"))
    alone = sources.join(up.join(projects, "directory").select("path"), "path", "left_anti")
    kind = F.when(path.rlike(r"(?i)\.slnf$"), "solution-filter").when(path.rlike(r"(?i)\.[a-z]+proj$") & ~path.rlike(r"(?i)\.csproj$"), "unsupported-project")
    return files.select("path", kind.alias("kind")).where("kind IS NOT NULL").unionByName(alone.select("path", F.lit("file-based-source").alias("kind")))


def entry_point(files: DataFrame, solution: str | None = None, project: str | None = None, configured: str | None = None) -> DataFrame:
    """One row (state, source, path, candidates): where a query starts.

    An explicit solution or project, else the configured one, else the only
    solution at the root, else the only project there. Both selectors at once are
    an error; several at the root are ambiguous; files elsewhere need a selection.
    """
    if solution is not None and project is not None:
        raise ValueError("a solution and a project can't be selected together")
    path = F.col("path")
    is_solution, is_project, at_root = path.rlike(r"(?i)\.slnx?$"), path.rlike(r"(?i)\.csproj$"), ~path.contains("/")
    paths = lambda c: F.sort_array(F.collect_set(F.when(c, path)))
    asked = solution or project or configured
    source = "explicit-solution" if solution else "explicit-project" if project else "configuration" if configured else None
    kind = is_solution if solution else is_project if project else is_solution | is_project
    found = files.agg(
        paths(is_solution & at_root).alias("s"), paths(is_project & at_root).alias("p"), F.count_if(is_solution | is_project).alias("n"), F.count_if((path == F.lit(asked)) & kind).alias("hit")
    )
    if asked is not None:
        return found.select(F.when(F.col("hit") > 0, "selected").otherwise("not_found").alias("state"), F.lit(source).alias("source"), F.lit(asked).alias("path"), F.array(F.lit(asked)).alias("candidates"))
    c = F.when(F.size("s") > 0, F.col("s")).otherwise(F.col("p"))
    state = F.when(F.size(c) == 1, "selected").when(F.size(c) > 1, "ambiguous").when(F.col("n") > 0, "selection_required").otherwise("not_found")
    told = F.when(F.size(c) == 1, F.when(F.size("s") > 0, "root-solution").otherwise("root-project"))
    return found.select(state.alias("state"), told.alias("source"), F.when(F.size(c) == 1, F.get(c, F.lit(0))).alias("path"), c.alias("candidates"))
