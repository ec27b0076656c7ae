"""File search: filters, kinds, ranks, ignore rules, ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.paths import ancestors, glob_regex, name_of, stem_of

KINDS = {"cs": "source", "txt": "text", "md": "text", "html": "markup", "xml": "markup", "json": "data", "csproj": "project", "sln": "solution"}


def extension(path: Column) -> Column:
    name = name_of(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.lower(F.substring_index(name, ".", -1)))


def kind(path: Column) -> Column:
    """The kind by extension; "other" without a known one."""
    e = extension(path)
    out = F.lit("other")
    for ext, k in KINDS.items():
        out = F.when(e == ext, k).otherwise(out)
    return out


def matching(files: DataFrame, extensions: list[str] = (), globs: list[str] = (), scopes: list[str] = (), case_sensitive: bool = False) -> DataFrame:
    """Files of any of the extensions, any of the globs and below any of the scopes; an empty list filters nothing. The letter case of an extension counts if that of the query does."""
    path = F.col("path")
    out = files
    if extensions:
        given = F.substring_index(name_of(path), ".", -1)
        asked = [e.lstrip(".") for e in extensions]
        out = out.where(extension(path).isNotNull() & (given.isin(asked) if case_sensitive else F.lower(given).isin([e.lower() for e in asked])))
    if globs:
        able = F.lit(False)
        for g in globs:
            able = able | path.rlike(glob_regex(g))
        out = out.where(able)
    if scopes:
        able = F.lit(False)
        for s in scopes:
            able = able | (path == s) | path.startswith(s + "/")
        out = out.where(able)
    return out


def search_files(files: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """(path, rank, match_index, name_length, depth): distinct paths that hold ``query``, in eight tiers.

    0 whole path, 1 name, 2 stem, 3 name begins, 4 name holds, 5 a directory,
    6 a directory begins, 7 elsewhere.
    """
    q = query if case_sensitive else query.lower()
    p = F.col("path") if case_sensitive else F.lower("path")
    name = name_of(p)
    dirs = F.split(p, "/", -1)
    dirs = F.slice(dirs, F.lit(1), F.size(dirs) - 1)
    rank = (
        F.when(p == q, 0).when(name == q, 1).when(stem_of(name) == q, 2).when(name.startswith(q), 3).when(name.contains(q), 4)
        .when(F.exists(dirs, lambda d: d == q), 5).when(F.exists(dirs, lambda d: d.startswith(q)), 6).otherwise(7)
    )
    found = files.select("path").where(p.contains(q)).distinct()
    return found.select("path", rank.alias("rank"), F.instr(p, q).alias("match_index"), F.length(name).alias("name_length"), F.size(F.split(p, "/", -1)).alias("depth"))


SEARCH_ORDER = ["rank", "match_index", "name_length", "depth"]


def ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``ignored`` to paths by rules (ord, regex, negated), the last that matches a path or a directory above it deciding.

    A path below an ignored directory is ignored whatever later rules say. The
    rules are one repository's rule files: a bounded table that is sent to all tasks.
    """
    each = files.select("path", F.explode(F.array_union(ancestors(F.col("path")), F.array("path"))).alias("prefix"))
    met = each.join(F.broadcast(rules), F.expr("prefix RLIKE regex"))
    last = met.groupBy("path", "prefix").agg(F.max_by("negated", "ord").alias("negated"))
    hit = last.where("NOT negated").select("path").distinct().withColumn("ignored", F.lit(True))
    return files.join(hit, "path", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))


GENERATED_NAMES = r"(?i)(\.g\.cs|\.g\.i\.cs|\.designer\.cs|\.generated\.cs)$"


def generated(path: Column, text: Column, marker: str = "<auto-generated") -> Column:
    """By name, or by a marker in the first 4096 characters: the mark's place is part of the rule."""
    return path.rlike(GENERATED_NAMES) | (F.locate(marker, F.lower(F.substring(text, 1, 4096))) > 0)


def owners(files: DataFrame, projects: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """(path, project): every project directory above a file, by an equi-join on the file's ancestors, and every project that links the file (project, path)."""
    up = files.select("path", F.explode(ancestors(F.col("path"))).alias("project"))
    out = up.join(projects.select(F.col("directory").alias("project")).distinct(), "project").select("path", "project")
    if linked is not None:
        out = out.unionByName(linked.select("path", "project").join(files.select("path").distinct(), "path", "left_semi"))
    return out.distinct()


def in_changed(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files among changed paths (path)."""
    return files.join(changed.select("path").distinct(), "path", "left_semi")


def in_ownership(files: DataFrame, owned_by: DataFrame) -> DataFrame:
    """Files that some project owns, and external ones (``external``)."""
    inside = files.where(~F.col("external")).join(owned_by.select("path").distinct(), "path", "left_semi")
    return inside.unionByName(files.where("external").select(*inside.columns))


def owned(files: DataFrame, owned_by: DataFrame) -> DataFrame:
    """(path, owning_projects, owner_count), also of files without owners."""
    lists = owned_by.groupBy("path").agg(F.array_sort(F.collect_list("project")).alias("owning_projects"))
    none = F.array().cast("array<string>")
    out = files.select("path").distinct().join(lists, "path", "left").withColumn("owning_projects", F.coalesce("owning_projects", none))
    return out.withColumn("owner_count", F.size("owning_projects"))


TEST_WORDS = ("test", "tests")


def test_named(path: Column, words: list[str] = TEST_WORDS) -> Column:
    """Whether some part of a path, between slashes, dots, hyphens and underscores, is one of the words or ends in "tests"."""
    return F.exists(F.split(path, r"[/\\.\-_]", -1), lambda s: F.lower(s).isin(list(words)) | F.lower(s).endswith("tests"))


def is_test(owned_files: DataFrame, words: list[str] = TEST_WORDS) -> DataFrame:
    """Add ``is_test``: all deepest owners are named as tests; a file without owners goes by its own path."""
    deep = F.filter("owning_projects", lambda o: F.size(F.split(o, "/", -1)) == F.array_max(F.transform("owning_projects", lambda x: F.size(F.split(x, "/", -1)))))
    return owned_files.withColumn("is_test", F.when(F.size("owning_projects") == 0, test_named(F.col("path"), words)).otherwise(F.forall(deep, lambda o: test_named(o, words))))
