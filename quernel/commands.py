"""The queries as commands: one function each, with default columns, ``fields`` for more, limits and scopes.

A corpus is a table of files (path, text) as ``traversed`` leaves it; what a
compiler knows comes in as fact tables. Every command gives a lazy DataFrame of
its default columns and those asked for, in declared order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.identity import entity_id, symbol_id
from quernel.operators import analysis, bounded, context, csharp, files, semantics, symbols, text
from quernel.sources import projects, worktree

VERSION = "1"
LIMIT = 100

#: Columns of each command in order, and how many of them are there unless more are asked for.
FIELDS: dict[str, tuple[list[str], list[str]]] = {
    "search file": (["id", "path", "kind", "owning_project_count", "owning_projects", "external"], ["path"]),
    "search text": (["id", "file", "line", "column", "external", "preview"], ["file", "line", "preview"]),
    "search symbol": (["id", "kind", "name", "qualified", "namespace", "accessibility", "signature", "file", "line", "column", "owning_projects", "is_test", "is_generated", "rank"], ["kind", "name", "file", "line"]),
    "search references": (["id", "identity", "file", "start", "length", "line", "project", "configuration", "framework"], ["file", "line", "project", "framework"]),
    "search implementations": (["id", "symbol", "kind", "file", "line", "project", "configuration", "framework"], ["file", "line", "project", "framework"]),
    "search syntax": (["id", "construct", "file", "line", "column", "start", "length", "name", "type_match", "status", "reasons"], ["file", "line"]),
    "outline": (["file", "seq", "kind", "name", "signature", "depth", "total"], ["file", "seq", "kind", "name", "signature", "depth", "total"]),
}


@dataclass
class Corpus:
    """Files (path, text), and what is known of them: rules of ignore files, projects (directory), linked files (project, path), changed paths (path)."""

    files: DataFrame
    rules: DataFrame | None = None
    projects: DataFrame | None = None
    linked: DataFrame | None = None
    changed: DataFrame | None = None
    session: semantics.Session = field(default_factory=semantics.Session)

    def scoped(self, paths: list[str] = (), project: str | None = None, changed: bool = False, include_generated: bool = False) -> DataFrame:
        """The files that a command sees."""
        scopes = [*paths, *([project] if project else [])] if not paths or not project else list(paths)
        out = worktree.traversed(self.files, self.rules, scopes=scopes, external=list(paths), include_generated=include_generated)
        if paths and project:
            out = out.where(worktree.within(F.col("path"), [project]))
        if changed:
            if self.changed is None:
                raise ValueError("no changed paths are given")
            out = files.in_changed(out, self.changed)
        return out

    def owners(self) -> DataFrame:
        if self.projects is None:
            raise ValueError("no projects are given")
        return self.session.get(lambda: files.owners(self.files, self.projects, self.linked), "owners")

    def facts(self, *kinds: str) -> DataFrame:
        """Syntax facts of some kinds of all C# files, parsed once a session."""
        return self.session.get(lambda: csharp.syntax_facts(self._sources(), list(kinds)), "facts", *kinds)

    def facts_of(self, path: str) -> DataFrame:
        """Declarations of one C# file; no other one is parsed."""
        return csharp.syntax_facts(self._sources().where(F.col("path") == path), csharp.DECLARED)

    def _sources(self) -> DataFrame:
        return self.files.where(F.col("path").rlike(r"(?i)\.cs$"))


def _fields(command: str, df: DataFrame, fields: list[str]) -> DataFrame:
    declared, default = FIELDS[command]
    return bounded.project(df, [c for c in declared if c in df.columns or c in default], default, fields)


def _bounded(command: str, df: DataFrame, order: list, limit: int | None, fields: list[str], full: bool) -> DataFrame:
    """The command's columns of the first rows, with ``total``, ``omitted`` and how to get the rest."""
    rows = bounded.enveloped(df, order, None if full else limit, f"{command} --full")
    told = [c for c in ("total", "truncated", "omitted", "retrieval") if c in rows.columns and c not in FIELDS[command][0]]
    kept = _fields(command, df.limit(0), fields).columns
    return rows.select(*kept, *told)


def home(corpus: Corpus) -> DataFrame:
    """One row: root, kind of workspace, numbers of solutions, projects, sources, changed files and further capabilities."""
    path = F.col("path")
    counts = corpus.files.agg(
        F.count_if(path.rlike(r"(?i)\.slnx?$")).alias("solutions"), F.count_if(path.rlike(r"(?i)\.csproj$")).alias("projects"), F.count_if(path.rlike(r"(?i)\.cs$")).alias("sources")
    )
    extra = worktree.capabilities(corpus.files).agg(F.count("*").alias("capabilities"))
    changed = (corpus.changed or corpus.files.select("path").limit(0)).select("path").distinct().agg(F.count("*").alias("changed"))
    return worktree.workspace(corpus.files).crossJoin(counts).crossJoin(changed).crossJoin(extra)  # one row each


def version() -> dict:
    return {"tool": "quernel", "version": VERSION, "commands": sorted(analysis.POLICIES)}


def help_text() -> str:
    return "\n".join(f"{name}  [{'executing' if p.executing else 'passive'}]" for name, p in sorted(analysis.POLICIES.items()))


def search_file(
    corpus: Corpus, query: str, case_sensitive: bool = False, extensions: list[str] = (), globs: list[str] = (), paths: list[str] = (),
    project: str | None = None, changed: bool = False, include_generated: bool = False, limit: int | None = LIMIT, full: bool = False, fields: list[str] = (),
) -> DataFrame:
    seen = files.matching(corpus.scoped(paths, project, changed, include_generated), extensions, globs, case_sensitive=case_sensitive)
    found = files.search_files(seen, query, case_sensitive).join(seen.select("path", "external").distinct(), "path")
    found = found.withColumns({"id": entity_id("file", path=F.col("path"), external=F.col("external")), "kind": files.kind(F.col("path"))})
    if corpus.projects is not None:
        owned = files.owned(found.select("path"), corpus.owners()).withColumnRenamed("owner_count", "owning_project_count")
        found = found.join(owned, "path", "left")
    order = [*[F.col(c) for c in files.SEARCH_ORDER], F.length("path"), F.col("path")]
    return _bounded("search file", found, order, limit, list(fields), full)


def search_text(
    corpus: Corpus, query: str, case_sensitive: bool = False, regex: bool = False, paths: list[str] = (), project: str | None = None,
    changed: bool = False, include_generated: bool = False, limit: int = LIMIT, full: bool = False, fields: list[str] = (),
) -> DataFrame:
    """Matches by file, line and column. Without ``full`` a literal search stops early: its total is known only if nothing is left out."""
    seen = corpus.scoped(paths, project, changed, include_generated)
    if regex:
        found = text.search_regex(seen, query, case_sensitive)
    elif full:
        found = text.search_literal(seen, query, case_sensitive)
    else:
        found = text.first_matches(seen, query, limit, case_sensitive)
    extra = seen.select("path", "external", F.sha2("text", 256).alias("content_hash"))
    mode = "regex" if regex else "ordinal" if case_sensitive else "ignore-case"
    found = found.join(extra, "path").withColumnRenamed("path", "file")
    place = F.concat_ws(":", "line", "column")
    found = found.withColumn("id", entity_id("text", content_hash=F.col("content_hash"), path=F.col("file"), start=place, length=F.length("match"), query=F.lit(query), mode=F.lit(mode)))
    order = [bounded.utf16_order("file"), F.col("line"), F.col("column")]
    if regex or full:
        return _bounded("search text", found, order, limit, list(fields), full)
    kept = _fields("search text", found.limit(0), list(fields)).columns
    return found.orderBy(*order).select(*kept, "total", "total_known")


def declared_symbols(corpus: Corpus) -> DataFrame:
    """Declarations of the C# files with identities, owners and classification."""
    d = csharp.declarations(corpus.facts(*csharp.DECLARED)).join(worktree.traversed(corpus.files, corpus.rules, include_generated=True).select("path", "is_generated").distinct(), "path")
    d = d.withColumn("id", symbol_id(F.col("name"), F.sha2(F.concat_ws("\n", "kind", "qualified", "signature"), 256), F.sha2(F.concat_ws("\n", "path", "line", "column"), 256)))
    if corpus.projects is None:
        return d.withColumns({"owning_projects": F.array().cast("array<string>"), "is_test": files.test_named(F.col("path"))})
    return d.join(files.is_test(files.owned(d.select("path"), corpus.owners())).select("path", "owning_projects", "is_test"), "path")


def search_symbol(
    corpus: Corpus, query: str, kinds: list[str] = (), namespace: str | None = None, projects_: list[str] = (), paths: list[str] = (), accessibilities: list[str] = (),
    include_tests: bool = False, include_generated: bool = False, limit: int = LIMIT, full: bool = False, fields: list[str] = (),
) -> DataFrame:
    d = declared_symbols(corpus)
    if paths:
        d = d.where(worktree.within(F.col("path"), list(paths)))
    d = symbols.filtered(d, kinds, accessibilities, namespace, projects_, include_tests, include_generated)
    found = symbols.search_symbols(d, query).withColumn("file", F.col("path"))
    order = [F.col(c) for c in ("rank", "file", "line", "column", "kind", "qualified", "signature", "id")]
    return _bounded("search symbol", found, order, limit, list(fields), full)


def search_references(facts: DataFrame, asked: DataFrame, scope: DataFrame, eligible: DataFrame | None = None, limit: int = LIMIT, full: bool = False, fields: list[str] = ()) -> DataFrame:
    found = semantics.references(facts, asked, scope, eligible).withColumn("file", F.col("path"))
    order = [*bounded.evidence_order("file", "line", "start", "project"), F.col("configuration").asc_nulls_first(), F.col("framework").asc_nulls_first(), F.col("id")]
    return _bounded("search references", found, order, limit, list(fields), full)


def search_implementations(type_edges: DataFrame, member_edges: DataFrame, declared: DataFrame, targets: DataFrame, limit: int = LIMIT, full: bool = False, fields: list[str] = ()) -> DataFrame:
    """``declared`` has (symbol, kind, in_source, path, line, start, length, project, configuration, framework)."""
    found = semantics.implementations(type_edges, member_edges, declared, targets).withColumn("file", F.col("path"))
    parts = {c: F.col(c) for c in ("project", "configuration", "framework", "path", "start", "length")}
    found = found.withColumn("id", entity_id("implementation", identity=F.col("symbol"), **parts))
    return _bounded("search implementations", found, [*bounded.evidence_order("file", "line", "symbol"), F.col("id")], limit, list(fields), full)


#: Constructs of a syntax search, and the facts that they are found among.
CONSTRUCTS = {"invocation": "invocation", "class": "class", "object-creation": "object_creation", "catch": "catch"}


def search_syntax(
    corpus: Corpus, construct: str, value: str | None = None, empty: bool = False, paths: list[str] = (), include_generated: bool = False,
    verify: DataFrame | None = None, limit: int = LIMIT, full: bool = False, fields: list[str] = (),
) -> DataFrame:
    """Candidates of a construct: "invocation" by name, "class" by attribute, "object-creation" by type, "catch" by type.

    ``verify`` is a table (id, status, reasons) from ``semantics.verified``.
    """
    seen = corpus.scoped(paths, include_generated=include_generated)
    if construct not in CONSTRUCTS:
        raise ValueError(f"unknown construct {construct!r}")
    facts = corpus.facts(CONSTRUCTS[construct]).join(seen.select("path").distinct(), "path", "left_semi")
    if construct == "invocation":
        found = csharp.invocations(facts, value)
    elif construct == "class":
        found = csharp.classes_with(facts, value)
    elif construct == "object-creation":
        found = csharp.object_creations(facts, value)
    else:
        found = csharp.catches(facts, value, empty)
    found = csharp.identified(found, seen, f"{construct}:{value}:{empty}").withColumns({"file": F.col("path"), "construct": F.lit(construct)})
    if verify is not None:
        found = found.join(verify.select("id", "status", "reasons"), "id", "left")
    return _bounded("search syntax", found, [F.col("file"), F.col("start"), F.col("length"), F.col("id")], limit, list(fields), full)


def show_symbol(corpus: Corpus, symbol: str, most: int = 1000) -> DataFrame:
    """The declaration of an identity: exact, else the only one of the same stable part; its text up to ``most`` characters."""
    d = declared_symbols(corpus)
    asked = symbol.split(":")
    if len(asked) != 4 or asked[0] != "symbol/q2":
        raise ValueError("not a symbol identity")
    parts = F.split("id", ":", -1)
    same = d.where((F.get(parts, F.lit(1)) == asked[1]) & (F.get(parts, F.lit(2)) == asked[2]))
    exact = same.where(F.col("id") == symbol)
    chosen = exact.unionByName(same.join(exact.agg(F.count("*").alias("n")).where("n = 0"), F.lit(True), "left_semi").where(F.col("id") != symbol))
    shown = context.show_symbol(corpus.facts(*csharp.DECLARED), corpus.files).withColumns({"shown_kind": F.replace("kind", F.lit("_"), F.lit("-")), "q": F.concat_ws(".", F.when(F.col("container") != "", F.col("container")), "name")}).drop("kind", "name")
    met = chosen.join(shown, (chosen["path"] == shown["path"]) & (chosen["qualified"] == shown["q"])).drop(shown["path"])
    kept, size, more = bounded.bounded_text(F.col("body"), most)
    return met.where(F.col("kind") == F.col("shown_kind")).select(
        "id", "path", "line", "kind", "qualified", "accessibility", kept.alias("body"), size.alias("body_chars"), more.alias("truncated"), "documentation",
        "attributes", "parameters", "type_parameters", "members", "bases", "overloads",
    ).dropDuplicates(["id"])


def show_document(corpus: Corpus, path: str, first: int | None = None, last: int | None = None, most: int = 1000, full: bool = False, expected: str | None = None) -> DataFrame:
    return context.show_document(corpus.files, path, first, last, (1 << 30) if full else most, expected)


SECTIONS = ("declaration", "owner", "document", "outline")


def context_symbol(corpus: Corpus, name: str, include: list[str] = (), most: int = 12_000) -> DataFrame:
    """(path, name, included, omitted, used): the whole sections of a declaration that fit a budget, of those asked for."""
    unknown = context.missing_sections(list(include), list(SECTIONS))
    if unknown:
        raise ValueError(f"unknown sections {unknown}; there are {list(SECTIONS)}")
    shown = context.show_symbol(corpus.facts(*csharp.DECLARED), corpus.files).where(F.col("name") == name)
    all_sections = context.sections(shown, corpus.owners(), csharp.outline(corpus.facts(*csharp.DECLARED)))
    return context.context(all_sections.where(F.col("section").isin(list(include or SECTIONS))), most)


def outline(corpus: Corpus, path: str, limit: int = LIMIT, full: bool = False, fields: list[str] = ()) -> DataFrame:
    rows = csharp.outline(corpus.facts_of(path), (1 << 30) if full else limit).withColumn("file", F.col("path"))
    return _fields("outline", rows, list(fields)).orderBy("seq")


def solution_scope(corpus: Corpus, solutions: DataFrame) -> DataFrame:
    """(solution, project): discovered projects of solution files (path, text)."""
    discovered = corpus.files.where(F.col("path").rlike(r"(?i)\.csproj$")).select(F.col("path").alias("project"))
    return semantics.solution_projects(projects.solution_members(solutions), discovered)
