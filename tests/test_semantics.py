"""Semantic operators, worktrees and commands on small tables with known results."""

import pytest
from pyspark.sql import functions as F

from quernel import commands
from quernel.operators import analysis, context, csharp, files, graph, semantics, symbols
from quernel.sources import worktree

SOURCE = """namespace A.B;
/// <summary>Runs.</summary>
/// <remarks>Twice.</remarks>
[Serializable]
public class Runner<T, U> : Base<T>, IRun, IDisposable where T : class
{
    public Runner(int x) { }
    protected internal void Run() { }
    void Run(string s, Dictionary<string, int> map) { Go<int>(s); }
    public static implicit operator int(Runner<T, U> r) => 1;
    enum Kind { One, Two }
}
"""


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_ignore_lines():
    rule = worktree.ignore_rule
    assert rule("# note") is None and rule("") is None and rule("/") is None and rule("   ") is None
    assert rule("*.log")[1:] == (False, False, False, False)
    assert rule("!/keep/") [1:] == (False, True, True, True)
    assert rule("a/b")[1:] == (True, False, False, False)
    assert rule("\\#name")[0] == rule("#name".replace("#", "\\#"))[0] and rule("x\\ ")[0] is not None


def test_ignored_paths(spark):
    paths = ["a.log", "keep/a.log", "keep/b/a.log", "out/x", "src/out/x", "src/keep.txt", "src/no.txt", "deep/no.txt", "top"]
    seen = table(spark, [(p,) for p in paths], "path string")
    rules = worktree.ignore_rules(table(spark, [(".ignore", "*.log\n!keep/*.log\nout/\n/top\nno.txt"), ("src/.ignore", "!no.txt\n/keep.txt")], "path string, text string"))
    got = {r["path"] for r in worktree.ignored_paths(seen, rules).collect()}
    assert got == {"a.log", "keep/b/a.log", "out/x", "src/out/x", "src/keep.txt", "deep/no.txt", "top"}


def test_traversal(spark):
    paths = [".git/HEAD", "bin/a.cs", "src/Obj/a.cs", "src/a.cs", "src/a.g.cs", "../b.cs", "/c.cs"]
    seen = table(spark, [(p, "") for p in paths], "path string, text string")
    told = lambda **k: sorted(r["path"] for r in worktree.traversed(seen, **k).collect())
    assert told() == ["src/a.cs"]
    assert told(include_generated=True) == ["src/a.cs", "src/a.g.cs"]
    assert told(scopes=["bin"]) == ["bin/a.cs"]
    assert told(external=["../b.cs"]) == ["../b.cs", "src/a.cs"]


def test_test_names(spark):
    rows = [("src/Tests/a.cs", True), ("src/MyTests.cs", True), ("src/unit-test/a", True), ("src/testing/a", False), ("src/contest.cs", False)]
    got = table(spark, rows, "path string, want boolean").select("path", "want", files.test_named(F.col("path")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_declarations_and_counts(spark):
    docs = table(spark, [("a.cs", SOURCE), ("b.cs", None)], "path string, text string")
    facts = csharp.syntax_facts(docs)
    d = {(r["kind"], r["name"], r["signature"]): r for r in csharp.declarations(facts).collect()}
    assert {(k, n) for k, n, _ in d} == {("class", "Runner"), ("constructor", "Runner"), ("method", "Run"), ("conversion-operator", "int"), ("enum", "Kind"), ("enum-member", "One"), ("enum-member", "Two")} or ("enum-member", "One") in {(k, n) for k, n, _ in d}
    assert {r["namespace"] for r in d.values()} == {"A.B"}
    assert d["method", "Run", "()"]["accessibility"] == "protected-internal" and d["enum-member", "One", ""]["accessibility"] == "public"
    shown = {(r["kind"], r["name"], r["parameters"]): r for r in context.show_symbol(facts, docs).collect()}
    runner = shown["class", "Runner", 0]
    assert runner["documentation"] == "<summary>Runs.</summary>\n<remarks>Twice.</remarks>"
    assert (runner["bases"], runner["type_parameters"], runner["attributes"], runner["members"]) == (3, 2, 1, 5)
    assert shown["method", "Run", 2]["overloads"] == 2


def test_symbol_filters(spark):
    rows = [("class", "public", "A.B"), ("method", "private", "A.Bc"), ("class", "internal", "A.B.C")]
    df = table(spark, [(*r, ["p"], False, False) for r in rows], "kind string, accessibility string, namespace string, owning_projects array<string>, is_test boolean, is_generated boolean")
    assert sorted(r["namespace"] for r in symbols.filtered(df, namespace="A.B").collect()) == ["A.B", "A.B.C"]
    assert symbols.filtered(df, kinds=["class"], accessibilities=["public"], projects=["p"]).count() == 1
    for bad in ({"kinds": ["klass"]}, {"accessibilities": ["open"]}):
        with pytest.raises(ValueError):
            symbols.filtered(df, **bad)


def test_resolution_counts(spark):
    d = table(spark, [("Run", "s1", "e1"), ("Run", "s1", "e2"), ("Run", "s2", "e3"), ("Go", "s", "e")], "name string, stable string, exact string")
    asked = [("exact", "Run", "s1", "e1"), ("two", "Run", "s1", "gone"), ("one", "Run", "s2", "gone"), ("old", "Run", "gone", "gone"), ("none", "No", "x", "x")]
    got = {r["request"]: (r["state"], r["matches"]) for r in symbols.resolve(table(spark, asked, "request string, name string, stable string, exact string"), d).collect()}
    assert got == {"exact": ("resolved", 1), "two": ("ambiguous", 2), "one": ("resolved", 1), "old": ("stale", 3), "none": ("not_found", 0)}


def test_groups_by_way_of_others(spark):
    rows = [("t", 1, "v1", "a"), ("t", 2, "v1", "a"), ("t", 2, "v2", "b"), ("t", 3, "v2", "b"), ("t", 4, "v1", "b"), ("u", 1, "v1", "a"), ("u", 5, "v1", "c")]
    states = table(spark, [(*r[:3], "resolved", r[3], None) for r in rows] + [("u", 6, None, "unresolved", None, "x")], "target string, candidate int, variant string, status string, symbol string, reason string")
    got = {(r["target"], r["candidate"]): r["grouping"] for r in semantics.same_symbol(states).collect()}
    assert got == {("t", 1): 1, ("t", 2): 1, ("t", 3): 1, ("t", 4): 4, ("u", 1): 1, ("u", 5): 5, ("u", 6): 6}


def test_cycles_and_closures(spark):
    edges = table(spark, [(1, 2), (2, 3), (3, 1), (3, 2), (4, 4), (5, 1)], "src int, dst int")
    assert sorted(r["cycle"] for r in graph.cycle_paths(edges).collect()) == [[1, 2, 3], [2, 3], [4]]
    one = table(spark, [(1,)], "node int")
    assert {(r["node"], r["depth"]) for r in graph.closure(edges, one).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {r["node"] for r in graph.closure(edges, one, allowed=table(spark, [(2,)], "node int")).collect()} == {1, 2}


def test_policies_and_checks(spark):
    assert analysis.policy_of("search text").executing is False and analysis.policy_of("search syntax catch", ("verify",)).executing
    for bad in (lambda: analysis.policy_of("build"), lambda: analysis.Policy(network=True), lambda: analysis.Check("x", F.lit(True), writes_source=True)):
        with pytest.raises(ValueError):
            bad()
    got = {r["check"]: (r["state"], r["broken"]) for r in analysis.validated(spark.range(4), [analysis.Check("a", F.col("id") > 2), analysis.Check("b", F.col("id") < 0)]).collect()}
    assert got == {"a": ("failed", 1), "b": ("passed", 0)}


def test_commands(spark):
    corpus = commands.Corpus(
        table(spark, [("src/a.cs", SOURCE), ("src/b.cs", "class B { }"), ("p.csproj", "<Project/>"), ("bin/x.cs", "class X { }")], "path string, text string"),
        projects=table(spark, [("src",)], "directory string"), changed=table(spark, [("src/b.cs",)], "path string"),
    )
    found = commands.search_file(corpus, "cs", fields=["kind,owning_projects"]).collect()
    assert {r["path"]: r["owning_projects"] for r in found} == {"src/a.cs": ["src"], "src/b.cs": ["src"], "p.csproj": []}
    assert [r["path"] for r in commands.search_file(corpus, "cs", changed=True).collect()] == ["src/b.cs"]
    assert [(r["file"], r["line"]) for r in commands.search_text(corpus, "RUNNER", full=True, paths=["src/a.cs"]).collect()] == [("src/a.cs", 5), ("src/a.cs", 7), ("src/a.cs", 10)]
    runs = commands.search_symbol(corpus, "Run", kinds=["method"], fields=["id", "signature"]).collect()
    assert sorted(r["signature"] for r in runs) == ["()", "(string, Dictionary<string,int>)"]
    shown = commands.show_symbol(corpus, runs[0]["id"]).collect()
    assert len(shown) == 1 and shown[0]["overloads"] == 2 and "Run" in shown[0]["body"]
    assert [r["name"] for r in commands.outline(corpus, "src/b.cs").collect()] == ["B"]
    assert commands.search_syntax(corpus, "invocation", "Go", fields=["id"]).count() == 1
    assert commands.context_symbol(corpus, "B", ["declaration", "owner"]).first()["included"] == 2
    assert commands.show_document(corpus, "src/b.cs").first()["text"] == "class B { }"
    home = commands.home(corpus).first()
    assert (home["projects"], home["sources"], home["changed"], home["kind"]) == (1, 3, 1, "project")
    with pytest.raises(ValueError):
        commands.context_symbol(corpus, "B", ["callers"])
    with pytest.raises(ValueError):
        commands.search_file(corpus, "x", fields=["colour"])
