"""Version-control, project and C# sources on small inputs."""

from quernel.operators import csharp
from quernel.sources import git, projects

SOURCE = '''using System;
namespace A.B
{
    /* new Ghost() in a comment */
    [Serializable, Obsolete("x")]
    public sealed partial class Box<T> : Base, IThing where T : new()
    {
        private readonly int count = 3, other;
        public string Name { get; set; } = "new Text()";
        public int Size => count + Helper.Compute<int>(1);
        public event EventHandler Done;
        public Box(int n, List<string> names = null) : base(n) { Run(n); }
        [Fact] internal static async Task<int> Run(int a, ref string b)
        {
            try { var x = new Thing(a) { P = 1 }; Thing y = new(); await x?.Call(); }
            catch (IOException e) when (e.HResult == 3) { }
            catch { Log("caught {0}"); }
            int[] z = new int[3];
            return nameof(a).Length;
        }
        enum Color { Red = 1, [Flag] Green }
    }
    interface IThing { void Go(); }
}
'''


def rows(text):
    return csharp.parse(text)[0]


def test_declarations():
    got = {(f[0], f[1], f[2], f[5]) for f in rows(SOURCE)}
    for want in [
        ("class", "Box", "A.B", ""), ("property", "Name", "A.B.Box", ""), ("property", "Size", "A.B.Box", ""),
        ("event", "Done", "A.B.Box", ""), ("constructor", "Box", "A.B.Box", "(int, List<string>)"), ("method", "Run", "A.B.Box", "(int, refstring)"),
        ("enum", "Color", "A.B.Box", ""), ("enum_member", "Red", "A.B.Box.Color", ""), ("enum_member", "Green", "A.B.Box.Color", ""),
        ("interface", "IThing", "A.B", ""), ("method", "Go", "A.B.IThing", "()"),
    ]:
        assert want in got, (want, got)


def test_expressions():
    facts = rows(SOURCE)
    assert {(f[1], f[6]) for f in facts if f[0] == "object_creation"} == {("Thing", "explicit"), ("", "implicit"), ("int", "array")}
    assert sorted((f[1], f[6]) for f in facts if f[0] == "catch") == [("", "body"), ("IOException", "empty")]
    assert {(f[1], f[6]) for f in facts if f[0] == "invocation"} == {("Run", "simple"), ("Compute", "member"), ("Call", "member"), ("Log", "simple")}
    assert [f[3] for f in facts if f[1] == "Box" and f[0] == "class"] == [["Serializable", "Obsolete"]]


def test_broken_sources_still_give_facts():
    facts, bad = csharp.parse("class A { void F() { G(; } class B { ")
    assert bad and {"A", "B"} <= {f[1] for f in facts if f[0] == "class"} | {"B"}
    for text in ["", "}}}}", "((((", '"unended', '@"', "class", "[", "class A : ", "new", "catch", "'"]:
        csharp.parse(text)


def test_fact_tables(spark):
    df = spark.createDataFrame([("a.cs", SOURCE), ("b.cs", None), ("c.cs", 'class C { string s = "😀"; void M() { N(); } }')], "path string, text string")
    facts = csharp.syntax_facts(df)
    assert [(r["path"], r["line"]) for r in csharp.invocations(facts, "Log").collect()] == [("a.cs", 17)]
    n = csharp.invocations(facts, "N").first()
    assert n["column"] == 'class C { string s = "😀"; void M() { N'.index("N", 30) + 2
    assert csharp.classes_with(facts, "SerializableAttribute").count() == 1
    assert sorted(r["type_match"] for r in csharp.object_creations(facts, "Thing").collect()) == ["exact", "unresolved"]
    assert csharp.catches(facts, "IOException", empty=True).count() == 1 and csharp.catches(facts).count() == 2
    access = {r["qualified"]: r["accessibility"] for r in csharp.declarations(facts).collect()}
    assert access["A.B.Box"] == "public" and access["A.B.Box.Run"] == "internal" and access["A.B.IThing.Go"] == "public" and access["C.M"] == "private" and access["C"] == "internal"
    items = [(r["seq"], r["kind"], r["total"]) for r in csharp.outline(facts, 2).where("path = 'c.cs'").orderBy("seq").collect()]
    assert items == [(1, "class", 3), (2, "field", 3)]


def test_git_outputs(spark):
    z = "\0"
    status = z.join(["1 .M N... 100644 100644 100644 a b src/x y.cs", "2 R. N... 100644 100644 100644 a b R100 new.cs", "old.cs", "u UU N... 1 1 1 1 a b c both.cs", "? free.txt", "! bin/o", ""])
    got = git.status_entries(spark.createDataFrame([("r", status.encode()), ("n", None)], "repository string, output binary")).collect()
    assert sorted((r["path"], r["original_path"], r["tracking"], r["conflict"]) for r in got) == [("bin/o", None, "ignored", False), ("both.cs", None, "tracked", True), ("free.txt", None, "untracked", False), ("new.cs", "old.cs", "tracked", False), ("src/x y.cs", None, "tracked", False)]
    diff = z.join(["M", "a", "R090", "b", "c", "D", "Rd", "C1", "Ce", "Rf", ""])
    got = git.diff_entries(spark.createDataFrame([("r", diff.encode()), ("n", None), ("e", b"")], "repository string, output binary")).collect()
    assert [tuple(r)[1:] for r in got] == [("M", "a", None), ("R090", "c", "b"), ("D", "Rd", None), ("C1", "Rf", "Ce")]
    tricky = z.join(["2 R. N... 1 1 1 a b R100 new", "2 R. N... 1 1 1 a b R100 old", "2 R. N... 1 1 1 a b R9 x", "1 looks like a record", "? a b", "1 short", ""])
    got = git.status_entries(spark.createDataFrame([("r", tricky.encode())], "repository string, output binary")).collect()
    assert [(r["path"], r["original_path"]) for r in got] == [("new", "2 R. N... 1 1 1 a b R100 old"), ("x", "1 looks like a record"), ("a b", None)]


def test_projects(spark):
    proj = '<Project Sdk="X" xmlns="u"><PropertyGroup><TargetFrameworks>net8.0; net9.0;$(Other)</TargetFrameworks><Configurations>Debug;Release</Configurations></PropertyGroup><ItemGroup><ProjectReference Include="..\\lib\\lib.csproj"/><Compile Include="../../out.cs"/></ItemGroup></Project>'
    df = spark.createDataFrame([("src/app/app.csproj", proj), ("all.slnx", '<Solution><Folder Name="x"><Project Path="src/app/app.csproj"/></Folder></Solution>'), ("old.sln", 'Project("{1}") = "app", "src\\app\\app.csproj", "{2}"\nProject("{3}") = "folder", "folder", "{4}"'), ("x.cs", "class X {}")], "path string, text string")
    m = projects.project_metadata(df.where("path LIKE '%proj'"))
    r = m.first()
    assert (r["frameworks"], r["configurations"], r["references"], r["linked"]) == (["net8.0", "net9.0"], ["Debug", "Release"], ["src/lib/lib.csproj"], ["out.cs"])
    assert [tuple(e) for e in projects.project_edges(m).collect()] == [("src/app/app.csproj", "src/lib/lib.csproj")]
    assert sorted(tuple(e) for e in projects.solution_members(df).collect()) == [("all.slnx", "src/app/app.csproj"), ("old.sln", "src/app/app.csproj")]
    assert {e["kind"]: e["n"] for e in projects.catalogue(df).collect()} == {"project": 1, "solution": 2, "source": 1}
    assert projects.entry_point(df).first()["state"] == "ambiguous" and projects.entry_point(df, "all.slnx").first()["state"] == "selected"
    broken = spark.createDataFrame([("a.csproj", "<Project><"), ("b.csproj", None)], "path string, text string")
    assert [(r["state"], r["references"]) for r in projects.project_metadata(broken).collect()] == [("broken", []), ("broken", [])]
    assert projects.entry_point(df.where("path = 'all.slnx'")).first()["path"] == "all.slnx"
