"""Symbols in context and rendered rows."""

from quernel.functions.render import as_json, table_text
from quernel.operators import context, csharp, files

SOURCE = "class Box {\n  void Put(int a) { }\n  void Put(string b) { Put(1); }\n}\n"


def test_context_of_symbols(spark):
    src = spark.createDataFrame([("src/app/a.cs", SOURCE)], "path string, text string")
    facts = csharp.syntax_facts(src)
    shown = context.show_symbol(facts, src)
    got = {(r["kind"], r["name"]): (r["overloads"], r["lines"]) for r in shown.collect()}
    assert got == {("class", "Box"): (1, 4), ("method", "Put"): (2, 1)}
    assert {r["body"] for r in shown.where("name = 'Put'").collect()} == {"void Put(int a) { }", "void Put(string b) { Put(1); }"}
    owners = files.owners(src, spark.createDataFrame([("src/app",)], "directory string"))
    parts = context.sections(shown.where("name = 'Box'"), owners, csharp.outline(facts))
    assert [(r["section"], r["text"]) for r in parts.where("section != 'document'").orderBy("priority").collect()] == [("declaration", "class Box"), ("owner", "src/app"), ("outline", "class Box\nmethod Put\nmethod Put")]
    r = context.context(parts, 60).first()
    assert (r["included"], r["omitted"]) == (3, 1)


def test_rendering(spark):
    df = spark.createDataFrame([(1, "a,b", None), (2, "plain text", True)], "n int, t string, b boolean").orderBy("n")
    assert [r["json"] for r in as_json(df).collect()] == ['{"n":1,"t":"a,b","b":null}', '{"n":2,"t":"plain text","b":true}']
    assert table_text("items", df.columns, df.collect()) == 'items[2]{n,t,b}:\n  1,"a,b",null\n  2,plain text,true'
