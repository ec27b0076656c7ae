"""Facts of C# files over many files: one parse, over many tasks, counts and owners from the parser."""

import contextlib
import io

from pyspark.sql import functions as F

from quernel import commands
from quernel.operators import context, csharp

TEXT = "namespace N;\npublic partial class A { int X; void F() { G(); } void F(int a) {} }\npartial class A { interface I { void H(); } }"


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_declarations_parse_once_and_partial_types_tell_members_once(spark):
    facts = csharp.syntax_facts(spark.createDataFrame([("a.cs", TEXT)], "path string, text string"))
    d = csharp.declarations(facts)
    assert _plan(d).count("MapInArrow") == 1
    rows = [(r["qualified"], r["signature"], r["namespace"], r["accessibility"]) for r in d.collect()]
    assert sorted(rows) == [
        ("N.A", "", "N", "internal"), ("N.A", "", "N", "public"), ("N.A.F", "()", "N", "private"), ("N.A.F", "(int)", "N", "private"),
        ("N.A.I", "", "N", "private"), ("N.A.I.H", "()", "N", "public"), ("N.A.X", "", "N", "private"),
    ]


def test_shown_symbols_parse_once_and_broadcast_no_text(spark):
    files = spark.range(0, 40, 1, 1).select(F.concat(F.lit("f"), "id", F.lit(".cs")).alias("path"), F.lit(TEXT).alias("text"))
    facts = csharp.syntax_facts(files)
    shown = context.show_symbol(facts, files)
    plan = _plan(shown)
    assert plan.count("MapInArrow") == 1 and "Broadcast" not in plan
    counts = {(r["name"], r["members"], r["overloads"]) for r in shown.where("path = 'f7.cs'").collect()}
    assert counts == {("A", 4, 2), ("X", 0, 1), ("F", 0, 2), ("I", 1, 1), ("H", 0, 1)}
    assert "Broadcast" not in _plan(csharp.identified(csharp.invocations(facts, "G"), files, "q"))


def test_files_of_one_partition_are_parsed_in_many_tasks(spark):
    files = spark.range(0, 400, 1, 1).select(F.concat(F.lit("f"), "id", F.lit(".cs")).alias("path"), F.lit(TEXT).alias("text"))
    facts = csharp.syntax_facts(files, ["invocation"])
    assert facts.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert facts.select("kind").distinct().collect() == [("invocation",)] and facts.count() == 400


def test_an_outline_parses_its_file_only(spark):
    corpus = commands.Corpus(spark.createDataFrame([("a.cs", TEXT), ("b.cs", TEXT)], "path string, text string"))
    assert [r["name"] for r in commands.outline(corpus, "b.cs").collect()] == ["A", "X", "F", "F", "A", "I", "H"]
    assert not corpus.session.built
