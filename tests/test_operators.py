"""Operators on small tables with known results."""

import pytest
from pyspark.sql import functions as F

from quernel.functions.identity import identity
from quernel.functions.paths import ancestors, glob_regex, normal_path
from quernel.operators import bounded, changed, files, graph, relations, symbols, text
from quernel.sources.tables import binary_files, decoded
from quernel.streaming.search import stream_search


def test_literal_places_count_utf16(spark):
    df = spark.createDataFrame([("a", "x😀ab\r\nAB ab"), ("b", None), ("c", "")], "path string, text string")
    got = sorted((r["path"], r["line"], r["column"], r["match"]) for r in text.search_literal(df, "ab").collect())
    assert got == [("a", 1, 4, "ab"), ("a", 2, 1, "AB"), ("a", 2, 4, "ab")]
    assert [r["column"] for r in text.search_literal(df, "ab", True).where("line = 2").collect()] == [4]
    with pytest.raises(ValueError):
        text.search_literal(df, "")


def test_literal_in_texts_that_change_length_in_other_case(spark):
    df = spark.createDataFrame([("a", "İİ needle here"), ("b", "ß NEEDLE\n😀needle")], "path string, text string")
    got = sorted((r["path"], r["line"], r["column"], r["match"]) for r in text.search_literal(df, "Needle").collect())
    assert got == [("a", 1, 4, "needle"), ("b", 1, 3, "NEEDLE"), ("b", 2, 3, "needle")]


def test_literal_over_line_ends(spark):
    df = spark.createDataFrame([("a", "one\ntwo\nONE\nTwo"), ("b", "one two")], "path string, text string")
    assert sorted((r["path"], r["line"], r["column"], r["match"]) for r in text.search_literal(df, "e\nt").collect()) == [("a", 1, 3, "e\nt"), ("a", 3, 3, "E\nT")]
    assert sorted((r["line"], r["match"]) for r in text.search_literal(df, "e\nt", True).collect()) == [(1, "e\nt")]


def test_signs_in_a_literal_are_not_a_pattern(spark):
    df = spark.createDataFrame([("a", "a.b(c) [x] \\d $1 ^ a|b"), ("b", "aXb")], "path string, text string")
    for q in ("a.b", "(c)", "[x]", "\\d", "$1", "^", "a|B"):
        assert [(r["path"], r["match"].lower()) for r in text.search_literal(df, q).collect()] == [("a", q.lower())]


def test_patterns_that_match_nothing(spark):
    df = spark.createDataFrame([("a", "foo1 foo2\n7"), ("b", None)], "path string, text string")
    got = sorted((r["line"], r["column"], r["match"]) for r in text.search_regex(df, "[0-9]*").collect())
    assert [g for g in got if g[2]] == [(1, 4, "1"), (1, 9, "2"), (2, 1, "7")]
    assert (1, 1, "") in got and (1, 5, "") in got
    assert sorted((r["line"], r["column"], r["match"]) for r in text.search_regex(df, "(?<=foo)[0-9]").collect()) == [(1, 4, "1"), (1, 9, "2")]


def test_a_slow_file_gives_its_matches_up(spark):
    df = spark.createDataFrame([("slow", "aaa " + "a" * 40 + "b"), ("quick", "aac"), ("none", None)], "path string, text string")
    got = {(r["path"], r["status"], len(r["found"])) for r in text.regex_files(df, "(a|a)+c|aaa", deadline=0.2).collect()}
    assert got == {("slow", "regular_expression_timeout", 0), ("quick", "analyzed", 1), ("none", "no_text", 0)}
    with pytest.raises(ValueError):
        text.search_regex(df, "(")


def test_early_stop_knows_its_total_only_if_nothing_is_left(spark):
    df = spark.createDataFrame([(f"f{i}", "x x" if i % 2 else "y") for i in range(10)], "path string, text string")
    rows = text.first_matches(df, "x", 3).collect()
    assert [(r["path"], r["column"], r["total_known"], r["total"]) for r in rows] == [("f1", 1, False, None), ("f1", 3, False, None), ("f3", 1, False, None)]
    assert {(r["total_known"], r["total"]) for r in text.first_matches(df, "x", 10).collect()} == {(True, 10)}
    assert text.first_matches(df, "z", 3).collect() == []


def test_envelopes(spark):
    df = spark.range(7).withColumnRenamed("id", "k")
    rows = bounded.enveloped(df, [F.col("k")], 3, "again --full").collect()
    assert [(r["k"], r["total"], r["omitted"], r["retrieval"]) for r in rows] == [(i, 7, 4, "again --full") for i in range(3)]
    with pytest.raises(Exception):
        bounded.enveloped(df, [F.col("k")], 3).collect()
    assert {r["omitted"] for r in bounded.enveloped(df, [F.col("k")], None).collect()} == {0}
    groups = df.withColumn("g", F.col("k") % 2)
    assert sorted((r["g"], r["k"], r["total"], r["omitted"]) for r in bounded.capped(groups, ["g"], ["k"], 2).collect()) == [(0, 0, 4, 2), (0, 2, 4, 2), (1, 1, 3, 1), (1, 3, 3, 1)]
    words = spark.createDataFrame([("\uffee",), ("\U0001F600",), (None,), ("a",)], "w string")
    assert [r["w"] for r in words.orderBy(bounded.utf16_order("w")).collect()] == ["a", "\U0001F600", "\uffee", None]


def test_overlaps_are_not_matched(spark):
    df = spark.createDataFrame([("a", "aaaaa")], "path string, text string")
    assert sorted(r["column"] for r in text.search_literal(df, "aa").collect()) == [1, 3]


def test_regex_places(spark):
    df = spark.createDataFrame([("a", "no 12 and 345\n7")], "path string, text string")
    got = sorted((r["line"], r["column"], r["match"]) for r in text.search_regex(df, "[0-9]+").collect())
    assert got == [(1, 4, "12"), (1, 11, "345"), (2, 1, "7")]


def test_preview_is_cut_around_the_match(spark):
    df = spark.createDataFrame([("a", "x" * 300 + "needle" + "y" * 300)], "path string, text string")
    p = text.search_literal(df, "needle").first()["preview"]
    assert p.startswith("…") and p.endswith("…") and "needle" in p and len(p) == 162


def test_span_out_of_range(spark):
    df = spark.createDataFrame([("a", "1\n2\n3"), ("b", "1")], "path string, text string")
    got = {r["path"]: (r["status"], r["text"]) for r in text.line_span(df, 2, 9).collect()}
    assert got == {"a": ("ok", "2\n3"), "b": ("out_of_range", None)}


def test_decoding(spark):
    rows = [("u8", b"a\nb"), ("bom", b"\xef\xbb\xbfhi"), ("le", b"\xff\xfeh\x00\n\x00"), ("be", b"\xfe\xff\x00h"), ("u32", b"\xff\xfe\x00\x00"), ("bin", b"a\x00b"), ("bad", b"\xff\xff"), ("none", None), ("empty", b"")]
    got = {r["path"]: (r["status"], r["total_lines"], r["text"]) for r in decoded(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["u8"] == ("success", 2, "a\nb") and got["bom"] == ("success", 1, "hi") and got["le"] == ("success", 1, "h\n") and got["be"] == ("success", 1, "h")
    assert [got[k][0] for k in ("u32", "bin", "bad", "none")] == ["unsupported", "binary", "undecodable", "unreadable"]
    assert got["empty"] == ("success", 0, "")


def test_binary_source(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_bytes(b"hello")
    assert [(r["path"], bytes(r["content"])) for r in binary_files(spark, str(tmp_path)).collect()] == [("d/x.txt", b"hello")]


def test_globs():
    import re

    hit = lambda g, p: re.search(glob_regex(g), p) is not None
    assert hit("*.cs", "a/b.cs") and hit("bin", "a/bin/c.dll") and not hit("*.cs", "a/b.csx")
    assert hit("src/**/x?.cs", "src/x1.cs") and hit("src/**/x?.cs", "src/a/b/x1.cs") and not hit("src/*.cs", "src/a/b.cs")
    assert hit("[!a]*.txt", "b.txt") and not hit("[!a]*.txt", "a.txt")


def test_normal_paths(spark):
    rows = ["a//b/./c", "a/../b", "../x", "/abs", "a\\b", "C:/x", "a/b/../../c", ""]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "p string").select(normal_path(F.col("p"))).collect()]
    assert got == ["a/b/c", "b", None, None, "a/b", None, "c", ""]
    assert spark.createDataFrame([("a/b/c.x",)], "p string").select(ancestors(F.col("p"))).first()[0] == ["a", "a/b"]


def test_file_ranks(spark):
    paths = ["foo", "x/foo", "x/foo.cs", "x/foobar.cs", "x/a_foo.cs", "foo/y", "foobar/y", "xfoo/y", "none"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"]: r["rank"] for r in files.search_files(df, "FOO").collect()} == dict(zip(paths[:8], range(8)))


def test_last_rule_decides_but_directories_prune(spark):
    rules = spark.createDataFrame([(1, "^(?:.*/)?build$", False), (2, "^build/keep.txt$", True), (3, "^.*\\.log$", False), (4, "^a/x.log$", True)], "ord int, regex string, negated boolean")
    df = spark.createDataFrame([(p,) for p in ("build/keep.txt", "a/x.log", "b/x.log", "c")], "path string")
    assert {r["path"]: r["ignored"] for r in files.ignored(df, rules).collect()} == {"build/keep.txt": True, "a/x.log": False, "b/x.log": True, "c": False}


def test_owners_and_tests(spark):
    df = spark.createDataFrame([("src/app/a.cs",), ("src/app.tests/b.cs",), ("tests/c.cs",)], "path string")
    projects = spark.createDataFrame([("src",), ("src/app",), ("src/app.tests",)], "directory string")
    owned = files.is_test(files.owned(df, files.owners(df, projects)), ["tests"])
    got = {r["path"]: (r["owning_projects"], r["is_test"]) for r in owned.collect()}
    assert got == {"src/app/a.cs": (["src", "src/app"], False), "src/app.tests/b.cs": (["src", "src/app.tests"], True), "tests/c.cs": ([], True)}


def test_changed_scopes(spark):
    entries = spark.createDataFrame([("a", None, False), ("b", "old_b", False), ("c", None, True)], "path string, original_path string, conflict boolean")
    diff = spark.createDataFrame([("R90", "n", "o"), ("C80", "k", "from"), ("M", "c", None)], "status string, path string, original_path string")
    names = lambda df: sorted(r["path"] for r in df.collect())
    assert names(changed.worktree_scope(entries)) == ["a", "b", "old_b"]
    assert names(changed.merge_base_scope(entries, diff)) == ["a", "b", "k", "n", "o", "old_b"]
    assert sorted((r["path"], r["state"]) for r in changed.three_dot_scope(entries, diff).collect()) == [("c", "conflict"), ("k", "changed"), ("n", "changed"), ("o", "changed")]


def test_identifier_tokens(spark):
    df = spark.createDataFrame([("HTTPServerError2Foo_bar",)], "n string")
    assert df.select(symbols.tokens(F.col("n"))).first()[0] == ["http", "server", "error2foo", "bar"]  # a letter after a digit begins no word
    d = spark.createDataFrame([(n, "N." + n) for n in ("GetUser", "getuser", "GetUserName", "UserGet", "XGetUserY", "GiveUp", "other")], "name string, qualified string")
    got = {r["name"]: r["rank"] for r in symbols.search_symbols(d, "GetUser").collect()}
    assert got == {"GetUser": 1, "getuser": 2, "GetUserName": 3, "UserGet": 4, "XGetUserY": 4}
    assert {r["name"]: r["rank"] for r in symbols.search_symbols(d, "GU").collect()} == {"GetUser": 4, "GetUserName": 4, "GiveUp": 4}


def test_identity_depends_on_framing(spark):
    row = spark.range(1).select(identity("d", F.lit("ab"), F.lit("c")).alias("x"), identity("d", F.lit("a"), F.lit("bc")).alias("y"), identity("e", F.lit("ab"), F.lit("c")).alias("z")).first()
    assert len({row["x"], row["y"], row["z"]}) == 3


def test_components_and_paths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8), (0, 1)], "src long, dst long")
    got = {r["node"]: (r["component"], r["cyclic"]) for r in graph.components(edges).collect()}
    assert got == {1: (1, True), 2: (1, True), 3: (1, True), 4: (4, True), 5: (4, True), 6: (6, True), 7: (7, False), 8: (8, False), 0: (0, False)}
    paths = {r["node"]: r["path"] for r in graph.shortest_paths(edges, 1).collect()}
    assert paths == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 2, 3, 4], 5: [1, 2, 3, 4, 5]}
    assert {r["node"]: r["depth"] for r in graph.closure(edges, spark.createDataFrame([(3,)], "node long"), most=1).collect()} == {3: 0, 1: 1, 4: 1}


def test_votes(spark):
    candidates = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z")], "id int, source string")
    variants = spark.createDataFrame([("v1", ["a", "b"], "rejected", "r"), ("v2", ["a"], "verified", None)], "variant string, sources array<string>, status string, reason string")
    got = {r["id"]: (r["status"], r["variants"], r["reasons"]) for r in relations.vote(relations.candidate_variants(candidates, variants)).collect()}
    assert got == {1: ("verified", 2, "r"), 2: ("rejected", 1, "r"), 3: ("unresolved", 0, "ownership.not_found")}


def test_budget_takes_later_smaller_sections(spark):
    df = spark.createDataFrame([("g", 1, 4), ("g", 2, 9), ("g", 3, 1), ("h", 1, 99)], "g string, p int, n int")
    got = {r["g"]: (r["included"], r["omitted"], r["used"]) for r in bounded.whole_sections(df, ["g"], ["p"], "n", 5).collect()}
    assert got == {"g": (2, 1, 5), "h": (0, 1, 0)}


def test_bounds(spark):
    df = spark.range(5)
    assert [r["total"] for r in bounded.limited(df, [F.col("id")], 2).collect()] == [5, 5]
    assert [(r["id"], r["total"]) for r in bounded.early_stop(df, [F.col("id")], 3).collect()] == [(0, None), (1, None), (2, None)]
    assert bounded.early_stop(df, [F.col("id")], 9).first()["total"] == 5
    assert bounded.limited(df.where("id < 0"), [F.col("id")], 2).collect() == []
    with pytest.raises(ValueError):
        bounded.project(df, ["id"], ["id"], ["x"])


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "find me\nand me", "en", "s"), (2, "nothing", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "in"))
    q = stream_search(spark, str(tmp_path / "in"), "me").writeStream.format("memory").queryName("found").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["path"], r["line"], r["column"]) for r in spark.table("found").collect()) == [("s/en/1.txt", 1, 6), ("s/en/1.txt", 2, 5)]
