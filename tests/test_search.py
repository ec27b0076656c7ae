"""Whole-text search, decoding and results with their evidence, on small inputs."""

import re
import time

import pytest
import regex
from pyspark.sql import functions as F

from quernel.operators import bounded, evidence, symbols, text
from quernel.sources.tables import decoded


def found(df, pattern, **more):
    return sorted((r["path"], r["line"], r["column"], r["match"]) for r in text.search_regex(df, pattern, **more).collect())


def test_matches_cross_lines(spark):
    df = spark.createDataFrame([("a", "foo\nbar"), ("b", "x\r\nfoo\r\nbar foo\rq"), ("c", None), ("d", "")], "path string, text string")
    assert found(df, r"foo\nbar") == [("a", 1, 1, "foo\nbar")]
    assert found(df, r"foo\s") == [("a", 1, 1, "foo\n"), ("b", 2, 1, "foo\r"), ("b", 3, 5, "foo\r")]
    assert found(df, r"\n") == [("a", 1, 4, "\n"), ("b", 2, 1, "\n"), ("b", 3, 1, "\n")]  # a lone carriage return before a match ends a line


def test_anchors_go_by_the_text(spark):
    df = spark.createDataFrame([("a", "x\nfoo"), ("b", "foo\nfoo"), ("c", "foo(\nfoo")], "path string, text string")
    assert found(df, r"\Afoo") == [("b", 1, 1, "foo"), ("c", 1, 1, "foo")] and found(df, "^foo") == found(df, r"\Afoo")
    assert found(df, "(?m)^foo") == [("a", 2, 1, "foo"), ("b", 1, 1, "foo"), ("b", 2, 1, "foo"), ("c", 1, 1, "foo"), ("c", 2, 1, "foo")]
    assert found(df, r"foo(?!\s)") == [("a", 2, 1, "foo"), ("b", 2, 1, "foo"), ("c", 1, 1, "foo"), ("c", 2, 1, "foo")]
    assert found(df, "FOO$", case_sensitive=False) == [("a", 2, 1, "foo"), ("b", 2, 1, "foo"), ("c", 2, 1, "foo")] and found(df, "FOO") == []


def test_places_of_many_matches(spark):
    """Against Python's places, with wide characters, over several blocks of the running sums."""
    words = ["ab", "😀", "c", "\n", "é", "xx", "\r\n"]
    body = "".join(words[(i * i + 3 * i) % 7] for i in range(3000))
    df = spark.createDataFrame([("p", body)], "path string, text string")
    want = []
    for m in re.finditer("c|xx", body):
        before = re.split("\r\n|\n|\r", body[: m.start()])
        want.append(("p", len(before), len(before[-1].encode("utf-16-le")) // 2 + 1, m[0]))
    assert found(df, "c|xx") == sorted(want) and len(want) > 600


def test_a_text_that_holds_marks(spark):
    df = spark.createDataFrame([("a", "﷐﷑ab﷐ab")], "path string, text string")
    assert found(df, "ab") == [("a", 1, 3, "ab"), ("a", 1, 6, "ab")]


def test_required_literals():
    cases = {r"ab(cd)?efg+": "ab", r"foo\s+barbaz": "barbaz", "(?i)abc": None, "a|b": None, r"\p{L}x": None, "(?:abc)+d": "abc", "x{0,3}yz": "yz", "": None, "a(?=bcd)": "a", "[a]bc": "abc"}
    assert {p: text.required_literal(p) for p in cases} == cases


def test_patterns_that_may_hang():
    yes = [r"(a|a)+c", r"(a+)+b", r"(ab|c)*", r"(x+x+)+y", r"(a)\1", r"(?:a{2,})+", "((a)*b)*"]
    no = [r"[a-z]+@[a-z]+", r"(?:ab)+", r"\Q(a+)+\E", r"[(+)+]+", "a|b", "(a+)", r"\(a+\)+"]
    assert all(map(text.may_hang, yes)) and not any(map(text.may_hang, no))


def test_ordinal_folding(spark):
    df = spark.createDataFrame([("a", "\u0131 \u017f \u212a i s k K \u00c9 \u00e9 \u00b5 \u039c")], "path string, text string")
    hits = lambda q: [r["match"] for r in text.search_literal(df, q).collect()]
    assert (hits("I"), hits("S"), hits("K"), hits("\u00e9"), hits("\u03bc")) == (["i"], ["s"], ["k", "K"], ["\u00c9", "\u00e9"], ["\u00b5", "\u039c"])


def test_words_of_names_in_any_letters(spark):
    names = ["GrößeÄndern", "HTTPServer2Go", "snake_case", "XMLHttp", "a", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(symbols.tokens(F.col("n"))).collect()
    assert [r[0] for r in got] == [["größe", "ändern"], ["http", "server2go"], ["snake", "case"], ["xml", "http"], ["a"], []]


def test_decoding(spark):
    rows = [
        ("lone", b"\xff\xfe\x00\xd8", "undecodable"), ("low", b"\xfe\xff\xdc\x00\x00a", "undecodable"), ("swapped", b"\xff\xfe\x00\xdc\x00\xd8", "undecodable"), ("half", b"\xff\xfea", "undecodable"),
        ("pair", b"\xff\xfe" + "a😀b".encode("utf-16-le"), "success"), ("be", b"\xfe\xff" + "퟿😀".encode("utf-16-be"), "success"), ("mark", b"\xff\xfe", "success"),
        ("bad", b"\xc3(", "undecodable"), ("nul", b"a\0b", "binary"), ("wide", b"\xff\xfe\x00\x00", "unsupported"), ("none", None, "unreadable"), ("empty", b"", "success"),
    ]
    got = {r["path"]: (r["status"], r["text"]) for r in decoded(spark.createDataFrame([r[:2] for r in rows], "path string, content binary")).collect()}
    assert {p: s for p, (s, _) in got.items()} == {r[0]: r[2] for r in rows}
    assert (got["pair"][1], got["be"][1], got["mark"][1], got["empty"][1]) == ("a😀b", "퟿😀", "", "")


# -- evidence ---------------------------------------------------------------------------------


def scans(df) -> int:
    return str(df._jdf.queryExecution().executedPlan()).count("FileScan")


def test_results_read_their_input_once(spark, tmp_path):
    spark.createDataFrame([(f"f{i:03}", "x y x" if i % 3 else "y") for i in range(200)], "path string, text string").repartition(5).write.parquet(str(tmp_path / "t"))
    files = spark.read.parquet(str(tmp_path / "t"))
    for df in (bounded.limited(files, [F.col("path")], 3), bounded.enveloped(files, [F.col("path")], 3, "more"), text.first_matches(files, "x", 5), text.search_evidence(files, "x", 5)):
        assert scans(df) == 1
    assert [(r["path"], r["total"], r["truncated"]) for r in bounded.limited(files, [F.col("path")], 3).collect()] == [(f"f{i:03}", 200, True) for i in range(3)]


def test_one_pass_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 37).select((F.col("id") * 7919 % 5003).alias("k"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id")).alias("v"))
    r = evidence.one_pass(df, [F.desc("k")], 10, {"odd": F.col("k") % 2 == 1, "none": F.col("v").isNull()}, F.col("v").isNotNull()).first()
    rows = sorted(((i * 7919 % 5003, i) for i in range(5000)), reverse=True)
    assert [x["k"] for x in r["rows"]] == [k for k, i in rows if i % 5][:10]
    assert (r["total"], r["odd"], r["none"]) == (4000, sum(k % 2 for k, _ in rows), 1000)
    empty = evidence.one_pass(df.where("k < 0"), [F.col("k")], 10, {"odd": F.lit(True)}).first()
    assert (empty["rows"], empty["total"], empty["odd"]) == ([], 0, 0)
    none = evidence.one_pass(df, [F.col("k")], 0).first()
    assert (none["rows"], none["total"]) == ([], 5000)


@pytest.mark.parametrize(
    "values,what",
    [
        (("partial", 3, 1, 2, 0, 0, None), "needs a reason"), (("complete", 3, 3, 0, 0, 0, "why"), "only partial"), (("complete", 3, 2, 1, 0, 0, None), "leaves nothing"),
        (("complete", 3, 2, 0, 0, 1, None), "fails nowhere"), (("not-applicable", 0, None, None, None, None, None), "no counts"), (("partial", 3, 4, None, None, None, "x"), "exceed"),
        (("complete", 4, 3, 0, 0, 0, None), "don't make up"), (("complete", -1, None, None, None, None, None), "negative"), (("whole", None, None, None, None, None, None), "unknown"),
        (("partial", 3, 1, 2, 0, 0, "limit"), None), (("complete", 3, 2, 0, 1, 0, None), None), (("not-applicable", None, None, None, None, None, None), None), (("complete", None, None, None, None, None, None), None),
    ],
)
def test_coverage_rules(spark, values, what):
    names = ["level", "considered", *evidence.PARTS, "partial_reason"]
    schema = ", ".join(f"{n} {'string' if n in ('level', 'partial_reason') else 'long'}" for n in names)
    c = F.struct(*names)
    row = spark.createDataFrame([values], schema)
    told = row.select(evidence.violation(c)).first()[0]
    assert told is None if what is None else what in told
    if what:
        with pytest.raises(Exception):
            row.select(evidence.checked(c)).collect()


def test_paths_come_in_the_order_of_utf16_units(spark):
    df = spark.createDataFrame([(p, "foo") for p in ("\ufffd", "\U00010000", "a", "\ue000")], "path string, text string")
    r = text.search_evidence(df, "foo", 9).first()
    assert [x["path"] for x in r["rows"]] == ["a", "\U00010000", "\ue000", "\ufffd"]
    assert {x["path"] for x in text.first_matches(df, "foo", 2).collect()} == {"a", "\U00010000"}


def test_search_evidence(spark):
    rows = [("a", "foo foo", None), ("b", None, "binary"), ("c", "foo", "success"), ("d", None, "success"), ("e", "bar", None), ("f", "a" * 40 + "b foo", None)]
    df = spark.createDataFrame(rows, "path string, text string, status string")
    r = text.search_evidence(df, "foo", 10).first()
    assert ([x["path"] for x in r["rows"]], r["total"], r["total_known"], r["truncated"]) == (["a", "a", "c", "f"], 4, True, False)
    c = r["evidence"]["coverage"]
    assert (c["level"], c["considered"], c["analyzed"], c["excluded"], c["failed"]) == ("partial", 6, 4, 1, 1)  # d could not be read
    r = text.search_evidence(df.where("path IN ('a', 'b', 'c')"), "foo", 3).first()
    assert r["evidence"]["coverage"]["level"] == "complete" and r["total_known"]
    r = text.search_evidence(df, "foo", 1).first()
    assert (len(r["rows"]), r["total"], r["evidence"]["coverage"]["partial_reason"]) == (1, None, evidence.LIMIT_REASON)
    r = text.search_evidence(df, "(a|aa)+$|o+", 9, regex=True, case_sensitive=True, deadline=0.2).first()
    assert (r["regular_expression_timeout"], r["evidence"]["coverage"]["partial_reason"], r["total_known"]) == (1, evidence.TIMEOUT_REASON, False)
    assert text.search_evidence(df.where("path = 'z'"), "foo", 3).first()["evidence"]["coverage"]["considered"] == 0


def test_few_matches_are_placed_as_many_are(spark, monkeypatch):
    texts = ["", "a\nthe b\r\nthe c", "the", "\nthe\n\nthe", "😀the the\n😀 the", "é the é\n  the", "the " * 40, None, "x" * 300 + " the " + "y" * 300 + "\nthe", "the\rthe", "日本the\n the. \n"]
    files = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    told = {}
    for few in (0, 16):
        monkeypatch.setattr(text, "FEW", few)
        told[few] = [sorted(text.located(files, p, most).select("path", "found").collect()) for p in ("the", "(?m)^") for most in (None, 0, 1, 5)]
    assert told[0] == told[16]


def test_a_try_that_exceeds_its_deadline_is_made_once_for_texts_that_end_alike(spark):
    texts = [(f"f{i}", f"w{i} 2024 " * i + "\n" + "a" * 60 + "!") for i in range(60)] + [("plain", "2024 aa")]
    df = spark.createDataFrame(texts, "path string, text string").coalesce(1)
    began = time.monotonic()
    got = {r["path"]: (r["status"], len(r["found"])) for r in text.regex_files(df, "(?:a|aa)+$|[0-9]{4,}", deadline=0.4).collect()}
    assert time.monotonic() - began < 12  # 24 s of deadlines
    assert got == {**{p: ("regular_expression_timeout", 0) for p, _ in texts[:-1]}, "plain": ("analyzed", 2)}


@pytest.mark.parametrize("pattern", ["(?:a|aa)+$|xy[a!]+|[0-9]", "(?<!xy)(?:a|aa)+$|[0-9]", "(?:a|aa)+$|x?[0-9]*"])
def test_ends_alike_are_known_only_where_the_search_comes_to_them(pattern):
    finder, ends, hard = regex.compile(pattern), re.compile(text.TERMINATOR), "a" * 60 + "!"
    given = ["1 zy" + hard, "2 zy" + hard, "3 xy" + hard, "xy" + hard, "y" + hard, hard, hard, "4 zy" + hard + "!", "5 zy" + hard[1:], "6 aa", "zy" + hard]
    for most in (None, 0, 1):
        known = None if text.LOOKS_BACK.search(pattern) else text.Endless(finder, 0.2, most)
        for t in given:
            alone = text._outcome(finder, ends, t, 0.2, most)
            assert text._outcome(finder, ends, t, 0.2, most, known) == alone, (t, most)


def test_ends_are_looked_for_only_while_they_are_met_again():
    tries = []

    class Finder:
        def match(self, t, at, timeout):
            tries.append(at)
            raise TimeoutError

    known = text.Endless(Finder(), 0.2, None)
    for i in range(20):
        known.learn(f"b{i}", 0)
    assert len(tries) == len(known.tails) == known.SPARE
