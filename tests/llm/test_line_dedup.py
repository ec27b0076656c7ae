"""Line dedup against brute force over all pairs of lines."""

import random

from pyspark.sql import functions as F

from quernel.llm import line_dedup

SCHEMA = "doc_id long, text string, lines_removed string, source string"


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, least=20):
    order = sorted({(r[0] if r[0] is not None else 1 << 63, r[1] or "") for r in rows})
    seen, out = [], {}
    for d, text in order:
        kept, gone = [], 0
        for line in text.split("\n"):
            t = line.replace("\t", " ").strip(" ")
            # equal lines go at any length, near ones from ``least`` on
            if t in seen or (len(t) >= least and any(len(s) >= least and abs(len(t) - len(s)) < 2 and edits(t, s) <= 1 for s in seen)):
                gone += 1
            else:
                kept.append(line)
            if t:
                seen.append(t)
        out[d, text] = ("\n".join(kept), gone)
    return out


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "x", "s") for d, t in rows], SCHEMA)
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "source", "lines_removed"]
    want = brute(rows)
    found = sorted((r["doc_id"] if r["doc_id"] is not None else 1 << 63, r["text"] or "", r["lines_removed"]) for r in got.collect())
    assert found == sorted((d if d is not None else 1 << 63, *want[d if d is not None else 1 << 63, t or ""]) for d, t in rows)


def test_random_edits(spark):
    r = random.Random(5)
    letters = "abcdeé ß"
    base = ["".join(r.choice(letters) for _ in range(r.choice([19, 20, 21, 31, 32, 33, 63, 64, 65, 127, 128, 150]))).strip() or "x" for _ in range(25)]

    def changed(s):
        k = r.randrange(len(s))
        return r.choice([s[:k] + s[k + 1 :], s[:k] + r.choice(letters) + s[k:], s[:k] + r.choice(letters) + s[k + 1 :], s])

    rows = []
    for d in range(40):
        lines = [changed(r.choice(base)) if r.random() < 0.7 else changed(changed(r.choice(base))) for _ in range(r.randrange(1, 7))]
        rows.append((r.randrange(1000), "\n".join(lines)))
    check(spark, rows)


def test_edges(spark):
    line = "a line of some length that repeats"
    rows = [
        (3, line), (1, f"  {line}\t\nshort\nshort"), (2, None), (5, ""), (None, line), (7, line[:-1]), (7, line[:-1]),
        (8, "\n".join([line + "x", line + "y", line[1:], "Z" + line[1:]])), (9, "short\n\n\nshort"), (10, "w " * 3000 + "end"), (11, "w " * 3000 + "emd"),
    ]
    check(spark, rows)


def test_many_versions_of_one_line(spark):
    rows = [(i, f"the token of this long template line is {i % 90:02d} and ends") for i in range(200)]
    check(spark, rows)


def test_empty_table_and_no_edits(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert line_dedup.dedup_lines(empty).collect() == []
    df = spark.createDataFrame([(1, "x" * 30, "", ""), (2, "x" * 31, "", ""), (3, "x" * 30, "", "")], SCHEMA)
    got = line_dedup.dedup_lines(df, max_edits=0).where(F.col("lines_removed") > 0).collect()
    assert [r["doc_id"] for r in got] == [3]


def test_short_lines_go_when_equal(spark):
    rows = [(1, "menu\n\nRead more\nbody one"), (2, "menu\n\nread more\nbody two"), (3, "  menu\t\nRead more"), (4, "menus")]
    check(spark, rows)


def test_hot_keys_meet_salted(spark):
    """A line in most documents, and a head that many different lines share."""
    from quernel.llm.common import meet

    rows = spark.range(5000).select((F.col("id") % 7 == 0).cast("long").alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = meet(rows, groups, ["k"], 5000, least=1000)
    assert got.columns == ["k", "id", "n", "top"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(groups, "k").collect()))
    common = "this line stands at the foot of every one of these pages"
    docs = spark.createDataFrame([(i, f"{common}\nthe same long beginning for all of these lines {i:08d}{i:08d}", "", "") for i in range(1500)], SCHEMA)
    got = line_dedup.dedup_lines(docs)
    assert sorted((r["doc_id"], r["lines_removed"]) for r in got.collect()) == [(i, int(i > 0)) for i in range(1500)]
