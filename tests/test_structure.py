"""Snapshots, listed worktrees, project graphs, nesting and targets on small inputs."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quernel.functions.identity import symbol_id
from quernel.operators import graph, nesting, ranges, snapshots, targets
from quernel.sources import listing


def entries(spark, rows):
    df = spark.createDataFrame(rows, "kind string, path string, content string")
    return snapshots.keyed(df.select(*snapshots.entries(F.col("kind"), F.col("path"), F.col("content"))))


def test_snapshot_identities(spark):
    files = lambda rows: spark.createDataFrame(rows, "kind string, path string, content binary")
    values = lambda rows: spark.createDataFrame(rows, "kind string, scope string, name string, value string")
    told = lambda *a: tuple(snapshots.workspace_snapshot(*a).first())
    base = [("source", "a", b"1"), ("source", "b", None), ("project", "a", b"1")]
    one = told(files(base))
    assert one == told(files(base[::-1]).repartition(3)) and one[1] == 3
    others = {told(files(base[:2])), told(files([*base[:2], ("project", "a", b"2")])), told(files(base), values([("p", None, "n", "v")])), told(files(base), values([("p", "", "n", "v")])), told(files(base), None, ("solution", "a")), one}
    assert len(others) == 6
    for broken in ((files([*base, ("source", "a", b"9")]),), (files(base), values([("p", None, "n", "v"), ("p", None, "n", "w")]))):
        with pytest.raises(Exception):
            told(*broken)
    assert told(files([]))[1] == 0
    assert snapshots.depth_for(100) == 1 and snapshots.depth_for(256**2 + 1) == 2


def test_snapshot_difference(spark, tmp_path):
    old = [("f", f"p{i}", str(i)) for i in range(300)]
    new = [("f", f"p{i}", "x" if i in (7, 200) else str(i)) for i in range(5, 300)] + [("g", "p7", "new")]
    want = sorted([("f", f"p{i}", "removed") for i in range(5)] + [("f", "p7", "changed"), ("f", "p200", "changed"), ("g", "p7", "added")])
    a, b = entries(spark, old), entries(spark, new)
    for depth in (1, 2):
        assert sorted((r["kind"], r["name"], r["change"]) for r in snapshots.difference(a, b, depth).collect()) == want
    nodes = snapshots.unequal_nodes(snapshots.tree(a, 2), snapshots.tree(b, 2), 2).count()
    assert 1 <= nodes <= len(want)
    assert snapshots.difference(a, a, 2).count() == 0
    snapshots.write(a, str(tmp_path / "a"), 2)
    snapshots.write(b, str(tmp_path / "b"), 2)
    snapshots.write(b, str(tmp_path / "c"), 1)
    got = snapshots.written_difference(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert sorted((r["kind"], r["name"], r["change"]) for r in got.collect()) == want
    with pytest.raises(ValueError):
        snapshots.written_difference(spark, str(tmp_path / "a"), str(tmp_path / "c"))


def test_listing(spark, tmp_path):
    root = tmp_path / "tree"
    for path, body in {
        ".git/info/exclude": "secret\n", ".git/HEAD": "x", ".gitignore": "*.log\n!keep.log\nout/\n/top.txt\nsp\\ ace\n", "a.cs": "12345", "x.log": "", "keep.log": "", "top.txt": "", "secret": "", "sp ace": "",
        "src/top.txt": "", "src/out/b.cs": "", "src/deep/er/still/c.cs": "", "src/deep/.gitignore": "c.cs\n!er/still/c.cs\nstar\\*\n", "src/deep/star*": "", "src/deep/starx": "", "src/nested/.git": "gitdir: elsewhere", "lib/d.cs": "",
    }.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(body)
    (tmp_path / "outside.txt").write_text("o")
    os.symlink(root / "lib/d.cs", root / "src/link.cs")
    os.symlink(root / "lib", root / "linked")
    os.symlink(tmp_path / "outside.txt", root / "out.txt")
    os.symlink(root / "nowhere", root / "broken")
    want = {".gitignore", "a.cs", "keep.log", "src/top.txt", "src/deep/.gitignore", "src/deep/er/still/c.cs", "src/deep/starx", "lib/d.cs"}
    for levels in (1, 2, 5):
        assert {r["path"] for r in listing.listed(spark, str(root), levels=levels).collect()} == want
    assert {r["path"] for r in listing.listed(spark, str(root), scopes=["src/deep", "a.cs"]).collect()} == {"a.cs", "src/deep/.gitignore", "src/deep/er/still/c.cs", "src/deep/starx"}
    far = listing.listed(spark, str(root), external=["../outside.txt"]).where("external").collect()
    assert [(r["path"], r["length"]) for r in far] == [("../outside.txt", 1)]
    assert bytes(listing.listed(spark, str(root), content=True).where("path = 'a.cs'").first()["content"]) == b"12345"
    reader = listing.Reader({"path": str(root), "scopes": '["src/deep/er"]', "levels": "3"})
    assert {p.path for p in reader.partitions()} == {"", "src", "src/deep", "src/deep/er"}  # others are never entered
    with pytest.raises(Exception):
        listing.listed(spark, str(tmp_path / "gone")).collect()


def test_pushed_paths(tmp_path):
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    for path in ("a/b/c.txt", "a/d.txt", "e/f.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    for pushed, want in ((EqualTo(("path",), "a/b/c.txt"), {"", "a", "a/b"}), (StringStartsWith(("path",), "e"), {"", "e"})):
        reader = listing.PushingReader({"path": str(tmp_path)})
        assert list(reader.pushFilters([pushed])) == [pushed]
        assert {p.path for p in reader.partitions()} == want


def test_running_over_ranges(spark):
    rows = [(random.Random(i).randint(0, 5), i, i % 7 or None) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    got = {r["b"]: (r["number"], r["s"], r["l"]) for r in ranges.running(df, [F.col("a"), F.col("b")], {"s": F.col("b")}, {"l": F.col("c")}).collect()}
    total, last = 0, None
    for n, (a, b, c) in enumerate(sorted(rows, key=lambda r: r[:2]), 1):
        total, last = total + b, c if c is not None else last
        assert got[b] == (n, total, last)


def brute_nesting(rows):
    out = {}
    for p, i, s, e in rows:  # an interval doesn't hold what is empty at its end
        around = [(t, -f, j) for q, j, t, f in rows if q == p and t <= s and f >= e and s < f and ((t, f) != (s, e) or j < i)]
        out[p, i] = (len(around), max(around)[2] if around else None)
    return out


def test_nesting(spark):
    rows, r = [], random.Random(4)

    def grow(path, a, b, depth):
        rows.append((path, len(rows), a, b))
        at = a
        while at < b and depth < 6 and r.random() < 0.8:
            s = r.randint(at, b)
            e = r.randint(s, b)
            grow(path, s, e, depth + 1) if s < e else rows.append((path, len(rows), s, e))
            at = e
    for path in "xyz":
        for k in range(4):
            grow(path, k * 100, k * 100 + 100, 0)
    df = spark.createDataFrame([*rows, ("x", None, 1, 2), (None, 5, 1, 2), ("x", 9999, 5, 3)], "path string, id long, start long, end long")
    nests = nesting.nested(df)
    want = brute_nesting(rows)
    assert {(x["path"], x["id"]): (x["depth"], x["parent"]) for x in nests.collect()} == want
    top = min(i for p, i, s, e in rows if p == "y")
    inside = {x["id"] for x in nesting.subtrees(nests, spark.createDataFrame([("y", top)], "path string, id long")).collect()}
    assert inside == {i for p, i, s, e in rows if p == "y" and s < 100}
    leaf = max(want, key=lambda k: want[k][0])
    chain = [x["id"] for x in nesting.enclosing(nests, spark.createDataFrame([leaf], "path string, id long")).orderBy("depth").collect()]
    assert len(chain) == want[leaf][0] + 1 and chain[-1] == leaf[1] and chain[-2] == want[leaf][1]
    with pytest.raises(Exception):
        nesting.nested(spark.createDataFrame([("x", 1, 0, 10), ("x", 2, 5, 15)], "path string, id long, start long, end long")).collect()


def edges(spark, *pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_levels_and_salvage(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 2), (3, 4), (1, 5), (6, 6))
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    assert {r["node"]: r["level"] for r in graph.levels(e, nodes).collect()} == {1: 2, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0}
    state = spark.createDataFrame([(1, "evaluated"), (2, "evaluated"), (3, "failed"), (4, "evaluated"), (6, "evaluated")], "node long, state string")
    out = graph.salvaged(state, e)
    assert {r["node"]: (r["usable"], r["broken_below"]) for r in out.collect()} == {1: ("partial", 1), 2: ("partial", 1), 3: ("failed", 0), 4: ("complete", 0), 5: ("failed", 0), 6: ("complete", 0)}
    assert tuple(graph.completeness(out).first()) == ("partial", 6, 2, 2, 2)
    assert graph.completeness(out.where("usable = 'complete'")).first()[0] == "complete" and graph.completeness(out.where("node < 0")).first()[0] == "failed"


def test_levels_write_little_more_than_the_edges(spark, monkeypatch):
    """A tree of 2,047 nodes has 10 levels; what is written doesn't go with edges times levels, nor with nodes times rounds."""
    written, cut = [], graph.cut

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    tree = spark.range(2, 2048).select(F.col("id").alias("src"), F.expr("id div 2").alias("dst"))
    got = {r["node"]: r["level"] for r in graph.levels(tree).collect()}
    assert got == {n: n.bit_length() - 1 for n in range(1, 2048)}
    assert sum(written) < 12 * 2047


def test_path_between(spark):
    e = edges(spark, (1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 6), (6, 1), (9, 9))
    told = lambda a, b, **k: tuple(graph.path_between(e, a, b, **k).first())
    assert told(1, 6) [:3] == ("found", 4, [1, 2, 4, 5, 6]) and told(4, 2)[:3] == ("found", 4, [4, 5, 6, 1, 2]) and told(1, 1)[:3] == ("found", 0, [1])
    assert told(1, 9)[:3] == ("none", None, None) and told(9, 1)[0] == "none" and told(1, 6, most=2)[:3] == ("open", None, None)
    long = edges(spark, *[(i, i + 1) for i in range(20)])
    r = graph.path_between(long, 0, 20).first()
    assert (r["length"], r["rounds"]) == (20, 20)


def test_project_instances(spark):
    maps = "src string, dst string, adds map<string,string>, removes array<string>"
    refs = spark.createDataFrame([("a", "b", {"TF": "net8"}, []), ("b", "c", {}, ["tf"]), ("c", "a", {"Tf": "net9"}, ["Config"]), ("c", "c", {}, [])], maps)
    roots = spark.createDataFrame([("a", {"Config": "Debug"}), ("a", {"CONFIG": "Debug"})], "path string, properties map<string,string>")
    found, links = graph.project_instances(roots, refs)
    got = sorted((r["path"], sorted(r["properties"].items())) for r in found.collect())
    assert got == [("a", [("config", "Debug")]), ("a", [("tf", "net9")]), ("b", [("config", "Debug"), ("tf", "net8")]), ("b", [("tf", "net8")]), ("c", []), ("c", [("config", "Debug")])]
    assert links.distinct().count() == 8
    with pytest.raises(RuntimeError):
        graph.project_instances(roots, refs, most=2)


def test_target_batch(spark):
    d = [(1, "HttpClient", "Net.HttpClient"), (2, "HttpClientHandler", "Net.HttpClientHandler"), (3, "ClientHttp", "Web.ClientHttp"), (4, "Grid", "Web.Grid"), (5, "Grid", "Old.Grid"), (6, "MegaGridView", "Web.MegaGridView")]
    df = spark.createDataFrame(d, "id long, name string, qualified string").withColumns({"stable": F.sha2("qualified", 256), "location": F.sha2(F.col("id").cast("string"), 256), "source": F.concat(F.lit("s"), F.col("id").cast("string")), "owner": F.lit("o")})
    variants = df.select(F.lit("v").alias("variant"), F.lit(None).cast("string").alias("project"), F.array("source").alias("sources"), F.lit("resolved").alias("status"), F.col("qualified").alias("symbol"), F.lit(None).cast("string").alias("reason"))
    ids = {r["id"]: r["s"] for r in df.select("id", symbol_id(F.col("name"), F.col("stable"), F.col("location")).alias("s")).collect()}
    gone = df.where("id = 4").select(symbol_id(F.col("name"), F.sha2(F.lit("other"), 256), F.col("location"))).first()[0]
    asked = ["Net.HttpClient", "HttpClient", "httpclient", "HttpC", "Client Http", "HC", "Grid", "egagr", "iew", "zzz", "", "file/q1:x", "symbol/q9:x", ids[1], gone, None, "e"]
    out, matches = targets.resolve_batch(spark.createDataFrame([(a,) for a in asked], "target string"), df, variants)
    got = {r["target"]: (r["status"], r["candidates"]) for r in out.collect()}
    want = {
        "Net.HttpClient": ("resolved", 1), "HttpClient": ("resolved", 1), "httpclient": ("resolved", 1), "HttpC": ("ambiguous", 2), "Client Http": ("ambiguous", 3), "HC": ("ambiguous", 2), "Grid": ("ambiguous", 2),
        "egagr": ("resolved", 1), "iew": ("resolved", 1), "zzz": ("not_found", 0), "": ("unsupported", 0), "file/q1:x": ("unsupported", 0), "symbol/q9:x": ("unsupported", 0), ids[1]: ("resolved", 1), gone: ("stale", 0), "e": ("ambiguous", 4),
    }
    assert got == want
    few = targets.replaced(out, spark.createDataFrame([(a,) for a in asked], "target string"), df).orderBy("place").collect()
    assert [(r["target"], r["id"], r["total"]) for r in few] == [(gone, 4, 2), (gone, 5, 2)]


def test_a_table_that_is_a_folder_is_listed_once(spark, tmp_path):
    from quernel.plans import workspace

    for name in ("a.parquet", "b.parquet/part-0.parquet", "b.parquet/part-1.parquet"):
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_bytes(b"x")
    got = [tuple(r) for r in workspace.worktree_listed(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("a.parquet", False), ("b.parquet", False)]


def test_holders_are_met_by_blocks_of_openings_not_by_file(spark):
    rows = [("hot.cs", 10 * k + j, 100 * k + 10 * j, 100 * (k + 1) - 10 * j) for k in range(60) for j in range(3)]
    nests = nesting.nested(spark.createDataFrame(rows, "path string, id long, start long, end long"))
    wanted = spark.createDataFrame([("hot.cs", 10 * k + 1) for k in range(0, 60, 7)], "path string, id long")
    below, above = nesting.subtrees(nests, wanted), nesting.enclosing(nests, wanted)
    ids = [10 * k for k in range(0, 60, 7)]
    assert sorted((r.root, r.id) for r in below.collect()) == sorted((k + 1, k + j) for k in ids for j in (1, 2))
    assert sorted((r.of, r.id) for r in above.collect()) == sorted((k + 1, k + j) for k in ids for j in (0, 1))
    for met in (below, above):
        assert not re.search(r"Join \[path#\d+\], \[path#\d+\], Inner", met._jdf.queryExecution().executedPlan().toString())
