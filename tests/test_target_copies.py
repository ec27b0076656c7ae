"""Many declarations of the same names: matched once, told all, never broadcast."""

import contextlib
import io
import random

from pyspark.sql import functions as F

from quernel.functions.identity import symbol_id
from quernel.operators import semantics, targets


def test_copies_are_matched_once_and_told_all(spark, monkeypatch):
    kept, cut = [], targets.cut

    def counted(df):
        out = cut(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(targets, "cut", counted)
    d = spark.range(300).select("id", F.lit("HttpClient").alias("name"), F.when(F.col("id") % 3 > 0, "Net.HttpClient").alias("qualified"))
    asked = spark.createDataFrame([("HttpClient",), ("httpc",), ("zz",)], "target string")
    got = targets.ranked_matches(asked, d).groupBy("target", "rank").agg(F.countDistinct("id").alias("n"), F.count("*").alias("rows"))
    assert {tuple(r) for r in got.collect()} == {("HttpClient", 1, 300, 300), ("httpc", 3, 300, 300)}
    assert max(kept) <= 3


def test_identities_broadcast_no_declarations(spark):
    # one partition of few bytes, as a compressed table
    d = spark.range(0, 20, 1, 1).select("id", F.lit("A").alias("name"), F.sha2(F.col("id").cast("string"), 256).alias("stable"), F.lit("x").alias("location"))
    asked = targets.forms(d.select(symbol_id(F.col("name"), F.col("stable"), F.sha2("location", 256)).alias("target")))
    out = targets.id_matches(asked.where("form = 'id'"), d)
    with contextlib.redirect_stdout(io.StringIO()) as told:
        out.explain()
    joins = [x for x in told.getvalue().splitlines() if "Join" in x and "stable" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
    assert {(r["id"], r["rank"]) for r in out.collect()} == {(i, 1) for i in range(20)}


def _told(spark, declarations, variants, asked):
    d = spark.createDataFrame(declarations, "id long, name string, qualified string, stable string, location string, source string, owner string")
    v = spark.createDataFrame(variants, "variant string, project string, sources array<string>, status string, symbol string, reason string")
    return targets.resolve_batch(spark.createDataFrame([(a,) for a in asked], "target string"), d, v)


def test_a_batch_is_told_by_classes_of_declarations(spark, monkeypatch):
    kept = []
    for module in (targets, semantics):

        def counted(df, cut=module.cut):
            out = cut(df)
            kept.append(out.count())
            return out

        monkeypatch.setattr(module, "cut", counted)
    monkeypatch.setattr(targets, "FEW_NAMES", 0)  # declarations of all names
    a, b, far = "a" * 64, "b" * 64, [f"{k:064x}" for k in range(20)]
    declarations = [(i, "Grid", "Web.Grid", a if i % 2 else b, "e" * 63 + "f", "s" if i % 3 else "t", "o") for i in range(400)]
    variants = [("v", "o", ["s"], "resolved", "x", None), ("v", "o", ["t"], "unresolved", None, "no")]
    moved = [f"symbol/q2:R3JpZA:{a}:{f}" for f in far]
    out, matches = _told(spark, declarations, variants, ["Grid", "gri", *moved])
    got = {r["target"]: (r["status"], r["candidates"], r["groups"]) for r in out.collect()}
    assert got == {"Grid": ("resolved", 400, 1), "gri": ("resolved", 400, 1), **{m: ("resolved", 200, 1) for m in moved}}
    assert max(kept) <= 200  # not the 4,800 pairs of a target and a declaration
    assert matches.count() == 4800


def test_classes_of_declarations_tell_what_single_ones_do(spark):
    draw = random.Random(5)
    stables, symbols = ["a" * 64, "b" * 64, "c" * 64], ["x", "y", "z", None]
    declarations = [(i, n := draw.choice("PQ"), f"{draw.choice('MN')}.{n}", draw.choice(stables), f"{draw.choice([i, 0]):064x}", f"s{draw.randrange(12)}", f"o{i % 2}") for i in range(30)]
    variants = [(draw.choice("uvw"), f"o{draw.randrange(2)}", [f"s{draw.randrange(12)}" for _ in range(2)], draw.choice(["resolved", "resolved", "unresolved", "failed"]), draw.choice(symbols), None) for _ in range(18)]
    ids = [f"symbol/q2:{b64}:{s}:{k:064x}" for b64 in ("UA", "UQ", "Ug") for s in stables for k in (0, 3, 7, 99)]
    out, matches = _told(spark, declarations, variants, ["P", "q", "M.P", "N.Q", "R", *ids])
    found = {}
    for r in matches.collect():
        found.setdefault(r["target"], []).append(r["id"])
    pairs = {d[0]: {(v[0], v[4]) for v in variants if v[3] == "resolved" and d[5] in v[2]} for d in declarations}
    for r in out.collect():
        parts = []
        for i in found.get(r["target"], []):
            if pairs[i]:
                links = {p for p in pairs[i] if p[1] is not None}
                met = [p for p in parts if p & links]
                parts = [p for p in parts if not p & links] + [links.union(*met)]
        assert (r["candidates"], r["groups"]) == (len(found.get(r["target"], [])), len(parts)), r["target"]
    assert any(r["groups"] > 1 for r in out.collect()) and any(len(x) == 1 for x in found.values())
