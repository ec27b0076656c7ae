"""Operators and pipeline stages on tables whose columns are named like what the operators use."""

import pytest

from quernel.llm import jaccard, licenses, line_dedup
from quernel.llm.common import aside

TEXT = "a fine day by the sea with friends and food for all of us here today\nMenu\nLicensed under the MIT License"
ROWS = [(1, TEXT), (2, TEXT), (3, None), (4, ""), (None, "Menu\nanother text"), (4, "")]
EXTRA = "near string, `a.b` int, __gone int, key string, h long, n long, d long, license string, Lines_Removed long, score double, predicted int, component string, `x y` string, size long"
VALUES = ("near", 7, 8, "k", 1, 2, 3, "own", 4, 0.5, 1, "c", "z", 9)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *VALUES) for r in ROWS], f"doc_id long, Text string, {EXTRA}").repartition(2)


def test_aside(spark, docs):
    slim, names = aside(docs, ["doc_id", "text"], ("score",))
    assert slim.columns[:3] == ["doc_id", "text", "__c2"] and "score" not in names and slim.toDF(*names).columns == names
    with pytest.raises(ValueError):
        aside(docs, ["nothing"])


def test_line_dedup(docs):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "Lines_Removed"] + ["lines_removed"]
    rows = out.collect()
    assert sorted((str(r["doc_id"]), r["Text"], r["lines_removed"]) for r in rows if r["Text"]) == [("1", TEXT, 0), ("None", "another text", 1)]
    assert {(r["near"], r["a.b"], r["__gone"], r["x y"]) for r in rows} == {("near", 7, 8, "z")}


def test_one_of_each(docs):
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["a.b"], r["component"]) for r in out.collect()) == [("1", 7, "c"), ("3", 7, "c"), ("4", 7, "c"), ("None", 7, "c")]


def test_licenses(spark):
    files = spark.createDataFrame([("a/LICENSE", TEXT, "n", 1, "x"), ("a/b.c", "code", "n", 2, "y"), (None, TEXT, None, 3, "z"), ("a/LICENSE", TEXT, "n", 1, "x"), ("c", None, "n", 4, "w")], "path string, text string, near string, `a.b` int, license_from string")
    rows = licenses.scan_licenses(files).collect()
    assert rows[0].__fields__ == ["path", "text", "near", "a.b", "license", "score", "license_from", "license_dir", "license_lines"]
    got = sorted((str(r["path"]), r["a.b"], r["license"], r["license_from"]) for r in rows)
    mit = rows[0]["license"] or next(r["license"] for r in rows if r["license"])
    assert got == [("None", 3, mit, "own"), ("a/LICENSE", 1, mit, "own"), ("a/LICENSE", 1, mit, "own"), ("a/b.c", 2, mit, "inherited"), ("c", 4, None, "none")]


def test_stages(spark, docs, tmp_path):
    import corpus_pipeline as pipeline

    spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = docs.withColumnRenamed("Text", "text")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns, name
        assert {(r["near"], r["a.b"], r["score"], r["predicted"]) for r in out.collect()} == {("near", 7, 0.5, 1)}, name
