"""Fill-in-the-middle against brute force, rank and select against plain counting."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import fill_middle

TEXTS = [
    (1, "one\ntwo\nthree"), (2, None), (3, ""), (4, "\n"), (5, "\n\n\nx\n"), (6, "no line end"), (7, "has <P> in it\nand more"), (8, "almost <\nP>\n<S\n>"), (9, "é😀\nü\n漢字\n"), (None, "a\nb\nc\nd"), (9, "é😀\nü\n漢字\n"),
    (10, "a\r\nb\rc\n"), (11, "<\n<P\n<<S\n" * 7), (12, "x\n" * 40_000), (13, "y" * 5_000_000 + "\n" + "z\n" * 1000),
]


def brute(key, text, seed=7, rate=100, spm=50, unit="line"):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fill_middle.MARKERS) or h[2] % 100 >= rate:
        return key, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return key, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("params", [{}, {"seed": 3, "rate": 60, "spm": 0}, {"seed": 5, "spm": 100, "unit": "character"}])
def test_cuts(spark, params):
    rows = TEXTS if params.get("unit") != "character" else TEXTS[:-1]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, Form string, `a.b` int")
    out = fill_middle.fill_in_middle(df, **params)
    assert out.columns == ["doc_id", "text", "a.b", "fim_text", "form", "n", "prefix_chars", "middle_chars"]
    got = out.withColumn("again", fill_middle.restored()).collect()
    want = [brute(d, t, **params) for d, t in rows]
    key = lambda r: (str(r[0]), r[5])
    assert sorted([(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["fim_text"]) for r in got], key=key) == sorted(want, key=key)
    assert all(r["again"] == (r["text"] or "") for r in got)


def test_empty_tables_and_wrong_parameters(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.fill_in_middle(df).collect() == []
    for bad in ({"unit": "word"}, {"markers": ("<P>", "<P>", "<M>")}, {"markers": ("aa", "<S>", "<M>")}):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(df, **bad)


def test_other_markers(spark):
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    df = spark.createDataFrame([(i, "a|\n<|\n" * i + "<P>\n") for i in range(30)], "doc_id long, text string")
    got = fill_middle.fill_in_middle(df, markers=marks).withColumn("again", fill_middle.restored(markers=marks)).collect()
    assert all(r["again"] == r["text"] and r["form"] != "plain" for r in got)


def test_rank_and_select():
    r = np.random.default_rng(1)
    for n, share in ((0, 0.5), (1, 1.0), (512, 1.0), (513, 0.01), (4000, 0.3), (70_000, 0.0005)):
        flags = r.random(n) < share
        bits = fill_middle.Bits(flags)
        places = np.arange(n + 1)
        assert (bits.rank(places) == np.append(0, np.cumsum(flags))[places]).all()
        ones = np.flatnonzero(flags)
        assert (bits.select(np.arange(1, len(ones) + 1)) == ones).all()


def test_long_texts_keep_their_bytes(spark):
    df = spark.createDataFrame([TEXTS[-1]], "doc_id long, text string")
    r = fill_middle.fill_in_middle(df).select(F.sha2(fill_middle.restored(), 256)).first()[0]
    assert r == hashlib.sha256(TEXTS[-1][1].encode()).hexdigest()
