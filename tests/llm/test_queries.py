"""Every query and every pipeline stage on small tables with nulls, empty, long and repeated rows and clashing columns, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quernel.llm import catalog, merge_dropout
from tests.llm.test_edges import brute_groups, brute_top_k
from tests.llm.test_fill_middle import brute as brute_cuts
from tests.llm.test_line_dedup import brute
from tests.llm.test_minhash import brute as brute_shingles
from tests.llm.test_resample import brute as brute_draws

LONG = "word " * 9000 + "end"
TEXTS = [
    (1, "a fine day by the sea with friends and food for all of us here today\nMenu\nRead more"), (2, None), (3, ""), (None, "a text without a number\nMenu"),
    (5, "a fine day by the sea with friends and food for all of us here today\nMenu\nRead more"), (6, LONG), (6, LONG), (20, "İstanbul ß 😀 \t tabs\r\nand returns"),
    (40, "a fine day by the sea with friends and food for all of us here todaY\nMenu\nread more"), (7, "   \n \n"), (8, "you utter villain you villain go away villain"), (9, "x"),
]
OTHER = ["".join(chr(97 + (i * k + k * k) % 26) for k in range(1, 8)) for i in range(97)]
ROWS = TEXTS + [(100 + i, f"{'you villain ' if i % 3 == 0 else ''}plain words {OTHER[i]} of {OTHER[i * 7 % 97]} and {OTHER[i * 5 % 89]} more {'villain' if i % 3 == 0 else 'friend'}") for i in range(80)]
TARGET = ["plain words of a fine day by the sea", None]
VECTORS = [(0, [1.0, 2.0]), (20, [0.5, -1.0]), (20, [0.5, -1.0]), (3, None), (4, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, []), (5, [None, 2.0]), (7, [-3.0, 4.0]), (40, [1.0, 2.0])]
PAGES = [(1, "u", None), (2, None, ""), (None, "u", "<p>A line of text that stands alone.</p>"), (4, "u", "<nav><a href=x>Home</a></nav><article><h1>T</h1><p>The main text is here, and it goes on for a while &amp; more.</p></article>")]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    extra = "lang string, source string, n_chars long, score double, predicted string, `group` string, line string, n long, key string"
    docs = [(*r, "en", "src1", len(r[1] or ""), 0.5, "p", "g", "l", 1, None) for r in ROWS]
    spark.createDataFrame(docs, f"doc_id long, text string, {extra}").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(d, 1, int("villain" in (t or "")), "x") for d, t in ROWS if d is not None and d >= 100] + [(None, None, 1, "x"), (9, 0, None, "x")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, v, "c") for i, v in VECTORS], "vec_id long, embedding array<float>, score string").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(1, TARGET[0], "x"), (None, None, "x")], "item_id long, text string, score string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, text string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "embeddings", "pages", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


def rows(spark, name, folder):
    return catalog.queries()[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_empty_tables(spark, empty_dir, name):
    assert rows(spark, name, empty_dir) == []


def crc(doc, n):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % n


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_op1_base_scores(spark, sf_dir):
    split = lambda t: [w.lower() for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode()) if w] + [None]
    counts = Counter(w for d, t in ROWS if crc(d, 7) != 2 for w in split(t))
    n, v = sum(counts.values()), len(counts)
    got = rows(spark, "op1_maxent_scoring", sf_dir)
    want = [(d, crc(d, 7) == 2, len(split(t)), sum(w in counts for w in split(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(t)), 4)) for d, t in ROWS]
    same([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got], want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_op2_digests(spark, sf_dir):
    got = rows(spark, "op2_media_columns", sf_dir)
    want = []
    for d, t in ROWS:
        p = (t or "").encode()
        p += b" " * (-len(p) % 192 if p else 192)
        want.append((d, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    same([(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got], want)
    assert len({(r["media_sha256"], r["feature"]) for r in got}) == len({p for _, _, _, p, _ in want})
    for r in got:  # timed clips cover the file from its beginning to its end
        ends = [c["first_frame"] + c["frames"] for c in r["clips"]]
        assert [c["first_frame"] for c in r["clips"]] == [0, *ends[:-1]] and ends[-1] == r["payload_bytes"] // 192
        assert all(c["end_s"] > c["start_s"] for c in r["clips"])


def test_op3_decodes(spark, sf_dir):
    import public_tokenizers

    codec = merge_dropout.MergeCodec(public_tokenizers.path("piece_bpe_32k.model"))
    got = rows(spark, "op3_merge_dropout", sf_dir)
    same([(r["doc_id"], codec.decode(r["ids"])) for r in got], [(d, t or "") for d, t in ROWS])
    assert all(r["lossless"] and r["n_ids"] == len(r["ids"]) for r in got)


def test_op4_lines(spark, sf_dir):
    want = brute(ROWS)
    same([(r["doc_id"], r["text"], r["lines_removed"]) for r in rows(spark, "op4_line_dedup", sf_dir)], [(d, None, 0) if t is None else (d, *want[d if d is not None else 1 << 63, t]) for d, t in ROWS])


def test_op5_groups(spark, sf_dir):
    same([(r["doc_id"], r["class_id"], r["n_links"]) for r in rows(spark, "op5_ngram_jaccard", sf_dir)], brute_groups(ROWS))


def test_op6_pages(spark, sf_dir):
    got = rows(spark, "op6_html_extraction", sf_dir)
    same([(r["page_id"], r["url"]) for r in got], [p[:2] for p in PAGES])
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert [r["text"] for r in got if r["page_id"] == 4] == ["T\nThe main text is here, and it goes on for a while & more."]


def test_op7_scores(spark, sf_dir):
    got = rows(spark, "op7_toxicity", sf_dir)
    same([(r["doc_id"], r["held_out"]) for r in got], [(d, crc(d, 5) == 0) for d, _ in ROWS])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    truth = {d: int("villain" in t) for d, t in ROWS if d is not None and d >= 100}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth]) > 0.95


def test_op8_rows(spark, sf_dir):
    got = rows(spark, "op8_license_scans", sf_dir)
    same([r["doc_id"] for r in got], [d for d, _ in ROWS])
    assert {r["license_from"] for r in got} == {"none"}


def test_op9_products(spark, sf_dir):
    same([(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(spark, "op9_exact_top_k", sf_dir)], brute_top_k(VECTORS, 20))


def pieces_of(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for d, t in documents:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            out.append((d, k, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    return out


def packed_well(got, documents):
    """All pieces are there, sequences are gapless and hold 2048 at most; how many sequences."""
    same([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], pieces_of(documents))
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by_sequence)


def test_op10_packs(spark, sf_dir):
    n = packed_well(rows(spark, "op10_best_fit_packing", sf_dir), ROWS)
    assert n == -(-sum(p[3] for p in pieces_of(ROWS)) // 2048) or n <= 1.1 * sum(p[3] for p in pieces_of(ROWS)) / 2048 + 1


def test_op11_draws(spark, sf_dir):
    got = rows(spark, "op11_importance_resampling", sf_dir)
    same([(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got], brute_draws(ROWS, TARGET))


def test_op12_cuts(spark, sf_dir):
    sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    got = rows(spark, "op12_fill_in_middle", sf_dir)
    want = [(*(c := brute_cuts(d, t))[:5], sha(c[5]), sha(t)) for d, t in ROWS]
    same([(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) for r in got], want)


def test_op13_groups(spark, sf_dir):
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows(spark, "op13_minhash_dedup", sf_dir)) == brute_shingles(ROWS)


# -- the pipeline -----------------------------------------------------------------------------


def test_stages(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = dict(pipeline.STAGES)
    assert list(steps) == ["toxicity", "line_dedup", "ngram_jaccard", "packing"]
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]

    clean = steps["toxicity"](spark, docs, sf_dir)
    assert clean.columns == docs.columns and clean.schema.names == docs.schema.names
    kept = [(r["doc_id"], r["text"]) for r in clean.collect()]
    toxic = [(d, t) for d, t in given if t and "villain" in t]
    assert not set(kept) & set(toxic) and len(kept) >= len(given) - len(toxic) - 2

    lines = steps["line_dedup"](spark, docs, sf_dir)
    assert lines.columns == docs.columns
    want = brute(given)
    same([(r["doc_id"], r["text"]) for r in lines.collect()], [(d, None if t is None else want[d if d is not None else 1 << 63, t][0]) for d, t in given])
    assert all(r["n_chars"] == len(r["text"] or "") for r in lines.collect())

    one = steps["ngram_jaccard"](spark, docs, sf_dir)
    assert one.columns == docs.columns
    groups = {d: c for d, c, _ in brute_groups(given)}
    left = [(r["doc_id"], r["text"]) for r in one.collect()]
    with_words = [(d, t) for d, t in left if (t or "").split()]
    assert Counter(groups[d] for d, _ in with_words) == Counter({groups[d] for d, t in given if (t or "").split()})
    assert {(d, t) for d, t in given if not (t or "").split()} <= set(left)

    packed_well(steps["packing"](spark, docs, sf_dir).collect(), given)


def test_run_is_its_stages(spark, sf_dir, empty_dir):
    import corpus_pipeline as pipeline

    got = pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    packed_well(got, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert pipeline.run(spark, empty_dir).collect() == []
