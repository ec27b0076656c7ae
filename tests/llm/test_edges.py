"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quernel.llm import html_blocks, html_pages, jaccard, jpeg, licenses, maxent, media, merge_dropout, packing, toxicity, vectors

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, key string"
LONG = "word " * 30_000
ROWS = [(1, "The cat sat on the mat\nand slept"), (2, None), (3, ""), (None, "no id here"), (5, LONG), (6, "ünïcode tëxt 日本 😀"), (6, "ünïcode tëxt 日本 😀"), (7, " \t\n"), (6, "another text, longer than the one before, of the same id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", "s", 1, "x", "y") for d, t in ROWS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


# -- packing


def packed_well(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_edges(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path).collect()
    want = []
    for d, text in ROWS:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(d, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert by(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    packed_well(got, 2048)
    assert packing.pack_documents(empty, path).collect() == []


def test_packing_merges_up_the_tree(spark):
    r = np.random.default_rng(3)
    sizes = r.integers(1, 2049, 3000).tolist() + [2048] * 5 + [1] * 50
    df = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(sizes)], packing.PIECES)
    got = packing.pack(df, items_per_partition=40, fan_in=3).collect()
    assert len(got) == len(sizes)
    assert packed_well(got, 2048) <= 1.1 * math.ceil(sum(sizes) / 2048)


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fill = packing.best_fit(np.array([7, 6, 4, 3]), 10)
    assert bins.tolist() == [0, 1, 1, 0] and offsets.tolist() == [0, 0, 6, 7] and fill.tolist() == [10, 10]


def test_chunk_tokenizer_on_odd_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, c = Tokenizer.from_file(path), packing.ChunkTokenizer(path)
    texts = ["it's I'LL x'sy 'that", "a1b2 ÀÉß×÷ÿ ß", "<|endoftext|> a", "<|startoftext|", "\x1c \x85 \xa0b", "İstanbul ſ", "é", "!!'s ''s 's's", "A​B", "9'9"]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in c.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


# -- vectors


def brute_top_k(rows, k, mod=20):
    """(query_id, rank, vec_id, score) of every row's exact products with all others."""
    from fractions import Fraction
    from math import floor, isfinite

    able = [(i, [floor(Fraction(x) * 64) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(able):
        if q % mod == 0:
            scores = [(-min(max(sum(s * t for s, t in zip(x, y)), vectors.LEAST), vectors.MOST), c) for b, (c, y) in enumerate(able) if a != b]
            out += [(q, n, c, -s) for n, (s, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_top_k_edges(spark):
    rows = [
        (0, [1.0, 2.0]), (20, [0.5, -1.0]), (-40, [3.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []),
        (60, [1e30, 1.0]), (1, [1.0, 2.0]), (0, [-7.0, 0.25]), (20, [0.5, -1.0]), (7, [1e9, -1e9]), (80, [1e9, 1e9 + 0.3]), (8, [-1e308, 1.0]), (9, [float("inf")]), (100, []),
    ]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<double>, query_id string")
    for sizes in ({}, {"block_rows": 2, "query_rows": 2, "candidate_tile": 1, "query_tile": 1}):
        got = by(vectors.top_k(df, k=3, **sizes).collect(), "query_id", "rank", "vec_id", "score")
        assert got == brute_top_k(rows, 3)
    assert vectors.top_k(df.where("vec_id IS NULL")).collect() == []
    assert vectors.top_k(df.where("vec_id = -40")).collect() == []


@pytest.mark.parametrize("dim", [3, 24])
def test_top_k_equals_brute_force(spark, dim):
    r = np.random.default_rng(dim)
    x = r.normal(size=(700, dim)) * r.lognormal(0, 1, size=(700, 1))
    x[100:140] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = np.floor(64 * x).astype(np.int64)
    want = []
    for i in range(0, 700, 20):
        s = q @ q[i]
        best = sorted((-int(s[j]), j) for j in range(700) if j != i)[:7]
        want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    got = vectors.top_k(df, k=7, block_rows=90, query_rows=10).collect()
    assert by(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


# -- media


def test_media_edges(docs, empty):
    got = media.media_features(docs).collect()
    assert by(got, "doc_id", "n_bytes") == sorted(((d, len((t or "").encode())) for d, t in ROWS), key=repr)
    assert all(r["payload_bytes"] % 192 == 0 and r["payload_bytes"] > 0 for r in got)
    same = [r for r in got if r["doc_id"] == 6 and r["n_bytes"] == len(ROWS[5][1].encode())]
    assert len(same) == 2 and same[0] == same[1]
    assert media.media_features(empty).collect() == []


def test_media_round_trip_of_all_bytes():
    r = np.random.default_rng(1)
    data = [bytes(r.integers(0, 256, n, dtype=np.uint8)) for n in (1, 191, 192, 193, 5000)] + [b"\xff" * 400, b"\x00\xff" * 300, b""]
    for t, got in zip(data, media.read_back(media.store(data))):
        assert got["payload"] == t + b" " * ((-len(t)) % 192 if t else 192)


def dct_frame(pixels, quant=1, restart=0):
    """A baseline grey JPEG by the usual tables, from first principles."""
    h, w = pixels.shape
    basis = jpeg._BASIS

    def codes(counts, symbols):
        out, code, at = {}, 0, 0
        for n, c in enumerate(counts, 1):
            for _ in range(c):
                out[symbols[at]] = format(code, f"0{n}b")
                code, at = code + 1, at + 1
            code <<= 1
        return out

    dc, ac = codes(*jpeg.DC_LUMA), codes(*jpeg.AC_LUMA)

    def number(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    data, bits, last, done = b"", "", 0, 0

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for y in range(0, h, 8):
        for x in range(0, w, 8):
            if restart and done and done % restart == 0:
                data += flush(bits) + bytes([0xFF, 0xD0 + (done // restart - 1) % 8])
                bits, last = "", 0
            f = np.rint(basis.T @ (pixels[y : y + 8, x : x + 8].astype(float) - 128) @ basis / quant).astype(int).ravel()[jpeg.ZIGZAG]
            n, b = number(int(f[0]) - last)
            last = int(f[0])
            bits += dc[n] + b
            run = 0
            for v in f[1:].tolist():
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits += ac[0xF0]
                    run -= 16
                n, b = number(v)
                bits += ac[run << 4 | n] + b
                run = 0
            if run:
                bits += ac[0]
            done += 1
    data += flush(bits)
    head = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([quant] * 64) + b"\xff\xc0\x00\x0b\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x01\x01\x11\x00"
    if restart:
        head += b"\xff\xdd\x00\x04" + restart.to_bytes(2, "big")
    return head + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + data + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 3])
def test_general_frames_decode(restart):
    r = np.random.default_rng(2)
    y, x = np.mgrid[0:32, 0:48]
    images = [(128 + 100 * np.sin(x / (3 + k)) * np.cos(y / 5) + r.normal(0, 3, (32, 48))).clip(0, 255) for k in range(3)]
    frames = [dct_frame(p, restart=restart) for p in images]
    (rows, c, layout), = media.decode_frames(frames)
    got = jpeg.planes(c, layout)[0]
    assert rows == [0, 1, 2] and np.abs(got - np.array(images)).max() < 3


def test_shots_and_broken_files(spark):
    dark, light = np.full((16, 16), 30.0), np.full((16, 16), 220.0)
    frames = [dct_frame(dark)] * 20 + [dct_frame(light)] * 15 + [dct_frame(dark)] * 12
    good = media.write_avi(frames, 16, 16)
    no_index = good[: good.index(b"idx1")]
    rows = [("a", good), ("b", no_index), ("c", None), ("d", b"RIFF"), ("e", good[:300]), ("f", media.write_avi([], 16, 16))]
    got = media.clip_rows(spark.createDataFrame(rows, "media_id string, media binary")).collect()
    clips = [(r["first_frame"], r["frames"]) for r in got if r["media_id"] == "a"]
    assert clips == [(0, 20), (20, 15), (35, 12)] == [(r["first_frame"], r["frames"]) for r in got if r["media_id"] == "b"]
    assert {r["media_id"] for r in got if r["error"]} >= {"c", "d"}
    assert [r["end_s"] for r in got if r["media_id"] == "a"] == pytest.approx([0.8, 1.4, 1.88])


# -- merge dropout


def test_merge_dropout_edges(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = merge_dropout.encode_column(docs, path).collect()
    assert len(got) == len(ROWS) and all(r["lossless"] for r in got)
    assert [r["n_ids"] for r in got if r["doc_id"] in (2, 3)] == [0, 0]
    a, b = [r for r in got if r["doc_id"] == 6 and r["ids"] and r["n_units"] == 4]
    assert a == b
    assert merge_dropout.encode_column(empty, path).collect() == []
    back = merge_dropout.decode_column(merge_dropout.encode_column(docs, path), path).collect()
    assert by(back, "doc_id", "text") == sorted(((d, t or "") for d, t in ROWS), key=repr)


def test_merge_dropout_without_dropout_is_the_library():
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, c = SentencePieceProcessor(model_file=path), merge_dropout.MergeCodec(path)
    for t in ["Hello  world", " a\tb\n\nc ", "ﬁné 日本 😀", "x" * 200, "internationalisation, isn't it?", "a  " * 50]:
        assert np.frombuffer(c.encode(t)[0], "<u4").tolist() == model.encode(t)


def test_merge_dropout_varies_by_seed_and_decodes():
    path = public_tokenizers.path("piece_bpe_32k.model")
    text = "understanding internationalisation of wonderful reading ▁ <0x41> </s>"
    seen = set()
    for seed in range(6):
        c = merge_dropout.MergeCodec(path, 0.3, seed)
        ids = np.frombuffer(c.encode(text, 9)[0], "<u4").tolist()
        assert c.decode(ids) == text and c.encode(text, 9)[0] == merge_dropout.MergeCodec(path, 0.3, seed).encode(text, 9)[0]
        for part in ["understanding", " internationalisation"]:
            assert np.frombuffer(c.merge_lockstep([(part, 1)])[0], "<u4").tolist() == c.ids_of(c.merge_few(part, 1)) == c.ids_of(c.merge_many(part, 1))
        seen.add(tuple(ids))
    assert len(seen) > 3


def test_merge_dropout_varies_at_every_occurrence():
    c = merge_dropout.MergeCodec(public_tokenizers.path("piece_bpe_32k.model"), 0.1, 1)
    for word in ["international", "reading"]:
        n = 4000
        alone = [c.encode(word, key)[0] for key in range(n)]
        (joined, units), = c.encode_many([" ".join([word] * n)], [7])
        assert units == n and c.decode(np.frombuffer(joined, "<u4").tolist()) == " ".join([word] * n)
        brute = [tuple(c.ids_of(c.merge_few(" " + word, draw))) for draw in range(n)]
        plain = Counter(brute).most_common(1)[0][0]
        share = [sum(tuple(x) == plain for x in xs) / n for xs in (brute, [np.frombuffer(d, "<u4").tolist() for d in alone])]
        assert abs(share[0] - share[1]) < 0.05 and len(set(alone)) > 8
        assert len({c.encode_many([word + " " + word], [k])[0][0] for k in range(200)}) > 20


# -- language model


def test_maxent_edges(docs, empty, spark):
    got = maxent.fit_and_score(docs, docs).collect()
    counts = Counter(w for _, t in ROWS for w in maxent.words(t))
    n, v = sum(counts.values()), len(counts)
    want = [(d, len(maxent.words(t)), len(maxent.words(t)), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in maxent.words(t)), 4)) for d, t in ROWS]
    assert sorted([(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got], key=repr) == sorted(want, key=repr)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 and r["train_tokens"] == n for r in got)
    assert maxent.fit_and_score(empty, empty).collect() == []
    untrained = maxent.fit_and_score(docs, empty).collect()
    assert len(untrained) == len(ROWS) and all(r["base_score"] == 0 and r["n_known"] == 0 for r in untrained)


def test_maxent_sums_to_one():
    words = [f"w{i}".encode() for i in range(maxent.IN_MODEL + 300)]
    counts = np.arange(len(words), 0, -1).astype(float)
    tokens, distinct = np.zeros(maxent.OPEN), np.zeros(maxent.OPEN)
    for w, c in zip(words[maxent.IN_MODEL :], counts[maxent.IN_MODEL :]):
        tokens[maxent.open_class(w)] += c
        distinct[maxent.open_class(w)] += 1
    lex = maxent.Lexicon(words, counts, int(counts.sum()), len(words), tokens, distinct)
    lex.prepare()
    r = np.random.default_rng(0)
    tables = [t + r.normal(0, 0.5, t.shape).astype(np.float32) for t in maxent.fresh()]
    history = [lex.ids[b"w3"], lex.ids[b"unseen"]]
    total = 0.0
    for w in words:
        ids = [np.array([*history, lex.ids[w]])]
        before = [np.array(history)]
        total += 10 ** (maxent.log10_model(ids, lex, tables)[0] - maxent.log10_model(before, lex, tables)[0])
    unseen = maxent.probabilities(tables[0], maxent.rows_of(maxent.hashed([np.array([history[1]]), np.array([history[0]])])), lex.class_bias)[0, maxent.CLASSES :]
    total += float((unseen / (tokens + distinct + 1)).sum())  # the place of unseen words in each open class
    assert total == pytest.approx(1, abs=1e-3)


def test_maxent_learns_context(spark):
    r = np.random.default_rng(1)
    rows = [(i, " ".join(f"{'ab'[k % 2]}{r.integers(5)}" for k in range(200))) for i in range(40)]
    got = maxent.fit_and_score(spark.createDataFrame(rows[:5], "doc_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string"), rounds=3).collect()
    assert all(r["score"] > r["base_score"] + 20 for r in got)


def test_maxent_grows_and_sees_the_third_word_before(spark):
    classes, rows = maxent.sizes(5_000_000_000, 50_000_000)
    assert maxent.sizes(1000, 100) == (16, 1 << 15) and classes > 200 and rows >= 1 << 19 and maxent.IN_MODEL == 1024
    _, before = maxent.positions([np.array([5, 6, 7, 8])])
    assert [x[-1] for x in before] == [7, 6, 5]
    one, other = (maxent.hashed([np.array([1]), np.array([2]), np.array([c])]) for c in (3, 4))
    assert any(x != y for x, y in zip(one, other))
    # a larger model trains and scores too
    lex = maxent.Lexicon([f"w{i}".encode() for i in range(1500)], np.arange(1500, 0, -1.0), 10_000, 1500, np.zeros(16), np.zeros(16), 20, 1 << 17)
    lex.prepare()
    ids = [np.array([3, 1100, 1279, 4])]
    tables, _ = maxent.learn(iter([["w3 w1100 w1279 w4"] * 50]), lex, maxent.fresh(20, 1 << 17))
    assert maxent.log10_model(ids, lex, tables)[0] > maxent.log10_model(ids, lex, maxent.fresh(20, 1 << 17))[0] + 0.5


# -- html


def test_html_edges(spark):
    model = html_blocks.labeller(200)
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (4, "u", "no markup at all"), (5, "u", "<" * 3000 + "a" * 10), (6, "u", "<div " + 'x="' * 2000), (7, "u", "<article>" + "<p>A long sentence of words here, and some more of it.</p>" * 3000)]
    got = html_blocks.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string"), model).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert html_blocks.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).collect() == []


def test_html_blocks_and_references():
    page = "<!-- x --><head><title>T</title></head><body><script>var t='</p>';</script><p>a &amp; b&nbsp;&#233;<br>c <b>d\n e</b><p>f<li>g<li>h</body>"
    assert [b.text for b in html_blocks.blocks(page)] == ["a & b é c d e", "f", "g", "h"]


def test_html_held_out_pages():
    model, r = html_blocks.labeller(600), np.random.default_rng(77)
    hit = wrong = missed = 0
    for _ in range(120):
        page, main = html_pages.generate(r)
        got = set(html_blocks.main_texts([page], model)[0].split("\n")) - {""}
        want = {b.text for b in html_blocks.blocks(page) if b.text in main}
        hit, wrong, missed = hit + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.95


# -- toxicity


def toxic_rows(n, seed):
    r = np.random.default_rng(seed)
    parts = "ba be ci do fu ga ho ki lu me no pa ri so tu".split()
    rows = []
    for i in range(n):
        words = ["".join(r.choice(parts, 3)) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            for k in range(3):
                words[int(r.integers(40))] = str(r.choice(["villain", "rotter", "scoundrel"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_learns_and_stands_gaps(spark):
    rows = toxic_rows(600, 1)
    docs, labels = (spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[r[0]] == r[2] for r in held]) > 0.97
    scores = dict(zip(("villain", "viilllain", "villlain", "bedoga"), model.unit_scores(["villain", "viilllain", "villlain", "bedoga"])))
    assert scores["villain"] > scores["villlain"] > scores["bedoga"] and scores["viilllain"] > scores["bedoga"]
    assert toxicity.units("v i l l a i n of") == {"villain"} and "villain" in toxicity.units("vil.la-in")


def test_toxicity_landmarks_cover_every_family():
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèçñ"
    r = np.random.default_rng(3)
    insults = ["".join(r.choice(list(letters), 7)) for _ in range(60)]
    got = toxicity.spread({u: 1.0 + i for i, u in enumerate(insults)}, 20)
    assert toxicity.normal_kernel(insults, got).max(1).min() >= 0.5 and len(got) > 40
    assert len(toxicity.spread({u: 1.0 for u in ["abcdef", "abcdeg", "abcdeh"]}, 3)) == 3


def test_toxicity_edges(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for some in (labels, none):
        model = toxicity.fit(docs, some)
        got = toxicity.with_scores(docs, model)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "score", "predicted", "worst_unit"]
        rows = got.collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
        assert toxicity.score(empty, model).collect() == []


def test_string_kernel():
    def brute(a, b, n, decay):
        from itertools import combinations

        def weights(s):
            out = {}
            for idx in combinations(range(len(s)), n):
                k = "".join(s[i] for i in idx)
                out[k] = out.get(k, 0) + decay ** (idx[-1] - idx[0] + 1)
            return out

        x, y = weights(a), weights(b)
        return sum(v * y.get(k, 0) for k, v in x.items())

    names = ["abcab", "bcxab", "zzz", "abcabca"]
    got = toxicity.kernel(toxicity.codes(names), toxicity.codes(names))
    for o, n in enumerate(toxicity.ORDERS):
        for i, a in enumerate(names):
            for j, b in enumerate(names):
                assert got[o, i, j] == pytest.approx(brute(a, b, n, toxicity.DECAY), rel=1e-4, abs=1e-9)


# -- Jaccard


def brute_groups(rows):
    sets = [set(jaccard.shingles(t).tolist()) for _, t in rows]
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a], links[b] = links[a] + 1, links[b] + 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 62), d if d is not None else 1 << 62)
    return sorted([(d, None if least[find(i)] == 1 << 62 else least[find(i)], links[i]) for i, (d, _) in enumerate(rows)], key=repr)


def test_jaccard_edges(docs, empty, spark):
    got = by(jaccard.jaccard_join(docs).collect(), "doc_id", "class_id", "n_links")
    assert got == brute_groups(ROWS)
    assert jaccard.jaccard_join(empty).collect() == []
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    want = [(d, t) for d, t in dict.fromkeys(ROWS)]
    assert by(kept.collect(), "doc_id", "text") == sorted(want, key=repr)


@pytest.mark.parametrize("small, block", [(512, 256), (4, 3)])
def test_jaccard_equals_brute_force(spark, small, block):
    r = np.random.default_rng(4)
    line = "one very common line that many of the texts share word for word in their middle"
    rows = []
    for i in range(160):
        if i % 3 == 0:
            base = [f"b{k}" for k in range(80)]
            for _ in range(int(r.integers(0, 4))):
                base[int(r.integers(80))] = f"x{r.integers(9)}"
            rows.append((i, " ".join(base)))
        else:
            rows.append((i, " ".join(f"w{r.integers(4000)}" for _ in range(int(r.integers(3, 40)))) + "\n" + line))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_join(df, small=small, block=block, runs=8, depth=4).collect()
    assert by(got, "doc_id", "class_id", "n_links") == brute_groups(rows)


# -- licences


def cosine(a, b, idf, oov):
    x, y = Counter(licenses.terms(a)), Counter(licenses.terms(b))
    wx, wy = ({t: n * idf.get(t, oov) for t, n in c.items()} for c in (x, y))
    return sum(v * wy.get(t, 0) for t, v in wx.items()) / math.sqrt(sum(v * v for v in wx.values()) * sum(v * v for v in wy.values()) or 1)


def test_licenses_equal_brute_force(spark):
    r = np.random.default_rng(6)
    templates = licenses.TEMPLATES
    rows = []
    for i in range(60):
        body = [" ".join(f"w{r.integers(300)}" for _ in range(8)) for _ in range(3)]
        if i % 3 == 0:
            words = templates[int(r.integers(len(templates)))][2].split()
            for _ in range(int(r.integers(0, 4))):
                words[int(r.integers(len(words)))] = f"w{r.integers(300)}"
            body.insert(int(r.integers(4)), " ".join(words))
        rows.append((f"d{i % 4}/e{i % 7}/f{i}", "\n".join(body)))
    vocabulary = {t for _, _, x in templates for t in licenses.terms(x)}
    held = [set(licenses.terms(t)) for _, t in rows]
    idf = {t: math.log((len(rows) + 1) / (sum(t in h for h in held) + 1)) + 1 for t in vocabulary}
    oov = math.log(len(rows) + 1) + 1
    want = {}
    for p, t in rows:
        scored = []
        for k, unit in enumerate([*t.split("\n"), t]):
            best = max(((round(cosine(unit, x, idf, oov), 9), -i) for i, (_, _, x) in enumerate(templates)))
            if best[0] >= 0.75:
                scored.append((best[0], k, templates[-best[1]][0], len(unit)))
        want[p] = (max(s[0] for s in scored), {s[2] for s in scored}) if scored else None
    got = licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()
    for row in got:
        own = want[row["path"]]
        assert (row["license_from"] == "own") == (own is not None), row
        if own:
            assert row["score"] == pytest.approx(own[0], abs=1e-6) and row["license"] in own[1]


def test_license_inheritance_and_edges(spark):
    mit, gpl = licenses.TEMPLATES[3][2], licenses.TEMPLATES[9][2]
    rows = [("a/LICENSE", mit), ("a/x", "code"), ("a/b/c/y", "code"), ("a/b/COPYING", gpl), ("a/b/z", None), ("q/x", "code"), (None, None), (None, mit), ("top", ""), ("a/x", "code"), ("a/b/c/LICENSE", "none here")]
    df = spark.createDataFrame([(*r, "old", 1) for r in rows], "path string, text string, license string, extra int")
    out = licenses.scan_licenses(df)
    assert out.columns == ["path", "text", "extra", "license", "score", "license_from", "license_dir", "license_lines"]
    got = by(out.collect(), "path", "license", "license_from", "license_dir")
    want = [("a/LICENSE", "MIT", "own", None), ("a/x", "MIT", "inherited", "a"), ("a/x", "MIT", "inherited", "a"), ("a/b/c/y", "GPL-3.0", "inherited", "a/b"), ("a/b/COPYING", "GPL-3.0", "own", None), ("a/b/z", "GPL-3.0", "inherited", "a/b"), ("a/b/c/LICENSE", "GPL-3.0", "inherited", "a/b"), ("q/x", None, "none", None), (None, None, "none", None), (None, "MIT", "own", None), ("top", None, "none", None)]
    assert got == sorted(want, key=repr)
    assert licenses.scan_licenses(df.where("extra = 0")).collect() == []


def test_licence_headers_over_several_lines(spark):
    """A notice wrapped in a comment, in paragraphs of it, and as a block of plain lines; the code below has no licence."""
    import textwrap

    code = "\n".join(f"value_{i} = compute({i}, other_{i})" for i in range(150))
    mit, gpl, bsd = (next(t for n, k, t in licenses.TEMPLATES if n == name and k == "file") for name in ("MIT", "GPL-3.0", "BSD-3-Clause"))
    comment = lambda t, sign: "\n".join(f"{sign} {x}" for x in textwrap.wrap(t, 72))
    half = len(gpl.split()) // 2
    two = comment(" ".join(gpl.split()[:half]), "//") + "\n//\n" + comment(" ".join(gpl.split()[half:]), "//")
    title = "Apache License\n  Version 2.0, January 2004\nhttp://www.apache.org/licenses/\n\n"
    rows = [("a/x.py", comment(mit, "#") + "\n" + code), ("b/y.js", two + "\n" + code), ("c/z.txt", "\n".join(textwrap.wrap(bsd, 60)) + "\n\n" + code), ("d/LICENSE", title + code), ("d/e/w", code), ("a/v", code)]
    got = {r["path"]: (r["license"], r["license_from"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/x.py": ("MIT", "own"), "b/y.js": ("GPL-3.0", "own"), "c/z.txt": ("BSD-3-Clause", "own"), "d/LICENSE": ("Apache-2.0", "own"), "d/e/w": ("Apache-2.0", "inherited"), "a/v": (None, "none")}


def test_maxent_predicts_held_out_texts_better_than_counts(spark):
    """Words that follow from those before: the model's bits a token on texts it never saw are far under the base's."""
    r = np.random.default_rng(8)
    names = [f"w{i}" for i in range(60)]

    def sentence():
        at, out = int(r.integers(60)), []
        for _ in range(30):
            out.append(names[at])
            at = (at * 7 + 3) % 60 if r.random() < 0.9 else int(r.integers(60))
        return " ".join(out)

    train = spark.createDataFrame([(i, sentence()) for i in range(1200)], "doc_id long, text string")
    unseen = spark.createDataFrame([(i, sentence()) for i in range(100)], "doc_id long, text string")
    rows = maxent.fit_and_score(unseen, train).collect()
    model, base = (-sum(x[c] for x in rows) / sum(x["n_tokens"] for x in rows) / math.log10(2) for c in ("score", "base_score"))
    assert model < base - 1
