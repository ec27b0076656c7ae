"""Best-fit packing of tokenised documents into fixed-size sequences.

Hierarchical residual packing: every partition packs its own pieces by best-fit
decreasing and emits its bins; the few underfull bins of a partition that could
still be joined with others go up a tree, where each node packs the bins of
``fan_in`` children as items, again by best fit, until one node is left.

Why few bins suffice: after best fit at most one bin of a partition is half
full or less (two such bins would have been one), and a merge of two bins needs
one of them. So a partition sends its emptiest bins, ``carry`` at most; bins
that stay behind are complete results, not dropped.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import arrow_map, claim, cut

CAPACITY = 2048
SEPARATOR_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Texts of these characters only are tokenised chunk by chunk: no normal form, case or class of theirs depends on a Unicode version.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÿ]*")
#: The file's own pre-tokenizer pattern, for lower-case text of those characters.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
CACHE_ENTRIES = 800_000


class ChunkTokenizer:
    """ids of a text as little-endian uint32 bytes, the same as the tokenizer file gives for the whole text.

    The file's pre-tokenizer never joins text across white space, so the ids of a
    text are those of its white-space-free chunks in order, and the ids of a chunk
    are those of its words; both are kept in bounded caches. Texts with other
    characters or with the text of a special token go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
        for piece, i in self.tokenizer.get_vocab().items():
            self.last[i] = piece.endswith("</w>")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        """Tokenise new words many at a time, and part the ids where a word ends."""
        for i in range(0, len(words), 500):
            part = words[i : i + 500]
            ids = np.asarray(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.nonzero(self.last[ids])[0]
            if len(ends) == len(part):
                data, cuts = ids.tobytes(), (4 * (ends + 1)).tolist()
                self.words.update(zip(part, [data[x:y] for x, y in zip([0, *cuts], cuts)]))
            else:
                self.words.update(zip(part, self._whole(part)))

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [(PLAIN.fullmatch(t) is not None) and "<|" not in t for t in texts]
        split = [t.lower().split() if p else None for t, p in zip(texts, plain)]
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks.clear()
        if len(self.words) > CACHE_ENTRIES:
            self.words.clear()
        known = self.chunks
        missing = set().union(*(cs for cs in split if cs)).difference(known)
        parts = {c: WORDS.findall(c) for c in missing}
        self._learn_words(list({w for ws in parts.values() for w in ws }.difference(self.words)))
        word = self.words.__getitem__
        known.update({c: b"".join(map(word, ws)) for c, ws in parts.items()})
        whole = iter(self._whole([t for t, p in zip(texts, plain) if not p]))
        get = known.__getitem__
        return [next(whole) if cs is None else b"".join(map(get, cs)) for cs in split]


_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    claim("packing", _tokenizers.clear)
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: its ids, then ``SEPARATOR_ID``, cut at ``capacity``.

    A null or empty text gives one piece that holds the separator alone. A null
    doc_id stays null; rows that repeat give repeated pieces.
    """
    end = np.asarray([SEPARATOR_ID], "<u4").tobytes()
    step = 4 * capacity

    def cut_up(batch: dict) -> dict:
        out: dict = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for doc, ids in zip(batch["doc_id"], tokenizer(path).encode([t or "" for t in batch["text"]])):
            ids += end
            for k, at in enumerate(range(0, len(ids), step)):
                part = ids[at : at + step]
                for name, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                    out[name].append(value)
        return out

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(slim, cut_up, PIECES, rows=512)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing of ``lengths``, which are in falling order: (bin, offset) of each, fill of each bin."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while some bin has r free places
    for i, n in enumerate(lengths.tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room - n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, np.asarray(fill, np.int64)


def emptiest(fill: np.ndarray, capacity: int, slack: int, carry: int) -> np.ndarray:
    """Which bins go up the tree: not nearly full, the ``carry`` emptiest."""
    chosen = np.zeros(len(fill), bool)
    order = np.argsort(fill, kind="stable")[:carry]
    chosen[order[fill[order] < capacity - slack]] = True
    return chosen


def pack(
    items: DataFrame,
    capacity: int = CAPACITY,
    items_per_partition: int = 65_536,
    fan_in: int = 8,
    carry: int = 16,
    slack: int = 8,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with (doc_id, piece, start, length, ids_crc32).

    Every input row comes back once. Rows of equal key and length are told apart
    by their order only, so repeated rows each get a place. An empty input gives
    no rows. Lengths are from 1 to ``capacity``.
    """
    items = cut(items)
    parts = max(1, -(-items.count() // items_per_partition))
    schema = PIECES + ", bin long, offset long, node long, fill long, up boolean"

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if not got:
            return
        node = TaskContext.get().partitionId()
        pdf = pd.concat(got, ignore_index=True)
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets, fill = best_fit(pdf["length"].to_numpy(), capacity)
        up = emptiest(fill, capacity, slack, carry)
        yield pdf.assign(bin=(node << 32) + bins, offset=offsets, node=node, fill=fill[bins], up=up[bins])

    # dealt by the row's number too, which its written form fixes: repeated rows don't meet in one task
    numbered = items.withColumn("row", F.monotonically_increasing_id())
    spread = numbered.repartition(parts, F.xxhash64("doc_id", "piece", "ids_crc32", "row")).drop("row")
    placed = cut(spread.mapInPandas(local, schema))

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
        bins, offsets, fill = best_fit(pdf["fill"].to_numpy(), capacity)
        up = emptiest(fill, capacity, slack, carry)
        first = pdf.groupby(bins)["bin"].transform("first")  # the bin that is joined keeps its id
        return pd.DataFrame({"bin": pdf["bin"], "into": first, "shift": offsets, "node": key[0], "fill": fill[bins], "up": up[bins]})

    nodes = placed.agg(F.max("node")).first()[0]
    level = placed.where("up").select("bin", "node", "fill").distinct()
    moved: DataFrame | None = None
    width = (nodes or 0) + 1
    while width > 1:
        width = -(-width // fan_in)
        step = (
            level.groupBy((F.col("node") / fan_in).cast("long").alias("node"))
            .applyInPandas(merge, "bin long, into long, shift long, node long, fill long, up boolean")
        )
        step = cut(step)
        level = step.where("up").select(F.col("into").alias("bin"), "node", "fill").distinct()
        hop = step.where("bin != into").select("bin", "into", "shift")
        if moved is None:
            moved = hop
        else:
            later = hop.select(F.col("bin").alias("into"), F.col("into").alias("to"), F.col("shift").alias("more"))
            earlier = moved.join(later, "into", "left").select(
                "bin", F.coalesce("to", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
            )
            moved = cut(earlier.unionByName(hop))
    if moved is not None:
        placed = placed.join(moved, "bin", "left")
        where, offset = F.coalesce("into", "bin"), F.col("offset") + F.coalesce("shift", F.lit(0))
    else:
        where, offset = F.col("bin"), F.col("offset")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", where.alias("sequence_id"), offset.cast("long").alias("offset")
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, **params) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text, any other columns) and pack the pieces."""
    return pack(pieces(docs, path, capacity), capacity, **params)


def op10_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
