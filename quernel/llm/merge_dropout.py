"""Merge-type subword segmentation with seeded merge dropout, and its lossless inverse.

The vocabulary file of a SentencePiece BPE model gives pieces and merge ranks.
Of a unit's adjacent pairs that form a piece, an agenda takes the best ranked
first, the leftmost on ties; each candidate may be skipped, and then comes back
only if a neighbour changes. Characters without a piece become byte pieces, so
every text decodes to itself.

No piece has a space after another character, so a text's units (spaces and the
word that follows, or a tab or newline) never merge, and a unit is cut further
where no piece joins the neighbours. Every occurrence of a part has its own draw,
a hash of the seed, the key of its row and its place, which says after how many
candidates each skip comes. What a part becomes after given skips is kept in a
bounded tree: the root has none, a child has one more. Most occurrences end at
the root or a child of it. Without dropout the ids are those of the SentencePiece library.
"""

from __future__ import annotations

import gc
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import claim

UNITS = re.compile(r" *[^ \n\t]+| +|[\n\t]")
CACHE_ENTRIES = 600_000
SHORT = 32  # letters of a part that is kept
NEVER = 1 << 20  # more candidates than a short part has
MASK = 0xFFFFFFFFFFFFFFFF
ENCODED = "doc_id long, n_units long, n_ids long, ids array<int>, ids_crc32 long, lossless boolean"


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MergeCodec:
    def __init__(self, path: str, dropout: float = 0.0, seed: int = 0):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.rank: dict[str, int] = {}  # pieces with "▁" as a space: id
        self.score: dict[int, float] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.rank[text] = i
                self.score[i] = model.get_score(i)
                self.bytes_of.append(text.encode())
        order = sorted(self.score, key=lambda i: (-self.score[i], i))
        self.order = dict(zip(order, range(len(order))))
        self.merge = {text: self.order[i] for text, i in self.rank.items() if len(text) > 1}
        self.joined = {x + y for text in self.merge for x, y in zip(text, text[1:])}  # neighbours inside some piece
        size = len(self.bytes_of)
        pairs = {}
        for text, i in self.rank.items():
            for k in range(1, len(text)):
                a, b = self.rank.get(text[:k]), self.rank.get(text[k:])
                if a is not None and b is not None:
                    pairs[a * size + b] = i
        self.size = size
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.order_of = np.full(size, len(self.order), np.int64)
        self.order_of[list(self.order)] = list(self.order.values())
        self.dropout = dropout
        self.seed = seed
        self.first_ids = np.arange(0x110000, dtype=np.int64) + size  # of each character; size and more where it has no piece
        for text, i in self.rank.items():
            if len(text) == 1:
                self.first_ids[ord(text)] = i
        self.forget()

    def forget(self) -> None:
        """Empty the caches. A node is a short part with its skips; ``forks`` has its children by node and the place of the next skip."""
        self.cuts: dict[str, list[str]] = {}
        self.roots: dict[str, int] = {}
        self.forks: dict[int, int] = {}
        self.node_part: list[str] = []
        self.node_skips: list[tuple[int, ...]] = []
        self.node_ids: list[bytes] = []
        self.node_candidates = array("q")

    def gaps(self, draws: np.ndarray, r: int) -> np.ndarray:
        """How many candidates of each draw pass between its skips ``r`` - 1 and ``r``; each is skipped with the same chance."""
        if not self.dropout:
            return np.full(len(draws), NEVER)
        u = (mixed(draws + np.uint64(r * 0x9E3779B97F4A7C15 & MASK)) >> np.uint64(11)) * 2.0**-53
        with np.errstate(divide="ignore"):
            return np.minimum(np.log1p(-u) / np.log1p(-self.dropout), NEVER).astype(np.int64)

    def skips_of(self, draw: int) -> Iterator[int]:
        """Places of the skips among the candidates, without end."""
        at, r, draws = -1, 0, np.array([draw & MASK], np.uint64)
        while True:
            at += 1 + int(self.gaps(draws, r)[0])
            yield at
            r += 1

    def ids_of(self, symbols: list[str]) -> list[int]:
        """ids of merged symbols; a character without a piece gives its bytes."""
        rank = self.rank
        return [i for s in symbols for i in ([rank[s]] if s in rank else [self.byte_ids[x] for x in s.encode()])]

    def cut_up(self, unit: str) -> list[str]:
        """A unit's parts: it is cut where no piece of the vocabulary could join the neighbours (not among letters)."""
        if unit.lstrip(" ").isalpha():
            return [unit]
        joined = self.joined
        cuts = [k for k, (x, y) in enumerate(zip(unit, unit[1:]), 1) if x + y not in joined]
        if not cuts:
            return [unit]
        return [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)])]

    def learn(self, wanted: list[tuple[str, tuple[int, ...]]]) -> range:
        """New nodes of (short part, skips), merged in lockstep with parts of like length."""
        first = len(self.node_part)
        order = sorted(range(len(wanted)), key=lambda i: len(wanted[i][0]))
        out: list[tuple[bytes, int]] = [(b"", 0)] * len(wanted)
        for a in range(0, len(order), 4096):
            rows = order[a : a + 4096]
            for i, got in zip(rows, zip(*self.lockstep([wanted[i] for i in rows]))):
                out[i] = got
        self.node_part.extend(part for part, _ in wanted)
        self.node_skips.extend(skips for _, skips in wanted)
        self.node_ids.extend(ids for ids, _ in out)
        self.node_candidates.extend(n for _, n in out)
        return range(first, first + len(wanted))

    def merge_lockstep(self, group: list[tuple[str, int]]) -> list[bytes]:
        """ids of each (part, draw) as bytes."""
        skips = []
        for part, draw in group:
            places = []
            for at in self.skips_of(draw):
                if at >= 4 * len(part):  # a part has fewer candidates
                    break
                places.append(at)
            skips.append(tuple(places))
        return self.lockstep([(part, x) for (part, _), x in zip(group, skips)])[0]

    def lockstep(self, group: list[tuple[str, tuple[int, ...]]]) -> tuple[list[bytes], list[int]]:
        """ids of each (part, places of skips) as bytes, and its number of candidates; all parts do one step of their agendas at a time."""
        n = len(group)
        lengths = np.fromiter((len(p) for p, _ in group), np.int64, n)
        width = int(lengths.max())
        size, never = self.size, len(self.order)
        points = np.frombuffer("".join([p for p, _ in group]).encode("utf-32-le"), "<u4").astype(np.int64)
        filled = np.arange(width + 1) < lengths[:, None]
        symbols = np.full((n, width + 1), -1, np.int64)
        symbols[filled] = self.first_ids[points]
        ends = np.full((n, max(len(x) for _, x in group) + 1), -1, np.int64)
        for row, (_, x) in zip(ends, group):
            row[: len(x)] = x
        done, candidates = np.zeros(n, np.int64), np.zeros(n, np.int64)  # skips and candidates so far

        def ranks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            q = np.where((x < 0) | (y < 0) | (x >= size) | (y >= size), -1, x * size + y)
            at = np.minimum(np.searchsorted(self.pair_keys, q), len(self.pair_keys) - 1)
            return np.where(self.pair_keys[at] == q, self.order_of[self.pair_ids[at]], never)

        by_order = np.array([*self.order, -1])  # id at each rank
        agenda = ranks(symbols[:, :-1], symbols[:, 1:])
        live, span = np.arange(n), np.arange(width + 1)
        while len(live):
            k = agenda[live].argmin(axis=1)
            best = agenda[live, k]
            on = best < never
            live, k, best = live[on], k[on], best[on]
            if not len(live):
                break
            merged = by_order[best]
            skip = candidates[live] == ends[live, done[live]]
            candidates[live] += 1
            done[live] += skip
            agenda[live[skip], k[skip]] = never
            go, k, merged = live[~skip], k[~skip], merged[~skip]
            index = np.minimum(span + (span > k[:, None]), width)
            symbols[go, k] = merged
            symbols[go] = np.take_along_axis(symbols[go], index, axis=1)
            symbols[go, -1] = -1
            moved = np.take_along_axis(agenda[go], np.minimum(index[:, :-1], width - 1), axis=1)
            moved[:, -1] = never
            rows = np.arange(len(go))
            right = np.minimum(k, width - 1)
            moved[rows, right] = ranks(merged, symbols[go, k + 1])
            has = k > 0
            moved[rows[has], k[has] - 1] = ranks(symbols[go[has], k[has] - 1], merged[has])
            agenda[go] = moved
        counts = (symbols >= 0).sum(1)
        flat = symbols[symbols >= 0]
        data, stops = flat.astype("<u4").tobytes(), np.cumsum(4 * counts).tolist()
        out = [data[x:y] for x, y in zip([0, *stops], stops)]
        for r in np.nonzero((symbols >= size).any(1))[0].tolist():
            row = symbols[r][symbols[r] >= 0].tolist()
            out[r] = np.asarray([y for i in row for y in ([i] if i < size else [self.byte_ids[x] for x in chr(i - size).encode()])], "<u4").tobytes()
        return out, candidates.tolist()

    def merge_few(self, part: str, draw: int) -> list[str]:
        """Merge with the agenda as a short list, one rank for each pair of neighbours."""
        merge, never = self.merge, len(self.order)
        skips, n_seen = self.skips_of(draw), 0
        skip = next(skips)
        symbols = list(part)
        agenda = [merge.get(x + y, never) for x, y in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == never:
                break
            k = agenda.index(best)
            piece = symbols[k] + symbols[k + 1]
            n_seen += 1
            if n_seen > skip:
                skip = next(skips)
                agenda[k] = never
                continue
            symbols[k : k + 2] = [piece]
            del agenda[k]
            if k:
                agenda[k - 1] = merge.get(symbols[k - 1] + piece, never)
            if k < len(agenda):
                agenda[k] = merge.get(piece + symbols[k + 1], never)
        return symbols

    def merge_many(self, part: str, draw: int) -> list[str]:
        """The same with the agenda as a heap, for long parts."""
        merge = self.merge
        skips, n_seen = self.skips_of(draw), 0
        skip = next(skips)
        symbols = list(part)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(merge[p], k, 2, k + 1) for k in range(n - 1) if (p := symbols[k] + symbols[k + 1]) in merge]
        heapq.heapify(agenda)
        while agenda:
            _, left, size, right = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right] if right < n else ""
            if not a or not b or len(a) + len(b) != size or after[left] != right:
                continue
            n_seen += 1
            if n_seen > skip:
                skip = next(skips)
                continue
            symbols[left], symbols[right] = a + b, ""
            far = after[left] = after[right]
            if far < n:
                before[far] = left
                if (p := symbols[left] + symbols[far]) in merge:
                    heapq.heappush(agenda, (merge[p], left, len(p), far))
            near = before[left]
            if near >= 0 and (p := symbols[near] + symbols[left]) in merge:
                heapq.heappush(agenda, (merge[p], near, len(p), left))
        return [s for s in symbols if s]

    def encode_many(self, texts: list[str], keys: list[int]) -> list[tuple[bytes, int]]:
        """Of each text: ids as little-endian uint32 bytes, and the number of units. The empty text has none."""
        if len(self.cuts) + len(self.node_part) > CACHE_ENTRIES:
            self.forget()
        paused = gc.isenabled()
        gc.disable()  # the many short-lived tuples form no cycles
        try:
            units = [UNITS.findall(" " + t) if t else [] for t in texts]
            cuts = self.cuts
            for u in set(chain.from_iterable(units)).difference(cuts):
                cuts[u] = self.cut_up(u)
            parts = [list(chain.from_iterable(map(cuts.__getitem__, us))) for us in units]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            stops = np.cumsum(sizes)
            places = np.arange(sizes.sum()) - np.repeat(stops - sizes, sizes)
            starts = [(key * 0x9E3779B97F4A7C15 + self.seed * 0xD1B54A32D192ED03) & MASK for key in keys]
            draws = mixed(places.astype(np.uint64) + np.repeat(np.array(starts, np.uint64), sizes))
            found = self.ids_by_draw(list(chain.from_iterable(parts)), draws)
            return [(b"".join(found[a:b]), len(us)) for a, b, us in zip([0, *stops.tolist()], stops.tolist(), units)]
        finally:
            if paused:
                gc.enable()

    def ids_by_draw(self, parts: list[str], draws: np.ndarray) -> list[bytes]:
        """ids of each occurrence of a part by its own draw."""
        roots, forks = self.roots, self.forks
        fresh = set(parts).difference(roots)
        new = sorted(p for p in fresh if len(p) <= SHORT)
        roots.update(zip(new, self.learn([(p, ()) for p in new])))
        roots.update((p, -1) for p in fresh if len(p) > SHORT)
        node = np.fromiter(map(roots.__getitem__, parts), np.int64, len(parts))
        long = np.nonzero(node < 0)[0].tolist()
        for i in long:
            roots.pop(parts[i], None)
        on = np.nonzero(node >= 0)[0]
        at = self.gaps(draws[on], 0)
        r = 0
        while len(on):
            deeper = at < np.array(self.node_candidates)[node[on]]
            on, at = on[deeper], at[deeper]
            if not len(on):
                break
            forked = (node[on] * NEVER + at).tolist()
            new = sorted(set(forked).difference(forks))
            forks.update(zip(new, self.learn([(self.node_part[k // NEVER], (*self.node_skips[k // NEVER], k % NEVER)) for k in new])))
            node[on] = np.fromiter(map(forks.__getitem__, forked), np.int64, len(on))
            r += 1
            at = at + 1 + self.gaps(draws[on], r)
        out = list(map(self.node_ids.__getitem__, node.tolist()))
        for i in long:
            out[i] = np.asarray(self.ids_of(self.merge_many(parts[i], int(draws[i]))), "<u4").tobytes()
        return out

    def encode(self, text: str, key: int = 0) -> tuple[bytes, int]:
        return self.encode_many([text], [key])[0]

    def decode(self, ids) -> str:
        """The text of ids; control ids stand for nothing, broken UTF-8 becomes replacement characters."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


_codecs: dict[tuple, MergeCodec] = {}


def codec(*key) -> MergeCodec:
    claim("merge_dropout", _codecs.clear)
    if key not in _codecs:
        _codecs[key] = MergeCodec(*key)
    return _codecs[key]


def encode_column(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """(doc_id, n_units, n_ids, ids, ids_crc32, lossless) of every row.

    The key of a row is its doc_id, so a text segments alike wherever the row
    is computed, and differently in rows of other ids. A null text counts as
    empty: no ids. ``lossless`` says that decoding the ids gives the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, dropout, seed)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                keys, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                got = c.encode_many(texts, [k or 0 for k in keys])
                arrays = [np.frombuffer(d, "<i4") for d, _ in got]
                ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), pa.int32()))
                same = [c.decode(x.tolist()) == t for x, t in zip(arrays, texts)]
                columns = [part.column(0), pa.array([n for _, n in got], pa.int64()), pa.array([len(x) for x in arrays], pa.int64()), ids, pa.array([zlib.crc32(d) for d, _ in got], pa.int64()), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_units", "n_ids", "ids", "ids_crc32", "lossless"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def decode_column(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows with an ``ids`` array; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [None if ids is None else c.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def op3_merge_dropout(spark, sf_dir):
    import public_tokenizers

    return encode_column(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
