"""Fill-in-the-middle: texts are cut at unit boundaries into prefix, middle and suffix, and written in another order.

The boundaries of all texts of a slice are one packed bit vector with a directory
of set bits before each block (rank and select): the number of a text's units is a
difference of two ranks, and the byte at which a unit ends is one select.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import table
from quernel.llm.words import flat, map_texts, quoted

#: Markers before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
UNITS = ("line", "character")


class Bits:
    """Bits in 64-bit words, and how many are set before each block of eight words."""

    def __init__(self, flags: np.ndarray) -> None:
        room = np.zeros((len(flags) // 512 + 1) * 512, bool)
        room[: len(flags)] = flags
        self.words = np.packbits(room, bitorder="little").view("<u8")
        self.before = np.append(0, np.bitwise_count(self.words).reshape(-1, 8).sum(1, dtype=np.int64).cumsum())

    def _block(self, block: np.ndarray) -> np.ndarray:
        """How many bits are set in each word of a block."""
        return np.bitwise_count(self.words.reshape(-1, 8)[block]).astype(np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before place ``at``, the number of all places at most."""
        block, word = at >> 9, (at >> 6) & 7
        earlier = (self._block(block) * (np.arange(8) < word[:, None])).sum(1)
        part = self.words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + earlier + np.bitwise_count(part)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th set bit, from 1."""
        block = np.searchsorted(self.before, k, side="left") - 1
        left = k - self.before[block]
        upto = self._block(block).cumsum(1)
        word = (upto < left[:, None]).sum(1)
        left = left - np.where(word, upto[np.arange(len(k)), word - 1], 0)
        bits = np.unpackbits(self.words[block * 8 + word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * 512 + word * 64 + (bits.cumsum(1) < left[:, None]).sum(1)


def boundaries(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[Bits, Bits]:
    """The last bytes of units, and the first bytes of characters, of texts that begin at ``offsets``."""
    leads = (data & 0xC0) != 0x80
    if unit == "line":
        ends = data == 10
    else:
        ends = np.append(leads[1:], np.ones(min(1, len(data)), bool))
    ends[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    return Bits(ends), Bits(leads)


def draws(key: str, seed: int) -> list[int]:
    """Four numbers of 32 bits for a row key."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def cut_texts(texts: pa.Array, keys: pa.Array, seed: int, rate: int, spm: int, unit: str, markers: tuple[str, str, str]) -> dict:
    data, offsets = flat(texts)
    ends, leads = boundaries(data, offsets, unit)
    at = ends.rank(offsets)
    n = np.diff(at)
    h = np.array([draws(k or "", seed) for k in keys.to_pylist()], np.int64).reshape(-1, 4)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    wanted = at[:-1, None] + cuts
    some = cuts > 0
    places = np.repeat(offsets[:-1, None], 2, axis=1)
    places[some] = ends.select(wanted[some]) + 1
    chars = leads.rank(np.concatenate([offsets[:-1], places[:, 0], places[:, 1]])).reshape(3, -1)
    p, s, m = (x.encode() for x in markers)
    raw, out, forms = data.tobytes(), [], []
    for a, b, c, d, form, order in zip(offsets[:-1].tolist(), places[:, 0].tolist(), places[:, 1].tolist(), offsets[1:].tolist(), h[:, 2] % 100 >= rate, h[:, 3] % 100 < spm):
        text = raw[a:d]
        if a == d or form or p in text or s in text or m in text:
            forms.append("plain")
            out.append(text)
        elif order:
            forms.append("spm")
            out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
        else:
            forms.append("psm")
            out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
    plain = np.array([f == "plain" for f in forms], bool)
    return {
        "fim_text": pa.array(out, pa.binary()).view(pa.string()), "form": forms, "n": n,
        "prefix_chars": pa.array(chars[1] - chars[0], pa.int64(), mask=plain), "middle_chars": pa.array(chars[2] - chars[1], pa.int64(), mask=plain),
    }


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """The columns ``keep`` (all, if None) and fim_text, form, n (units), prefix_chars and middle_chars (null if plain).

    Of 100 texts ``rate`` are cut, and ``spm`` of 100 cut ones have their suffix
    first; what is drawn depends on seed and key only, so repeated rows of one key
    and text are cut alike. Empty and null texts and texts that hold a marker are
    left as they are (plain; null gives the empty text). A null key draws as the
    empty one does. Texts are worked on whole and row by row, whatever their length.
    A column of the input that is named like one of the result is replaced.
    """
    if unit not in UNITS or len(set(markers)) != 3 or any(len(x) < 2 or x[0] in x[1:] for x in markers):
        raise ValueError(f"units are {UNITS}; markers are three different ones whose first character isn't in them again")
    keys = F.col(quoted(key)).cast("string")
    added = "fim_text string, form string, n long, prefix_chars long, middle_chars long"
    return map_texts(docs, text, docs.columns if keep is None else keep, added, lambda t, keys: cut_texts(t, keys, seed, rate, spm, unit, markers), {"keys": keys})


def restored(fim_text: str = "fim_text", form: str = "form", markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``fill_in_middle`` was given, from what it wrote. A marker begins nowhere but where it was put, also across cuts."""
    first, *_ = p, s, m = markers
    whole, kind = F.col(quoted(fim_text)), F.col(quoted(form))

    def parts(before: str, between: str) -> tuple[Column, Column, Column]:
        a = F.locate(between, whole)
        b = a + F.locate(m, F.substring(whole, a, F.length(whole))) - 1
        head = F.substring(whole, F.lit(len(before) + 1), a - len(before) - 1)
        return head, F.substring(whole, a + len(between), b - a - len(between)), F.substring(whole, b + len(m), F.length(whole))

    (prefix, suffix, middle), (suffix2, prefix2, middle2) = parts(p, s), parts(s, p)
    return F.when(kind == "psm", F.concat(prefix, middle, suffix)).when(kind == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(whole)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
