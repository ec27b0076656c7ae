"""Texts as flat byte arrays: words found and numbered a slice of texts at a time, without a Python step a word."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE = 4 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words parted by white space, and of runs of ASCII letters, digits and all that isn't ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


class Words(NamedTuple):
    ids: np.ndarray  #: the number of each word in ``vocabulary``
    vocabulary: pa.Array
    first: np.ndarray  #: where each text's words begin, and the number of all words


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts one after the other, and where each begins; a null is an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts with ``SLICE`` bytes together, or of one longer text."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        yield at, to - at
        at = to


def words(texts: pa.Array, inside: np.ndarray) -> Words:
    """The runs of bytes that are ``inside``, after A-Z are lowered; none goes over the end of a text."""
    data, offsets = flat(texts)
    data = LOWER[data]
    held = inside[data]
    begins = held.copy()
    begins[1:] &= ~held[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = held[edges]
    starts = np.flatnonzero(begins)
    letters = data[held]
    ends = np.append((np.cumsum(held) - 1)[starts], len(letters)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
    return Words(np.asarray(found.indices, np.int64), found.dictionary, np.searchsorted(starts, offsets))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def map_texts(df: DataFrame, column: str, keep: list[str], added: str, fn: Callable[..., dict], also: dict | None = None) -> DataFrame:
    """The columns ``keep`` and those of the schema ``added``, which ``fn`` gives for an array of texts.

    ``also`` has more columns that ``fn`` gets, by name. A kept column that is named
    like an added one, in whatever case, is replaced by it.
    """
    new = StructType.fromDDL(added)
    taken = {f.name.lower() for f in new}
    keep = [c for c in keep if c.lower() not in taken]
    also = also or {}
    inner = df.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)], *[c.alias(f"a_{k}") for k, c in also.items()], F.col(quoted(column)).cast("string").alias("t"))
    schema = StructType(inner.schema.fields[: len(keep)] + new.fields)
    names, extra, n = schema.names, list(also), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(new)
        for batch in batches:
            for at, size in slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(at, size)
                got = fn(part.column(part.num_columns - 1), **{k: part.column(n + i) for i, k in enumerate(extra)})
                yield pa.RecordBatch.from_arrays(part.columns[:n] + [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in out], names)

    return inner.mapInArrow(run, schema).toDF(*keep, *new.names)
