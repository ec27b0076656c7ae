"""AVI motion-JPEG columns: RIFF parsing, intra-frame decoding, shots and clips.

``parse_avi`` reads the header lists and the index (or walks the frames where
there is none); ``decode_frames`` decodes many frames at once; ``shots`` cuts
where the difference of neighbouring histograms stands out from those around it.
Frames are encoded and decoded ``SLICE`` at a time, so that memory beyond the
file itself doesn't grow with its length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import jpeg

COLUMNS, ROWS = 16, 12
UNIT = COLUMNS * ROWS  # bytes of a frame
FRAME_RATE = 25
BINS = 32
SLICE = 1024  # frames that are encoded or decoded together
HEADER = jpeg.mosaic_header(8 * COLUMNS, 8 * ROWS)


CLIP = "clip int, first_frame long, frames long, start_s double, end_s double"
CLIP_FIELDS = CLIP.replace(" ", ":").replace(",:", ", ")


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


@dataclass
class Avi:
    seconds_a_frame: float
    frames: list[bytes]
    width: int
    height: int


def chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, rate: int = FRAME_RATE) -> bytes:
    """A RIFF AVI file of motion-JPEG frames with an index."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    sizes = np.array([len(f) for f in frames], np.int64)
    body = b"".join(x for f in frames for x in (b"00dc" + len(f).to_bytes(4, "little"), f, b"\0" * (len(f) % 2)))
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10
    index[:, 2] = 4 + np.concatenate([[0], np.cumsum(8 + sizes + sizes % 2)])[:-1]
    index[:, 3] = sizes
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", b"movi" + body) + chunk(b"idx1", index.tobytes()))


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(tag, start, end) of the chunks between two places; one cut short ends with the data."""
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def parse_avi(data: bytes) -> Avi:
    """Frames of the first video stream, by the index where there is one."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise jpeg.Unsupported("no AVI file")
    seconds, width, height, stream, streams, movi, index = 1 / FRAME_RATE, 0, 0, 0, 0, None, None
    for tag, a, b in chunks(data, 12, len(data)):
        kind = data[a : a + 4] if tag == b"LIST" else b""
        if kind == b"hdrl":
            video = None
            for tag2, a2, b2 in chunks(data, a + 4, b):
                if tag2 == b"avih" and b2 - a2 >= 40:
                    seconds = (int.from_bytes(data[a2 : a2 + 4], "little") or 1_000_000 // FRAME_RATE) / 1e6
                    width, height = struct.unpack_from("<II", data, a2 + 32)
                elif tag2 == b"LIST" and data[a2 : a2 + 4] == b"strl":
                    for tag3, a3, b3 in chunks(data, a2 + 4, b2):
                        if tag3 == b"strh" and data[a3 : a3 + 4] == b"vids" and video is None and b3 - a3 >= 28:
                            video = streams
                            scale, rate = struct.unpack_from("<II", data, a3 + 20)
                            if scale and rate:
                                seconds = scale / rate
                    streams += 1
            stream = video or 0
        elif kind == b"movi":
            movi = (a, b)
        elif tag == b"idx1":
            index = np.frombuffer(data[a : b - (b - a) % 16], "<u4").reshape(-1, 4)
    if movi is None:
        raise jpeg.Unsupported("no movi list")
    wanted = [b"%02d%s" % (stream, kind) for kind in (b"dc", b"db")]
    frames: list[bytes] = []
    if index is not None and len(index):
        rows = index[np.isin(index[:, 0], [int.from_bytes(w, "little") for w in wanted])]
        base = movi[0] if len(rows) and data[movi[0] + int(rows[0, 2]) : movi[0] + int(rows[0, 2]) + 4] in wanted else 0
        frames = [data[base + o + 8 : base + o + 8 + n] for o, n in rows[:, 2:].tolist()]
    else:
        todo = [movi]
        for a, b in todo:
            for tag, a2, b2 in chunks(data, a + 4, b):
                if tag in wanted:
                    frames.append(data[a2:b2])
                elif tag == b"LIST":
                    todo.append((a2, b2))
    return Avi(seconds, frames, width, height)


def decode_frames(frames: list[bytes]) -> list[tuple[list[int], jpeg.Coefficients, jpeg.Layout]]:
    """Frames grouped by equal headers: (numbers of the frames, coefficients, layout)."""
    groups: dict[bytes, list[int]] = {}
    layouts: dict[bytes, jpeg.Layout] = {HEADER: _LAYOUT}
    for i, f in enumerate(frames):
        head = HEADER
        if not f.startswith(head):
            head = next((h for h in layouts if f.startswith(h)), None)
            if head is None:
                layout = jpeg.parse_header(f)
                head = f[: layout.scan_at]
                layouts[head] = layout
        groups.setdefault(head, []).append(i)
    out = []
    for head, rows in groups.items():
        scans = [(f := frames[i])[len(head) : (end if (end := f.rfind(b"\xff\xd9")) > 0 else len(f))] for i in rows]
        out.append((rows, jpeg.decode_scans(scans, layouts[head]), layouts[head]))
    return out


_LAYOUT = jpeg.parse_header(HEADER)


def decoded(frames: list[bytes]) -> Iterator[tuple[np.ndarray, jpeg.Coefficients, jpeg.Layout]]:
    """``decode_frames`` of a slice of the frames at a time, with numbers among all of them."""
    for a in range(0, len(frames), SLICE):
        for rows, c, layout in decode_frames(frames[a : a + SLICE]):
            yield np.array(rows) + a, c, layout


def histograms(frames: list[bytes]) -> np.ndarray:
    """Share of the first component's samples in each of ``BINS`` bins, by frame."""
    out = np.zeros((len(frames), BINS))
    for rows, c, layout in decoded(frames):
        if len(c.frame) or len(layout.components) > 1:
            values = jpeg.planes(c, layout)[0].reshape(len(rows), -1)
        else:
            values = mosaic_values(c, layout)
        out[rows] = histogram_rows(values)
    return out


def mosaic_values(c: jpeg.Coefficients, layout: jpeg.Layout) -> np.ndarray:
    """The samples of flat blocks, one each."""
    step = layout.quantisers[layout.components[0][3]][0]
    return np.rint(np.clip(c.dc * step / 8 + 128, 0, 255)).astype(np.uint8)


def histogram_rows(values: np.ndarray) -> np.ndarray:
    n, per = values.shape
    flat = (values.astype(np.int64) * BINS // 256) + BINS * np.arange(n)[:, None]
    return np.bincount(flat.ravel(), minlength=n * BINS).reshape(n, BINS) / per


def differences(hist: np.ndarray) -> np.ndarray:
    """Half the L1 distance of each frame's histogram from the one before; 0 for the first."""
    return np.concatenate([[0.0], np.abs(np.diff(hist, axis=0)).sum(1) / 2])[: len(hist)]


def shots(diff: np.ndarray, reach: int = 12, factor: float = 3.0, least: float = 0.2) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot.

    A cut is a frame whose difference is the highest of its neighbourhood
    (``reach`` frames on either side), at least ``least``, and above the
    neighbourhood's mean by ``factor`` of its deviations.
    """
    n = len(diff)
    if not n:
        return []
    at = np.arange(n)
    lo, hi = np.maximum(at - reach, 1), np.minimum(at + reach + 1, n)
    s1, s2 = (np.concatenate([[0.0], np.cumsum(x)]) for x in (diff, diff**2))
    count = np.maximum(hi - lo - 1, 1)
    mean = (s1[hi] - s1[lo] - diff) / count
    dev = np.sqrt(np.maximum((s2[hi] - s2[lo] - diff**2) / count - mean**2, 0))
    cuts = [int(i) for i in np.nonzero((diff >= least) & (diff > mean + factor * dev) & (at > 0))[0] if diff[i] >= diff[lo[i] : hi[i]].max()]
    edges = [0, *cuts, n]
    return list(zip(edges, edges[1:]))


def timed(cut: list[tuple[int, int]], seconds_a_frame: float) -> list[dict]:
    """Shots as clip rows with their times."""
    return [{"clip": k, "first_frame": a, "frames": b - a, "start_s": a * seconds_a_frame, "end_s": b * seconds_a_frame} for k, (a, b) in enumerate(cut)]


def clip_rows(df: DataFrame, media_col: str = "media", id_col: str = "media_id") -> DataFrame:
    """Timed clips of a column of AVI files: (id, clip, first_frame, frames, start_s, end_s, error).

    A null or broken file gives one row with ``error`` and null times; a file
    without frames gives no clip rows.
    """
    schema = f"media_id string, {CLIP}, error string"
    out = arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    avi = parse_avi(data or b"")
                    rows = [{"media_id": key} | r for r in timed(shots(differences(histograms(avi.frames))), avi.seconds_a_frame)]
                except (struct.error, IndexError, KeyError, ValueError, OverflowError, MemoryError) as e:  # whatever broken bytes lead to
                    rows = [{"media_id": key, "clip": 0, "error": str(e) or type(e).__name__}]
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    return df.select(F.col(id_col).cast("string"), F.col(media_col).cast("binary")).mapInArrow(read, schema)


def store(texts: list[bytes]) -> list[bytes]:
    """Each text's bytes, filled with spaces to whole frames, as an AVI file."""
    filled = [t + b" " * ((-len(t)) % UNIT if t else UNIT) for t in texts]
    samples = np.frombuffer(b"".join(filled), np.uint8).reshape(-1, UNIT)
    frames = [f for a in range(0, len(samples), SLICE) for f in jpeg.encode_mosaics(samples[a : a + SLICE], HEADER)]
    at, out = 0, []
    for f in filled:
        n = len(f) // UNIT
        out.append(write_avi(frames[at : at + n], 8 * COLUMNS, 8 * ROWS))
        at += n
    return out


def read_back(files: list[bytes]) -> list[dict]:
    """Payload and features of files that ``store`` wrote, from the files alone."""
    parsed = [parse_avi(f) for f in files]
    frames = [f for avi in parsed for f in avi.frames]
    values = np.zeros((len(frames), UNIT), np.uint8)
    for rows, c, layout in decoded(frames):
        values[rows] = mosaic_values(c, layout)
    hist, at, out = histogram_rows(values), 0, []
    for avi in parsed:
        n = len(avi.frames)
        payload, diff = values[at : at + n].tobytes(), differences(hist[at : at + n])
        cut = shots(diff)
        times = ",".join(f"{a * avi.seconds_a_frame:.2f}" for a, _ in cut)
        longest = max(b - a for a, b in cut)
        digest = hashlib.sha256(times.encode()).hexdigest()[:16]
        out.append({"payload": payload, "clips": timed(cut, avi.seconds_a_frame), "feature": f"frames={n};seconds={n * avi.seconds_a_frame:.2f};shots={len(cut)};longest={longest};change={diff.mean():.4f};peak={diff.max():.4f};starts={digest}"})
        at += n
    return out


MEDIA = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<{CLIP_FIELDS}>>"


def media_features(docs: DataFrame, budget: int = 1 << 20) -> DataFrame:
    """Store every text as an AVI file, read it back, and describe what was read; ``clips`` are the file's timed clip rows.

    A null text counts as empty, which is one frame of spaces. Rows keep their
    doc_id, null too; repeated rows give repeated results. Texts are taken
    together up to ``budget`` bytes; a longer one is taken alone.
    """
    schema = arrow_schema(MEDIA)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            texts = batch.column(1).cast(pa.binary())
            while at < len(ids):
                part, size = [], 0
                while at + len(part) < len(ids) and (not part or size < budget):
                    t = texts[at + len(part)].as_py() or b""
                    part.append(t)
                    size += len(t)
                rows = []
                files = store(part)
                for key, t, f, got in zip(ids[at : at + len(part)], part, files, read_back(files)):
                    p = got["payload"]
                    rows.append((key, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(f), hashlib.sha256(f).hexdigest(), got["feature"], got["clips"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                at += len(part)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(features, MEDIA)


def op2_media_columns(spark, sf_dir):
    return media_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
