"""Baseline JPEG on numpy: many scans of one layout are decoded in lockstep, one symbol of each at a time.

Decoder: sequential Huffman, 8 bits a sample, one or more components with any
sampling, restart intervals, own or usual Huffman tables. Encoder: grey mosaics,
in which each sample fills one 8 x 8 block, exactly.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the JPEG standard (ITU-T T.81): zigzag order by rule, usual Huffman tables (annex K.3).
ZIGZAG = np.array([8 * y + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
DC_LUMA = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], bytes(range(12)))
DC_CHROMA = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], bytes(range(12)))
AC_LUMA = ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a43444546474849"
    "4a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5"
    "c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"))
AC_CHROMA = ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], bytes.fromhex(
    "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748".replace(" ", "")
    + "494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4"
    "c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"))


def lookup(counts, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length by the next 16 bits; length 0 marks no code."""
    sym, size, at, code = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            lo = code << (16 - n)
            hi = (code + 1) << (16 - n)
            sym[lo:hi], size[lo:hi] = symbols[at], n
            at, code = at + 1, code + 1
        code <<= 1
    return sym, size


@dataclass
class Layout:
    """What a frame's header says; equal headers share one object."""

    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # [id, h, v, quantiser]
    quantisers: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)  # (class, id): lookup
    scan: list = field(default_factory=list)  # [component, dc table, ac table]
    restart: int = 0
    scan_at: int = 0


class Unsupported(ValueError):
    """A frame that is no baseline JPEG, or is cut short."""


def parse_header(frame: bytes) -> Layout:
    out, at = Layout(), 2
    out.tables = {(0, 0): lookup(*DC_LUMA), (0, 1): lookup(*DC_CHROMA), (1, 0): lookup(*AC_LUMA), (1, 1): lookup(*AC_CHROMA)}
    if frame[:2] != b"\xff\xd8":
        raise Unsupported("no start of image")
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise Unsupported("no marker where one must be")
        marker = frame[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                n = 128 if wide else 64
                out.quantisers[body[i] & 15] = np.frombuffer(body[i + 1 : i + 1 + n], ">u2" if wide else "u1").astype(np.int32)
                i += 1 + n
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                counts = list(body[i + 1 : i + 17])
                out.tables[body[i] >> 4, body[i] & 15] = lookup(counts, body[i + 17 : i + 17 + sum(counts)])
                i += 17 + sum(counts)
        elif marker == 0xC0 or marker == 0xC1:
            bits, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not out.height or not out.width:
                raise Unsupported("samples are not of 8 bits or the size is open")
            out.components = [[body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]] for k in range(n)]
        elif 0xC0 < marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise Unsupported("not a baseline frame")
        elif marker == 0xDD:
            out.restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            ids = [c[0] for c in out.components]
            n = body[0]
            if n != len(ids) or not n:
                raise Unsupported("components in separate scans")
            out.scan = [[ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15] for k in range(n)]
            out.scan_at = at + 2 + size
            return out
        at += 2 + size
    raise Unsupported("no scan")


@dataclass
class Coefficients:
    """Quantised coefficients of frames of one layout: dense first ones, sparse others in zigzag places."""

    dc: np.ndarray  # frame, block in scan order
    frame: np.ndarray
    block: np.ndarray
    place: np.ndarray
    value: np.ndarray


def plan(layout: Layout) -> tuple[list[tuple[int, int]], int, int]:
    """(component, blocks across) for each block of an MCU; MCUs across and down."""
    hs, vs = max(c[1] for c in layout.components), max(c[2] for c in layout.components)
    single = len(layout.components) == 1
    across, down = (8, 8) if single else (8 * hs, 8 * vs)
    order = [k for k, (c, _, _) in enumerate(layout.scan) for _ in range(1 if single else layout.components[c][1] * layout.components[c][2])]
    return order, -(-layout.width // across), -(-layout.height // down)


def decode_scans(scans: list[bytes], layout: Layout) -> Coefficients:
    """Coefficients of scans (entropy-coded bytes, up to the end marker) of one layout."""
    order, across, down = plan(layout)
    per_mcu, mcus = len(order), across * down
    blocks = per_mcu * mcus
    raw = np.frombuffer(b"".join(scans), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in scans])])[:-1]
    after = np.concatenate([[False], raw[:-1] == 0xFF])
    after[starts[starts < len(raw)]] = False
    marks = after & (raw >= 0xD0) & (raw <= 0xD7)
    drop = (after & (raw == 0)) | marks
    drop[:-1] |= marks[1:]
    segment_at = np.sort(np.concatenate([starts, np.nonzero(marks)[0] + 1]))
    kept = np.cumsum(~drop)
    kept = np.concatenate([[0], kept])
    data = np.concatenate([raw[~drop], np.zeros(8, np.uint8)]).astype(np.int64)
    window = (data[:-4] << 24) | (data[1:-3] << 16) | (data[2:-2] << 8) | data[3:-1]
    begin = kept[segment_at] * 8
    limit = np.concatenate([begin[1:], [kept[-1] * 8]])
    owner = np.searchsorted(starts, segment_at, "right") - 1
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    step = layout.restart or mcus
    first_block = nth * step * per_mcu
    if np.any(first_block >= blocks) or np.any(np.bincount(owner, minlength=len(scans)) != -(-mcus // step)):
        raise Unsupported("restart intervals do not fit the size")
    todo = np.minimum(blocks - first_block, step * per_mcu)
    dc = np.zeros((len(scans), blocks), np.int32)
    sparse: list[tuple] = []
    tables = [(layout.tables[0, layout.scan[k][1]], layout.tables[1, layout.scan[k][2]]) for k in range(len(layout.scan))]
    pos, done, k = begin.copy(), np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    pred = np.zeros((len(owner), len(layout.scan)), np.int32)
    component = np.array(order)
    live = np.arange(len(owner))
    width = len(window) - 1

    def bits(at, n):
        return (window[np.minimum(at >> 3, width)] >> (32 - (at & 7) - n)) & ((1 << n) - 1)

    def extended(at, n):
        v = bits(at, n)
        return np.where(v < (1 << np.maximum(n - 1, 0)), v - (1 << n) + 1, v) * (n > 0)

    while len(live):
        for c in range(len(layout.scan)):
            mine = live if len(layout.scan) == 1 else live[component[done[live] % per_mcu] == c]
            (dc_sym, dc_len), (ac_sym, ac_len) = tables[c]
            for at_dc in (True, False):
                these = mine[(k[mine] == 0) == at_dc]
                if not len(these):
                    continue
                p = pos[these]
                peek = bits(p, 16)
                sym, size = (dc_sym, dc_len) if at_dc else (ac_sym, ac_len)
                s, n = sym[peek], size[peek]
                if not n.all() or np.any(p >= limit[these]):
                    raise Unsupported("a code that the tables lack, or a scan cut short")
                p = p + n
                if at_dc:
                    pred[these, c] += extended(p, s)
                    dc[owner[these], first_block[these] + done[these]] = pred[these, c]
                    pos[these] = p + s
                    k[these] = 1
                else:
                    run, bitsize = s >> 4, s & 15
                    place = np.where(bitsize > 0, k[these] + run, np.where(run == 15, k[these] + 15, 63))
                    if np.any(place > 63):
                        raise Unsupported("coefficients past the block")
                    hit = np.nonzero(bitsize)[0]
                    if len(hit):
                        t = these[hit]
                        sparse.append((owner[t], first_block[t] + done[t], place[hit], extended(p[hit], bitsize[hit])))
                    pos[these] = p + bitsize
                    place = place + 1
                    over = place > 63
                    k[these] = np.where(over, 0, place)
                    done[these] += over
        live = live[done[live] < todo[live]]
    joined = [np.concatenate(x) for x in zip(*sparse)] if sparse else [np.zeros(0, np.int64)] * 4
    return Coefficients(dc, *joined)


_BASIS = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


def block_samples(c: Coefficients, layout: Layout) -> np.ndarray:
    """Samples 0..255 of every block, (frame, block in scan order, 8, 8)."""
    order, across, down = plan(layout)
    quant = np.array([layout.quantisers[layout.components[layout.scan[k][0]][3]] for k in order])[np.arange(c.dc.shape[1]) % len(order)]
    flat = np.rint(np.clip(c.dc * quant[:, 0] / 8 + 128, 0, 255)).astype(np.uint8)
    out = np.repeat(flat[:, :, None], 64, axis=2).reshape(*flat.shape, 8, 8)
    if len(c.frame):
        where, inverse = np.unique(c.frame * c.dc.shape[1] + c.block, return_inverse=True)
        f, b = where // c.dc.shape[1], where % c.dc.shape[1]
        spectra = np.zeros((len(where), 64))
        spectra[:, 0] = c.dc[f, b] * quant[b, 0]
        spectra[inverse, ZIGZAG[c.place]] = c.value * quant[c.block, c.place]
        pixels = _BASIS @ spectra.reshape(-1, 8, 8) @ _BASIS.T
        out[f, b] = np.rint(np.clip(pixels + 128, 0, 255)).astype(np.uint8)
    return out


def planes(c: Coefficients, layout: Layout) -> list[np.ndarray]:
    """One (frame, height, width) array of samples for each component, at its own sampling."""
    order, across, down = plan(layout)
    samples = block_samples(c, layout).reshape(len(c.dc), down, across, len(order), 8, 8)
    hs, vs = max(x[1] for x in layout.components), max(x[2] for x in layout.components)
    out, at = [], 0
    for comp, _, _ in layout.scan:
        _, h, v, _ = layout.components[comp]
        h, v, w_all, h_all = (1, 1, layout.width, layout.height) if len(layout.components) == 1 else (h, v, -(-layout.width * h // hs), -(-layout.height * v // vs))
        part = samples[:, :, :, at : at + h * v].reshape(len(c.dc), down, across, v, h, 8, 8)
        out.append(part.transpose(0, 1, 3, 5, 2, 4, 6).reshape(len(c.dc), down * v * 8, across * h * 8)[:, :h_all, :w_all])
        at += h * v
    return out


def mosaic_header(width: int, height: int) -> bytes:
    """Header of a grey frame of flat blocks: first coefficients in steps of 8, which are sample steps of 1."""
    dqt = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8] + [1] * 63)
    sof = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + bytes([1, 0x11, 0])
    dht = b"\xff\xc4" + struct.pack(">HB", 28, 0x00) + bytes([0, 0, 0, 9, *[0] * 12]) + bytes(range(9))
    dht += b"\xff\xc4" + struct.pack(">HB", 20, 0x10) + bytes([1, *[0] * 15]) + b"\0"
    sos = b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0x00, 0, 63, 0])
    return b"\xff\xd8" + dqt + sof + dht + sos


def encode_mosaics(samples: np.ndarray, header: bytes) -> list[bytes]:
    """A frame for each row of 8-bit ``samples``, a flat block for each sample.

    Code of a block: 4 bits of category, the category's bits, one end bit.
    """
    q = samples.astype(np.int32) - 128
    d = np.diff(q, axis=1, prepend=0)
    size = np.ceil(np.log2(np.abs(d) + 1)).astype(np.int32)
    low = np.where(d < 0, d + (1 << size) - 1, d)
    code, length = (((size << size) | low) << 1), size + 5
    pad = -length.sum(1) % 8
    code = np.column_stack([code, (1 << pad) - 1]).ravel()
    length = np.column_stack([length, pad]).ravel()
    ends = np.cumsum(length)
    place = np.repeat(ends, length) - np.arange(ends[-1]) - 1
    packed = np.packbits(((np.repeat(code, length) >> place) & 1).astype(np.uint8))
    cuts = (ends[samples.shape[1] :: samples.shape[1] + 1] // 8).tolist()
    data, at, out = packed.tobytes(), 0, []
    for end in cuts:
        out.append(header + data[at:end].replace(b"\xff", b"\xff\x00") + b"\xff\xd9")
        at = end
    return out
