"""Baseline JPEG in numpy: marker parsing, batched Huffman decoding, DC-only luminance thumbnails, lossless storage of bytes.

Decoding runs many entropy-coded segments in lockstep: a segment starts at a scan or a restart marker, and one step
decodes the next coefficient of every segment with table look-ups. Storage keeps each payload byte in one quantised
coefficient of a grey image (all quantiser steps 1): DC = byte - 128, AC = 256 + byte, with Huffman tables by which every
DC code has 9 bits in all and every AC code 10, and a restart marker after each 9 blocks, which hold 576 bytes.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

UNIT = 576
BLOCKS = 9
#: A segment's bits: 9 blocks of one DC code of 9 bits and 63 AC codes of 10, and one padding bit.
SEGMENT_BYTES = (BLOCKS * (9 + 63 * 10) + 7) // 8
#: Stacks of 3 x 3 blocks in a column; JPEG's height has 16 bits.
MOST_STACKS = 2_700
#: Segments decoded together; their state stays in the cache.
LOCKSTEP = 4_096


class BadImage(ValueError):
    pass


# ---- storing bytes -------------------------------------------------------------------------------------------------


def _segment(kind: int, body: bytes) -> bytes:
    return bytes((0xFF, kind)) + struct.pack(">H", len(body) + 2) + body


def _dc_bits() -> np.ndarray:
    """Nine bits for each DC difference from -255 to 255: category c has a code of 9 - c bits, ones and a zero."""
    rows = []
    for diff in range(-255, 256):
        c = abs(diff).bit_length()
        code = (((1 << (9 - c)) - 2) << c) | (diff if diff >= 0 else diff + (1 << c) - 1)
        rows.append([code >> (8 - k) & 1 for k in range(9)])
    return np.array(rows, np.uint8)


_DC_BITS = _dc_bits()
#: Counts of codes by length, then symbols: DC categories 8 to 0 in 1 to 9 bits; AC run 0 size 9, end of block, 16 zeros.
_DC_TABLE = bytes([1] * 9 + [0] * 7 + list(range(8, -1, -1)))
_AC_TABLE = bytes([1, 1, 1] + [0] * 13 + [0x09, 0x00, 0xF0])


def _entropy(units: np.ndarray) -> np.ndarray:
    """Bytes of each segment, before stuffing, for units of shape (n, 9, 64)."""
    n = len(units)
    bits = np.empty((n, BLOCKS, 639), np.uint8)
    level = units[:, :, 0].astype(np.int16) - 128
    bits[:, :, :9] = _DC_BITS[np.diff(level, axis=1, prepend=np.int16(0)) + 255]
    ac = bits[:, :, 9:].reshape(n, BLOCKS, 63, 10)
    ac[..., 0], ac[..., 1] = 0, 1
    ac[..., 2:] = np.unpackbits(np.ascontiguousarray(units[:, :, 1:])).reshape(n, BLOCKS, 63, 8)
    bits[:, :, 9:] = ac.reshape(n, BLOCKS, 630)
    flat = np.ones((n, SEGMENT_BYTES * 8), np.uint8)
    flat[:, : BLOCKS * 639] = bits.reshape(n, -1)
    return np.packbits(flat, axis=1)


def store(payload: bytes) -> bytes:
    """A JPEG that holds `payload`, whose length is a positive multiple of 576."""
    stacks = len(payload) // UNIT
    columns = -(-stacks // MOST_STACKS)
    rows = -(-stacks // columns)
    units = np.zeros((columns * rows, BLOCKS, 64), np.uint8)
    units[:stacks] = np.frombuffer(payload, np.uint8).reshape(stacks, BLOCKS, 64)
    total = len(units)
    body = np.empty((total, SEGMENT_BYTES + 2), np.uint8)
    for at in range(0, total, 512):
        body[at : at + 512, :SEGMENT_BYTES] = _entropy(units[at : at + 512])
    body[:, -2], body[:, -1] = 0xFF, 0xD0 + np.arange(total) % 8
    full = body == 0xFF
    full[:, -2] = False
    body, full = body.ravel()[:-2], full.ravel()[:-2]
    before = np.cumsum(full)
    stuffed = np.zeros(len(body) + int(before[-1]), np.uint8)
    stuffed[np.arange(len(body)) + before - full] = body
    head = (
        b"\xff\xd8"
        + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
        + _segment(0xFE, b"payload " + struct.pack(">Q", len(payload)))
        + _segment(0xDB, b"\0" + b"\1" * 64)
        + _segment(0xC0, struct.pack(">BHHB", 8, 24 * rows, 24 * columns, 1) + b"\1\x11\0")
        + _segment(0xC4, b"\x00" + _DC_TABLE + b"\x10" + _AC_TABLE)
        + _segment(0xDD, struct.pack(">H", BLOCKS))
        + _segment(0xDA, b"\1\1\0\0\x3f\0")
    )
    return head + stuffed.tobytes() + b"\xff\xd9"


# ---- parsing -------------------------------------------------------------------------------------------------------


@dataclass
class Image:
    width: int = 0
    height: int = 0
    #: Of the frame's components: id, horizontal and vertical sampling, quantiser table.
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, bytes] = field(default_factory=dict)
    interval: int = 0
    comment: bytes = b""
    #: Of the scan's components: index in parts, DC table, AC table.
    scan: list[tuple[int, int, int]] = field(default_factory=list)
    data: np.ndarray | None = None
    starts: np.ndarray | None = None

    def grid(self) -> tuple[int, int, list[tuple[int, int, int]]]:
        """Coding units across and down, and of each block of a unit: scan component, row, column."""
        if len(self.scan) == 1:
            i = self.scan[0][0]
            most = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
            w, h = -(-self.width * self.parts[i][1] // most[0]), -(-self.height * self.parts[i][2] // most[1])
            return -(-w // 8), -(-h // 8), [(0, 0, 0)]
        across, down = 8 * max(p[1] for p in self.parts), 8 * max(p[2] for p in self.parts)
        blocks = [(s, y, x) for s, (i, _, _) in enumerate(self.scan) for y in range(self.parts[i][2]) for x in range(self.parts[i][1])]
        return -(-self.width // across), -(-self.height // down), blocks


def parse(raw: bytes) -> Image:
    """Markers up to the first scan, and that scan's bytes without stuffing, with the places where segments start."""
    if raw[:2] != b"\xff\xd8":
        raise BadImage("no start of image")
    image, at = Image(), 2
    while True:
        while raw[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(raw) or raw[at] != 0xFF:
            raise BadImage("no marker where one is due")
        kind, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                image.quantisers[name] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif kind == 0xC0 or kind == 0xC1:
            depth, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not image.width or not image.height:
                raise BadImage("not an 8-bit baseline frame")
            image.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise BadImage("not a baseline frame")
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                image.huffman[body[0]] = body[1:n]
                body = body[n:]
        elif kind == 0xDD:
            image.interval = struct.unpack(">H", body[:2])[0]
        elif kind == 0xFE:
            image.comment = body
        elif kind == 0xDA:
            names = [p[0] for p in image.parts]
            image.scan = [(names.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            break
        elif kind == 0xD9:
            raise BadImage("no scan")
    scan = np.frombuffer(raw, np.uint8, offset=at)
    full = np.flatnonzero(scan[:-1] == 0xFF)
    follow = scan[full + 1]
    ends = full[(follow != 0) & (follow != 0xFF) & ((follow < 0xD0) | (follow > 0xD7))]
    if not len(ends):
        raise BadImage("no end of image")
    scan = scan[: ends[0]]
    full, follow = full[full < ends[0]], follow[full < ends[0]]
    keep = np.ones(len(scan) + 1, bool)
    keep[full[follow == 0] + 1] = False
    restart = full[(follow >= 0xD0) & (follow <= 0xD7)]
    keep[restart] = keep[restart + 1] = False
    image.data = scan[keep[: len(scan)]]
    image.starts = np.concatenate([[0], restart - np.cumsum(~keep)[restart] + 1]) if len(restart) else np.zeros(1, np.int64)
    return image


# ---- Huffman decoding in lockstep ----------------------------------------------------------------------------------


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 coming bits: value << 16 | run << 8 | bits used with the value, or bits | 0x80 where the value's bits don't fit."""
    out = np.zeros(1 << 16, np.int64)
    code, at = 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            symbol = table[at]
            at += 1
            size, low, n = symbol & 15, code << (16 - length), 1 << (16 - length)
            if length + size <= 16:
                more = (np.arange(n) >> (16 - length - size)) & ((1 << size) - 1)
                value = np.where(more >= (1 << size >> 1), more, more - (1 << size) + 1) if size else np.zeros(n, np.int64)
                out[low : low + n] = (value << 16) | (symbol >> 4) << 8 | (length + size) | (0x40 if not size else 0)
            else:
                out[low : low + n] = (size << 16) | (symbol >> 4) << 8 | length | 0x80
            code += 1
        code <<= 1
    return out


def _read(words: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Next bit position, value, run of zeros, and whether the symbol carries a value."""
    found = table[(words[at >> 3] >> (16 - (at & 7))) & 0xFFFF]
    used = found & 0x3F
    if not used.all():
        raise BadImage("no such Huffman code")
    value, run = found >> 16, (found >> 8) & 0xF
    at = at + used
    late = (found & 0x80) != 0
    if late.any():
        size = np.where(late, value, 0)
        more = (words[at >> 3] >> (32 - (at & 7) - size)) & ((1 << size) - 1)
        value = np.where(late, np.where(more >= (1 << size >> 1), more, more - (1 << size) + 1), value)
        at = at + size
    return at, value, run, (found & 0x40) == 0


def _decode_segments(words: np.ndarray, at: np.ndarray, blocks: np.ndarray, pattern: list[int], tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Coefficients (segment, block, 64) in zigzag order; DC values are summed up. `blocks` falls from segment to segment."""
    out = np.zeros((len(at), int(blocks[0]), 64), np.int16)
    last = np.zeros((len(tables), len(at)), np.int64)
    for b in range(int(blocks[0])):
        n = int(np.searchsorted(-blocks, -b, "left"))
        part = pattern[b % len(pattern)]
        dc, ac = tables[part]
        now, value, _, _ = _read(words, at[:n], dc)
        last[part, :n] += value
        out[:n, b, 0] = last[part, :n]
        live, k = None, np.ones(n, np.int64)  # None: all segments
        while True:
            now_live = now if live is None else now[live]
            now_live, value, run, real = _read(words, now_live, ac)
            rows = np.arange(n) if live is None else live
            to = k[rows] + run
            if real.all():
                if (to > 63).any():
                    raise BadImage("a block of over 64 coefficients")
                out[rows, b, to] = value
                to = to + 1
            else:
                if (to[real] > 63).any():
                    raise BadImage("a block of over 64 coefficients")
                out[rows[real], b, to[real]] = value[real]
                to = np.where(real | (run == 15), to + 1, 64)
            if live is None:
                now, k = now_live, to
            else:
                now[live], k[live] = now_live, to
            going = to < 64
            if not going.any():
                break
            if live is not None or not going.all():
                live = rows[going]
        at[:n] = now
    return out


@dataclass
class Decoded:
    image: Image
    #: Coefficients of the luminance component, blocks in coding order, (block, 64) in zigzag order.
    coefficients: np.ndarray
    #: One brightness per block, (rows, columns).
    thumbnail: np.ndarray


def decode(images: list[bytes]) -> list[Decoded | None]:
    """Each image decoded, None for one that isn't baseline JPEG. Images of equal tables are decoded together."""
    out: list[Decoded | None] = [None] * len(images)
    groups: dict[tuple, list[tuple[int, Image]]] = {}
    for k, raw in enumerate(images):
        try:
            image = parse(raw)
            pattern = [s for s, _, _ in image.grid()[2]]
            tables = tuple((image.huffman[d], image.huffman[16 + a]) for _, d, a in image.scan)
        except (BadImage, KeyError, IndexError, ValueError, struct.error):
            continue
        groups.setdefault((tables, tuple(pattern)), []).append((k, image))
    for (tables, pattern), found in groups.items():
        lookups = [(_lookup(d), _lookup(a)) for d, a in tables]
        some: list[tuple[int, Image]] = []
        count = 0
        for item in found:
            some.append(item)
            count += len(item[1].starts)
            if count >= LOCKSTEP:
                _decode_group(some, lookups, list(pattern), out)
                some, count = [], 0
        _decode_group(some, lookups, list(pattern), out)
    return out


def _decode_group(found: list[tuple[int, Image]], lookups: list, pattern: list[int], out: list[Decoded | None]) -> None:
    if not found:
        return
    data, at, blocks, own = [], [], [], []
    base = 0
    for n, (_, image) in enumerate(found):
        across, down, _ = image.grid()
        units = across * down
        interval = image.interval or units
        segments = -(-units // interval)
        starts = image.starts[:segments]
        data += [image.data, np.full(8, 0xFF, np.uint8)]
        at.append((base + starts) * 8)
        blocks.append(np.minimum(interval, units - interval * np.arange(len(starts))) * len(pattern))
        own.append(np.full(len(starts), n))
        base += len(image.data) + 8
    joined = np.concatenate([*data, np.zeros(8, np.uint8)]).astype(np.int64)
    words = joined[:-3] << 24 | joined[1:-2] << 16 | joined[2:-1] << 8 | joined[3:]
    at, blocks, own = np.concatenate(at), np.concatenate(blocks), np.concatenate(own)
    order = np.argsort(-blocks, kind="stable")
    try:
        got = _decode_segments(words, at[order].copy(), blocks[order], pattern, lookups)
    except (BadImage, IndexError):
        if len(found) > 1:  # one damaged image must not cost the others
            for item in found:
                _decode_group([item], lookups, pattern, out)
        return
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    for n, (k, image) in enumerate(found):
        across, down, cells = image.grid()
        mine = np.flatnonzero(own == n)
        if len(mine) < -(-across * down // (image.interval or across * down)):
            continue
        coefficients = np.concatenate([got[place[s], : blocks[s]] for s in mine])
        luma = [c for c, cell in enumerate(cells) if cell[0] == 0]
        part = coefficients.reshape(across * down, len(cells), 64)[:, luma].reshape(-1, 64)
        v, h = 1 + max(cells[c][1] for c in luma), 1 + max(cells[c][2] for c in luma)
        dc = part[:, 0].astype(np.int64) * int(image.quantisers[image.parts[image.scan[0][0]][3]][0])
        dc = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        out[k] = Decoded(image, part, np.clip((dc + 4 + 1024) >> 3, 0, 255).astype(np.uint8))


def stored_payload(found: Decoded) -> bytes:
    """The bytes that `store` put into this image."""
    if found.image.comment[:8] != b"payload ":
        raise BadImage("no stored payload")
    n = struct.unpack(">Q", found.image.comment[8:16])[0]
    values = found.coefficients[: n // 64].copy()
    values[:, 0] += 128
    values[:, 1:] -= 256
    return values.astype(np.uint8).tobytes()


def _shrink(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over equal parts; a side shorter than wanted is repeated."""
    for axis, want in ((0, rows), (1, columns)):
        n = image.shape[axis]
        if n < want:
            image = np.take(image, np.arange(want) * n // want, axis)
        else:
            edges = np.arange(want) * n // want
            sums = np.add.reduceat(image.astype(np.float64), edges, axis)
            width = np.diff(np.append(edges, n))
            image = sums / (width[:, None] if axis == 0 else width)
    return image


def feature(found: Decoded) -> str:
    """Width x height, then two 64-bit hashes of the thumbnail: brighter than the mean, and brighter than the left neighbour."""
    mean = _shrink(found.thumbnail, 8, 8)
    step = _shrink(found.thumbnail, 8, 9)
    bits = lambda x: np.packbits(x.ravel()).tobytes().hex()
    return f"{found.image.width}x{found.image.height}:{bits(mean > mean.mean())}:{bits(step[:, 1:] > step[:, :-1])}"
