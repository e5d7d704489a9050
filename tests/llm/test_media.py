import hashlib
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import jpeg, media

#: A Huffman table pair that has all categories a test needs, all codes of 8 bits.
DC = bytes([0] * 7 + [12] + [0] * 8 + list(range(12)))
AC_SYMBOLS = [0x00, 0xF0] + [run << 4 | size for run in range(8) for size in range(1, 9)]
AC = bytes([0] * 7 + [len(AC_SYMBOLS)] + [0] * 8 + AC_SYMBOLS)


def plain_jpeg(blocks: list, width: int, height: int, parts: list, quantiser: int, interval: int = 0) -> bytes:
    """A JPEG of coefficient blocks in coding order [(component, 64 values in zigzag order)], written bit by bit."""
    out, bits, last, done = bytearray(), "", {}, 0

    def extra(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        for k in range(0, len(bits), 8):
            out.append(int(bits[k : k + 8], 2))
            if out[-1] == 0xFF:
                out.append(0)
        bits = ""

    per_unit = sum(h * v for _, h, v, _ in parts)
    for k, (part, values) in enumerate(blocks):
        if interval and k and k % (interval * per_unit) == 0:
            flush()
            out.extend((0xFF, 0xD0 + done % 8))
            done, last = done + 1, {}
        size, more = extra(values[0] - last.get(part, 0))
        last[part] = values[0]
        bits += format(size, "08b") + more
        run = 0
        for i, v in enumerate(values[1:], 1):
            if not any(values[i:]):
                bits += format(0, "08b")
                break
            if v == 0:
                run += 1
                continue
            while run > 15:
                bits += format(1, "08b")
                run -= 16
            while run > 7:  # the table has runs to 7 only; a longer run below 16 can't be written
                raise AssertionError
            size, more = extra(v)
            bits += format(AC_SYMBOLS.index(run << 4 | size), "08b") + more
            run = 0
    flush()
    head = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0]) + bytes([quantiser]) * 64)
    head += jpeg._segment(0xC0, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([c, h << 4 | v, q]) for c, h, v, q in parts))
    head += jpeg._segment(0xC4, b"\x00" + DC + b"\x10" + AC)
    if interval:
        head += jpeg._segment(0xDD, struct.pack(">H", interval))
    head += jpeg._segment(0xDA, bytes([len(parts)]) + b"".join(bytes([p[0], 0]) for p in parts) + b"\0\x3f\0")
    return head + bytes(out) + b"\xff\xd9"


@pytest.mark.parametrize("n", [1, 2, 41, 2701])
def test_round_trip(n):
    payload = os.urandom(576 * n - 40) + b"\xff" * 40
    (found,) = jpeg.decode([jpeg.store(payload)])
    assert jpeg.stored_payload(found) == payload
    assert found.image.width % 24 == 0


@pytest.mark.parametrize("interval", [0, 2])
def test_grey_blocks(interval):
    r = np.random.default_rng(1)
    blocks = []
    for _ in range(12):
        v = [int(r.integers(-200, 200))] + [0] * 63
        for _ in range(3):
            v[int(r.integers(1, 8))] = int(r.integers(-100, 100))
        v[7], v[24] = 5, 3  # a run of 16 zeros and none after it
        blocks.append((0, v))
    (found,) = jpeg.decode([plain_jpeg(blocks, 30, 20, [(1, 1, 1, 0)], 4, interval)])
    assert found.thumbnail.shape == (3, 4)
    assert found.coefficients.tolist() == [v for _, v in blocks]
    want = [np.clip((v[0] * 4 + 4 + 1024) >> 3, 0, 255) for _, v in blocks]
    assert found.thumbnail.ravel().tolist() == want


def test_subsampled_colour():
    parts = [(1, 2, 2, 0), (2, 1, 1, 0), (3, 1, 1, 0)]
    blocks, level = [], {}
    for unit in range(2):
        for y in range(2):
            for x in range(2):
                level[y, 2 * unit + x] = 10 * (4 * unit + 2 * y + x)
                blocks.append((0, [level[y, 2 * unit + x]] + [0] * 63))
        blocks += [(1, [77] + [0] * 63), (2, [-9] + [0] * 63)]
    (found,) = jpeg.decode([plain_jpeg(blocks, 32, 16, parts, 8)])
    assert found.thumbnail.tolist() == [[level[y, x] + 128 for x in range(4)] for y in range(2)]


def test_damaged_images_do_not_stop_others():
    good = jpeg.store(b"\1" * 576)
    found = jpeg.decode([b"", b"GIF89a", good[:200], good, good[:-40] + b"\xff\xd9", b"\xff\xd8\xff\xc2" + good[4:]])
    assert [f is not None for f in found][3] and not found[0] and not found[1] and not found[2] and not found[5]


def test_operator(spark, make_docs):
    texts = ["", None, "a" * 575, "b" * 576, "ä" * 300, "x" * 50_000, "b" * 576]
    docs = make_docs(texts).withColumns({"media": F.lit("clash"), "feature": F.lit(1), "n_bytes": F.lit(0)})
    got = {r.doc_id: r for r in media.media_features(media.store_payload(docs), ["doc_id", "n_bytes"]).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[3].feature == got[6].feature and got[3].media_sha256 == got[6].media_sha256
    odd = spark.createDataFrame([(1, None), (2, b"no image")], "doc_id long, media binary")
    assert [r.feature for r in media.media_features(odd, ["doc_id"]).collect()] == [None, None]
    assert media.media_features(media.store_payload(docs.limit(0)), ["doc_id"]).count() == 0
