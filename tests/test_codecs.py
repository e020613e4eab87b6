"""Stream codecs by round trips with independent encoders and by hand-made bytes."""

import base64
import zlib

import numpy as np

from quirefold.sources import codecs


def test_text_codecs():
    raw = bytes(range(256)) + bytes(8) + b"tail"
    assert codecs.base85_decode(base64.a85encode(raw) + b"~>") == raw
    assert codecs.hex_decode(b"48 65\n6C6c 6F7>zz") == b"Hellop"
    assert codecs.runs_decode(b"\x02abc\xfez\x80ignored") == b"abczzz"


def test_flate_keeps_partial_output():
    raw = b"some text " * 5000
    packed = zlib.compress(raw)
    assert codecs.flate(packed) == raw and codecs.flate(packed[2:-4]) == raw
    assert raw.startswith(codecs.flate(packed[: len(packed) // 2])) and codecs.flate(b"") == b""


def test_lzw():
    assert codecs.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_predictors():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 256, (4, 6), dtype=np.uint8)
    up = rows.copy()
    up[1:] -= rows[:-1]
    assert codecs.png_rows(b"".join(b"\x02" + r.tobytes() for r in up), 6) == rows.tobytes()
    sub = rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    assert codecs.png_rows(b"".join(b"\x01" + r.tobytes() for r in sub), 6) == rows.tobytes()
    assert codecs.tiff_rows(sub.tobytes(), 6) == rows.tobytes()
    paeth, average = bytearray(), bytearray()
    for y, row in enumerate(rows.astype(int)):
        paeth.append(4)
        average.append(3)
        for x, v in enumerate(row):
            a, b = (row[x - 1] if x else 0), (int(rows[y - 1][x]) if y else 0)
            c = int(rows[y - 1][x - 1]) if x and y else 0
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            paeth.append((v - near) % 256)
            average.append((v - (a + b) // 2) % 256)
    assert codecs.png_rows(bytes(paeth), 6) == rows.tobytes()
    assert codecs.png_rows(bytes(average), 6) == rows.tobytes()


def test_chain_stops_before_images(spark):
    raw = zlib.compress(b"data")
    frame = spark.createDataFrame([(raw.hex().encode(), ["AHx", "Fl"]), (b"jpeg", ["DCTDecode"]), (None, ["Fl"])], "raw binary, filters array<string>")
    got = [(None if r["decoded"] is None else bytes(r["decoded"]), r["remaining"]) for r in codecs.decode_streams(frame).collect()]
    assert got == [(b"data", []), (b"jpeg", ["DCTDecode"]), (None, ["Fl"])]
