"""Stream codecs: chains of byte filters over a binary column, as an Arrow function.

A chain is an array of filter names in the order of decoding. Image filters are never decoded: decoding stops before
them and reports what is left. Corrupt Flate data gives what could be read of it.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Filter names and their abbreviations.
NAMES = {
    "FlateDecode": "flate", "Fl": "flate", "LZWDecode": "lzw", "LZW": "lzw", "ASCIIHexDecode": "hex", "AHx": "hex",
    "ASCII85Decode": "base85", "A85": "base85", "RunLengthDecode": "runs", "RL": "runs",
}
IMAGES = ("DCTDecode", "DCT", "JPXDecode", "JBIG2Decode", "CCITTFaxDecode", "CCF")
MOST = 512 << 20  # bytes that one stream may inflate to


def flate(data: bytes) -> bytes:
    """Inflate; without a valid header the raw form is tried, and partial output is kept."""
    for bits in (15, -15):
        engine, out = zlib.decompressobj(bits), b""
        for i in range(0, len(data), 4096):
            try:
                out += engine.decompress(data[i : i + 4096], MOST - len(out))
            except zlib.error:
                break
            if engine.eof or len(out) >= MOST:
                break
        if out:
            return out
    return b""


def lzw(data: bytes, early: int = 1) -> bytes:
    """Variable-width LZW from 9 to 12 bits; `early` widens the codes one entry sooner."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, before, width, held, bits = [], None, 9, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, before, width = table[:258], None, 9
            continue
        if code < len(table):
            entry = table[code]
        elif before is not None and code == len(table):
            entry = before + before[:1]
        else:
            break
        out.append(entry)
        if before is not None and len(table) < 4096:
            table.append(before + entry[:1])
        before = entry
        width = min(12, max(9, (len(table) + early).bit_length()))
    return b"".join(out)


def hex_decode(data: bytes) -> bytes:
    """Hex digits up to '>', other bytes skipped, an odd last digit padded with 0."""
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.partition(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def base85_decode(data: bytes) -> bytes:
    """Base-85 groups up to '~>'; 'z' is four zero bytes, a short last group gives one byte less than its digits."""
    out, group = bytearray(), []
    for c in data.partition(b"~")[0]:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                out += (sum(d * 85 ** (4 - i) for i, d in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group) - 1
        group += [84] * (5 - len(group))
        out += (sum(d * 85 ** (4 - i) for i, d in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[:n]
    return bytes(out)


def runs_decode(data: bytes) -> bytes:
    """Length-prefixed literals (0-127) and repeats (129-255); 128 ends."""
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def png_rows(data: bytes, columns: int, colors: int = 1, bits: int = 8) -> bytes:
    """Undo PNG row filters; each row begins with its filter's number."""
    step = max(1, colors * bits // 8)
    width = (columns * colors * bits + 7) // 8
    above, out = np.zeros(width, dtype=np.int64), []
    for at in range(0, len(data), width + 1):
        kind, row = data[at], np.frombuffer(data[at + 1 : at + 1 + width].ljust(width, b"\0"), dtype=np.uint8).astype(np.int64)
        if kind == 2:
            row = (row + above) & 255
        elif kind == 1:
            for lane in range(step):
                row[lane::step] = np.cumsum(row[lane::step]) & 255
        elif kind in (3, 4):
            for i in range(width):
                a = row[i - step] if i >= step else 0
                b, c = above[i], above[i - step] if i >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                row[i] = (row[i] + guess) & 255
        above = row
        out.append(row.astype(np.uint8).tobytes())
    return b"".join(out)


def tiff_rows(data: bytes, columns: int, colors: int = 1) -> bytes:
    """Undo horizontal differencing of 8-bit samples."""
    width = columns * colors
    rows = np.frombuffer(data[: len(data) // width * width], dtype=np.uint8).reshape(-1, columns, colors)
    return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()


DECODERS = {"flate": flate, "lzw": lzw, "hex": hex_decode, "base85": base85_decode, "runs": runs_decode}


def decode(data: bytes | None, chain: list[str]) -> tuple[bytes | None, list[str]]:
    """Decoded bytes and the filters that are left, from the first image or unknown filter on."""
    if data is None:
        return None, list(chain)
    for i, name in enumerate(chain):
        if name not in NAMES:
            return data, list(chain[i:])
        data = DECODERS[NAMES[name]](data)
    return data, []


def decode_streams(streams: DataFrame, data_col: str = "raw", chain_col: str = "filters") -> DataFrame:
    """Append `decoded` (binary) and `remaining` (array<string>); narrow, null data stays null."""

    @F.pandas_udf("decoded binary, remaining array<string>")
    def run(data: pd.Series, chains: pd.Series) -> pd.DataFrame:
        rows = [decode(d, [] if c is None else list(c)) for d, c in zip(data, chains, strict=True)]
        return pd.DataFrame(rows, columns=["decoded", "remaining"])

    out = streams.withColumn("__out", run.asNondeterministic()(F.col(data_col), F.col(chain_col)))
    return out.select(*streams.columns, "__out.decoded", "__out.remaining")
