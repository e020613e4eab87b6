"""Fonts of a page: codes from bytes, widths, and text by /ToUnicode, encodings and glyph names."""

from __future__ import annotations

import re
import unicodedata
from typing import Any

from quirefold.pdf.document import Document
from quirefold.pdf.objects import End, Keyword, Name, PdfError, Reader, Stream, from_hex

# Names of ASCII glyphs that aren't letters, and of common typographic ones.
NAMED = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[",
    "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|",
    "braceright": "}", "asciitilde": "~", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”",
    "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "Euro": "€", "germandbls": "ß", "ae": "æ",
    "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "fi": "ﬁ", "fl": "ﬂ", "ff": "ﬀ",
    "ffi": "ﬃ", "ffl": "ﬄ", "dotlessi": "ı", "section": "§", "paragraph": "¶", "degree": "°", "nbspace": " ",
}
# Accents in glyph names, as combining marks.
ACCENTS = {
    "grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇",
    "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "ogonek": "̨",
}
CODECS = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}
AUTHORITATIVE = ("to-unicode", "differences", "base")


def glyph_text(name: str) -> str | None:
    """Text of a glyph name: fixed names, letters with accents, uniXXXX and uXXXXX, ligature parts; suffixes are dropped."""
    name = name.partition(".")[0]
    if not name:
        return None
    if "_" in name:
        parts = [glyph_text(p) for p in name.split("_")]
        return None if None in parts else "".join(parts)
    if name in NAMED:
        return NAMED[name]
    if len(name) == 1 and name.isascii() and name.isalpha():
        return name
    hexed = re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name)
    if hexed:
        codes = [int(hexed.group(2), 16)] if hexed.group(2) else [int(hexed.group(1)[i : i + 4], 16) for i in range(0, len(hexed.group(1)), 4)]
        if any(c > 0x10FFFF or 0xD800 <= c <= 0xDFFF for c in codes):
            return None
        return "".join(map(chr, codes))
    if name[1:] in ACCENTS and name[0].isalpha():
        whole = unicodedata.normalize("NFC", name[0] + ACCENTS[name[1:]])
        return whole if len(whole) == 1 else None
    try:
        return unicodedata.lookup(f"GREEK {'CAPITAL' if name[0].isupper() else 'SMALL'} LETTER {name.upper()}")
    except KeyError:
        return None


#: A section of single codes with their texts.
_CHARS = re.compile(rb"[\0\t\n\f\r ]*+beginbfchar[\0\t\n\f\r ]*+((?:<[0-9A-Fa-f]*+>[\0\t\n\f\r ]*+<[0-9A-Fa-f]*+>[\0\t\n\f\r ]*+)*+)endbfchar(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_PAIR = re.compile(rb"<([0-9A-Fa-f]*+)>[\0\t\n\f\r ]*+<([0-9A-Fa-f]*+)>")


class CMap:
    """Code spaces, and texts or character ids by code."""

    def __init__(self, data: bytes):
        self.spaces: list[tuple[int, int, int]] = []
        self.texts: dict[int, str] = {}
        self.cids: dict[int, int] = {}
        reader, held = Reader(data, refs=False), []
        while True:
            if found := _CHARS.match(data, reader.pos):
                for code, text in _PAIR.findall(found[1]):
                    self._text(from_hex(code), from_hex(text))
                reader.pos, held = found.end(), []
                continue
            try:
                item = reader.value()
            except End:
                break
            except PdfError:
                continue
            if not isinstance(item, Keyword):
                held.append(item)
                continue
            if item == b"endcodespacerange":
                for lo, hi in self._groups(held, 2):
                    if isinstance(lo, bytes) and isinstance(hi, bytes):
                        self.spaces.append((len(lo), int.from_bytes(lo, "big"), int.from_bytes(hi, "big")))
            elif item == b"endbfchar":
                for code, text in self._groups(held, 2):
                    self._text(code, text)
            elif item == b"endbfrange":
                for lo, hi, to in self._groups(held, 3):
                    self._range(lo, hi, to)
            elif item == b"endcidchar":
                for code, cid in self._groups(held, 2):
                    if isinstance(code, bytes) and isinstance(cid, int):
                        self.cids[int.from_bytes(code, "big")] = cid
            elif item == b"endcidrange":
                for lo, hi, cid in self._groups(held, 3):
                    if isinstance(lo, bytes) and isinstance(hi, bytes) and isinstance(cid, int):
                        a, b = int.from_bytes(lo, "big"), int.from_bytes(hi, "big")
                        for code in range(a, min(b, a + 0xFFFF) + 1):
                            self.cids[code] = cid + code - a
            held = []
        self.sizes = sorted({n for n, _, _ in self.spaces})

    @staticmethod
    def _groups(held: list, n: int) -> list[tuple]:
        return list(zip(*(held[i::n] for i in range(n)), strict=False))

    def _text(self, code: Any, text: Any) -> None:
        if isinstance(code, bytes) and isinstance(text, bytes):
            self.texts[int.from_bytes(code, "big")] = text.decode("utf-16-be", "replace") if len(text) > 1 else text.decode("latin-1")

    def _range(self, lo: Any, hi: Any, to: Any) -> None:
        if not (isinstance(lo, bytes) and isinstance(hi, bytes)):
            return
        a, b = int.from_bytes(lo, "big"), int.from_bytes(hi, "big")
        for i in range(min(b - a, 0xFFFF) + 1):
            code = (a + i).to_bytes(len(lo), "big")
            if isinstance(to, list):
                if i < len(to):
                    self._text(code, to[i])
            elif isinstance(to, bytes) and to:
                last = int.from_bytes(to[-2:], "big") + i
                self._text(code, to[:-2] + (last & 0xFFFF).to_bytes(min(2, len(to)), "big") if last < 1 << 8 * min(2, len(to)) else None)

    def split(self, data: bytes) -> list[tuple[int, int]]:
        """(code, bytes) one after another; bytes outside every code space make a code of the shortest length."""
        out, at = [], 0
        while at < len(data):
            for n in self.sizes:
                code = int.from_bytes(data[at : at + n], "big")
                if at + n <= len(data) and any(m == n and self._within(code, lo, hi, n) for m, lo, hi in self.spaces):
                    break
            else:
                n = self.sizes[0] if self.sizes else 1
                code = int.from_bytes(data[at : at + n], "big")
            out.append((code, n))
            at += n
        return out

    @staticmethod
    def _within(code: int, lo: int, hi: int, n: int) -> bool:
        return all((lo >> 8 * i & 255) <= (code >> 8 * i & 255) <= (hi >> 8 * i & 255) for i in range(n))


class Font:
    """`decode` gives (code, bytes, width in text space, text or None, provenance) for the bytes of a string."""

    def __init__(self, doc: Document, font: Any):
        font = font if isinstance(font, dict) else {}
        self.subtype = str(doc.resolve(font.get("Subtype")) or "")
        self.name = str(doc.resolve(font.get("BaseFont")) or "")
        unicode = doc.resolve(font.get("ToUnicode"))
        self.to_unicode = CMap(doc.decoded(unicode)) if isinstance(unicode, Stream) else None
        self.composite = self.subtype == "Type0"
        self.widths: dict[int, float] = {}
        self.names: dict[int, tuple[str, str]] = {}
        self.cmap: CMap | None = None
        self._known: dict[tuple[int, int], tuple] = {}
        self._plain = _Plain(self, 2 if self.composite else 1)
        descriptor = font
        if self.composite:
            kids = doc.resolve(font.get("DescendantFonts")) or [None]
            descriptor = doc.resolve(kids[0]) or {}
            self.default = doc.resolve(descriptor.get("DW", 1000))
            encoding = doc.resolve(font.get("Encoding"))
            self.cmap = CMap(doc.decoded(encoding)) if isinstance(encoding, Stream) else None
            self._composite_widths(doc, doc.resolve(descriptor.get("W")) or [])
        else:
            first = doc.resolve(font.get("FirstChar")) or 0
            for i, w in enumerate(doc.resolve(font.get("Widths")) or []):
                w = doc.resolve(w)
                if isinstance(w, (int, float)):
                    self.widths[first + i] = w
            facts = doc.entry(font.get("FontDescriptor"), "MissingWidth")
            self.default = facts if isinstance(facts, (int, float)) else 600 if "Courier" in self.name else 500
            self._encoding(doc, doc.resolve(font.get("Encoding")))
        facts = doc.resolve(descriptor.get("FontDescriptor"))
        self.embedded = isinstance(facts, dict) and any(k in facts for k in ("FontFile", "FontFile2", "FontFile3"))
        matrix = doc.resolve(font.get("FontMatrix")) if self.subtype == "Type3" else None
        self.unit_size = float(matrix[0]) if isinstance(matrix, list) and matrix else 0.001

    def _composite_widths(self, doc: Document, w: list) -> None:
        i = 0
        while i + 1 < len(w):
            first, second = doc.resolve(w[i]), doc.resolve(w[i + 1])
            if isinstance(second, list):
                for j, value in enumerate(second):
                    self.widths[first + j] = doc.resolve(value)
                i += 2
            elif i + 2 < len(w):
                value = doc.resolve(w[i + 2])
                for cid in range(first, min(second, first + 0xFFFF) + 1):
                    self.widths[cid] = value
                i += 3
            else:
                break

    def _encoding(self, doc: Document, encoding: Any) -> None:
        base = encoding if isinstance(encoding, Name) else doc.entry(encoding, "BaseEncoding")
        codec = CODECS.get(base) or (None if self.name in ("Symbol", "ZapfDingbats") else "cp1252")
        if codec:
            for code in range(32, 256):
                self.names[code] = (bytes([code]).decode(codec, "ignore"), "base" if base else "implied")
            if codec == "cp1252":
                self.names[0xAD] = ("-", self.names[0xAD][1])
        code = 0
        for item in doc.entry(encoding, "Differences") or []:
            item = doc.resolve(item)
            if isinstance(item, int):
                code = item
            elif isinstance(item, Name):
                self.names[code] = (glyph_text(item) or "", "differences")
                code += 1

    def decode(self, data: bytes) -> list[tuple]:
        if self.composite:
            units = self.cmap.split(data) if self.cmap else [(int.from_bytes(data[i : i + 2], "big"), 2) for i in range(0, len(data) - 1, 2)]
        else:
            units = [(b, 1) for b in data]
        return [self.unit(u) for u in units]

    def shown(self, data: bytes) -> tuple[Any, Any, Any, str | None]:
        """Codes, bytes of each, widths and text of a string. Bytes and widths are one value if they are equal; codes are
        characters or numbers; the text is None unless each code has one character."""
        if self.cmap is None:
            try:
                codes = data.decode("utf-16-be" if self.composite else "latin-1")
                if len(codes) * self._plain.length == len(data):
                    text = codes.translate(self._plain)
                    return codes, self._plain.length, [self._known[ord(c), self._plain.length][2] for c in codes] if self.widths else self.default * self.unit_size, text
            except (_Odd, UnicodeDecodeError):
                pass
        units = self.decode(data)
        return [u[0] for u in units], [u[1] for u in units], [u[2] for u in units], None

    def unit(self, unit: tuple[int, int]) -> tuple:
        found = self._known.get(unit)
        if found is None:
            code, n = unit
            cid = self.cmap.cids.get(code, code) if self.cmap else code
            width = self.widths.get(cid, self.default) * self.unit_size
            text, how = (self.to_unicode.texts.get(code) if self.to_unicode else None), "to-unicode"
            if text is None:
                text, how = self.names.get(code, ("", "failed"))
                text, how = (text, how) if text else (None, "failed")
            self._known[unit] = found = (code, n, width, text, how)
        return found


class _Odd(Exception):
    """A code whose text isn't one character."""


class _Plain(dict):
    """Characters by code, filled as codes are met."""

    def __init__(self, font: Font, length: int):
        self.font, self.length = font, length

    def __missing__(self, code: int) -> str:
        text = self.font.unit((code, self.length))[3]
        if text is None or len(text) != 1:
            raise _Odd
        self[code] = text
        return text
