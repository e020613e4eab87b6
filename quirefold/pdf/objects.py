"""Objects of a PDF file: a tolerant reader of bytes and a serialiser."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any, NamedTuple

DEEPEST = 256  # nesting of arrays and dictionaries

_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]*")
_REFERENCE = re.compile(rb"[\0\t\n\f\r ]+(\d{1,10})[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_STRING_PART = re.compile(rb"[^()\\\r]*")
_INTEGER = re.compile(rb"[+-]?\d+$")
_REAL = re.compile(rb"[+-]*(?:\d+\.?\d*|\.\d+)")
_DELIMITED = rb"(?![^\0\t\n\f\r ()<>\[\]{}/%])"
NUMBER = rb"[+-]?(?:\d+\.?\d*|\.\d+)"
#: The plain tokens: a number, a hexadecimal string, a name, a string without escapes, a keyword.
_TOKEN = re.compile(
    rb"[\0\t\n\f\r ]*+(?:(" + NUMBER + rb")" + _DELIMITED + rb"|<([0-9A-Fa-f]*+)>|/([^\0\t\n\f\r ()<>\[\]{}/%#]*+)" + _DELIMITED
    + rb"|\(([^()\\\r]*+)\)|([A-Za-z'\"][^\0\t\n\f\r ()<>\[\]{}/%]*+))"
)
_IRREGULAR = re.compile(rb"[^!-~]|[#()<>\[\]{}/%]")
_UNPRINTABLE = re.compile(rb"[^ -~]")
VALUES = {b"true": True, b"false": False, b"null": None}
# Escapes of literal strings.
_ESCAPES = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}


class PdfError(ValueError):
    """The file can't be read."""


class End(PdfError):
    """No object is left."""


class Name(str):
    """A name, without its slash."""


class Keyword(bytes):
    """A bare word: an operator, or a stray delimiter."""


class Ref(NamedTuple):
    num: int
    gen: int


@dataclass
class Stream:
    dict: dict
    raw: bytes
    own: Ref | None = field(default=None, compare=False)


def number(word: bytes) -> int | float | None:
    """Integer or real; repeated signs and text behind the digits are tolerated."""
    if _INTEGER.match(word):
        return int(word)
    found = _REAL.match(word)
    if not found:
        return None
    text = found.group()
    value = float(text.lstrip(b"+-"))
    return -value if text.startswith(b"-") else value


def plain_number(word: bytes) -> int | float:
    return float(word) if b"." in word else int(word)


def from_hex(digits: bytes) -> bytes:
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


class Reader:
    """Objects one after another from a buffer; `refs` tells whether `n g R` is a reference."""

    def __init__(self, buf: bytes, pos: int = 0, refs: bool = True):
        self.buf, self.pos, self.refs = buf, pos, refs

    def skip(self) -> None:
        self.pos = _SKIP.match(self.buf, self.pos).end()

    def value(self, depth: int = 0) -> Any:
        found = _TOKEN.match(self.buf, self.pos) if depth <= DEEPEST else None
        if found is not None:
            kind, self.pos = found.lastindex, found.end()
            word = found[kind]
            if kind == 1:
                value = plain_number(word)
                if self.refs and type(value) is int and value >= 0:
                    ref = _REFERENCE.match(self.buf, self.pos)
                    if ref:
                        self.pos = ref.end()
                        return Ref(value, int(ref.group(1)))
                return value
            if kind == 2:
                return from_hex(word)
            if kind == 3:
                return Name(word.decode("latin-1"))
            if kind == 4:
                return word
            return VALUES[word] if word in VALUES else Keyword(word)
        self.skip()
        buf, at = self.buf, self.pos
        if at >= len(buf):
            raise End("end of data")
        if depth > DEEPEST:
            raise PdfError("nested too deeply")
        c = buf[at]
        if c == 0x2F:
            return self._name()
        if c == 0x28:
            return self._string()
        if c == 0x3C:
            return self._dict(depth) if buf[at + 1 : at + 2] == b"<" else self._hex()
        if c == 0x5B:
            return self._array(depth)
        if c in b")]{}>":
            self.pos = at + (2 if buf[at : at + 2] == b">>" else 1)
            return Keyword(buf[at : self.pos])
        self.pos = _REGULAR.match(buf, at).end()
        word = buf[at : self.pos]
        if c in b"+-.0123456789":
            value = number(word)
            if value is not None:
                if self.refs and type(value) is int and value >= 0:
                    ref = _REFERENCE.match(buf, self.pos)
                    if ref:
                        self.pos = ref.end()
                        return Ref(value, int(ref.group(1)))
                return value
        if word == b"true":
            return True
        if word == b"false":
            return False
        if word == b"null":
            return None
        return Keyword(word)

    def _name(self) -> Name:
        end = _REGULAR.match(self.buf, self.pos + 1).end()
        raw, self.pos = self.buf[self.pos + 1 : end], end
        if b"#" in raw:
            raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m.group(1), 16)]), raw)
        return Name(raw.decode("latin-1"))

    def _string(self) -> bytes:
        buf, at, depth, out = self.buf, self.pos + 1, 1, []
        while at < len(buf):
            end = _STRING_PART.match(buf, at).end()
            out.append(buf[at:end])
            c, at = buf[end : end + 1], end + 1
            if c == b"(":
                depth += 1
                out.append(c)
            elif c == b")":
                depth -= 1
                if not depth:
                    break
                out.append(c)
            elif c == b"\r":
                out.append(b"\n")
                at += buf[at : at + 1] == b"\n"
            elif c == b"\\" and at < len(buf):
                octal = re.compile(rb"[0-7]{1,3}").match(buf, at)
                if octal:
                    out.append(bytes([int(octal.group(), 8) & 255]))
                    at = octal.end()
                elif buf[at] in b"\r\n":
                    at += 2 if buf[at : at + 2] == b"\r\n" else 1
                else:
                    out.append(_ESCAPES.get(buf[at], buf[at : at + 1]))
                    at += 1
        self.pos = min(at, len(buf))
        return b"".join(out)

    def _hex(self) -> bytes:
        end = self.buf.find(b">", self.pos)
        end = len(self.buf) if end < 0 else end
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.buf[self.pos + 1 : end])
        self.pos = min(end + 1, len(self.buf))
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def _array(self, depth: int) -> list:
        self.pos += 1
        out: list = []
        while True:
            try:
                item = self.value(depth + 1)
            except End:
                return out
            if isinstance(item, Keyword):
                if item == b"]":
                    return out
                if item in (b"endobj", b"endstream", b">>"):
                    return out
                continue
            out.append(item)

    def _dict(self, depth: int) -> dict:
        self.pos += 2
        out: dict = {}
        while True:
            try:
                key = self.value(depth + 1)
                if isinstance(key, Keyword):
                    if key == b">>":
                        return out
                    if key in (b"endobj", b"stream"):
                        self.pos -= len(key)
                        return out
                    continue
                if not isinstance(key, Name):
                    continue
                item = self.value(depth + 1)
            except End:
                return out
            if isinstance(item, Keyword):
                if item == b">>":
                    return out
                continue
            out[key] = item


def text_of(raw: Any) -> str | None:
    """A text string: UTF-16BE or UTF-8 by its mark, else one byte a character."""
    if not isinstance(raw, bytes):
        return str(raw) if isinstance(raw, Name) else None
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("cp1252", "replace") if any(0x80 <= b < 0xA0 for b in raw) else raw.decode("latin-1")


def real(value: float) -> str:
    """Shortest fixed notation, at most six digits behind the point."""
    out = f"{value:.6f}".rstrip("0").rstrip(".")
    return "0" if out in ("", "-0") else out


def serialise(value: Any) -> bytes:
    """The bytes of an object; streams with their own length."""
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, Name):
        return b"/" + _IRREGULAR.sub(lambda m: b"#%02X" % m[0][0], value.encode("latin-1", "replace"))
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return real(value).encode()
    if isinstance(value, str):
        plain = value.isascii()
        return serialise(value.encode("ascii") if plain else b"\xfe\xff" + value.encode("utf-16-be", "surrogatepass"))
    if isinstance(value, bytes):
        if not _UNPRINTABLE.search(value):
            return b"(" + re.sub(rb"([()\\])", rb"\\\1", value) + b")"
        return b"<" + value.hex().upper().encode() + b">"
    if isinstance(value, (list, tuple)):
        return b"[" + b" ".join(map(serialise, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b"".join(serialise(Name(k)) + b" " + serialise(v) for k, v in value.items()) + b">>"
    if isinstance(value, Stream):
        return serialise(value.dict | {"Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    raise TypeError(type(value).__name__)
