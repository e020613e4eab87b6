"""An opened PDF file: cross references, recovery, objects, streams, pages and document facts."""

from __future__ import annotations

import re
from typing import Any

from quirefold.pdf.crypt import RIGHTS, Handler
from quirefold.pdf.objects import End, Keyword, Name, PdfError, Reader, Ref, Stream, text_of
from quirefold.sources import codecs

_HEADER = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj(?![a-zA-Z])")
_END = re.compile(rb"[\r\n \t]*endstream")
_ROW = re.compile(rb"[\0\t\n\f\r ]*+(\d+)[\0\t\n\f\r ]++(\d+)[\0\t\n\f\r ]++([nf])(?![^\0\t\n\f\r ()<>\[\]{}/%])")
LINKS = 32  # references followed in a row
MATRIX = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Document:
    """Objects are parsed when asked for. `load_mode` is `followed` or `reconstructed`; `leniencies` lists what was tolerated."""

    def __init__(self, data: bytes, recovery: bool = True, password: str = ""):
        self.data, self.leniencies = data, []
        self.entries: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.revisions: list[int] = []
        self.load_mode = "followed"
        self._cache: dict[int, Any] = {}
        self._members: dict[int, list] = {}
        self._found: dict[int, tuple[int, int]] | None = None
        self.crypt: Handler | None = None
        self._password = password
        self.start = data.find(b"%PDF-")
        if self.start < 0:
            if not recovery:
                raise PdfError("no header")
            self.start = 0
            self._tolerate("missing-header")
        elif self.start:
            self._tolerate("header-offset")
        try:
            self._follow()
            self._unlock()
            if not isinstance(self.resolve(self.trailer.get("Root")), dict):
                raise PdfError("no catalog")
        except (PdfError, ValueError, TypeError, IndexError, KeyError, RecursionError) as e:
            if str(e) in ("wrong password", "another security handler"):
                raise
            if not recovery:
                raise PdfError("cross references can't be followed") from None
            self._reconstruct()
        if not isinstance(self.catalog(), dict):
            raise PdfError("no catalog")

    def _tolerate(self, kind: str) -> None:
        self.leniencies.append(kind)

    # cross references

    def _follow(self) -> None:
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise PdfError("no startxref")
        todo, seen = [Reader(self.data, at + 9).value()], set()
        while todo:
            pos = todo.pop(0)
            if not isinstance(pos, int) or pos in seen:
                continue
            seen.add(pos)
            trailer = self._section(pos + self.start)
            self.revisions.append(pos)
            for key, value in trailer.items():
                self.trailer.setdefault(key, value)
            todo = [p for p in (trailer.get("XRefStm"), trailer.get("Prev")) if p is not None] + todo
        if not self.entries:
            raise PdfError("empty cross references")

    def _section(self, pos: int) -> dict:
        reader = Reader(self.data, pos)
        word = reader.value()
        if word != b"xref":
            if isinstance(word, int):
                stream = self._indirect(pos)[1]
                if isinstance(stream, Stream):
                    return self._xref_stream(stream)
            raise PdfError("no cross references there")
        while True:
            first = reader.value()
            if isinstance(first, Keyword):
                break
            for num in range(first, first + reader.value()):
                row = _ROW.match(self.data, reader.pos)
                if row:
                    offset, gen, kind, reader.pos = int(row[1]), int(row[2]), row[3], row.end()
                else:
                    offset, gen, kind = reader.value(), reader.value(), reader.value()
                if kind == b"n":
                    self.entries.setdefault(num, ("at", offset + self.start, gen))
                else:
                    self.entries.setdefault(num, ("free",))
        if first != b"trailer":
            raise PdfError("no trailer")
        trailer = reader.value()
        if not isinstance(trailer, dict):
            raise PdfError("no trailer")
        return trailer

    def _xref_stream(self, stream: Stream) -> dict:
        data, widths = self.decoded(stream), stream.dict["W"]
        index = stream.dict.get("Index") or [0, stream.dict["Size"]]
        step, at = sum(widths), 0
        if step <= 0:
            raise PdfError("no widths")
        for first, count in zip(index[::2], index[1::2], strict=True):
            for num in range(first, min(first + count, first + (len(data) - at) // step + 1)):
                row, at = data[at : at + step], at + step
                if len(row) < step:
                    break
                a, b = widths[0], widths[0] + widths[1]
                kind = int.from_bytes(row[:a], "big") if a else 1
                one, two = int.from_bytes(row[a:b], "big"), int.from_bytes(row[b:], "big")
                entry = {0: ("free",), 1: ("at", one + self.start, two), 2: ("in", one, two)}.get(kind)
                if entry:
                    self.entries.setdefault(num, entry)
        return stream.dict

    def _headers(self) -> dict[int, tuple[int, int]]:
        """Offset and generation by object number: the higher generation wins, then the later offset."""
        if self._found is None:
            self._found = {}
            for m in _HEADER.finditer(self.data):
                num, gen = int(m.group(1)), int(m.group(2))
                if num not in self._found or gen >= self._found[num][1]:
                    self._found[num] = (m.start(), gen)
        return self._found

    def _reconstruct(self) -> None:
        self.load_mode = "reconstructed"
        self._tolerate("reconstructed")
        self._cache.clear()
        self._members.clear()
        self.revisions = []
        self.entries = {num: ("at", at, gen) for num, (at, gen) in self._headers().items()}
        self.trailer = {}
        for m in re.finditer(rb"trailer", self.data):
            try:
                found = Reader(self.data, m.end()).value()
            except PdfError:
                continue
            if isinstance(found, dict):
                self.trailer |= found
        self._unlock()
        for num in sorted(self.entries):
            value = self.get(num)
            if isinstance(value, Stream) and value.dict.get("Type") == "ObjStm":
                for i, (member, _) in enumerate(self._object_stream(num)):
                    self.entries.setdefault(member, ("in", num, i))
            elif isinstance(value, Stream) and value.dict.get("Type") == "XRef":
                self.trailer = {k: value.dict[k] for k in ("Root", "Info", "Encrypt", "ID") if k in value.dict} | self.trailer
        root = self.resolve(self.trailer.get("Root"))
        if not isinstance(root, dict) or root.get("Type", "Catalog") != "Catalog":
            for num in sorted(self.entries, reverse=True):
                value = self.get(num)
                if isinstance(value, dict) and value.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(num, 0)
                    break

    def _unlock(self) -> None:
        """Set up decryption; objects read before are read again."""
        encrypt = self.resolve(self.trailer.get("Encrypt"))
        if isinstance(encrypt, dict):
            self.crypt = None
            self.crypt = Handler(self, encrypt, self._password)
            self._cache.clear()
            self._members.clear()

    # objects

    def _indirect(self, pos: int) -> tuple[int, Any]:
        reader = Reader(self.data, pos)
        num, gen, word = reader.value(), reader.value(), reader.value()
        if not isinstance(num, int) or word != b"obj":
            raise PdfError("no object there")
        value = reader.value()
        if isinstance(value, Keyword):
            return num, None
        if isinstance(value, dict):
            reader.skip()
            if self.data.startswith(b"stream", reader.pos):
                at = reader.pos + 6
                at += 2 if self.data[at : at + 2] == b"\r\n" else 1 if self.data[at : at + 1] in (b"\n", b"\r") else 0
                length = value.get("Length")
                length = self.resolve(length) if isinstance(length, Ref) and length.num != num else length
                if not isinstance(length, int) or length < 0 or not _END.match(self.data, at + length):
                    end = self.data.find(b"endstream", at)
                    end = len(self.data) if end < 0 else end
                    self._tolerate("stream-length")
                    raw = self.data[at:end]
                    raw = raw[:-2] if raw.endswith(b"\r\n") else raw[:-1] if raw.endswith((b"\n", b"\r")) else raw
                else:
                    raw = self.data[at : at + length]
                return num, Stream(value, raw, Ref(num, gen))
        return num, value

    def _object_stream(self, num: int) -> list[tuple[int, Any]]:
        if num not in self._members:
            self._members[num] = []
            stream = self.get(num)
            if isinstance(stream, Stream):
                data, out = self.decoded(stream), []
                head = Reader(data)
                count, first = self.resolve(stream.dict.get("N")) or 0, self.resolve(stream.dict.get("First")) or 0
                try:
                    places = [(head.value(), head.value()) for _ in range(count)]
                    for member, offset in places:
                        out.append((member, Reader(data, first + offset).value()))
                except (PdfError, TypeError):
                    self._tolerate("object-stream")
                self._members[num] = out
        return self._members[num]

    def get(self, num: int) -> Any:
        """The object of a number, or None; a wrong offset is repaired by the object's header."""
        if num in self._cache:
            return self._cache[num]
        self._cache[num] = None  # a cycle reads as null
        entry, value = self.entries.get(num, ("free",)), None
        if entry[0] == "at":
            try:
                found, value = self._indirect(entry[1])
                if found != num:
                    raise PdfError("another object there")
            except (PdfError, TypeError):
                value = None
                if num in self._headers():
                    self._tolerate("object-offset")
                    try:
                        value = self._indirect(self._headers()[num][0])[1]
                    except (PdfError, TypeError):
                        value = None
        elif entry[0] == "in":
            members = self._object_stream(entry[1])
            if entry[2] < len(members) and members[entry[2]][0] == num:
                value = members[entry[2]][1]
            else:
                value = next((v for n, v in members if n == num), None)
        locked = self.crypt and entry[0] == "at" and num != getattr(self.trailer.get("Encrypt"), "num", None)
        if locked:
            value = self.crypt.opened(value, Ref(num, entry[2]))
        self._cache[num] = value
        return value

    def resolve(self, value: Any) -> Any:
        for _ in range(LINKS):
            if not isinstance(value, Ref):
                return value
            value = self.get(value.num)
        return None

    def entry(self, owner: Any, key: str) -> Any:
        """A dictionary's value, resolved."""
        owner = self.resolve(owner)
        owner = owner.dict if isinstance(owner, Stream) else owner
        return self.resolve(owner.get(key)) if isinstance(owner, dict) else None

    def filters(self, stream: Stream) -> list[tuple[str, dict]]:
        names, parms = self.entry(stream, "Filter"), self.entry(stream, "DecodeParms")
        names = names if isinstance(names, list) else [] if names is None else [names]
        parms = parms if isinstance(parms, list) else [parms]
        parms = [self.resolve(p) for p in parms] + [None] * len(names)
        return [(self.resolve(n), p if isinstance(p, dict) else {}) for n, p in zip(names, parms, strict=False)]

    def decoded(self, stream: Stream) -> bytes:
        """Through all filters up to the first that isn't a text or byte codec."""
        data = stream.raw
        for name, parms in self.filters(stream):
            kind = codecs.NAMES.get(name)
            if kind is None:
                break
            data = codecs.lzw(data, self.resolve(parms.get("EarlyChange", 1))) if kind == "lzw" else codecs.DECODERS[kind](data)
            predictor, columns, colors = (self.resolve(parms.get(k, 1)) for k in ("Predictor", "Columns", "Colors"))
            if predictor >= 10:
                data = codecs.png_rows(data, columns, colors, self.resolve(parms.get("BitsPerComponent", 8)))
            elif predictor == 2:
                data = codecs.tiff_rows(data, columns, colors)
        return data

    # document facts

    def catalog(self) -> Any:
        return self.resolve(self.trailer.get("Root"))

    def version(self) -> str | None:
        found = re.compile(rb"%PDF-(\d\.\d)").match(self.data, self.start)
        return found.group(1).decode() if found else None

    def info(self) -> dict[str, str | None]:
        """/Info first, the XMP packet second."""
        info = self.resolve(self.trailer.get("Info"))
        info = info if isinstance(info, dict) else {}
        xmp = self.entry(self.catalog(), "Metadata")
        packet = self.decoded(xmp).decode("utf-8", "replace") if isinstance(xmp, Stream) else ""
        pairs = (("title", "Title", "dc:title"), ("author", "Author", "dc:creator"), ("producer", "Producer", "pdf:Producer"))
        return {key: text_of(self.resolve(info.get(name))) or xmp_field(packet, tag) for key, name, tag in pairs}

    def permissions(self) -> list[str] | None:
        """The granted advisory rights, or None if the file isn't encrypted."""
        bits = self.entry(self.trailer.get("Encrypt"), "P")
        return [n for n, b in RIGHTS.items() if bits >> (b - 1) & 1] if isinstance(bits, int) else None

    def is_linearized(self) -> bool:
        found = _HEADER.search(self.data, self.start, self.start + 1024)
        try:
            value = Reader(self.data, found.end()).value() if found else None
        except End:
            value = None
        return isinstance(value, dict) and "Linearized" in value

    def pages(self) -> list[dict]:
        """Leaf pages in order, with what they inherit; nodes are visited once and at most 64 deep."""
        out, seen = [], set()

        def walk(ref: Any, inherited: dict, depth: int) -> None:
            key = ref.num if isinstance(ref, Ref) else id(ref)
            node = self.resolve(ref)
            if not isinstance(node, dict) or key in seen or depth > 64:
                return
            seen.add(key)
            inherited = inherited | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            kids = self.resolve(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                for kid in kids:
                    walk(kid, inherited, depth + 1)
            else:
                out.append(inherited | node | {"__ref": ref})

        walk(self.catalog().get("Pages"), {}, 0)
        return out

    def box(self, page: dict) -> tuple[float, float, float, float]:
        """The crop box within the media box; US letter if there is none."""

        def rect(value: Any) -> tuple | None:
            value = self.resolve(value)
            if not isinstance(value, list) or len(value) != 4:
                return None
            v = [self.resolve(x) for x in value]
            if not all(isinstance(x, (int, float)) for x in v):
                return None
            return min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3])

        media = rect(page.get("MediaBox")) or (0.0, 0.0, 612.0, 792.0)
        crop = rect(page.get("CropBox")) or media
        both = max(media[0], crop[0]), max(media[1], crop[1]), min(media[2], crop[2]), min(media[3], crop[3])
        return both if both[0] < both[2] and both[1] < both[3] else media

    def rotation(self, page: dict) -> int:
        turn = self.resolve(page.get("Rotate"))
        return int(turn) % 360 // 90 * 90 if isinstance(turn, (int, float)) else 0

    def content(self, page: dict) -> bytes:
        """The parts of /Contents, separated by line feeds."""
        parts = self.resolve(page.get("Contents"))
        parts = parts if isinstance(parts, list) else [parts]
        streams = [self.resolve(p) for p in parts]
        return b"\n".join(self.decoded(s) for s in streams if isinstance(s, Stream))

    def outlines(self) -> list[tuple[int, str]]:
        """Depth and title of the outline entries, in order."""
        out, seen = [], set()

        def walk(ref: Any, depth: int) -> None:
            while isinstance(ref, Ref) and ref.num not in seen and depth <= 64:
                seen.add(ref.num)
                node = self.resolve(ref)
                if not isinstance(node, dict):
                    return
                out.append((depth, text_of(self.resolve(node.get("Title"))) or ""))
                walk(node.get("First"), depth + 1)
                ref = node.get("Next")

        walk(self.entry(self.catalog(), "Outlines") and self.entry(self.catalog(), "Outlines").get("First"), 0)
        return out

    def annotations(self, page: dict) -> list[dict]:
        """Subtype, contents and field value of a page's annotations; a field's value comes from its parents if need be."""
        out = []
        for ref in self.resolve(page.get("Annots")) or []:
            note = self.resolve(ref)
            if not isinstance(note, dict):
                continue
            value, owner = None, note
            for _ in range(LINKS):
                value = self.resolve(owner.get("V"))
                owner = self.resolve(owner.get("Parent"))
                if value is not None or not isinstance(owner, dict):
                    break
            flags = self.resolve(note.get("F")) or 0
            out.append({"subtype": str(note.get("Subtype", "")), "contents": text_of(self.resolve(note.get("Contents"))),
                        "value": text_of(value), "hidden": bool(flags & 2 or flags & 32)})
        return out

    def fields(self) -> list[tuple[str, str | None, str | None]]:
        """Full dotted name, type and value of the form's terminal fields."""
        out, seen = [], set()

        def walk(ref: Any, path: list[str], kind: Any, value: Any, depth: int) -> None:
            key, node = (ref.num if isinstance(ref, Ref) else id(ref)), self.resolve(ref)
            if not isinstance(node, dict) or key in seen or depth > 64:
                return
            seen.add(key)
            own = text_of(self.resolve(node.get("T")))
            path = path if own is None else [*path, own]
            kind, value = self.resolve(node.get("FT")) or kind, node.get("V", value)
            kids = [k for k in self.resolve(node.get("Kids")) or [] if isinstance(self.entry(k, "T"), bytes)]
            for kid in kids:
                walk(kid, path, kind, value, depth + 1)
            if not kids and path:
                out.append((".".join(path), None if kind is None else str(kind), text_of(self.resolve(value))))

        for ref in self.entry(self.entry(self.catalog(), "AcroForm"), "Fields") or []:
            walk(ref, [], None, None, 0)
        return out

    def reachable(self) -> set[int]:
        """Numbers of the objects that the trailer leads to."""
        seen: set[int] = set()
        todo: list[Any] = [self.trailer.get("Root"), self.trailer.get("Info"), self.trailer.get("Encrypt")]
        while todo:
            value = todo.pop()
            if isinstance(value, Ref):
                if value.num not in seen and value.num in self.entries:
                    seen.add(value.num)
                    todo.append(self.get(value.num))
            elif isinstance(value, Stream):
                todo.append(value.dict)
            elif isinstance(value, dict):
                todo += value.values()
            elif isinstance(value, list):
                todo += value
        return seen


def xmp_field(packet: str, tag: str) -> str | None:
    """The first value of a tag, out of its RDF container, with the five entities decoded."""
    found = re.search(rf"<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", packet, re.S)
    if not found:
        return None
    inner = re.search(r"<rdf:li(?:\s[^>]*)?>(.*?)</rdf:li>", found.group(1), re.S)
    text = (inner or found).group(1).strip()
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = text.replace(f"&{name};", char)
    return text or None


def kind_of(value: Any) -> str:
    """The name of an object's kind."""
    if value is None:
        return "null"
    for kind, name in ((bool, "boolean"), (Ref, "reference"), (Name, "name"), (int, "integer"), (float, "real"), (bytes, "string"),
                       (list, "array"), (dict, "dictionary"), (Stream, "stream")):
        if isinstance(value, kind):
            return name
    return "unknown"
