"""The standard security handler: keys from passwords, RC4 and AES, reading and writing protected files."""

from __future__ import annotations

import hashlib
from typing import Any

from quirefold.pdf.objects import Name, PdfError, Ref, Stream

# Fixed value: the padding of short passwords.
PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j, i, out = list(range(256)), 0, 0, bytearray()
    for k in range(256):
        j = (j + s[k] + key[k % len(key)]) & 255
        s[k], s[j] = s[j], s[k]
    j = 0
    for b in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(b ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def _double(b: int) -> int:
    return (b << 1 ^ 0x11B) & 0xFF if b & 0x80 else b << 1


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = _double(a), b >> 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    """The substitution box: inverses in the field, then an affine map; and its inverse."""
    box, back, p, q = [0x63] * 256, [0] * 256, 1, 1
    while True:
        p ^= _double(p)  # times 3
        q ^= q << 1  # divided by 3
        q ^= q << 2
        q ^= q << 4
        q &= 255
        if q & 0x80:
            q ^= 0x09
        box[p] = q ^ (q << 1 | q >> 7) & 255 ^ (q << 2 | q >> 6) & 255 ^ (q << 3 | q >> 5) & 255 ^ (q << 4 | q >> 4) & 255 ^ 0x63
        if p == 1:
            break
    for i, v in enumerate(box):
        back[v] = i
    return box, back


_BOX, _BACK = _boxes()
_MIX = {k: [_times(i, k) for i in range(256)] for k in (2, 3, 9, 11, 13, 14)}
_SHIFT = [4 * ((c + r) % 4) + r for c in range(4) for r in range(4)]
_UNSHIFT = [_SHIFT.index(i) for i in range(16)]


class Aes:
    """Block cipher of 16, 24 or 32 byte keys."""

    def __init__(self, key: bytes):
        n = len(key) // 4
        words = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
        self.rounds, turn = n + 6, 1
        for i in range(n, 4 * (self.rounds + 1)):
            w = words[-1]
            if i % n == 0:
                w = [_BOX[b] for b in w[1:] + w[:1]]
                w[0] ^= turn
                turn = _double(turn)
            elif n > 6 and i % n == 4:
                w = [_BOX[b] for b in w]
            words.append([a ^ b for a, b in zip(words[i - n], w, strict=True)])
        self.keys = [sum(words[4 * r : 4 * r + 4], []) for r in range(self.rounds + 1)]

    def encrypt(self, block: bytes) -> bytes:
        two, three = _MIX[2], _MIX[3]
        s = [a ^ b for a, b in zip(block, self.keys[0], strict=True)]
        for r in range(1, self.rounds + 1):
            t, k = [_BOX[s[i]] for i in _SHIFT], self.keys[r]
            if r < self.rounds:
                s = []
                for c in (0, 4, 8, 12):
                    a, b, d, e = t[c : c + 4]
                    s += [two[a] ^ three[b] ^ d ^ e ^ k[c], a ^ two[b] ^ three[d] ^ e ^ k[c + 1], a ^ b ^ two[d] ^ three[e] ^ k[c + 2],
                          three[a] ^ b ^ d ^ two[e] ^ k[c + 3]]
            else:
                s = [a ^ b for a, b in zip(t, k, strict=True)]
        return bytes(s)

    def decrypt(self, block: bytes) -> bytes:
        m9, m11, m13, m14 = _MIX[9], _MIX[11], _MIX[13], _MIX[14]
        s = [a ^ b for a, b in zip(block, self.keys[-1], strict=True)]
        for r in range(self.rounds - 1, -1, -1):
            t = [_BACK[s[i]] ^ k for i, k in zip(_UNSHIFT, self.keys[r], strict=True)]
            if r:
                s = []
                for c in (0, 4, 8, 12):
                    a, b, d, e = t[c : c + 4]
                    s += [m14[a] ^ m11[b] ^ m13[d] ^ m9[e], m9[a] ^ m14[b] ^ m11[d] ^ m13[e], m13[a] ^ m9[b] ^ m14[d] ^ m11[e],
                          m11[a] ^ m13[b] ^ m9[d] ^ m14[e]]
            else:
                s = t
        return bytes(s)


def _xor(a: bytes, b: bytes) -> bytes:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).to_bytes(len(a), "big")


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    cipher, out = Aes(key), []
    for i in range(0, len(data), 16):
        iv = cipher.encrypt(_xor(data[i : i + 16], iv))
        out.append(iv)
    return b"".join(out)


def cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    cipher, out = Aes(key), []
    for i in range(0, len(data) - 15, 16):
        block = data[i : i + 16]
        out.append(_xor(cipher.decrypt(block), iv))
        iv = block
    return b"".join(out)


def aes_open(key: bytes, data: bytes) -> bytes:
    """Vector in front, padding off; what isn't padding stays."""
    plain = cbc_decrypt(key, data[:16], data[16:]) if len(data) >= 32 else b""
    n = plain[-1] if plain else 0
    return plain[:-n] if 1 <= n <= 16 and plain.endswith(bytes([n]) * n) else plain


def aes_seal(key: bytes, iv: bytes, data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return iv + cbc_encrypt(key, iv, data + bytes([n]) * n)


def hash_r6(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    """Rounds of AES and SHA-2, 64 at least, until the last byte allows an end."""
    k, turn, last = hashlib.sha256(password + salt + user).digest(), 0, 0
    while turn < 64 or last > turn - 32:
        sealed = cbc_encrypt(k[:16], k[16:32], (password + k + user) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(sealed[:16]) % 3](sealed).digest()
        turn, last = turn + 1, sealed[-1]
    return k[:32]


def file_key(password: bytes, owner: bytes, rights: int, first_id: bytes, revision: int, length: int, metadata: bool) -> bytes:
    """The file key of revisions 2 to 4."""
    more = b"\xff\xff\xff\xff" if revision >= 4 and not metadata else b""
    key = hashlib.md5((password + PAD)[:32] + owner[:32] + (rights & 0xFFFFFFFF).to_bytes(4, "little") + first_id + more).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key[:length]).digest()
    return key[:length]


def _user_entry(key: bytes, first_id: bytes, revision: int) -> bytes:
    if revision == 2:
        return rc4(key, PAD)
    out = hashlib.md5(PAD + first_id).digest()
    for i in range(20):
        out = rc4(bytes(b ^ i for b in key), out)
    return out + bytes(16)


def _owner_key(password: bytes, revision: int, length: int) -> bytes:
    key = hashlib.md5((password + PAD)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key).digest()
    return key[:length]


class Handler:
    """Decrypts a file's strings and streams; raises if neither the user's nor the owner's password fits."""

    def __init__(self, doc: Any, encrypt: dict, password: str = ""):
        def get(key: str, default: Any = None) -> Any:
            found = doc.resolve(encrypt.get(key))
            return default if found is None else found

        if get("Filter", "Standard") != "Standard":
            raise PdfError("another security handler")
        version, self.revision = get("V", 0), get("R", 2)
        ids = doc.resolve(doc.trailer.get("ID"))
        first_id = doc.resolve(ids[0]) if isinstance(ids, list) and ids else b""
        self.metadata = get("EncryptMetadata", True)
        length = 5 if version == 1 else max(5, min(16, get("Length", 40) // 8))
        self.streams = self.strings = "rc4"
        if version >= 4:
            self.streams, self.strings = (self._method(doc, get("CF", {}), get(k, "Identity")) for k in ("StmF", "StrF"))
            length = 16
        if self.revision >= 5:
            self.key = self._modern(get, password.encode()[:127])
        else:
            self.key = self._classic(get, password.encode("latin-1", "replace"), first_id, length)

    @staticmethod
    def _method(doc: Any, filters: Any, name: str) -> str:
        if name == "Identity":
            return "none"
        method = doc.entry(filters.get(name), "CFM")
        return {"None": "none", "V2": "rc4", "AESV2": "aes", "AESV3": "aes256"}.get(method, "none")

    def _classic(self, get: Any, password: bytes, first_id: bytes, length: int) -> bytes:
        owner, user, rights = get("O", b""), get("U", b""), get("P", 0)
        opened = owner[:32]
        key = _owner_key(password, self.revision, length)
        for i in range(19, -1, -1) if self.revision >= 3 else (0,):
            opened = rc4(bytes(b ^ i for b in key), opened)
        for candidate in (password, opened):
            key = file_key(candidate, owner, rights, first_id, self.revision, length, self.metadata)
            n = 32 if self.revision == 2 else 16
            if _user_entry(key, first_id, self.revision)[:n] == user[:n]:
                return key
        raise PdfError("wrong password")

    def _modern(self, get: Any, password: bytes) -> bytes:
        owner, user = get("O", b"")[:48], get("U", b"")[:48]
        for entry, sealed, more in ((user, get("UE", b""), b""), (owner, get("OE", b""), user)):
            hashed = hash_r6 if self.revision >= 6 else lambda p, s, u=b"": hashlib.sha256(p + s + u).digest()
            if hashed(password, entry[32:40], more) == entry[:32]:
                return cbc_decrypt(hashed(password, entry[40:48], more), bytes(16), sealed[:32])
        raise PdfError("wrong password")

    def _apply(self, method: str, ref: Ref, data: bytes) -> bytes:
        if method == "none":
            return data
        if method == "aes256":
            return aes_open(self.key, data)
        own = object_key(self.key, ref, method == "aes")
        return aes_open(own, data) if method == "aes" else rc4(own, data)

    def opened(self, value: Any, ref: Ref) -> Any:
        """The object with its strings and stream decrypted."""
        if isinstance(value, bytes):
            return self._apply(self.strings, ref, value)
        if isinstance(value, list):
            return [self.opened(v, ref) for v in value]
        if isinstance(value, dict):
            return {k: self.opened(v, ref) for k, v in value.items()}
        if isinstance(value, Stream):
            kind = value.dict.get("Type")
            if kind == "XRef":
                return value
            plain = kind == "Metadata" and not self.metadata
            return Stream(self.opened(value.dict, ref), value.raw if plain else self._apply(self.streams, ref, value.raw), value.own)
        return value


def object_key(key: bytes, ref: Ref, aes: bool) -> bytes:
    own = key + ref.num.to_bytes(3, "little") + ref.gen.to_bytes(2, "little") + (b"sAlT" if aes else b"")
    return hashlib.md5(own).digest()[: min(len(key) + 5, 16)]


# Bit numbers of the advisory rights.
RIGHTS = {"print": 3, "modify": 4, "copy": 5, "annotate": 6, "fill": 9, "access": 10, "assemble": 11, "print_high": 12}


def weaknesses(user: str, owner: str, rights: set[str], strong: bool) -> list[str]:
    """What a policy doesn't protect against."""
    found = {"no-user-password": not user, "no-owner-password": not owner, "same-passwords": bool(user) and user == owner,
             "short-password": 0 < len(user) < 8, "old-cipher": not strong, "rights-are-advisory": rights != set(RIGHTS)}
    return [name for name, there in found.items() if there]


def protect(doc: Any, user: str, owner: str, entropy: bytes, rights: set[str] = frozenset(RIGHTS), strong: bool = True) -> bytes:
    """The file in one revision, encrypted by AES-256 (revision 6) or AES-128 (revision 4). `entropy`: 32 random bytes from the caller."""
    from quirefold.pdf.write import file_of

    if len(entropy) != 32 or len(set(entropy)) < 8:
        raise PdfError("32 random bytes are needed")
    counter = 0

    def fresh(n: int) -> bytes:
        nonlocal counter
        counter += 1
        return hashlib.sha256(entropy + counter.to_bytes(8, "big")).digest()[:n]

    bits = sum(1 << RIGHTS[r] - 1 for r in rights) | 0xFFFFF0C0  # reserved bits are set
    signed = bits - (1 << 32)
    first_id = fresh(16)
    if strong:
        key, one, two = fresh(32), user.encode()[:127], (owner or user).encode()[:127]
        salts = fresh(16)
        u = hash_r6(one, salts[:8]) + salts
        ue = cbc_encrypt(hash_r6(one, salts[8:]), bytes(16), key)
        salts = fresh(16)
        o = hash_r6(two, salts[:8], u) + salts
        oe = cbc_encrypt(hash_r6(two, salts[8:], u), bytes(16), key)
        perms = (bits & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff\xff\xff\xffTadb" + fresh(4)
        entry = {"V": 5, "R": 6, "Length": 256, "O": o, "U": u, "OE": oe, "UE": ue, "Perms": Aes(key).encrypt(perms)}
        method, own_length = Name("AESV3"), 32
    else:
        sealed = (user.encode("latin-1", "replace") + PAD)[:32]
        for i in range(20):
            sealed = rc4(bytes(b ^ i for b in _owner_key((owner or user).encode("latin-1", "replace"), 4, 16)), sealed)
        key = file_key(user.encode("latin-1", "replace"), sealed, signed, first_id, 4, 16, True)
        entry = {"V": 4, "R": 4, "Length": 128, "O": sealed, "U": _user_entry(key, first_id, 4)}
        method, own_length = Name("AESV2"), 16
    entry |= {"Filter": Name("Standard"), "P": signed, "StmF": Name("StdCF"), "StrF": Name("StdCF"),
              "CF": {"StdCF": {"CFM": method, "AuthEvent": Name("DocOpen"), "Length": own_length}}}

    def sealed_object(value: Any, ref: Ref) -> Any:
        own = key if strong else object_key(key, ref, True)
        if isinstance(value, str) and not isinstance(value, Name):
            value = value.encode("ascii") if value.isascii() else b"\xfe\xff" + value.encode("utf-16-be")
        if isinstance(value, bytes):
            return aes_seal(own, fresh(16), value)
        if isinstance(value, list):
            return [sealed_object(v, ref) for v in value]
        if isinstance(value, dict):
            return {k: sealed_object(v, ref) for k, v in value.items()}
        if isinstance(value, Stream):
            return Stream(sealed_object(value.dict, ref), aes_seal(own, fresh(16), value.raw))
        return value

    kept = {n: doc.get(n) for n in doc.reachable() if n != getattr(doc.trailer.get("Encrypt"), "num", None)}
    objects = {n: sealed_object(v, Ref(n, 0)) for n, v in kept.items()}
    num = max(objects, default=0) + 1
    objects[num] = entry
    trailer = {k: doc.trailer[k] for k in ("Root", "Info") if k in doc.trailer}
    return file_of(objects, trailer | {"Encrypt": Ref(num, 0), "ID": [first_id, first_id]})


def unprotect(doc: Any) -> bytes:
    """The opened file without encryption, in one revision."""
    from quirefold.pdf.write import save_full

    doc.trailer.pop("Encrypt", None)
    return save_full(doc)
