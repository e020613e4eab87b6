"""Ciphers by published vectors, protected files by round trips."""

import hashlib

import pytest

from quirefold.pdf import crypt, layout, write
from quirefold.pdf.content import Walker
from quirefold.pdf.document import Document
from quirefold.pdf.objects import PdfError
from quirefold.pdf.write import Placed

ENTROPY = hashlib.sha256(b"test").digest()


def test_ciphers():
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for n, out in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        cipher = crypt.Aes(bytes(range(n)))
        assert cipher.encrypt(plain).hex() == out and cipher.decrypt(bytes.fromhex(out)) == plain
    assert crypt.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"
    for size in (0, 1, 15, 16, 17, 100):
        data = bytes(range(size))
        assert crypt.aes_open(ENTROPY, crypt.aes_seal(ENTROPY, ENTROPY[:16], data)) == data
    assert crypt.aes_open(ENTROPY, b"short") == b""


@pytest.mark.parametrize("strong", [True, False])
def test_protected_files(strong):
    data = write.compose([[Placed("Geheim 密", 10, 50, 700)]], {"Title": "Tïtle"})
    locked = crypt.protect(Document(data), "öpen", "owner", ENTROPY, {"print", "copy"}, strong)
    for password in ("öpen", "owner"):
        for broken in (locked, locked.replace(b"startxref", b"startxxxx")):
            doc = Document(broken, password=password)
            assert doc.info()["title"] == "Tïtle" and doc.permissions() == ["print", "copy"]
            assert [ln.text for ln in layout.lines_of(Walker(doc, doc.pages()[0]).glyphs)] == ["Geheim 密"]
    with pytest.raises(PdfError, match="wrong password"):
        Document(locked)
    plain = Document(crypt.unprotect(Document(locked, password="owner")))
    assert plain.info()["title"] == "Tïtle" and plain.permissions() is None and len(plain.pages()) == 1
    assert Document(crypt.protect(Document(data), "", "", ENTROPY, strong=strong)).info()["title"] == "Tïtle"


def test_policies():
    assert crypt.weaknesses("", "x", set(crypt.RIGHTS), True) == ["no-user-password"]
    assert crypt.weaknesses("same", "same", {"print"}, False) == ["same-passwords", "short-password", "old-cipher", "rights-are-advisory"]
    with pytest.raises(PdfError):
        crypt.protect(Document(write.compose([[]])), "a", "b", bytes(32))
