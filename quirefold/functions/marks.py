"""Markers, emphasis, roles, scripts and encodable characters of text, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and names that carry a meaning in documents.
BULLETS = "•·‣▪◦–—*"
FOOTNOTE_SYMBOLS = "*†‡§¶#"
INVISIBLE = "​-‏﻿­"
WHITE = "\u0009-\u000d \u0085   -     　"
BOLD, ITALIC = "bold|black|heavy", "italic|oblique"
HEADING_ROLES = {"H": 1} | {f"H{n}": n for n in range(1, 7)}
ITEM_ROLES, LABEL_ROLE = ("LI", "LBody"), "Lbl"
SCRIPTS = {
    "Latn": "Latin", "Cyrl": "Cyrillic", "Grek": "Greek", "Arab": "Arabic", "Hebr": "Hebrew", "Syrc": "Syriac", "Thaa": "Thaana",
    "Deva": "Devanagari", "Beng": "Bengali", "Thai": "Thai", "Hang": "Hangul", "Hira": "Hiragana", "Kana": "Katakana", "Hani": "Han",
    "Armn": "Armenian", "Geor": "Georgian", "Ethi": "Ethiopic", "Khmr": "Khmer", "Laoo": "Lao", "Mymr": "Myanmar", "Taml": "Tamil",
}
#: Code points of each script (hexadecimal, with ranges), as the SQL's regular expressions know them.
CODES = {
    "Latn": (
        "41-5A 61-7A AA BA C0-D6 D8-F6 F8-2B8 2E0-2E4 1D00-1D25 1D2C-1D5C 1D62-1D65 1D6B-1D77 1D79-1DBE 1E00-1EFF 2071 207F "
        "2090-209C 212A-212B 2132 214E 2160-2188 2C60-2C7F A722-A787 A78B-A7CA A7D0-A7D1 A7D3 A7D5-A7D9 A7F2-A7FF AB30-AB5A "
        "AB5C-AB64 AB66-AB69 FB00-FB06 FF21-FF3A FF41-FF5A 10780-10785 10787-107B0 107B2-107BA 1DF00-1DF1E 1DF25-1DF2A"
    ),
    "Cyrl": "400-484 487-52F 1C80-1C88 1D2B 1D78 2DE0-2DFF A640-A69F FE2E-FE2F 1E030-1E06D 1E08F",
    "Grek": (
        "370-373 375-377 37A-37D 37F 384 386 388-38A 38C 38E-3A1 3A3-3E1 3F0-3FF 1D26-1D2A 1D5D-1D61 1D66-1D6A 1DBF 1F00-1F15 "
        "1F18-1F1D 1F20-1F45 1F48-1F4D 1F50-1F57 1F59 1F5B 1F5D 1F5F-1F7D 1F80-1FB4 1FB6-1FC4 1FC6-1FD3 1FD6-1FDB 1FDD-1FEF "
        "1FF2-1FF4 1FF6-1FFE 2126 AB65 10140-1018E 101A0 1D200-1D245"
    ),
    "Arab": (
        "600-604 606-60B 60D-61A 61C-61E 620-63F 641-64A 656-66F 671-6DC 6DE-6FF 750-77F 870-88E 890-891 898-8E1 8E3-8FF "
        "FB50-FBC2 FBD3-FD3D FD40-FD8F FD92-FDC7 FDCF FDF0-FDFF FE70-FE74 FE76-FEFC 10E60-10E7E 10EFD-10EFF 1EE00-1EE03 "
        "1EE05-1EE1F 1EE21-1EE22 1EE24 1EE27 1EE29-1EE32 1EE34-1EE37 1EE39 1EE3B 1EE42 1EE47 1EE49 1EE4B 1EE4D-1EE4F 1EE51-1EE52 "
        "1EE54 1EE57 1EE59 1EE5B 1EE5D 1EE5F 1EE61-1EE62 1EE64 1EE67-1EE6A 1EE6C-1EE72 1EE74-1EE77 1EE79-1EE7C 1EE7E 1EE80-1EE89 "
        "1EE8B-1EE9B 1EEA1-1EEA3 1EEA5-1EEA9 1EEAB-1EEBB 1EEF0-1EEF1"
    ),
    "Hebr": "591-5C7 5D0-5EA 5EF-5F4 FB1D-FB36 FB38-FB3C FB3E FB40-FB41 FB43-FB44 FB46-FB4F",
    "Syrc": "700-70D 70F-74A 74D-74F 860-86A",
    "Thaa": "780-7B1",
    "Deva": "900-950 955-963 966-97F A8E0-A8FF 11B00-11B09",
    "Beng": "980-983 985-98C 98F-990 993-9A8 9AA-9B0 9B2 9B6-9B9 9BC-9C4 9C7-9C8 9CB-9CE 9D7 9DC-9DD 9DF-9E3 9E6-9FE",
    "Thai": "E01-E3A E40-E5B",
    "Hang": (
        "1100-11FF 302E-302F 3131-318E 3200-321E 3260-327E A960-A97C AC00-D7A3 D7B0-D7C6 D7CB-D7FB FFA0-FFBE FFC2-FFC7 FFCA-FFCF "
        "FFD2-FFD7 FFDA-FFDC"
    ),
    "Hira": "3041-3096 309D-309F 1B001-1B11F 1B132 1B150-1B152 1F200",
    "Kana": (
        "30A1-30FA 30FD-30FF 31F0-31FF 32D0-32FE 3300-3357 FF66-FF6F FF71-FF9D 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B000 "
        "1B120-1B122 1B155 1B164-1B167"
    ),
    "Hani": (
        "2E80-2E99 2E9B-2EF3 2F00-2FD5 3005 3007 3021-3029 3038-303B 3400-4DBF 4E00-9FFF F900-FA6D FA70-FAD9 16FE2-16FE3 "
        "16FF0-16FF1 20000-2A6DF 2A700-2B739 2B740-2B81D 2B820-2CEA1 2CEB0-2EBE0 2F800-2FA1D 30000-3134A 31350-323AF"
    ),
    "Armn": "531-556 559-58A 58D-58F FB13-FB17",
    "Geor": "10A0-10C5 10C7 10CD 10D0-10FA 10FC-10FF 1C90-1CBA 1CBD-1CBF 2D00-2D25 2D27 2D2D",
    "Ethi": (
        "1200-1248 124A-124D 1250-1256 1258 125A-125D 1260-1288 128A-128D 1290-12B0 12B2-12B5 12B8-12BE 12C0 12C2-12C5 12C8-12D6 "
        "12D8-1310 1312-1315 1318-135A 135D-137C 1380-1399 2D80-2D96 2DA0-2DA6 2DA8-2DAE 2DB0-2DB6 2DB8-2DBE 2DC0-2DC6 2DC8-2DCE "
        "2DD0-2DD6 2DD8-2DDE AB01-AB06 AB09-AB0E AB11-AB16 AB20-AB26 AB28-AB2E 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE"
    ),
    "Khmr": "1780-17DD 17E0-17E9 17F0-17F9 19E0-19FF",
    "Laoo": "E81-E82 E84 E86-E8A E8C-EA3 EA5 EA7-EBD EC0-EC4 EC6 EC8-ECE ED0-ED9 EDC-EDF",
    "Mymr": "1000-109F A9E0-A9FE AA60-AA7F",
    "Taml": (
        "B82-B83 B85-B8A B8E-B90 B92-B95 B99-B9A B9C B9E-B9F BA3-BA4 BA8-BAA BAE-BB9 BBE-BC2 BC6-BC8 BCA-BCD BD0 BD7 BE6-BFA "
        "11FC0-11FF1 11FFF"
    ),
}
RIGHT_TO_LEFT = (
    "Arab Hebr Syrc Thaa Nkoo Samr Mand Adlm Rohg Yezi Ougr Phnx Armi Prti Phli Avst Sarb Narb Palm Hatr Mani Sogd Sogo Chrs Elym "
    "Nbat Hung Cprt Khar Lydi Mero Merc Orkh"
).split()

#: The code page's characters from 0x80 to 0x9F, in the order of their codes; five codes have none.
SPECIAL = {code: bytes([code]).decode("cp1252") for code in range(0x80, 0xA0) if code not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def list_marker(text: Column, hanging: Column) -> Column:
    """(ordered, rest) of an item's text without its marker, null if it has none. A number needs a hanging indent."""
    bullet = F.regexp_extract(text, rf"^\s*[{BULLETS}]\s*(\S.*)$", 1)
    number = F.when(hanging, F.regexp_extract(text, r"^\s*[0-9]+[.)]\s*(\S.*)$", 1)).otherwise("")
    as_item = lambda ordered, rest: F.struct(F.lit(ordered).alias("ordered"), rest.alias("rest"))
    return F.when(bullet != "", as_item(False, bullet)).when(number != "", as_item(True, number))


def leading_marker(text: Column) -> Column:
    """Leading digits, or one of six symbols and its repetitions; null if there is neither."""
    symbols = "|".join(f"[{c}]+" for c in FOOTNOTE_SYMBOLS)
    found = F.regexp_extract(text, rf"^\s*([0-9]+|{symbols})", 1)
    return F.when(found != "", found)


def visible(text: Column) -> Column:
    """Text without zero-width characters and soft hyphens."""
    return F.regexp_replace(text, f"[{INVISIBLE}]", "")


def collapsed(text: Column) -> Column:
    """White space as single spaces, none at the front; one may stay at the end, as more text could follow."""
    return F.regexp_replace(F.regexp_replace(text, f"[{WHITE}]+", " "), "^ ", "")


def emphasis(font: Column, render_mode: Column) -> Column:
    """(bold, italic, invisible) from a font's name without its subset tag, and the render mode."""
    name = F.lower(F.regexp_replace(font, r"^[A-Z]{6}\+(?=.)", ""))
    return F.struct(name.rlike(BOLD).alias("bold"), name.rlike(ITALIC).alias("italic"), render_mode.isin(3, 7).alias("invisible"))


def role_block(role: Column) -> Column:
    """(kind, level) of a structure role; a label gives no block."""
    level = F.create_map(*(F.lit(x) for pair in HEADING_ROLES.items() for x in pair))[role]
    kind = F.when(level.isNotNull(), "heading").when(role.isin(*ITEM_ROLES), "item").when(role != LABEL_ROLE, "paragraph")
    return F.struct(kind.alias("kind"), level.alias("level"))


@cache
def _script_table() -> np.ndarray:
    """The number of each code point's script in SCRIPTS, from 1; 0 for none."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for i, tag in enumerate(SCRIPTS, 1):
        for part in CODES[tag].split():
            low, _, high = part.partition("-")
            table[int(low, 16) : int(high or low, 16) + 1] = i
    return table


def main_script(text: str | None) -> str:
    """Tag of the script with most characters, of equals the one that starts last; Latn if there is none."""
    if not text or text.isascii():
        return "Latn"
    ids = _script_table()[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
    n = np.bincount(ids, minlength=len(SCRIPTS) + 1)[1:]
    best = np.flatnonzero(n == n.max()) + 1
    if not n.max():
        return "Latn"
    return list(SCRIPTS)[(best[0] if len(best) == 1 else max(best, key=lambda i: int(np.argmax(ids == i)))) - 1]


def script_of(text: Column) -> Column:
    """`main_script` of each text, by one look at each character."""

    @F.pandas_udf("string")
    def scripts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_script)

    return scripts(text)


def direction_of(script: Column) -> Column:
    return F.when(script.isin(*RIGHT_TO_LEFT), "rtl").otherwise("ltr")


_CONTROLS = bytes([*range(0x20), 0x7F])


def win_ansi(text: Column) -> Column:
    """Bytes of the characters that the code page has; others and controls are left out."""

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else t.encode("cp1252", "ignore").translate(None, _CONTROLS))

    return encoded(text)


def slot(edges: Column, value: Column) -> Column:
    """Index of the interval (low, high] of ascending edges that holds a value, clamped at both ends; null for fewer than two edges."""
    n = F.size(edges)
    below = F.size(F.filter(edges, lambda e: e < value)) - 1
    return F.when(n >= 2, F.least(F.greatest(below, F.lit(0)), n - 2))
