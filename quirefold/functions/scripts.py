"""Script classes of text and small text predicates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes by script behaviour, as ranges.
CJK = "[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af\\uf900-\\ufaff]"
CONTINUOUS = "[\\u0e00-\\u0eff\\u1000-\\u109f\\u1780-\\u17ff]"
RTL = "[\\u0590-\\u08ff\\ufb1d-\\ufdff\\ufe70-\\ufeff]"
SPACED = "[A-Za-z\\u00c0-\\u058f\\u1e00-\\u1fff]"


def dominant(text: Column) -> Column:
    """Majority script; ties go to CJK, continuous, right-to-left, spaced, and no letters give neutral."""
    n = {name: F.regexp_count(text, F.lit(p)) for name, p in (("cjk", CJK), ("continuous", CONTINUOUS), ("rtl", RTL), ("spaced", SPACED))}
    top = F.greatest(*n.values())
    out = F.when(top == 0, "neutral")
    for name, count in n.items():
        out = out.when(count == top, name)
    return out


def confidence(total: Column, mapped: Column, authoritative: Column) -> Column:
    """none, exact or partial from three counts."""
    return F.when((total == 0) | (mapped == 0), "none").when((mapped == total) & (authoritative == total), "exact").otherwise("partial")


def strip_subset_prefix(name: Column) -> Column:
    """Without six capitals and a plus sign, if something follows."""
    return F.regexp_replace(name, "^[A-Z]{6}\\+(.+)$", "$1")


def escape_markdown(text: Column) -> Column:
    """Backslashes before the eight characters that Markdown would read as marks."""
    return F.regexp_replace(text, r"([\\`*_\[\]<>])", r"\\$1")


# Producer families by a word in the name, first match wins.
PRODUCERS = (("word", "word"), ("latex", "tex"), ("chrome", "skia"), ("quartz", "quartz"), ("ghostscript", "ghostscript"))


def classify_producer(producer: Column) -> Column:
    """Family of a producer string by what it contains."""
    low = F.lower(F.coalesce(producer, F.lit("")))
    out = F.when(low == "", "none")
    for family, word in PRODUCERS:
        out = out.when(F.contains(low, F.lit(word)), family)
    return out.otherwise("other")
