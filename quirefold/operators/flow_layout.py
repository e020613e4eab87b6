"""Breaking text to lines and filling frames of pages with blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import inf
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Measure = Callable[[str], float]  # width of a text at size 1

# How far a space stretches and shrinks, tolerances tried in turn, penalties.
STRETCH, SHRINK, TOLERANCES, LINE_PENALTY, UNEVEN = 0.5, 1 / 3, (200.0, 10_000.0, inf), 10.0, 10_000.0


def half_em(text: str) -> float:
    """Every character is half its size wide."""
    return 0.5 * len(text)


def first_fit(words: list[str], measure: float, width: Measure = half_em) -> list[str]:
    """Lines that take words as long as they fit; a wider word stands alone."""
    out: list[str] = []
    left, space = -1.0, width(" ")
    for w in words:
        need = width(w)
        if out and need + space <= left + 1e-9:
            out[-1] += " " + w
            left -= need + space
        else:
            out.append(w)
            left = measure - need
    return out


def total_fit(words: list[str], measure: float, width: Measure = half_em) -> list[int] | None:
    """Ends of the lines (word indexes) on the way of least demerits; None if some word is too wide.

    Each break remembers the best way to it. Lines are tried from short to long and given up once overfull, so the work
    is the words times those that fit on a line.
    """
    n, space = len(words), width(" ")
    if not n:
        return None
    sizes = [width(w) for w in words]
    for tolerance in TOLERANCES:
        farthest = inf if tolerance == inf else (tolerance / 100) ** (1 / 3)
        cost, came, grade = [0.0] + [inf] * n, [0] * (n + 1), [1] * (n + 1)
        for end in range(1, n + 1):
            natural, best = -space, inf
            for start in range(end - 1, -1, -1):
                natural += sizes[start] + space
                free, gaps = measure - natural, end - start - 1
                if free < -1e-12:
                    room = gaps * space * SHRINK
                    if end == n or free < -room - 1e-12:
                        break
                    ratio = free / room
                elif end == n:
                    ratio = 0.0
                else:
                    ratio = free / ((gaps + 1) * space * STRETCH) if free > 1e-12 else 0.0
                if cost[start] == inf or ratio > farthest:
                    continue
                kind = 0 if ratio < -0.5 else 1 if ratio <= 0.5 else 2 if ratio <= 1 else 3
                total = cost[start] + (LINE_PENALTY + 100 * abs(ratio) ** 3) ** 2
                if not -2 < kind - grade[start] < 2:
                    total += UNEVEN
                if total <= best:
                    best = cost[end] = total
                    came[end], grade[end] = start, kind
        if cost[n] < inf:
            out, at = [], n
            while at:
                out.append(at - 1)
                at = came[at]
            return out[::-1]
    return None


def total_fit_lines(text: Column, measure: float) -> Column:
    """Lines of total-fit breaking at spaces, widths in half ems; first-fit where a word is too wide. Null stays null."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str] | None:
            if t is None:
                return None
            words = [w for w in t.split(" ") if w]
            ends = total_fit(words, measure)
            if ends is None:
                return first_fit(words, measure)
            return [" ".join(words[a:b]) for a, b in zip([0, *(e + 1 for e in ends[:-1])], [e + 1 for e in ends], strict=True)]

        return texts.map(one)

    return run(text)


@dataclass(frozen=True)
class Rules:
    """Frames are (top, bottom, width) in points; a page holds them all."""

    frames: tuple[tuple[float, float, float], ...] = ((50.0, 750.0, 500.0),)
    size: float = 10.0
    heading_size: float = 14.0
    leading: float = 1.2
    gap: float = 6.0
    orphans: int = 2
    widows: int = 2


class Placement(NamedTuple):
    seq: int
    page: int
    frame: int
    y: float
    first_line: int
    n_lines: int


def fill(blocks: Iterable[tuple[int, bool, list[str]]], rules: Rules = Rules()) -> Iterator[Placement]:
    """Places (seq, is heading, lines) one after another, holding two blocks at a time.

    A block that doesn't fit moves to the next frame if it has begun one already; in an empty frame it is split, leaving at least `orphans`
    lines and carrying at least `widows`. A heading also needs room for the first line of what follows.
    """
    page, frame, y = 0, 0, rules.frames[0][0]
    todo = iter(blocks)
    block = next(todo, None)
    while block is not None:
        after = next(todo, None)
        seq, heading, lines = block
        step = rules.leading * (rules.heading_size if heading else rules.size)
        done = 0
        while done < len(lines):
            top, bottom, _ = rules.frames[frame]
            left = len(lines) - done
            need = left * step
            if heading and after is not None:
                need += rules.gap + rules.leading * (rules.heading_size if after[1] else rules.size)
            fits = min(left, int((bottom - y + 0.01) / step)) if bottom > y else 0
            begun = y > top
            if begun and need > bottom - y + 0.01:
                fits = 0
            elif fits < left and (fits < rules.orphans or left - fits < rules.widows):
                fits = 0 if begun else max(1, min(fits, left - rules.widows)) if fits else 1
            if fits:
                yield Placement(seq, page, frame, round(y, 3), done, fits)
                y += fits * step
                done += fits
            if done < len(lines):
                frame += 1
                if frame == len(rules.frames):
                    page, frame = page + 1, 0
                y = rules.frames[frame][0]
        y += rules.gap if lines else 0.0
        block = after


def layout(blocks: DataFrame, key: str, seq: str, heading: str, text: str, rules: Rules = Rules(), width: Measure = half_em) -> DataFrame:
    """Placements of each document's blocks: (key, seq, page, frame, y, first_line, n_lines, lines).

    A document is folded in order as it streams by, so even one with a third of all rows is never held at once. Empty or null texts take no room.
    """
    names = [key, "seq", "page", "frame", "y", "first_line", "n_lines", "lines"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in batch.itertuples(index=False, name=None))
        row, held = next(rows, None), []
        while row is not None:
            current, kept = row[0], {}

            def blocks_of() -> Iterator[tuple[int, bool, list[str]]]:
                nonlocal row
                while row is not None and row[0] == current:
                    _, number, head, content = row
                    head = bool(head) if head is not None else False
                    measure = rules.frames[0][2] / (rules.heading_size if head else rules.size)
                    kept[number] = first_fit((content or "").split(), measure, width)
                    yield number, head, kept[number]
                    row = next(rows, None)

            for p in fill(blocks_of(), rules):
                lines = kept[p.seq][p.first_line : p.first_line + p.n_lines]
                for gone in [k for k in kept if k < p.seq]:
                    del kept[gone]
                held.append((current, *p, lines))
                if len(held) >= 10_000:
                    yield pd.DataFrame(held, columns=names)
                    held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    kind = blocks.schema[key].dataType.simpleString()
    ordered = blocks.where(F.col(key).isNotNull() & F.col(seq).isNotNull())
    ordered = ordered.select(key, F.col(seq).cast("long").alias("seq"), heading, text).repartition(key).sortWithinPartitions(key, "seq")
    return ordered.mapInPandas(run, f"`{key}` {kind}, seq long, page long, frame long, y double, first_line long, n_lines long, lines array<string>")
