"""Benchmark decontamination with a generalised suffix automaton over normalised benchmark words.

Training words stream through the automaton of all items, which yields at each word the length
of the longest match that ends there. A match of `window` words is an occurrence of a benchmark window,
and so is that of a whole item that is shorter. Words outside the benchmark's vocabulary and word pairs
that no item holds are found by array operations first, so that only runs that can hold a window are streamed.

The benchmark is cut into blocks of at most BLOCK_WORDS words; each block's automaton has a proven size
(at most 2 states and 3 transitions a word) and is broadcast. A task holds at most AT_ONCE blocks: a larger benchmark
means more passes over the documents, whose results are joined by row, not a larger broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import checkpointed

WINDOW = 10
#: Words in a block, and blocks that are broadcast at once.
BLOCK_WORDS, AT_ONCE = 1_000_000, 2
#: Words of UTF-8 text: digits, a-z after lower-casing A-Z, and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FOUND = "n_words long, hits array<struct<start:int,n:int>>, item_ids array<string>"


def normalise(text: str | None) -> list[bytes]:
    """Words of a text; null has none. bytes.lower() changes A-Z only."""
    return WORD.findall(text.encode().lower()) if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word-id sequences with the items of each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        coded = [
            (item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
            for item, words in items
            if words
        ]
        self.least = min([window, *(len(seq) for _, seq in coded)])
        for _, seq in coded:
            at = 0
            for c in seq:
                at = self._extend(at, c)
        self._own(coded)
        pairs = {(a, b) for _, seq in coded for a, b in zip(seq, seq[1:])}
        self.pairs = np.array(sorted(a << 32 | b for a, b in pairs), dtype=np.int64)

    def _add(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._add(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _own(self, coded: list[tuple[str, list[int]]]) -> None:
        """Items per window state; short items per state, also those reached over suffix links."""
        self.window_state: dict[int, int] = {}
        self.items: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        for item, seq in coded:
            at = size = 0
            for c in seq:
                at, size = self.step(at, size, c)
                if size >= self.window:
                    self.items.setdefault(self.state_of_window(at), set()).add(item)
            if len(seq) < self.window:
                short.setdefault(at, []).append((len(seq), item))
        self.short: list[tuple[tuple[int, str], ...]] = [()] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short[v] = (*short.get(v, ()), *self.short[self.link[v]])

    def step(self, at: int, size: int, c: int) -> tuple[int, int]:
        """Longest match after one more word: its state and length."""
        while at and c not in self.next[at]:
            at = self.link[at]
            size = self.length[at]
        to = self.next[at].get(c)
        return (0, 0) if to is None else (to, size + 1)

    def state_of_window(self, at: int) -> int:
        """The state that holds the last `window` words of the match at `at`."""
        found = self.window_state.get(at)
        if found is None:
            found = at
            while self.length[self.link[found]] >= self.window:
                found = self.link[found]
            self.window_state[at] = found
        return found

    def match(self, words: list[bytes], hit: np.ndarray, items: set[str]) -> None:
        """Mark the words inside occurrences of windows and collect the items they belong to."""
        get = self.vocabulary.get
        codes = np.array([get(w, -1) for w in words], dtype=np.int64)
        known = codes >= 0
        if len(codes) > 1 and self.least > 1:
            joined = known[:-1] & known[1:]
            spots = np.flatnonzero(joined)
            pairs = codes[spots] << 32 | codes[spots + 1]
            place = np.searchsorted(self.pairs, pairs)
            place[place == len(self.pairs)] = 0
            fits = self.pairs[place] == pairs if len(self.pairs) else np.zeros(len(pairs), dtype=bool)
            joined[spots[~fits]] = False
            edge = np.flatnonzero(np.diff(np.concatenate(([False], joined, [False])).astype(np.int8)))
            spans = [(a, b + 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b + 1 - a >= self.least]
        elif self.least <= 1:
            spans = [(0, len(codes))]
        else:
            spans = []
        for a, b in spans:
            at = size = 0
            for i, c in enumerate(codes[a:b].tolist(), a):
                if c < 0:
                    at = size = 0
                    continue
                at, size = self.step(at, size, c)
                if size >= self.window:
                    hit[i + 1 - self.window : i + 1] = True
                    items |= self.items[self.state_of_window(at)]
                for k, item in self.short[at]:
                    if k <= size:
                        hit[i + 1 - k : i + 1] = True
                        items.add(item)


def automata(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[SuffixAutomaton]:
    """Automata of the benchmark's blocks; the driver holds one block of items at a time. Items without an id go by ''."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).toLocalIterator()
    for item, text in rows:
        words = normalise(text)
        block.append((item, words))
        size += len(words)
        if size >= block_words:
            yield SuffixAutomaton(block, window)
            block, size = [], 0
    if block:
        yield SuffixAutomaton(block, window)


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return [{"start": a, "n": b - a} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def _finder(blocks: list):
    """A column function: number of words, hit spans and items of a text under some blocks."""

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = normalise(text)
            hit, items = np.zeros(len(words), dtype=bool), set()
            for block in blocks:
                block.value.match(words, hit, items)
            rows.append((len(words), _spans(hit), sorted(items)))
        return pd.DataFrame(rows, columns=["n_words", "hits", "item_ids"])

    return find.asNondeterministic()  # not to be evaluated again for each use of a field


def _united(sizes: pd.Series, parts: pd.Series) -> pd.Series:
    """Union of the spans that several passes found."""
    out = []
    for n, spans in zip(sizes, parts, strict=True):
        hit = np.zeros(n, dtype=bool)
        for span in spans:
            hit[span["start"] : span["start"] + span["n"]] = True
        out.append(_spans(hit))
    return pd.Series(out)


def annotate(
    rows: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """Append `found` (n_words, hits, item_ids): spans of words inside benchmark windows, and the items.

    Narrow while the benchmark has at most `at_once` blocks; else a pass for each so many blocks.
    """
    spark, made = rows.sparkSession, automata(benchmark, item_col, item_text, window, block_words)
    shipped = lambda: [spark.sparkContext.broadcast(x) for x in islice(made, at_once)]
    blocks, more = shipped(), shipped()
    if not more:
        return rows.withColumn("found", _finder(blocks)(F.col(text_col)))
    numbered = checkpointed(rows.withColumn("rid", F.monotonically_increasing_id()))
    passes = []
    while blocks:
        found = numbered.select("rid", _finder(blocks)(F.col(text_col)).alias("f")).select("rid", "f.*")
        passes.append(checkpointed(found if not passes else found.where(F.size("hits") > 0)))
        for block in blocks:
            block.unpersist()
        blocks, more = more, shipped()
    gathered = reduce(DataFrame.unionByName, passes).groupBy("rid").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
    )
    united = gathered.select("rid", F.struct("n_words", F.pandas_udf(_united, "array<struct<start:int,n:int>>")("n_words", "hits").alias("hits"), "item_ids").alias("found"))
    return numbered.join(united, "rid").drop("rid")


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_words, hits, item_ids): spans of words inside benchmark windows, and the items.

    Null and empty texts have no words and no hits; items without words are ignored, an item id that occurs
    twice in the table counts once, and so do all items without an id. Other columns are ignored.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return annotate(picked, benchmark, **options).select("doc_id", "found.*")


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per document."""
    hits = find_hits(docs, benchmark, **options)
    return hits.select(
        "doc_id",
        "n_words",
        _n_hit("hits").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _n_hit(hits: str):
    return F.aggregate(hits, F.lit(0).cast("long"), lambda total, h: total + h["n"])


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the bytes from each span's first word to its last."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.lower())]
    kept, end = [], 0
    for start, n in spans:
        kept.append(raw[end : at[start][0]])
        end = at[start + n - 1][1]
    return b"".join([*kept, raw[end:]]).decode()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    max_span: int | None = 0,
    max_coverage: float = 0.0,
    text_col: str = "text",
    **options,
) -> DataFrame:
    """Documents with all their columns, less what exceeds the limits.

    A document goes if hit words make up more than `max_coverage` of its words. In documents that
    stay, spans of more than `max_span` hit words are cut from the text (None: none are). With the
    defaults every contaminated document goes and clean ones stay as they are.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, hits: pd.Series) -> pd.Series:
        spans = ([(h["start"], h["n"]) for h in hs if h["n"] > max_span] for hs in hits)
        return pd.Series([remove_spans(t, s) if s else t for t, s in zip(texts, spans, strict=True)])

    # Rows travel as one column, so that no column of theirs can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    found = annotate(rows, benchmark, **options)
    kept = found.where(_n_hit("found.hits") <= max_coverage * F.col("found.n_words"))
    if max_span is None or not max_coverage:  # no hits are left
        return kept.select("row.*")
    text = F.when(F.size("found.hits") > 0, cut("text", "found.hits")).otherwise(F.col("text"))
    return kept.select(F.col("row").withField(f"`{text_col}`", text).alias("row")).select("row.*")
