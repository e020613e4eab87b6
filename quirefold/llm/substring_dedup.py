"""Removal of repeated word windows by super-k-mer partitioning.

A window's minimiser is the smallest hash among its m-word parts. Equal windows have equal minimisers,
and neighbouring windows mostly share theirs, so a run of consecutive windows with one minimiser (a
super-k-mer) travels as one packed string of its windows' 64-bit hashes, under the minimiser's
64 bits, to the bucket of that minimiser. There a sort puts equal windows side by side and counts
them exactly; their 64-bit hashes, under one minimiser, decide that two windows are equal.

Hot buckets. A sample of documents (SAMPLE_SHARE of them, HOT_SAMPLE at least) estimates the super-k-mers under
each minimiser of the corpus; minimisers with more than HOT_ROWS of them are hot, of which there are at most
all super-k-mers / HOT_ROWS. Windows under a hot minimiser are dealt one by one, by their own hash, and are
counted as they stream by, however many they are. Those of them that the sample itself holds HOT_TIMES times or more
(the HOT_WINDOWS most frequent hashes, broadcast) are thereby known to repeat: they are resolved map-side
and never meet in a task. Both lists steer the dealing only; the result is the same without them.
Copies of a document are not special: results are keyed by (id, text hash).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import checkpointed
from quirefold.llm.words import WordHashes, mix, sliding_min, windows

WINDOW = 35
#: Words in a part from which the minimiser is chosen.
PART = 4
HOT_SAMPLE, SAMPLE_SHARE, HOT_ROWS, HOT_TIMES, HOT_WINDOWS = 10_000, 0.01, 100_000, 8, 400_000
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
PACKED = "bucket long, doc_id long, text_hash long, start int, n int, packed binary"


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def _pairs(flags: np.ndarray) -> list[tuple[int, int]]:
    starts, sizes = _runs(flags)
    return list(zip(starts.tolist(), sizes.tolist(), strict=True))


class SuperKmers:
    """Cuts texts into super-k-mers."""

    def __init__(self, window: int, part: int):
        self.window, self.part, self.hashes = window, min(part, window), WordHashes()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Window hashes; starts, lengths and minimisers of the super-k-mers."""
        h = self.hashes(text.encode().split())
        w = windows(h, self.window)
        if not len(w):
            none = np.empty(0, dtype=np.int64)
            return w, none, none, w
        low = sliding_min(mix(windows(h, self.part)), self.window - self.part + 1)
        starts = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
        return w, starts, np.diff(np.append(starts, len(w))), low[starts]


def _hot(docs: DataFrame, window: int, part: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hot minimisers and the sorted windows under them that surely repeat."""
    none = np.empty(0, np.uint64)
    total = docs.count()
    if not total:
        return none, none
    share = min(1.0, max(sample / total, SAMPLE_SHARE))
    picked = (docs if share == 1 else docs.sample(fraction=share, seed=7)).select("text")

    def minimisers(batches):
        cut = SuperKmers(window, part)
        for batch in batches:
            lows = [cut(text)[3] for text in batch["text"]]
            if lows:
                yield pd.DataFrame({"low": np.concatenate(lows).view(np.int64)})

    counts = checkpointed(picked.mapInPandas(minimisers, "low long").groupBy("low").agg(F.count("*").alias("n")))
    # HOT_ROWS in the corpus; tables of a few million super-k-mers call what holds a 2,000th of them hot.
    least = max(64, min(share * HOT_ROWS, (counts.agg(F.sum("n")).first()[0] or 0) / 2_000))
    lows = [r[0] for r in counts.where(F.col("n") >= least).select("low").collect()]  # bounded, see above
    if not lows:
        return none, none
    hot = np.sort(np.array(lows, dtype=np.int64).view(np.uint64))

    def hot_windows(batches):
        cut = SuperKmers(window, part)
        for batch in batches:
            for text in batch["text"]:
                w, _, sizes, low = cut(text)
                if len(w):
                    yield pd.DataFrame({"w": w[np.repeat(np.isin(low, hot), sizes)].view(np.int64)})

    known = picked.mapInPandas(hot_windows, "w long").groupBy("w").agg(F.count("*").alias("n"))
    frequent = known.where(F.col("n") >= HOT_TIMES).orderBy(F.desc("n"), "w").select("w").limit(HOT_WINDOWS).collect()  # bounded
    return hot, np.sort(np.array([r[0] for r in frequent], dtype=np.int64).view(np.uint64))


def repeated_ranges(
    docs: DataFrame, window: int = WINDOW, part: int = PART, sample: int = HOT_SAMPLE
) -> DataFrame:
    """(doc_id, text_hash, start, n): n windows from word `start` on whose sequence starts elsewhere too.

    docs: doc_id, text_hash, text (not null).
    """
    lists = docs.sparkSession.sparkContext.broadcast(_hot(docs, window, part, sample))

    def cut(batches):
        make, (hot_lows, known) = SuperKmers(window, part), lists.value
        for batch in batches:
            out: list[tuple] = []
            for doc_id, key, text in zip(batch["doc_id"], batch["text_hash"], batch["text"], strict=True):
                w, starts, sizes, lows = make(text)
                if not len(w):
                    continue
                raw, signed = w.tobytes(), w.view(np.int64)
                heat = np.isin(lows, hot_lows) if len(hot_lows) else None
                for i, (s, n, low) in enumerate(zip(starts.tolist(), sizes.tolist(), lows.view(np.int64).tolist(), strict=True)):
                    if heat is not None and heat[i]:
                        sure = np.isin(w[s : s + n], known)
                        out.extend((key ^ (s + j), doc_id, key, s + j, m, b"") for j, m in _pairs(sure))
                        out.extend((int(signed[j]), doc_id, key, j, 1, raw[8 * j : 8 * j + 8]) for j in (s + np.flatnonzero(~sure)).tolist())
                    else:
                        out.append((low, doc_id, key, s, n, raw[8 * s : 8 * (s + n)]))
                if len(out) >= 50_000:
                    yield _frame(out)
                    out = []
            if out:
                yield _frame(out)

    def _frame(rows):
        return pd.DataFrame(rows, columns=["bucket", "doc_id", "text_hash", "start", "n", "packed"]).astype({"doc_id": "Int64"})

    def count(batches):
        rest, last = None, None  # an unfinished bucket; a hot window's hash if it was seen and is known to repeat
        for batch in batches:
            if last is not None:
                known = batch["bucket"].to_numpy() == last
                if known.all():  # no need to gather them
                    yield batch[["doc_id", "text_hash", "start", "n"]]
                    continue
                if known.any():
                    yield batch.loc[known, ["doc_id", "text_hash", "start", "n"]]
                    batch = batch.loc[~known]
                last = None
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            tail = int(np.searchsorted(batch["bucket"].to_numpy(), batch["bucket"].iloc[-1]))
            rest = batch.iloc[tail:]
            if len(rest) > 1 and dealt_alone(rest):
                last, rest, tail = int(rest["bucket"].iloc[0]), None, len(batch)
            if tail:
                yield marked(batch.iloc[:tail])
        if rest is not None and len(rest):
            yield marked(rest)

    def dealt_alone(rows: pd.DataFrame) -> bool:
        """Whether a bucket holds rows of one window, dealt by its hash."""
        key = int(rows["bucket"].iloc[0]).to_bytes(8, "little", signed=True)
        return bool((rows["packed"] == key).all())

    def marked(rows: pd.DataFrame) -> pd.DataFrame:
        """Sort all windows of whole buckets and mark those that have an equal neighbour."""
        sure = rows["packed"].str.len().to_numpy() == 0
        known, rows = rows.loc[sure, ["doc_id", "text_hash", "start", "n"]], rows[~sure]
        n = rows["n"].to_numpy()
        w = np.frombuffer(b"".join(rows["packed"]), dtype=np.uint64)
        order = np.argsort(w)
        ordered, bucket = w[order], np.repeat(rows["bucket"].to_numpy(), n)[order]
        # Equal hashes of two buckets are as good as impossible, and then are not neighbours' equals.
        same = (ordered[1:] == ordered[:-1]) & (bucket[1:] == bucket[:-1])
        twice = np.zeros(len(w), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        offsets = np.concatenate(([0], np.cumsum(n)))
        # Runs of marked windows, cut at the borders of rows.
        padded = np.zeros(len(w) + len(n), dtype=bool)
        spot = np.arange(len(w)) + np.repeat(np.arange(len(n)), n)
        padded[spot] = twice
        starts, sizes = _runs(padded)
        row = np.searchsorted(offsets[:-1] + np.arange(len(n)), starts, side="right") - 1
        at = starts - (offsets[row] + row)
        picked = rows.iloc[row]
        found = pd.DataFrame(
            {
                "doc_id": picked["doc_id"].array,
                "text_hash": picked["text_hash"].to_numpy(),
                "start": (picked["start"].to_numpy() + at).astype(np.int32),
                "n": sizes.astype(np.int32),
            }
        )
        return pd.concat([known, found]).astype({"doc_id": "Int64"})

    packed = docs.select("doc_id", "text_hash", "text").mapInPandas(cut, PACKED)
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(count, "doc_id long, text_hash long, start int, n int")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, part: int = PART
) -> DataFrame:
    """(doc_id, text, n_words, n_removed): each text without the words of windows that occur elsewhere too.

    Windows are judged on the input, so every copy of a repeated passage goes, the first too. Kept
    words are joined by one space. Null and texts shorter than a window keep all their words. Rows that
    repeat id and text count as two occurrences; rows that repeat only the id are told apart by
    their text's hash. Other columns are ignored.
    """
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    found = repeated_ranges(keyed, window, part)
    ranges = found.groupBy("doc_id", "text_hash").agg(
        F.collect_list("start").alias("starts"), F.collect_list("n").alias("sizes")
    )
    right = ranges.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "starts", "sizes")
    joined = keyed.join(
        right, (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left"
    )

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, text, starts, sizes in zip(batch["doc_id"], batch["text"], batch["starts"], batch["sizes"], strict=True):
                words = text.encode().split()
                total = len(words)
                if starts is not None:
                    edges = np.zeros(total + 1, dtype=np.int64)
                    begin = np.asarray(starts, dtype=np.int64)
                    np.add.at(edges, begin, 1)
                    np.add.at(edges, begin + np.asarray(sizes, dtype=np.int64) + window - 1, -1)
                    keep = np.cumsum(edges[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                rows.append((doc_id, b" ".join(words).decode(), total, total - len(words)))
            frame = pd.DataFrame(rows, columns=["doc_id", "text", "n_words", "n_removed"])
            yield frame.astype({"doc_id": "Int64"})

    picked = joined.select("doc_id", "text", "starts", "sizes")
    return picked.mapInPandas(cut, "doc_id long, text string, n_words long, n_removed long")


def digest(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of `remove_repeats`."""
    return remove_repeats(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
