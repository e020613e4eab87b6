"""Toxic spans by a linear-chain conditional random field.

Only documents carry labels, so tokens are labelled from them: in a toxic document, a word is a toxic token if it
is in the lexicon, that is if the distinct labelled texts show it far more often in toxic than in clean documents,
beyond what chance gives the number of words tried. Near copies of a toxic text count as one text. Stems, the first
letters of words outside the lexicon, enter it by the same test, so that rare forms and rare languages take part.
The lexicon is counted on a bounded sample of
labelled rows, LEXICON_DOCS documents. The two-state CRF (word and stem features, transitions) is then fitted by
gradient ascent on the token labels of a bounded sample, TRAIN_DOCS documents of either class.

Scoring runs forward-backward over every whole text. A document's score joins the marginals of its tokens (minus the
logarithm of the probability that none is toxic, as x / (1 + x)) and maps it to the share of toxic documents that the training sample
shows at that level, by monotone regression; tokens with a marginal of at least a half form the offending spans.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import Memo, checkpointed, small_or_not
from quirefold.llm.minhash_dedup import near_groups

TOKEN = re.compile(r"[^\W_]+")
#: Labelled documents (about) behind the lexicon and, of either class, the CRF; steps of its fit.
LEXICON_DOCS, TRAIN_DOCS, STEPS = 60_000, 600, 80
#: A lexicon word is in so many toxic texts at least, near copies counted once, and so many times likelier there
#: than in clean ones.
LEAST_RATIO, LEAST_DOCS = 10.0, 5
#: Letters in a stem.
STEMS = range(4, 9)
#: Ends a stem in the lexicon; no token holds it.
STEM = "-"
#: Marginals below this are no evidence.
EVIDENCE = 0.05
#: Tokens in a training sequence.
TRAIN_TOKENS = 64
#: Tokens that are decoded together.
CHAIN_TOKENS = 1_000_000
SPANS = "array<struct<start:int,end:int,probability:double>>"


class Chain:
    """Two-state chain; weights are log-potentials against the clean state."""

    def __init__(self, features: int):
        self.emit = np.full(features, -4.0)
        self.trans = np.zeros((2, 2))
        self.start = np.zeros(2)

    def marginals(self, codes: np.ndarray, lengths: np.ndarray):
        """Ratios of forward and backward weights (toxic to clean) for each token of consecutive texts.

        One step handles the t-th token of all texts that are long enough.
        """
        e = np.exp(self.emit)[codes]
        t = np.exp(self.trans)
        order = np.argsort(-lengths, kind="stable")
        begin = (np.cumsum(lengths) - lengths)[order]
        size = lengths[order]
        alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        forward, backward = np.empty(len(codes)), np.empty(len(codes))
        r = np.empty(0)
        for step, n in enumerate(alive.tolist()):
            spot = begin[:n] + step
            if step == 0:
                r = e[spot] * np.exp(self.start[1] - self.start[0])
            else:
                r = r[:n]
                r = e[spot] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
            forward[spot] = r
        last = begin + size - 1
        b = np.empty(len(size))
        for step in range(len(alive) - 1, -1, -1):
            n = alive[step]
            spot = begin[:n] + step
            ends = size[:n] == step + 1
            follow = np.where(ends, last[:n], spot + 1)
            w = e[follow] * b[:n]
            b[:n] = np.where(ends, 1.0, (t[1, 0] + t[1, 1] * w) / (t[0, 0] + t[0, 1] * w))
            backward[spot] = b[:n]
        return forward, backward, e

    def fit(self, codes: np.ndarray, lengths: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 0.3, ridge: float = 1e-6) -> None:
        """Adam on the conditional log-likelihood with a small ridge."""
        keep = lengths > 0
        lengths = lengths[keep]
        if not len(lengths):
            return
        first = np.zeros(len(codes), dtype=bool)
        first[np.cumsum(lengths) - lengths] = True
        inner = np.flatnonzero(~first)
        real = np.zeros((2, 2))
        np.add.at(real, (y[inner - 1], y[inner]), 1)
        emitted = np.bincount(codes, weights=y, minlength=len(self.emit))
        state = [np.zeros_like(x) for x in (self.emit, self.trans, self.start) for _ in "mv"]
        for i in range(1, steps + 1):
            f, b, e = self.marginals(codes, lengths)
            p = f * b / (1 + f * b)
            t = np.exp(self.trans)
            w = e[inner] * b[inner]
            pair = np.stack([np.full(len(inner), t[0, 0]), t[0, 1] * w, f[inner - 1] * t[1, 0], f[inner - 1] * t[1, 1] * w])
            pair /= pair.sum(axis=0)
            expected = pair.sum(axis=1).reshape(2, 2)
            opened = np.array([(1 - p[first]).sum(), p[first].sum()])
            observed = np.array([(1 - y[first]).sum(), y[first].sum()])
            slopes = (emitted - np.bincount(codes, weights=p, minlength=len(self.emit)), real - expected, observed - opened)
            for k, (x, g) in enumerate(zip((self.emit, self.trans, self.start), slopes, strict=True)):
                g = g / len(lengths) - ridge * x
                state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
                state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * g * g
                x += rate * (state[2 * k] / (1 - 0.9**i)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**i)) + 1e-9)


def _lexicon(labelled: DataFrame) -> list[str]:
    """Words and stems of toxic texts, from counts over the distinct labelled texts."""
    marked = checkpointed(labelled.select("doc_id", "key", "toxic"))
    texts = marked.groupBy("key").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    sides = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sides.get(1, 0), sides.get(0, 0)
    if not bad:
        return []
    # Copies of a text count once: only the row with the smallest id of each text speaks.
    speakers = small_or_not(texts.select("doc_id").distinct())
    once = labelled.join(speakers, "doc_id", "left_semi").select("key", "text", "toxic")
    # Near copies of a toxic text are one group, so that words they repeat don't look widespread.
    near = near_groups(once.where("toxic = 1"), id_col="key").select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"))
    near = small_or_not(near.distinct())
    once = once.join(near, "key", "left").select("text", "toxic", F.coalesce("group", F.lit(0)).alias("group"))
    bad = near.select("group").distinct().count()

    def telling(features) -> set[str]:
        """Features of toxic texts that chance doesn't explain; `features` gives those of a text's set of words."""

        def rows(batches):
            for batch in batches:
                for text, toxic, group in zip(batch["text"], batch["toxic"], batch["group"], strict=True):
                    found = list(features(set(TOKEN.findall(text.lower()))))
                    if found:
                        yield pd.DataFrame({"word": found, "toxic": int(toxic), "group": int(group)})

        per = once.mapInPandas(rows, "word string, toxic int, group long").groupBy("word", "toxic", "group").agg(F.count("*").alias("n"))
        sides = per.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum((1 - F.col("toxic")) * F.col("n")).alias("f"))
        counts = checkpointed(sides)
        t, f = F.col("t"), F.col("f")
        ratio = ((t + 0.5) / (bad + 1)) / ((f + 0.5) / (good + 1))
        # Chernoff's bound: fewer than one feature of all those tried is expected to get so far by chance.
        base, part = bad / (bad + good), t / (t + f)
        bits = t * F.log(part / base)
        if good:
            bits += F.when(f > 0, f * F.log((1 - part) / (1 - base))).otherwise(0.0)
        tried = math.log(max(1, counts.count()))
        kept = counts.where((t >= LEAST_DOCS) & (ratio >= LEAST_RATIO) & (bits >= tried))
        return {r["word"] for r in kept.select("word").collect()}  # of a bounded sample

    whole = telling(lambda words: words)
    shipped = once.sparkSession.sparkContext.broadcast(whole)
    stems = telling(lambda words: {w[:k] for w in words - shipped.value for k in STEMS if len(w) > k})
    return sorted(whole) + sorted(x + STEM for x in stems)


def _coder(code: dict[str, int]) -> Memo:
    """Feature of a word: its own, else that of its longest stem, else 0."""

    def of(word: str) -> int:
        found = code.get(word, 0)
        return found or next((code[x] for k in reversed(STEMS) if len(word) > k and (x := word[:k] + STEM) in code), 0)

    return Memo(of)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """CRF, lexicon and calibration from (id, text) and (id, toxic) rows."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sides = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    lot = F.pmod(F.xxhash64("doc_id", F.lit("lexicon")), F.lit(1_000_000)) / 1_000_000
    # About LEXICON_DOCS labels whatever the input, so they may be broadcast and no text shuffles.
    drawn = small_or_not(marks.where(lot < LEXICON_DOCS / max(1, sum(sides.values()))))
    lexicon = _lexicon(texts.join(drawn, "doc_id").withColumn("key", F.xxhash64("text")))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("toxic") == 1, TRAIN_DOCS / max(1, sides.get(1, 0))).otherwise(TRAIN_DOCS / max(1, sides.get(0, 0)))
    sample = marks.where(spread < share)  # about 2 * TRAIN_DOCS rows, whatever the input
    picked = texts.join(F.broadcast(sample), "doc_id").select("text", "toxic").limit(4 * TRAIN_DOCS).collect()
    code = {w: i + 1 for i, w in enumerate(lexicon)}
    coder = _coder(code)
    chain = Chain(len(lexicon) + 1)
    codes, lengths, y = [], [], []
    for text, toxic in picked:
        for line in text.lower().split("\n"):
            found = [coder[w] for w in TOKEN.findall(line)]
            codes += found
            lengths += [min(TRAIN_TOKENS, len(found) - i) for i in range(0, len(found), TRAIN_TOKENS)]
            y += [int(toxic == 1 and c > 0) for c in found]
    # Start from each feature's odds, so that words of clean texts too weigh less than certain ones.
    bad_tokens = np.bincount(codes, weights=y, minlength=len(code) + 1) if codes else np.zeros(len(code) + 1)
    all_tokens = np.bincount(codes, minlength=len(code) + 1) if codes else np.ones(len(code) + 1)
    chain.emit = np.log((bad_tokens + 0.5) / (all_tokens - bad_tokens + 0.5))
    chain.fit(np.array(codes, dtype=np.int64), np.array(lengths, dtype=np.int64), np.array(y, dtype=np.int64))
    model = {"code": code, "chain": chain, "levels": [0.0], "shares": [0.0]}
    # Calibration: the share of toxic documents at each level of evidence.
    level = np.array([p for p, _ in (_joined(*x) for x in _decode(model, coder, [t for t, _ in picked]))])
    toxic = np.array([t for _, t in picked], dtype=float)
    prior = np.where(toxic == 1, sides.get(1, 0) / max(1, toxic.sum()), sides.get(0, 0) / max(1, len(toxic) - toxic.sum()))
    if len(level):
        model["levels"], model["shares"] = _monotone(level, toxic, prior)
    return model


def _monotone(level: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[list[float], list[float]]:
    """Levels and the shares of toxic documents there, never falling: adjacent violators are pooled."""
    pools: list[list[float]] = []  # weight of toxic, weight of all, sum of weighted levels
    for x in np.unique(level):
        here = level == x
        w = float(weight[here].sum())
        pools.append([float((weight * toxic)[here].sum()), w, w * float(x)])
        while len(pools) > 1 and pools[-1][0] * pools[-2][1] <= pools[-2][0] * pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return [s / w for _, w, s in pools], [(t + 0.5 / len(level)) / (w + 1 / len(level)) for t, w, _ in pools]


def _decode(model: dict, coder: Memo, texts: list[str]):
    """Per text: marginals of its tokens. Texts are taken together up to CHAIN_TOKENS tokens."""
    get, chain = coder.__getitem__, model["chain"]
    group, size = [], 0

    def run():
        lengths = np.array([len(c) for c in group], dtype=np.int64)
        flat = np.concatenate(group) if group else np.empty(0, dtype=np.int64)
        busy = lengths > 0
        f, b, _ = chain.marginals(flat, lengths[busy])
        p = f * b / (1 + f * b)
        at = np.cumsum(lengths) - lengths
        for i, n in zip(at.tolist(), lengths.tolist(), strict=True):
            yield p[i : i + n], n

    for text in texts:
        group.append(np.array(list(map(get, TOKEN.findall(text.lower()))), dtype=np.int64))
        size += len(group[-1])
        if size >= CHAIN_TOKENS:
            yield from run()
            group, size = [], 0
    if group:
        yield from run()


def _joined(p: np.ndarray, n: int) -> tuple[float, bool]:
    """Evidence that any token is toxic, and whether some marginal reaches a half.

    Only marginals from EVIDENCE on are joined, so that the many tiny ones of a long text don't add up.
    """
    if not n:
        return 0.0, False
    top = float(p.max())
    strong = np.minimum(p[p >= EVIDENCE], 1 - 1e-12) if top >= EVIDENCE else np.array([top])
    evidence = float(-np.log1p(-strong).sum())
    return evidence / (1 + evidence), top >= 0.5


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, spans) per row: spans are character offsets of toxic tokens in the text.

    Null and empty texts have no tokens: the lowest score and no spans. Only the text enters the score.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        m = shipped.value
        coder = _coder(m["code"])
        for batch in batches:
            texts = batch["text"].tolist()
            rows = []
            for doc_id, text, (p, n) in zip(batch["doc_id"], texts, _decode(m, coder, texts), strict=True):
                level, any_toxic = _joined(p, n)
                spans = []
                if any_toxic:
                    lowered = text.lower()
                    places = text if len(lowered) == len(text) else lowered
                    spans = [{"start": t.start(), "end": t.end(), "probability": float(q)} for t, q in zip(TOKEN.finditer(places.lower()), p.tolist(), strict=True) if q >= 0.5]
                value = float(np.interp(level, m["levels"], m["shares"]))
                rows.append((doc_id, value, int(value >= 0.5), spans))
            yield pd.DataFrame(rows, columns=["doc_id", "score", "predicted", "spans"]).astype({"doc_id": "Int64"})

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return picked.mapInPandas(label, f"doc_id long, score double, predicted int, spans {SPANS}")
