"""Language identification by multilingual mixture inference.

A document is a mixture of languages. Each word has a likelihood under each language, from smoothed character
n-grams of the word with its borders. Expectation-maximisation over the words estimates the languages'
proportions; the set of languages grows while the penalised likelihood (BIC) grows. The prediction is the
language with the largest proportion of that set, the score its proportion.

The n-gram model is a classifier and is fitted on a bounded sample of labelled rows: about TRAIN_DOCS whole
documents a language, chosen by a hash of the text; all their n-grams and all languages enter it.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import small_or_not, worker_state

TRAIN_DOCS = 1_000
GRAM, ROUNDS, SMOOTH = 3, 12, 0.2
#: Words whose likelihoods a worker remembers at most, and bytes that the likelihoods take.
KNOWN_WORDS, KNOWN_BYTES = 200_000, 32_000_000
#: Tokens whose mixtures are inferred together.
BATCH_TOKENS = 20_000
WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double, proportions map<string,double>"


def letters(text: str) -> list[str]:
    """Runs of letters, in lower case. Superscripts, fractions and the like are word characters but no letters."""
    words = WORDS.findall(text.lower())
    if words and not "".join(words).isalpha():
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return words


def grams(word: str) -> list[str]:
    """Character n-grams of a word with its borders; short words give what they have."""
    w = f" {word} "
    return [w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_DOCS) -> dict:
    """Model of (text, lang) rows without nulls, from about `per_lang` documents a language."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").count()
    share = counts.select("lang", F.least(F.lit(1.0), per_lang / F.col("count")).alias("share"))
    picked = rows.join(small_or_not(share), "lang").where(
        F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.col("share") * 1_000_000
    )

    def count(batches):
        for batch in batches:
            found: dict[str, Counter] = {}
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                words = found.setdefault(lang, Counter())
                words.update(letters(text))
            for lang, words in found.items():
                tally: Counter = Counter()
                for word, n in words.items():
                    for g in grams(word):
                        tally[g] += n
                if tally:
                    yield pd.DataFrame({"lang": lang, "gram": list(tally), "n": list(tally.values())})

    total = picked.mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kept = total.orderBy("lang", "gram").toPandas()  # n-grams of the bounded sample
    langs = sorted(kept["lang"].unique())
    known = sorted(kept["gram"].unique())
    table = np.zeros((len(known) + 1, len(langs)))
    at = {g: i for i, g in enumerate(known)}
    column = {x: i for i, x in enumerate(langs)}
    np.add.at(table, (kept["gram"].map(at).to_numpy(dtype=int), kept["lang"].map(column).to_numpy(dtype=int)), kept["n"])
    table = np.log((table + SMOOTH) / (table.sum(axis=0) + SMOOTH * len(table))) if langs else table
    return {"key": uuid.uuid4().hex, "langs": langs, "grams": at, "table": table.astype(np.float32)}


class Mixture:
    """Infers language proportions with a trained model."""

    def __init__(self, model: dict):
        self.langs, self.grams, self.table = model["langs"], model["grams"], model["table"]
        self.rest = len(self.grams)
        self._reset()

    def _reset(self) -> None:
        self.words: dict[str, int] = {}
        self.rows = np.empty((1024, len(self.langs)), dtype=np.float32)

    def _learn(self, words: set[str]) -> None:
        """Likelihoods of words that aren't known yet, all at once."""
        fresh = words - self.words.keys()
        if len(self.words) + len(fresh) > min(KNOWN_WORDS, KNOWN_BYTES // (4 * len(self.langs))):
            self._reset()
            fresh = words
        if not fresh:
            return
        get, rest = self.grams.get, self.rest
        spots: list[int] = []
        begin = []
        for word in fresh:
            begin.append(len(spots))
            spots += [get(g, rest) for g in grams(word)]
        sums = np.add.reduceat(self.table[spots], begin, axis=0)
        at = len(self.words)
        if at + len(fresh) > len(self.rows):
            more = np.empty((max(len(self.rows), at + len(fresh) - len(self.rows)), len(self.langs)), dtype=np.float32)
            self.rows = np.concatenate([self.rows, more])
        self.rows[at : at + len(fresh)] = np.exp(np.maximum(sums - sums.max(axis=1, keepdims=True), -30.0))
        self.words.update(zip(fresh, range(at, at + len(fresh)), strict=True))

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """Likelihood of each word under each language, relative to its best one; the words were learned before."""
        return self.rows[list(map(self.words.__getitem__, words))]

    @staticmethod
    def _em(p: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihoods of documents after some rounds of expectation-maximisation.

        p holds the tokens of all documents, `begin` their first rows.
        """
        theta = np.full((len(sizes), p.shape[1]), 1.0 / p.shape[1])
        if p.shape[1] > 1:
            for _ in range(ROUNDS):
                share = p * np.repeat(theta, sizes, axis=0)
                share /= share.sum(axis=1, keepdims=True)
                theta = np.add.reduceat(share, begin, axis=0) / sizes[:, None]
        fit = np.log((p * np.repeat(theta, sizes, axis=0)).sum(axis=1) + 1e-30)
        return theta, np.add.reduceat(fit, begin)

    def infer_all(self, texts: list[str | None]) -> list[dict[str, float]]:
        """Per text the proportions of the selected languages; empty if it has no letter."""
        out: list[dict[str, float]] = [{} for _ in texts]
        if not self.langs:
            return out
        group: list[tuple[int, list[str]]] = []
        tokens = 0
        for i, text in enumerate(texts):
            words = letters(text) if text else None
            if words:
                group.append((i, words))
                tokens += len(words)
                if tokens >= BATCH_TOKENS:
                    self._group(group, out)
                    group, tokens = [], 0
        if group:
            self._group(group, out)
        return out

    def _group(self, group: list[tuple[int, list[str]]], out: list[dict[str, float]]) -> None:
        """Grow every document's set of languages, by proportion, while its penalised likelihood grows."""
        self._learn({w for _, words in group for w in words})
        p = np.concatenate([self.likelihoods(x) for _, x in group]).astype(np.float64)
        sizes = np.array([len(x) for _, x in group])
        spot = np.array([i for i, _ in group])
        theta, _ = self._em(p, np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(-theta, axis=1, kind="stable")
        penalty = 0.5 * np.log(sizes + 1.0) + 3.0
        best = np.full(len(spot), -np.inf)
        weights: list[np.ndarray] = [np.ones(1)] * len(spot)
        live = np.arange(len(spot))  # documents whose set may still grow
        for size in range(1, len(self.langs) + 1):
            n = sizes[live]
            rows = np.repeat(np.isin(np.arange(len(spot)), live), sizes)
            part = np.take_along_axis(p[rows], np.repeat(order[live, :size], n, axis=0), axis=1)
            t, fit = self._em(part, np.cumsum(n) - n, n)
            value = fit - penalty[live] * size
            grows = value > best[live]
            for k in np.flatnonzero(grows).tolist():
                weights[live[k]] = t[k]
            best[live] = np.maximum(best[live], value)
            live = live[grows]
            if not len(live):
                break
        for i, chosen, weight in zip(spot.tolist(), order.tolist(), weights, strict=True):
            out[i] = {self.langs[c]: float(w) for c, w in zip(chosen, weight.tolist(), strict=False)}


def _top(found: dict[str, float]) -> str:
    return max(found, key=lambda x: (found[x], [-ord(c) for c in x])) if found else UNKNOWN


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, proportions) per row, from its whole text alone.

    Null texts and texts without a letter get `und`, score 0 and no proportions, and so does every
    text if there was nothing to learn from. Ties go to the language that sorts first.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        model = shipped.value
        mixture = worker_state(model["key"], lambda: Mixture(model))
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch["doc_id"], mixture.infer_all(batch["text"].tolist()), strict=True):
                top = _top(found)
                rows.append((doc_id, top, min(1.0, found.get(top, 0.0)), found))
            out = pd.DataFrame(rows, columns=["doc_id", "lang_pred", "score", "proportions"])
            yield out.astype({"doc_id": "Int64"})

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(label, SCHEMA)


def with_language(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "lang_pred") -> DataFrame:
    """Append the predicted language to rows with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def label(texts: pd.Series) -> pd.Series:
        model = shipped.value
        mixture = worker_state(model["key"], lambda: Mixture(model))
        return pd.Series([_top(x) for x in mixture.infer_all(texts.tolist())], index=texts.index)

    # Not to be evaluated again for each use of the column.
    return docs.withColumn(out_col, label.asNondeterministic()(F.col(text_col)))


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo the number of folds; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
