"""A training-corpus pipeline: language ID, exact dedup, near-dedup, decontamination, SentencePiece.

Each stage reads all that its predecessor kept, from Parquet, and returns the columns of `documents`, except for the
last, which returns the encoded documents. Rows that repeat a doc_id are carried along; null and
empty texts have no language and go in the first stage.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import decontamination, exact_dedup, language_id, minhash_dedup, queries, sentencepiece_bpe
from quirefold.llm.common import arrow_rows, hand_back_all, remove, shared_dir, small_or_not


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; `lang` becomes the predicted language, where it was null.

    The model learns from the labelled documents of the stage's own input.
    """
    model = language_id.train(docs.where(language_id.fold("doc_id", 4) != 2))
    # Rows travel as one column, so that no column of theirs can clash.
    found = language_id.with_language(docs.select(F.struct("*").alias("row"), "text"), model)
    told = found.where(F.col("lang_pred") != language_id.UNKNOWN)
    return told.select(F.col("row").withField("lang", F.coalesce("row.lang", "lang_pred")).alias("row")).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity of 0.8 or more) the document with the smallest doc_id.

    Rows that repeat a doc_id are told apart by their texts.
    """
    gone = minhash_dedup.near_groups(docs).where("NOT kept").select("doc_id", "text_key").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    return rows.join(small_or_not(gone), ["doc_id", "text_key"], "left_anti").select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; clean ones stay as they are."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text that they decode to."""
    return sentencepiece_bpe.round_trip(docs, queries.piece_model())


def _lean(stage):
    """The stage, begun with the memory that executors and Python workers really use."""

    @wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        hand_back_all(spark)
        return stage(spark, docs, sf_dir)

    return begin


STAGES = [
    ("language_id", _lean(language_stage)),
    ("exact_dedup", _lean(exact_stage)),
    ("minhash_dedup", _lean(near_stage)),
    ("decontamination", _lean(decontamination_stage)),
    ("sentencepiece", _lean(encoding_stage)),
]

#: SQL can't express language identification or BPE; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each result is written to the shared folder and read again, then removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{base}/{name}"
        with arrow_rows(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
