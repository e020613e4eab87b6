"""The queries opN_<name> and their SQL oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import (
    chat,
    decontamination,
    exact_dedup,
    html_text,
    language_id,
    minhash_dedup,
    sentencepiece_bpe,
    substring_dedup,
    toxicity,
    warc,
)
from quirefold.llm.common import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> bytes:
    """The public SentencePiece model; its path is a parameter of read_model."""
    import public_tokenizers

    return sentencepiece_bpe.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip(_read(spark, sf_dir, "documents"), piece_model())


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_read(spark, sf_dir, "conversations"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_groups(_read(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.drop("text_key")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    learn = language_id.fold("doc_id", 5) != 0
    model = toxicity.train(docs.where(learn), labels.where(learn))
    return toxicity.score(docs, model).select(
        "doc_id", (language_id.fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted"
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_pages(_read(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_archive(spark, path))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def language_model(spark: SparkSession, sf_dir: str) -> dict:
    """n-gram model of the labelled documents outside the held-out fold."""
    docs = _read(spark, sf_dir, "documents")
    return language_id.train(docs.where(language_id.fold("doc_id", 4) != 2))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.predict(_read(spark, sf_dir, "documents"), language_model(spark, sf_dir))
    return found.select("doc_id", (language_id.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_read(spark, sf_dir, "documents"))


OP2_SQL = """
WITH t AS (
  SELECT conv_id, count(*) AS n_turns,
         list(sha256(coalesce(role, '')) || sha256(coalesce(text, '')) ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS h,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS rendered
  FROM conversations GROUP BY 1),
p AS (SELECT DISTINCT array_to_string(list_slice(h, 1, unnest(generate_series(1, len(h) - 1))), '') AS k FROM t WHERE len(h) > 1),
w AS (SELECT array_to_string(h, '') AS k, min(conv_id) AS conv_id FROM t GROUP BY 1)
SELECT t.conv_id, t.n_turns, t.rendered FROM t JOIN w USING (conv_id) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = w.k)
"""

OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 80 * (na.n + nb.n - p.c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP6_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
hits AS (
  SELECT p.doc_id, p.s, p.k, bw.item_id
  FROM (SELECT doc_id, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win
        FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s
              FROM d, (SELECT DISTINCT k FROM bw) ks WHERE len(w) >= k)) p
  JOIN bw ON bw.win = p.win AND bw.k = p.k),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS pos FROM hits) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, n.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP7_SQL = """
WITH d AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS first, sha1(html) AS digest FROM d)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(digest, 5 * CAST(floor(i / 4) AS INT) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS INT) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""

OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n,
             array_to_string(list_slice(w, generate_subscripts(w, 1), generate_subscripts(w, 1) + 34), ' ') AS win FROM d),
f AS (SELECT doc_id, word, pos, CASE WHEN pos + 34 <= n AND count(*) OVER (PARTITION BY pos + 34 <= n, win) > 1 THEN 1 ELSE 0 END AS again FROM p),
c AS (SELECT doc_id, word, pos, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM c GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(g.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


def queries() -> dict[str, Query]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_chat_format": op2_chat_format,
        "op3_minhash_dedup": op3_minhash_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_html_extraction": op5_html_extraction,
        "op6_decontamination": op6_decontamination,
        "op7_warc": op7_warc,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_language_id": op9_language_id,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": OP2_SQL,
        "op3_minhash_dedup": OP3_SQL,
        "op6_decontamination": OP6_SQL,
        "op7_warc": OP7_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op10_substring_dedup": OP10_SQL,
    }
