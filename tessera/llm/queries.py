"""One query for each corpus operator, over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, fingerprints, jaccard, langid, mixing, pii, quality, tokencount, toxicity, warc
from tessera.llm.common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    model = langid.fit_filter(docs.filter(~held).select("doc_id", "text", "lang"))
    # The id's remainder is known from the id alone, so no second read of the texts is needed for it.
    return langid.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["n_entities", *(f"n_{x}" for x in pii.PATTERNS)]
    return pii.replace_entities(_table(spark, sf_dir, "documents"), counts=True).select("doc_id", "text", *names)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = crc_mod("doc_id", 3) == 1
    model = toxicity.fit(docs, labels.filter(~held))
    return toxicity.score_documents(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_source_mixing": op3_source_mixing,
    "op4_warc": op4_warc,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_toxicity": op8_toxicity,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_token_counts": op10_token_counts,
}

#: Base 32 of a SHA-1 digest: each five hexadecimal digits are twenty bits, hence four letters.
_BASE32 = (
    "array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    "(((('0x' || substr(h, CAST(g * 5 + 1 AS INTEGER), 5))::BIGINT >> CAST(15 - 5 * k AS INTEGER)) & 31) + 1)::INTEGER, 1) "
    "FOR k IN [0, 1, 2, 3]], '') FOR g IN [0, 1, 2, 3, 4, 5, 6, 7]], '')"
)

ORACLE_SQL: dict[str, str] = {
    "op4_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)
""",
    "op9_ngram_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(t) < 4 THEN array_to_string(t, ' ') ELSE array_to_string(t[i:i + 3], ' ') END AS g
  FROM (SELECT doc_id, t, unnest(generate_series(1, greatest(1, len(t) - 3))) AS i FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT u, v FROM x JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)),
both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT b.v, r.root FROM reach r JOIN both_ways b ON b.u = r.doc_id)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
""",
}
