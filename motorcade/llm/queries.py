"""Registered queries of the text operators; each reads its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorcade.llm import ann, classifier, langid, mixing, neardup, packing, pii, quality, tokens, toxicity
from motorcade.llm.common import id_crc, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.references(docs))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "n_tokens", F.map_entries("posteriors").alias("posteriors"), "rate", "missed")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grammar = toxicity.fit(docs, labels.where(id_crc("doc_id") % 3 != 1))
    scored = toxicity.score(docs, grammar)
    return scored.select("doc_id", (id_crc("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= toxicity.REJECT_AT).cast("int").alias("predicted"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classifier.rate(docs, classifier.fit(docs, labels))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs.where(id_crc("doc_id") % 4 != 2)))
    return found.select("doc_id", (id_crc("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_quality_divergence, op3_mixing, op4_token_counts, op5_toxicity, op6_quality_classifier, op7_near_duplicates, op8_language, op9_packing, op10_neighbours)
}
#: Exact components over all pairs that share a shingle. The other queries have no SQL form: they learn weights, run
#: tokenizer files, or use look-around patterns; tests compare them with brute force or held-out labels.
ORACLE: dict[str, str] = {
    "op7_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w
), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN s sx ON sx.doc_id = x JOIN s sy ON sy.doc_id = y WHERE 100 * c >= 80 * (len(sx.sh) + len(sy.sh) - c)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y)
SELECT s.doc_id, len(s.sh) AS n_shingles, min(r.y) AS component_id, s.doc_id = min(r.y) AS kept FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.sh)
""",
}
