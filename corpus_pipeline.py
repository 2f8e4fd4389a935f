"""Corpus pipeline over `documents`: toxicity, near-duplicates, PII, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns
of documents. run() writes every stage's result to the shared folder and reads it back.

Edge cases: nulls in any column, empty and very long texts are handled as each operator states; a document with a null
text is kept by all stages and packed as one end id; repeated rows go through all stages each; a row without an id is no
near-duplicate of another; further columns of documents, whatever their names, stay; empty tables give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorcade.llm import mixing, neardup, packing, pii, toxicity
from motorcade.llm.common import id_crc, table, written

#: Label rows are few and their toxic part fewer; rows whose id's crc32 leaves 1 by 3 are never learnt from.
HELD_OUT = (3, 1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the rejection threshold."""
    labels = table(spark, sf_dir, "labels").where(id_crc("doc_id") % HELD_OUT[0] != HELD_OUT[1])
    grammar = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, grammar, keep=tuple(docs.columns))
    return scored.where(F.col("score") < toxicity.REJECT_AT).select("kept.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates: shingles of five words, similarity 0.8 or more."""
    stays = neardup.near_duplicates(docs, width=5, percent=80).where("kept").select("doc_id")
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    return rows.join(stays, rows["doc.doc_id"].eqNullSafe(stays["doc_id"]), "left_semi").select("doc.*")


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by tags."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their rates; no domain shrinks and each document stays at least once."""
    mixed = mixing.mix(docs, table(spark, sf_dir, "labels"), least=1.0, grow=True, keep=tuple(docs.columns))
    return mixed.select("kept", F.explode(F.sequence(F.lit(1), mixing.copies())).alias("copy")).select("kept.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("pii", redact_pii), ("mixing", mix_sources), ("packing", pack_windows)]

#: Learnt weights, iterated components and tokenizer ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
