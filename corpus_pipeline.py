"""Corpus pipeline: documents in, token ids out. Each stage works on all its predecessor kept; run() writes each
stage's rows as Parquet to the shared folder and rereads them as the next stage's documents.

All stages: extra columns of any name are kept (the last stage ignores them), an empty table gives an empty table, texts
are read whole. What rows with nulls, empty texts or equal ids get is said at each stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import decontam, langid, lines, pieces, similar
from marginalia.llm.common import stored, table

#: SQL has neither the profiles of the first stage nor the fingerprints of the third.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language isn't found go: null texts, texts without a letter, long texts unlike every language. A null id or
    lang changes nothing; equal rows fare alike."""
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; no row goes. A null text stays null, an empty one empty; rows with a null id count
    as one document; rows with one id lose the same lines."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: five-word shingles, similarity 0.8 or more, or nearly equal fingerprints.
    Texts without words are one group. Rows with a null id stay; rows with one id stay or go together."""
    return similar.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go. Null and empty texts hold none; ids play no part; an empty benchmark keeps all."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids), a row a document. Null and empty texts have no ids; a null id is carried through."""
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
