"""Corpus pipeline over ``documents``: language ID, line dedup, SimHash near-dedup, PII
masking, packing.

Each stage takes ``(spark, docs, sf_dir)``, calls one operator of
``sparkdesk.llm`` and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``.  All but the last return the columns of
``docs``; where the text changes, ``n_chars`` follows it.  Nulls, empty texts,
repeated rows, empty tables and extra columns are treated as the operators'
docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkdesk.llm import langid, line_dedup, packing, pii, simhash
from sparkdesk.llm.common import crc_bucket
from sparkdesk.session import materialize

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, as the length of the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
                         else F.col(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the labelled part (crc32(doc_id) mod 4 not 2);
    texts without a letter and texts that no language codes well go."""
    held_out = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    return langid.keep_known(docs, langid.fit(docs.where(~held_out)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated three-line windows."""
    return _recounted(line_dedup.dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (3-word shingles, 2 bits)."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in brackets."""
    return _recounted(pii.mask(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences of what is left."""
    pieces = packing.pack_documents(docs, WORD_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("simhash", near_duplicates),
    ("pii", personal_data),
    ("packing", pack),
]

#: SQL cannot express language models, fingerprints or tokenizers; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
