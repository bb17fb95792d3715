"""Registered queries of the operators: each applies its operator, with production
parameters, to its whole table and derives the columns of its result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkdesk.llm import (ann, bpe, chat, collocation, langid, line_dedup, packing, piece_bpe, pii, simhash,
                           spelling, topk, toxicity)
from sparkdesk.llm.common import crc_bucket

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later occurrences of repeated three-line windows."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, lines_col="n_lines", removed_col="n_removed")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all conversations as a transcript writes them, their roles only in
    speaker markers of several styles that one turn in eight lacks."""
    turns = _table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", chat.with_markers(
        F.col("role"), F.col("text"), F.xxhash64("conv_id", "turn")).alias("text"))


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same transcripts with a row for each line, so no row tells where a turn starts;
    different texts of one turn follow each other by text hash."""
    turns = transcripts(spark, sf_dir).withColumn("version", F.xxhash64("text"))
    return turns.select("conv_id", "turn", "version", F.posexplode_outer(F.split("text", "\n")).alias("line", "text"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role and turn start of every line of all transcripts, and its canonical form, by the
    model estimated from them."""
    found = chat.parse(transcript_lines(spark, sf_dir), ["turn", "version", "line"], rounds=chat.ROUNDS)
    return found.select("conv_id", "turn", "line", "role", "starts", "content", "rendered")


def op3_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found, by cosine, of every vector whose id 50 divides."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    found = pii.find(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.BASE],
                        F.sha2(pii.joined(base), 256).alias("base_sha256"),
                        pii.joined(F.col("spans")).alias("spans"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences of all documents."""
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every vector whose id 20 divides."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; rows with crc32(doc_id) mod 5 = 0 are held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    net = toxicity.fit(docs.where(~held_out), labels.where(~held_out))
    return toxicity.score(docs, net).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the byte-level ranks and decoded again, as digests."""
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)
    both = bpe.decode(encoded, BYTE_BPE, public_tokenizers.PATTERN)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document (3-word shingles, 2 bits)."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; rows with crc32(doc_id) mod 4 = 2 are held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"),
                                              "lang_pred", "score")


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the piece model, with an end id, and decoded again, as digests."""
    encoded = piece_bpe.encode(_table(spark, sf_dir, "documents"), PIECE_BPE)
    both = piece_bpe.decode(encoded, PIECE_BPE)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the documents, whose words lose a letter in
    one of 31 (document, word) places."""
    words = spelling.word_counts(_table(spark, sf_dir, "documents"), drop_every=31)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two to three words of each language."""
    found = collocation.best(collocation.collocations(_table(spark, sf_dir, "documents")))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


LLM_QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_hilbert_ann": op3_hilbert_ann,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_topk": op6_topk,
    "op7_toxicity": op7_toxicity,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_simhash": op9_simhash,
    "op10_langid": op10_langid,
    "op11_piece_bpe": op11_piece_bpe,
    "op12_spelling": op12_spelling,
    "op13_collocation": op13_collocation,
}

LLM_ORACLE: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op6_topk": topk.ORACLE,
    "op13_collocation": collocation.ORACLE,
}
