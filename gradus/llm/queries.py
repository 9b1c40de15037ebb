"""The registered queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, exact_dedup, hard_negatives, language_id, lattice_lm, lz_fingerprint, merkle, minhash_dedup, mixing, quotation, recompression, sentencepiece_codec, sharding
from .common import crc_mod, until_end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.without_repeats(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.linked(table(spark, sf_dir, "conversations"))


def chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 where messages quote: to each message of the table, passages of the two before it are added as with_quotes() states."""
    return quotation.linked(quotation.with_quotes(table(spark, sf_dir, "conversations")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_codec.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_ids").alias("ids"), F.col("_n_pieces").alias("n_pieces"), F.col("_lossless").alias("lossless"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.fit(docs.filter(~held_out))
    found = language_id.predicted(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four arrivals of documents, by a hash of the id: a half, a quarter, and an eighth twice; then compaction. One row for each document: its shard. The store goes when the application ends."""
    docs = table(spark, sf_dir, "documents")
    shards = sharding.Shards(spark, until_end(spark, "shards"))
    part = F.coalesce(crc_mod(F.col("doc_id"), 8), F.lit(7))
    for low, high in ((0, 4), (4, 6), (6, 7), (7, 8)):
        shards.append(docs.filter((part >= low) & (part < high)))
    version = shards.compact(docs.schema)
    live = shards.manifest(version).select(F.col("path").alias("_shard"), F.col("bytes").alias("shard_bytes"), F.col("n_rows").alias("shard_rows"), "tier")
    rows = shards.read(docs.schema, version).select("doc_id", "_shard")
    return rows.join(F.broadcast(live) if live.count() <= sharding.FILES_A_PASS else live, "_shard").select("doc_id", F.element_at(F.split("_shard", "/"), -1).alias("shard"), "shard_bytes", "shard_rows", "tier", F.lit(version).alias("version"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 1, F.lit(False))
    found = lattice_lm.scored(docs.select("doc_id", held_out.alias("held_out"), "text"), ~F.col("held_out"))
    return found.select("doc_id", "held_out", "_lm.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_groups(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), mixing.Mix()).select("doc_id", "source", "_mix.*")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe_codec.encoded(table(spark, sf_dir, "documents"), keep=["doc_id"])
    ids = F.array_join(F.col("_ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("_decoded", 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_substring_dedup, op2_chat_formatting, chat_quotes, op3_sentencepiece, op4_language_id, op5_sharding, op6_lm_scoring, op7_exact_dedup, op8_lz_fingerprint, op9_near_dedup, op10_mixing, op11_merkle_manifest, op12_bpe, op13_hard_negatives]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": quotation.SQL, "chat_quotes": quotation.SQL_OF_QUOTES, "op7_exact_dedup": exact_dedup.SQL, "op11_merkle_manifest": merkle.SQL, "op13_hard_negatives": hard_negatives.SQL}
