"""A corpus pipeline over documents: language ID, exact and near deduplication, mixing and encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import exact_dedup, language_id, minhash_dedup, mixing, sentencepiece_codec
from gradus.llm.common import Scratch, fresh

#: A document stays if a language is found whose share is this at least.
MIN_SCORE = 0.5


def beside(docs: DataFrame, added: set[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(docs) with the columns of docs alone; those whose names run adds itself are called otherwise meanwhile."""
    called = [fresh(docs, "_" + c) if c.lower() in added else c for c in docs.columns]
    found = run(docs.toDF(*called))
    return found.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(called, docs.columns, strict=True)])


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a learned language; learned from the labelled ones.

    A null or empty text, or one without a letter, goes; of a text of any length the whole counts. Where no row is labelled there is nothing to reject
    by, and only texts without a letter go. Repeated rows share their fate; an empty table stays empty; other columns, of any name, are kept as they are.
    """
    model = language_id.fit(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    known = (F.col("_lang_pred") != language_id.UNKNOWN) & (F.col("_lang_score") >= MIN_SCORE)
    return beside(docs, {"_lang_pred", "_lang_score"}, lambda d: language_id.predicted(d, model).filter(known))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts: the longest original, then the smallest id.

    Null and empty texts are one group. Of repeated rows one stays. An empty table stays empty; other columns, of any name, are kept as they are.
    """
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of the smallest id.

    Null, empty and blank texts are linked with nothing and stay. Texts of any length count whole. An empty table stays empty; other columns, of any name, are kept as they are.
    """
    return minhash_dedup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws as many tokens as there are, no source more than 1.25 times; a document that is drawn again comes again.

    A null source is a source of its own. Null and empty texts have no tokens and are drawn with the blocks that they are in; a source of such texts
    alone isn't drawn. Repeated rows are drawn together; an empty table stays empty; other columns, of any name, are kept as they are.
    """
    return beside(docs, {"_mix"}, lambda d: mixing.mixed(d, mixing.Mix(max_repeats=1.25)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of a sampled segmentation of each document: doc_id, source, lang, ids, n_pieces, lossless; other columns go.

    A null text has null ids, an empty one none. Texts of any length are encoded whole. Repeated rows get equal ids; an empty table stays empty.
    """
    found = sentencepiece_codec.encoded(docs.select("doc_id", "text", "source", "lang"))
    return found.select("doc_id", "source", "lang", F.col("_ids").alias("ids"), F.col("_n_pieces").alias("n_pieces"), F.col("_lossless").alias("lossless"))


STAGES = [("language_id", identify), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("sentencepiece", encode)]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what each keeps is written to the shared folder and read again, and what it was made from is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.written(docs, name)
            scratch.close(docs)
    return docs
