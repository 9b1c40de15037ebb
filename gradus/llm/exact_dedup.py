"""Exact deduplication by skew-safe combining of salted digest groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, numbered


def _grouped(rows: DataFrame, salts: int) -> DataFrame:
    """rows (file, place, doc_id, text) -> (file, place, doc_id, keep_id, group_size, kept, text_sha256)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.select("file", "place", F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).alias("n"), F.translate(text, SPACE, "").alias("norm"))
    rows = rows.withColumns({"sha": F.sha2("norm", 256), "check": F.xxhash64("norm"), "norm_n": F.char_length("norm")})
    best = F.max(F.struct("n", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("not_id"), F.bitwise_not("place").alias("not_place"), "file"))
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("sha", "check", "norm_n", "norm", "salt")
        .agg(best.alias("best"), F.count("*").alias("size"))
    )
    winners = (
        salted.groupBy("sha", "check", "norm_n", "norm")
        .agg(F.max("best").alias("best"), F.sum("size").alias("group_size"))
        .select("sha", "check", "norm_n", F.bitwise_not("best.not_id").alias("keep_id"), F.bitwise_not("best.not_place").alias("keep_place"), F.col("best.file").alias("keep_file"), "group_size")
    )
    found = rows.select("file", "place", "doc_id", "sha", "check", "norm_n").join(winners, ["sha", "check", "norm_n"])
    kept = (F.col("place") == F.col("keep_place")) & (F.col("file") == F.col("keep_file"))
    return found.select("file", "place", "doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row for each document with the row that stands for its group of equal texts.

    Texts are equal when they are identical after every character of [\\x20\\x09-\\x0D] is deleted; null counts as empty.
    The row with the most code points in its original text stays, then the one with the smallest id (a null id comes last);
    of rows that tie in both, the first in its file, and of such rows in several files any one, always the same. So one row of each group
    is kept, where ids repeat too.

    Rows are combined three times, each time by digest and full content: by Spark's map-side aggregation within a task,
    then by digest and salt, so that a group of any size is spread over `salts` tasks, then over the few salt winners.
    Winners meet the documents again over SHA-256, a second hash and the length, and a large group's documents can be
    split there, as each has one winner. Rows are told apart by their file and their place in it, which no change of the cluster alters between
    readings; rows that don't come from files are written first.

    Returns (id, keep_id, group_size, kept, text_sha256). Texts of any length are compared whole. An empty table gives an empty one. Other columns are ignored.
    """
    rows, (file, place) = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), Scratch(docs.sparkSession))
    rows = rows.select(F.col(file).alias("file"), F.col(place).alias("place"), "doc_id", "text")
    return _grouped(rows, salts).drop("file", "place").withColumnRenamed("doc_id", id_col)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """The rows that stay, one of each group as in exact_groups, with all their columns, whatever their names.

    Null and empty texts are one group; of repeated rows one stays; ties, null ids and ids at both ends of their range are decided as in exact_groups. Texts of any length are compared whole; an empty table gives an empty one.
    """
    rows, (file, place) = numbered(docs, Scratch(docs.sparkSession))
    narrow = rows.select(F.col(file).alias("file"), F.col(place).alias("place"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kept = _grouped(narrow, salts).filter("kept").select(F.col("file").alias(file), F.col("place").alias(place))
    return rows.join(kept, [file, place], "left_semi").select([f"`{c}`" for c in docs.columns])


SQL = """
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS n,
             translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
