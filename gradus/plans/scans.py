"""Registered queries over scanned texts and their questions, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.operators import correction, fusion
from gradus.operators.answers import segmented
from gradus.sources.tables import spread, table

from .text import q, strip, turns, vocabularies

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query()
def corrected_scans(spark, d):
    """Benchmark texts as if scanned badly (m as rn, o as 0), corrected by the words of the documents."""
    known = vocabularies(spark, d)[1]
    read = table(spark, d, "benchmark").select("item_id", F.replace(F.replace("text", F.lit("m"), F.lit("rn")), F.lit("o"), F.lit("0")).alias("text"))
    return correction.corrected(read, known, "item_id").select("item_id", "corrected", "layers", "corrections")


#: Engines that misread a letter each, and the quality of what they read.
ENGINES = [("first", "o", "0", 0.9), ("second", "l", "1", 0.8), ("third", "e", "c", 0.7)]


@query()
def fused_lines(spark, d):
    """Messages as three engines read them, of which each takes one letter for another, voted back into one text."""
    m = table(spark, d, "conversations")
    read = F.array(*[F.struct(F.lit(name).alias("engine"), F.replace("text", F.lit(a), F.lit(b)).alias("text"), F.lit(quality).alias("quality")) for name, a, b, quality in ENGINES])
    rows = spread(m).select(F.struct("conv_id", "turn").alias("page"), F.explode(read).alias("r")).select("page", "r.*")
    return fusion.fused(rows).select("page.conv_id", "page.turn", "text")


def _first(x: str, patterns: list[str]) -> list[str]:
    return [f"nullif(regexp_extract({x}, {q(p)}, 1), '')" for p in patterns]


def _regions_sql() -> str:
    numbers = ", ".join(f"CASE WHEN CAST({n} AS INTEGER) BETWEEN 1 AND 200 THEN CAST({n} AS INTEGER) END" for n in _first("head", fusion.QUESTIONS))
    said = "CASE WHEN role = 'user' THEN 'Q' || (turn % 3 + 1) || '. ' || text WHEN turn % 4 = 1 THEN '(a) ' || text ELSE text END"
    return f"""WITH p AS (SELECT conv_id, turn, coalesce({said}, '') AS text FROM conversations), h AS (SELECT *, {strip(f'substr({strip("text")}, 1, 50)')} AS head, substr({strip('text')}, 1, 30) AS start FROM p),
 n AS (SELECT conv_id, turn, text, coalesce({numbers}) AS number, coalesce({', '.join(_first('start', fusion.PARTS))}) AS label FROM h),
 x AS (SELECT *, count(number) OVER (PARTITION BY conv_id ORDER BY turn) AS position, count(number) OVER (PARTITION BY conv_id) AS numbers FROM n),
 r AS (SELECT conv_id, position, coalesce(max(number), 1) AS number, {strip("coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (text <> ''), '')")} AS text, count(*) AS paragraphs, coalesce(list(label ORDER BY turn) FILTER (label IS NOT NULL), []) AS parts FROM x WHERE position > 0 OR numbers = 0 GROUP BY ALL),
 a AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, number ORDER BY position) > 1 AS INTEGER) AS again, max(number) OVER (PARTITION BY conv_id) AS most FROM r)
 SELECT conv_id, position, CASE WHEN again = 1 THEN most + CAST(sum(again) OVER (PARTITION BY conv_id ORDER BY position) AS INTEGER) ELSE number END AS number, text, paragraphs, parts FROM a"""


@query(_regions_sql())
def question_regions(spark, d):
    """Messages as paragraphs of a conversation: each of the user's begins a question, every other reply a part of it."""
    said = F.when(F.col("role") == "user", F.concat(F.lit("Q"), F.col("turn") % 3 + 1, F.lit(". "), "text")).when(F.col("turn") % 4 == 1, F.concat(F.lit("(a) "), "text")).otherwise(F.col("text"))
    return fusion.question_regions(table(spark, d, "conversations").select("conv_id", "turn", said.alias("text")), "conv_id", "turn")


@query()
def segment_summaries(spark, d):
    return fusion.segment_summary(segmented(spread(table(spark, d, "documents").select("doc_id", "text"))))


@query()
def segment_pairs(spark, d):
    """Replies and the messages before them, both cut into questions and met by number."""
    x = turns(spark, d).select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), "model", "student")
    return fusion.segment_pairs(x, "id", "model", "student")
