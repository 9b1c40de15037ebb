"""Table functions in SQL give the rows of the DataFrame functions."""

import pytest
from gradus.functions import tables
from gradus.operators import alignment, answers
from pyspark.sql import functions as F

TEXTS = [(1, "Q1. The kernel manages memory. It is part of the system. [5 marks]\nQ2. A scheduler allocates time."), (2, None), (3, ""), (4, "The disk stores files; the cache contains pages of the disk.\n\nAnother paragraph of more than thirty letters here.")]


@pytest.fixture(scope="module")
def texts(spark):
    tables.register(spark)
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    df.createOrReplaceTempView("texts")
    return df


def test_segments(spark, texts):
    got = spark.sql("SELECT doc_id, s.* FROM texts, LATERAL segments(text) AS s")
    want = answers.segmented(texts)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_propositions(spark, texts):
    got = spark.sql("SELECT doc_id, p.subject, p.predicate, p.object FROM texts, LATERAL propositions(text) AS p WHERE predicate <> 'is'")
    want = texts.select("doc_id", F.explode(alignment.propositions(F.col("text"))).alias("p")).select("doc_id", "p.*").filter("predicate <> 'is'")
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and (1, "The kernel", "manages", "memory") in rows


def test_assignment(spark, texts):
    pairs = spark.createDataFrame([(1, "The disk stores files. A cache holds pages. Nothing else.", "A cache holds hot pages. Files: the disk stores files."), (2, None, "x y z."), (3, "one two.", None)], "k int, model string, student string")
    pairs.createOrReplaceTempView("answers_given")
    got = {(r.k, r.model): (r.student, round(r.similarity, 6)) for r in spark.sql("SELECT k, a.* FROM answers_given, LATERAL assignment(answers_given.model, answers_given.student) AS a").collect()}
    assert got[1, 0] == (1, 1.0) and got[1, 1] == (0, 1.0) and got[3, 0] == (-1, 0.0) and (2, 0) not in got
    assert got[1, 2] == (-1, 0.0) and len(got) == 4  # three sentences, two answers; a null side has none


def test_other_types_are_refused(spark, texts):
    with pytest.raises(Exception, match="text is wanted"):
        spark.sql("SELECT * FROM segments(5)").collect()
