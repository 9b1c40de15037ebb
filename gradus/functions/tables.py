"""Table functions for SQL and lateral joins: segments, propositions and assigned sentences of a text."""

from __future__ import annotations

import re

import numpy as np
from pyspark.errors import PySparkTypeError
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from gradus.functions.lexicons import STOP_WORDS
from gradus.operators.alignment import triples
from gradus.operators.answers import assign, segments

def _row(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


_INT, _TEXT, _NUMBER = T.IntegerType(), T.StringType(), T.DoubleType()
SEGMENT = _row(position=_INT, number=_INT, method=_TEXT, confidence=_NUMBER, start=_INT, text=_TEXT, marks=_INT, parts=T.ArrayType(_TEXT))
PROPOSITION = _row(subject=_TEXT, predicate=_TEXT, object=_TEXT)
MATCH = _row(model=_INT, student=_INT, similarity=_NUMBER)


def _texts(schema: T.StructType, *given: AnalyzeArgument) -> AnalyzeResult:
    """The schema, if all arguments are texts or null."""
    for a in given:
        if not isinstance(a.dataType, (T.StringType, T.NullType)):
            raise PySparkTypeError(f"a text is wanted, not {a.dataType.simpleString()}")
    return AnalyzeResult(schema)


class Segments:
    """segments(text): a row for each question segment, as operators.answers.segmented; one row for a null text."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return _texts(SEGMENT, text)

    def eval(self, text: str | None):
        yield from segments(text)


class Propositions:
    """propositions(text): (subject, predicate, object) of each clause, each once, as operators.alignment.propositions; none for null."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return _texts(PROPOSITION, text)

    def eval(self, text: str | None):
        yield from triples(text)


STOPS = set(STOP_WORDS)


def content(sentence: str) -> set[str]:
    return set(sentence.lower().split()) - STOPS


def split(text: str | None) -> list[str]:
    found = [s.strip() for s in re.split(r"(?<=[.!?])\s+", (text or "").strip())]
    return [s for s in found if len(s) > 2]


class Assignment:
    """assignment(model, student): for each sentence of the model the student's that the best assignment gives it, and how many of the smaller one's content words both have; -1 and 0 where it has none."""

    @staticmethod
    def analyze(model: AnalyzeArgument, student: AnalyzeArgument) -> AnalyzeResult:
        return _texts(MATCH, model, student)

    def eval(self, model: str | None, student: str | None):
        rows, columns = [content(s) for s in split(model)], [content(s) for s in split(student)]
        sim = np.array([[len(a & b) / min(len(a), len(b)) if a and b else 0.0 for b in columns] for a in rows]).reshape(len(rows), len(columns))
        for i, j in enumerate(assign(sim)):
            yield i, j, float(sim[i, j]) if j >= 0 else 0.0


def register(spark: SparkSession) -> None:
    """Makes segments, propositions and assignment known to the session's SQL. Rows move in Arrow batches."""
    for name, function in (("segments", Segments), ("propositions", Propositions), ("assignment", Assignment)):
        spark.udtf.register(name, udtf(function, useArrow=True))
