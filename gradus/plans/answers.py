"""Queries over answers that vary: each document's item answered by a stated edit of the item's own sentences, so that every grade, level and detector occurs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions import detectors as D
from gradus.functions import feedback as B
from gradus.functions import lexicons as L
from gradus.functions import quality as Q
from gradus.functions import similarity as S
from gradus.functions import text as T

from . import text as X
from .text import PAIRS, TURNS, hits, q, r6, sents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: What the edits add: filler, cues of structure with a list, and a cue of each cognitive level.
FILLER = "As we all know, it is important to note that perhaps this is so. Needless to say, it goes without saying that maybe it is. It should be noted that in today's world it seems so."
OPENING = "The concept of this topic is defined as the process below, and it refers to the following parts in Operating Systems."
CLOSING = "Therefore, in conclusion, the main idea of this topic is important and essential for all of the following work."
CUES = [
    "It is defined as such and known as that.",
    "This means, in other words, that it holds because of that, for example.",
    "Step 1 is this; applying this we can use the method.",
    "Whereas one is similar, the other differs from it, unlike the first aspect.",
    "In my opinion it should be the best approach, as I believe.",
    "I would propose a new method, combining both in a framework.",
]
#: The edits, by (doc_id div 7) mod 10.
EDITS = ["kept", "reversed", "every other", "threefold", "padded", "structured", "stuffed", "backwards", "own text", "with a cue"]


def edited(doc_id: Column, own: Column, model: Column) -> Column:
    """The answer of a document to its item."""
    ss = T.sentences(model)
    nth = lambda xs, f: F.filter(xs, f)
    made = [
        model,
        F.array_join(F.reverse(ss), " "),
        F.array_join(nth(ss, lambda s, i: i % 2 == 0), " "),
        F.concat_ws(" ", model, model, model),
        F.concat_ws(" ", F.lit(FILLER), model, F.lit(FILLER)),
        F.concat(F.lit(OPENING + "\n\nFirstly, for example, consider the parts:\n"), F.array_join(F.transform(ss, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n"), F.lit("\n\n" + CLOSING)),
        F.repeat(F.concat(F.array_join(F.slice(T.keywords(model), 1, 10), " "), F.lit(" ")), 12),
        F.reverse(own),
        own,
        F.concat_ws(" ", model, F.get(F.array(*[F.lit(c) for c in CUES]), (F.floor(doc_id / 70) % 6).cast("int"))),
    ]
    out = None
    for k, text in enumerate(made[:-1]):
        hit = F.floor(doc_id / 7) % 10 == k
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out.otherwise(made[-1])


def answers(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, student, model) with edited answers."""
    return X.pairs(spark, d).withColumn("student", edited(F.col("doc_id"), F.col("student"), F.col("model")))


def _edited_sql() -> str:
    keys = f"list_filter(list_transform({X.w('b.text')}, lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda x: length(x) >= 3 AND NOT list_contains({X.STOP}, x))"
    keys = f"list_filter({keys}, lambda x, i: list_position({keys}, x) = i)[1:10]"
    ss = sents("b.text")
    made = [
        "b.text",
        f"array_to_string(list_reverse({ss}), ' ')",
        f"array_to_string(list_filter({ss}, lambda s, i: i % 2 = 1), ' ')",
        "concat_ws(' ', b.text, b.text, b.text)",
        f"concat_ws(' ', {q(FILLER)}, b.text, {q(FILLER)})",
        f"{q(OPENING)} || chr(10) || chr(10) || 'Firstly, for example, consider the parts:' || chr(10) || array_to_string(list_transform({ss}, lambda s, i: i || '. ' || s), chr(10)) || chr(10) || chr(10) || {q(CLOSING)}",
        f"repeat(array_to_string({keys}, ' ') || ' ', 12)",
        "reverse(d.text)",
        "d.text",
    ]
    cases = " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(made))
    return f"SELECT d.doc_id, CASE (d.doc_id // 7) % 10 {cases} ELSE b.text || ' ' || [{', '.join(map(q, CUES))}][(d.doc_id // 70) % 6 + 1] END AS text FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)"


def over_answers(sql: str) -> str:
    """SQL of documents as SQL of their answers."""
    sql = sql.replace("documents", "answers").strip()
    return f"WITH answers AS ({_edited_sql()}){', ' + sql[5:] if sql.startswith('WITH ') else ' ' + sql}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = over_answers(sql)
        return f

    return register


@query("SELECT doc_id, text FROM documents")
def answer_texts(spark, d):
    return answers(spark, d).select("doc_id", F.col("student").alias("text"))


@query(X.SQL["final_grade"])
def answer_grades(spark, d):
    return X.grades_of(answers(spark, d))


@query(X.SQL["rubric_confidence"])
def answer_rubrics(spark, d):
    return X.rubrics_of(answers(spark, d))


@query(X.SQL["feedback"])
def answer_feedback(spark, d):
    return X.feedback_of(answers(spark, d))


@query(X.SQL["structure_scores"])
def answer_structure(spark, d):
    x = D.structured(answers(spark, d).select("doc_id", "student"), F.col("student"))
    return x.select("doc_id", *[r6(F.col(n)).alias(n) for n in (*L.STRUCTURE_WEIGHTS, "structural_score", "structure_bonus")])


@query(X.SQL["gaming_report_all"].replace(TURNS, PAIRS).replace("conv_id, turn", "doc_id"))
def answer_gaming(spark, d):
    s, m = F.col("student"), F.col("model")
    x = answers(spark, d).withColumns({"mk": T.keywords(m), "sk": T.keywords(s), "semantic": S.overlap_smaller(F.array_distinct(T.words(s)), F.array_distinct(T.words(m)))})
    x = x.withColumn("matched", S.matched(F.col("mk"), F.col("sk"), form=S.byte_form)).withColumn("keyword", X.covered("mk", "matched"))
    x = D.gamed(x, s, m, F.col("keyword"), F.col("semantic"), F.col("matched"))
    report = B.gaming({n: F.col(n) for n in B.GAMING_CAPS})
    return x.select("doc_id", *[r6(F.col(n)).alias(n) for n in B.GAMING_CAPS], r6(report["gaming_penalty"]).alias("gaming_penalty"), report["flags"].alias("flags"), report["warnings"].alias("warnings"))


_COUNTS = ", ".join(f"({' + '.join(hits('text', p) for p in group)})" for group in L.ANSWER_CUES)


@query(f"""SELECT doc_id, level, [{', '.join(q(n) for n in L.LEVELS)}][level] AS name, cs[level] AS hits, round({X.div('cs[level]', 'list_sum(cs)')}, 3) AS confidence FROM (SELECT doc_id, [{_COUNTS}] AS cs FROM documents), (SELECT unnest(range(1, 7)) AS level)""")
def answer_levels(spark, d):
    x = answers(spark, d).withColumn("cue", T.edged(F.col("student"))).withColumn("counts", D.cue_counts(F.col("cue"), L.ANSWER_CUES))
    x = x.select("doc_id", F.explode(Q.level_breakdown(F.col("counts"), L.LEVELS)).alias("l"))
    return x.select("doc_id", "l.*")
