"""Changes of records, text quality and terms on hand-made rows."""

import math

from gradus import plans
from gradus.functions import lexicons as L
from gradus.functions import quality as Q
from gradus.functions import scoring as G
from gradus.operators import alignment as N
from gradus.operators import records as C
from gradus.operators import terms as W
from gradus.sources.tables import language_of_path
from pyspark.sql import functions as F


def test_json_safe(spark):
    df = spark.createDataFrame([(1, math.nan, "a"), (2, math.inf, "b"), (3, -math.inf, None), (4, 0.5, "c"), (5, None, "d")], "id int, `x.y` double, s string")
    assert [r[1] for r in C.json_safe(df).orderBy("id").collect()] == [None, None, None, 0.5, None]


def test_transitions(spark):
    rows = [(1, 1, "in_review", "teacher", 10, "a"), (1, 2, "resolved", "admin", 11, "b"), (1, 3, "no such", "admin", 12, "c"), (1, 4, "escalated", "teacher", 13, "d"), (2, 5, "open", "admin", 14, None)]
    df = spark.createDataFrame(rows, "case int, n int, status string, role string, at int, note string")
    got = {r.case: r for r in C.transitions(df, "case", "n", ["open", "in_review", "resolved", "rejected", "escalated"]).collect()}
    assert (got[1].status, got[1].resolution, got[1].resolved_at, got[1].resolved_by, got[1].escalated_at, got[1].changes) == ("escalated", "b", 11, "admin", 13, 3)
    assert (got[2].status, got[2].resolution) == ("open", None)
    said = [r.content for r in C.status_messages(df.filter("case = 1 AND status != 'no such'"), "case", "n").orderBy("n").collect()]
    assert said == ["Status changed from 'open' to 'in_review'", "Status changed from 'in_review' to 'resolved'", "Status changed from 'resolved' to 'escalated'"]


def test_upserts(spark):
    users, boards = spark.createDataFrame([(1,), (2,), (2,)], "u int"), spark.createDataFrame([(1, 5)], "u int, n int")
    assert sorted(map(tuple, C.got_or_created(users, boards, "u", ["n"]).collect())) == [(1, 5, False), (2, 0, True)]
    assert C.reset(boards, F.col("u") == 1, ["n"]).first().n == 0
    new = spark.createDataFrame([(1, 9), (3, None), (3, 7)], "u int, n int")
    assert sorted(map(tuple, C.inserted(boards, new, "u", {"n": F.lit(0)}).collect())) == [(1, 5), (3, 0)]
    assert sorted(map(tuple, C.link_requests(new, boards, ["u"]).collect())) == [(1, "exists"), (3, "added")]


def test_permissions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    role, user = F.lit("teacher"), F.lit(1)
    assert one(C.may_view(role, user, F.lit(2), F.lit(1))) and not one(C.may_view(F.lit("student"), user, F.lit(2), F.lit(1)))
    assert one(C.may_update(role, user, F.lit(1))) and not one(C.may_update(F.lit("student"), user, F.lit(1)))
    assert one(C.owns(F.lit("admin"), user, F.lit(1), F.lit(9))) and not one(C.owns(role, user, F.lit(1), F.lit(None))) and not one(C.owns(F.lit("student"), user, F.lit(1), F.lit(1)))
    assert one(language_of_path(F.lit("a/Notes_FR.pdf"))) == "fr" and one(language_of_path(F.lit("a/notes.pdf"))) == "en" and one(language_of_path(F.lit("hindi_1.png"))) == "hi"


def test_text_quality(spark):
    texts = [("",), (None,), ("One short line of six words.",), ("Two lines of some words here.\nAnd more of them here.",), ("@@@@ #### $$$$\n%%%% ^^^^",), ("aaaa bbbbb cccc dddd eeeee ffff\ngg hh",)]
    got = [round(r[0], 6) for r in spark.createDataFrame(texts, "t string").select(Q.quality_score(F.col("t"))).collect()]
    assert got == [0.0, 0.0, 0.95, 1.0, 0.8, 0.85]


def test_question_parts_and_lines(spark):
    df = spark.createDataFrame([("intro\nQ1. first\nmore\nQuestion 2 second\n3) third",)], "t string")
    assert df.select(Q.question_parts(F.col("t"))).first()[0] == ["intro", "Q1. first\nmore", "Question 2 second", "3) third"]
    lines = df.select(Q.lines_of(F.lit(" a b \n\nc "))).first()[0]
    assert [tuple(x) for x in lines] == [(1, "a b", 2, False), (2, "", 0, True), (3, "c", 1, False)]


def test_words(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(Q.merged_missing(F.array(F.lit("Cell"), F.lit("wall")), F.array(F.lit("cell"), F.lit("Root"), F.lit("ROOT")))) == ["Cell", "wall", "Root"]
    assert one(Q.changed_words(F.lit("a b b"), F.lit("b c d"))) == 3
    assert one(Q.normal_form(F.lit("The Cells, are growing Fast x1"), {"cells": "cell", "growing": "grow"})) == "grow fast x1"
    assert one(Q.entities(F.lit("New York and New York met Old Town"))) == ["New York", "Old Town"]


def test_rubric_parts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    merged = G.merged_rubric({"terminology": 0.5, "no such": 9.0})
    assert set(merged) == set(L.RUBRICS["default"]) and abs(sum(merged.values()) - 1) < 1e-9 and abs(merged["terminology"] - 0.5 / 1.35) < 1e-9
    assert one(G.examples(F.lit("short"), F.lit(""))) == 0.0
    rich = "For example, in practice 3 of 4 cells divide, such as roots. See figure 2."
    assert abs(one(G.examples(F.lit(rich), F.lit("Cells divide, for instance."))) - (0.40 + 0.25 + 0.15 + 0.08)) < 1e-9
    assert abs(one(G.heuristic_structure(F.lit("One. Two. Three."))) - 0.40) < 1e-9
    assert abs(one(G.terminology(F.array(F.lit("cell")), F.array(F.lit("wall")), F.lit("cell wall grows"), F.lit("cell wall grows"))) - (0.55 * 0.5 + 0.30 / 1.5 + 0.15 * 0.5)) < 1e-9
    assert abs(one(G.simple_score(F.lit("factual"), F.lit(1.0), F.lit(0.5), F.lit(0.0), F.lit(0.1))) - ((0.2 + 0.125) / 0.45 - 0.1)) < 1e-9


def test_salience_and_terms(spark):
    s = spark.createDataFrame([(1, 0, "roots drink water"), (1, 1, "leaves drink light"), (1, 2, "the of"), (2, 0, "alone here")], "d int, p int, t string")
    got = {(r.d, r.p): r.salience for r in W.salience(s, "d", "p", F.col("t")).collect()}
    assert got[2, 0] == 1.0 and got[1, 2] == 0.0 and abs(got[1, 0] - 2.0) < 1e-9 and abs(got[1, 1] - 2.0) < 1e-9
    top = W.important_terms(spark.createDataFrame([(1, "root root leaf")], "d int, t string"), "d", F.col("t"), 2).orderBy("place").collect()
    assert [r.term for r in top] == ["root", "leaf"] and abs(top[0].weight - 2 / math.sqrt(4 + 1 + 1 + 1)) < 1e-9


def test_json_safe_at_any_depth(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, ([nan, 1.5, None], {"a": inf, "b": 2.0}), [[-inf, 0.5]], "x"), (2, None, None, None)], "id int, s struct<xs:array<double>,m:map<string,float>>, deep array<array<double>>, t string")
    first, second = C.json_safe(df).orderBy("id").collect()
    assert (list(first.s.xs), first.s.m, first.deep, first.t) == ([None, 1.5, None], {"a": None, "b": 2.0}, [[None, 0.5]], "x")
    assert second.s is None and second.deep is None


def test_terms_of_a_text_are_counted_in_its_row(spark):
    """Each of these once shuffled every term of every text; a plan without an exchange can't."""
    docs = spark.createDataFrame([(1, "Root leaf. Root root stem"), (2, None), (3, "leaf")], "d int, t string")
    ranked = W.ranked_concepts(docs, "d", F.array(F.lit("Root leaf"), F.lit("Leaf"), F.lit("none")), F.col("t"))
    plans = [W.important_terms(docs, "d", F.col("t")), ranked, N.important_sentences(docs, "d", F.col("t")), N.tfidf_cosine(docs, "d", "t", "t")]
    assert not any("Exchange" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    got = {(r.d, r.concept): (round(r.importance, 6), r.place) for r in ranked.collect()}
    assert got[1, "root leaf"] == (1.0, 1) and got[1, "leaf"] == (round(1 / 5.5, 6), 2) and got[1, "none"] == (0.1, 3)  # root 3, leaf 1, their run 1 at 1.5
    assert {r.d: round(r.similarity, 9) for r in plans[3].collect()} == {1: 1.0, 2: 0.0, 3: 1.0}


def test_concept_graph_takes_every_concept(spark, tmp_path):
    """Only the first 80 were nodes."""
    letters = "abcdefghij"
    text = ". ".join(f"Name{a}{b}" for a in letters for b in letters) + ". Namea" + "a"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert plans.queries()["concept_graph"](spark, str(tmp_path)).first().nodes == 100
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ranked = W.ranked_concepts(docs, "doc_id", F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), F.lit(1)), F.col("text"))
    assert [r.concept for r in ranked.filter("place <= 2").orderBy("place").collect()] == ["nameaa", "nameab"] and ranked.agg(F.max("place")).first()[0] == 100
