"""Text functions and detectors on hand-made rows, at and around each threshold."""

import itertools
import random
import re
from collections import Counter
from math import log2

import numpy as np
import pytest
from gradus import plans
from gradus.functions import detectors as D
from gradus.functions import lexicons as L
from gradus.functions import feedback, ocr, scoring, similarity, text
from gradus.operators import alignment, answers, spelling
from gradus.plans import answers as answer_plans
from gradus.plans import text as text_plans
from pyspark.sql import functions as F


def value(spark, column, **inputs):
    names = {k: F.lit(v) for k, v in inputs.items()}
    return spark.range(1).select(*[c.alias(k) for k, c in names.items()]).select(column.alias("v")).first()["v"]


def of(spark, f, s):
    return value(spark, f(F.col("s")), s=s)


@pytest.mark.parametrize(
    ("given", "want"),
    [(None, ""), ("", ""), ("a\r\nb", "a\nb"), ("so  much   room", "so much room"), ("what??!", "what!"), ("one , two .Three", "one, two.Three"), ("( in )", "(in)"), ("~~x___y---z", "xyz"), ("sooooo", "soo"), ("Q 1. a\nquestion 2 : b", "Q1. a\nquestion 2: b"), ("a\n\n\n\n\nb", "a\n\n\nb"), ("1. one.\n2. two", "1. one.\n2. two"), ("tlie vvord", "the word")],
)
def test_clean(spark, given, want):
    assert of(spark, text.clean, given) == want


def test_literal_clean_swallows_line_ends(spark):
    assert of(spark, lambda s: text.clean(s, literal=True), "one.\ntwo") == "one. two"


def test_splits(spark):
    assert of(spark, text.sentences, " One. Two!  Three? four ") == ["One.", "Two!", "Three?", "four"]
    assert of(spark, lambda s: text.sentences(s, 3), "No. Sentence here.") == ["Sentence here."]
    assert of(spark, text.sentences, None) == [] and of(spark, text.words, " \n") == []
    assert of(spark, text.paragraphs, "a\n\nb") == ["a", "b"]
    assert of(spark, text.paragraphs, "a line that is long\nshort\nanother line this long") == ["a line that is long", "another line this long"]
    assert of(spark, text.paragraphs, "just one") == ["just one"]
    assert of(spark, lambda s: text.ngrams(text.words(s), 2), "a b a b") == ["a b", "b a"]
    assert of(spark, lambda s: text.ngrams(text.words(s), 5), "a b") == []
    assert of(spark, text.keywords, "The cell, the Cell and its membrane of 3 nm") == ["cell", "membrane"]
    assert of(spark, text.strip_html, "<p>a &lt;b&gt; &amp; c</p>\n<script>x</script>\n\n<i>d</i>") == "a & c\nd"


def test_noise_lines(spark):
    lines = "Real line\n12\n----\nxxxx\nhttps://x.y\n\n1234"
    assert of(spark, text.without_noise_lines, lines) == "Real line\n1234"


@pytest.mark.parametrize(("a", "b", "want"), [("cell", "cell", 1.0), ("cell", "cells", 0.9), ("membrane", "membrant", 1 - 1 / 8), ("abc", "xyz", 0.0)])
def test_word_similarity(spark, a, b, want):
    assert abs(value(spark, similarity.word_similarity(F.col("a"), F.col("b")), a=a, b=b) - want) < 1e-9


def test_coverage(spark):
    assert value(spark, similarity.coverage(F.col("m"), F.col("s")), m=["cell", "nucleus", "wall"], s=["cells", "nukleus"]) == pytest.approx(2 / 3)
    assert value(spark, similarity.coverage(F.array().cast("array<string>"), F.col("s")), s=["x"]) == 1.0


def test_cosine(spark):
    assert value(spark, similarity.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert value(spark, similarity.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 0.0
    assert value(spark, similarity.semantic(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 1.0]) == 0.5


@pytest.mark.parametrize(("copied", "want"), [(0.39, 0.0), (0.40, 0.0), (0.60, 0.10), (0.95, 0.20)])
def test_copy_penalty(spark, copied, want):
    assert value(spark, similarity.copy_penalty(F.col("c")), c=copied) == pytest.approx(want)


CUES = {
    "intro": ("A stack is defined as a list in which the last Item comes out first. More.", 1.0),
    "conclusion": ("We tested it. Therefore this important result holds for each of the samples we took.", 1.0),
    "lists": ("1. one\n2. two\n3. three\n- a\n- b\n", 0.7),
    "definitions": ("A stack is defined as a list. It refers to order. The cell is a type of unit.", 1.0),
    "examples": ("For example, it is similar to cells, such as Amoeba, in 20 percent.", 0.9),
}


@pytest.mark.parametrize("name", CUES)
def test_structure_cues(spark, name):
    given, want = CUES[name]
    assert value(spark, D.structure(F.col("s"))[name], s=given) == pytest.approx(want)
    assert value(spark, D.structure(F.col("s"))[name], s="x") == 0.0


def test_coherence(spark):
    linked = "The cell wall is strong. However, the cell wall also bends. Therefore the cell survives. First it grows, then the cell divides."
    assert value(spark, D.structure(F.col("s"))["coherence"], s=linked) >= 0.8
    assert value(spark, D.structure(F.col("s"))["coherence"], s="One thing. Another matter.") == 0.0


def test_gaming(spark):
    same = "Plants need light to grow well. Plants need light to grow well. Roots take water in."
    assert of(spark, D.repetition, same) == pytest.approx(0.20)
    assert of(spark, D.repetition, "Plants need light. Roots take water.") == 0.0
    model = "Plants need light to grow. Roots take water in."
    assert value(spark, D.irrelevance(F.col("a"), F.col("m")), a="Football was invented long ago. Nobody won yesterday.", m=model) == 0.25
    assert value(spark, D.copy_shuffle(F.col("a"), F.col("m")), a="Roots take water in. Plants need light to grow.", m=model) == pytest.approx(0.15)
    assert value(spark, D.stuffing(F.col("a"), F.col("m"), F.lit(0.9), F.lit(0.2), F.array(F.lit("cell"))), a="cell cell cell cell cell cell", m="the cell is a very small unit of life here") > 0.1
    assert of(spark, D.padding, "It is important to note that basically all is well. Needless to say, the fact that it works is nice.") >= 0.08
    assert value(spark, D.gibberish(F.col("s"), F.lit(5.2)), s="xkcd zzqr bvnm qwrt plkj hgfd zxcv mnbq wrtp") > 0.2


def test_twins_equal_all_pairs():
    rnd = random.Random(3)
    for n in (1, 2, 9):
        sets = [list({rnd.choice("abcdefg") for _ in range(rnd.randint(0, n))}) for _ in range(60)]
        pair = lambda a, b: a and b and len(set(a) & set(b)) / min(len(a), len(b)) >= 0.85
        assert D.twins(sets) == sum(any(i != j and pair(a, b) for j, b in enumerate(sets)) for i, a in enumerate(sets))


def test_entropy(spark):
    assert of(spark, D.entropy, "aabB") == pytest.approx(1.0) and of(spark, D.entropy, "") == 0.0 and of(spark, D.entropy, None) == 0.0 and of(spark, D.entropy, "😀é") == pytest.approx(1.0)


def test_all_six_detectors_reach_the_grade(spark, tmp_path):
    model = "The cell membrane keeps the nucleus and controls transport of water between tissues."
    odd = "xkcd zzqr bvnm qwrt plkj hgfd zxcv mnbq wrtp"
    stuffed = "cell cell membrane. cell nucleus. cell transport. cell membrane cell."
    spark.createDataFrame([(0, odd), (1, stuffed), (2, model)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, model)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    chat = [(c, t, r, x) for c, a in enumerate((odd, stuffed, model)) for t, r, x in ((0, "user", model), (1, "assistant", a))]
    spark.createDataFrame(chat, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    report = {r.conv_id: r for r in plans.queries()["gaming_report_all"](spark, str(tmp_path)).collect()}
    assert "gibberish" in report[0].flags and report[0].irrelevance > 0 and report[1].stuffing > 0 and report[2].gibberish == report[2].stuffing == 0
    used = {r.doc_id: r.gaming for r in text_plans.scores(spark, str(tmp_path)).collect()}
    assert used == pytest.approx({c: r.gaming_penalty for c, r in report.items()}, abs=1e-6) and used[0] == 0.40


@pytest.mark.parametrize(("penalty", "want"), [(0.0, "none"), (0.049, "low"), (0.05, "medium"), (0.12, "high")])
def test_severity(spark, penalty, want):
    assert value(spark, D.severity(F.col("p"), 0.05, 0.12), p=penalty) == want


@pytest.mark.parametrize(("question", "level"), [("Define a stack", 1), ("Explain why", 2), ("Calculate the sum", 3), ("Compare a stack and a queue", 4), ("Evaluate and justify it", 5), ("Design an original plan", 6), ("Stacks", 2)])
def test_levels(spark, question, level):
    assert value(spark, D.level(F.col("s"), L.QUESTION_CUES)["level"], s=question) == level


def test_level_modifier(spark):
    m = lambda q, a, s=1.0: value(spark, D.level_modifier(F.lit(q), F.lit(a), F.lit(s), F.lit(s)))
    assert (m(4, 4), m(2, 6), m(6, 1)) == (0.0, pytest.approx(0.05), pytest.approx(-0.15)) and m(4, 2) == pytest.approx(-0.09)


@pytest.mark.parametrize(("score", "want"), [(0.85, "excellent"), (0.8499, "good"), (0.70, "good"), (0.50, "average"), (0.4999, "poor")])
def test_grades(spark, score, want):
    assert value(spark, scoring.grade(F.col("s")), s=score) == want


def test_weights_go_to_what_is_there(spark):
    none = F.lit(None).cast("double")
    got = value(spark, scoring.redistributed(F.lit("factual"), {"semantic": F.lit(1.0), "concept_graph": none, "sentence_alignment": none, "keyword": F.lit(0.0), "diagram": none}))
    assert got == pytest.approx(0.20 / 0.45)
    assert scoring.normalised({"understanding": 2.0, "structure": 2.0, "nonsense": 9.0}) == {"understanding": 0.5, "structure": 0.5}
    assert scoring.normalised({"understanding": 0.0, "structure": 0.0}) == {"understanding": 0.5, "structure": 0.5}


def test_confidence(spark):
    none = F.lit(None).cast("double")
    assert value(spark, scoring.embedding_stability(F.lit(0.8), none, none)) == 0.65
    assert value(spark, scoring.embedding_stability(F.lit(0.8), F.lit(0.8), F.lit(0.8))) == pytest.approx(1.0)
    assert value(spark, scoring.score_agreement(F.lit(0.5), F.lit(0.5), none)) == pytest.approx(0.8 + 0.2 / 3)
    factors = {k: F.lit(1.0) for k in L.CONFIDENCE_WEIGHTS}
    assert value(spark, scoring.confidence(factors, F.lit(0.0))) == pytest.approx(1.0)
    assert value(spark, scoring.confidence(factors, F.lit(0.3))) == pytest.approx(0.7)


def test_rubric(spark):
    got = scoring.rubric({"understanding": F.lit(0.9), "concept_coverage": F.lit(0.9), "terminology": F.lit(0.1), "structure": F.lit(0.5), "examples": F.lit(0.1)})
    assert value(spark, got["rubric_score"]) == pytest.approx(0.9 * 0.7 + 0.1 * 0.15 + 0.05 + 0.005)
    assert (value(spark, got["best"]), value(spark, got["worst"]), value(spark, got["band"])) == ("understanding", "terminology", "Good")


def test_ocr_quality(spark):
    assert of(spark, ocr.bigram_score, "the then") > 0.6 and of(spark, ocr.bigram_score, "zq") == 0.0
    assert of(spark, ocr.valid_ratio, "the strength xxxx bcdfgh a") == pytest.approx(3 / 5)
    assert of(spark, ocr.repetition, "a b c d e f g") == 0.0 and of(spark, ocr.repetition, "x y " * 10) > 0.5
    assert value(spark, ocr.quality(F.col("s"), F.lit(1.0)), s="") == 0.0


def test_engines_and_votes(spark):
    pages = spark.createDataFrame([(1, "a", "x", 0.5), (1, "b", "y", 0.9), (2, "a", "z", 0.1)], "page int, engine string, text string, quality double")
    assert {(r.page, r.text) for r in ocr.best_engine(pages).collect()} == {(1, "y"), (2, "z")}
    votes = spark.createDataFrame([(1, "The", 0.4), (1, "the", 0.4), (1, "tbc", 0.7), (2, "bcdfg", 0.9), (2, "cell", 0.1)], "place int, word string, weight double")
    assert {(r.place, r.word.lower()) for r in ocr.voted_words(votes, ["place"]).collect()} == {(1, "the"), (2, "cell")}
    lines = spark.createDataFrame([(1, 0.0, 10.0), (1, 12.0, 22.0), (1, 60.0, 70.0)], "page int, y1 double, y2 double")
    assert [r.paragraph for r in ocr.paragraph_groups(lines).orderBy("y1").collect()] == [1, 1, 2]


@pytest.mark.parametrize(
    ("given", "method", "numbers"),
    [
        ("Q1. Stack is a list [5 marks]\nQ2. Queue\nQ3. Tree", "q_number", [1, 2, 3]),
        ("Question 1: Stack\nQuestion 2: Queue", "question_number", [1, 2]),
        ("1. one\n2. two\n3. three\n4. four", "plain_number", [1, 2, 3, 4]),
        ("Ans 1: a first\nAns 2: b second\nAns 3: c third", "answer_number", [1, 2, 3]),
        ("A paragraph that is over thirty characters.\n\nAnother paragraph of over thirty characters.", "paragraphs", [1, 2]),
        ("Just one short text", "whole", [1]),
        ("abc", "empty", [1]),
        (None, "empty", [1]),
        ("Q1. a text\nQ3. b text\nQ4. c text", "q_number", [1, 3, 4]),
    ],
)
def test_segments(given, method, numbers):
    found = answers.segments(given)
    assert [s[1] for s in found] == numbers and {s[2] for s in found} == {method}


@pytest.mark.parametrize(("line", "want"), [("Stacks [5M]", 5), ("Stacks 5 m", 5), ("Stacks 5 marks", 5), ("Stacks (10 Marks) ", 10), ("Describe how a stack differs from a queue, and where each of the two is used [12 marks]", 12), ("Stacks [1000 marks]", 1000), ("A run of 1500 m", None), ("Forms", None), ("Plan 5 marks ahead", None)])
def test_marks(line, want):
    assert [s[6] for s in answers.segments(f"Q1. {line}\nText 7 marks\nQ2. Queues")] == [want, None]


def test_segment_details(spark):
    found = answers.segments("Q1. Stacks [5 marks]\n(a) push\n(b) pop\nQ2. Queues")
    assert found[0][6] == 5 and found[0][7] == ["a", "b"] and found[1][6] is None
    assert answers.sequence_confidence([1, 2, 3]) == 0.95 and answers.sequence_confidence([1, 3, 4]) == pytest.approx(0.75) and answers.sequence_confidence([3, 1]) == 0.5
    df = answers.segmented(spark.createDataFrame([(1, "Q1. a [5 marks]\nQ2. b"), (2, None)], "doc_id long, text string"))
    marks = {(r.doc_id, r.number): r.max_marks for r in answers.proportional_marks(df, 10.0).collect()}
    assert marks == {(1, 1): 5.0, (1, 2): 5.0, (2, 1): 10.0}


def test_assignment_equals_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        n, m = rng.randrange(1, 6), rng.randrange(1, 6)
        sim = np.array([[rng.choice([0.0, 0.2, 0.5, 0.5, rng.random()]) for _ in range(m)] for _ in range(n)])
        got = answers.assign(sim)
        total = sum(sim[i, j] for i, j in enumerate(got) if j >= 0)
        used = [j for j in got if j >= 0]
        assert len(set(used)) == len(used)
        best = max(sum(sim[i, p[i]] for i in range(n) if p[i] < m) for p in itertools.permutations(range(max(n, m)), n))
        assert abs(total - best) < 1e-9
    assert answers.assign(np.zeros((2, 0))) == [-1, -1]


def test_alignment_columns(spark):
    frame = spark.createDataFrame([(1, [[0.9, 0.8], [0.9, 0.1]]), (2, [[0.1], [0.5]]), (3, None)], "id int, sim array<array<double>>")
    got = {r.id: (r.o, r.g) for r in frame.select("id", answers.optimal_alignment(F.col("sim")).alias("o"), answers.greedy_alignment(F.col("sim")).alias("g")).collect()}
    assert got == {1: ([1, 0], [0, -1]), 2: ([-1, 0], [-1, 0]), 3: (None, None)}


def test_folds(spark):
    assert answers.joined_lines("a broken wo\nrd here.\nNext") == "a broken word here.\nNext"
    assert answers.without_echoes("The same line\nThe same line!\nother\n\nmore text\nThe same line") == "The same line\nother\n\nmore text\nThe same line"
    assert of(spark, answers.folded, "x y\nX Y") == "x y"


def test_roles_and_importance(spark):
    for sentence, want in [("A cell is a unit.", "definition"), ("Take plants, for example.", "example"), ("However it fails.", "transition"), ("It must work.", "key_fact"), ("Roots take up water from soil during the night.", "explanation"), ("Roots drink.", "general")]:
        assert of(spark, alignment.role, sentence) == want
    assert value(spark, alignment.importance(F.col("s"), F.lit(0), F.lit(3)), s="A cell is a unit.") == pytest.approx(0.35 * 1.5 + 0.25 + 0.15 * 1.4 + 0.075)


@pytest.mark.parametrize(("places", "want"), [([1, 2, 3], 1.0), ([3, 2, 1], 0.0), ([1], 1.0), ([2, 2], 0.5), ([1, 3, 2], 2 / 3)])
def test_order_score(spark, places, want):
    assert value(spark, alignment.order_score(F.col("p")), p=places) == pytest.approx(want)


def test_aligned_answers(spark):
    model = "Plants need light to grow. Roots take water in."
    rows = [(1, model, "Plants need light to grow. Roots take water in."), (2, model, "Roots take water in. Plants need light to grow."), (3, model, "Football is fun today."), (4, model, ""), (5, None, "x y z")]
    got = {r.id: r for r in alignment.aligned(spark.createDataFrame(rows, "id int, model string, student string")).collect()}
    assert got[1].combined == pytest.approx(1.0) and got[1].strong == 2 and got[1].matched == [0, 1]
    assert got[2].matched == [1, 0] and got[2].order == 0.0 and got[2].combined < got[1].combined
    assert got[3].missing == 2 and got[3].combined < 0.2 and got[3].gap == pytest.approx(min(0.2, 0.08 * 2 * 0.9), abs=0.06)
    assert (got[4].combined, got[5].combined, got[5].orphans) == (0.0, 0.0, 1)


def test_concepts(spark):
    assert alignment.triples("The kernel manages the memory. It runs. The kernel manages the memory.") == [("The kernel", "manages", "the memory")]
    assert alignment.triples(None) == []
    assert of(spark, alignment.phrases, "Red Blood Cells carry oxygen. Oxygen feeds muscle and muscle burns oxygen.") == ["red blood cells", "oxygen", "muscle"]
    model = "Stacks store items. Stacks push items. Queues store items. Queues wait."
    rows = [(1, model, model), (2, model, "Football football goals goals."), (3, "", "x")]
    got = {r.id: r for r in alignment.concept_scores(spark.createDataFrame(rows, "id int, model string, student string")).collect()}
    assert got[1].n_covered == got[1].n_concepts and got[1].coverage == 1.0 and got[1].copying == 0.20
    assert got[2].coverage == 0.0 and got[2].relevance <= 0.5 and set(got[2].missing) == {"stacks", "items", "store", "queues"}
    assert got[3].combined == 0.5


def test_tfidf(spark):
    frame = spark.createDataFrame([(1, "cell wall", "cell wall"), (2, "cell wall", "root hair"), (3, "", "x"), (4, "cell wall", "cell hair")], "id int, model string, student string")
    got = {r.id: r.similarity for r in alignment.tfidf_cosine(frame, "id").collect()}
    rare = (np.log(3 / 2) + 1) ** 2
    assert got[1] == pytest.approx(1.0) and got[2] == 0.0 and got[3] == 0.0 and got[4] == pytest.approx(1 / (1 + 2 * rare))


def test_spelling(spark):
    known = spark.createDataFrame([("word", 9), ("ward", 2), ("sword", 5), ("the", 50)], "word string, n int")
    asked = spark.createDataFrame([("wrod",), ("woord",), ("the",), ("xyzzy",), ("wird",)], "word string")
    got = {(r.word, r.candidate): r.edits for r in spelling.candidates(asked, known).collect()}
    assert got["wrod", "word"] == 2 and got["woord", "word"] == 1 and got["woord", "sword"] == 2 and ("xyzzy", "the") not in got
    assert {r.word: r.correction for r in spelling.corrected(asked, known).collect()} == {"wrod": "word", "woord": "word", "the": "the", "xyzzy": "xyzzy", "wird": "word"}
    assert "modem" in of(spark, spelling.spellings, "modern") and "word" in of(spark, spelling.spellings, "vvord") + of(spark, spelling.spellings, "w0rd")
    case = lambda a, b: value(spark, spelling.case_like(F.col("a"), F.col("b")), a=a, b=b)
    assert (case("word", "WROD"), case("word", "Wrod"), case("word", "wrod")) == ("WORD", "Word", "word")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_candidates_equal_brute_force(spark):
    """Words around the length where pieces take over, with up to three edits."""
    rnd = random.Random(5)
    known = {"".join(rnd.choices("abé", k=n)) for n in [*range(1, 24), 14, 15, 16, 17, 18, 19, 40, 90] for _ in range(4)}
    asked = set()
    for k in known:
        for _ in range(3):
            w = list(k)
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(w) + 1)
                w[at : at + rnd.randint(0, 1)] = rnd.choices("abé", k=rnd.randint(0, 1))
            asked.add("".join(w) or "a")
    want = {(a, k): n for a in asked for k in known if (n := edits(a, k)) <= 2}
    frame = lambda ws: spark.createDataFrame([(w, 3) for w in sorted(ws)], "word string, n int")
    assert {(r.word, r.candidate): r.edits for r in spelling.candidates(frame(asked), frame(known)).collect()} == want


def test_whole_words_are_corrected(spark, tmp_path):
    long = "internationalisation"
    docs = [(i, f"{long} naïveté don't water") for i in range(2)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "Internatonalisatoin naivete d'accord NASA watre, water x")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.word: r.correction for r in plans.queries()["word_corrections"](spark, str(tmp_path)).collect()}
    assert got == {"internatonalisatoin": "internatonalisatoin", "naivete": "naïveté", "watre": "water"}
    found = {(r.word, r.candidate, r.edits) for r in plans.queries()["word_candidates"](spark, str(tmp_path)).collect()}
    assert found == {("naivete", "naïveté", 2), ("watre", "water", 2)} and edits("internatonalisatoin", long) == 3


def test_reports(spark):
    got = feedback.gaming({"repetition": F.lit(0.2), "padding": F.lit(0.05), "gibberish": F.lit(0.3)})
    assert value(spark, got["gaming_penalty"]) == 0.40 and value(spark, got["flags"]) == ["repetition", "gibberish"] and value(spark, got["warnings"]) == ["padding"]
    assert value(spark, feedback.explanation(F.lit("good"), F.lit(3), F.lit(4))) == "Most of what was asked is there: 3 of 4 keywords."
    tips = value(spark, feedback.suggestions(F.lit("poor"), F.lit(0.3), F.array(F.lit("cell"))))
    assert len(tips) == 3 and tips[1] == "Mention cell."
    assert value(spark, feedback.level_feedback(F.lit(4), F.lit(1))) == "The question asks to analyse; the answer comes to remember."


def test_feedback_equals_brute_force(spark, tmp_path):
    """Rows of the query from the model's keywords, the lengths and final_grade's grade."""
    model = "Membrane nucleus transport tissue keep water."
    given = ["nucleus water", "Membrane nucleus transport tissue keep water.", "Membrane words " + "go on and on " * 12, ""]
    spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, model)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    grades = {r.doc_id: r.grade for r in plans.queries()["final_grade"](spark, str(tmp_path)).collect()}
    got = {r.doc_id: r for r in plans.queries()["feedback"](spark, str(tmp_path)).collect()}
    keys = ["membrane", "nucleus", "transport", "tissue", "keep", "water"]
    for i, t in enumerate(given):
        missing = [k for k in keys if k not in t.lower()][:5]
        tips = ["Write more: the answer is less than half as long as expected."] * (len(t) / len(model) < 0.5) + ["Be brief: the answer is more than twice as long as expected."] * (len(t) / len(model) > 2)
        tips += [f"Mention {', '.join(missing)}."] * bool(missing) + ["Go over the topic again."] * (grades[i] in ("poor", "average"))
        assert (got[i].grade, got[i].suggestions) == (grades[i], tips)
    assert value(spark, feedback.suggestions(F.lit("good"), F.lit(2.5), F.array().cast("array<string>"))) == ["Be brief: the answer is more than twice as long as expected."]


def test_edits_of_the_queries_count_bytes(spark):
    x = spark.createDataFrame([(["abcde"], ["abcdé"]), (["naïve"], ["naïve"]), (["rivers"], ["river"]), (["memory"], ["mmeory"])], "m array<string>, s array<string>")
    got = x.select(similarity.matched(F.col("m"), F.col("s")).alias("chars"), similarity.matched(F.col("m"), F.col("s"), form=similarity.byte_form).alias("bytes")).collect()
    assert [r.chars for r in got] == [["abcde"], ["naïve"], ["rivers"], []] and [r.bytes for r in got] == [[], ["naïve"], ["rivers"], []]


def test_cues_end_at_letters_beyond_ascii(spark):
    x = spark.createDataFrame([("An éa is here and so on. Butö no.",), ("An ea is here and so on. But no.",)], "t string")
    got = D.structured(x, F.col("t")).withColumn("k", text.hits(text.edged(F.col("t")), L.ADVERSATIVE)).collect()
    assert [round(r.intro, 2) for r in got] == [0.0, 0.3] and [r.k for r in got] == [1, 1]


def test_names_inside_sentences_end_at_letters_beyond_ascii(spark):
    x = spark.createDataFrame([("Well. so it is with Rétier Ölten and Marie and Bonnèt.", "none")], "s string, m string")
    assert x.select(scoring.examples(F.col("s"), F.col("m")).alias("v")).first().v == pytest.approx(0.30 + 0.08)
    y = spark.createDataFrame([("Well. so it is with Bonnèt here too.", "none")], "s string, m string")
    assert y.select(scoring.examples(F.col("s"), F.col("m")).alias("v")).first().v == pytest.approx(0.30 + 0.08)


def test_ocr_scores_against_loops(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("the ssoo\u00e9'A1\n ", k=n)) for n in (0, 1, 3, 4, 9, 80, 400) for _ in range(6)] + [None, "    ", "a b c d", "sss", "THE\x1cthe the the the the the"]
    got = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3).select("id", ocr.bigram_score(F.col("t")).alias("b"), ocr.char_certainty(F.col("t")).alias("c"), ocr.repetition(F.col("t")).alias("r")).collect()
    for r in got:
        t = texts[r.id] or ""
        plain = "".join(c for c in t.lower() if c in "abcdefghijklmnopqrstuvwxyz ")
        pairs = [w[i : i + 2] for w in plain.split(" ") for i in range(len(w) - 1)]
        mean = sum(L.BIGRAMS.get(p, 0) for p in pairs) / len(pairs) if pairs and len(plain) >= 4 else 0.0
        assert r.b == pytest.approx(min(1.0, mean / 3.56)), t
        assert r.c == pytest.approx(sum(c.isalpha() or c.isdigit() or c in " .,;:!?'\"()\n-" for c in t) / len(t) if t else 0.0), t
        ws = [w for w in re.split("[ \\t-\\r]+", t.lower()) if w]
        grams = list(zip(ws, ws[1:], strict=False))
        want = 0.0
        if len(ws) >= 6:
            top, top2 = max(Counter(ws).values()), max(Counter(grams).values())
            want = min(1.0, (max(0.0, (top / len(ws) - 0.15) * 2) + min(1.0, max(0.0, top2 - 2) / 4) + max(0.0, 1 - len(set(grams)) / len(grams) * 1.5)) / 3)
        assert r.r == pytest.approx(want), t


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_what_texts_are_cut_into_is_computed_once(spark, small):
    assert optimized(text_plans.ocr_quality(spark, small)).count("array_sort") == 0
    assert optimized(text_plans.padding_penalty(spark, small)).count("(?<=[.!?])") == 1
    assert optimized(text_plans.sentence_roles(spark, small)).count("denotes") == 1
    assert optimized(answer_plans.answer_levels(spark, small)).count("abbreviation\\b") == 1
    assert optimized(text_plans.gibberish_penalty(spark, small)).count("[^a-z]") == 1


def test_cues_that_need_letters(spark):
    cues = [p for group in [*L.ANSWER_CUES, *L.QUESTION_CUES, L.EXAMPLE_CUES, L.APPLICATION_CUES] for p in group]
    plain = lambda p: re.sub(r"\\s[+*]", " ", re.sub(r"\\b|\\w\*|\\d\?|\\|\(\?:([^|()]*)[^()]*\)\??|[?*]", lambda m: m[1] or "", p)).replace("[ei]", "e")
    rng = random.Random(2)
    texts = [None, ""] + [" ".join(rng.choices([plain(p) for p in cues] + ["First THEN", "E.G. i.e", "\u212anown as"], k=12)) for _ in range(40)]
    x = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", F.lower("t"))
    got = x.select("t", text.total_hits(F.col("t"), F.col("low"), cues).alias("n")).collect()
    assert all(r.n == (None if r.t is None else sum(len(re.findall("(?ia)" + p, r.t)) for p in cues)) for r in got)
    assert text.needle(r"\bis\s+defined\s+as\b") == "defined" and text.needle(L.FILLERS) == ""


def test_entropy_of_frequent_and_rare_characters(spark):
    texts = ["the end, the end.", "xx\u00e9\u00e9\u00e9 QQ", "\U0001f600a\U0001f600", "%_$ .", "\n\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.entropy(F.col("t")).alias("e")).collect()
    for r in got:
        n = Counter(r.t.lower()).values()
        assert r.e == pytest.approx(-sum(k / sum(n) * log2(k / sum(n)) for k in n), abs=1e-12)


def test_a_quick_pattern_counts_what_the_pattern_counts(spark):
    patterns = [L.CONCLUSION, L.SUMMARY, L.ENUMERATION, L.EXAMPLES, L.ANALOGIES, L.NUMBERS, L.ADDITIVE, L.CAUSAL, L.FILLERS, L.HEDGES, L.TRANSITIONS, L.DIAGRAM_CUES, r"\b(ab?|c?d)\b", r"\b(a(b|c)|de)\b", r"\b(ab)?c"]
    assert text.quick(r"\b(ab)?c") == r"\b(ab)?c" and text.quick(L.FILLERS) != L.FILLERS
    texts = ["Therefore MOREOVER thus hence.", "such as a, b, c; e.g. one, two", "for example In Summary, Fig. 3 and figure 4", "ab ac de d cd abc c", "it seems perhaps\tlike this, that", "as a result, akin  to 3.5 % of 20 years", "", "xtherefore therefored"]
    x = spark.createDataFrame([(t,) for t in texts], "t string")
    got = x.select(*[F.regexp_count("t", F.lit("(?i)" + q)) for p in patterns for q in (p, text.quick(p))]).collect()
    assert all(r[i] == r[i + 1] for r in got for i in range(0, len(r), 2)) and sum(map(sum, got)) > 40


def test_sentences_and_keywords_of_long_texts(spark):
    texts = [" One.  Two words!\n\n Three ΟΔΟΣ. Ünï? ok\t", None, "", "   ", "the of " * 60 + "alpha beta " + "the " * 80 + "gamma Alpha, delta", "a. b. cdef ghij. K", "x" * 3 + ". " + "word."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    x = D.in_parts(df, F.col("t"), "p")
    stripped = F.filter(F.transform(F.split(text.strip(F.coalesce("t", F.lit(""))), r"(?<=[.!?])\s+"), text.strip), lambda s: F.char_length(s) > 0)
    for r in x.select("*", text.words(F.col("t")).alias("ws"), stripped.alias("ss"), text.keywords(F.col("t")).alias("ks"), D.longer(F.col("p_sw"), F.col("p_ss"), 3).alias("long"), F.transform(text.sentences(F.col("t"), 3), text.words).alias("want")).collect():
        assert (r.p_ws, r.p_ss, r.long) == (r.ws, r.ss, r.want)
        assert r.i != 4 or r.ks == ["alpha", "beta", "gamma", "delta"]


def test_entropy_of_many_texts(spark):
    texts = ["", None, "a", "aabb", "Hello World", "ΟΔΟΣ Ünï \U0001f600 " * 5, "x" * 1000]
    x = spark.createDataFrame([(t,) for t in texts], "t string").select(D.entropy(F.col("t")).alias("a"), D.entropy_of_many(F.col("t")).alias("b")).collect()
    assert all(abs(r.a - r.b) < 1e-9 for r in x)


def test_an_answer_is_split_once_for_all_its_scores(spark, small):
    """Its words were found six times over."""
    plan = plans.queries()["final_grade"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(") <= 5
