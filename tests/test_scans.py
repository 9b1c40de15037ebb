"""Correction of scanned texts, fusion of engines' lines, question regions and pairs of segments."""

import difflib
import random
import re

import pytest
from gradus.operators import correction, fusion, spelling
from gradus.operators.answers import segmented
from gradus.plans import scans, text
from gradus.sources.scratch import written
from pyspark.sql import functions as F

WORDS = {"the": 90, "system": 30, "that": 50, "thot": 1, "modern": 9, "learning": 8, "operation": 6, "is": 80, "structures": 27, "life": 9, "good": 20}


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame(list(WORDS.items()), "word string, n long")


def test_patterns_without_a_dictionary(spark):
    rows = {"syst3m l0gic": "syst3m logic", "a10b a0b1c 10": "a10b aoblc 10", "x5y": "xsy"}
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert {r.t: r.u for r in df.select("t", correction.letters_for_digits(F.col("t")).alias("u")).collect()} == rows
    rows = {"opera tion and manage MENT": "operation and manageMENT", "a ed be ed": "a edbe ed", "learn ing": "learning"}
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = {r.t: r.u for r in df.select("t", correction.joined_endings(F.col("t")).alias("u")).collect()}
    assert got["opera tion and manage MENT"] == rows["opera tion and manage MENT"] and got["learn ing"] == "learning"
    rows = {"one. two! 3 four? five": "One. Two! 3 four? Five", "": "", "éa": "Éa"}
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert {r.t: r.u for r in df.select("t", correction.sentence_starts(F.col("t")).alias("u")).collect()} == rows
    rows = {"a , b.c 3.5 what?!": "a, b. c 3.5 what!", "x;y": "x; y"}
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert {r.t: r.u for r in df.select("t", correction.spaced_punctuation(F.col("t")).alias("u")).collect()} == rows


def test_words_that_a_dictionary_decides(spark, known):
    tokens = spark.createDataFrame([(t,) for t in ["systern", "(Systern)", "thal", "Syslem,", "thot", "slruclures", "the", "l" * 5000, "12"]], "token string")
    assert {r.token: r.new for r in correction.ligatures_undone(tokens, known).collect()} == {"systern": "system", "(Systern)": "(System)"}
    assert {r.token: r.new for r in correction.swaps_undone(tokens, known, 5).collect()} == {"thal": "that", "Syslem,": "System,", "thot": "that", "slruclures": "structures"}


def test_layers(spark, known):
    rows = [(1, "thc syslem is g0od . is"), (2, None), (3, "  "), (4, "Modern life\n is good"), (5, "lerning THX")]
    got = {r.id: r for r in correction.corrected(spark.createDataFrame(rows, "id long, text string"), known, "id").collect()}
    assert (got[1].corrected, got[1].layers, got[1].corrections) == ("The system is good. Is", ["patterns"], 7)
    assert all((got[i].corrected, got[i].layers, got[i].corrections) == ("", [], 0) for i in (2, 3))
    assert got[4].corrected == "Modern life is good" and got[4].corrections == 0
    assert (got[5].corrected, got[5].layers) == ("Learning THX", ["patterns", "spelling"])
    assert correction.corrected(spark.createDataFrame([], "id long, text string"), known, "id").count() == 0


def test_the_dictionary_is_counted_once(spark, small):
    for found in (scans.corrected_scans(spark, small), text.word_corrections(spark, small)):
        assert not [f for f in found.inputFiles() if "documents.parquet" in f]


def test_deletions_of_a_small_dictionary_are_not_broadcast(spark, known):
    """Their number is a hundred times that of the words, which a file's size doesn't tell."""
    found = spelling.candidates(spark.createDataFrame([("systm",), ("thot",)], "word string"), written(known, "dictionary"))
    assert sorted(map(tuple, found.collect())) == [("systm", "system", 30, 1), ("thot", "that", 50, 1), ("thot", "the", 90, 2), ("thot", "thot", 1, 0)]
    assert "SortMergeJoin [key" in found._jdf.queryExecution().executedPlan().toString()


def voted(readings):
    """Fusion of (engine, text, quality), by loops."""
    from gradus.functions.lexicons import BIGRAMS

    def valid(w):
        w = "".join(c for c in w.lower() if "a" <= c <= "z")
        if len(w) < 2:
            return w in ("a", "i")
        fair = not (len(w) > 3 and not set(w) & set("aeiouy")) and not (len(w) >= 4 and not set(w[:4]) & set("aeiouy"))
        return fair and not any(a == b == c for a, b, c in zip(w, w[1:], w[2:], strict=False)) and (len(w) < 4 or any(p in w for p in BIGRAMS))

    ranked = sorted((r for r in readings if (r[1] or "").strip()), key=lambda r: (-r[2], r[0]))
    if not ranked:
        return None
    out = []
    for line in ranked[0][1].strip().split("\n"):
        said = [(line, ranked[0][2])]
        for _, text, weight in ranked[1:]:
            said += [(x, weight) for x in difflib.get_close_matches(line, text.strip().split("\n"), 1, 0.25)]
        if not line.strip():
            out.append("")
        elif len(said) == 1:
            out.append(line)
        else:
            words = [(s.split(), w) for s, w in said]
            kept = []
            for i in range(max(len(ws) for ws, _ in words)):
                votes = {}
                for rank, (ws, weight) in enumerate(words):
                    if i < len(ws):
                        votes.setdefault(ws[i].lower(), []).append((ws[i], weight, sum(c.isalpha() for c in ws[i]), rank))
                best = max(votes.values(), key=lambda vs: (valid(vs[0][0]), round(sum(v[1] for v in vs), 9), max(v[2] for v in vs), -vs[0][3]))
                kept.append(max(best, key=lambda v: (v[2], -v[3]))[0])
            out.append(" ".join(kept))
    return "\n".join(out).strip()


def test_fusion_against_brute_force(spark):
    rng = random.Random(3)
    words = "the System of learning is modern and every student reads one".split()
    rows = []
    for page in range(40):
        lines = [" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(rng.randint(1, 5))]
        for engine in range(rng.randint(1, 4)):
            own = ["".join(rng.choice("01cxQ") if c != " " and rng.random() < 0.15 else c for c in line) for line in lines if rng.random() < 0.9]
            rows.append((page, f"e{engine}", "\n".join(own), rng.choice([0.5, 0.7, 0.9])))
    rows += [(100, "a", None, 0.5), (100, "b", " ", 0.5), (101, "a", "Alone  here", 0.1)]
    got = {r.page: r.text for r in fusion.fused(spark.createDataFrame(rows, "page long, engine string, text string, quality double")).collect()}
    want = {p: voted([r[1:] for r in rows if r[0] == p]) for p in {r[0] for r in rows}}
    assert got == {p: t for p, t in want.items() if t is not None}


def test_nearest_lines_are_those_of_difflib(monkeypatch):
    rng = random.Random(11)
    compared = []
    for case in range(400):
        letters = "ab c" if case % 2 else "etaoin shrdlu\U0001f600\ud800"
        lines = ["".join(rng.choices(letters, k=rng.choice([0, 1, 5, 40, 190, 230, 500]))) for _ in range(rng.randrange(0, 5))]
        own = "".join(rng.choice("01x") if rng.random() < 0.2 else c for c in rng.choice(lines)) if lines and case % 3 else "".join(rng.choices(letters, k=30))
        assert fusion.nearest(own, lines) == next(iter(difflib.get_close_matches(own, lines, 1, fusion.LIKE)), None), (own, lines)
        for x in lines:
            assert fusion.matching(x, own, float("inf")) == sum(m.size for m in difflib.SequenceMatcher(None, x, own).get_matching_blocks()), (x, own)
    own = "the quick brown fox jumps over the lazy dog and runs away from it all"
    true = fusion.matching
    monkeypatch.setattr(fusion, "matching", lambda a, b, n: compared.append(a) or true(a, b, n))
    near = own.replace("o", "0")
    assert fusion.nearest(own, [w[::-1] for w in own.split()] + [near]) == near and compared == [near]


def test_fusion_shuffles_no_words(spark):
    rows = spark.createDataFrame([(1, "a", "One line\n\nand more", 0.9), (1, "b", "0ne line\nand m0re", 0.8)], "page long, engine string, text string, quality double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = fusion.fused(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning(page") == plan.count("Exchange ") == 2 and not re.search(r"Exchange hashpartitioning\(page[^)]*(line|place)", plan)


def test_question_regions(spark):
    rows = [(1, 0, "before"), (1, 1, "Q1. what"), (1, 2, "(a) this"), (1, 3, "3) more"), (1, 4, "Question 1: again"), (1, 5, None), (1, 6, "(2) and"), (1, 7, "Ans 3: so"), (2, 0, "no number"), (2, 1, "ii) part"), (3, 0, None), (4, 0, "Q999 too great"), (4, 1, "7: seven")]
    got = fusion.question_regions(spark.createDataFrame(rows, "page long, place int, text string"), "page", "place").collect()
    assert sorted((r.page, r.position, r.number, r.text, r.paragraphs, tuple(r.parts)) for r in got) == [
        (1, 1, 1, "Q1. what\n(a) this", 2, ("a",)), (1, 2, 3, "3) more", 1, ()), (1, 3, 4, "Question 1: again", 2, ()), (1, 4, 2, "(2) and", 1, ()), (1, 5, 5, "Ans 3: so", 1, ()),
        (2, 0, 1, "no number\nii) part", 2, ("ii",)), (3, 0, 1, "", 1, ()), (4, 1, 7, "7: seven", 1, ()),
    ]


def test_segment_pairs_and_summary(spark):
    x = spark.createDataFrame([(1, "Q1. alpha beta\nQ2. gamma delta", "Q2. mine is\nQ3. " + "long " * 40)], "id long, m string, s string")
    got = {r.number: (r.model, r.student) for r in fusion.segment_pairs(x, "id", "m", "s").collect()}
    assert got[1] == ("alpha beta", None) and got[2] == ("gamma delta", "mine is") and got[3][0] is None
    last = fusion.segment_summary(segmented(x, "id", "s")).filter("number = 3").first()
    assert last.preview == ("long " * 24) + "..." and last.length == 199 and last.n_parts == 0


def swaps(core):
    """(word, kind, places) with one confusion undone at one place, kind 0; then with one undone at two to four places, kinds from 1 in their order: by loops."""
    from itertools import combinations

    def put(at, right):
        return "".join((right.upper() if c.isupper() else right) if i in at else c for i, c in enumerate(core))

    low = core.lower()
    for wrong, right in correction.SWAPS:
        for i, c in enumerate(low):
            if c == wrong:
                yield put((i,), right), 0, 1
    for kind, (wrong, right) in enumerate(correction.SWAPS[: correction.SEVERAL], 1):
        at = [i for i, c in enumerate(low) if c == wrong]
        for n in range(min(len(at), correction.PLACES), 1, -1):
            for places in combinations(at, n):
                yield put(places, right), kind, n


def test_swaps_against_enumeration(spark):
    rng = random.Random(7)
    words = {"".join(rng.choices("litoanuecs", k=rng.randrange(2, 7))): rng.randrange(1, 40) for _ in range(1500)} | {"awvvake": 9}
    tokens = sorted({"".join(rng.choices("litoanuecsLT", k=rng.randrange(2, 7))) for _ in range(400)} | {"awwake", "(Awwake)"})
    want = {}
    for token in tokens:
        core = token.strip("()")
        own = words.get(core.lower())
        if len(core) < 2 or (own is not None and own >= 5):
            continue
        found = [(k, p, words[w.lower()], -i, w) for i, (w, k, p) in enumerate(swaps(core)) if w.lower() in words and w.lower() != core.lower()]
        single = [f for f in found if f[0] == 0]
        if single:
            best = max(single, key=lambda f: (f[2], f[3]))
            if own is not None and best[2] <= own * 3:
                continue
        elif found and own is None:
            kinds = {k: max(p for kk, p, *_ in found if kk == k) for k, *_ in found}
            best = max((max((f for f in found if f[0] == k and f[1] == p), key=lambda f: (f[2], f[3])) for k, p in kinds.items()), key=lambda f: (f[2], -f[0]))
        else:
            continue
        want[token] = token.replace(core, best[4])
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    known = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {r.token: r.new for r in correction.swaps_undone(df, known, 5).collect()} == want


def test_words_of_any_length_and_ligatures_with_a_swap(spark):
    long = "internationalisation" * 3
    known = spark.createDataFrame([(long, 9), ("system", 30), ("modern", 4)], "word string, n long")
    tokens = spark.createDataFrame([(long.replace("a", "o", 1),), ("Syslern,",), ("rnoclern",), ("moclenn",)], "token string")
    assert {r.token: r.new for r in correction.swaps_undone(tokens, known, 5).collect()} == {long.replace("a", "o", 1): long}
    assert {r.token: r.new for r in correction.ligatures_undone(tokens, known).collect()} == {"Syslern,": "System,"}
