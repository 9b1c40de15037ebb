"""Sentence alignment and concept coverage of answers against models, over whole tables.

Similarity is a function of two columns of content words, so that an embedder's can take its place; by default it is word overlap.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions import lexicons as L
from gradus.functions.similarity import cosine, copy_penalty, overlap_smaller, ratio, word_similarity
from gradus.functions.text import content_words, edged, let, ngrams, sentences, words

from .answers import optimal_alignment, tier
from .terms import entity_density, terms, with_cosine, with_salience

Similarity = Callable[[Column, Column], Column]


def role(sentence: Column) -> Column:
    """What a sentence does: the first kind of cue that it has."""

    def kind(cue: Column) -> Column:
        out = None
        for name, pattern in L.ROLE_CUES:
            found = cue.rlike("(?i)" + pattern)
            out = F.when(found, name) if out is None else out.when(found, name)
        return out.when(F.size(words(sentence)) >= 8, "explanation").otherwise("general")

    return let(edged(sentence), kind)


def importance(sentence: Column, place: Column, count: Column, keywords: Column | None = None, salience: Column | float = 1.0, density: Column | float = 0.5, kind: Column | None = None) -> Column:
    """From 0.3 to 2: role, salience, place in the text, density of names and keywords. Salience and density count as average where they aren't given; important_sentences() gives them. kind: the sentence's role, where it is known."""
    weigh = lambda kind: F.coalesce(*[F.when(kind == name, value) for name, value in L.ROLE_WEIGHTS.items()], F.lit(1.0))
    weight = let(role(sentence) if kind is None else kind, weigh)
    position = F.when(place == 0, 1.4).when(place == count - 1, 1.2).when(place <= 2, 1.1).otherwise(1.0)
    boost = F.lit(0.0) if keywords is None else F.least(F.size(F.array_intersect(words(sentence), keywords)) * 0.2, F.lit(1.0))
    return F.greatest(F.lit(0.3), F.least(F.lit(2.0), 0.35 * weight + 0.25 * salience + 0.15 * position + 0.15 * density + 0.10 * boost))


def important_sentences(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, place, sentence, role, salience, density, importance) of each sentence of over two characters: salience is tf-idf within its text. Keys are distinct; null and blank texts have no sentences."""
    x = texts.select(key, sentences(text, 2).alias("ss"))
    x = with_salience(x.withColumn("_ts", F.transform("ss", lambda s: terms(s))), "salience", "_ts")
    x = x.select(key, F.size("ss").alias("_n"), F.posexplode(F.arrays_zip("ss", "salience")).alias("place", "_z"))
    x = x.select(key, "_n", "place", F.col("_z.ss").alias("sentence"), "_z.salience").withColumns({"role": role(F.col("sentence")), "density": entity_density(F.col("sentence"))})
    value = importance(F.col("sentence"), F.col("place"), F.col("_n"), salience=F.col("salience"), density=F.col("density"), kind=F.col("role"))
    return x.select(key, "place", "sentence", "role", "salience", "density", value.alias("importance"))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def order_score(places: Column) -> Column:
    """Agreement of an order with the ascending one, from 0 to 1; 1 for fewer than two. Equal places count as neither."""
    numbered = F.transform(places, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    pairs = let(numbered, lambda xs: F.flatten(F.transform(xs, lambda a: F.transform(F.filter(xs, lambda b: b["i"] > a["i"]), lambda b: F.signum((b["p"] - a["p"]).cast("double"))))))
    return let(pairs, lambda s: F.when(F.size(s) == 0, 1.0).otherwise((ratio(_total(s), F.size(s)) + 1) / 2))


def redundancy(sim: Column, like: float = 0.85) -> Column:
    """0.02 / k for the k-th pair of columns of a similarity matrix with like profiles, 0.10 at most."""
    columns = F.transform(F.sequence(F.lit(0), F.size(F.get(sim, 0)) - 1), lambda j: F.transform(sim, lambda r: F.get(r, j)))
    numbered = F.transform(columns, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    twins = let(numbered, lambda xs: _total(F.transform(xs, lambda a: F.size(F.filter(xs, lambda b: (b["i"] > a["i"]) & (cosine(a["c"], b["c"]) >= like))).cast("double"))))
    return let(twins, lambda n: F.when(n < 1, 0.0).otherwise(F.least(_total(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(200.0)).cast("int")), lambda k: 0.02 / k)), F.lit(0.10))))


def aligned(pairs: DataFrame, model: str = "model", student: str = "student", similarity: Similarity = overlap_smaller) -> DataFrame:
    """pairs with the matrix, the assignment and the scores of each answer's sentences against the model's.

    Every model sentence is assigned one of the student's at most, optimally; a better one that is taken still counts for quality if it reaches 0.40.
    The assignment is cubic in the number of sentences of a pair, within its task. Scores are 0 where either side has none.
    """
    x = pairs.withColumns({"_m": sentences(F.col(model), 2), "_s": sentences(F.col(student), 2)})
    x = x.withColumns({"_mw": F.transform("_m", content_words), "_sw": F.transform("_s", content_words)})
    x = x.withColumn("sim", F.transform("_mw", lambda m: F.transform(F.col("_sw"), lambda s: similarity(m, s))))
    x = x.withColumn("matched", optimal_alignment(F.when((F.size("_m") > 0) & (F.size("_s") > 0), F.col("sim"))))
    quality = F.zip_with("sim", "matched", lambda row, j: F.greatest(F.when(j >= 0, F.get(row, j)).otherwise(0.0), F.when(F.array_max(row) >= 0.40, F.array_max(row)).otherwise(0.0)))
    x = x.withColumns({"quality": quality, "weights": F.transform("_m", lambda s, i: importance(s, i, F.size("_m")))})
    tiers = F.transform("quality", tier)
    x = x.withColumn("tiers", tiers)
    w = F.col("weights")
    alignment = ratio(_total(F.zip_with("quality", w, lambda q, v: q * v)), _total(w))
    covered = ratio(_total(F.zip_with("tiers", w, lambda t, v: F.when(t.isin("strong", "partial"), v).otherwise(0.0))), _total(w))
    depth = ratio(F.size(F.filter("tiers", lambda t: t == "strong")), F.size("tiers"))
    gap = F.least(_total(F.zip_with("tiers", w, lambda t, v: F.when(t == "missing", v * 0.08).otherwise(0.0))), F.lit(0.20))
    placed = F.filter(F.zip_with("matched", "tiers", lambda j, t: F.when((j >= 0) & (t != "missing"), j)), lambda j: j.isNotNull())
    x = x.withColumns({"alignment": alignment, "coverage": covered, "depth": depth, "gap": gap, "order": order_score(placed), "redundant": redundancy(F.col("sim"))})
    count = lambda name: F.size(F.filter("tiers", lambda t: t == name)).alias(name)
    combined = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.50 * F.col("alignment") + 0.20 * F.col("coverage") + 0.15 * F.col("order") + 0.15 * F.col("depth") - F.col("gap") - F.col("redundant") - F.greatest(F.lit(0.0), 0.5 - F.col("order")) * 0.05))
    orphans = F.size("_s") - F.size(F.array_distinct(F.filter("matched", lambda j: j >= 0)))
    both = (F.size("_m") > 0) & (F.size("_s") > 0)
    names = ["alignment", "coverage", "order", "depth", "gap"]
    return x.select(*[F.col(c) for c in pairs.columns], "matched", *[F.when(both, F.col(n)).otherwise(0.0).alias(n) for n in names], F.when(both, combined).otherwise(0.0).alias("combined"), *[F.when(both, count(t)).otherwise(0).alias(t) for t in ("strong", "partial", "weak", "missing")], F.when(both, orphans).otherwise(F.size("_s")).alias("orphans"))


#: Verbs that join a subject and an object.
VERBS = "is are was were has have had manages provides handles performs includes contains defines describes explains controls allocates schedules processes converts uses creates enables supports implements stores refers involves requires allows helps".split()
_TRIPLES = {v: re.compile(rf"\b(\w[\w\s]{{2,30}}?)\s+{v}\s+(\w[\w\s]{{2,30}}?)(?:[.,;!?]|$)", re.I) for v in VERBS}


def triples(text: str | None) -> list[tuple[str, str, str]]:
    """(subject, verb, object) of each clause of a text, each once."""
    out: dict[tuple[str, str, str], tuple[str, str, str]] = {}
    for sentence in re.split(r"[.!?]+", text or ""):
        sentence = sentence.strip()
        present = set(sentence.lower().split())
        if len(sentence) >= 10:
            for verb in VERBS:
                if verb in present:
                    for m in _TRIPLES[verb].finditer(sentence):
                        found = (m[1].strip(), verb, m[2].strip())
                        out.setdefault(tuple(x.lower() for x in found), found)
    return list(out.values())


def propositions(text: Column) -> Column:
    """array<struct<subject, predicate, object>>."""

    @F.pandas_udf("array<struct<subject:string,predicate:string,object:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"subject": s, "predicate": v, "object": o} for s, v, o in triples(t)] for t in texts], dtype=object)

    return run(text)


def phrases(text: Column, most: int = 80) -> Column:
    """Capitalised phrases of several words, then words of four letters at least that occur twice, by frequency and then in order; lower case, each once."""
    text = F.coalesce(text, F.lit(""))
    names = F.transform(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"), F.lit(1)), lambda p: F.lower(F.regexp_replace(p, r"\s+", " ")))
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z]{4,})\b"), F.lit(1)), lambda w: ~F.array_contains(F.array(*[F.lit(x) for x in L.STOP_WORDS]), w))

    def counted(ws: Column) -> Column:
        starts = F.filter(F.transform(ws, lambda w, i: F.when((i == 0) | (w != F.get(ws, i - 1)), i)), lambda i: i.isNotNull())
        size = lambda xs: F.zip_with(xs, F.concat(F.slice(xs, 2, F.size(xs)), F.array(F.size(ws))), lambda a, b: F.struct((a - b).alias("minus"), F.get(ws, a).alias("word")))
        return let(starts, lambda xs: F.when(F.size(xs) > 0, size(xs)).otherwise(F.array().cast("array<struct<minus:int,word:string>>")))

    often = F.transform(F.slice(F.array_sort(F.filter(let(F.array_sort(found), counted), lambda c: c["minus"] <= -2)), 1, 40), lambda c: c["word"])
    return F.slice(F.array_distinct(F.concat(names, often)), 1, most)


def phrase_similarity(a: Column, b: Column) -> Column:
    """Word similarity of equal-length single words, else overlap of their words."""
    return F.when((F.instr(a, " ") == 0) & (F.instr(b, " ") == 0), word_similarity(a, b)).otherwise(overlap_smaller(F.split(a, " "), F.split(b, " ")))


def concept_scores(pairs: DataFrame, model: str = "model", student: str = "student", similarity: Similarity = phrase_similarity) -> DataFrame:
    """pairs with coverage of the model's concepts, its quality, the student's relevance, penalties for length and copying, and all combined."""
    x = pairs.withColumns({"_m": phrases(F.col(model)), "_s": phrases(F.col(student)), "_mn": F.size(words(F.col(model))), "_sn": F.size(words(F.col(student)))})
    x = x.withColumns({"_mg": ngrams(words(F.col(model)), 5), "_sg": ngrams(words(F.col(student)), 5)})
    best = let(F.col("_s"), lambda own: F.transform("_m", lambda m: F.coalesce(F.array_max(F.transform(own, lambda s: similarity(m, s))), F.lit(0.0))))
    off = let(F.col("_m"), lambda other: F.size(F.filter("_s", lambda s: F.coalesce(F.array_max(F.transform(other, lambda m: similarity(m, s))), F.lit(0.0)) < 0.30)))
    x = x.withColumns({"_best": best, "_off": off, "copied": ratio(F.size(F.array_intersect("_mg", "_sg")), F.size("_mg"))})
    covered, partial = F.filter("_best", lambda b: b >= 0.55), F.filter("_best", lambda b: (b >= 0.35) & (b < 0.55))
    coverage = ratio(_total(F.filter("_best", lambda b: b >= 0.35)), F.size("_m"))
    depth = F.when(F.size(covered) > 0, ratio(_total(covered), F.size(covered))).otherwise(0.5 * ratio(_total(partial), F.size(partial)))
    relevance = ratio(F.size("_s") - F.col("_off"), F.size("_s"))
    longer = ratio(F.col("_sn"), F.col("_mn"))
    verbosity = F.when((longer > 2.0) & (ratio(F.size("_s"), F.greatest(F.size("_m"), F.lit(1))) < 1.2), F.least((longer - 2.0) / 2.0 * 0.1, F.lit(0.15))).otherwise(0.0)
    density = F.least(F.lit(1.0), ratio(ratio(F.size("_s"), F.col("_sn")), ratio(F.size("_m"), F.col("_mn"))))
    x = x.withColumns({"coverage": coverage, "depth": depth, "relevance": relevance, "verbosity": verbosity, "copying": copy_penalty(F.col("copied")), "density": density})
    combined = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.50 * F.col("coverage") + 0.30 * F.col("depth") + 0.20 * F.col("relevance") - F.col("verbosity") - F.col("copying")))
    none = F.size("_m") == 0
    names = ["depth", "relevance", "verbosity", "copying", "density"]
    missing = F.filter(F.zip_with("_m", "_best", lambda m, b: F.when(b < 0.35, m)), lambda m: m.isNotNull())
    return x.select(*pairs.columns, F.size("_m").alias("n_concepts"), F.size(covered).alias("n_covered"), F.size(partial).alias("n_partial"), missing.alias("missing"), F.when(none, 0.5).otherwise(F.col("coverage")).alias("coverage"), *names, F.when(none, 0.5).otherwise(combined).alias("combined"))


def tfidf_cosine(pairs: DataFrame, key: str, model: str = "model", student: str = "student") -> DataFrame:
    """(key, similarity): cosine of the two texts' tf-idf weights over single words and pairs, with document frequencies within the pair and smoothing."""
    return with_cosine(pairs.select(key, terms(F.col(model)).alias("_a"), terms(F.col(student)).alias("_b")), "similarity", "_a", "_b").select(key, "similarity")
