"""Quality of extracted text, question parts, entities, normal forms and changes of words, as functions of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import STOP_WORDS
from .similarity import ratio
from .text import let, strip, words

#: What is neither word, white space nor plain punctuation; a letter four times or more; where a question begins.
NOISE = r"[^\p{L}\p{N}_\s.,!?;:\-()]"
REPEATED = "(?i)" + "|".join(f"{c}{{4,}}" for c in "abcdefghijklmnopqrstuvwxyz")
QUESTION = r"(?m)^(?:(?:Q|Question|Ques|Ans)\.?\s*\d+|\d+[.):\-])"
ENTITY = r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"


def quality_score(text: Column) -> Column:
    """From 1 down by 0.2 for noise, 0.15 for repeated letters, 0.1 for odd sentence lengths, 0.05 for a single line; 0 for no text."""
    text = F.coalesce(text, F.lit(""))
    noise = F.regexp_count(text, F.lit(NOISE)) > F.char_length(text) * 0.1
    repeated = F.regexp_count(text, F.lit(REPEATED)) > 5
    parts = F.size(F.split(text, "[.!?]", -1))
    average = F.size(F.filter(F.split(F.regexp_replace(text, "[.!?]", " "), r"\s+"), lambda w: w != "")) / parts
    score = 1.0 - F.when(noise, 0.2).otherwise(0.0) - F.when(repeated, 0.15).otherwise(0.0) - F.when((average < 3) | (average > 50), 0.1).otherwise(0.0)
    return F.when(text == "", 0.0).otherwise(F.greatest(F.lit(0.0), score - F.when(~F.contains(text, F.lit("\n")), 0.05).otherwise(0.0)))


def question_parts(text: Column) -> Column:
    """The text cut before each question marker at a line start; trimmed, without empty parts."""
    cut = F.split(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\x01"), F.lit("")), "(" + QUESTION + ")", "\x01$1"), "\x01", -1)
    return F.filter(F.transform(cut, strip), lambda p: p != "")


def entities(text: Column) -> Column:
    """Names of several capitalised words, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({ENTITY})"), F.lit(1)))


def lemmas(ws: Column, known: dict[str, str] | None = None) -> Column:
    """The lemma of each word by a map; a word that it lacks stays as it is."""
    if not known:
        return ws
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.transform(ws, lambda w: F.coalesce(F.try_element_at(table, w), w))


def normal_form(text: Column, known: dict[str, str] | None = None) -> Column:
    """Lower-case words of letters and digits only that are no stop words, as lemmas, joined by spaces."""
    plain = F.filter(words(text), lambda w: w.rlike(r"^[\p{L}\p{N}]+$") & ~w.isin(STOP_WORDS))
    return F.array_join(lemmas(plain, known), " ")


def changed_words(before: Column, after: Column) -> Column:
    """How many distinct words are in one text only."""
    return F.size(F.array_except(words(before), words(after))) + F.size(F.array_except(words(after), words(before)))


def merged_missing(first: Column, second: Column) -> Column:
    """first and what second has besides, whatever the case; the first spelling stays."""
    step = lambda out, m: F.when(F.array_contains(F.transform(out, F.lower), F.lower(m)), out).otherwise(F.array_append(out, m))
    return F.aggregate(F.coalesce(second, F.array().cast("array<string>")), F.coalesce(first, F.array().cast("array<string>")), step)


def lines_of(text: Column) -> Column:
    """(line, text, words, empty) of each line, from 1."""
    bare = F.transform(F.split(strip(F.coalesce(text, F.lit(""))), "\n"), strip)
    return F.transform(bare, lambda s, i: F.struct((i + 1).alias("line"), F.substring(s, 1, 120).alias("text"), F.size(words(s)).alias("words"), (s == "").alias("empty")))


def hybrid(semantic: Column, tfidf: Column, jaccard: Column) -> Column:
    return 0.6 * semantic + 0.25 * tfidf + 0.15 * jaccard


def level_breakdown(counts: Column, names: list[str]) -> Column:
    """(level, name, count, confidence) for each of the levels' cue counts."""
    total = F.aggregate(counts, F.lit(0), lambda s, c: s + c)
    known = F.array(*[F.lit(n) for n in names])
    return let(total, lambda t: F.transform(counts, lambda c, i: F.struct((i + 1).alias("level"), F.get(known, i).alias("name"), c.alias("hits"), F.round(ratio(c, t), 3).alias("confidence"))))
