"""Detectors of structure, gaming and cognitive level: each is one expression, so a table is read once for all."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as L
from .similarity import overlap_first, overlap_smaller, ratio
from .text import content_words, edged, hits, let, needle, paragraphs, quick, sentences, strip, total_hits, type_token_ratio, without_stop_words, words


def steps(value: Column, *cuts: tuple[float, float]) -> Column:
    """The score of the first cut that the value reaches, 0 below all."""

    def first(v: Column) -> Column:
        out = F.when(v >= cuts[0][0], F.lit(float(cuts[0][1])))
        for at, score in cuts[1:]:
            out = out.when(v >= at, F.lit(float(score)))
        return out.otherwise(0.0)

    return let(value, first)


def tenths(score: Column) -> Column:
    """A sum of decimal steps as the double that is nearest to it, whatever the order of adding: decimals of the queries' SQL are exact."""
    return F.round(score, 10)


def capped(score: Column) -> Column:
    return F.least(F.lit(1.0), score)


def intro(sents: Column) -> Column:
    first = F.coalesce(F.get(sents, 0), F.lit(""))
    own = F.filter(F.split(first, r"\s+"), lambda w: w != "")
    capitals = F.exists(F.slice(own, 2, F.size(own)), lambda w: w.rlike(r"^\p{Lu}\p{L}*$"))
    opening = let(edged(first), lambda cue: F.when(cue.rlike("(?i)" + L.INTRO), 0.5).when(cue.rlike("(?i)" + L.CONTEXT), 0.3).otherwise(0.0))
    return F.when(F.size(sents) == 0, 0.0).otherwise(capped(steps(F.size(own), (12, 0.3), (8, 0.15)) + opening + F.when((F.size(own) > 2) & capitals, 0.2).otherwise(0.0)))


def body(text: Column, sents: Column) -> Column:
    return body_of(F.transform(sents, words), words(text), F.size(paragraphs(text)))


def body_of(sent_words: Column, ws: Column, n_paragraphs: Column) -> Column:
    n = F.size(sent_words)
    elaborate = ratio(F.size(F.filter(sent_words, lambda s: F.size(s) >= 10)), n)
    average = ratio(F.size(ws), n)
    score = steps(n, (6, 0.25), (3, 0.15)) + steps(n_paragraphs, (3, 0.20), (2, 0.10)) + steps(elaborate, (0.6, 0.25), (0.3, 0.15))
    score = score + steps(type_token_ratio(F.slice(ws, 1, 200)), (0.65, 0.15), (0.50, 0.08)) + F.when(average.between(12, 25), 0.15).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(capped(score))


def conclusion(sents: Column) -> Column:
    n = F.size(sents)
    last = F.coalesce(F.get(sents, n - 1), F.lit(""))
    two = edged(F.concat_ws(" ", F.get(sents, n - 2), last))
    count = F.size(words(last))
    score = F.when(two.rlike("(?i)" + L.CONCLUSION), 0.5).otherwise(0.0) + F.when(two.rlike("(?i)" + L.SUMMARY), 0.2).otherwise(0.0)
    score = score + F.when(count >= 10, 0.2).otherwise(0.0) + F.when((count >= 6) & ~F.endswith(last, F.lit("?")), 0.1).otherwise(0.0)
    return F.when(n < 2, 0.0).otherwise(capped(score))


def lists(text: Column) -> Column:
    found = lambda p: text.rlike("(?i)" + quick(p))
    score = steps(hits(text, L.NUMBERED), (3, 0.4), (2, 0.2)) + F.when(hits(text, L.BULLETS) >= 2, 0.3).otherwise(0.0)
    for pattern, value in ((L.ROMAN, 0.2), (L.LETTERED, 0.2), (L.ENUMERATION, 0.2), (L.COLON_LIST, 0.15)):
        score = score + F.when(found(pattern), value).otherwise(0.0)
    return capped(score)


def definitions(text: Column) -> Column:
    return let(F.lower(text), lambda low: definitions_of(text, low))


def definitions_of(text: Column, low: Column) -> Column:
    """low: the text in lower case. A pattern is only tried where the letters that it needs are there."""
    found = [(F.contains(low, F.lit(needle(p))) & text.rlike("(?i)" + p)).cast("int") for p in L.DEFINITIONS]
    return steps(sum(found[1:], found[0]), (3, 1.0), (2, 0.7), (1, 0.4))


def examples(text: Column) -> Column:
    score = F.least(F.lit(0.5), hits(text, L.EXAMPLES) * 0.2)
    for pattern, value in ((L.ANALOGIES, 0.2), (L.NUMBERS, 0.15)):
        score = score + F.when(text.rlike("(?i)" + quick(pattern)), value).otherwise(0.0)
    return capped(score + F.when(text.rlike(r"\b(?=[els])(like|such as|e\.g\.)\s+[A-Z][a-z]+"), 0.15).otherwise(0.0))


def coherence(text: Column, sents: Column) -> Column:
    return coherence_of(text, F.transform(sents, content_words))


def coherence_of(text: Column, sets: Column) -> Column:
    counts = [hits(text, p) for p in (L.ADDITIVE, L.ADVERSATIVE, L.CAUSAL, L.SEQUENTIAL)]
    total, kinds = counts[0], (counts[0] > 0).cast("int")
    for c in counts[1:]:
        total, kinds = total + c, kinds + (c > 0).cast("int")
    empty = F.array().cast("array<string>")

    def shared(sets: Column) -> Column:
        n = F.size(sets)
        links = F.zip_with(F.slice(sets, 1, F.greatest(n - 1, F.lit(0))), F.slice(sets, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), overlap_smaller(a, b)))
        flow = let(F.filter(links, lambda x: x.isNotNull()), lambda xs: ratio(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), F.size(xs)))
        topic = F.when(n >= 3, overlap_first(F.coalesce(F.get(sets, 0), empty), F.coalesce(F.get(sets, n - 1), empty))).otherwise(0.0)
        return F.when(n < 2, -1.0).otherwise(steps(flow, (0.15, 0.25), (0.08, 0.12)) + F.when(topic >= 0.15, 0.2).otherwise(0.0))

    cue = steps(total, (4, 0.3), (2, 0.15)) + steps(kinds, (3, 0.25), (2, 0.15))
    return let(shared(sets), lambda x: F.when(x < 0, 0.0).otherwise(capped(cue + x)))


def in_parts(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with a text's sentences (name_ss), their words (name_sw), their content words (name_cs) and all words (name_ws), unless it has them.

    A text is split and put in lower case once; sentences end at white space, so their words are all of the text's.
    """
    if f"{name}_ss" in df.columns:
        return df
    x = df.withColumn(f"{name}_ss", sentences(text)).withColumn(f"{name}_sw", F.transform(f"{name}_ss", words))
    return x.withColumns({f"{name}_ws": F.flatten(f"{name}_sw"), f"{name}_cs": F.transform(f"{name}_sw", without_stop_words)})


def longer(parts: Column, sents: Column, than: int) -> Column:
    """What belongs to the sentences of more than so many characters."""
    sizes = F.transform(sents, F.char_length)
    return F.when(F.coalesce(F.array_min(sizes) > than, F.lit(True)), parts).otherwise(let(sizes, lambda ns: F.filter(parts, lambda x, i: F.get(ns, i) > than)))


def structured(df: DataFrame, text: Column, own: str = "_s") -> DataFrame:
    """df with the seven scores, their weighted sum (structural_score) and the bonus (structure_bonus); all 0 for texts of fewer than ten characters.

    What several scores need is a column of its own, so it is computed once: sentences, their words and content words, words, paragraphs. own: the name of the text's in_parts(), if df has them.
    """
    x = in_parts(df.withColumn("_t", F.coalesce(text, F.lit(""))), text, own)
    t, cue, ss = F.col("_t"), F.col("_cue"), F.col(f"{own}_ss")
    x = x.withColumns({"_cue": edged(t), "_np": F.size(paragraphs(t))}).withColumn("_low", F.lower("_cue"))
    scores = {"intro": intro(ss), "body": body_of(F.col(f"{own}_sw"), F.col(f"{own}_ws"), F.col("_np")), "conclusion": conclusion(ss), "lists": lists(cue), "definitions": definitions_of(cue, F.col("_low")), "examples": examples(cue), "coherence": coherence_of(cue, F.col(f"{own}_cs"))}
    long = F.char_length(F.trim(t)) >= 10
    x = x.withColumns({k: F.when(long, tenths(v)).otherwise(0.0) for k, v in scores.items()})
    total = sum((F.col(k) * w for k, w in list(L.STRUCTURE_WEIGHTS.items())[1:]), F.col("intro") * L.STRUCTURE_WEIGHTS["intro"])
    x = x.withColumn("structural_score", capped(total)).withColumn("structure_bonus", F.col("structural_score") * L.STRUCTURE_BONUS)
    return x.drop("_t", "_cue", "_np", "_low", *_added(df, own))


def _added(df: DataFrame, name: str) -> list[str]:
    """Columns of in_parts() that df doesn't have."""
    return [f"{name}_{c}" for c in ("ss", "sw", "ws", "cs") if f"{name}_{c}" not in df.columns]


def structure(text: Column) -> dict[str, Column]:
    """structured() as expressions, for texts that are no column yet."""
    text = F.coalesce(text, F.lit(""))
    sents = sentences(text)
    of = lambda score: let(edged(text), score)
    scores = {"intro": let(sents, intro), "body": let(sents, lambda x: body(text, x)), "conclusion": let(sents, conclusion), "lists": of(lists), "definitions": of(definitions), "examples": of(examples), "coherence": of(lambda cue: coherence(cue, sents))}
    long = F.char_length(F.trim(text)) >= 10
    scores = {k: F.when(long, tenths(v)).otherwise(0.0) for k, v in scores.items()}
    total = capped(sum((scores[k] * w for k, w in list(L.STRUCTURE_WEIGHTS.items())[1:]), scores["intro"] * L.STRUCTURE_WEIGHTS["intro"]))
    return scores | {"structural_score": total, "structure_bonus": total * L.STRUCTURE_BONUS}


def severity(penalty: Column, low: float, medium: float) -> Column:
    return F.when(penalty <= 0, "none").when(penalty < low, "low").when(penalty < medium, "medium").otherwise("high")


def repetition(text: Column) -> Column:
    """Share of sentences that another repeats in words, by 0.35, to 0.20 at most."""

    def penalty(sets: Column) -> Column:
        same = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & (overlap_smaller(a, b) >= 0.85)
        numbered = F.transform(sets, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
        twins = let(numbered, lambda xs: F.filter(xs, lambda a: F.exists(xs, lambda b: (a["i"] != b["i"]) & same(a["s"], b["s"]))))
        return F.when(F.size(sets) < 2, 0.0).otherwise(F.least(ratio(F.size(twins), F.size(sets)) * 0.35, F.lit(0.20)))

    return let(F.transform(sentences(text, 3), content_words), penalty)


def twins(sets: list[list[str]], like: float = 0.85) -> int:
    """How many sentences, given as distinct words, share that part of the smaller one's words with another.

    Equal sets are compared once. A set meets only those that have one of its rarest words, as many as it may miss and one more: who shares enough has one.
    """
    times = Counter(frozenset(s) for s in sets if len(s))
    kinds = list(times)
    found = [times[s] > 1 for s in kinds]
    places: dict[str, list[int]] = {}
    for i, s in enumerate(kinds):
        for word in s:
            places.setdefault(word, []).append(i)
    for i, s in enumerate(kinds):
        least = next(m for m in range(1, len(s) + 1) if m / len(s) >= like)
        for word in sorted(s, key=lambda w: len(places[w]))[: len(s) - least + 1]:
            for j in places[word]:
                if i != j and len(kinds[j]) >= len(s) and not (found[i] and found[j]) and len(s & kinds[j]) >= least:
                    found[i] = found[j] = True
    return sum(times[s] for s, f in zip(kinds, found, strict=True) if f)


def repetition_of_many(text: Column) -> Column:
    """repetition() for texts of any number of sentences, without comparing all pairs."""
    return repetition_of(F.transform(sentences(text, 3), content_words))


def repetition_of(sets: Column) -> Column:

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([0 if t is None else twins(t) for t in texts], dtype="int32")

    return F.when(F.size(sets) < 2, 0.0).otherwise(F.least(ratio(run(sets), F.size(sets)) * 0.35, F.lit(0.20)))


def irrelevant(own: Column, other: Column) -> Column:
    """Places of sentences, from 0, that share less than a tenth of their words with any sentence of the model; both as content words."""

    def places(others: Column) -> Column:
        best = lambda s: F.coalesce(F.array_max(F.transform(others, lambda m: overlap_first(s, m))), F.lit(0.0))
        marked = F.transform(own, lambda s, i: F.struct(i.alias("i"), ((F.size(s) == 0) | (best(s) < 0.10)).alias("off")))
        return F.transform(F.filter(marked, lambda x: x["off"]), lambda x: x["i"])

    return let(other, places)


def irrelevance(student: Column, model: Column) -> Column:
    return irrelevance_of(F.transform(sentences(student, 3), content_words), F.transform(sentences(model, 3), content_words))


def irrelevance_of(own: Column, other: Column) -> Column:

    def penalty(off: Column) -> Column:
        n = F.size(off)
        neighbours = F.size(F.filter(F.zip_with(F.slice(off, 1, F.greatest(n - 1, F.lit(0))), F.slice(off, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b - a), lambda d: d == 1))
        return F.when(n > 0, F.least(ratio(n, F.size(own)) * 0.30 + tenths(neighbours * 0.03), F.lit(0.25))).otherwise(0.0)

    return F.when((F.size(own) == 0) | (F.size(other) == 0), 0.0).otherwise(let(irrelevant(own, other), penalty))


def copy_shuffle(student: Column, model: Column) -> Column:
    """Half or more of the sentences share three quarters of their words with one of the model's."""
    return copy_shuffle_of(F.transform(sentences(student, 3), content_words), F.transform(sentences(model, 3), content_words))


def copy_shuffle_of(own: Column, other: Column) -> Column:
    copied = let(other, lambda others: F.transform(own, lambda s: (F.size(s) > 0) & F.exists(others, lambda m: overlap_first(s, m) >= 0.75)))

    def penalty(flags: Column) -> Column:
        n, copies = F.size(flags), F.size(F.filter(flags, lambda x: x))
        share = ratio(copies, n)
        part = F.least(F.least((share - 0.5) * 0.4, F.lit(0.15)) + F.when(n - copies <= 1, 0.05).otherwise(0.0), F.lit(0.15))
        return F.when((n == 0) | (share < 0.5), 0.0).otherwise(part)

    return F.when(F.size(other) == 0, 0.0).otherwise(let(copied, penalty))


def stuffing(student: Column, model: Column, keyword: Column, semantic: Column, found: Column) -> Column:
    """Keywords far above meaning, far denser than in the model, or in very short sentences."""
    return stuffing_of(words(student), words(model), F.size(sentences(student, 3)), keyword, semantic, found)


def stuffing_of(own: Column, other: Column, n_sentences: Column, keyword: Column, semantic: Column, found: Column) -> Column:
    gap = keyword - semantic
    gap_penalty = F.when(gap > 0.30, F.least((gap - 0.30) * 0.5, F.lit(0.10))).otherwise(0.0)
    density = lambda ws: ratio(F.size(F.filter(ws, lambda w: F.array_contains(found, w))), F.size(ws))
    a, b = density(own), density(other)
    dense = F.when((b > 0) & (a > b * 2.5), F.least((a / F.greatest(b, F.lit(0.001)) - 2.5) * 0.04, F.lit(0.08))).otherwise(0.0)
    short = F.when((F.size(own) / F.greatest(n_sentences, F.lit(1)) < 4) & (F.size(found) >= 3), 0.06).otherwise(0.0)
    penalty = gap_penalty + F.when(F.size(found) > 0, dense + short).otherwise(0.0)
    return F.when(F.size(own) < 5, 0.0).otherwise(F.least(penalty, F.lit(0.20)))


def gibberish(text: Column, entropy: Column, vocabulary: list[str] | None = None) -> Column:
    """Entropy of letters, known words, vowels, odd characters and variety. vocabulary: words that count as known, stop words and more."""
    return gibberish_of(F.coalesce(text, F.lit("")), words(text), entropy, vocabulary)


def gibberish_of(text: Column, ws: Column, entropy: Column, vocabulary: list[str] | None = None) -> Column:
    known = vocabulary or L.STOP_WORDS
    parts = F.struct(
        F.filter(ws, lambda w: w.rlike(r"^\p{L}+$")).alias("letters"),
        F.regexp_replace(F.lower(text), "[^a-z]+", "").alias("plain"),
        ratio(F.char_length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", "")), F.char_length(text)).alias("odd"),
        type_token_ratio(ws).alias("variety"),
        F.size(ws).alias("n"),
        entropy.alias("entropy"),
    )
    penalty = let(parts, lambda x: let(_vowels(x["plain"]), lambda vowels: _strange(x, vowels, known)))
    return F.when(F.char_length(F.trim(text)) < 15, 0.0).otherwise(penalty)


def _vowels(plain: Column) -> Column:
    left = plain
    for v in "aeiou":
        left = F.replace(left, F.lit(v), F.lit(""))
    return F.char_length(plain) - F.char_length(left)


def _strange(x: Column, vowels: Column, known: list[str]) -> Column:
    """The penalty by letters (words of letters alone), plain (the letters a-z), odd, variety, n (words) and entropy."""
    letters, plain, odd, entropy = x["letters"], x["plain"], x["odd"], x["entropy"]
    real = ratio(F.size(F.filter(letters, lambda w: w.isin(known))), F.size(letters))
    balance = ratio(vowels, F.greatest(F.char_length(plain) - vowels, F.lit(1)))
    penalty = F.when(entropy > 4.8, F.least((entropy - 4.8) * 0.15, F.lit(0.10))).otherwise(0.0)
    penalty = penalty + let(real, lambda real: F.when((F.size(letters) >= 8) & (real < 0.40), F.least((0.40 - real) * 0.5, F.lit(0.12))).otherwise(0.0))
    penalty = penalty + let(balance, lambda balance: F.when((F.char_length(plain) >= 20) & ((balance < 0.20) | (balance > 1.5)), 0.08).otherwise(0.0))
    penalty = penalty + F.when(odd > 0.15, F.least(odd * 0.3, F.lit(0.08))).otherwise(0.0)
    penalty = penalty + F.when(x["n"].between(5, 50) & (x["variety"] < 0.30), 0.06).otherwise(0.0)
    return F.least(penalty, F.lit(0.30))


#: Characters that are counted first, as most of a text is made of them; which ones they are changes no result.
OFTEN = " etaoinshrdlcumwfgypbvk.,"


def entropy(text: Column) -> Column:
    """Entropy in bits of a text's characters, in lower case; 0 for none."""

    def without(acc: Column, c: Column) -> Column:
        """What is left without c, and the sum with its count; the character at hand is replaced in what is left alone, so text shrinks at every step."""
        return let(F.replace(acc["left"], c, F.lit("")), lambda left: F.struct(left.alias("left"), (acc["sum"] + let((F.char_length(acc["left"]) - F.char_length(left)).cast("double"), lambda k: F.when(k > 0, k * F.log2(k)).otherwise(0.0))).alias("sum")))

    def bits(t: Column) -> Column:
        n = F.char_length(t)
        often = F.aggregate(F.array(*[F.lit(c) for c in OFTEN]), F.struct(t.alias("left"), F.lit(0.0).alias("sum")), without)
        rest = lambda acc: F.aggregate(F.filter(F.array_distinct(F.split(acc["left"], "")), lambda c: c != ""), acc, without)["sum"]
        return F.coalesce(F.log2(n) - F.try_divide(let(often, rest), n), F.lit(0.0))

    return let(F.lower(F.coalesce(text, F.lit(""))), bits)


def bits(text: str) -> float:
    """Entropy in bits of a text's characters; 0 for none."""
    if not text:
        return 0.0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(codes) if codes.max() < 1024 else np.unique(codes, return_counts=True)[1]
    n = n[n > 0]
    return float(max(0.0, np.log2(len(codes)) - (n * np.log2(n)).sum() / len(codes)))


def entropy_of_many(text: Column) -> Column:
    """entropy() for large tables: a pass over a text's characters in Python instead of one for each character that it may have."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([0.0 if t is None else bits(t) for t in texts], dtype="float64")

    return run(F.lower(F.coalesce(text, F.lit(""))))


def padding(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    of = lambda sents, cue: padding_of(sents, F.transform(sents, without_stop_words), hits(cue, L.FILLERS), hits(cue, L.HEDGES))
    return let(F.transform(sentences(text, 3), words), lambda sents: let(edged(text), lambda cue: of(sents, cue)))


def padded(df: DataFrame, text: Column) -> DataFrame:
    """df with fillers, hedges and the penalty for them (padding). What is needed several times is a column of its own, so it is computed once."""
    x = df.withColumns({"_cue": edged(text), "_sw": F.transform(sentences(text, 3), words)})
    x = x.withColumns({"fillers": hits(F.col("_cue"), L.FILLERS), "hedges": hits(F.col("_cue"), L.HEDGES), "_cs": F.transform("_sw", without_stop_words)})
    return x.withColumn("padding", padding_of(F.col("_sw"), F.col("_cs"), F.coalesce("fillers", F.lit(0)), F.coalesce("hedges", F.lit(0)))).drop("_cue", "_sw", "_cs")


def padding_of(sents: Column, sets: Column, fillers: Column, hedges: Column) -> Column:
    """sents: words of each sentence; sets: its content words."""
    n = F.size(sents)
    empty = F.array().cast("array<string>")
    first, last = F.get(sets, 0), F.get(sets, n - 1)
    content = F.aggregate(F.transform(sents, lambda s: F.size(F.filter(s, lambda w: ~w.isin(L.STOP_WORDS) & w.rlike(r"^\p{L}+$")))), F.lit(0), lambda s, x: s + x)
    penalty = F.when(fillers >= 3, F.least(fillers * 0.02, F.lit(0.08))).when(fillers >= 2, 0.03).otherwise(0.0)
    penalty = penalty + F.when(ratio(hedges, n) > 0.8, 0.05).otherwise(0.0)
    penalty = penalty + F.when((n >= 4) & (overlap_smaller(F.coalesce(first, empty), F.coalesce(last, empty)) > 0.7), 0.05).otherwise(0.0)
    penalty = penalty + F.when((n >= 3) & (ratio(content, n) < 2.0), 0.04).otherwise(0.0)
    return F.when(n < 2, 0.0).otherwise(F.least(tenths(penalty), F.lit(0.15)))


def gamed(df: DataFrame, student: Column, model: Column, keyword: Column, semantic: Column, found: Column, own: str = "_s", other: str = "_m") -> DataFrame:
    """df with the penalties of all six detectors; 0 where the answer or the model has fewer than ten characters.

    keyword: coverage; semantic: likeness of meaning; found: the model's keywords that the answer has. Sentences and words of both texts are computed once. own, other: the names of their in_parts(), if df has them.
    """
    x = in_parts(in_parts(df.withColumn("_t", F.coalesce(student, F.lit(""))), student, own), model, other)
    x = x.withColumns({f"_{k}": longer(F.col(f"{own}_{k}"), F.col(f"{own}_ss"), 3) for k in ("sw", "cs")} | {"_ms": longer(F.col(f"{other}_cs"), F.col(f"{other}_ss"), 3), "_e": entropy_of_many(F.col("_t")), "_cue": edged(F.col("_t"))})
    x = x.withColumns({"_f": hits(F.col("_cue"), L.FILLERS), "_h": hits(F.col("_cue"), L.HEDGES)})
    sets, models, ws = F.col("_cs"), F.col("_ms"), F.col(f"{own}_ws")
    penalties = {
        "repetition": repetition_of(sets),
        "irrelevance": irrelevance_of(sets, models),
        "stuffing": stuffing_of(ws, F.col(f"{other}_ws"), F.size("_sw"), keyword, semantic, found),
        "gibberish": gibberish_of(F.col("_t"), ws, F.col("_e"), L.STOP_WORDS + L.COMMON_WORDS),
        "padding": padding_of(F.col("_sw"), sets, F.col("_f"), F.col("_h")),
        "copy_shuffle": copy_shuffle_of(sets, models),
    }
    long = (F.char_length(strip(student)) >= 10) & (F.char_length(strip(model)) >= 10)
    x = x.withColumns({n: F.when(long, p).otherwise(0.0) for n, p in penalties.items()})
    return x.drop("_t", "_sw", "_cs", "_ms", "_e", "_cue", "_f", "_h", *_added(df, own), *_added(df, other))


def cue_counts(text: Column, cues: list[list[str]]) -> Column:
    """How many cues of each group an edged() text has."""
    return let(F.lower(text), lambda low: let(text, lambda cue: F.array(*[total_hits(cue, low, group) for group in cues])))


def level(text: Column, cues: list[list[str]]) -> Column:
    """(level, confidence, hits): the cognitive level with the greatest weighted number of cues, the lowest of equals, and how sure that is; (2, 0.3) without a cue."""
    counts = let(edged(text), lambda cue: cue_counts(cue, cues))
    weights = F.array(*[F.lit(w) for w in L.LEVEL_WEIGHTS])

    def vote(cs: Column) -> Column:
        total = F.aggregate(cs, F.lit(0), lambda s, c: s + c)
        scored = F.zip_with(cs, weights, lambda c, w: c * w)
        everything = F.aggregate(scored, F.lit(0.0), lambda s, x: s + x)
        best = F.array_max(F.transform(scored, lambda x, i: F.struct(x.alias("score"), (-i - 1).alias("minus"))))
        sure = F.least(F.lit(1.0), best["score"] / F.greatest(everything, F.lit(1.0)) + 0.2 * F.least(total, F.lit(5)) / 5)
        return F.struct(F.when(total == 0, 2).otherwise(-best["minus"]).alias("level"), F.when(total == 0, 0.3).otherwise(sure).alias("confidence"), total.alias("hits"))

    return let(counts, vote)


def level_modifier(question: Column, answer: Column, question_sure: Column, answer_sure: Column) -> Column:
    """-0.05 a level below what is asked (to -0.15), +0.025 a level above it (to +0.05), by confidence."""
    gap = answer - question
    return F.when(gap < 0, -F.least(-gap * 0.05 * F.least(question_sure, F.lit(0.9)), F.lit(0.15))).when(gap > 0, F.least(F.least(gap, F.lit(2)) * 0.025 * answer_sure, F.lit(0.05))).otherwise(0.0)


def level_alignment(question: Column, answer: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 + (answer - question) * 0.2))
