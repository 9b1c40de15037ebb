"""Weights, rubrics, confidence, grades and the final score as functions of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .similarity import ratio
from .text import edged, hits, let, strip, total_hits, words


def clipped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def labelled(value: Column, cuts: list[tuple[float, str]]) -> Column:
    out = F.when(value >= cuts[0][0], cuts[0][1])
    for at, name in cuts[1:-1]:
        out = out.when(value >= at, name)
    return out.otherwise(cuts[-1][1])


def grade(score: Column) -> Column:
    return labelled(score, L.GRADES)


def redistributed(kind: Column, scores: dict[str, Column]) -> Column:
    """Weighted mean by question type; a null component's weight goes to the others in proportion. 0 where all are null."""
    used = weights = F.lit(0.0)
    for name, score in scores.items():
        weight = F.lit(0.0)
        for k, table in L.QUESTION_WEIGHTS.items():
            weight = F.when(kind == k, table[name]).otherwise(weight)
        weight = F.when(kind.isin(list(L.QUESTION_WEIGHTS)), weight).otherwise(L.QUESTION_WEIGHTS["mixed"][name])
        used = used + F.when(score.isNotNull(), weight * score).otherwise(0.0)
        weights = weights + F.when(score.isNotNull(), weight).otherwise(0.0)
    return F.coalesce(F.try_divide(used, F.round(weights, 10)), F.lit(0.0))


def final(weighted: Column, length_penalty: Column, structure_bonus: Column, gaming_penalty: Column, modifier: Column | None = None) -> Column:
    score = clipped(weighted - length_penalty + structure_bonus - gaming_penalty)
    return score if modifier is None else clipped(score + modifier)


def normalised(weights: dict[str, float]) -> dict[str, float]:
    """Equal weights if they sum to nothing; scaled to 1 if they are further than 0.001 from it. Dimensions that no rubric has are dropped."""
    known = {k: v for k, v in weights.items() if k in L.RUBRICS["default"]}
    total = sum(known.values())
    if total <= 0:
        return {k: 1 / len(known) for k in known}
    return {k: v / total for k, v in known.items()} if abs(total - 1) > 0.001 else known


def understanding(semantic: Column, alignment: Column, graph: Column) -> Column:
    return F.when(alignment.isNotNull(), 0.55 * semantic + 0.45 * alignment).when(graph.isNotNull(), 0.6 * semantic + 0.4 * graph).otherwise(semantic)


def concept_coverage(keyword: Column, graph_coverage: Column, graph: Column) -> Column:
    return F.when(graph_coverage.isNotNull(), 0.35 * keyword + 0.65 * graph_coverage).when(graph.isNotNull(), 0.4 * keyword + 0.6 * graph).otherwise(keyword)


def terminology(matched: Column, missing: Column, student: Column, model: Column) -> Column:
    """Share of keywords that are there, and how dense words of four letters at least that are no filler stand beside the model; 0.5 without keywords."""
    hit = ratio(F.size(matched), F.size(matched) + F.size(missing))
    technical = lambda ws: ratio(F.size(F.filter(ws, lambda w: (F.char_length(w) >= 4) & ~w.isin(L.FILLER))), F.size(ws))
    there = let(words(model), lambda ws: F.when(F.size(ws) > 0, technical(ws)).otherwise(0.3))
    own = let(words(student), technical)
    density = F.when(there > 0, F.least(own / there, F.lit(1.5))).otherwise(1.0)
    bonus = F.least(F.size(F.filter(matched, lambda k: F.contains(k, F.lit(" ")))) * 0.03, F.lit(0.10))
    score = 0.55 * hit + 0.30 * F.least(density / 1.5, F.lit(1.0)) + 0.15 * F.least(hit + bonus, F.lit(1.0))
    return F.when(F.size(matched) + F.size(missing) == 0, 0.5).otherwise(clipped(score))


def heuristic_structure(text: Column) -> Column:
    """Structure by sentences, paragraphs, list marks, transitions and headings, where no structural score is known."""
    text = F.coalesce(text, F.lit(""))
    n = F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: strip(s) != ""))
    blocks = F.size(F.filter(F.split(text, "\n\n"), lambda p: strip(p) != ""))
    score = 0.30 + F.when(blocks >= 2, 0.15).otherwise(0.0) + F.when(text.rlike(L.LIST_MARK), 0.10).otherwise(0.0)
    score = score + F.when(n >= 6, 0.20).when(n >= 3, 0.10).otherwise(0.0) + F.least(hits(text, L.TRANSITIONS) * 0.05, F.lit(0.15))
    return F.least(score + F.when(text.rlike(L.HEADING), 0.05).otherwise(0.0), F.lit(1.0))


def examples(student: Column, model: Column, diagram: Column | None = None) -> Column:
    """Examples and applications beside the model's, numbers and names, and diagrams; 0 for fewer than ten characters."""
    student, model = F.coalesce(student, F.lit("")), F.coalesce(model, F.lit(""))
    count = lambda text, cues: let(F.lower(text), lambda low: total_hits(text, low, cues))
    share = lambda own, other: F.when(own > 0, F.when(other > 0, 0.40 * F.least(own / other, F.lit(1.0))).otherwise(0.40)).when(other == 0, 0.30).otherwise(0.0)
    given = let(count(student, L.EXAMPLE_CUES), lambda own: let(count(model, L.EXAMPLE_CUES), lambda other: share(own, other)))
    applied = 0.25 * F.least(count(student, L.APPLICATION_CUES) / F.greatest(count(model, L.APPLICATION_CUES), F.lit(1)), F.lit(1.0))
    specific = let(F.regexp_count(student, F.lit(L.QUANTITY)) + F.regexp_count(edged(student), F.lit(L.INNER_NAME)), lambda k: F.when(k >= 3, 0.15).when(k >= 1, 0.08).otherwise(0.0))
    drawn = F.when(hits(student, L.DIAGRAM_CUES) > 0, 0.08).otherwise(0.0)
    if diagram is not None:
        drawn = F.when(diagram > 0, 0.20 * diagram).otherwise(drawn)
    return F.when(F.char_length(strip(student)) < 10, 0.0).otherwise(clipped(given + applied + specific + drawn))


def merged_rubric(custom: dict[str, float], base: dict[str, float] | None = None) -> dict[str, float]:
    """The base rubric with a teacher's own weights in place of its; dimensions that no rubric has are dropped, then all are normalised."""
    base = base or L.RUBRICS["default"]
    return normalised(base | {k: v for k, v in custom.items() if k in base})


def simple_score(kind: Column, semantic: Column, keyword: Column, diagram: Column, length_penalty: Column) -> Column:
    """The score of meaning, keywords and diagram alone, each by its weight for the kind of question; without a diagram its weight goes to the others. Clipped after the length penalty."""
    parts = {"semantic": semantic, "keyword": keyword, "diagram": F.nullif(diagram, F.lit(0.0))}
    return clipped(redistributed(kind, parts) - length_penalty)


def rubric(dimensions: dict[str, Column], weights: dict[str, float] | None = None) -> dict[str, Column]:
    """The weighted score, its band, and the best and worst dimension (the first in order of equals)."""
    weights = normalised(weights or L.RUBRICS["default"])
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + clipped(dimensions[name]) * weight
    ranked = F.array(*[F.struct(clipped(dimensions[n]).alias("s"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(weights)])
    low = F.array(*[F.struct(clipped(dimensions[n]).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(weights)])
    return {"rubric_score": total, "band": labelled(total, [(0.85, "Excellent"), (0.70, "Good"), (0.50, "Average"), (0.0, "Poor")]), "best": F.array_max(ranked)["n"], "worst": F.array_min(low)["n"]}


def _known(*scores: Column) -> Column:
    return F.filter(F.array(*scores), lambda x: x.isNotNull())


def _mean(xs: Column) -> Column:
    return ratio(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), F.size(xs))


def embedding_stability(semantic: Column, graph: Column, alignment: Column) -> Column:
    xs = _known(semantic, graph, alignment)
    squares = let(_mean(xs), lambda mean: F.aggregate(F.transform(xs, lambda x: F.pow(x - mean, 2)), F.lit(0.0), lambda s, x: s + x))
    return F.when(F.size(xs) < 2, 0.65).otherwise(F.greatest(F.lit(0.0), 1 - F.sqrt(ratio(squares, F.size(xs))) / 0.25))


def keyword_consistency(keyword: Column, semantic: Column, graph: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(keyword - F.when(graph.isNotNull(), (semantic + graph) / 2).otherwise(semantic)) / 0.40)


def score_agreement(*scores: Column) -> Column:
    xs = _known(*scores)
    worst = let(_mean(xs), lambda mean: F.array_max(F.transform(xs, lambda x: F.abs(x - mean))))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - worst / 0.30) * 0.8 + F.least(F.lit(1.0), F.size(xs) / 6) * 0.2)


def structure_clarity(structural: Column, length_ratio: Column, chars: Column) -> Column:
    scale = F.when(length_ratio < 0.2, 0.3).when(length_ratio < 0.5, 0.7).when(length_ratio > 3.0, 0.8).otherwise(1.0)
    return clipped(F.coalesce(structural, F.lit(0.5)) * scale * F.when(chars < 20, 0.2).otherwise(1.0))


def answer_adequacy(chars: Column, model_chars: Column, keyword: Column, covered: Column) -> Column:
    length = F.least(F.lit(1.0), F.least(F.lit(2.0), chars / F.greatest(model_chars, F.lit(1))) / 0.4)
    return F.when(chars < 5, 0.0).otherwise(F.least(F.lit(1.0), length * 0.4 + F.least(F.lit(1.0), keyword / 0.3) * 0.3 + F.least(F.lit(1.0), covered / 30.0) * 0.3))


def confidence(factors: dict[str, Column], gaming_penalty: Column, ocr: Column | None = None) -> Column:
    total = F.lit(0.0)
    for name, weight in L.CONFIDENCE_WEIGHTS.items():
        total = total + factors[name] * weight
    if ocr is not None:
        total = F.when(ocr.isNotNull(), total * 0.9 + ocr * 0.1).otherwise(total)
    return clipped(total * F.when(gaming_penalty > 0.05, F.greatest(F.lit(0.5), 1 - gaming_penalty)).otherwise(1.0))
