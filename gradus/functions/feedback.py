"""What an answer's scores say in words, and the report of gaming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import detectors as D
from . import lexicons as L

#: The caps of the six detectors and of their sum, and where penalties turn from low to medium to high.
GAMING_CAPS = {"repetition": 0.20, "irrelevance": 0.25, "stuffing": 0.20, "gibberish": 0.30, "padding": 0.15, "copy_shuffle": 0.15}
GAMING_CAP = 0.40
SEVERITY = {"repetition": (0.05, 0.12), "irrelevance": (0.06, 0.15), "stuffing": (0.04, 0.10), "gibberish": (0.05, 0.15), "padding": (0.04, 0.08), "copy_shuffle": (0.04, 0.08)}


def gaming(penalties: dict[str, Column]) -> dict[str, Column]:
    """The capped sum, what is flagged (high) or warned of (medium), and how sure gaming is."""
    raw = sum((penalties[n] for n in list(penalties)[1:]), penalties[next(iter(penalties))])
    kind = lambda want: F.filter(F.array(*[F.when(D.severity(p, *SEVERITY[n]) == want, F.lit(n)) for n, p in penalties.items()]), lambda x: x.isNotNull())
    return {"gaming_penalty": F.least(raw, F.lit(GAMING_CAP)), "flags": kind("high"), "warnings": kind("medium"), "gaming_confidence": raw / sum(GAMING_CAPS.values())}


def explanation(grade: Column, matched: Column, total: Column) -> Column:
    said = F.when(grade == "excellent", "Nearly everything that was asked is there").when(grade == "good", "Most of what was asked is there").when(grade == "average", "Part of what was asked is there").otherwise("Little of what was asked is there")
    return F.format_string("%s: %d of %d keywords.", said, matched, total)


def suggestions(grade: Column, length_ratio: Column, missing: Column, structure: dict[str, Column] | None = None) -> Column:
    """What would help, most important first."""
    tips = [
        F.when(length_ratio < 0.5, F.lit("Write more: the answer is less than half as long as expected.")),
        F.when(length_ratio > 2.0, F.lit("Be brief: the answer is more than twice as long as expected.")),
        F.when(F.size(missing) > 0, F.concat(F.lit("Mention "), F.array_join(F.slice(missing, 1, 5), ", "), F.lit("."))),
        F.when(grade.isin("poor", "average"), F.lit("Go over the topic again.")),
    ]
    for name, tip in (("intro", "Begin with what the topic is."), ("conclusion", "End with a conclusion."), ("examples", "Give an example."), ("coherence", "Link the sentences.")):
        if structure:
            tips.append(F.when(structure[name] < 0.2, F.lit(tip)))
    return F.filter(F.array(*tips), lambda t: t.isNotNull())


def level_name(level: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in L.LEVELS]), level - 1)


def level_feedback(question: Column, answer: Column) -> Column:
    """How the answer's level meets the question's."""
    return F.when(answer < question, F.concat(F.lit("The question asks to "), F.lower(level_name(question)), F.lit("; the answer comes to "), F.lower(level_name(answer)), F.lit("."))).when(answer > question, F.lit("The answer goes beyond what is asked.")).otherwise(F.lit("The answer meets what is asked."))
