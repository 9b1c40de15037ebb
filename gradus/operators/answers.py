"""Operators that need Python for a document at a time: segmentation with offsets, assignment and line folds."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How questions are numbered, at line starts.
MARKERS = {
    "q_number": r"^[ \t]*[Qq]\.?[ \t]*(\d+)[ \t]*[.):\-]*[ \t]*",
    "question_number": r"^[ \t]*[Qq]uestion[ \t]*(\d+)[ \t]*[.):\-]*[ \t]*",
    "answer_number": r"^[ \t]*[Aa]ns(?:wer)?[ \t]*\.?[ \t]*(\d+)[ \t]*[.):\-]*[ \t]*",
    "plain_number": r"^[ \t]*(\d{1,2})[.)][ \t]+",
}
MARKS = re.compile(r"(?:[\[(]\s*(\d+)\s*marks?|(?<![\d.,])(\d{1,3})\s*(?:marks?|m))\s*[\])]*\s*$", re.I)
PARTS = re.compile(r"^[ \t]*(?:\(([a-z]|[ivx]+)\)|([a-z]|[ivx]+)\))[ \t]*", re.M)
SEGMENTS = "doc_id long, position int, number int, method string, confidence double, start int, text string, marks int, parts array<string>"


def sequence_confidence(numbers: list[int]) -> float:
    """0.95 if each number is one more than the one before; less by the share of such steps, 0.5 if they fall, 0.2 for one alone."""
    if len(numbers) < 2:
        return 0.2
    steps = [b - a for a, b in zip(numbers, numbers[1:], strict=False)]
    good = sum(s == 1 for s in steps) / len(steps)
    return 0.95 if good == 1 else 0.6 + 0.3 * good if all(s > 0 for s in steps) else 0.5


def segments(text: str | None) -> list[tuple]:
    """(position, number, method, confidence, start, text, marks, parts) of each question in a text: by the surest kind of marker that occurs twice, else by paragraphs, else the whole."""
    text = re.sub(r"\n{3,}", "\n\n", (text or "").replace("\t", "    ")).strip()
    if len(text) < 5:
        return [(0, 1, "empty", 0.0, 0, text, None, [])]
    best: tuple[float, int, str, list[re.Match]] | None = None
    for name, pattern in MARKERS.items():
        found = list(re.finditer(pattern, text, re.M))
        if len(found) >= 2:
            rank = (sequence_confidence([int(m[1]) for m in found]), len(found), name, found)
            if best is None or rank[:2] > best[:2]:
                best = rank
    if best:
        sure, _, name, found = best
        cuts = [(int(m[1]), m.end(), n.start() if n else len(text)) for m, n in zip(found, [*found[1:], None], strict=True)]
    else:
        blocks = [m for m in re.finditer(r"\S(?:.|\n(?!\s*\n))*", text) if len(m[0].strip()) >= 15]
        name, sure = ("paragraphs", 0.35) if sum(len(m[0].strip()) >= 30 for m in blocks) >= 2 else ("whole", 0.2)
        cuts = [(i + 1, m.start(), m.end()) for i, m in enumerate(blocks)] if name == "paragraphs" else [(1, 0, len(text))]
    out = []
    for i, (number, start, end) in enumerate(cuts):
        piece = text[start:end].strip()
        marks = MARKS.search(piece.split("\n")[0])
        parts = [m[1] or m[2] for m in PARTS.finditer(piece)]
        out.append((i, number, name, sure, start, piece, int(marks[1] or marks[2]) if marks else None, parts if len(parts) >= 2 else []))
    return out


def segmented(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each question segment of each text, with its offset in the cleaned text."""
    columns = ["doc_id", "position", "number", "method", "confidence", "start", "text", "marks", "parts"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(i, *s) for i, t in zip(frame.doc_id, frame.text, strict=True) for s in segments(t)], columns=columns)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, SEGMENTS)


def proportional_marks(segments: DataFrame, total: float) -> DataFrame:
    """Marks that a segment names, else an equal share of the total."""
    n = segments.groupBy("doc_id").agg(F.count("*").alias("_n"))
    return segments.join(n, "doc_id").withColumn("max_marks", F.coalesce(F.col("marks").cast("double"), F.round(F.lit(total) / F.col("_n"), 2))).drop("_n")


def assign(sim: np.ndarray) -> list[int]:
    """The column for each row that makes the sum of similarities greatest, each column once; -1 where there are more rows than columns and the row is left over.

    Shortest augmenting paths with potentials; O(rows * rows * columns).
    """
    rows, cols = sim.shape
    if not rows or not cols:
        return [-1] * rows
    cost = np.zeros((rows, max(rows, cols)))
    cost[:, :cols] = -sim
    n, m = cost.shape
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while owner[j0]:
            used[j0] = True
            reduced = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = ~used[1:] & (reduced < low[1:])
            low[1:][better], way[1:][better] = reduced[better], j0
            free = np.where(used[1:], np.inf, low[1:])
            j1 = int(free.argmin()) + 1
            step = free[j1 - 1]
            u[owner[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    out = [-1] * n
    for j in range(1, cols + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def optimal_alignment(sim: Column) -> Column:
    """array<int>: assign() of a matrix of similarities, array<array<double>>; null for null."""

    @F.pandas_udf("array<int>")
    def run(matrices: pd.Series) -> pd.Series:
        return pd.Series([None if m is None else assign(np.array([list(r) for r in m], float).reshape(len(m), -1)) for m in matrices], dtype=object)

    return run(sim)


def greedy_alignment(sim: Column, least: float = 0.20) -> Column:
    """array<int>: in the order of the rows, the best column that no row has yet, if its similarity is enough; -1 otherwise."""

    def step(taken: Column, row: Column) -> Column:
        free = F.transform(row, lambda s, j: F.struct(F.when(F.array_contains(taken, j), -1.0).otherwise(s).alias("s"), (-j).alias("j")))
        best = F.array_max(free)
        return F.array_append(taken, F.when(best["s"] >= least, -best["j"]).otherwise(-1))

    return F.aggregate(sim, F.array().cast("array<int>"), step)


def tier(sim: Column) -> Column:
    return F.when(sim >= 0.70, "strong").when(sim >= 0.45, "partial").when(sim >= 0.30, "weak").otherwise("missing")


def similar(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


def without_echoes(text: str | None, like: float = 0.8, last: int = 3) -> str:
    """Drops a line that is like one of the last kept ones."""
    kept: list[str] = []
    for line in (text or "").split("\n"):
        if not line.strip() or all(similar(line, k) <= like for k in kept[-last:]):
            kept.append(line)
    return "\n".join(kept)


def joined_lines(text: str | None) -> str:
    """Joins a line that ends within a word or sentence with the next if that begins in lower case."""
    out: list[str] = []
    for line in (text or "").split("\n"):
        if out and out[-1] and out[-1][-1] not in " .!?;:,-()" and line.lstrip()[:1].islower():
            out[-1] += line.lstrip()
        else:
            out.append(line)
    return "\n".join(out)


def folded(text: Column) -> Column:
    """joined_lines, then without_echoes."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without_echoes(joined_lines(t)) for t in texts], dtype=object)

    return run(text)
