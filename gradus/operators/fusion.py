"""One text from what several engines read, and questions from the paragraphs of a page."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradus.functions.ocr import valid_word
from gradus.functions.text import strip

from .answers import segmented

#: Fixed value: how alike a line must be to vote with the best engine's line.
LIKE = 0.25


#: From this length on difflib leaves out the frequent characters of a line. Lines with more pairs of places of equal characters than CELLS are left to difflib.
POPULAR, CELLS = 200, 1 << 22


def longest_common(masks: dict[str, int], n: int, other: str) -> int:
    """The length of the longest common subsequence of `other` and a line of n characters, by the bits of each character's places in that line."""
    whole = (1 << n) - 1
    left = whole
    for mask in map(masks.get, other):
        if mask:
            both = left & mask
            left = (left + both) | (left - both)
    return n - (left & whole).bit_count()


def blocks(a: str, b: str) -> Callable[[int, int, int, int], tuple[int, int, int]]:
    """What finds the longest block of equal characters within a part of both lines, as difflib does: its start in each and its size.

    For each pair of places with equal characters, frequent ones left out, the run that ends there is counted once; a part's longest block is the longest run there, cut at the part's
    start, and then reaches over frequent characters on both sides.
    """
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    by_char = np.argsort(y, kind="stable")
    chars = y[by_char]
    popular = np.zeros(len(b), bool)
    if len(b) >= POPULAR:
        popular = np.searchsorted(chars, chars, "right") - np.searchsorted(chars, chars) > len(b) // 100 + 1
        by_char, chars = by_char[~popular], chars[~popular]
    begin = np.searchsorted(chars, x)
    n = np.searchsorted(chars, x, "right") - begin
    if n.sum() > CELLS:
        return difflib.SequenceMatcher(None, a, b).find_longest_match
    at = np.repeat(np.arange(len(a)), n)
    to = by_char[np.arange(len(at)) + np.repeat(begin - np.cumsum(n) + n, n)]
    reach = bool(popular.any())
    order = np.argsort((at - to) * (len(a) + 1) + at)
    i, j = at[order], to[order]
    first = np.ones(len(i), bool)
    first[1:] = (np.diff(i) != 1) | (np.diff(j) != 1)
    places = np.arange(len(i))
    runs = np.empty(len(i), int)
    runs[order] = places - np.maximum.accumulate(np.where(first, places, 0)) + 1

    def longest(lo: int, hi: int, left: int, right: int) -> tuple[int, int, int]:
        begin, end = np.searchsorted(at, (lo, hi))
        i, j, size = lo, left, 0
        if begin < end:
            js = to[begin:end]
            own = np.minimum(np.minimum(runs[begin:end], at[begin:end] - (lo - 1)), js - (left - 1))
            own[js >= right] = 0
            best = int(own.argmax())
            if own[best] > 0:
                size = int(own[best])
                i, j = int(at[begin + best]) + 1 - size, int(js[best]) + 1 - size
        if reach:
            while i > lo and j > left and a[i - 1] == b[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < hi and j + size < right and a[i + size] == b[j + size]:
                size += 1
        return i, j, size

    return longest


def matching(a: str, b: str, enough: float) -> int:
    """How many characters difflib matches between a and b, by longest blocks; as soon as `enough` are found, those found by then."""
    found, parts, longest = 0, [(0, len(a), 0, len(b))] if a and b else [], blocks(a, b)
    while parts and found < enough:
        lo, hi, left, right = parts.pop()
        i, j, size = longest(lo, hi, left, right)
        if size:
            found += size
            parts += [p for p in ((lo, i, left, j), (i + size, hi, j + size, right)) if p[0] < p[1] and p[2] < p[3]]
            parts.sort(key=lambda p: min(p[1] - p[0], p[3] - p[2]))
    return found


def nearest(own: str, lines: list[str]) -> str | None:
    """The first of difflib.get_close_matches(own, lines, 1, LIKE), None if there is none.

    Matched characters are a common subsequence, so its greatest length bounds the likeness: lines are compared from the greatest bound down, until no bound reaches the best.
    """
    if own in lines:
        return own
    masks: dict[str, int] = {}
    for i, c in enumerate(own):
        masks[c] = masks.get(c, 0) | 1 << i
    share = lambda n, x: 2.0 * n / (len(own) + len(x))
    bounds = sorted(((share(longest_common(masks, len(own), x), x), x) for x in set(lines)), reverse=True)
    best: tuple[float, str] | None = None
    for k, (bound, x) in enumerate(bounds):
        if bound < LIKE or (best and bound < best[0]):
            break
        rest = max([LIKE, *[b for b, _ in bounds[k + 1 : k + 2]], *([best[0]] if best else [])])
        found = (share(matching(x, own, rest * (len(own) + len(x)) / 2 + 1), x), x)
        if found[0] >= LIKE and (best is None or found > best):
            best = found
    return best[1] if best else None


def nearest_lines(own: Column, lines: Column) -> Column:
    """array<string>: for each of the first lines the one of the others that is most like it, null if none is like enough or the line is blank."""

    @F.pandas_udf("array<string>")
    def run(own: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([[nearest(a, list(bs)) if a.strip() else None for a in xs] for xs, bs in zip(own, lines, strict=True)], dtype=object)

    return run(own, lines)


def fused(readings: DataFrame, page: str = "page", engine: str = "engine", text: str = "text", quality: str = "quality") -> DataFrame:
    """(page, text): the lines of each page's best engine, each word voted on by the engines' lines that are most like it.

    One row for an engine and a page; a reading that is blank or null doesn't count, a page without another gives no row. Of equal quality, the first engine by name is the best.
    A word gets the sum of its engines' qualities, whatever its case; words that could be English go first, then the greatest sum, then the most letters, then the best engine's.
    Its spelling is that with the most letters. A line that no other engine has stays as it is. Readings are shuffled by page, words are not: they are counted where their page is.
    """
    r = readings.select(F.col(page).alias("page"), F.col(engine).alias("engine"), F.split(strip(F.col(text)), r"\r?\n").alias("lines"), F.col(quality).cast("double").alias("weight")).filter(strip(F.col(text)) != "")
    by_page = Window.partitionBy("page").orderBy(F.desc_nulls_last("weight"), "engine")
    ranked = r.withColumns({"rank": F.row_number().over(by_page), "own": F.first("lines").over(by_page)})
    votes = ranked.select("page", "weight", "rank", "own", nearest_lines("own", "lines").alias("near")).withColumn("lines", F.when(F.col("rank") == 1, F.col("own")).otherwise(F.col("near")))
    votes = votes.repartition("page")  # where Python ran, Spark no longer knows that rows lie by page
    lines = votes.select("page", "weight", "rank", F.posexplode("lines").alias("line", "said")).filter("said IS NOT NULL")
    said = lines.select("*", F.posexplode_outer(F.filter(F.split("said", r"\s+"), lambda w: w != "")).alias("place", "word"))
    letters = F.regexp_count("word", F.lit(r"\p{L}"))
    once = F.coalesce("place", F.lit(0)) == 0
    sums = said.groupBy("page", "line", "place", F.lower("word").alias("low")).agg(
        F.round(F.sum("weight"), 9).alias("sum"), F.max(letters).alias("letters"), F.min("rank").alias("rank"), F.max_by("word", F.struct(letters, F.negative("rank"))).alias("word"),
        F.count_if(once).alias("n"), F.max(F.when(once & (F.col("rank") == 1), F.col("said"))).alias("own"),
    )
    order = F.struct(F.coalesce(valid_word(F.col("low")), F.lit(False)), "sum", "letters", F.negative("rank"))
    words = sums.groupBy("page", "line", "place").agg(F.max_by("word", order).alias("word"), F.sum("n").alias("n"), F.max("own").alias("own"))
    listed = F.sort_array(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("place", "word"))))
    whole = words.groupBy("page", "line").agg(F.array_join(F.transform(listed, lambda w: w["word"]), " ").alias("voted"), F.sum("n").alias("n"), F.max("own").alias("own"))
    line = F.when(strip(F.col("own")) == "", "").when(F.col("n") > 1, F.col("voted")).otherwise(F.col("own"))
    out = whole.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("line", line.alias("said")))).alias("ls"))
    return out.select(F.col("page").alias(page), strip(F.array_join(F.transform("ls", lambda x: x["said"]), "\n")).alias(text))


#: How a paragraph begins that begins a question, and one that begins a part of it.
QUESTIONS = [
    r"^[Qq][\s.]*(\d{1,3})[\s.:)]*",
    r"(?i)^[Qq]ue(?:stion|s)?[\s.]*(\d{1,3})[\s.:)]*",
    r"^(\d{1,3})\s*[.):]",
    r"^\((\d{1,3})\)",
    r"^[Aa]ns(?:wer)?[\s.]*(\d{1,3})[\s.:)]*",
]
PARTS = [
    r"(?i)^[(\s]*([a-z])\s*[).:]",
    r"(?i)^[(\s]*(i{1,4}|iv|vi{0,3}|ix|x)\s*[).:]",
    r"(?i)^(\d{1,3})\s*[.]\s*[(\s]*([a-z])\s*[).:]?",
]


def first_of(text: Column, patterns: list[str], group: int = 1) -> Column:
    """What the first of the patterns that is there found; null if none is."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns])


def question_number(text: Column) -> Column:
    """The number, 1 to 200, of the question that a paragraph begins by its first fifty characters; null if it begins none."""
    head = strip(F.substring(strip(text), 1, 50))
    numbers = [F.nullif(F.regexp_extract(head, p, 1), F.lit("")).cast("int") for p in QUESTIONS]
    return F.coalesce(*[F.when((n >= 1) & (n <= 200), n) for n in numbers])


def question_regions(paragraphs: DataFrame, page: str, order: str, text: str = "text") -> DataFrame:
    """(page, position, number, text, paragraphs, parts) of the questions of each page.

    A paragraph with a question's number begins it, the ones up to the next belong to it. Those before the first belong to none; a page without a number is question 1.
    A number that was there before gets the next one after the page's greatest. parts: the labels of paragraphs that begin a part, in order. Null texts count as empty.
    """
    by_page = Window.partitionBy("page").orderBy("order")
    x = paragraphs.select(F.col(page).alias("page"), F.col(order).alias("order"), F.coalesce(text, F.lit("")).alias("text")).withColumn("number", question_number(F.col("text")))
    x = x.withColumn("position", F.count("number").over(by_page)).withColumn("all", F.count("number").over(Window.partitionBy("page"))).filter("position > 0 OR all = 0")
    label = first_of(F.substring(strip(F.col("text")), 1, 30), PARTS)
    said = F.sort_array(F.collect_list(F.struct("order", "text", label.alias("label"))))
    q = x.groupBy("page", "position").agg(F.coalesce(F.max("number"), F.lit(1)).alias("number"), said.alias("ps"))
    again = (F.row_number().over(Window.partitionBy("page", "number").orderBy("position")) > 1).cast("int")
    q = q.withColumn("again", again).withColumn("most", F.max("number").over(Window.partitionBy("page")))
    number = F.when(F.col("again") == 1, F.col("most") + F.sum("again").over(Window.partitionBy("page").orderBy("position"))).otherwise(F.col("number"))
    whole = strip(F.array_join(F.filter(F.transform("ps", lambda p: p["text"]), lambda t: t != ""), "\n"))
    return q.select(F.col("page").alias(page), "position", number.cast("int").alias("number"), whole.alias("text"), F.size("ps").alias("paragraphs"), F.array_compact(F.transform("ps", lambda p: p["label"])).alias("parts"))


def segment_summary(segments: DataFrame, preview: int = 120) -> DataFrame:
    """(doc_id, position, number, method, confidence, preview, length, marks, n_parts) of segmented(): what a reader is shown of them."""
    text = F.col("text")
    short = F.when(F.char_length(text) > preview, F.concat(F.substring(text, 1, preview), F.lit("..."))).otherwise(text)
    return segments.select("doc_id", "position", "number", "method", F.round("confidence", 3).alias("confidence"), short.alias("preview"), F.char_length(text).alias("length"), "marks", F.size("parts").alias("n_parts"))


def segment_pairs(pairs: DataFrame, id_col: str, model: str, student: str) -> DataFrame:
    """(doc_id, number, model, student): both texts cut into questions and met by number; a question that one side lacks is null there. Of a repeated number the last counts."""
    sides = [segmented(pairs, id_col, c).groupBy("doc_id", "number").agg(F.max_by("text", "position").alias(name)) for c, name in ((model, "model"), (student, "student"))]
    return sides[0].join(sides[1], ["doc_id", "number"], "full_outer")
