"""Quality of scanned text, and merging what several engines read."""

from __future__ import annotations

import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as L
from .similarity import ratio
from .text import let, strip


def bigram_score(text: Column) -> Column:
    """Mean frequency of the letter pairs, by the greatest one; 0 for fewer than four letters and spaces, or no pair."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z ]", "")
    return F.least(F.lit(1.0), pair_mean(plain) / max(L.BIGRAMS.values()))


def pair_mean(plain: Column) -> Column:
    """Mean frequency of the pairs of letters in texts of a-z and spaces; 0 for fewer than four characters, or no pair. Frequencies are summed as whole hundredths."""
    value = np.zeros(1 << 16, np.int64)
    for pair, n in L.BIGRAMS.items():
        value[ord(pair[0]) << 8 | ord(pair[1])] = round(n * 100)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        chars = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].astype(np.uint16) if data and ends[-1] > ends[0] else np.zeros(0, np.uint16)
        ends = ends - ends[0]
        sums, counts = np.zeros(len(chars) + 1, np.int64), np.zeros(len(chars) + 1, np.int64)
        np.cumsum(value[chars[:-1] << 8 | chars[1:]], out=sums[2:])
        np.cumsum((chars[:-1] != 32) & (chars[1:] != 32), out=counts[2:])
        lo, hi = np.minimum(ends[:-1] + 1, ends[1:]), ends[1:]
        n = counts[hi] - counts[lo]
        return pa.array(np.where((n > 0) & (np.diff(ends) >= 4), (sums[hi] - sums[lo]) / 100 / np.maximum(n, 1), 0.0))

    return run(plain)


def char_certainty(text: Column) -> Column:
    """Share of letters, digits and plain punctuation."""
    odd = F.char_length(F.regexp_replace(text, r"[\p{L}\p{N} .,;:!?'\"()\n-]+", ""))
    return ratio(F.char_length(text) - odd, F.char_length(text))


def valid_word(word: Column) -> Column:
    """Whether letters could be an English word: vowels, no long run of consonants at the start, no letter three times, a common pair."""
    return valid_letters(F.lower(F.regexp_replace(word, "[^a-zA-Z]", "")))


def valid_letters(w: Column) -> Column:
    pairs = "|".join(f"{a}[{''.join(p[1] for p in L.BIGRAMS if p[0] == a)}]" for a in dict.fromkeys(p[0] for p in L.BIGRAMS))
    fair = ~((F.char_length(w) > 3) & ~w.rlike("[aeiouy]")) & ~w.rlike("^[^aeiouy]{4}") & ~w.rlike(r"(.)\1\1") & ((F.char_length(w) < 4) | w.rlike(pairs))
    return F.when(F.char_length(w) < 2, w.isin("a", "i")).otherwise(fair)


def valid_ratio(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return let(F.filter(F.split(low, "[^a-z']+"), lambda w: w != ""), lambda found: ratio(F.size(F.filter(found, lambda w: valid_letters(F.replace(w, F.lit("'"), F.lit(""))))), F.size(found)))


WORD = re.compile(r"[^ \t-\r]+")


def repeats(text: Column) -> Column:
    """(n, top, pairs, top_pair) of a text's words in lower case: how many there are, how often the most frequent one occurs, how many different neighbours, and how often the most frequent two."""

    @F.arrow_udf("struct<n:int,top:int,pairs:int,top_pair:int>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            own = WORD.findall(t.as_py() or "")
            once, twice = Counter(own), Counter(pairwise(own))
            out.append({"n": len(own), "top": max(once.values(), default=0), "pairs": len(twice), "top_pair": max(twice.values(), default=0)})
        return pa.array(out, pa.struct([(k, pa.int32()) for k in ("n", "top", "pairs", "top_pair")]))

    return run(F.lower(text))


def repetition(text: Column) -> Column:
    """From 0 to 1: how frequent the most frequent word and pair of neighbours are, and how few pairs differ; 0 for fewer than six words."""
    return repetition_of(repeats(text))


def repetition_of(found: Column) -> Column:
    n = found["n"]
    word = F.greatest(F.lit(0.0), (ratio(found["top"], n) - 0.15) * 2)
    pair = F.least(F.lit(1.0), F.greatest(F.lit(0.0), found["top_pair"] - F.lit(2.0)) / 4)
    unique = F.greatest(F.lit(0.0), 1 - ratio(found["pairs"], n - 1) * 1.5)
    return F.when(n < 6, 0.0).otherwise(F.least(F.lit(1.0), (word + pair + unique) / 3))


def quality(text: Column, confidence: Column, expected: int = 500) -> Column:
    text = strip(F.coalesce(text, F.lit("")))
    length = F.least(F.lit(1.0), F.char_length(text) / expected)
    total = 0.30 * confidence + 0.25 * valid_ratio(text) + 0.20 * bigram_score(text) + 0.10 * char_certainty(text) + 0.10 * length - 0.05 * repetition(text)
    return F.when(text == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def best_engine(df: DataFrame, page: str = "page", engine: str = "engine", text: str = "text", score: str = "quality") -> DataFrame:
    """The text of the best engine of each page; of equals the first by name."""
    return df.groupBy(page).agg(F.max_by(F.struct(engine, text, score), F.struct(F.col(score), F.negative(F.xxhash64(engine)))).alias("b")).select(page, f"b.{engine}", f"b.{text}", f"b.{score}")


def voted_words(df: DataFrame, keys: list[str], word: str = "word", weight: str = "weight") -> DataFrame:
    """The word of each place with the greatest sum of weights, valid words first; of equals the first in order."""
    sums = df.groupBy(*keys, F.lower(F.col(word)).alias("_low")).agg(F.sum(weight).alias("_sum"), F.max_by(word, weight).alias(word))
    first = F.max_by(word, F.struct(valid_word(F.col("_low")), F.col("_sum"), F.negative(F.xxhash64("_low"))))
    return sums.groupBy(*keys).agg(first.alias(word))


def paragraph_groups(lines: DataFrame, page: str = "page", top: str = "y1", bottom: str = "y2", factor: float = 1.5) -> DataFrame:
    """Numbers the paragraphs of each page: a gap of over factor times the median line height begins one."""
    from pyspark.sql.window import Window

    order = Window.partitionBy(page).orderBy(top)
    height = F.median(F.col(bottom) - F.col(top)).over(Window.partitionBy(page))
    breaks = (F.col(top) - F.lag(bottom).over(order)) > height * factor
    return lines.withColumn("paragraph", F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(order) + 1)
