"""Exact similarity joins of word sets by prefix filter or within rows, and soft alignment of sentences as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Smallest similarity of a soft match.
SOFT = 0.40


def ranked(sets: DataFrame, keys: list[str], words: str, frequency: DataFrame) -> DataFrame:
    """sets (keys, words) with _by, the distinct words from the rarest to the most frequent in frequency (word, n), equal ones in order, and _n, their number. Empty sets go."""
    each = sets.select(*keys, F.explode(F.array_distinct(words)).alias("word"))
    rare = each.join(frequency, "word", "left").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))), lambda x: x["word"]).alias("_by"))
    return rare.withColumn("_n", F.size("_by"))


def frequencies(*sides: tuple[DataFrame, str]) -> DataFrame:
    """(word, n): in how many sets of all sides each word is."""
    each = [df.select(F.explode(F.array_distinct(words)).alias("word")) for df, words in sides]
    both = each[0]
    for one in each[1:]:
        both = both.unionByName(one)
    return both.groupBy("word").agg(F.count("*").alias("n"))


def needed(size: Column, threshold: float) -> Column:
    """Words that two sets share at least, if their similarity reaches the threshold and the smaller one has `size`."""
    return F.greatest(F.ceil(size * threshold - 1e-9), F.lit(1))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, words: str = "words", threshold: float = SOFT) -> DataFrame:
    """(keys, left_id, right_id, shared, similarity): all pairs of sets with equal keys whose common words, by the smaller set's size, reach the threshold.

    left has keys, left_id and words, right has keys, right_id and words; ids are distinct within their keys, a null key meets none, and empty sets match none. A pair that reaches the threshold shares at least
    needed(n) of the smaller set's n words, so one of its n - needed(n) + 1 rarest is in the larger set: the rarest of the smaller meet all words of the larger, by an equi-join. No pair
    is made without a common word among those; the whole sets then decide. With few keys and frequent words the rarest keep the number of candidates small; no
    words are left out.
    """
    common = frequencies((left, words), (right, words))
    a = ranked(left, [*keys, left_id], words, common).select(*keys, F.col(left_id).alias("_a"), F.col("_by").alias("_aw"), F.col("_n").alias("_an"))
    b = ranked(right, [*keys, right_id], words, common).select(*keys, F.col(right_id).alias("_b"), F.col("_by").alias("_bw"), F.col("_n").alias("_bn"))
    first = lambda w, n: F.slice(F.col(w), 1, (F.col(n) - needed(F.col(n), threshold) + 1).cast("int"))
    met = lambda one, one_words, other, other_words, small: one.withColumn("_w", F.explode(one_words)).drop("_aw", "_bw").join(other.withColumn("_w", F.explode(other_words)).drop("_aw", "_bw"), [*keys, "_w"]).filter(small).select(*keys, "_a", "_b").distinct()
    pairs = met(a, first("_aw", "_an"), b, F.col("_bw"), F.col("_an") <= F.col("_bn")).unionByName(met(b, first("_bw", "_bn"), a, F.col("_aw"), F.col("_bn") < F.col("_an")))
    found = pairs.join(a, [*keys, "_a"]).join(b, [*keys, "_b"])
    shared = F.size(F.array_intersect("_aw", "_bw"))
    found = found.select(*keys, F.col("_a").alias(left_id), F.col("_b").alias(right_id), shared.alias("shared"), (shared / F.least("_an", "_bn")).alias("similarity"))
    return found.filter(F.col("similarity") >= threshold - 1e-12)


def overlap_within(rows: DataFrame, keys: list[str], left: str, right: str, left_id: str, right_id: str, threshold: float = SOFT) -> DataFrame:
    """(keys, left_id, right_id, shared, similarity): the pairs of overlap_join() where a row holds the sets of both sides, as arrays of arrays of words without nulls; ids are places there, from 0.

    Nothing is shuffled. A right set is first cut down to the words that any left set of its row has, and goes where there are none; only what is left meets the left sets one by one.
    """
    each = rows.select(*keys, F.col(left).alias("_left"), F.array_distinct(F.flatten(left)).alias("_any"), F.posexplode(right).alias(right_id, "_words"))
    met = each.select(*keys, right_id, "_left", F.size(F.array_distinct("_words")).alias("_n"), F.array_intersect("_words", "_any").alias("_met")).filter(F.size("_met") > 0)
    pairs = met.select(*keys, right_id, "_n", "_met", F.posexplode("_left").alias(left_id, "_words"))
    pairs = pairs.select(*keys, left_id, right_id, F.size(F.array_intersect("_met", "_words")).alias("shared"), F.least("_n", F.size(F.array_distinct("_words"))).alias("_least")).filter("shared > 0")
    return pairs.select(*keys, left_id, right_id, "shared", (F.col("shared") / F.col("_least")).alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)


def soft_alignment(models: DataFrame, matches: DataFrame, keys: list[str], model_id: str, student_id: str) -> DataFrame:
    """(keys, model_id, matches): for each model sentence, matches or none, the list of (student, similarity), the most similar first, then in the text's order."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("minus"), F.col(student_id).alias("student"))))
    lists = matches.groupBy(*keys, model_id).agg(F.transform(order, lambda x: F.struct(x["student"].alias("student"), (-x["minus"]).alias("similarity"))).alias("matches"))
    empty = F.array().cast("array<struct<student:int,similarity:double>>")
    return models.select(*keys, model_id).join(lists, [*keys, model_id], "left").withColumn("matches", F.coalesce("matches", empty))
