"""Correction of scanned words against a dictionary with frequencies, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.text import let

#: What scanning takes for something else; both ways are tried.
CONFUSED = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("li", "h"), ("0", "o"), ("1", "l"), ("5", "s"), ("8", "b"), ("|", "l")]


def deletions(word: Column, distance: int = 2) -> Column:
    """The word and what is left of it without up to so many characters, each once."""
    shorter = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    out = F.array(word)
    for _ in range(distance):
        out = let(out, lambda ws: F.array_distinct(F.concat(ws, F.flatten(F.transform(F.filter(ws, lambda w: F.char_length(w) > 0), shorter)))))
    return out


#: Longer words are met by pieces, as what is left of them after deletions grows with a power of the length.
LONG = 16


def pieces(word: Column, distance: int = 2) -> Column:
    """A dictionary word of any length in so many pieces that one of them is in every word within the distance, each with length and number."""
    n, parts = F.char_length(word), distance + 1
    begin = lambda i: F.floor(n * i / parts).cast("int")
    return F.array(*[F.concat_ws(":", n, F.lit(i), F.substr(word, begin(i) + 1, begin(i + 1) - begin(i))) for i in range(parts)])


def pieces_within(word: Column, distance: int = 2) -> Column:
    """What pieces() a word shares with one of over LONG characters within the distance, at each place that edits can shift it to."""
    parts, shifts = distance + 1, range(-distance, distance + 1)
    out = []
    for more in shifts:
        n = F.char_length(word) + more
        begin = lambda i, n=n: F.floor(n * i / parts).cast("int")
        for i in range(parts):
            size = begin(i + 1) - begin(i)
            for shift in shifts:
                at = begin(i) + shift
                out.append(F.when((n > LONG) & (at >= 0) & (at + size <= n - more), F.concat_ws(":", n, F.lit(i), F.substr(word, at + 1, size))))
    return F.array_distinct(F.filter(F.array(*out), lambda x: x.isNotNull()))


def candidates(unknown: DataFrame, dictionary: DataFrame, distance: int = 2) -> DataFrame:
    """(word, candidate, edits, n) of dictionary words within so many edits of each unknown word.

    unknown: (word); dictionary: (word, n). Words within d edits share what is left of both after d deletions at most, so an equi-join finds all
    of them, without comparing every pair; the edit distance then decides. Dictionary words of more than LONG characters are met by pieces instead.
    """
    none = F.array().cast("array<string>")
    n, c = F.char_length("word"), F.char_length("candidate")
    own = F.concat(F.when(n <= LONG + distance, deletions(F.col("word"), distance)).otherwise(none), F.when(n > LONG - distance, pieces_within(F.col("word"), distance)).otherwise(none))
    keyed = unknown.select("word").distinct().select("word", F.explode(own).alias("key"))
    known = dictionary.select(F.col("word").alias("candidate"), "n")
    known = known.select("candidate", "n", F.explode(F.when(c <= LONG, deletions(F.col("candidate"), distance)).otherwise(pieces(F.col("candidate"), distance))).alias("key"))
    # Spark takes what deletions make of a dictionary for as small as the dictionary, and would broadcast it.
    found = keyed.join(known.hint("merge"), "key").select("word", "candidate", "n").distinct()
    return found.withColumn("edits", F.levenshtein("word", "candidate", distance)).filter(F.col("edits") >= 0)


def corrected(unknown: DataFrame, dictionary: DataFrame, distance: int = 2) -> DataFrame:
    """(word, correction) by fewest edits, then frequency, then order; words that the dictionary has, or without a candidate, stay as they are."""
    order = F.struct(-F.col("edits"), F.col("n"), F.transform(F.split("candidate", ""), lambda c: -F.ascii(c)))
    best = candidates(unknown, dictionary, distance).groupBy("word").agg(F.max_by("candidate", order).alias("correction"))
    return unknown.select("word").distinct().join(best, "word", "left").select("word", F.coalesce("correction", "word").alias("correction"))


def spellings(word: Column) -> Column:
    """The word with each confusion undone, one at a time; none that is the word itself."""
    out = F.array()
    for a, b in CONFUSED:
        out = F.concat(out.cast("array<string>"), F.array(F.replace(word, F.lit(a), F.lit(b)), F.replace(word, F.lit(b), F.lit(a))))
    return F.array_distinct(F.filter(out, lambda w: w != word))


def case_like(word: Column, model: Column) -> Column:
    """The word in the case of the model: upper, title or lower."""
    return F.when((F.upper(model) == model) & (F.lower(model) != model) & (F.char_length(model) > 1), F.upper(word)).when(F.substring(model, 1, 1).rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))).otherwise(word)
