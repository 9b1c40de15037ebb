"""Layers of scan correction: patterns of characters, words that only a dictionary can decide, spelling, sentence starts and punctuation.

Words are corrected as distinct words, by joins with the dictionary, and put back by their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.text import strip

from . import spelling

#: Digits that stand between letters, and the letters that they are.
DIGITS = {"0": "o", "1": "l", "5": "s"}
#: Letters that are read for one other, likeliest first.
LIGATURES = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("li", "h"), ("nn", "m")]
#: Letters that are taken for another, likeliest first.
SWAPS = [("l", "i"), ("l", "t"), ("i", "l"), ("t", "l"), ("o", "a"), ("a", "o"), ("n", "u"), ("u", "n"), ("e", "c"), ("c", "e"), ("h", "b"), ("b", "h"), ("s", "e"), ("r", "v"), ("v", "r"), ("d", "a"), ("g", "q"), ("f", "l"), ("l", "f"), ("w", "vv")]
#: Endings that are joined to the word before them; the second group only to words of two letters at least.
ENDINGS = ["tion", "ment", "ness", "ing", "ity", "able", "ible", "ous", "ally", "ence", "ance"]
SHORT_ENDINGS = ["ed", "er", "ly", "al"]
#: Kinds of swaps that are tried at several places of a word at once, and the most places.
SEVERAL, PLACES = 12, 4
#: Kinds of swaps that are tried after a ligature, and how frequent the word that they give must be.
AFTER_LIGATURE, FREQUENT = 8, 5


def letters_for_digits(text: Column) -> Column:
    for digit, letter in DIGITS.items():
        text = F.regexp_replace(text, f"(?<=[a-zA-Z]){digit}(?=[a-zA-Z])", letter)
    return text


def joined_endings(text: Column) -> Column:
    """Word endings that stand alone are joined to the word before them, whatever the case."""
    for ending in ENDINGS:
        text = F.regexp_replace(text, rf"(?iU)\b(\w+)\s({ending})\b", "$1$2")
    for ending in SHORT_ENDINGS:
        text = F.regexp_replace(text, rf"(?iU)\b(\w{{2,}})\s({ending})\b", "$1$2")
    return text


def sentence_starts(text: Column) -> Column:
    """A capital at the start of the text and after . ! ? and a space."""
    parts = F.split(text, r"(?<=[.!?]\s)(?=\S)")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def spaced_punctuation(text: Column) -> Column:
    """No space before a mark, one between a mark and a letter, and of a run of full stops, ! and ? the last alone."""
    text = F.regexp_replace(text, r"\s+([.,;:!?])", "$1")
    text = F.regexp_replace(text, r"([.,;:!?])([A-Za-z])", "$1 $2")
    return F.regexp_replace(text, r"([.!?]){2,}", "$1")


def _classes() -> tuple[str, str]:
    """Letters that are taken for each other, directly or by others, and the one that stands for them."""
    owner = {}
    for wrong, right in SWAPS:
        if len(wrong) == len(right) == 1:
            a, b = owner.setdefault(wrong, wrong), owner.setdefault(right, right)
            owner = {k: min(a, b) if v in (a, b) else v for k, v in owner.items()}
    return "".join(owner), "".join(owner.values())


def skeleton(word: Column) -> Column:
    """The word with each letter replaced by what stands for its class: equal for words that differ in swaps alone."""
    return F.translate(word, *_classes())


def swapped(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(token, core, word, n, kind, at): dictionary words that a token's core becomes when one kind of confusion is undone, at the places `at`; kind is its number in SWAPS.

    tokens: (token, core); dictionary: (word, n). Words that differ in swaps have one skeleton, so an equi-join finds all of them, whatever their length; then the letters are compared. What changes the length is tried at each of its places.
    """
    x = tokens.withColumn("low", F.lower("core")).filter(F.char_length("low") == F.char_length("core"))
    known = dictionary.select("word", "n")
    met = x.withColumn("key", skeleton(F.col("low"))).join(known.withColumn("key", skeleton(F.col("word"))), "key").filter((F.col("word") != F.col("low")) & (F.char_length("word") == F.char_length("low")))
    letters = lambda c: F.split(c, "")
    pairs = F.zip_with(letters("low"), letters("word"), lambda a, b: F.when(a != b, F.concat(a, F.lit(">"), b)))
    places = F.filter(F.transform(F.col("pairs"), lambda p, i: F.when(p.isNotNull(), i)), lambda i: i.isNotNull())
    kinds = F.array(*[F.lit(f"{a}>{b}") for a, b in SWAPS])
    met = met.withColumn("pairs", pairs).withColumn("own", F.array_distinct(F.filter("pairs", lambda p: p.isNotNull()))).filter(F.size("own") == 1)
    same = met.withColumn("kind", (F.array_position(kinds, F.get("own", 0)) - 1).cast("int")).filter("kind >= 0").select("token", "core", "word", "n", "kind", places.alias("at"))
    for kind, (a, b) in enumerate(SWAPS):
        if len(a) != len(b):
            where = F.filter(F.transform(letters("low"), lambda c, i: F.when(c == a, i)), lambda i: i.isNotNull())  # noqa: B023
            each = x.select("token", "core", "low", F.explode(where).alias("i")).withColumn("word", F.concat(F.substr("low", F.lit(1), F.col("i")), F.lit(b), F.substr("low", F.col("i") + 2)))
            same = same.unionByName(each.join(known, "word").select("token", "core", "word", "n", F.lit(kind).alias("kind"), F.array("i").alias("at")))
    return same


def in_case(core: Column, word: Column, at: Column) -> Column:
    """The core with the word's letters at these places, in the case of those that they replace."""
    more = F.char_length(word) - F.char_length(core)
    new = lambda c, i: F.substr(word, i + 1, more + 1)
    return F.array_join(F.transform(F.split(core, ""), lambda c, i: F.when(F.array_contains(at, i), F.when(F.upper(c) == c, F.upper(new(c, i))).otherwise(new(c, i))).otherwise(c)), "")


def _pick(found: DataFrame, order: Column) -> DataFrame:
    return found.groupBy("token").agg(F.max_by("new", order).alias("new"))


def ligatures_undone(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(token, new) of those tokens that become a dictionary word when a ligature is undone wherever it stands, or a frequent one when a confused letter is undone besides: the first ligature that does; of its words the most frequent."""
    bare = lambda w: F.lower(F.regexp_replace(w, "[^a-zA-Z]", ""))
    tries = F.array(*[F.struct(F.lit(-i).alias("rank"), F.regexp_replace("token", f"(?i){a}", b).alias("new")) for i, (a, b) in enumerate(LIGATURES)])
    unknown = tokens.select("token", bare(F.col("token")).alias("word")).filter(F.char_length("word") >= 3).join(dictionary, "word", "left_anti")
    trial = unknown.select("token", F.explode(tries).alias("t")).select("token", "t.*").filter(F.col("new") != F.col("token")).withColumn("word", bare(F.col("new")))
    whole = trial.join(dictionary, "word", "left")
    direct = whole.filter("n IS NOT NULL").select("token", "new", "rank", F.lit(1).alias("direct"), "n", F.lit(0).alias("before"))
    left = whole.filter("n IS NULL").select("token", "new", "rank", "word")
    more = swapped(left.select(F.col("word").alias("token"), F.col("word").alias("core")).distinct(), dictionary).filter((F.col("kind") < AFTER_LIGATURE) & (F.size("at") == 1) & (F.col("n") >= FREQUENT))
    more = more.select(F.col("token").alias("word"), F.col("word").alias("right"), "n", "kind", F.get("at", 0).alias("i"))
    # The i-th of the letters a-z of the token is replaced, in its case.
    letters = F.transform(F.split("new", ""), lambda c, i: F.struct(c.alias("c"), F.size(F.filter(F.slice(F.split("new", ""), 1, i), lambda x: x.rlike("[a-zA-Z]"))).alias("k")))
    put = F.array_join(F.transform(letters, lambda x: F.when(x["c"].rlike("[a-zA-Z]") & (x["k"] == F.col("i")), F.when(F.upper(x["c"]) == x["c"], F.upper(F.substr("right", F.col("i") + 1, F.lit(1)))).otherwise(F.substr("right", F.col("i") + 1, F.lit(1)))).otherwise(x["c"])), "")
    combined = left.join(more, "word").select("token", put.alias("new"), "rank", F.lit(0).alias("direct"), "n", (-F.col("kind") * 1000 - F.col("i")).alias("before"))
    return _pick(direct.unionByName(combined), F.struct("rank", "direct", "n", "before"))


def swaps_undone(tokens: DataFrame, dictionary: DataFrame, common: int) -> DataFrame:
    """(token, new) of tokens that become a dictionary word when confused letters are undone.

    Of words with one letter undone, the most frequent; without any, of those with several, the kind's most places first, then the most frequent. A token that the dictionary
    has changes only if it is rare (under `common`) and the new word, one letter away, is over three times as frequent. Of equally frequent words the first kind's, then that with the first places. Words may have any length.
    """
    parts = lambda g: F.regexp_extract("token", r"(?s)^(\P{L}*)(.*?)(\P{L}*)$", g)
    own = dictionary.select(F.col("word").alias("low"), F.col("n").alias("own"))
    x = tokens.select("token", parts(1).alias("head"), parts(2).alias("core"), parts(3).alias("tail")).filter(F.char_length("core") >= 2).withColumn("low", F.lower("core"))
    x = x.join(own, "low", "left").filter("own IS NULL OR own < %d" % common)
    met = swapped(x.select("token", "core"), dictionary).withColumn("places", F.size("at")).filter((F.col("places") == 1) | ((F.col("kind") < SEVERAL) & (F.col("places") <= PLACES)))
    order = F.struct("n", F.negative("kind"), F.transform("at", lambda i: -i))
    kinds = met.groupBy("token", (F.when(F.col("places") == 1, -1).otherwise(F.col("kind"))).alias("group"), "places").agg(F.max_by(F.struct("core", "word", "at", "n"), order).alias("b"))
    most = kinds.groupBy("token", "group").agg(F.max_by("b", "places").alias("b"))
    best = most.groupBy("token").agg(F.max_by(F.struct("b", "group"), F.struct(F.col("group") == -1, F.col("b.n"), -F.col("group"))).alias("x")).select("token", "x.b.*", "x.group")
    fair = F.col("own").isNull() | ((F.col("group") == -1) & (F.col("n") > F.col("own") * 3))
    found = best.join(x.select("token", "head", "tail", "own"), "token").filter(fair)
    return found.select("token", F.concat("head", in_case(F.col("core"), F.col("word"), F.col("at")), "tail").alias("new"))


def spelled(tokens: DataFrame, dictionary: DataFrame, distance: int = 2) -> DataFrame:
    """(token, new) of tokens of letters alone (marks around them stay) that the dictionary lacks: its nearest word, in the token's case. Words in capitals stay."""
    parts = lambda g: F.regexp_extract("token", r"(?s)^([^a-zA-Z]*)([a-zA-Z]{2,})([^a-zA-Z]*)$", g)
    x = tokens.select("token", parts(1).alias("head"), parts(2).alias("core"), parts(3).alias("tail")).filter((F.col("core") != "") & (F.upper("core") != F.col("core"))).withColumn("word", F.lower("core"))
    x = x.join(dictionary.select("word"), "word", "left_anti")
    right = spelling.corrected(x.select("word"), dictionary, distance).filter("correction <> word")
    return x.join(right, "word").select("token", F.concat("head", spelling.case_like(F.col("correction"), F.col("core")), "tail").alias("new"))


def _then(known: DataFrame, step: DataFrame) -> DataFrame:
    """(token, now) after one more step over the distinct words."""
    return known.join(step.select(F.col("token").alias("now"), "new"), "now", "left").select("token", F.coalesce("new", "now").alias("now"))


def _changed(a: Column, b: Column) -> Column:
    own = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1)))
    return F.size(F.array_except(own(a), own(b))) + F.size(F.array_except(own(b), own(a)))


def corrected(texts: DataFrame, dictionary: DataFrame, id_col: str, text_col: str = "text", common: int = 5, spelling_too: bool = True) -> DataFrame:
    """(id, text, corrected, layers, corrections): texts with all layers applied, which of them changed it, and how many distinct words differ.

    dictionary: (word, n), distinct words in lower case. Layers: patterns (digits, ligatures, confused letters, endings, sentence starts, punctuation), then spelling. Ids are
    distinct. White space becomes single spaces; null and blank texts come back as empty ones, with no layer. Each distinct word is decided once, however often it occurs.
    """
    x = texts.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("first", strip(letters_for_digits(F.col("text"))))
    placed = x.select("id", F.posexplode(F.split("first", r"\s+")).alias("place", "token")).filter("token <> ''")
    tokens = placed.select("token").distinct()
    known = _then(tokens.select("token", F.col("token").alias("now")), ligatures_undone(tokens, dictionary))
    known = _then(known, swaps_undone(known.select(F.col("now").alias("token")).distinct(), dictionary, common))
    after = known.withColumn("fixed", F.col("now"))
    if spelling_too:
        after = after.join(spelled(known.select(F.col("now").alias("token")).distinct(), dictionary).select(F.col("token").alias("now"), "new"), "now", "left").withColumn("fixed", F.coalesce("new", "now"))
    words = placed.join(after.select("token", "now", "fixed"), "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "now", "fixed"))).alias("ws"))
    put = lambda name: spaced_punctuation(sentence_starts(joined_endings(F.array_join(F.transform("ws", lambda w: w[name]), " "))))
    both = x.join(words, "id", "left").select("id", "text", F.coalesce(put("now"), F.lit("")).alias("patterns"), F.coalesce(put("fixed"), F.lit("")).alias("corrected"))
    named = F.array_compact(F.array(F.when(F.col("patterns") != strip(F.col("text")), "patterns"), F.when(F.col("corrected") != F.col("patterns"), "spelling")))
    return both.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "corrected", named.alias("layers"), _changed(F.col("text"), F.col("corrected")).alias("corrections"))
