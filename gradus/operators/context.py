"""Spelling by context: a corpus's word pairs, and the best path through the candidates of each sentence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradus.sources.scratch import written

from . import spelling

#: What the logarithm of a word's frequency, the context, and each edit weigh, and by what the logarithm is divided.
FREQUENCY, CONTEXT, EDIT, SCALE = 0.4, 0.6, 0.005, 12.0


def neighbours(texts: DataFrame, text: Column) -> DataFrame:
    """(left, right): each two words that stand next to each other in a line, in lower case."""
    words = F.regexp_extract_all(F.lower(F.col("line")), F.lit(r"([\p{L}']+)"), F.lit(1))
    lines = texts.select(F.explode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line")).select(words.alias("ws"))
    n = F.greatest(F.size("ws") - 1, F.lit(0))
    return lines.select(F.inline(F.arrays_zip(F.slice("ws", 1, n).alias("left"), F.slice("ws", 2, n).alias("right"))).alias("left", "right"))


def pairs_of(texts: DataFrame, text: Column) -> DataFrame:
    """(left, right, n): how often two words stand next to each other in a line, in lower case."""
    return neighbours(texts, text).groupBy("left", "right").agg(F.count("*").alias("n"))


#: Groups by hash that pairs of other words are counted in, and how many of the fullest are looked into first.
GROUPS, FULLEST = 65536, 64


def pairs_among(texts: DataFrame, text: Column, words: DataFrame) -> DataFrame:
    """(left, right, n): pairs_of() that are of these words alone, and a most frequent one of all where that is of others.

    words: (word). Most pairs of a large text are of other words and nearly each is distinct, so they are counted by groups, in the same pass. A group bounds the pairs in it: if none is fuller than the most frequent pair
    found, that is the most frequent of all; if some are, their pairs are counted too. With frequent words among those asked for, one pass is nearly always enough.
    """
    asked = written(words.select("word").distinct(), "asked")
    mark = lambda side: asked.select(F.col("word").alias(side), F.lit(True).alias(f"_{side}"))
    x = neighbours(texts, text).join(mark("left"), "left", "left").join(mark("right"), "right", "left")
    hit = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    x = x.select(F.when(hit, F.col("left")).alias("left"), F.when(hit, F.col("right")).alias("right"), F.when(~hit, F.struct("left", "right")).alias("other"))
    group = F.when(F.col("other").isNotNull(), F.pmod(F.xxhash64("other.left", "other.right"), F.lit(GROUPS)))
    counted = written(x.groupBy("left", "right", group.alias("group")).agg(F.count("*").alias("n")), "pairs")
    found, rest = counted.filter("group IS NULL").select("left", "right", "n"), counted.filter("group IS NOT NULL").select("group", "n")
    for fullest in (FULLEST, GROUPS):
        most = found.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        over = written(rest.filter(F.col("n") > most).orderBy(F.desc("n")).limit(fullest).select("group"), "groups")
        if over.isEmpty():
            break
        inside = x.select("other.*", group.alias("group")).join(F.broadcast(over), "group", "left_semi").groupBy("left", "right").agg(F.count("*").alias("n"))
        found = written(found.unionByName(inside.orderBy(F.desc("n")).limit(1)), "pairs")
        rest = rest.join(F.broadcast(over), "group", "left_anti")
    return found


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, changes and swaps of neighbours that make a of b, none edited twice; most + 1 where more are needed."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return min(last[-1], most + 1)


def near(unknown: DataFrame, dictionary: DataFrame, distance: int = 1) -> DataFrame:
    """(word, candidate, n, edits) of dictionary words within so many edits, a swap of neighbours being one.

    A swap is two edits of single letters, so words within twice the distance are met by their deletions, and then counted. Of a word's candidates all are kept.
    """

    @F.arrow_udf("int")
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([edits(x, y, distance) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())

    found = spelling.candidates(unknown, dictionary, 2 * distance).select("word", "candidate", "n")
    return found.withColumn("edits", count("word", "candidate")).filter(F.col("edits") <= distance)


def best_path(local: list[np.ndarray], joint: list[np.ndarray]) -> list[int]:
    """The choice at each place that makes the sum of local scores and of those of neighbours greatest; of equals the first choices, from the last place on."""
    total, back = local[0], []
    for now, pair in zip(local[1:], joint, strict=True):
        both = total[:, None] + pair
        back.append(both.argmax(axis=0))
        total = both.max(axis=0) + now
    choice = [int(total.argmax())]
    for b in reversed(back):
        choice.append(int(b[choice[-1]]))
    return choice[::-1]


def corrected(lines: DataFrame, dictionary: DataFrame, pairs: DataFrame | Callable[[DataFrame], DataFrame], keys: list[str], text: str = "text", distance: int = 1) -> DataFrame:
    """(keys, place, word, correction) of the words of each line that the dictionary lacks, corrected by frequency, context and distance together.

    lines: keys, distinct, and text; dictionary: (word, n); pairs: (left, right, n), or what gives them for the words (word) that may stand next to each other, as pairs_among() does. Words are letters with apostrophes in them, in lower case. Known words, single letters and words with an apostrophe stay, as do those without a
    candidate. A candidate scores FREQUENCY * ln(1 + n) / SCALE less EDIT an edit; two neighbours score CONTEXT / 2 * ln(1 + pairs) / ln(1 + the most frequent pair). Of all
    choices of a line the one of the greatest sum is taken, by dynamic programming, so neighbours that are both unknown help each other. Of equal choices the first in order is taken.

    Candidates, and the pairs of neighbouring candidates, come by joins, so nothing of the dictionary is broadcast. Lines are cut at runs of known words: only unknown words and one word on each side of them
    are put together, in stretches that end at known words; a stretch is a group, as long as unknown words follow each other. Null texts have no words.
    """
    ws = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}']+)"), F.lit(1))
    x = lines.select(*keys, F.posexplode(ws).alias("place", "word"))
    known = x.join(dictionary.select("word", F.lit(True).alias("known")), "word", "left").withColumn("fixed", F.col("known").isNotNull() | (F.char_length("word") < 2) | F.contains("word", F.lit("'")))
    by_line = Window.partitionBy(*keys).orderBy("place")
    y = known.withColumns({"before": F.lag("fixed").over(by_line), "after": F.lead("fixed").over(by_line), "stretch": F.count_if("fixed").over(by_line)})
    # A known word ends one stretch and begins the next, so it is in both where unknown words are on both sides.
    ends = F.filter(F.array(F.when(~F.col("fixed"), F.col("stretch")), F.when(F.col("fixed") & ~F.coalesce("after", F.lit(True)), F.col("stretch")), F.when(F.col("fixed") & ~F.coalesce("before", F.lit(True)), F.col("stretch") - 1)), lambda s: s.isNotNull())
    y = y.select(*keys, "place", "word", "fixed", F.explode(ends).alias("stretch"))
    options = near(y.filter("NOT fixed").select("word"), dictionary, distance)
    own = options.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("candidate", "n", "edits"))).alias("options"))
    alone = F.array(F.struct(F.col("word").alias("candidate"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("edits")))
    y = written(y.join(own, "word", "left").withColumn("options", F.when(F.col("fixed") | F.col("options").isNull(), alone).otherwise(F.col("options"))), "words")
    nxt = Window.partitionBy(*keys, "stretch").orderBy("place")
    met = y.withColumn("next", F.lead("options").over(nxt)).filter("next IS NOT NULL")
    met = met.select(*keys, "stretch", "place", F.posexplode(F.transform("options", lambda o: o["candidate"])).alias("_i", "left"), "next").select(*keys, "stretch", "place", "_i", "left", F.posexplode(F.transform("next", lambda o: o["candidate"])).alias("_j", "right"))
    if callable(pairs):
        pairs = pairs(y.select(F.explode("options.candidate").alias("word")))
    seen = met.join(pairs.withColumnRenamed("n", "times"), ["left", "right"]).groupBy(*keys, "stretch", "place").agg(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_j").alias("j"), "times")).alias("seen"))
    y = y.join(seen, [*keys, "stretch", "place"], "left").crossJoin(F.broadcast(pairs.agg(F.coalesce(F.max("n"), F.lit(1)).alias("most"))))
    row = F.struct("place", "word", "fixed", "options", "seen", "most")
    stretches = y.groupBy(*keys, "stretch").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, words, found = [], [], [], []
            for r, rows in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                local = [np.array([FREQUENCY * np.log1p(o["n"]) / SCALE - EDIT * o["edits"] for o in w["options"]]) for w in rows]
                joint = []
                for w, after in zip(rows, rows[1:], strict=False):
                    pair = np.zeros((len(w["options"]), len(after["options"])))
                    for s in w["seen"] or ():
                        pair[s["i"], s["j"]] = CONTEXT / 2 * np.log1p(s["times"]) / np.log1p(w["most"])
                    joint.append(pair)
                for w, k in zip(rows, best_path(local, joint), strict=True):
                    if not w["fixed"]:
                        at.append(r)
                        places.append(w["place"])
                        words.append(w["word"])
                        found.append(w["options"][k]["candidate"])
            left = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*left, pa.array(places, pa.int32()), pa.array(words, pa.string()), pa.array(found, pa.string())], [*keys, "place", "word", "correction"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.select(*keys).schema)
    return stretches.select(*keys, "rows").mapInArrow(run, f"{types}, place int, word string, correction string")
