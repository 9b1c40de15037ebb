"""Concept graphs as relations: nodes and edges of the statements of texts, and a model's graph matched against an answer's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.text import strip

from .alignment import VERBS
from .set_join import overlap_join

#: Importance of a node that no concept of the text has; scores from which a node, or the end of an edge, counts as covered or as partial.
ORDINARY, COVERED, PARTIAL = 0.5, 0.55, 0.35
_WORD = r"[\p{L}\p{N}_]"


def clause(verb: str) -> str:
    """The pattern of a subject, this verb and an object, for both groups: 3 to 31 letters, digits and spaces each."""
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])({_WORD}[\p{{L}}\p{{N}}_\s]{{2,30}}?)\s+{verb}\s+({_WORD}[\p{{L}}\p{{N}}_\s]{{2,30}}?)(?:[,;]|$)"


def statements(texts: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, source, predicate, target) of each clause with one of the verbs, in lower case, trimmed, each once a text.

    Sentences of ten characters at least are rows, and meet only the patterns of verbs that they have.
    """
    cut = F.transform(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), strip)
    rows = texts.select(*keys, F.explode(F.array_distinct(F.filter(cut, lambda s: F.char_length(s) >= 10))).alias("s"))
    verbs = F.array_intersect(F.split(F.lower("s"), r"\s+"), F.array(*[F.lit(v) for v in VERBS]))
    rows = rows.select(*keys, "s", F.explode(verbs).alias("predicate"))
    before, after = clause("\0").split("\0")
    pattern = F.concat(F.lit(before), "predicate", F.lit(after))  # compiled anew only where the verb changes
    rows = rows.withColumns({f"_{group}": F.regexp_extract_all("s", pattern, F.lit(group)) for group in (1, 2)})
    found = rows.select(*keys, "predicate", F.explode(F.arrays_zip("_1", "_2")).alias("p"))
    return found.select(*keys, F.lower(strip(F.col("p._1"))).alias("source"), "predicate", F.lower(strip(F.col("p._2"))).alias("target")).distinct()


def graph(concepts: DataFrame, stated: DataFrame, keys: list[str], concept: str = "concept", importance: str = "importance") -> tuple[DataFrame, DataFrame]:
    """Nodes (keys, node, importance, statements) and edges (keys, source, predicate, target) of concepts and statements.

    A node is a label in lower case, trimmed; concepts and the ends of statements that are equal so are one. Its importance is the greatest that a concept of the label has, else ORDINARY; statements
    are those that it is the source of.
    """
    label = lambda c: F.lower(strip(F.col(c)))
    edges = stated.select(*keys, label("source").alias("source"), "predicate", label("target").alias("target")).distinct()
    ends = edges.select(*keys, F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("own")), F.struct(F.col("target").alias("node"), F.lit(0).alias("own")))).alias("e")).select(*keys, "e.node", F.lit(None).cast("double").alias("importance"), "e.own")
    rows = concepts.select(*keys, label(concept).alias("node"), F.col(importance).cast("double").alias("importance"), F.lit(0).alias("own")).unionByName(ends)
    nodes = rows.groupBy(*keys, "node").agg(F.coalesce(F.max("importance"), F.lit(ORDINARY)).alias("importance"), F.sum("own").alias("statements"))
    return nodes, edges


def matched(nodes: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, other, score): nodes of two graphs that have words in common, by the share of the smaller label's words, from PARTIAL up."""
    words = lambda df, name: df.select(*keys, F.col("node").alias(name), F.split("node", r"\s+").alias("words"))
    return overlap_join(words(nodes, "node"), words(other, "other"), keys, "node", "other", "words", PARTIAL).select(*keys, "node", "other", F.col("similarity").alias("score"))


def covered_graph(model: tuple[DataFrame, DataFrame], answer: tuple[DataFrame, DataFrame], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The model's nodes with score, the best match among the answer's; and its edges with score, the lower one of their ends, and stated: whether the answer has an edge of that predicate between nodes that match both ends from COVERED up."""
    pairs = matched(model[0], answer[0], keys)
    best = pairs.groupBy(*keys, "node").agg(F.max("score").alias("score"))
    nodes = model[0].join(best, [*keys, "node"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    end = lambda name: nodes.select(*keys, F.col("node").alias(name), F.col("score").alias("_" + name), F.col("importance").alias(name + "_importance"))
    edges = model[1].join(end("source"), [*keys, "source"]).join(end("target"), [*keys, "target"]).withColumn("score", F.least("_source", "_target")).drop("_source", "_target")
    near = pairs.filter(F.col("score") >= COVERED)
    side = lambda a, b: near.select(*keys, F.col("node").alias(a), F.col("other").alias(b))
    # The answer's edges are carried to the model's nodes, whose own edges then meet them by equality.
    carried = answer[1].select(*keys, F.col("source").alias("_s"), "predicate", F.col("target").alias("_t")).join(side("source", "_s"), [*keys, "_s"]).join(side("target", "_t"), [*keys, "_t"])
    stated = carried.select(*keys, "source", "predicate", "target").distinct().withColumn("stated", F.lit(True))
    return nodes, edges.join(stated, [*keys, "source", "predicate", "target"], "left").withColumn("stated", F.coalesce("stated", F.lit(False)))


def summary(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, nodes, covered, partial, missing, covered_importance, edges, covered_edges, stated_edges)."""
    s = F.col("score")
    of_nodes = nodes.groupBy(*keys).agg(F.count("*").alias("nodes"), F.count_if(s >= COVERED).alias("covered"), F.count_if((s >= PARTIAL) & (s < COVERED)).alias("partial"), F.count_if(s < PARTIAL).alias("missing"), F.sum(F.col("importance") * s).alias("covered_importance"))
    of_edges = edges.groupBy(*keys).agg(F.count("*").alias("edges"), F.count_if(s >= COVERED).alias("covered_edges"), F.count_if("stated").alias("stated_edges"))
    counts = ["edges", "covered_edges", "stated_edges"]
    return of_nodes.join(of_edges, keys, "left").select(*of_nodes.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
