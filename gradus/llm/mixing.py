"""Mixing sources to target weights by temperature, realised as budgeted permutations of blocks."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Scratch, fresh

#: Rows of a plan up to which it is broadcast (40 bytes a row); beyond it, the join shuffles.
BROADCAST_ROWS = 100_000
#: Sources whose totals the driver gets to weigh; those of more stay in their table, and each step of the bisection is one aggregation there.
WEIGHED = 100_000


@dataclass(frozen=True)
class Mix:
    """budget: tokens of the mixture, None: as many as there are. One target: an entropy of the weights (nats), or the
    passes over a source that may not be exceeded. blocks: of each source; a source's last block is cut by document."""

    budget: int | None = None
    entropy: float | None = None
    max_repeats: float | None = 1.25
    blocks: int = 1024
    seed: int = 0


def weights_at(shares: list[float], exponent: float) -> list[float]:
    """share ** exponent, normalised; a source without tokens has no weight."""
    raised = [math.exp(exponent * math.log(s)) if s > 0 else 0.0 for s in shares]
    total = math.fsum(raised)
    return [x / total if total else 0.0 for x in raised]


#: Of share ** exponent over the sources with tokens: the sum, the sum of its product with its logarithm, and the greatest of share ** (exponent - 1).
Sums = Callable[[float], tuple[float, float, float]]


def sums_of(shares: list[float]) -> Sums:
    logs = [math.log(s) for s in shares if s > 0]

    def at(exponent: float) -> tuple[float, float, float]:
        raised = [math.exp(exponent * x) for x in logs]
        return math.fsum(raised), math.fsum(r * exponent * x for r, x in zip(raised, logs, strict=True)), max((math.exp((exponent - 1) * x) for x in logs), default=0.0)

    return at


def sums_in(totals: DataFrame, everything: int) -> Sums:
    """sums_of() the shares of a table (tokens), by one aggregation each time."""
    log = F.log(F.col("tokens") / F.lit(everything))

    def at(exponent: float) -> tuple[float, float, float]:
        raised = F.exp(exponent * log)
        return tuple(totals.filter("tokens > 0").agg(F.sum(raised), F.sum(raised * exponent * log), F.max(F.exp((exponent - 1) * log))).first())

    return at


def solve_exponent(shares: list[float] | Sums, mix: Mix, budget_share: float = 1.0) -> float:
    """The exponent, by bisection. With a repetition limit: the smallest in [0, 1] that keeps every source within it (1 if none does).
    With an entropy: the one in [0, 64] that comes to it (entropy falls as the exponent grows); an end of the range if none does."""
    sums = shares if callable(shares) else sums_of(shares)
    if not sums(1.0)[0] or (mix.entropy is None and mix.max_repeats is None):
        return 1.0

    def short(exponent: float) -> bool:
        total, logs, most = sums(exponent)
        if mix.entropy is not None:
            return math.log(total) - logs / total > mix.entropy
        return most * budget_share / total > mix.max_repeats

    low, high = 0.0, 64.0 if mix.entropy is not None else 1.0
    if not short(low):
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if short(middle) else (low, middle)
    return high


def _keyed(docs: DataFrame, mix: Mix, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, list[str]]:
    """docs with the source's key, the row's order in it and its block, and the names of these columns."""
    names = [fresh(docs, n) for n in ("_source", "_order", "_block")]
    order = F.xxhash64(F.lit(mix.seed), F.col(id_col), F.col(text_col))
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))
    return docs.withColumns(dict(zip(names, [source, order, F.pmod(order, F.lit(mix.blocks)).cast("int")], strict=True))), names


def plan(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each source and block: (_source, _block, weight, exponent, whole, cutoff, block_key).

    A source is drawn `whole` times; then its blocks follow in a permutation of their own until the budget is reached: those
    before that count once more in `whole`, and of the block in which it is reached, the rows whose order is up to `cutoff`.
    """
    scratch = Scratch(docs.sparkSession)
    keyed, names = _keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")), mix, "doc_id", "text", "source")
    tokens = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    rows = scratch.written(keyed.select(*names, tokens.alias("tokens")), "mix-rows")
    blocks = scratch.written(rows.groupBy("_source", "_block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    totals = scratch.written(blocks.groupBy("_source").agg(F.sum("tokens").alias("tokens")), "mix-totals")
    n_sources, everything = totals.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    budget = everything if mix.budget is None else mix.budget
    weighed = [r["tokens"] / max(1, everything) for r in totals.orderBy("_source").collect()] if n_sources <= WEIGHED else None
    sums = sums_in(totals, max(1, everything)) if weighed is None else sums_of(weighed)
    exponent = solve_exponent(sums, mix, budget / everything if everything else 1.0)
    below = (sums(exponent)[0] if everything else 0) or 1.0
    weight = F.when(F.col("tokens") > 0, F.exp(F.lit(exponent) * F.log(F.col("tokens") / F.lit(max(1, everything)))) / F.lit(below)).otherwise(0.0)
    passes = F.coalesce(F.floor(F.try_divide(F.col("quota"), "tokens")), F.lit(0)).cast("int")
    quota = totals.withColumn("weight", weight).withColumn("quota", F.col("weight") * F.lit(float(budget))).withColumn("passes", passes)
    quota = quota.select("_source", "weight", F.lit(exponent).alias("exponent"), "passes", (F.col("quota") - F.col("passes") * F.col("tokens")).alias("rest"))
    seeded = F.xxhash64(F.lit(mix.seed), F.lit("block"), F.col("_block"), F.col("passes"))
    by_source = Window.partitionBy("_source").orderBy("block_key", "_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = blocks.join(quota, "_source").withColumn("block_key", seeded).withColumn("upto", F.sum("tokens").over(by_source))
    laid = scratch.written(laid.withColumn("before", F.col("upto") - F.col("tokens")), "mix-laid")
    cut = laid.filter("upto > rest AND before < rest").select("_source", "_block", (F.col("rest") - F.col("before")).alias("room"))
    in_block = Window.partitionBy("_source", "_block").orderBy("_order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        rows.join(F.broadcast(cut) if n_sources <= BROADCAST_ROWS else cut, ["_source", "_block"])
        .withColumn("upto", F.sum("tokens").over(in_block))
        .filter("upto <= room")
        .groupBy("_source", "_block")
        .agg(F.max("_order").alias("cutoff"))
    )
    once_more = (F.col("upto") <= F.col("rest")).cast("int")
    made = laid.join(last, ["_source", "_block"], "left").select("_source", "_block", "weight", "exponent", (F.col("passes") + once_more).alias("whole"), "cutoff", "block_key")
    made = scratch.written(made, "mix-plan")
    scratch.close(made)
    return made


def mixed(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The drawn rows, with all their columns and epoch, weight, exponent, block_key, row_key as _mix (a struct).

    A row that is drawn k times comes k times, with epochs from 0; sorted by (epoch, block_key, row_key) of _mix, the
    sources' blocks are permuted anew. Token shares are words of the text (null: none). A null source is a source of its
    own; one without tokens has weight 0 and isn't drawn. Repeated rows with one id and text are drawn together. Within the
    budget, a source may fall short by less than one document. Texts of any length count whole. An empty table gives an empty one. A column _mix of the table's own is
    replaced; other columns, of any name, are kept.
    """
    mix = mix or Mix()
    laid = plan(docs, mix, id_col, text_col, source_col)
    if laid.count() <= BROADCAST_ROWS:
        laid = F.broadcast(laid)
    keyed, names = _keyed(docs, mix, id_col, text_col, source_col)
    own = [fresh(keyed, f"_plan{i}") for i in range(7)]
    source, block, weight, exponent, whole, cutoff, block_key = own
    laid = laid.toDF(*own)
    copies = F.coalesce(F.col(whole) + (F.col(names[1]) <= F.col(cutoff)).cast("int"), F.col(whole))
    drawn = keyed.join(laid, (F.col(names[0]) == F.col(source)) & (F.col(names[2]) == F.col(block))).filter(copies > 0)
    epoch = fresh(drawn, "_epoch")
    drawn = drawn.withColumn(epoch, F.explode(F.sequence(F.lit(0), copies - 1)))
    keys = F.struct(
        F.col(epoch).alias("epoch"),
        F.col(weight).alias("weight"),
        F.col(exponent).alias("exponent"),
        F.xxhash64(block_key, epoch).alias("block_key"),
        F.xxhash64(names[1], epoch).alias("row_key"),
    )
    return drawn.select(*[f"`{c}`" for c in docs.columns if c != "_mix"], keys.alias("_mix"))
