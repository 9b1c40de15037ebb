"""Agreement of two orders within keys in n log n: inversions are counted in blocks, and between blocks from their counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.sources.scratch import written


def greater_before(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row how many rows before it in its group have a greater value. Rows of a group stand together.

    Values become ranks, compared bit by bit from the highest: among rows whose higher bits are equal, those with a 1 that stand before one with a 0 are greater. Each bit takes one stable sort of
    rows that are nearly sorted.
    """
    n = len(values)
    found = np.zeros(n, np.int64)
    if not n:
        return found
    starts = np.append(0, np.flatnonzero(groups[1:] != groups[:-1]) + 1)
    number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    order = np.lexsort((values, number))
    new = np.append(False, (number[order][1:] != number[order][:-1]) | (values[order][1:] != values[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    rows = np.arange(n)
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        own = rank[rows]
        one = (own >> bit) & 1
        high = own >> (bit + 1)
        begin = np.maximum.accumulate(np.where(np.append(True, high[1:] != high[:-1]), np.arange(n), 0))
        before = np.cumsum(one) - one
        zero = one == 0
        found[rows[zero]] += (before - before[begin])[zero]
        rows = rows[np.argsort(own >> bit, kind="stable")]
    return found


def local(rows: DataFrame, groups: list[str]) -> DataFrame:
    """(_key, n): inversions within each group (of _key and others), a row for each group. A task takes its groups in order, batch by batch, and holds one group and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def counted(table: pa.Table) -> pa.RecordBatch:
            ids = table["_group"].to_numpy()
            n = greater_before(ids, table["_value"].to_numpy())
            starts = np.append(0, np.flatnonzero(ids[1:] != ids[:-1]) + 1)
            return pa.RecordBatch.from_arrays([table["_key"].take(pa.array(starts)).combine_chunks(), pa.array(np.add.reduceat(n, starts))], ["_key", "n"])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            ids = table["_group"].to_numpy()
            last = int(np.searchsorted(ids != ids[-1], False)) if ids[0] == ids[-1] else len(ids) - int((ids == ids[-1])[::-1].argmin())
            if last:
                yield counted(table.slice(0, last))
            held = table.slice(last)
        if held is not None and held.num_rows:
            yield counted(held)

    keyed = rows.select(F.xxhash64(*groups).alias("_hash"), F.struct(*groups).alias("_id"), "_key", "_order", "_value")
    dealt = keyed.repartition("_hash").sortWithinPartitions("_hash", "_id", "_order", "_value")
    # Groups are numbered by their hash; of two groups of one hash the second begins where the key or the block changes.
    numbered = dealt.select(F.xxhash64("_id", "_hash").alias("_group"), "_key", "_value")
    key = rows.schema["_key"].dataType.simpleString()
    return numbered.mapInArrow(run, f"_key {key}, n long")


def across(cells: DataFrame) -> DataFrame:
    """(_key, n): pairs of rows whose first comes from an earlier block and a later bucket, from the counts (_key, _b, _v, n) of cells. A key has as many cells as blocks by buckets at most."""

    def run(table: pa.Table) -> pa.Table:
        b, b_at = np.unique(table["_b"].to_numpy(), return_inverse=True)
        v, v_at = np.unique(table["_v"].to_numpy(), return_inverse=True)
        m = np.zeros((len(b), len(v)), np.int64)
        m[b_at, v_at] = table["n"].to_numpy()
        later = np.cumsum(m[:, ::-1], axis=1)[:, ::-1] - m  # of the same block, in later buckets
        above = np.cumsum(later, axis=0) - later
        return pa.table({"_key": table["_key"].slice(0, 1), "n": pa.array([int((above * m).sum())])})

    key = cells.schema["_key"].dataType.simpleString()
    return cells.groupBy("_key").applyInArrow(run, f"_key {key}, n long")


def order_scores(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, n, score): agreement, from 0 to 1, of a numeric value's order with `order` within each key: pairs that rise count 1, those that fall 0, equal ones a half; 1 where no two rows differ in order.

    Pairs of equal orders count for nothing; rows with a null key, order or value take no part. Rows are laid out by key and order; a key within one range is counted there. A key of several ranges
    is split twice, into blocks by order and buckets by value: falling pairs are those within blocks and those within buckets, less those within both, and those across, which the counts of the
    cells give. So no task gets more of a key than a block or a bucket (equal values stay in one bucket).
    """
    rows = df.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col(value).alias("_value")).filter("_key IS NOT NULL AND _order IS NOT NULL AND _value IS NOT NULL")
    rows = rows.withColumn("_value", F.col("_value").cast("double")) if dict(rows.dtypes)["_value"] not in ("int", "bigint", "smallint", "tinyint", "double", "float") else rows
    laid = written(rows.repartitionByRange("_key", "_order", "_value").withColumn("_b", F.spark_partition_id()), "laid")
    spans = laid.groupBy("_key").agg(F.min("_b").alias("low"), F.max("_b").alias("high"), F.count("*").alias("n"))
    wide = written(spans.filter("low < high").select("_key"), "wide")  # fewer than ranges
    cold = local(laid.join(F.broadcast(wide), "_key", "left_anti"), ["_key"])
    hot = laid.join(F.broadcast(wide), "_key", "left_semi").repartitionByRange("_key", "_value").withColumn("_v", F.spark_partition_id())
    hot = written(hot, "hot")
    cells = hot.groupBy("_key", "_b", "_v").agg(F.count("*").alias("n"))
    falling = cold.unionByName(local(hot, ["_key", "_b"])).unionByName(local(hot, ["_key", "_v"])).unionByName(local(hot, ["_key", "_b", "_v"]).withColumn("n", -F.col("n"))).unionByName(across(cells))
    fall = falling.groupBy("_key").agg(F.sum("n").alias("fall"))
    # Pairs of equal orders count for nothing; among them values ascend, so none of them falls.
    choose = lambda m: F.col(m) * (F.col(m) - 1) / 2
    both = laid.groupBy("_key", "_order", "_value").agg(F.count("*").alias("m"))
    tied = lambda c: both.groupBy("_key", c).agg(F.sum("m").alias("m")).groupBy("_key").agg(F.sum(choose("m")).alias(c))
    equal = both.groupBy("_key").agg(F.sum(choose("m")).alias("both"))
    x = spans.join(fall, "_key").join(tied("_order"), "_key").join(tied("_value"), "_key").join(equal, "_key").withColumn("pairs", choose("n") - F.col("_order"))
    score = F.when(F.col("pairs") == 0, 1.0).otherwise((F.col("pairs") - F.col("fall") - (F.col("_value") - F.col("both")) / 2) / F.col("pairs"))
    return x.select(F.col("_key").alias(key), "n", score.alias("score"))
