"""Document fingerprints from Lempel-Ziv phrases, and neighbours in the order of ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: hashes that a fingerprint keeps.
KEPT = 128


def parse(text: str, start: int, seen: dict[str, None], limit: int) -> int:
    """Adds the LZ78 phrases from start on that end at limit at most, and says where the next one begins: each is the longest phrase known so far and one character more.

    With a phrase its beginnings are known too, so the search for the longest may begin in the middle, at three characters.
    """
    i, n = start, len(text)
    while i < limit:
        found = text[i : i + 3]
        if found in seen:
            j = i + 4
            found = text[i:j]
            while found in seen and j < n:
                j += 1
                found = text[i:j]
        elif (two := text[i : i + 2]) not in seen:
            found = two if (one := text[i]) in seen else one
        j = i + len(found)
        if j > limit:
            break
        seen[found] = None
        i = j
    return i


def hashes(phrases: list[str]) -> np.ndarray:
    return (pd.util.hash_array(np.array(phrases, dtype=object), categorize=False) >> np.uint64(32)).astype(np.uint32) if phrases else np.zeros(0, np.uint32)


def lowest(values: np.ndarray) -> np.ndarray:
    """The signature: the smallest distinct hashes, in order."""
    if len(values) > 2 * KEPT:
        values = np.partition(values, 2 * KEPT - 1)[: 2 * KEPT]
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])][:KEPT] if len(values) else values


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of common phrases among all of two phrase sets: that among the smallest hashes of both. Two empty ones are alike."""
    both = np.sort(np.concatenate([a, b]))
    if not len(both):
        return 1.0
    twice = both[1:] == both[:-1]
    place = np.arange(2, len(both) + 1) - np.cumsum(twice)  # of the distinct hashes, from 1; the first one is left out
    return int(np.count_nonzero(twice & (place <= KEPT))) / min(KEPT, len(both) - int(np.count_nonzero(twice)))


class Parsed:
    """A text's phrases in the order in which they were found, and their hashes."""

    def __init__(self, text: str):
        seen: dict[str, None] = {}
        self.keep = len(text) - len(text) // 2
        self.next = parse(text, 0, seen, self.keep)
        self.same = len(seen)
        parse(text, self.next, seen, len(text))
        self.text, self.phrases = text, list(seen)
        self.hashes = hashes(self.phrases)
        self.signature = lowest(self.hashes)

    def edited(self, other: str) -> tuple[str, np.ndarray]:
        """The text with its last floor(n / 2) characters replaced by the first as many of the other, and its signature. Phrases that end before the edit are the same."""
        text = self.text[: self.keep] + other[: len(self.text) - self.keep]
        seen = dict.fromkeys(self.phrases[: self.same])
        parse(text, self.next, seen, len(text))
        return text, lowest(np.concatenate([self.hashes[: self.same], hashes(list(seen)[self.same :])]))


def printed(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, extra) in order; each is compared with the next one, and extra rows are there for that alone."""
    held: tuple[int | None, Parsed] | None = None
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text, extra in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if extra and held is None:
                continue
            now = Parsed(text or "")
            if held is not None:
                own_id, own = held
                edited, signature = own.edited(now.text)
                out.append((own_id, len(own.text), hashlib.sha256(edited.encode()).hexdigest(), printed(own.signature), printed(signature), likeness(own.signature, signature), likeness(own.signature, now.signature)))
            held = None if extra else (doc_id, now)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ARROW, strict=True)], schema=ARROW)


#: Characters of a range at most, on average.
RANGE_CHARS = 1 << 30


def cuts_of(rows: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids at which ranges begin, ascending; how many ranges each of these ids itself fills (0: it shares one); how many the null ids fill."""
    total, known = rows.agg(F.count("*"), F.count("doc_id")).first()
    points = rows.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    cuts, times = np.unique(np.clip(np.array(points, np.float64), -(2.0**63), 2.0**63 - 1024).astype(np.int64), return_counts=True)
    return cuts, np.where(times > 1, times, 0), max(1, -(-(total - known) * ranges // max(1, total)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are to each other and to the next document's.

    A text (null: empty) is parsed into LZ78 phrases; its fingerprint holds the smallest 32-bit hashes of the phrase set, in hex. The next
    document follows in descending id (a null id comes last, equal ids by a hash of the text and then the text), after the last comes the first; one document is its own next. The
    edited text has the last floor(n / 2) of its n code points replaced by the first as many (or all) of the next document's.

    Ids are cut into ranges of about as many rows, and a range's tasks get one row more: the first of the range that follows. An id, or null, with more rows than a
    range is cut by the texts' hashes; only rows alike in id and text stay together. There are as many ranges as shuffle partitions, or as the texts' characters need. The driver
    holds the cuts and the first id of each range. A text of any length is parsed whole, in one task, two texts at a time. Other columns are ignored; an empty table gives an empty one.

    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if ranges is None:
        chars = rows.agg(F.sum(F.char_length("text").cast("long"))).first()[0] or 0
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // RANGE_CHARS)
    cuts, own, nulls = cuts_of(rows, ranges)
    # In descending order: ids above a cut's, the cut's own where it fills ranges, and so on; null ids last.
    begin = np.concatenate([[0], np.cumsum(1 + own[::-1])])
    last = int(begin[-1]) + 1

    @F.arrow_udf("int")
    def range_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        part = (hashes.to_numpy(zero_copy_only=False).astype(np.int64) >> 32) + (1 << 31)
        out = last + (part * nulls >> 32)
        value = ids.drop_null().to_numpy().astype(np.int64)
        place = np.searchsorted(cuts, value, side="right")
        at = begin[len(cuts) - place]
        if len(cuts):
            cut = np.maximum(place - 1, 0)
            inside = (place > 0) & (cuts[cut] == value) & (own[cut] > 0)
            at = at + np.where(inside, 1 + (part[known] * own[cut] >> 32), 0)
        out[known] = at
        return pa.array(out.astype(np.int32))

    order = [F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("id"), F.col("h").alias("h")]
    placed = rows.withColumn("h", F.xxhash64("text")).withColumn("range", range_of("doc_id", "h"))
    firsts = sorted((r["range"], r["first"]) for r in placed.groupBy("range").agg(F.min(F.struct(*order)).alias("first")).collect())
    after = [(firsts[(i + 1) % len(firsts)][1], r) for i, (r, _) in enumerate(firsts)]
    extra = spark.createDataFrame([(None if f["none"] else ~f["id"], f["h"], r) for f, r in after], "first long, first_h long, range int")
    met = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(extra), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("h") == F.col("first_h")))
    more = met.groupBy("range").agg(F.min(F.struct("doc_id", F.col("text").isNotNull(), "text", "h")).alias("row")).select("row.doc_id", "row.text", "row.h", "range", F.lit(True).alias("extra"))
    both = placed.withColumn("extra", F.lit(False)).unionByName(more)
    laid = both.repartitionById(last + nulls, F.col("range")).sortWithinPartitions("extra", F.col("doc_id").desc_nulls_last(), "h", F.col("text").asc_nulls_first())
    return laid.select("doc_id", "text", "extra").mapInArrow(compared, SCHEMA).withColumnRenamed("doc_id", id_col)
