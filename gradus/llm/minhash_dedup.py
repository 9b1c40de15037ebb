"""Near-duplicate detection: SuperMinHash signatures, banding, verification and union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pieces

#: Registers of a signature and the bands of consecutive registers made of it.
REGISTERS, ROWS = 120, 4
BANDS = REGISTERS // ROWS
#: Two bits a register make a sketch of four 64-bit integers. Pairs whose sketches estimate a likeness this far below the threshold are not
#: compared in full: four and a half standard deviations of the estimate at 0.75, so one such link in 290,000 is lost.
SLACK = 0.215
LOW_BITS = 0x5555555555555555
SKETCH = ["k0", "k1", "k2", "k3"]
#: Documents of a block, and shingles that are counted at once, when groups that meet in a bucket are compared.
BLOCK, COLUMNS = 256, 4096
#: A cluster of more blocks is compared bucket by bucket; members of a bucket that one task compares with all of it by their sketches.
WHOLE, SHARE = 8, 4096
CHARS = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64, on 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the number of words of each text. Bytes' lower() and split() know A-Z and [\\x20\\x09-\\x0D] only."""
    words = [(t or "").encode().lower().split() for t in texts]
    flat = np.array([w for ws in words for w in ws], dtype=object)
    return (pd.util.hash_array(flat, categorize=True) if len(flat) else np.zeros(0, np.uint64)), np.array([len(ws) for ws in words], dtype=np.int64)


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and the number of each text."""
    words, counts = word_hashes(texts)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    starts = np.cumsum(counts) - counts
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[doc]
    long = np.minimum(counts[doc], width)
    out = mix(long.astype(np.uint64))
    for k in range(width):
        use = k < long
        out[use] = mix(out[use] * np.uint64(0x9E3779B97F4A7C15) + words[at[use] + k])
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    first = np.ones(len(out), bool)
    first[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[first], np.bincount(doc[first], minlength=len(texts))


def superminhash(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One signature a set, as (level << 24 | random 24 bits).

    Each element permutes the registers by its own random swaps. The swaps are made level by level for all elements together;
    in a level every value is larger than in the one before, so a set whose registers are all filled stops there.
    """
    sets = len(sizes)
    empty = np.uint32(0xFFFFFFFF)
    out = np.full(sets * REGISTERS, empty, np.uint32)
    owner = np.repeat(np.arange(sets), sizes)
    seed = elements
    swap = np.empty((0, 0), np.uint8)
    for level in range(REGISTERS):
        if not len(owner):
            break
        draw = mix(seed + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = (draw >> np.uint64(40)).astype(np.uint32) | np.uint32(level << 24)
        k = level + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(REGISTERS - level)) >> np.uint64(32)).astype(np.int64)
        if level == 0:
            register = k
        else:
            rows = np.arange(len(owner))
            register = swap[rows, k].astype(np.int64)
            swap[rows, k] = swap[rows, level]
        np.minimum.at(out, owner * REGISTERS + register, value)
        full = (out.reshape(sets, REGISTERS) != empty).all(axis=1)
        left = ~full[owner]
        if level == 0:
            owner, seed = owner[left], seed[left]
            swap = np.tile(np.arange(REGISTERS, dtype=np.uint8), (len(owner), 1))
            swap[np.arange(len(owner)), k[left]] = 0
        elif not left.all():
            owner, seed, swap = owner[left], seed[left], swap[left]
    return out.reshape(sets, REGISTERS)


def fingerprints(elements: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums that tell sets apart."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(elements ^ np.uint64(key)))]) for key in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return [(s[ends[1:]] - s[ends[:-1]]).view(np.int64) for s in sums]


SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), *((k, pa.int64()) for k in SKETCH)])


def sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in pieces([len(t or "") for t in texts], CHARS):
                elements, sizes = shingle_sets(texts[i:j], width)
                fingerprint = fingerprints(elements, sizes)
                registers = superminhash(elements, sizes)
                band = np.full((j - i, BANDS), 0, np.uint64)
                for r in range(ROWS):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + registers[:, r::ROWS].astype(np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
                offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[sizes > 0].reshape(-1).view(np.int64)))
                two = np.zeros((j - i, 128), np.uint64)
                two[:, :REGISTERS] = mix(registers.astype(np.uint64)) >> np.uint64(62)
                packed = np.bitwise_or.reduce(two.reshape(-1, 4, 32) << (2 * np.arange(32, dtype=np.uint64)), axis=2).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(sizes), pa.array(fingerprint[0]), pa.array(fingerprint[1]), bands, *(pa.array(np.ascontiguousarray(packed[:, k])) for k in range(4))], schema=SIGNED)

    return run


def sets_of(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("set_a", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in pieces([len(t or "") for t in texts], CHARS):
                elements, sizes = shingle_sets(texts[i:j], width)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(elements.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(fingerprints(elements, sizes)[0]), lists], schema=schema)

    return run


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Union-find over a table of edges (a, b): one row (id, root) for each end, root the smallest id that it reaches.

    Each round hangs every id below its smallest neighbour, halves the paths, and contracts the edges to the roots; the
    number of rounds is logarithmic. Each round is written to the shared folder, and what it replaces is deleted.
    """
    own = Scratch(edges.sparkSession)
    edges = own.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        low = edges.select(F.col("a").alias("id"), F.col("b").alias("up")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("up"))).groupBy("id").agg(F.min("up").alias("up"))
        step = own.written(low, "parents")
        for _ in range(2):
            step = step.join(step.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", F.col("top").alias("up"))
        step = own.written(step, "parents")
        if labels is None:
            labels = step.select("id", F.col("up").alias("root"))
        else:
            labels = labels.join(step.select(F.col("id").alias("root"), "up"), "root", "left").select("id", F.coalesce("up", "root").alias("root"))
        labels = own.written(labels, "labels")
        ends = [step.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up")) for c in "ab"]
        moved = edges.join(ends[0], "a").join(ends[1], "b").select(F.greatest("a_up", "b_up").alias("a"), F.least("a_up", "b_up").alias("b"))
        edges = own.written(moved.filter("a != b").distinct(), "edges")
        own.close(labels, edges)
    if labels is None:
        labels = own.written(edges.select(F.col("a").alias("id"), F.col("b").alias("root")), "labels")
    own.close(labels)
    if scratch:
        scratch.tables += own.tables
    return labels


def unlike(left: list[Column], right: list[Column]) -> Column:
    """The number of registers in which two sketches differ."""
    both = [a.bitwiseXOR(b) for a, b in zip(left, right, strict=True)]
    return sum((F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOW_BITS))) for x in both[1:]), F.bit_count(both[0].bitwiseOR(F.shiftrightunsigned(both[0], 1)).bitwiseAND(F.lit(LOW_BITS))))


def block_links(percent: int):
    """Links between different groups among the documents of two blocks, one for each two groups."""

    def run(table: pa.Table) -> pa.Table:
        ids, root, block = (table.column(c).to_numpy() for c in ("doc_id", "root", "block"))
        lists = table.column("shingles").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        values, kind = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), size)
        common = np.zeros((len(ids), len(ids)), np.float32)
        order = np.argsort(kind, kind="stable")
        kind, owner = kind[order], owner[order]
        cuts = np.searchsorted(kind, np.arange(0, len(values) + COLUMNS, COLUMNS))
        for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            part = np.zeros((len(ids), COLUMNS), np.float32)
            part[owner[i:j], kind[i:j] - k * COLUMNS] = 1
            common += part @ part.T
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        linked &= (root[:, None] != root[None, :]) & ((block[:, None] != block[None, :]) | (block.min() == block.max()))
        x, y = np.nonzero(np.triu(linked, 1))
        _, once = np.unique(np.stack([np.minimum(root[x], root[y]), np.maximum(root[x], root[y])], axis=1), axis=0, return_index=True)
        return pa.table({"a": ids[x[once]], "b": ids[y[once]]})

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row for each document with the smallest id that it reaches over links of near-duplicates.

    A document's set holds its distinct shingles of `width` words, A-Z lower-cased; a text of fewer words is one shingle; one
    without words, or null, has an empty set and no link. Documents are linked when 100 * intersection >= percent * union.

    Documents of one set are one class from the start. Candidates are classes that share a band of their SuperMinHash
    signature (at 0.75, (1 - 0.75 ** 4) ** 30, one link in 90,000, shares none) and whose sketches are alike. First each bucket's
    members are compared with one of them, another in each band; links make groups, and a group of copies costs a multiple of its
    size. Where different groups meet in a bucket, the members of all such buckets that hang together are dealt into blocks, and each two blocks are
    compared whole, in a task of 512 documents at most. Of clusters of more than WHOLE blocks, each bucket is compared by itself, small ones together, so that no blocks
    meet which share no band. So no link between groups is left out, and no pair becomes a row but a link. Every link is counted on the full sets.

    Returns (id, n_shingles, component_id, kept). A null id is left out of groups: its component_id is null and it is kept.
    Rows that repeat an id are one document, whose set is the smallest of theirs (of as small ones that of the lowest hash); n_shingles is the row's own. A text of any
    length is taken whole, in one task. Other columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    written = scratch.written
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = written(docs.mapInArrow(sign(width), "doc_id long, n long, set_a long, set_b long, bands array<long>, " + ", ".join(f"{k} long" for k in SKETCH)), "signed")
    key = ["n", "set_a", "set_b"]
    own = signed.filter("doc_id IS NOT NULL AND n > 0")
    several = written(own.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("one"), F.count("*").alias("times")).filter("times > 1").select("doc_id", "one"), "several")
    own = own.join(several, "doc_id", "left").filter(F.col("one").isNull() | (F.col("one") == F.struct(*key))).drop("one")
    classes = own.groupBy(key).agg(F.min("doc_id").alias("rep"))
    member = written(own.select("doc_id", *key).join(classes, key).select("doc_id", "rep"), "members")
    reps = own.join(member.filter("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rows = reps.select("doc_id", "n", F.explode("bands").alias("bucket"))
    full = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = written(rows.join(full, "bucket"), "buckets")
    buckets = buckets.join(own.select("doc_id", *SKETCH).dropDuplicates(["doc_id"]), "doc_id")
    near = 100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")
    bound = REGISTERS * (1 - (percent / 100 - SLACK)) * 0.75
    shares = F.ceil(F.col("size") / SHARE).cast("int")
    others = buckets.select(F.col("bucket").alias("in"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("of_share"), F.col("doc_id").alias("other"), F.col("n").alias("other_n"), *(F.col(k).alias(f"other_{k}") for k in SKETCH))
    alike = (F.col("bucket") == F.col("in")) & (F.col("share") == F.col("of_share")) & (F.col("doc_id") != F.col("other")) & near & (unlike([F.col(k) for k in SKETCH], [F.col(f"other_{k}") for k in SKETCH]) <= bound)
    dealt_out = buckets.withColumn("share", F.pmod(F.xxhash64("doc_id"), shares).cast("int"))
    buckets = written(dealt_out.join(others, alike, "left_semi").select("bucket", "doc_id", "n"), "alike")
    some = buckets.select("doc_id").distinct()
    sets = docs.join(some.hint("merge"), "doc_id", "left_semi").mapInArrow(sets_of(width), "doc_id long, set_a long, shingles array<long>")
    sets = sets.join(several, "doc_id", "left").filter(F.col("one").isNull() | ((F.col("one.n") == F.size("shingles")) & (F.col("one.set_a") == F.col("set_a"))))
    sets = written(sets.select("doc_id", "shingles").dropDuplicates(["doc_id"]), "sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Which of the pairs (a, b) are links."""
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        met = pairs.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b")
        met = met.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("both"), (F.size("of_a") + F.size("of_b")).alias("sum"))
        return written(met.filter(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b"), name)

    turned = F.col("doc_id").bitwiseXOR(F.xxhash64("bucket"))
    lead = buckets.groupBy("bucket").agg(F.min(turned).alias("low")).select("bucket", F.col("low").bitwiseXOR(F.xxhash64("bucket")).alias("lead"))
    sizes = buckets.select("doc_id", "n").distinct()
    led = buckets.join(lead, "bucket").filter("doc_id != lead").select("doc_id", "n", "lead").distinct().join(sizes.toDF("lead", "other_n"), "lead").filter(near)
    links = confirmed(led.select(F.col("doc_id").alias("a"), F.col("lead").alias("b")), "led-links")
    groups = components(links, scratch)

    placed = written(buckets.join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "placed")
    torn = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("doc_id").alias("first"), F.count("*").alias("size")).filter("low != high")
    torn_rows = written(placed.join(torn.select("bucket", "first", "size"), "bucket").select("bucket", "size", "doc_id", "root", "first"), "torn")
    clusters = components(torn_rows.select(F.col("doc_id").alias("a"), F.col("first").alias("b")), scratch)
    clusters = clusters.select(F.col("id").alias("doc_id"), F.col("root").alias("cluster"))
    count = clusters.groupBy("cluster").agg(F.count("*").alias("docs"))
    many = F.col("docs") > WHOLE * BLOCK
    unit = F.when(~many, 0).when(F.col("size") > BLOCK, F.col("bucket")).otherwise(F.pmod("bucket", F.ceil(F.col("docs") / BLOCK)))
    blocks = F.when(~many, F.ceil(F.col("docs") / BLOCK)).when(F.col("size") > BLOCK, F.ceil(F.col("size") / BLOCK)).otherwise(1).cast("int")
    dealt = torn_rows.join(clusters, "doc_id").join(count, "cluster").select("cluster", unit.alias("unit"), blocks.alias("blocks"), "doc_id", "root").distinct()
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    met = dealt.join(sets, "doc_id").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cluster", "unit", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "doc_id", "root", "shingles")
    more = written(met.groupBy("cluster", "unit", "low", "high").applyInArrow(block_links(percent), "a long, b long"), "rest-links")

    groups = components(links.unionByName(more), scratch)
    ends = member.join(groups.select(F.col("id").alias("rep"), "root"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("root")).distinct()
    found = written(signed.select("doc_id", "n").join(ends, "doc_id", "left"), "groups")
    scratch.close(found)
    return found.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("root", "doc_id"))).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """The documents of which none stays in their stead, with all their columns, whatever their names: of each group of near_groups() the one of the smallest id.

    Null, empty and blank texts are linked with nothing and stay, and so do rows with a null id. Rows of one id stay or go together. Texts of any length count whole; an empty table gives an empty one.
    """
    gone = near_groups(docs, id_col, text_col, width, percent).filter("NOT kept").select(F.col(id_col).alias("_gone_id")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone_id"], "left_anti")
