"""Hard negatives of anchor vectors: one-bit codes bound each score, and what the bounds leave is scored in integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Vectors of a block, anchors of a group and of a tile, vectors of a stripe; bits of a query's components.
VECTORS, ANCHORS, TILE, STRIPE, PLANES = 2048, 8192, 256, 1 << 18, 6
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows turned by three rounds of fixed signs and a Walsh-Hadamard transform: lengths and inner products stay. The width is a power of two."""
    n, width = x.shape
    for k in range(3):
        x = x * np.where(np.random.default_rng(1000 + k).random(width) < 0.5, -1.0, 1.0)
        step = 1
        while step < width:
            pairs = x.reshape(n, width // (2 * step), 2, step)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
            step *= 2
        x = x / np.sqrt(width)
    return x


def widened(values: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(values), width))
    out[:, : values.shape[1]] = values
    return out


def coded(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-bit codes of integer vectors (in words of 64 bits), their lengths, and how well each code is aligned with its vector: the cosine of the two."""
    turned = rotated(widened(values, width))
    length = np.sqrt((turned * turned).sum(axis=1))
    align = np.abs(turned).sum(axis=1) / np.sqrt(width) / np.where(length > 0, length, 1.0)
    return np.packbits(turned > 0, axis=1).view(np.uint64), length, np.where(length > 0, np.minimum(align, 1.0), 1.0)


class Queries:
    """Turned queries as PLANES bits a component, in planes of words, and the length of what that leaves out."""

    def __init__(self, values: np.ndarray, width: int):
        turned = rotated(widened(values, width))
        self.width, self.length = width, np.sqrt((turned * turned).sum(axis=1))
        self.low = turned.min(axis=1, initial=0)
        self.step = (turned.max(axis=1, initial=0) - self.low) / ((1 << PLANES) - 1)
        self.step[self.step == 0] = 1.0
        whole = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        rest = turned - self.low[:, None] - whole * self.step[:, None]
        self.left = np.sqrt((rest * rest).sum(axis=1))
        self.total = whole.sum(axis=1)
        self.planes = [np.packbits((whole >> j) & 1 == 1, axis=1).view(np.uint64) for j in range(PLANES)]

    def bounds(self, part: slice, code: np.ndarray, length: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of these queries with coded vectors.

        A vector's direction is align times its code's, and a residual at right angles to it. Popcounts give the query's product with the code, but for `left`; by Cauchy-Schwarz that with the
        residual is at most the length of what the query has outside the code's direction times the residual's. Nothing is left to chance.
        """
        ones = np.zeros((part.stop - part.start, len(code)), np.int64)
        for j, plane in enumerate(self.planes):
            rows = plane[part]
            for w in range(code.shape[1]):
                ones += np.bitwise_count(rows[:, w, None] & code[None, :, w]).astype(np.int64) << j
        set_bits = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        low, step, left, q = (x[part, None] for x in (self.low, self.step, self.left, self.length))
        along = (low * (2 * set_bits - self.width)[None] + step * (2 * ones - self.total[part, None])) / np.sqrt(self.width)
        least = np.maximum(np.abs(along) - left, 0.0)
        outside = np.sqrt(np.maximum(q * q - least * least, 0.0))
        half = length * (align * left + np.sqrt(1 - align * align) * outside) + 1e-9 * self.width * q * length + 1e-6
        middle = length * align * along
        return middle - half, middle + half


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a and b, exact; beyond a long they stop at its ends."""
    high = lambda x: int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    if a.shape[1] * high(a) * high(b) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    found = a.astype(object) @ b.astype(object).T
    return np.clip(found, LEAST + 1, MOST).astype(np.int64)


def scored(a: np.ndarray, b: np.ndarray, survives: np.ndarray) -> np.ndarray:
    """Integer scores where survives; elsewhere LEAST."""
    out = np.full(survives.shape, LEAST)
    i, j = np.flatnonzero(survives.any(axis=1)), np.flatnonzero(survives.any(axis=0))
    if len(i) and len(j):
        out[np.ix_(i, j)] = products(a[i], b[j])
    out[~survives] = LEAST
    return out


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest value of each row, the least there is where it has fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf if values.dtype.kind == "f" else LEAST)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


class Best:
    """The k greatest (score, smaller id first) of each of n lists, as they come in."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.of, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(n, LEAST)

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each of `lists`, LEAST where there is none; ids: of the columns."""
        bar = np.maximum(kth(scores, self.k), self.least[lists])
        i, j = np.nonzero((scores >= bar[:, None]) & (scores > LEAST))
        if not len(i):
            return
        of, score, found = np.append(self.of, lists[i]), np.append(self.score, scores[i, j]), np.append(self.ids, ids[j])
        order = np.lexsort((found, -score, of))
        of, score, found = of[order], score[order], found[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        top = place < self.k
        self.of, self.score, self.ids = of[top], score[top], found[top]
        last = place[top] == self.k - 1
        self.least[self.of[last]] = self.score[last]


class Block:
    """A packed block of vectors."""

    def __init__(self, row: dict, width: int):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        n = len(self.ids)
        self.values = np.frombuffer(row["v"], np.dtype(row["kind"])).reshape(n, -1)
        self.code, self.length, self.align = np.frombuffer(row["code"], np.uint64).reshape(n, width // 64), np.frombuffer(row["length"]), np.frombuffer(row["align"])


BLOCKS = "ids binary, labels binary, kind string, v binary, code binary, length binary, align binary"


def values_of(rows: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows of a matrix; a shorter one has zeros behind it."""
    out = np.zeros((len(rows), size), np.int64)
    n = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(rows)), n), at] = rows.flatten().to_numpy()
    return out


def packer(size: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, VECTORS):
                part = batch.slice(i, VECTORS)
                values = values_of(part.column("v"), size)
                code, length, align = coded(values, width)
                kind = next(t for t in ("int16", "int32", "int64") if t == "int64" or (values.max(initial=0) <= np.iinfo(t).max and values.min(initial=0) >= np.iinfo(t).min))
                held = [part.column("id").to_numpy().tobytes(), part.column("label").to_numpy().tobytes(), kind, values.astype(kind).tobytes(), code.tobytes(), length.tobytes(), align.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held], [c.split()[0] for c in BLOCKS.split(", ")])

    return run


POSITIVES = "anchor_id long, positive_id long, score long"


def positives(anchors: pa.Table, blocks: Iterator[Block], size: int, width: int, k: int) -> pa.Table:
    """Of each anchor, the k best rows of its label."""
    ids, labels, values = anchors["id"].to_numpy(), anchors["label"].to_numpy(), values_of(anchors["v"].combine_chunks(), size)
    queries, best = {}, Best(len(ids), k)
    own = {x: np.flatnonzero(labels == x) for x in np.unique(labels)}
    for block in blocks:
        for label in np.intersect1d(block.labels, labels):
            rows, mine = np.flatnonzero(block.labels == label), own[label]
            if label not in queries:
                queries[label] = Queries(values[mine], width)
            for i in range(0, len(mine), TILE):
                part = slice(i, min(i + TILE, len(mine)))
                at = mine[part]
                low, high = queries[label].bounds(part, block.code[rows], block.length[rows], block.align[rows])
                other = ids[at, None] != block.ids[rows]
                bar = np.maximum(kth(np.where(other, low, -np.inf), k), best.least[at].astype(np.float64))
                best.add(at, scored(values[at], block.values[rows], other & (high >= bar[:, None])), block.ids[rows])
    return pa.table({"anchor_id": ids[best.of], "positive_id": best.ids, "score": best.score})


NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def negatives(anchors: pa.Table, blocks: Iterator[Block], size: int, width: int, k: int, low_pct: int, high_pct: int) -> pa.Table:
    """Of each anchor and positive, the k best rows of other labels whose score is from low_pct to high_pct percent of the positive's."""
    ids, labels, values = anchors["id"].to_numpy(), anchors["label"].to_numpy(), values_of(anchors["v"].combine_chunks(), size)
    counts = pc.list_value_length(anchors["positives"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = anchors["positives"].combine_chunks().flatten()
    pos_id, pos_score = flat.field("positive_id").to_numpy(), flat.field("score").to_numpy()
    anchor, most = np.repeat(np.arange(len(ids)), counts), int(counts.max(initial=0))
    # The range's ends in whole scores; a list for each place among an anchor's positives, empty ranges where there is none.
    least = np.array([-(-low_pct * int(s) // 100) if s >= 0 else MOST for s in pos_score], np.int64)
    upto = np.array([high_pct * int(s) // 100 if s >= 0 else LEAST for s in pos_score], np.int64)
    place = np.arange(len(anchor)) - np.repeat(np.cumsum(counts) - counts, counts)
    lows, highs, number = np.full((len(ids), most), MOST), np.full((len(ids), most), LEAST), np.zeros((len(ids), most), np.int64)
    lows[anchor, place], highs[anchor, place], number[anchor, place] = least, upto, np.arange(len(anchor))
    queries, best = Queries(values, width), Best(len(anchor), k)
    for block in blocks:
        for i in range(0, len(ids), TILE):
            part = slice(i, min(i + TILE, len(ids)))
            low, high = queries.bounds(part, block.code, block.length, block.align)
            known = np.where(lows[part] < MOST, np.maximum(lows[part], best.least[number[part]] if len(anchor) else LEAST), MOST)
            survives = (labels[part, None] != block.labels) & (high >= known.min(axis=1, initial=MOST)[:, None]) & (low <= highs[part].max(axis=1, initial=LEAST)[:, None])
            found = scored(values[part], block.values, survives)
            for p in range(most):
                has = np.flatnonzero(lows[part][:, p] < MOST)
                if len(has):
                    inside = (found[has] >= lows[part][has, p, None]) & (found[has] <= highs[part][has, p, None])
                    best.add(number[part][has, p], np.where(inside, found[has], LEAST), block.ids)
    return pa.table({"anchor_id": ids[anchor[best.of]], "positive_id": pos_id[best.of], "positive_score": pos_score[best.of], "negative_id": best.ids, "negative_score": best.score})


def prepared(vectors: DataFrame, label: Column, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & v.isNotNull() & ~bad)
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))


def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column | None = None, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", n_positives: int = 5, n_negatives: int = 10, low_pct: int = 30, high_pct: int = 90
) -> DataFrame:
    """Hard negatives of the rows for which `anchor` (of columns id, label, v) holds, against all rows.

    Components become floor(256 x); a score is an integer inner product; greater scores come first, equal ones by id. An anchor's positives are its n_positives best other rows of its
    label. For each of them come the n_negatives best rows of other labels with low_pct * positive <= 100 * score <= high_pct * positive, so a negative positive score has none.
    `label` replaces the label column.

    Rows with a null id, label or vector, or with a component that is null or not finite, take no part. A shorter vector counts as if zeros followed, an empty one scores 0. Rows of
    the anchor's own id are no other rows; if several rows have one anchor id, the anchor is the one of the smallest label, then vector; elsewhere repeated rows count one by one. Scores beyond a long stop
    at its ends. An empty table gives an empty result; other columns are ignored.

    Vectors are packed in blocks with a rotated one-bit code, the length and the alignment of code and vector, and written once. Anchors, in groups of at most about ANCHORS, meet every
    stripe of blocks; a task holds one group and one stripe, keeps the best of each anchor, and scores only what the codes' bounds can't rule out. Each stripe's best are merged by anchor.

    Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = prepared(vectors, label if label is not None else F.col(f"`{label_col}`"), id_col, label_col, vector_col)
    n, size, n_anchors = rows.agg(F.count("*"), F.max(F.size("v")), F.count_if(anchor)).first()
    size = max(size or 0, 1)
    width = max(64, 1 << (size - 1).bit_length())
    cores = spark.sparkContext.defaultParallelism
    groups, stripes = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n // STRIPE), min(2 * cores, n // VECTORS))
    blocks = scratch.written(rows.repartition(max(1, min(-(-n // VECTORS), 4 * stripes))).mapInArrow(packer(size, width), BLOCKS), "blocks")
    anchors = rows.filter(anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = blocks.withColumn("stripe", F.pmod(F.xxhash64("ids"), F.lit(stripes)).cast("int")).withColumn("group", each(groups))

    def best(asked: DataFrame, run, schema: str, *more) -> DataFrame:
        def task(left: pa.Table, right: pa.Table) -> pa.Table:
            names = [c.split()[0] for c in schema.split(", ")]
            if not left.num_rows or not right.num_rows:
                return pa.table({c: pa.array([], pa.int64()) for c in names})
            held = (Block({c: right[c][i].as_py() for c in right.column_names}, width) for i in range(right.num_rows))
            return run(left, held, size, width, *more).select(names)

        asked = asked.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("stripe", each(stripes))
        return asked.groupBy("group", "stripe").cogroup(dealt.groupBy("group", "stripe")).applyInArrow(task, schema)

    def first(found: DataFrame, k: int, score: str, other: str, *keys: str) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), other))).filter(F.col("rank") <= k)

    found = first(best(anchors, positives, POSITIVES, n_positives), n_positives, "score", "positive_id", "anchor_id")
    # A positive of which there are several rows is one for its negatives.
    known = scratch.written(found.groupBy(F.col("anchor_id").alias("id"), "positive_id", "score").agg(F.min("rank").alias("rank")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("positives")), "positives")
    found = first(best(anchors.join(known, "id"), negatives, NEGATIVES, n_negatives, low_pct, high_pct), n_negatives, "negative_score", "negative_id", "anchor_id", "positive_id", "positive_score")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def mined(embeddings: DataFrame) -> DataFrame:
    """hard_negatives() of embeddings whose label is wrong where 7 divides the id; anchors are the ids that 100 divides."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings, F.col("id") % 100 == 0, label)


SQL = """
WITH rows AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT a.id AS anchor_id, b.id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM rows AS a JOIN rows AS b ON a.id <> b.id WHERE a.id % 100 = 0),
positives AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
