"""An inverted-file index of vectors by cosine: centroids from a bounded sample, every vector in the list of its nearest one, queries against few lists or exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors from which centroids are fitted at most, rounds of fitting, queries by which `probe` is chosen, vectors of a packed block, vectors that a task holds, similarities of a task at a time, vectors whose greatest similarity is looked at first.
SAMPLE, ROUNDS, TRIALS, BLOCK, HELD, CELLS, NEIGHBOURS = 20_000, 8, 100, 1024, 65_536, 1 << 22, 64


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows by their lengths; zero rows stay."""
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(norm > 0, norm, 1.0)


def matrix(rows: pa.Array, size: int) -> np.ndarray:
    """Vectors as unit rows. One of another length counts as if zeros followed, or as cut to the index's length; nulls inside count as 0."""
    n = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(rows.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(rows), size))
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    use = at < size
    out[np.repeat(np.arange(len(rows)), n)[use], at[use]] = flat[use]
    return units(out)


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by spherical k-means. It begins with rows spread over the sample; an empty list takes the row that is farthest from its centroid."""
    centers = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        own, best = np.empty(len(sample), np.int64), np.empty(len(sample))
        for i in range(0, len(sample), BLOCK):  # similarities of a block at a time: all of them are rows by lists
            sim = sample[i : i + BLOCK] @ centers.T
            own[i : i + BLOCK], best[i : i + BLOCK] = sim.argmax(axis=1), sim.max(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = sample[np.argsort(best, kind="stable")[: len(empty)]]
        centers = units(sums)
    return centers


def nearest_center(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The centroid of the greatest cosine with each row."""
    return np.concatenate([np.zeros(0, np.int64), *[(x[i : i + BLOCK] @ centers.T).argmax(axis=1) for i in range(0, len(x), BLOCK)]])


def top(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest finite values of each row; of equals the first columns."""
    sim = np.where(np.isfinite(sim), sim, -np.inf)
    least = np.partition(sim, -k, axis=1)[:, -k, None] if sim.shape[1] > k else np.full((len(sim), 1), -np.inf)
    more, equal = sim > least, (sim == least) & (sim > -np.inf)
    equal &= np.cumsum(equal, axis=1) <= k - more.sum(axis=1, keepdims=True)
    return np.nonzero(more | equal)


class Held:
    """Lists of an index, or parts of them, in a task's memory."""

    def __init__(self, size: int, lists: dict[int, list[tuple[bytes, bytes]]]):
        self.size, self.names = size, sorted(lists)
        ids, rows = [], []
        for name in self.names:
            own, v = (np.concatenate([np.frombuffer(b[i], kind) for b in lists[name]]) for i, kind in enumerate((np.int64, np.float64)))
            v = v.reshape(len(own), size)
            use = np.flatnonzero(np.isfinite(v).all(axis=1))
            use = use[np.argsort(own[use], kind="stable")]
            ids.append(own[use])
            rows.append(v[use])
        self.ends = np.cumsum([0, *map(len, ids)])
        self.ids, self.rows = np.concatenate(ids), np.concatenate(rows)
        self.short = self.rows.astype(np.float32)
        self.slack = (size + 4) * 2.0**-22  # of single precision, for the difference of two similarities of unit vectors

    def best(self, qid: np.ndarray, q: np.ndarray, bar: np.ndarray, asks: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(qid, id, cosine) of each query's k best of the lists that it asks for (queries by lists), without those that are under its bar."""
        longest = max(1, int(np.diff(self.ends).max()))
        step = max(1, CELLS // (longest + NEIGHBOURS))
        for i in range(0, len(qid), step):
            s = slice(i, i + step)
            yield self._best(qid[s], q[s], bar[s], asks[s], k)

    def _best(self, qid: np.ndarray, q: np.ndarray, bar: np.ndarray, asks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Single precision shows which similarities can be among the k best: those of at least the k-th greatest of all groups' greatest, less what it may err. Double precision decides."""
        reach, short, found = bar - 1e-11, q.astype(np.float32), []
        for n, (a, b) in enumerate(zip(self.ends, self.ends[1:], strict=False)):
            at = np.flatnonzero(asks[:, n])
            if not len(at) or a == b:
                continue
            lo, hi = (np.searchsorted(self.ids[a:b], qid[at], side) for side in ("left", "right"))
            own = np.repeat(np.arange(len(at)), hi - lo)
            same = np.arange(len(own)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[own]
            groups = -(-(b - a) // NEIGHBOURS)
            sim = np.full((len(at), groups * NEIGHBOURS), -np.inf, np.float32)
            np.matmul(short[at], self.short[a:b].T, out=sim[:, : b - a])
            sim[own, same] = -np.inf
            each = sim.reshape(len(at), groups, NEIGHBOURS)
            most = each.max(axis=2)
            of = most if groups >= k else sim
            if of.shape[1] >= k:
                reach[at] = np.fmax(reach[at], np.partition(of, -k, axis=1)[:, -k] - self.slack)
            row, group = np.nonzero(most >= (reach[at] - self.slack)[:, None])
            if len(row) > max(4 * k * len(at), CELLS // NEIGHBOURS // 8):  # as with many equal vectors
                sim = np.round(q[at] @ self.rows[a:b].T, 12)
                sim[own, same] = -np.inf
                row, col = top(sim, k)
            else:
                kept = each[row, group] >= (reach[at] - self.slack)[row, None]
                pair, place = np.nonzero(kept)
                row, col = row[pair], group[pair] * NEIGHBOURS + place
            found.append((at[row], a + col))
        row, col = (np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in range(2))
        value = np.concatenate([np.zeros(0), *[np.round(np.einsum("ij,ij->i", q[row[i : i + HELD]], self.rows[col[i : i + HELD]]), 12) for i in range(0, len(row), HELD)]])
        use = np.isfinite(value) & (value >= bar[row] - 1e-11)
        row, col, value = row[use], col[use], value[use]
        order = np.lexsort((self.ids[col], -value, row))
        row, col, value = row[order], col[order], value[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        return qid[row[first]], self.ids[col[first]], value[first]


def nearest_order(x: np.ndarray, centers: np.ndarray, probe: int) -> np.ndarray:
    """The `probe` nearest centroids of each row, the nearest first."""
    found = [np.argsort(-(x[i : i + BLOCK] @ centers.T), axis=1, kind="stable")[:, :probe] for i in range(0, len(x), BLOCK)]
    return np.concatenate([np.zeros((0, min(probe, len(centers))), np.int64), *found])


def nearest_lists(x: np.ndarray, centers: np.ndarray, probe: int) -> np.ndarray:
    """Which lists are among the `probe` nearest, rows by lists."""
    out = np.zeros((len(x), len(centers)), bool)
    np.put_along_axis(out, nearest_order(x, centers, probe), True, axis=1)
    return out


def reaching(x: np.ndarray, bar: np.ndarray, centers: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which lists may have a vector of at least the bar's cosine, rows by lists. reach: the least cosine of each list's vectors with its centroid, over 1.5 for an empty list."""
    angle = np.arccos(np.clip(x @ centers.T, -1, 1)) - np.arccos(np.clip(reach, -1, 1))
    most = np.where(reach > 1.5, -3.0, np.cos(np.maximum(angle, 0.0)) + 1e-9)
    zero = ~x.any(axis=1)  # such a query is as far from all
    return (most >= bar[:, None]) | (zero[:, None] & (reach <= 1.5))


@dataclass
class Index:
    """A written index. path has `lists` (rows: list, near, ids and vectors in blocks) and `centers`; near is the least cosine of a block's vectors with their centroid."""

    path: str
    size: int
    lists: int

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7) -> Index:
        """Fits centroids and writes every vector with an id into its list, once.

        The sample: up to SAMPLE rows, those whose hashed ids are smallest. `lists` is the root of the number of rows where it isn't given, a tenth of the sample at most. The driver holds the sample
        and the centroids, nothing that grows with the table. A list of any size lies in blocks of BLOCK vectors over many tasks.
        """
        spark = vectors.sparkSession
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
        n, size = rows.agg(F.count("*"), F.max(F.size("v"))).first()
        share = min(1.0, 1.2 * SAMPLE / max(n, 1))
        drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(SAMPLE) if share < 1 else rows
        table = drawn.toArrow().sort_by("id")
        size = max(size or 1, 1)
        sample = matrix(table["v"].combine_chunks(), size) if n else np.zeros((0, size))
        sample = sample[np.isfinite(sample).all(axis=1)]
        sample = sample if len(sample) else np.zeros((1, size))
        lists = max(1, min(lists or int(np.sqrt(n)), max(1, len(sample) // 10)))
        centers = fitted(sample, lists)
        sent = spark.sparkContext.broadcast(centers)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

            def block(k: int, parts) -> pa.RecordBatch:
                ids, x, near = (np.concatenate(p) for p in zip(*parts, strict=True))
                return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([float(near.min())]), pa.array([ids.tobytes()]), pa.array([x.tobytes()])], ["list", "near", "ids", "v"])

            for batch in batches:
                own, ids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), size)
                near = np.einsum("ij,ij->i", x, sent.value[own])
                near = np.where(np.isfinite(near), near, 1.0)  # a vector that isn't finite is near to nothing
                for k in np.unique(own):
                    at = np.flatnonzero(own == k)
                    parts = held.setdefault(int(k), [])
                    parts.append((ids[at], x[at], near[at]))
                    if sum(len(p[0]) for p in parts) >= BLOCK:
                        yield block(int(k), held.pop(int(k)))
            for k, parts in held.items():
                yield block(k, parts)

        # Rows come to their lists' blocks through one shuffle by list, salted so that no list is one task's.
        @F.arrow_udf("int")
        def listed(v: pa.Array) -> pa.Array:
            return pa.array(nearest_center(matrix(v, size), sent.value).astype(np.int32))

        salt = F.pmod(F.xxhash64("id"), F.lit(max(1, n // (lists * BLOCK * 8) + 1)))
        dealt = rows.withColumn("list", listed("v")).repartition("list", salt.cast("int")).select("list", "id", "v")
        dealt.mapInArrow(packed, "list int, near double, ids binary, v binary").write.parquet(f"{path}/lists")
        spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centers)], "list int, v array<double>").write.parquet(f"{path}/centers")
        return cls(path, size, lists)

    def centers(self, spark: SparkSession) -> np.ndarray:
        rows = spark.read.parquet(f"{self.path}/centers").orderBy("list").collect()
        return np.array([r.v for r in rows])

    def search(self, queries: DataFrame, k: int, probe: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """(qid, vec_id, sim): the k vectors of the greatest cosine with each query, not those of its own id; of equals the smaller ids.

        With probe, the lists of the `probe` nearest centroids are searched. Without, the search is exact: first the nearest list, whose k-th best is a bar; then every list whose vectors can
        reach the bar, given their least cosine with the centroid (the angle between query and vector is at least that between query and centroid less the list's widest angle).
        Queries with a null id or vector have no result. Lists are put together, and large ones apart, in shards of about HELD vectors. A query goes once to each shard that has a list for it;
        a task holds a shard and takes the queries as they come. What is sent grows with queries times shards.
        """
        spark = queries.sparkSession
        centers = spark.sparkContext.broadcast(self.centers(spark))
        asked = queries.select(F.col(id_col).cast("long").alias("qid"), F.col(vector_col).alias("q")).filter("qid IS NOT NULL AND q IS NOT NULL")
        lists = spark.read.parquet(f"{self.path}/lists")
        sizes = lists.groupBy("list").agg((F.sum(F.octet_length("ids")) / 8).cast("long").alias("n"), F.min("near").alias("near")).orderBy("list").collect()  # a row for each list, as many as centroids
        met = self._sharded(lists, sizes, k)
        if probe is not None:
            return met(asked.withColumn("bar", F.lit(-2.0)), lambda x, bar: nearest_lists(x, centers.value, probe))
        first = met(asked.withColumn("bar", F.lit(-2.0)), lambda x, bar: nearest_lists(x, centers.value, 1))
        bar = first.groupBy("qid").agg(F.count("*").alias("n"), F.min("sim").alias("least")).select("qid", F.when(F.col("n") >= k, F.col("least")).otherwise(-2.0).alias("bar"))
        reach = np.full(self.lists, 2.0)
        for r in sizes:
            reach[r["list"]] = r.near
        return met(asked.join(bar, "qid", "left").withColumn("bar", F.coalesce("bar", F.lit(-2.0))), lambda x, bar: reaching(x, bar, centers.value, reach))

    @staticmethod
    def _nearest(centers, size: int, probe: int):
        @F.arrow_udf("array<int>")
        def run(q: pa.Array) -> pa.Array:
            best = nearest_order(matrix(q, size), centers.value, probe).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1, dtype=np.int32) * best.shape[1]), pa.array(best.ravel()))

        return run("q")

    @staticmethod
    def _reaching(centers, size: int, reach):
        """reaching() as a column of lists, of the columns q and bar."""

        @F.arrow_udf("array<int>")
        def run(q: pa.Array, bar: pa.Array) -> pa.Array:
            return pa.array([np.flatnonzero(x).astype(np.int32) for x in reaching(matrix(q, size), bar.to_numpy(), centers.value, reach.value)], pa.list_(pa.int32()))

        return run("q", "bar")

    def _sharded(self, lists: DataFrame, sizes: list, k: int) -> Callable[[DataFrame, Callable[[np.ndarray, np.ndarray], np.ndarray]], DataFrame]:
        """A function of queries (qid, q, bar) and of their choice, which tells (queries by lists) what lists a batch of unit vectors and bars asks for; it gives each query's k best there."""
        spark, size, lists_ = lists.sparkSession, self.size, self.lists
        cores = spark.sparkContext.defaultParallelism
        most = max(BLOCK, min(HELD, -(-sum(r.n for r in sizes) // (2 * cores))))
        shards: list[list[int]] = []
        places, room = [], 0
        for r in sizes:
            parts = -(-r.n // most)
            if parts > 1 or r.n > room:
                places.append((r["list"], len(shards), parts))
                shards += [[r["list"]] for _ in range(parts)]
                room = most - r.n if parts == 1 else 0
            else:
                places.append((r["list"], len(shards) - 1, 1))
                shards[-1].append(r["list"])
                room -= r.n
        place = spark.createDataFrame(places, "list int, at int, parts int")
        held = lists.join(F.broadcast(place), "list").select((F.col("at") + F.pmod(F.xxhash64("ids"), F.col("parts"))).cast("int").alias("shard"), "list", "ids", "v")

        def choose(choice):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    x, bar = matrix(batch.column("q"), size), batch.column("bar").to_numpy()
                    asks = np.concatenate([np.zeros((0, lists_), bool), *[choice(x[i : i + BLOCK], bar[i : i + BLOCK]) for i in range(0, len(x), BLOCK)]])
                    for n, own in enumerate(shards):
                        at = np.flatnonzero(asks[:, own].any(axis=1))
                        if len(at):
                            part = batch.take(pa.array(at))
                            which = pa.array([m.tobytes() for m in np.packbits(asks[np.ix_(at, own)], axis=1)], pa.binary())
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), part.column("qid"), part.column("q"), part.column("bar"), which], ["shard", "qid", "q", "bar", "asks"])

            return run

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, blocks, there = None, {}, None
            for batch in batches:
                shard, query = batch.column("shard").to_numpy(), pc.is_valid(batch.column("qid")).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (query[1:] != query[:-1])) + 1), len(shard)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if shard[a] != now:
                        now, blocks, there = shard[a], {}, None
                    part = batch.slice(a, b - a)
                    if not query[a]:  # a shard's vectors come before its queries
                        for name, ids, v in zip(*(part.column(c).to_pylist() for c in ("list", "ids", "v")), strict=True):
                            blocks.setdefault(name, []).append((ids, v))
                        continue
                    if there is None:
                        if not blocks:
                            continue
                        there, blocks = Held(size, blocks), {}
                    own = shards[now]
                    bits = np.frombuffer(b"".join(part.column("asks").to_pylist()), np.uint8).reshape(b - a, -1)
                    asks = np.unpackbits(bits, axis=1, count=len(own)).astype(bool)[:, [own.index(n) for n in there.names]]
                    for found in there.best(part.column("qid").to_numpy(), matrix(part.column("q"), size), part.column("bar").to_numpy(), asks, k):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["qid", "vec_id", "sim"])

        def met(asked: DataFrame, choice: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
            kind = asked.schema["q"].dataType.simpleString()
            sent = asked.select("qid", "q", "bar").mapInArrow(choose(choice), f"shard int, qid long, q {kind}, bar double, asks binary")
            both = held.unionByName(sent, allowMissingColumns=True).repartitionById(max(1, len(shards)), "shard").sortWithinPartitions("shard", F.col("qid").isNotNull())
            found = both.mapInArrow(score, "qid long, vec_id long, sim double")
            rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("sim").desc(), "vec_id"))
            return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")

        return met

    def probe_for(self, queries: DataFrame, k: int, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
        """The fewest lists whose search finds so large a share of the k best of TRIALS of these queries (those of the smallest hashed ids), measured against the exact search. Queries of another kind may need more."""
        trials = queries.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col)).limit(TRIALS)
        spark = queries.sparkSession
        exact = self.search(trials, k, None, id_col, vector_col)
        centers = spark.sparkContext.broadcast(self.centers(spark))
        order = self._nearest(centers, self.size, self.lists)
        asked = trials.select(F.col(id_col).cast("long").alias("qid"), F.col(vector_col).alias("q")).select("qid", F.posexplode(order).alias("place", "list"))
        size = self.size

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for list_, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = np.frombuffer(ids, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), list_, np.int32)), pa.array(found)], ["list", "vec_id"])

        lists = spark.read.parquet(f"{self.path}/lists").select("list", "ids").mapInArrow(members, "list int, vec_id long")
        places = lists.join(F.broadcast(exact.select("qid", "vec_id")), "vec_id").join(F.broadcast(asked), ["qid", "list"]).groupBy("place").count().collect()
        counts = np.zeros(self.lists)
        for r in places:  # a row for each place, as many as lists at most
            counts[r.place] = r["count"]
        upto = np.cumsum(counts)
        return int(np.searchsorted(upto, recall * upto[-1] - 1e-9)) + 1 if upto[-1] else 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(qid, recall): the share of a query's exact results that were found."""
    hit = exact.select("qid", "vec_id").join(found.select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left")
    return hit.groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))
