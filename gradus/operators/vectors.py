"""A stated set of query vectors against all vectors, in blocks: each task multiplies a block of queries by a block of vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .vector_index import matrix

#: Query vectors and other vectors of a block at most, on average.
QUERIES, VECTORS = 1024, 4096

#: (query ids, vector ids, cosines with a row for each query) -> columns of the block's result.
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def in_blocks(vectors: DataFrame, asked: Column, kernel: Kernel, schema: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """kernel over each block of queries (rows for which `asked` holds) and each block of all rows. Null vectors and ids are left out. Of vectors of several lengths the shorter ones count as if zeros followed; a null inside a vector counts as 0.

    Queries are copied once for each block of vectors and vectors once for each block of queries, as any exact search needs; a task holds one block of each.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.coalesce(asked, F.lit(False)).alias("q")).filter("v IS NOT NULL AND id IS NOT NULL")
    n, n_asked, size = rows.agg(F.count("*"), F.count_if("q"), F.max(F.size("v"))).first()
    size = max(size or 1, 1)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    across, down = -(-n_asked // QUERIES), max(-(-n // VECTORS), min(cores, n // 64 + 1))
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.lit(max(count, 1) - 1)))
    own = lambda count: F.pmod(F.xxhash64("id"), F.lit(max(count, 1))).cast("int")
    queries = rows.filter("q").select(own(across).alias("a"), spread(down).alias("b"), "q", "id", "v")
    others = rows.select(spread(across).alias("a"), own(down).alias("b"), F.lit(False).alias("q"), "id", "v")

    def run(table: pa.Table) -> pa.Table:
        mask = table.column("q")
        left, right = table.filter(mask), table.filter(pa.compute.invert(mask))
        if not left.num_rows or not right.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in pa_schema})
        qid, q = left.column("id").to_numpy(), matrix(left.column("v").combine_chunks(), size)
        vid, v = right.column("id").to_numpy(), matrix(right.column("v").combine_chunks(), size)
        found = kernel(qid, vid, np.round(q @ v.T, 12))
        return pa.table([pa.array(found[f.name], f.type) for f in pa_schema], schema=pa_schema)

    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    pa_schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")])
    return queries.unionByName(others).groupBy("a", "b").applyInArrow(run, schema)


def nearest(vectors: DataFrame, asked: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(qid, vec_id, sim): the k rows of the greatest cosine with each query, not itself; of equals the smallest ids. Each block keeps its own k, then these are merged."""

    def best(qid: np.ndarray, vid: np.ndarray, sim: np.ndarray) -> dict[str, np.ndarray]:
        sim = np.where(qid[:, None] == vid[None, :], -np.inf, sim)
        by_id = np.argsort(vid, kind="stable")
        top = by_id[np.argsort(-sim[:, by_id], axis=1, kind="stable")[:, :k]]
        row = np.repeat(np.arange(len(qid)), top.shape[1])
        value = sim[row, top.ravel()]
        return {n: x[np.isfinite(value)] for n, x in {"qid": qid[row], "vec_id": vid[top.ravel()], "sim": value}.items()}

    found = in_blocks(vectors, asked, best, "qid long, vec_id long, sim double", id_col, vector_col)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("sim").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def tier_counts(vectors: DataFrame, asked: Column, cuts: list[tuple[float, str]], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(qid, tier, n): how many other rows are in each tier of cosine with each query; cuts go down and end with the lowest tier's name."""

    def counted(qid: np.ndarray, vid: np.ndarray, sim: np.ndarray) -> dict[str, np.ndarray]:
        tier = np.searchsorted([-c for c, _ in cuts[:-1]], -sim, side="left")
        tier[qid[:, None] == vid[None, :]] = len(cuts)
        n = np.stack([(tier == t).sum(axis=1) for t in range(len(cuts))], axis=1)
        row, which = np.nonzero(n)
        return {"qid": qid[row], "tier": np.array([name for _, name in cuts])[which], "n": n[row, which]}

    return in_blocks(vectors, asked, counted, "qid long, tier string, n long", id_col, vector_col).groupBy("qid", "tier").agg(F.sum("n").alias("n"))
