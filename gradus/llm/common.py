"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which driver and executors share. Where it is unset, a temporary one in local mode, as in tests; on a cluster, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", found)
    spark.sparkContext.setCheckpointDir(found)
    return found


def until_end(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the application ends. An application that is killed leaves it: names end in a random part, so whatever is older than the longest run may be swept."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)  # only of what is there
    return path


class Scratch:
    """Tables that an operator writes into the shared folder on its way. A table that is written ends the lineage: a lost executor takes nothing along."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet and reads it back. The files go when the application ends, if close() doesn't delete them before."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        fs, at = self._files(path)
        fs.deleteOnExit(at)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((path, back))
        return back

    def close(self, *kept: DataFrame) -> None:
        """Deletes all tables but these: what the operator's result still reads."""
        for path, table in self.tables:
            if not any(table is k for k in kept):
                fs, at = self._files(path)
                fs.delete(at, True)
        self.tables = [(p, t) for p, t in self.tables if any(t is k for k in kept)]


#: Plan nodes that leave rows as they are.
PLAIN = {"Project", "Filter", "LogicalRelation"}


def stored_rows(df: DataFrame) -> list[Column] | None:
    """Two columns that tell rows of stored files apart, the same at each reading: the file's hash and the row's place in it.

    None where df isn't rows of files as they are: its plan has other nodes than filters and projections over one file relation, or a condition that may change from reading to reading.
    """
    node = df._jdf.queryExecution().analyzed()
    while True:
        if node.getClass().getSimpleName() not in PLAIN or not node.deterministic():
            return None
        if node.children().isEmpty():
            break
        node = node.children().head()
    try:
        meta = df.metadataColumn("_metadata")
        found = [F.xxhash64(meta.getField("file_path")), meta.getField("row_index")]
        df.select(*found).schema  # noqa: B018
        return found
    except AnalysisException:
        return None


def numbered(df: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[str]]:
    """df with two more columns that tell its rows apart, the same at each reading, and their names. Rows that are not rows of files as they are, are written first."""
    names = [fresh(df, n) for n in ("_file", "_place")]
    found = stored_rows(df)
    if found is not None:
        return df.withColumns(dict(zip(names, found, strict=True))), names
    return scratch.written(df.withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.monotonically_increasing_id()}), "rows"), names


def fresh(df: DataFrame, name: str) -> str:
    """The name, with more underscores before it as long as df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and leaves every other character."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    return F.crc32(col.cast("string").cast("binary")) % n


def pieces(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes sum to the limit at most, or of one row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
