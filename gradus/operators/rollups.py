"""Dashboards kept up to date from changes: daily states that add up, written as versions and folded when they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind of sums: exact, so that what is taken back leaves nothing behind.
SUM = "decimal(38,9)"


def states(changes: DataFrame, keys: list[str], value: str, member: str, times: str = "times") -> DataFrame:
    """(keys, member, n, total): how many rows each member has under the keys, and the sum of their values, from changes with `times` 1 for a row that comes and -1 for one that goes.

    A correction is the old row going and the new one coming. Null values count as rows and add nothing; a null member is a member of its own. States of any changes add up to the
    state of all of them, in whatever order they come; distinct members are exact, as each has its own count, which a sketch couldn't take back.
    """
    amount = F.coalesce(F.col(value).cast(SUM), F.lit(0).cast(SUM)) * F.col(times)
    return changes.groupBy(*keys, F.col(member).alias("member")).agg(F.sum(times).cast("long").alias("n"), F.sum(amount.cast(SUM)).cast(SUM).alias("total"))


def folded(found: DataFrame, keys: list[str]) -> DataFrame:
    """States that add up to one state for each member; members without rows go."""
    return found.groupBy(*keys, "member").agg(F.sum("n").alias("n"), F.sum("total").cast(SUM).alias("total")).filter("n <> 0 OR total <> 0")


def dashboard(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, total, mean, members) of folded states."""
    sums = found.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").cast(SUM).alias("total"), F.count_if(F.col("n") > 0).alias("members"))
    return sums.select(*keys, "n", F.col("total").cast("double").alias("total"), F.try_divide(F.col("total").cast("double"), F.col("n")).alias("mean"), "members")


class Rollups:
    """Versions of states in a folder: a delta for each batch of changes, and bases that stand for all versions up to theirs.

    A batch is a version, by its number from 1; done again it replaces itself, so a run that was cut off is repeated without harm. A base is seen once it is whole (its success mark is written last). Deltas and bases are never
    changed, so any version since the oldest base stays readable.
    """

    def __init__(self, spark: SparkSession, place: str, keys: list[str]):
        self.spark, self.place, self.keys = spark, place, keys

    def apply(self, number: int, changes: DataFrame, value: str, member: str) -> None:
        states(changes, self.keys, value, member).write.mode("overwrite").parquet(f"{self.place}/delta/{number:09d}")

    def _there(self, kind: str) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{kind}/*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(int(x.getPath().getParent().getName()) for x in found or [])

    def read(self, version: int | None = None) -> DataFrame:
        """The state after so many batches, or after all: the newest base up to there and the deltas after it."""
        upto = lambda kind: [n for n in self._there(kind) if version is None or n <= version]
        base = (upto("base") or [0])[-1]
        paths = [f"{self.place}/base/{base:09d}"] * bool(base) + [f"{self.place}/delta/{n:09d}" for n in upto("delta") if n > base]
        if not paths:
            raise ValueError("no version is there")
        return folded(self.spark.read.parquet(*paths), self.keys)

    def compact(self, version: int) -> None:
        """Writes the state after so many batches as a base."""
        self.read(version).write.mode("overwrite").parquet(f"{self.place}/base/{version:09d}")
