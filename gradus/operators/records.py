"""Changes of records as tables: status requests, reviews, upserts, resets, write-backs and clean-ups. Each gives the new rows; nothing is updated in place."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _floating(kind: T.DataType) -> bool:
    """Whether values of this type have floating numbers at any depth."""
    if isinstance(kind, T.ArrayType):
        return _floating(kind.elementType)
    if isinstance(kind, T.MapType):
        return _floating(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_floating(f.dataType) for f in kind)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def safe_value(value: Column, kind: T.DataType) -> Column:
    """The value with null for NaN and infinities, inside structs, arrays and the values of maps too."""
    if not _floating(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: safe_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: safe_value(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[safe_value(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def json_safe(df: DataFrame) -> DataFrame:
    """df with null for NaN and infinities, at any depth, which JSON has no numbers for."""
    found = [f for f in df.schema if _floating(f.dataType)]
    return df.withColumns({f.name: safe_value(F.col(f"`{f.name}`"), f.dataType) for f in found}) if found else df


def may_view(role: Column, user: Column, owner: Column, assigned: Column) -> Column:
    """One record, one user: an admin sees every case, a student own ones, a teacher own and assigned ones."""
    return F.when(role == "admin", True).when(role == "student", user == owner).when(role == "teacher", (user == owner) | (user == assigned)).otherwise(False)


def may_update(role: Column, user: Column, assigned: Column) -> Column:
    return F.when(role == "admin", True).when(role == "teacher", user == assigned).otherwise(False)


def owns(role: Column, user: Column, owner_admin: Column, owner_teacher: Column) -> Column:
    """Whether a user owns a community in the user's role; students own none, and a null owner is nobody."""
    return F.coalesce(F.when(role == "admin", user == owner_admin).when(role == "teacher", user == owner_teacher), F.lit(False))


def transitions(requests: DataFrame, key: str, order: str, statuses: Iterable[str], at: str = "at", note: str = "note") -> DataFrame:
    """(key, status, resolution, resolved_at, escalated_at, changes) after all requests (key, order, status, role, at, note) in order.

    Requests with a status of no known name are ignored. The last request decides the status; the last one that resolves, or escalates, decides what is
    noted of it. One aggregation, so a case with many requests costs one row a task.
    """
    valid = requests.filter(F.col("status").isin(list(statuses)))
    when = lambda status: F.when(F.col("status") == status, F.col(order))
    return valid.groupBy(key).agg(
        F.max_by("status", order).alias("status"),
        F.max_by(note, when("resolved")).alias("resolution"),
        F.max_by(at, when("resolved")).alias("resolved_at"),
        F.max_by("role", when("resolved")).alias("resolved_by"),
        F.max_by(at, when("escalated")).alias("escalated_at"),
        F.count("*").alias("changes"),
    )


def status_messages(requests: DataFrame, key: str, order: str, first: str = "open") -> DataFrame:
    """(key, order, content): the message that each change of status leaves in a case."""
    before = F.coalesce(F.lag("status").over(Window.partitionBy(key).orderBy(order)), F.lit(first))
    return requests.select(key, order, F.format_string("Status changed from '%s' to '%s'", before, "status").alias("content"))


def reviewed(records: DataFrame, reviews: DataFrame, key: str, at: str) -> DataFrame:
    """records with `reviewed` and the time of the last review (null: none)."""
    last = reviews.groupBy(key).agg(F.max(at).alias("reviewed_at"))
    return records.join(last, key, "left").withColumn("reviewed", F.col("reviewed_at").isNotNull())


def link_requests(requests: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Each requested link once, with its outcome: `exists` or `added`."""
    there = links.select(*keys).dropna().distinct().withColumn("_there", F.lit(True))
    found = requests.select(*keys).dropna().distinct().join(there, keys, "left")
    return found.select(*keys, F.when(F.col("_there"), "exists").otherwise("added").alias("outcome"))


def got_or_created(users: DataFrame, dashboards: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """One dashboard for each user: the one there is, or a new one with zero counters (created)."""
    there = dashboards.select(key, *counters).withColumn("_there", F.lit(True))
    found = users.select(key).distinct().join(there, key, "left")
    return found.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in counters], F.col("_there").isNull().alias("created"))


def reset(dashboards: DataFrame, chosen: Column, counters: list[str]) -> DataFrame:
    """dashboards with zero counters where `chosen` holds."""
    return dashboards.withColumns({c: F.when(F.coalesce(chosen, F.lit(False)), F.lit(0)).otherwise(F.col(c)) for c in counters})


def inserted(records: DataFrame, new: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """records and the new ones whose key isn't there, each key once (the first by all columns); defaults stand for nulls of the new."""
    filled = new.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()}).join(records.select(key), key, "left_anti")
    once = filled.groupBy(key).agg(F.min(F.struct([c for c in records.columns if c != key])).alias("_row")).select(key, "_row.*")
    return records.unionByName(once.select(records.columns))


def of_type(files: DataFrame, kind: str, order: list[Column], limit: int, deleted: str | None = None) -> DataFrame:
    """The first so many files of each kind that are not deleted, as a registry lists them."""
    live = files.filter(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else files
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return live.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def written_back(files: DataFrame, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """files with the extracted text where there is one, and `processed`."""
    new = texts.groupBy(key).agg(F.max(text).alias("_text"))
    return files.join(new, key, "left").withColumns({text: F.coalesce("_text", text), "processed": F.col("_text").isNotNull()}).drop("_text")


def expired(files: DataFrame, at: str, now: Column, hours: int) -> DataFrame:
    """Files that are older than so many hours, to be deleted."""
    return files.filter(F.col(at) < now - F.make_dt_interval(hours=F.lit(hours)))


def sorted_page(df: DataFrame, by: str, allowed: dict[str, Column], descending: bool, tie: str, size: int) -> DataFrame:
    """A page in the order that the caller chose; a name that isn't allowed means the first that is."""
    order = allowed.get(by, next(iter(allowed.values())))
    return df.orderBy(order.desc() if descending else order.asc(), tie).limit(size)
