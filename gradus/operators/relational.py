"""Relational operators over tables of people, evaluations, messages and cases: scoped filters, joins, rollups, top-N and paging."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window


def filtered(df: DataFrame, equals: Mapping[str, object] | None = None, domains: Mapping[str, Iterable[str]] | None = None, search: str | None = None, search_in: Iterable[str] = ()) -> DataFrame:
    """Applies the filters that are set. A value outside its column's domain is ignored, as an unknown status is; search is a case-insensitive substring of any of the columns."""
    for name, value in (equals or {}).items():
        if value is not None and value in list((domains or {}).get(name, [value])):
            df = df.filter(F.col(name) == F.lit(value))
    if search:
        pattern = "%" + search.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        found = F.lit(False)
        for name in search_in:
            found = found | F.coalesce(F.col(name).ilike(pattern), F.lit(False))
        df = df.filter(found)
    return df


def visible(role: str, user: int, owner: str, assigned: str | None = None) -> Column:
    """Row-level scope: an admin sees all rows, a teacher own and assigned ones, a student own ones."""
    if role == "admin":
        return F.lit(True)
    own = F.col(owner) == F.lit(user)
    return own | (F.col(assigned) == F.lit(user)) if role == "teacher" and assigned else own


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The page with this number, from 1. The order must end in a unique key; Spark keeps offset + size rows of each partition at most."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(total: Column, size: int) -> Column:
    return F.ceil(total / F.lit(size))


def zero_filled(df: DataFrame, keys: list[str], column: str, domain: list[str], prefix: str = "n_") -> DataFrame:
    """One row for each key with a count for each value of the domain, 0 where there is none, in one scan."""
    counts = [F.count_if(F.col(column) == F.lit(v)).alias(f"{prefix}{v.lower()}") for v in domain]
    return df.groupBy(*keys).agg(*counts) if keys else df.agg(*counts)


def counted_where(df: DataFrame, keys: list[str], conditions: Mapping[str, Column]) -> DataFrame:
    """All conditional counts in one scan."""
    counts = [F.count_if(c).alias(n) for n, c in conditions.items()]
    return df.groupBy(*keys).agg(*counts) if keys else df.agg(*counts)


def sparse_counts(df: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    """Counts of the values that occur; null counts as `missing`."""
    return df.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle (WindowGroupLimit)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the one with the greatest order; a map-side aggregation instead of a sort, so a key with many versions costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.`{c}`").alias(c) for c in rest])


def marked(df: DataFrame, other: DataFrame, on: list[str], name: str) -> DataFrame:
    """df with a flag: whether `other` has a row with the same keys. Neither drops nor repeats rows."""
    keys = other.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(keys, on, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


#: Members of a list at most, on average, that go to a subject together, and parts in which subjects are dealt out.
MEMBERS, DEALT = 256, 64


def marked_pairs(subjects: DataFrame, members: DataFrame, other: DataFrame, group: str, subject: str, member: str, name: str) -> DataFrame:
    """(member, subject, name): each member of a group with each of its subjects, marked if `other` has the two.

    For groups so large that their pairs far outnumber all tables: no pair is shuffled. A subject's row brings the members that other has for it, meets its group's members in lists of about MEMBERS,
    and makes and marks the pairs in place. A null group meets none; a null member or subject isn't marked.
    A list meets all of a part's subjects before the next one does, so a column of the result is constant for a list and the other repeats it: stored in columns, a pair takes a small part of a byte.
    """
    there = other.groupBy(subject).agg(F.collect_set(member).alias("_there"))
    rows = subjects.join(there, subject, "left").withColumn("_dealt", F.pmod(F.xxhash64(subject), F.lit(DEALT)))
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / MEMBERS).alias("_n"))
    own = lambda m: F.pmod(F.xxhash64(m), F.col("_n"))
    lists = members.join(sizes, group).groupBy(group, "_n", own(F.col(member)).alias("_list")).agg(F.collect_list(F.struct(F.col(member).alias("m"))).alias("_members"))
    lists = lists.withColumn("_dealt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))))
    near = F.col("_there")
    if members.schema[member].dataType == other.schema[member].dataType and isinstance(members.schema[member].dataType, IntegralType):  # equal values of other types may have several hashes
        near = F.filter("_there", lambda m: own(m) == F.col("_list"))  # once a list, not all of them once a pair
    met = lists.hint("merge").join(rows, [group, "_dealt"]).select(subject, near.alias("_there"), "_members")
    pairs = met.select(subject, "_there", F.explode("_members").alias("_m"))
    mark = F.col(subject).isNotNull() & F.coalesce(F.array_contains("_there", F.col("_m.m")), F.lit(False))
    return pairs.select(F.col("_m.m").alias(member), subject, mark.alias(name))


def with_child_count(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, name: str) -> DataFrame:
    """Number of children of each parent, 0 without any: one grouped count instead of a query for each row."""
    counts = child.groupBy(F.col(child_key).alias("_key")).agg(F.count("*").alias(name))
    return parent.join(counts, F.col(parent_key) == F.col("_key"), "left").drop("_key").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def accepted(batch: DataFrame, existing: DataFrame, keys: list[list[str]], order: list[str]) -> DataFrame:
    """batch with `reason`: null for rows to insert; `exists: k` where a key is in the table, `repeated: k` where an earlier row of the batch has it.

    A null key is no conflict. Repeats count among rows that don't exist yet. Ties of the order are for the caller to exclude.
    """
    reason = F.lit(None).cast("string")
    out = batch
    for i, key in enumerate(keys):
        there = existing.select(*[F.col(k).alias(f"_k{i}_{k}") for k in key]).dropna().distinct().withColumn(f"_there{i}", F.lit(True))
        condition = [F.col(k) == F.col(f"_k{i}_{k}") for k in key]
        out = out.join(there, condition, "left")
        reason = F.coalesce(reason, F.when(F.col(f"_there{i}"), F.lit("exists: " + ",".join(key))))
    out = out.withColumn("_exists", reason).select(*batch.columns, "_exists")
    reason = F.col("_exists")
    for i, key in enumerate(keys):
        whole = F.lit(True)
        for k in key:
            whole = whole & F.col(k).isNotNull()
        first = F.row_number().over(Window.partitionBy(*key, F.col("_exists").isNull()).orderBy(*order))
        out = out.withColumn(f"_first{i}", first)
        reason = F.coalesce(reason, F.when((F.col(f"_first{i}") > 1) & whole, F.lit("repeated: " + ",".join(key))))
    return out.withColumn("reason", reason).select(*batch.columns, "reason")


def preview(text: Column, n: int = 50) -> Column:
    """The first n characters, with dots where more follow."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def ago(at: Column, now: Column) -> Column:
    """`2 days ago`, `1 hour ago`, `5 minutes ago` or `Just now`; now is given, so results repeat."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(at)

    def unit(size: int, name: str) -> Column:
        n = F.floor(seconds / size)
        return F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago"))

    return F.when(seconds >= 86400, unit(86400, "day")).when(seconds >= 3600, unit(3600, "hour")).when(seconds >= 60, unit(60, "minute")).otherwise(F.lit("Just now"))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum(weight * value) / sum(weight), 0 where the weights sum to 0."""
    return F.coalesce(F.try_divide(F.sum(value * weight), F.sum(weight)), F.lit(0.0))


def full_aligned(left: DataFrame, right: DataFrame, keys: list[str], value: str, names: tuple[str, str], order: str) -> DataFrame:
    """Full outer join by key; of rows that repeat a key the last by `order` counts."""
    sides = [side.groupBy(*keys).agg(F.max_by(value, order).alias(name)) for side, name in zip((left, right), names, strict=True)]
    return sides[0].join(sides[1], keys, "full_outer")


def running_pairs(df: DataFrame, keys: list[str], value: str) -> Column:
    """The step from the row before, in the order of the value."""
    return F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(value))
