"""Every registered query of the library against its SQL on the small tables."""

import math

import duckdb
import pytest
from gradus import plans

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") and v.tzinfo else v


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, small, con, name):
    want = con.sql(plans.oracle_sql()[name])
    got = plans.queries()[name](spark, small)
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(map(plain, r)) for r in got.select(want.columns).collect()]
    assert sorted(rows, key=repr) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_runs(spark, small, name):
    assert plans.queries()[name](spark, small).count() > 0


def test_filters_reach_the_scan(spark, small):
    plan = plans.queries()["unknown_filter_ignored"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan and "o_totalprice" not in plan


def test_top_per_group_limits_before_the_shuffle(spark, small):
    assert "WindowGroupLimit" in plans.queries()["latest_message"](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_subjects_and_members_are_marked_without_a_shuffle_of_pairs(spark):
    from gradus.operators import relational as R

    subjects = spark.createDataFrame([(1, 10), (1, 10), (2, 20), (None, 30), (1, None)], "g int, s int")
    members = spark.createDataFrame([(1, 5), (1, 6), (1, 6), (2, 7), (1, None), (None, 8)], "g int, m int")
    other = spark.createDataFrame([(10, 6), (10, 6), (20, 5), (None, 5), (10, None)], "s int, m int")
    x = R.marked_pairs(subjects, members, other, "g", "s", "m", "here")
    got = sorted((tuple(r) for r in x.collect()), key=repr)
    want = [(m, s, s == 10 and m == 6) for g, s in [(1, 10), (1, 10), (2, 20), (1, None)] for h, m in [(1, 5), (1, 6), (1, 6), (2, 7), (1, None)] if g == h]
    assert got == sorted(want, key=repr)
    marked = [line for line in x._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode(_members" in line or "array_contains" in line]
    assert marked and "Join" not in "".join(marked)


def test_pairs_of_subjects_and_members_are_stored_in_little_space(spark, tmp_path):
    """Where a subject met all members in turn, a pair took 1.5 bytes and more, and the result outgrew the disk."""
    from gradus.operators import relational as R
    from pyspark.sql import functions as F

    subjects = spark.range(3001).select((F.col("id") % 3).alias("g"), F.col("id").alias("s"))
    members = spark.range(1111).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919).alias("m"))
    other = spark.range(20_000).select((F.col("id") * 31 % 3001).alias("s"), (F.col("id") * 17 % 1111 * 7919).alias("m"))
    R.marked_pairs(subjects, members, other, "g", "s", "m", "here").write.parquet(f"{tmp_path}/pairs")
    x = spark.read.parquet(f"{tmp_path}/pairs")
    taught = other.distinct().filter("s % 3 = m DIV 7919 % 3").count()
    n = sum(sum(1 for j in range(1111) if j % 3 == i % 3) for i in range(3001))
    assert (x.count(), x.distinct().count(), x.filter("here").count()) == (n, n, taught)
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.7 * n
