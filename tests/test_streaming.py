"""Streams: cases against the batch form whatever the split, restarts from the checkpoint, timers, files read once."""

import random

import pytest
from gradus.operators import records
from gradus.streaming import cases
from pyspark.sql import functions as F

STATUSES = ["open", "resolved", "escalated"]
REQUESTS = "id long, n long, status string, role string, at timestamp, note string"


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", cases.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def requests(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([1, 2, 3, None]), i, rng.choice([*STATUSES, "view", None]), rng.choice(["admin", "teacher"]), f"2024-01-01 00:{i % 60:02d}:00", f"note {i}") for i in range(n)]
    return spark.createDataFrame(rows, REQUESTS.replace("at timestamp", "at string")).withColumn("at", F.to_timestamp("at"))


def run(spark, tmp_path, name, **more):
    source = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    changed = cases.stream_transitions(source, "id", "n", STATUSES, **more)
    stream = cases.kept(changed, f"{tmp_path}/{name}-out", f"{tmp_path}/{name}-checkpoint")
    stream.awaitTermination(120)
    assert stream.exception() is None
    return cases.latest_cases(spark, f"{tmp_path}/{name}-out", "id", changed.schema)


def rows_of(df):
    names = ["id", "status", "resolution", "resolved_at", "resolved_by", "escalated_at", "changes"]
    return sorted(map(tuple, df.select(names).collect()))


@pytest.mark.parametrize("parts", [1, 4])
def test_any_split_gives_the_batch_result(spark, tmp_path, parts):
    df = requests(spark, 80)
    df.repartition(parts, F.hash("n") % parts).write.parquet(f"{tmp_path}/in")
    assert rows_of(run(spark, tmp_path, "in")) == rows_of(records.transitions(df.filter("id IS NOT NULL"), "id", "n", STATUSES))


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    df = requests(spark, 60)
    df.filter("n >= 30").coalesce(1).write.parquet(f"{tmp_path}/in")
    run(spark, tmp_path, "in")
    df.filter("n < 30").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert rows_of(run(spark, tmp_path, "in")) == rows_of(records.transitions(df.filter("id IS NOT NULL"), "id", "n", STATUSES))


def test_idle_cases_are_closed_and_forgotten(spark, tmp_path):
    at = lambda s: F.to_timestamp(F.lit(f"2024-01-01 {s}"))
    for k, (id_, n, s) in enumerate([(1, 1, "00:00:00"), (2, 2, "05:00:00"), (2, 3, "06:00:00"), (1, 4, "06:30:00")]):
        spark.range(1).select(F.lit(id_).cast("long").alias("id"), F.lit(n).cast("long").alias("n"), F.lit("open").alias("status"), F.lit("admin").alias("role"), at(s).alias("at"), F.lit("x").alias("note")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = run(spark, tmp_path, "in", late="10 minutes", idle=3600)
        got = {r.id: (r.changes, r.closed) for r in found.collect()}
        if k == 2:
            assert got[1] == (1, True) and got[2][0] == 2
    assert got[1] == (1, False) and got[2] == (2, False)


def test_files_are_extracted_once(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    text = F.upper(F.decode("content", "UTF-8"))

    def read():
        stream = cases.extracted_once(spark, f"file://{folder}", f"file://{tmp_path}/memo", f"file://{tmp_path}/checkpoint", text, limit=2)
        stream.awaitTermination(120)
        assert stream.exception() is None
        return sorted((r.path.rsplit("/", 1)[1], r.text) for r in spark.read.parquet(f"{tmp_path}/memo/*").collect()), [p["numInputRows"] for p in stream.recentProgress]

    for name, content in {"a": "one", "b": "two", "c": "one"}.items():
        (folder / name).write_text(content)
    first, seen = read()
    assert [t for _, t in first] in (["ONE", "TWO"], ["TWO", "ONE"]) and sum(seen) == 3
    (folder / "d").write_text("three")
    (folder / "e").write_text("two")
    second, seen = read()
    assert sorted(t for _, t in second) == ["ONE", "THREE", "TWO"] and sum(seen) == 2
    assert read()[0] == second
