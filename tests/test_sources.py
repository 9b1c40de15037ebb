"""Sources, sinks and relational operators on hand-made rows."""

import json
from datetime import datetime

from gradus.operators import relational as R
from gradus.sources import tables as S
from pyspark.sql import functions as F


def test_result_documents(spark, tmp_path):
    for name, doc in {"a": {"evaluation_id": "a", "final_score": 0.5, "grade": "good"}, "b": {"evaluation_id": "b", "concepts": {"matched": ["x"]}}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
    got = {r.evaluation_id: r for r in S.results(spark, str(tmp_path)).collect()}
    assert got["a"].final_score == 0.5 and got["b"].grade is None and got["b"].concepts.matched == ["x"]
    assert S.result(spark, str(tmp_path), "a").count() == 1 and S.result(spark, str(tmp_path), "z").count() == 0


def test_result_store(spark, tmp_path):
    store = S.ResultStore(spark, f"file://{tmp_path}/r")
    at = lambda s: F.lit(f"2024-01-01 00:00:0{s}")
    frame = lambda rows: spark.createDataFrame(rows, "evaluation_id string, final_score double")
    store.save(frame([("a", 0.1), ("b", 0.2)]), at(1))
    store.save(frame([("a", 0.9)]), at(2))
    assert {(r.evaluation_id, r.final_score) for r in store.load().collect()} == {("a", 0.9), ("b", 0.2)}
    store.delete(frame([("b", 0.0)]), at(3))
    assert [r.evaluation_id for r in store.load().collect()] == ["a"]


def test_files_and_export(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("hello")
    (tmp_path / "in" / "two.exe").write_text("no")
    got = S.files(spark, str(tmp_path / "in")).collect()
    assert [(r.bytes, r.mime, r.checksum[:8]) for r in got] == [(5, "text/plain", "2cf24dba")]
    S.export_csv(spark.createDataFrame([("a,b", 1)], "x string, y int"), str(tmp_path / "out"), ["x", "y"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["x"] == "a,b"


def test_search_escapes_wildcards(spark):
    df = spark.createDataFrame([("50% off",), ("5000 off",), (None,)], "name string")
    assert R.filtered(df, search="0%", search_in=["name"]).count() == 1


def test_scopes(spark):
    df = spark.createDataFrame([(1, 9), (2, 1), (3, 3)], "owner int, helper int")
    count = lambda role: df.filter(R.visible(role, 1, "owner", "helper")).count()
    assert (count("admin"), count("teacher"), count("student")) == (3, 2, 1)


def test_labels_and_previews(spark):
    now = F.lit(datetime(2024, 1, 2))
    df = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 1, 22),), (datetime(2024, 1, 1, 23, 59),), (datetime(2024, 1, 1, 23, 59, 50),)], "at timestamp")
    assert [r[0] for r in df.select(R.ago(F.col("at"), now)).collect()] == ["1 day ago", "2 hours ago", "1 minute ago", "Just now"]
    text = spark.createDataFrame([("x" * 50,), ("x" * 51,), (None,), (" ",)], "t string")
    assert [r[0] for r in text.select(R.preview(F.col("t"))).collect()] == ["x" * 50, "x" * 50 + "...", None, " "]
    assert [r[0] for r in text.select(R.blank_to_null(F.col("t"))).collect()][3] is None


def test_accepted_rows(spark):
    batch = spark.createDataFrame([(1, "a", "r1"), (2, "a", "r2"), (3, None, "r3"), (4, None, "r3"), (5, "z", "r9")], "n int, email string, roll string")
    there = spark.createDataFrame([("z", "r7")], "email string, roll string")
    got = {r.n: r.reason for r in R.accepted(batch, there, [["email"], ["roll"]], ["n"]).collect()}
    assert got == {1: None, 2: "repeated: email", 3: None, 4: "repeated: roll", 5: "exists: email"}


def test_stream_equals_batch(spark, small, tmp_path):
    from gradus.streaming import daily

    events = spark.read.parquet(f"{small}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = daily.counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, daily.counts(events).collect()))


def test_documents_by_id_open_one_file(spark, tmp_path):
    from gradus.sources import documents as D
    from pyspark.sql.datasource import EqualTo, In

    rows = spark.createDataFrame([(f"id{i}", i / 10, ["a"], (["x"], None, float("nan"))) for i in range(200)] + [("inf", float("inf"), None, None)], "evaluation_id string, final_score double, suggestions array<string>, concepts struct<matched:array<string>,missing:array<string>,coverage_percentage:double>")
    D.saved(rows, str(tmp_path))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "other.txt").write_text("no document")
    assert D.documents(spark, str(tmp_path)).count() == 202
    reader = D.Lookup(str(tmp_path), S.RESULT)
    assert list(reader.pushFilters([EqualTo(("evaluation_id",), "id7")])) and [p.names for p in reader.partitions()] == [[f"{tmp_path}/id7.json"]]
    both = D.Lookup(str(tmp_path), S.RESULT)
    list(both.pushFilters([In(("evaluation_id",), ("id1", "id2", "none", "../x")), EqualTo(("final_score",), 0.1)]))
    assert sum(len(p.names) for p in both.partitions()) == 2 and sum(len(p.names) for p in D.Reader(str(tmp_path), S.RESULT).partitions()) == 202
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        found = D.documents(spark, f"file://{tmp_path}").filter("evaluation_id = 'id7'")
        one = found.first()
        assert (one.final_score, one.suggestions, one.concepts.matched, one.concepts.coverage_percentage, one.grade) == (0.7, ["a"], ["x"], None, None)
        assert found.rdd.getNumPartitions() == 1
        assert D.documents(spark, str(tmp_path)).filter("evaluation_id = 'broken'").count() == 0
        assert D.documents(spark, str(tmp_path)).filter("evaluation_id = 'inf'").first().final_score is None
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
