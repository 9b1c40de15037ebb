"""Cases kept up to date from a stream of status requests, and files read once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What is remembered of a case: the last request, the last that resolves and the last that escalates, by their order, and how many there were.
STATE = "last long, status string, resolved long, resolution string, resolved_at timestamp, resolved_by string, escalated long, escalated_at timestamp, changes long, seen timestamp"


class _Cases(StatefulProcessor):
    """State of one case. Requests may come in any order and in any batches: each part of the state keeps the request of the greatest order, so late ones change only what they should."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.case = handle.getValueState("case", STATE)

    @staticmethod
    def _row(key: tuple, s: tuple, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "status": [s[1]], "resolution": [s[3]], "resolved_at": [s[4]], "resolved_by": [s[5]], "escalated_at": [s[7]], "changes": [s[8]], "closed": [closed]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        s = list(self.case.get()) if self.case.exists() else [None, None, None, None, None, None, None, None, 0, None]
        before = s[9]
        for r in (r for part in rows for r in part.itertuples(index=False)):
            at = None if pd.isna(r.at) else pd.Timestamp(r.at).to_pydatetime()
            if s[0] is None or r.order > s[0]:
                s[0], s[1] = int(r.order), r.status
            if r.status == "resolved" and (s[2] is None or r.order > s[2]):
                s[2:6] = [int(r.order), r.note, at, r.role]
            if r.status == "escalated" and (s[6] is None or r.order > s[6]):
                s[6:8] = [int(r.order), at]
            s[8] += 1
            s[9] = at if s[9] is None or (at is not None and at > s[9]) else s[9]
        self.case.update(tuple(s))
        if self.idle_ms is not None and s[9] is not None and s[9] != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(pd.Timestamp(s[9], tz="UTC").timestamp() * 1000) + self.idle_ms)
        yield self._row(key, tuple(s), False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.case.exists():
            row = self._row(key, tuple(self.case.get()), True)
            self.case.clear()
            yield row

    def close(self) -> None:
        pass


def stream_transitions(requests: DataFrame, key: str, order: str, statuses: list[str], at: str = "at", note: str = "note", late: str | None = None, idle: int | None = None) -> DataFrame:
    """operators.records.transitions() on a stream: (key, status, resolution, resolved_at, resolved_by, escalated_at, changes, closed), a row for each case whenever a batch changes it.

    However requests are split into batches, and in whatever order they come, a case's last row is what transitions() gives for all of them. With `late` (how long requests may come late) and `idle`
    (seconds), a case without a request for so long in event time is reported once more, closed, and forgotten; a request after that begins it anew. Requests with an unknown status, a
    null key or a null order are ignored. State is kept in RocksDB, which spark.sql.streaming.stateStore.providerClass must name.
    """
    valid = requests.filter(F.col("status").isin(statuses) & F.col(key).isNotNull() & F.col(order).isNotNull())
    rows = valid.select(F.col(key).alias("key"), F.col(order).cast("long").alias("order"), "status", "role", F.col(at).cast("timestamp").alias("at"), F.col(note).cast("string").alias("note"))
    timed = idle is not None
    if timed:
        rows = rows.withWatermark("at", late or "0 seconds")
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *T.StructType.fromDDL("status string, resolution string, resolved_at timestamp, resolved_by string, escalated_at timestamp, changes long, closed boolean").fields])
    made = rows.groupBy("key").transformWithStateInPandas(_Cases(idle * 1000 if timed else None), outputStructType=schema, outputMode="Update", timeMode="EventTime" if timed else "None")
    return made.withColumnRenamed("key", key)


def kept(changed: DataFrame, place: str, checkpoint: str):
    """Starts writing what changes to `place`, a folder for each batch, so that a batch that is done again replaces itself; `latest_cases` reads it. What there is now is read, then the stream ends."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{place}/{number:012d}")

    return changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest_cases(spark, place: str, key: str, schema: T.StructType) -> DataFrame:
    """The last row of each case that kept() wrote. Within a batch a closing row comes after the others of its case."""
    rows = spark.read.schema(schema.add("batch", "long")).parquet(f"{place}/*")
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("batch", "closed")).alias("r")).select(key, "r.*")


def extracted_once(spark, folder: str, memo: str, checkpoint: str, text: Column, limit: int | None = None):
    """Starts reading the new files of a folder into the memo (checksum, path, bytes, text, batch), each content once, then ends.

    text: of the binary column `content`. A file that was read before isn't opened again, as the checkpoint knows its path. A file whose content is in the memo already adds no row, so copies, and files written again
    unchanged, cost a checksum only; of equal contents of one batch the first path stays. A changed file under its old path is not seen again by file streams: it needs a new name, as uploads get.
    Each batch has a folder of its own in the memo and replaces it when it is done again; what earlier batches hold decides what is new, so nothing is added twice. `limit`: files of a batch at most.
    """
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if limit:
        source = source.option("maxFilesPerTrigger", limit)
    schema = "checksum string, path string, bytes long, text string, batch long"

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        found = batch.select(F.sha2("content", 256).alias("checksum"), "path", F.col("length").alias("bytes"), "content")
        new = found.groupBy("checksum").agg(F.min_by(F.struct("path", "bytes", "content"), "path").alias("f")).select("checksum", "f.*")
        before = session.read.schema(schema).parquet(f"{memo}/*").filter(F.col("batch") < number) if number else session.createDataFrame([], schema)
        new = new.join(before.select("checksum"), "checksum", "left_anti")
        new.select("checksum", "path", "bytes", text.alias("text"), F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{memo}/{number:012d}")

    return source.load(folder).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).queryName(f"memo-{uuid.uuid4().hex}").start()
