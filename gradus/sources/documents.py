"""Result documents as a data source: one file an id, so that a filter on the id opens those files alone."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .tables import RESULT

#: Files of a partition.
FILES = 64


@dataclass
class Files(InputPartition):
    names: list[str]


def plain(value, kind: T.DataType):
    """A JSON value as this type; null where it isn't one."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(plain(value.get(f.name), f.dataType) for f in kind) if isinstance(value, dict) else None
    if isinstance(kind, T.ArrayType):
        return [plain(x, kind.elementType) for x in value] if isinstance(value, list) else None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    return float(value) if isinstance(kind, T.DoubleType) else int(value) if float(value).is_integer() else None


class Reader(DataSourceReader):
    def __init__(self, place: str, schema: T.StructType):
        self.place, self.schema, self.ids = place, schema, None

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.place) if "://" in self.place or self.place.startswith("file:") else (fs.LocalFileSystem(), self.place)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = self._files()
        if self.ids is not None:
            wanted = sorted(f"{root.rstrip('/')}/{i}.json" for i in self.ids if isinstance(i, str) and "/" not in i)
            names = [x.path for x in store.get_file_info(wanted) if x.type == fs.FileType.File]
        else:
            names = sorted(x.path for x in store.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File and x.path.endswith(".json"))
        return [Files(names[i : i + FILES]) for i in range(0, len(names), FILES)]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = self._files()
        for name in partition.names:
            with store.open_input_stream(name) as f:
                raw = f.read()
            try:
                found = json.loads(raw)
            except ValueError:
                found = {}
            yield plain(found if isinstance(found, dict) else {}, self.schema)


class Lookup(Reader):
    """A reader that filters reach."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on the id choose files; all are still checked against what the files say."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("evaluation_id",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = own if self.ids is None else self.ids & own
            yield f


class ResultDocuments(DataSource):
    """format("result_documents").load(folder): a row for each <id>.json, fields that it lacks are null; a file that is no JSON object is a row of nulls."""

    @classmethod
    def name(cls) -> str:
        return "result_documents"

    def schema(self) -> T.StructType:
        return RESULT

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (Lookup if self.options.get("lookup") == "true" else Reader)(self.options["path"], schema)


def documents(spark: SparkSession, place: str) -> DataFrame:
    """All result documents of a folder. Filters on the id reach the source where spark.sql.python.filterPushdown.enabled is on; otherwise all files are read and then filtered."""
    spark.dataSource.register(ResultDocuments)
    return spark.read.format("result_documents").option("lookup", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load(place)


def saved(df: DataFrame, place: str) -> None:
    """Writes each row as <evaluation_id>.json, in the tasks that hold them; a row of an id that is there replaces its file. Of rows of one id in df one stays. Ids without a name (null or with a slash) are an error."""
    spare = Reader(place, df.schema)
    names = df.columns

    def write(rows) -> None:
        store, root = spare._files()
        for row in rows:
            if not row["evaluation_id"] or "/" in row["evaluation_id"]:
                raise ValueError("a result needs an id that can name a file")
            text = json.dumps({n: jsonable(row[n]) for n in names}, ensure_ascii=False)
            with store.open_output_stream(f"{root.rstrip('/')}/{row['evaluation_id']}.json") as f:
                f.write(text.encode())

    df.foreachPartition(write)


def jsonable(value):
    """Rows as objects, times as text, numbers that are not finite as null, as the sanitiser of results does, at any depth."""
    if isinstance(value, float):
        return value if value == value and abs(value) != float("inf") else None
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if hasattr(value, "asDict"):
        return {k: jsonable(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: jsonable(v) for k, v in value.items()}
    return [jsonable(v) for v in value] if isinstance(value, (list, tuple)) else value
