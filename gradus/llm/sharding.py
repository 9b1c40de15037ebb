"""Shards of a growing table: small immutable arrivals, size-tiered compaction and versioned manifests."""

from __future__ import annotations

import json
import math
import uuid
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh

#: Files that one merging pass takes at most: their names are broadcast (about 200 bytes each). The rest follow in further passes.
FILES_A_PASS = 50_000
ENTRY = "path string, bytes long, n_rows long, checksum long, tier int"


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class Shards:
    """A table of immutable Parquet shards below `root`, a folder that driver and executors share.

    A manifest is a table of the live shards (path, bytes, n_rows, checksum, tier). Version n is committed by renaming one
    small file to versions/n.json, which fails if it is there: readers see a version whole or not at all, and of two
    writers one gets Conflict and may begin anew. Old shards and manifests stay, so readers of old versions go on.

    Rows are kept as they are, with nulls, empty and very long texts, ties and repeats; columns may have any names, _metadata included, but can't be
    maps, which have no hash. An arrival without rows commits a version with the same shards; compacting an empty table does nothing.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 64 << 20, fan: int = 4, rows_a_shard: int = 1000):
        self.spark, self.root, self.target, self.fan, self.rows = spark, root.rstrip("/"), target_bytes, fan, rows_a_shard

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        conf = self.spark._jsc.hadoopConfiguration()
        return self._path("versions").getFileSystem(conf)

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        fs, at = self._files(), self._path("versions")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], ENTRY)
        place = self.spark.read.text(f"{self.root}/versions/{version:09d}.json").first()[0]
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/{json.loads(place)['manifest']}")

    def _commit(self, entries: DataFrame, base: int) -> int:
        name = f"manifests/{uuid.uuid4().hex}"
        entries.coalesce(1 + entries.count() // 1_000_000).write.parquet(f"{self.root}/{name}")
        jvm, fs = self.spark._jvm, self._files()
        fs.mkdirs(self._path("versions"))
        draft, final = self._path(f"versions/_{uuid.uuid4().hex}"), self._path(f"versions/{base + 1:09d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": base + 1, "manifest": name}).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Exception as e:
            raise Conflict(f"version {base + 1} is there already") from e
        return base + 1

    def _write(self, df: DataFrame, rows_a_file: int = 0) -> DataFrame:
        """Writes new shards, of so many rows at most (0: of any number, whatever the session says); returns their entries, read back from the files."""
        place = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(place)
        return self._entries(self.spark.read.schema(df.schema).parquet(place))

    def _entries(self, df: DataFrame) -> DataFrame:
        row, file = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), df.metadataColumn("_metadata")
        found = df.select(file.getField("file_path").alias("path"), file.getField("file_size").alias("bytes"), row.alias("row"))
        found = found.groupBy("path", "bytes").agg(F.count("*").alias("n_rows"), F.bit_xor("row").alias("checksum"))
        tier = F.greatest(F.lit(0), F.floor(F.log(F.col("bytes") / 65536) / math.log(self.fan))).cast("int")
        return found.withColumn("tier", tier)

    def append(self, df: DataFrame) -> int:
        """Adds an arrival as small shards, without a shuffle, and commits; an arrival without rows adds no shard."""
        base = self.version()
        return self._commit(self.manifest(base).unionByName(self._write(df, self.rows)), base)

    def merges(self, entries: DataFrame) -> DataFrame:
        """(path, merge) of shards to merge: those of a tier, packed by size up to the target; a lone shard and one of half the target stay."""
        small = entries.filter(F.col("bytes") < self.target // 2)
        sums = small.groupBy("tier").agg(F.sum("bytes").alias("tier_bytes"), F.count("*").alias("shards")).filter("shards > 1")
        lanes = F.ceil(F.col("tier_bytes") / (64 * self.target))
        by = Window.partitionBy("tier", "lane")
        packed = (
            small.join(sums, "tier")
            .withColumn("lane", F.pmod(F.xxhash64("path"), lanes))
            .withColumn("bin", F.floor((F.sum("bytes").over(by.orderBy("bytes", "path").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1) / self.target))
        )
        size = F.count("*").over(Window.partitionBy("tier", "lane", "bin"))
        return packed.withColumn("size", size).filter("size > 1").select("path", F.concat_ws("-", "tier", "lane", "bin").alias("merge"))

    def compact(self, schema) -> int:
        """Merges similarly sized shards into files of about the target size and commits; returns the version (the same if there is nothing to merge).

        Rows and checksums of merged files are compared with those of their inputs before the commit. A pass takes whole
        merges of FILES_A_PASS files at most; passes follow until no tier has two small shards to pack.
        """
        while True:
            base = self.version()
            entries = self.manifest(base)
            chosen = self.merges(entries).orderBy("merge", "path").limit(FILES_A_PASS).collect()
            names = sorted({r["merge"] for r in chosen})
            if len(chosen) == FILES_A_PASS and len(names) > 1:
                names = names[:-1]
            number = {name: i for i, name in enumerate(names)}
            pairs = [(r["path"], number[r["merge"]]) for r in chosen if r["merge"] in number]
            if not pairs:
                return base
            group = F.broadcast(self.spark.createDataFrame(pairs, "path string, _merge int"))
            rows = self.spark.read.schema(schema).parquet(*[p for p, _ in pairs])
            place, merge = fresh(rows, "_place"), fresh(rows, "_merge")
            merged = rows.withColumn(place, rows.metadataColumn("_metadata").getField("file_path")).join(group.toDF(place, merge), place).repartitionById(len(names), F.col(merge))
            new = self._write(merged.select([F.col(f"`{c}`") for c in rows.columns]))
            old = entries.join(group, "path", "left_semi")
            total = [F.coalesce(F.sum("n_rows"), F.lit(0)), F.coalesce(F.bit_xor("checksum"), F.lit(0))]
            if tuple(new.agg(*total).first()) != tuple(old.agg(*total).first()):
                raise RuntimeError("merged shards differ from their inputs")
            self._commit(entries.join(group, "path", "left_anti").unionByName(new), base)

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version's live shards, with the shard's path as _shard. Shards are named to Spark in pages of FILES_A_PASS; its own list of files is all that the driver holds of them."""
        paths = (r["path"] for r in self.manifest(version).select("path").toLocalIterator())
        found = None
        while page := list(islice(paths, FILES_A_PASS)):
            rows = self.spark.read.schema(schema).parquet(*page)
            rows = rows.withColumn("_shard", rows.metadataColumn("_metadata").getField("file_path"))
            found = rows if found is None else found.unionByName(rows)
        return self.spark.createDataFrame([], schema).withColumn("_shard", F.lit(None).cast("string")) if found is None else found
