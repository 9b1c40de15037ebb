"""Sources and sinks: tables by name, result documents, files, exports and a versioned result store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.operators.relational import latest

#: Extensions that are taken, the largest file in bytes, and MIME types by extension.
EXTENSIONS = [".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".txt"]
MAX_BYTES = 100 * 1024 * 1024
MIME = {".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".txt": "text/plain"}

#: A stored evaluation result; files may span lines.
RESULT = T.StructType([
    T.StructField("evaluation_id", T.StringType()),
    T.StructField("final_score", T.DoubleType()),
    T.StructField("max_marks", T.IntegerType()),
    T.StructField("obtained_marks", T.DoubleType()),
    T.StructField("grade", T.StringType()),
    T.StructField("explanation", T.StringType()),
    T.StructField("suggestions", T.ArrayType(T.StringType())),
    T.StructField("processing_time", T.DoubleType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("saved_at", T.StringType()),
    T.StructField("concepts", T.StructType([T.StructField("matched", T.ArrayType(T.StringType())), T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("coverage_percentage", T.DoubleType())])),
])


def table(spark: SparkSession, place: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{place}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes in fewer than half as many parts, as a small file does; large tables stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def results(spark: SparkSession, place: str) -> DataFrame:
    """All result documents of a folder, by one schema; fields that a document lacks are null."""
    return spark.read.schema(RESULT).option("multiLine", True).option("mode", "PERMISSIVE").json(place)


def result(spark: SparkSession, place: str, evaluation_id: str) -> DataFrame:
    return results(spark, place).filter(F.col("evaluation_id") == evaluation_id).limit(1)


class ResultStore:
    """Results by id, appended and never rewritten: of a key's versions the last saved counts, and a deletion is a version too."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place

    def save(self, df: DataFrame, saved_at: Column) -> None:
        df.withColumns({"saved_at": saved_at.cast("timestamp"), "deleted": F.lit(False)}).write.mode("append").parquet(self.place)

    def delete(self, ids: DataFrame, saved_at: Column) -> None:
        """ids: evaluation_id of the results to delete."""
        schema = self.spark.read.parquet(self.place).schema
        gone = ids.select("evaluation_id").withColumns({"saved_at": saved_at.cast("timestamp"), "deleted": F.lit(True)})
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in gone.columns]
        gone.select("*", *rest).select(schema.names).write.mode("append").parquet(self.place)

    def load(self) -> DataFrame:
        return latest(self.spark.read.parquet(self.place), ["evaluation_id"], ["saved_at", "deleted"]).filter("NOT deleted").drop("deleted")


def export_csv(df: DataFrame, place: str, columns: list[str]) -> None:
    """The columns with a header, quoted where needed."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(place)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def mime(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("application/octet-stream"))


def files(spark: SparkSession, place: str) -> DataFrame:
    """Files that are taken, with checksum and MIME type: (path, bytes, modified, mime, checksum, content)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(place)
    ok = extension(F.col("path")).isin(EXTENSIONS) & (F.col("length") <= MAX_BYTES)
    return found.filter(ok).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), mime(F.col("path")).alias("mime"), F.sha2("content", 256).alias("checksum"), "content")


def language_of_path(path: Column, default: str = "en") -> Column:
    """A language that the file's name mentions."""
    low = F.lower(path)
    return F.when(low.rlike("hindi|_hi[_.]"), "hi").when(low.rlike("french|_fr[_.]"), "fr").when(low.rlike("german|_de[_.]"), "de").otherwise(default)
