"""Log lines as a stream into an index: each line once, whatever batches are killed and run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import _folder


def tail_ndjson(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """New files of JSON lines under ``path`` as a stream of (file, line, document, fields); blank lines are left out.

    A line that isn't JSON comes with null fields, so that the sink can keep it apart.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_a_batch).load(path).filter(F.trim("value") != "")
    parsed = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), F.from_json("value", schema).alias("_j"), F.try_parse_json("value").isNotNull().alias("valid"))
    return parsed.select("file", "line", "valid", "_j.*")


class IndexSink:
    """Writes a micro-batch to folders of its number under ``path``: documents by index name, and lines that aren't JSON.

    A batch is staged and renamed whole; one that is run again finds its folder and changes nothing, and what a killed one
    left behind is overwritten.  Readers see renamed folders only.
    """

    def __init__(self, path: str, index: str) -> None:
        self.path, self.index = path.rstrip("/"), index

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = f"{self.path}/batch={number}"
        fs, target = _folder(spark, done)
        if fs.exists(target):
            return
        staged = f"{self.path}/_staged-{number}"
        named = batch.withColumn("index", F.when(F.col("valid"), F.expr(self.index)).otherwise("_bad")).drop("valid")
        named.write.mode("overwrite").partitionBy("index").parquet(staged)
        if not fs.rename(_folder(spark, staged)[1], target):
            raise OSError(f"{staged} wasn't renamed")


def read_index(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The documents of an index, or of all but the bad lines, with the batch that brought them."""
    rows = spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/batch=*")
    return rows.filter(F.col("index") == name) if name else rows.filter("index != '_bad'")
