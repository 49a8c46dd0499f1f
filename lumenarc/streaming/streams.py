"""Streams of new files and of check results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lumenarc.functions.keys import uuid5_image
from lumenarc.operators.fixity import BAD


#: Folders that ids are dealt into.
BUCKETS = 256
CATALOGUE = "id string, path string, size long, bucket int"


def known_ids(spark, catalogue_path: str, buckets: list[int], key: str = "id", kind: str = "string") -> DataFrame:
    """(key) of a catalogue's buckets; files of other buckets aren't read."""
    if not _exists(spark, catalogue_path):
        return spark.createDataFrame([], f"{key} {kind}")
    read = spark.read.schema(CATALOGUE if key == "id" else f"{key} {kind}, {CATALOGUE}").option("ignoreMissingFiles", "true").parquet(catalogue_path)
    return read.where(F.col("bucket").isin(buckets)).select(key)


def ingest_stream(files: DataFrame, catalogue_path: str, checkpoint: str, root: str, buckets: int = BUCKETS, key: str = "id") -> StreamingQuery:
    """STR-1: append each new file (path, size) once to a Parquet catalogue, across restarts; runs over what is there and ends.

    The catalogue is partitioned by ``bucket``, a hash of the id, which must stay as it was. A batch is joined against the ids that earlier batches wrote to the buckets it touches, so a batch that is run again after a
    failure adds nothing twice and a small batch reads a small part of a large catalogue. Where several entries share a path, ``key`` names the column that tells them apart instead of the id: see inventory.ingest().
    """
    spark = files.sparkSession
    relative = F.substring(F.col("path"), len(root.rstrip("/")) + 2, 1 << 20)
    own = ["id"] if key == "id" else [key, "id"]
    kind = "string" if key == "id" else files.schema[key].dataType.simpleString()

    def append(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("id", uuid5_image(relative)).dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
        keyed = keyed.select(*own, "path", "size", "bucket").persist()
        try:
            touched = [r.bucket for r in keyed.select("bucket").distinct().collect()]
            known = known_ids(spark, catalogue_path, touched, key, kind)
            keyed.join(known, key, "left_anti").repartition("bucket").write.mode("append").partitionBy("bucket").parquet(catalogue_path)
        finally:
            keyed.unpersist()

    return files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    """Whether the folder is there, asked of the file system that the path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def fixity_alert_stream(checks: DataFrame, delay: str = "1 day") -> DataFrame:
    """STR-2: one alert per path and bad state of a stream (file_path, status, checked_at), duplicates dropped within the watermark."""
    bad = checks.where(F.col("status").isin(*BAD)).withWatermark("checked_at", delay)
    return bad.dropDuplicatesWithinWatermark(["file_path", "status"]).select("file_path", "status", "checked_at")
