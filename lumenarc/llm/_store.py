"""Where operators put intermediate tables: always the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenarc.session import reachable


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset (tests), a temporary one of this process."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = tempfile.mkdtemp(prefix="lumenarc-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; Spark's cleaner removes it when unused."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_below(df: DataFrame, rows: int, limit: int):
    """Hint a broadcast only where the counted rows are within the limit; beyond it Spark shuffles both sides."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows <= limit else df


def join_around_hot(left: DataFrame, right: DataFrame, key: str, hot, limit: int) -> DataFrame:
    """Inner join on ``key``, unique in ``right``: keys that ``hot`` (a condition on ``right``) marks as having many rows in ``left`` are joined
    by a broadcast within ``limit`` rows, so that none of them is one task's, and the others by a shuffle."""
    some = cut(right.where(hot))
    n = some.count()
    if not n:
        return left.join(right, key)
    some = broadcast_below(some, n, limit)
    others = left.join(some.select(key), key, "left_anti").join(right.where(~hot), key)
    return left.join(some, key).unionByName(others)


def limit_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes as well as by rows, so that very long texts don't add up in one batch; and workers find this package."""
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
