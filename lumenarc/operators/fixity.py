"""Checks of stored digests against files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.functions.text import filled
from lumenarc.sources.digests import file_digests

BAD = ("CORRUPTED", "MISSING", "READ_ERROR")


def observed_files(spark, path: str, **options) -> DataFrame:
    """(file_path, size, sha256, error) of the files under a folder, of any size; sha256 is null where a file can't be read. See sources.digests for ``options``."""
    return file_digests(spark, path, **options)


def fixity_verify(catalogue: DataFrame, observed: DataFrame, checked_at: Column, initialise: bool = True) -> DataFrame:
    """FIX-1: (file_path, status, sha256, checked_at, outcome) per catalogue row.

    ``observed`` has file_path, sha256 (null if unreadable). Outcome is what the check counts: missing, corrupted (unreadable
    too), initialized (no stored digest: it becomes the baseline), intact, or unverified where no baseline may be set.
    """
    there = observed.select("file_path", F.col("sha256").alias("now"), F.lit(True).alias("there"))
    joined = catalogue.select("file_path", filled(F.col("sha256")).alias("stored")).join(there, "file_path", "left")
    first = F.col("stored").isNull()
    status = F.when(F.col("there").isNull(), "MISSING").when(F.col("now").isNull(), "READ_ERROR").when(first, F.lit("OK" if initialise else "UNVERIFIED")).when(F.col("stored") == F.col("now"), "OK").otherwise("CORRUPTED")
    joined = joined.withColumn("status", status)
    outcome = F.when(F.col("status") == "MISSING", "missing").when(F.col("status").isin("READ_ERROR", "CORRUPTED"), "corrupted").when(first & F.lit(initialise), "initialized").when(F.col("status") == "OK", "intact").otherwise("unverified")
    new = F.when(first & (F.col("status") == "OK"), F.col("now"))
    return joined.select("file_path", "status", new.alias("sha256"), checked_at.alias("checked_at"), outcome.alias("outcome"))


def fixity_alerts(checks: DataFrame) -> DataFrame:
    """Alert rows of the bad states."""
    return checks.where(F.col("status").isin(*BAD)).select(F.lit("FIXITY_BITROT_ALERT").alias("action"), F.lit("IMAGE").alias("target_type"), F.col("file_path").alias("target_id"), F.to_json(F.struct("status")).alias("details"))


def corrupted_list(table: DataFrame, limit: int) -> DataFrame:
    """TOP-10: rows in a bad state, newest check first."""
    return table.where(F.col("fixity_status").isin(*BAD)).orderBy(F.desc("last_fixity_check"), "file_path").limit(limit)
