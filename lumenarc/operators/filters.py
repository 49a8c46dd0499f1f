"""Row filters over catalogue tables. All are plain predicates, so that Spark can push them into scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.functions.text import EPOCHS


def in_batch(import_id: Column, batch: str, legacy: str = "legacy") -> Column:
    """FLT-1: exact batch; the legacy batch also takes null and empty."""
    return F.coalesce(F.nullif(import_id, F.lit("")), F.lit(legacy)) == batch


def contains(column: Column, text: str) -> Column:
    """Literal substring without case."""
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lower(F.lit(text)))


def match_facets(df: DataFrame, year: Column | None = None, year_from: int | None = None, year_to: int | None = None, signature: str | None = None,
                 creator: str | None = None, batch: str | None = None, epoch: str | None = None) -> DataFrame:
    """FLT-2: all given facets hold. Years are inclusive and a row without a year fails a year range; explicit years win over the epoch's."""
    if epoch:
        spans = {name: (a, b) for name, a, b in EPOCHS}
        year_from, year_to = year_from if year_from is not None else spans[epoch][0], year_to if year_to is not None else spans[epoch][1]
    if batch is not None:
        df = df.where(in_batch(F.col("import_id"), batch))
    if year_from is not None:
        df = df.where(year >= year_from)
    if year_to is not None:
        df = df.where(year <= year_to)
    if signature:
        df = df.where(contains(F.col("signature"), signature))
    if creator:
        df = df.where(contains(F.col("creator"), creator))
    return df


def search_metadata(df: DataFrame, query: str, columns: Sequence[str], order: Sequence[Column], batch: str | None = None, limit: int = 50) -> DataFrame:
    """FLT-3: the query in any of the columns, newest first. Matching is literal and folds case in Unicode."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | contains(F.col(c), query)
    df = df.where(hit)
    if batch is not None:
        df = df.where(in_batch(F.col("import_id"), batch))
    return df.orderBy(*order).limit(limit)


def search_clusters(clusters: DataFrame, query: str) -> DataFrame:
    """FLT-4: query in name or notes, by name."""
    return clusters.where(contains(F.col("name"), query) | contains(F.col("notes"), query)).orderBy("name", "id")


def reading_room_faces(faces: DataFrame) -> DataFrame:
    """FLT-5: what a viewer sees: verified faces."""
    return faces.where("curation_status = 'VERIFIED'")


def reading_room_clusters(clusters: DataFrame) -> DataFrame:
    """FLT-5: what a viewer sees: clusters with a name other than Person #n."""
    return clusters.where((F.coalesce(F.trim("name"), F.lit("")) != "") & ~F.col("name").startswith("Person #"))


def split_oversize(df: DataFrame, width: Column, height: Column, max_pixels: int) -> DataFrame:
    """FLT-6: adds ``rejected``: whether the image has more pixels than allowed (a null size passes)."""
    return df.withColumn("rejected", F.coalesce(width.cast("long") * height.cast("long") > max_pixels, F.lit(False)))


def under_folder(path: Column, folder: str) -> Column:
    """FLT-7: inside a folder; /a doesn't take /ab."""
    return path.startswith(folder.rstrip("/") + "/")


def lookup(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """FLT-8: rows of the given keys; a missing key gives no row."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def cluster_list(clusters: DataFrame, text: str = "", named: bool | None = None, limit: int | None = None) -> DataFrame:
    """FLT-9: named or unnamed clusters whose name or id (also written #n) holds the text."""
    blank = F.coalesce(F.trim("name"), F.lit("")) == ""
    if named is not None:
        clusters = clusters.where(~blank if named else blank)
    if text:
        number = text.lstrip("#")
        clusters = clusters.where(contains(F.col("name"), text) | contains(F.col("id"), text) | (contains(F.col("id"), f"cluster_{number}") if text.startswith("#") else F.lit(False)))
    clusters = clusters.orderBy("id")
    return clusters.limit(limit) if limit else clusters


def epochs(spark) -> DataFrame:
    """PRJ-6: the named spans of years as a table of five rows."""
    return spark.createDataFrame(list(EPOCHS), "epoch string, year_from int, year_to int")


def with_epochs(df: DataFrame, year: str) -> DataFrame:
    """PRJ-6: one row per item and epoch that holds its year; a year may lie in two."""
    spans = epochs(df.sparkSession)
    return df.join(F.broadcast(spans), F.col(year).between(F.col("year_from"), F.col("year_to")))
