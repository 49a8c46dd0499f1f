"""Joins between catalogue tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.functions.text import filled


def new_files(inventory: DataFrame, catalogue: DataFrame, key: str, force: bool = False) -> DataFrame:
    """JN-1: files whose key isn't in the catalogue; all of them if forced."""
    return inventory if force else inventory.join(catalogue.select(key), key, "left_anti")


def orphans(catalogue: DataFrame, files: DataFrame, absolute: str, relative: str, base: str) -> DataFrame:
    """JN-2: catalogue rows of which neither the absolute path nor base/relative exists; two equi joins, one after the other."""
    there = files.select(F.col("path").alias("__there")).distinct()
    left = catalogue.join(there, F.col(absolute) == F.col("__there"), "left_anti")
    return left.join(there, F.concat(F.lit(base.rstrip("/") + "/"), F.col(relative)) == F.col("__there"), "left_anti")


def without(df: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    """JN-3: rows whose key isn't in the delete list."""
    return df.join(gone.select(F.col(gone_key or key).alias("__gone")).distinct(), F.col(key) == F.col("__gone"), "left_anti")


def metadata_overlay(base: DataFrame, curated: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """JN-7: curated values before the base's, field by field; empty text counts as absent."""
    over = curated.select(key, *(F.col(c).alias(f"__new_{c}") for c in columns))
    joined = base.join(over, key, "left")
    return joined.select(*(F.coalesce(filled(F.col(f"__new_{c}")), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def image_details(images: DataFrame, faces: DataFrame, clusters: DataFrame, pairs: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """JN-8: each image with its faces (id, name by label, else cluster) in order of id.

    With ``pairs`` (recto_path, verso_path; one pair per path at most) and images that have file_path also sheet_role (recto, verso or null) and companion_path; with ``texts`` (file_path, ocr_text) also its own
    ocr_text and, with both, the companion's companion_text.
    """
    named = faces.join(clusters.select(F.col("id").alias("cluster_id"), F.col("name").alias("cluster_name")), "cluster_id", "left")
    name = F.coalesce(filled(F.col("label")), filled(F.col("cluster_name")))
    each = named.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("face_id", name.alias("name")))).alias("faces"))
    out = images.join(each, "image_id", "left").withColumn("faces_count", F.coalesce(F.size("faces"), F.lit(0)))
    if pairs is not None:
        side = lambda own, other, role: pairs.select(F.col(own).alias("file_path"), F.lit(role).alias("sheet_role"), F.col(other).alias("companion_path"))
        out = out.join(side("recto_path", "verso_path", "recto").unionByName(side("verso_path", "recto_path", "verso")), "file_path", "left")
    if texts is not None:
        out = out.join(texts.select("file_path", "ocr_text"), "file_path", "left")
        if pairs is not None:
            out = out.join(texts.select(F.col("file_path").alias("companion_path"), F.col("ocr_text").alias("companion_text")), "companion_path", "left")
    return out


def label_fallback(faces: DataFrame, clusters: DataFrame) -> DataFrame:
    """JN-12: adds ``name``: the face's label, else the name of its cluster."""
    names = clusters.select(F.col("id").alias("cluster_id"), F.col("name").alias("__cluster_name"))
    return faces.join(names, "cluster_id", "left").withColumn("name", F.coalesce(filled(F.col("label")), filled(F.col("__cluster_name")))).drop("__cluster_name")


def shared_images(faces: DataFrame, first: str, second: str) -> DataFrame:
    """JN-11, SET-4: images that show both persons."""
    of = lambda who: faces.where(F.col("label") == who).select("image_id").distinct()
    return of(first).join(of(second), "image_id", "left_semi")


def two_sided_info(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """JN-5: notes from the recto, else the verso, and both sides' texts. ``sides`` has file_path, notes and ocr_text."""
    side = lambda p: sides.select(F.col("file_path").alias(f"{p}_path"), F.col("notes").alias(f"{p}_notes"), F.col("ocr_text").alias(f"{p}_text"))
    joined = pairs.join(side("recto"), "recto_path", "left").join(side("verso"), "verso_path", "left")
    return joined.withColumn("notes", F.coalesce(filled(F.col("recto_notes")), filled(F.col("verso_notes")))).drop("recto_notes", "verso_notes")


def verso_to_recto(hits: DataFrame, pairs: DataFrame, score: float = 0.89) -> DataFrame:
    """JN-6: a hit on a verso makes its recto a hit with a fixed score, unless the recto is one already."""
    moved = hits.join(pairs.select(F.col("verso_path").alias("file_path"), "recto_path"), "file_path").select(F.col("recto_path").alias("file_path"), F.lit(score).alias("score")).distinct()
    fresh = moved.join(hits.select("file_path"), "file_path", "left_anti")
    return hits.select("file_path", "score").unionByName(fresh)


def representatives(items: DataFrame, group: str, id_col: str = "id") -> DataFrame:
    """WIN-1: the item of each group with most pixels (width, height; null counts as 0), of equal ones that with the least id."""
    return best_by(items, [group], [F.desc(pixels()), F.col(id_col)])


def pixels() -> Column:
    return F.coalesce(F.col("width").cast("long") * F.col("height"), F.lit(0))


def best_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")
