"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the namespace of image ids
ARCHIVE_NAMESPACE = "3d4b6845-816b-4e45-8b3c-9ad51b5bbfcb"


def uuid5(name: Column, namespace: str = ARCHIVE_NAMESPACE) -> Column:
    """UUID version 5 of a name, as text; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def uuid5_image(relative_path: Column) -> Column:
    return uuid5(relative_path)


def uuid5_face(relative_path: Column, face_index: Column) -> Column:
    return uuid5(F.concat(relative_path, F.lit("#face_"), face_index.cast("string")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def fallback_id(path: Column) -> Column:
    """Id of a hit without a vector: that of its file name."""
    return uuid5(base_name(path))


def norm_cluster_id(cluster: Column) -> Column:
    """Trimmed; plain digits become cluster_<digits>."""
    c = F.trim(cluster)
    return F.when(c.rlike("^[0-9]+$"), F.concat(F.lit("cluster_"), c)).otherwise(c)
