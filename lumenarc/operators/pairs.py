"""Front and back of one sheet by file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.functions.keys import base_name

# fixed values: families of side marks (recto, verso), the first of each being the canonical one; order is precedence
FAMILIES = (
    (("r", "recto"), ("v", "verso")), (("vorderseite", "vs"), ("rueckseite", "rückseite", "rs")), (("front",), ("back",)),
    (("a",), ("b",)), (("01",), ("02",)), (("1",), ("2",)),
)
EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".webp")


def side_of(stem: Column) -> Column:
    """(base, delimiter, family, side, tag) of a stem with a side mark at its end; null without one."""
    out = F.lit(None).cast("struct<base: string, delimiter: string, family: int, side: string, tag: string>")
    for k, family in reversed(list(enumerate(FAMILIES))):
        for side, tags in (("verso", family[1]), ("recto", family[0])):
            pattern = f"^(.*)([-_])({'|'.join(tags)})$"
            part = lambda g, p=pattern: F.regexp_extract(stem, f"(?iu){p}", g)
            found = F.struct(part(1).alias("base"), part(2).alias("delimiter"), F.lit(k).alias("family"), F.lit(side).alias("side"), F.lower(part(3)).alias("tag"))
            out = F.when(stem.rlike(f"(?iu){pattern}"), found).otherwise(out)
    return out


def recto_verso_pairs(files: DataFrame, path: str = "file_path", strict_tags: bool = False) -> DataFrame:
    """JN-4: every file with a side mark: (path, role, companion); companion is null if there is none.

    The companion is in the same folder, has the same base and delimiter and the other side of the same family of marks; the same
    extension comes first, then the order of EXTENSIONS. With ``strict_tags`` only the family's canonical mark counts as the other side.
    """
    name = base_name(F.col(path))
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    folder = F.substring(F.col(path), F.lit(1), F.length(F.col(path)) - F.length(name))
    marked = files.select(F.col(path).alias("file_path"), folder.alias("folder"), ext.alias("ext"), side_of(stem).alias("s")).where("s is not null").select("file_path", "folder", "ext", "s.*")
    canonical = F.array(*(F.lit(t) for f in FAMILIES for t in (f[0][0], f[1][0])))
    other = marked.select(
        "folder", "base", "delimiter", "family", F.when(F.col("side") == "recto", "verso").otherwise("recto").alias("side"), F.col("file_path").alias("companion"),
        F.col("ext").alias("companion_ext"), F.array_contains(canonical, F.col("tag")).alias("canonical"))
    if strict_tags:
        other = other.where("canonical")
    joined = marked.join(other, ["folder", "base", "delimiter", "family", "side"], "left")
    known = F.array_position(F.array(*(F.lit(e) for e in EXTENSIONS)), F.col("companion_ext"))
    order = [F.when(F.col("companion_ext") == F.col("ext"), 0).otherwise(1), F.when(known > 0, known).otherwise(99), "companion"]
    ranked = joined.withColumn("rank", F.row_number().over(Window.partitionBy("file_path").orderBy(*order)))
    return ranked.where("rank = 1").select("file_path", F.col("side").alias("role"), "companion")
