"""Summaries of catalogue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.functions.text import EPOCHS, filled
from lumenarc.operators.graph import checkpointed


def cluster_summary(faces: DataFrame) -> DataFrame:
    """AGG-1: per cluster the number of faces and the first non-empty label by face; largest first."""
    label = filled(F.col("label"))
    out = faces.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("face_count"), F.min_by(label, F.when(label.isNotNull(), F.col("face_id"))).alias("label"))
    return out.orderBy(F.desc("face_count"), "cluster_id")


def primary_clusters(faces: DataFrame) -> DataFrame:
    """AGG-2: for each person the cluster with most of its labelled faces, one person per cluster. Ties: cluster id; of persons that share a cluster the one with more faces, then the name."""
    n = faces.where(filled(F.col("label")).isNotNull() & F.col("cluster_id").isNotNull()).groupBy("label", "cluster_id").agg(F.count("*").alias("n"))
    mine = n.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "cluster_id"))).where("r = 1")
    one = mine.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "label"))).where("r = 1")
    return one.select("cluster_id", "label", "n")


def fixity_summary(table: DataFrame) -> DataFrame:
    """AGG-3: counts by state; unreadable counts as corrupted, no state as unverified."""
    s = F.col("fixity_status")
    bad = F.coalesce(s.isin("CORRUPTED", "READ_ERROR"), F.lit(False))
    out = table.agg(
        F.count("*").alias("total"), F.count_if(s == "OK").alias("intact"), F.count_if(bad).alias("corrupted"), F.count_if(s == "MISSING").alias("missing"),
        F.count_if(s.isNull() | (s == "UNVERIFIED")).alias("unverified"), F.max("last_fixity_check").alias("last_check"))
    return out.withColumn("alert_active", (F.col("corrupted") + F.col("missing")) > 0)


def year_range(years: DataFrame) -> DataFrame:
    """AGG-4: least and greatest year, clamped to 1840-1900 and 2025-2030; 1860 and 2026 where there is none."""
    low = F.least(F.greatest(F.coalesce(F.min("year"), F.lit(1860)), F.lit(1840)), F.lit(1900))
    return years.agg(low.alias("min_year"), F.greatest(F.least(F.coalesce(F.max("year"), F.lit(2026)), F.lit(2030)), F.lit(2025)).alias("max_year"))


def facet_values(records: DataFrame, year: Column) -> DataFrame:
    """AGG-4: (facet, value, n) of every creator, signature, batch and epoch with the records it holds, from one pass over the table.

    Blank values are left out, records without a batch make the legacy one, a year may lie in two epochs. See year_range() for the span of years.
    """
    one = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.alias("value"))
    batch = F.coalesce(filled(F.col("import_id")), F.lit("legacy"))
    epochs = F.array(*(one("epoch", F.when(F.col("__year").between(a, b), name)) for name, a, b in EPOCHS))
    each = F.concat(F.array(one("creator", filled(F.col("creator"))), one("signature", filled(F.col("signature"))), one("batch", batch)), epochs)
    found = records.withColumn("__year", year).select(F.explode(each).alias("f")).select("f.*").where("value is not null")
    return found.groupBy("facet", "value").agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, column: str, limit: int = 100) -> DataFrame:
    """AGG-5: trimmed non-empty distinct values, sorted."""
    return df.select(filled(F.col(column)).alias("value")).where("value is not null").distinct().orderBy("value").limit(limit)


#: Persons of an image that one row holds; an image with more is cut into chunks of about so many.
CHUNK = 256
#: Rows (image, chunks) of large images that may be broadcast.
LARGE_IMAGES = 100_000


def co_occurrence(faces: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """AGG-7: (a < b, shared): images that show both persons.

    The persons of an image are one array, from which its pairs are made. An image with more than ``chunk`` persons is cut into chunks by a hash of the person; each pair of chunks (i <= j) is a row
    of its own, so a hot image's pairs are made by as many tasks as it has pairs of chunks. Pairs are counted per task before they are sent.
    """
    seen = faces.select("image_id", filled(F.col("label")).alias("person")).where("person is not null and image_id is not null").distinct()
    dealt = dealt_chunks(seen, chunk)
    some = dealt.groupBy("image_id", "i", "j").agg(F.collect_list(F.when(F.col("chunk") == F.col("i"), F.col("person"))).alias("left"), F.collect_list(F.when(F.col("chunk") == F.col("j"), F.col("person"))).alias("right"))
    pairs = some.select("i", "j", F.explode("left").alias("x"), "right").select("i", "j", "x", F.explode("right").alias("y")).where("i < j or x < y")
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("shared"))


def dealt_chunks(seen: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(image_id, person, chunk, i, j): every person in each pair of chunks of its image that its own chunk belongs to."""
    large = seen.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("image_id", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    large = checkpointed(large)
    large = F.broadcast(large) if large.count() <= LARGE_IMAGES else large
    each = seen.join(large, "image_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    each = each.withColumn("chunk", F.pmod(F.xxhash64("person"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    return each.select("image_id", "person", "chunk", other).select("image_id", "person", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))


def batch_stats(images: DataFrame, faces: DataFrame, skipped: DataFrame) -> DataFrame:
    """AGG-8: images, faces and skipped files per batch."""
    n = lambda df, name: df.groupBy("import_id").agg(F.count("*").alias(name))
    out = n(images, "images").join(n(faces, "faces"), "import_id", "full").join(n(skipped, "skipped"), "import_id", "full")
    return out.na.fill(0, ["images", "faces", "skipped"])


def faces_per_image(images: DataFrame, faces: DataFrame) -> DataFrame:
    """AGG-9: number of faces, 0 where there is none."""
    n = faces.groupBy("image_id").agg(F.count("*").alias("faces_count"))
    return images.select("image_id").join(n, "image_id", "left").na.fill(0, ["faces_count"])


def clustering_stats(placed: DataFrame) -> DataFrame:
    """AGG-11: totals of (id, cluster), -1 being noise."""
    return placed.agg(F.count("*").alias("total"), F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), F.count_if(F.col("cluster") >= 0).alias("clustered"), F.count_if(F.col("cluster") < 0).alias("noise"))


def store_stats(files: DataFrame, size: Column, limit_bytes: int) -> DataFrame:
    """AGG-13: files, bytes, MB, share of the limit in per cent, whether over it."""
    out = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    return out.select("files", "bytes", F.round(F.col("bytes") / (1024 * 1024), 2).alias("mb"), F.round(F.col("bytes") * 100.0 / limit_bytes, 2).alias("usage_percent"), (F.col("bytes") > limit_bytes).alias("over_limit"))


def catalogue_counts(images: DataFrame, faces: DataFrame) -> DataFrame:
    """AGG-15: (images, faces): the rows of both tables."""
    each = images.select(F.lit(1).alias("i"), F.lit(0).alias("f")).unionByName(faces.select(F.lit(0).alias("i"), F.lit(1).alias("f")))
    return each.agg(F.coalesce(F.sum("i"), F.lit(0)).alias("images"), F.coalesce(F.sum("f"), F.lit(0)).alias("faces"))


def hit_type_counts(hits: DataFrame) -> DataFrame:
    """AGG-14: hits by kind and in all."""
    return hits.agg(F.count("*").alias("hits"), *(F.count_if(F.col("match_type") == k).alias(k) for k in ("person", "metadata", "clip")))


def group_stats(groups: DataFrame, shown: int) -> DataFrame:
    """AGG-10: of (group, id): all groups, and the images stacked behind the first of each of the ``shown`` largest groups."""
    n = groups.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    top = n.orderBy(F.desc("n"), "group").limit(shown).select(F.lit(0).alias("groups"), (F.col("n") - 1).alias("stacked"))
    both = n.select(F.lit(1).alias("groups"), F.lit(0).cast("long").alias("stacked")).unionByName(top)
    return both.agg(F.coalesce(F.sum("groups"), F.lit(0)).alias("total_groups"), F.coalesce(F.sum("stacked"), F.lit(0)).alias("total_stacked_images"))


def retention_plan(files: DataFrame, limit_bytes: int, share: float = 0.8) -> DataFrame:
    """WIN-3: files to delete, oldest first, until the total is at most ``share`` of the limit; none while the total is within the limit."""
    from lumenarc.operators.windows import running_totals

    total = files.agg(F.sum("size")).first()[0] or 0
    if total <= limit_bytes:
        return files.limit(0)
    before = running_totals(files, [F.col("mtime"), F.col("path")], {"__before": F.col("size")})
    return before.where(F.lit(total) - F.col("__before") > limit_bytes * share).drop("__before")
