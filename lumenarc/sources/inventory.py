"""File inventories, sidecar records and catalogue tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenarc.functions.keys import base_name, uuid5_image
from lumenarc.functions.text import consolidate
from lumenarc.operators.joins import best_by
from lumenarc.sources.versions import Archive, rebalanced

# fixed values: suffixes of image files
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "tif", "tiff", "webp")

CATALOGUE = T.StructType([T.StructField(n, T.StringType()) for n in ("file_path", "file_name", "title", "description", "creator", "date", "signature")] + [
    T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("persons", T.ArrayType(T.StringType())), T.StructField("sha256", T.StringType()),
    T.StructField("fixity_status", T.StringType()), T.StructField("last_fixity_check", T.TimestampType()), T.StructField("updated_at", T.TimestampType()), T.StructField("import_id", T.StringType()),
])


def file_inventory(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, recursive: bool = True) -> DataFrame:
    """SRC-1: (path, size, mtime) of files with one of the suffixes, in any case, sorted by path. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    wanted = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return wanted.where(F.lower("path").rlike(rf"\.({'|'.join(suffixes)})$")).orderBy("path")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def folder_preview(files: DataFrame, indexed: DataFrame, is_image: Column, is_sidecar: Column, names: int = 10) -> DataFrame:
    """SRC-2: per folder: images, sidecars, the first names, how many are indexed and new, and whether all or some are.

    ``files`` and ``indexed`` have a path. Tasks pass on at most ``names`` names of a folder (Spark limits the rank before its shuffle).
    """
    known = indexed.select("path").distinct().withColumn("__known", F.lit(True))
    joined = files.join(known, "path", "left").withColumns({"folder": folder_of(F.col("path")), "name": base_name(F.col("path"))})
    per = joined.groupBy("folder").agg(
        F.count_if(is_image).alias("image_count"), F.count_if(is_sidecar).alias("sidecar_count"), F.count_if(is_image & F.col("__known")).alias("already_indexed"))
    ranked = joined.where(is_image).select("folder", "name", F.row_number().over(Window.partitionBy("folder").orderBy("name")).alias("rank")).where(F.col("rank") <= names)
    first = ranked.groupBy("folder").agg(F.array_sort(F.collect_list("name")).alias("names"))
    per = per.join(first, "folder", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    new = F.greatest(F.lit(0), F.col("image_count") - F.col("already_indexed"))
    full = (F.col("image_count") > 0) & (F.col("already_indexed") >= F.col("image_count"))
    return per.withColumns({"new_count": new, "fully_indexed": full, "partially_indexed": (F.col("already_indexed") > 0) & ~full})


def read_sidecars(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """JSON records with the path of their file; files that hold no object are left out."""
    read = spark.read.schema(f"{schema}, _bad string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)
    return read.select(F.col("_metadata.file_path").alias("sidecar"), "*").where("_bad is null").drop("_bad")


def attach_sidecars(images: DataFrame, sidecars: DataFrame) -> DataFrame:
    """SRC-3: for an image x.tif the record of x.json, else of x.tif.json; images without one stay."""
    fields = [c for c in sidecars.columns if c != "sidecar"]
    names = F.array(F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(".json")), F.concat("path", F.lit(".json")))
    tried = images.select("path", F.posexplode(names).alias("rank", "sidecar")).join(sidecars, "sidecar")
    return images.join(best_by(tried, ["path"], [F.col("rank")]).select("path", *fields), "path", "left")


def write_catalogue(table: DataFrame, path: str) -> None:
    """SRC-4: a new version of a table, partitioned by batch, which as many tasks write as its bytes need (see versions.rebalanced); versions.Archive switches several tables together."""
    rebalanced(table, "import_id").write.partitionBy("import_id").parquet(path)


def read_catalogue(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A written table; batch ids are text, as they were (007 stays 007)."""
    if schema is None:
        found = spark.read.parquet(path).schema
        schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "import_id" else f for f in found])
    return spark.read.schema(schema).parquet(path)


#: Names that a run reports.
FIRST_NAMES = 20


def ingest(files: DataFrame, catalogue: DataFrame, batch: str, root: str, force: bool = False, fields: dict[str, Sequence[Column]] | None = None, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """ING-1: (rows to append, journal row) for files (path, size) under ``root`` that the catalogue (id) lacks.

    Ids come from the path relative to the archive root, so a file has one id whatever folder was scanned. Files of size 0 or without one are rejected and counted as failed. ``fields`` adds columns by PRJ-1, each
    the first filled of its candidates (columns of ``files``: sidecar values, then header tags). Files are told apart, among themselves and from the catalogue's, by their id; where several entries of an inventory
    share a path, ``key`` names a column of both tables that tells them apart, and each is a row. The journal row has the counts, the first 20 names taken and the first 20 rejected, by path.
    """
    judged = _judged(files, catalogue, root, force, key)
    extra = consolidate(fields or {})
    own = ["id"] if key == "id" else ["id", key]
    rows = judged.where("taken and readable").select(*own, "path", base_name(F.col("path")).alias("file_name"), "size", F.lit(batch).alias("import_id"), *extra)
    def names(which: str, column: str) -> DataFrame:
        first = judged.where(which).select(F.lit(batch).alias("id"), "path").orderBy("path").limit(FIRST_NAMES)
        return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("path")), lambda p: F.regexp_extract(p, "[^/]*$", 0)).alias(column))

    new, bad = "taken and readable", "taken and not readable"
    count = lambda which: F.count_if(F.expr(which))
    told = judged.agg(F.lit(batch).alias("id"), count(new).alias("image_count"), count("not taken").alias("skipped_count"), count(bad).alias("failed_count"))
    none = F.array().cast("array<string>")
    for which, column in ((new, "first_names"), (bad, "failed_names")):
        told = told.join(names(which, column), "id", "left").withColumn(column, F.coalesce(column, none))
    return rows, told.withColumn("status", F.lit("completed"))


def _judged(files: DataFrame, catalogue: DataFrame, root: str, force: bool, key: str = "id") -> DataFrame:
    """``files`` with id, taken (not known yet) and readable, one row per key."""
    relative = F.substring(F.col("path"), len(root.rstrip("/")) + 2, 1 << 20)
    keyed = files.withColumn("id", uuid5_image(relative)).dropDuplicates([key])
    known = catalogue.select(key).distinct().withColumn("__known", F.lit(True))
    return keyed.join(known, key, "left").withColumns({"taken": F.lit(force) | F.col("__known").isNull(), "readable": F.coalesce(F.col("size") > 0, F.lit(False))}).drop("__known")


JOURNAL = "id string, status string, started_at timestamp, finished_at timestamp, image_count long, skipped_count long, failed_count long, first_names array<string>, failed_names array<string>, note string"


def reconcile(archive: Archive) -> list[str]:
    """Mark runs that the journal calls running as failed: their rows were never switched to. The batches, in order."""
    snapshot = archive.snapshot()
    if "journal" not in snapshot.tables:
        return []
    journal = snapshot.read("journal")
    dead = [r.id for r in journal.where("status = 'running'").select("id").orderBy("id").collect()]
    if dead:
        with archive.change("reconcile") as change:
            running = F.col("status") == "running"
            change.replace("journal", journal.withColumns({"note": F.when(running, "interrupted").otherwise(F.col("note")), "finished_at": F.when(running, F.current_timestamp()).otherwise(F.col("finished_at")), "status": F.when(running, "failed").otherwise(F.col("status"))}), None)
    return dead


def _told(archive: Archive, row: DataFrame) -> DataFrame:
    """The journal with a run's row instead of its earlier one."""
    spark = archive.spark
    schema = T._parse_datatype_string(JOURNAL)
    snapshot = archive.snapshot()
    journal = snapshot.read("journal") if "journal" in snapshot.tables else spark.createDataFrame([], schema)
    full = row.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in row.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    return journal.join(full.select("id"), "id", "left_anti").select(*schema.names).unionByName(full)


def start_run(archive: Archive, batch: str) -> None:
    """The journal's running row of a batch, before anything else; runs that died before are marked as failed."""
    reconcile(archive)
    with archive.change(f"start {batch}") as change:
        change.replace("journal", _told(archive, archive.spark.range(1).select(F.lit(batch).alias("id"), F.lit("running").alias("status"), F.current_timestamp().alias("started_at"))), None)


def run_ingest(archive: Archive, files: DataFrame, batch: str, root: str, force: bool = False, fields: dict[str, Sequence[Column]] | None = None) -> DataFrame:
    """ING-1 as a job on versioned tables ``images`` and ``journal``: the batch's journal row.

    The run is journalled as running; then the new rows and the completed row come with one switch. An error is journalled as failed and raised. A run that dies in between leaves running, and the
    next run of any batch marks it as failed; as none of its rows were switched to, the next run over the same files takes them.
    """
    start_run(archive, batch)
    snapshot = archive.snapshot()
    known = snapshot.read("images").select("id") if "images" in snapshot.tables else archive.spark.createDataFrame([], "id string")
    began = snapshot.read("journal").where(F.col("id") == batch).select("id", "started_at")
    try:
        rows, journal = ingest(files, known, batch, root, force, fields)
        done = journal.join(began, "id").withColumn("finished_at", F.current_timestamp())
        with archive.change(f"ingest {batch}") as change:
            if force and "images" in snapshot.tables:
                kept = change.read("images").join(rows.select("id"), "id", "left_anti")
                change.replace("images", kept.select(*rows.columns).unionByName(rows))
            else:
                change.append("images", rows)
            change.replace("journal", _told(archive, done), None)
    except Exception as error:
        with archive.change(f"failed {batch}") as change:
            change.replace("journal", _told(archive, began.withColumns({"status": F.lit("failed"), "finished_at": F.current_timestamp(), "note": F.lit(f"{type(error).__name__}: {error}"[:500])})), None)
        raise
    return archive.snapshot().read("journal").where(F.col("id") == batch)
