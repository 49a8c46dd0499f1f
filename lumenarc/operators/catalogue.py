"""Keyed updates of catalogue tables: every update is a join that gives the table's next version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.functions.text import filled, merge_keywords
from lumenarc.operators.aggregates import clustering_stats, primary_clusters
from lumenarc.operators.graph import checkpointed, connected_components
from lumenarc.operators.similarity import cluster_vectors
from lumenarc.operators.windows import row_numbers


def last_by(updates: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One update per key: the last in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(c.desc_nulls_last() for c in order)))
    return updates.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def last_edit(updates: DataFrame, key: str) -> DataFrame:
    """One update per key: the last by ts and seq where there are such columns, ties (and updates without them) by the other columns.

    A partial maximum per task, so a key with many updates is no task's burden.
    """
    others = [f for f in updates.schema if f.name != key]
    if not others:
        return updates.distinct()
    sortable = [f.name for f in others if f.dataType.typeName() not in ("map", "variant")]
    order = sorted(sortable, key=lambda c: ("ts", "seq").index(c) if c in ("ts", "seq") else 2)
    if not order:
        return updates.dropDuplicates([key])
    best = F.max_by(F.struct(*(f.name for f in others)), F.struct(*order))
    return updates.groupBy(key).agg(best.alias("__last")).select(key, "__last.*")


def merge(table: DataFrame, updates: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Full outer join of table (t) and the last update (u) of each ``key``; every other column by its rule, or kept."""
    t, u = table.alias("t"), last_edit(updates, key).withColumn("__hit", F.lit(True)).alias("u")
    joined = t.join(u, F.col(f"t.{key}") == F.col(f"u.{key}"), "full")
    out = [F.coalesce(f"t.{key}", f"u.{key}").alias(key)]
    out += [rules.get(c, F.col(f"t.{c}")).alias(c) for c in table.columns if c != key]
    return joined.select(*out)


def keep_or_new(column: str) -> Column:
    """The update's value unless null."""
    return F.coalesce(f"u.{column}", f"t.{column}")


def upsert(table: DataFrame, updates: DataFrame, key: str, always: Sequence[str] = ()) -> DataFrame:
    """UPS-1, UPS-14: new non-null values win per column; ``always`` columns take the update's value wherever there is an update."""
    rules = {}
    for c in table.columns:
        if c != key and c in updates.columns:
            rules[c] = F.when(F.col("u.__hit"), F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")) if c in always else keep_or_new(c)
    return merge(table, updates, key, rules)


def upsert_cluster(clusters: DataFrame, updates: DataFrame) -> DataFrame:
    """UPS-2: name and notes if given; face_count if given, else kept, 0 for a new cluster."""
    return merge(clusters, updates, "id", {"name": keep_or_new("name"), "notes": keep_or_new("notes"), "face_count": F.coalesce("u.face_count", "t.face_count", F.lit(0))})


def bulk_sync_clusters(clusters: DataFrame, counted: DataFrame, preserve_names: bool = False) -> DataFrame:
    """UPS-3: counts replaced, names too (by null as well) unless they are preserved; clusters that the input lacks stay."""
    name = keep_or_new("name") if preserve_names else F.when(F.col("u.__hit"), F.col("u.name")).otherwise(F.col("t.name"))
    return merge(clusters, counted, "id", {"name": name, "face_count": F.coalesce("u.face_count", "t.face_count")})


def sync_exact_labels(clusters: DataFrame, primary: DataFrame) -> DataFrame:
    """UPS-4: all names are cleared, then set from (id, name) of primary clusters; missing clusters are added."""
    return merge(clusters, primary, "id", {"name": F.col("u.name")})


def image_persons(faces: DataFrame) -> DataFrame:
    """AGG-6: sorted distinct labels of each image."""
    return faces.groupBy("image_id").agg(F.array_sort(F.collect_set(filled(F.col("label")))).alias("persons"))


def label_clusters(faces: DataFrame, edits: DataFrame) -> DataFrame:
    """UPS-5: (cluster_id, new_label) sets the label and VERIFIED on all faces of a cluster."""
    joined = faces.join(last_edit(edits, "cluster_id").select("cluster_id", "new_label"), "cluster_id", "left")
    hit = F.col("new_label").isNotNull()
    return joined.withColumns({"label": F.coalesce("new_label", "label"), "curation_status": F.when(hit, "VERIFIED").otherwise(F.col("curation_status"))}).select(*faces.columns)


def label_faces(faces: DataFrame, edits: DataFrame) -> DataFrame:
    """UPS-6: (face_id, new_label): a clustered face labels its cluster; a single one gets a cluster of its own. Blank labels change nothing: see rejected_labels()."""
    valid = last_edit(edits.where(filled(F.col("new_label")).isNotNull()), "face_id").select("face_id", F.trim("new_label").alias("new_label"))
    named = faces.join(valid, "face_id").where("cluster_id is not null").groupBy("cluster_id").agg(F.min("new_label").alias("cluster_label"))
    single = F.concat(F.lit("cluster_"), F.substring(F.replace("face_id", F.lit("-"), F.lit("")), 1, 10))
    joined = faces.join(named, "cluster_id", "left").join(valid, "face_id", "left")
    alone = F.col("cluster_id").isNull() & F.col("new_label").isNotNull()
    hit = F.col("cluster_label").isNotNull() | alone
    return joined.withColumns({
        "label": F.when(alone, F.col("new_label")).otherwise(F.coalesce("cluster_label", "label")),
        "curation_status": F.when(hit, "VERIFIED").otherwise(F.col("curation_status")),
        "cluster_id": F.when(alone, single).otherwise(F.col("cluster_id")),
    }).select(*faces.columns)


def rejected_labels(edits: DataFrame) -> DataFrame:
    """UPS-6: edits with a null or blank label."""
    return edits.where(filled(F.col("new_label")).isNull())


#: Moved clusters that may be broadcast.
BROADCAST_MOVES = 100_000


def merge_clusters(faces: DataFrame, moves: DataFrame) -> DataFrame:
    """UPS-7: (source, target[, new_label]): faces move to the end of their chain of moves.

    The label of all faces there is the given one, else the target's first label (by face), else the sources' first one.
    """
    moves = moves.where("source <> target")
    nxt = connected_components(moves.select(F.col("source").alias("src"), F.col("target").alias("dst"))).select(F.col("node").alias("cluster_id"), "root")
    ends = moves.select(F.col("target").alias("cluster_id")).distinct().join(moves.select(F.col("source").alias("cluster_id")), "cluster_id", "left_anti")
    last = ends.join(nxt, "cluster_id").groupBy("root").agg(F.min("cluster_id").alias("end"))
    mapped = nxt.join(last, "root").select("cluster_id", "end")
    given = moves.where("new_label is not null").select(F.col("target").alias("cluster_id"), "new_label") if "new_label" in moves.columns else None
    touched = faces.join(mapped, "cluster_id")
    own = F.when(F.col("cluster_id") == F.col("end"), filled(F.col("label")))
    other = F.when(F.col("cluster_id") != F.col("end"), filled(F.col("label")))
    first = touched.groupBy("end").agg(F.min_by(own, F.when(own.isNotNull(), F.col("face_id"))).alias("own"), F.min_by(other, F.when(other.isNotNull(), F.col("face_id"))).alias("other"))
    if given is not None:
        asked = given.join(mapped, "cluster_id").groupBy("end").agg(F.min("new_label").alias("asked"))
        first = first.join(asked, "end", "left")
    else:
        first = first.withColumn("asked", F.lit(None).cast("string"))
    chosen = first.select("end", F.coalesce("asked", "own", "other").alias("__label"))
    # one join by cluster: most faces have no end, and joined by it they would all be one task's
    ends_of = checkpointed(mapped.join(chosen, "end", "left"))
    small = ends_of.limit(BROADCAST_MOVES + 1).count() <= BROADCAST_MOVES
    out = faces.join(F.broadcast(ends_of) if small else ends_of, "cluster_id", "left")
    return out.withColumns({"label": F.when(F.col("end").isNotNull(), F.coalesce("__label", "label")).otherwise(F.col("label")), "cluster_id": F.coalesce("end", "cluster_id")}).select(*faces.columns)


def remove_faces(faces: DataFrame, removed: DataFrame) -> DataFrame:
    """UPS-8: the listed faces lose cluster and label; persons and counts are aggregated anew from the result."""
    joined = faces.join(removed.select("face_id").distinct().withColumn("__hit", F.lit(True)), "face_id", "left")
    gone = F.col("__hit").isNotNull()
    return joined.withColumns({c: F.when(~gone, F.col(c)) for c in ("cluster_id", "label")}).select(*faces.columns)


def set_curation(table: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """UPS-9: valid states (VERIFIED, KI_AUTO, in any case) are set; see rejected_curation() for the others."""
    state = F.upper(F.trim("status"))
    valid = last_edit(edits.where(state.isin("VERIFIED", "KI_AUTO")), key).select(key, state.alias("__state"))
    return table.join(valid, key, "left").withColumn("curation_status", F.coalesce("__state", "curation_status")).select(*table.columns)


def rejected_curation(edits: DataFrame) -> DataFrame:
    """UPS-9: edits with another state."""
    return edits.where(~F.coalesce(F.upper(F.trim("status")).isin("VERIFIED", "KI_AUTO"), F.lit(False)))


def batch_rows(table: DataFrame, import_id: str = "import_id", legacy: str = "legacy") -> DataFrame:
    """UPS-10: the journal rows that existing data implies; rows without a batch make the legacy one."""
    return table.groupBy(F.coalesce(F.nullif(F.col(import_id), F.lit("")), F.lit(legacy)).alias("id")).agg(F.count("*").alias("image_count"))


def rollback(table: DataFrame, batch: str) -> DataFrame:
    """UPS-10: the table without a batch; with partitions by import_id other partitions aren't read."""
    return table.where(~F.col("import_id").eqNullSafe(F.lit(batch)))


def create_batches(journal: DataFrame, created: DataFrame) -> DataFrame:
    """UPS-10: (id, name, folder_path, started_at, status, notes) into the journal.

    An id that is there takes the new name, folder and status (running where none is given), keeps its start and counts, and its notes unless new ones are given.
    """
    asked = created.withColumns({"name": F.trim("name"), "folder_path": F.trim("folder_path"), "status": F.coalesce("status", F.lit("running"))})
    new = lambda c: F.when(F.col("u.__hit"), F.col(f"u.{c}")).otherwise(F.col(f"t.{c}"))
    rules = {c: new(c) for c in ("name", "folder_path", "status")} | {"notes": keep_or_new("notes"), "started_at": F.coalesce("t.started_at", "u.started_at")}
    return merge(journal, asked, "id", rules | {c: F.coalesce(f"t.{c}", F.lit(0)) for c in ("image_count", "face_count", "skipped_count") if c in journal.columns})


def update_batches(journal: DataFrame, updates: DataFrame) -> DataFrame:
    """UPS-10: values that aren't null replace the journal's; ids that the journal lacks are ignored."""
    return upsert(journal, updates.join(journal.select("id"), "id", "left_semi"), "id")


def rename_batches(journal: DataFrame, names: DataFrame) -> DataFrame:
    """UPS-10: (id, name): blank names are ignored."""
    return update_batches(journal, names.withColumn("name", filled(F.col("name"))).where("name is not null"))


def rollback_batch(batch: str, journal: DataFrame, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """UPS-10: the journal without the batch's row, then images, faces, metadata (any tables with import_id) without its rows, as versions to be switched to together."""
    return journal.where(~F.col("id").eqNullSafe(F.lit(batch))), *(rollback(t, batch) for t in tables)


def seed_journal(journal: DataFrame, images: DataFrame, faces: DataFrame, batch: str = "batch_initial_legacy") -> DataFrame:
    """UPS-10: an empty journal gets one completed row with the counts of what exists, none if there are no images."""
    if not journal.isEmpty():
        return journal
    seen = lambda df, image: df.select(F.lit(image).alias("image_count"), F.lit(1 - image).alias("face_count"))
    counts = seen(images, 1).unionByName(seen(faces, 0)).agg(F.sum("image_count").alias("image_count"), F.sum("face_count").alias("face_count")).where("image_count > 0")
    row = counts.withColumns({"id": F.lit(batch), "status": F.lit("completed")})
    return row.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in row.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in journal.schema))


def update_fixity(table: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """UPS-11: status and time from the check; the hash only if given."""
    c = last_edit(checks, key).select(key, F.col("status").alias("__status"), F.col("checked_at").alias("__at"), F.col("sha256").alias("__sha"))
    joined = table.join(c, key, "left")
    rules = {"fixity_status": F.coalesce("__status", "fixity_status"), "last_fixity_check": F.coalesce("__at", "last_fixity_check"), "sha256": F.coalesce("__sha", "sha256")}
    return joined.withColumns(rules).select(*table.columns)


def audit_rows(entries: DataFrame, order: Sequence[Column], first_id: int) -> DataFrame:
    """UPS-12: entries as audit rows with increasing ids from ``first_id`` on; append them to the log."""
    return row_numbers(entries, order, "id", start=first_id)


def save_verso_notes(table: DataFrame, edits: DataFrame, pairs: DataFrame) -> DataFrame:
    """UPS-13: notes go to both sides of a pair, with roles and the other side's path; missing rows are added."""
    paired = last_edit(edits, "file_path").join(pairs, "file_path", "left")
    own = paired.select("file_path", "verso_notes", F.col("role").alias("sheet_role"), F.col("companion").alias("companion_path"))
    mirror = paired.where("companion is not null").select(F.col("companion").alias("file_path"), "verso_notes", F.when(F.col("role") == "recto", "verso").otherwise("recto").alias("sheet_role"), F.col("file_path").alias("companion_path"))
    fresh = mirror.join(own.select("file_path"), "file_path", "left_anti")
    return upsert(table, own.unionByName(fresh), "file_path")


def upsert_authority(table: DataFrame, updates: DataFrame) -> DataFrame:
    """UPS-15: full replacement by id."""
    return table.join(updates.select("id"), "id", "left_anti").unionByName(last_edit(updates, "id").select(*updates.columns))


def seed_when_empty(table: DataFrame, seed: DataFrame) -> DataFrame:
    """UPS-15: the seed where the table is empty."""
    return seed if table.isEmpty() else table


def save_edit_settings(table: DataFrame, log: DataFrame) -> DataFrame:
    """UPS-16: the last settings of each path win."""
    last = log.groupBy("file_path").agg(F.max_by("edit_settings", F.struct("ts", "seq")).alias("edit_settings"))
    return upsert(table, last, "file_path")


def audit_recent(log: DataFrame, target_type: str | None = None, target_id: str | None = None, limit: int = 100) -> DataFrame:
    """TOP-6: the newest audit rows by id, of one kind of target or one target where given."""
    for column, value in (("target_type", target_type), ("target_id", target_id)):
        if value is not None:
            log = log.where(F.col(column) == value)
    return log.orderBy(F.desc("id")).limit(limit)


def batches_recent(journal: DataFrame, limit: int = 50) -> DataFrame:
    """TOP-7: the journal's batches, latest start first (none last), then by id."""
    return journal.orderBy(F.desc_nulls_last("started_at"), "id").limit(limit)


def apply_tags(table: DataFrame, chosen: DataFrame, first_id: int, at: Column) -> tuple[DataFrame, DataFrame]:
    """TAG-2: (next version of ``table``, audit rows) for ``chosen`` (file_path, tags, carrier, operator).

    Keywords are merged by SET-2; a path that the table lacks gets a row with its keywords and nothing else. Of repeated rows of one path the last counts (see last_edit()). Every path has one audit row APPLY_GND_TAGS
    with ids from ``first_id`` on in order of path.
    """
    last = last_edit(chosen, "file_path")
    joined = last.join(table.select("file_path", F.col("keywords").alias("__old")), "file_path", "left")
    merged = joined.select("file_path", merge_keywords(F.col("__old"), F.col("tags"), F.col("carrier")).alias("keywords"))
    details = F.to_json(F.struct(F.col("tags").alias("tags_added"), "carrier"))
    entries = last.select(at.alias("ts"), F.lit("APPLY_GND_TAGS").alias("action"), F.lit("IMAGE").alias("target_type"), F.col("file_path").alias("target_id"), details.alias("details"), F.coalesce("operator", F.lit("curator")).alias("operator"))
    return upsert(table, merged, "file_path"), audit_rows(entries, [F.col("target_id")], first_id)


def person_clusters(faces: DataFrame, clusters: DataFrame, eps: float = 0.35, min_samples: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """CLU-2: (faces, clusters, statistics) after faces (face_id, label, cluster_id, vector) are clustered anew.

    cluster_id becomes ``cluster_<number>`` or null; labels stay. ``clusters`` (id, name, face_count, ...) takes the new counts and, as name, the person of whom a cluster is the primary one (null for others);
    clusters that don't occur stay as they are (UPS-3). Fewer faces with a vector than ``min_samples`` are all noise. Null vectors are noise, too.
    """
    # clusters are numbered by their least core face
    numbered = checkpointed(row_numbers(faces.where("vector is not null").select("face_id", "vector"), [F.col("face_id")], "id"))
    if numbered.limit(min_samples).count() < min_samples:
        found = faces.select("face_id", F.lit(-1).cast("long").alias("cluster")).where("false")
    else:
        found = cluster_vectors(numbered.select("id", "vector"), eps, min_samples).join(numbered.select("id", "face_id"), "id").select("face_id", "cluster")
    found = checkpointed(found)
    told = F.when(F.col("cluster") >= 0, F.concat(F.lit("cluster_"), F.col("cluster").cast("string")))
    placed = faces.drop("cluster_id").join(found, "face_id", "left").withColumn("cluster_id", told).drop("cluster").select(*faces.columns)
    counted = found.where("cluster >= 0").groupBy(told.alias("id")).agg(F.count("*").alias("face_count"))
    names = primary_clusters(placed.where("cluster_id is not null").select("label", "cluster_id")).select(F.col("cluster_id").alias("id"), F.col("label").alias("name"))
    synced = bulk_sync_clusters(clusters, counted.join(names, "id", "left"))
    return placed, synced, clustering_stats(placed.select("face_id", F.coalesce(F.substring_index("cluster_id", "_", -1).cast("long"), F.lit(-1)).alias("cluster")))
