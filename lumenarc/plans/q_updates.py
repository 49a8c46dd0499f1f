"""Keyed table updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenarc.operators import aggregates as A
from lumenarc.operators import catalogue as C
from lumenarc.operators import pairs as P
from lumenarc.plans.fixtures import ctes, made, table
from lumenarc.plans.registry import query

_T1 = "SELECT o_orderkey AS id, concat('t', o_custkey) AS title, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS creator, 'old' AS updated_at FROM orders WHERE o_orderkey % 4 < 3"
_U1 = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 1 THEN concat('u', o_orderkey) END AS title, CASE WHEN o_orderkey % 7 > 1 THEN 'new' END AS creator, 'now' AS updated_at FROM orders WHERE o_orderkey % 2 = 1"


def _sql(spark, d, text, base):
    return spark.sql(text.replace(f"FROM {base}", "FROM {t}"), t=table(spark, d, base))


@query("UPS_1_upsert_metadata", f"WITH t AS ({_T1}), u AS ({_U1}) SELECT coalesce(t.id, u.id) AS id, coalesce(u.title, t.title) AS title, coalesce(u.creator, t.creator) AS creator, CASE WHEN u.id IS NOT NULL THEN u.updated_at ELSE t.updated_at END AS updated_at FROM t FULL JOIN u ON t.id = u.id")
def ups_1(spark, d):
    return C.upsert(_sql(spark, d, _T1, "orders"), _sql(spark, d, _U1, "orders"), "id", always=["updated_at"])


_T2 = "SELECT concat('cluster_', s_suppkey) AS id, s_name AS name, 'n' AS notes, CAST(s_nationkey AS BIGINT) AS face_count FROM supplier WHERE s_suppkey % 3 < 2"
_U2 = "SELECT concat('cluster_', s_suppkey) AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'renamed' END AS name, CAST(NULL AS VARCHAR(9)) AS notes, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey AS BIGINT) END AS face_count FROM supplier WHERE s_suppkey % 3 > 0"


@query("UPS_2_upsert_cluster", f"WITH t AS ({_T2}), u AS ({_U2}) SELECT coalesce(t.id, u.id) AS id, coalesce(u.name, t.name) AS name, coalesce(u.notes, t.notes) AS notes, coalesce(u.face_count, t.face_count, 0) AS face_count FROM t FULL JOIN u ON t.id = u.id")
def ups_2(spark, d):
    return C.upsert_cluster(_sql(spark, d, _T2, "supplier"), _sql(spark, d, _U2, "supplier"))


@query("UPS_3_bulk_sync_clusters", f"WITH t AS ({_T2}), u AS ({_U2}) SELECT coalesce(t.id, u.id) AS id, CASE WHEN u.id IS NOT NULL THEN u.name ELSE t.name END AS name, t.notes, coalesce(u.face_count, t.face_count) AS face_count FROM t FULL JOIN u ON t.id = u.id")
def ups_3(spark, d):
    return C.bulk_sync_clusters(_sql(spark, d, _T2, "supplier"), _sql(spark, d, _U2, "supplier"))


@query("UPS_4_sync_exact_labels", f"""WITH t AS ({_T2}), n AS (SELECT l_linenumber AS p, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, 'cluster_' || l_suppkey) AS r FROM n),
    o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, 'L' || p) AS k FROM m WHERE r = 1), u AS (SELECT 'cluster_' || l_suppkey AS id, 'L' || p AS name FROM o WHERE k = 1)
    SELECT coalesce(t.id, u.id) AS id, u.name, t.notes, t.face_count FROM t FULL JOIN u ON t.id = u.id""")
def ups_4(spark, d):
    faces = table(spark, d, "lineitem").select(F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("label"), F.concat(F.lit("cluster_"), F.col("l_suppkey").cast("string")).alias("cluster_id"))
    primary = A.primary_clusters(faces).select(F.col("cluster_id").alias("id"), F.col("label").alias("name"))
    return C.sync_exact_labels(_sql(spark, d, _T2, "supplier"), primary)


@query("UPS_5_label_cluster", ctes("faces") + "SELECT face_id, CASE WHEN cluster_id IN ('cluster_1', 'cluster_2') THEN 'New ' || cluster_id ELSE label END AS label, CASE WHEN cluster_id IN ('cluster_1', 'cluster_2') THEN 'VERIFIED' ELSE curation_status END AS curation_status FROM faces")
def ups_5(spark, d):
    edits = made(spark, d, "clusters").where("id in ('cluster_1', 'cluster_2')").select(F.col("id").alias("cluster_id"), F.concat(F.lit("New "), "id").alias("new_label"))
    return C.label_clusters(made(spark, d, "faces"), edits).select("face_id", "label", "curation_status")


_LOOSE = "loose AS (SELECT face_id, CASE WHEN image_id % 3 = 0 THEN NULL ELSE cluster_id END AS cluster_id, label, curation_status FROM faces)"


@query("UPS_6_label_face", ctes("faces").rstrip() + f""", {_LOOSE}, e AS (SELECT face_id, cluster_id FROM loose WHERE face_id LIKE '7-%'), named AS (SELECT DISTINCT cluster_id FROM e WHERE cluster_id IS NOT NULL)
    SELECT l.face_id, CASE WHEN l.cluster_id IS NULL AND e.face_id IS NOT NULL THEN 'cluster_' || substr(replace(l.face_id, '-', ''), 1, 10) ELSE l.cluster_id END AS cluster_id,
    CASE WHEN n.cluster_id IS NOT NULL OR (l.cluster_id IS NULL AND e.face_id IS NOT NULL) THEN 'Given' ELSE label END AS label,
    CASE WHEN n.cluster_id IS NOT NULL OR (l.cluster_id IS NULL AND e.face_id IS NOT NULL) THEN 'VERIFIED' ELSE curation_status END AS curation_status
    FROM loose l LEFT JOIN e ON e.face_id = l.face_id LEFT JOIN named n ON n.cluster_id = l.cluster_id""")
def ups_6(spark, d):
    faces = made(spark, d, "faces").withColumn("cluster_id", F.expr("CASE WHEN image_id % 3 = 0 THEN NULL ELSE cluster_id END"))
    edits = faces.where("face_id like '7-%'").select("face_id", F.lit(" Given ").alias("new_label"))
    return C.label_faces(faces, edits).select("face_id", "cluster_id", "label", "curation_status")


@query("UPS_7_merge_clusters", ctes("faces").rstrip() + """, own AS (SELECT arg_min(label, face_id) FILTER (label IS NOT NULL AND cluster_id = 'cluster_3') AS a, arg_min(label, face_id) FILTER (label IS NOT NULL AND cluster_id IN ('cluster_1', 'cluster_2')) AS b FROM faces)
    SELECT face_id, CASE WHEN cluster_id IN ('cluster_1', 'cluster_2') THEN 'cluster_3' ELSE cluster_id END AS cluster_id, CASE WHEN cluster_id IN ('cluster_1', 'cluster_2', 'cluster_3') THEN coalesce((SELECT coalesce(a, b) FROM own), label) ELSE label END AS label FROM faces""")
def ups_7(spark, d):
    moves = made(spark, d, "clusters").where("id in ('cluster_1', 'cluster_2')").select(F.col("id").alias("source"), F.when(F.col("id") == "cluster_1", "cluster_2").otherwise("cluster_3").alias("target"))
    return C.merge_clusters(made(spark, d, "faces"), moves).select("face_id", "cluster_id", "label")


@query("UPS_8_remove_face", ctes("faces") + "SELECT cluster_id, count(*) AS face_count, arg_min(label, face_id) FILTER (label IS NOT NULL) AS label FROM faces WHERE image_id % 10 <> 0 GROUP BY cluster_id")
def ups_8(spark, d):
    faces = made(spark, d, "faces")
    return A.cluster_summary(C.remove_faces(faces, faces.where("image_id % 10 = 0")))


_E9 = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' verified' WHEN 1 THEN 'KI_auto' ELSE 'other' END AS status FROM labels WHERE doc_id % 2 = 0"


@query("UPS_9_set_curation", f"WITH e AS ({_E9}) SELECT l.doc_id, CASE WHEN e.doc_id IS NOT NULL AND l.doc_id % 3 = 0 THEN 'VERIFIED' WHEN e.doc_id IS NOT NULL AND l.doc_id % 3 = 1 THEN 'KI_AUTO' ELSE CASE WHEN quality = 1 THEN 'VERIFIED' ELSE 'KI_AUTO' END END AS curation_status FROM labels l LEFT JOIN e ON e.doc_id = l.doc_id")
def ups_9(spark, d):
    faces = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "VERIFIED").otherwise("KI_AUTO").alias("curation_status"))
    return C.set_curation(faces, _sql(spark, d, _E9, "labels"), "doc_id")


@query("UPS_9_rejected_curation", f"SELECT doc_id, status FROM ({_E9}) e WHERE status = 'other'")
def ups_9b(spark, d):
    return C.rejected_curation(_sql(spark, d, _E9, "labels"))


@query("UPS_10_batches", ctes("records") + "SELECT coalesce(import_id, 'legacy') AS id, count(*) AS image_count FROM records GROUP BY 1")
def ups_10(spark, d):
    return C.batch_rows(made(spark, d, "records"))


@query("UPS_10_rollback", ctes("records") + "SELECT id, import_id FROM records WHERE import_id IS DISTINCT FROM 'src5'")
def ups_10b(spark, d):
    return C.rollback(made(spark, d, "records"), "src5").select("id", "import_id")


_JOURNAL = """SELECT concat('b', o_custkey) AS id, concat('Batch ', o_custkey) AS name, '/arch' AS folder_path, min(o_orderdate) AS started_at, 'completed' AS status, CASE WHEN o_custkey % 2 = 0 THEN 'old' END AS notes,
    count(*) AS image_count, CAST(0 AS BIGINT) AS face_count, CAST(0 AS BIGINT) AS skipped_count FROM orders WHERE o_custkey % 3 < 2 GROUP BY o_custkey"""
_CREATED = "SELECT DISTINCT concat('b', o_custkey) AS id, concat(' New ', o_custkey, ' ') AS name, '/new' AS folder_path, TIMESTAMP '2024-05-01 00:00:00' AS started_at, CAST(NULL AS VARCHAR(9)) AS status, CASE WHEN o_custkey % 4 = 0 THEN 'fresh' END AS notes FROM orders WHERE o_custkey % 3 > 0"


@query("UPS_10_create", f"""WITH j AS ({_JOURNAL}), c AS ({_CREATED}) SELECT coalesce(j.id, c.id) AS id, coalesce(trim(c.name), j.name) AS name, coalesce(c.folder_path, j.folder_path) AS folder_path, coalesce(j.started_at, c.started_at) AS started_at,
    CASE WHEN c.id IS NOT NULL THEN 'running' ELSE j.status END AS status, coalesce(c.notes, j.notes) AS notes, coalesce(image_count, 0) AS image_count, coalesce(face_count, 0) AS face_count, coalesce(skipped_count, 0) AS skipped_count FROM j FULL JOIN c ON j.id = c.id""")
def ups_10_create(spark, d):
    return C.create_batches(_sql(spark, d, _JOURNAL, "orders"), _sql(spark, d, _CREATED, "orders"))


@query("UPS_10_update", f"""WITH j AS ({_JOURNAL}) SELECT id, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 5 = 0 THEN concat('Renamed ', substr(id, 2)) ELSE name END AS name, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 5 = 1 THEN 'failed' ELSE status END AS status,
    CASE WHEN CAST(substr(id, 2) AS BIGINT) % 5 = 1 THEN 7 ELSE skipped_count END AS skipped_count, image_count FROM j""")
def ups_10_update(spark, d):
    """Partial updates of some batches and of none that exists, then names, blank ones among them."""
    journal = _sql(spark, d, _JOURNAL, "orders")
    number = F.substring("id", 2, 20).cast("long")
    updates = journal.where(number % 5 == 1).select("id", F.lit("failed").alias("status"), F.lit(None).cast("long").alias("image_count"), F.lit(7).cast("long").alias("skipped_count"))
    updates = updates.unionByName(updates.withColumn("id", F.concat(F.lit("no"), "id")))
    names = journal.where(number % 5 < 2).select("id", F.when(number % 5 == 0, F.concat(F.lit(" Renamed "), F.substring("id", 2, 20))).otherwise("  ").alias("name"))
    return C.rename_batches(C.update_batches(journal, updates), names).select("id", "name", "status", "skipped_count", "image_count")


@query("UPS_11_update_fixity", ctes("fixity") + "SELECT id, CASE WHEN id % 5 = 0 THEN 'OK' ELSE fixity_status END AS fixity_status, CASE WHEN id % 5 = 0 THEN TIMESTAMP '2024-05-01 00:00:00' ELSE last_fixity_check END AS last_fixity_check, CASE WHEN id % 10 = 0 THEN 'abc' ELSE sha256 END AS sha256 FROM fixity")
def ups_11(spark, d):
    t = made(spark, d, "fixity")
    checks = t.where("id % 5 = 0").select("id", F.lit("OK").alias("status"), F.to_timestamp(F.lit("2024-05-01 00:00:00")).alias("checked_at"), F.when(F.col("id") % 10 == 0, "abc").alias("sha256"))
    return C.update_fixity(t, checks, "id").select("id", "fixity_status", "last_fixity_check", "sha256")


@query("UPS_12_audit_append", "SELECT 1000 + row_number() OVER (ORDER BY ts, event_id) - 1 AS id, event_id, event_type AS action, '{\"type\":\"' || event_type || '\"}' AS details FROM events")
def ups_12(spark, d):
    entries = table(spark, d, "events").select("ts", "event_id", F.col("event_type").alias("action"), F.to_json(F.struct(F.col("event_type").alias("type"))).alias("details"))
    return C.audit_rows(entries, [F.col("ts"), F.col("event_id")], 1000).select("id", "event_id", "action", "details")


@query("UPS_13_save_verso_notes", ctes("sides").rstrip() + """, ok AS (SELECT conv_id FROM sides GROUP BY conv_id HAVING count(*) FILTER (turn = 0) > 0 AND count(*) FILTER (turn = 1) > 0)
    SELECT s.file_path, CASE WHEN e THEN 'note' END AS verso_notes, CASE WHEN e THEN CASE s.turn WHEN 0 THEN 'recto' ELSE 'verso' END END AS sheet_role, CASE WHEN e THEN o.file_path END AS companion_path
    FROM (SELECT *, conv_id % 2 = 0 AND (turn = 0 OR turn = 1 AND conv_id IN (SELECT conv_id FROM ok)) AS e FROM sides) s LEFT JOIN sides o ON o.conv_id = s.conv_id AND o.turn = 1 - s.turn""")
def ups_13(spark, d):
    sides = made(spark, d, "sides")
    empty = F.lit(None).cast("string")
    records = sides.select("file_path", empty.alias("verso_notes"), empty.alias("sheet_role"), empty.alias("companion_path"))
    edits = sides.where("turn = 0 and conv_id % 2 = 0").select("file_path", F.lit("note").alias("verso_notes"))
    return C.save_verso_notes(records, edits, P.recto_verso_pairs(sides))


@query("UPS_14_save_ocr_text", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ocr ' || lang ELSE source END AS ocr_text FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def ups_14(spark, d):
    docs = table(spark, d, "documents")
    return C.upsert(docs.where("doc_id % 2 = 0").select("doc_id", F.col("source").alias("ocr_text")), docs.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("ocr "), "lang").alias("ocr_text")), "doc_id")


@query("UPS_15_upsert_authority", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS canonical FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def ups_15(spark, d):
    part = table(spark, d, "part")
    return C.upsert_authority(part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("canonical")), part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("canonical")))


@query("UPS_16_save_edit_settings", "SELECT user_id AS file_path, arg_max(props, (ts, event_id)) AS edit_settings FROM events GROUP BY user_id")
def ups_16(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("file_path"), F.col("props").alias("edit_settings"), "ts", F.col("event_id").alias("seq"))
    start = log.select("file_path", F.lit("{}").alias("edit_settings")).distinct()
    return C.save_edit_settings(start, log)
