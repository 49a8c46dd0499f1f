"""Joins, aggregates and window-shaped operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenarc.functions.text import EPOCHS
from lumenarc.operators import aggregates as A
from lumenarc.operators import joins as J
from lumenarc.operators import pairs as P
from lumenarc.operators import similarity as S
from lumenarc.operators import vocabulary as W
from lumenarc.operators.graph import connected_components
from lumenarc.plans.fixtures import ctes, hashes, made, table, vectors
from lumenarc.plans.q_functions import _HAM
from lumenarc.plans.registry import query
from lumenarc.sources.exports import numbered


@query("JN_1_new_files", "SELECT page_id AS id FROM pages WHERE page_id % 3 <> 0")
def jn_1(spark, d):
    files = made(spark, d, "inventory")
    return J.new_files(files, files.where("known"), "id").select("id")


@query("JN_2_orphans", "SELECT page_id AS id FROM pages p WHERE page_id % 4 = 1")
def jn_2(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("/old/"), F.col("page_id").cast("string")).alias("absolute"), F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("relative"))
    found = pages.where("id % 4 = 0").select(F.col("absolute").alias("path")).unionByName(pages.where("id % 4 > 1").select(F.concat(F.lit("/base/"), "relative").alias("path")))
    return J.orphans(pages, found, "absolute", "relative", "/base").select("id")


@query("JN_3_cascade_delete", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY l_orderkey")
def jn_3(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return J.without(table(spark, d, "lineitem"), gone, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("JN_4_recto_verso_pairs", ctes("sides") + """SELECT s.file_path, CASE s.turn WHEN 0 THEN 'recto' ELSE 'verso' END AS role, o.file_path AS companion FROM sides s
    LEFT JOIN sides o ON o.conv_id = s.conv_id AND o.turn = 1 - s.turn WHERE s.turn < 2""")
def jn_4(spark, d):
    return P.recto_verso_pairs(made(spark, d, "sides"))


def _sheets(spark, d):
    sides = made(spark, d, "sides")
    marked = P.recto_verso_pairs(sides)
    pairs = marked.where("role = 'recto' and companion is not null").select(F.col("file_path").alias("recto_path"), F.col("companion").alias("verso_path"))
    return sides, pairs


_SHEETS = "sheets AS (SELECT r.file_path AS recto_path, v.file_path AS verso_path, r.notes AS rn, v.notes AS vn, r.ocr_text AS recto_text, v.ocr_text AS verso_text FROM sides r JOIN sides v ON r.conv_id = v.conv_id AND r.turn = 0 AND v.turn = 1)"


@query("JN_5_two_sided_info", ctes("sides").rstrip() + f", {_SHEETS} SELECT recto_path, verso_path, recto_text, verso_text, coalesce(nullif(trim(rn), ''), nullif(trim(vn), '')) AS notes FROM sheets")
def jn_5(spark, d):
    sides, pairs = _sheets(spark, d)
    return J.two_sided_info(pairs, sides)


@query("JN_6_verso_to_recto", ctes("sides").rstrip() + f""", {_SHEETS}, hits AS (SELECT file_path, 0.5 AS score FROM sides WHERE contains(ocr_text, 'tion') AND turn < 2)
    SELECT file_path, score FROM hits UNION ALL SELECT DISTINCT recto_path, 0.89 FROM sheets JOIN hits ON verso_path = file_path WHERE recto_path NOT IN (SELECT file_path FROM hits)""")
def jn_6(spark, d):
    sides, pairs = _sheets(spark, d)
    hits = sides.where("turn < 2").where(F.contains("ocr_text", F.lit("tion"))).select("file_path", F.lit(0.5).alias("score"))
    return J.verso_to_recto(hits, pairs)


_CUR = "SELECT doc_id AS id, CASE WHEN toxic = 1 THEN '' ELSE concat('Title ', doc_id) END AS title, CASE WHEN quality = 1 THEN 'Curated' END AS creator FROM labels"


@query("JN_7_metadata_overlay", ctes("records").rstrip() + f", cur AS ({_CUR}) SELECT r.id, coalesce(nullif(trim(c.title), ''), r.title) AS title, coalesce(nullif(trim(c.creator), ''), r.creator) AS creator FROM records r LEFT JOIN cur c ON r.id = c.id")
def jn_7(spark, d):
    curated = spark.sql(_CUR.replace("FROM labels", "FROM {t}"), t=table(spark, d, "labels"))
    return J.metadata_overlay(made(spark, d, "records"), curated, "id", ["title", "creator"]).select("id", "title", "creator")


@query("JN_8_image_details", ctes("faces", "clusters").rstrip() + """, n AS (SELECT image_id, list({'face_id': face_id, 'name': coalesce(nullif(trim(f.label), ''), nullif(trim(c.name), ''))} ORDER BY face_id) AS found FROM faces f LEFT JOIN clusters c ON f.cluster_id = c.id GROUP BY image_id),
    p AS (SELECT a.o_orderkey AS recto, b.o_orderkey AS verso FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderkey % 2 = 1),
    t AS (SELECT o_orderkey AS k, o_orderstatus AS txt FROM orders WHERE o_orderkey % 3 <> 0)
    SELECT o_orderkey AS image_id, coalesce(len(found), 0) AS faces_count, array_to_string(list_transform(found, lambda x: x.face_id || '=' || coalesce(x.name, '?')), ';') AS faces, CASE WHEN r.recto IS NOT NULL THEN 'recto' WHEN v.verso IS NOT NULL THEN 'verso' END AS sheet_role,
    coalesce('/arch/o_' || r.verso || '.jpg', '/arch/o_' || v.recto || '.jpg') AS companion_path, t.txt AS ocr_text, u.txt AS companion_text
    FROM orders LEFT JOIN n ON n.image_id = o_orderkey LEFT JOIN p r ON r.recto = o_orderkey LEFT JOIN p v ON v.verso = o_orderkey LEFT JOIN t ON t.k = o_orderkey LEFT JOIN t u ON u.k = coalesce(r.verso, v.recto)""")
def jn_8(spark, d):
    """Neighbouring orders are the two sides of a sheet; their states are texts."""
    path = lambda k: F.concat(F.lit("/arch/o_"), k.cast("string"), F.lit(".jpg"))
    orders = table(spark, d, "orders")
    images = orders.select(F.col("o_orderkey").alias("image_id"), path(F.col("o_orderkey")).alias("file_path"))
    key = orders.select(F.col("o_orderkey").alias("k"))
    pairs = key.where("k % 2 = 1").join(key.select((F.col("k") - 1).alias("k")), "k").select(path(F.col("k")).alias("recto_path"), path(F.col("k") + 1).alias("verso_path"))
    texts = orders.where("o_orderkey % 3 <> 0").select(path(F.col("o_orderkey")).alias("file_path"), F.col("o_orderstatus").alias("ocr_text"))
    found = J.image_details(images, made(spark, d, "faces"), made(spark, d, "clusters"), pairs, texts)
    told = F.array_join(F.transform("faces", lambda x: F.concat(x["face_id"], F.lit("="), F.coalesce(x["name"], F.lit("?")))), ";")
    return found.select("image_id", F.col("faces_count").cast("long").alias("faces_count"), told.alias("faces"), "sheet_role", "companion_path", "ocr_text", "companion_text")


@query("JN_9_similarity_join", ctes("edges") + "SELECT a, b, similarity FROM edges")
def jn_9(spark, d):
    return S.similarity_join(vectors(spark, d), 0.4)


@query("JN_10_hash_join", ctes("hashes") + f"SELECT a, b, distance FROM (SELECT a.id AS a, b.id AS b, {_HAM} AS distance FROM hashes a JOIN hashes b ON a.id < b.id) t WHERE distance <= 17")
def jn_10(spark, d):
    return S.hash_join(hashes(spark, d), 17)


@query("JN_10_hash_join_bands", ctes("hashes") + f"SELECT a, b, distance FROM (SELECT a.id AS a, b.id AS b, {_HAM} AS distance FROM hashes a JOIN hashes b ON a.id < b.id) t WHERE distance <= 16")
def jn_10_bands(spark, d):
    """By bands, as for short distances."""
    return S.hash_join(hashes(spark, d), 16, bands=17)


@query("JN_11_shared_images", ctes("faces") + "SELECT image_id FROM faces WHERE label = 'Person 49' INTERSECT SELECT image_id FROM faces WHERE label = 'Person 76'")
def jn_11(spark, d):
    return J.shared_images(made(spark, d, "faces"), "Person 49", "Person 76")


@query("JN_12_label_fallback", ctes("faces", "clusters") + "SELECT face_id, coalesce(nullif(trim(label), ''), nullif(trim(name), '')) AS name FROM faces f LEFT JOIN clusters c ON f.cluster_id = c.id")
def jn_12(spark, d):
    return J.label_fallback(made(spark, d, "faces"), made(spark, d, "clusters")).select("face_id", "name")


def _vocabulary(spark, d):
    return made(spark, d, "vocabulary").withColumn("synonyms", F.array(F.concat(F.lit("syn "), "canonical"), F.lower("brand")))


_Q13 = "SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN concat('x', p_name, 'y') ELSE concat('zz ', p_name) END AS query FROM part WHERE p_partkey % 100 = 0"


@query("JN_13_expand_term", ctes("vocabulary").rstrip() + f""", q AS ({_Q13}), syn AS (SELECT position, canonical, lower(canonical) AS term, 0 AS kind, 0 AS place FROM vocabulary UNION ALL SELECT position, canonical, 'syn ' || lower(canonical), 1, 1 FROM vocabulary UNION ALL SELECT position, canonical, lower(brand), 1, 2 FROM vocabulary),
    idx AS (SELECT term, arg_min(canonical, (kind, CASE WHEN kind = 0 THEN position ELSE -position END)) AS canonical, min((position, place)) AS seen FROM syn GROUP BY term),
    w AS (SELECT query, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM (SELECT query, regexp_split_to_array(lower(query), '[^0-9a-z_]+') AS words FROM q) t),
    c AS (SELECT query, canonical, term, 1 AS tier, 0 AS place, 0 AS p2 FROM q JOIN idx ON lower(query) = term
        UNION ALL SELECT query, canonical, term, 2, pos, 0 FROM w JOIN idx ON word = term WHERE length(word) >= 3
        UNION ALL SELECT query, canonical, term, 3, seen[1], seen[2] FROM q JOIN idx ON length(term) >= 4 AND (contains(lower(query), term) OR contains(term, lower(query))))
    SELECT query, canonical, term AS matched_term, tier FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, place, p2, term) AS r FROM c) t WHERE r = 1""")
def jn_13(spark, d):
    queries = spark.sql(_Q13.replace("FROM part", "FROM {t}"), t=table(spark, d, "part"))
    return W.expand_terms(queries, _vocabulary(spark, d))


@query("JN_13_expand_every_term")
def jn_13_every(spark, d):
    """JN_13_expand_term with all of part as queries; no SQL, as its tier 3 compares every query with every term."""
    queries = spark.sql(_Q13.partition(" WHERE ")[0].replace("FROM part", "FROM {t}"), t=table(spark, d, "part"))
    return W.expand_terms(queries, _vocabulary(spark, d))


@query("AGG_1_cluster_summary", ctes("faces") + "SELECT cluster_id, count(*) AS face_count, arg_min(label, face_id) FILTER (label IS NOT NULL) AS label FROM faces GROUP BY cluster_id")
def agg_1(spark, d):
    return A.cluster_summary(made(spark, d, "faces"))


_GROUPS = "SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_returnflag"


@query("AGG_2_primary_cluster", f"""WITH n AS ({_GROUPS}), m AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS r FROM n),
    o AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, 'P' || l_suppkey) AS k FROM m WHERE r = 1) SELECT l_returnflag AS cluster_id, 'P' || l_suppkey AS label, n FROM o WHERE k = 1""")
def agg_2(spark, d):
    faces = table(spark, d, "lineitem").select(F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("label"), F.col("l_returnflag").alias("cluster_id"))
    return A.primary_clusters(faces)


@query("AGG_3_fixity_summary", ctes("fixity") + """SELECT count(*) AS total, count(*) FILTER (fixity_status = 'OK') AS intact, count(*) FILTER (fixity_status IN ('CORRUPTED', 'READ_ERROR')) AS corrupted, count(*) FILTER (fixity_status = 'MISSING') AS missing,
    count(*) FILTER (fixity_status IS NULL) AS unverified, max(last_fixity_check) AS last_check, count(*) FILTER (fixity_status IN ('CORRUPTED', 'MISSING')) > 0 AS alert_active FROM fixity""")
def agg_3(spark, d):
    return A.fixity_summary(made(spark, d, "fixity"))


@query("AGG_4_facets", ctes("dated") + "SELECT CAST(least(greatest(min(true_year), 1840), 1900) AS BIGINT) AS min_year, CAST(greatest(least(max(true_year), 2030), 2025) AS BIGINT) AS max_year FROM dated")
def agg_4(spark, d):
    return A.year_range(made(spark, d, "dated").select(F.col("true_year").cast("long").alias("year"))).select(F.col("min_year").cast("long").alias("min_year"), F.col("max_year").cast("long").alias("max_year"))


_EPOCH_SQL = " UNION ALL ".join(f"SELECT 'epoch', '{name}' FROM dated WHERE true_year BETWEEN {a} AND {b}" for name, a, b in EPOCHS)


@query("AGG_4_facet_values", ctes("dated") + f"SELECT facet, value, count(*) AS n FROM (SELECT 'creator' AS facet, creator AS value FROM dated UNION ALL SELECT 'signature', signature FROM dated UNION ALL SELECT 'batch', coalesce(nullif(import_id, ''), 'legacy') FROM dated UNION ALL {_EPOCH_SQL}) t GROUP BY facet, value")
def agg_4_values(spark, d):
    return A.facet_values(made(spark, d, "dated"), F.col("true_year"))


@query("AGG_5_distinct_values", "SELECT DISTINCT trim(c_name) AS value FROM customer WHERE trim(c_name) <> '' ORDER BY value LIMIT 100")
def agg_5(spark, d):
    return A.distinct_values(table(spark, d, "customer"), "c_name")


@query("AGG_6_image_persons", ctes("faces") + "SELECT image_id, coalesce(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), []) AS persons FROM faces GROUP BY image_id")
def agg_6(spark, d):
    from lumenarc.operators.catalogue import image_persons

    return image_persons(made(spark, d, "faces"))


_CO = "seen AS (SELECT DISTINCT image_id, label AS person FROM faces WHERE label IS NOT NULL), co AS (SELECT x.person AS a, y.person AS b, count(*) AS shared FROM seen x JOIN seen y ON x.image_id = y.image_id AND x.person < y.person GROUP BY ALL)"


@query("AGG_7_co_occurrence", ctes("faces").rstrip() + f", {_CO} SELECT a, b, shared FROM co")
def agg_7(spark, d):
    return A.co_occurrence(made(spark, d, "faces"))


@query("AGG_8_batch_stats", "SELECT source AS import_id, count(*) AS images, CAST(sum(CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) AS BIGINT) AS faces, CAST(sum(CASE WHEN n_chars < 100 THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM documents GROUP BY source")
def agg_8(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("source", "import_id")
    return A.batch_stats(docs, docs.where("n_chars > 1000"), docs.where("n_chars < 100"))


@query("AGG_9_faces_per_image", ctes("faces") + "SELECT o_orderkey AS image_id, count(face_id) AS faces_count FROM orders LEFT JOIN faces ON image_id = o_orderkey GROUP BY o_orderkey")
def agg_9(spark, d):
    return A.faces_per_image(table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id")), made(spark, d, "faces"))


_COMP = """, sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT a AS id, a AS r FROM sym UNION SELECT reach.id, sym.b FROM reach JOIN sym ON reach.r = sym.a),
    comp AS (SELECT id, min(r) AS root FROM reach GROUP BY id) """


def _components(spark, d):
    from lumenarc.operators.graph import checkpointed

    return checkpointed(S.similarity_join(vectors(spark, d), 0.4))


@query("CC_1_connected_components", ctes("edges").rstrip() + _COMP + "SELECT id AS node, root FROM comp")
def cc_1(spark, d):
    return connected_components(_components(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst")))


_DB = ", num AS (SELECT root, dense_rank() OVER (ORDER BY root) - 1 AS c FROM (SELECT DISTINCT root FROM comp) t), placed AS (SELECT vec_id AS id, coalesce(c, -1) AS cluster FROM embeddings LEFT JOIN comp ON id = vec_id LEFT JOIN num USING (root)) "


@query("CLU_1_dbscan_cosine", ctes("edges").rstrip() + _COMP.rstrip() + _DB + "SELECT id, cluster FROM placed")
def clu_1(spark, d):
    return S.cluster_vectors(vectors(spark, d), 0.6)


@query("AGG_11_clustering_stats", ctes("edges").rstrip() + _COMP.rstrip() + _DB + "SELECT count(*) AS total, count(DISTINCT cluster) FILTER (cluster >= 0) AS clusters, count(*) FILTER (cluster >= 0) AS clustered, count(*) FILTER (cluster < 0) AS noise FROM placed")
def agg_11(spark, d):
    return A.clustering_stats(S.cluster_vectors(vectors(spark, d), 0.6))


_FACE_ROWS = """faces AS (SELECT 'f' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS face_id, CASE WHEN label % 3 = 0 THEN ' ' ELSE 'L' || label END AS label, cluster FROM placed JOIN embeddings ON id = vec_id),
    n AS (SELECT trim(label) AS label, 'cluster_' || cluster AS cluster_id, count(*) AS n FROM faces WHERE cluster >= 0 AND trim(label) <> '' GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, cluster_id) AS r FROM n),
    o AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, label) AS k FROM m WHERE r = 1)"""


def _person_clusters(spark, d):
    """Vectors as faces, of which every third has no name; clusters of suppliers as the table before."""
    from lumenarc.operators.catalogue import person_clusters

    v = vectors(spark, d)
    faces = v.select(F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("face_id"), F.when(F.col("label") % 3 == 0, " ").otherwise(F.concat(F.lit("L"), F.col("label").cast("string"))).alias("label"), F.lit("old").alias("cluster_id"), "vector")
    return person_clusters(faces, made(spark, d, "clusters"), 0.6)


@query("CLU_2_person_clusters", ctes("edges").rstrip() + _COMP.rstrip() + _DB.rstrip() + f", {_FACE_ROWS} SELECT face_id, label, CASE WHEN cluster >= 0 THEN 'cluster_' || cluster END AS cluster_id FROM faces")
def clu_2(spark, d):
    return _person_clusters(spark, d)[0].select("face_id", "label", "cluster_id")


@query("CLU_2_synced_clusters", ctes("edges", "clusters").rstrip() + _COMP.rstrip() + _DB.rstrip() + f""", {_FACE_ROWS}, c AS (SELECT 'cluster_' || cluster AS id, count(*) AS face_count FROM faces WHERE cluster >= 0 GROUP BY 1)
    SELECT coalesce(t.id, c.id) AS id, CASE WHEN c.id IS NULL THEN t.name ELSE o.label END AS name, coalesce(c.face_count, t.face_count) AS face_count FROM clusters t FULL JOIN c ON t.id = c.id LEFT JOIN o ON o.cluster_id = c.id AND o.k = 1""")
def clu_2_synced(spark, d):
    return _person_clusters(spark, d)[1].select("id", "name", "face_count")


@query("AGG_10_variant_group_stats", ctes("edges").rstrip() + _COMP + ", g AS (SELECT root, count(*) AS n FROM comp GROUP BY root), t AS (SELECT n FROM g ORDER BY n DESC, root LIMIT 10) SELECT (SELECT count(*) FROM g) AS total_groups, (SELECT CAST(sum(n - 1) AS BIGINT) FROM t) AS total_stacked_images")
def agg_10(spark, d):
    found = connected_components(_components(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return A.group_stats(found.select(F.col("root").alias("group"), F.col("node").alias("id")), 10)


@query("VAR_2_variant_groups", ctes("edges", "sized").rstrip() + _COMP.rstrip() + _DB.rstrip() + """, m AS (SELECT p.id, p.cluster, s.width, coalesce(CAST(s.width AS BIGINT) * s.height, 0) AS px FROM placed p LEFT JOIN sized s ON s.id = p.id WHERE cluster >= 0 AND cluster < 10)
    SELECT 'group_' || cluster AS group_id, count(*) OVER (PARTITION BY cluster) AS "count", row_number() OVER (PARTITION BY cluster ORDER BY px DESC, id) AS place, id, width FROM m""")
def var_2(spark, d):
    return _variants(spark, d)[0].select("group_id", "count", F.col("place").cast("long").alias("place"), "id", "width")


def _variants(spark, d):
    """Vectors as images whose pixels come from part."""
    from lumenarc.operators.search import variant_groups

    sizes = made(spark, d, "sized").select("id", "width", "height")
    return variant_groups(vectors(spark, d).select("id", "vector").join(sizes, "id", "left"), 0.6, shown=10)


@query("VAR_2_variant_group_stats", ctes("edges").rstrip() + _COMP.rstrip() + _DB.rstrip() + ", g AS (SELECT cluster, count(*) AS n FROM placed WHERE cluster >= 0 GROUP BY cluster) SELECT count(*) AS total_groups, count(*) FILTER (cluster < 10) AS showing_groups, CAST(coalesce(sum(n) FILTER (cluster < 10), 0) AS BIGINT) AS total_stacked_images FROM g")
def var_2_stats(spark, d):
    return _variants(spark, d)[1]


@query("AGG_12_categories", "SELECT DISTINCT p_type AS category FROM part ORDER BY 1")
def agg_12(spark, d):
    return W.categories(table(spark, d, "part").withColumnRenamed("p_type", "category"))


@query("AGG_12_terms", ctes("vocabulary") + "SELECT canonical, position FROM vocabulary WHERE lower(category) = 'economy'")
def agg_12b(spark, d):
    return W.terms(made(spark, d, "vocabulary"), "Economy ").select("canonical", "position")


@query("AGG_13_store_stats", "SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, round(sum(n_chars) / (1024 * 1024), 2) AS mb, round(sum(n_chars) * 100.0 / 5000000, 2) AS usage_percent, sum(n_chars) > 5000000 AS over_limit FROM documents")
def agg_13(spark, d):
    return A.store_stats(table(spark, d, "documents"), F.col("n_chars"), 5_000_000)


_HITS = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'metadata' ELSE 'clip' END AS match_type FROM documents"


@query("AGG_14_hit_type_counts", f"SELECT count(*) AS hits, count(*) FILTER (match_type = 'person') AS person, count(*) FILTER (match_type = 'metadata') AS metadata, count(*) FILTER (match_type = 'clip') AS clip FROM ({_HITS}) t")
def agg_14(spark, d):
    return A.hit_type_counts(spark.sql(_HITS.replace("FROM documents", "FROM {t}"), t=table(spark, d, "documents")))


@query("AGG_15_catalogue_counts", ctes("faces") + "SELECT (SELECT count(*) FROM orders) AS images, (SELECT count(*) FROM faces) AS faces")
def agg_15(spark, d):
    return A.catalogue_counts(table(spark, d, "orders"), made(spark, d, "faces"))


@query("WIN_1_representative", ctes("sized") + "SELECT grp, id FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CAST(width AS BIGINT) * height DESC, id) AS r FROM sized) t WHERE r = 1")
def win_1(spark, d):
    return J.representatives(made(spark, d, "sized"), "grp").select("grp", "id")


@query("WIN_2_running_no", "SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS no, printf('POS-%04d', row_number() OVER (ORDER BY n_chars, doc_id)) AS unit FROM documents")
def win_2(spark, d):
    return numbered(table(spark, d, "documents").select("doc_id", "n_chars"), [F.col("n_chars"), F.col("doc_id")]).select("doc_id", "no", F.format_string("POS-%04d", "no").alias("unit"))


@query("WIN_3_retention_plan", "SELECT doc_id AS path FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id % 97, doc_id) - n_chars AS before, sum(n_chars) OVER () AS total FROM documents) t WHERE total > 100000 AND total - before > 80000")
def win_3(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") % 97).alias("mtime"))
    return A.retention_plan(files, 100_000).select("path")


@query("WIN_4_best_match", ctes("faces").rstrip() + """, s AS (SELECT file_path, label, CASE WHEN lower(label) = 'person 4 anna' THEN 1.0 WHEN contains(lower(label), 'person 4 anna') OR contains('person 4 anna', lower(label)) THEN 0.98
    WHEN contains(lower(label), 'person') OR contains(lower(label), 'anna') THEN 0.95 END AS score FROM faces WHERE label IS NOT NULL)
    SELECT file_path, CAST(max(score) AS DOUBLE) AS score, list_sort(list(DISTINCT label)) AS persons FROM s WHERE score IS NOT NULL GROUP BY file_path""")
def win_4(spark, d):
    from lumenarc.operators.search import person_hits

    return person_hits(made(spark, d, "faces"), "Person 4 Anna").withColumn("score", F.col("score").cast("double"))


@query("WIN_5_cluster_number", "SELECT l_suppkey, dense_rank() OVER (ORDER BY first) - 1 AS cluster FROM (SELECT l_suppkey, min(l_orderkey * 1000 + l_suppkey) AS first FROM lineitem GROUP BY l_suppkey) t")
def win_5(spark, d):
    roots = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min(F.col("l_orderkey") * 1000 + F.col("l_suppkey")).alias("root"))
    return S.cluster_numbers(roots).join(roots, "root").select("l_suppkey", "cluster")


@query("WIN_6_first_term_wins", ctes("records") + """SELECT file_path, CASE WHEN r = 0 THEN 0.90 ELSE 0.88 END AS score, q AS matched_query FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY r) AS k FROM (
    SELECT file_path, 0 AS r, 'ering' AS q FROM (SELECT file_path FROM records WHERE contains(lower(concat_ws(chr(1), title, description)), 'ering') ORDER BY file_path LIMIT 40) a
    UNION ALL SELECT file_path, 1, 'einer' FROM (SELECT file_path FROM records WHERE contains(lower(concat_ws(chr(1), title, description)), 'einer') ORDER BY file_path LIMIT 40) b
    UNION ALL SELECT file_path, 2, 'thing' FROM (SELECT file_path FROM records WHERE contains(lower(concat_ws(chr(1), title, description)), 'thing') ORDER BY file_path LIMIT 40) c) u) t WHERE k = 1""")
def win_6(spark, d):
    from lumenarc.operators.search import metadata_hits

    return metadata_hits(made(spark, d, "records"), "ering", ["thing", "einer"], ("title", "description"))


@query("WIN_7_best_face", ctes("faces") + "SELECT image_id, arg_max(face_id, (det_score, face_id)) AS face_id FROM faces GROUP BY image_id")
def win_7(spark, d):
    from lumenarc.operators.search import best_face

    return best_face(made(spark, d, "faces"))


