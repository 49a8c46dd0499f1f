"""Keys, scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenarc.functions import images as I
from lumenarc.functions import keys as K
from lumenarc.functions import text as X
from lumenarc.functions import vectors as V
from lumenarc.operators import filters as L
from lumenarc.plans.fixtures import ctes, made, table, vectors
from lumenarc.plans.fixtures import hashes as hash_table
from lumenarc.plans.registry import query

NS = K.ARCHIVE_NAMESPACE.replace("-", "")


def _uuid_sql(name: str) -> str:
    h = f"sha1(unhex('{NS}') || encode({name}))"
    return f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-5', substr({h}, 14, 3), '-', translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr({h}, 18, 3), '-', substr({h}, 21, 12))"


@query("KEY_1_uuid5_image", f"SELECT page_id, {_uuid_sql('url')} AS id FROM pages")
def key_1(spark, d):
    return table(spark, d, "pages").select("page_id", K.uuid5_image(F.col("url")).alias("id"))


@query("KEY_2_uuid5_face", f"SELECT l_orderkey, l_linenumber, {_uuid_sql('''concat('o/', l_orderkey, '.jpg#face_', l_linenumber)''')} AS id FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) t")
def key_2(spark, d):
    faces = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return faces.withColumn("id", K.uuid5_face(F.concat(F.lit("o/"), F.col("l_orderkey").cast("string"), F.lit(".jpg")), F.col("l_linenumber")))


_C3 = "CASE WHEN s_suppkey % 2 = 0 THEN concat('  ', s_suppkey, ' ') ELSE concat('cluster_', s_suppkey) END"


@query("KEY_3_norm_cluster_id", f"SELECT s_suppkey, CASE WHEN regexp_matches(trim(c), '^[0-9]+$') THEN 'cluster_' || trim(c) ELSE trim(c) END AS cluster_id FROM (SELECT s_suppkey, {_C3} AS c FROM supplier) t")
def key_3(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", K.norm_cluster_id(F.expr(_C3)).alias("cluster_id"))


@query("KEY_4_fallback_id", f"SELECT page_id, {_uuid_sql('''regexp_extract(url, '[^/]*$')''')} AS id FROM pages")
def key_4(spark, d):
    return table(spark, d, "pages").select("page_id", K.fallback_id(F.col("url")).alias("id"))


@query("PRJ_1_consolidate_metadata", ctes("records") + """SELECT r.id, coalesce(nullif(trim(CASE WHEN r.id % 3 = 0 THEN ' ' WHEN r.id % 3 = 1 THEN concat(' side ', r.id) END), ''), nullif(trim(r.title), '')) AS title,
    coalesce(nullif(trim(CASE WHEN r.id % 5 = 0 THEN 'Sidecar' ELSE '' END), ''), nullif(trim(CASE WHEN r.id % 2 = 0 THEN r.creator END), ''), nullif(trim(r.signature), '')) AS creator FROM records r""")
def prj_1(spark, d):
    r = made(spark, d, "records")
    side_title = F.expr("CASE WHEN id % 3 = 0 THEN ' ' WHEN id % 3 = 1 THEN concat(' side ', id) END")
    side_creator, tag = F.expr("CASE WHEN id % 5 = 0 THEN 'Sidecar' ELSE '' END"), F.expr("CASE WHEN id % 2 = 0 THEN creator END")
    return r.select("id", *X.consolidate({"title": [side_title, F.col("title")], "creator": [side_creator, tag, F.col("signature")]}))


_WORDS = "array_to_string(list_slice(string_split(text, ' '), 1, 5), ', ')"


@query("PRJ_2_normalise_keywords", f"SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(string_split({_WORDS}, ','), lambda w: trim(w)), lambda w: w <> ''))) AS keywords FROM documents")
def prj_2(spark, d):
    words = F.array_join(F.slice(F.split("text", " "), 1, 5), ", ")
    return table(spark, d, "documents").select("doc_id", X.normalise_keywords(words).alias("keywords"))


_L3 = "CASE WHEN event_id % 3 = 0 THEN concat('[\"', event_type, '\",\"x\"]') WHEN event_id % 3 = 1 THEN concat(event_type, ', y ,') END"


@query("PRJ_3_decode_list", f"SELECT event_id, CASE WHEN t IS NULL THEN [] WHEN t LIKE '[%' THEN CAST(CAST(t AS JSON) AS VARCHAR[]) ELSE list_filter(list_transform(string_split(t, ','), lambda w: trim(w)), lambda w: w <> '') END AS items FROM (SELECT event_id, {_L3} AS t FROM events) e")
def prj_3(spark, d):
    return table(spark, d, "events").select("event_id", X.decode_list(F.expr(_L3)).alias("items"))


_Y = r"(?:^|[^0-9])(1[5-9][0-9]{2}|20[0-9]{2})(?:[^0-9]|$)"
_YEAR = f"coalesce(TRY_CAST(nullif(regexp_extract(coalesce(date, ''), '{_Y}', 1), '') AS INTEGER), list_filter(list_transform(list_reverse(string_split(file_path, '/')), lambda p: TRY_CAST(nullif(regexp_extract(p, '{_Y}', 1), '') AS INTEGER)), lambda y: y IS NOT NULL)[1])"


@query("PRJ_4_year_of_item", ctes("dated") + f"SELECT id, {_YEAR} AS year FROM dated")
def prj_4(spark, d):
    return made(spark, d, "dated").select("id", X.year_of_item(F.col("date"), F.col("file_path")).alias("year"))


@query("PRJ_5_facet_year", ctes("dated") + f"SELECT id, coalesce(TRY_CAST(nullif(regexp_extract(coalesce(date, ''), '{_Y}', 1), '') AS INTEGER), TRY_CAST(nullif(regexp_extract(file_path, '{_Y}', 1), '') AS INTEGER)) AS year FROM dated")
def prj_5(spark, d):
    return made(spark, d, "dated").select("id", X.facet_year(F.col("date"), F.col("file_path")).alias("year"))


@query("PRJ_6_epoch", ctes("dated") + "SELECT id, e.epoch FROM dated JOIN (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in X.EPOCHS) + ") e(epoch, a, b) ON true_year BETWEEN e.a AND e.b")
def prj_6(spark, d):
    return L.with_epochs(made(spark, d, "dated"), "true_year").select("id", "epoch")


_BOX = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, l_extendedprice AS p, CASE WHEN l_linenumber = 7 THEN 0 ELSE 2000 END AS w, 1000 AS h FROM lineitem"


def _boxes(spark, d):
    df = spark.sql(_BOX.replace("FROM lineitem", "FROM {t}"), t=table(spark, d, "lineitem"))
    return df.withColumn("bbox", F.array(F.col("q"), F.col("q") * 2, F.col("q") * 5, F.col("q") * 7))


@query("PRJ_7_bbox_percent", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN w > 0 THEN round(q / w * 100, 4) END AS l, CASE WHEN w > 0 THEN round(q * 2 / h * 100, 4) END AS t, CASE WHEN w > 0 THEN round((q * 5 - q) / w * 100, 4) END AS bw, CASE WHEN w > 0 THEN round((q * 7 - q * 2) / h * 100, 4) END AS bh FROM ({_BOX}) b")
def prj_7(spark, d):
    box = _boxes(spark, d).withColumn("b", I.bbox_percent(F.col("bbox"), F.col("w"), F.col("h")))
    return box.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("b.left").alias("l"), F.col("b.top").alias("t"), F.col("b.width").alias("bw"), F.col("b.height").alias("bh"))


@query("PRJ_8_mwg_region", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((q + q * 5) / 2 / w, 6) AS x, round((q * 2 + q * 7) / 2 / h, 6) AS y, round((q * 5 - q) / w, 6) AS rw, round((q * 7 - q * 2) / h, 6) AS rh FROM ({_BOX}) b WHERE w > 0")
def prj_8(spark, d):
    none = F.lit(None).cast("struct<left: double, top: double, width: double, height: double>")
    box = _boxes(spark, d).withColumn("r", I.mwg_region(none, F.col("bbox"), F.col("w"), F.col("h"))).where("r is not null")
    return box.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("r.x").alias("x"), F.col("r.y").alias("y"), F.col("r.w").alias("rw"), F.col("r.h").alias("rh"))


_CH = "SELECT p_partkey AS id, p_partkey * 7 % 256 AS r, p_partkey * 5 % 256 AS g, p_partkey * 3 % 256 AS b, p_partkey % 100 AS sat, 600 + p_partkey % 700 AS w, 960 AS h, p_partkey * 11 % 90 AS contrast FROM part"


@query("PRJ_9_carrier_rules", f"""SELECT id, CASE WHEN b > r * 1.35 AND b > 70 AND sat > 40 THEN 'cyanotype' WHEN r > b * 1.22 AND r > g AND sat > 25 THEN 'albumen' WHEN sat > 55 AND abs(r - b) > 20 THEN 'colour' ELSE 'silver_gelatin' END AS carrier,
    CASE WHEN q BETWEEN 1.52 AND 1.68 THEN 'carte_de_visite' WHEN q >= 1.40 AND q < 1.52 THEN 'cabinet' WHEN q BETWEEN 1.0 AND 1.12 THEN 'square' WHEN q BETWEEN 1.20 AND 1.38 THEN 'large_plate' ELSE 'normal' END AS format,
    CASE WHEN contrast < 28 THEN 'faded' WHEN contrast > 65 THEN 'good' ELSE 'normal' END AS condition FROM (SELECT *, greatest(w, h) / greatest(least(w, h), 1) AS q FROM ({_CH}) c) x""")
def prj_9(spark, d):
    df = spark.sql(_CH.replace("FROM part", "FROM {t}"), t=table(spark, d, "part"))
    c = F.col
    return df.select("id", I.carrier_type(c("r"), c("g"), c("b"), c("sat")).alias("carrier"), I.format_band(I.aspect_ratio(c("w"), c("h"))).alias("format"), I.condition(c("contrast")).alias("condition"))


def _ocr_sql() -> str:
    t = "replace(coalesce(text, ''), ' en ', ' Meffe  Klofter ſæ ')"
    for old, new in X.OLD_LETTERS:
        t = f"replace({t}, '{old}', '{new}')"
    for pattern, right in X.OCR_TERMS:
        t = f"regexp_replace({t}, '(?i){pattern}', '{right}', 'g')"
    return t


@query("PRJ_10_clean_ocr_text", f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split({_ocr_sql()}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM documents")
def prj_10(spark, d):
    dirty = F.replace(F.coalesce("text", F.lit("")), F.lit(" en "), F.lit(" Meffe  Klofter ſæ "))
    return table(spark, d, "documents").select("doc_id", X.clean_ocr_text(dirty).alias("text"))


@query("PRJ_11_word_count", r"SELECT doc_id, n AS words, n >= 3 OR length(text) >= 15 AS accepted FROM (SELECT doc_id, text, CAST(len(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\s+'), lambda w: w <> '')) AS INTEGER) AS n FROM documents) t")
def prj_11(spark, d):
    return table(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"), X.ocr_accepted(F.col("text")).alias("accepted"))


_LAB = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'VERIFIED' WHEN doc_id % 3 = 1 THEN '' END AS status, CASE WHEN quality = 1 THEN 'x' END AS label FROM labels"


@query("PRJ_12_curation_default", f"SELECT doc_id, coalesce(nullif(trim(status), ''), CASE WHEN label IS NOT NULL THEN 'VERIFIED' ELSE 'KI_AUTO' END) AS state FROM ({_LAB}) l")
def prj_12(spark, d):
    df = spark.sql(_LAB.replace("FROM labels", "FROM {t}"), t=table(spark, d, "labels"))
    return df.select("doc_id", X.curation_default(F.col("status"), F.col("label")).alias("state"))


_HAM = "CAST(bit_count(xor(CAST('0x' || substr(a.hash, 1, 8) AS BIGINT), CAST('0x' || substr(b.hash, 1, 8) AS BIGINT))) + bit_count(xor(CAST('0x' || substr(a.hash, 9, 8) AS BIGINT), CAST('0x' || substr(b.hash, 9, 8) AS BIGINT))) AS INTEGER)"


@query("PRJ_13_hamming64", ctes("hashes") + f"SELECT a.id AS a, b.id AS b, {_HAM} AS distance FROM hashes a JOIN hashes b ON b.id = a.id + 1")
def prj_13(spark, d):
    h = hash_table(spark, d)
    a, b = h.select(F.col("id").alias("a"), F.col("hash").alias("ha"), (F.col("id") + 1).alias("b")), h.select(F.col("id").alias("b"), F.col("hash").alias("hb"))
    return a.join(b, "b").select("a", "b", V.hamming64(F.col("ha"), F.col("hb")).alias("distance"))


@query("PRJ_14_classify_variant", ctes("edges") + "SELECT a, b, CASE WHEN similarity >= 0.485 THEN 'EXACT_DUPLICATE' WHEN similarity >= 0.445 THEN 'FORMAT_VARIANT' ELSE 'RELATED' END AS kind FROM (SELECT a, b, similarity FROM edges) e WHERE similarity >= 0.4 AND NOT (similarity >= 0.39 AND similarity < 0.4)".replace("ELSE 'RELATED'", "WHEN similarity >= 0.39 THEN 'SERIES_VARIANT' ELSE 'RELATED'"))
def prj_14(spark, d):
    from lumenarc.operators.similarity import similarity_join

    return similarity_join(vectors(spark, d), 0.4).select("a", "b", V.classify_variant(F.col("similarity"), shift=-0.5).alias("kind"))


@query("PRJ_15_l2_normalise", "SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3)) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * 9), 6) AS s FROM embeddings")
def prj_15(spark, d):
    tripled = F.transform("vector", lambda x: x * 3)
    return vectors(spark, d).select(F.col("id").alias("vec_id"), F.round(F.aggregate(V.l2_normalise(tripled), F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


@query("PRJ_16_blend_vector", ctes("vectors") + """SELECT id, round(s / sqrt(n), 6) AS first FROM (SELECT v.id, 0.75 * v.vector[1] / sqrt(list_dot_product(v.vector, v.vector)) + 0.25 * q.vector[1] / sqrt(list_dot_product(q.vector, q.vector)) AS s,
    0.5625 + 0.0625 + 0.375 * list_dot_product(v.vector, q.vector) / sqrt(list_dot_product(v.vector, v.vector) * list_dot_product(q.vector, q.vector)) AS n FROM vectors v, (SELECT vector FROM vectors WHERE id = 0) q) t""")
def prj_16(spark, d):
    v = vectors(spark, d)
    aux = F.array(*(F.lit(x) for x in v.where("id = 0").select("vector").first()[0]))
    return v.select("id", F.round(F.get(V.blend_vector(F.col("vector"), aux), F.lit(0)), 6).alias("first"))


@query("PRJ_17_size_ladder", ctes("sized") + "SELECT id, list_filter(list_transform(range(21), lambda k: CAST(power(2, k) AS INTEGER)), lambda s: s = 1 OR s * 512 <= greatest(width, height) * 2) AS factors, list_filter([256, 512, 1024, 2048], lambda s: s < greatest(width, height)) AS previews FROM sized")
def prj_17(spark, d):
    s = made(spark, d, "sized")
    return s.select("id", I.scale_factors(F.col("width"), F.col("height")).alias("factors"), I.preview_sizes(F.col("width"), F.col("height")).alias("previews"))


@query("PRJ_18_person_name", ctes("clusters") + "SELECT id, coalesce(nullif(trim(CASE WHEN face_count % 2 = 0 THEN ' ' ELSE 'Label' END), ''), nullif(trim(name), ''), 'Person #' || replace(id, 'cluster_', '')) AS person FROM clusters")
def prj_18(spark, d):
    label = F.expr("CASE WHEN face_count % 2 = 0 THEN ' ' ELSE 'Label' END")
    return made(spark, d, "clusters").select("id", I.person_name(label, F.col("name"), F.col("id")).alias("person"))


@query("PRJ_19_matched_query", ctes("records") + "SELECT id, CASE WHEN contains(lower(signature), 'en') THEN 'signature: ' || signature WHEN contains(lower(title), 'en') THEN 'title: ' || title WHEN contains(lower(description), 'en') THEN 'description: ' || substr(description, 1, 30) ELSE 'Metadaten' END AS matched FROM records")
def prj_19(spark, d):
    c = {n: F.col(n) for n in ("signature", "title", "description")}
    return made(spark, d, "records").select("id", X.matched_query(F.lit("EN"), c, {"description": 30}, F.lit("Metadaten")).alias("matched"))


@query("PRJ_20_rotation_norm", "SELECT user_id, CAST(((sum(a) % 360) + 360) % 360 AS BIGINT) AS rotation, (((sum(a) % 360) + 360) % 360) IN (90, 270) AS swapped FROM (SELECT user_id, CASE event_type WHEN 'click' THEN 90 WHEN 'error' THEN -90 WHEN 'view' THEN 180 ELSE 0 END AS a FROM events) e GROUP BY user_id")
def prj_20(spark, d):
    angle = F.expr("CASE event_type WHEN 'click' THEN 90 WHEN 'error' THEN -90 WHEN 'view' THEN 180 ELSE 0 END")
    return table(spark, d, "events").groupBy("user_id").agg(I.turned(F.sum(angle)).alias("rotation")).withColumn("swapped", F.col("rotation").isin(90, 270))


@query("FLT_1_in_batch", ctes("dated") + "SELECT id FROM dated WHERE coalesce(nullif(import_id, ''), 'legacy') = 'legacy'")
def flt_1(spark, d):
    return made(spark, d, "dated").where(L.in_batch(F.col("import_id"), "legacy")).select("id")


@query("FLT_2_match_facets", ctes("dated") + f"SELECT id, year FROM (SELECT *, {_YEAR} AS year FROM dated) t WHERE year BETWEEN 1914 AND 1939 AND contains(lower(signature), 'sig-1') AND contains(lower(creator), '5-low') AND coalesce(nullif(import_id, ''), 'legacy') = 'batch_2'")
def flt_2(spark, d):
    items = made(spark, d, "dated").withColumn("year", X.year_of_item(F.col("date"), F.col("file_path")))
    return L.match_facets(items, F.col("year"), signature="SIG-1", creator="5-low", batch="batch_2", epoch="weimar").select("id", "year")


@query("FLT_3_search_metadata", ctes("records") + "SELECT id FROM records WHERE (contains(lower(title), 'tion') OR contains(lower(description), 'tion')) AND coalesce(nullif(import_id, ''), 'legacy') = 'src3' ORDER BY id DESC LIMIT 50")
def flt_3(spark, d):
    return L.search_metadata(made(spark, d, "records"), "TION", ["title", "description"], [F.desc("id")], batch="src3").select("id")


@query("FLT_4_search_clusters", ctes("clusters") + "SELECT id, name FROM clusters WHERE contains(lower(coalesce(name, '')), 'person') OR contains(lower(notes), 'nation 1')")
def flt_4(spark, d):
    return L.search_clusters(made(spark, d, "clusters"), "person").unionByName(L.search_clusters(made(spark, d, "clusters"), "NATION 1")).select("id", "name").distinct()


@query("FLT_5_reading_room_view", ctes("faces", "clusters") + "SELECT face_id AS id, 'face' AS kind FROM faces WHERE curation_status = 'VERIFIED' UNION ALL SELECT id, 'cluster' FROM clusters WHERE trim(coalesce(name, '')) <> '' AND name NOT LIKE 'Person #%'")
def flt_5(spark, d):
    faces = L.reading_room_faces(made(spark, d, "faces")).select(F.col("face_id").alias("id"), F.lit("face").alias("kind"))
    return faces.unionByName(L.reading_room_clusters(made(spark, d, "clusters")).select("id", F.lit("cluster").alias("kind")))


@query("FLT_6_oversize", ctes("sized") + "SELECT id, CAST(width AS BIGINT) * height > 250000000 AS rejected FROM sized")
def flt_6(spark, d):
    return L.split_oversize(made(spark, d, "sized"), F.col("width"), F.col("height"), 250_000_000).select("id", "rejected")


@query("FLT_7_under_prefix", "SELECT page_id FROM pages WHERE starts_with(url, 'https://m.ththth.example.net/') OR starts_with(url, 'https://tionsh.example.net/')")
def flt_7(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").where(L.under_folder(url, "https://m.ththth.example.net") | L.under_folder(url, "https://tionsh.example.net/")).select("page_id")


@query("FLT_8_lookup", ctes("dated") + "SELECT id, file_path FROM dated WHERE id IN (SELECT c_custkey * 2 FROM customer)")
def flt_8(spark, d):
    wanted = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("id"))
    return L.lookup(made(spark, d, "dated"), wanted, ["id"]).select("id", "file_path")


@query("FLT_9_cluster_list", ctes("clusters") + "SELECT id, name FROM clusters WHERE trim(coalesce(name, '')) = '' AND (contains(coalesce(name, ''), '#1') OR contains(id, 'cluster_1')) ORDER BY id LIMIT 20")
def flt_9(spark, d):
    return L.cluster_list(made(spark, d, "clusters"), "#1", named=False, limit=20).select("id", "name")
