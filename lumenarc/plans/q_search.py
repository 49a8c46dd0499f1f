"""Top-k, set operations and composite searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenarc.functions import text as X
from lumenarc.operators import aggregates as A
from lumenarc.operators import catalogue as C
from lumenarc.operators import fixity as Y
from lumenarc.operators import network as N
from lumenarc.operators import search as R
from lumenarc.operators import similarity as S
from lumenarc.operators import vocabulary as W
from lumenarc.operators.windows import Desc, page
from lumenarc.plans.fixtures import ctes, hashes, made, table, vectors
from lumenarc.plans.q_functions import _YEAR
from lumenarc.plans.q_joins import _CO, _vocabulary
from lumenarc.plans.registry import query

_COS = "round(list_dot_product(v.vector, q.vector) / sqrt(list_dot_product(v.vector, v.vector) * list_dot_product(q.vector, q.vector)), 6)"


def _vector(spark, d, i: int = 0) -> list[float]:
    return list(vectors(spark, d).where(F.col("id") == i).select("vector").first()[0])


@query("TOP_1_vector_topk", ctes("vectors") + f"SELECT v.id, {_COS} AS score FROM vectors v, (SELECT vector FROM vectors WHERE id = 0) q WHERE v.label BETWEEN 2 AND 7 AND {_COS} >= 0.1 ORDER BY score DESC, id LIMIT 20")
def top_1(spark, d):
    return S.vector_topk(vectors(spark, d), _vector(spark, d), 20, 0.1, F.col("label").between(2, 7))


@query("TOP_2_vector_topk_batch", ctes("vectors") + f"SELECT query_id, id, score, r AS rank FROM (SELECT q.id AS query_id, v.id, {_COS} AS score, row_number() OVER (PARTITION BY q.id ORDER BY {_COS} DESC, v.id) AS r FROM vectors v, vectors q ) t WHERE r <= 5")
def top_2(spark, d):
    """All vectors are queries."""
    v = vectors(spark, d)
    return S.vector_topk_batch(v, v.withColumnRenamed("id", "query_id"), 5)


@query("TOP_2_topk_grid", ctes("vectors") + f"SELECT query_id, id, score, r AS rank FROM (SELECT q.id AS query_id, v.id, {_COS} AS score, row_number() OVER (PARTITION BY q.id ORDER BY {_COS} DESC, v.id) AS r FROM vectors v, vectors q) t WHERE r <= 7 AND score >= 0.15")
def top_2_grid(spark, d):
    """The way for two large sides, whatever their sizes are here."""
    v = vectors(spark, d)
    return S.topk_grid(v, v.withColumnRenamed("id", "query_id"), 7, 0.15)


_SCORED = "SELECT concat('/arch/', source, '/', doc_id) AS file_path, n_chars % 10 / 10 AS score FROM documents"


@query("TOP_3_hybrid_order", f"SELECT file_path, score FROM ({_SCORED}) t ORDER BY score DESC, file_path DESC LIMIT 50")
def top_3(spark, d):
    hits = spark.sql(_SCORED.replace("FROM documents", "FROM {t}"), t=table(spark, d, "documents"))
    return R.hybrid_order(hits, 50)


@query("TOP_4_page", f"SELECT file_path, score FROM ({_SCORED}) t ORDER BY score DESC, file_path DESC LIMIT 30 OFFSET 60")
def top_4(spark, d):
    hits = spark.sql(_SCORED.replace("FROM documents", "FROM {t}"), t=table(spark, d, "documents"))
    return page(hits, [Desc(F.col("score")), Desc(F.col("file_path"))], 60, 30)


@query("TOP_4_deep_page", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 40 OFFSET 40000")
def top_4_deep(spark, d):
    """Page 1,001 of 40 rows."""
    items = table(spark, d, "lineitem")
    order = [Desc(F.col("l_extendedprice")), *(F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))]
    return page(items, order, 40_000, 40).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("TOP_5_browse", ctes("dated") + f"SELECT file_name, year, CAST(1.0 AS DOUBLE) AS score FROM (SELECT *, {_YEAR} AS year FROM dated) t WHERE year BETWEEN 1890 AND 1910 ORDER BY coalesce(year, 9999), lower(file_name), file_name LIMIT 100")
def top_5(spark, d):
    items = made(spark, d, "dated")
    return R.browse(items, X.year_of_item(F.col("date"), F.col("file_path")), 1890, 1910, None, 100).select("file_name", "year", "score")


@query("TOP_6_audit_recent", ctes("audit") + "SELECT id, action, details FROM audit WHERE target_type = 'USER' AND target_id = '7' ORDER BY id DESC LIMIT 50")
def top_6(spark, d):
    return C.audit_recent(made(spark, d, "audit"), "USER", "7", 50).select("id", "action", "details")


@query("TOP_7_batches_recent", "SELECT user_id AS id, min(ts) AS started_at FROM events GROUP BY user_id ORDER BY started_at DESC, id LIMIT 20")
def top_7(spark, d):
    return C.batches_recent(table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("started_at")), 20)


@query("TOP_8_autocomplete", ctes("vocabulary") + """SELECT term, canonical, is_synonym FROM (SELECT CASE WHEN lower(canonical) LIKE 's%' AND lower(canonical) LIKE 'sm%' THEN canonical WHEN 'syn ' || lower(canonical) LIKE 'sm%' THEN 'syn ' || canonical WHEN lower(brand) LIKE 'sm%' THEN lower(brand) END AS term, canonical,
    NOT lower(canonical) LIKE 'sm%' AS is_synonym, position FROM vocabulary) t WHERE term IS NOT NULL ORDER BY is_synonym, position LIMIT 8""")
def top_8(spark, d):
    return W.autocomplete(_vocabulary(spark, d), " Sm")


@query("TOP_9_authority_search", "SELECT p_partkey AS id, p_name FROM part WHERE (contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')) AND p_type = 'ECONOMY' ORDER BY p_name, p_partkey LIMIT 50")
def top_9(spark, d):
    part = table(spark, d, "part").withColumnRenamed("p_partkey", "id")
    return W.authority_search(part, "RED", ("p_name", "p_brand", "p_type"), "p_name", ("p_type", "ECONOMY")).select("id", "p_name")


@query("TOP_9_authority_lookup", """WITH a AS (SELECT p_partkey AS id, p_name AS canonical, p_brand AS gnd, p_type AS iconclass FROM part), q AS (SELECT CAST(p_partkey AS VARCHAR) AS identifier FROM part UNION SELECT p_name FROM part UNION SELECT p_brand FROM part UNION SELECT p_type || '!' FROM part UNION SELECT p_type FROM part),
    i AS (SELECT CAST(id AS VARCHAR) AS identifier, 0 AS rank, * FROM a UNION ALL SELECT canonical, 1, * FROM a UNION ALL SELECT gnd, 2, * FROM a UNION ALL SELECT iconclass, 3, * FROM a)
    SELECT identifier, id, canonical, gnd, iconclass FROM (SELECT q.identifier, i.id, i.canonical, i.gnd, i.iconclass, row_number() OVER (PARTITION BY q.identifier ORDER BY rank, id) AS r FROM q JOIN i ON q.identifier = i.identifier) t WHERE r = 1""")
def top_9_lookup(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("canonical"), F.col("p_brand").alias("gnd"), F.col("p_type").alias("iconclass"))
    asked = part.select(F.explode(F.array(F.col("id").cast("string"), "canonical", "gnd", F.concat("iconclass", F.lit("!")), "iconclass")).alias("identifier"))
    return W.authority_lookup(part, asked)


@query("TOP_10_corrupted_list", ctes("fixity") + "SELECT file_path, fixity_status FROM fixity WHERE fixity_status IN ('CORRUPTED', 'MISSING', 'READ_ERROR') ORDER BY last_fixity_check DESC, file_path LIMIT 100")
def top_10(spark, d):
    return Y.corrupted_list(made(spark, d, "fixity"), 100).select("file_path", "fixity_status")


def _legs(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("file_path"), "doc_id", "source")
    persons = docs.where("doc_id % 3 = 0").select("file_path", F.lit(0.95).alias("score"), F.array("source").alias("persons"))
    meta = docs.where("doc_id % 2 = 0").select("file_path", F.lit(0.9).alias("score"))
    vec = docs.where("doc_id % 5 < 3").select("file_path", (F.col("doc_id") % 100 / 100).alias("score"))
    return persons, meta, vec


@query("SET_1_fuse_hits", """SELECT '/d/' || doc_id AS file_path, greatest(CASE WHEN doc_id % 3 = 0 THEN 0.95 ELSE 0 END, CASE WHEN doc_id % 2 = 0 THEN 0.9 ELSE 0 END, CASE WHEN doc_id % 5 < 3 THEN doc_id % 100 / 100 ELSE 0 END) AS score,
    CASE WHEN doc_id % 3 = 0 THEN 'person' WHEN doc_id % 2 = 0 THEN 'metadata' ELSE 'clip' END AS match_type, CASE WHEN doc_id % 3 = 0 THEN [source] ELSE [] END AS persons FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0 OR doc_id % 5 < 3""")
def set_1(spark, d):
    return R.fuse_hits(*_legs(spark, d))


@query("SET_2_merge_keywords", "SELECT doc_id, array_to_string([lang, source] || CASE WHEN lang = 'en' THEN [] ELSE ['en'] END || ['carrier'], ',') AS keywords FROM documents")
def set_2(spark, d):
    merged = X.merge_keywords(F.array("lang", "source"), F.array(F.lit("en"), F.col("lang")), F.lit("carrier"))
    return table(spark, d, "documents").select("doc_id", F.array_join(merged, ",").alias("keywords"))


@query("SET_3_expansion_terms", ctes("vocabulary") + "SELECT canonical, list_sort(list_distinct([canonical, 'syn ' || canonical, lower(brand)])) AS terms FROM vocabulary")
def set_3(spark, d):
    return _vocabulary(spark, d).select("canonical", W.expansion_terms(F.col("canonical"), F.col("synonyms")).alias("terms"))


@query("SET_4_intersect_paths", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_suppkey = 2")
def set_4(spark, d):
    of = lambda k: table(spark, d, "lineitem").where(F.col("l_suppkey") == k).select("l_orderkey")
    return of(1).intersect(of(2))


def _search_tables(spark, d):
    """Documents are images: their vector is that of doc_id modulo 500, one face each with its source's name."""
    docs = made(spark, d, "records")
    faces = docs.select("file_path", F.concat(F.lit("Person "), "creator").alias("label"))
    images = docs.join(vectors(spark, d).withColumnRenamed("id", "vid"), F.expr("id % 500 = vid")).select("file_path", "vector")
    return faces, docs, images


@query("SRCH_1_hybrid_search", ctes("records", "vectors").rstrip() + f""", ok AS (SELECT * FROM records WHERE signature = 'en'),
    p AS (SELECT file_path, CASE WHEN lower('Person ' || creator) = 'person src3' THEN 1.0 WHEN contains(lower('Person ' || creator), 'person src3') THEN 0.98 ELSE 0.95 END AS score, ['Person ' || creator] AS persons FROM ok),
    m AS (SELECT file_path, 0.9 AS score FROM ok WHERE contains(lower(concat_ws(chr(1), title, description)), 'person src3') ORDER BY file_path LIMIT 40),
    v AS (SELECT file_path, {_COS} AS score FROM ok JOIN vectors v ON ok.id % 500 = v.id, (SELECT vector FROM vectors WHERE id = 7) q WHERE {_COS} >= 0.28 ORDER BY score DESC, file_path DESC LIMIT 80),
    u AS (SELECT file_path, score, 0 AS r, 'person' AS k, persons FROM p UNION ALL SELECT file_path, score, 1, 'metadata', [] FROM m UNION ALL SELECT file_path, score, 2, 'clip', [] FROM v)
    SELECT file_path, CAST(max(score) AS DOUBLE) AS score, arg_min(k, r) AS match_type, list_sort(list_distinct(flatten(list(persons)))) AS persons FROM u GROUP BY file_path ORDER BY score DESC, file_path DESC LIMIT 25 OFFSET 5""")
def srch_1(spark, d):
    faces, docs, images = _search_tables(spark, d)
    return R.hybrid_search(faces, docs, images, "Person src3", _vector(spark, d, 7), offset=5, limit=25, where=F.col("signature") == "en")


def _all_legs(spark, d, **options):
    """Every leg: faces of some records, clusters by nation, sheets of two neighbouring records, sources as vocabulary."""
    _, docs, images = _search_tables(spark, d)
    faces = docs.where("id % 3 = 0").select("file_path", F.when(F.col("id") % 2 == 0, F.concat(F.lit("Person "), "creator")).alias("label"), F.concat(F.lit("cluster_"), (F.col("id") % 25).cast("string")).alias("cluster_id"))
    nation = table(spark, d, "nation")
    clusters = nation.select(F.concat(F.lit("cluster_"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("src"), (F.col("n_nationkey") % 10).cast("string")).alias("notes"))
    rectos = docs.where("id % 2 = 0").select((F.col("id") + 1).alias("id"), F.col("file_path").alias("recto_path"))
    pairs = docs.join(rectos, "id").select("recto_path", F.col("file_path").alias("verso_path"))
    number = F.col("n_nationkey").cast("long")
    vocabulary = nation.select(F.concat(F.lit("src"), number.cast("string")).alias("canonical"), number.alias("position"), F.array(F.concat(F.lit("src"), (number + 1).cast("string"))).alias("synonyms"))
    return R.hybrid_search(faces, docs, images, "src3", _vector(spark, d, 7), W.expansion_of("src3", vocabulary), ("title", "creator"), where=F.col("signature") != "en",
                           clusters=clusters, pairs=pairs, prompt_vector=_vector(spark, d, 8), **options)


_NORM = "list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"


_LEGS = ctes("records", "vectors").rstrip() + f""", ok AS (SELECT * FROM records WHERE signature <> 'en'),
    f AS (SELECT file_path, CASE WHEN id % 2 = 0 THEN 'Person ' || creator END AS label, 'cluster_' || (id % 25) AS cluster_id FROM ok WHERE id % 3 = 0),
    p AS (SELECT file_path, CAST(0.98 AS DOUBLE) AS score, [label] AS persons FROM f WHERE contains(lower(label), 'src3')
        UNION ALL SELECT file_path, 0.98, [n_name] FROM f JOIN nation ON cluster_id = 'cluster_' || n_nationkey WHERE contains(lower(n_name), 'src3') OR contains('src' || (n_nationkey % 10), 'src3')),
    m0 AS (SELECT file_path, CAST(0.90 AS DOUBLE) AS score FROM ok WHERE contains(lower(concat_ws(chr(1), title, creator)), 'src3') ORDER BY file_path LIMIT 40),
    m1 AS (SELECT file_path, CAST(0.88 AS DOUBLE) AS score FROM ok WHERE contains(lower(concat_ws(chr(1), title, creator)), 'src4') ORDER BY file_path LIMIT 40),
    m AS (SELECT file_path, max(score) AS score FROM (SELECT * FROM m0 UNION ALL SELECT * FROM m1) t GROUP BY file_path),
    b AS (SELECT r.file_path, round(max(m.score) - 0.01, 2) AS score FROM m JOIN records s ON s.file_path = m.file_path JOIN ok r ON r.id = s.id - 1 AND r.id % 2 = 0
        WHERE r.file_path NOT IN (SELECT file_path FROM m) AND r.file_path NOT IN (SELECT file_path FROM p) GROUP BY r.file_path),
    q AS (SELECT list_transform(list_zip({_NORM.format(v='x.vector')}, {_NORM.format(v='y.vector')}), lambda z: 0.75 * z[1] + 0.25 * z[2]) AS vector FROM vectors x, vectors y WHERE x.id = 7 AND y.id = 8),
    v AS (SELECT file_path, {_COS} AS score FROM ok JOIN vectors v ON ok.id % 500 = v.id, q WHERE {_COS} >= 0.2 ORDER BY score DESC, file_path DESC LIMIT 915),
    u AS (SELECT file_path, score, 0 AS r, 'person' AS k, persons FROM p UNION ALL SELECT file_path, score, 1, 'metadata', [] FROM m UNION ALL SELECT file_path, score, 1, 'metadata', [] FROM b UNION ALL SELECT file_path, score, 2, 'clip', [] FROM v),
    fused AS (SELECT file_path, CAST(max(score) AS DOUBLE) AS score, arg_min(k, r) AS match_type, list_sort(list_distinct(flatten(list(persons)))) AS persons FROM u GROUP BY file_path)"""


@query("SRCH_1_hybrid_search_all_legs", _LEGS + " SELECT * FROM fused ORDER BY score DESC, file_path DESC LIMIT 300 OFFSET 5")
def srch_1_all(spark, d):
    return _all_legs(spark, d, offset=5, limit=300)


def _greedy(hits: str, threshold: float) -> str:
    """CTEs that stack ``hits`` (q, id, rank, vector) by the greedy rule, one rank after the other; ``walk`` has every hit's stack_of, a rank."""
    return f"""h AS MATERIALIZED ({hits}),
    near AS MATERIALIZED (SELECT b.q, b.rank, list_sort(list(a.rank)) AS earlier FROM h a JOIN h b ON a.q = b.q AND a.rank < b.rank AND round(list_dot_product(a.vector, b.vector) / sqrt(list_dot_product(a.vector, a.vector) * list_dot_product(b.vector, b.vector)), 6) >= {threshold} GROUP BY b.q, b.rank),
    lists AS MATERIALIZED (SELECT h.q, h.rank, coalesce(earlier, []) AS earlier FROM h LEFT JOIN near USING (q, rank)),
    walk AS (SELECT q, rank, CAST([rank] AS BIGINT[]) AS heads, CAST(rank AS BIGINT) AS stack_of FROM lists WHERE rank = 1
        UNION ALL SELECT l.q, l.rank, CASE WHEN len(list_intersect(l.earlier, w.heads)) > 0 THEN w.heads ELSE list_append(w.heads, l.rank) END, CASE WHEN len(list_intersect(l.earlier, w.heads)) > 0 THEN list_min(list_intersect(l.earlier, w.heads)) ELSE l.rank END
        FROM walk w JOIN lists l ON l.q = w.q AND l.rank = w.rank + 1)"""


_STACKED = _LEGS + ", " + _greedy("SELECT 0 AS q, CAST(row_number() OVER (ORDER BY f.score DESC, f.file_path DESC) AS BIGINT) AS rank, f.file_path, f.score, f.match_type, f.persons, v.vector FROM fused f JOIN records r USING (file_path) JOIN vectors v ON r.id % 500 = v.id", 0.92)


@query("SRCH_1_hybrid_search_stacked", _STACKED.replace("LIMIT 915),", "LIMIT 180),") + " SELECT file_path, score, match_type, persons, n AS stack_size FROM (SELECT stack_of AS rank, count(*) AS n FROM walk GROUP BY stack_of) s JOIN h USING (rank) ORDER BY score DESC, file_path DESC LIMIT 60")
def srch_1_stacked(spark, d):
    """All hits are stacked, then paged."""
    return _all_legs(spark, d, offset=0, limit=60, stack=0.92)


@query("SRCH_2_similar_images", ctes("vectors") + f"SELECT v.id, {_COS} AS score FROM vectors v, (SELECT vector FROM vectors WHERE id = 11) q ORDER BY score DESC, id LIMIT 12")
def srch_2(spark, d):
    return R.similar_images(vectors(spark, d), 11)


_ALIKE = ctes("vectors").rstrip() + ", " + _greedy(f"SELECT 0 AS q, CAST(row_number() OVER (ORDER BY score DESC, id) AS BIGINT) AS rank, id, score, vector FROM (SELECT v.id, v.vector, {_COS} AS score FROM vectors v, (SELECT vector FROM vectors WHERE id = 11) q) t WHERE score >= 0", 0.3)


@query("SRCH_2_similar_images_stacked", _ALIKE + " SELECT id, score, n AS stack_size FROM (SELECT stack_of AS rank, count(*) AS n FROM walk GROUP BY stack_of) s JOIN h USING (rank) ORDER BY rank LIMIT 30")
def srch_2_stacked(spark, d):
    return R.similar_images(vectors(spark, d), 11, 30, stack=0.3)


_FACES = """f AS (SELECT l_orderkey % 2000 AS image, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS face_id, max(l_discount) AS det_score FROM lineitem GROUP BY ALL),
    w AS (SELECT image, arg_max(face_id, (det_score, face_id)) AS face_id FROM f GROUP BY image)"""


@query("SRCH_3_vector_search", ctes("vectors").rstrip() + f", {_FACES} SELECT query_id, id, score, r AS rank, face_id FROM (SELECT q.id AS query_id, v.id, {_COS} AS score, row_number() OVER (PARTITION BY q.id ORDER BY {_COS} DESC, v.id) AS r FROM vectors v, vectors q WHERE q.id % 100 = 0) t LEFT JOIN w ON id = image WHERE r <= 3 AND score >= 0.2")
def srch_3(spark, d):
    v = vectors(spark, d)
    faces = spark.sql("SELECT l_orderkey % 2000 AS image_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS face_id, max(l_discount) AS det_score FROM {t} GROUP BY 1, 2", t=table(spark, d, "lineitem"))
    return R.search_faces(v, v.where("id % 100 = 0").withColumnRenamed("id", "query_id"), faces, 3, 0.2)


_STK = ctes("vectors").rstrip() + ", " + _greedy(f"SELECT q, id, score, vector, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS BIGINT) AS rank FROM (SELECT q.id AS q, v.id, v.vector, {_COS} AS score FROM vectors v, vectors q WHERE q.id % 100 = 0) t WHERE score >= 0.0", 0.25)


@query("STK_1_stack_results", _STK + " SELECT w.q AS query_id, h.id, CAST(h.rank AS INTEGER) AS rank, o.id AS stack_of FROM walk w JOIN h ON h.q = w.q AND h.rank = w.rank JOIN h o ON o.q = w.q AND o.rank = w.stack_of")
def stk_1(spark, d):
    """Every hit of a list takes part, however long it is."""
    v = vectors(spark, d)
    return S.stack_search(v, v.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 0.0, 0.25).select("query_id", "id", "rank", "stack_of")


@query("STK_1_stacks_in_rounds", _STK + " SELECT w.q AS query_id, h.id, CAST(h.rank AS INTEGER) AS rank, o.id AS stack_of FROM walk w JOIN h ON h.q = w.q AND h.rank = w.rank JOIN h o ON o.q = w.q AND o.rank = w.stack_of")
def stk_1_rounds(spark, d):
    """The way of long lists, whatever their lengths are here."""
    v = vectors(spark, d)
    return S.stack_search(v, v.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 0.0, 0.25, list_rows=1).select("query_id", "id", "rank", "stack_of")


@query("VAR_1_find_variants", ctes("vectors", "hashes").rstrip() + f""", p AS (SELECT v.id, {_COS} AS score, CAST(bit_count(xor(CAST('0x' || h.hash AS UBIGINT), CAST('0x' || g.hash AS UBIGINT))) AS INTEGER) AS distance FROM vectors v JOIN hashes h ON h.id = v.id, (SELECT vector FROM vectors WHERE id = 5) q, (SELECT hash FROM hashes WHERE id = 5) g WHERE v.id <> 5)
    SELECT id, score, distance, CASE WHEN score >= 0.392 OR distance <= 2 THEN 'EXACT_DUPLICATE' WHEN score >= 0.355 OR distance <= 7 THEN 'FORMAT_VARIANT' WHEN score >= 0.29 THEN 'SERIES_VARIANT' WHEN score >= 0.385 THEN 'EXACT_DUPLICATE' WHEN score >= 0.345 THEN 'FORMAT_VARIANT' ELSE 'RELATED' END AS kind
    FROM p WHERE score >= 0.25 ORDER BY score DESC, id LIMIT 25""")
def var_1(spark, d):
    images = vectors(spark, d).select("id", "vector").join(hashes(spark, d), "id")
    return R.find_variants(images, 5, 0.25, shift=-0.6).select("id", "score", "distance", "kind")


@query("TAG_1_zero_shot_tags", ctes("vectors") + f"SELECT query_id, id, score, r AS rank, round(greatest(0.0, least(1.0, (score - 0.15) / 0.20)) * 100, 1) AS confidence FROM (SELECT q.id AS query_id, v.id, {_COS} AS score, row_number() OVER (PARTITION BY q.id ORDER BY {_COS} DESC, v.id) AS r FROM vectors v, vectors q) t WHERE r <= 5 AND (score >= 0.2 OR r <= 2)")
def tag_1(spark, d):
    """All vectors are terms."""
    v = vectors(spark, d)
    ranked = S.best_for_rows(v.withColumnRenamed("id", "query_id"), v, 10)
    return R.zero_shot_tags(ranked, 5)


_TAGGED = """t AS (SELECT '/d/' || doc_id AS file_path, [source, lang] AS keywords, doc_id FROM documents WHERE doc_id % 5 <> 4),
    c AS (SELECT '/d/' || doc_id AS file_path, doc_id, CASE doc_id % 3 WHEN 0 THEN [lang, 'tag a'] ELSE ['tag b', 'tag b'] END AS tags, CASE WHEN doc_id % 2 = 0 THEN 'glass' END AS carrier FROM documents WHERE doc_id % 3 < 2)"""


def _apply_tags(spark, d):
    docs = table(spark, d, "documents").withColumn("file_path", F.concat(F.lit("/d/"), F.col("doc_id").cast("string")))
    known = docs.where("doc_id % 5 <> 4").select("file_path", F.array("source", "lang").alias("keywords"))
    tags = F.when(F.col("doc_id") % 3 == 0, F.array("lang", F.lit("tag a"))).otherwise(F.array(F.lit("tag b"), F.lit("tag b")))
    chosen = docs.where("doc_id % 3 < 2").select("file_path", tags.alias("tags"), F.when(F.col("doc_id") % 2 == 0, "glass").alias("carrier"), F.lit(None).cast("string").alias("operator"))
    return C.apply_tags(known, chosen, 1000, F.current_timestamp())


@query("TAG_2_apply_tags", f"""WITH {_TAGGED}, k AS (SELECT coalesce(t.file_path, c.file_path) AS file_path, coalesce(t.keywords, []) AS old, c.tags, c.carrier FROM t FULL JOIN c ON t.file_path = c.file_path)
    SELECT file_path, array_to_string(old || list_filter(CASE WHEN tags IS NULL THEN [] ELSE CASE WHEN len(tags) = 2 AND tags[1] = tags[2] THEN [tags[1]] ELSE tags END END, lambda x: NOT list_contains(old, x)) || CASE WHEN carrier IS NULL THEN [] ELSE [carrier] END, ',') AS keywords FROM k""")
def tag_2(spark, d):
    return _apply_tags(spark, d)[0].select("file_path", F.array_join("keywords", ",").alias("keywords"))


@query("TAG_2_audit_rows", f"""WITH {_TAGGED} SELECT 999 + row_number() OVER (ORDER BY file_path) AS id, 'APPLY_GND_TAGS' AS action, file_path AS target_id, '{{"tags_added":["' || array_to_string(tags, '","') || '"]' || CASE WHEN carrier IS NULL THEN '' ELSE ',"carrier":"glass"' END || '}}' AS details, 'curator' AS operator FROM c""")
def tag_2_audit(spark, d):
    return _apply_tags(spark, d)[1].select("id", "action", "target_id", "details", "operator")


@query("NET_1_person_graph_edges", ctes("faces").rstrip() + f""", {_CO}, near AS (SELECT other FROM (SELECT CASE WHEN a = 'Person 49' THEN b ELSE a END AS other, shared FROM co WHERE a = 'Person 49' OR b = 'Person 49' ORDER BY shared DESC, other LIMIT 25) t WHERE shared >= 2 ORDER BY shared DESC, other LIMIT 15),
    pick AS (SELECT other AS p FROM near UNION ALL SELECT 'Person 49') SELECT a, b, shared FROM co WHERE a IN (SELECT p FROM pick) AND b IN (SELECT p FROM pick) AND shared >= 2""")
def net_1(spark, d):
    faces = made(spark, d, "faces")
    pairs = A.co_occurrence(faces)
    totals = faces.where("label is not null").groupBy(F.col("label").alias("person")).agg(F.count("*").alias("faces"))
    return N.person_graph(pairs, totals, "Person 49")[1]


@query("NET_1_person_graph_nodes", ctes("faces").rstrip() + f""", {_CO}, near AS (SELECT other FROM (SELECT CASE WHEN a = 'Person 49' THEN b ELSE a END AS other, shared FROM co WHERE a = 'Person 49' OR b = 'Person 49' ORDER BY shared DESC, other LIMIT 25) t WHERE shared >= 2 ORDER BY shared DESC, other LIMIT 15),
    n AS (SELECT label AS id, count(*) AS faces FROM faces WHERE label IS NOT NULL GROUP BY label) SELECT id, faces, CAST(CASE WHEN id = 'Person 49' THEN 38 ELSE greatest(18, least(32, 16 + faces // 10)) END AS INTEGER) AS size FROM n WHERE id = 'Person 49' OR id IN (SELECT other FROM near)""")
def net_1_nodes(spark, d):
    faces = made(spark, d, "faces")
    totals = faces.where("label is not null").groupBy(F.col("label").alias("person")).agg(F.count("*").alias("faces"))
    return N.person_graph(A.co_occurrence(faces), totals, "Person 49")[0]


_HOPS = """pairs AS (SELECT a AS who, b AS other, shared FROM co UNION ALL SELECT b, a, shared FROM co), top AS (SELECT other, shared FROM pairs WHERE who = 'Person 49' ORDER BY shared DESC, other LIMIT 25),
    near AS (SELECT other, row_number() OVER (ORDER BY shared DESC, other) AS place FROM top WHERE shared >= 2 ORDER BY shared DESC, other LIMIT 15),
    second AS (SELECT n.place, b.other, b.shared, row_number() OVER (PARTITION BY n.place ORDER BY b.shared DESC, b.other) AS r FROM near n JOIN pairs b ON b.who = n.other WHERE n.place <= 3),
    s1 AS (SELECT other FROM second WHERE place = 1 AND r <= 7 AND other <> 'Person 49' AND shared >= 2 AND other NOT IN (SELECT other FROM near) ORDER BY r LIMIT 6),
    s2 AS (SELECT other FROM second WHERE place = 2 AND r <= 7 AND other <> 'Person 49' AND shared >= 2 AND other NOT IN (SELECT other FROM near UNION ALL SELECT other FROM s1) ORDER BY r LIMIT 6),
    s3 AS (SELECT other FROM second WHERE place = 3 AND r <= 7 AND other <> 'Person 49' AND shared >= 2 AND other NOT IN (SELECT other FROM near UNION ALL SELECT other FROM s1 UNION ALL SELECT other FROM s2) ORDER BY r LIMIT 6),
    pick AS (SELECT other AS p FROM near UNION ALL SELECT 'Person 49' UNION ALL SELECT other FROM s1 UNION ALL SELECT other FROM s2 UNION ALL SELECT other FROM s3)"""


@query("NET_1_person_graph_two_hops", ctes("faces").rstrip() + f", {_CO}, {_HOPS} SELECT a, b, shared FROM co WHERE a IN (SELECT p FROM pick) AND b IN (SELECT p FROM pick) AND shared >= 2")
def net_1_two_hops(spark, d):
    faces = made(spark, d, "faces")
    totals = faces.where("label is not null").groupBy(F.col("label").alias("person")).agg(F.count("*").alias("faces"))
    return N.person_graph(A.co_occurrence(faces), totals, "Person 49", depth=2)[1]
