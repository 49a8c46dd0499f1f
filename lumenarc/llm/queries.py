"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.llm import alignment, centroids, dart_minhash, exact_dedup, html_main, mixing, packing, quality_rules, token_binary, token_counts, toxicity, url_rules, warc
from lumenarc.llm._store import cut, fresh_path
from lumenarc.llm._tokens import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no words and fail the base; repeated rows each have a row; without trusted rows or documents see quality()."""
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.quality(_table(spark, sf_dir, "documents"), trusted)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without words (null, empty, blank) are one class; repeated rows each have a row; an empty table gives an empty one."""
    return dart_minhash.near_duplicate_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are one piece of one token; repeated rows are documents of their own; an empty table gives no pieces."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In training order: taken is a document's size for each of its training positions; first_position is the earliest one, in millionths of the training time
    (null, and last, for documents that aren't taken). Null texts have size 0, null sources are a source, repeated rows each have a row."""
    units = mixing.plan(_table(spark, sf_dir, "documents")).withColumn("position", F.get("positions", F.lit(0)))
    each = mixing.by_position(units.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))))
    taken = F.col("size") * F.coalesce(F.size("positions"), F.lit(0))
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), F.floor(F.col("position") * 1_000_000).alias("first_position"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null counts as empty; of equal texts of equal length the smallest doc_id stays, null last; repeated rows each have a row."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty html give an empty text; pages with a null or odd url share one host; repeated rows each have a row."""
    return html_main.main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are a segment of one token (the end); repeated rows are documents of their own; an empty table gives no segments."""
    packed = token_binary.write_packed(_table(spark, sf_dir, "documents"), fresh_path(spark, "packed"), tokenizer_path(), id_bytes=2)
    return token_binary.segments(packed, 2).withColumnRenamed("id", "doc_id")


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html is an empty payload; equal payloads of any length are revisits of that with the largest page_id; repeated rows each have a row."""
    path = fresh_path(spark, "warc")
    warc.write_captures(_table(spark, sf_dir, "pages"), path)
    # the archives are read once
    captures = warc.assemble(cut(warc.read_records(spark, path, with_payload=False)))
    return warc.captures_by_page(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have value 0; null ids aren't held out and have no label; repeated rows each have a row; without labels of both classes nothing is toxic."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own, new at every call: an earlier run over the contents of even digest fills it, then all documents are counted, so half of
    the contents are hits (column cached) and half are encoded. Null texts count as empty, repeated rows each have a row."""
    docs, cache = _table(spark, sf_dir, "documents"), fresh_path(spark, "token-cache")
    token_counts.token_counts(docs.where(F.crc32(F.coalesce("text", F.lit(""))) % 2 == 0), tokenizer_path(), cache)
    return token_counts.token_counts(docs, tokenizer_path(), cache)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts, and texts that either tokenizer does not give back byte for byte, have zeros; repeated rows each have a row."""
    return alignment.alignment_scores(_table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of other widths or with null or non-finite components have no row; repeated rows each have one; an empty table gives an empty one."""
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


#: Listed rules as host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that association rules are mined from are the listed rules' verdicts. Null urls have an empty host and path and are allowed; repeated rows each have a row."""
    values = ", ".join(str(r) for r in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")
    return url_rules.judge(_table(spark, sf_dir, "pages"), rules)


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_near_duplicates, op3_best_fit_packing, op4_mix_sources, op5_exact_dedup, op6_html_main_text, op7_token_binary, op8_warc_round_trip, op9_toxicity, op10_token_counts,
              op11_token_alignment, op12_centroid_clusters, op13_url_filters)
}


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Long form (vector, place, component); a round's nearest centroids are ranked by (distance, number)."""
    def assigned(centroids: str) -> str:
        return (f"SELECT r, n, d FROM (SELECT r, n, d, row_number() OVER (PARTITION BY r ORDER BY d, n) AS place FROM "
                f"(SELECT r, n, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN {centroids} c USING (i) GROUP BY r, n) s) p WHERE place = 1")

    parts = [
        "e AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        "v AS MATERIALIZED (SELECT r, i, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM e, range(1, 65) t(i))",
        f"f AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id), embedding) - 1 AS n FROM e QUALIFY n < {k})",
        "c0 AS MATERIALIZED (SELECT n, i, x FROM f JOIN v USING (r))",
    ]
    for t in range(rounds):
        parts.append(f"a{t} AS MATERIALIZED ({assigned(f'c{t}')})")
        parts.append(f"m{t} AS (SELECT n, i, CAST(sum(x) AS BIGINT) AS total, count(*) AS q FROM a{t} JOIN v USING (r) GROUP BY n, i)")
        parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c.n, c.i, CASE WHEN q IS NULL THEN c.x ELSE (total - ((total % q) + q) % q) // q END AS x FROM c{t} c LEFT JOIN m{t} USING (n, i))")
    parts.append(f"z AS MATERIALIZED ({assigned(f'c{rounds}')})")
    parts.append(f"h AS (SELECT n, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY n)")
    return ("WITH " + ",\n".join(parts) + " SELECT vec_id, CAST(n AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY n) AS BIGINT) AS cluster_inertia, "
            "CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM z JOIN e USING (r) JOIN h USING (n)")

ORACLE = {
    "op4_mix_sources": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        u AS (SELECT doc_id, source, size, count(*) AS n FROM d GROUP BY ALL),
        s AS (SELECT source, CAST(sum(size * n) AS BIGINT) AS source_size FROM u GROUP BY source),
        w AS (SELECT *, CAST(CASE number % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number FROM s) x),
        r AS (SELECT *, CAST(coalesce(sum(3 * source_size) OVER b, 0) AS DOUBLE) AS cap_before, coalesce(sum(weight) OVER b, 0) AS weight_before, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS weights
            FROM w WINDOW b AS (ORDER BY 3 * source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        c AS (SELECT *, (total - cap_before) * weight >= 3 * source_size * (weights - weight_before) AS capped FROM r),
        l AS (SELECT *, CAST(sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER () AS DOUBLE) AS held, sum(CASE WHEN capped THEN 0.0 ELSE weight END) OVER () AS rest FROM c),
        t AS (SELECT source, source_size, number, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE weight * ((total - held) / rest) END AS target FROM l),
        p AS (SELECT u.doc_id, u.size, u.n, t.source_size, t.target, t.number, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS passes,
            CAST(coalesce(sum(u.size * u.n) OVER (PARTITION BY t.number ORDER BY md5(concat_ws('|', u.doc_id, u.size, 17)), u.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) + u.size * u.n / 2 AS inside
            FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
            CASE WHEN copies > 0 THEN CAST(floor((CASE WHEN drift = 0 THEN share ELSE (sqrt((1 - drift) * (1 - drift) + 4 * drift * share) - (1 - drift)) / (2 * drift) END) * 1000000) AS BIGINT) END AS first_position
        FROM (SELECT *, CASE WHEN size > 0 THEN passes + CASE WHEN inside < target - passes * source_size THEN 1 ELSE 0 END ELSE 0 END AS copies,
            least(inside / nullif(target, 0), 1.0) AS share, CAST(CASE number % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0 ELSE 0.5 END AS DOUBLE) AS drift, unnest(range(n)) FROM p) q""",
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        r AS (SELECT doc_id, norm, row_number() OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id ASC NULLS LAST) AS place, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
        SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY place) AS keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r""",
    "op8_warc_round_trip": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        s AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last, html FROM p),
        b AS (SELECT *, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(5 * (7 - i % 8) AS BIGINT)) & 31) AS BIGINT), 1)) AS letters FROM s)
        SELECT page_id, payload_bytes, array_to_string(letters, '') AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to FROM b""",
    "op12_centroid_clusters": _clusters_sql(),
}
