"""Archive tables made from the driver tables; one text each, valid in Spark SQL and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.functions.vectors import doubles, sign_hash

TABLES = {
    "faces": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS face_id, l_orderkey AS image_id, concat('cluster_', l_suppkey) AS cluster_id,
        CASE WHEN max(l_returnflag) <> 'N' THEN concat('Person ', l_suppkey) END AS label, max(l_discount) AS det_score, concat('/arch/o_', l_orderkey, '.jpg') AS file_path,
        CASE WHEN max(l_returnflag) = 'R' THEN 'VERIFIED' ELSE 'KI_AUTO' END AS curation_status FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey""",
    "dated": """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN concat('ca. ', y) WHEN 1 THEN concat(y, ':05:14 12:00:00') WHEN 2 THEN concat(y, '-06-01') END AS date,
        concat('/arch/', y, '_x/o_', o_orderkey, '.jpg') AS file_path, concat('o_', o_orderkey, '.jpg') AS file_name, concat('Sig-', o_custkey) AS signature,
        concat('Atelier ', o_orderpriority) AS creator, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '' ELSE concat('batch_', o_orderkey % 5) END AS import_id,
        y AS true_year FROM (SELECT o_orderkey, o_custkey, o_orderpriority, year(o_orderdate) - o_orderkey % 130 AS y FROM orders) t""",
    "records": """SELECT doc_id AS id, concat('/arch/', source, '/', doc_id, '.tif') AS file_path, concat(doc_id, '.tif') AS file_name, substr(text, 1, 40) AS title, text AS description,
        source AS creator, lang AS signature, CASE WHEN source = 'src0' THEN NULL ELSE source END AS import_id, n_chars FROM documents""",
    "clusters": """SELECT concat('cluster_', s_suppkey) AS id, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN s_name ELSE concat('Person #', s_suppkey) END AS name,
        concat('nation ', s_nationkey) AS notes, CAST(s_nationkey AS BIGINT) AS face_count FROM supplier""",
    "fixity": """SELECT o_orderkey AS id, concat('/arch/o_', o_orderkey, '.jpg') AS file_path, CASE WHEN o_orderpriority = '5-LOW' THEN 'MISSING' WHEN o_orderstatus = 'F' THEN 'OK'
        WHEN o_orderstatus = 'P' THEN 'CORRUPTED' END AS fixity_status, o_orderdate AS last_fixity_check, CASE WHEN o_orderkey % 3 <> 0 THEN sha256(concat('v', o_orderkey)) END AS sha256 FROM orders""",
    "vocabulary": """SELECT p_name AS canonical, min(p_partkey) AS position, min_by(p_type, p_partkey) AS category, min_by(p_brand, p_partkey) AS brand FROM part GROUP BY p_name""",
    "inventory": "SELECT page_id AS id, url AS path, length(html) AS size, page_id % 3 = 0 AS known FROM pages",
    "sides": """SELECT concat('/arch/sheet_', conv_id, CASE turn WHEN 0 THEN '_r.jpg' WHEN 1 THEN '_v.jpg' ELSE concat('x', turn, '.jpg') END) AS file_path,
        CASE WHEN turn = 1 THEN text WHEN conv_id % 5 = 0 THEN '' END AS notes, text AS ocr_text, conv_id, turn FROM conversations""",
    "audit": "SELECT event_id AS id, ts, event_type AS action, 'USER' AS target_type, CAST(user_id AS VARCHAR(20)) AS target_id, props AS details FROM events",
    "sized": "SELECT p_partkey AS id, p_size * 700 AS width, p_size * 300 + p_partkey % 900 AS height, p_brand AS grp FROM part",
}
_FROM = {"faces": "lineitem", "dated": "orders", "records": "documents", "clusters": "supplier", "fixity": "orders", "vocabulary": "part", "inventory": "pages", "sides": "conversations", "audit": "events", "sized": "part"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """An archive table from its driver table, whose rows are dealt out by the column ``by`` where that is given."""
    base = _FROM[name]
    text = TABLES[name].replace(f"FROM {base}", "FROM {base}")
    if name == "fixity":
        text = text.replace("sha256(concat('v', o_orderkey))", "sha2(concat('v', o_orderkey), 256)")
    rows = table(spark, sf_dir, base)
    return spark.sql(text, base=rows.repartition(by) if by else rows)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), doubles(F.col("embedding")).alias("vector"), "label")


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", sign_hash(F.col("vector")).alias("hash"))


def ctes(*names: str) -> str:
    """WITH clause for an oracle."""
    extra = {
        "vectors": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings",
        "hashes": "SELECT vec_id AS id, lower(array_to_string(list_transform(range(16), lambda k: substr('0123456789abcdef', CAST(1 + list_sum(list_transform(range(4), lambda j: CASE WHEN embedding[4 * k + j + 1] > 0 THEN (8 >> j) ELSE 0 END)) AS BIGINT), 1)), '')) AS hash FROM embeddings",
        "edges": "SELECT a, b, similarity FROM (SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])) * list_dot_product(CAST(y.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))), 6) AS similarity FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) p WHERE similarity >= 0.4",
    }
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({(TABLES | extra)[n]})" for n in names) + " "
