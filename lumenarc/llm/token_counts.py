"""Token counts through a digest cache.

The cache is a table (content digest, tokenizer digest, n_tokens) in a shared folder. Contents are normalised as the
tokenizer sees them (null becomes empty, UTF-8) and digested; documents whose digests are stored take the stored counts, of the
others one document per distinct content is encoded, and the new counts are appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarc.llm._store import broadcast_below, cut, join_around_hot, limit_batches
from lumenarc.llm._tokens import encoder, tokenizer_digest

CACHE = "content binary, tokenizer binary, n_tokens long"
#: Rows of (digest, id) that may be broadcast, about 60 bytes each.
BROADCAST_ROWS = 250_000
#: Copies from which a content's count is broadcast to its rows.
HOT_ROWS = 1_000


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            n = np.fromiter((len(encode(t.as_py())) for t in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], ["content", "n_tokens"])

    return count


def _read_cache(spark, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), cached (its content's count was stored before). New counts are appended to ``cache``.

    Whole texts; null counts as empty, an empty text has 0 tokens; ids may repeat or be null; an empty table gives an empty one. Copies are
    encoded once: of equal contents the row with the least id (of rows that tie, each; the stored count is the same).
    A lost task is rerun; a rerun append that leaves a digest twice does no harm, as the cache is read as distinct rows.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("content"))
    version = F.unhex(F.lit(tokenizer_digest(tokenizer)))
    entries = cut(read.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "content"))
    stored = _read_cache(spark, cache).where(F.col("tokenizer") == version).select("content").distinct()
    distinct = entries.groupBy("content").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    # cut before the append below, which would otherwise make every content a hit
    state = cut(distinct.join(stored.withColumn("hit", F.lit(True)), "content", "left"))
    # what needs no encoding or not by every row: cached contents, and copies
    special = state.where("hit or copies > 1").select("content", F.coalesce("hit", F.lit(False)).alias("hit"), "first")
    marked = read.join(broadcast_below(special, special.count(), BROADCAST_ROWS), "content", "left")
    todo = marked.where(F.col("hit").isNull() | (~F.col("hit") & F.col("id").eqNullSafe(F.col("first"))))
    new = todo.select("content", "text").mapInArrow(_counter(tokenizer), "content binary, n_tokens long")
    new.select("content", version.alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    known = _read_cache(spark, cache).where(F.col("tokenizer") == version).select("content", "n_tokens").dropDuplicates(["content"])
    counted = state.select("content", "copies", F.coalesce("hit", F.lit(False)).alias("cached")).join(known, "content")
    each = join_around_hot(entries, counted, "content", F.col("copies") >= HOT_ROWS, BROADCAST_ROWS)
    return each.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cached")
