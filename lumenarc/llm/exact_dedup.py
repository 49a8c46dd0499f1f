"""Exact deduplication by an extendible-hash index on shared files, in DataFrame functions only.

Each text is normalised (every character of [\\x20\\x09-\\x0D] is deleted) and hashed. The index is a directory
over the leading bits of the hash: a bucket that holds more distinct keys than ``capacity`` splits on its next bit,
which doubles the part of the directory that points to it, until no bucket is overfull or ``max_depth`` bits
are used. Entries get their bucket through the directory and are dealt to owner tasks by ranges of buckets, which write the index to shared files; inside a bucket
entries of one key form a chain, and the bytes of all texts of a chain are compared. Documents look themselves up by slot, bucket and entry. Texts of equal keys and unequal bytes are told apart by their bytes.

Scale: whole texts are read twice, once for keys and once for the comparison, where only texts of chains with
two or more members go on; copies collapse before each shuffle (partial aggregates per task), so a group with a third
of all rows costs each task one row. No texts are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.llm._store import broadcast_below, cut, fresh_path

#: Rows of chains with copies that may be broadcast (about 100 bytes each, so 25 MB).
BROADCAST_ROWS = 250_000
#: Distinct keys that a bucket holds.
CAPACITY = 4_096
#: Prefixes of a partition in which buckets are split.
PREFIXES_PER_TASK = 500_000


def normalised(text: Column) -> Column:
    """Null as empty, every character of [\\x20\\x09-\\x0D] deleted."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for code in (0x20, 0x0A, 0x09, 0x0B, 0x0C, 0x0D):
        out = F.replace(out, F.lit(chr(code)), F.lit(""))
    return out


def directory(keys: DataFrame, capacity: int, max_depth: int) -> tuple[DataFrame, int]:
    """The directory of an extendible hash over distinct ``key``: (slot, bucket, depth) and its depth.

    A bucket holds the keys of a prefix; one that holds more than ``capacity`` keys splits on its next bit, down to ``max_depth`` bits. The
    directory is doubled until its depth is that of the deepest bucket, and then has 2 ** (depth - bucket's depth) slots for a bucket.
    bucket is numbered by depth and prefix. Prefixes without keys have no bucket; no keys give an empty directory of depth 0.
    """
    held = cut(keys.groupBy(F.shiftrightunsigned("key", 64 - max_depth).alias("prefix")).agg(F.count("*").alias("n")).withColumn("depth", F.lit(max_depth)))
    # few prefixes are one partition, in which Spark needs no exchange
    held = held.coalesce(max(1, (1 << max_depth) // PREFIXES_PER_TASK))
    levels = held
    for depth in range(max_depth - 1, -1, -1):
        held = (held.groupBy(F.shiftright("prefix", 1).alias("prefix")).agg(F.sum("n").alias("n")).withColumn("depth", F.lit(depth)))
        held = cut(held) if depth % 4 == 0 else held
        levels = levels.unionByName(held)
    parent = levels.where(F.col("n") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
    fits = levels.where((F.col("n") <= capacity) | (F.col("depth") == max_depth)).withColumn("above", F.shiftright("prefix", 1))
    split = fits.where("depth > 0").join(parent, ["depth", "above"], "left_semi").unionByName(fits.where("depth = 0"))
    buckets = cut(split.select("prefix", "depth", (F.shiftleft("prefix", 6) + F.col("depth")).alias("bucket")))
    depth = buckets.agg(F.max("depth")).first()[0] or 0
    double = F.expr(f"sequence(shiftleft(prefix, {depth} - depth), shiftleft(prefix + 1, {depth} - depth) - 1)")
    return buckets.select(F.explode(double).alias("slot"), "bucket", "depth"), depth


def _slot(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, n_cp (code points of the original text).

    Of equal texts the row with the most code points in the original text stays, then the smallest id (a null id comes
    last); of rows that tie in both, one. Ids may be of any type that can be ordered. Null texts count as empty, empty texts are equal to each other, an empty
    table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    norm = normalised(F.col(text_col))
    read = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("n_cp"))
    heap = read.select("id", "n_cp", F.xxhash64("norm").alias("key"), F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256)).alias("sha"), F.octet_length("norm").cast("long").alias("n_bytes"))
    heap = cut(heap.withColumn("row", F.monotonically_increasing_id()))
    chain = ["bucket", "key", "sha", "n_bytes"]
    best = F.struct((-F.col("n_cp")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))
    some = heap.groupBy("key", "sha", "n_bytes", F.shiftright("row", 33).alias("task")).agg(F.count("*").alias("n"), F.min(best).alias("best"))
    some = cut(some)
    n_some = some.count()
    max_depth = max(4, min(24, math.ceil(math.log2(max(1, n_some) / capacity + 1)) + 3))
    pointers, depth = directory(some.select("key").distinct(), capacity, max_depth)
    pointers = broadcast_below(pointers.select("slot", "bucket"), 1 << depth, BROADCAST_ROWS)
    # entries are placed through the directory; owner tasks take ranges of buckets, and within large buckets of keys
    placed = some.withColumn("slot", _slot(depth)).join(pointers, "slot")
    owned = placed.repartitionByRange("bucket", "key", "sha", "n_bytes").groupBy(*chain)
    path = fresh_path(spark, "exact-index")
    owned.agg(F.sum("n").alias("group_size"), F.min("best").alias("best")).write.parquet(path)
    index = spark.read.parquet(path)
    shared = index.where("group_size > 1")
    n_shared = shared.count()
    compared = _compare_bytes(read, shared.select("key", "sha", "n_bytes"), n_shared)
    equal = shared.join(compared.where("same"), ["key", "sha", "n_bytes"], "left_semi")
    split = shared.join(compared.where("not same"), ["key", "sha", "n_bytes"], "left_semi").select("key", "sha", "n_bytes")
    # every document looks its chain up: slot, bucket, entry
    found = heap.withColumn("slot", _slot(depth)).join(pointers, "slot")
    one = found.join(broadcast_below(equal, n_shared, BROADCAST_ROWS), chain, "left")
    whole = one.select(
        F.col("id"),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "key", "sha", "n_bytes", "n_cp",
    )
    if compared.where("not same").limit(1).count():
        whole = whole.join(split, ["key", "sha", "n_bytes"], "left_anti").unionByName(_chained(read, split))
    return whole.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256", "n_cp")


def _compare_bytes(read: DataFrame, chains: DataFrame, n_chains: int) -> DataFrame:
    """For each chain with several members, whether all have the same bytes: its least text is then its greatest."""
    keyed = read.select("norm", F.xxhash64("norm").alias("key"), F.octet_length("norm").cast("long").alias("n_bytes"))
    keys = chains.select("key", "n_bytes", "sha")
    member = keyed.join(broadcast_below(keys.select("key", "n_bytes").distinct(), n_chains, BROADCAST_ROWS), ["key", "n_bytes"], "left_semi")
    member = member.withColumn("sha", F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256)))
    ends = member.groupBy("key", "sha", "n_bytes").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
    return cut(ends.select("key", "sha", "n_bytes", (F.col("least") == F.col("greatest")).alias("same")))


def _chained(read: DataFrame, split: DataFrame) -> DataFrame:
    """Rows whose keys are equal and whose bytes are not: grouped by the bytes themselves."""
    sha = F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256))
    rows = read.select("id", "n_cp", "norm", F.xxhash64("norm").alias("key"), sha.alias("sha"), F.octet_length("norm").cast("long").alias("n_bytes"))
    rows = rows.join(split, ["key", "sha", "n_bytes"], "left_semi")
    by = Window.partitionBy("key", "sha", "n_bytes", "norm")
    place = F.row_number().over(by.orderBy(F.desc("n_cp"), F.asc_nulls_last("id")))
    rows = rows.withColumn("place", place).withColumn("group_size", F.count("*").over(by))
    rows = rows.withColumn("keep_id", F.max(F.when(F.col("place") == 1, F.col("id"))).over(by))
    return rows.select("id", "keep_id", "group_size", (F.col("place") == 1).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "key", "sha", "n_bytes", "n_cp")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that exact_groups() doesn't keep; all columns stay, in order.

    Dropped rows are found by (id, digest, code points); rows that agree in all three are interchangeable, and of those
    that tie with the row that stays one is kept.
    """
    groups = exact_groups(docs, id_col, text_col, **options)
    same = groups.groupBy(F.col(id_col).alias("__dedup_id"), F.col("text_sha256").alias("__dedup_sha"), F.col("n_cp").alias("__dedup_cp"))
    fate = cut(same.agg(F.max("kept").alias("__dedup_kept"), F.count("*").alias("__dedup_rows")).where("not __dedup_kept or __dedup_rows > 1"))
    n = fate.count()
    # a document's digest is needed only where its id has some row that goes
    ids = broadcast_below(fate.select("__dedup_id").distinct(), n, BROADCAST_ROWS)
    same_id = F.col(id_col).eqNullSafe(F.col("__dedup_id"))
    untouched = docs.join(ids, same_id, "left_anti")
    touched = docs.join(ids, same_id, "left_semi")
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    touched = touched.withColumns({"__dedup_k": F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256), "__dedup_n": F.length(raw).cast("long")})
    on = same_id & (F.col("__dedup_k") == F.col("__dedup_sha")) & (F.col("__dedup_n") == F.col("__dedup_cp"))
    joined = touched.join(broadcast_below(fate, n, BROADCAST_ROWS), on, "left")
    plain = joined.where("__dedup_sha is null")
    ties = joined.where("__dedup_kept and __dedup_rows > 1").dropDuplicates(["__dedup_id", "__dedup_k", "__dedup_n"])
    return untouched.unionByName(plain.unionByName(ties).select(*docs.columns))
