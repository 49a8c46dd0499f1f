"""Graphs as edge tables: connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one of this process, which is then set."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        path = tempfile.mkdtemp(prefix="lumenarc-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage reliably, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Edges that a task holds while it contracts its partition, and from which one task finishes.
HELD_EDGES = 2_000_000
LAST_EDGES = 500_000


def _forest(src: pa.Array, dst: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(node, least node of its component) of all nodes of these edges."""
    names = pa.chunked_array([src, dst]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(names.dictionary).to_numpy(zero_copy_only=False)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[names.indices.to_numpy(zero_copy_only=False)]
    a, b = codes[: len(src)], codes[len(src) :]
    root = np.arange(len(order))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    values = names.dictionary.take(pa.array(order))
    return values, values.take(pa.array(root))


def _contract(loops: bool):
    """Edges of a partition to edges (node, least node of its component in the partition), in bounded memory: beyond HELD_EDGES the forest so far is passed on."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        held = 0
        for batch in batches:
            waiting.append((batch.column(0), batch.column(1)))
            held += batch.num_rows
            if held >= HELD_EDGES and not loops:
                node, root = _forest(*(pa.concat_arrays(x) for x in zip(*waiting, strict=True)))
                waiting, held = [(node, root)], len(node)
                if held > HELD_EDGES // 2:
                    keep = pc.not_equal(node, root)
                    yield pa.RecordBatch.from_arrays([node.filter(keep), root.filter(keep)], ["src", "dst"])
                    waiting, held = [], 0
        if waiting:
            node, root = _forest(*(pa.concat_arrays(x) for x in zip(*waiting, strict=True)))
            if not loops:
                keep = pc.not_equal(node, root)
                node, root = node.filter(keep), root.filter(keep)
            yield pa.RecordBatch.from_arrays([node, root], ["src", "dst"])

    return contract


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) of the same components, at most one per node in each partition: union-find inside each partition."""
    shape = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in ("src", "dst"))
    return edges.select("src", "dst").mapInArrow(_contract(False), shape)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("least")).select("src", F.least("src", "least").alias("least"))
    return both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("least"))
    moved = edges.join(least, "src").where("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.unionByName(least.select("src", F.col("least").alias("dst"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, last_edges: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges(src, dst)``; root is the least node of its component.

    Union-find inside each partition contracts the edges first (one per node and partition stays) and after every round. Rounds of large-star and small-star go on
    until ``last_edges`` (LAST_EDGES) or fewer edges are left, which one task settles, or until nothing changes: every edge ends as (node, root). All on executors; hubs are met by partial minima
    and by skew joins. Self loops and null ends are ignored; no edges give no rows. Raises RuntimeError if ``max_rounds`` rounds don't suffice.
    """
    bound = LAST_EDGES if last_edges is None else last_edges
    now = checkpointed(contracted(edges.where("src <> dst")))
    before = _signature(now)
    for _ in range(max_rounds):
        if before[0] <= bound:
            shape = ", ".join(f"{c} {now.schema[c].dataType.simpleString()}" for c in ("src", "dst"))
            return now.coalesce(1).mapInArrow(_contract(True), shape).toDF("node", "root")
        now = checkpointed(contracted(_small_star(_large_star(now).distinct())))
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    now = now.distinct()
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(roots)
