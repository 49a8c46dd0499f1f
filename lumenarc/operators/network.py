"""Graph of persons who appear together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarc.operators.graph import checkpointed


def person_graph(pairs: DataFrame, totals: DataFrame, root: str, min_shared: int = 2, depth: int = 1, neighbours: int = 15) -> tuple[DataFrame, DataFrame]:
    """NET-1: nodes (id, faces, size) and edges (a, b, shared) around a person, from co_occurrence() pairs and (person, faces).

    Of the 25 persons who share most images those with ``min_shared`` or more (else the first five), at most ``neighbours``; with depth 2 also at
    most six of each of the first three. Edges join all selected persons: the root's from ``min_shared`` on, others from max(2, min_shared) on.
    ``pairs`` are checkpointed once; every hop then reads them.
    """
    pairs = checkpointed(pairs)

    def around(who: str, n: int) -> list[tuple[str, int]]:
        mine = pairs.where((F.col("a") == who) | (F.col("b") == who)).select(F.when(F.col("a") == who, F.col("b")).otherwise(F.col("a")).alias("other"), "shared")
        return [(r["other"], r["shared"]) for r in mine.orderBy(F.desc("shared"), "other").limit(n).collect()]  # at most 25 rows

    found = around(root, 25)
    near = [(p, n) for p, n in found if n >= min_shared] or found[:5]
    chosen = [p for p, _ in near[:neighbours]]
    if depth >= 2:
        for p in chosen[:3]:
            chosen += [q for q, n in around(p, 7) if q != root and q not in chosen and n >= max(2, min_shared)][:6]
    names = [root, *chosen]
    edges = pairs.where(F.col("a").isin(names) & F.col("b").isin(names))
    own = (F.col("a") == root) | (F.col("b") == root)
    edges = edges.where(F.when(own, F.col("shared") >= min(min_shared, min((n for _, n in near), default=min_shared))).otherwise(F.col("shared") >= max(2, min_shared)))
    size = F.when(F.col("person") == root, F.lit(38)).otherwise(F.greatest(F.lit(18), F.least(F.lit(32), F.lit(16) + F.floor(F.col("faces") / 10))).cast("int"))
    nodes = totals.where(F.col("person").isin(names)).select(F.col("person").alias("id"), "faces", size.alias("size"))
    return nodes, edges
