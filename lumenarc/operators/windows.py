"""Running totals and row numbers over a whole table without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.operators.graph import checkpointed


class Desc(NamedTuple):
    """A descending part of an order (nulls last); plain columns are ascending."""

    column: Column


def _values(order: Sequence[Column | Desc]) -> list[Column]:
    return [c.column if isinstance(c, Desc) else F.col(c) if isinstance(c, str) else c for c in order]


def _sorted_by(order: Sequence[Column | Desc], columns: Sequence[Column]) -> list[Column]:
    return [c.desc() if isinstance(o, Desc) else c.asc() for o, c in zip(order, columns, strict=True)]


def running_totals(df: DataFrame, order: Sequence[Column | Desc], sums: dict[str, Column], partitions: int | None = None, small: bool = False) -> DataFrame:
    """``df`` with one column per entry of ``sums``: the total of its value over all rows before this one.

    Rows are range-partitioned by ``order`` (append a hash or a key so that equal values can be split), each
    partition is summed by itself, and the partitions' totals (one row each) are added up before it. A table that the caller
    knows to be ``small`` is one window.
    """
    if small:
        whole = Window.orderBy(*_sorted_by(order, _values(order))).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *(F.coalesce(F.sum(v).over(whole), F.lit(0)).alias(k) for k, v in sums.items()))
    keys = [c.alias(f"__order{i}") for i, c in enumerate(_values(order))]
    spread = df.select("*", *keys)
    by = _sorted_by(order, [F.col(f"__order{i}") for i in range(len(order))])
    spread = spread.repartitionByRange(partitions, *by) if partitions else spread.repartitionByRange(*by)
    spread = checkpointed(spread.withColumn("__part", F.spark_partition_id()))
    local = Window.partitionBy("__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inner = spread.select("*", *(F.coalesce(F.sum(v).over(local), F.lit(0)).alias(f"__local_{k}") for k, v in sums.items()))
    totals = spread.groupBy("__part").agg(*(F.sum(v).alias(f"__sum_{k}") for k, v in sums.items()))
    # one row per partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *(F.coalesce(F.sum(f"__sum_{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in sums))
    joined = inner.join(F.broadcast(offsets), "__part")
    out = [(F.col(f"__local_{k}") + F.col(f"__before_{k}")).alias(k) for k in sums]
    return joined.select(*(F.col(c) for c in df.columns), *out)


def row_numbers(df: DataFrame, order: Sequence[Column | Desc], name: str = "row_no", start: int = 1, small: bool = False, ties: Sequence[Column] = ()) -> DataFrame:
    """``df`` with a gapless number in the given order.

    Rows are dealt out by ranges of ``order`` once and numbered where they lie, then the counts of the partitions before are added. ``ties`` put rows of equal ``order`` in order; they are worked out
    only where such rows are compared, and are neither sent nor kept, so they may be long texts.
    """
    if small:
        return running_totals(df, [*order, *ties], {name: F.lit(1)}, small=True).withColumn(name, (F.col(name) + start).cast("long"))
    keys = [c.alias(f"__order{i}") for i, c in enumerate(_values(order))]
    by = _sorted_by(order, [F.col(f"__order{i}") for i in range(len(order))])
    spread = df.select("*", *keys).repartitionByRange(*by).sortWithinPartitions(*by, *ties)
    # partition and place in it, as Spark packs them
    spread = checkpointed(spread.select(*(F.col(c) for c in df.columns), F.monotonically_increasing_id().alias("__at")))
    part, place = F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy(part).count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    joined = spread.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return joined.select(*(F.col(c) for c in df.columns), (F.col("__before") + place + start).cast("long").alias(name))


#: Rows up to which a page comes from one sorted head.
SHALLOW = 10_000


def page(df: DataFrame, order: Sequence[Column | Desc], offset: int, limit: int, shallow: int = SHALLOW) -> DataFrame:
    """TOP-4: rows ``offset`` to ``offset + limit`` in the given order, in that order; ``order`` should tell all rows apart.

    A page near the start is a top-k. For a deeper one rows are range-partitioned and counted per partition, and only the partitions that hold the page (mostly one or two) are sorted, so that no task sees
    the ``offset`` rows before it.
    """
    if offset + limit <= shallow:
        return df.orderBy(*_sorted_by(order, _values(order))).offset(offset).limit(limit)
    keys = [c.alias(f"__order{i}") for i, c in enumerate(_values(order))]
    spread = df.select("*", *keys)
    by = _sorted_by(order, [F.col(f"__order{i}") for i in range(len(order))])
    spread = checkpointed(spread.repartitionByRange(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by).withColumn("__part", F.spark_partition_id()))
    before, chosen, skip = 0, [], 0
    for r in spread.groupBy("__part").count().orderBy("__part").collect():  # one row per partition
        if before < offset + limit and before + r["count"] > offset:
            skip = skip if chosen else offset - before
            chosen.append(r["__part"])
        before += r["count"]
    return spread.where(F.col("__part").isin(chosen)).orderBy(*by).offset(max(skip, 0)).limit(limit).select(*df.columns)
