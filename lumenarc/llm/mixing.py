"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a target number of words from the weights, at most ``most`` times its size. Its weight over training
time is a line from (1 - drift) to (1 + drift); the integral of that line, scaled to the target, is its cumulative demand.
Every copy of a document has a place in its source's stream of words, and the demand inverted at that place is its training
position. Documents are then range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.llm._store import broadcast_below, cut
from lumenarc.operators.windows import row_numbers, running_totals

WEIGHTS = (5.0, 2.0, 1.0)
#: Slope of the weight lines, by source: declining, level, rising.
DRIFTS = (-0.5, 0.0, 0.5)
MOST = 3
BROADCAST_ROWS = 250_000
#: Sources up to which one task orders them (one row each); more are range-partitioned.
SMALL_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Runs outside [\\x20\\x09-\\x0D]; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _cycle(values: tuple[float, ...], number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, drifts: tuple[float, ...] = DRIFTS) -> DataFrame:
    """(source, source_size, number, target, drift) from (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn. Targets share the sum of all sizes by weight; none exceeds ``most``
    times its source's size, and what it may not take goes to the others by weight. With c(lambda) = sum of
    min(most * size, lambda * weight) the capped sources are those of least size/weight, found with running totals in that order.
    """
    small = sizes.count() <= SMALL_SOURCES
    numbered = row_numbers(sizes, [F.col("source").isNull(), F.col("source")], "number", start=0, small=small)
    named = numbered.withColumns({"weight": _cycle(weights, F.col("number")), "drift": _cycle(drifts, F.col("number"))})
    cap = F.col("source_size") * most
    running = running_totals(named, [cap / F.col("weight"), F.col("number")], {"cap_before": cap, "weight_before": F.col("weight")}, small=small)
    running = cut(running)
    total, weight = running.agg(F.sum("source_size"), F.sum("weight")).first()
    capped = (F.lit(total) - F.col("cap_before")) * F.col("weight") >= cap * (F.lit(weight) - F.col("weight_before"))
    at = running.withColumns({"cap": cap, "capped": capped})
    held, rest = at.agg(F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)), F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight")))).first()
    level = (total - held) / rest if rest else 0.0
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return at.select("source", "source_size", "number", "drift", target.alias("target"))


def position(share: Column, drift: Column) -> Column:
    """The time in 0..1 at which the integral of 1 + drift (2 t - 1) reaches ``share``."""
    a, b = drift, 1 - drift
    root = (F.sqrt(b * b + 4 * a * share) - b) / (2 * a)
    return F.when(drift == 0, share).otherwise(root)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
         most: int = MOST, drifts: tuple[float, ...] = DRIFTS, seed: int = 17) -> DataFrame:
    """One row per distinct (id, source, size): rows with it, source_size, target, copies and the position of each copy.

    A source takes all its documents target/size times in full, and of the remaining words those documents whose
    middle lies before the remainder in hash order; so its words differ from the target by at most half a document (or half a set of rows with equal id, source and size).
    Null texts have size 0 and take nothing; null sources are a source; an empty table gives an empty plan.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    units = cut(sized.groupBy("id", "source", "size").agg(F.count("*").alias("rows")))
    sizes = cut(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")))
    targets = cut(source_targets(sizes, weights, most, drifts))
    n_sources = targets.count()
    first = cut(running_totals(targets, [F.col("number")], {"start": F.col("source_size")}, small=n_sources <= SMALL_SOURCES))
    tied = units.join(broadcast_below(first, n_sources, BROADCAST_ROWS), units["source"].eqNullSafe(first["source"])).drop(first["source"])
    words = F.col("size") * F.col("rows")
    placed = running_totals(tied, [F.col("number"), F.md5(F.concat_ws("|", F.col("id").cast("string"), F.col("size").cast("string"), F.lit(str(seed)))), F.col("id")], {"place": words})
    inside = F.col("place") - F.col("start") + words / 2
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    remainder = F.col("target") - F.col("passes") * F.col("source_size")
    placed = placed.withColumns({"passes": passes, "inside": inside})
    copies = (F.col("passes") + ((F.col("size") > 0) & (F.col("inside") < remainder)).cast("int")) * (F.col("size") > 0).cast("int")
    placed = placed.withColumn("copies", copies)
    share = lambda k: (k * F.col("source_size") + F.col("inside")) / F.col("target")
    at = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: position(F.least(share(k), F.lit(1.0)), F.col("drift"))))
    return cut(placed.select("id", "source", "size", "rows", "source_size", "target", "copies", at.alias("positions")))


def by_position(rows: DataFrame) -> DataFrame:
    """Rows of (position, id) range-sorted by training position; those without one come last."""
    return rows.repartitionByRange(F.col("position").asc_nulls_last(), F.xxhash64("id")).sortWithinPartitions(F.col("position").asc_nulls_last(), "id")


def training_order(units: DataFrame) -> DataFrame:
    """The plan's copies, one row each, in order of training position; units that aren't taken come last, with null."""
    return by_position(units.withColumn("position", F.explode_outer("positions")).drop("positions"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` as training takes them: each row as often as its copies, in range-sorted order of position; all columns stay.

    Texts of size 0 (null, empty, blank) are not taken; a null source is a source; repeated rows are taken alike, ties in position go by id; an empty table gives an empty one.
    """
    units = plan(docs, id_col, text_col, source_col, **options)
    taken = units.where("copies > 0").select(F.col("id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_size"), F.col("positions").alias("__mix_at"))
    n = taken.count()
    own = F.col("__mix_own") == F.col("__mix_size")
    on = F.col(id_col).eqNullSafe(F.col("__mix_id")) & F.col(source_col).eqNullSafe(F.col("__mix_source")) & own
    rows = docs.withColumn("__mix_own", word_count(F.col(text_col))).join(broadcast_below(taken, n, BROADCAST_ROWS), on)
    rows = rows.withColumn("__mix_position", F.explode("__mix_at"))
    return rows.repartitionByRange("__mix_position", F.xxhash64(id_col)).sortWithinPartitions("__mix_position", id_col).select(*docs.columns)
