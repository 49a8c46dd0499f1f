"""Toxicity by two class-conditional Kneser-Ney models over the letters of texts.

Symbols are UTF-8 bytes: ASCII letters and Latin-1 capitals in lower case, all bytes from 128 on as they are, and one boundary for each run of
anything else; grams of five symbols run across words, so an expression of several words is modelled too. Counts are numbers of documents that hold a gram,
and documents whose least shingle is the same (copies and near copies) share the weight of one.

The shared model is interpolated Kneser-Ney over both classes: pooled counts for five symbols, numbers of distinct left contexts for
four to one, then uniform. A class model discounts each of its counts by what the pooled counts make expected, ``SIGMAS`` standard errors of that and ``DISCOUNT``;
the mass that is discounted backs off to the shared model, so rare expressions get shared probabilities and both models sum to one.
A text's value is the mean over its symbols of its toxic minus its ordinary log-likelihood. A logistic curve makes it a score.

Counts, contexts and probabilities are Spark aggregations over all labelled rows that may be used, and grow with them. Only grams and contexts in which the models
differ go to tasks: by broadcasts of at most ``PART_ROWS`` rows, one after the other through the driver, each applied in its own pass of one chain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenarc.llm._store import broadcast_below, cut, limit_batches
from lumenarc.llm._text import row_sums, slices, span_hashes, windows, words

ORDER = 5
#: Absolute discounts of class counts and of shared counts, and standard errors of the expected count that are discounted, too.
DISCOUNT, SHARED_DISCOUNT, SIGMAS = 1.5, 0.75, 2.0
#: Weight of a document in counts (a document of m copies has a whole part of WEIGHT / m, so sums don't depend on their order).
WEIGHT = 720_720
#: Rows of labels that may be broadcast (24 bytes each and a hash table).
BROADCAST_LABELS = 1_000_000
#: Most rows that the logistic curve is fitted on; taken by least hash of the id.
CALIBRATION_ROWS = 20_000
#: Rows of the models' differences that are gathered and broadcast at once (17 bytes each).
PART_ROWS = 2_000_000
#: Labelled rows that a task counts, at least.
ROWS_PER_TASK = 5_000
#: Grams of a partition from which the models are computed.
GRAMS_PER_TASK = 500_000

_GAP = 32
_SYMBOL = np.full(256, _GAP, np.uint8)
_SYMBOL[65:91] = np.arange(97, 123)
_SYMBOL[97:123] = np.arange(97, 123)
_SYMBOL[128:] = np.arange(128, 256)
_U = np.uint64


def grams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends in each symbol (last symbol lowest), and the offsets of texts in them; a text is preceded by boundaries."""
    s = _SYMBOL[raw]
    if len(s):
        capital = np.r_[False, raw[:-1] == 0xC3] & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
        s[capital] += 32
    gap = s == _GAP
    again = np.r_[False, gap[1:] & gap[:-1]] if len(s) else gap
    starts = offs[:-1][offs[:-1] < offs[1:]]
    again[starts] = gap[starts]  # a boundary at the start says nothing
    kept = np.flatnonzero(~again)
    ends = np.r_[0, np.cumsum(~again)][offs]
    x = s[kept].astype(np.uint64)
    place = np.arange(len(x)) - np.repeat(ends[:-1], np.diff(ends))
    g = x.copy()
    for k in range(1, ORDER):
        back = np.full(len(x), _GAP, np.uint64)
        if k < len(x):
            back[k:] = np.where(place[k:] >= k, x[:-k], _U(_GAP))
        g |= back << _U(8 * k)
    return g, ends


def _least_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, key): the least hash of five words in a row."""
    for batch in batches:
        for part, raw, offs in slices(batch, "text"):
            starts, ends, rows = words(raw, offs)
            win, _, at = windows(span_hashes(raw, starts, ends), rows, part.num_rows, 5)
            key = np.full(part.num_rows, 2**64 - 1, np.uint64)
            np.minimum.at(key, at, win)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(key.view(np.int64))], ["id", "label", "key"])


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, label, n): weights of the documents that hold a gram, summed up in memory up to a bound."""
    held: dict[int, list] = {0: [], 1: []}
    waiting = 0

    def out() -> Iterator[pa.RecordBatch]:
        for label, parts in held.items():
            if parts:
                keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([p[1] for p in parts]))
                parts.clear()
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(np.full(len(keys), label, np.int32)), pa.array(n.astype(np.int64))], ["gram", "label", "n"])

    for batch in batches:
        for part, raw, offs in slices(batch, "text"):
            g, ends = grams(raw, offs)
            row = np.repeat(np.arange(part.num_rows, dtype=np.uint64), np.diff(ends))
            once = np.unique(row << _U(8 * ORDER) | g)
            row, g = (once >> _U(8 * ORDER)).astype(np.int64), once & _U((1 << 8 * ORDER) - 1)
            label, weight = (np.asarray(part.column(part.schema.get_field_index(c)))[row] for c in ("label", "weight"))
            for c in (0, 1):
                own = label == c
                if own.any():
                    keys, inverse = np.unique(g[own], return_inverse=True)
                    held[c].append((keys, np.bincount(inverse, weight[own])))
                    waiting += len(keys)
        if waiting > 8_000_000:
            yield from out()
            waiting = 0
    yield from out()


def shared_backoff(table: DataFrame) -> DataFrame:
    """(gram, shared): the shared probability of each gram's last symbol after the others, from (gram, toxic, ordinary) in documents.

    Every context has at most 256 continuations, which bounds the windows below.
    """
    d = SHARED_DISCOUNT
    levels = [table.select("gram")]
    for k in range(ORDER - 1, 0, -1):
        key = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")
        levels.append(levels[-1].select(key).groupBy("gram").agg(F.count("*").cast("double").alias("n")))
    levels[0] = table.select("gram", (F.col("toxic") + F.col("ordinary")).alias("n"))
    found = None
    for k, level in enumerate(reversed(levels), 1):
        if found is None:
            lower, level = F.lit(1 / 256), level
        else:
            lower = F.col("shared")
            level = level.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(found.withColumnRenamed("gram", "suffix"), "suffix")
        same = Window.partitionBy(F.shiftright("gram", 8))
        held, total = F.sum(F.least("n", F.lit(d))).over(same), F.sum("n").over(same)
        found = level.select("gram", ((F.greatest(F.col("n") - d, F.lit(0.0)) + held * lower) / total).alias("shared"))
    return found


def model_differences(table: DataFrame, discount: float = DISCOUNT, sigmas: float = SIGMAS) -> DataFrame:
    """(key, is_gram, ratio): log ratio toxic to ordinary of grams with class evidence; of other symbols after a context (key of four symbols) with such grams.

    All other symbols have the shared probability in both classes, so their ratio is 0. ``table`` has (gram, toxic, ordinary) in documents.
    A class without documents has no evidence.
    """
    same = Window.partitionBy(F.shiftright("gram", 8))
    both = table.join(shared_backoff(table), "gram")
    for c in ("toxic", "ordinary"):
        both = both.withColumn(f"{c}_all", F.sum(c).over(same))
    pooled, everything = F.col("toxic") + F.col("ordinary"), F.col("toxic_all") + F.col("ordinary_all")
    for c in ("toxic", "ordinary"):
        expected = pooled * F.col(f"{c}_all") / everything
        excess = F.greatest(F.col(c) - expected - sigmas * F.sqrt(expected) - discount, F.lit(0.0))
        both = both.withColumn(f"{c}_own", F.when(F.col(f"{c}_all") > 0, excess / F.col(f"{c}_all")).otherwise(0.0))
    for c in ("toxic", "ordinary"):
        both = both.withColumn(f"{c}_back", 1 - F.sum(f"{c}_own").over(same))
    log = lambda c: F.log(F.col(f"{c}_own") + F.col(f"{c}_back") * F.col("shared"))
    both = both.where("toxic_back < 1 or ordinary_back < 1").select(
        "gram", F.shiftright("gram", 8).alias("context"), (log("toxic") - log("ordinary")).alias("ratio"), (F.log("toxic_back") - F.log("ordinary_back")).alias("back"),
        ((F.col("toxic_own") > 0) | (F.col("ordinary_own") > 0)).alias("own"))
    own = both.where("own").select(F.col("gram").alias("key"), F.lit(True).alias("is_gram"), "ratio")
    return own.unionByName(both.groupBy("context").agg(F.first("back").alias("ratio")).select(F.col("context").alias("key"), F.lit(False).alias("is_gram"), "ratio"))


class Lookup:
    """Values of 64-bit keys: a direct table by hash, and a sorted list for keys whose place is taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(8, int(len(keys) * 2).bit_length())
        keys = keys.astype(np.uint64)
        place = self._place(keys)
        _, first = np.unique(place, return_index=True)
        self.keys, self.values = np.full(1 << self.bits, 2**64 - 1, np.uint64), np.zeros(1 << self.bits)
        self.keys[place[first]], self.values[place[first]] = keys[first], values[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.more, self.more_values = keys[rest], values[rest]
        self.crowded = np.zeros(1 << self.bits, bool)
        self.crowded[place[rest]] = True

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where a key is unknown), and whether each key is known."""
        place = self._place(keys)
        known = self.keys[place] == keys
        out = np.where(known, self.values[place], 0.0)
        ask = np.flatnonzero(~known & self.crowded[place])
        if len(ask):
            at = np.minimum(np.searchsorted(self.more, keys[ask]), len(self.more) - 1)
            hit = self.more[at] == keys[ask]
            out[ask[hit]], known[ask[hit]] = self.more_values[at[hit]], True
        return out, known


@dataclass(frozen=True)
class ToxicityModel:
    """Differences of the class models (key, is_gram, ratio, part), number of parts, the curve's slope and offset, and the share of toxic rows."""

    differences: DataFrame
    parts: int
    slope: float = 1.0
    offset: float = 0.0


def _adder(shared, text_col: str, has_value: bool):
    box: dict = {}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not box:
            key, is_gram, ratio = shared.value
            box["gram"], box["context"] = Lookup(key[is_gram], ratio[is_gram]), Lookup(key[~is_gram], ratio[~is_gram])
        for batch in batches:
            for part, raw, offs in slices(batch, text_col):
                g, ends = grams(raw, offs)
                own, seen = box["gram"](g)
                back, _ = box["context"](g >> _U(8))
                mean = row_sums(np.where(seen, own, back), ends) / np.maximum(np.diff(ends), 1)
                columns = part.columns
                if has_value:
                    mean, columns = mean + np.asarray(columns[-1]), columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(mean)], [*part.schema.names[: len(columns)], VALUE])

    return add


VALUE = "__toxic_value"


def with_value(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with the column VALUE: mean log-likelihood ratio of a text's symbols, 0 for a text without symbols."""
    spark = docs.sparkSession
    limit_batches(spark)
    schema = T.StructType([*docs.schema.fields, T.StructField(VALUE, T.DoubleType())])
    out = docs
    for part in range(model.parts):
        table = model.differences.where(F.col("part") == part).select("key", "is_gram", "ratio").toArrow()  # about PART_ROWS rows
        arrays = tuple(np.asarray(table[c].combine_chunks().to_numpy(zero_copy_only=False)) for c in ("key", "is_gram", "ratio"))
        out = out.mapInArrow(_adder(spark.sparkContext.broadcast(arrays), text_col, part > 0), schema)
    return out


def score_of(model: ToxicityModel) -> Column:
    """The curve at VALUE."""
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), model.slope * F.col(VALUE) + model.offset))
    return 1 / (1 + F.exp(-z))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a small ridge."""
    scale = float(np.std(x)) or 1.0
    z, w = np.c_[x / scale, np.ones(len(x))], np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + 1e-2 * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def best_cut(x: np.ndarray, y: np.ndarray) -> float:
    """The positive value from which calling rows toxic makes fewest errors; the middle of the widest gap that does so.

    It is positive as a value of 0 says that nothing in a text tells the classes apart.
    """
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    errors = np.r_[0, np.cumsum(y)] + np.r_[np.cumsum((1 - y)[::-1])[::-1], 0]
    low, high = np.maximum(np.r_[0.0, x], 0.0), np.r_[x, 2 * max(x[-1], 1e-9)]
    errors[high <= low] = len(x) + 1
    at = min(np.flatnonzero(errors == errors.min()), key=lambda k: low[k] - high[k])
    return float(low[at] + high[at]) / 2


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 folds: int = 5, held_out: int = 0, calibration_rows: int = CALIBRATION_ROWS, part_rows: int = PART_ROWS) -> ToxicityModel:
    """Fit on rows whose crc32(id as text) mod ``folds`` is not ``held_out``: one further fold sets the curve, all others the counts.

    Labels of one id that disagree count as toxic; labels that are null or not 0 or 1, and null ids, aren't used. Texts are whole; null counts as empty.
    Rows of a repeated id count with its label each. At most ``calibration_rows`` rows fit the curve. Without labels of both classes every score is 0.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    fold = F.crc32(F.col("id").cast("string")) % folds
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    marks = cut(marks.groupBy("id").agg(F.max("label").alias("label")).where(fold != held_out))
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    tune = (held_out + folds - 1) % folds
    counted = marks.where(fold != tune)
    n_marks = marks.count()
    known = read.join(broadcast_below(counted, n_marks, BROADCAST_LABELS), "id").select("id", "label", "text")
    kind = known.schema["id"].dataType.simpleString()
    keys = cut(known.mapInArrow(_least_shingles, f"id {kind}, label int, key long"))
    alike = keys.groupBy("label", "key").agg(F.count("*").alias("copies"))
    weighed = keys.join(broadcast_below(alike, n_marks, BROADCAST_LABELS), ["label", "key"]).groupBy("id", "label").agg(F.max("copies").alias("copies"))
    weighed = cut(weighed.select("id", "label", F.floor(F.lit(WEIGHT) / F.col("copies")).alias("weight")))
    # the scan keeps its tasks; the labelled texts that it leaves, few in a partition, are then counted by tasks of some thousand, which sum up more before the shuffle
    texts = cut(read.join(broadcast_below(weighed, n_marks, BROADCAST_LABELS), "id").select("text", "label", "weight"))
    tasks = max(3 * spark.sparkContext.defaultParallelism, n_marks // ROWS_PER_TASK)
    counts = texts.coalesce(tasks).mapInArrow(_counter, "gram long, label int, n long")
    of = lambda c: (F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)) / WEIGHT)
    table = cut(counts.groupBy("gram").agg(of(1).alias("toxic"), of(0).alias("ordinary")))
    # few grams are one partition, in which Spark needs no exchange
    table = table.coalesce(max(1, table.count() // GRAMS_PER_TASK))
    differences = cut(model_differences(table))
    parts = max(1, -(-differences.count() // part_rows))
    # a gram is in the part of its context
    context = F.when(F.col("is_gram"), F.shiftright("key", 8)).otherwise(F.col("key"))
    model = ToxicityModel(differences.withColumn("part", F.pmod(F.xxhash64(context), F.lit(parts))), parts)
    # ids are chosen before texts are read
    chosen = marks.where(fold == tune).orderBy(F.xxhash64("id"), "id").limit(calibration_rows)
    scored = with_value(read.join(F.broadcast(chosen), "id").select("label", "text"), model).select("label", VALUE).toArrow()
    value, label = np.asarray(scored[VALUE], float), np.asarray(scored["label"], float)
    slope, offset = 0.0, -30.0
    if len(value) and label.min() < label.max():
        slope, offset = logistic(value, label)
        # values that don't rise with toxicity tell nothing
        slope, offset = (slope, -slope * best_cut(value, label)) if slope > 0 else (0.0, float(np.log(label.mean() / (1 - label.mean()))))
    return ToxicityModel(model.differences, parts, slope, offset)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, value (mean log-likelihood ratio) and score (0 to 1). Empty and null texts have value 0, whose score is under 0.5
    where both labels occur; ids may be null or repeat, each row is scored alone; an empty table gives an empty one."""
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return with_value(read, model).select(F.col("id").alias(id_col), F.col(VALUE).alias("value"), score_of(model).alias("score"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without documents whose score reaches ``threshold``; all columns and other rows stay, repeated ones and those with null or empty texts too."""
    return with_value(docs, model, text_col).where(score_of(model) < threshold).select(*docs.columns)
