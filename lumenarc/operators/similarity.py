"""Vector search, similarity joins and classes of similar vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.functions.vectors import cosine, doubles
from lumenarc.operators.graph import checkpointed, connected_components
from lumenarc.operators.windows import Desc, row_numbers

#: Bytes of query vectors that may be broadcast.
BROADCAST_BYTES = 16 << 20
#: Pairs that a cell without a bound on its hits may pass on.
CELL_PAIRS = 2_000_000
#: Hits of a cell that are given to heads.
CELL_HITS = 250_000
#: Pairs of rows of two blocks that are multiplied at once.
STRIP_PAIRS = 1_000_000
#: Rows (ids and numbers) that one task may sort.
SMALL_ROWS = 200_000
#: Pairs of queries and vectors of a cell in which lists are stacked, and heads that it holds unless one query has more.
STACK_PAIRS = 16_000_000
STACK_HEADS = 100_000
#: Hits of a list that one task puts in order.
BAND_HITS = 1_000_000


def vector_topk(vectors: DataFrame, query: list[float] | Column, k: int, threshold: float | None = None, where: Column | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """TOP-1: the k most similar rows (id, score), by score, then id. Filters apply before the ranking."""
    q = F.array(*(F.lit(float(x)) for x in query)) if isinstance(query, list) else query
    df = vectors.where(where) if where is not None else vectors
    scored = df.select(F.col(id_col), F.round(cosine(doubles(F.col(vector_col)), q), 6).alias("score"))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def _matrix(column: pd.Series) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _best(queries: np.ndarray, m: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first query, places in ``m``, scores), the k best of ``m``'s rows in order, for 256 queries at a time; of equal scores the earlier rows come first.

    The first rows of ``m`` are sorted; from then on only scores that round to more than a query's k-th best so far are looked at, so that memory is one strip of the product.
    """
    head = max(512, k)
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        s = np.round(q @ m[:head].T, 6)
        place = np.argsort(-s, axis=1, kind="stable")[:, :k]
        score, width = np.take_along_axis(s, place, 1), place.shape[1]
        for start in range(head, len(m), 2048):
            s = q @ m[start : start + 2048].T
            x, y = np.nonzero(s > score[:, -1:] + 4e-7)
            v = np.round(s[x, y], 6)
            better = v > score[x, -1]
            if not better.any():
                continue
            x, y, v = x[better], y[better], v[better]
            touched = np.unique(x)
            row = np.concatenate([np.repeat(touched, width), x])
            value, column = np.concatenate([score[touched].ravel(), v]), np.concatenate([place[touched].ravel(), start + y])
            order = np.lexsort((column, -value, row))
            sizes = np.unique(row, return_counts=True)[1]
            nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = order[nth < width]
            score[touched], place[touched] = value[order].reshape(-1, width), column[order].reshape(-1, width)
        yield at, place, score


def vector_topk_batch(vectors: DataFrame, queries: DataFrame, k: int | None, threshold: float | None = None) -> DataFrame:
    """TOP-2: for every (query_id, vector) the k most similar of (id, vector): (query_id, id, score, rank); all from ``threshold`` on where k is None.

    Few queries (``BROADCAST_BYTES``) are one broadcast and one pass over the vectors, each batch of which passes on its own best k only; more, or k None, go through a grid of blocks: see topk_grid().
    """
    n, width = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    schema = "query_id long, id long, score double"
    sc = vectors.sparkSession.sparkContext
    if not n:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    if k is None or n * 8 * (width or 1) > BROADCAST_BYTES:
        return topk_grid(vectors, queries, k, threshold)
    table = queries.select("query_id", "vector").toPandas()
    ids, shared = table["query_id"].to_numpy(), sc.broadcast(_matrix(table["vector"]))

    def search(frames: Iterator[pd.DataFrame], ids=ids, shared=shared) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                pdf = pdf.sort_values("id", kind="stable")
                own, m = pdf["id"].to_numpy(), _matrix(pdf["vector"])
                for at, place, score in _best(shared.value, m, k):
                    out = pd.DataFrame({"query_id": np.repeat(ids[at : at + len(place)], place.shape[1]), "id": own[place].ravel(), "score": score.ravel()})
                    yield out if threshold is None else out[out["score"] >= threshold]

    return _ranked(vectors.select("id", "vector").mapInPandas(search, schema), k)


def _ranked(found: DataFrame, k: int | None) -> DataFrame:
    """Ranks per query, the first k of them; Spark keeps a task's first k before the shuffle. All ranks are numbered over the whole table, so that no query's list is one task's."""
    if k is not None:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    numbered = row_numbers(found, [F.col("query_id"), Desc(F.col("score")), F.col("id")], "__no")
    first = numbered.groupBy("query_id").agg(F.min("__no").alias("__first"))
    return numbered.join(first, "query_id").select("query_id", "id", "score", (F.col("__no") - F.col("__first") + 1).cast("int").alias("rank"))


def topk_grid(vectors: DataFrame, queries: DataFrame, k: int | None, threshold: float | None = None, block_rows: int = 16_384) -> DataFrame:
    """TOP-2 with both sides large: blocks of queries and blocks of vectors, each pair of blocks a task that passes on its best k per query (all, where k is None).

    Nothing passes the driver but two counts; a query is sent once per block of vectors and a vector once per block of queries.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_q, n_v = queries.count(), vectors.count()
    q_blocks, v_blocks = max(1, math.ceil(n_q / block_rows)), max(1, math.ceil(n_v / block_rows))
    v_blocks = max(v_blocks, min(math.ceil(2 * cores / q_blocks), math.ceil(n_v / 64)))
    if k is None:
        q_blocks = max(q_blocks, math.ceil(n_q * n_v / v_blocks / CELL_PAIRS))
    of = lambda key, blocks: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    vector = F.col("vector").cast("array<double>").alias("vector")
    asked = queries.where("vector is not null").select(F.col("query_id").alias("id"), vector, F.lit(True).alias("asked"), of("query_id", q_blocks).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))).alias("j"))
    held = vectors.where("vector is not null").select("id", vector, F.lit(False).alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("i"), of("id", v_blocks).alias("j"))

    def cell(table: pa.Table) -> pa.Table:
        left, right = table.filter(table["asked"]), table.filter(pc.invert(table["asked"]))
        asked, ids = np.asarray(left["id"]), np.asarray(right["id"])
        out = []
        if len(asked) and len(ids):
            order = np.argsort(ids, kind="stable")
            m, q, ids = _unit_rows(right["vector"])[order], _unit_rows(left["vector"]), ids[order]
            if k is not None:
                for at, place, score in _best(q, m, k):
                    keep = score >= threshold if threshold is not None else np.ones(score.shape, bool)
                    out.append((np.repeat(asked[at : at + len(place)], keep.sum(axis=1)), ids[place][keep], score[keep]))
            else:
                for at in range(0, len(q), 256):
                    scores = np.round(q[at : at + 256] @ m.T, 6)
                    row, column = (x.ravel() for x in np.indices(scores.shape)) if threshold is None else np.nonzero(scores >= threshold)
                    out.append((asked[at + row], ids[column], scores[row, column]))
        columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    found = asked.unionByName(held).groupBy("i", "j").applyInArrow(cell, "query_id long, id long, score double")
    return _ranked(found, k)


def best_for_rows(rows: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """For every row (query_id, vector) the k most similar of ``terms`` (id, vector): (query_id, id, score, rank).

    The counterpart of vector_topk_batch() for many rows and few terms: rows stay where they are and are read once, terms are one broadcast of at most ``BROADCAST_BYTES``. More terms go through topk_grid().
    """
    n, width = terms.agg(F.count("*"), F.max(F.size("vector"))).first()
    schema = "query_id long, id long, score double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema + ", rank int")
    if n * 8 * (width or 1) > BROADCAST_BYTES:
        return topk_grid(terms, rows, k)
    mine = terms.select("id", "vector").toPandas().sort_values("id", kind="stable")
    shared = rows.sparkSession.sparkContext.broadcast((mine["id"].to_numpy(), _matrix(mine["vector"])))

    def search(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        for pdf in frames:
            if len(pdf):
                asked = pdf["query_id"].to_numpy()
                for at, place, score in _best(_matrix(pdf["vector"]), matrix, k):
                    yield pd.DataFrame({"query_id": np.repeat(asked[at : at + len(place)], place.shape[1]), "id": ids[place].ravel(), "score": score.ravel()})

    return _ranked(rows.select("query_id", "vector").mapInPandas(search, schema), k)


def _unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Unit rows from a list column without going through Python objects; a zero vector stays zero."""
    lists = column.combine_chunks()
    m = np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def choose_pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """At most ``count`` different unit vectors that lie far apart: farthest first among four times as many rows, those of least hash."""
    rows = vectors.where("vector is not null").orderBy(F.xxhash64("id"), "id").limit(4 * count).select("vector").toArrow()
    if not rows.num_rows:
        return np.zeros((0, 1))
    seen = _unit_rows(rows["vector"])
    chosen, far = [0], np.linalg.norm(seen - seen[0], axis=1)
    while len(chosen) < min(count, len(seen)) and far.max() > 1e-9:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(seen - seen[chosen[-1]], axis=1))
    return seen[chosen]


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((m * m).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * m @ pivots.T, 0))


def reach_of(threshold: float) -> float:
    """The Euclidean distance of unit vectors up to which a similarity that rounds to ``threshold`` is possible."""
    return math.sqrt(max(0.0, 2 - 2 * (threshold - 1e-6))) + 1e-7


def in_cells(vectors: DataFrame, threshold: float, pivots: np.ndarray, within: str | None = None) -> DataFrame:
    """(own, id, vector, cell, inner): every row in the cell of its nearest pivot, and as a guest (not inner) in other cells that may hold similar rows.

    A row x of cell i is no guest of cell j where all rows of j are beyond reach: by the plane between the two pivots, by j's radius, or by j's empty inner ball (triangle
    inequality). Of two cells one visits the other, so that each pair of rows meets once. ``own`` is the value of ``within``, 0 without.
    """
    reach = reach_of(threshold)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(pivots)
    own = F.col(within).cast("long") if within else F.lit(0).cast("long")

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_unit_rows(pa.chunked_array([batch.column(2)])), shared.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["own", "id", "vector", "cell", "distance"])

    read = vectors.where("vector is not null").select(own.alias("own"), "id", F.col("vector").cast("array<double>").alias("vector"))
    kind = read.schema["id"].dataType.simpleString()
    placed = checkpointed(read.mapInArrow(home, f"own long, id {kind}, vector array<double>, cell int, distance double"))
    radii = placed.groupBy("cell").agg(F.min("distance").alias("least"), F.max("distance").alias("most")).collect()
    least, most = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in radii:
        least[r.cell], most[r.cell] = r.least, r.most
    rings = spark.sparkContext.broadcast((least, most))

    def guests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, most = rings.value
        gap = np.maximum(_distances(shared.value, shared.value), 1e-12)
        number = np.arange(len(least))
        for batch in batches:
            cell = np.asarray(batch.column(3))
            d = _distances(_unit_rows(pa.chunked_array([batch.column(2)])), shared.value) if len(cell) else np.zeros((0, len(least)))
            near = (d <= most + reach) & (d >= least - reach)
            home = d[np.arange(len(cell)), cell]
            near &= (d * d - (home * home)[:, None]) / (2 * gap[cell]) <= reach + 1e-9
            # of two cells the one with the greater number visits if the sum is even, else the other
            visits = np.where((number[None, :] + cell[:, None]) % 2 == 0, cell[:, None] > number[None, :], cell[:, None] < number[None, :])
            row, other = np.nonzero(near & visits)
            take = np.r_[np.arange(len(cell)), row]
            part = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.r_[cell, other].astype(np.int32)), pa.array(np.r_[np.ones(len(cell), bool), np.zeros(len(row), bool)])], ["own", "id", "vector", "cell", "inner"])

    return placed.mapInArrow(guests, f"own long, id {kind}, vector array<double>, cell int, inner boolean")


def cell_statistics(cells: DataFrame) -> DataFrame:
    """(own, cell, inner, guests) of in_cells(): rows that live in a cell and that visit it."""
    return cells.groupBy("own", "cell").agg(F.count_if("inner").alias("inner"), F.count_if(~F.col("inner")).alias("guests"))


def similarity_join(vectors: DataFrame, threshold: float, block_rows: int = 16_384, within: str | None = None, pivots: int | None = None) -> DataFrame:
    """JN-9: all pairs (a < b, similarity) with a cosine of ``threshold`` or more, exactly; with ``within`` (a column of numbers) only pairs of equal values, which are a column ``own``.

    Rows are dealt into balls around pivots, far apart and at most 2,048; only cells that may hold similar rows are compared (see in_cells()), so well-separated classes cost their own
    squares. A cell is cut into blocks of ``block_rows`` or fewer, as many as give every core work, and each pair of blocks is one task's matrix product: a hot cell is split, and
    a task holds two blocks and one strip of the product. Where nothing is far apart, that is all pairs of blocks. Single precision finds candidates, with a margin; double precision decides.
    Null vectors have no pairs, rows of equal id none with each other.
    """
    spark = vectors.sparkSession
    cores = spark.sparkContext.defaultParallelism
    n = vectors.count()
    count = pivots or int(min(2048, max(2 * cores, math.ceil(n / 4096)), max(1, n)))
    centres = choose_pivots(vectors, count)
    shape = f"{'own long, ' if within else ''}a long, b long, similarity double"
    if not len(centres):
        return spark.createDataFrame([], shape)
    cells = in_cells(vectors, threshold, centres, within)
    block_rows = max(64, min(block_rows, math.ceil(n / (2 * cores))))
    sizes = cell_statistics(cells).select("own", "cell", F.ceil(F.col("inner") / block_rows).cast("int").alias("inners"), F.ceil(F.col("guests") / block_rows).cast("int").alias("guests")).where("inners > 0")
    # blocks 0 .. inners - 1 are the cell's own rows, the others its guests; tasks are the pairs u <= v of blocks of which u is the cell's own
    each = cells.join(sizes, ["own", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("inner"), F.col("inners")).otherwise(F.col("guests"))).cast("int") + F.when(F.col("inner"), 0).otherwise(F.col("inners")))
    blocks = F.sequence(F.lit(0), F.when(F.col("inner"), F.col("inners") + F.col("guests")).otherwise(F.col("inners")) - 1)
    dealt = each.withColumn("other", F.explode(blocks)).select("own", "cell", F.least("block", "other").alias("u"), F.greatest("block", "other").alias("v"), "block", "id", "vector")

    at_once = STRIP_PAIRS

    def pairs(table: pa.Table) -> pa.Table:
        u, v = table["u"][0].as_py(), table["v"][0].as_py()
        block, ids = np.asarray(table["block"]), np.asarray(table["id"])
        m = _unit_rows(table["vector"])
        left, right = (m, m) if u == v else (m[block == u], m[block == v])
        ids_l, ids_r = (ids, ids) if u == v else (ids[block == u], ids[block == v])
        small, out = right.astype(np.float32), []
        strip = max(1, at_once // len(right))
        for at in range(0, len(left), strip):
            near = left[at : at + strip].astype(np.float32) @ small.T >= threshold - 1e-4
            x, y = np.nonzero(near)
            x += at
            s = np.round(np.einsum("ij,ij->i", left[x], right[y]), 6)
            keep = (s >= threshold) & ((ids_l[x] < ids_r[y]) if u == v else (ids_l[x] != ids_r[y]))
            a, b = ids_l[x[keep]], ids_r[y[keep]]
            out.append((np.minimum(a, b), np.maximum(a, b), s[keep]))
        columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3)]
        found = {"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64()), "similarity": pa.array(columns[2], pa.float64())}
        return pa.table(({"own": pa.array(np.full(len(columns[0]), table["own"][0].as_py()), pa.int64())} if within else {}) | found)

    return dealt.groupBy("own", "cell", "u", "v").applyInArrow(pairs, shape)


def bits_of(hashes: DataFrame) -> DataFrame:
    """(id, bits) with 16 hex digits as one number of 64 bits."""
    half = lambda k: F.conv(F.substr(F.col("hash"), F.lit(k), F.lit(8)), 16, 10).cast("long")
    return hashes.where("hash is not null").select("id", F.shiftleft(half(1), 32).bitwiseOR(half(9)).alias("bits"))


def hash_join(hashes: DataFrame, max_distance: int, bands: int | None = None, block_rows: int = 16_384, bucket_rows: int = 256) -> DataFrame:
    """JN-10: pairs (a < b, distance) of 16-digit hex hashes that differ in at most ``max_distance`` bits.

    With more bands than differing bits some band agrees, so bands are equi-joined and the distance is checked; a band's buckets of more than ``bucket_rows`` hashes are cut into blocks of
    ``block_rows`` at most, each pair of blocks one task's packed comparison. A pair counts in the first band that it shares. Bands of few bits have full buckets: where n rows of evenly spread hashes
    would meet more than half of all pairs (see band_pairs()), packed blocks are compared instead (hash_join_blocks()). ``bands`` asks for bands, whatever they cost.
    """
    if bands is None and band_pairs(1.0, max_distance + 1) > 0.5:
        return hash_join_blocks(hashes, max_distance, block_rows)
    bands = bands or max_distance + 1
    edges = [64 * k // bands for k in range(bands + 1)]
    masks = [(1 << 64 - low) - (1 << 64 - high) for low, high in zip(edges, edges[1:], strict=False)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    parts = F.array(*(F.struct(F.lit(k).alias("band"), F.col("bits").bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(signed)))
    banded = checkpointed(bits_of(hashes)).select("id", "bits", F.inline(parts))
    # buckets of many hashes are compared in packed blocks, all others by an equi-join
    full = checkpointed(banded.groupBy("band", "value").count().where(F.col("count") > bucket_rows).withColumn("blocks", F.ceil(F.col("count") / block_rows).cast("int")).drop("count"))
    none = full.isEmpty()
    rest = banded if none else banded.join(full, ["band", "value"], "left_anti")
    a, b = (rest.select(F.col("id").alias(e), F.col("bits").alias(f"bits_{e}"), "band", "value") for e in "ab")
    apart = F.col("bits_a").bitwiseXOR(F.col("bits_b"))
    # a pair counts in the first of the bands that it shares
    first = F.coalesce(*(F.when(apart.bitwiseAND(F.lit(m)) == 0, k) for k, m in enumerate(signed)))
    near = a.join(b, ["band", "value"]).where((F.col("a") < F.col("b")) & (F.bit_count(apart) <= max_distance) & (first == F.col("band"))).select("a", "b", F.bit_count(apart).cast("int").alias("distance"))
    if none:
        return near
    each = banded.join(full, ["band", "value"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = each.select("band", "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "bits")

    def pairs(table: pa.Table) -> pa.Table:
        return _near_bits(table, max_distance, masks[: table["band"][0].as_py()])

    return near.unionByName(dealt.groupBy("band", "value", "i", "j").applyInArrow(pairs, "a long, b long, distance int"))


def _near_bits(table: pa.Table, max_distance: int, earlier: Sequence[int] = ()) -> pa.Table:
    """Pairs of the blocks i and j of a table that differ in at most so many bits, without those that agree on one of the ``earlier`` masks."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    block, ids, bits = np.asarray(table["block"]), np.asarray(table["id"]), np.asarray(table["bits"]).view(np.uint64)
    left, right = (block == i, block == j)
    ids_l, bits_l, ids_r, bits_r = ids[left], bits[left], ids[right], bits[right]
    out = []
    for at in range(0, len(ids_l), 64):
        apart = bits_l[at : at + 64, None] ^ bits_r[None, :]
        d = np.bitwise_count(apart)
        x, y = np.nonzero(d <= max_distance)
        a, b = ids_l[at + x], ids_r[y]
        keep = (a < b) if i == j else (a != b)
        for mask in earlier:
            keep &= (apart[x, y] & np.uint64(mask)) != 0
        out.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], d[x, y][keep]))
    columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3)]
    return pa.table({c: pa.array(columns[k], t) for k, (c, t) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int32())))})


def band_pairs(pairs: float, bands: int) -> float:
    """How many of so many pairs of evenly spread hashes meet in a band, each as often as it does."""
    return pairs * sum(2.0 ** -(64 * (k + 1) // bands - 64 * k // bands) for k in range(bands))


def hash_join_blocks(hashes: DataFrame, max_distance: int, block_rows: int = 16_384) -> DataFrame:
    """JN-10 for long distances: blocks of packed hashes, each pair of blocks one task that takes XOR and bit counts of whole rows at once.

    Blocks are ranges of the number of set bits, cut by a hash of the id where one range has too many rows; two hashes within the distance have set bits within it, so pairs of blocks farther apart aren't made.
    """
    spark = hashes.sparkSession
    packed = bits_of(hashes).withColumn("ones", F.bit_count("bits").cast("int"))
    counts = {r.ones: r["count"] for r in packed.groupBy("ones").count().collect()}  # 65 rows at most
    n = sum(counts.values())
    block_rows = max(64, min(block_rows, math.ceil(n / (2 * spark.sparkContext.defaultParallelism))))
    blocks: list[tuple[int, int, int]] = []  # least and most ones, parts
    for ones in sorted(counts):
        if blocks and blocks[-1][2] == 1 and sum(counts[k] for k in range(blocks[-1][0], ones + 1) if k in counts) <= block_rows:
            blocks[-1] = (blocks[-1][0], ones, 1)
        else:
            blocks.append((ones, ones, math.ceil(counts[ones] / block_rows)))
    first = np.cumsum([0, *(b[2] for b in blocks)]).tolist()
    if not blocks:
        return spark.createDataFrame([], "a long, b long, distance int")
    rows = [(k, low, high, parts, first[k]) for k, (low, high, parts) in enumerate(blocks)]
    near = [(i, j) for i, x in enumerate(blocks) for j, y in enumerate(blocks) if x[0] - y[1] <= max_distance and y[0] - x[1] <= max_distance]
    meets = spark.createDataFrame([(i, first[j], first[j] + blocks[j][2] - 1) for i, j in near], "range int, low int, high int")
    ranges = spark.createDataFrame(rows, "range int, least int, most int, parts int, start int")
    own = packed.join(F.broadcast(ranges), F.col("ones").between(F.col("least"), F.col("most"))).select("range", "id", "bits", (F.col("start") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block"))
    spread = own.join(F.broadcast(meets), "range").withColumn("other", F.explode(F.sequence("low", "high"))).select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "bits")

    def pairs(table: pa.Table) -> pa.Table:
        return _near_bits(table, max_distance)

    return spread.groupBy("i", "j").applyInArrow(pairs, "a long, b long, distance int")


def cluster_numbers(rooted: DataFrame, small: bool = False) -> DataFrame:
    """WIN-5: (root, cluster): the distinct roots numbered from 0 in their order."""
    return row_numbers(rooted.select("root").distinct(), [F.col("root")], "cluster", start=0, small=small)


def dbscan(ids: DataFrame, edges: DataFrame, min_samples: int = 2) -> DataFrame:
    """CLU-1: (id, cluster) from neighbour pairs (a, b): clusters are numbered from 0 by least core point, noise is -1.

    A core has at least ``min_samples`` - 1 neighbours besides itself; clusters are the components of cores; a border point
    belongs to the cluster of its least core neighbour.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other")))
    cores = checkpointed(both.groupBy("id").count().where(F.col("count") >= min_samples - 1).select("id"))
    core_edges = edges.join(cores.select(F.col("id").alias("a")), "a", "left_semi").join(cores.select(F.col("id").alias("b")), "b", "left_semi")
    found = connected_components(core_edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rooted = cores.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    border = both.join(cores, "id", "left_anti").join(cores.select(F.col("id").alias("other")), "other", "left_semi").groupBy("id").agg(F.min("other").alias("other"))
    border = border.join(rooted.select(F.col("id").alias("other"), "root"), "other").select("id", "root")
    numbers = cluster_numbers(rooted, small=cores.count() <= SMALL_ROWS)
    placed = rooted.unionByName(border).join(numbers, "root").select("id", "cluster")
    return ids.select("id").join(placed, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def cluster_vectors(vectors: DataFrame, eps: float, min_samples: int = 2) -> DataFrame:
    """CLU-1 over vectors by cosine distance of at most eps."""
    return dbscan(vectors, checkpointed(similarity_join(vectors, 1 - eps)), min_samples)


def stack_results(hits: DataFrame, threshold: float = 0.92, list_rows: int = 2048, vectors: DataFrame | None = None) -> DataFrame:
    """STK-1: per query_id, in rank order, each unabsorbed hit absorbs later ones of a cosine of ``threshold`` or more: (query_id, id, rank, stack_of, similarity).

    ``hits`` has query_id, id (once per query), rank (different in a query) and vector; with ``vectors`` (id, vector) they need none, and a vector is sent once per block of queries instead of once per hit. Lists of up to
    ``list_rows`` hits are one group each; longer ones, of any length, go in rounds: the first open hits of each list are stacked so, then cells of queries and vectors give their heads the later
    hits (see absorbed()), and what is left is open. Each round takes eight times as many first hits, 32,768 at most. Both give the greedy answer.
    """
    spark = hits.sparkSession
    if vectors is None:
        # a hit's vector is its own
        hits = checkpointed(row_numbers(hits, [F.col("query_id"), F.col("rank")], "__key"))
        vectors = hits.select(F.col("__key").alias("key"), "vector")
    else:
        hits = hits.withColumn("__key", F.col("id"))
        vectors = vectors.select(F.col("id").alias("key"), "vector")
    open_ = checkpointed(hits.select(F.col("query_id").cast("long"), F.col("id").cast("long"), F.col("rank").cast("int"), F.col("__key").cast("long").alias("key")))
    shape = "query_id long, id long, rank int, stack_of long, similarity double"

    def greedy(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        m, ids = _unit_rows(table["vector"]), np.asarray(table["id"])
        owner, score = np.full(len(ids), -1), np.ones(len(ids))
        for i in range(len(ids)):
            if owner[i] < 0:
                owner[i] = i
                s = np.round(m[i + 1 :] @ m[i], 6)
                j = i + 1 + np.flatnonzero((s >= threshold) & (owner[i + 1 :] < 0))
                owner[j], score[j] = i, s[j - i - 1]
        return pa.table({"query_id": table["query_id"], "id": table["id"], "rank": table["rank"], "stack_of": pa.array(ids[owner]), "similarity": pa.array(score)})

    done = spark.createDataFrame([], shape)
    while not open_.isEmpty():
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        first = checkpointed(open_.withColumn("__place", place).where(F.col("__place") <= list_rows).drop("__place"))
        stacked = checkpointed(first.join(vectors, "key").groupBy("query_id").applyInArrow(greedy, shape))
        last = first.groupBy("query_id").agg(F.max("rank").alias("__last"))
        later = checkpointed(open_.join(last, "query_id").where(F.col("rank") > F.col("__last")).drop("__last"))
        done = done.unionByName(stacked)
        if later.isEmpty():
            break
        heads = stacked.where("id = stack_of").select("query_id", "id", "rank").join(first.select("query_id", "id", "key"), ["query_id", "id"]).join(vectors, "key").drop("key")
        told = checkpointed(absorbed(later, heads, vectors, threshold))
        done = done.unionByName(told.where("stack_of is not null").drop("key"))
        open_, list_rows = told.where("stack_of is null").select("query_id", "id", "rank", "key"), min(8 * list_rows, 32_768)
    return done


def absorbed(hits: DataFrame, heads: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(query_id, id, rank, stack_of, similarity, key): hits (query_id, id, rank, key) and the first head (query_id, id, rank, vector) of their query within ``threshold``, null without one.

    A task is a cell of a block of queries and a block of ``vectors`` (key, vector): a vector is sent once per block of queries, a head once per block of vectors, a hit once. Of a product a cell holds one strip.
    """
    n_v, n_h = vectors.count(), hits.count()
    cores = hits.sparkSession.sparkContext.defaultParallelism
    v_blocks = max(1, math.ceil(n_v / 16_384))
    q_blocks = max(math.ceil(n_h / v_blocks / CELL_HITS), math.ceil(3 * cores / v_blocks))
    i, j = F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"), F.pmod(F.xxhash64("key"), F.lit(v_blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vector, none = F.col("vector").cast("array<double>").alias("vector"), F.lit(None).cast("array<double>").alias("vector")
    long_, int_ = F.lit(None).cast("long"), F.lit(None).cast("int")
    asked = hits.select(F.lit(0).alias("kind"), "query_id", "id", "rank", "key", none, i.alias("i"), j.alias("j"))
    led = heads.select(F.lit(1).alias("kind"), "query_id", "id", "rank", long_.alias("key"), vector, i.alias("i"), every(v_blocks).alias("j"))
    held = vectors.select(F.lit(2).alias("kind"), long_.alias("query_id"), long_.alias("id"), int_.alias("rank"), "key", vector, every(q_blocks).alias("i"), j.alias("j"))
    if n_v > n_h // 2:
        # own vectors of hits: only those still asked for
        held = held.join(hits.select("key").distinct(), "key", "left_semi").select(*asked.columns)

    def cell(table: pa.Table) -> pa.Table:
        kind = np.asarray(table["kind"])
        mine, led, held = (table.filter(pa.array(kind == k)) for k in range(3))
        mine, led = mine.drop_columns("vector").sort_by("query_id"), led.sort_by([("query_id", "ascending"), ("rank", "ascending")])
        query, stack, score = np.asarray(mine["query_id"]), np.zeros(len(mine), np.int64), np.ones(len(mine))
        found = np.zeros(len(mine), bool)
        if len(mine) and len(led):
            keys = np.asarray(held["key"])
            order = np.argsort(keys)
            row = order[np.searchsorted(keys[order], np.asarray(mine["key"]))]
            m, h, of, ids = _unit_rows(held["vector"]), _unit_rows(led["vector"]), np.asarray(led["query_id"]), np.asarray(led["id"])
            for q in np.unique(of):
                low, high = np.searchsorted(of, [q, q + 1])
                start, end = np.searchsorted(query, [q, q + 1])
                for at in range(start, end, 1024):
                    part = slice(at, min(at + 1024, end))
                    s = m[row[part]] @ h[low:high].T
                    near = s >= threshold
                    x, y = np.nonzero(np.abs(s - threshold) <= 1e-6)
                    near[x, y] = np.round(s[x, y], 6) >= threshold
                    best = near.argmax(axis=1)
                    each = np.arange(len(best))
                    found[part], stack[part], score[part] = near[each, best], ids[low + best], np.round(s[each, best], 6)
        missing = ~found
        return pa.table({"query_id": mine["query_id"], "id": mine["id"], "rank": mine["rank"], "stack_of": pa.array(stack, mask=missing), "similarity": pa.array(score, mask=missing), "key": mine["key"]})

    return asked.unionByName(led).unionByName(held).groupBy("i", "j").applyInArrow(cell, "query_id long, id long, rank int, stack_of long, similarity double, key long")


class _List(NamedTuple):
    """A query's hits in one block of vectors, in order: places in the block (ids, unit rows m, vectors) and scores, and the heads so far of the whole list, in order."""

    query: int
    ids: np.ndarray
    m: np.ndarray
    vectors: pa.Array
    place: np.ndarray
    score: np.ndarray
    heads: np.ndarray
    head_ids: np.ndarray
    start: int
    cuts: np.ndarray


def _lists(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[_List]:
    """The lists of a cell of queries (kind 0), heads (1) and vectors (2). Scores are the same in every round: each is worked out with its whole block of vectors, in the order of ids."""
    table = pa.Table.from_batches(list(batches))
    kind = np.asarray(table["kind"])
    asked, led, held = (table.filter(pa.array(kind == k)) for k in range(3))
    del table
    if not len(asked) or not len(held):
        return
    held, led = held.sort_by("id"), led.sort_by([("query_id", "ascending"), ("score", "descending"), ("id", "ascending")])
    ids, vectors, q = np.asarray(held["id"]), held["vector"].combine_chunks(), _unit_rows(asked["vector"])
    m, of, head_ids = _unit_rows(held["vector"]), np.asarray(led["query_id"]), np.asarray(led["id"])
    heads = _unit_rows(led["vector"]) if len(led) else np.zeros((0, m.shape[1]))
    del held, led
    for n, a in enumerate(asked.drop_columns("vector").to_pylist()):
        s = np.round(m @ q[n], 6) + 0.0
        place = np.flatnonzero(s >= least)
        place = place[np.argsort(-s[place], kind="stable")]
        score = s[place]

        def upto(cut: float, id_: int, place=place, score=score) -> int:
            low, high = np.searchsorted(-score, -cut), np.searchsorted(-score, -cut, "right")
            return int(low + np.searchsorted(ids[place[low:high]], id_, "right"))

        low, high = np.searchsorted(of, [a["query_id"], a["query_id"] + 1])
        cuts = np.array([0, *(upto(-c["less"], c["id"]) for c in a["cuts"] or ()), len(place)])
        yield _List(a["query_id"], ids, m, vectors, place, score, heads[low:high], head_ids[low:high], 0 if a["id"] is None else upto(a["score"], a["id"]), cuts)


def _within(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which unit rows have a cosine that rounds to ``threshold`` or more; next to that edge each pair is summed by itself, so that it is judged alike in any product."""
    edge = (math.ceil(threshold * 1e6 - 1e-6) - 0.5) / 1e6
    s = a @ b.T
    near = s >= edge
    x, y = np.nonzero(np.abs(s - edge) <= 1e-9)
    near[x, y] = np.round((a[x] * b[y]).sum(axis=1), 6) >= threshold
    return near


def _first_heads(m: np.ndarray, place: np.ndarray, heads: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of ``m`` the place of the first of ``heads`` within ``threshold``, -1 without one, and the similarity; what a strip of heads absorbs isn't compared with the next one."""
    edge = (math.ceil(threshold * 1e6 - 1e-6) - 0.5) / 1e6
    owner, score = np.full(len(place), -1), np.ones(len(place))
    for at in range(0, len(place), 4096):
        open_ = np.arange(at, min(at + 4096, len(place)))
        for h in range(0, len(heads), 32):
            rows = m[place[open_]]
            s = rows @ heads[h : h + 32].T
            near = s >= edge - 1e-9
            best, each = near.argmax(axis=1), np.arange(len(open_))
            doubt = np.flatnonzero(near[each, best] & (s[each, best] <= edge + 1e-9))
            if len(doubt):
                near[doubt] = _within(rows[doubt], heads[h : h + 32], threshold)
                best[doubt] = near[doubt].argmax(axis=1)
            found = near[each, best]
            owner[open_[found]], score[open_[found]] = h + best[found], np.round(s[each, best][found], 6)
            open_ = open_[~found]
            if not len(open_):
                break
    return owner, score


def stack_search(vectors: DataFrame, queries: DataFrame, least: float, threshold: float = 0.92, list_rows: int = 2048, block_rows: int = 65_536) -> DataFrame:
    """TOP-2 and STK-1 in one: all hits of (query_id, vector) among (id, vector) from a cosine of ``least`` on, by score, then id, stacked as stack_results() does: (query_id, id, rank, stack_of, similarity).

    No table of hits is made on the way. A task is a cell of a block of queries and a block of vectors that works out its scores anew in every round: a vector is sent once per block of queries, a head once per
    block of vectors. In a round one task stacks about the next ``list_rows`` open hits of a list, in the next one eight times as many, 32,768 at most; their heads are told to all cells. When no list has open
    hits, cells give each hit its first head, and hits are sent once, packed, to be numbered: a list in bands of at most ``BAND_HITS``.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    vector, none = F.col("vector").cast("array<double>").alias("vector"), F.lit(None)
    vectors = checkpointed(vectors.where("vector is not null").select(F.col("id").cast("long").alias("id"), vector))
    asked = checkpointed(queries.where("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), none.cast("long").alias("id"), none.cast("double").alias("score"), vector, none.cast("array<struct<less: double, id: long>>").alias("cuts")))
    n_v, n_q = vectors.count(), asked.count()
    v_blocks = max(1, math.ceil(n_v / block_rows), min(math.ceil(math.sqrt(3 * cores)), math.ceil(n_v / 4096)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def cells(asked: DataFrame, n_q: int, heads: DataFrame | None, n_heads: int, function, shape: str) -> DataFrame:
        q_blocks = min(max(1, n_q), max(math.ceil(3 * cores / v_blocks), math.ceil(n_q * n_v / v_blocks / STACK_PAIRS), math.ceil(n_heads / STACK_HEADS)))
        i, j = F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("i"), F.pmod(F.xxhash64("id"), F.lit(v_blocks)).cast("int").alias("j")
        whole = asked.select(F.lit(0).alias("kind"), "*", i, every(v_blocks).alias("j"))
        if heads is not None:
            whole = whole.unionByName(heads.select(F.lit(1).alias("kind"), "*", i, every(v_blocks).alias("j")), allowMissingColumns=True)
        whole = whole.unionByName(vectors.select(F.lit(2).alias("kind"), "*", every(q_blocks).alias("i"), j), allowMissingColumns=True)
        return whole.groupBy("i", "j").applyInArrow(function, shape)

    def search(first: int):
        def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for a in _lists(batches, least):
                at, found = a.start, []
                while at < len(a.place) and len(found) <= first:
                    part = np.arange(at, min(at + max(1024, 2 * first), len(a.place)))
                    found.extend(part[_first_heads(a.m, a.place[part], a.heads, threshold)[0] < 0])
                    at = part[-1] + 1
                if found:
                    take, ends = np.array(found[:first]), np.zeros(min(first, len(found)), bool)
                    ends[-1] = len(found) > first
                    place = a.place[take]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), a.query)), pa.array(a.ids[place]), pa.array(a.score[take]), a.vectors.take(pa.array(place)), pa.array(ends)], ["query_id", "id", "score", "vector", "more"])

        return cell

    def greedy(table: pa.Table) -> pa.Table:
        table = table.sort_by([("score", "descending"), ("id", "ascending")])
        ends = np.flatnonzero(np.asarray(table["more"]))
        # after the first end of what a cell has told open hits may be missing
        n = ends[0] + 1 if len(ends) else len(table)
        m, open_, heads = _unit_rows(table["vector"]), np.arange(n), []
        while len(open_):
            heads.append(open_[0])
            open_ = open_[1:][~_within(m[open_[1:]], m[open_[:1]], threshold)[:, 0]]
        head = table.take(pa.array(heads)).set_column(4, "more", pa.array(np.zeros(len(heads), bool)))
        return pa.concat_tables([head, table.slice(n - 1, 1)]) if len(ends) else head

    heads, n_heads, open_, n_open = None, 0, asked, n_q
    row = "query_id long, id long, score double, vector array<double>, more boolean"
    while n_open and n_v:
        # a cell tells its share of the next hits and three standard deviations
        first = math.ceil(list_rows / v_blocks + 3 * math.sqrt(list_rows / v_blocks)) if v_blocks > 1 else list_rows
        mine = None if heads is None else heads.join(open_.select("query_id"), "query_id", "left_semi")
        told = checkpointed(cells(open_, n_open, mine, n_heads, search(first), row).groupBy("query_id").applyInArrow(greedy, row))
        new = told.where("not more").drop("more")
        heads = new if heads is None else heads.unionByName(new)
        open_ = checkpointed(asked.select("query_id", "vector", "cuts").join(told.where("more").select("query_id", "id", "score"), "query_id"))
        n_heads, n_open, list_rows = heads.count(), open_.count(), min(8 * list_rows, 32_768)
    shape = "query_id long, id long, rank int, stack_of long, similarity double"
    if heads is None:
        return vectors.sparkSession.createDataFrame([], shape)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, band_hits // (2 * v_blocks))
        for a in _lists(batches, least):
            take = np.arange(step - 1, len(a.place), step)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), a.query)), pa.array(-a.score[take]), pa.array(a.ids[a.place[take]])], ["query_id", "less", "id"])

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in _lists(batches, least):
            owner, score = _first_heads(a.m, a.place, a.heads, threshold)
            # a head is its own: a zero vector has a similarity of zero even to itself
            at = np.searchsorted(a.ids, a.head_ids)
            here = np.flatnonzero(a.ids[np.minimum(at, len(a.ids) - 1)] == a.head_ids)
            number = np.full(len(a.ids), -1)
            number[at[here]] = here
            own = number[a.place]
            owner, score = np.where(own < 0, owner, own), np.where(own < 0, score, 1.0)
            if (owner < 0).any():
                raise RuntimeError(f"hits of {a.query} are without a head")
            columns = [a.ids[a.place], np.rint(a.score * 1e6).astype(np.int32), a.head_ids[owner], np.rint(score * 1e6).astype(np.int32)]
            bands = np.flatnonzero(np.diff(a.cuts))
            parts = [pa.array([c[a.cuts[b] : a.cuts[b + 1]].tobytes() for b in bands], pa.binary()) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bands), a.query)), pa.array(bands.astype(np.int32)), pa.array(np.diff(a.cuts)[bands]), *parts], ["query_id", "band", "n", "ids", "scores", "heads", "similarities"])

    def numbered(table: pa.Table) -> pa.Table:
        ids, scores, heads, similar = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[c]]) for c, kind in (("ids", np.int64), ("scores", np.int32), ("heads", np.int64), ("similarities", np.int32)))
        order = np.lexsort((ids, -scores))
        rank = table["before"][0].as_py() + 1 + np.arange(len(ids))
        return pa.table({"query_id": pa.array(np.full(len(ids), table["query_id"][0].as_py())), "id": ids[order], "rank": rank.astype(np.int32), "stack_of": heads[order], "similarity": similar[order] / 1e6})

    band_hits, one = BAND_HITS, n_v <= BAND_HITS
    if not one:
        # every v_blocks-th of the sampled hits of a list ends a band
        some = cells(asked, n_q, None, 0, sample, "query_id long, less double, id long").withColumn("__no", F.row_number().over(Window.partitionBy("query_id").orderBy("less", "id")))
        cuts = some.where(F.col("__no") % v_blocks == 0).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("less", "id"))).alias("cuts"))
        asked = checkpointed(asked.drop("cuts").join(cuts, "query_id", "left"))
    packed = cells(asked, n_q, heads, n_heads, owners, "query_id long, band int, n long, ids binary, scores binary, heads binary, similarities binary")
    if one:
        packed = packed.withColumn("before", F.lit(0).cast("long"))
    else:
        packed = checkpointed(packed)
        before = Window.partitionBy("query_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
        packed = packed.join(packed.groupBy("query_id", "band").agg(F.sum("n").alias("__n")).withColumn("before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"), ["query_id", "band"])
    return packed.groupBy("query_id", "band").applyInArrow(numbered, shape)


def settle_stacks(edges: DataFrame, last_edges: int = 500_000, max_rounds: int = 60) -> DataFrame:
    """(query_id, late, early, similarity): the head that absorbs each hit that is none, from edges (query_id, early, late, similarity) between similar hits, told by their ranks.

    The heads are the maximal independent set that rank order gives. In a round every open hit without an open earlier neighbour is a head, and its later neighbours are absorbed; edges of what is settled
    go. When ``last_edges`` or fewer are open (long chains settle two links a round), one task walks them in order. The first head among a hit's neighbours owns it. Raises RuntimeError after ``max_rounds``.
    """
    spark, pair = edges.sparkSession, ["query_id", "early", "late"]
    open_, absorbed = edges.select(*pair), spark.createDataFrame([], "query_id long, late int")
    for _ in range(max_rounds):
        if open_.count() <= last_edges:
            last = open_.coalesce(1).sortWithinPartitions("query_id", "late", "early").mapInArrow(_walk, "query_id long, late int")
            absorbed = checkpointed(absorbed.unionByName(last))
            break
        follows = open_.select("query_id", F.col("late").alias("early")).distinct()
        now = checkpointed(open_.join(follows, ["query_id", "early"], "left_anti").select("query_id", "late").distinct())
        heads = open_.join(follows, ["query_id", "early"], "left_anti").select("query_id", "early").distinct()
        settled = checkpointed(now.select("query_id", F.col("late").alias("hit")).unionByName(heads.select("query_id", F.col("early").alias("hit"))))
        for end in ("early", "late"):
            open_ = open_.join(settled.withColumnRenamed("hit", end), ["query_id", end], "left_anti")
        open_, absorbed = checkpointed(open_), absorbed.unionByName(now)
    else:
        raise RuntimeError(f"stacks are still open after {max_rounds} rounds")
    by_head = edges.join(absorbed.withColumnRenamed("late", "early"), ["query_id", "early"], "left_anti")
    return by_head.groupBy("query_id", "late").agg(F.min("early").alias("early"), F.min_by("similarity", "early").alias("similarity"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The absorbed hits of edges that come sorted by query, later and earlier hit; an absorbed hit absorbs nothing."""
    query, absorbed = None, set()
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("query_id", "late", "early")), strict=True):
            if row[0] != query:
                query, absorbed = row[0], set()
            if row[1] not in absorbed and row[2] not in absorbed:
                absorbed.add(row[1])
                out.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32())], ["query_id", "late"])
