"""Packed token-id matrices: best-fit decreasing with a segment tree, written as binary rows.

Tasks tokenise their documents, cut overlong ones into consecutive pieces (nothing is lost), gather pieces up to a bound of
tokens and pack each such shard by best-fit decreasing. A segment tree over capacities finds the fullest open row that still has room in
log2(capacity) steps. No shuffle: ids never leave the task that made them, and a shard holds thousands of rows, so its last rows hardly count.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenarc.llm._store import limit_batches
from lumenarc.llm._tokens import encoder

SHARD_TOKENS = 4_000_000


class CapacityTree:
    """Open rows by free capacity, with the least capacity that is at least a size found top down."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = defaultdict(list)

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        at = free + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (free, row) of the tightest row with room for ``size``."""
        at = size + self.leaves
        if not self.count[at]:
            while at > 1 and not (at % 2 == 0 and self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        free = at - self.leaves
        row = self.rows[free].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return free, row


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of indices into ``lengths``; each row's lengths add up to at most ``capacity``."""
    tree, rows = CapacityTree(capacity), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = tree.take(size)
        free, row = found if found else (capacity, len(rows))
        if not found:
            rows.append([])
        rows[row].append(i)
        if free - size:
            tree.add(free - size, row)
    return rows


SHAPE = "sequence_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, segments array<struct<id: {kind}, piece: int, start: long, length: int>>"


def _packer(tokenizer: str, capacity: int, end: int | None, pad: int, id_bytes: int, shard: int, kind: pa.DataType):
    dtype = np.dtype(f"<u{id_bytes}")

    def write(pieces: list[tuple], base: int) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(p[3]) for p in pieces], np.int64)
        rows = best_fit_decreasing(lengths, capacity)
        for at in range(0, len(rows), 1000):
            some = rows[at : at + 1000]
            matrix = np.full((len(some), capacity), pad, dtype)
            cu, resets, segments, n = [], [], [], []
            for k, members in enumerate(some):
                ends = np.cumsum([0, *lengths[members]]).astype(np.int32)
                for i, a, b in zip(members, ends[:-1], ends[1:], strict=True):
                    matrix[k, a:b] = pieces[i][3]
                cu.append(ends)
                resets.append(ends[:-1])
                segments.append([{"id": pieces[i][0], "piece": pieces[i][1], "start": pieces[i][2], "length": int(lengths[i])} for i in members])
                n.append(int(ends[-1]))
            inner = pa.list_(pa.struct([("id", kind), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(base + at, base + at + len(some))), pa.array([r.tobytes() for r in matrix], pa.binary()), pa.array(n, pa.int32()), pa.array(cu, pa.list_(pa.int32())), pa.array(resets, pa.list_(pa.int32())), pa.array(segments, inner)],
                ["sequence_id", "ids", "n_tokens", "cu_seqlens", "position_resets", "segments"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(tokenizer), TaskContext.get().partitionId() << 40
        pieces: list[tuple] = []
        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids = np.append(ids, np.uint32(end)) if end is not None else ids
                if len(ids) and int(ids.max()) >= 1 << 8 * id_bytes:
                    raise ValueError(f"token id {int(ids.max())} needs more than {id_bytes} bytes")
                ids = ids.astype(dtype)
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    pieces.append((key.as_py(), piece, start, ids[start : start + capacity]))
                held += len(ids)
                if held >= shard:
                    for out in write(pieces, base):
                        base += out.num_rows
                        yield out
                    pieces, held = [], 0
        if pieces:
            yield from write(pieces, base)

    return pack


def write_packed(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end: int | None = 0, pad: int = 0, id_bytes: int = 4, shard: int = SHARD_TOKENS) -> DataFrame:
    """Write packed rows as Parquet to ``path`` and return the table that was written.

    A row is ``capacity`` ids, little-endian in ``id_bytes`` bytes each, padded with ``pad``; n_tokens without padding; cu_seqlens the cumulative segment
    lengths from 0; position_resets the places where positions start anew; segments the document, piece, start and length of each segment.
    Null texts count as empty; with ``end`` None an empty document has no segment. Repeated ids are separate documents; an empty table gives an empty one.
    """
    limit_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    arrow = to_arrow_type(read.schema["id"].dataType)
    shape = SHAPE.format(kind=kind)
    read.mapInArrow(_packer(tokenizer, capacity, end, pad, id_bytes, shard, arrow), shape).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(shape).parquet(path)


def position_ids(n_tokens: int, resets: list[int]) -> np.ndarray:
    """0, 1, ... from each reset on."""
    starts = np.zeros(n_tokens, np.int64)
    starts[list(resets)] = list(resets)
    return np.arange(n_tokens) - np.maximum.accumulate(starts)


def segments(packed: DataFrame, id_bytes: int) -> DataFrame:
    """One row per segment: id, piece, start, length, sequence_id, offset and the CRC-32 of its bytes, from packed rows."""
    each = packed.select("sequence_id", "ids", "cu_seqlens", F.posexplode("segments").alias("k", "segment"))
    each = each.select("segment.*", "sequence_id", F.element_at("cu_seqlens", F.col("k") + 1).cast("long").alias("offset"), "ids")
    body = F.expr(f"substring(ids, cast(offset * {id_bytes} + 1 as int), length * {id_bytes})")
    return each.select("id", "piece", "start", F.col("length").cast("long").alias("length"), "sequence_id", "offset", F.crc32(body).alias("ids_crc32"))


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
