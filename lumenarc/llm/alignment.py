"""Alignment of the tokens of two tokenizers by products of incidence matrices.

Both encodings of a text cover the same bytes. A token-byte incidence matrix has a row per token and a column per byte. Row i of A·Bᵀ, built
by Gustavson's rule (the columns of row i of A name the rows of Bᵀ that are added up), holds the B tokens that share bytes with A's token i,
with the number of bytes: the overlap links. Where tokens of both end at the same byte a group ends; the product of the token-group incidence
matrices holds the pairs that share a group. The matrices are plain CSR arrays without values, as every entry is 1.

Documents are encoded once. What a document contributes (its token counts, its group digest and its distinct id pairs with their numbers) is written to the shared
folder; the corpus-wide count of each id pair is summed from there, per task first. The frequent pairs, ``HOT_PAIRS`` at most, are then
broadcast to score every document in place, and the rarer ones are joined by a shuffle, so that no table that grows with the corpus is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenarc.llm._store import broadcast_below, cut, fresh_path, limit_batches
from lumenarc.llm._text import slices
from lumenarc.llm._tokens import encoder, token_bytes

#: Id pairs whose counts may be broadcast, 17 bytes each.
HOT_PAIRS = 500_000
#: Rows of (B id, highest count) that may be broadcast; there is one per entry of B's vocabulary at most.
BROADCAST_ROWS = 250_000
#: Bytes of text, and products, that are worked on at once.
STRIP = 1 << 19
#: Id pairs that a task holds before it passes their sums on.
HELD_PAIRS = 2_000_000


class Csr(NamedTuple):
    """A 0/1 matrix: the columns of row i are idx[ptr[i] : ptr[i + 1]]."""

    ptr: np.ndarray
    idx: np.ndarray
    width: int

    @property
    def transposed(self) -> Csr:
        order = np.argsort(self.idx, kind="stable")
        row = np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))
        return Csr(np.r_[0, np.cumsum(np.bincount(self.idx, minlength=self.width))], row[order], len(self.ptr) - 1)


def token_byte_incidence(ends: np.ndarray) -> Csr:
    """Tokens by bytes, from where each token ends."""
    n = int(ends[-1]) if len(ends) else 0
    return Csr(np.r_[0, ends], np.arange(n), n)


def token_group_incidence(ends: np.ndarray, group_ends: np.ndarray) -> Csr:
    """Tokens by groups: every token lies in the group that ends with it or after it."""
    return Csr(np.arange(len(ends) + 1), np.searchsorted(group_ends, ends), len(group_ends))


def row_products(a: Csr, b: Csr, budget: int = STRIP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The product of two 0/1 matrices by Gustavson's rule, some rows at a time: (row, column, value) of its entries, in order.

    The symbolic part says how many terms each row adds up; rows are taken together up to ``budget`` terms (or one row).
    """
    terms = np.r_[0, np.cumsum(np.diff(b.ptr)[a.idx])][a.ptr]
    at, rows = 0, len(a.ptr) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(terms, terms[at] + budget, "right")) - 1)
        k = a.idx[a.ptr[at] : a.ptr[to]]
        n = b.ptr[k + 1] - b.ptr[k]
        first = np.cumsum(n) - n
        col = b.idx[np.repeat(b.ptr[k] - first, n) + np.arange(int(n.sum()))]
        key = np.repeat(np.repeat(np.arange(at, to), np.diff(a.ptr[at : to + 1])), n) * b.width + col
        if len(key) and (key[1:] < key[:-1]).any():
            key = np.sort(key)
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        yield key[new] // max(b.width, 1), key[new] % max(b.width, 1), np.diff(np.r_[new, len(key)])
        at = to


def entries(a: Csr, b: Csr) -> np.ndarray:
    """How many terms each row of the product adds up: its entries, where the rows of ``b`` that a row names are disjoint."""
    return np.diff(np.r_[0, np.cumsum(np.diff(b.ptr)[a.idx])][a.ptr])


class Vocabulary:
    """Byte lengths and bytes of a tokenizer's entries, and its encoder."""

    def __init__(self, path: str) -> None:
        table = token_bytes(path)
        self.size, self.encode = len(table), encoder(path, True)
        self.lengths = np.array([len(x) for x in table], np.int64)
        self._flat, self._begin = np.frombuffer(b"".join(table), np.uint8), np.cumsum(self.lengths) - self.lengths

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        first = np.cumsum(n) - n
        return self._flat[np.repeat(self._begin[ids] - first, n) + np.arange(int(n.sum()))]


class Aligned(NamedTuple):
    """Both encodings of consecutive texts on one line of bytes: token ids and ends, the text of each token, and where groups end."""

    a: np.ndarray
    a_end: np.ndarray
    a_doc: np.ndarray
    b: np.ndarray
    b_end: np.ndarray
    b_doc: np.ndarray
    group_end: np.ndarray


def aligned(texts: list[str | None], left: Vocabulary, right: Vocabulary) -> Aligned:
    """Tokens of space + text by ``left`` and of text by ``right`` (which adds the space); none where the bytes differ or the text is null or empty."""
    ids: tuple[list, list] = ([], [])
    docs: tuple[list, list] = ([], [])
    for k, text in enumerate(texts):
        if not text:
            continue
        a, b = left.encode(" " + text).astype(np.int64), right.encode(text).astype(np.int64)
        raw = np.frombuffer((" " + text).encode(), np.uint8)
        if np.array_equal(left.spelled(a), raw) and np.array_equal(right.spelled(b), raw):
            for side, x in enumerate((a, b)):
                ids[side].append(x)
                docs[side].append(np.full(len(x), k))
    none = np.zeros(0, np.int64)
    (a, b), (a_doc, b_doc) = ([np.concatenate(x) if x else none for x in y] for y in (ids, docs))
    a_end, b_end = np.cumsum(left.lengths[a]), np.cumsum(right.lengths[b])
    return Aligned(a, a_end, a_doc, b, b_end, b_doc, _common(a_end, b_end))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values of both of two sorted arrays, once each."""
    if not len(a) or not len(b):
        return a[:0]
    found = a[b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a]
    return found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found


def strips(x: Aligned, size: int = STRIP) -> Iterator[tuple[slice, slice, int, np.ndarray]]:
    """Runs of whole groups with about ``size`` bytes: (A tokens, B tokens, first byte, ends of the groups)."""
    at, begin = 0, 0
    while at < len(x.group_end):
        to = max(at + 1, int(np.searchsorted(x.group_end, begin + size, "right")))
        last = int(x.group_end[to - 1])
        sides = [slice(*np.searchsorted(e, [begin, last], "right")) for e in (x.a_end, x.b_end)]
        yield sides[0], sides[1], begin, x.group_end[at:to] - begin
        at, begin = to, last


def overlap_links(x: Aligned) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(A token, B token, shared bytes): the entries of A·Bᵀ over bytes."""
    for a, b, begin, _ in strips(x):
        right = token_byte_incidence(x.b_end[b] - begin).transposed
        for i, j, n in row_products(token_byte_incidence(x.a_end[a] - begin), right):
            yield i + a.start, j + b.start, n


def group_links(x: Aligned) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(A token, B token, 1): the entries of the product of the group incidences."""
    for a, b, begin, ends in strips(x):
        right = token_group_incidence(x.b_end[b] - begin, ends).transposed
        for i, j, n in row_products(token_group_incidence(x.a_end[a] - begin, ends), right):
            yield i + a.start, j + b.start, n


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else np.zeros(0, np.int64)




def _spellings(left: Vocabulary, right: Vocabulary) -> tuple[np.ndarray, int]:
    most = max(left.size, right.size)
    return np.array([f"{i}{mark}".encode() for mark in (",", "|", ";") for i in range(most)], object), most


def _digests(x: Aligned, n: int, spelled: np.ndarray, most: int) -> list[str]:
    """SHA-256 of each text's groups as ``a1,a2|b1;a3|b2,b3``; '' for texts without tokens."""
    ga, gb = np.searchsorted(x.group_end, x.a_end), np.searchsorted(x.group_end, x.b_end)
    last = [np.r_[g[1:] != g[:-1], True] if len(g) else np.zeros(0, bool) for g in (ga, gb)]
    order = np.argsort(np.r_[2 * ga, 2 * gb + 1], kind="stable")
    words = spelled[np.r_[x.a + most * last[0], x.b + 2 * most * last[1]][order]]
    ends = np.cumsum(np.bincount(x.a_doc, minlength=n) + np.bincount(x.b_doc, minlength=n))
    out, at = [], 0
    for to in ends.tolist():
        out.append(hashlib.sha256(b"".join(words[at:to].tolist())[:-1]).hexdigest() if to > at else "")
        at = to
    return out


def _aligner(a_path: str, b_path: str, schema: pa.Schema):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = Vocabulary(a_path), Vocabulary(b_path)
        spelled, most = _spellings(left, right)
        span = left.size * right.size
        for batch in batches:
            for part, _, _ in slices(batch, "text"):
                n = part.num_rows
                x = aligned(part.column(1).to_pylist(), left, right)
                keys, counts, n_groups_links = [], [], np.zeros(n, np.int64)
                for i, j, _ in overlap_links(x):
                    k, c = _summed(x.a_doc[i] * span + x.a[i] * right.size + x.b[j], np.ones(len(i), np.int64))
                    keys.append(k)
                    counts.append(c)
                for a, b, begin, ends in strips(x):
                    shared = entries(token_group_incidence(x.a_end[a] - begin, ends), token_group_incidence(x.b_end[b] - begin, ends).transposed)
                    np.add.at(n_groups_links, x.a_doc[a], shared)
                key, count = _summed(np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                doc = key // span
                cuts = np.searchsorted(doc, np.arange(1, n))
                group_doc = x.a_doc[np.searchsorted(x.a_end, x.group_end)]
                columns = [
                    part.column(0), *(pa.array(np.bincount(d, minlength=n).astype(np.int64)) for d in (x.a_doc, x.b_doc, group_doc)),
                    pa.array(np.bincount(doc, count, minlength=n).astype(np.int64)), pa.array(n_groups_links), pa.array(_digests(x, n, spelled, most), pa.string()),
                    pa.array([k.tobytes() for k in np.split(key % span, cuts)], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for c in np.split(count, cuts)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field("id", part.schema.field(0).type), *list(schema)[1:]]))

    return align


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, count, row) of the id pairs of a batch with columns keys and counts."""
    keys = [np.frombuffer(k, np.int64) for k in batch.column("keys").to_pylist()]
    counts = [np.frombuffer(c, np.uint32) for c in batch.column("counts").to_pylist()]
    rows = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    return (np.concatenate(keys), np.concatenate(counts).astype(np.int64), rows) if keys else (np.zeros(0, np.int64),) * 3


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the task's id pairs; passed on early where it has seen more than ``HELD_PAIRS`` different ones."""
    key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[tuple] = []
    for batch in batches:
        waiting.append(_pairs(batch)[:2])
        if sum(len(k) for k, _ in waiting) >= HELD_PAIRS:
            key, count = _summed(np.r_[key, *(k for k, _ in waiting)], np.r_[count, *(c for _, c in waiting)])
            waiting = []
            if len(key) >= HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], ["key", "n"])
                key, count = key[:0], count[:0]
    key, count = _summed(np.r_[key, *(k for k, _ in waiting)], np.r_[count, *(c for _, c in waiting)])
    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], ["key", "n"])


def _scorer(shared):
    """What the broadcast pairs give each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for batch in batches:
            key, times, row = _pairs(batch)
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            at, times, row = at[known], times[known], row[known]
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row, times * counts[at])
            np.add.at(sums[1], row, times * best[at])
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n not in ("keys", "counts")), pa.array(sums[0]), pa.array(sums[1])],
                                             [*(n for n in batch.schema.names if n not in ("keys", "counts")), "count_sum", "n_best"])

    return score


def _rare(shared):
    """(row, key, times) of the pairs that aren't broadcast."""

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value[0]
        for batch in batches:
            key, times, row = _pairs(batch)
            left = ~np.isin(key, keys, assume_unique=False)
            number = np.asarray(batch.column("row"))[row[left]] if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(key[left]), pa.array(times[left])], ["row", "key", "times"])

    return rare


DOCUMENT = "n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, keys binary, counts binary"


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table with a row per document: id, n_a, n_b, n_groups, n_links, n_group_links, groups_sha256, row (a number of its own), and
    its distinct id pairs: keys (64-bit A id * size of B + B id) and counts (32-bit).

    Whole texts; null and empty texts, and texts that either tokenizer does not give back byte for byte, have zeros and ''.
    Repeated rows each have a row; an empty table gives an empty one; other columns aren't read.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", read.schema["id"].dataType), *T._parse_datatype_string(DOCUMENT).fields])
    arrow = pa.schema([("id", pa.null()), *((f.name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[{"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString())]) for f in schema.fields[1:])])
    path = fresh_path(spark, "aligned")
    read.mapInArrow(_aligner(a_path, b_path, arrow), schema).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def pair_counts(aligned_docs: DataFrame, size_b: int) -> DataFrame:
    """(key, n, best): how many links corpus-wide hold an id pair linked, and whether no pair with the same B id has more."""
    counts = cut(aligned_docs.select("keys", "counts").mapInArrow(_pair_sums, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    b = (F.col("key") % size_b).alias("b")
    highest = counts.groupBy(b).agg(F.max("n").alias("highest"))
    return counts.withColumn("b", b).join(broadcast_below(highest, size_b, BROADCAST_ROWS), "b").select("key", "n", (F.col("n") == F.col("highest")).alias("best"))


def alignment_scores(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the corpus-wide highest count of its B id), count_sum (of the
    counts of its links), groups_sha256, n_group_links (pairs of tokens that share a group). Rows as align_documents() says."""
    spark = docs.sparkSession
    size_b = len(token_bytes(b_path))
    each = align_documents(docs, a_path, b_path, id_col, text_col)
    counts = cut(pair_counts(each, size_b))
    # the frequent pairs, by powers of two of their counts
    level = F.floor(F.log2(F.col("n"))).cast("int")
    levels = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    lowest, total = 64, 0
    for r in levels:
        total += r["count"]
        if total > hot_pairs:
            break
        lowest = r["level"]
    hot = counts.where(level >= lowest).toArrow().sort_by("key")
    shared = spark.sparkContext.broadcast((hot["key"].to_numpy(), hot["n"].to_numpy(), hot["best"].to_numpy().astype(np.int64)))
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256", "row"]
    scored = T.StructType([each.schema[n] for n in names] + [T.StructField(n, T.LongType()) for n in ("count_sum", "n_best")])
    out = each.select(*names, "keys", "counts").mapInArrow(_scorer(shared), scored)
    if total > hot_pairs:
        rare = each.select("row", "keys", "counts").mapInArrow(_rare(shared), "row long, key long, times long").join(counts.where(level < lowest), "key")
        sums = rare.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
        out = out.join(sums, "row", "left").withColumns({"count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0))})
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")


def token_links(docs: DataFrame, a_path: str, b_path: str, by: str = "overlap", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The links themselves, a row each: id, a_at and b_at (places of the tokens in their encodings), a_id, b_id, shared (bytes; 1 by ``group``)."""
    product = {"overlap": overlap_links, "group": group_links}[by]
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    limit_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("id", read.schema["id"].dataType), *T._parse_datatype_string("a_at long, b_at long, a_id int, b_id int, shared long").fields])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = Vocabulary(a_path), Vocabulary(b_path)
        for batch in batches:
            for part, _, _ in slices(batch, "text"):
                x = aligned(part.column(1).to_pylist(), left, right)
                first = [np.searchsorted(d, np.arange(part.num_rows)) for d in (x.a_doc, x.b_doc)]
                for i, j, n in product(x):
                    doc = x.a_doc[i]
                    numbers = [i - first[0][doc], j - first[1][doc], x.a[i].astype(np.int32), x.b[j].astype(np.int32), n.astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), *map(pa.array, numbers)], schema.names)

    return read.mapInArrow(links, schema).withColumnRenamed("id", id_col)
