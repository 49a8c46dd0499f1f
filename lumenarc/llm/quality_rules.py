"""Quality rules: text statistics, and a hashed n-gram likelihood ratio of trusted to raw text.

The second rule compares two multinomials over hashed four-byte grams: one counted on trusted documents, one on all
documents. A document's value is the mean log ratio of its grams (so length doesn't matter), and it is kept where the
value reaches a fixed threshold; no sampling, so reruns agree. Counts cover every gram of every document; each task sends
at most 2**bits rows to the aggregation, and the driver gets the 2**bits sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarc.llm._store import broadcast_below, cut, limit_batches
from lumenarc.llm._text import WHITE, mix, row_sums, slices, span_hashes, windows, words

BITS = 17
#: Mean log ratio from which a document is kept.
THRESHOLD = -0.5
#: Ids of trusted documents that may be broadcast (8 bytes each and a hash table).
BROADCAST_IDS = 1_000_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: Names and types of the statistics, in order.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(raw: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each text; see quality()."""
    n = len(offs) - 1
    starts, ends, rows = words(raw, offs)
    hashes = span_hashes(raw, starts, ends)
    inside = ~WHITE[raw]
    out = {"n_words": np.bincount(rows, minlength=n), "word_chars": row_sums(inside & ((raw & 0xC0) != 0x80), offs), "n_symbols": row_sums(SYMBOLS[raw], offs)}
    breaks = np.flatnonzero(raw == 10)
    line, stop = np.sort(np.r_[offs[:-1], breaks + 1]), np.sort(np.r_[offs[1:], breaks])
    filled = np.r_[0, np.cumsum(inside)]
    has = filled[stop] > filled[line]
    line, stop = line[has], stop[has]
    owner = np.searchsorted(offs, line, "right") - 1
    out["n_dup_lines"] = _later(span_hashes(raw, line, stop), owner, n)
    win, first, at = windows(hashes, rows, n, 5)
    key = mix(win + mix(at.astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(rows) + 6, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + 5, -1)
    out["n_repeat_words"] = np.bincount(rows[np.cumsum(cover)[: len(rows)] > 0], minlength=n)
    return out


def _later(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Per row, how many values equal an earlier one of the row."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    return np.bincount(r[1:][(h[1:] == h[:-1]) & (r[1:] == r[:-1])], minlength=n)


def buckets(raw: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed four-byte grams at each byte, and whether the gram ends inside its text."""
    n = len(raw)
    x = np.zeros(n + 3, np.uint32)
    x[:n] = raw
    g = x[:n] | x[1 : n + 1] << np.uint32(8) | x[2 : n + 2] << np.uint32(16) | x[3 : n + 3] << np.uint32(24)
    valid = np.ones(n, bool)
    for k in range(1, 4):
        at = offs[1:] - k
        valid[at[at >= offs[:-1]]] = False
    return (g * np.uint32(2654435761)) >> np.uint32(32 - bits), valid


def _counter(bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, good = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part, raw, offs in slices(batch, "text"):
                h, valid = buckets(raw, offs, bits)
                total += np.bincount(h[valid], minlength=1 << bits)
                trusted = np.asarray(part.column(part.schema.get_field_index("trusted")).fill_null(False).cast(pa.int8())).astype(bool)
                if trusted.any():
                    chosen = valid & np.repeat(trusted, np.diff(offs))
                    good += np.bincount(h[chosen], minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at]), pa.array(good[at])], ["bucket", "n", "trusted"])

    return count


def _judge(ratio: np.ndarray, threshold: float, bits: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in slices(batch, "text"):
                stats = statistics(raw, offs)
                h, valid = buckets(raw, offs, bits)
                value = row_sums(np.where(valid, ratio[h], 0), offs) / np.maximum(row_sums(valid, offs), 1)
                failed = (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])
                columns = [part.column(0), *(pa.array(stats[k].astype(np.int64)) for k in STATS), pa.array(failed), pa.array(~failed & (value >= threshold)), pa.array(value)]
                yield pa.RecordBatch.from_arrays(columns, ["id", *STATS, "base_failed", "kept", "llr"])

    return judge


def fit_ratio(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, pseudo: float = 1.0) -> np.ndarray:
    """Log ratio of the trusted and the raw multinomial for each bucket; zeros without trusted text.

    Raw counts are scaled to the trusted total before ``pseudo`` is added to both, so smoothing pulls both alike, a bucket
    without evidence has ratio 0, and little trusted text doesn't shift all documents one way.

    ``trusted`` has the ids of trusted documents. Every document counts as raw, trusted ones too.
    """
    limit_batches(docs.sparkSession)
    good = cut(trusted.select(F.col(id_col).alias("id")).where("id is not null").distinct().withColumn("trusted", F.lit(True)))
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = read.join(broadcast_below(good, good.count(), BROADCAST_IDS), "id", "left").select("text", "trusted")
    counts = marked.mapInArrow(_counter(bits), "bucket int, n long, trusted long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("trusted").alias("trusted"))
    table = counts.toArrow()  # at most 2**bits rows
    n, t = np.zeros(1 << bits), np.zeros(1 << bits)
    at = np.asarray(table["bucket"])
    n[at], t[at] = np.asarray(table["n"]), np.asarray(table["trusted"])
    if not t.sum():
        return np.zeros(1 << bits, np.float32)
    return (np.log(t + pseudo) - np.log(n * (t.sum() / n.sum()) + pseudo)).astype(np.float32)


def quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    Words are runs outside [\\x20\\x09-\\x0D] (ASCII white space), word_chars their code points, n_symbols the characters of
    ``#*$%&|<>``, n_dup_lines the lines (split at \\n) that hold a word and equal an earlier line, n_repeat_words the words in windows of five that
    occur twice or more in the text. base_failed: under 10 words, or over 20% repeated words. llr is 0 for texts under four bytes.
    Null texts have no words; ids may repeat or be null, each row is judged alone; an empty table gives an empty one.
    """
    ratio = fit_ratio(docs, trusted, id_col, text_col, bits)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {', '.join(f'{k} long' for k in STATS)}, base_failed boolean, kept boolean, llr double"
    return read.mapInArrow(_judge(ratio, threshold, bits), schema).withColumnRenamed("id", id_col)
