"""Vectorised helpers on Arrow text columns, used inside tasks: words, hashes and slices of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text is worked on alone.
SLICE = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_U = np.uint64
_BASE, _rng = _U(0x9E3779B97F4A7C15), np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.int64).view(np.uint64) * _U(2) + _U(1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_powers: np.ndarray = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(base: np.uint64, at: np.ndarray) -> np.ndarray:
    """base ** at, modulo 2**64, from two small tables."""
    low = np.multiply.accumulate(np.r_[_U(1), np.full(4095, base)])
    step = _U(pow(int(base), 4096, 1 << 64))
    high = np.multiply.accumulate(np.r_[_U(1), np.full(int(at.max(initial=0)) >> 12, step)])
    return high[at >> 12] * low[at & 4095]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with at most ``size`` bytes of text (or one row): (rows, bytes, offsets)."""
    raw, offs = flat(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield batch.slice(at, to - at), raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes outside [\\x20\\x09-\\x0D]; runs end with their text."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~WHITE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offs] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by prefix sums of a polynomial; equal bytes give equal hashes."""
    global _powers
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(_powers) < len(raw):
        _powers = np.multiply.accumulate(np.r_[_U(1), np.full(max(len(raw), SLICE), _BASE)])
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, starts) + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words, first word and row of each; a text with fewer words (one at least) is one window."""
    count = np.bincount(rows, minlength=n_rows)
    begin = np.cumsum(count) - count
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    full = max(0, len(hashes) - width + 1)
    sums = np.zeros(full, np.uint64)
    for k in range(width):
        sums = sums * _U(0xD6E8FEB86659FD93) + hashes[k : k + full]
    whole = rows[:full] == rows[width - 1 : width - 1 + full]
    at = np.flatnonzero(whole)
    short = np.flatnonzero((count > 0) & (count < width))
    few = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        has = count[short] > k
        few[has] = few[has] * _U(0xA0761D6478BD642F) + hashes[begin[short[has]] + k]
    out = np.r_[mix(sums[at]), mix(few ^ _U(0x5851F42D4C957F2D))]
    first = np.r_[at, begin[short]]
    order = np.argsort(first, kind="stable")
    return out[order], first[order], rows[first[order]]


def sequence_digests(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """16 bytes for each text, equal for equal word sequences: two polynomials over the words' hashes, and their number."""
    count = np.bincount(rows, minlength=n_rows)
    begin = np.cumsum(count) - count
    place = np.arange(len(hashes)) - begin[rows]
    out = np.zeros((n_rows, 2), np.uint64)
    for k, base in enumerate((0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)):
        terms = mix(hashes ^ _U(base)) * _power(_U(base), place)
        sums = np.r_[_U(0), np.cumsum(terms, dtype=np.uint64)]
        out[:, k] = mix(sums[begin + count] - sums[begin] + count.astype(np.uint64) * _U(base ^ 0xFFFF))
    return out


def fixed_binary(values: np.ndarray) -> pa.Array:
    """Rows of a contiguous array as binary values."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offs = np.arange(len(values) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(values.tobytes())])


def row_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of consecutive ranges; an empty range gives 0."""
    sums = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]
