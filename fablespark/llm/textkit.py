"""Numpy kernels over Arrow text columns: words, hashes and shingles of many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
U = np.uint64
_rng = np.random.default_rng(20240229)
BYTE_HASH = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
TERMS = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1, modulo 2^64."""
    size = 1 << max(n, CHUNK_BYTES).bit_length()
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (BASE, BASE_INVERSE):
            x = np.full(size, U(base))
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _powers[size] = tuple(out)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about `most` bytes: first row, row after the last, bytes, offsets."""
    data, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with (h[e] - h[s]) * inverse power s a hash of data[s:e]."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * powers(len(data) + 1)[0][: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = powers(len(h))[1]
    return mix((h[ends] - h[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of non-space bytes, and the row it lies in."""
    solid = ~SPACE[data]
    before, after = np.empty_like(solid), np.empty_like(solid)
    if len(solid):
        before[1:], before[0] = solid[:-1], False
        after[:-1], after[-1] = solid[1:], False
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and its row."""
    if lower:
        data = LOWER[data]
    starts, ends, row = word_spans(data, offsets)
    return span_hash(prefix_hash(data), starts, ends), row


def shingles(words: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and their rows, grouped by row; fewer words make one shingle."""
    n = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    out, where = [], []
    if len(words) >= k:
        whole = np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1])
        x = np.zeros(len(whole), np.uint64)
        for j in range(k):
            x += words[whole + j] * TERMS[j]
        out.append(mix(x + U(k)))
        where.append(row[whole])
    for few in range(1, k):
        short = np.flatnonzero(n == few)
        if len(short):
            x = np.zeros(len(short), np.uint64)
            for j in range(few):
                x += words[first[short] + j] * TERMS[j]
            out.append(mix(x + U(few)))
            where.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(where)


def distinct_by_row(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, laid end to end, and the offsets of the rows."""
    if len(values) == 0:
        return values, np.zeros(rows + 1, np.int64)
    order = np.argsort(row, kind="stable")
    values, row = values[order], row[order]
    bounds = np.searchsorted(row, np.arange(rows + 1))
    parts, offsets = [], np.zeros(rows + 1, np.int64)
    for r in range(rows):
        part = np.sort(values[bounds[r] : bounds[r + 1]])
        if len(part) > 1:
            keep = np.empty(len(part), bool)
            keep[0] = True
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            part = part[keep]
        parts.append(part)
        offsets[r + 1] = offsets[r] + len(part)
    return np.concatenate(parts), offsets


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.ascontiguousarray(values).view(np.int64)))
