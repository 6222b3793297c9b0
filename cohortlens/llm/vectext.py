"""Words of a column of texts as 64-bit hashes, computed on the Arrow buffer at once.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased; every
other byte counts as it is. Two equal words have equal hashes; two different words share
one with a chance near 2**-64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE = 1 << 17
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _space(b: np.ndarray) -> np.ndarray:
    return (b == 0x20) | (b - np.uint8(0x09) < 5)


def _no_term(b: np.ndarray) -> np.ndarray:
    """Bytes that are neither a digit nor a letter A-Z nor part of a character past 0x7F."""
    letter = (b | np.uint8(0x20)) - np.uint8(97) < 26
    return ~(letter | (b - np.uint8(48) < 10) | (b >= 0x80))


def _lower(b: np.ndarray) -> np.ndarray:
    return b + ((b - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers over all positions (a bijection)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """An order-dependent hash of two hashes."""
    return mix(left * U64(0x9DDFEA08EB382D69) + right + U64(0x2545F4914F6CDD1D))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE, 1 << (n - 1).bit_length())
    if size not in _powers:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        if size > SLICE:
            return tables[0], tables[1]
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column in a row, and where each begins; null is empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def small_arrow(spark) -> None:
    """Batches of at most 1 MiB between Spark and Python, unless the session has a limit of
    its own: memory for larger ones stays with an executor's allocator after their use."""
    if spark.conf.get(_ARROW_LIMIT) == "67108864b":  # Spark's own default
        spark.conf.set(_ARROW_LIMIT, str(1 << 20))


def small_batches(batches: Iterator[pa.RecordBatch], text: int, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with at most ``limit`` bytes of text, or one longer row
    each, so that what is computed beside them stays small too."""
    for batch in batches:
        for i, j in row_groups(buffers(batch.column(text))[1], limit):
            yield batch.slice(i, j - i)


def row_groups(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or one longer row each."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def term_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, of runs of digits, letters A-Z and characters past 0x7F."""
    return word_hashes(buf, offs, _no_term)


def word_hashes(buf: np.ndarray, offs: np.ndarray, gap: Callable = _space) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words begin (n + 1).
    ``gap`` tells the bytes that are in no word."""
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    hashes, starts, s = [], [], 0
    while s < len(buf):
        e, step = min(len(buf), s + SLICE), SLICE
        while e < len(buf):
            cuts = np.flatnonzero(gap(buf[e - step + 1 : e + 1]) | edge[e - step + 1 : e + 1])
            if len(cuts):
                e = e - step + 1 + int(cuts[-1])
                break
            e = min(len(buf), e + step)
        part = buf[s:e]
        word = ~gap(part)
        before = np.concatenate(([False], word[:-1])) & ~edge[s:e]
        after = np.concatenate((word[1:], [False])) & ~edge[s + 1 : e + 1]
        first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        power, inverse = _power_tables(len(part))
        total = np.zeros(len(part) + 1, U64)
        np.cumsum((_lower(part).astype(U64) + U64(1)) * power[: len(part)], out=total[1:])
        h = (total[last] - total[first]) * inverse[first]
        hashes.append(mix(h + (last - first).astype(U64) * U64(0xD6E8FEB86659FD93)))
        starts.append(first + s)
        s = e
    if not hashes:
        return np.zeros(0, U64), np.zeros(len(offs), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offs)


def binary_column(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def fixed_rows(matrix: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    flat = np.ascontiguousarray(matrix)
    width = flat.shape[1] * flat.itemsize
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])
