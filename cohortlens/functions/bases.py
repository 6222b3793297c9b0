"""Bases of a column of sequences as codes, computed on Arrow's buffers inside tasks: the
counts of columns of an alignment and the differences from a reference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Codes: A, C, G, T, a missing base (N or a gap), anything else.
CODES = 6
#: Columns of an alignment that are counted and sent together.
SPAN = 4096
_HELD = 64 << 20  # bytes of counts that a task holds before it sends them
_SLICE = 1 << 20  # characters that are worked on at once
_TABLE = np.full(256, 5, np.uint8)
_TABLE[np.frombuffer(b"ACGTN-", np.uint8)] = [0, 1, 2, 3, 4, 4]


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each character of all sequences in a row (0xFF past 0x7F), and where each
    sequence begins; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offs[0] : offs[-1]]
    offs = offs - offs[0]
    if (flat < 0x80).all():
        return flat, offs
    first = (flat & 0xC0) != 0x80  # the first bytes of characters
    at = np.concatenate(([0], np.cumsum(first)))
    return np.where(flat >= 0x80, 0xFF, flat)[first].astype(np.uint8), at[offs]


def pieces(batches: Iterator[pa.RecordBatch], seq: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in slices of about a million characters, or one longer row each."""
    for batch in batches:
        flat, offs = characters(batch.column(seq))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + _SLICE, "right")) - 1)
            yield batch.slice(i, j - i), flat[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def count_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``grp, seq`` to ``grp, block, counts``: for each block of columns a matrix of
    how often each code stands in each column, over all sequences of a task."""
    held: dict[tuple, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        keys = list(held)
        out = [pa.array([g for g, _ in keys], pa.string()), pa.array([b for _, b in keys], pa.int64()), pa.array([m.tobytes() for m in held.values()], pa.binary())]
        held.clear()
        return pa.RecordBatch.from_arrays(out, names=["grp", "block", "counts"])

    for batch, flat, offs in pieces(batches, 1):
        groups = np.array(batch.column(0).to_pylist(), dtype=object)
        codes = _TABLE[flat].astype(np.int64)
        pos = np.arange(len(flat)) - np.repeat(offs[:-1], np.diff(offs))
        for g in dict.fromkeys(groups):
            mine = np.repeat(groups == g if g is not None else [x is None for x in groups], np.diff(offs))
            block, within = np.divmod(pos[mine], SPAN)
            code = codes[mine]
            for b in np.unique(block).tolist():
                here = block == b
                n = np.bincount(within[here] * CODES + code[here], minlength=SPAN * CODES)
                held[g, b] = held[g, b] + n if (g, b) in held else n
                if len(held) * SPAN * CODES * 8 >= _HELD:
                    yield flush()
    if held:
        yield flush()


def add_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``grp, block, counts`` sorted by group and block, added up as they stream by:
    ``grp, pos, a, c, g, t, missing, other`` for every column that has a sequence."""
    key, total = None, None

    def told() -> pa.RecordBatch:
        m = total.reshape(SPAN, CODES)
        at = np.flatnonzero(m.sum(axis=1))
        out = [pa.array([key[0]] * len(at), pa.string()), pa.array((key[1] * SPAN + at + 1).astype(np.int32)), *[pa.array(m[at, k]) for k in range(CODES)]]
        return pa.RecordBatch.from_arrays(out, names=["grp", "pos", "a", "c", "g", "t", "missing", "other"])

    for batch in batches:
        for g, b, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if total is not None and key != (g, b):
                yield told()
                total = None
            key, n = (g, b), np.frombuffer(raw, np.int64)
            total = n.copy() if total is None else total + n
    if total is not None:
        yield told()


class Reference:
    """A sequence to compare with: its bases in upper case and where they stand in context
    (1: a C after T, 2: a G before A)."""

    def __init__(self, seq: str):
        self.seq = _upper(characters(pa.array([seq], pa.string()))[0])
        self.code = _TABLE[self.seq]
        after_t = np.concatenate(([False], self.seq[:-1] == ord("T")))
        before_a = np.concatenate((self.seq[1:] == ord("A"), [False]))
        self.context = np.where((self.seq == ord("C")) & after_t, 1, np.where((self.seq == ord("G")) & before_a, 2, 0))[: len(self.seq)]

    def differences(self, flat: np.ndarray, offs: np.ndarray, same_length: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of sequences: row, place, base of the reference and of the sequence, and context
        (of the change that it makes, else 0), where both are known and differ."""
        n = len(self.seq)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        pos = np.arange(len(flat)) - offs[row]
        inside = pos < n if not same_length else (np.diff(offs) == n)[row]
        row, pos, base = row[inside], pos[inside], _upper(flat[inside])
        code = _TABLE[base]
        at = np.flatnonzero((code < 4) & (self.code[pos] < 4) & (code != self.code[pos]))
        row, pos, base = row[at], pos[at], base[at]
        edited = np.where((self.context[pos] == 1) & (base == ord("T")), 1, np.where((self.context[pos] == 2) & (base == ord("A")), 2, 0))
        return row, pos, self.seq[pos], base, edited


def _upper(b: np.ndarray) -> np.ndarray:
    return np.where((b >= 97) & (b <= 122), b - 32, b).astype(np.uint8)


_CONTEXTS = pa.array([None, "TC", "GA"], pa.string())


def _letters(b: np.ndarray) -> pa.Array:
    return pa.array(["A", "C", "G", "T"], pa.string()).take(pa.array(_TABLE[b]))


def list_differences(batches: Iterator[pa.RecordBatch], ref: Reference, same_length: bool) -> Iterator[pa.RecordBatch]:
    """Rows ``accession, seq`` to a row a difference."""
    for batch, flat, offs in pieces(batches, 1):
        row, pos, was, base, edited = ref.differences(flat, offs, same_length)
        columns = [batch.column(0).take(pa.array(row)), pa.array((pos + 1).astype(np.int32)), _letters(was), _letters(base), _CONTEXTS.take(pa.array(edited))]
        yield pa.RecordBatch.from_arrays(columns, names=["accession", "pos", "ref", "alt", "context"])


def count_differences(batches: Iterator[pa.RecordBatch], ref: Reference, same_length: bool) -> Iterator[pa.RecordBatch]:
    """Rows ``accession, seq`` to their numbers of differences and of those in context;
    sequences of another length are left out if ``same_length``."""
    for batch, flat, offs in pieces(batches, 1):
        row, *_, edited = ref.differences(flat, offs, same_length)
        n, hit = np.bincount(row, minlength=batch.num_rows), np.bincount(row[edited > 0], minlength=batch.num_rows)
        some = pc.is_valid(batch.column(1)).to_numpy(zero_copy_only=False)
        if same_length:
            some &= np.diff(offs) == len(ref.seq)
        at = np.flatnonzero(some)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(n[at].astype(np.int64)), pa.array(hit[at].astype(np.int64))], names=["accession", "total_snvs", "apobec3_snvs"])
