"""Refined incompatibility of pairs of sites, in tiles of sites, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa

from cohortlens.functions.bases import _TABLE, characters

#: Sites a side of a tile.
TILE = 128
_HELD = 64 << 20  # bytes of tiles that a task holds before it sends them
_SLICE = 1 << 22  # numbers that are worked on at once


@lru_cache(1)
def incompatibility() -> np.ndarray:
    """For each set of pairs of bases (bit 4a + b: base a at one site with b at the other):
    edges less vertices plus components of the graph that they make, 0 for compatible sites."""
    out = np.zeros(1 << 16, np.uint8)
    for mask in range(1, 1 << 16):
        rows = [mask >> 4 * a & 15 for a in range(4) if mask >> 4 * a & 15]
        parts: list[int] = []
        for row in rows:
            near = [p for p in parts if p & row]
            parts = [p for p in parts if not p & row] + [row | sum(near)]  # disjoint, so their sum is their union
        out[mask] = mask.bit_count() - len(rows) - sum(parts).bit_count() + len(parts)
    return out


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``grp, seq, sites`` (columns from 1) to ``grp, i, j, bits``: a tile of sets of
    pairs of bases that a task's sequences have at blocks ``i`` and ``j`` of sites."""
    held: dict[tuple, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        keys = list(held)
        out = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([m.tobytes() for m in held.values()], pa.binary())]
        held.clear()
        return pa.RecordBatch.from_arrays(out, names=["grp", "i", "j", "bits"])

    for batch in batches:
        flat, offs = characters(batch.column(1))
        groups = np.array(batch.column(0).to_pylist(), dtype=object)
        for g in dict.fromkeys(groups):
            rows = np.flatnonzero(groups == g)
            at = np.asarray(batch.column(2)[int(rows[0])].as_py(), np.int64) - 1
            blocks = -(-len(at) // TILE)
            step = max(1, _SLICE // max(1, len(at)))
            for start in range(0, len(rows), step):
                some = rows[start : start + step]
                code = np.full((len(some), blocks * TILE), 4, np.uint8)
                for to, r in zip(code, some, strict=True):
                    inside = at[: int(np.searchsorted(at, offs[r + 1] - offs[r]))]
                    to[: len(inside)] = _TABLE[flat[offs[r] + inside]]
                has = [(code == a).astype(np.float32).reshape(len(some), blocks, TILE) for a in range(4)]
                for i in range(blocks):
                    for j in range(i, blocks):
                        tile = np.zeros((TILE, TILE), np.uint16)
                        for a in range(4):
                            for b in range(4):
                                tile |= (has[a][:, i].T @ has[b][:, j] > 0).astype(np.uint16) << (4 * a + b)
                        held[g, i, j] = held[g, i, j] | tile if (g, i, j) in held else tile
                        if len(held) * TILE * TILE * 2 >= _HELD:
                            yield flush()
    if held:
        yield flush()


def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``grp, i, j, bits`` sorted by tile to ``grp, i, j, score``: a byte of
    incompatibility for each pair of sites of a tile, as tiles stream by."""
    key, total = None, None

    def told() -> pa.RecordBatch:
        score = incompatibility()[total]
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32()), pa.array([score.tobytes()], pa.binary())], names=["grp", "i", "j", "score"])

    for batch in batches:
        for *k, raw in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if total is not None and key != k:
                yield told()
                total = None
            key, bits = k, np.frombuffer(raw, np.uint16)
            total = bits.copy() if total is None else total | bits
    if total is not None:
        yield told()


def places(sites: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Where each site stands: a row of the order as it is, then a row a replicate, ordered by
    the MD5 of ``seed:replicate:column``."""
    out = np.empty((replicates + 1, len(sites)), np.int32)
    out[0] = np.arange(len(sites))
    for r in range(1, replicates + 1):
        drawn = np.array([md5(f"{seed}:{r}:{c}".encode()).digest() for c in sites.tolist()], dtype="S16")
        # S16 drops trailing zero bytes, which leaves the order of 16-byte strings as it is
        out[r, np.argsort(drawn, kind="stable")] = out[0]
    return out


def windows(batches: Iterator[pa.RecordBatch], replicates: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows ``grp, i, j, score, sites, near`` sorted by group to ``grp, replicate, total``: the
    sum of scores over pairs of a task's tiles that stand at most ``near`` places apart."""
    group, at, total = None, None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group] * len(total), pa.string()), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["grp", "replicate", "total"])

    for batch in batches:
        for row, (g, i, j, raw, near) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5)), strict=True)):
            if total is None or g != group:
                if total is not None:
                    yield told()
                group, at, total = g, places(np.array(batch.column(4)[row].as_py()), replicates, seed), np.zeros(replicates + 1, np.int64)
            score = np.frombuffer(raw, np.uint8).reshape(TILE, TILE)
            a, b = np.nonzero(np.triu(score, 1) if i == j else score)
            weight, a, b = score[a, b].astype(np.int64), a + i * TILE, b + j * TILE
            step = max(1, _SLICE // max(1, len(a)))
            for r in range(0, replicates + 1, step):
                total[r : r + step] += (np.abs(at[r : r + step, a] - at[r : r + step, b]) <= near) @ weight
    if total is not None:
        yield told()
