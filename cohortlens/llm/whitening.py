"""Whitening of embeddings by a tiled covariance: rows are cut into blocks of rows and of
columns, a task multiplies two column blocks of one row block, products are summed a tile."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.names import col
from cohortlens.llm.vectext import fixed_rows, small_arrow
from cohortlens.llm.vectors import finite_rows, width
from cohortlens.workspace import Workspace


@dataclass(frozen=True)
class Whitening:
    """Entries c become floor(``scale`` c) + ``shift``; ``components`` are returned.

    Dimensions are cut into tiles of ``tile``, wider ones where that makes more than
    ``most_tiles`` column blocks: each block of ``row_block`` rows crosses the network once
    for each column block, so the shuffle is at most ``most_tiles`` times the rows. What
    the driver holds is one matrix of dimensions by dimensions, whatever the rows.
    """

    components: int = 16
    scale: int = 64
    shift: int = 1_000_000
    tile: int = 32
    most_tiles: int = 8
    row_block: int = 4096


#: Scaled entries from here on have no exact 64-bit integer; their rows count as not finite.
_LARGEST = float(1 << 62)


def _whole_numbers(batches: Iterator[pa.RecordBatch], dim: int, p: Whitening) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, c = finite_rows(batch.column(1), dim)
        scaled = np.floor(c * p.scale)
        fits = (np.abs(scaled) < _LARGEST).all(axis=1)
        x = scaled[fits].astype(np.int64) + p.shift
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[fits])), fixed_rows(x) if len(x) else pa.array([], pa.binary())], names=["vec_id", "x"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dim)


def _sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """A task's sums a dimension in two halves that cannot overflow, and its rows (-1)."""
    total, rows = np.zeros((2, dim), np.int64), 0
    for batch in batches:
        x = _matrix(batch.column(0), dim)
        total += np.stack(((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)))
        rows += len(x)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(dim), -1), pa.int32()), pa.array(np.append(total[0], 0)), pa.array(np.append(total[1], rows))], names=["dim", "high", "low"])


def _times_n_less_sum(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S exactly: 64-bit where all fit, else Python's integers."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * most + max(map(abs, total), default=0) < 1 << 62:
        return x * n - np.array(total, np.int64)
    return x.astype(object) * n - np.array(total, object)


def _centred(column: pa.Array, n: int, total: list[int]) -> np.ndarray:
    return (_times_n_less_sum(_matrix(column, len(total)), n, total) / n).astype(np.float64)


def _tiles(dim: int, p: Whitening) -> list[tuple[int, int]]:
    step = max(p.tile, -(-dim // p.most_tiles))
    return [(k, min(k + step, dim)) for k in range(0, dim, step)]


def _column_blocks(batches: Iterator[pa.RecordBatch], rows_of: Callable, dim: int, p: Whitening) -> Iterator[pa.RecordBatch]:
    """Each row block's column blocks, one beside every tile that multiplies it."""
    from pyspark import TaskContext

    task, cuts, number, held = TaskContext.get().partitionId(), _tiles(dim, p), 0, []

    def flush(x: np.ndarray) -> pa.RecordBatch:
        out = []
        for i, (a, b) in enumerate(cuts):
            raw = np.ascontiguousarray(x[:, a:b]).tobytes()
            out += [(task, number, min(i, j), max(i, j), int(j < i), raw) for j in range(len(cuts))]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["task", "block", "i", "j", "side", "raw"])

    for batch in batches:
        x = rows_of(batch.column(0))
        while len(x):
            room = p.row_block - sum(map(len, held))
            held.append(x[:room])
            x = x[room:]
            if sum(map(len, held)) == p.row_block:
                yield flush(np.concatenate(held))
                number, held = number + 1, []
    if held:
        yield flush(np.concatenate(held))


def covariance(table: DataFrame, rows_of: Callable, dim: int, n: int, p: Whitening) -> np.ndarray:
    """The covariance (divisor ``n``) of centred vectors that ``rows_of`` makes of the one
    column of a written table, whose order within a task a second attempt repeats: so the
    column blocks of a row block always belong together."""
    cuts = _tiles(dim, p)

    def multiply(pieces: pa.Table) -> pa.Table:
        i, j = pieces.column("i")[0].as_py(), pieces.column("j")[0].as_py()
        sides = dict(zip(pieces.column("side").to_pylist(), pieces.column("raw").to_pylist(), strict=True))
        left = np.frombuffer(sides[0], np.float64).reshape(-1, cuts[i][1] - cuts[i][0])
        right = left if i == j else np.frombuffer(sides[1], np.float64).reshape(-1, cuts[j][1] - cuts[j][0])
        product = left.T @ right
        row, column = np.indices(product.shape)
        return pa.table({"row": pa.array((row + cuts[i][0]).ravel(), pa.int32()), "column": pa.array((column + cuts[j][0]).ravel(), pa.int32()), "v": product.ravel()})

    blocks = table.mapInArrow(partial(_column_blocks, rows_of=rows_of, dim=dim, p=p), "task int, block int, i int, j int, side int, raw binary")
    products = blocks.groupBy("task", "block", "i", "j").applyInArrow(multiply, "row int, column int, v double")
    got = products.groupBy("row", "column").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((dim, dim))
    out[got.column("row").to_numpy(), got.column("column").to_numpy()] = got.column("v").to_numpy()
    upper = np.triu(out)
    return (upper + np.triu(upper, 1).T) / n


@dataclass(frozen=True)
class Whitener:
    """What whitens a vector: rows and sums of the fit list, axes (dimensions x components,
    divided by the root of their variance; zero where a component has none), shares of
    variance, and which components have any."""

    n: int
    total: list[int]
    axes: np.ndarray
    explained: np.ndarray
    spread: np.ndarray

    def __call__(self, column: pa.Array) -> np.ndarray:
        return _centred(column, self.n, self.total) @ self.axes


def _whitener(fit: DataFrame, dim: int, p: Whitening) -> Whitener | None:
    halves = fit.mapInArrow(partial(_sums, dim=dim), "dim int, high long, low long").groupBy("dim")
    found = {r.dim: (int(r.high) << 32) + int(r.low) for r in halves.agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).collect()}
    n, total = found.get(-1, 0), [found.get(k, 0) for k in range(dim)]
    if not n:
        return None
    v = covariance(fit, partial(_centred, n=n, total=total), dim, n, p)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][: p.components], vectors[:, ::-1][:, : p.components]
    spread = values > max(v.trace(), 0.0) * dim * np.finfo(np.float64).eps
    # of the two signs that with which the largest entry is positive
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    axes = np.where(spread, vectors / np.sqrt(np.where(spread, values, 1.0)), 0.0)
    return Whitener(n, total, axes, np.where(v.trace() > 0, values / max(v.trace(), np.finfo(np.float64).tiny), np.nan), spread)


def _means(batches: Iterator[pa.RecordBatch], whitener: Whitener) -> Iterator[pa.RecordBatch]:
    total = np.zeros(whitener.axes.shape[1])
    for batch in batches:
        total += whitener(batch.column(0)).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["dim", "total"])


def identity_error(fit: DataFrame, whitener: Whitener, p: Whitening) -> float | None:
    """The largest entry of the whitened fit list's covariance less the identity, over the
    components that have variance; None where none has."""
    k = whitener.axes.shape[1]
    sums = fit.mapInArrow(partial(_means, whitener=whitener), "dim int, total double").groupBy("dim").agg(F.sum("total").alias("total")).collect()
    mean = np.zeros(k)
    for r in sums:
        mean[r.dim] = r.total / whitener.n
    c = covariance(fit, lambda column: whitener(column) - mean, k, whitener.n, p)
    c = c[np.ix_(whitener.spread, whitener.spread)]
    return float(np.abs(c - np.eye(len(c))).max()) if len(c) else None


def _whitened(batches: Iterator[pa.RecordBatch], w: Whitener, error: float | None) -> Iterator[pa.RecordBatch]:
    k = w.axes.shape[1]
    for batch in batches:
        off = _times_n_less_sum(_matrix(batch.column(1), len(w.total)), w.n, w.total)
        most = max(abs(int(off.max(initial=0))), abs(int(off.min(initial=0))))
        exact = off if most * most * len(w.total) < 1 << 63 else off.astype(object)
        deviation = [d if d < 1 << 63 else None for d in (exact * exact).sum(axis=1).tolist()]
        white = (off / w.n).astype(np.float64) @ w.axes
        of_row = np.repeat(np.arange(batch.num_rows), k)
        rows = len(of_row)
        columns = [
            batch.column(0).take(pa.array(of_row)),
            pa.array(np.tile(np.arange(1, k + 1), batch.num_rows), pa.int32()),
            pa.array(np.full(rows, w.n), pa.int64()),
            pa.array(deviation, pa.int64()).take(pa.array(of_row)),
            pa.array(white.ravel(), mask=np.tile(~w.spread, batch.num_rows)),
            pa.array(np.tile(w.explained, batch.num_rows), from_pandas=True),
            pa.array([error] * rows, pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, p: Whitening = Whitening(), vector: str = "embedding", dim: int | None = None) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for
    every row of ``vec_id`` and ``vector`` that is kept, and each component.

    A vector is dropped if it is null, holds a null, NaN or infinite entry or one whose
    scaled value is no 64-bit integer, or has another length than ``dim`` (by default the
    length that most have; of two as frequent the larger). The covariance is that of the
    distinct vectors of whole numbers, so repeated rows count once in it, but each comes
    back with its own ``vec_id``, null ones too. Components without variance (fewer
    distinct vectors than dimensions, a constant dimension) have a null ``whitened`` and
    no part in ``identity_error``; with one distinct vector ``explained`` and
    ``identity_error`` are null. Components with equal variance come in any order.
    ``deviation`` is null where it exceeds a long. Further columns are ignored, an empty
    table gives an empty one.
    """
    spark = rows.sparkSession
    ws = Workspace(spark, "whiten")
    small_arrow(spark)
    rows = rows.select(F.col("vec_id").cast("long"), col(vector).cast("array<double>").alias("vector"))
    dim = width(rows, "vector") if dim is None else dim
    kept = ws.table(rows.mapInArrow(partial(_whole_numbers, dim=dim, p=p), "vec_id long, x binary"), "kept")
    fit = ws.table(kept.select("x").distinct(), "fit")
    whitener = _whitener(fit, dim, p) if dim else None
    if whitener is None:
        return spark.createDataFrame([], _OUT)
    return kept.mapInArrow(partial(_whitened, w=whitener, error=identity_error(fit, whitener, p)), _OUT)


def op11_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first 16 components. Nulls, repeated rows, ties, other
    lengths, an empty table and further columns: as in ``whiten``."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op11_tiled_whitening": op11_tiled_whitening}
#: SQL has no eigenvectors; tests hold the result against NumPy over the whole table.
ORACLES: dict = {}
