"""Near-duplicate embeddings by an inverted multi-index: codebooks of both halves of a
vector make a grid of cells, a query visits cells from the nearest on, exact cosines verify."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import graph
from cohortlens.llm.names import col, lookup
from cohortlens.llm.vectext import binary_column, fixed_rows, small_arrow
from cohortlens.llm.vectors import finite_rows, width
from cohortlens.workspace import Workspace


@dataclass(frozen=True)
class MultiIndex:
    """Vectors of one label link at a ``cosine`` or more.

    The codebooks (one a half; the cube root of the number of vectors, within
    ``least_codes`` and ``most_codes``) are fitted on about ``sample`` vectors chosen by
    hash, fewer where these exceed ``sample_bytes``. A query visits cells by ascending
    distance until they are ``slack`` farther than the first; ``slack`` is the share
    ``recall`` of what it takes to meet neighbours of the sample at the threshold itself,
    turned in random directions of both halves or of one. Closer pairs are found more surely.

    The vectors of a label and a first code meet in blocks of ``members`` rows that are held
    and ``queries`` rows that stream by, so no group needs more however large it is.
    """

    cosine: float = 0.93
    recall: float = 0.999
    sample: int = 20_000
    sample_bytes: int = 64 << 20
    least_codes: int = 8
    most_codes: int = 256
    rounds: int = 12
    members: int = 4_096
    queries: int = 32_768
    small: int = 100_000
    seed: int = 7


@dataclass(frozen=True)
class Grid:
    """Codebooks of the first ``cut`` entries and of the rest, and the slack of a visit."""

    cut: int
    first: np.ndarray
    second: np.ndarray
    slack: float

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, : self.cut], self.first), _distances(x[:, self.cut :], self.second)


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared, up to rounding."""
    return (x * x).sum(axis=1)[:, None] + (codes * codes).sum(axis=1) - 2 * (x @ codes.T)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that huge and tiny entries keep their digits."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _codebook(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    codes = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = _distances(x, codes).argmin(axis=1)
        order, n = np.argsort(own, kind="stable"), np.bincount(own, minlength=len(codes))
        full = np.flatnonzero(n)
        codes = codes.copy()
        codes[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0) / n[full][:, None]
    return codes


def fit_grid(x: np.ndarray, total: int, p: MultiIndex) -> Grid:
    """Codebooks and slack from a sample (a row each, of length 1) of ``total`` vectors."""
    rng = np.random.default_rng(p.seed)
    k, cut = int(np.clip(round(total ** (1 / 3)), p.least_codes, p.most_codes)), -(-x.shape[1] // 2)
    grid = Grid(cut, _codebook(x[:, :cut], k, p.rounds, rng), _codebook(x[:, cut:], k, p.rounds, rng), 0.0)
    near, turned = grid.distances(x), []
    for k in range(max(3, -(-p.sample // len(x)))):
        aside = rng.standard_normal(x.shape)
        aside[:, [slice(0), slice(cut), slice(cut, None)][k % 3]] = 0  # in both halves, in either
        aside -= (aside * x).sum(axis=1, keepdims=True) * x
        length = np.linalg.norm(aside, axis=1, keepdims=True)
        y = p.cosine * x + np.sqrt(1 - p.cosine**2) * np.divide(aside, length, out=np.zeros_like(aside), where=length > 0)
        homes = [d.argmin(axis=1) for d in grid.distances(y)]
        turned.append(sum(d[np.arange(len(x)), h] - d.min(axis=1) for d, h in zip(near, homes, strict=True)))
    return Grid(grid.cut, grid.first, grid.second, float(np.quantile(np.concatenate(turned), p.recall)) + 1e-9)


def _sign(batches: Iterator[pa.RecordBatch], dim: int, kind: str) -> Iterator[pa.RecordBatch]:
    from hashlib import blake2b

    for batch in batches:
        at, x = finite_rows(batch.column(2), dim)
        x, raw = x.astype(kind), [None] * batch.num_rows
        ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keys = [None] * batch.num_rows
        for k, row, some in zip(at.tolist(), x, (x != 0).any(axis=1).tolist(), strict=True):
            if some and ids[k] is not None and labels[k] is not None:
                raw[k] = row.tobytes()
                keys[k] = blake2b(raw[k], digest_size=16, key=blake2b(labels[k].encode(), digest_size=16).digest()).digest()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), binary_column(keys), binary_column(raw)], names=["vec_id", "label", "key", "vec"])


def _rows(column: pa.Array, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def _placed(batches: Iterator[pa.RecordBatch], kind: str, dim: int, grid) -> Iterator[pa.RecordBatch]:
    """Each vector's cell, and the first codes it visits with what is left of its reach for
    the second: cells in the order of the traversal are those within that reach."""
    g = grid.value
    for batch in batches:
        d1, d2 = g.distances(_unit(_rows(batch.column(2), kind, dim)))
        left = (d1.min(axis=1) + d2.min(axis=1) + g.slack)[:, None] - d1
        row, code = np.nonzero(left >= d2.min(axis=1)[:, None])
        offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows)))).astype(np.int32)
        visits = pa.StructArray.from_arrays([pa.array(code, pa.int32()), pa.array(left[row, code])], names=["a", "reach"])
        cells = [pa.array(d.argmin(axis=1), pa.int32()) for d in (d1, d2)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *cells, pa.ListArray.from_arrays(pa.array(offsets), visits)], names=["rep", "label", "vec", "copies", "a", "b", "visits"])


class _Block:
    """The members of one block and what its queries have linked so far."""

    def __init__(self, reps: list, copies: list, codes: list, rows: list):
        codes = np.concatenate(codes)
        order = np.argsort(codes, kind="stable")
        self.reps, self.copies, self.rows = (np.concatenate(v)[order] for v in (reps, copies, rows))
        self.codes, begin = np.unique(codes[order], return_index=True)
        self.cells = list(zip(self.codes.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True))
        self.part = np.arange(len(order))

    def links(self, reps: np.ndarray, rows: np.ndarray, reach: np.ndarray, near: np.ndarray, least: float) -> tuple[np.ndarray, list]:
        """How many vectors each query links with in the cells that it visits, and enough
        links to connect all of them: one, or one for each part of the block not yet
        connected. ``near``: squared distances of the queries to the second codes."""
        count, edges = np.zeros(len(reps), np.int64), []
        for code, s, e in self.cells:
            at = np.flatnonzero(near[:, code] <= reach)
            if not len(at):
                continue
            hit = rows[at] @ self.rows[s:e].T >= least
            hit &= reps[at][:, None] != self.reps[s:e]
            some = hit.any(axis=1)
            at, hit = at[some], hit[some]
            if not len(at):
                continue
            count[at] += hit @ self.copies[s:e]
            low = np.where(hit, self.part[s:e], len(self.part)).min(axis=1)
            high = np.where(hit, self.part[s:e], -1).max(axis=1)
            edges += zip(reps[at].tolist(), self.reps[low].tolist(), strict=True)
            for k in np.flatnonzero(low != high).tolist():
                parts = np.unique(self.part[s:e][hit[k]])
                edges += [(int(reps[at[k]]), int(self.reps[x])) for x in parts[1:]]
                self.part[np.isin(self.part, parts)] = parts[0]
        return count, edges


def _linked(batches: Iterator[pa.RecordBatch], kind: str, dim: int, grid, least: float) -> Iterator[pa.RecordBatch]:
    """Rows ``label, a, held, streamed, is_query, rep, copies, b, reach, vec``, sorted so that
    a block's members come before its queries: ``u, v, n``, a row for each query's count
    (``v`` null) and for each link that connects."""
    g, group, members, block = grid.value, None, ([], [], [], []), None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
        x = _unit(_rows(batch.column(9), kind, dim)) if keys else np.zeros((0, dim))
        reps, copies, codes, reach = (batch.column(k).to_numpy(zero_copy_only=False) for k in (5, 6, 7, 8))
        out, s = [], 0
        while s < len(keys):
            e = s + 1
            while e < len(keys) and keys[e] == keys[s]:
                e += 1
            if keys[s][:4] != group:
                group, members, block = keys[s][:4], ([], [], [], []), None
            if not keys[s][4]:
                for held, new in zip(members, (reps[s:e], copies[s:e], codes[s:e].astype(np.int64), x[s:e]), strict=True):
                    held.append(new)
            elif members[0]:
                block = block or _Block(*members)
                for i in range(s, e, 1024):
                    j = min(e, i + 1024)
                    count, edges = block.links(reps[i:j], x[i:j], reach[i:j], _distances(x[i:j, g.cut :], g.second), least)
                    at = np.flatnonzero(count)
                    out += zip(reps[i:j][at].tolist(), [None] * len(at), count[at].tolist(), strict=True)
                    out += [(u, v, 0) for u, v in edges]
            s = e
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["u", "v", "n"])


def _meetings(placed: DataFrame, p: MultiIndex, ws: Workspace) -> DataFrame:
    """Members and queries of each label and first code, dealt to a grid of blocks where
    they are many. Only those groups are looked up, so a hot group costs others nothing."""
    of = F.struct("label", "a").alias("of")
    zero, half = F.lit(0).cast("long"), F.lit(None)
    own = placed.select("label", "a", "rep", "copies", "b", half.cast("double").alias("reach"), "vec")
    asks = placed.select("label", F.explode("visits").alias("visit"), "rep", "copies", half.cast("int").alias("b"), "vec")
    asks = asks.select("label", "visit.a", "rep", "copies", "b", "visit.reach", "vec")
    sizes = own.select("label", "a", F.lit(1).alias("m"), F.lit(0).alias("q")).union(asks.select("label", "a", F.lit(0), F.lit(1))).groupBy("label", "a").agg(F.sum("m").alias("m"), F.sum("q").alias("q"))
    sizes = sizes.where((F.col("m") > p.members) | (F.col("q") > p.queries)).where("m > 0")
    wide = ws.table(sizes.select(F.struct("label", "a").alias("wide"), F.ceil(F.col("m") / p.members).alias("held_n"), F.ceil(F.col("q") / p.queries).alias("streamed_n")), "wide")
    few = wide.count() <= p.small

    def dealt(rows: DataFrame, query: bool) -> DataFrame:
        rows = lookup(rows.withColumn("of", of), "of", wide, "wide", few, "left").withColumns({n: F.coalesce(n, F.lit(1).cast("long")) for n in ("held_n", "streamed_n")})
        mine, others = ("streamed", "held") if query else ("held", "streamed")
        rows = rows.withColumn(mine, F.pmod(F.xxhash64("rep", F.lit(int(query))), F.col(f"{mine}_n"))).withColumn(others, F.explode(F.sequence(zero, F.col(f"{others}_n") - 1)))
        return rows.select("label", "a", "held", "streamed", F.lit(query).alias("is_query"), "rep", "copies", "b", "reach", "vec")

    block = ["label", "a", "held", "streamed"]
    return dealt(own, False).union(dealt(asks, True)).repartition(*block).sortWithinPartitions(*block, "is_query")


def near_vectors(rows: DataFrame, p: MultiIndex = MultiIndex(), vector: str = "embedding", dim: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, label, vector``.

    Vectors of one label whose cosine reaches the threshold link; ``n_links`` counts the
    other vectors linked directly, exact copies included. Equal vectors of a label are one
    class that is indexed and searched once, so a vector that a third of all rows hold
    costs one search. Null and zero vectors, those with a null or non-finite entry or
    without the length ``dim`` (by default the most frequent), null labels and null ids
    link with nothing: ``n_links`` 0, a component of their own (null for a null id), kept.
    Rows that repeat an id and a vector count once; rows that repeat an id with different
    vectors are one node with the links of all. Further columns are ignored; an empty
    table gives an empty one.
    """
    spark = rows.sparkSession
    ws = Workspace(spark, "vectors")
    small_arrow(spark)
    kind = "<f4" if "array<float>" in dict(rows.dtypes)[vector] else "<f8"
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), col(vector).cast(f"array<{'float' if kind == '<f4' else 'double'}>").alias("vector"))
    dim = width(rows, "vector") if dim is None else dim
    signed = ws.table(rows.mapInArrow(partial(_sign, dim=dim, kind=kind), "vec_id long, label string, key binary, vec binary"), "signed")
    full = signed.where("key IS NOT NULL")
    copies = full.select("key", "vec_id").distinct().groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = ws.table(full.groupBy("key").agg(F.first("label").alias("label"), F.first("vec").alias("vec")).join(copies, "key"), "classes")
    n = classes.count()
    alone = F.col("vec_id").alias("component_id")
    if not n:
        return signed.select("vec_id", F.lit(0).cast("long").alias("n_links"), alone, F.lit(True).alias("kept"))
    bound = max(1, min(p.sample, p.sample_bytes // (8 * dim)))
    some = classes.where(F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n // bound)))) == 0).select("vec").toArrow().column(0).combine_chunks()
    some = some if len(some) else classes.select("vec").limit(1).toArrow().column(0).combine_chunks()
    grid = spark.sparkContext.broadcast(fit_grid(_unit(_rows(some, kind, dim)), n, p))
    placed = classes.select("rep", "label", "vec", "copies").mapInArrow(partial(_placed, kind=kind, dim=dim, grid=grid), "rep long, label string, vec binary, copies long, a int, b int, visits array<struct<a int, reach double>>")
    placed = ws.table(placed, "placed")
    met = _meetings(placed, p, ws).mapInArrow(partial(_linked, kind=kind, dim=dim, grid=grid, least=p.cosine), "u long, v long, n long")
    met = ws.table(met, "links")
    parts = graph.components(met.where("v IS NOT NULL").select("u", "v"), ws, "parts")
    counts = met.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    told = classes.select("key", "rep", "copies").join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    told = ws.table(told.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "told")
    out = lookup(signed.select("vec_id", F.col("key").alias("of")), "of", told, "key", n <= p.small, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of a label against each other at a cosine of 0.93. Nulls, zeros,
    repeated rows, ties, other lengths, an empty table and further columns: as in
    ``near_vectors``."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op12_multi_index": op12_multi_index}
ORACLES = {
    "op12_multi_index": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT p.w, r.root FROM r JOIN p ON p.u = r.id WHERE r.root < p.w),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT u, count(*) AS n FROM p GROUP BY u)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN n ON n.u = vec_id
"""
}
