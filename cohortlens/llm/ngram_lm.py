"""Scores of a bigram language model by deleted interpolation.

Texts become chunks of token numbers. A chunk asks for the corpus counts of its distinct
tokens and bigrams: the questions are dealt out by ranges of their hashes, summed there,
and the answers go back to the chunks. So a count crosses the network once a chunk that
holds it, and no task needs the whole vocabulary.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.vectext import U64, buffers, pair, row_groups, small_arrow, word_hashes
from cohortlens.workspace import Workspace


@dataclass(frozen=True)
class Interpolation:
    """P(w | v) = a f(v w) / f(v) + b f(w) / N + c / (V + 1), the weights by a bucket of
    f(v), learned by ``rounds`` of expectation-maximisation on documents that the counts f
    leave out; then f counts these too. ``chunk_bytes``: text in a chunk (a longer text has
    one of its own). ``bucket_tokens``: tokens of the corpus for each range of hashes.
    A range with more than ``hot_bytes`` of questions, as that of a word which every chunk
    has, is summed in parts."""

    chunk_bytes: int = 16 << 20
    bucket_tokens: int = 1 << 19
    hot_bytes: int = 32 << 20
    buckets: int = 16
    rounds: int = 60


#: Roles of a document: counted; held out from the counts for the weights; only scored.
COUNTED, WEIGHING, SCORED = 0, 1, 2
_END, _BEGIN = U64(0xE4D0E4D0E4D0E4D1), U64(0xB0B0B0B0B0B0B0B7)
_STORE, _WORDS, _PAIRS, _SUMS = 0, 1, 2, 3
_PARTS = "role int, chunk string, kind int, bucket long, ids binary, keys binary, a binary, b binary"
#: Bits of a bigram's hash beyond its bucket's number: with a million bigrams a bucket, one
#: in a million shares its count with another.
_BITS = 40


def _pair_keys(keys: np.ndarray, ids: np.ndarray, begin: np.ndarray, bits: int) -> np.ndarray:
    before = np.empty(len(ids), U64)
    before[1:] = keys[ids[:-1]]
    before[begin[:-1]] = _BEGIN
    return pair(before, keys[ids]) >> U64(64 - _BITS - bits)


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones: small numbers compress well."""
    return np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _asked(role: int, chunk: str, kind: int, keys: np.ndarray, shift: int, width: int, n: np.ndarray) -> Iterator[tuple]:
    """A row for each range of sorted keys; texts that are only scored count nothing."""
    n = n if role != SCORED else np.zeros(len(keys), np.int64)
    bucket = (keys >> U64(shift)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]))
    raw = keys.view(np.uint8).reshape(-1, 8)[:, :width]
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield role, chunk, kind, int(bucket[s]), None, np.ascontiguousarray(raw[s:e]).tobytes(), _planes(n[s:e]), None


def _chunked(batches: Iterator[pa.RecordBatch], p: Interpolation, word_bits: int, pair_bits: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    held = {r: ([], [], [], 0) for r in (COUNTED, WEIGHING, SCORED)}
    number = itertools.count()
    schema = pa.schema([("role", pa.int32()), ("chunk", pa.string()), ("kind", pa.int32()), ("bucket", pa.int64()), *[(c, pa.binary()) for c in ("ids", "keys", "a", "b")]])

    def flush(role: int) -> Iterator[pa.RecordBatch]:
        ids_, words, lengths, _ = held[role]
        held[role] = ([], [], [], 0)
        chunk = f"{role}-{task}-{next(number)}"
        tokens, begin = np.concatenate(words), np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
        keys, ids, n = np.unique(tokens, return_inverse=True, return_counts=True)
        del tokens, words
        rank = np.empty(len(keys), np.int64)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(keys))
        # the most frequent token gets the smallest number
        by_rank = np.empty(len(keys), U64)
        by_rank[rank] = keys
        rows = [(role, chunk, _STORE, -1, pa.array(np.concatenate(ids_)).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), by_rank.tobytes(), _planes(rank[ids]), _planes(np.diff(begin)))]
        rows += _asked(role, chunk, _WORDS, keys, 64 - word_bits, 8, n)
        pairs, n = np.unique(_pair_keys(keys, ids, begin, pair_bits), return_counts=True)
        rows += _asked(role, chunk, _PAIRS, pairs, _BITS, 5, n)
        for k in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 64], strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        row, role_of = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        buf, offs = buffers(batch.column(2))
        for i, j in row_groups(offs, 1 << 18):
            hashes, begin = word_hashes(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            ended = np.insert(hashes, begin[1:], _END)
            begin = begin + np.arange(len(begin))
            for role in np.unique(role_of[i:j]).tolist():
                mine = np.flatnonzero(role_of[i:j] == role)
                rows_, words, lengths, size = held[role]
                rows_.append(row[i + mine])
                words += [ended[begin[k] : begin[k + 1]] for k in mine]
                lengths.append(np.diff(begin)[mine])
                held[role] = (rows_, words, lengths, size + int(np.diff(offs)[i + mine].sum()))
                if held[role][3] >= p.chunk_bytes:
                    yield from flush(role)
    for role in held:
        if held[role][0]:
            yield from flush(role)


def _keys_of(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view(U64).ravel()


_TOTALS = -1  # role of a row that holds sums of questions: keys, all counts, those of COUNTED


def _totals(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of questions (or of sums of some) in one range of hashes, with all
    counts and those of COUNTED texts."""
    width = 8 if rows.column("kind")[0].as_py() == _WORDS else 5
    roles = rows.column("role").to_pylist()
    all_ = [_unplaned(x) for x in rows.column("a").to_pylist()]
    counted = [_unplaned(y) if r == _TOTALS else x if r == COUNTED else np.zeros(len(x), np.uint32) for r, x, y in zip(roles, all_, rows.column("b").to_pylist(), strict=True)]
    keys, at = np.unique(np.concatenate([_keys_of(x, width) for x in rows.column("keys").to_pylist()]), return_inverse=True)
    return keys, *(np.bincount(at, np.concatenate(n), len(keys)).astype(np.int64) for n in (all_, counted))


def _rows(cols: dict) -> pa.Table:
    types = (pa.int32(), pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
    return pa.table({k: pa.array(cols[k], t) for k, t in zip(("role", "chunk", "kind", "bucket", "ids", "keys", "a", "b"), types, strict=True)})


def _added(rows: pa.Table) -> pa.Table:
    """Questions of one part of a range as one row."""
    kind, bucket = rows.column("kind")[0].as_py(), rows.column("bucket")[0].as_py()
    keys, all_, counted = _totals(rows)
    raw = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, : 8 if kind == _WORDS else 5]).tobytes()
    return _rows({"role": [_TOTALS], "chunk": [""], "kind": [kind], "bucket": [bucket], "ids": [None], "keys": [raw], "a": [_planes(all_)], "b": [_planes(counted)]})


def _told(rows: pa.Table) -> pa.Table:
    """Answers to each question of a range (or of a part of one, with the whole range's
    sums among the rows): all counts; to WEIGHING texts those of COUNTED ones too."""
    kind, bucket = rows.column("kind")[0].as_py(), rows.column("bucket")[0].as_py()
    sums = rows.filter(pa.array([r == _TOTALS for r in rows.column("role").to_pylist()]))
    keys, all_, counted = _totals(sums if len(sums) else rows)
    out = {c: [] for c in ("role", "chunk", "kind", "bucket", "ids", "keys", "a", "b")}
    for role, chunk, raw in zip(*(rows.column(c).to_pylist() for c in ("role", "chunk", "keys")), strict=True):
        if role == _TOTALS:
            continue
        at = np.searchsorted(keys, _keys_of(raw, 8 if kind == _WORDS else 5))
        for c, v in zip(out, (role, chunk, kind, bucket, None, None, _planes(all_[at]), _planes(counted[at]) if role == WEIGHING else None), strict=True):
            out[c].append(v)
    return _rows(out)


def _summed(rows: pa.Table) -> pa.Table:
    """Of a whole range: the answers, and a row of sums."""
    return pa.concat_tables([_told(rows), _sums(rows)])


def _sums(rows: pa.Table) -> pa.Table:
    """Of a whole range of words: all tokens, distinct ones, tokens of COUNTED texts."""
    kind, bucket = rows.column("kind")[0].as_py(), rows.column("bucket")[0].as_py()
    if kind != _WORDS:
        return _rows({c: [] for c in rows.column_names} | {"ids": []})
    _, all_, counted = _totals(rows)
    sums = np.array([all_.sum(), (all_ > 0).sum(), counted.sum()], np.int64).tobytes()
    return _rows({"role": [_TOTALS], "chunk": [""], "kind": [_SUMS], "bucket": [bucket], "ids": [sums], "keys": [None], "a": [None], "b": [None]})


def _as_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = np.sum([np.frombuffer(x, np.int64) for x in batch.column(0).to_pylist()], axis=0) if batch.num_rows else np.zeros(3, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in sums], names=["n", "distinct", "counted"])


def _answers(asked: DataFrame, p: Interpolation, ws: Workspace) -> DataFrame:
    """All questions' answers, and the sums of each range of words. The rows of a range
    go to one task; those of a hot range to as many as its bytes ask for, twice: once to be
    added up, once with the sums of the whole range to be answered."""
    sizes = asked.groupBy("kind", "bucket").agg((F.sum(F.octet_length("keys")) / p.hot_bytes).alias("x")).where("x > 1")
    hot = ws.table(sizes.select("kind", "bucket", F.ceil("x").alias("parts")), "hot")
    if not hot.head(1):
        return asked.groupBy("kind", "bucket").applyInArrow(_summed, _PARTS)
    cold = asked.join(hot, ["kind", "bucket"], "left_anti").select(*asked.columns).groupBy("kind", "bucket").applyInArrow(_summed, _PARTS)
    dealt = asked.join(hot, ["kind", "bucket"]).select(*asked.columns, F.pmod(F.xxhash64("chunk"), "parts").alias("part"))
    sums = ws.table(dealt.groupBy("kind", "bucket", "part").applyInArrow(_added, _PARTS), "hot-parts")
    totals = ws.table(sums.groupBy("kind", "bucket").applyInArrow(_added, _PARTS), "hot-totals")
    known = totals.join(hot, ["kind", "bucket"]).select(*asked.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    told = dealt.unionByName(known).groupBy("kind", "bucket", "part").applyInArrow(_told, _PARTS)
    return cold.unionAll(told).unionAll(totals.groupBy("kind", "bucket").applyInArrow(_sums, _PARTS))


@dataclass(frozen=True)
class Totals:
    """Training tokens, distinct ones, tokens of COUNTED texts; bits of the ranges."""

    n: int
    distinct: int
    counted: int
    pair_bits: int


def _answered(table: pa.Table, t: Totals, column: str = "a"):
    """Of one chunk: row numbers, where each text begins, and for each token its count, that
    of the token before it and that of both; all counts (``a``) or those of COUNTED (``b``)."""
    order = table.sort_by([("kind", "ascending"), ("bucket", "ascending")])
    kinds = order.column("kind").to_numpy()
    store = order.slice(int(np.flatnonzero(kinds == _STORE)[0]), 1).to_pylist()[0]
    keys, ids, begin = np.frombuffer(store["keys"], U64), _unplaned(store["a"]), np.concatenate(([0], np.cumsum(_unplaned(store["b"]).astype(np.int64))))

    def told(kind: int) -> np.ndarray:
        mine = order.filter(pa.array(kinds == kind)).column(column).to_pylist()
        return np.concatenate([_unplaned(x) for x in mine]).astype(np.int64)

    by_key = np.empty(len(keys), np.int64)
    by_key[np.argsort(keys)] = told(_WORDS)
    _, at = np.unique(_pair_keys(keys, ids, begin, t.pair_bits), return_inverse=True)
    both = told(_PAIRS)[at]
    before = np.empty(len(ids), np.int64)
    before[1:] = by_key[ids[:-1]]
    before[begin[:-1]] = by_key[np.flatnonzero(keys == _END)[0]]  # as many beginnings as ends
    return np.frombuffer(store["ids"], np.int64), begin, by_key[ids], before, both


def _bucket_of(before: np.ndarray, buckets: int) -> np.ndarray:
    """0 for a context never seen, then one for each doubling of its count."""
    return np.minimum(buckets - 1, np.where(before > 0, np.log2(np.maximum(before, 1)).astype(np.int64) + 1, 0))


_STEPS = 64


def _coarse(p: np.ndarray) -> np.ndarray:
    """A probability in half powers of two; 0 stays apart."""
    return np.where(p > 0, 1 + np.minimum(_STEPS - 2, np.round(-2 * np.log2(np.maximum(p, 1e-300)))), 0).astype(np.int64)


def _histogram(table: pa.Table, t: Totals, p: Interpolation) -> pa.Table:
    """Held-out tokens by context bucket and coarse probabilities."""
    _, _, model, before, both = _answered(table, t, "b")
    cell = (_bucket_of(before, p.buckets) * _STEPS + _coarse(both / np.maximum(before, 1))) * _STEPS + _coarse(model / max(1, t.counted))
    at, n = np.unique(cell, return_counts=True)
    return pa.table({"cell": pa.array(at), "n": pa.array(n.astype(np.int64))})


def mixture_weights(cells: np.ndarray, n: np.ndarray, distinct: int, p: Interpolation) -> np.ndarray:
    """``buckets x 3`` weights of bigram, word and uniform estimates by expectation-
    maximisation. A bucket without held-out tokens has the weights of all taken together."""
    value = np.concatenate(([0.0], 2.0 ** (-0.5 * np.arange(_STEPS - 1))))
    bucket = cells // (_STEPS * _STEPS)
    likely = np.stack([value[cells // _STEPS % _STEPS], value[cells % _STEPS], np.full(len(cells), 1 / (distinct + 1))], axis=1)
    start = np.array([0.4, 0.4, 0.2])

    def fitted(rows: np.ndarray) -> np.ndarray:
        w = start
        for _ in range(p.rounds if rows.any() else 0):
            part = likely[rows] * w
            w = (part / part.sum(axis=1, keepdims=True) * n[rows, None]).sum(axis=0) / n[rows].sum()
        w = np.maximum(w, 1e-5)
        return w / w.sum()

    pooled = fitted(np.ones(len(cells), bool))
    return np.stack([fitted(bucket == b) if (bucket == b).any() else pooled for b in range(p.buckets)])


def _scores(table: pa.Table, t: Totals, p: Interpolation, weights: np.ndarray) -> pa.Table:
    rows, begin, all_, before, both = _answered(table, t)
    w = weights[_bucket_of(before, p.buckets)]
    likely = w[:, 0] * both / np.maximum(before, 1) + w[:, 1] * all_ / max(1, t.n) + w[:, 2] / (t.distinct + 1)
    add = lambda x: np.add.reduceat(x, begin[:-1])
    cols = {
        "row": rows, "n_tokens": np.diff(begin), "n_known": add((all_ > 0).astype(np.int64)),
        "base_score": add(np.log10((all_ + 1) / (t.n + t.distinct + 1))), "score": add(np.log10(likely)),
    }
    return pa.table({k: pa.array(v) for k, v in cols.items()})


def score_texts(docs: DataFrame, p: Interpolation = Interpolation()) -> DataFrame:
    """``row, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``:
    ``row`` (an integer, given back as it is), ``role`` (COUNTED, WEIGHING or SCORED), ``text``.

    A token is a word (a run of anything but white space, A-Z lower-cased), or the end that
    every text has, null and empty ones too. ``base_score`` adds one to the counts of all
    rows but the scored ones; so does ``score``, the log10 probability by the interpolated
    model, whose weights the WEIGHING texts teach with counts of COUNTED ones alone.
    Without training rows every token is unknown. Repeated rows each count. A null ``row``
    is the smallest integer. Other columns are ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_arrow(spark)
    ws = Workspace(spark, "lm")
    docs = docs.select(F.coalesce(F.col("row").cast("long"), F.lit(-(1 << 63))).alias("row"), F.col("role").cast("int"), F.col("text").cast("string"))
    # a token is six bytes or so; what matters is that ranges grow with the corpus
    tokens = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    pair_bits = max(2, int(np.ceil(np.log2(max(1, tokens / p.bucket_tokens)))))
    word_bits = max(2, pair_bits - 2)
    chunks = docs.mapInArrow(partial(_chunked, p=p, word_bits=word_bits, pair_bits=pair_bits), _PARTS)
    chunks.write.option("compression", "zstd").partitionBy("kind").parquet(f"{ws.path}/parts")
    parts = spark.read.schema(_PARTS).parquet(f"{ws.path}/parts").select(*chunks.columns)
    answers = ws.table(_answers(parts.where(F.col("kind") != _STORE), p, ws), "answers", compression="zstd")
    for kind in (_WORDS, _PAIRS):  # answered, and half of all bytes
        ws.drop(f"parts/kind={kind}")
    parts = spark.read.schema(_PARTS).parquet(f"{ws.path}/parts").select(*chunks.columns)
    sums = answers.where(F.col("kind") == _SUMS).select("ids").mapInArrow(_as_numbers, "n long, distinct long, counted long")
    n, distinct, counted = (x or 0 for x in sums.agg(F.sum("n"), F.sum("distinct"), F.sum("counted")).first())
    t = Totals(n, distinct, counted, pair_bits)
    both = parts.where(F.col("kind") == _STORE).unionAll(answers.where(F.col("kind") < _SUMS))

    def histogram(table: pa.Table) -> pa.Table:
        return _histogram(table, t, p)

    def scores(table: pa.Table) -> pa.Table:
        return _scores(table, t, p, weights)

    seen = both.where(F.col("role") == WEIGHING).groupBy("chunk").applyInArrow(histogram, "cell long, n long")
    cells = seen.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    weights = mixture_weights(cells.column("cell").to_numpy(), cells.column("n").to_numpy(), distinct, p)
    out = both.groupBy("chunk").applyInArrow(scores, "row long, n_tokens long, n_known long, base_score double, score double")
    return out.select("row", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op10_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; fold 2 of 7 is only scored, fold 3 fits the weights, the rest is
    counted. A null doc_id is in no fold: it is counted, and null in the result. Repeated
    ids each give a row; further columns are not read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7))
    role = F.when(fold == 2, SCORED).when(fold == 3, WEIGHING).otherwise(COUNTED)
    out = score_texts(docs.select(F.col("doc_id").alias("row"), role.alias("role"), "text"))
    doc_id = F.when(F.col("row") > -(1 << 63), F.col("row"))
    return out.select(doc_id.alias("doc_id"), F.pmod(F.crc32(doc_id.cast("string")), F.lit(7)).eqNullSafe(2).alias("held_out"), *out.columns[1:])


QUERIES = {"op10_interpolated_lm": op10_interpolated_lm}
ORACLES: dict = {}
