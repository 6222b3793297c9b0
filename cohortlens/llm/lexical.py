"""Ranked lexical search: an inverted index in shards, each searched by MaxScore."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.vectext import U64, buffers, row_groups, small_arrow, term_hashes
from cohortlens.workspace import Workspace


@dataclass(frozen=True)
class Ranking:
    """The ``top`` documents an item. A shard holds about ``shard_bytes`` of text, a longer
    text has one of its own. Items are searched ``block_terms`` of their terms at a time,
    which bounds what tasks hold of them; ``chunk`` postings of an essential list are
    scored at once. Lists of terms up to ``small`` are broadcast."""

    top: int = 50
    shard_bytes: int = 16 << 20
    block_terms: int = 500_000
    chunk: int = 4_096
    small: int = 1_000_000


def _binaries(flat: np.ndarray, begin: np.ndarray) -> pa.Array:
    """``flat[begin[k]:begin[k + 1]]`` as a binary value for each k."""
    flat = np.ascontiguousarray(flat)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer((begin * flat.itemsize).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def _bounds(term: np.ndarray, tf: np.ndarray, n: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """For each term the pairs (tf, n) that no posting beats in both: its highest score is
    at one of them, whatever the corpus' mean length. As flat pairs and where each begins."""
    order = np.lexsort((n, -tf, term))
    term, tf, n = term[order], tf[order], n[order]
    # the running minimum of n within a term: later terms lie below all earlier ones
    low = n - term * (int(n.max(initial=0)) + 1)
    best = np.concatenate(([True], low[1:] < np.minimum.accumulate(low)[:-1])) if len(low) else np.zeros(0, bool)
    return np.stack((tf[best], n[best]), axis=1), np.concatenate(([0], np.cumsum(np.bincount(term[best], minlength=terms))))


_INDEX = "shard string, term long, df long, tokens long, docs binary, tfs binary, bounds binary"


def _shards(batches: Iterator[pa.RecordBatch], p: Ranking) -> Iterator[pa.RecordBatch]:
    """Rows of a shard: its documents (``term`` null; ids and lengths by ascending id, null
    ids last), then each term's postings: places of documents, counts, bounds."""
    from pyspark import TaskContext

    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0
    names = [c.split()[0] for c in _INDEX.split(", ")]

    def flush() -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([h[0] for h in held])
        hashes, n = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        held.clear()
        key, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((key, null))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        terms, of = np.unique(hashes, return_inverse=True)
        pairs, tf = np.unique(of * len(order) + np.repeat(place, n), return_counts=True)
        term, doc = pairs // max(1, len(order)), pairs % max(1, len(order))
        begin = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(terms)))))
        bounds, bounds_begin = _bounds(term, tf, n[order][doc], len(terms))
        shard = f"{task}-{number}"
        whole = [[shard], [None], [int((n > 0).sum())], [int(n.sum())], [key[order].tobytes()], [n[order].tobytes()], [np.packbits(null[order]).tobytes()]]
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(whole, types, strict=True)], names=names)
        for s in range(0, len(terms), 8192):
            e = min(len(terms), s + 8192)
            at, to = begin[s], begin[e]
            columns = [pa.array([shard] * (e - s)), pa.array(terms[s:e].view(np.int64)), pa.array(np.diff(begin[s : e + 1])), pa.array(np.zeros(e - s, np.int64))]
            columns += [_binaries(x[at:to].astype(np.int32), begin[s : e + 1] - at) for x in (doc, tf)]
            columns.append(_binaries(bounds[bounds_begin[s] : bounds_begin[e]].astype(np.int64).ravel(), 2 * (bounds_begin[s : e + 1] - bounds_begin[s])))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        buf, offs = buffers(batch.column(1))
        for i, j in row_groups(offs, 1 << 18):
            hashes, begin = term_hashes(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            held.append((batch.column(0).slice(i, j - i), hashes, np.diff(begin)))
            size += int(offs[j] - offs[i])
            if size >= p.shard_bytes:
                yield from flush()
                number, size = number + 1, 0
    if held:
        yield from flush()


def build_index(docs: DataFrame, ws: Workspace, p: Ranking = Ranking()) -> DataFrame:
    """The written index of ``doc_id, text``: a row for each shard and one for each of its
    terms. Every document is in it, those without a term too."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return ws.table(rows.mapInArrow(partial(_shards, p=p), _INDEX), "index")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, begin = term_hashes(*buffers(batch.column(1)))
        own = [np.unique(hashes[s:e]).view(np.int64) for s, e in zip(begin[:-1], begin[1:], strict=True)]
        of = np.repeat(np.arange(len(own)), [len(x) for x in own])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(np.concatenate([*own, np.zeros(0, np.int64)]))], names=["item_id", "term"])


class _Shard:
    """One shard's documents and the postings of the terms that items ask for."""

    def __init__(self, ids: bytes, n: bytes, null: bytes, texts: int, tokens: int):
        self.ids, n = np.frombuffer(ids, np.int64), np.frombuffer(n, np.int64)
        self.null = np.unpackbits(np.frombuffer(null, np.uint8), count=len(self.ids)).astype(bool)
        wide = 50 * int(n.max(initial=0)) * texts >= 1 << 63
        long_ = (n.astype(object) if wide else n) * (50 * texts) // max(1, tokens)
        self.m = 50 + long_.astype(np.int64)
        self.texts, self.tokens, self.postings = texts, tokens, {}

    def add(self, term: int, weight: int, docs: bytes, tfs: bytes, bounds: bytes) -> None:
        tf, n = np.frombuffer(bounds, np.int64).reshape(-1, 2).T.tolist()
        most = max(weight * (1_000_000_000 * t // (1000 * t + 20 * (50 + 50 * k * self.texts // self.tokens))) for t, k in zip(tf, n, strict=True))
        self.postings[term] = [most, weight, np.frombuffer(docs, np.int32), np.frombuffer(tfs, np.int32), None]

    def scored(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a term and what it adds to each, worked out at its first use."""
        found = self.postings[term]
        if found[4] is None:
            tf = found[3].astype(np.int64)
            found[4] = found[1] * (1_000_000_000 * tf // (1000 * tf + 20 * self.m[found[2]]))
        return found[2], found[4]


@dataclass
class _Best:
    """An item's best documents so far, best first, and the score to reach."""

    score: np.ndarray
    doc: np.ndarray
    null: np.ndarray
    least: int = 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray, top: int) -> None:
        score, doc, null = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[:top]
        self.score, self.doc, self.null = score[order], doc[order], null[order]
        if len(order) == top:
            self.least = max(1, int(self.score[-1]))


def max_score(shard: _Shard, terms: list[int], best: _Best, p: Ranking) -> None:
    """Add the shard's documents that belong to an item's best.

    Terms go by falling bound. Essential are those before the point where the bounds of all
    that follow cannot reach the score that counts: only their postings are opened. A
    document found there looks up the later terms one by one, while what it has and the
    bounds still to come can reach that score. Equal scores go on, as a smaller id wins."""
    terms = sorted((t for t in terms if t in shard.postings), key=lambda t: -shard.postings[t][0])
    bound = [shard.postings[t][0] for t in terms]
    after = np.concatenate((np.cumsum(bound[::-1])[::-1], [0])).astype(np.int64) if terms else np.zeros(1, np.int64)
    seen = np.zeros(len(shard.ids), bool)
    for k, term in enumerate(terms):
        if after[k] < best.least:
            break
        docs, adds = shard.scored(term)
        for s in range(0, len(docs), p.chunk):
            at, score = docs[s : s + p.chunk], adds[s : s + p.chunk]
            go = ~seen[at] & (score + after[k + 1] >= best.least)
            seen[at] = True
            at, score = at[go], score[go]
            for j in range(k + 1, len(terms)):
                if not len(at):
                    break
                other, more = shard.scored(terms[j])
                place = np.minimum(np.searchsorted(other, at), len(other) - 1)
                score = score + np.where(other[place] == at, more[place], 0)
                go = score + after[j + 1] >= best.least
                if not go.all():
                    at, score = at[go], score[go]
            go = score >= best.least
            if go.any():
                best.add(score[go], shard.ids[at[go]], shard.null[at[go]], p.top)


def _search(batches: Iterator[pa.RecordBatch], items, texts: int, tokens: int, p: Ranking) -> Iterator[pa.RecordBatch]:
    """A task's best documents of each item, over all its shards: the score that counts is
    carried from shard to shard."""
    asked, weights = items.value
    best = {item: _Best(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for item in asked}
    shard = None

    def finish() -> None:
        if shard is not None and shard.postings:
            for item, terms in asked.items():
                max_score(shard, terms, best[item], p)

    for batch in batches:
        for term, docs, tfs, bounds in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
            if term is None:
                finish()
                shard = _Shard(docs, tfs, bounds, texts, tokens)
            else:
                shard.add(term, weights[term], docs, tfs, bounds)
    finish()
    for item, b in best.items():
        if len(b.score):
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(b.score), pa.int64()), pa.array(b.doc, mask=b.null), pa.array(b.score)], names=["item_id", "doc_id", "score"])


def search(index: DataFrame, items: DataFrame, ws: Workspace, p: Ranking = Ranking()) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents of ``index`` for each item
    (``item_id, text``); other things as in ``ranked``."""
    spark = index.sparkSession
    items = items.where("item_id IS NOT NULL").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.max(F.col("text").cast("string")).alias("text"))
    asked = ws.table(items.mapInArrow(_terms, "item_id long, term long"), "asked")
    whole = index.where("term IS NULL").agg(F.sum("df").alias("texts"), F.sum("tokens").alias("tokens")).first()
    texts, tokens = whole.texts or 0, whole.tokens or 0
    vocabulary = ws.table(asked.select("term").distinct(), "vocabulary")
    n_terms = vocabulary.count()
    held = index.where("term IS NOT NULL").select("term", "df").join(F.broadcast(vocabulary) if n_terms <= p.small else vocabulary, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * texts + 2.0) / (2 * F.col("df") + 1))).cast("long")
    weights = ws.table(asked.join(held.select("term", weight.alias("weight")), "term"), "weights")
    parts = max(1, -(-weights.count() // p.block_terms))
    out = None
    for k in range(parts):
        rows = weights.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).toArrow().to_pydict()
        if not rows["term"]:
            continue
        terms: dict[int, list[int]] = {}
        for item, term in zip(rows["item_id"], rows["term"], strict=True):
            terms.setdefault(item, []).append(term)
        block = spark.sparkContext.broadcast((terms, dict(zip(rows["term"], rows["weight"], strict=True))))
        wanted = F.broadcast(weights.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).select("term").distinct())
        postings = index.where("term IS NOT NULL").join(wanted, "term", "left_semi").select("shard", "term", "docs", "tfs", "bounds")
        postings = postings.union(index.where("term IS NULL").select("shard", "term", "docs", "tfs", "bounds")).repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
        found = ws.table(postings.mapInArrow(partial(_search, items=block, texts=texts, tokens=tokens, p=p), "item_id long, doc_id long, score long"), f"best-{k}")
        block.unpersist()
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.select("item_id", rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= p.top)


def ranked(docs: DataFrame, items: DataFrame, p: Ranking = Ranking()) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item (``item_id, text``) its best
    documents (``doc_id, text``), equal scores by ascending id, null ids last.

    A term is a run of digits, letters A-Z (lower-cased) and characters past 0x7F, of any
    length; counts are over all documents. Null, empty and termless texts are ranked for
    nothing; an item without terms has no rows. Every row is a document of its own, also
    one that repeats an id. Items with a null id are left out; of items with one id the
    largest text counts. Further columns are ignored; an empty table on either side gives
    no rows. Terms are known by 64 bits of a hash."""
    ws = Workspace(docs.sparkSession, "lexical")
    small_arrow(docs.sparkSession)
    return search(build_index(docs, ws, p), items, ws, p)


def op13_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item. Nulls, empty and long texts, ties,
    repeated rows, empty tables and further columns: as in ``ranked``."""
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op13_max_score": op13_max_score}
ORACLES = {
    "op13_max_score": r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
g AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, g),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), g GROUP BY item_id, doc_id),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM r WHERE k <= 50
"""
}
