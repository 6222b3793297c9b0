"""Near-duplicate documents: MinHash bands propose, a sequential Bayesian test prunes,
whole shingle sets confirm, contraction by stars gathers the groups."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import graph
from cohortlens.llm.names import lookup
from cohortlens.llm.vectext import U64, binary_column, buffers, fixed_rows, mix, pair, row_groups, small_arrow, word_hashes
from cohortlens.workspace import Workspace


@dataclass(frozen=True)
class NearDuplicates:
    """``words`` a shingle, link at a Jaccard similarity of ``percent``/100 or more.

    ``bands`` x ``rows`` minima propose pairs: at similarity 0.8 the defaults miss a pair
    with a chance of 6e-5, at less than that for every closer pair. ``batch`` minima at a
    time are compared; a pair goes when the posterior chance (uniform prior) that its
    similarity reaches the threshold is below ``miss``. About ``star`` partners are
    verified beside one copy of their pivot's text; blocks of a component that texts are
    compared with have ``star`` members or ``block_shingles`` shingles. ``small_ids``
    bounds the id lists that are broadcast; longer ones are joined by a shuffle.
    """

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 6
    batch: int = 32
    miss: float = 1e-6
    star: int = 256
    block_shingles: int = 1 << 19
    small_ids: int = 100_000
    seed: int = 11


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words than a
    shingle has all its words as one, a text without words none."""
    hashes, begin = word_hashes(buf, offs)
    grams, least = hashes, np.minimum(words, np.diff(begin))
    for k in range(1, words):
        longer, m = np.zeros(len(hashes), U64), max(0, len(hashes) - k)
        longer[:m] = pair(grams[:m], hashes[k:])
        grams = np.where(np.repeat(least, np.diff(begin)) > k, longer, grams)
    for s, e, k in zip(begin[:-1], begin[1:], least, strict=True):
        yield np.unique(grams[s : e - k + 1]) if e > s else grams[:0]


def _multipliers(p: NearDuplicates) -> np.ndarray:
    return np.random.default_rng(p.seed).integers(0, 1 << 63, p.bands * p.rows, dtype=U64) * U64(2) + U64(1)


def _minima(sets: list[np.ndarray], p: NearDuplicates) -> np.ndarray:
    """The upper halves of the smallest products for each multiplier (a row a set)."""
    out = np.full((len(sets), p.bands * p.rows), np.iinfo(np.uint32).max, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        at = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])[:-1]))
        turned = np.empty_like(flat)
        for k, m in enumerate(_multipliers(p)):
            np.multiply(flat, m, out=turned)
            out[full, k] = np.minimum.reduceat(turned, at) >> U64(32)
    return out


def _sign(batches: Iterator[pa.RecordBatch], p: NearDuplicates) -> Iterator[pa.RecordBatch]:
    from hashlib import blake2b

    for batch in batches:
        buf, offs = buffers(batch.column(1))
        for i, j in row_groups(offs, 1 << 18):
            sets = list(shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], p.words))
            low = _minima(sets, p)
            keys = np.zeros((len(sets), p.bands), U64)
            for r in range(p.rows):
                keys = mix(keys * U64(0x9DDFEA08EB382D69) + low[:, r :: p.rows])
            keys = mix(keys + np.arange(p.bands, dtype=U64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.array([len(s) for s in sets], pa.int64()),
                    binary_column([blake2b(s.tobytes(), digest_size=16).digest() for s in sets]),
                    pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                    fixed_rows(low.astype(np.uint8)),
                ],
                names=["doc_id", "n_shingles", "set_key", "bands", "sig"],
            )


def signatures(docs: DataFrame, p: NearDuplicates) -> DataFrame:
    """``doc_id, n_shingles, set_key, bands, sig`` of documents ``doc_id, text``."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        partial(_sign, p=p), "doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary"
    )


def least_matches(p: NearDuplicates) -> list[tuple[int, int]]:
    """After so many minima, the fewest matches with which a pair may go on: the posterior
    Beta(m + 1, n - m + 1) reaches the threshold with a chance P(Bin(n + 1, t) <= m)."""
    t, out = p.percent / 100, []
    for n in range(p.batch, p.bands * p.rows + 1, p.batch):
        chance, m = 0.0, -1
        while chance < p.miss:
            m += 1
            chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def _prune(batches: Iterator[pa.RecordBatch], p: NearDuplicates) -> Iterator[pa.RecordBatch]:
    steps, width = least_matches(p), p.bands * p.rows
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, width) for k in (2, 3))
        alive, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
        for n, least in steps:
            matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
            alive, done = alive[matches[alive] >= least], n
        yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(alive)) for k in (0, 1)], names=["a", "b"])


def _close(own: np.ndarray, other: np.ndarray, p: NearDuplicates) -> bool:
    if 100 * min(len(own), len(other)) < p.percent * max(len(own), len(other)):
        return False
    both = len(np.intersect1d(own, other, assume_unique=True))
    return 100 * both >= p.percent * (len(own) + len(other) - both)


def _group_links(batches: Iterator[pa.RecordBatch], p: NearDuplicates) -> Iterator[pa.RecordBatch]:
    """Rows ``part, block, salt, id, ys, text`` sorted by group, in each the known documents
    (``ys`` null) first: for each other row a link to one of the ``ys`` it asks for. Only
    the sets of a group's known documents are held."""
    group, known = None, {}
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        ids, asked = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        buf, offs = buffers(batch.column(5))
        out = []
        for i, j in row_groups(offs, 1 << 18):
            for k, own in enumerate(shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], p.words), i):
                if keys[k] != group:
                    group, known = keys[k], {}
                if asked[k] is None:
                    known.setdefault(ids[k], []).append(own)
                    continue
                hit = next((y for y in asked[k] if any(_close(own, other, p) for other in known[y])), None)
                if hit is not None:
                    out.append((hit, ids[k]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _few(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast a written table only where its counted rows are within a bound."""
    return F.broadcast(df) if df.count() <= limit else df


def _confirmed(asked: DataFrame, members: DataFrame | None, docs: DataFrame, p: NearDuplicates, ws: Workspace, name: str) -> DataFrame:
    """Links ``u, v`` of ``part, block, x, ys``: whether document ``x`` is close to one of
    the documents ``ys`` by their whole sets. The ys are among the ``members`` (``part,
    block, id``) of the block, ``star`` or so; without members each part is a document.
    Many askers of one block are dealt to several groups, each with its texts once."""
    asked = ws.table(asked, f"{name}-asked")
    if members is None:
        members = asked.select("part", "block", F.col("part").alias("id")).distinct()
    salts = ws.table(asked.groupBy("part", "block").agg(F.ceil(F.count("*") / p.star).alias("n")), f"{name}-salts")
    # most blocks are one group; only the wide ones, where most askers are, need looking up
    wide = salts.where("n > 1").select(F.struct("part", "block").alias("wide"), "n")
    xs = lookup(asked.withColumn("of", F.struct("part", "block")), "of", wide, "wide", wide.count() <= p.small_ids, "left")
    salt = F.pmod(F.xxhash64("x"), F.coalesce("n", F.lit(1).cast("long")))
    xs = xs.select("part", "block", salt.alias("salt"), F.col("x").alias("id"), "ys")
    ys = members.join(salts, ["part", "block"]).select("part", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("salt"), "id", F.lit(None).cast("array<long>").alias("ys"))
    rows = ws.table(ys.union(xs), f"{name}-rows")
    ids = ws.table(rows.select(F.col("id").alias("doc_id")).distinct(), f"{name}-ids")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(_few(ids, p.small_ids), "doc_id", "left_semi")
    # an id may repeat in the input, with one text or several
    texts = texts.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("text").alias("texts"))
    whole = rows.join(texts, "id").select("part", "block", "salt", "id", "ys", F.explode("texts").alias("text"))
    whole = whole.repartition("part", "block", "salt").sortWithinPartitions("part", "block", "salt", F.col("ys").asc_nulls_first())
    return ws.table(whole.mapInArrow(partial(_group_links, p=p), "u long, v long"), f"{name}-links")


def verify(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, p: NearDuplicates, ws: Workspace, name: str) -> DataFrame:
    """The pairs ``(a, b)`` of representatives whose whole shingle sets are close enough."""
    sigs = sigs.select("rep", "sig")
    pairs = ws.table(pairs, f"{name}-pairs")
    turns = ws.table(pairs.groupBy("a").agg(F.ceil(F.count("*") / p.star).alias("n")), f"{name}-turns")
    # the partners of a pivot are dealt to groups, each beside one copy of its signature
    wide = turns.where("n > 1").toDF("wide", "n")
    salt = F.pmod(F.xxhash64("b"), F.coalesce("n", F.lit(1).cast("long")))
    dealt = lookup(pairs, "a", wide, "wide", wide.count() <= p.small_ids, "left").select("a", "b", salt.alias("salt"))
    pivots = turns.join(sigs.toDF("a", "sig_a"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("salt"), "sig_a")
    both = dealt.join(pivots, ["a", "salt"]).join(sigs.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
    close = both.mapInArrow(partial(_prune, p=p), "a long, b long")
    asked = close.select(F.col("a").alias("part"), F.lit(0).cast("long").alias("block"), F.col("b").alias("x"), F.array("a").alias("ys"))
    return _confirmed(asked, None, docs, p, ws, name)


def _near_blocks(table: pa.Table, p: NearDuplicates) -> pa.Table:
    """Of one block of a bucket: for each unlinked member (``far``) and verification block
    those members of other components whose signatures may be close enough."""
    names = ("rep", "part", "vblock", "sig", "bands")
    far = np.array(table.column("far").to_pylist(), bool)
    bucket = table.column("bucket")[0].as_py()

    def side(mask: np.ndarray) -> list[np.ndarray]:
        t = table.filter(pa.array(mask))
        cols = {c: t.column(c).combine_chunks() for c in names}
        sig = np.frombuffer(b"".join(cols["sig"].to_pylist()), np.uint8).reshape(len(t), -1)
        bands = np.array(cols["bands"].to_pylist(), np.int64).reshape(len(t), -1)
        return [cols[c].to_numpy(zero_copy_only=False) for c in names[:3]] + [sig, bands, np.array(t.column("rest").to_pylist(), bool)]

    x_rep, x_part, _, x_sig, x_bands, _ = side(far)
    y_rep, y_part, y_block, y_sig, y_bands, y_rest = side(~far)
    steps, out = least_matches(p), []
    for k in range(len(x_rep) if len(y_rep) else 0):
        # two unlinked members meet once, whichever is smaller asks
        at = np.flatnonzero((y_part != x_part[k]) & (~y_rest | (x_rep[k] < y_rep)))
        matches, done = np.zeros(len(at), np.int64), 0
        for n, least in steps:
            matches += (y_sig[at, done:n] == x_sig[k, done:n]).sum(axis=1)
            at, matches, done = at[matches >= least], matches[matches >= least], n
        # of all buckets that two share, that of the first band counts
        same = y_bands[at] == x_bands[k]
        at = at[x_bands[k][same.argmax(axis=1)] == bucket] if len(at) else at
        for part, block in sorted(set(zip(y_part[at].tolist(), y_block[at].tolist(), strict=True))):
            mine = at[(y_part[at] == part) & (y_block[at] == block)]
            out.append((int(x_rep[k]), part, block, y_rep[mine].tolist()))
    cols = list(zip(*out, strict=True)) or [[]] * 4
    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.table({c: pa.array(v, t) for c, v, t in zip(("x", "part", "block", "ys"), cols, types, strict=True)})


def _far_links(known: DataFrame, linked: DataFrame, docs: DataFrame, p: NearDuplicates, ws: Workspace) -> DataFrame:
    """Links of the members outside their bucket's largest component to members of other
    components: at least one for each pair of a document and a component that has one.
    ``known``: the buckets of several components, ``bucket, rep, part, rest, n_far, n_all``.
    Pairs are formed inside tasks only, between blocks of ``star`` rows at most; a
    component is cut into blocks of ``star`` members or ``block_shingles`` shingles."""

    def near_blocks(table: pa.Table) -> pa.Table:
        return _near_blocks(table, p)

    blocks = lambda n: F.ceil(F.col(n) / p.star)
    members = known.select("rep", "part").distinct().join(linked.select("rep", "n_shingles"), "rep")
    wide = members.groupBy("part").agg(F.greatest(F.ceil(F.count("*") / p.star), F.ceil(F.sum("n_shingles") / p.block_shingles)).alias("cut")).where("cut > 1")
    wide = ws.table(wide, "far-wide")
    narrow = known.join(_few(wide, p.small_ids), "part", "left")
    narrow = narrow.withColumn("vblock", F.when(F.col("cut") > 1, F.pmod(F.xxhash64("rep", F.lit(3)), F.col("cut"))).otherwise(F.lit(0).cast("long")))
    rows = narrow.join(linked.select("rep", "sig", "bands"), "rep")
    near = rows.select("*", F.lit(False).alias("far"), F.pmod(F.xxhash64("rep"), blocks("n_all")).alias("yb"), F.explode(F.sequence(F.lit(0).cast("long"), blocks("n_far") - 1)).alias("xb"))
    far = rows.where("rest").select("*", F.lit(True).alias("far"), F.pmod(F.xxhash64("rep"), blocks("n_far")).alias("xb"), F.explode(F.sequence(F.lit(0).cast("long"), blocks("n_all") - 1)).alias("yb"))
    cols = ["bucket", "rep", "part", "vblock", "sig", "bands", "rest", "far", "xb", "yb"]
    asked = near.select(*cols).union(far.select(*cols)).groupBy("bucket", "xb", "yb").applyInArrow(near_blocks, "x long, part long, block long, ys array<long>")
    asked = asked.groupBy("part", "block", "x").agg(F.array_distinct(F.flatten(F.collect_list("ys"))).alias("ys"))
    members = narrow.select("part", F.col("vblock").alias("block"), F.col("rep").alias("id")).distinct()
    return _confirmed(asked, members, docs, p, ws, "far")


def near_duplicates(spark: SparkSession, docs: DataFrame, p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``doc_id, text``.

    Documents with equal sets form one class with one representative; only classes are
    compared. In each bucket of a band every member meets three pivots: the member that
    shares most buckets with others (the text that copies were made from, if it is there),
    the smallest, and one by hash. Where that leaves several components in a bucket, every
    member outside the largest meets all members of other components: no proposed pair
    between different components stays untested, and groups that have merged cost no
    further pairs.

    Null and empty texts and texts of white space have an empty set, are linked with
    nothing and kept. So are rows without a doc_id, whose component is null. Of rows that
    repeat a doc_id each comes back with that id's component, whatever their texts. Other
    columns are ignored. An empty table gives an empty one.
    """
    ws = Workspace(spark, "near")
    small_arrow(spark)
    signed = ws.table(signatures(docs, p), "signed")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sig")])
    reps = ws.table(reps, "reps")
    members = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    company = members.join(shared, "bucket").groupBy("rep").agg(F.collect_set("bucket").alias("buckets"), F.sum("n").alias("company"))
    linked = ws.table(reps.drop("set_key").join(company, "rep"), "linked")
    rows = linked.select("rep", "company", F.explode("buckets").alias("bucket"))
    pivots = rows.groupBy("bucket").agg(F.array_distinct(F.array(F.max_by("rep", F.struct("company", "rep")), F.min("rep"), F.min_by("rep", F.xxhash64("rep")))).alias("pivots"))
    asked = rows.join(pivots, "bucket").select(F.explode("pivots").alias("a"), F.col("rep").alias("b"), F.array_contains("pivots", F.col("rep")).alias("both"))
    asked = asked.where("a != b AND (NOT both OR a < b)").select("a", "b").distinct()
    links = verify(asked, linked, docs, p, ws, "pivots")
    parts = ws.table(graph.components(links, ws, "parts"), "components")
    known = rows.select("bucket", "rep").join(_few(parts.withColumnRenamed("node", "rep"), p.small_ids), "rep", "left")
    known = ws.table(known.select("bucket", "rep", F.coalesce("component", "rep").alias("part")), "known")
    several = known.groupBy("bucket", "part").agg(F.count("*").alias("n")).groupBy("bucket")
    several = several.agg(F.count("*").alias("parts"), F.max_by("part", F.struct("n", "part")).alias("top"), F.max("n").alias("n_top"), F.sum("n").alias("n_all")).where("parts > 1 AND n_all > 2")
    several = ws.table(several.select("bucket", "top", (F.col("n_all") - F.col("n_top")).alias("n_far"), "n_all"), "several")
    if several.head(1):
        known = known.join(_few(several, p.small_ids), "bucket").select("bucket", "rep", "part", (F.col("part") != F.col("top")).alias("rest"), "n_far", "n_all")
        found = _far_links(ws.table(known, "far-known"), linked, docs, p, ws)
        if found.head(1):
            parts = ws.table(graph.components(parts.toDF("u", "v").union(found), ws, "parts-far"), "components-far")
    groups = reps.select("set_key", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    groups = groups.select("set_key", F.coalesce("component", "rep").alias("component_id"))
    key = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_key"))
    out = signed.select("doc_id", "n_shingles", key.alias("set_key")).join(groups, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


#: The contract of op8 asks for two-word shingles.
OP8 = NearDuplicates(words=2)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents alike by two-word shingles. Nulls, empty and long texts, repeated
    ids, an empty table and further columns: as in ``near_duplicates``."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), OP8)


QUERIES = {"op8_minhash": op8_minhash}
ORACLES = {
    "op8_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
        ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
        AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.id WHERE r.root < e.v),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN c ON c.id = s.doc_id
"""
}
