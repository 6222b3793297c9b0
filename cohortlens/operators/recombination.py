"""Recombination found in the alignment itself: walks of triplets, refined incompatibility."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import bases, compatibility, walks
from cohortlens.operators.sequence import column_counts
from cohortlens.workspace import Workspace

#: Bytes of sequences of one side that a task holds at once.
BLOCK = 16 << 20
_HELD = 1 << 22  # steps of walks at once
_PARTS = 32  # that an alignment is dealt to


def _codes(seqs) -> np.ndarray:
    """A row a sequence: codes of its bases in upper case, 4 or more where unknown or past its end."""
    raw = [np.frombuffer((s or "").upper().encode("ascii", "replace"), np.uint8) for s in seqs]
    out = np.full((len(raw), max(map(len, raw), default=0)), 4, np.uint8)
    for row, s in zip(out, raw, strict=True):
        row[: len(s)] = bases._TABLE[s]
    return out


def _scan(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of children against one pair of blocks of parents."""
    children, left, right = (pdf[pdf["side"] == s].sort_values("id") for s in (0, 1, 2))
    within = len(pdf) > 0 and pdf["i"].iloc[0] == pdf["j"].iloc[0]  # both parents from one block
    right = left if within else right
    names = [list(x["name"]) for x in (left, right)]
    wide = _codes([*children["seq"], *left["seq"], *right["seq"]])
    own, a, b = wide[: len(children)], wide[len(children) : len(children) + len(left)], wide[len(children) + len(left) :]
    out = []
    for ident, name, child in zip(children["id"], children["name"], own, strict=True):
        # columns that tell some parent from another by the child
        like_a, like_b = (x == child for x in (a, b))
        some = (child < 4) & (like_a.any(0) | like_b.any(0)) & (((a < 4) & ~like_a).any(0) | ((b < 4) & ~like_b).any(0))
        at = np.flatnonzero(some)
        la, lb, ka, kb = like_a[:, at].astype(np.int8), like_b[:, at].astype(np.int8), a[:, at] < 4, b[:, at] < 4
        slab = max(1, _HELD // max(1, len(at)))
        tested, where, n_tests = [], [], 0
        for p in range(len(left)):
            if names[0][p] == name:
                continue
            for start in range(p + 1 if within else 0, len(right), slab):
                rows = slice(start, start + slab)
                known = ka[p] & kb[rows]
                ups, downs, fall, rise = walks.descents(np.where(known, la[p] - lb[rows], 0).astype(np.int8))
                for q, m, n, d, u in zip(range(start, len(right)), ups.tolist(), downs.tolist(), fall.tolist(), rise.tolist(), strict=False):
                    if names[1][q] == name or names[1][q] == names[0][p]:
                        continue
                    n_tests += 2
                    tested += [(m, n, d, (names[0][p], names[1][q])), (n, m, u, (names[1][q], names[0][p]))]
                    where += [(p, q, 1), (p, q, -1)]
        if not tested:
            continue
        chance, best = walks.best_of(tested)
        m, n, k, (p_name, q_name) = tested[best]
        p, q, sign = where[best]
        steps = np.where(ka[p] & kb[q], la[p] - lb[q], 0) * sign
        walk = np.flatnonzero(steps)
        first, last = walks.segment(steps[walk]) if k else (None, None)
        places = (None, None) if first is None else (int(at[walk[first]]) + 1, int(at[walk[last]]) + 1)
        out.append((ident, name, n_tests, p_name, q_name, m, n, k, *places, chance, walks.rank_of(chance)))
    table = pd.DataFrame(out, columns=["id", "child", "n_triplets", "p_name", "q_name", "m", "n", "k", "from_pos", "to_pos", "p", "rank"])
    return table.astype({"from_pos": "Int32", "to_pos": "Int32"})


_SCANNED = "id long, child string, n_triplets long, p_name string, q_name string, m int, n int, k int, from_pos int, to_pos int, p double, rank double"


def triplet_scan(children: DataFrame, parents: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row a child of ``name, seq``: the pair of ``parents`` (same columns, same alignment)
    that it most likely is a mosaic of.

    A column is informative for parents P and Q if all three bases are known and the child has
    one parent's base; the walk goes up (``m`` times) where it is P's, down (``n``) where it
    is Q's. ``k`` is the greatest descent: the stretch ``from_pos`` to ``to_pos`` (columns from
    1; null without a descent) that looks like Q. ``p`` is the exact chance of such a descent
    if steps came in random order, ``p_corrected`` is 1 - (1 - p)^N for the N triplets of the
    whole scan (``n_triplets``: the child's). Smallest p, compared by its common logarithm to
    nine decimals; of equal ones the first names.

    Every ordered pair of parents of different names, neither the child's, is tested. Null
    names are left out; null sequences and columns past an end are unknown; case is ignored;
    repeated children have a row each; a child without a triplet has none. Children meet parents in blocks of
    ``block`` bytes, dealt by row number; a task holds three blocks, and sends a row a child."""
    spark = children.sparkSession
    ws = Workspace(spark, "triplets")

    def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int, int]:
        named = df.where("name IS NOT NULL").select(F.col("name").cast("string").alias("name"), F.coalesce(F.col("seq").cast("string"), F.lit("")).alias("seq"))
        out = ws.table(named.withColumn("id", F.monotonically_increasing_id()), name)
        rows, longest = out.agg(F.count("*"), F.coalesce(F.max(F.length("seq")), F.lit(0))).first()
        return out, rows, rows * (longest + 64)  # rows are padded to the longest

    kids, n_kids, kid_bytes = numbered(children, "children")
    folk, _, folk_bytes = numbered(parents, "parents")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a small table of children is spread too, as far as that copies 256 MB of parents
    n_kids = max(1, -(-kid_bytes // block), min(n_kids, tasks, 1 + (256 << 20) // max(1, folk_bytes)))
    n_blocks = max(1, -(-folk_bytes // block))

    def dealt(parts: int):
        return F.pmod(F.xxhash64("id"), F.lit(parts))

    every_kid, every_block = F.sequence(F.lit(0), F.lit(n_kids - 1)), F.sequence(F.lit(0), F.lit(n_blocks - 1))
    mine = F.col("blk").cast("int")
    # pairs of blocks are i <= j; a parent is on the left where its block is i, else on the right
    pairs = F.filter(F.flatten(F.transform(every_block, lambda i: F.transform(every_block, lambda j: F.struct(i.alias("i"), j.alias("j"))))), lambda x: x["i"] <= x["j"])
    ours = F.transform(every_block, lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    kid_rows = kids.select(dealt(n_kids).cast("int").alias("kid"), F.explode(pairs).alias("at"), F.lit(0).alias("side"), "id", "name", "seq")
    folk_rows = folk.withColumn("blk", dealt(n_blocks)).select(F.explode(every_kid).alias("kid"), "*").select("kid", F.explode(ours).alias("at"), "blk", "id", "name", "seq")
    folk_rows = folk_rows.select("kid", "at", F.when(F.col("at.i") == mine, 1).otherwise(2).alias("side"), "id", "name", "seq")
    # a block of children and a pair of blocks of parents
    met = kid_rows.unionByName(folk_rows).select("kid", "at.i", "at.j", "side", "id", "name", "seq")
    met = met.repartition(max(tasks, min(n_kids * n_blocks * (n_blocks + 1) // 2, 8 * tasks)), "kid", "i", "j")  # by number: few bytes are much work here
    found = ws.table(met.groupBy("kid", "i", "j").applyInPandas(_scan, _SCANNED), "found")
    best = F.min_by(F.struct("child", "p_name", "q_name", "m", "n", "k", "from_pos", "to_pos", "p"), F.struct("rank", "p_name", "q_name")).alias("x")
    each = found.groupBy("id").agg(F.sum("n_triplets").alias("n_triplets"), best)
    total = found.agg(F.sum("n_triplets").alias("__all"))
    out = each.join(F.broadcast(total))  # one row
    corrected = F.when(F.col("x.p") >= 1, F.lit(1.0)).otherwise(-F.expm1(F.col("__all") * F.log1p(-F.col("x.p"))))
    return out.select("x.child", "n_triplets", "x.p_name", "x.q_name", "x.m", "x.n", "x.k", "x.from_pos", "x.to_pos", "x.p", corrected.alias("p_corrected"))


def phi_test(alignments: DataFrame, group: str = "candidate", window: int = 100, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """``n_sites, near, phi, phi_mean, phi_perm_p`` of each alignment (``group``, ``seq``).

    Informative sites have two bases or more that two sequences or more have. Two sites'
    incompatibility is the least number of changes beyond those that one tree needs: edges
    less vertices plus components of the graph of pairs of bases. ``phi`` is its mean over
    sites at most ``near`` informative sites apart, as many as ``window`` columns hold on
    average (1 at least). Recombination makes near sites more compatible than far ones, so
    ``phi_perm_p`` is the share of ``replicates`` orders of the sites, by MD5, whose mean is no
    larger; the alignment's own order counts as one more. Fewer than two sites: nulls.

    Null groups are left out; null sequences and columns past an end are unknown, as is
    whatever is not A, C, G or T; case is ignored; repeated rows count. No task holds an
    alignment: sequences become sets of pairs of bases in tiles of sites, united as they
    stream by; each tile adds to the sum of every order. Sites of an alignment (its columns
    at most) are an array, joined to its sequences and tiles in 32 parts."""
    ws = Workspace(alignments.sparkSession, "compatibility")
    rows = alignments.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("grp"), F.upper(F.col("seq").cast("string")).alias("seq"))
    counts = column_counts(rows, "grp")
    many = sum((F.col(b) > 1).cast("int") for b in "acgt")
    sites = counts.groupBy("grp").agg(F.max("pos").alias("length"), F.sort_array(F.collect_list(F.when(many >= 2, F.col("pos")))).alias("sites"))
    n = F.size("sites")
    near = F.least(n - 1, F.greatest(F.lit(1), F.floor(F.lit(window) * n / F.col("length")))).cast("int")
    sites = ws.table(sites.select("grp", n.alias("n_sites"), near.alias("near"), "sites"), "sites")

    parts = F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))).alias("part")
    open_ = sites.where("n_sites > 1").select("grp", parts, "sites", "near")
    # which pairs of bases occur does not depend on how often, so equal sequences are one
    dealt = rows.dropDuplicates(["grp", "seq"]).withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(_PARTS)).cast("int"))
    joined = dealt.join(open_, ["grp", "part"]).select("grp", "seq", "sites")
    tiles = joined.mapInArrow(compatibility.meet, "grp string, i int, j int, bits binary").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    tiles = ws.table(tiles.mapInArrow(compatibility.unite, "grp string, i int, j int, score binary"), "tiles")
    dealt = tiles.withColumn("part", F.pmod(F.xxhash64("i", "j"), F.lit(_PARTS)).cast("int"))
    ready = dealt.join(open_, ["grp", "part"]).repartition(int(alignments.sparkSession.conf.get("spark.sql.shuffle.partitions")), "grp", "part").select("grp", "i", "j", "score", "sites", "near").sortWithinPartitions("grp")
    totals = ready.mapInArrow(partial(compatibility.windows, replicates=replicates, seed=seed), "grp string, replicate int, total long")
    totals = totals.groupBy("grp", "replicate").agg(F.sum("total").alias("total"))
    own = totals.where("replicate = 0").select("grp", F.col("total").alias("own"))
    told = totals.join(own, "grp").groupBy("grp").agg(F.max("own").alias("own"), F.avg(F.when(F.col("replicate") > 0, F.col("total"))).alias("mean"), F.count_if(F.col("total") <= F.col("own")).alias("low"))
    pairs = F.col("near") * F.col("n_sites") - F.col("near") * (F.col("near") + 1) / 2
    out = rows.select("grp").distinct().join(sites.drop("sites"), "grp", "left").join(told, "grp", "left")
    return out.select(
        F.col("grp").alias(group), F.coalesce("n_sites", F.lit(0)).alias("n_sites"), F.when(F.col("n_sites") > 1, F.col("near")).alias("near"),
        (F.col("own") / pairs).alias("phi"), (F.col("mean") / pairs).alias("phi_mean"), (F.col("low") / (replicates + 1)).alias("phi_perm_p"),
    )
