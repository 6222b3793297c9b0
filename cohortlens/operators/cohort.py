"""Cohorts: stratified and uniform samples that a hash decides, clusters of a tree."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.operators.ranges import first_rows
from cohortlens.workspace import Workspace


def draw(seed: Column | str, key: str) -> Column:
    """A reproducible order: the MD5 of seed and key."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    return F.md5(F.concat_ws(":", seed.cast("string"), F.col(key).cast("string")))


def first_in_group(df: DataFrame, group: list[str], order: list[Column], n: int, place: str = "k") -> DataFrame:
    """The first ``n`` rows a group, with their place in a column of that name. A filter on the place lets
    Spark cut groups down before they are shuffled, so a large group is no large task."""
    return df.withColumn(place, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(place) <= n)


def stratified_sample(df: DataFrame, strata: list[str], key: str, total: int, least: int, most: int, seed: str = "42", named: bool = False) -> DataFrame:
    """At most ``total`` rows: first up to ``least`` a stratum, then one a stratum and round
    up to ``most``, strata in hashed order; ``allocation_pass`` 1 or 2. Rows of an
    ``unknown`` or null stratum are left out. Where the first pass alone exceeds ``total``
    its rows are taken in hashed order. ``named``: the passes as ``pass1_min`` and
    ``pass2_fill``, or ``pass1_capped`` for all rows where the first pass exceeds ``total``.

    Only the candidates, ``most`` a stratum, are ever sorted; the cut to ``total`` is a
    limit, not a window over all."""
    for s in strata:
        df = df.where(F.col(s).isNotNull() & (F.col(s).cast("string") != "unknown"))
    stratum = F.concat_ws("|", *[F.col(s).cast("string") for s in strata])
    some = df.withColumns({"__stratum": stratum, "__draw": draw(seed, key)})
    some = first_in_group(some, ["__stratum"], [F.col("__draw"), F.col(key)], most, "__k")
    first = F.col("__k") <= least
    some = some.withColumns({"__turn": F.when(first, 0).otherwise(F.col("__k")), "__place": F.when(first, F.col("__draw")).otherwise(draw(seed, "__stratum"))})
    out = some.orderBy("__turn", "__place", "__k", key).limit(total)
    turn = F.when(F.col("__k") <= least, 1).otherwise(2)
    if named:
        capped = F.lit(some.where(first).count() > total)
        turn = F.when(capped, "pass1_capped").when(turn == 1, "pass1_min").otherwise("pass2_fill")
    return out.select(*df.columns, turn.alias("allocation_pass"))


def subsamples(df: DataFrame, key: str, share: float, replicates: int, seed: int = 42) -> DataFrame:
    """``replicate`` and the rows of it: a uniform sample without replacement of
    ``round(n * share)`` rows (half to even) for each of several seeds."""
    n = df.count()
    each = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    each = each.withColumn("__draw", draw(F.col("replicate") + seed, key))
    return first_rows(each, ["replicate"], [F.col("__draw"), F.col(key)], round(n * share)).drop("__draw")


def without_latest(df: DataFrame, date: str, key: str, share: float) -> DataFrame:
    """All but the last ``round(n * share)`` rows by date; ties by key, null dates last."""
    n = df.count()
    return first_rows(df, [], [F.col(date).asc_nulls_last(), F.col(key)], n - round(n * share))


def matched_random(candidates: DataFrame, taken: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` candidates that are not taken, by hash: a control of the same size."""
    return candidates.join(taken.select(key).distinct(), key, "left_anti").orderBy(draw(seed, key), key).limit(n)


def jaccard(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    both = a.select(key).distinct().withColumn("in_a", F.lit(1)).join(b.select(key).distinct().withColumn("in_b", F.lit(1)), key, "full")
    inner, full = F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()), F.count("*")
    return both.agg(inner.alias("shared"), full.alias("either"), F.when(full > 0, inner / full).alias("jaccard"))


#: The chance that a Poisson count of mean 1 is at most 0, 1, 2 and so on.
POISSON_ONE = [*accumulate(math.exp(-1) / math.factorial(k) for k in range(13))]


def jaccard_interval(a: DataFrame, b: DataFrame, key: str, least: float = 0.8, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """``jaccard``, percentiles 2.5 and 97.5 (``low, high``) of its bootstrap over the keys of
    either side, and ``similar``: at ``least`` so much. A replicate counts each key a Poisson
    number of times, told by the MD5 of seed, replicate and key; sums of a replicate are made
    before the shuffle, whose rows do not grow with the keys. Null keys are left out; without
    any key all four are null."""
    sides = [x.select(key).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True)) for x, name in ((a, "__a"), (b, "__b"))]
    both = sides[0].join(sides[1], key, "full").select(key, (F.col("__a") & F.col("__b")).alias("__shared"))
    spark = both.sparkSession
    both = both.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)  # few keys, many draws
    each = both.select("__shared", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("__replicate"), key)
    told = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__replicate").cast("string"), F.col(key).cast("string")))
    count = F.when(F.col("__replicate") == 0, 1)
    for k, c in enumerate(math.ceil(c * 2**32) for c in POISSON_ONE):
        if c < 2**32:
            count = count.when(F.col("__told") < f"{c:08x}", k)
            top = k + 1
    each = each.withColumn("__told", F.substring(told, 1, 8)).withColumn("__n", count.otherwise(top))
    shared, full = F.sum(F.when(F.col("__shared"), F.col("__n")).otherwise(0)), F.sum("__n")
    sums = each.groupBy("__replicate").agg(F.when(full > 0, shared / full).alias("__j"))
    found, drawn = F.max(F.when(F.col("__replicate") == 0, F.col("__j"))), F.when(F.col("__replicate") > 0, F.col("__j"))
    at = lambda q: F.percentile(drawn, F.lit(q))
    return sums.agg(found.alias("jaccard"), at(0.025).alias("low"), at(0.975).alias("high"), (found >= least).alias("similar"))


def marked_children(df: DataFrame, children: DataFrame, key: str = "accession") -> DataFrame:
    return df.join(children.select(key).distinct().withColumn("is_child", F.lit(True)), key, "left").withColumn("is_child", F.coalesce("is_child", F.lit(False)))


def children_first(df: DataFrame, children: DataFrame, key: str = "accession", order: str = "ord") -> DataFrame:
    """Children, then the others, each in file order."""
    return marked_children(df, children, key).orderBy(F.desc("is_child"), order)


def restricted(df: DataFrame, clade: str, prefix: str, excluded: DataFrame, key: str) -> DataFrame:
    """The rows of a clade (by prefix) whose key is not among the excluded ones; null keys stay."""
    return df.where(F.coalesce(F.col(clade), F.lit("")).startswith(prefix)).join(excluded.select(key).dropna().distinct(), key, "left_anti")


def drop_exactly_one(df: DataFrame, key: str, value: str) -> DataFrame:
    n = df.where(F.col(key) == value).count()
    if n != 1:
        raise ValueError(f"{n} records of {value}, not one")
    return df.where(F.col(key) != value)


#: Joins of a tree with itself: a broadcast of its tables at each of the many steps would pass
#: them all through the driver, as Spark broadcasts whatever is small on disk.
BOTH_SORTED = "merge"


def ancestors(edges: DataFrame) -> DataFrame:
    """``id, label, ancestor, depth, dist`` for every node of ``id, parent, label, dist`` and
    each of its ancestors (itself at 0), which are many for a deep tree: what asks for less
    climbs by ``jumps``. Pointers double: after k steps a node knows its first 2^k ancestors,
    so a tree of any depth takes the logarithm of it."""
    ws = Workspace(edges.sparkSession, "tree")
    nodes = edges.select("id", "parent", "label", F.col("dist").cast("double").alias("dist"))
    known = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"), F.lit(0.0).alias("dist"))
    jump = ws.table(nodes.where("parent IS NOT NULL").select("id", F.col("parent").alias("to"), "dist"), "jump-0")
    step = 0
    while jump.head(1):
        far = jump.toDF("id", "to", "more").join(known.toDF("to", "ancestor", "depth", "dist").hint(BOTH_SORTED), "to")
        known = ws.table(known.unionByName(far.select("id", "ancestor", (F.col("depth") + (1 << step)).alias("depth"), (F.col("dist") + F.col("more")).alias("dist"))), f"known-{step}")
        step += 1
        jump = ws.table(jump.join(jump.toDF("to", "further", "more").hint(BOTH_SORTED), "to").select("id", F.col("further").alias("to"), (F.col("dist") + F.col("more")).alias("dist")), f"jump-{step}")
    return known.join(nodes.select("id", "label").hint(BOTH_SORTED), "id").select("id", "label", "ancestor", "depth", "dist")


def jumps(edges: DataFrame, ws: Workspace) -> list[DataFrame]:
    """Jump pointers: written tables ``id, to, dist, most`` of each node's ancestor 1, 2, 4, ...
    steps up, the length of the path and the largest length on the way. A table for each
    power of two within the depth, so n log(depth) rows for n nodes, a chain's too."""
    dist = F.coalesce(F.col("dist").cast("double"), F.lit(0.0))
    jump = edges.where("parent IS NOT NULL").select("id", F.col("parent").alias("to"), dist.alias("dist"), dist.alias("most"))
    out = []
    while True:
        jump = ws.table(jump, f"jump-{len(out)}")
        if not jump.head(1):
            return out
        out.append(jump)
        on = jump.toDF("to", "further", "more", "peak").hint(BOTH_SORTED)
        most = F.greatest("most", F.col("dist") + F.col("peak"))
        jump = jump.join(on, "to").select("id", F.col("further").alias("to"), (F.col("dist") + F.col("more")).alias("dist"), most.alias("most"))


def subtree_sums(edges: DataFrame, values: DataFrame, names: list[str], ws: Workspace) -> DataFrame:
    """``id`` and for each of ``names`` the sum of it over the node and all below: ``values``
    has a row for some of the nodes. After k steps a node has the sums of those less than
    2^k below it, and those 2^k below hand it theirs: n rows a step, added before the
    shuffle, so neither a chain nor a node with very many children grows."""
    sums = edges.select("id").join(values.hint(BOTH_SORTED), "id", "left").select("id", *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in names])
    sums = ws.table(sums, "sums-0")
    jump = ws.table(edges.where("parent IS NOT NULL").select("id", F.col("parent").alias("to")), "up-0")
    step = 0
    while jump.head(1):
        step += 1
        handed = jump.join(sums.hint(BOTH_SORTED), "id").groupBy(F.col("to").alias("id")).agg(*[F.sum(n).alias(f"more_{n}") for n in names])
        sums = sums.join(handed.hint(BOTH_SORTED), "id", "left").select("id", *[(F.col(n) + F.coalesce(f"more_{n}", F.lit(0))).alias(n) for n in names])
        sums = ws.table(sums, f"sums-{step}")
        jump = ws.table(jump.join(jump.toDF("to", "further").hint(BOTH_SORTED), "to").select("id", F.col("further").alias("to")), f"up-{step}")
    return sums


def lowest_common(edges: DataFrame, tips: DataFrame) -> DataFrame:
    """``id, label, n_tips``: one row, the deepest node above all leaves whose label is in
    ``tips`` (``label``; those of no leaf are passed over), and the label of it or, if it has
    none, of its nearest ancestor that has one (null if none has). No row without tips."""
    ws = Workspace(edges.sparkSession, "mrca")
    wanted = edges.where("is_leaf").join(tips.select("label").distinct().hint(BOTH_SORTED), "label", "left_semi").select("id", F.lit(1).alias("tips"))
    values = edges.select("id", F.lit(1).alias("size")).join(wanted.hint(BOTH_SORTED), "id", "left")
    sums = subtree_sums(edges, values, ["tips", "size"], ws)
    # those above all tips are the path from the root down to the one sought; sizes fall on it
    path = sums.where("tips > 0").join(F.broadcast(sums.agg(F.max("tips").alias("tips"))), "tips").join(edges.select("id", "label").hint(BOTH_SORTED), "id")
    named = F.when(F.col("label") != "", F.col("label"))
    out = path.agg(F.min_by("id", "size").alias("id"), F.min_by(named, F.when(named.isNotNull(), F.col("size"))).alias("label"), F.max("tips").alias("n_tips"))
    return out.where("id IS NOT NULL")


def common_ancestor(edges: DataFrame, tips: list[str]) -> str | None:
    """The label of ``lowest_common``; fewer than two tips in the tree are an error."""
    found = lowest_common(edges, edges.sparkSession.createDataFrame([(t,) for t in tips], "label string")).first()
    if found is None or found.n_tips < 2:
        raise ValueError("fewer than two of the tips are in the tree")
    return found.label


def prune(edges: DataFrame, tips: DataFrame) -> DataFrame:
    """``id, parent, label, dist, is_leaf`` of the tree with no other leaves than those whose
    ``label`` is in ``tips``. Nodes left with one child go and hand their length to it; the
    root stays, with one child or none if the others lose all tips. Labels that no leaf has
    are passed over. Work is a row a node for each doubling of the depth."""
    ws = Workspace(edges.sparkSession, "pruned")
    dist = F.col("dist").cast("double")
    kept = ws.table(edges.where("is_leaf").join(tips.select("label").distinct().hint(BOTH_SORTED), "label", "left_semi").select("id", F.lit(1).alias("tips")), "kept")
    live = subtree_sums(edges, kept, ["tips"], ws).where("tips > 0").select("id")
    live = ws.table(edges.join(live.hint(BOTH_SORTED), "id", "left_semi").select("id", "parent", dist.alias("dist")), "live")
    forks = live.groupBy("parent").agg(F.count("*").alias("n")).where("n > 1 AND parent IS NOT NULL")
    nodes = forks.select(F.col("parent").alias("id")).unionByName(kept.select("id")).unionByName(edges.where("parent IS NULL").select("id"))
    nodes = ws.table(nodes.distinct().withColumn("stays", F.lit(True)), "nodes")
    # each live node's way up to the next node that stays: ways double until all have got there
    way = live.where("parent IS NOT NULL").join(nodes.toDF("parent", "there").hint(BOTH_SORTED), "parent", "left")
    way = ws.table(way.select("id", F.col("parent").alias("to"), "dist", F.coalesce("there", F.lit(False)).alias("there")), "way-0")
    step = 0
    while way.where("NOT there").head(1):
        step += 1
        on = way.toDF("to", "further", "more", "arrives").hint(BOTH_SORTED)
        longer = way.where("NOT there").join(on, "to").select("id", F.col("further").alias("to"), (F.col("dist") + F.col("more")).alias("dist"), F.col("arrives").alias("there"))
        way = ws.table(way.where("there").unionByName(longer), f"way-{step}")
    own = edges.select("id", "label", dist.alias("own")).join(nodes.hint(BOTH_SORTED), "id", "left_semi").join(way.select("id", F.col("to").alias("parent"), "dist").hint(BOTH_SORTED), "id", "left")
    own = own.join(kept.select("id", F.lit(True).alias("is_leaf")).hint(BOTH_SORTED), "id", "left")
    return own.select("id", "parent", "label", F.coalesce("dist", "own").alias("dist"), F.coalesce("is_leaf", F.lit(False)).alias("is_leaf"))


def tree_clusters(edges: DataFrame, threshold: float) -> DataFrame:
    """``label, cluster``: each leaf with the node that it reaches by going up as long as the
    path from it stays shorter than the threshold; the root is the last it can reach. An
    unlabelled node is ``node_<id>``. Leaves climb by jump pointers, the largest first."""
    ws = Workspace(edges.sparkSession, "clusters")
    at = ws.table(edges.where("is_leaf").select("id", "label", F.col("id").alias("at"), F.lit(0.0).alias("gone")), "start")
    for k, jump in reversed(list(enumerate(jumps(edges, ws)))):
        far = at.join(jump.toDF("at", "to", "dist", "most").hint(BOTH_SORTED), "at", "left")
        go = F.col("to").isNotNull() & (F.col("gone") + F.col("most") < threshold)
        far = far.select("id", "label", F.when(go, F.col("to")).otherwise(F.col("at")).alias("at"), F.when(go, F.col("gone") + F.col("dist")).otherwise(F.col("gone")).alias("gone"))
        at = ws.table(far, f"climbed-{k}")
    name = F.when(F.col("label") != "", F.col("label")).otherwise(F.concat(F.lit("node_"), F.col("id").cast("string")))
    return at.select("label", "at").join(edges.select(F.col("id").alias("at"), name.alias("cluster")).hint(BOTH_SORTED), "at").select("label", "cluster")
