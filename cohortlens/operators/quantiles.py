"""Exact quantiles by selection: values are counted in ranges, and only the ranges that hold
a wanted place are looked into. No task holds a group, however large it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.workspace import Workspace

#: A range with so many rows at most is sorted in one task.
SORTED_ROWS = 100_000
#: Parts that a larger range is cut into.
PARTS = 1024
#: Lists of ranges are broadcast up to so many.
SMALL = 100_000
_LARGEST = 1.7976931348623157e308


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def _within(values: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The values of each of the ranges ``lo``, ``hi`` of their group, ends included."""
    held = F.broadcast(ranges) if ranges.count() <= SMALL else ranges
    on = _same(values, ranges, keys) & values["__v"].between(ranges["lo"], ranges["hi"])
    return values.join(held, on).select(*[ranges[k] for k in keys], "lo", "hi", "__v")


def _part(turn: int) -> Column:
    """The part of its range that a value is in: even widths, in every other turn widths that
    grow, so that values of many magnitudes part too. Both never fall as values rise."""
    # halved, as the difference of two values may be no double
    share = (F.col("__v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    share = share if turn % 2 == 0 else F.log1p(share * 1e15) / F.log1p(F.lit(1e15))
    return F.least(F.lit(PARTS - 1), F.floor(share * PARTS).cast("int"))


def quantiles(df: DataFrame, value: str, groups: list[str], shares: dict[str, float]) -> DataFrame:
    """A row a group: its columns, ``__n`` values, and for each name in ``shares`` the quantile
    (linear between two values). Null and NaN values are left out, infinite ones count as the
    largest double; a null group is a group; one without values has no row.

    Each wanted place starts with the range of its whole group. A range of over SORTED_ROWS
    rows is cut into parts whose rows, smallest and largest value are counted (before the
    shuffle, so a hot group costs a row a part and task) and gives way to the part that
    holds the place, until ranges are small or of one value; the small ones are sorted."""
    ws = Workspace(df.sparkSession, "quantiles")
    keys = [f"__g{k}" for k in range(len(groups))] or ["__g"]
    kept = [F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)] if groups else [F.lit(0).alias("__g")]
    v = F.col(value).cast("double")
    values = ws.table(df.where(v.isNotNull() & ~F.isnan(v)).select(*kept, F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), v)).alias("__v")), "values")
    sizes = ws.table(values.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")), "sizes")
    at = [F.lit(p) * (F.col("__n") - 1) for p in shares.values()]
    places = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in at])))
    state = sizes.select(*keys, F.explode(places).alias("place"), F.lit(0).cast("long").alias("before"), "lo", "hi", F.col("__n").alias("rows"))
    turn = 0
    while True:
        state = ws.table(state, f"state-{turn}")
        large = (F.col("rows") > SORTED_ROWS) & (F.col("lo") < F.col("hi"))
        wide = state.where(large)
        if not wide.head(1):
            break
        parts = _within(values, wide.select(*keys, "lo", "hi").distinct(), keys).groupBy(*keys, "lo", "hi", _part(turn).alias("part"))
        parts = parts.agg(F.count("*").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"))
        w = W.partitionBy(*keys, "lo", "hi").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        parts = parts.withColumn("earlier", F.coalesce(F.sum("n").over(w), F.lit(0)))
        s, p = wide.alias("s"), parts.alias("p")
        offset = F.col("s.place") - F.col("s.before") - F.col("p.earlier")
        on = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"p.{k}")) for k in [*keys, "lo", "hi"]]) & (offset >= 0) & (offset < F.col("p.n"))
        narrowed = s.join(p, on).select(*[f"s.{k}" for k in keys], "s.place", (F.col("s.before") + F.col("p.earlier")).alias("before"), F.col("p.least").alias("lo"), F.col("p.most").alias("hi"), F.col("p.n").alias("rows"))
        state = state.where(~large).unionByName(narrowed)
        turn += 1
    open_ = state.where("lo < hi")
    counted = _within(values, open_.select(*keys, "lo", "hi").distinct(), keys).groupBy(*keys, "lo", "hi", "__v").agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys, "lo", "hi").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    counted = counted.withColumn("upto", F.sum("n").over(w))
    s, c = open_.alias("s"), counted.alias("c")
    offset = F.col("s.place") - F.col("s.before")
    on = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "lo", "hi"]]) & (offset < F.col("c.upto")) & (offset >= F.col("c.upto") - F.col("c.n"))
    found = s.join(c, on).select(*[f"s.{k}" for k in keys], "s.place", F.col("c.__v").alias("found"))
    found = found.unionAll(state.where("lo = hi").select(*keys, "place", F.col("lo").alias("found")))
    by_place = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("place", "found"))).alias("found"))  # two places a share
    told = sizes.alias("s").join(by_place.alias("f"), reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]))
    out = []
    for name, x in zip(shares, at, strict=True):
        low, high = F.col("f.found")[F.floor(x)], F.col("f.found")[F.ceil(x)]
        part = x - F.floor(x)
        out.append(F.when(low == high, low).otherwise(low * (1 - part) + high * part).alias(name))
    return told.select(*[F.col(f"s.{k}").alias(g) for g, k in zip(groups, keys, strict=False)], "__n", *out)
