"""Orders over whole tables without a task that holds all rows: ranges and their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.workspace import Workspace

#: Rows a range, about.
RANGE_ROWS = 250_000


def ranged(df: DataFrame, group: list[str], order: list[Column], amount: Column | None = None) -> DataFrame:
    """``df`` with its range in ``__range`` (by group, then order; equal rows share one), the
    sum of ``amount`` (rows, if none) over the group's rows in earlier ranges in ``__before``,
    and over those in its own in ``__here``. Rows are written once, so that ranges stay as
    they are; the window has a row a range and group. Groups are not null."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    dealt = df.repartitionByRange(parts, *[F.col(g) for g in group], *order).withColumn("__range", F.spark_partition_id())
    ws = Workspace(spark, "ranges")
    dealt = ws.table(dealt, "rows")
    sums = dealt.groupBy(*group, "__range").agg(F.sum(F.lit(1) if amount is None else amount).alias("__here"))
    w = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sums = ws.table(sums.withColumn("__before", F.coalesce(F.sum("__here").over(w), F.lit(0))), "sums")
    # a row a range and group in it: many small groups are more than a broadcast should hold
    return dealt.join(F.broadcast(sums) if sums.count() <= RANGE_ROWS else sums, [*group, "__range"])


def first_rows(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows a group. Only the range in which a group is cut is sorted."""
    all_ = ranged(df, group, order)
    whole = F.col("__before") + F.col("__here") <= n
    cut = all_.where(~whole & (F.col("__before") < n))
    cut = cut.withColumn("__k", F.row_number().over(W.partitionBy(*group, "__range").orderBy(*order))).where(F.col("__before") + F.col("__k") <= n)
    return all_.where(whole).select(*df.columns).unionAll(cut.select(*df.columns))
