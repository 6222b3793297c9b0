"""Panels: who is eligible, who is drawn, and what each candidate is compared with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import cohort


def good_quality(records: DataFrame, least: int) -> DataFrame:
    """Records called good, of ``least`` bases or more (``qc_overall, seq_length``)."""
    return records.where((F.col("qc_overall") == "good") & (F.col("seq_length") >= least))


def clade_pools(records: DataFrame, clades: list[str]) -> DataFrame:
    """``clade, n``: how many records each clade's pool has, those without any too."""
    spark = records.sparkSession
    named = spark.createDataFrame([(c,) for c in clades], "clade string")
    n = records.where(F.col("clade").isin(*clades)).groupBy("clade").agg(F.count("*").alias("n"))
    return named.join(n, "clade", "left").fillna(0, ["n"])


def strata_counts(panels: DataFrame) -> DataFrame:
    """``panel, stratum, n``: rows of each panel by ``year_stratum|who_region``."""
    return panels.groupBy("panel", F.concat_ws("|", "year_stratum", "who_region").alias("stratum")).agg(F.count("*").alias("n"))


def composition(panel: DataFrame, by: str) -> DataFrame:
    return panel.groupBy(by).agg(F.count("*").alias("n"))


def redraws(df: DataFrame, strata: list[str], key: str, target: int, seeds: tuple[int, ...] = (1, 2, 3, 4, 5), floor: int = 2, most: int = 6) -> DataFrame:
    """The stratified sample once a seed; ``seed`` is a column."""
    each = [cohort.stratified_sample(df, strata, key, target, floor, most, str(s)).withColumn("seed", F.lit(s)) for s in seeds]
    return reduce(DataFrame.unionByName, each)


def block_integrity(records: DataFrame, members: DataFrame, key: str, place: str, n: int) -> DataFrame:
    """``n_in_block, whole``: how many of the first ``n`` records by ``place`` are members."""
    first = records.where(F.col(place) <= n).select(key, place)
    inside = first.join(members.select(key).distinct().withColumn("inside", F.lit(True)), key, "left")
    return inside.agg(F.count_if(F.col("inside")).alias("n_in_block"), (F.count_if(F.col("inside")) == n).alias("whole"))


def subsets(candidates: DataFrame, panel: DataFrame, control: str, aligned: DataFrame, least: int = 4) -> DataFrame:
    """``candidate, size, reason``: how many different sequences of the alignment a
    candidate's subset has (itself, the panel, the control), and why it is skipped, if it is.
    The panel is counted once, so no candidate is paired with it."""
    have = aligned.select(F.col("accession").alias("a")).distinct()
    others = panel.select(F.col("accession").alias("a")).union(panel.sparkSession.createDataFrame([(control,)], "a string")).distinct().join(have, "a", "left_semi")
    n = F.broadcast(others.agg(F.count("*").alias("others")))  # one row
    out = candidates.select(F.col("accession").alias("candidate")).distinct()
    out = out.join(have.select(F.col("a").alias("candidate"), F.lit(True).alias("found")), "candidate", "left")
    out = out.join(others.select(F.col("a").alias("candidate"), F.lit(1).alias("known")), "candidate", "left").join(n)
    size = F.col("others") + F.when(F.col("found") & F.col("known").isNull(), 1).otherwise(0)
    reason = F.when(F.col("found").isNull(), "missing_from_alignment").when(size < least, F.concat(F.lit("subset_too_small_"), size.cast("string")))
    return out.select("candidate", size.alias("size"), reason.alias("reason"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, side``: whether each distinct key is in ``both``, only in ``a`` or only in ``b``."""
    left, right = (x.select(key).where(F.col(key).isNotNull()).distinct() for x in (a, b))
    both = left.withColumn("l", F.lit(1)).join(right.withColumn("r", F.lit(1)), key, "full")
    return both.select(key, F.when(F.col("l").isNull(), "b").when(F.col("r").isNull(), "a").otherwise("both").alias("side"))


def lineage_clusters(records: DataFrame, missing: str = "Ib-global") -> DataFrame:
    """One cluster a lineage; records without one share ``missing``."""
    return records.select("accession", F.coalesce("lineage", F.lit(missing)).alias("cluster_id"))


def both_detectors(first: Column, second: Column) -> Column:
    """Whether both call; no call is a call of none."""
    return F.coalesce(first, F.lit(False)) & F.coalesce(second, F.lit(False))
