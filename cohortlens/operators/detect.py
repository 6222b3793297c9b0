"""Results of several detectors: smallest p values, votes, sweeps, donors, consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def min_p(records: DataFrame) -> DataFrame:
    """The smallest corrected p of each child."""
    return records.groupBy("child").agg(F.min("p").alias("min_p"))


def best_pair(records: DataFrame) -> DataFrame:
    """The parents at each child's smallest p; of equal ones the first."""
    return records.where("p IS NOT NULL").groupBy("child").agg(F.min_by(F.struct("p_name", "q_name", "p"), F.struct("p", "ord")).alias("x")).select("child", "x.p_name", "x.q_name", "x.p")


def most_common(df: DataFrame, value: str, first: str, n: int = 10) -> DataFrame:
    """The ``n`` commonest values; of equally common ones that seen first."""
    return df.groupBy(value).agg(F.count("*").alias("n"), F.min(first).alias("first")).orderBy(F.desc("n"), "first").limit(n).select(value, "n")


def donor(p_is_a: Column, q_is_a: Column, p_name: Column, q_name: Column) -> Column:
    """The parent outside group A; both outside: both, marked; P inside: Q, whatever it is."""
    return F.when(p_is_a, q_name).when(q_is_a, p_name).otherwise(F.concat(p_name, F.lit("|"), q_name, F.lit("(neither-Ia)")))


def votes(*p_values: Column, alpha: float = 0.05) -> Column:
    """How many p values are below alpha; null is no vote."""
    out = F.lit(0)
    for p in p_values:
        out = out + F.coalesce((p < alpha).cast("int"), F.lit(0))
    return out


def threshold_sweep(records: DataFrame, control: str, alpha: float = 0.05, scales: tuple[float, ...] = (0.5, 1.0, 2.0)) -> DataFrame:
    """Children below alpha at each scale, and whether the control is one."""
    each = records.select("child", "p", F.explode(F.array(*[F.lit(alpha * s) for s in scales])).alias("threshold"))
    hit = F.col("p") < F.col("threshold")
    return each.groupBy("threshold").agg(F.countDistinct(F.when(hit, F.col("child"))).alias("n_candidates"), F.coalesce(F.bool_or(hit & (F.col("child") == control)), F.lit(False)).alias("control_in_set"))


def agreement_sweep(calls: DataFrame, control: str, k: tuple[int, ...] = (1, 2, 3), columns: tuple[str, ...] = ("phi_perm_p", "nss_p", "maxchi_p")) -> DataFrame:
    """Candidates with at least k significant statistics, for each k."""
    each = calls.select("accession", votes(*[F.col(c) for c in columns]).alias("v"), F.explode(F.array(*[F.lit(x) for x in k])).alias("k"))
    hit = F.col("v") >= F.col("k")
    return each.groupBy("k").agg(F.count_if(hit).alias("n_candidates"), F.coalesce(F.bool_or(hit & (F.col("accession") == control)), F.lit(False)).alias("control_in_set"))


def segment_sweep(breakpoints: DataFrame, threshold: float, scales: list[float], control: str) -> DataFrame:
    """``scale, n_candidates, n_breakpoints, control``: how many candidates of ``accession,
    delta, baseline`` keep a breakpoint, and how many there are, if one counts where its gain
    reaches the scaled threshold; whether the control is among them. Files without a baseline
    count nothing; a scale at which nothing counts has zeros."""
    each = breakpoints.withColumn("scale", F.explode(F.array(*[F.lit(float(x)) for x in scales])))
    kept = F.col("baseline").isNotNull() & (F.col("delta") >= F.col("scale") * threshold)
    by = each.groupBy("scale", "accession").agg(F.count_if(kept).alias("n"))
    found = by.groupBy("scale").agg(F.count_if(F.col("n") > 0).alias("n_candidates"), F.sum("n").alias("n_breakpoints"), F.bool_or((F.col("n") > 0) & (F.col("accession") == control)).alias("control"))
    every = breakpoints.sparkSession.createDataFrame([(float(x),) for x in scales], "scale double")
    out = every.join(found, "scale", "left")
    zero = F.lit(0).cast("long")
    return out.select("scale", F.coalesce("n_candidates", zero).alias("n_candidates"), F.coalesce("n_breakpoints", zero).alias("n_breakpoints"), F.coalesce("control", F.lit(False)).alias("control"))


def flagged_by_condition(records: DataFrame, condition: str) -> DataFrame:
    return records.where("p IS NOT NULL").groupBy(condition).agg(F.countDistinct("child").alias("flagged"))


def per_child_table(records: DataFrame, condition: str, conditions: list[str]) -> DataFrame:
    """A row a child, its smallest p in each condition."""
    return records.groupBy("child").pivot(condition, conditions).agg(F.min("p"))


def consensus(calls: DataFrame, least: int = 2) -> DataFrame:
    """``accession, n_detectors, candidate`` of calls ``accession, detector``."""
    return calls.groupBy("accession").agg(F.countDistinct("detector").alias("n_detectors")).withColumn("candidate", F.col("n_detectors") >= least)


def discordance(ladder: DataFrame) -> DataFrame:
    """Levels at which the first detector calls and the second does not: the largest level,
    what is left at it, and how many there are."""
    odd = ladder.where("threeseq_flag AND NOT phipack_call")
    return odd.agg(F.count("*").alias("n"), F.max("retain_frac").alias("max_retain"), F.max_by("retained_nongap_bp", "retain_frac").alias("bp_at_max"))


def breakpoint_summary(calls: DataFrame, low: int, high: int) -> DataFrame:
    """Median breakpoint of each accession over its detectors, and its distance to an interval."""
    out = calls.groupBy("accession").agg(F.count("*").alias("n"), F.percentile("breakpoint", F.lit(0.5)).alias("median_bp"))
    far = F.when(F.col("median_bp") < low, low - F.col("median_bp")).when(F.col("median_bp") > high, F.col("median_bp") - high).otherwise(0.0)
    return out.withColumns({"inside": F.col("median_bp").between(low, high), "distance": far})


def hypotheses(calls: DataFrame, control: str, total: int) -> DataFrame:
    """Of ``consensus`` rows: how many candidates there are besides the control, with a
    Wilson interval of their share of ``total``; H3 (any) and H4 (the control is one)."""
    from cohortlens.operators import stats

    agg = calls.agg(F.count_if(F.col("candidate") & (F.col("accession") != control)).alias("k"), F.coalesce(F.bool_or(F.col("candidate") & (F.col("accession") == control)), F.lit(False)).alias("h4"))
    low, high = stats.wilson(F.col("k"), F.lit(float(total)))
    return agg.select("k", low.alias("low"), high.alias("high"), (F.col("k") >= 1).alias("h3"), "h4")
