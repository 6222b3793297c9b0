"""Quality control: every record gets the list of reasons that exclude it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import scalars as S


@dataclass(frozen=True)
class Limits:
    min_length: int = 190_000
    max_n: float = 0.05
    max_other: float = 0.01
    resolution: str = "month"
    organisms: tuple[str, ...] = ("monkeypox", "mpxv")
    check_qc: bool = True
    check_frameshift: bool = True
    missing_clade: str = "clade_excluded:nan"


def clade_allowed(clade: Column) -> Column:
    return (clade.startswith("I") & ~clade.startswith("II")) | clade.contains("/") | clade.isin("IIb", "II")


def reasons(p: Limits) -> Column:
    """The ordered reasons of a row of ``organism, clade, seq_length, n_fraction,
    non_acgtn_fraction, collection_date, qc, frameshift_qc``; an empty list passes. A null
    clade is excluded as ``missing_clade``; an empty text as clade or organism passes."""
    col, three = F.col, S.fixed3
    organism = F.lower("organism")
    known = F.lit(False)
    for word in p.organisms:
        known = known | organism.contains(word)
    length = F.when(col("seq_length").isNull(), "no_sequence_found").when(col("seq_length") < p.min_length, F.concat(F.lit(f"length_lt_{p.min_length}:"), col("seq_length").cast("long").cast("string")))
    seen = S.date_resolution(col("collection_date"))
    found = [
        F.when((organism != "") & ~known, F.concat(F.lit("organism_not_mpxv:"), col("organism").substr(1, 30))),
        F.when(col("clade").isNull(), F.lit(p.missing_clade)).when((col("clade") != "") & ~clade_allowed(col("clade")), F.concat(F.lit("clade_excluded:"), "clade")),
        length,
        F.when(col("n_fraction") > p.max_n, F.concat(F.lit(f"n_fraction_gt_{p.max_n}:"), three(col("n_fraction")))),
        F.when(col("non_acgtn_fraction") > p.max_other, F.concat(F.lit(f"non_acgtn_gt_{p.max_other}:"), three(col("non_acgtn_fraction")))),
        F.when(~S.resolution_passes(seen, p.resolution), F.concat(F.lit("date_resolution_"), seen, F.lit(f"_lt_{p.resolution}"))),
    ]
    if p.check_qc:
        found.append(F.when(S.is_bad(col("qc")), "nextclade_qc_bad"))
    if p.check_frameshift:
        found.append(F.when(S.is_bad(col("frameshift_qc")), "frameshift_qc_bad"))
    return F.array_compact(F.array(*found))


def with_reasons(df: DataFrame, p: Limits = Limits()) -> DataFrame:
    df = df.withColumn("exclusion_reasons", reasons(p))
    return df.withColumn("passes", F.size("exclusion_reasons") == 0)


def serialised(df: DataFrame) -> DataFrame:
    return df.withColumn("exclusion_reasons", F.array_join("exclusion_reasons", "|"))


def tally(df: DataFrame) -> DataFrame:
    """How often each reason excludes, whatever its details."""
    # an inner explode would have Spark filter by the list's size, working it out once more
    each = df.select(F.explode_outer("exclusion_reasons").alias("reason")).where("reason IS NOT NULL")
    return each.groupBy(F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))


def clade_tally(df: DataFrame) -> DataFrame:
    """Survivors a clade, counted without a filter, which would work out the reasons again."""
    n = df.groupBy(F.coalesce("clade", F.lit("unassigned")).alias("clade")).agg(F.count_if(F.col("passes")).alias("n"))
    return n.where("n > 0")


def dated_share(df: DataFrame) -> DataFrame:
    """Survivors with a month or better, and whether there are 30 survivors at all."""
    dated = S.resolution_passes(S.date_resolution(F.col("collection_date")), "month")
    return df.agg(F.count_if(F.col("passes")).alias("passed"), F.avg(F.when(F.col("passes"), dated.cast("double"))).alias("share_dated")).withColumn("enough", F.col("passed") >= 30)


def summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("input_rows"), F.count_if(F.col("passes")).alias("passed"), F.count_if(~F.col("passes")).alias("excluded"))


def eligible_clusters(members: DataFrame, least: int = 10, months: int = 6) -> DataFrame:
    """A row a cluster: size, first and last date, span; eligible by size and by months of
    30 days. Under two dates there is no span (0)."""
    dates = F.count("d")
    agg = members.withColumn("d", S.parse_loose(F.col("collection_date"))).groupBy("cluster_id").agg(
        F.count("*").alias("n_genomes"), F.when(dates >= 2, F.min("d")).alias("earliest"), F.when(dates >= 2, F.max("d")).alias("latest"),
        F.when(dates >= 2, F.datediff(F.max("d"), F.min("d"))).otherwise(0).alias("span_days"),
    )
    return agg.withColumn("eligible", (F.col("n_genomes") >= least) & (F.col("span_days") >= months * 30))
