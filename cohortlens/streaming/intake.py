"""An extension: quality control of records as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import qc


def screened(stream: DataFrame, p: qc.Limits = qc.Limits()) -> DataFrame:
    """Reasons and verdict of each arriving record; stateless, so batch and stream agree."""
    return qc.with_reasons(stream, p)


def reason_counts(stream: DataFrame, time: str, window: str = "1 day", late: str = "1 day", p: qc.Limits = qc.Limits()) -> DataFrame:
    """How often each reason excludes in each window of time; later records than ``late``
    behind the latest are dropped."""
    each = qc.with_reasons(stream.withWatermark(time, late), p).select(time, F.explode("exclusion_reasons").alias("reason"))
    return each.groupBy(F.window(time, window), F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))
