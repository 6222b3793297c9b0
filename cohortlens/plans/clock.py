"""Queries of fits by profiles and of drawn counts, over users as genomes: the events of each,
and half a change more a day, so that the best date lies before all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import dating
from cohortlens.plans.catalog import _COUNTS_SQL, _NLL, _SAT, counts, query, r6

_DAYS_SQL = f"""{_COUNTS_SQL.replace("c AS", "c0 AS", 1)}, c AS (SELECT g, day, k + floor((day - 738880) / 2) AS k FROM c0), d AS (SELECT g, day, count(*)::DOUBLE AS n, sum(k) AS k FROM c GROUP BY 1, 2)"""


def ageing(spark: SparkSession, sf: str) -> DataFrame:
    return counts(spark, sf).withColumn("k", F.col("k") + F.floor((F.col("day") - 738880) / 2))


def _profile_sql(name: str, dates: str) -> str:
    """The best rate of the saturation model at each ``g, t0`` of ``dates``, by scoring steps."""
    return f"""{name}_s AS (SELECT x.g, x.t0, 0 AS i, ln(greatest(sum(k) / (23140 * sum(n * (day - x.t0))), 1e-12)) AS th FROM {dates} x JOIN d ON x.g = d.g GROUP BY 1, 2 HAVING min(day) > x.t0
  UNION ALL SELECT g, t0, i + 1, least(0, greatest(ln(1e-12), any_value(th) + least(2, greatest(-2, sum((k / mu - n) * turn) / sum(n * turn * turn / mu))))) FROM (
   SELECT s.*, n, k, 23140 * (1 - exp(-exp(th) * (day - t0))) AS mu, 23140 * exp(th) * (day - t0) * exp(-exp(th) * (day - t0)) AS turn FROM {name}_s s JOIN d ON s.g = d.g WHERE i < 25) GROUP BY g, t0, i),
 {name} AS (SELECT g, t0, any_value(exp(th)) AS rate, sum(n * mu - k * ln(mu)) AS nll FROM (SELECT s.*, n, k, 23140 * (1 - exp(-exp(th) * (day - t0))) AS mu FROM {name}_s s JOIN d ON s.g = d.g WHERE i = 25) GROUP BY 1, 2),
 {name}_b AS (SELECT g, t0, rate, nll FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY nll, t0) AS nth FROM {name}) WHERE nth = 1)"""


def _around_sql(name: str, best: str, step: float) -> str:
    return f"{name} AS (SELECT g, t0 + j * ({step!r}) AS t0 FROM {best}, range(-10, 11) r(j) WHERE t0 + j * ({step!r}) BETWEEN 738400 AND 738880)"


@query(f"""WITH RECURSIVE {_DAYS_SQL}, t AS (SELECT g, (738600 + 5 * i)::DOUBLE AS t0 FROM (SELECT DISTINCT g FROM d), range(41) r(i)), {_profile_sql("f", "t")}
 SELECT g, t0, round(log10(rate), 6) AS log_rate, round(nll, 4) AS nll FROM f""")
def ml_rate_profile(spark, sf):
    """The saturation model's best rate at 41 dates."""
    out = dating.rate_profile(ageing(spark, sf), [738600.0 + 5 * i for i in range(41)], 23140.0, "saturation", "g")
    return out.select("g", "t0", r6(F.log10("rate"), "log_rate"), F.round("nll", 4).alias("nll"))


@query(f"""WITH RECURSIVE {_DAYS_SQL}, p AS (SELECT 738400 + i * (480.0::DOUBLE / 199) AS t0, exp(ln(1e-7) + j * (ln(1e5) / 199)) AS rate FROM range(200) a(i), range(200) b(j)),
 l AS (SELECT g, t0, rate, {_NLL.format(mu=_SAT)} AS nll FROM c, p GROUP BY 1, 2, 3), co AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY nll, t0, rate) AS nth FROM l) WHERE nth = 1),
 t AS (SELECT g, 738400 + i * (480.0::DOUBLE / 199) AS t0 FROM (SELECT DISTINCT g FROM d), range(200) r(i)), {_profile_sql("f", "t")}, {_around_sql("u", "f_b", 480.0 / 199 / 10)}, {_profile_sql("h", "u")},
 {_around_sql("v", "h_b", 480.0 / 199 / 100)}, {_profile_sql("z", "v")}
 SELECT co.g, round(z_b.t0, 2) AS t0, round(log10(z_b.rate), 4) AS log_rate, round(z_b.nll, 3) AS nll, round(co.t0, 2) AS grid_t0, round(co.nll, 3) AS grid_nll FROM co LEFT JOIN z_b ON co.g = z_b.g""")
def ml_polished_fit(spark, sf):
    """A grid of 200 x 200, and its best point polished."""
    out = dating.polished_fit(ageing(spark, sf), 738400.0, 738880.0, 23140.0, "saturation", "g")
    return out.select("g", F.round("t0", 2).alias("t0"), F.round(F.log10("rate"), 4).alias("log_rate"), F.round("nll", 3).alias("nll"), F.round("grid_t0", 2).alias("grid_t0"), F.round("grid_nll", 3).alias("grid_nll"))


@query(f"""WITH {_DAYS_SQL}, fit AS (SELECT g, sum(k) / (23140 * sum(n * (day - 738600))) AS rate FROM d GROUP BY 1),
 m AS (SELECT d.g, day, n, CAST(rep AS INTEGER) AS replicate, n * (23140.0::DOUBLE * rate * (day - 738600)) AS mu, CAST('0x' || substr(md5('42:' || rep || ':' || d.g || ':' || CAST(CAST(day AS DECIMAL(20, 3)) AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
   FROM d JOIN fit ON d.g = fit.g, range(1, 51) r(rep)),
 a AS (SELECT *, floor(mu) + CASE WHEN o % 2 = 1 THEN (o + 1) // 2 ELSE -(o // 2) END AS x, o FROM (SELECT *, unnest(range(0, 60 + 24 * CAST(ceil(sqrt(mu)) AS BIGINT))) AS o FROM m)),
 cu AS (SELECT *, sum(exp(x * ln(mu) - mu - lgamma(x + 1))) OVER (PARTITION BY g, day, replicate ORDER BY o) AS cum FROM a WHERE x >= 0)
 SELECT g, replicate, day, n, CAST(arg_min(x, o) AS BIGINT) AS k FROM cu WHERE u < cum GROUP BY 1, 2, 3, 4""")
def smp_poisson(spark, sf):
    """Fifty replicates of every day's count, around the linear model at one date."""
    rows = ageing(spark, sf)
    fits = dating.rate_profile(rows, [738600.0], 23140.0, "linear", "g")
    return dating.poisson_replicates(rows, fits, 23140.0, 50, "linear", "g").select("g", "replicate", "day", "n", "k")
