"""Dating by a Poisson model of counts: grids and profiles in SQL, replicates as groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import draws
from cohortlens.operators.quantiles import quantiles


def saturation_mean(sites: float, rate: Column, age: Column) -> Column:
    return sites * (1 - F.exp(-rate * F.greatest(age, F.lit(0.0))))


def linear_mean(sites: float, rate: Column, age: Column) -> Column:
    return sites * rate * F.greatest(age, F.lit(0.0))


def twofold_mean(sites: float, rate: Column, age: Column) -> Column:
    """Saturation with hits back to the first state: three quarters of the sites at most."""
    return sites * 0.75 * (1 - F.exp(-rate * 4 / 3 * F.greatest(age, F.lit(0.0))))


MEANS = {"saturation": saturation_mean, "linear": linear_mean, "twofold": twofold_mean}


def nll(k: Column, mu: Column, age: Column, n: Column) -> Column:
    """Aggregate: the negative log likelihood of all genomes (``n`` alike a row). If any age
    is below 0: a penalty that grows with the sum of such ages; else if any mean is not
    positive: a flat one."""
    young = F.sum(n * F.greatest(-age, F.lit(0.0)))
    part = F.when((age >= 0) & (mu > 0), n * (k * F.ln(mu) - mu))
    return F.when(F.min(age) < 0, 1e18 + young * 1e6).when(F.min(mu) <= 0, 1e18).otherwise(-F.sum(part))


def grid(spark, t0_low: float, t0_high: float, n_t0: int, rate_low: float, rate_high: float, n_rate: int) -> DataFrame:
    """``t0, rate``: even steps of dates, even steps of log rates; a fixed number of rows."""
    t = spark.range(n_t0).select((F.lit(t0_low) + F.col("id") * ((t0_high - t0_low) / max(1, n_t0 - 1))).alias("t0"))
    r = spark.range(n_rate).select(F.exp(F.lit(np.log(rate_low)) + F.col("id") * (np.log(rate_high / rate_low) / max(1, n_rate - 1))).alias("rate"))
    return t.join(F.broadcast(r))


def likelihoods(counts: DataFrame, points: DataFrame, sites: float, model: str = "saturation", *groups: str) -> DataFrame:
    """``t0, rate, nll`` a group: every point against the group's rows (``day, k``). Rows of
    one day and count are summed first, so the work follows the distinct ones."""
    some = counts.groupBy(*groups, "day", "k").agg(F.count("*").alias("__n"))
    both = some.join(F.broadcast(points))  # the grid has a fixed size
    age = F.col("day") - F.col("t0")
    mean = MEANS[model](sites, F.col("rate"), age)
    return both.groupBy(*groups, "t0", "rate").agg(nll(F.col("k"), mean, age, F.col("__n")).alias("nll"))


def best_fit(likely: DataFrame, *groups: str) -> DataFrame:
    return likely.groupBy(*groups).agg(F.min_by(F.struct("t0", "rate", "nll"), F.struct("nll", "t0", "rate")).alias("x")).select(*groups, "x.t0", "x.rate", "x.nll")


def ridge(likely: DataFrame, *groups: str) -> DataFrame:
    """The best rate at each date, and how much worse it is than the best of all."""
    out = likely.groupBy(*groups, "t0").agg(F.min_by(F.struct("rate", "nll"), F.struct("nll", "rate")).alias("x")).select(*groups, "t0", "x.rate", "x.nll")
    least = out.groupBy(*groups).agg(F.min("nll").alias("__least"))
    out = out.join(least, list(groups)) if groups else out.join(F.broadcast(least))
    return out.withColumn("delta_nll", F.col("nll") - F.col("__least")).drop("__least")


def linear_profile(counts: DataFrame, dates: DataFrame, sites: float, *groups: str) -> DataFrame:
    """The linear model's best rate at each ``t0`` in closed form, and its likelihood. Dates
    that leave a row without a positive age are left out."""
    some = counts.groupBy(*groups, "day", "k").agg(F.count("*").alias("__n"))
    both = some.join(F.broadcast(dates)).withColumn("age", F.col("day") - F.col("t0"))
    n = F.col("__n")
    sums = both.groupBy(*groups, "t0").agg(F.min("age").alias("youngest"), F.sum(n * F.col("k")).alias("sk"), F.sum(n * F.col("age")).alias("sa"), F.sum(n * F.col("k") * F.ln(F.when(F.col("age") > 0, F.col("age")))).alias("skl")).where("youngest > 0")
    rate = F.col("sk") / (sites * F.col("sa"))
    least = -(F.col("sk") * F.ln(F.lit(float(sites)) * rate) + F.coalesce("skl", F.lit(0.0)) - F.col("sk"))
    return sums.select(*groups, "t0", rate.alias("rate"), least.alias("nll"))


def profile_summary(profile: DataFrame, *groups: str, least_range: float = 2.0) -> DataFrame:
    spread = F.max("nll") - F.min("nll")
    return profile.groupBy(*groups).agg(spread.alias("ll_range"), (spread < least_range).alias("poorly_identified"), F.min_by("t0", "nll").alias("t0"))


def by_day(counts: DataFrame, *groups: str) -> DataFrame:
    """A row a day and group: how many rows (``n``) and their sum (``k``). The likelihood of
    either model, and the sum of Poisson draws of one mean, depend on no more than these; so
    what a task holds follows the calendar, not the table."""
    return counts.groupBy(*groups, "day").agg(F.count("*").cast("double").alias("n"), F.sum("k").cast("double").alias("k"))


def _days() -> Column:
    return F.sort_array(F.collect_list(F.struct(F.col("day").cast("double").alias("day"), "n", "k"))).alias("days")


def _arrays(days) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.array([float("nan") if x[c] is None else x[c] for x in days]) for c in ("day", "n", "k"))


#: A model's highest mean as a share of the sites, and how much faster than the rate it gets there.
SHAPES = {"saturation": (1.0, 1.0), "twofold": (0.75, 4 / 3)}
_LOG_RATES = (float(np.log(1e-12)), 0.0)


def rate_at(days: Column, t0: Column, sites: float, model: str = "saturation", steps: int = 25) -> Column:
    """``rate, nll`` of the best rate at a date, for ``days`` (an array of ``day, n, k``): the
    linear model's in closed form, from which other models take scoring steps in the
    logarithm, at most 2 each, within 1e-12 to 1. Null where a day is not after the date."""

    def total(of) -> Column:
        return F.aggregate(days, F.lit(0.0), lambda s, x: s + of(x, x["day"] - t0))

    first = F.ln(F.greatest(total(lambda x, a: x["k"]) / (sites * total(lambda x, a: x["n"] * a)), F.lit(1e-12)))
    if model == "linear":
        theta, mean = first, lambda x, a, th: sites * F.exp(th) * a
    else:
        cap, pace = SHAPES[model]

        def mean(x, a, th):
            return -sites * cap * F.expm1(-pace * F.exp(th) * a)

        def step(th: Column, _: Column) -> Column:
            def add(s: Column, x: Column) -> Column:
                ra = pace * F.exp(th) * (x["day"] - t0)
                mu, turn = -sites * cap * F.expm1(-ra), sites * cap * ra * F.exp(-ra)
                return F.struct((s["g"] + (x["k"] / mu - x["n"]) * turn).alias("g"), (s["h"] + x["n"] * turn * turn / mu).alias("h"))

            move = F.aggregate(days, F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("h")), add, lambda s: F.when(s["h"] > 0, s["g"] / s["h"]).otherwise(0.0))
            return F.least(F.lit(_LOG_RATES[1]), F.greatest(F.lit(_LOG_RATES[0]), th + F.least(F.lit(2.0), F.greatest(F.lit(-2.0), move))))

        theta = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step)

    def told(th: Column) -> Column:
        least = F.aggregate(days, F.lit(0.0), lambda s, x: s + x["n"] * mean(x, x["day"] - t0, th) - x["k"] * F.ln(mean(x, x["day"] - t0, th)))
        return F.struct(F.exp(th).alias("rate"), least.alias("nll"))

    found = F.get(F.transform(F.array(theta), told), F.lit(0))
    return F.when(F.array_min(F.transform(days, lambda x: x["day"])) > t0, found)


def _dated(counts: DataFrame, *groups: str) -> DataFrame:
    """An array of days a group, as long as the calendar at most; rows without a day or count are left out."""
    return by_day(counts.where("day IS NOT NULL AND k IS NOT NULL"), *groups).groupBy(*groups).agg(_days())


def rate_profile(counts: DataFrame, dates: list[float], sites: float, model: str = "saturation", *groups: str) -> DataFrame:
    """``t0, rate, nll`` a group and date with the best rate there (``rate_at``), where every
    row is younger than the date. Equal to ``linear_profile`` for the linear model. A group's
    dates are spread over the cluster, each with the group's days."""
    each = _dated(counts, *groups).withColumn("t0", F.explode(F.array(*[F.lit(float(t)) for t in dates]))).where(F.array_min(F.transform("days", lambda x: x["day"])) > F.col("t0"))
    each = each.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *groups, "t0")
    return each.select(*groups, "t0", F.inline(F.array(rate_at(F.col("days"), F.col("t0"), sites, model))))


def polished_fit(counts: DataFrame, low: float, high: float, sites: float, model: str = "saturation", *groups: str, n: int = 200, rates: tuple[float, float] = (1e-7, 1e-2), rounds: int = 2) -> DataFrame:
    """``t0, rate, nll`` a group, with ``grid_t0, grid_nll``, the best of an n x n grid of dates
    and rates. The polish takes the best rate (``rate_at``) at each of the grid's dates, as a
    grid's steps of rates hide how dates compare, and then, ``rounds`` times, at 21 dates from
    one step before the best date to one after it, within ``low`` to ``high``; each round's
    step is a tenth of the last's. Of equal likelihoods the earlier date. Null where no date
    of the grid is before all rows; the grid's likelihood is a penalty there."""
    known, step = counts.where("day IS NOT NULL AND k IS NOT NULL"), (high - low) / max(1, n - 1)
    points = grid(counts.sparkSession, low, high, n, *rates, n)
    coarse = best_fit(likelihoods(known, points, sites, model, *groups), *groups).select(*groups, F.col("t0").alias("grid_t0"), F.col("nll").alias("grid_nll"))
    on = list(groups) or ["__one"]  # without groups, rows of one
    one = [] if groups else [F.lit(1).alias("__one")]
    fine = best_fit(rate_profile(known, [low + i * step for i in range(n)], sites, model, *groups), *groups)
    out = coarse.select("*", *one).join(_dated(known, *groups).select("*", *one), on).join(fine.select("*", *one), on, "left")
    for r in range(1, rounds + 1):
        offsets = F.array(*[F.lit(i * step / 10.0**r) for i in range(-10, 11)])
        around = F.filter(F.transform(offsets, lambda o: F.col("t0") + o), lambda t: t.between(low, high))
        tried = F.transform(around, lambda t: F.struct(t.alias("t0"), rate_at(F.col("days"), t, sites, model).alias("x")))
        able = F.transform(F.filter(tried, lambda y: y["x"].isNotNull()), lambda y: F.struct(y["x"]["nll"].alias("nll"), y["t0"].alias("t0"), y["x"]["rate"].alias("rate")))
        out = out.select(*groups, "days", "grid_t0", "grid_nll", F.inline_outer(F.array(F.array_min(able))))
    return out.select(*groups, "t0", "rate", "nll", "grid_t0", "grid_nll")


def poisson_replicates(counts: DataFrame, fits: DataFrame, sites: float, replicates: int, model: str = "saturation", *groups: str, seed: int = 42) -> DataFrame:
    """``replicate, day, n, k`` a group, day and replicate: counts drawn around a fit (``t0,
    rate`` a group) as columns, so that a draw is the same wherever it is made. ``k`` is a
    day's sum over its ``n`` rows, whose distribution is Poisson too; its point is the MD5 of
    seed, replicate, groups and day."""
    days = by_day(counts.where("day IS NOT NULL AND k IS NOT NULL"), *groups)
    both = days.drop("k").join(fits.select(*groups, "t0", "rate"), list(groups)) if groups else days.drop("k").join(F.broadcast(fits.select("t0", "rate")))
    each = both.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    mean = F.col("n") * MEANS[model](sites, F.col("rate"), F.col("day") - F.col("t0"))
    u = draws.uniform(F.lit(seed), F.col("replicate"), *[F.col(g) for g in groups], F.col("day").cast("decimal(20,3)"))
    return each.select(*groups, "replicate", "day", "n", draws.poisson(mean, u).alias("k"))


def _fit(day: np.ndarray, n: np.ndarray, k: np.ndarray, sites: float, saturated: bool, low: float, high: float, starts: np.ndarray | None = None) -> tuple[float, float, float]:
    """Best (t0, rate, nll) for ``n`` genomes with ``k`` changes a day: a dense search over t0, the best rate at each by bisection of the
    score (saturation) or in closed form (linear), then golden sections around the best."""

    def at(t0: float) -> tuple[float, float]:
        a = day - t0
        if a.min() <= 0 or k.sum() == 0:
            return 1e-10, 1e18
        if not saturated:
            rate = k.sum() / (sites * (n * a).sum())
            return rate, float(-(k * np.log(sites * rate * a) - n * sites * rate * a).sum())
        lo, hi = 1e-12, 1.0
        for _ in range(80):
            mid = np.sqrt(lo * hi)
            e = np.exp(-mid * a)
            lo, hi = (mid, hi) if (k * a * e / np.maximum(1 - e, 1e-300)).sum() > sites * (n * a * e).sum() else (lo, mid)
        mu = sites * -np.expm1(-lo * a)
        return lo, float(-(k * np.log(mu) - n * mu).sum())

    grid_ = np.linspace(low, high, 60) if starts is None else starts
    best = min(grid_, key=lambda t: at(t)[1])
    step = (high - low) / 59 if len(grid_) > 1 else 365.0
    lo, hi = max(low, best - step), min(high, best + step)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, y) if at(x)[1] <= at(y)[1] else (x, hi)
    t0 = min((best, (lo + hi) / 2), key=lambda t: at(t)[1])
    return t0, *at(t0)


#: Bounds of the rate in joint fits of date and rate.
RATES = (1e-10, 1e-3)


def _climb(day: np.ndarray, n: np.ndarray, k: np.ndarray, sites: float, saturated: bool, low: float, t0: float, rate: float) -> tuple[float, float, float, bool]:
    """Where a local search in date and rate from one start ends: (t0, rate, nll, converged).
    Damped scoring steps in (t0, log rate) within ``low`` to the day before the first and
    RATES; converged if the slope is below a thousandth of a standard error's."""
    lows, highs = np.array([low, np.log(RATES[0])]), np.array([day.min() - 1, np.log(RATES[1])])

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        a, r = day - x[0], np.exp(x[1])
        mu = sites * (-np.expm1(-r * a) if saturated else r * a)
        turn = np.exp(-r * a) if saturated else np.ones_like(a)
        return float((n * mu - k * np.log(mu)).sum()), mu, sites * r * np.array([-turn, a * turn])

    x, damp = np.clip([t0, np.log(rate)], lows, highs), 1e-3
    f, mu, d = at(x)
    for _ in range(300):
        g, h = d @ (n - k / mu), (d * (n / mu)) @ d.T
        free = ~((x <= lows) & (g > 0) | (x >= highs) & (g < 0))
        if not (np.abs(g) > 1e-3 * np.sqrt(np.diag(h)))[free].any():
            return float(x[0]), float(np.exp(x[1])), f, bool(np.isfinite(f))
        while damp < 1e12:
            damped = h + np.diag(np.diag(h)) * damp
            y = x.copy()
            y[free] -= np.linalg.solve(damped[np.ix_(free, free)], g[free])
            y = np.clip(y, lows, highs)
            then = at(y)
            if then[0] < f:
                x, (f, mu, d), damp = y, then, max(damp / 10, 1e-12)
                break
            damp *= 10
        else:
            break
    return float(x[0]), float(np.exp(x[1])), f, False


def multi_start(counts: DataFrame, sites: float, low: float, model: str = "saturation", group: str = "cluster_id", starts: int = 25) -> DataFrame:
    """A row a group and start: the start's date and rate, where the joint search from it
    ends, and whether it converged. Starts are a square of even dates and even log rates."""
    kind, side = dict(counts.dtypes)[group], int(np.ceil(np.sqrt(starts)))
    rows = by_day(counts.where("day IS NOT NULL AND k IS NOT NULL"), group).groupBy(group).agg(_days())
    each = rows.select(group, "days", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start_idx"))

    def climb(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                day, n, k = _arrays(r.days)
                i, j = divmod(r.start_idx, side)
                t0 = low + (day.min() - 1 - low) * i / max(1, side - 1)
                rate = 1e-9 * 1e5 ** (j / max(1, side - 1))
                out.append((getattr(r, group), r.start_idx, t0, rate, *_climb(day, n, k, sites, model == "saturation", low, t0, rate)))
            yield pd.DataFrame(out, columns=[group, "start_idx", "t0_init", "rate_init", "t0", "rate", "nll", "converged"])

    schema = f"{group} {kind}, start_idx int, t0_init double, rate_init double, t0 double, rate double, nll double, converged boolean"
    return each.repartition(F.col(group), F.col("start_idx")).mapInPandas(climb, schema)


def trajectory_table(ends: DataFrame, *groups: str) -> DataFrame:
    """The ends of ``multi_start`` as a table: of each start its ordinal, year and rate, of its
    end the ordinal, date, year, rate, likelihood, whether it converged, and the basin that
    the end's year is in (``non-converged`` without an end)."""
    from cohortlens.functions import scalars as S

    end = F.when(~F.isnan("t0"), F.col("t0"))
    year = S.year_of_ordinal(end)
    return ends.select(
        *groups, "start_idx", F.floor("t0_init").cast("int").alias("t0_init_ordinal"), F.col("rate_init").alias("lam_init"), S.year_of_ordinal(F.col("t0_init")).alias("t0_init_year"),
        F.floor(end).cast("int").alias("t0_converged_ordinal"), F.coalesce(S.from_ordinal(end).cast("string"), F.lit("non-converged")).alias("t0_converged_date"), F.col("rate").alias("lam_converged"),
        year.alias("t0_converged_year"), F.col("nll").alias("final_nll"), F.col("converged").alias("converged_status"), S.basin(year).alias("basin"),
    )


def joint_fit(ends: DataFrame, group: str = "cluster_id") -> DataFrame:
    """The lowest end of ``multi_start`` a group, converged or not, and how many converged."""
    best = F.min_by(F.struct("t0", "rate", "nll", "converged"), F.struct("nll", "t0", "rate")).alias("x")
    return ends.groupBy(group).agg(best, F.count_if("converged").alias("n_converged")).select(group, "x.*", "n_converged")


def fit_groups(counts: DataFrame, sites: float, low: float, model: str = "saturation", group: str = "cluster_id") -> DataFrame:
    """``t0, rate, nll`` of each group of ``day, k``, from the sums of its days."""
    kind = dict(counts.dtypes)[group]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        day, n, k = (pdf[c].to_numpy(float) for c in ("day", "n", "k"))
        t0, rate, nll = _fit(day, n, k, sites, model == "saturation", low, day.min() - 1)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "n": [int(n.sum())], "t0": [t0], "rate": [rate], "nll": [nll]})

    return by_day(counts, group).groupBy(group).applyInPandas(fit, f"{group} {kind}, n long, t0 double, rate double, nll double")


def bootstrap(counts: DataFrame, sites: float, low: float, replicates: int = 2000, model: str = "saturation", group: str = "cluster_id", seed: int = 42, within: bool = False) -> DataFrame:
    """``t0_low, t0_high``: percentiles 2.5 and 97.5 of refits to Poisson draws around each
    group's fit. Draws are of a day's sum, which has the same distribution as the sum of its
    rows' draws; replicates go over the cluster in 64 parts a group. ``within``: around the
    joint fit, and each refit is a local search from it, so it stays in the fit's basin."""
    kind = dict(counts.dtypes)[group]
    if within:
        counts = counts.where("day IS NOT NULL AND k IS NOT NULL")
        fits = joint_fit(multi_start(counts, sites, low, model, group), group).select(group, "t0", "rate", F.lit(0).alias("n"))
    else:
        fits = fit_groups(counts, sites, low, model, group)
    rows = by_day(counts, group).groupBy(group).agg(_days()).join(fits.drop("n"), group)
    each = rows.select(group, "days", "t0", "rate", F.explode(F.sequence(F.lit(1), F.lit(min(64, replicates)))).alias("part"))

    def refit(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                day, n, _ = _arrays(r.days)
                age = np.maximum(day - r.t0, 0)
                mu = sites * -np.expm1(-r.rate * age) if model == "saturation" else sites * r.rate * age
                starts = np.linspace(max(low, r.t0 - 365), min(day.min() - 1, r.t0 + 365), 15)
                for replicate in range(r.part, replicates + 1, 64):
                    k = np.random.default_rng([seed, replicate]).poisson(n * mu)
                    again = _climb(day, n, k, sites, model == "saturation", low, r.t0, r.rate) if within else _fit(day, n, k, sites, model == "saturation", low, day.min() - 1, starts)
                    out.append((getattr(r, group), again[0]))
            yield pd.DataFrame(out, columns=[group, "t0"])

    drawn = each.repartition(F.col(group), F.col("part")).mapInPandas(refit, f"{group} {kind}, t0 double")
    return drawn.groupBy(group).agg(F.percentile("t0", F.lit(0.025)).alias("t0_low"), F.percentile("t0", F.lit(0.975)).alias("t0_high"), F.count("*").alias("replicates"))


def start_trajectories(counts: DataFrame, sites: float, low: float, starts: int = 25) -> DataFrame:
    """A row a start date: where a local search from it ends, and the basin of that year."""
    from cohortlens.functions import scalars as S

    rows = by_day(counts).agg(_days())
    last = F.array_min("days.day") - 1
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start_idx")).withColumn("t0_init", F.lit(low) + (last - low) * F.col("start_idx") / max(1, starts - 1))

    def climb(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                day, n, k = _arrays(r.days)
                near = np.array([r.t0_init])
                out.append((r.start_idx, r.t0_init, *_fit(day, n, k, sites, True, max(low, r.t0_init - 365), min(day.min() - 1, r.t0_init + 365), near)))
            yield pd.DataFrame(out, columns=["start_idx", "t0_init", "t0", "rate", "nll"])

    done = each.repartition("start_idx").select("days", "start_idx", "t0_init").mapInPandas(climb, "start_idx int, t0_init double, t0 double, rate double, nll double")
    return done.withColumn("basin", S.basin(S.decimal_year(S.from_ordinal(F.col("t0")))))


def root_to_tip(counts: DataFrame, *groups: str) -> DataFrame:
    """A strict clock by regression of counts on days: slope, intercept, the date of zero."""
    slope, cut = F.regr_slope("k", "day"), F.regr_intercept("k", "day")
    return counts.groupBy(*groups).agg(F.count("*").alias("n"), slope.alias("slope"), cut.alias("intercept"), F.when(slope != 0, -cut / slope).alias("t0"))


def compare_fits(a: DataFrame, b: DataFrame, group: str, days: float = 60) -> DataFrame:
    """How far two models' dates are apart, and whether by more than so many days."""
    both = a.select(group, F.col("t0").alias("ta")).join(b.select(group, F.col("t0").alias("tb")), group)
    return both.select(group, (F.col("tb") - F.col("ta")).alias("delta_days"), (F.abs(F.col("tb") - F.col("ta")) > days).alias("supported"))


def saturated_share(rate_age: Column) -> Column:
    """Of sites hit at least once, those hit at least twice (Poisson hits)."""
    return F.when(rate_age > 0, (1 - F.exp(-rate_age) * (1 + rate_age)) / (1 - F.exp(-rate_age))).otherwise(0.0)


def saturation_profile(likely: DataFrame, *groups: str) -> DataFrame:
    """The best rate of a grid at each date with the saturation model (of ``likelihoods``)."""
    return likely.groupBy(*groups, "t0").agg(F.min_by("rate", F.struct("nll", "rate")).alias("rate"), F.min("nll").alias("nll"))


def basins(fits: DataFrame, *groups: str) -> DataFrame:
    """``basin``, how many searches of ``basin, t0, rate, nll`` end there, and the best one."""
    best = F.min_by(F.struct("t0", "rate", "nll"), F.struct("nll", "t0", "rate")).alias("x")
    return fits.groupBy(*groups, "basin").agg(F.count("*").alias("n"), best).select(*groups, "basin", "n", "x.t0", "x.rate", "x.nll")


def emergence(replicates: DataFrame, *groups: str) -> DataFrame:
    """Median date of replicate fits ``t0``, and percentiles 5 and 95; null and NaN dates are
    left out, and groups that have no other."""
    out = quantiles(replicates, "t0", list(groups), {"median_t0": 0.5, "low_t0": 0.05, "high_t0": 0.95})
    return out.select(*groups, "median_t0", "low_t0", "high_t0", F.col("__n").alias("n"))


def largest_delta(clusters: DataFrame, delta: str = "delta_days") -> DataFrame:
    """The largest difference of dates over all clusters; null without any."""
    return clusters.agg(F.max(delta).alias("max_delta"), F.count(delta).alias("n_clusters"))
