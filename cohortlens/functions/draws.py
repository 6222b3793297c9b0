"""Random draws as columns: uniform numbers from MD5, Poisson counts by inversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column) -> Column:
    """A number in [0, 1) of 52 bits: the first 13 hexadecimal digits of the MD5 of the
    parts joined by colons. A null part counts as an empty text."""
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def log_factorial(n: Column) -> Column:
    """ln(n!) of n >= 0, to some 1e-12 or 1e-14 of its size: Stirling's series eight places on, taken back."""
    x = n + 8.0
    series = (x + 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0))) + 1 / (1188 * F.pow(x, F.lit(9.0)))
    for k in range(1, 9):
        series = series - F.ln(n + float(k))
    return series


def poisson(mean: Column, u: Column) -> Column:
    """The count of a Poisson distribution at the point ``u`` of [0, 1), a long. Its values are
    laid end to end from the mode m outwards (m, m + 1, m - 1, m + 2, ...), each as long as its
    chance; so a draw takes some 12 sqrt(mean) + 30 steps whatever the mean. 0 for a mean of 0
    or less; null for a null or NaN."""
    mode = F.floor(mean).cast("double")
    top = F.exp(mode * F.ln(mean) - mean - log_factorial(mode))
    steps = F.sequence(F.lit(1), (F.lit(30) + F.ceil(12 * F.sqrt(mean))).cast("int"))

    def draw(x: Column) -> Column:
        def outward(s: Column, j: Column) -> Column:
            up = s["up"] * x["mean"] / (x["mode"] + j)
            down = F.greatest(s["down"] * (x["mode"] - j + 1) / x["mean"], F.lit(0.0))
            k = F.when(s["k"].isNotNull(), s["k"]).when(s["left"] < up, x["mode"] + j).when(s["left"] < up + down, x["mode"] - j)
            return F.struct((s["left"] - up - down).alias("left"), up.alias("up"), down.alias("down"), k.alias("k"))

        first = F.struct((x["u"] - x["top"]).alias("left"), x["top"].alias("up"), x["top"].alias("down"), F.when(x["u"] < x["top"], x["mode"]).alias("k"))
        return F.aggregate(x["steps"], first, outward, lambda s: F.coalesce(s["k"], x["mode"]).cast("long"))

    # as the element of an array, the parts are worked out once, not at every step
    parts = F.struct(mean.alias("mean"), u.alias("u"), mode.alias("mode"), top.alias("top"), steps.alias("steps"))
    drawn = F.get(F.transform(F.array(parts), draw), F.lit(0))
    return F.when(mean <= 0, F.lit(0).cast("long")).when(mean.isNotNull() & ~F.isnan(mean) & u.isNotNull(), drawn)
