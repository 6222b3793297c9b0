"""Scalar column functions: dates of partial precision, base composition, strata, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The WHO region of a country, by the names used in the metadata.
WHO_REGIONS = {
    "AFR": ("Democratic Republic of the Congo", "DRC", "Congo", "Nigeria", "Cameroon", "Central African Republic", "South Africa", "Liberia", "Ghana", "Republic of the Congo", "Sierra Leone", "Sudan", "Uganda", "Kenya", "Tanzania", "Burundi", "Rwanda", "Zambia", "Zimbabwe", "Ivory Coast", "Cote d'Ivoire", "Côte d'Ivoire", "Gabon", "Benin", "Mozambique", "Senegal", "Angola", "Ethiopia", "Mali"),
    "AMR": ("USA", "United States", "Canada", "Mexico", "Brazil", "Argentina", "Chile", "Colombia", "Peru", "Ecuador", "Cuba", "Dominican Republic", "Panama", "Costa Rica", "Venezuela", "Bolivia", "Uruguay", "Paraguay", "Guatemala", "El Salvador", "Honduras", "Jamaica"),
    "EMR": ("Saudi Arabia", "United Arab Emirates", "UAE", "Iran", "Iraq", "Lebanon", "Jordan", "Egypt", "Morocco", "Tunisia", "Pakistan", "Qatar", "Kuwait", "Bahrain", "Oman", "Israel"),
    "EUR": ("United Kingdom", "UK", "England", "Scotland", "Wales", "Northern Ireland", "Ireland", "Spain", "France", "Germany", "Italy", "Portugal", "Netherlands", "Belgium", "Austria", "Switzerland", "Sweden", "Norway", "Denmark", "Finland", "Poland", "Czech Republic", "Czechia", "Slovakia", "Slovenia", "Hungary", "Romania", "Bulgaria", "Greece", "Croatia", "Serbia", "Russia", "Ukraine", "Belarus", "Lithuania", "Latvia", "Estonia", "Iceland", "Luxembourg", "Malta", "Cyprus"),
    "SEAR": ("India", "Indonesia", "Thailand", "Bangladesh", "Myanmar", "Sri Lanka", "Nepal"),
    "WPR": ("Australia", "New Zealand", "Japan", "China", "South Korea", "Singapore", "Malaysia", "Philippines", "Vietnam", "Taiwan", "Hong Kong"),
}

RANKS = {"day": 3, "month": 2, "year": 1, "unknown": 0}


def date_resolution(s: Column) -> Column:
    """``day``, ``month``, ``year`` or ``unknown`` by the shape of a date; digits are not
    validated. Null is unknown."""
    t, n = F.trim(s), F.length(F.trim(s))
    dash = lambda k: t.substr(k, 1) == "-"
    return (
        F.when((n >= 10) & dash(5) & dash(8), "day").when((n >= 7) & dash(5), "month").when(t.rlike("^[0-9]{4}$"), "year").otherwise("unknown")
    )


def resolution_rank(resolution: Column) -> Column:
    out = F.lit(0)
    for name, rank in RANKS.items():
        out = F.when(resolution == name, rank).otherwise(out)
    return out


def resolution_passes(observed: Column, required: str) -> Column:
    return resolution_rank(observed) >= RANKS[required]


def parse_loose(s: Column) -> Column:
    """The date by the finest format whose prefix parses: a bad month falls back to the
    year's first day; null if nothing parses."""
    t = F.trim(s)

    def form(n: int, pattern: str, fmt: str) -> Column:
        head = t.substr(1, n)
        return F.when((F.length(t) >= n) & head.rlike(pattern), F.try_to_timestamp(head, F.lit(fmt)).cast("date"))

    return F.coalesce(form(10, r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), form(7, r"^\d{4}-\d{2}$", "yyyy-MM"), form(4, r"^\d{4}$", "yyyy"))


def ordinal(d: Column) -> Column:
    """Days since 0001-01-01, which is day 1."""
    return F.datediff(d, F.lit("0001-01-01").cast("date")) + 1


def from_ordinal(x: Column, nearest: bool = False) -> Column:
    """The date of an ordinal, truncated, or rounded half to even."""
    day = F.bround(x, 0) if nearest else F.floor(x)
    return F.date_add(F.lit("0001-01-01").cast("date"), (day - 1).cast("int"))


def decimal_year(d: Column) -> Column:
    start = F.trunc(d, "YEAR")
    return F.year(d) + F.datediff(d, start) / F.datediff(F.add_months(start, 12), start)


def year_of_ordinal(x: Column) -> Column:
    """The decimal year of an ordinal with its fraction of a day; null for null and NaN."""
    x = F.when(~F.isnan(x.cast("double")), x)
    start = F.trunc(from_ordinal(x), "YEAR")
    return F.year(start) + (x - ordinal(start)) / F.datediff(F.add_months(start, 12), start)


def without(s: Column, letters: str) -> Column:
    return F.translate(s, letters, "")


def n_fraction(seq: Column) -> Column:
    n = F.length(seq)
    return F.when(n > 0, (n - F.length(without(seq, "Nn"))) / n).otherwise(0.0)


def non_acgtn_fraction(seq: Column) -> Column:
    """Gaps count as such."""
    n = F.length(seq)
    return F.when(n > 0, F.length(without(seq, "ACGTNacgtn")) / n).otherwise(0.0)


def non_gap_length(seq: Column) -> Column:
    return F.length(without(seq, "-Nn"))


def country_of(location: Column) -> Column:
    return F.trim(F.split(location, ":")[0])


def who_region(location: Column) -> Column:
    """The region of a ``country: place`` text; ``unknown`` if blank, ``other`` if not listed."""
    pairs = [F.lit(x) for region, names in WHO_REGIONS.items() for name in names for x in (name, region)]
    found = F.create_map(*pairs)[country_of(location)]
    return F.when(F.trim(F.coalesce(location, F.lit(""))) == "", "unknown").otherwise(F.coalesce(found, F.lit("other")))


def year_stratum(s: Column) -> Column:
    year = F.trim(s).substr(1, 4).try_cast("int")
    return F.when(year.isNull(), "unknown").when(year <= 2022, "2022").when(year <= 2024, year.cast("string")).otherwise("2025+")


def _classified(clade: Column) -> Column:
    return clade.isNotNull() & ~clade.isin("", "unassigned")


def pick_clade(first: Column, second: Column) -> Column:
    """The first run's clade, or the second's where the first has none."""
    return F.when(_classified(first), first).otherwise(second)


def pick_qc(first_clade: Column, first_qc: Column, second_qc: Column) -> Column:
    """The quality call of the run whose clade counts."""
    return F.when(_classified(first_clade), first_qc).otherwise(second_qc)


def is_partial(completeness: Column, fallback: Column) -> Column:
    return F.coalesce(completeness == "PARTIAL", fallback)


def basin(year: Column) -> Column:
    """Where a dating fit ended: two intervals of years, else ``other``; without a year
    (null or NaN) it has not converged."""
    nowhere = year.isNull() | F.isnan(year.cast("double"))
    return F.when(nowhere, "non-converged").when(year.between(2018, 2020), "~2019 local minimum").when(year.between(2022.5, 2024.5), "~2023 global minimum").otherwise("other")


def starts_with(value: Column, prefix: str) -> Column:
    return F.coalesce(value, F.lit("")).startswith(prefix)


def first_token(header: Column) -> Column:
    return F.split(F.trim(header), r"\s+")[0]


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def is_bad(qc: Column) -> Column:
    return F.lower(F.coalesce(qc, F.lit(""))) == "bad"


def number_or_null(text: Column, missing: str = "--") -> Column:
    return F.nullif(F.trim(text), F.lit(missing)).try_cast("double")


def fixed3(x: Column) -> Column:
    """A number from 0 up with three decimals, rounded by its exact binary value (half to
    even), as C does: the product with 1000 is split into two numbers without error."""
    p, c = x * 1000, x * 134217729.0
    high = c - (c - x)
    rest = (high * 1000 - p) + (x - high) * 1000
    over = (p - F.floor(p) - 0.5) + rest
    k = (F.floor(p) + F.when((over > 0) | ((over == 0) & (F.floor(p) % 2 == 1)), 1).otherwise(0)).cast("long")
    return F.format_string("%d.%03d", F.floor(k / 1000), k % 1000)


def resolve_column(df: DataFrame, candidates: tuple[str, ...], required: bool = True) -> str | None:
    """The first of several spellings of a column that a table has."""
    for name in candidates:
        if name in df.columns:
            return name
    if required:
        raise ValueError(f"none of the columns {', '.join(candidates)}")
    return None
