"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.names import col, free, lookup
from cohortlens.workspace import Workspace


@dataclass(frozen=True)
class Mixture:
    """Wanted share of each source in the output: ``weights``, normed, where given (a
    source without a weight gets none), else its row count to the power ``temper``.
    The output has as many rows as the input times ``growth``, in expectation.
    ``small_sources``: the table of rates is broadcast up to so many sources."""

    weights: tuple[tuple[str, float], ...] = ()
    temper: float = 0.5
    growth: float = 1.0
    seed: int = 7
    small_sources: int = 10_000


#: Rates above this are split into equal parts, which are drawn apart and summed.
_PART = 4.0
#: With a mean of _PART, more than this many have a chance below 1e-25.
_MOST = 40


def unit(*parts: Column | str) -> Column:
    """52 bits of the MD5 of the parts, joined by colons, as a number from 0 below 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, source: str, m: Mixture) -> DataFrame:
    """``__source, __rate, __parts, __cdf``: copies a document of the source should have on
    average; how often to draw; the distribution of a draw, from 0 copies up."""
    n = docs.groupBy(col(source).alias("__source")).agg(F.count("*").alias("__n"))
    if m.weights:
        given = F.create_map(*[F.lit(x) for k, w in m.weights for x in (k, float(w))])
        weight = F.when(F.col("__source").isNull(), 0.0).otherwise(F.coalesce(given[F.coalesce(F.col("__source").cast("string"), F.lit(""))], F.lit(0.0)))
    else:
        weight = F.pow(F.col("__n").cast("double"), F.lit(m.temper))
    n = n.withColumn("__weight", weight)
    all_ = n.agg(F.sum("__n").alias("__total"), F.sum("__weight").alias("__weights"))
    n = n.join(F.broadcast(all_))  # one row
    rate = F.when(F.col("__weights") > 0, F.col("__total") * m.growth * F.col("__weight") / F.col("__weights") / F.col("__n")).otherwise(0.0)
    n = n.select("__source", rate.alias("__rate")).withColumn("__parts", F.greatest(F.lit(1), F.ceil(F.col("__rate") / _PART)).cast("int"))
    each = F.col("__rate") / F.col("__parts")
    zero = F.lit(0.0)
    logs = F.transform(F.sequence(F.lit(0), F.lit(_MOST)), lambda k: F.when(k == 0, zero).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), zero, lambda a, i: a + F.ln(i))))
    mass = F.transform(logs, lambda lf, k: F.exp(k * F.ln(each) - each - lf))
    cdf = F.transform(mass, lambda _, k: F.aggregate(F.slice(mass, 1, k + 1), zero, lambda a, x: a + x))
    return n.withColumn("__cdf", F.when(F.col("__rate") > 0, cdf).otherwise(F.array(F.lit(2.0))))


def mix_sources(docs: DataFrame, m: Mixture = Mixture(), source: str = "source", key: str = "doc_id") -> DataFrame:
    """The columns of ``docs``, then ``copy`` (from 1) and ``shuffle_key``: each document as
    often as a Poisson draw, seeded by its id, says. Rows are dealt to partitions by a hash
    of ``shuffle_key``, itself a hash, and sorted by it there: a random order.

    Null is a source like others; if weights are given it has none. A null id is hashed as
    an empty text. Texts are not looked at: null, empty and long ones are replicated alike.
    Repeated rows with one id are drawn alike. Columns ``copy`` and ``shuffle_key`` of the
    input are replaced. An empty table gives an empty one.
    """
    ws = Workspace(docs.sparkSession, "mix")
    table = ws.table(rates(docs, source, m), "rates")
    base = docs.drop("copy", "shuffle_key")
    of, rate, parts, cdf, copies = free(base, "of", "rate", "parts", "cdf", "copies")
    both = lookup(base, source, table.toDF(of, rate, parts, cdf), of, table.count() <= m.small_sources, "inner")
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col(parts)), F.lit(0),
        lambda a, c: a + F.size(F.filter(cdf, lambda x: x <= unit(F.lit(str(m.seed)), col(key).cast("string"), c.cast("string")))),
    )
    # drawn once as a column of its own: sequence(1, 0) would count down
    both = both.withColumn(copies, drawn).where(F.col(copies) > 0)
    out = both.select(*[col(c) for c in base.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies).cast("long"))).alias("copy"))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order{m.seed}"), col(key).cast("string"), F.col("copy").cast("string"))))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents remixed: sources weigh as the square roots of their sizes."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_poisson_mix": op7_poisson_mix}

#: Over ``docs``: doc_id, source and the number of copies.
MIX_SQL = """
  mn AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM {docs} GROUP BY source),
  mr AS (SELECT source, (SELECT sum(n) FROM mn) * w / (SELECT sum(w) FROM mn) / n AS rate FROM mn),
  mp AS (SELECT source, greatest(1, CAST(ceil(rate / 4) AS INT)) AS parts, rate / greatest(1, ceil(rate / 4)) AS each FROM mr),
  mm AS (SELECT source, parts, list_transform(range(0, 41), lambda k: exp(k * ln(each) - each - CASE WHEN k = 0 THEN 0 ELSE list_sum(list_transform(range(1, k + 1), lambda i: ln(i))) END)) AS mass FROM mp),
  mc AS (SELECT source, parts, list_transform(range(1, 42), lambda k: list_sum(mass[1:k])) AS cdf FROM mm),
  md AS (SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda c: len(list_filter(cdf, lambda x:
           x <= CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || c), 1, 13) AS BIGINT) / 4503599627370496.0)))) AS copies
         FROM {docs} d JOIN mc ON d.source IS NOT DISTINCT FROM mc.source),
  me AS (SELECT *, unnest(range(1, CAST(copies AS BIGINT) + 1)) AS copy FROM md WHERE copies > 0),
  mixed AS (SELECT * EXCLUDE (copies), md5('order7:' || doc_id || ':' || copy) AS shuffle_key FROM me)
"""
ORACLES = {"op7_poisson_mix": "WITH " + MIX_SQL.format(docs="documents") + " SELECT doc_id, text, lang, source, n_chars, copy, shuffle_key FROM mixed"}
