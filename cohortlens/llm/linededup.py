"""Boilerplate lines: a line that too large a share of its site's pages carries goes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.names import col, free, lookup
from cohortlens.workspace import Workspace


@dataclass(frozen=True)
class SiteLines:
    """A line goes if ``least_pages`` pages of its site or more, and a share over ``ratio``
    of them, carry it. ``small_keys``: up to so many line keys (and sites) are broadcast."""

    ratio: float = 0.05
    least_pages: int = 4
    small_keys: int = 100_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def boilerplate(docs: DataFrame, site: str, text: str, p: SiteLines, ws: Workspace) -> DataFrame:
    """``site_of_lines, gone``: the keys of each site's boilerplate lines. A site has at
    most (lines a page) / ``ratio`` of them, however many pages it has."""
    full = F.filter(lines_of(col(text)), lambda x: F.trim(x) != "")
    keys = docs.select(col(site).alias("s"), F.explode(F.array_distinct(F.transform(full, lambda x: F.xxhash64(x)))).alias("key"))
    often = keys.groupBy("s", "key").agg(F.count("*").alias("n")).where(F.col("n") >= p.least_pages)
    pages = ws.table(docs.groupBy(col(site).alias("site_of_pages")).agg(F.count("*").alias("pages")), "pages")
    over = lookup(often, "s", pages, "site_of_pages", pages.count() <= p.small_keys, "inner").where(F.col("n") > p.ratio * F.col("pages"))
    return ws.table(over.groupBy(F.col("s").alias("site_of_lines")).agg(F.collect_list("key").alias("gone")), "boilerplate")


def drop_site_lines(docs: DataFrame, site: str = "source", text: str = "text", p: SiteLines = SiteLines(), counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """All rows and columns of ``docs`` with the boilerplate lines cut out of ``text``, and
    how many lines it had and lost, under the names ``counts`` (replaced if there are such
    columns; no other column is touched).

    Blank lines stay and are not counted. A page of nothing but boilerplate loses all its
    lines: what stays are its blank ones, or an empty text. Null text stays null and counts
    as a page without lines. A null site is a site. Lines are compared byte by byte (by a
    64-bit hash); a line that one page repeats counts once for that page, repeated rows
    each count. An empty table gives an empty one.
    """
    ws = Workspace(docs.sparkSession, "lines")
    found = boilerplate(docs, site, text, p, ws)
    total = found.agg(F.sum(F.size("gone"))).first()[0] or 0
    base = docs.drop(*counts)
    key, gone, lines, kept = free(base, "site_of_lines", "gone", "lines", "kept")
    both = lookup(base, site, found.toDF(key, gone), key, total <= p.small_keys, "left")
    both = both.withColumn(lines, lines_of(col(text)))
    drop = F.coalesce(F.col(gone), F.array().cast("array<long>"))
    both = both.withColumn(kept, F.when(F.size(drop) > 0, F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(drop, F.xxhash64(x)))).otherwise(F.col(lines)))
    lost = (F.size(lines) - F.size(kept)).cast("long")
    new = F.when(lost > 0, F.array_join(kept, "\n")).otherwise(col(text))
    had = F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long")
    return both.select(*[new.alias(c) if c == text else col(c) for c in base.columns], had.alias(counts[0]), lost.alias(counts[1]))


def op4_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source. Nulls, empty and long texts,
    ties, repeated rows, an empty table and further columns: as in ``drop_site_lines``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_site_lines(docs).select("doc_id", "source", "n_lines", "n_dropped", "text")


QUERIES = {"op4_site_lines": op4_site_lines}

#: Over a view ``docs_in``: the same columns with cleaned text.
CLEAN_SQL = """
  l AS (SELECT doc_id, source, text, CASE WHEN text IS NULL THEN [''] ELSE string_split(text, chr(10)) END AS ls FROM {docs}),
  k AS (SELECT source, line, count(*) AS n FROM
          (SELECT source, doc_id, unnest(list_distinct(list_filter(ls, lambda x: trim(x, ' ') <> ''))) AS line FROM l) GROUP BY source, line),
  t AS (SELECT source, count(*) AS pages FROM {docs} GROUP BY source),
  b AS (SELECT k.source, list(line) AS gone FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
        WHERE n >= 4 AND n > 0.05 * pages GROUP BY k.source),
  c AS (SELECT l.doc_id, l.source, l.text, ls, len(list_filter(ls, lambda x: trim(x, ' ') <> '')) AS n_lines,
          list_filter(ls, lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(gone, []), x)) AS kept
        FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source),
  cleaned AS (SELECT doc_id, source, CAST(n_lines AS BIGINT) AS n_lines,
          CAST(len(ls) - len(kept) AS BIGINT) AS n_dropped,
          CASE WHEN len(ls) > len(kept) THEN coalesce(array_to_string(kept, chr(10)), '') ELSE text END AS text FROM c)
"""
ORACLES = {"op4_site_lines": "WITH " + CLEAN_SQL.format(docs="documents") + " SELECT doc_id, source, n_lines, n_dropped, text FROM cleaned"}
