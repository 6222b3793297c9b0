"""All queries of the library with their SQL twins (DuckDB) over the driver's tables.

Sequences are derived from the documents: all their letters, turned into bases.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import scalars as S
from cohortlens.operators import cohort, dating, detect, qc, sequence, stats

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c, name: str | None = None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) if name is None else F.round(c, 6).alias(name)


# --- quality control -------------------------------------------------------------------

LIMITS = qc.Limits(min_length=200, max_n=0.1, max_other=0.75, organisms=("src1", "src2", "src3"))

_RECORDS_SQL = """
r AS (SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, source AS organism,
       CASE WHEN quality IS NULL THEN '' WHEN quality = 1 THEN 'Ia' ELSE 'IIa' END AS clade,
       CAST(length(text) AS BIGINT) AS seq_length,
       CASE WHEN length(text) > 0 THEN (length(text) - length(translate(text, 'Nn', ''))) * 1.0 / length(text) WHEN text IS NOT NULL THEN 0.0 END AS nf,
       CASE WHEN length(text) > 0 THEN length(translate(text, 'ACGTNacgtn', '')) * 1.0 / length(text) WHEN text IS NOT NULL THEN 0.0 END AS af,
       CASE coalesce(d.doc_id, l.doc_id) % 4 WHEN 0 THEN '2024-05-01' WHEN 1 THEN '2024-05' WHEN 2 THEN '2024' ELSE '' END AS cdate,
       CASE WHEN toxic = 1 THEN 'Bad' ELSE 'good' END AS qc, CASE WHEN coalesce(d.doc_id, l.doc_id) % 11 = 0 THEN 'bad' ELSE 'good' END AS fs
  FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id),
x AS (SELECT *, CASE WHEN cdate LIKE '____-__-__' THEN 'day' WHEN cdate LIKE '____-__' THEN 'month' WHEN cdate LIKE '____' THEN 'year' ELSE 'unknown' END AS res FROM r),
q AS (SELECT *, list_filter([
  CASE WHEN organism <> '' AND NOT (contains(lower(organism), 'src1') OR contains(lower(organism), 'src2') OR contains(lower(organism), 'src3')) THEN 'organism_not_mpxv:' || substr(organism, 1, 30) END,
  CASE WHEN clade <> '' AND NOT ((starts_with(clade, 'I') AND NOT starts_with(clade, 'II')) OR contains(clade, '/') OR clade IN ('IIb', 'II')) THEN 'clade_excluded:' || clade END,
  CASE WHEN seq_length IS NULL THEN 'no_sequence_found' WHEN seq_length < 200 THEN 'length_lt_200:' || seq_length END,
  CASE WHEN nf > 0.1 THEN 'n_fraction_gt_0.1:' || printf('%.3f', nf) END,
  CASE WHEN af > 0.75 THEN 'non_acgtn_gt_0.75:' || printf('%.3f', af) END,
  CASE WHEN res NOT IN ('day', 'month') THEN 'date_resolution_' || res || '_lt_month' END,
  CASE WHEN lower(qc) = 'bad' THEN 'nextclade_qc_bad' END, CASE WHEN fs = 'bad' THEN 'frameshift_qc_bad' END], lambda z: z IS NOT NULL) AS reasons FROM x)
"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as records of a surveillance table: labels are their quality calls."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")  # noqa: E741
    both = d.select("doc_id", "text", "source").join(l, "doc_id", "full")
    cycle = F.col("doc_id") % 4
    return both.select(
        "doc_id", F.col("source").alias("organism"), F.when(F.col("quality").isNull(), "").when(F.col("quality") == 1, "Ia").otherwise("IIa").alias("clade"),
        F.length("text").cast("long").alias("seq_length"), S.n_fraction(F.col("text")).alias("n_fraction"), S.non_acgtn_fraction(F.col("text")).alias("non_acgtn_fraction"),
        F.when(cycle == 0, "2024-05-01").when(cycle == 1, "2024-05").when(cycle == 2, "2024").otherwise("").alias("collection_date"),
        F.when(F.col("toxic") == 1, "Bad").otherwise("good").alias("qc"), F.when(F.col("doc_id") % 11 == 0, "bad").otherwise("good").alias("frameshift_qc"),
    )


@query(f"WITH {_RECORDS_SQL} SELECT doc_id, array_to_string(reasons, '|') AS exclusion_reasons, len(reasons) = 0 AS passes FROM q")
def flt_reasons(spark, sf):
    return qc.serialised(qc.with_reasons(records(spark, sf), LIMITS)).select("doc_id", "exclusion_reasons", "passes")


@query(f"WITH {_RECORDS_SQL} SELECT split_part(z, ':', 1) AS reason, count(*) AS n FROM (SELECT unnest(reasons) AS z FROM q) GROUP BY 1")
def flt_tally(spark, sf):
    return qc.tally(qc.with_reasons(records(spark, sf), LIMITS))


@query(f"WITH {_RECORDS_SQL} SELECT clade, count(*) AS n FROM q WHERE len(reasons) = 0 GROUP BY 1")
def flt_clade_tally(spark, sf):
    return qc.clade_tally(qc.with_reasons(records(spark, sf), LIMITS))


@query(f"WITH {_RECORDS_SQL} SELECT count(*) AS passed, round(avg(CASE WHEN res IN ('day', 'month') THEN 1.0 ELSE 0.0 END), 6) AS share_dated, count(*) >= 30 AS enough FROM q WHERE len(reasons) = 0")
def flt_exit(spark, sf):
    return qc.dated_share(qc.with_reasons(records(spark, sf), LIMITS)).select("passed", r6("share_dated", "share_dated"), "enough")


@query(f"WITH {_RECORDS_SQL} SELECT count(*) AS input_rows, count(*) FILTER (len(reasons) = 0) AS passed, count(*) FILTER (len(reasons) > 0) AS excluded FROM q")
def flt_summary(spark, sf):
    return qc.summary(qc.with_reasons(records(spark, sf), LIMITS))


@query("""SELECT o_custkey AS cluster_id, count(*) AS n_genomes, CASE WHEN count(o_orderdate) >= 2 THEN CAST(min(o_orderdate) AS DATE) END AS earliest,
  CASE WHEN count(o_orderdate) >= 2 THEN CAST(max(o_orderdate) AS DATE) END AS latest,
  CASE WHEN count(o_orderdate) >= 2 THEN CAST(CAST(max(o_orderdate) AS DATE) - CAST(min(o_orderdate) AS DATE) AS INTEGER) ELSE 0 END AS span_days,
  count(*) >= 10 AND CASE WHEN count(o_orderdate) >= 2 THEN CAST(max(o_orderdate) AS DATE) - CAST(min(o_orderdate) AS DATE) ELSE 0 END >= 180 AS eligible FROM orders GROUP BY 1""")
def flt_clusters(spark, sf):
    return qc.eligible_clusters(table(spark, sf, "orders").select(F.col("o_custkey").alias("cluster_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("collection_date")))


# --- scalars ---------------------------------------------------------------------------


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN strftime(o_orderdate, '%Y') || '-13-01' ELSE 'none' END AS s FROM orders),
 d AS (SELECT *, coalesce(CASE WHEN length(s) >= 10 THEN try_strptime(substr(s, 1, 10), '%Y-%m-%d') END, CASE WHEN length(s) >= 7 THEN try_strptime(substr(s, 1, 7), '%Y-%m') END, CASE WHEN length(s) >= 4 THEN try_strptime(substr(s, 1, 4), '%Y') END)::DATE AS d FROM s)
 SELECT o_orderkey, s, CASE WHEN length(s) >= 10 AND s[5] = '-' AND s[8] = '-' THEN 'day' WHEN length(s) >= 7 AND s[5] = '-' THEN 'month' WHEN regexp_matches(s, '^[0-9]{4}$') THEN 'year' ELSE 'unknown' END AS resolution,
  d AS parsed, CAST(date_diff('day', DATE '0001-01-01', d) + 1 AS INTEGER) AS ordinal,
  round(year(d) + date_diff('day', date_trunc('year', d), d) * 1.0 / date_diff('day', date_trunc('year', d), date_trunc('year', d) + INTERVAL 1 YEAR), 6) AS decimal_year FROM d""")
def fn_dates(spark, sf):
    at, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    s = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "yyyy-MM")).when(k == 2, F.date_format(at, "yyyy")).when(k == 3, F.concat(F.date_format(at, "yyyy"), F.lit("-13-01"))).otherwise("none")
    df = table(spark, sf, "orders").select("o_orderkey", s.alias("s"))
    df = df.select("*", S.date_resolution(F.col("s")).alias("resolution"), S.parse_loose(F.col("s")).alias("parsed"))
    return df.select("*", S.ordinal(F.col("parsed")).alias("ordinal"), r6(S.decimal_year(F.col("parsed")), "decimal_year"))


@query("""SELECT doc_id, CAST(length(text) AS INTEGER) AS len, round(CASE WHEN length(text) > 0 THEN (length(text) - length(translate(text, 'Nn', ''))) * 1.0 / length(text) ELSE 0 END, 6) AS n_fraction,
  round(CASE WHEN length(text) > 0 THEN length(translate(text, 'ACGTNacgtn', '')) * 1.0 / length(text) ELSE 0 END, 6) AS other_fraction, CAST(length(translate(text, '-Nn', '')) AS INTEGER) AS non_gap FROM documents""")
def fn_composition(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.length(t).alias("len"), r6(S.n_fraction(t), "n_fraction"), r6(S.non_acgtn_fraction(t), "other_fraction"), S.non_gap_length(t).alias("non_gap"))


_PLACES = ("Canada: Ottawa", "Brazil", "Nigeria: Lagos", "France ", "Atlantis", "", "Japan: Tokyo")


@query("""WITH p AS (SELECT n_nationkey, ['Canada: Ottawa', 'Brazil', 'Nigeria: Lagos', 'France ', 'Atlantis', '', 'Japan: Tokyo'][n_nationkey % 7 + 1] AS place FROM nation)
 SELECT n_nationkey, place, CASE trim(split_part(place, ':', 1)) WHEN 'Canada' THEN 'AMR' WHEN 'Brazil' THEN 'AMR' WHEN 'Nigeria' THEN 'AFR' WHEN 'France' THEN 'EUR' WHEN 'Japan' THEN 'WPR' WHEN '' THEN 'unknown' ELSE 'other' END AS region FROM p""")
def fn_regions(spark, sf):
    place = F.element_at(F.array(*map(F.lit, _PLACES)), (F.col("n_nationkey") % 7 + 1).cast("int"))
    return table(spark, sf, "nation").select("n_nationkey", place.alias("place"), S.who_region(place).alias("region"))


@query("""WITH s AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(year(o_orderdate) + o_orderkey % 30 AS VARCHAR) END AS s FROM orders)
 SELECT CASE WHEN try_cast(substr(trim(s), 1, 4) AS INT) IS NULL THEN 'unknown' WHEN try_cast(substr(trim(s), 1, 4) AS INT) <= 2022 THEN '2022' WHEN try_cast(substr(trim(s), 1, 4) AS INT) <= 2024 THEN substr(trim(s), 1, 4) ELSE '2025+' END AS stratum, count(*) AS n FROM s GROUP BY 1""")
def fn_year_strata(spark, sf):
    s = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise((F.year("o_orderdate") + F.col("o_orderkey") % 30).cast("string"))
    return table(spark, sf, "orders").groupBy(S.year_stratum(s).alias("stratum")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT d.doc_id, CASE quality WHEN 1 THEN 'Ib' WHEN 0 THEN 'unassigned' END AS c1, lang AS c2, CASE toxic WHEN 1 THEN 'bad' ELSE 'good' END AS q1, source AS q2 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
 SELECT doc_id, CASE WHEN c1 IS NOT NULL AND c1 NOT IN ('', 'unassigned') THEN c1 ELSE c2 END AS clade, CASE WHEN c1 IS NOT NULL AND c1 NOT IN ('', 'unassigned') THEN q1 ELSE q2 END AS qc FROM b""")
def fn_pick(spark, sf):
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    c1 = F.when(F.col("quality") == 1, "Ib").when(F.col("quality") == 0, "unassigned")
    q1 = F.when(F.col("toxic") == 1, "bad").otherwise("good")
    return both.select("doc_id", S.pick_clade(c1, F.col("lang")).alias("clade"), S.pick_qc(c1, q1, F.col("source")).alias("qc"))


@query("SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents")
def fn_checksums(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


# --- joins -----------------------------------------------------------------------------


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS in_documents, l.doc_id IS NOT NULL AS in_labels FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def jn_full(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lit(True).alias("in_d"))
    l = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("in_l"))  # noqa: E741
    return d.join(l, "doc_id", "full").select("doc_id", F.col("in_d").isNotNull().alias("in_documents"), F.col("in_l").isNotNull().alias("in_labels"))


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def jn_left(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    df = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return df.select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def jn_semi(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 350000)")
def jn_anti(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) AS flagged FROM customer")
def jn_mark(spark, sf):
    have = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("f")).distinct()
    return table(spark, sf, "customer").join(have, "c_custkey", "left").select("c_custkey", F.col("f").isNotNull().alias("flagged"))


# --- aggregates ------------------------------------------------------------------------


@query("""SELECT coalesce(l_returnflag, 'ALL') AS clade, count(*) AS n, round(median(l_quantity), 6) AS median_total, round(sum(l_discount) / sum(l_quantity), 6) AS pooled_fraction FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())""")
def agg_baseline(spark, sf):
    aggs = [F.count("*").alias("n"), r6(F.sum("l_discount") / F.sum("l_quantity"), "pooled_fraction")]
    return stats.with_total(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("clade"), "l_quantity", "l_discount"), "clade", "unassigned", "ALL", aggs, {"median_total": "l_quantity"}).withColumn("median_total", r6("median_total"))


@query("SELECT lang, quality, CAST(sum(toxic) AS BIGINT) AS flagged, count(*) AS n, round_even(sum(toxic) * 1.0 / count(*), 4) AS rate FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE lang IS NOT NULL AND quality IS NOT NULL GROUP BY 1, 2")
def agg_flag_rate(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").where("lang IS NOT NULL AND quality IS NOT NULL")
    return df.groupBy("lang", "quality").agg(F.sum("toxic").alias("flagged"), F.count("*").alias("n"), F.bround(F.sum("toxic") / F.count("*"), 4).alias("rate"))


@query("SELECT o_orderstatus, count(o_totalprice) AS n, round_even(quantile_cont(o_totalprice, 0.5), 4) AS median, round_even(quantile_cont(o_totalprice, 0.25), 4) AS q1, round_even(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders GROUP BY 1")
def agg_describe(spark, sf):
    return stats.describe(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus")


@query("SELECT event_type, count(value) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS sd FROM events GROUP BY 1")
def agg_distribution(spark, sf):
    out = stats.distribution(table(spark, sf, "events"), "value", "event_type")
    return out.select("event_type", "n", *[r6(c, c) for c in ("min", "max", "mean", "median", "sd")])


@query("SELECT least(23, CAST(floor(l_quantity / (50.0 / 24)) AS INTEGER)) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def agg_histogram(spark, sf):
    return stats.histogram(table(spark, sf, "lineitem"), "l_quantity", 0.0, 50.0)


@query("SELECT o_orderpriority, round(avg(CASE WHEN o_totalprice < 100000 THEN 1.0 ELSE 0.0 END) * 100, 6) AS percent_below FROM orders GROUP BY 1")
def agg_percent_below(spark, sf):
    return stats.percent_below(table(spark, sf, "orders"), "o_totalprice", 100000, "o_orderpriority").select("o_orderpriority", r6("percent_below", "percent_below"))


@query("WITH c AS (SELECT unnest([10.0, 25.0, 50.0]) AS cutoff) SELECT cutoff::DOUBLE AS cutoff, count(*) FILTER (l_quantity <= cutoff) AS n, round(sum(l_tax) FILTER (l_quantity <= cutoff) / sum(l_discount) FILTER (l_quantity <= cutoff), 6) AS pooled_fraction FROM lineitem, c GROUP BY 1")
def agg_graded_exclusion(spark, sf):
    return stats.graded_exclusion(table(spark, sf, "lineitem"), "l_quantity", "l_tax", "l_discount", [10, 25, 50]).select("cutoff", "n", r6("pooled_fraction", "pooled_fraction"))


# --- samples, orders, sets -------------------------------------------------------------


@query("""WITH c AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_mktsegment || '|' || c_nationkey AS s, md5('42:' || c_custkey) AS h FROM customer),
 k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, c_custkey) AS k FROM c),
 t AS (SELECT *, CASE WHEN k <= 2 THEN 0 ELSE k END AS turn, CASE WHEN k <= 2 THEN h ELSE md5('42:' || s) END AS place FROM k WHERE k <= 6)
 SELECT c_custkey, c_mktsegment, c_nationkey, CASE WHEN k <= 2 THEN 1 ELSE 2 END AS allocation_pass FROM t ORDER BY turn, place, k, c_custkey LIMIT 400""")
def smp_stratified(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return cohort.stratified_sample(df, ["c_mktsegment", "c_nationkey"], "c_custkey", 400, 2, 6)


@query("""WITH e AS (SELECT s_suppkey, r, md5((r + 42) || ':' || s_suppkey) AS h FROM supplier, (SELECT unnest([1, 2, 3]) AS r)),
 k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY h, s_suppkey) AS k FROM e) SELECT s_suppkey, CAST(r AS INTEGER) AS replicate FROM k WHERE k <= (SELECT round_even(count(*) * 0.5, 0) FROM supplier)""")
def smp_replicates(spark, sf):
    return cohort.subsamples(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", 0.5, 3)


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) ORDER BY md5('7:' || p_partkey), p_partkey LIMIT 50")
def smp_matched(spark, sf):
    taken = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return cohort.matched_random(table(spark, sf, "part").select("p_partkey"), taken, "p_partkey", 50, "7")


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders ORDER BY o_orderdate NULLS LAST, o_orderkey LIMIT (SELECT count(*) - CAST(round_even(count(*) * 0.1, 0) AS BIGINT) FROM orders)")
def srt_tail_drop(spark, sf):
    return cohort.without_latest(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 0.1).select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("SELECT o_custkey, o_orderkey, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 3")
def lim_first_per_group(spark, sf):
    return cohort.first_in_group(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")], 3)


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 40), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.05) SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS shared, count(*) AS either, round(count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) * 1.0 / count(*), 6) AS jaccard FROM a FULL JOIN b ON a.k = b.k")
def set_jaccard(spark, sf):
    li = table(spark, sf, "lineitem")
    return cohort.jaccard(li.where("l_quantity > 40"), li.where("l_discount > 0.05"), "l_partkey").select("shared", "either", r6("jaccard", "jaccard"))


# --- sequences -------------------------------------------------------------------------

_SEQ = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
_SEQS_SQL = f"s AS (SELECT doc_id AS accession, {_SEQ} AS seq FROM documents), ref AS (SELECT seq AS rs FROM s WHERE accession = 0)"
_VARIANTS_SQL = f"""{_SEQS_SQL}, p AS (SELECT accession, seq, rs, unnest(range(1, least(length(seq), length(rs)) + 1)) AS pos FROM s, ref),
 v AS (SELECT accession, CAST(pos AS INTEGER) AS pos, substr(rs, pos, 1) AS ref, substr(seq, pos, 1) AS alt,
   CASE WHEN substr(rs, pos, 1) = 'C' AND substr(seq, pos, 1) = 'T' AND pos > 1 AND substr(rs, pos - 1, 1) = 'T' THEN 'TC'
        WHEN substr(rs, pos, 1) = 'G' AND substr(seq, pos, 1) = 'A' AND substr(rs, pos + 1, 1) = 'A' THEN 'GA' END AS context
   FROM p WHERE substr(rs, pos, 1) <> substr(seq, pos, 1))"""
_SITES_SQL = f"""{_SEQS_SQL}, e AS (SELECT CAST(pos AS INTEGER) AS pos, CASE WHEN substr(rs, pos, 1) = 'C' AND pos > 1 AND substr(rs, pos - 1, 1) = 'T' THEN 'TC'
   WHEN substr(rs, pos, 1) = 'G' AND substr(rs, pos + 1, 1) = 'A' THEN 'GA' END AS context FROM (SELECT rs, unnest(range(1, length(rs) + 1)) AS pos FROM ref))"""


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """The bases of each document."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    seq = F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("accession"), seq.alias("seq"))


def reference(spark: SparkSession, sf: str) -> DataFrame:
    return sequences(spark, sf).where("accession = 0").select("seq")


@query(f"WITH {_SEQS_SQL} SELECT accession, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM s")
def seq_whole_reverse_complement(spark, sf):
    return sequences(spark, sf).select("accession", sequence.reverse_complement(F.col("seq")).alias("rc"))


@query(f"WITH {_SEQS_SQL} SELECT accession, CASE WHEN length(seq) > 10 THEN substr(seq, 1, 10) || repeat('N', CAST(least(length(seq), 40) - 10 AS BIGINT)) || substr(seq, 41) ELSE seq END AS seq FROM s")
def seq_whole_mask(spark, sf):
    return sequences(spark, sf).select("accession", sequence.masked(F.col("seq"), [(10, 30), (25, 40)]).alias("seq"))


@query(f"WITH {_SITES_SQL} SELECT pos, context FROM e WHERE context IS NOT NULL")
def seq_whole_eligible_sites(spark, sf):
    return sequence.eligible_sites(reference(spark, sf))


@query(f"WITH {_SITES_SQL} SELECT count(context) AS l_total, count(*) FILTER (context = 'TC') AS l_tc, count(*) FILTER (context = 'GA') AS l_ga FROM e")
def seq_whole_site_totals(spark, sf):
    return sequence.site_totals(sequence.eligible_sites(reference(spark, sf)))


@query(f"WITH {_VARIANTS_SQL} SELECT accession, pos, ref, alt, context FROM v")
def seq_whole_variants(spark, sf):
    return sequence.variants(sequences(spark, sf), reference(spark, sf), same_length=False)


@query(f"""WITH {_VARIANTS_SQL}, c AS (SELECT accession, count(*) AS t, count(context) AS a FROM v GROUP BY 1)
 SELECT s.accession, coalesce(t, 0) AS total_snvs, coalesce(a, 0) AS apobec3_snvs, coalesce(t - a, 0) AS non_apobec3_snvs, round(CASE WHEN t > 0 THEN a * 1.0 / t ELSE 0 END, 6) AS apobec3_fraction FROM s LEFT JOIN c ON s.accession = c.accession""")
def seq_whole_variant_counts(spark, sf):
    out = sequence.count_variants(sequences(spark, sf), reference(spark, sf), same_length=False)
    return out.withColumn("apobec3_fraction", r6("apobec3_fraction"))


@query(f"WITH {_VARIANTS_SQL} SELECT pos, context, count(*) AS occupancy FROM v WHERE context IS NOT NULL GROUP BY 1, 2")
def seq_whole_occupancy(spark, sf):
    return sequence.occupancy(sequence.variants(sequences(spark, sf), reference(spark, sf), same_length=False))


@query(f"""WITH {_SEQS_SQL}, b AS (SELECT CAST(pos AS INTEGER) AS pos, substr(seq, pos, 1) AS base FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS pos FROM s))
 SELECT pos, CAST(count(DISTINCT base) AS INTEGER) AS n_bases, 0.0::DOUBLE AS missing, count(DISTINCT base) >= 2 AS variable, false AS ambiguous FROM b GROUP BY 1""")
def seq_whole_columns(spark, sf):
    return sequence.column_statistics(sequence.column_counts(sequences(spark, sf)))


@query(f"""WITH {_SITES_SQL}, b AS (SELECT CAST(pos AS INTEGER) AS pos, substr(seq, pos, 1) AS base FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS pos FROM s))
 SELECT e.pos, context, count(*) AS n_sequences FROM e JOIN b ON e.pos = b.pos WHERE (context = 'TC' AND base = 'T') OR (context = 'GA' AND base = 'A') GROUP BY 1, 2""")
def seq_whole_homoplasy(spark, sf):
    return sequence.homoplasy_columns(sequence.column_counts(sequences(spark, sf)), reference(spark, sf))


@query(f"""WITH {_SEQS_SQL}, l AS (SELECT accession, seq, f, CAST(round_even(length(seq) * f, 0) AS BIGINT) AS k FROM s, (SELECT unnest([1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.1])::DOUBLE AS f))
 SELECT accession, f AS retain_frac, repeat('-', (length(seq) - k) // 2) || substr(seq, (length(seq) - k) // 2 + 1, k) || repeat('-', length(seq) - k - (length(seq) - k) // 2) AS seq FROM l""")
def seq_whole_ladder(spark, sf):
    return sequence.truncation_ladder(sequences(spark, sf)).select("accession", "retain_frac", "seq")


@query(f"""WITH {_SEQS_SQL}, b AS (SELECT accession, CAST(pos AS INTEGER) AS pos, substr(seq, pos, 1) AS base FROM (SELECT accession, seq, unnest(range(1, length(seq) + 1)) AS pos FROM s)),
 n AS (SELECT pos, lang AS grp, base, count(*) AS n FROM b JOIN documents ON accession = doc_id WHERE lang IN ('fr', 'de') GROUP BY 1, 2, 3),
 t AS (SELECT *, row_number() OVER w AS k, coalesce(lead(n) OVER w, 0) AS second FROM n WINDOW w AS (PARTITION BY pos, grp ORDER BY n DESC, base))
 SELECT pos, list_sort(list(grp || ':' || base)) AS calls FROM t WHERE k = 1 AND n - second >= 3 GROUP BY pos HAVING count(*) = 2 AND count(DISTINCT base) = 2""")
def seq_whole_diagnostic(spark, sf):
    groups = table(spark, sf, "documents").where("lang IN ('fr', 'de')").select(F.col("doc_id").alias("accession"), "lang")
    return sequence.diagnostic_columns(sequence.column_counts(sequences(spark, sf).join(groups, "accession"), "lang"))


# --- statistics ------------------------------------------------------------------------


@query("""WITH g AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders GROUP BY 1), z AS (SELECT 1.959963984540054 AS z),
 c AS (SELECT *, k * 1.0 / n AS p FROM g, z)
 SELECT o_orderpriority, n, k, round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4.0*n*n)) / (1 + z*z/n)), 6) AS low, round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4.0*n*n)) / (1 + z*z/n)), 6) AS high FROM c""")
def st_wilson(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select("o_orderpriority", "n", "k", r6(low, "low"), r6(high, "high"))


@query("""WITH g AS (SELECT n_regionkey, count(*) AS n, count(*) FILTER (n_nationkey % 2 = 0) AS k FROM nation GROUP BY 1),
 t AS (SELECT n_regionkey, n, k, unnest(range(k, n + 1)) AS i FROM g)
 SELECT n_regionkey, n, k, round(least(1, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.7) + (n - i) * ln(0.3)))), 6) AS p_greater FROM t GROUP BY 1, 2, 3""")
def st_binomial(spark, sf):
    g = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"), F.count_if(F.col("n_nationkey") % 2 == 0).alias("k"))
    return g.select("n_regionkey", "n", "k", r6(stats.binomial_tail_column(F.col("k"), F.col("n"), 0.7), "p_greater"))


@query("SELECT o_orderkey, o_orderstatus, rank() OVER w + (count(*) OVER (PARTITION BY o_orderstatus, o_orderdate) - 1) / 2.0 AS place FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate)")
def win_ranks(spark, sf):
    return stats.ranked(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), "o_orderdate", "o_orderstatus").select("o_orderkey", "o_orderstatus", F.col("rank_o_orderdate").alias("place"))


@query("""WITH r AS (SELECT o_orderstatus = 'F' AS f, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r FROM orders)
 , t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM orders WHERE o_totalprice IS NOT NULL GROUP BY o_totalprice)),
 u AS (SELECT count(*) FILTER (f)::DOUBLE AS n1, count(*) FILTER (NOT f)::DOUBLE AS n2, sum(r) FILTER (f) - count(*) FILTER (f) * (count(*) FILTER (f) + 1) / 2.0 AS u FROM r),
 z AS (SELECT *, (u - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u, t)
 SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, round(u, 6) AS u, round(z, 6) AS z FROM z""")
def st_rank_sum(spark, sf):
    df = table(spark, sf, "orders").select("o_totalprice", (F.col("o_orderstatus") == "F").alias("f"))
    return stats.rank_sum(df, "o_totalprice", "f").select("n1", "n2", r6("u", "u"), r6("z", "z"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
 SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r""")
def st_spearman(spark, sf):
    return stats.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select("n", r6("rho", "rho"))


# --- detectors -------------------------------------------------------------------------

_REC_SQL = "rec AS (SELECT CAST(user_id AS VARCHAR) AS child, event_type AS p_name, CAST(event_id % 17 AS VARCHAR) AS q_name, CASE WHEN value > 0 AND value / 100 <= 1 THEN value / 100 END AS p, event_id AS ord FROM events)"


def detector_records(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a detector's triplets: a user is a child, hundredths are p values."""
    p = F.when((F.col("value") > 0) & (F.col("value") / 100 <= 1), F.col("value") / 100)
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("child"), F.col("event_type").alias("p_name"), (F.col("event_id") % 17).cast("string").alias("q_name"), p.alias("p"), F.col("event_id").alias("ord"))


@query(f"WITH {_REC_SQL} SELECT child, round(min(p), 6) AS min_p FROM rec GROUP BY 1")
def det_min_p(spark, sf):
    return detect.min_p(detector_records(spark, sf)).select("child", r6("min_p", "min_p"))


@query(f"WITH {_REC_SQL} SELECT child, p_name, q_name, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY p, ord) AS k FROM rec WHERE p IS NOT NULL) WHERE k = 1")
def det_best_pair(spark, sf):
    return detect.best_pair(detector_records(spark, sf)).withColumn("p", r6("p"))


@query(f"WITH {_REC_SQL} SELECT q_name, count(*) AS n FROM rec GROUP BY 1 ORDER BY n DESC, min(ord) LIMIT 10")
def det_top_parents(spark, sf):
    return detect.most_common(detector_records(spark, sf), "q_name", "ord")


@query(f"WITH {_REC_SQL} SELECT t::DOUBLE AS threshold, count(DISTINCT child) FILTER (p < t) AS n_candidates, coalesce(bool_or(p < t AND child = '7'), false) AS control_in_set FROM rec, (SELECT unnest([0.05 * 0.5, 0.05, 0.05 * 2]) AS t) GROUP BY 1")
def det_threshold_sweep(spark, sf):
    return detect.threshold_sweep(detector_records(spark, sf), "7")


@query(f"WITH {_REC_SQL}, d AS (SELECT CASE WHEN p_name = 'click' THEN q_name WHEN q_name = '3' THEN p_name ELSE p_name || '|' || q_name || '(neither-Ia)' END AS donor FROM rec) SELECT donor, count(*) AS n FROM d GROUP BY 1")
def det_donors(spark, sf):
    rec = detector_records(spark, sf)
    d = detect.donor(F.col("p_name") == "click", F.col("q_name") == "3", F.col("p_name"), F.col("q_name"))
    return rec.groupBy(d.alias("donor")).agg(F.count("*").alias("n"))


_CALLS_SQL = "calls AS (SELECT CAST(vec_id AS VARCHAR) AS accession, abs(embedding[1])::DOUBLE AS phi_perm_p, CASE WHEN vec_id % 5 > 0 THEN abs(embedding[2])::DOUBLE END AS nss_p, abs(embedding[3])::DOUBLE AS maxchi_p FROM embeddings)"


def calls(spark: SparkSession, sf: str) -> DataFrame:
    e = lambda i: F.abs(F.col("embedding")[i]).cast("double")
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("accession"), e(0).alias("phi_perm_p"), F.when(F.col("vec_id") % 5 > 0, e(1)).alias("nss_p"), e(2).alias("maxchi_p"))


_VOTES = "(coalesce(CAST(phi_perm_p < 0.05 AS INT), 0) + coalesce(CAST(nss_p < 0.05 AS INT), 0) + coalesce(CAST(maxchi_p < 0.05 AS INT), 0))"


@query(f"WITH {_CALLS_SQL} SELECT accession, {_VOTES} AS n_sig, {_VOTES} >= 2 AS phipack_call FROM calls")
def det_votes(spark, sf):
    v = detect.votes(F.col("phi_perm_p"), F.col("nss_p"), F.col("maxchi_p"))
    return calls(spark, sf).select("accession", v.alias("n_sig"), (v >= 2).alias("phipack_call"))


@query(f"WITH {_CALLS_SQL} SELECT CAST(k AS INTEGER) AS k, count(*) FILTER ({_VOTES} >= k) AS n_candidates, coalesce(bool_or({_VOTES} >= k AND accession = '7'), false) AS control_in_set FROM calls, (SELECT unnest([1, 2, 3]) AS k) GROUP BY 1")
def det_agreement_sweep(spark, sf):
    return detect.agreement_sweep(calls(spark, sf), "7")


@query(f"WITH {_REC_SQL} SELECT p_name, count(DISTINCT child) AS flagged FROM rec WHERE p IS NOT NULL GROUP BY 1")
def det_by_condition(spark, sf):
    return detect.flagged_by_condition(detector_records(spark, sf), "p_name")


@query(f"WITH {_REC_SQL} SELECT child AS accession, count(DISTINCT p_name) AS n_detectors, count(DISTINCT p_name) >= 2 AS candidate FROM rec WHERE p < 0.05 GROUP BY 1")
def det_consensus(spark, sf):
    return detect.consensus(detector_records(spark, sf).where("p < 0.05").select(F.col("child").alias("accession"), F.col("p_name").alias("detector")))


# --- dating ----------------------------------------------------------------------------

_COUNTS_SQL = "c AS (SELECT user_id % 4 AS g, CAST(date_diff('day', DATE '0001-01-01', min(ts)::DATE) + 1 AS DOUBLE) + user_id % 97 AS day, count(*)::DOUBLE AS k FROM events GROUP BY user_id)"
_GRID_SQL = "p AS (SELECT 738600 + i * (200.0 / 39) AS t0, exp(ln(1e-6) + j * (ln(1e-2 / 1e-6) / 39)) AS rate FROM range(40) a(i), range(40) b(j))"


def counts(spark: SparkSession, sf: str) -> DataFrame:
    """Users as genomes: how many events, and a day."""
    day = S.ordinal(F.to_date(F.min("ts"))).cast("double") + F.col("user_id") % 97
    return table(spark, sf, "events").groupBy("user_id").agg(day.alias("day"), F.count("*").cast("double").alias("k")).select((F.col("user_id") % 4).alias("g"), "day", "k")


def _grid(spark: SparkSession) -> DataFrame:
    return dating.grid(spark, 738600.0, 738800.0, 40, 1e-6, 1e-2, 40)


_NLL = "CASE WHEN min(day - t0) < 0 THEN 1e18 + sum(greatest(t0 - day, 0)) * 1e6 WHEN min({mu}) <= 0 THEN 1e18 ELSE -sum(CASE WHEN {mu} > 0 THEN k * ln({mu}) - {mu} END) END"
_SAT, _LIN = "(23140.0 * (1 - exp(-rate * greatest(day - t0, 0))))", "(23140.0 * rate * greatest(day - t0, 0))"


@query(f"WITH {_COUNTS_SQL}, {_GRID_SQL}, l AS (SELECT g, t0, rate, {_NLL.format(mu=_SAT)} AS nll FROM c, p GROUP BY 1, 2, 3) SELECT g, round(t0, 3) AS t0, round(log10(rate), 3) AS log_rate, round(nll, 3) AS nll FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY nll, t0, rate) AS n FROM l) WHERE n = 1")
def ml_grid_saturation(spark, sf):
    fit = dating.best_fit(dating.likelihoods(counts(spark, sf), _grid(spark), 23140.0, "saturation", "g"), "g")
    return fit.select("g", F.round("t0", 3).alias("t0"), F.round(F.log10("rate"), 3).alias("log_rate"), F.round("nll", 3).alias("nll"))


@query(f"WITH {_COUNTS_SQL}, {_GRID_SQL}, l AS (SELECT t0, rate, {_NLL.format(mu=_LIN)} AS nll FROM c, p GROUP BY 1, 2), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t0 ORDER BY nll, rate) AS n FROM l) WHERE n = 1) SELECT round(t0, 3) AS t0, round(log10(rate), 3) AS log_rate, round(nll - (SELECT min(nll) FROM m), 3) AS delta_nll FROM m")
def ml_ridge_linear(spark, sf):
    out = dating.ridge(dating.likelihoods(counts(spark, sf), _grid(spark), 23140.0, "linear"))
    return out.select(F.round("t0", 3).alias("t0"), F.round(F.log10("rate"), 3).alias("log_rate"), F.round("delta_nll", 3).alias("delta_nll"))


@query(f"""WITH {_COUNTS_SQL}, t AS (SELECT (738700 + i)::DOUBLE AS t0 FROM range(41) r(i)), s AS (SELECT g, t0, sum(k) AS sk, sum(day - t0) AS sa, sum(k * ln(day - t0)) AS skl FROM c, t GROUP BY 1, 2 HAVING min(day - t0) > 0)
 SELECT g, t0, round(log10(sk / (23140 * sa)), 6) AS log_rate, round(-(sk * ln(23140 * sk / (23140 * sa)) + skl - sk), 4) AS nll FROM s""")
def ml_profile(spark, sf):
    dates = spark.range(41).select((F.lit(738700.0) + F.col("id")).alias("t0"))
    return dating.linear_profile(counts(spark, sf), dates, 23140.0, "g").select("g", "t0", r6(F.log10("rate"), "log_rate"), F.round("nll", 4).alias("nll"))


@query(f"WITH {_COUNTS_SQL} SELECT g, count(*) AS n, round(regr_slope(k, day), 6) AS slope, round(regr_intercept(k, day), 2) AS intercept, round(-regr_intercept(k, day) / regr_slope(k, day), 1) AS t0 FROM c GROUP BY 1")
def ml_root_to_tip(spark, sf):
    return dating.root_to_tip(counts(spark, sf), "g").select("g", "n", r6("slope", "slope"), F.round("intercept", 2).alias("intercept"), F.round("t0", 1).alias("t0"))


@query()
def ml_fit(spark, sf):
    return dating.fit_groups(counts(spark, sf), 23140.0, 738000.0, group="g")


@query()
def ml_bootstrap(spark, sf):
    return dating.bootstrap(counts(spark, sf), 23140.0, 738000.0, model="linear", group="g")


@query()
def ml_trajectories(spark, sf):
    return dating.start_trajectories(counts(spark, sf), 23140.0, 738000.0)


# --- trees -----------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT n_nationkey + 1 AS id, CASE WHEN n_nationkey = 0 THEN NULL ELSE (n_nationkey + 1) // 2 END AS parent, n_name AS label, 1.0::DOUBLE AS dist FROM nation),
 up AS (SELECT id, label, id AS ancestor, parent AS above, 0 AS depth, 0.0::DOUBLE AS dist, dist AS last FROM e
  UNION ALL SELECT up.id, up.label, e.id, e.parent, up.depth + 1, up.dist + up.last, e.dist FROM up JOIN e ON up.above = e.id) SELECT CAST(id AS BIGINT) AS id, label, CAST(ancestor AS BIGINT) AS ancestor, depth, dist FROM up""")
def tr_ancestors(spark, sf):
    """Nations as a binary tree by number."""
    n = F.col("n_nationkey").cast("long")
    edges = table(spark, sf, "nation").select((n + 1).alias("id"), F.when(n > 0, F.floor((n + 1) / 2)).alias("parent"), F.col("n_name").alias("label"), F.lit(1.0).alias("dist"))
    return cohort.ancestors(edges)


from cohortlens.plans import clock, more, mosaic, roundtrip  # noqa: E402, F401  (add their queries to the two tables)
