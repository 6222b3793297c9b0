"""Further queries: panels, ancestral branches, annotation, small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import cohort, dating, detect, panels, sequence, stats
from cohortlens.plans.catalog import _CALLS_SQL, _COUNTS_SQL, _GRID_SQL, _NLL, _REC_SQL, _SAT, _grid, calls, counts, detector_records, query, r6, reference, sequences, table

# --- panels ----------------------------------------------------------------------------


@query("SELECT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1 AND length(text) >= 500")
def pn_good_quality(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    d = d.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("qc_overall"), F.length("text").alias("seq_length"))
    return panels.good_quality(d, 500).select("doc_id")


@query("SELECT clade, count(doc_id) AS n FROM (SELECT unnest(['en', 'fr', 'xx']) AS clade) LEFT JOIN documents ON lang = clade GROUP BY 1")
def pn_clade_pools(spark, sf):
    return panels.clade_pools(table(spark, sf, "documents").select(F.col("lang").alias("clade")), ["en", "fr", "xx"])


@query("SELECT o_orderstatus AS panel, year(o_orderdate) || '|' || o_orderpriority AS stratum, count(*) AS n FROM orders GROUP BY 1, 2")
def pn_strata(spark, sf):
    o = table(spark, sf, "orders")
    return panels.strata_counts(o.select(F.col("o_orderstatus").alias("panel"), F.year("o_orderdate").cast("string").alias("year_stratum"), F.col("o_orderpriority").alias("who_region")))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def pn_composition(spark, sf):
    return panels.composition(table(spark, sf, "nation"), "n_regionkey")


@query("""WITH c AS (SELECT CAST(seed AS INTEGER) AS seed, c_custkey, c_mktsegment || '|' || c_nationkey AS s, md5(seed || ':' || c_custkey) AS h FROM customer, (SELECT unnest([1, 2, 3, 4, 5]) AS seed)),
 k AS (SELECT *, row_number() OVER (PARTITION BY seed, s ORDER BY h, c_custkey) AS k FROM c),
 t AS (SELECT *, CASE WHEN k <= 2 THEN 0 ELSE k END AS turn, CASE WHEN k <= 2 THEN h ELSE md5(seed || ':' || s) END AS place FROM k WHERE k <= 6),
 o AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY turn, place, k, c_custkey) AS nth FROM t)
 SELECT seed, c_custkey, CASE WHEN k <= 2 THEN 1 ELSE 2 END AS allocation_pass FROM o WHERE nth <= 300""")
def pn_redraws(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return panels.redraws(df, ["c_mktsegment", "c_nationkey"], "c_custkey", 300).select("seed", "c_custkey", "allocation_pass")


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS n_in_block, count(*) FILTER (o_orderstatus = 'F') = 50 AS whole FROM orders WHERE o_orderkey <= 50")
def pn_block(spark, sf):
    o = table(spark, sf, "orders")
    return panels.block_integrity(o, o.where("o_orderstatus = 'F'"), "o_orderkey", "o_orderkey", 50)


@query("""WITH a AS (SELECT CAST(n_nationkey AS VARCHAR) AS a FROM nation), p AS (SELECT CAST(s_suppkey AS VARCHAR) AS a FROM supplier WHERE s_suppkey BETWEEN 20 AND 22 UNION SELECT '7'),
 o AS (SELECT a FROM p WHERE a IN (FROM a)), c AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS candidate FROM supplier WHERE s_suppkey <= 40),
 n AS (SELECT candidate, (SELECT count(*) FROM o) + CASE WHEN candidate IN (FROM a) AND candidate NOT IN (FROM o) THEN 1 ELSE 0 END AS size, candidate IN (FROM a) AS found FROM c)
 SELECT candidate, size, CASE WHEN NOT found THEN 'missing_from_alignment' WHEN size < 5 THEN 'subset_too_small_' || size END AS reason FROM n""")
def pn_subsets(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("accession"), "s_suppkey")
    aligned = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("accession"))
    return panels.subsets(s.where("s_suppkey <= 40"), s.where("s_suppkey BETWEEN 20 AND 22"), "7", aligned, 5)


@query("""WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount > 0.09)
 SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, CASE WHEN a.l_partkey IS NULL THEN 'b' WHEN b.l_partkey IS NULL THEN 'a' ELSE 'both' END AS side FROM a FULL JOIN b ON a.l_partkey = b.l_partkey""")
def set_overlap(spark, sf):
    li = table(spark, sf, "lineitem")
    return panels.overlap(li.where("l_quantity > 49"), li.where("l_discount > 0.09"), "l_partkey")


@query(f"""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 46), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.09),
 f AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AND b.k IS NOT NULL AS shared FROM a FULL JOIN b ON a.k = b.k),
 d AS (SELECT shared, r, ('0x' || substr(md5('42:' || r || ':' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM f, (SELECT unnest(range(1, 1001)) AS r)),
 w AS (SELECT shared, r, len(list_filter({cohort.POISSON_ONE}::DOUBLE[], lambda c: c <= u)) AS n FROM d),
 j AS (SELECT r, sum(CASE WHEN shared THEN n ELSE 0 END) / nullif(sum(n), 0) AS j FROM w GROUP BY r), o AS (SELECT count(*) FILTER (shared) / count(*) AS j FROM f)
 SELECT round(max(o.j), 6) AS jaccard, round(quantile_cont(j.j, 0.025), 6) AS low, round(quantile_cont(j.j, 0.975), 6) AS high, max(o.j) >= 0.8 AS similar FROM j, o""")
def set_jaccard_interval(spark, sf):
    li = table(spark, sf, "lineitem")
    out = cohort.jaccard_interval(li.where("l_quantity > 46"), li.where("l_discount > 0.09"), "l_partkey")
    return out.select(r6("jaccard", "jaccard"), r6("low", "low"), r6("high", "high"), "similar")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey + 1 AS id, CASE WHEN n_nationkey = 0 THEN NULL ELSE (n_nationkey + 1) // 2 END AS parent, n_name AS label, 1.0::DOUBLE + n_nationkey % 3 AS dist, n_regionkey FROM nation),
 up AS (SELECT id, id AS ancestor, parent AS above, 0 AS depth, 0.0::DOUBLE AS dist, dist AS last FROM e
  UNION ALL SELECT up.id, e.id, e.parent, up.depth + 1, up.dist + up.last, e.dist FROM up JOIN e ON up.above = e.id),
 kept AS (SELECT id FROM e WHERE n_regionkey IN (1, 2) AND id NOT IN (SELECT parent FROM e WHERE parent IS NOT NULL)),
 live AS (SELECT DISTINCT ancestor AS id FROM up WHERE id IN (FROM kept)),
 nodes AS (SELECT id FROM kept UNION SELECT id FROM e WHERE parent IS NULL UNION SELECT parent FROM e WHERE id IN (FROM live) AND parent IS NOT NULL GROUP BY parent HAVING count(*) > 1),
 above AS (SELECT id, arg_min(ancestor, depth) AS parent, arg_min(dist, depth) AS dist FROM up WHERE depth > 0 AND ancestor IN (FROM nodes) GROUP BY id)
 SELECT CAST(e.id AS BIGINT) AS id, CAST(above.parent AS BIGINT) AS parent, label, coalesce(above.dist, e.dist) AS dist, e.id IN (FROM kept) AS is_leaf FROM e LEFT JOIN above ON e.id = above.id WHERE e.id IN (FROM nodes)""")
def tr_prune(spark, sf):
    """Nations as a binary tree by number, with the leaves of two regions."""
    n = F.col("n_nationkey").cast("long")
    nations = table(spark, sf, "nation")
    edges = nations.select((n + 1).alias("id"), F.when(n > 0, F.floor((n + 1) / 2)).alias("parent"), F.col("n_name").alias("label"), (1.0 + n % 3).alias("dist"))
    inner = edges.where("parent IS NOT NULL").select(F.col("parent").alias("id"), F.lit(False).alias("is_leaf")).distinct()
    edges = edges.join(inner, "id", "left").withColumn("is_leaf", F.coalesce("is_leaf", F.lit(True)))
    return cohort.prune(edges, nations.where("n_regionkey IN (1, 2)").select(F.col("n_name").alias("label")))


_DEEP_SQL = """e AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN greatest(1, c_custkey - 1 - c_custkey % 3) END AS parent, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS label, 0.5::DOUBLE + c_custkey % 5 AS dist FROM customer),
 leaf AS (SELECT * FROM e WHERE id NOT IN (SELECT parent FROM e WHERE parent IS NOT NULL))"""


def deep_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as a tree whose depth grows with them: each hangs on one a little before it;
    every fourth has no name."""
    k = F.col("c_custkey").cast("long")
    c = table(spark, sf, "customer").select(k.alias("id"), F.when(k > 1, F.greatest(F.lit(1).cast("long"), k - 1 - k % 3)).alias("parent"), F.when(k % 4 == 0, "").otherwise(F.col("c_name")).alias("label"), (0.5 + k % 5).alias("dist"), "c_nationkey")
    inner = c.where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct().withColumn("inner", F.lit(True))
    return c.join(inner.hint(cohort.BOTH_SORTED), "id", "left").select("id", "parent", "label", "dist", F.col("inner").isNull().alias("is_leaf"), "c_nationkey")


@query(f"""WITH RECURSIVE {_DEEP_SQL}, w AS (SELECT id, label, id AS node, 0.0::DOUBLE AS gone FROM leaf
  UNION ALL SELECT w.id, w.label, e.parent, w.gone + e.dist FROM w JOIN e ON w.node = e.id WHERE e.parent IS NOT NULL AND w.gone + e.dist < 40),
 t AS (SELECT id, any_value(label) AS label, arg_max(node, gone) AS node FROM w GROUP BY id)
 SELECT t.label, CASE WHEN e.label <> '' THEN e.label ELSE 'node_' || e.id END AS cluster FROM t JOIN e ON t.node = e.id""")
def tr_clusters(spark, sf):
    return cohort.tree_clusters(deep_tree(spark, sf), 40.0)


@query(f"""WITH RECURSIVE {_DEEP_SQL}, tip AS (SELECT id FROM leaf JOIN customer ON id = c_custkey WHERE label <> '' AND c_nationkey = 7 AND c_custkey > 60),
 up AS (SELECT id, id AS ancestor, 0 AS depth FROM tip UNION ALL SELECT up.id, e.parent, depth + 1 FROM up JOIN e ON up.ancestor = e.id WHERE e.parent IS NOT NULL),
 shared AS (SELECT ancestor, max(depth) AS depth FROM up GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM tip))
 SELECT (SELECT arg_min(ancestor, depth) FROM shared) AS id, (SELECT arg_min(label, depth) FROM shared JOIN e ON ancestor = e.id WHERE label <> '') AS label, (SELECT count(*) FROM tip) AS n_tips""")
def tr_mrca(spark, sf):
    tree = deep_tree(spark, sf)
    return cohort.lowest_common(tree, tree.where("c_nationkey = 7 AND id > 60 AND label <> ''").select("label"))


@query("SELECT doc_id AS accession, coalesce(nullif(lang, 'en'), 'Ib-global') AS cluster_id FROM documents")
def tr_lineage_clusters(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("accession"), F.nullif(F.col("lang"), F.lit("en")).alias("lineage"))
    return panels.lineage_clusters(d)


# --- small aggregates and statistics ---------------------------------------------------


@query("SELECT event_type AS basin, count(*) AS n, arg_min(event_id::DOUBLE, (value, event_id)) AS t0, min(value) AS nll FROM events WHERE value IS NOT NULL GROUP BY 1")
def agg_basins(spark, sf):
    e = table(spark, sf, "events").where("value IS NOT NULL")
    fits = e.select(F.col("event_type").alias("basin"), F.col("event_id").cast("double").alias("t0"), F.lit(1.0).alias("rate"), F.col("value").alias("nll"))
    return dating.basins(fits).select("basin", "n", "t0", "nll")


@query("SELECT count(*) AS intervals, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bp FROM lineitem")
def agg_masked_bp(spark, sf):
    start = F.col("l_linenumber").cast("long") * 10
    return sequence.masked_bp(table(spark, sf, "lineitem").select(start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end")))


@query("SELECT max(o_totalprice) AS max_delta, count(o_totalprice) AS n_clusters FROM orders")
def agg_largest_delta(spark, sf):
    return dating.largest_delta(table(spark, sf, "orders"), "o_totalprice")


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_tax) / sum(l_discount), 6) AS pooled_fraction FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1")
def agg_dated_fraction(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("date", F.when(F.col("l_orderkey") % 3 > 0, F.col("l_shipdate")))
    return stats.dated_fraction(li, "date", "l_tax", "l_discount", "l_returnflag").withColumn("pooled_fraction", r6("pooled_fraction"))


@query(f"WITH {_CALLS_SQL} SELECT accession, coalesce(phi_perm_p < 0.05, false) AND coalesce(nss_p < 0.05, false) AS called FROM calls")
def det_both(spark, sf):
    return calls(spark, sf).select("accession", panels.both_detectors(F.col("phi_perm_p") < 0.05, F.col("nss_p") < 0.05).alias("called"))


@query(f"""WITH {_REC_SQL}, c AS (SELECT child AS accession, count(DISTINCT p_name) >= 2 AS candidate FROM rec WHERE p < 0.05 GROUP BY 1),
 k AS (SELECT count(*) FILTER (candidate AND accession <> '7') AS k, coalesce(bool_or(candidate AND accession = '7'), false) AS h4, 1.959963984540054 AS z, 100000.0 AS n FROM c), p AS (SELECT *, k / n AS p FROM k)
 SELECT k, round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4.0*n*n)) / (1 + z*z/n)), 6) AS low, round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4.0*n*n)) / (1 + z*z/n)), 6) AS high, k >= 1 AS h3, h4 FROM p""")
def det_hypotheses(spark, sf):
    found = detect.consensus(detector_records(spark, sf).where("p < 0.05").select(F.col("child").alias("accession"), F.col("p_name").alias("detector")))
    return detect.hypotheses(found, "7", 100_000).select("k", r6("low", "low"), r6("high", "high"), "h3", "h4")


@query("""WITH l AS (SELECT l_orderkey AS k, sum(l_quantity) AS a, sum(l_tax) AS b FROM lineitem GROUP BY 1), j AS (SELECT l.a AS a1, round(l.b, 6) AS b1, o_totalprice AS a2, o_custkey AS b2 FROM l JOIN orders ON k = o_orderkey),
 r AS (SELECT rank() OVER (ORDER BY a1) + (count(*) OVER (PARTITION BY a1) - 1) / 2.0 AS a1, rank() OVER (ORDER BY b1) + (count(*) OVER (PARTITION BY b1) - 1) / 2.0 AS b1,
   rank() OVER (ORDER BY a2) + (count(*) OVER (PARTITION BY a2) - 1) / 2.0 AS a2, rank() OVER (ORDER BY b2) + (count(*) OVER (PARTITION BY b2) - 1) / 2.0 AS b2 FROM j)
 SELECT 'a' AS measure, count(*) AS n, round(corr(a1, a2), 6) AS rho FROM r UNION ALL SELECT 'b', count(*), round(corr(b1, b2), 6) FROM r""")
def st_cross_spearman(spark, sf):
    left = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("a"), F.round(F.sum("l_tax"), 6).alias("b"))
    right = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("a"), F.col("o_custkey").alias("b"))
    return stats.cross_spearman(left, right, "k", ["a", "b"]).withColumn("rho", r6("rho"))


@query("""WITH z AS (SELECT s_suppkey, (s_suppkey % 120) / 10.0 - 1 AS z FROM supplier), d AS (SELECT *, abs(z) AS a, exp(-z * z / 2) / sqrt(2 * pi()) AS d FROM z),
 t AS (SELECT *, CASE WHEN a < 2.5 THEN 0.5 - d * list_sum(list_transform(range(0, 51), lambda n: exp((2 * n + 1) * ln(greatest(a, 1e-300)) - (lgamma(2 * n + 2) - n * ln(2.0) - lgamma(n + 1)))))
   ELSE d / list_reduce(list_transform(range(120, 0, -1), lambda k: k::DOUBLE), lambda s, k: a + k / s, a) END AS upper FROM d)
 SELECT s_suppkey, round(ln(CASE WHEN z >= 0 THEN upper ELSE 1 - upper END), 8) AS log_tail FROM t""")
def st_normal_tail(spark, sf):
    z = (F.col("s_suppkey") % 120) / 10.0 - 1
    return table(spark, sf, "supplier").select("s_suppkey", F.round(F.ln(stats.normal_tail(z)), 8).alias("log_tail"))


_P_SQL = """p AS (SELECT *, (n - 2) / 2.0 AS a, (1 - abs(rho)) / 4000 AS h FROM c),
 i AS (SELECT *, (SELECT sum(CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(0, 1 - (abs(rho) + k * h) ** 2), a - 1)) FROM (SELECT unnest(range(0, 4001)) AS k)) * h / 3 AS area FROM p)"""


@query(f"""WITH r AS (SELECT rank() OVER (ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_acctbal) - 1) / 2.0 AS x, rank() OVER (ORDER BY s_nationkey) + (count(*) OVER (PARTITION BY s_nationkey) - 1) / 2.0 AS y FROM supplier),
 c AS (SELECT count(*) AS n, corr(x, y) AS rho FROM r), {_P_SQL} SELECT n, round(rho, 6) AS rho, round(2 * area * exp(lgamma(a + 0.5) - lgamma(a)) / sqrt(pi()), 6) AS p FROM i""")
def st_spearman_p(spark, sf):
    """The chance of a rank correlation as large, which SQL integrates by Simpson's rule."""
    return stats.spearman(table(spark, sf, "supplier"), "s_acctbal", "s_nationkey").select("n", r6("rho", "rho"), r6("p", "p"))


@query("""WITH r AS (SELECT s_nationkey < 12 AS f, rank() OVER (ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_acctbal) - 1) / 2.0 AS r FROM supplier),
 t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM supplier WHERE s_acctbal IS NOT NULL GROUP BY s_acctbal)),
 u AS (SELECT count(*) FILTER (f)::DOUBLE AS n1, count(*) FILTER (NOT f)::DOUBLE AS n2, sum(r) FILTER (f) - count(*) FILTER (f) * (count(*) FILTER (f) + 1) / 2.0 AS u FROM r),
 z AS (SELECT *, (u - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u, t), d AS (SELECT *, abs(z) AS a, exp(-z * z / 2) / sqrt(2 * pi()) AS d FROM z),
 p AS (SELECT *, CASE WHEN a < 2.5 THEN 0.5 - d * list_sum(list_transform(range(0, 51), lambda n: exp((2 * n + 1) * ln(greatest(a, 1e-300)) - (lgamma(2 * n + 2) - n * ln(2.0) - lgamma(n + 1)))))
   ELSE d / list_reduce(list_transform(range(120, 0, -1), lambda k: k::DOUBLE), lambda s, k: a + k / s, a) END AS upper FROM d)
 SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, round(u, 6) AS u, round(z, 6) AS z, round(CASE WHEN z >= 0 THEN upper ELSE 1 - upper END, 8) AS p_greater FROM p""")
def st_rank_sum_p(spark, sf):
    df = table(spark, sf, "supplier").select("s_acctbal", (F.col("s_nationkey") < 12).alias("f"))
    return stats.rank_sum(df, "s_acctbal", "f").select("n1", "n2", r6("u", "u"), r6("z", "z"), F.round("p_greater", 8).alias("p_greater"))


# --- sequences -------------------------------------------------------------------------

_WHOLE = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
_TIPS_SQL = f"""ref AS (SELECT {_WHOLE} AS rs FROM documents WHERE doc_id = 0),
 tip AS (SELECT s_suppkey AS accession, CASE WHEN s_suppkey % 3 = 0 THEN 'IIb' ELSE 'Ib' END AS clade,
   substr(rs, 1, s_suppkey % 90) || reverse(substr(rs, s_suppkey % 90 + 1, 40)) || substr(rs, s_suppkey % 90 + 41) || CASE WHEN s_suppkey % 10 = 4 THEN 'A' ELSE '' END AS seq FROM supplier, ref)"""
_CHANGES_SQL = f"""{_TIPS_SQL}, v AS (SELECT accession, CAST(pos AS INTEGER) AS pos, substr(rs, pos, 1) AS ref, substr(seq, pos, 1) AS alt,
   CASE WHEN substr(rs, pos, 1) = 'C' AND substr(seq, pos, 1) = 'T' AND pos > 1 AND substr(rs, pos - 1, 1) = 'T' THEN 'TC' WHEN substr(rs, pos, 1) = 'G' AND substr(seq, pos, 1) = 'A' AND substr(rs, pos + 1, 1) = 'A' THEN 'GA' END AS context, rs
   FROM (SELECT accession, seq, rs, unnest(range(1, length(rs) + 1)) AS pos FROM tip, ref WHERE clade = 'Ib' AND length(seq) = length(rs)) WHERE substr(rs, pos, 1) <> substr(seq, pos, 1))"""


def tips(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as tips: the first document's bases with a stretch turned round, some longer."""
    k = F.col("s_suppkey") % 90
    cut = F.concat(F.col("rs").substr(F.lit(1), k.cast("int")), F.reverse(F.col("rs").substr((k + 1).cast("int"), F.lit(40))), F.col("rs").substr((k + 41).cast("int"), F.length("rs")), F.when(F.col("s_suppkey") % 10 == 4, "A").otherwise(""))
    ref = F.broadcast(reference(spark, sf).select(F.col("seq").alias("rs")))  # one row
    return table(spark, sf, "supplier").join(ref).select(F.col("s_suppkey").alias("accession"), F.when(F.col("s_suppkey") % 3 == 0, "IIb").otherwise("Ib").alias("clade"), cut.alias("seq"))


@query(f"""WITH {_CHANGES_SQL}, c AS (SELECT accession, count(*) AS t, count(context) AS a FROM v GROUP BY 1)
 SELECT tip.accession, coalesce(t, 0) AS total_snvs, coalesce(a, 0) AS apobec3_snvs, coalesce(t - a, 0) AS non_apobec3_snvs, round(CASE WHEN t > 0 THEN a * 1.0 / t ELSE 0 END, 6) AS apobec3_fraction
 FROM tip JOIN ref ON length(seq) = length(rs) LEFT JOIN c ON tip.accession = c.accession WHERE clade = 'Ib'""")
def seq_branch_counts(spark, sf):
    return sequence.branch_counts(tips(spark, sf), reference(spark, sf))[0].withColumn("apobec3_fraction", r6("apobec3_fraction"))


@query(f"WITH {_TIPS_SQL} SELECT count(*) AS n_tips, count(*) FILTER (length(seq) <> length(rs)) AS n_skipped FROM tip, ref WHERE clade = 'Ib'")
def seq_branch_state(spark, sf):
    return sequence.branch_counts(tips(spark, sf), reference(spark, sf))[1]


_GENES = [("g1", 0, 30), ("g2", 20, 60), ("g3", 70, 5000)]


@query(f"""WITH {_CHANGES_SQL}, g AS (SELECT * FROM (VALUES ('g1', 0, 30), ('g2', 20, 60), ('g3', 70, 5000)) t(gene, s, e))
 SELECT accession, pos, ref, alt, context, substr('N' || rs || 'N', pos, 3) AS trinucleotide, (SELECT arg_min(gene, (s, gene)) FROM g WHERE pos - 1 >= s AND pos - 1 < e) AS gene FROM v""")
def seq_annotated(spark, sf):
    ref = reference(spark, sf)
    genes = spark.createDataFrame(_GENES, "gene string, start int, end int")
    return sequence.annotate(sequence.variants(tips(spark, sf).where("clade = 'Ib'"), ref), ref, genes).select("accession", "pos", "ref", "alt", "context", "trinucleotide", "gene")


_EXONS = [("fwd", "+", 0, 31), ("fwd", "+", 40, 76), ("rev", "-", 20, 50), ("rev", "-", 70, 130), ("short", "+", 100, 104)]
_CODE_SQL = lambda c: f"CASE WHEN regexp_full_match({c}, '[ACGT]{{{{3}}}}') THEN substr('{sequence.GENETIC_CODE}', 16 * (instr('TCAG', substr({c}, 1, 1)) - 1) + 4 * (instr('TCAG', substr({c}, 2, 1)) - 1) + instr('TCAG', substr({c}, 3, 1)), 1) END"


@query(f"""WITH {_CHANGES_SQL}, x AS (SELECT * FROM (VALUES {", ".join(map(str, _EXONS))}) t(gene, strand, s, e)),
 o AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY gene ORDER BY CASE WHEN strand = '-' THEN -s ELSE s END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM x),
 c AS (SELECT gene, string_agg(CASE WHEN strand = '-' THEN reverse(translate(substr(rs, s + 1, e - s), 'ACGT', 'TGCA')) ELSE substr(rs, s + 1, e - s) END, '' ORDER BY o) AS coding FROM o, ref GROUP BY gene),
 h AS (SELECT v.accession, v.pos, v.ref, v.alt, o.gene, coding, CAST(o + CASE WHEN strand = '-' THEN e - pos ELSE pos - 1 - s END AS BIGINT) AS p, CASE WHEN strand = '-' THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS b FROM v JOIN o ON pos - 1 >= s AND pos - 1 < e JOIN c ON c.gene = o.gene),
 w AS (SELECT *, substr(coding, p // 3 * 3 + 1, 3) AS was FROM h), n AS (SELECT *, substr(was, 1, p % 3) || b || substr(was, p % 3 + 2) AS now FROM w),
 a AS (SELECT *, {_CODE_SQL("was").format()} AS ref_aa, {_CODE_SQL("now").format()} AS alt_aa FROM n)
 SELECT accession, pos, ref, alt, gene, CAST(p // 3 + 1 AS INTEGER) AS codon, ref_aa, alt_aa, CASE WHEN ref_aa = alt_aa THEN 'synonymous' WHEN alt_aa = '*' THEN 'stop_gained' WHEN ref_aa = '*' THEN 'stop_lost' WHEN ref_aa IS NOT NULL AND alt_aa IS NOT NULL THEN 'missense' END AS effect FROM a""")
def seq_codon_effects(spark, sf):
    ref = reference(spark, sf)
    exons = spark.createDataFrame(_EXONS, "gene string, strand string, start int, end int")
    return sequence.codon_effects(sequence.variants(tips(spark, sf).where("clade = 'Ib'"), ref), ref, exons)


@query(f"""WITH s AS (SELECT doc_id AS accession, {_WHOLE} AS seq FROM documents), c AS (SELECT accession, seq || reverse(translate(substr(lower(seq), 1, 1000 + accession % 500), 'acgt', 'tgca')) AS seq FROM s WHERE length(seq) >= 1500),
 h AS (SELECT accession, upper(seq) AS seq, reverse(translate(upper(seq), 'ACGT', 'TGCA')) AS rc, least(20000, length(seq) // 2) AS n FROM c),
 p AS (SELECT accession, n, coalesce((SELECT min(i) FROM (SELECT unnest(range(1, n + 1)) AS i) WHERE substr(seq, i, 1) <> substr(rc, i, 1)) - 1, n) AS k FROM h)
 SELECT accession, CAST(CASE WHEN k >= 1000 THEN k ELSE 0 END AS INTEGER) AS repeat_bp FROM p""")
def seq_terminal_repeat(spark, sf):
    """Long documents whose end repeats their beginning, reverse complemented, in lower case."""
    s = sequences(spark, sf).where("length(seq) >= 1500")
    end = sequence.reverse_complement(F.lower("seq").substr(F.lit(1), (1000 + F.col("accession") % 500).cast("int")))
    return s.select("accession", sequence.terminal_repeat(F.concat("seq", end)).cast("int").alias("repeat_bp"))


@query("""WITH s AS (SELECT doc_id AS accession, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTAC-TANGTACGTACG-AC') AS seq FROM documents),
 b AS (SELECT CAST(pos AS INTEGER) AS pos, substr(seq, pos, 1) AS base FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS pos FROM s))
 SELECT pos, CAST(count(DISTINCT base) FILTER (base IN ('A', 'C', 'G', 'T')) AS INTEGER) AS n_bases, round(avg(CASE WHEN base IN ('N', '-') THEN 1.0 ELSE 0.0 END), 6) AS missing,
  count(DISTINCT base) FILTER (base IN ('A', 'C', 'G', 'T')) >= 2 AS variable, avg(CASE WHEN base IN ('N', '-') THEN 1.0 ELSE 0.0 END) >= 0.1 AS ambiguous FROM b GROUP BY 1""")
def seq_gap_columns(spark, sf):
    """Columns of whole texts in which some letters are gaps or N."""
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTAC-TANGTACGTACG-AC")
    counts = sequence.column_counts(table(spark, sf, "documents").select(seq.alias("seq")))
    return sequence.column_statistics(counts).withColumn("missing", r6("missing"))


# --- dating ----------------------------------------------------------------------------


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median_t0, round(quantile_cont(value, 0.05), 6) AS low_t0, round(quantile_cont(value, 0.95), 6) AS high_t0, count(value) AS n FROM events GROUP BY 1")
def ml_emergence(spark, sf):
    out = dating.emergence(table(spark, sf, "events").select("event_type", F.col("value").alias("t0")), "event_type")
    return out.select("event_type", *[r6(c, c) for c in ("median_t0", "low_t0", "high_t0")], "n")


@query(f"WITH {_COUNTS_SQL}, {_GRID_SQL}, l AS (SELECT g, t0, rate, {_NLL.format(mu=_SAT)} AS nll FROM c, p GROUP BY 1, 2, 3) SELECT g, round(t0, 3) AS t0, round(log10(arg_min(rate, (nll, rate))), 3) AS log_rate, round(min(nll), 3) AS nll FROM l GROUP BY g, l.t0")
def ml_saturation_profile(spark, sf):
    out = dating.saturation_profile(dating.likelihoods(counts(spark, sf), _grid(spark), 23140.0, "saturation", "g"), "g")
    return out.select("g", F.round("t0", 3).alias("t0"), F.round(F.log10("rate"), 3).alias("log_rate"), F.round("nll", 3).alias("nll"))


_TWO = "(23140.0 * 0.75 * (1 - exp(-rate * 4 / 3 * greatest(day - t0, 0))))"


@query(f"WITH {_COUNTS_SQL}, {_GRID_SQL}, l AS (SELECT g, t0, rate, {_NLL.format(mu=_TWO)} AS nll FROM c, p GROUP BY 1, 2, 3) SELECT g, round(t0, 3) AS t0, round(log10(rate), 3) AS log_rate, round(nll, 3) AS nll FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY nll, t0, rate) AS n FROM l) WHERE n = 1")
def ml_grid_twofold(spark, sf):
    fit = dating.best_fit(dating.likelihoods(counts(spark, sf), _grid(spark), 23140.0, "twofold", "g"), "g")
    return fit.select("g", F.round("t0", 3).alias("t0"), F.round(F.log10("rate"), 3).alias("log_rate"), F.round("nll", 3).alias("nll"))


@query()
def ml_multi_start(spark, sf):
    return dating.multi_start(counts(spark, sf), 23140.0, 738000.0, group="g")


@query("SELECT c_custkey AS g, 3 AS start_idx, CAST(floor(736000 + c_custkey % 900 + 0.25) AS INTEGER) AS t0_init_ordinal, CAST(floor(t) AS INTEGER) AS t0_converged_ordinal, coalesce(strftime(DATE '0001-01-01' + CAST(floor(t) - 1 AS INTEGER), '%Y-%m-%d'), 'non-converged') AS t0_converged_date, round(y, 6) AS t0_converged_year, CASE WHEN y IS NULL THEN 'non-converged' WHEN y BETWEEN 2018 AND 2020 THEN '~2019 local minimum' WHEN y BETWEEN 2022.5 AND 2024.5 THEN '~2023 global minimum' ELSE 'other' END AS basin FROM (SELECT c_custkey, t, year(d) + (t - (date_diff('day', DATE '0001-01-01', date_trunc('year', d)) + 1)) / date_diff('day', date_trunc('year', d), date_trunc('year', d) + INTERVAL 1 YEAR) AS y FROM (SELECT c_custkey, t, DATE '0001-01-01' + CAST(floor(t) - 1 AS INTEGER) AS d FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 > 0 THEN 736500 + c_custkey % 2600 + 0.5 END AS t FROM customer)))")
def ml_start_table(spark, sf):
    """The table of starts and ends, of customers as ends."""
    k = F.col("c_custkey")
    end = F.when(k % 10 > 0, 736_500 + k % 2600 + 0.5).otherwise(F.lit(float("nan")))
    ends = table(spark, sf, "customer").select(k.alias("g"), F.lit(3).alias("start_idx"), (736_000 + k % 900 + 0.25).alias("t0_init"), F.lit(1e-6).alias("rate_init"), end.alias("t0"), F.lit(1e-6).alias("rate"), F.lit(1.0).alias("nll"), F.lit(True).alias("converged"))
    out = dating.trajectory_table(ends, "g")
    return out.select("g", "start_idx", "t0_init_ordinal", "t0_converged_ordinal", "t0_converged_date", r6("t0_converged_year", "t0_converged_year"), "basin")


@query()
def ml_joint_fit(spark, sf):
    return dating.joint_fit(dating.multi_start(counts(spark, sf), 23140.0, 738000.0, "linear", "g"), "g")


@query()
def ml_basin_bootstrap(spark, sf):
    """Intervals of the linear model's date within the basin of its joint fit."""
    return dating.bootstrap(counts(spark, sf), 23140.0, 738000.0, model="linear", group="g", within=True)
