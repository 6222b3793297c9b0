"""Queries that write driver tables with the library's writers and read them back with its
readers, into a fresh folder of the session's shared one; and small operators beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions import scalars as S
from cohortlens.operators import cohort, detect, sequence, stats
from cohortlens.plans.catalog import _SEQ, query, r6, sequences, table
from cohortlens.sources import files, sinks
from cohortlens.workspace import Workspace


def folder(spark: SparkSession, name: str) -> str:
    return f"{Workspace(spark, 'roundtrip').path}/{name}"


def text_file(lines: DataFrame, spark: SparkSession, name: str, **options) -> str:
    """A folder of text with the one column of ``lines``."""
    path = folder(spark, name)
    lines.write.options(**options).text(path)
    return path


def text_files(lines: DataFrame, spark: SparkSession, name: str, key: str) -> str:
    """A folder with a file a row of ``key`` and ``value``."""
    sinks.write_each(lines, path := folder(spark, name), key)
    return path


def written_fasta(records: DataFrame, spark: SparkSession, **options) -> str:
    path = folder(spark, "fasta")
    sinks.write_fasta(records, path, **options)
    return path


# --- tables ----------------------------------------------------------------------------


@query("SELECT s_name AS accession, CAST(s_nationkey AS VARCHAR) AS nation, replace(s_name, '#', '|') AS parts FROM supplier")
def src_metadata(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat("s_name", F.lit(" further words")).alias(" Accession "), F.col("s_nationkey").alias("nation"), F.split("s_name", "#").alias("parts"))
    sinks.write_tsv(s, path := folder(spark, "tsv"))
    return files.read_metadata(spark, path)


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, trim(p_name) AS p_name FROM part")
def src_projected(spark, sf):
    sinks.write_tsv(table(spark, sf, "part"), path := folder(spark, "tsv"))
    return files.read_tsv(spark, path, ["p_partkey", "p_name"])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS accession FROM orders")
def src_tokens(spark, sf):
    lines = table(spark, sf, "orders").select(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit("\tx y")).alias("value"))
    return files.read_tokens(spark, text_file(lines.union(spark.range(3).select(F.lit("  "))), spark, "tokens"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS accession FROM supplier UNION SELECT CAST(n_nationkey AS VARCHAR) FROM nation UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 2 = 0")
def src_union(spark, sf):
    ids = lambda t, k: table(spark, sf, t).select(F.col(k).cast("string").alias("accession"))
    return files.union_accessions(ids("supplier", "s_suppkey"), ids("nation", "n_nationkey"), ids("customer", "c_custkey").where("CAST(accession AS INT) % 2 = 0"))


# --- sequences -------------------------------------------------------------------------


@query(f"SELECT CAST(doc_id AS VARCHAR) AS accession, doc_id || ' ' || lang AS header, {_SEQ} AS seq FROM documents WHERE lang <> 'en'")
def src_fasta(spark, sf):
    """Sequences written a line of 60 each, restricted to other languages than English."""
    d = table(spark, sf, "documents").where("lang IS NOT NULL").select(F.col("doc_id").alias("accession"), "lang").join(sequences(spark, sf), "accession")
    named = d.select(F.concat_ws(" ", F.col("accession").cast("string"), "lang").alias("accession"), "seq", "lang")
    return files.read_fasta(spark, written_fasta(named, spark, keep=named.where("lang <> 'en'"), wrap=60)).select("accession", "header", "seq")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS accession, CASE WHEN doc_id % 3 = 0 THEN reverse({_SEQ}) ELSE {_SEQ} END AS seq FROM documents")
def src_fasta_last(spark, sf):
    """Every third record comes twice, the second time turned round; the last one counts."""
    s = sequences(spark, sf).withColumn("ord", F.lit(0))
    again = s.where("accession % 3 = 0").select("accession", F.reverse("seq").alias("seq"), F.lit(1).alias("ord"))
    path = written_fasta(s.union(again).withColumn("accession", F.col("accession").cast("string")), spark)
    return files.last_records(files.read_fasta(spark, path)).select("accession", "seq")


@query("SELECT CAST(p_partkey AS VARCHAR) AS accession, substr(repeat(substr('ACGT-N', p_partkey % 5 + 1, 2), 40), 1, 75) AS seq FROM part")
def src_alignment(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("accession"), F.col("p_partkey").alias("ord"), F.repeat(F.substring(F.lit("ACGT-N"), (F.col("p_partkey") % 5 + 1).cast("int"), F.lit(2)), F.lit(40)).substr(1, 75).alias("seq"))
    return files.read_alignment(spark, written_fasta(p, spark, wrap=20)).select("accession", "seq")


@query("SELECT CAST(p_partkey - 1 AS INTEGER) AS start, CAST(p_partkey AS INTEGER) AS \"end\", CASE WHEN p_size % 2 = 0 THEN 'TC' ELSE 'GA' END AS label FROM part")
def src_bed(spark, sf):
    sites = table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("pos"), F.when(F.col("p_size") % 2 == 0, "TC").otherwise("GA").alias("context"), F.col("p_size").cast("long").alias("occupancy"))
    sinks.write_bed(sites, path := folder(spark, "bed"), header="parts")
    return files.read_bed(spark, path)


_SPANS_SQL = "(s_suppkey * 37) % 1500 - 3 AS s, (s_suppkey * 37) % 1500 - 3 + s_nationkey AS e"


def bed_of_suppliers(spark: SparkSession, sf: str) -> str:
    start = (F.col("s_suppkey") * 37) % 1500 - 3
    return text_file(table(spark, sf, "supplier").select(F.concat_ws("\t", F.lit("ref"), start.cast("string"), (start + F.col("s_nationkey")).cast("string"), "s_name").alias("value")), spark, "bed")


@query(f"""WITH iv AS (SELECT greatest(0, s) AS s, e FROM (SELECT {_SPANS_SQL} FROM supplier) WHERE e > s AND e > 0),
 p AS (SELECT DISTINCT unnest(range(s, e)) AS p FROM iv), m AS (SELECT p, p - row_number() OVER (ORDER BY p) AS run FROM p)
 SELECT CAST(min(p) AS INTEGER) AS start, CAST(max(p) + 1 AS INTEGER) AS "end" FROM m GROUP BY run""")
def seq_interval_union(spark, sf):
    return sequence.union_intervals(files.read_bed(spark, bed_of_suppliers(spark, sf)))


@query(f"""WITH iv AS (SELECT {_SPANS_SQL} FROM supplier), p AS (SELECT DISTINCT unnest(range(greatest(0, s), e)) AS p FROM iv WHERE e > s AND e > 0), d AS (SELECT doc_id, {_SEQ} AS seq FROM documents),
 b AS (SELECT doc_id, i, CASE WHEN p IS NULL THEN substr(seq, CAST(i + 1 AS BIGINT), 1) ELSE 'N' END AS c FROM (SELECT doc_id, seq, unnest(range(0, least(length(seq), 1600))) AS i FROM d) LEFT JOIN p ON i = p),
 h AS (SELECT doc_id, string_agg(c, '' ORDER BY i) AS head FROM b GROUP BY 1)
 SELECT CAST(d.doc_id AS VARCHAR) AS accession, coalesce(head, '') || substr(seq, 1601) AS seq FROM d LEFT JOIN h ON d.doc_id = h.doc_id""")
def seq_bed_mask(spark, sf):
    """A BED file of suppliers' intervals, the first mask given, over all sequences, written
    and read back in one chain."""
    _, bed = files.mask_source(("user", None), ("dataset", bed_of_suppliers(spark, sf)), ("repeats", "unused"))
    masked = sequence.mask_intervals(sequences(spark, sf), files.read_bed(spark, bed))
    return files.read_fasta(spark, written_fasta(masked.withColumn("accession", F.col("accession").cast("string")), spark)).select("accession", "seq")


@query("""WITH c AS (SELECT DISTINCT s_nationkey * 2 AS c FROM supplier), p AS (SELECT p_partkey, substr(repeat(substr('ACGT-N', p_partkey % 5 + 1, 2), 40), 1, 75) AS seq FROM part),
 b AS (SELECT p_partkey, i, CASE WHEN c IS NULL THEN substr(seq, CAST(i + 1 AS BIGINT), 1) ELSE 'N' END AS x FROM (SELECT p_partkey, seq, unnest(range(0, 75)) AS i FROM p) LEFT JOIN c ON i = c),
 s AS (SELECT p_partkey, string_agg(x, '' ORDER BY i) AS seq FROM b GROUP BY 1)
 SELECT row_number() OVER (ORDER BY p_partkey % 4 <> 0, p_partkey) AS place, CAST(p_partkey AS VARCHAR) AS accession, seq FROM s""")
def snk_condition_fasta(spark, sf):
    """Children (every fourth part) first, some columns masked; places as in the file."""
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("accession"), F.col("p_partkey").alias("ord"), F.repeat(F.substring(F.lit("ACGT-N"), (F.col("p_partkey") % 5 + 1).cast("int"), F.lit(2)), F.lit(40)).substr(1, 75).alias("seq"))
    columns = table(spark, sf, "supplier").select((F.col("s_nationkey") * 2).alias("column"))
    sinks.write_condition_fasta(p, p.where("ord % 4 = 0"), path := folder(spark, "fasta"), columns)
    found = files.read_fasta(spark, path)
    return stats.ranked(found, "ord").select(F.col("rank_ord").cast("long").alias("place"), "accession", "seq")


@query("SELECT CAST(ord AS INTEGER) AS ref_pos, CAST(i AS INTEGER) AS \"column\" FROM (SELECT i, row_number() OVER (ORDER BY i) AS ord FROM (SELECT rs, unnest(range(1, length(rs) + 1)) AS i FROM (SELECT translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTAC-TANGTACGTACG-AC') AS rs FROM documents WHERE doc_id = 0)) WHERE substr(rs, i, 1) <> '-')")
def seq_reference_columns(spark, sf):
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTAC-TANGTACGTACG-AC")
    return sequence.reference_columns(table(spark, sf, "documents").where("doc_id = 0").select(seq.alias("seq")))


@query("""WITH s AS (SELECT s_suppkey AS site, substr('ACGT-acgtRY', s_suppkey % 11 + 1, 1) AS state FROM supplier WHERE s_suppkey % 3 <> 0)
 SELECT CAST(i AS INTEGER) AS site, CASE WHEN upper(state) IN ('A', 'C', 'G', 'T') THEN upper(state) ELSE 'N' END AS base FROM (SELECT unnest(range(1, (SELECT max(site) FROM s) + 1)) AS i) LEFT JOIN s ON i = site""")
def src_node_state(spark, sf):
    s = table(spark, sf, "supplier").where("s_suppkey % 3 <> 0").select(F.explode(F.array(F.lit("n1"), F.lit("n2"))).alias("Node"), F.col("s_suppkey").alias("Site"), F.substring(F.lit("ACGT-acgtRY"), (F.col("s_suppkey") % 11 + 1).cast("int"), F.lit(1)).alias("State"))
    sinks.write_tsv(s, path := folder(spark, "state"))
    return files.read_node_state(spark, path, "n1")


@query("""WITH s AS (SELECT *, dense_rank() OVER (ORDER BY s_nationkey) AS g, row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS i FROM supplier), n AS (SELECT s_nationkey, g + min(i) - 1 AS id FROM s GROUP BY s_nationkey, g)
 SELECT 0 AS id, NULL AS parent, 'root' AS label, 0.0::DOUBLE AS dist, false AS is_leaf UNION ALL SELECT id, 0, 'n' || s_nationkey, 2.5, false FROM n
 UNION ALL SELECT s.g + s.i, n.id, s_name, round(s_suppkey % 9 / 4.0, 6), true FROM s JOIN n ON s.s_nationkey = n.s_nationkey""")
def src_newick(spark, sf):
    """Suppliers as leaves of their nations, in one file."""
    of_nation = W.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = table(spark, sf, "supplier").withColumns({"first": F.row_number().over(of_nation) == 1, "last": F.lead("s_suppkey").over(of_nation).isNull()})
    name = F.concat(F.col("s_name"), F.lit(":"), F.format_string("%.2f", F.col("s_suppkey") % 9 / 4.0))
    text = F.concat(F.when(F.col("first"), "(").otherwise(""), name, F.when(F.col("last"), F.concat(F.lit(")n"), F.col("s_nationkey").cast("string"), F.lit(":2.5"))).otherwise(""))
    edge = s.agg(F.min(F.struct("s_nationkey", "s_suppkey")).alias("low"), F.max(F.struct("s_nationkey", "s_suppkey")).alias("high"))
    at = F.struct("s_nationkey", "s_suppkey")
    s = s.join(F.broadcast(edge))  # one row
    line = F.concat(F.when(at == F.col("low"), "(").otherwise(","), text, F.when(at == F.col("high"), ")root;").otherwise(""))
    path = text_file(s.orderBy("s_nationkey", "s_suppkey").select(line.alias("value")).coalesce(1), spark, "newick", lineSep=" ")
    return files.newick_tree(spark, path)


# --- detectors -------------------------------------------------------------------------

_REC_LINES_SQL = "SELECT l_orderkey, l_linenumber, l_discount AS p1, CASE WHEN l_tax > 0 THEN l_tax END AS p2 FROM lineitem"


def record_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as lines of a triplet detector: names, nine numbers, breakpoints with a comma."""
    p = lambda c: F.when(F.col(c) > 0, F.format_string("%.2f", c)).otherwise("0.0")
    return table(spark, sf, "lineitem").select(F.concat_ws(",", F.concat(F.lit(" P"), F.col("l_linenumber").cast("string")), F.lit("Q"), F.concat(F.lit("c"), F.col("l_orderkey").cast("string"), F.lit(" ")), *[F.lit("1")] * 6, p("l_discount"), p("l_tax"), F.lit("100"), F.lit("1-2"), F.lit("3-4")).alias("value"))


@query(f"SELECT 'P' || l_linenumber AS p_name, 'c' || l_orderkey AS child, round(CASE WHEN p1 > 0 THEN p1 END, 6) AS p1, round(p2, 6) AS p2, round(least(CASE WHEN p1 > 0 THEN p1 END, p2), 6) AS p, '1-2,3-4' AS breakpoints FROM ({_REC_LINES_SQL})")
def src_triplets(spark, sf):
    head = spark.range(1).select(F.lit("P_name,Q_name,C_name,m,n,k,p,HS?,log(p),DS(p),DS(p),min_rec_length,breakpoints"))
    out = files.read_triplets(spark, text_file(head.union(record_lines(spark, sf)), spark, "rec"))
    return out.select("p_name", "child", r6("p1", "p1"), r6("p2", "p2"), r6("p", "p"), "breakpoints")


@query(f"SELECT count(*) > 0 AS flagged, round(min(least(CASE WHEN p1 > 0 THEN p1 ELSE 1 END, coalesce(p2, 1))), 6) AS min_p, count(*) AS n_triples FROM ({_REC_LINES_SQL}) WHERE 'c' || l_orderkey LIKE '%c1%'")
def src_scan(spark, sf):
    return files.scan_p(spark, text_file(record_lines(spark, sf), spark, "rec"), "c1").withColumn("min_p", r6("min_p"))


@query("SELECT s_suppkey, round(CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey / 100.0 END, 6) AS phi_perm_p, round(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey / 1000.0 END, 6) AS nss_p FROM supplier")
def src_scrape(spark, sf):
    """What a permutation detector prints, with ``--`` for a value that it lacks."""
    s = table(spark, sf, "supplier")
    value = lambda label, ok, x: F.concat(F.lit(f"{label}: "), F.when(ok, F.format_string("%.4e", x)).otherwise("--"), F.lit(" (1000 permutations)\n"))
    text = F.concat(F.lit("header\n"), value("PHI (Permutation)", F.col("s_suppkey") % 3 != 0, F.col("s_nationkey") / 100.0), value("NSS", F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") / 1000.0))
    found = dict(zip((n for n, _ in files.PERMUTATION_FIELDS), files.permutation_values(F.col("text")), strict=True))
    return s.select("s_suppkey", text.alias("text")).select("s_suppkey", r6(found["phi_perm_p"], "phi_perm_p"), r6(found["nss_p"], "nss_p"))


@query("SELECT CAST(p_partkey AS INTEGER) AS bin, CAST(p_size AS BIGINT) AS count, round(p_size / 50.0, 6) AS fraction, round(CASE WHEN p_size % 2 = 0 THEN ln(p_size) / ln(10) END, 6) AS log10 FROM part")
def src_p_histogram(spark, sf):
    log = F.when(F.col("p_size") % 2 == 0, F.format_string("%.9f", F.log10("p_size"))).otherwise("N/A")
    lines = table(spark, sf, "part").select(F.concat(F.lit("  "), F.concat_ws("  ", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.format_string("%.6f", F.col("p_size") / 50.0), log)).alias("value"))
    return files.read_p_histogram(spark, text_file(lines, spark, "histogram")).withColumns({"fraction": r6("fraction"), "log10": r6("log10")})


@query("SELECT s_name AS accession, round(s_nationkey / 25.0, 6) AS phi_perm_p, CAST(s_suppkey AS BIGINT) AS n_sites, s_suppkey % 2 = 0 AS has_parents FROM supplier")
def src_candidates(spark, sf):
    """A JSON file a supplier."""
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("accession"), (F.col("s_nationkey") / 25.0).alias("phi_perm_p"), F.col("s_suppkey").alias("n_sites"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("p"), F.lit("q"))).alias("parents"))
    path = text_files(s.select("accession", F.to_json(F.struct("*")).alias("value")), spark, "candidates", "accession")
    return files.read_candidate_json(spark, path).select("accession", r6("phi_perm_p", "phi_perm_p"), "n_sites", F.col("parents").isNotNull().alias("has_parents"))


@query("""WITH b AS (SELECT s_name AS accession, s_suppkey % 5 <> 0 AS ok, unnest([s_nationkey::DOUBLE, s_nationkey / 2.0]) AS delta FROM supplier), c AS (SELECT unnest([0.75, 1.0, 1.25, 99])::DOUBLE AS scale)
 SELECT scale, count(DISTINCT accession) FILTER (ok AND delta >= scale * 10) AS n_candidates, count(*) FILTER (ok AND delta >= scale * 10) AS n_breakpoints, coalesce(bool_or(ok AND delta >= scale * 10 AND accession = 'Supplier#000000003'), false) AS control FROM b, c GROUP BY 1""")
def st_segment_sweep(spark, sf):
    """A JSON file a supplier with two breakpoints, some without a baseline."""
    s = table(spark, sf, "supplier")
    gain = F.col("s_nationkey").cast("double")
    points = F.create_map(F.lit("0"), F.struct(gain.alias("delta_cAIC")), F.lit("1"), F.struct((gain / 2).alias("delta_cAIC")))
    base = F.when(F.col("s_suppkey") % 5 != 0, F.struct(F.lit(1000.5).alias("c-AIC")))
    path = text_files(s.select("s_name", F.to_json(F.struct(F.col("s_name").alias("candidate_accession"), points.alias("breakpointData"), base.alias("baselineParameters"))).alias("value")), spark, "segments", "s_name")
    return detect.segment_sweep(files.read_segments(spark, path), 10.0, [0.75, 1.0, 1.25, 99.0], "Supplier#000000003")


# --- summaries, bundles, manifests -----------------------------------------------------


@query("""SELECT (SELECT count(*) FROM orders) AS n, o_orderstatus AS status, count(*) AS of_status FROM orders GROUP BY o_orderstatus""")
def snk_summary(spark, sf):
    """A nested summary, written as one JSON object and read back."""
    o = table(spark, sf, "orders")
    by = o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    sinks.write_summary(path := folder(spark, "summary"), o.agg(F.count("*").alias("n")), by_status=by)
    read = spark.read.option("multiLine", True).schema("n long, by_status array<struct<status string, n long>>").json(path)
    return read.select("n", F.explode("by_status").alias("x")).select("n", "x.status", F.col("x.n").alias("of_status"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def src_bundle(spark, sf):
    c = table(spark, sf, "customer")
    nested = c.select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.struct(F.col("c_mktsegment").alias("segment"))).alias("more")).alias("of"))
    sinks.write_json(nested, path := folder(spark, "bundle"))
    return files.read_bundle(spark, path, {"id": "id", "name": "of.name", "segment": "of.more.segment"})


@query("SELECT CAST(length(s_name) + 1 AS BIGINT) AS size, sha256(s_name || chr(10)) AS sha256 FROM supplier")
def src_manifest(spark, sf):
    """A file a supplier, hashed by the reader of files."""
    path = text_files(table(spark, sf, "supplier").select("s_name", F.col("s_name").alias("value")), spark, "files", "s_name")
    return files.manifest(spark, path).where(F.col("path").rlike(r"/part-[^/]*$")).select("size", "sha256")


@query("SELECT sha256 || '  ' || s_name AS line FROM (SELECT s_name, sha256(s_name) AS sha256 FROM supplier)")
def snk_checksums(spark, sf):
    sinks.write_checksums(table(spark, sf, "supplier").select(F.col("s_name").alias("path"), F.sha2("s_name", 256).alias("sha256")), path := folder(spark, "sums"))
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 1 AND o_orderkey % 4 <> 2")
def snk_resume(spark, sf):
    """What is left to do after two runs have added their results."""
    work, path = table(spark, sf, "orders").select("o_orderkey"), folder(spark, "runs")
    for unit in (1, 2):
        sinks.append_run(work.where(F.col("o_orderkey") % 4 == unit).withColumns({"unit": F.lit(unit)}), path, "unit")
    return sinks.remaining(work, spark.read.parquet(path), "o_orderkey")


@query("SELECT c_name AS node, CAST(c_custkey AS BIGINT) AS k FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'NODE_' || c_custkey ELSE c_name END AS c_name, c_custkey FROM customer) WHERE c_name LIKE 'NODE_%' ORDER BY 1 LIMIT 5")
def src_clock_roots(spark, sf):
    """The five first inner nodes are what is asked for."""
    k = F.col("c_custkey")
    return files.clock_roots(table(spark, sf, "customer").select(F.when(k % 7 == 0, F.concat(F.lit("NODE_"), k.cast("string"))).otherwise(F.col("c_name")).alias("node"), k.cast("long").alias("k")))


@query("SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'rate' ELSE 'intercept' END AS name, round(s_acctbal, 2) AS value FROM supplier")
def src_clock_lines(spark, sf):
    s = table(spark, sf, "supplier")
    lines = s.select(F.concat(F.lit(" --"), F.when(F.col("s_suppkey") % 2 == 0, "rate").otherwise("intercept"), F.lit(":\t"), F.format_string("%.2f", "s_acctbal"), F.lit(" +/- 1")).alias("value"))
    return files.clock_lines(spark, text_file(lines.union(s.select("s_name")), spark, "clock")).withColumn("value", F.round("value", 2))


# --- small operators -------------------------------------------------------------------


@query("""SELECT o_orderkey, CAST(DATE '0001-01-01' + CAST(floor(730000 + o_custkey % 9000 + 0.75) AS INTEGER) - 1 AS DATE) AS day, round(CASE WHEN o_custkey % 3 > 0 THEN o_totalprice / (o_custkey % 3) ELSE 0 END, 6) AS ratio,
 o_orderpriority LIKE '1%' AS urgent, split_part(o_orderpriority, '-', 1) AS token, o_orderstatus = 'P' OR (o_orderstatus IS NULL AND o_totalprice < 1000) AS partial FROM orders""")
def fn_scalars(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_custkey") % 3
    completeness = F.when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise(F.col("o_orderstatus"))
    return o.select(
        "o_orderkey", S.from_ordinal(730_000 + F.col("o_custkey") % 9000 + 0.75).alias("day"), r6(S.safe_ratio(F.col("o_totalprice"), k), "ratio"),
        S.starts_with(F.col("o_orderpriority"), "1").alias("urgent"), S.first_token(F.concat(F.lit(" "), F.regexp_replace("o_orderpriority", "-", " "))).alias("token"), S.is_partial(completeness, F.col("o_totalprice") < 1000).alias("partial"),
    )


@query("""SELECT 'c' || l_orderkey AS child, round(min(p) FILTER (l_linenumber = 1), 6) AS baseline, round(min(p) FILTER (l_linenumber = 2), 6) AS masked FROM (SELECT *, CASE WHEN l_discount > 0 THEN l_discount END AS p FROM lineitem WHERE l_linenumber <= 2) GROUP BY 1""")
def jn_per_child(spark, sf):
    """A row a child with its smallest p under each of two conditions."""
    li = table(spark, sf, "lineitem").where("l_linenumber <= 2")
    rec = li.select(F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("child"), F.when(F.col("l_linenumber") == 1, "baseline").otherwise("masked").alias("condition"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("p"))
    out = detect.per_child_table(rec, "condition", ["baseline", "masked"])
    return out.select("child", r6("baseline", "baseline"), r6("masked", "masked"))


@query("""WITH m AS (SELECT l_orderkey, count(*) AS n, quantile_cont(l_extendedprice, 0.5) AS m FROM lineitem GROUP BY 1)
 SELECT l_orderkey AS accession, n, round(m, 6) AS median_bp, m BETWEEN 20000 AND 40000 AS inside, round(CASE WHEN m < 20000 THEN 20000 - m WHEN m > 40000 THEN m - 40000 ELSE 0 END, 6) AS distance FROM m""")
def st_breakpoints(spark, sf):
    out = detect.breakpoint_summary(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("accession"), F.col("l_extendedprice").alias("breakpoint")), 20_000, 40_000)
    return out.select("accession", "n", r6("median_bp", "median_bp"), "inside", r6("distance", "distance"))


@query("SELECT count(*) AS n, round(max(o_totalprice), 6) AS max_retain, arg_max(o_custkey, o_totalprice) AS bp_at_max FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority NOT LIKE '1%'")
def st_discordance(spark, sf):
    o = table(spark, sf, "orders")
    ladder = o.select((F.col("o_orderstatus") == "F").alias("threeseq_flag"), S.starts_with(F.col("o_orderpriority"), "1").alias("phipack_call"), F.col("o_totalprice").alias("retain_frac"), F.col("o_custkey").alias("retained_nongap_bp"))
    return detect.discordance(ladder).withColumn("max_retain", r6("max_retain"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey <> 5")
def flt_drop_one(spark, sf):
    return cohort.drop_exactly_one(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", 5)


@query("SELECT doc_id FROM documents WHERE lang LIKE 'e%' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL)")
def flt_panel(spark, sf):
    """Restricted to a clade by prefix and less the excluded ones, in one step."""
    labels = table(spark, sf, "labels").where("quality = 0").select("doc_id")
    return cohort.restricted(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "e", labels, "doc_id").select("doc_id")


@query("""WITH f AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY md5('42:' || c_custkey), c_custkey) AS k FROM customer WHERE c_mktsegment IS NOT NULL AND c_nationkey IS NOT NULL),
 t AS (SELECT count(*) FILTER (k <= 2) > 60 AS capped FROM f) SELECT c_custkey, 'pass1_capped' AS allocation_pass FROM f, t WHERE capped AND k <= 2 ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 60""")
def smp_capped(spark, sf):
    """A first pass that alone exceeds what is wanted."""
    return cohort.stratified_sample(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), ["c_mktsegment", "c_nationkey"], "c_custkey", 60, 2, 8, named=True).select("c_custkey", "allocation_pass")
