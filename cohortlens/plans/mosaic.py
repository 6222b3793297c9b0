"""Queries that look for recombination in the alignment itself. The alignment is made of the
vectors: a base a dimension, by quarters of the values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import recombination
from cohortlens.plans.catalog import query, r6, table

_BASES_SQL = """b AS (SELECT CAST(vec_id AS VARCHAR) AS name, label, pos, CASE WHEN v IS NULL THEN 'N' WHEN v < -0.085 THEN 'A' WHEN v < 0 THEN 'C' WHEN v < 0.085 THEN 'G' ELSE 'T' END AS base
   FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)),
 par AS (SELECT CAST(min(vec_id) AS VARCHAR) AS name FROM embeddings WHERE label IS NOT NULL GROUP BY label)"""
_WALKS_SQL = f"""{_BASES_SQL}, f AS (SELECT * FROM b WHERE name IN (FROM par) AND base <> 'N'),
 st AS (SELECT c.name AS child, p.name AS p, q.name AS q, c.pos, CASE WHEN c.base = p.base THEN 1 ELSE -1 END AS s FROM b c JOIN f p ON c.pos = p.pos JOIN f q ON c.pos = q.pos
   WHERE p.base <> q.base AND c.base IN (p.base, q.base) AND p.name <> c.name AND q.name <> c.name),
 hh AS (SELECT *, sum(s) OVER (PARTITION BY child, p, q ORDER BY pos) AS h FROM st),
 dd AS (SELECT *, greatest(0, max(h) OVER (PARTITION BY child, p, q ORDER BY pos)) - h AS d FROM hh),
 w AS (SELECT child, p, q, count(*) FILTER (s = 1) AS m, count(*) FILTER (s = -1) AS n, greatest(0, max(d)) AS k FROM dd GROUP BY 1, 2, 3)"""
_CHANCE_SQL = """t AS (SELECT DISTINCT m, n, k FROM w WHERE k > greatest(n - m, 1)),
 r AS (SELECT m, n, k, 0::BIGINT AS step, 0::BIGINT AS ups, 0::BIGINT AS d, 1.0::DOUBLE AS p FROM t
  UNION ALL SELECT m, n, k, step + 1, u, e, sum(x) FROM (
    SELECT m, n, k, step, CASE WHEN d = k THEN -1 ELSE ups + up END AS u, CASE WHEN d = k THEN k WHEN up = 1 THEN greatest(d - 1, 0) ELSE d + 1 END AS e,
      CASE WHEN d = k THEN CASE WHEN up = 1 THEN p ELSE 0 END WHEN up = 1 THEN p * (m - ups) / (m + n - step) ELSE p * (n - (step - ups)) / (m + n - step) END AS x
    FROM r, (SELECT unnest([0, 1]) AS up) WHERE step < m + n) WHERE x > 0 GROUP BY 1, 2, 3, 4, 5, 6),
 ch AS (SELECT m, n, k, sum(p) AS p FROM r WHERE step = m + n AND d = k GROUP BY 1, 2, 3),
 z AS (SELECT w.*, coalesce(ch.p, 1.0) AS p_value FROM w LEFT JOIN ch ON w.m = ch.m AND w.n = ch.n AND w.k = ch.k),
 one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY round(log10(p_value), 9), p, q) AS nth FROM z) WHERE nth = 1)"""


def alignment(spark: SparkSession, sf: str) -> DataFrame:
    """``name, seq, label`` of each vector."""
    v = lambda x: x.cast("double")
    base = F.transform("embedding", lambda x: F.when(x.isNull(), "N").when(v(x) < -0.085, "A").when(v(x) < 0, "C").when(v(x) < 0.085, "G").otherwise("T"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.array_join(base, "").alias("seq"), "label")


def founders(spark: SparkSession, sf: str) -> DataFrame:
    """The first vector of each label, as possible parents."""
    first = table(spark, sf, "embeddings").where("label IS NOT NULL").groupBy("label").agg(F.min("vec_id").cast("string").alias("name"))
    return alignment(spark, sf).join(first.select("name"), "name", "semi")


@query(f"""WITH RECURSIVE {_WALKS_SQL}, {_CHANCE_SQL},
 c AS (SELECT child, (SELECT count(*) FROM par) - CASE WHEN child IN (FROM par) THEN 1 ELSE 0 END AS others FROM one),
 nt AS (SELECT child, CAST(others * (others - 1) AS BIGINT) AS n_triplets, CAST(sum(others * (others - 1)) OVER () AS BIGINT) AS total FROM c),
 en AS (SELECT o.child, min(x.pos) AS last FROM one o JOIN dd x ON o.child = x.child AND o.p = x.p AND o.q = x.q WHERE x.d = o.k AND o.k > 0 GROUP BY 1),
 pk AS (SELECT o.child, en.last, max(y.h) AS bottom, coalesce(max(x.pos) FILTER (x.pos < en.last AND x.h = y.h + o.k), 0) AS peak FROM one o JOIN en ON o.child = en.child
   JOIN dd x ON o.child = x.child AND o.p = x.p AND o.q = x.q JOIN dd y ON o.child = y.child AND o.p = y.p AND o.q = y.q AND y.pos = en.last GROUP BY 1, 2),
 sg AS (SELECT o.child, pk.last, min(x.pos) AS first FROM one o JOIN pk ON o.child = pk.child JOIN dd x ON o.child = x.child AND o.p = x.p AND o.q = x.q AND x.pos > pk.peak GROUP BY 1, 2)
 SELECT o.child, n_triplets, o.p AS p_name, o.q AS q_name, CAST(m AS INTEGER) AS m, CAST(n AS INTEGER) AS n, CAST(k AS INTEGER) AS k, CAST(first AS INTEGER) AS from_pos, CAST(last AS INTEGER) AS to_pos,
   round(log10(p_value), 6) AS log_p, round(CASE WHEN p_value >= 1 THEN 1.0 ELSE 1 - pow(1 - p_value, total) END, 6) AS p_corrected FROM one o JOIN nt ON o.child = nt.child LEFT JOIN sg ON o.child = sg.child""")
def ex_triplet_scan(spark, sf):
    """Every vector as a mosaic of the first vectors of two labels."""
    out = recombination.triplet_scan(alignment(spark, sf), founders(spark, sf))
    return out.select("child", "n_triplets", "p_name", "q_name", "m", "n", "k", "from_pos", "to_pos", r6(F.log10("p"), "log_p"), r6("p_corrected", "p_corrected"))


_REPLICATES = 200


@query(f"""WITH {_BASES_SQL}, al AS (SELECT CAST(vec_id // 10 AS VARCHAR) AS candidate, name, pos, base FROM b JOIN embeddings ON name = CAST(vec_id AS VARCHAR)),
 cand AS (SELECT DISTINCT CAST(vec_id // 10 AS VARCHAR) AS candidate FROM embeddings),
 le AS (SELECT candidate, max(pos) AS length FROM al GROUP BY 1),
 si AS (SELECT candidate, pos FROM (SELECT candidate, pos, base, count(*) AS n FROM al WHERE base <> 'N' GROUP BY 1, 2, 3) WHERE n > 1 GROUP BY 1, 2 HAVING count(*) > 1),
 ns AS (SELECT si.candidate, count(*) AS s, any_value(length) AS length FROM si JOIN le ON si.candidate = le.candidate GROUP BY 1),
 nr AS (SELECT candidate, s, least(s - 1, greatest(1, CAST(floor(10.0 * s / length) AS BIGINT))) AS near FROM ns WHERE s > 1),
 x AS (SELECT al.* FROM al JOIN si ON al.candidate = si.candidate AND al.pos = si.pos WHERE base <> 'N'),
 e AS (SELECT DISTINCT u.candidate, u.pos AS i, v.pos AS j, u.base AS a, v.base AS b FROM x u JOIN x v ON u.candidate = v.candidate AND u.name = v.name AND u.pos < v.pos),
 c2 AS (SELECT l.candidate, l.i, l.j, l.a, min(r.a) AS m FROM e l JOIN e r ON l.candidate = r.candidate AND l.i = r.i AND l.j = r.j AND l.b = r.b GROUP BY 1, 2, 3, 4),
 e2 AS (SELECT e.*, m FROM e JOIN c2 ON e.candidate = c2.candidate AND e.i = c2.i AND e.j = c2.j AND e.a = c2.a),
 c3 AS (SELECT l.candidate, l.i, l.j, l.a, min(r.m) AS m FROM e2 l JOIN e2 r ON l.candidate = r.candidate AND l.i = r.i AND l.j = r.j AND l.b = r.b GROUP BY 1, 2, 3, 4),
 e3 AS (SELECT e.*, m FROM e JOIN c3 ON e.candidate = c3.candidate AND e.i = c3.i AND e.j = c3.j AND e.a = c3.a),
 c4 AS (SELECT l.candidate, l.i, l.j, l.a, min(r.m) AS m FROM e3 l JOIN e3 r ON l.candidate = r.candidate AND l.i = r.i AND l.j = r.j AND l.b = r.b GROUP BY 1, 2, 3, 4),
 inc AS (SELECT e.candidate, e.i, e.j, count(*) - count(DISTINCT e.a) - count(DISTINCT e.b) + count(DISTINCT c4.m) AS r FROM e JOIN c4 ON e.candidate = c4.candidate AND e.i = c4.i AND e.j = c4.j AND e.a = c4.a GROUP BY 1, 2, 3),
 pl AS (SELECT candidate, pos, rep, row_number() OVER (PARTITION BY candidate, rep ORDER BY CASE WHEN rep > 0 THEN md5('42:' || rep || ':' || pos) END, pos) AS place FROM si, range({_REPLICATES} + 1) g(rep)),
 tt AS (SELECT inc.candidate, u.rep, sum(CASE WHEN abs(u.place - v.place) <= near THEN r ELSE 0 END) AS total FROM inc JOIN nr ON inc.candidate = nr.candidate JOIN pl u ON u.candidate = inc.candidate AND u.pos = inc.i
   JOIN pl v ON v.candidate = inc.candidate AND v.pos = inc.j AND v.rep = u.rep GROUP BY 1, 2),
 ow AS (SELECT candidate, total AS own FROM tt WHERE rep = 0),
 fin AS (SELECT tt.candidate, any_value(own) AS own, avg(total) FILTER (rep > 0) AS mean, count(*) FILTER (total <= own) AS low FROM tt JOIN ow ON tt.candidate = ow.candidate GROUP BY 1)
 SELECT cand.candidate, CAST(coalesce(ns.s, 0) AS INTEGER) AS n_sites, CAST(near AS INTEGER) AS near, round(own / (near * nr.s - near * (near + 1) / 2), 6) AS phi, round(mean / (near * nr.s - near * (near + 1) / 2), 6) AS phi_mean, round(low / {_REPLICATES + 1}, 6) AS phi_perm_p
  FROM cand LEFT JOIN ns ON cand.candidate = ns.candidate LEFT JOIN nr ON cand.candidate = nr.candidate LEFT JOIN fin ON cand.candidate = fin.candidate""")
def ex_phi_test(spark, sf):
    """Every ten neighbouring vectors as an alignment."""
    rows = alignment(spark, sf).select(F.floor(F.col("name").cast("long") / 10).cast("string").alias("candidate"), "seq")
    out = recombination.phi_test(rows, window=10, replicates=_REPLICATES)
    return out.select("candidate", "n_sites", "near", r6("phi", "phi"), r6("phi_mean", "phi_mean"), r6("phi_perm_p", "phi_perm_p"))
