"""URL filters: rules first, then the reputation of the host by empirical Bayes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.names import lookup
from cohortlens.workspace import Workspace

#: (verdict, host and path), as agreed for op9.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@dataclass(frozen=True)
class Reputation:
    """A host is blocked if its share of bad pages is over ``limit`` with a posterior chance
    of ``sure`` or more, that is if the lower bound of the share at that level is over it.
    A suffix is the last label, or the last two where that has two letters and the one
    before is in ``second``; ``suffixes`` are further ones, as read from a list of public
    suffixes. ``floor`` and ``roof`` bound the weight of a prior, in pages.
    ``small_hosts``: up to so many hosts' answers are broadcast."""

    limit: float = 0.5
    sure: float = 0.977
    floor: float = 2.0
    roof: float = 200.0
    second: tuple[str, ...] = ("ac", "co", "com", "edu", "gov", "mil", "ne", "net", "nom", "or", "org")
    suffixes: tuple[str, ...] = ()
    small_hosts: int = 100_000


def host_of(url: Column) -> Column:
    """What is between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty for null and for a text without ``://``."""
    after = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?s).*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?s).*?://[^/?#]*(/?[^?#]*)", 1)


def read_suffixes(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Suffixes of several labels in a public suffix list (a rule a line, ``//`` comments;
    rules with ``*`` or ``!`` are passed over). Such lists have some 10,000 rules."""
    rules = spark.read.text(path).select(F.lower(F.trim("value")).alias("rule"))
    rules = rules.where(r"rule RLIKE '^[^/*!\\s.]+([.][^/*!\\s.]+)+$'").distinct().orderBy("rule")
    return tuple(r.rule for r in rules.limit(100_000).collect())


def suffix_of(host: Column, p: Reputation) -> Column:
    labels = F.split(host, r"\.")
    two = F.substring_index(host, ".", -2)
    last, before = F.substring_index(host, ".", -1), F.substring_index(two, ".", 1)
    out = F.when((F.length(last) == 2) & (F.size(labels) > 1) & before.isin(*p.second), two).otherwise(last)
    if p.suffixes:
        known = F.array(*map(F.lit, p.suffixes))
        tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels) - k + 1), "."))
        out = F.coalesce(F.get(F.filter(tails, lambda t: F.array_contains(known, t)), F.lit(0)), out)
    return out


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and the label before it; a host that is a suffix is its own domain."""
    before = F.lit(1) + F.size(F.split(suffix, r"\."))
    parts = F.split(host, r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - before + 1), F.least(before, F.size(parts))), ".")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):
        at, slash, start = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + start)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _weight(level: DataFrame, p: Reputation) -> DataFrame:
    """One row, ``weight``: how many pages the prior of a level is worth, by the moments of
    the groups' bad shares around their parents' (few or equal groups: the roof)."""
    # E[(s - n m)^2] = m (1 - m) n (n + w) / (1 + w), summed over groups and solved for w
    q = level.where("n > 1").agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col("mean"), 2)).alias("a"),
        F.sum(F.col("mean") * (1 - F.col("mean")) * F.col("n")).alias("b"),
        F.sum(F.col("mean") * (1 - F.col("mean")) * F.col("n") * F.col("n")).alias("c"),
    )
    found = F.when(F.col("a") > F.col("b"), (F.col("c") - F.col("a")) / (F.col("a") - F.col("b")))
    return q.select(F.least(F.lit(p.roof), F.greatest(F.lit(p.floor), F.coalesce(found, F.lit(p.roof)))).alias("weight"))


def host_posteriors(labelled: DataFrame, p: Reputation, ws: Workspace) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Of ``host, bad`` (1 or 0): posterior ``mean`` and ``size`` (pages the posterior is
    worth) of each host, domain and suffix, and the share of bad pages overall.

    A suffix shrinks towards the overall share, a domain towards its suffix, a host towards
    its domain: the mean of Beta(w m + bad, w (1 - m) + n - bad).
    """
    hosts = labelled.groupBy("host").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"), p)).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    hosts = ws.table(hosts.select("host", "domain", "suffix", F.col("bad").cast("double").alias("bad"), F.col("n").cast("double").alias("n")), "hosts")
    all_ = hosts.agg(F.sum("bad"), F.sum("n")).first()
    overall = all_[0] / all_[1] if all_[1] else 0.0

    def shrunk(level: DataFrame, keys: list[str], name: str) -> DataFrame:
        weight = F.broadcast(_weight(level, p))  # one row
        out = level.join(weight).select(*keys, "n", ((F.col("weight") * F.col("mean") + F.col("bad")) / (F.col("weight") + F.col("n"))).alias("mean"), (F.col("weight") + F.col("n")).alias("size"))
        return ws.table(out, name)

    sums = [F.sum("bad").alias("bad"), F.sum("n").alias("n")]
    domains = ws.table(hosts.groupBy("domain", "suffix").agg(*sums), "domain-sums")
    suffixes = shrunk(domains.groupBy("suffix").agg(*sums).withColumn("mean", F.lit(overall)), ["suffix"], "suffixes")
    up = suffixes.select("suffix", "mean")
    domains = shrunk(domains.join(up, "suffix"), ["domain", "suffix"], "domains")
    up = domains.select("domain", "mean")
    return shrunk(hosts.join(up, "domain"), ["host", "domain", "suffix"], "posteriors"), domains, suffixes, overall


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0 (Stirling's series above 8)."""
    z = x + 8
    series = (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return series - F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda s, i: s + F.ln(x + i))


def _lower_tail(a: Column, b: Column, x: Column) -> Column:
    """P(share < x) under Beta(a, b), for x below its mean or so: a series of positive
    terms, of which the square root of a + b is as many as matter, times nine and more."""
    front = F.exp(a * F.ln(x) + b * F.ln(1 - x) + log_gamma(a + b) - log_gamma(a + 1) - log_gamma(b))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, n: Column) -> Column:
        term = s["term"] * (a + b + n - 1) / (a + n) * x
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    terms = (80 + 9 * F.sqrt(a + b)).cast("int")
    return front * F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda s: s["sum"])


def chance_over(mean: Column, size: Column, limit: float) -> Column:
    """P(share > limit) under a Beta distribution with this mean, worth ``size`` pages."""
    a, b, x = mean * size, (1 - mean) * size, F.lit(float(limit))
    tail = F.when(mean >= limit, 1 - _lower_tail(a, b, x)).otherwise(_lower_tail(b, a, 1 - x))
    return F.when(mean <= 0, 0.0).when(mean >= 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules=RULES, p: Reputation = Reputation()) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_mean, bad_chance`` of every row of ``pages``
    (``page_id, url``): the longest rule's verdict, else ``block`` if the host's share of bad
    pages is over the limit with a posterior chance of ``sure``, else ``allow``.

    ``labelled``: ``url, bad`` (1 bad, 0 not, null ignored). A host without a label has the
    posterior mean of its domain, else of its suffix, else the overall share, worth two
    pages. A null, empty or malformed url has an empty host, which is a host like others.
    Repeated rows are judged alike (and counted each as labels); extra columns are ignored;
    empty tables give no rows, no labels let everything pass.
    """
    ws = Workspace(pages.sparkSession, "hosts")
    labels = labelled.where("bad IS NOT NULL").select(host_of(F.col("url")).alias("host"), F.col("bad").cast("long").alias("bad"))
    hosts, domains, suffixes, overall = host_posteriors(labels, p, ws)

    def answers(level: DataFrame, key: str, size: Column | str) -> DataFrame:
        """Mean and chance of each group, worked out once a group."""
        out = level.select(F.col(key).alias(f"of_{key}"), F.struct(F.col("mean"), chance_over(F.col("mean"), size, p.limit).alias("chance")).alias(f"by_{key}"))
        return ws.table(out, f"by-{key}")

    floor = F.lit(p.floor)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("suffix", suffix_of(F.col("host"), p)).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    for level, key, size in ((hosts, "host", F.col("size")), (domains, "domain", floor), (suffixes, "suffix", floor)):
        found = answers(level, key, size)
        rows = lookup(rows, key, found, f"of_{key}", found.count() <= p.small_hosts, "left")
    none = F.struct(F.lit(overall).alias("mean"), chance_over(F.lit(overall), floor, p.limit).alias("chance"))
    said = F.coalesce("by_host", "by_domain", "by_suffix", none)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"), F.round(said["mean"], 9).alias("bad_mean"), F.round(said["chance"], 6).alias("bad_chance"))
    by_host = F.when(F.col("bad_chance") >= p.sure, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", by_host).alias("verdict"), "bad_mean", "bad_chance")


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; a page is labelled bad if the label of its number has low quality. Null
    urls and labels, empty tables and repeated rows: see ``judge_urls``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("bad"))
    return judge_urls(pages, pages.join(labels, pages["page_id"] == labels["doc_id"]).select("url", "bad"))


QUERIES = {"op9_host_reputation": op9_host_reputation}
ORACLES = {
    "op9_host_reputation": r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(url, '^(?s:.*?)://[^/?#]*(/?[^?#]*)', 1) AS path FROM u),
s AS (SELECT *, CASE WHEN len(string_split(host, '.')) > 1 AND length(string_split(host, '.')[-1]) = 2
          AND string_split(host, '.')[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'mil', 'ne', 'net', 'nom', 'or', 'org')
        THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE string_split(host, '.')[-1] END AS suffix FROM h),
d AS (SELECT *, array_to_string(list_slice(string_split(host, '.'), greatest(1, len(string_split(host, '.')) - len(string_split(suffix, '.'))), len(string_split(host, '.'))), '.') AS domain FROM s),
l AS (SELECT d.host, d.domain, d.suffix, CAST(1 - quality AS DOUBLE) AS bad FROM d JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL),
o AS (SELECT coalesce(sum(bad) / count(*), 0.0) AS overall FROM l),
s0 AS (SELECT suffix, sum(bad) AS bad, CAST(count(*) AS DOUBLE) AS n, any_value(overall) AS mean FROM l, o GROUP BY suffix),
sw AS (SELECT least(200.0, greatest(2.0, coalesce(CASE WHEN a > b THEN (c - a) / (a - b) END, 200.0))) AS w FROM
  (SELECT sum((bad - n * mean) ** 2) AS a, sum(mean * (1 - mean) * n) AS b, sum(mean * (1 - mean) * n * n) AS c FROM s0 WHERE n > 1)),
s1 AS (SELECT suffix, (w * mean + bad) / (w + n) AS mean FROM s0, sw),
d0 AS (SELECT domain, l.suffix, sum(bad) AS bad, CAST(count(*) AS DOUBLE) AS n, any_value(mean) AS mean FROM l JOIN s1 ON l.suffix = s1.suffix GROUP BY domain, l.suffix),
dw AS (SELECT least(200.0, greatest(2.0, coalesce(CASE WHEN a > b THEN (c - a) / (a - b) END, 200.0))) AS w FROM
  (SELECT sum((bad - n * mean) ** 2) AS a, sum(mean * (1 - mean) * n) AS b, sum(mean * (1 - mean) * n * n) AS c FROM d0 WHERE n > 1)),
d1 AS (SELECT domain, (w * mean + bad) / (w + n) AS mean FROM d0, dw),
h0 AS (SELECT host, sum(bad) AS bad, CAST(count(*) AS DOUBLE) AS n, any_value(mean) AS mean FROM l JOIN d1 ON l.domain = d1.domain GROUP BY host),
hw AS (SELECT least(200.0, greatest(2.0, coalesce(CASE WHEN a > b THEN (c - a) / (a - b) END, 200.0))) AS w FROM
  (SELECT sum((bad - n * mean) ** 2) AS a, sum(mean * (1 - mean) * n) AS b, sum(mean * (1 - mean) * n * n) AS c FROM h0 WHERE n > 1)),
h1 AS (SELECT host, (w * mean + bad) / (w + n) AS mean, w + n AS size FROM h0, hw),
r AS (SELECT page_id, d.host, path, coalesce(h1.mean, d1.mean, s1.mean, overall) AS m, coalesce(size, 2.0) AS sz,
  CASE WHEN d.host LIKE '%.example.org' OR d.host = 'example.org' THEN
         CASE WHEN starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN starts_with(path, '/es/') THEN 'example.org/es/' WHEN starts_with(path, '/') THEN 'org/' END
       WHEN (d.host LIKE '%.org' OR d.host = 'org') AND starts_with(path, '/') THEN 'org/'
       WHEN (d.host LIKE '%.com' OR d.host = 'com') AND starts_with(path, '/fr/') THEN 'com/fr/'
       WHEN (d.host LIKE '%.com' OR d.host = 'com') AND starts_with(path, '/de/') THEN 'com/de/' END AS rule
  FROM d CROSS JOIN o LEFT JOIN h1 ON d.host = h1.host LEFT JOIN d1 ON d.domain = d1.domain LEFT JOIN s1 ON d.suffix = s1.suffix),
g AS (SELECT DISTINCT m, sz, CASE WHEN m >= 0.5 THEN m * sz ELSE (1 - m) * sz END AS a, CASE WHEN m >= 0.5 THEN (1 - m) * sz ELSE m * sz END AS b FROM r),
c AS (SELECT m, sz, CASE WHEN m <= 0 THEN 0.0 WHEN m >= 1 THEN 1.0 ELSE list_sum(list_transform(range(0, CAST(100 + 10 * sqrt(sz) AS BIGINT)), lambda k:
          exp((a + b + k) * ln(0.5) + lgamma(a + b + k) - lgamma(a + 1 + k) - lgamma(b)))) END AS tail FROM g),
b AS (SELECT r.*, round(r.m, 9) AS bad_mean, round(CASE WHEN r.m <= 0 OR r.m >= 1 THEN tail WHEN r.m >= 0.5 THEN 1 - tail ELSE tail END, 6) AS bad_chance
      FROM r JOIN c ON r.m = c.m AND r.sz = c.sz)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN bad_chance >= 0.977 THEN 'block' ELSE 'allow' END AS verdict, bad_mean, bad_chance FROM b
"""
}
