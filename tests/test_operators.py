"""Operators on small hand-made rows and on golden values."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import scalars as S
from cohortlens.operators import cohort, dating, detect, qc, sequence, stats
from cohortlens.streaming import intake


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


@pytest.mark.parametrize(("text", "resolution", "date"), [("2024-01-02", "day", "2024-01-02"), ("2024-13-01", "day", "2024-01-01"), ("2024-02", "month", "2024-02-01"), (" 2023 ", "year", "2023-01-01"), ("abcd-ef", "month", None), ("", "unknown", None), (None, "unknown", None)])
def test_dates(spark, text, resolution, date):
    r = one(spark, text).select(S.date_resolution(F.col("x")).alias("r"), S.parse_loose(F.col("x")).cast("string").alias("d")).first()
    assert (r.r, r.d) == (resolution, date)


def test_ordinals(spark):
    d = one(spark, "2024-01-02").select(F.to_date("x").alias("d")).select(S.ordinal(F.col("d")).alias("o"), S.from_ordinal(S.ordinal(F.col("d")) + 0.9).cast("string").alias("back"), S.decimal_year(F.col("d")).alias("y")).first()
    assert (d.o, d.back, d.y) == (738887, "2024-01-02", 2024 + 1 / 366)


def test_regions_and_strata(spark):
    df = spark.createDataFrame([("USA: Texas", "2021-05"), ("Atlantis", " 202"), ("", None), (None, "2024"), ("Côte d'Ivoire", "2026")], "l string, y string")
    assert [tuple(r) for r in df.select(S.who_region(F.col("l")), S.year_stratum(F.col("y"))).collect()] == [("AMR", "2022"), ("other", "2022"), ("unknown", "unknown"), ("unknown", "2024"), ("AFR", "2025+")]


def test_three_decimals_as_python(spark):
    xs = [0.8125, 0.1125, 0.0005, 1.0005, 0.9995, 0.0, 0.12345, 2.5e-4, 1 / 3]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(S.fixed3(F.col("x"))).collect()] == [f"{x:.3f}" for x in xs]


def test_reasons(spark):
    schema = "organism string, clade string, seq_length long, n_fraction double, non_acgtn_fraction double, collection_date string, qc string, frameshift_qc string"
    rows = [("mpxv", "Ib", 197_000, 0.01, 0.0, "2024-05", "good", ""), ("dog", "IIa", 10, 0.2, 0.5, "2024", "BAD", "bad"), (None, None, None, None, None, None, None, None), ("", "Ib/IIb", 197_000, 0.0, 0.0, "2024-01-01", None, None)]
    out = [r.exclusion_reasons for r in qc.with_reasons(spark.createDataFrame(rows, schema)).collect()]
    assert out[0] == [] and out[3] == []
    assert out[1] == ["organism_not_mpxv:dog", "clade_excluded:IIa", "length_lt_190000:10", "n_fraction_gt_0.05:0.200", "non_acgtn_gt_0.01:0.500", "date_resolution_year_lt_month", "nextclade_qc_bad", "frameshift_qc_bad"]
    assert out[2] == ["clade_excluded:nan", "no_sequence_found", "date_resolution_unknown_lt_month"]


def test_golden_interval_and_test(spark):
    df = spark.createDataFrame([(942, 1127), (0, 0), (7, 7)], "k long, n long")
    low, high = stats.wilson(F.col("k"), F.col("n"))
    rows = df.select(low.alias("low"), high.alias("high"), stats.binomial_tail_column(F.col("k"), F.col("n"), 0.7).alias("p")).collect()
    assert rows[0].low == pytest.approx(0.8130872836853098, abs=1e-12) and rows[0].high == pytest.approx(0.8563257397719684, abs=1e-12)
    assert rows[0].p == pytest.approx(4.52098e-26, rel=1e-5) and stats.binomial_tail(942, 1127, 0.7) == pytest.approx(4.52098e-26, rel=1e-5)
    assert (rows[1].low, rows[1].high, rows[1].p) == (0.0, 0.0, 1.0) and rows[2].p == pytest.approx(0.7**7)
    d = stats.proportion_test(942, 1127)
    assert d["verdict"] == "supported" and not d["halt"] and d["fraction"] == pytest.approx(0.83585, abs=1e-5)


def test_ranks_and_correlation(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 1.0), (2.0, 4.0), (5.0, 9.0), (None, 2.0)], "a double, b double")
    assert sorted(r.rank_a for r in stats.ranked(df, "a").collect()) == [1.0, 2.5, 2.5, 4.0]
    assert stats.spearman(df, "a", "b").first().rho == pytest.approx(0.6324555, abs=1e-6)
    assert stats.spearman(df.limit(2), "a", "b").first().rho is None
    assert stats.spearman_p(-0.5, 20) == pytest.approx(0.0247691, abs=1e-5)
    u = stats.rank_sum(spark.createDataFrame([(float(i), i > 4) for i in range(10)], "v double, f boolean"), "v", "f").first()
    assert (u.n1, u.n2, u.u) == (5, 5, 25.0) and u.p_greater == pytest.approx(0.0061, abs=2e-4)


def test_histogram_and_describe(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 24, 25)], "v double")
    assert {r.bin: r.n for r in stats.histogram(df, "v", 0.0, 24.0).collect()} == {0: 1, 1: 1, 2: 1, 23: 1}
    assert tuple(stats.describe(df, "v").first()) == (5, 2.0, 1.0, 24.0)
    assert stats.distribution(df.limit(1), "v").first().sd == 0.0


def test_masks(spark):
    f = lambda s, c: one(spark, s).select(c.alias("y")).first().y
    x = F.col("x")
    assert f("ACGTACGT", sequence.masked(x, [(1, 3), (2, 4), (7, 99), (-5, 1)])) == "NNNNACGN"
    twice = sequence.masked(sequence.masked(x, [(1, 3)]), [(1, 3)])
    assert f("ACGT", twice) == "ANNT" and f("", sequence.masked(x, [(0, 3)])) == ""
    assert f("ACGTn", sequence.reverse_complement(sequence.reverse_complement(x))) == "ACGTn"
    assert f("ACGTACGTAC", sequence.truncate_central(x, 0.5)) == "--GTACG---"
    head = "ACGGT" * 250
    rc = head.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert f(head + "A" * 900 + rc, sequence.terminal_repeat(x)) >= 1250 and f(head + "A" * 900, sequence.terminal_repeat(x)) == 0


def test_variants(spark):
    ref = spark.createDataFrame([("TCAGATTCGA",)], "seq string")
    sites = {(r.pos, r.context) for r in sequence.eligible_sites(ref).collect()}
    assert sites == {(2, "TC"), (4, "GA"), (8, "TC"), (9, "GA")}
    g = spark.createDataFrame([("a", "TTAAATTCGA"), ("b", "tcagattcga"), ("c", "TCAG"), ("d", "ACNGATT-GT")], "accession string, seq string")
    found = sequence.variants(g, ref)
    assert {(r.accession, r.pos, r.ref, r.alt, r.context) for r in found.collect()} == {("a", 2, "C", "T", "TC"), ("a", 4, "G", "A", "GA"), ("d", 1, "T", "A", None), ("d", 10, "A", "T", None)}
    n = {r.accession: (r.total_snvs, r.apobec3_snvs, r.apobec3_fraction) for r in sequence.variant_counts(g, found).collect()}
    assert n == {"a": (2, 2, 1.0), "b": (0, 0, 0.0), "c": (0, 0, 0.0), "d": (2, 0, 0.0)}
    cols = {r.pos: (r.n_bases, r.variable, r.ambiguous) for r in sequence.column_statistics(sequence.column_counts(g.where("accession <> 'b'"))).collect()}
    assert cols[1] == (2, True, False) and cols[3][2] and cols[2] == (2, True, False)
    assert [(r.ref_pos, r.column) for r in sequence.reference_columns(spark.createDataFrame([("A--CG-",)], "seq string")).collect()] == [(1, 1), (2, 4), (3, 5)]


def test_samples(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i % 10 else "unknown") for i in range(300)], "k long, s string")
    out = cohort.stratified_sample(df, ["s"], "k", 40, 5, 20)
    n = {r["s"]: r["count"] for r in out.groupBy("s").count().collect()}
    assert sum(n.values()) == 40 and set(n) == set("abc") and max(n.values()) <= 20 and min(n.values()) >= 13
    assert out.where("allocation_pass = 1").count() == 15
    assert cohort.stratified_sample(df, ["s"], "k", 7, 5, 20).count() == 7
    reps = cohort.subsamples(df, "k", 0.25, 4)
    assert {r["count"] for r in reps.groupBy("replicate").count().collect()} == {75} and reps.select("k").distinct().count() > 75
    with pytest.raises(ValueError):
        cohort.drop_exactly_one(df, "s", "a")
    assert cohort.without_latest(df, "k", "k", 0.1).agg(F.max("k")).first()[0] == 269


def test_detectors(spark):
    rows = [("c1", "p", "q", 0.04, 1), ("c1", "r", "s", 0.01, 2), ("c1", "t", "u", 0.01, 3), ("c2", "p", "q", None, 4)]
    rec = spark.createDataFrame(rows, "child string, p_name string, q_name string, p double, ord long")
    assert [tuple(r) for r in detect.best_pair(rec).collect()] == [("c1", "r", "s", 0.01)]
    assert {r.child: r.min_p for r in detect.min_p(rec).collect()} == {"c1": 0.01, "c2": None}
    sweep = {round(r.threshold, 3): (r.n_candidates, r.control_in_set) for r in detect.threshold_sweep(rec, "c1").collect()}
    assert sweep == {0.025: (1, True), 0.05: (1, True), 0.1: (1, True)}
    calls = spark.createDataFrame([("a", 0.01, None, 0.2), ("b", 0.01, 0.02, 0.049), ("c", 0.05, 0.5, None)], "accession string, phi_perm_p double, nss_p double, maxchi_p double")
    assert {r.k: r.n_candidates for r in detect.agreement_sweep(calls, "b").collect()} == {1: 2, 2: 1, 3: 1}
    d = spark.createDataFrame([(True, True, "x", "y"), (False, True, "x", "y"), (False, False, "x", "y")], "a boolean, b boolean, p string, q string")
    assert [r[0] for r in d.select(detect.donor(F.col("a"), F.col("b"), F.col("p"), F.col("q"))).collect()] == ["y", "x", "x|y(neither-Ia)"]
    ladder = spark.createDataFrame([(1.0, 900, True, True), (0.5, 450, True, False), (0.3, 200, True, False)], "retain_frac double, retained_nongap_bp int, threeseq_flag boolean, phipack_call boolean")
    assert tuple(detect.discordance(ladder).first()) == (2, 0.5, 450)


def test_dating(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    day = rng.integers(738_500, 739_200, 150)
    truth, rate, sites = 737_000.0, 2e-7, 23_140.0
    k = rng.poisson(sites * (1 - np.exp(-rate * (day - truth))))
    df = spark.createDataFrame([("x", float(d), float(v)) for d, v in zip(day, k, strict=True)], "cluster_id string, day double, k double")
    low = 730_000.0
    fit = dating.fit_groups(df, sites, low).first()
    grid = dating.best_fit(dating.likelihoods(df, dating.grid(spark, low, 738_400.0, 60, 1e-9, 1e-5, 60), sites)).first()
    assert fit.nll <= grid.nll + 1e-6
    starts = dating.start_trajectories(df, sites, low, 6).collect()
    assert len(starts) == 6 and all(fit.nll <= r.nll + 1e-6 for r in starts)
    b = dating.bootstrap(df, sites, low, 20).first()
    assert b.replicates == 20 and b.t0_low <= b.t0_high
    linear = dating.fit_groups(df, sites, low, "linear")
    assert abs(dating.compare_fits(dating.fit_groups(df, sites, low), linear, "cluster_id").first().delta_days - (linear.first().t0 - fit.t0)) < 1e-6
    prof = dating.linear_profile(df, spark.range(30).select((F.lit(737_000.0) + F.col("id") * 40).alias("t0")), sites)
    assert dating.profile_summary(prof).first().ll_range > 0
    assert one(spark, 1e-6, "double").select(dating.saturated_share(F.col("x")).alias("y")).first().y == pytest.approx(5e-7, rel=0.01)
    assert math.isfinite(dating.root_to_tip(df).first().slope)


def test_dating_by_day(spark):
    """Fits see a row a day however many rows there are, with the likelihood of all rows."""
    import numpy as np

    rng = np.random.default_rng(5)
    day = rng.integers(738_500, 738_530, 6000).astype(float)
    sites, low = 23_140.0, 736_000.0
    k = rng.poisson(sites * -np.expm1(-3e-7 * (day - 738_000.0))).astype(float)
    df = spark.createDataFrame([("xy"[i % 2], float(d), float(v)) for i, (d, v) in enumerate(zip(day, k, strict=True))], "cluster_id string, day double, k double")
    days = dating.by_day(df, "cluster_id").collect()
    assert len(days) == 60 and sum(r.n for r in days) == 6000 and sum(r.k for r in days) == k.sum()
    for model in ("saturation", "linear"):
        for r in dating.fit_groups(df, sites, low, model).collect():
            at = np.arange(6000) % 2 == "xy".index(r.cluster_id)
            age = day[at] - r.t0
            mu = sites * (-np.expm1(-r.rate * age) if model == "saturation" else r.rate * age)
            assert r.n == 3000 and r.nll == pytest.approx(-(k[at] * np.log(mu) - mu).sum(), rel=1e-9)
    b = dating.bootstrap(df, sites, low, 130, "linear").collect()
    assert [r.replicates for r in b] == [130, 130] and all(r.t0_low < r.t0_high for r in b)


def test_joint_fits(spark):
    """The best of 25 joint searches is no worse than the search over all dates; linear and
    saturated; intervals of refits lie around it; null rows take no part."""
    import numpy as np

    rng = np.random.default_rng(9)
    sites, low = 23_140.0, 730_000.0
    day = rng.integers(738_000, 739_400, 400).astype(float)
    k = rng.poisson(sites * -np.expm1(-4e-7 * (day - 736_500.0))).astype(float)
    rows = [("x", d, v) for d, v in zip(day.tolist(), k.tolist(), strict=True)]
    df = spark.createDataFrame([*rows, ("x", None, 3.0), ("x", 738_000.0, None)], "cluster_id string, day double, k double")
    whole = df.where("day IS NOT NULL AND k IS NOT NULL")
    for model in ("saturation", "linear"):
        ends = dating.multi_start(df, sites, low, model).cache()
        best, dense = dating.joint_fit(ends).first(), dating.fit_groups(whole, sites, low, model).first()
        assert ends.count() == 25 and best.converged and best.n_converged > 0
        assert best.nll == pytest.approx(dense.nll, abs=1e-3) and best.t0 == pytest.approx(dense.t0, abs=5)
        age = day - best.t0
        mu = sites * (-np.expm1(-best.rate * age) if model == "saturation" else best.rate * age)
        assert best.nll == pytest.approx(-(k * np.log(mu) - mu).sum(), rel=1e-9)
        b = dating.bootstrap(df, sites, low, 60, model, within=True).first()
        assert b.replicates == 60 and b.t0_low < best.t0 < b.t0_high
    zeros = dating.multi_start(whole.withColumn("k", F.lit(0.0)), sites, low).collect()
    assert all(r.converged and r.rate == pytest.approx(1e-10) for r in zeros)
    assert dating.multi_start(df.limit(0), sites, low).count() == 0


def test_trees(spark):
    from cohortlens.sources.files import tree_edges

    edges = tree_edges(spark, "((A:1,B:2)n1:1,(C:1,(D:1,E:1):0.5)n2:3)root;").cache()
    assert edges.where("is_leaf").count() == 5
    assert cohort.common_ancestor(edges, ["A", "B"]) == "n1" and cohort.common_ancestor(edges, ["D", "E"]) == "n2" and cohort.common_ancestor(edges, ["A", "E"]) == "root"
    with pytest.raises(ValueError):
        cohort.common_ancestor(edges, ["A", "zzz"])
    got = {r.label: r.cluster for r in cohort.tree_clusters(edges, 1.6).collect()}
    assert got["A"] == "n1" and got["B"] == "B" and got["D"] == got["E"] == "n2" and got["C"] == "n2"
    got = {r.label: r.cluster for r in cohort.tree_clusters(edges, 2.5).collect()}  # within reach of the root
    assert got == {"A": "root", "B": "n1", "C": "n2", "D": "n2", "E": "n2"}
    assert {r.label: r.cluster for r in cohort.tree_clusters(edges, 1e9).collect()} == dict.fromkeys("ABCDE", "root")
    tips = lambda *names: spark.createDataFrame([(n,) for n in names], "label string")
    name = {r.id: r.label for r in edges.collect()}
    pruned = lambda t: {r.label: (name.get(r.parent), r.dist, r.is_leaf) for r in cohort.prune(edges, t).collect()}
    assert pruned(tips("A", "C", "D", "D", "zzz", None)) == {"root": (None, 0.0, False), "n2": ("root", 3.0, False), "A": ("root", 2.0, True), "C": ("n2", 1.0, True), "D": ("n2", 1.5, True)}
    assert pruned(tips("E")) == {"root": (None, 0.0, False), "E": ("root", 4.5, True)}
    assert pruned(tips()) == {"root": (None, 0.0, False)}
    assert len(pruned(tips(*"ABCDE"))) == edges.count()
    assert cohort.prune(edges.limit(0), tips("A")).count() == 0


def test_deep_trees(spark):
    """A chain of 3,000 nodes with a leaf on every fifteenth, and random trees by force."""
    import random

    n = 3_000
    chain = [(k, k - 1 if k else None, f"n{k}" if k % 7 == 0 else "", 1.0, False) for k in range(n)]
    chain += [(n + k, 15 * k, f"leaf{k}", 0.25, True) for k in range(n // 15)] + [(2 * n, n - 1, "end", 1.0, True)]
    edges = spark.createDataFrame(chain, "id long, parent long, label string, dist double, is_leaf boolean")
    assert cohort.common_ancestor(edges, ["leaf60", "leaf199", "end"]) == "n896" and cohort.common_ancestor(edges, ["leaf5", "leaf6"]) == "n70"
    got = {r.label: r.cluster for r in cohort.tree_clusters(edges, 150.0).collect()}
    assert got["leaf20"] == "node_151" and got["leaf1"] == "n0" and got["end"] == "node_2851"
    cut = {r.id: (r.parent, r.dist) for r in cohort.prune(edges, spark.createDataFrame([("leaf3",), ("leaf150",), ("end",)], "label string")).collect()}
    assert cut == {0: (None, 1.0), 45: (0, 45.0), 2250: (45, 2205.0), n + 3: (45, 0.25), n + 150: (2250, 0.25), 2 * n: (2250, 750.0)}
    r = random.Random(7)
    parent = {k: r.choice([k - 1, r.randrange(k), 0]) if k else None for k in range(300)}
    dist = {k: r.choice([0.0, 0.5, 1.0, 2.0, -0.25]) for k in parent}
    leaf = set(parent) - set(parent.values())
    tree = spark.createDataFrame([(k, p, f"t{k}" if k in leaf or k % 2 else "", dist[k], k in leaf) for k, p in parent.items()], edges.schema)
    for threshold in (0.4, 9.0):
        want = {}
        for k in leaf:
            at, gone = k, 0.0
            while parent[at] is not None and gone + dist[at] < threshold:
                at, gone = parent[at], gone + dist[at]
            want[f"t{k}"] = f"t{at}" if at in leaf or at % 2 else f"node_{at}"
        assert {x.label: x.cluster for x in cohort.tree_clusters(tree, threshold).collect()} == want
    up = lambda k: [k, *up(parent[k])] if k is not None else []
    for size in (2, 5):
        tips = r.sample(sorted(leaf), size)
        shared = [a for a in up(tips[0]) if all(a in up(t) for t in tips)]
        found = cohort.lowest_common(tree, spark.createDataFrame([(f"t{t}",) for t in tips], "label string")).first()
        assert found.id == shared[0] and found.n_tips == size and found.label == next((f"t{a}" for a in shared if a % 2), None)
    assert cohort.lowest_common(tree, spark.createDataFrame([("x",)], "label string")).count() == 0


def test_jaccard_interval(spark):
    """The interval of a share is that of the binomial distribution, up to the draws' noise."""
    a, b = spark.range(0, 950).toDF("k"), spark.range(50, 1000).unionByName(spark.range(50, 100)).toDF("k")
    r = cohort.jaccard_interval(a, b, "k").first()
    assert r.jaccard == 0.9 and r.similar and r.low == pytest.approx(0.9 - 1.96 * 0.0095, abs=0.004) and r.high == pytest.approx(0.9 + 1.96 * 0.0095, abs=0.004)
    same = cohort.jaccard_interval(a, a, "k", replicates=50).first()
    assert (same.jaccard, same.low, same.high) == (1.0, 1.0, 1.0)
    nulls = spark.createDataFrame([(None,)], "k long")
    assert tuple(cohort.jaccard_interval(nulls, nulls, "k", replicates=5).first()) == (None,) * 4
    assert cohort.jaccard_interval(nulls, a, "k", replicates=5).first().jaccard == 0.0


def test_cuts_by_ranges(spark):
    """The same rows as a sort of everything, without a limit or window over all of them."""
    rows = [(i, None if i % 50 == 0 else (i * 7919) % 400) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, d int").repartition(7)
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    for share in (0.1, 0.0, 0.335, 1.0):
        got = cohort.without_latest(df, "d", "k", share)
        assert "Limit" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r.k for r in got.collect()) == sorted(k for k, _ in order[: 3000 - round(3000 * share)])
    import hashlib

    some = cohort.subsamples(df, "k", 0.3, 3)
    assert "replicate#" in (plan := some._jdf.queryExecution().optimizedPlan().toString()) and "__range" in plan  # a replicate is not one window
    got = {(r.replicate, r.k) for r in some.collect()}
    want = set()
    for r in (1, 2, 3):
        draws = sorted((hashlib.md5(f"{r + 42}:{k}".encode()).hexdigest(), k) for k, _ in rows)
        want |= {(r, k) for _, k in draws[:900]}
    assert got == want
    assert cohort.without_latest(df.limit(0), "d", "k", 0.1).count() == 0 and cohort.subsamples(df.limit(0), "k", 0.5, 2).count() == 0


def test_ranks_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(stats, "RANGE_ROWS", 50)  # fewer than there are values, so that they are cut
    values = [(i * 7919) % 700 / 4 for i in range(2000)] + [None]
    df = spark.createDataFrame([(i, v, i % 3 == 0) for i, v in enumerate(values)], "k long, v double, f boolean").repartition(5)
    known = sorted(v for v in values if v is not None)
    place = {v: known.index(v) + (known.count(v) + 1) / 2 for v in set(known)}
    got = stats.ranked(df, "v")
    counted = stats.places(df.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("__n")), "v", "__n")
    windows = [x for x in counted._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x and "v#" in x]
    assert windows and all("__range" in x for x in windows)  # no window over all values
    assert {r.k: r.rank_v for r in got.collect()} == {i: place[v] for i, v in enumerate(values) if v is not None}
    first = [v for i, v in enumerate(values[:-1]) if i % 3 == 0]
    u = stats.rank_sum(df, "v", "f").first()
    assert (u.n1, u.u) == (len(first), sum(place[v] for v in first) - len(first) * (len(first) + 1) / 2)


def test_streamed_intake(spark, tmp_path):
    schema = "organism string, clade string, seq_length long, n_fraction double, non_acgtn_fraction double, collection_date string, qc string, frameshift_qc string, at timestamp"
    rows = [("mpxv", "Ia", 10, 0.0, 0.0, "2024", "good", "good"), ("mpxv", "Ia", 197_000, 0.0, 0.0, "2024-05-01", "good", "good")]
    df = spark.createDataFrame(rows, schema.rsplit(",", 1)[0]).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000)))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = intake.reason_counts(stream, "at").writeStream.outputMode("complete").format("memory").queryName("reasons").start()
    q.processAllAvailable()
    q.stop()
    assert {r.reason: r.n for r in spark.table("reasons").collect()} == {"length_lt_190000": 1, "date_resolution_year_lt_month": 1}


def test_columns_over_many_blocks(spark, monkeypatch):
    """Counts of columns against a dictionary: several blocks, groups, odd characters, nulls."""
    import random
    from collections import Counter

    r = random.Random(1)
    rows = [(r.choice(["x", "y", None]), "".join(r.choices("ACGTNacg-é", weights=[9, 5, 5, 9, 2, 1, 1, 1, 1, 1], k=r.choice([0, 3, 4096, 4097, 9000])))) for _ in range(60)] + [("x", None), (None, None)]
    want = Counter((g, i + 1, {"A": 0, "C": 1, "G": 2, "T": 3, "N": 4, "-": 4}.get(c, 5)) for g, s in rows for i, c in enumerate(s or ""))
    out = sequence.column_counts(spark.createDataFrame(rows, "g string, seq string").repartition(5), "g").collect()
    got = {(x.grp, x.pos, k): n for x in out for k, n in enumerate(x[2:]) if n}
    assert got == dict(want) and len(out) == len({k[:2] for k in want})
    assert sequence.column_counts(spark.createDataFrame([], "g string, seq string")).count() == 0
    ref = spark.createDataFrame([("TCéGA",)], "seq string")
    g = spark.createDataFrame([(1, "tté" + "aa"), (2, None), (3, "")], "accession int, seq string")
    assert [tuple(x) for x in sequence.variants(g, ref).collect()] == [(1, 2, "C", "T", "TC"), (1, 4, "G", "A", "GA")]
    assert [tuple(x)[:3] for x in sequence.count_variants(g, ref, same_length=False).orderBy("accession").collect()] == [(1, 2, 2), (3, 0, 0)]


def test_correlation_p(spark):
    """Against the same function of two numbers, and known values of Student's t."""
    rows = [(rho, n) for n in (3, 4, 5, 10, 50, 198, 1000, 10**6) for rho in (-0.999, -0.8289, -0.3, -1e-3, 0.02, 0.5, 0.97)]
    df = spark.createDataFrame([*rows, (1.0, 9), (0.0, 9), (None, 9), (0.5, 2)], "rho double, n long")
    got = {(r.rho, r.n): r.p for r in df.withColumn("p", stats.correlation_p(F.col("rho"), F.col("n"))).collect()}
    for rho, n in rows:
        assert got[rho, n] == pytest.approx(stats.spearman_p(rho, n), rel=1e-9, abs=1e-300), (rho, n)
    assert got[1.0, 9] == 0.0 and got[0.0, 9] == 1.0 and got[None, 9] is None and got[0.5, 2] is None
    assert got[0.5, 10] == pytest.approx(0.14111328, rel=1e-6)  # t = 1.632993, 8 degrees of freedom


def test_quantiles_by_selection(spark, monkeypatch):
    """Against NumPy: groups of all sizes, ties, many magnitudes, nulls, with ranges so small
    that they are cut again and again."""
    import random

    import numpy as np

    from cohortlens.operators import quantiles as Q

    r = random.Random(4)
    draws = {"a": [r.gauss(0, 1) for _ in range(900)], "b": [10 ** r.uniform(-250, 250) * r.choice([1, -1]) for _ in range(700)], "c": [7.0] * 500 + [8.0], "d": [3.5], "e": [float(r.randrange(4)) for _ in range(400)], None: [1.0, 2.0, 4.0], "h": [1e308, -1e308, 1.7e308]}
    rows = [(g, float(v)) for g, vs in draws.items() for v in vs] + [("a", None), ("z", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"q0": 0.0, "q1": 0.25, "q5": 0.5, "q9": 0.937, "q10": 1.0}
    for rows_, small in ((100_000, 100_000), (20, 100_000), (3, 0)):
        monkeypatch.setattr(Q, "SORTED_ROWS", rows_)
        monkeypatch.setattr(Q, "SMALL", small)
        monkeypatch.setattr(Q, "PARTS", 16)
        got = {x.g: x for x in Q.quantiles(df, "v", ["g"], shares).collect()}
        assert set(got) == set(draws)
        for g, vs in draws.items():
            assert got[g]["__n"] == len(vs)
            for name, p in shares.items():
                assert got[g][name] == pytest.approx(float(np.quantile(np.array(vs, np.longdouble), p)), rel=1e-12), (g, name)
    whole = Q.quantiles(df.where("g = 'a'"), "v", [], {"m": 0.5}).collect()
    assert len(whole) == 1 and whole[0].m == pytest.approx(float(np.median(draws["a"])), rel=1e-12)
    assert Q.quantiles(df.limit(0), "v", ["g"], {"m": 0.5}).count() == 0
    out = {x.g: (x.n, x.median) for x in stats.distribution(df, "v", "g").collect()}
    assert out["z"] == (0, None) and out[None] == (3, 2.0) and out["a"][0] == 900


def test_ranks_in_ranges(spark, monkeypatch):
    """Ranks within groups by one range and by several."""
    import random

    r = random.Random(9)
    rows = [(r.choice(["x", "y", None]), r.choice([None, *range(300)])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, v long")
    want = {}
    for g in ("x", "y"):
        vs = sorted(v for k, v in rows if k == g and v is not None)
        want |= {(g, v): vs.index(v) + 1 + (vs.count(v) - 1) / 2 for v in set(vs)}
    for size in (250_000, 50):
        monkeypatch.setattr(stats, "RANGE_ROWS", size)
        out = stats.ranked(df, "v", "g").collect()
        assert {(x.g, x.v): x.rank_v for x in out} == want and len(out) == sum(g is not None and v is not None for g, v in rows)


def test_codon_effects(spark):
    """A gene of two exons on each strand, by hand."""
    #                            0123456789012345678901
    ref = spark.createDataFrame([("ATGTCAGGTTAAAATTACCCAT",)], "seq string")
    # +: ATG|TCA, intron GG, TTA; -: (CAT) of 19-22 reversed: ATG, then 10-13 reversed (AAA): TTT
    exons = spark.createDataFrame([("f", "+", 0, 6), ("f", "+", 8, 11), ("r", "-", 19, 22), ("r", "-", 10, 13), ("s", "+", 20, 22)], "gene string, strand string, start int, end int")
    variants = [("a", 4, "T", "A"), ("a", 6, "A", "G"), ("a", 5, "C", "A"), ("a", 10, "T", "C"), ("a", 7, "G", "A"), ("b", 22, "T", "C"), ("b", 11, "A", "G"), ("b", 13, "A", "C"), ("b", 21, "A", "C")]
    found = spark.createDataFrame(variants, "accession string, pos int, ref string, alt string")
    got = {(x.gene, x.pos): (x.codon, x.ref_aa, x.alt_aa, x.effect) for x in sequence.codon_effects(found, ref, exons).collect()}
    assert got == {
        ("f", 4): (2, "S", "T", "missense"), ("f", 6): (2, "S", "S", "synonymous"), ("f", 5): (2, "S", "*", "stop_gained"), ("f", 10): (3, "L", "S", "missense"),
        ("f", 11): (3, "L", "L", "synonymous"), ("r", 22): (1, "M", "V", "missense"), ("r", 11): (2, "F", "F", "synonymous"), ("r", 13): (2, "F", "V", "missense"), ("r", 21): (1, "M", "R", "missense"), ("s", 22): (1, None, None, None), ("s", 21): (1, None, None, None),
    }


def test_profiles_and_polish(spark):
    """Rates and dates against the dense search and the closed form."""
    import random

    r = random.Random(3)
    rows = [(g, float(738_800 + d), float(max(0, round((0.03 + 0.01 * g) * (d + 400) + r.gauss(0, 2))))) for g in range(3) for d in range(0, 300, 4) for _ in range(2)]
    df = spark.createDataFrame(rows + [(0, None, 3.0), (1, 738_900.0, None)], "g int, day double, k double")
    want = {x.g: x for x in dating.fit_groups(df.where("day IS NOT NULL AND k IS NOT NULL"), 23140.0, 738_000.0, group="g").collect()}
    got = {x.g: x for x in dating.polished_fit(df, 738_000.0, 738_799.0, 23140.0, "saturation", "g", n=60).collect()}
    assert set(got) == {0, 1, 2}
    for g, x in got.items():
        assert x.t0 == pytest.approx(want[g].t0, abs=0.3) and x.rate == pytest.approx(want[g].rate, rel=1e-2)
        assert want[g].nll - 1e-3 < x.nll < want[g].nll + 1e-3 and x.nll <= x.grid_nll
    everyone = dating.polished_fit(df, 738_000.0, 738_799.0, 23140.0, n=20).collect()
    assert len(everyone) == 1 and everyone[0].nll <= everyone[0].grid_nll
    late = dating.polished_fit(df, 739_500.0, 739_600.0, 23140.0, "saturation", "g", n=5).collect()
    assert all(x.t0 is None and x.grid_nll >= 1e18 for x in late) and len(late) == 3
    dates = spark.createDataFrame([(738_500.0,), (738_799.0,), (738_801.0,)], "t0 double")
    clean = df.where("day IS NOT NULL AND k IS NOT NULL")
    closed = {(x.g, x.t0): x for x in dating.linear_profile(clean, dates, 23140.0, "g").collect()}
    lines = {(x.g, x.t0): x for x in dating.rate_profile(df, [738_500.0, 738_799.0, 738_801.0], 23140.0, "linear", "g").collect()}
    assert set(closed) == set(lines) and len(lines) == 6
    for key, x in lines.items():
        assert x.rate == pytest.approx(closed[key].rate, rel=1e-9) and x.nll == pytest.approx(closed[key].nll, rel=1e-9)
    # a rate of the twofold model is one at which the likelihood is flat
    import numpy as np

    day, k = (np.array([row[i] for row in rows if row[0] == 1]) for i in (1, 2))

    def nll(rate):
        mu = 23140 * 0.75 * -np.expm1(-4 / 3 * rate * (day - 738_500))
        return (mu - k * np.log(mu)).sum()

    two = next(x for x in dating.rate_profile(df, [738_500.0], 23140.0, "twofold", "g").collect() if x.g == 1)
    assert two.nll == pytest.approx(nll(two.rate), rel=1e-9) and two.nll < min(nll(two.rate * 1.001), nll(two.rate / 1.001))
    none = spark.createDataFrame([(7, 738_900.0, 0.0)], "g int, day double, k double")
    assert dating.rate_profile(none, [738_500.0], 23140.0, "saturation", "g").first().rate == pytest.approx(1e-12)


def test_poisson_draws(spark):
    """Chances of drawn counts, means from 0 to a million, odd input."""
    from math import exp, lgamma, log

    from cohortlens.functions import draws

    df = spark.range(20_000).select(draws.uniform(F.lit(7), F.col("id")).alias("u"))
    for mean in (0.01, 0.9, 3.7, 40.5):
        seen = {x.k: x.n for x in df.select(draws.poisson(F.lit(mean), F.col("u")).alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}
        for k in range(60):
            p = exp(k * log(mean) - mean - lgamma(k + 1))
            assert abs(seen.get(k, 0) - 20_000 * p) <= 5 * (20_000 * p) ** 0.5 + 3, (mean, k)
    big = df.limit(500).select(draws.poisson(F.lit(1e6), F.col("u")).alias("k")).agg(F.avg("k"), F.stddev("k")).first()
    assert big[0] == pytest.approx(1e6, abs=300) and big[1] == pytest.approx(1000, rel=0.2)
    odd = spark.createDataFrame([(0.0, 0.5), (-1.0, 0.5), (None, 0.5), (2.0, None), (float("nan"), 0.5), (2.0, 0.0)], "m double, u double")
    assert [x.k for x in odd.select(draws.poisson(F.col("m"), F.col("u")).alias("k")).collect()] == [0, 0, None, None, None, 2]
    facts = spark.range(0, 200, 7).select("id", draws.log_factorial(F.col("id")).alias("x")).collect()
    assert all(x.x == pytest.approx(lgamma(x.id + 1), abs=1e-12 * max(1, lgamma(x.id + 1))) for x in facts)
    assert all(0 <= x.u < 1 for x in df.limit(100).collect())


def test_poisson_replicates(spark):
    df = spark.createDataFrame([(1, 100.0, 4.0), (1, 100.0, 6.0), (1, 120.0, 9.0), (None, 90.0, 1.0), (1, None, 2.0), (1, 50.0, None)], "g int, day double, k double")
    fits = spark.createDataFrame([(1, 60.0, 1e-4)], "g int, t0 double, rate double")
    out = dating.poisson_replicates(df, fits, 1000.0, 3000, "saturation", "g")
    rows = {x.day: x for x in out.groupBy("g", "day").agg(F.count("*").alias("c"), F.avg("k").alias("m"), F.variance("k").alias("v"), F.max("n").alias("n")).collect()}
    assert set(rows) == {100.0, 120.0} and rows[100.0].n == 2.0
    for day, n in ((100.0, 2), (120.0, 1)):
        mean = n * 1000 * (1 - math.exp(-1e-4 * (day - 60)))
        assert rows[day].c == 3000 and rows[day].m == pytest.approx(mean, abs=5 * (mean / 3000) ** 0.5) and rows[day].v == pytest.approx(mean, rel=0.15)
    assert sorted(out.collect()) == sorted(dating.poisson_replicates(df.repartition(3), fits, 1000.0, 3000, "saturation", "g").collect())


def test_tree_steps_pass_no_table_through_the_driver(spark, monkeypatch):
    """Each step's join sorts both sides: none is collected for a broadcast, however small."""
    from cohortlens.workspace import Workspace

    plans, table = [], Workspace.table

    def seen(ws, df, name, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return table(ws, df, name, **options)

    edges = [(1, None, "r", 1.0, False)] + [(i, max(1, i - 1 - i % 3), f"n{i}", 1.0, i > 25) for i in range(2, 31)]
    frame = spark.createDataFrame(edges, "id long, parent long, label string, dist double, is_leaf boolean")
    path = Workspace(spark, "test")
    frame = path.table(frame, "edges")  # of known size, so that Spark would broadcast it
    tips = path.table(frame.where("id > 28").select("label"), "tips")
    monkeypatch.setattr(Workspace, "table", seen)
    ends = [cohort.tree_clusters(frame, 4.0), cohort.prune(frame, tips), cohort.ancestors(frame)]
    plans += [x._jdf.queryExecution().executedPlan().toString() for x in ends]
    assert cohort.lowest_common(frame, tips).first().n_tips == 2
    assert len(plans) > 20 and not [x for x in plans if "Broadcast" in x]
