"""Panels, trees of any depth, files of any size, tails of any height: small and odd cases."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import cohort, dating, detect, panels, sequence, stats
from cohortlens.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_deep_tree(spark):
    """A chain far deeper than a recursive query may go in small steps, with branches."""
    n = 300
    edges = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}", 1.0) for i in range(n)] + [(1000, 5, "x", 2.5)], "id long, parent long, label string, dist double")
    up = cohort.ancestors(edges)
    assert up.count() == n * (n + 1) // 2 + 7
    assert rows(up.where("id = 1000 AND depth IN (0, 1, 6)").select("ancestor", "depth", "dist")) == sorted([(1000, 0, 0.0), (5, 1, 2.5), (0, 6, 7.5)], key=str)
    assert cohort.ancestors(edges.limit(0)).count() == 0


def test_penalty_is_of_the_whole_vector(spark):
    df = spark.createDataFrame([(10.0, 2.0), (3.0, 1.0), (1.0, 0.0)], "day double, k double")
    at = lambda t: dating.likelihoods(df, spark.createDataFrame([(t, 0.001)], "t0 double, rate double"), 100.0, "linear").first()["nll"]
    assert at(5.0) == pytest.approx(1e18 + 6e6, abs=200) and at(1.0) == 1e18
    mu = [0.1 * (d + 1) for d in (10, 3, 1)]
    assert at(-1.0) == pytest.approx(-sum(k * math.log(m) - m for k, m in zip((2, 1, 0), mu, strict=True)))


def test_tails(spark):
    z = [-9.0, -2.6, -2.4, 0.0, 0.3, 2.49, 2.51, 6.0, 20.0, 37.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(stats.normal_tail(F.col("z"))).collect()]
    assert all(g == pytest.approx(math.erfc(x / math.sqrt(2)) / 2, rel=1e-11) for g, x in zip(got, z, strict=True))


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"\0\xff" * 700_000)
    (tmp_path / "in" / "b b.txt").write_bytes(b"x")
    whole, streamed = (rows(files.manifest(spark, f"{tmp_path}/in", small)) for small in (1 << 28, -1))
    assert whole == streamed and hashlib.sha256(b"\0\xff" * 700_000).hexdigest() in str(whole)
    one = files.folder_record(files.manifest(spark, f"{tmp_path}/in")).first()
    assert (one["files"], one["size"]) == (2, 1_400_001) and len(one["sha256"]) == 64
    (tmp_path / "p.json").write_text(json.dumps({"L_total": 5, "x": {"y": [1, 2]}}, indent=1))
    assert files.read_parameters(spark, f"{tmp_path}/p.json") == {"L_total": 5, "x": {"y": [1, 2]}}
    (tmp_path / "b.jsonl").write_text('{"accession": "A", "location": {"name": "X"}}\n\n{"accession": "B"}\n')
    assert rows(files.read_bundle(spark, f"{tmp_path}/b.jsonl", {"acc": "accession", "place": "location.name"})) == [("A", "X"), ("B", None)]
    (tmp_path / "clock.txt").write_text("Root-Tip-Regression:\n --rate:\t1.5e-05\n --intercept: -3\n --r^2:\t0.2\n")
    assert rows(files.clock_lines(spark, f"{tmp_path}/clock.txt")) == [("intercept", -3.0), ("rate", 1.5e-05)]
    nodes = spark.createDataFrame([("NODE_1",), ("tip",), ("the_Root",)], "node string")
    assert rows(files.clock_roots(nodes)) == [("NODE_1",), ("the_Root",)]
    (tmp_path / "rec.csv").write_text("P,Q,kid,3,0.5,1e-9\nP\tR\tkid\t0\t7\nP,Q,other,1e-30\n")
    assert files.scan_p(spark, f"{tmp_path}/rec.csv", "kid").first() == (True, 1e-9, 2) and files.scan_p(spark, f"{tmp_path}/rec.csv", "none").first() == (False, None, 0)
    assert files.mask_source(("user", None), ("dataset", "d.bed"), ("repeat", "r.bed")) == ("dataset", "d.bed") and files.mask_source(("user", None)) is None


def test_panels(spark):
    aligned = spark.createDataFrame([(x,) for x in "abcdk"], "accession string")
    panel, cand = (spark.createDataFrame([(x,) for x in t], "accession string") for t in ("abz", ["a", "c", "y", "c"]))
    assert rows(panels.subsets(cand, panel, "k", aligned)) == [("a", 3, "subset_too_small_3"), ("c", 4, None), ("y", 3, "missing_from_alignment")]
    records = spark.createDataFrame([(i, f"r{i}") for i in range(1, 6)], "n int, id string")
    members = spark.createDataFrame([("r1",), ("r2",), ("r2",), ("r4",)], "id string")
    assert panels.block_integrity(records, members, "id", "n", 2).first() == (2, True) and panels.block_integrity(records, members, "id", "n", 3).first() == (2, False)
    a, b = (spark.createDataFrame([(x,) for x in t], "k string") for t in (["x", "x", None, "y"], ["y", "z"]))
    assert rows(panels.overlap(a, b, "k")) == [("x", "a"), ("y", "both"), ("z", "b")]
    assert panels.overlap(a.limit(0), b.limit(0), "k").count() == 0
    calls = spark.createDataFrame([("c", True), ("d", True), ("e", False)], "accession string, candidate boolean")
    got = detect.hypotheses(calls, "c", 10).first()
    assert (got.k, got.h3, got.h4) == (1, True, True) and detect.hypotheses(calls.limit(0), "c", 10).first()["h4"] is False


def test_branches_and_genes(spark):
    ref = spark.createDataFrame([("TCGAAC",)], "seq string")
    tips = spark.createDataFrame([("a", "Ib", "ttaaac"), ("b", "Ib", "TCGAA"), ("c", "IIb", "TTGAAC"), ("d", "Ib", "TCGAAC")], "accession string, clade string, seq string")
    found, state = sequence.branch_counts(tips, ref)
    assert rows(found) == [("a", 2, 2, 0, 1.0), ("d", 0, 0, 0, 0.0)] and state.first() == (3, 1)
    genes = spark.createDataFrame([("g", 0, 2), ("h", 1, 3), ("far", 4000, 9000)], "gene string, start int, end int")
    out = sequence.annotate(sequence.variants(tips.where("accession = 'a'"), ref), ref, genes)
    assert rows(out.select("pos", "trinucleotide", "gene")) == [(2, "TCG", "g"), (3, "CGA", "h")]
    same = sequence.variant_counts(tips.where("clade = 'Ib'"), sequence.variants(tips, ref, same_length=False))
    assert rows(same) == rows(sequence.count_variants(tips.where("clade = 'Ib'"), ref, same_length=False))
    mixed = "".join("ACGT"[(i * i + i // 3) % 4] for i in range(1250))
    both = spark.createDataFrame([(mixed + "ttttt" + mixed[::-1].translate(str.maketrans("ACGT", "tgca")),), (mixed,), (None,)], "seq string")
    assert [r[0] for r in both.select(sequence.terminal_repeat(F.col("seq"))).collect()][:2] == [1250, 0]
