"""Readers and writers on small files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import sequence
from cohortlens.sources import files, sinks


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    path = put(tmp_path / "x.fa", ">a one\nACGT\nAC\n>b\nGG\n>a again\nTT\n\n")
    rows = files.read_fasta(spark, path).orderBy("ord").collect()
    assert [(r.accession, r.header, r.seq) for r in rows] == [("a", "a one", "ACGTAC"), ("b", "b", "GG"), ("a", "a again", "TT")]
    assert {r.accession: r.seq for r in files.last_records(files.read_fasta(spark, path)).collect()} == {"a": "TT", "b": "GG"}
    with pytest.raises(Exception, match="different lengths"):
        files.read_alignment(spark, path).collect()
    sinks.write_fasta(files.read_fasta(spark, path), f"{tmp_path}/out", keep=spark.createDataFrame([("b",)], "accession string"), wrap=1)
    assert "".join(r.value + "\n" for r in spark.read.text(f"{tmp_path}/out").collect()) == ">b\nG\nG\n"


def test_fasta_order_of_parts(spark, tmp_path):
    """Files of a folder by path, parts of a file by place, though Spark reads larger ones first."""
    (tmp_path / "f").mkdir()
    for name, ids in (("part-0", range(3)), ("part-1", range(3, 90)), ("part-2", [2, 1])):
        put(tmp_path / "f" / name, "".join(f">r{i}\n{'ACGT' * (1 + i % 7)}{'A' * len(name) * (len(ids) == 2)}\n" for i in ids))
    for size in ("128m", "300"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = files.read_fasta(spark, f"{tmp_path}/f")
            assert [x.accession for x in found.orderBy("ord").collect()] == [f"r{i}" for i in [*range(90), 2, 1]], size
            last = {x.accession: x.seq for x in files.last_records(found).collect()}
            assert len(last) == 90 and last["r1"] == "ACGT" * 2 + "A" * 6 and last["r3"] == "ACGT" * 4
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tables_and_intervals(spark, tmp_path):
    path = put(tmp_path / "m.tsv", " Accession \tqc.overallStatus\n x1 extra\t good \ny2\tbad\n")
    assert [tuple(r) for r in files.read_metadata(spark, path).collect()] == [("x1", "good"), ("y2", "bad")]
    bed = put(tmp_path / "b.bed", "#c\ntrack x\nchr\t1\t5\tITR\nchr\t5\t5\nchr\ta\t9\nchr\t7\t9\n\n")
    assert [tuple(r) for r in files.read_bed(spark, bed).collect()] == [(1, 5, "ITR"), (7, 9, None)]
    state = put(tmp_path / "n.state", "# c\nNode\tSite\tState\tp_A\nn1\t1\tA\t1\nn1\t3\t-\t1\nn1\t4\tg\t1\nn2\t1\tC\t1\n")
    assert [r.base for r in files.read_node_state(spark, state, "n1").orderBy("site").collect()] == ["A", "N", "N", "G"]
    with pytest.raises(ValueError):
        files.read_node_state(spark, state, "n9")


def test_detector_files(spark, tmp_path):
    head = "P_name,Q_name,C_name,m,n,k,p,HS?,log10(p),DS(p),DS(p),min_rec_length,breakpoints\n"
    rec = put(tmp_path / "r.csv", head + "a,b,c,1,2,3,0.1,0,-1,0.00000,3.9e-03,100,1-2 & 3-4\na,b,d,1,2,3,0.1,0,-1,0.00391,3.911e-03,100,1-2, 3-4\nshort,line\n")
    rows = {r.child: r for r in files.read_triplets(spark, rec).collect()}
    assert rows["c"].p == 3.9e-03 and rows["d"].p == 3.91e-03 and rows["d"].breakpoints == "1-2, 3-4"
    assert files.read_triplets(spark, rec, drop_ragged=True).count() == 1
    text = "PHI (Permutation): 1.0e-02 x\nPHI (Normal): --\nMax Chi^2: 0.5"
    r = spark.createDataFrame([(text,)], "t string").select(*files.permutation_values(F.col("t"))).first()
    assert tuple(r) == (0.01, None, None, 0.5)
    hist = put(tmp_path / "h", " 0 10 0.5 -0.3\n 1 0 0.0 N/A\n")
    assert [tuple(x) for x in files.read_p_histogram(spark, hist).collect()] == [(0, 10, 0.5, -0.3), (1, 0, 0.0, None)]
    assert [x.accession for x in files.read_tokens(spark, put(tmp_path / "l", "a b\n\n c\n")).collect()] == ["a", "c"]


def test_manifest_and_resume(spark, tmp_path):
    (tmp_path / "d").mkdir()
    put(tmp_path / "d" / "x.txt", "hello")
    m = files.manifest(spark, f"{tmp_path}/d")
    r = m.first()
    assert (r["size"], r.sha256) == (5, hashlib.sha256(b"hello").hexdigest())
    old = m.withColumn("sha256", F.lit("0")).union(spark.createDataFrame([("gone", 1, "1")], "path string, size long, sha256 string"))
    assert {x.state for x in files.verify_manifest(m, old).collect()} == {"changed", "missing"}
    work = spark.range(3).withColumnRenamed("id", "seed")
    sinks.append_run(work.where("seed = 1").withColumn("v", F.lit(1)), f"{tmp_path}/runs", "seed")
    assert {x.seed for x in sinks.remaining(work, spark.read.parquet(f"{tmp_path}/runs"), "seed").collect()} == {0, 2}
    sinks.write_tsv(spark.createDataFrame([(["a", "b"], 1)], "r array<string>, n int"), f"{tmp_path}/t")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/t").first().r == "a|b"


def test_masks_from_a_bed_file(spark, tmp_path):
    """Read, masked and written in one plan, against a fold over every interval."""
    import random

    r = random.Random(3)
    for n in (0, 1, 40, 300):
        spans = [(s, s + r.choice([0, 1, 2, 7, 50])) for s in (r.randrange(-5, 420) for _ in range(n))]
        path = put(tmp_path / f"m{n}.bed", "track\n" + "".join(f"ref\t{s}\t{e}\n" for s, e in spans))
        seqs = {"a": "".join(r.choices("ACGT-", k=400)), "b": "ACé" * 30, "c": "", "d": None, "e": "A"}
        genomes = spark.createDataFrame([(k, s, i) for i, (k, s) in enumerate(seqs.items())], "accession string, seq string, ord int")
        got = {x.accession: x.seq for x in sequence.mask_intervals(genomes, files.read_bed(spark, path)).collect()}
        for k, s in seqs.items():
            want = None if s is None else "".join("N" if any(a <= i < b for a, b in spans) else c for i, c in enumerate(s))
            assert got[k] == want, (n, k)
        union = [(x.start, x.end) for x in sequence.union_intervals(files.read_bed(spark, path)).orderBy("start").collect()]
        covered = {i for a, b in spans for i in range(max(0, a), b)}
        assert {i for a, b in union for i in range(a, b)} == covered and all(b < c for (_, b), (c, _) in zip(union, union[1:], strict=False))
    by_key = spark.createDataFrame([("a", 0, 3), ("a", 2, 5), (None, 0, 9), ("e", -4, 0)], "accession string, start int, end int")
    got = {x.accession: x.seq for x in sequence.mask_intervals(genomes, by_key, "accession").collect()}
    assert got["a"][:6].count("N") == 5 and got["b"] == seqs["b"] and got["e"] == "A"
    children = spark.createDataFrame([("e",), ("a",), ("zzz",)], "accession string")
    sinks.write_condition_fasta(genomes.where("accession <> 'd'"), children, f"{tmp_path}/c", spark.createDataFrame([(0,), (2,), (2,)], "column int"))
    lines = "".join(x.value + "\n" for x in spark.read.text(f"{tmp_path}/c").collect()).split("\n")
    assert lines[:5] == [">a", "N" + seqs["a"][1] + "N" + seqs["a"][3:], ">e", "N", ">b"] and lines[5].startswith("NCN") and lines[6] == ">c"


def test_summaries_candidates_and_sites(spark, tmp_path):
    import json

    values = spark.createDataFrame([(3, 0.5)], "n int, share double")
    sinks.write_summary(f"{tmp_path}/s", values, by_clade=spark.createDataFrame([("b", 2), ("a", 1)], "clade string, n int"), none=spark.createDataFrame([], "x int"))
    text = "".join(x.value + "\n" for x in spark.read.text(f"{tmp_path}/s").collect())
    assert json.loads(text) == {"n": 3, "share": 0.5, "by_clade": [{"clade": "a", "n": 1}, {"clade": "b", "n": 2}], "none": []} and "\n  " in text
    assert files.read_parameters(spark, f"{tmp_path}/s")["by_clade"][1] == {"clade": "b", "n": 2}
    sites = spark.createDataFrame([(9, "TC", 2), (3, "GA", 1)], "pos int, context string, occupancy long")
    sinks.write_bed(sites, f"{tmp_path}/b", header="sites of the cohort")
    assert [x.value for x in spark.read.text(f"{tmp_path}/b").collect()] == ["# sites of the cohort", "ref\t2\t3\tGA\t1", "ref\t8\t9\tTC\t2"]
    assert [tuple(x) for x in files.read_bed(spark, f"{tmp_path}/b").orderBy("start").collect()] == [(2, 3, "GA"), (8, 9, "TC")]
    (tmp_path / "j").mkdir()
    put(tmp_path / "j" / "2.json", '{\n "accession": "y", "phi_perm_p": 0.5, "other": [1]\n}')
    put(tmp_path / "j" / "1.json", '{"accession": "x", "parents": ["p", "q"]}')
    assert [(x.accession, x.phi_perm_p, x.parents) for x in files.read_candidate_json(spark, f"{tmp_path}/j").collect()] == [("x", None, ["p", "q"]), ("y", 0.5, None)]
    files_ = spark.createDataFrame([("b", "2"), ("a", "1")], "path string, sha256 string")
    sinks.write_checksums(files_, f"{tmp_path}/k")
    assert [x.value for x in spark.read.text(f"{tmp_path}/k").collect()] == ["1  a", "2  b"]
    both = files.union_accessions(spark.createDataFrame([("a",), (None,)], "accession string"), spark.createDataFrame([("a",), ("c",)], "accession string"))
    assert {x.accession for x in both.collect()} == {"a", "c"}


def test_trees_of_any_size(spark, tmp_path, monkeypatch):
    """The same edges as the small parser, for odd spellings and random trees read in pieces."""
    import random

    r = random.Random(5)

    def grown(n):
        if n <= 1:
            return r.choice(["A", "'b c'", "", " x "]) + r.choice(["", ":1.5", ":0", ":2e-3"])
        cuts = sorted(r.sample(range(1, n), min(n - 1, r.choice([1, 1, 2, 5]))))
        inner = ",".join(grown(b - a) for a, b in zip([0, *cuts], [*cuts, n], strict=True))
        return f"({inner}){r.choice(['', 'n', 'k'])}" + r.choice(["", ":3.25"])

    chain = "(" * 400 + "a" + "".join(f",t{k}:1)n{k}:2" for k in range(400)) + ";"
    trees = ["((A:1,B:2)n1:1,(C:1,(D:1,E:1):0.5)n2:3)root;", "A;", "(A);", "((A));", "(,(,),);\n(B,C);", "( (A:1 , 'q r':2 ) n1:1\n,\nC)r:0.5;", chain] + [grown(n) + ";" for n in (2, 9, 300)]
    for block in (1 << 16, 8):
        monkeypatch.setattr(files, "TREE_BLOCK", block)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 200 if block == 8 else 128 << 20)
        try:
            for k, text in enumerate(trees if block == 8 else trees[:2]):
                got = sorted(tuple(x) for x in files.newick_tree(spark, put(tmp_path / f"t{block}-{k}.nwk", text)).collect())
                assert got == sorted(files.read_newick(text)), text[:80]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_last_record_counts_across_files(spark, tmp_path):
    """Records written again in a later file count, though Spark reads the rest of an earlier file after it."""
    ids = spark.range(400).select(F.col("id").cast("string").alias("accession"))
    first = ids.select("accession", F.lit("ACGT" * 20).alias("seq"), F.lit(0).alias("ord"))
    again = ids.where("accession % 3 = 0").select("accession", F.lit("TG" * 20).alias("seq"), F.lit(1).alias("ord"))
    sinks.write_fasta(first.coalesce(1), f"{tmp_path}/x/1")
    sinks.write_fasta(again.coalesce(1), f"{tmp_path}/x/2")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        last = files.last_records(files.read_fasta(spark, f"{tmp_path}/x/*")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {x.accession: x.seq for x in last} == {str(i): "ACGT" * 20 if i % 3 else "TG" * 20 for i in range(400)}


def test_fasta_of_few_places_written_by_many_tasks(spark, tmp_path):
    """Two values of ``ord`` do not send all records to two tasks; the second ones still come last."""
    ids = spark.range(600).select(F.col("id").cast("string").alias("accession"))
    first = ids.select("accession", F.lit("ACGT").alias("seq"), F.lit(0).alias("ord"))
    again = ids.where("accession % 3 = 0").select("accession", F.lit("TG").alias("seq"), F.lit(1).alias("ord"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        sinks.write_fasta(first.union(again), f"{tmp_path}/x")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = files.read_fasta(spark, f"{tmp_path}/x")
    sizes = [r["count"] for r in found.groupBy("ord.file").count().collect()]
    assert sum(sizes) == 800 and max(sizes) < 400
    seqs = [r.seq for r in found.orderBy("ord").collect()]
    assert seqs == ["ACGT"] * 600 + ["TG"] * 200
    assert {r.accession: r.seq for r in files.last_records(found).collect()} == {str(i): "ACGT" if i % 3 else "TG" for i in range(600)}


def test_a_file_a_row_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Every row has its own file, whatever the number of tasks that the input comes in."""
    monkeypatch.setattr(sinks, "FILES_A_TASK", 5)
    lines = spark.range(23).coalesce(1).select("id", F.format_string("v%02d", "id").alias("value"))
    sinks.write_each(lines, f"{tmp_path}/each", "id")
    found = [x for x in (tmp_path / "each").iterdir() if x.name.startswith("part-")]
    assert sorted(x.read_text() for x in found) == [f"v{i:02d}\n" for i in range(23)]
    assert len({x.name.split("-")[1] for x in found}) > 1
    sinks.write_each(lines.limit(0), f"{tmp_path}/none", "id")
    assert not spark.read.text(f"{tmp_path}/none").head(1)
