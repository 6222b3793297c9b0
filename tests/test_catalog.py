"""Every query with a SQL twin agrees with it on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from cohortlens.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    at = [want.columns.index(c) for c in order]
    rows = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    assert rows == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=str)


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0


def test_whole_sequences(spark, tmp_path):
    """The sequence queries over whole texts, against brute force; most letters are past the 512th."""
    import random
    from collections import Counter, defaultdict

    r = random.Random(2)
    texts = {k: "".join(r.choices("abcdefghijklmnopqrstuvwxyzABC .,", k=n)) for k, n in enumerate((2100, 1500, 900, 2600, 300, 0, 1700, 1800, 1900, 2000))}
    texts |= {k: texts[6][:700] + texts[0][700:1700] for k in range(20, 26)}
    docs = [(k, t, ("fr", "de")[k % 2] if k < 20 else "fr" if k < 23 else "de") for k, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")

    def run(name):
        df = entry.queries()[f"seq_whole_{name}"](spark, str(tmp_path))
        return [tuple(tuple(v) if isinstance(v, list) else v for v in x) for x in df.collect()]

    seqs = {k: "".join("ACGT"[(ord(c) - 97) % 4] for c in t.lower() if c.isalpha()) for k, t in texts.items()}
    ref = seqs[0]
    context = lambda i: "TC" if ref[i] == "C" and ref[i - 1 : i] == "T" else "GA" if ref[i] == "G" and ref[i + 1 : i + 2] == "A" else None
    sites = {i + 1: context(i) for i in range(len(ref)) if context(i)}
    edited = {"TC": ("C", "T"), "GA": ("G", "A")}
    found = [(k, i + 1, a, b, context(i) if edited.get(context(i)) == (a, b) else None) for k, q in seqs.items() for i, (a, b) in enumerate(zip(ref, q, strict=False)) if a != b]
    assert max(x[1] for x in found) > 1500
    key = lambda rows: sorted(rows, key=str)
    assert key(run("variants")) == key(found)
    assert key(run("eligible_sites")) == key(sites.items())
    n = Counter(sites.values())
    assert run("site_totals") == [(len(sites), n["TC"], n["GA"])]
    assert key(run("occupancy")) == key((*at, c) for at, c in Counter((x[1], x[4]) for x in found if x[4]).items())
    total, inside = Counter(x[0] for x in found), Counter(x[0] for x in found if x[4])
    assert key(run("variant_counts")) == key((k, total[k], inside[k], total[k] - inside[k], round(inside[k] / total[k], 6) if total[k] else 0.0) for k in seqs)
    assert dict(run("reverse_complement")) == {k: q[::-1].translate(str.maketrans("ACGT", "TGCA")) for k, q in seqs.items()}
    assert dict(run("mask")) == {k: q[:10] + "N" * (min(len(q), 40) - 10) + q[40:] if len(q) > 10 else q for k, q in seqs.items()}
    columns, by_group = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for (k, q), (_, _, lang) in zip(seqs.items(), docs, strict=True):
        for i, c in enumerate(q):
            columns[i + 1][c] += 1
            by_group[i + 1][lang][c] += 1
    assert key(run("columns")) == key((i, len(c), 0.0, len(c) > 1, False) for i, c in columns.items())
    hits = Counter((i, s) for i, s in sites.items() for q in seqs.values() if q[i - 1 : i] == edited[s][1])
    assert key(run("homoplasy")) == key((*at, c) for at, c in hits.items())

    def shorter(q, f):
        keep = round(len(q) * f)
        start = (len(q) - keep) // 2
        return "-" * start + q[start : start + keep] + "-" * (len(q) - keep - start)

    assert key(run("ladder")) == key((k, f, shorter(q, f)) for k, q in seqs.items() for f in (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.1))
    calls = []
    for i, groups in by_group.items():
        top = {}
        for g, c in groups.items():
            (base, most), second = min(c.items(), key=lambda x: (-x[1], x[0])), sorted(c.values())[-2:-1]
            if most - sum(second) >= 3:
                top[g] = base
        if len(top) == 2 and len(set(top.values())) == 2:
            calls.append((i, tuple(sorted(f"{g}:{c}" for g, c in top.items()))))
    assert key(run("diagnostic")) == key(calls)


def test_bootstrap_replicates(spark):
    if os.path.isdir(SF):
        assert {r.replicates for r in entry.queries()["ml_bootstrap"](spark, SF).collect()} == {2000}
