"""Queries of the subpackage that have SQL twins, on the smallest tables."""

import os

import pytest

from cohortlens.llm import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["op4_site_lines", "op7_poisson_mix", "op8_minhash", "op9_host_reputation", "op12_multi_index", "op13_max_score"])
def test_query_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    want = con.sql(catalog.oracle_sql()[name])
    order = sorted(df.columns)
    at = [want.columns.index(c) for c in order]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert len(order) == len(want.columns)
    assert sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str) == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=str)


def test_every_number_has_one_query():
    names = list(catalog.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names
