"""Whitening and the multi-index against NumPy over whole tables, and on odd rows."""

import math
import random

import numpy as np
import pytest

from cohortlens.llm import graph, multiindex, whitening
from cohortlens.workspace import Workspace

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string, component int, key string, `a.b` int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x", 3, "k", 4) for i, v, label in rows], SCHEMA)


def plain(x: list[float]) -> list[int]:
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in x]


def test_whitening_against_numpy(spark):
    r = np.random.default_rng(3)
    mixing = r.standard_normal((40, 40))
    rows = [(i, (r.standard_normal(40) @ mixing / 8).tolist(), 0) for i in range(700)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(900)]  # a vector that most rows hold
    rows += [(2, None, 0), (3, [1.0, None] * 20, 0), (4, [float("nan")] * 40, 0), (5, [float("inf")] * 40, 0), (6, [1.0] * 7, 0), (7, [1e30] * 40, 0), (None, rows[6][1], None), (10, rows[10][1], 0)]
    p = whitening.Whitening(components=8, tile=12, row_block=100)
    got = whitening.whiten(table(spark, rows), p).collect()
    good = [(i, plain(v)) for i, v, _ in rows if v is not None and len(v) == 40 and all(c is not None and abs(c) < 1e20 for c in v)]
    assert len(got) == 8 * len(good)
    fit = np.array(sorted({tuple(x) for _, x in good}))
    n, total = len(fit), fit.sum(axis=0)
    c = (fit * n - total) / n
    v = c.T @ c / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    by = {}
    for x in got:
        by.setdefault(x.vec_id, {}).setdefault(x.component, []).append(x)
    sign = None
    for i, x in good:
        want = ((np.array(x) * n - total) / n) @ axes / np.sqrt(values)
        own = np.array([by[i][k + 1][0].whitened for k in range(8)])
        sign = np.sign(own * want) if sign is None else sign
        assert np.allclose(own, want * sign, atol=1e-9)
        assert by[i][1][0].deviation == sum((n * a - int(s)) ** 2 for a, s in zip(x, total, strict=True)) and by[i][1][0].n == n
    assert len(by[10][1]) == 2 and len(by[None][1]) == 1
    one = {x.component: x for x in got if x.vec_id == good[0][0]}
    assert all(one[k + 1].explained == pytest.approx(values[k] / np.trace(v), rel=1e-9) for k in range(8))
    assert {x.identity_error for x in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_without_variance(spark):
    flat = [(i, [float(i % 3), 1.0, float(i % 3)], 0) for i in range(9)]
    got = whitening.whiten(table(spark, flat)).collect()
    first = [x for x in got if x.component == 1]
    assert len(got) == 27 and all(x.whitened is not None for x in first) and all(x.whitened is None for x in got if x.component > 1)
    assert first[0].explained == pytest.approx(1.0) and first[0].identity_error < 1e-9
    same = whitening.whiten(table(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert len(same) == 4 and {(x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in same} == {(1, 0, None, None, None)}
    assert whitening.whiten(table(spark, [])).count() == 0 and whitening.whiten(table(spark, [(1, None, 0), (2, [], 0)])).count() == 0


def test_sums_beyond_64_bits():
    x = np.array([[1 << 61, 5], [1 << 61, 7]])
    off = whitening._times_n_less_sum(x, 6, [12 << 61, 11])
    assert off.tolist() == [[-6 << 61, 19], [-6 << 61, 31]]


def brute(rows, cosine=0.93):
    seen, valid = set(), []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v) or not any(v) or len(v) != 24:
            continue
        if (i, tuple(v), label) not in seen:
            seen.add((i, tuple(v), label))
            valid.append((i, np.array(np.float32(v), float), label))
    links = {}
    for a, (i, u, x) in enumerate(valid):
        for j, v, y in valid[a + 1 :]:
            if x == y and i != j and u @ v / math.sqrt((u @ u) * (v @ v)) >= cosine:
                links.setdefault(i, set()).add(j)
                links.setdefault(j, set()).add(i)
    component = {}
    for i in sorted({i for i, *_ in rows if i is not None}):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in component:
                component[k] = i
                todo += links.get(k, ())
    return links, component


@pytest.mark.parametrize("members, queries", [(4096, 32768), (7, 11)])
def test_multi_index_against_all_pairs(spark, members, queries):
    r = np.random.default_rng(5)
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    centres = [r.standard_normal(24) for _ in range(12)]
    rows = [(i, unit(r.standard_normal(24)), i % 3) for i in range(150)]
    rows += [(1000 + i, unit(centres[i % 12] + r.standard_normal(24) * 0.2), i % 2) for i in range(150)]
    rows += [(2000 + i, unit(centres[0] * 3), 1) for i in range(120)]  # copies of one vector
    u, w = np.linalg.qr(r.standard_normal((24, 2)))[0].T
    chain = [unit(np.cos(0.3 * k) * u + np.sin(0.3 * k) * w) for k in range(10)]
    rows += [(3000 + k, v, 0) for k, v in enumerate(chain)]
    rows += [(3, rows[3][1], 0), (4000, [0.0] * 24, 0), (4001, None, 0), (4002, [1.0, None] * 12, 0), (4003, [float("nan")] * 24, 0), (4004, rows[0][1], None), (None, rows[0][1], 0), (4005, [1.0], 0), (4006, (np.array(rows[0][1]) * 1e-30).tolist(), 0)]
    random.Random(1).shuffle(rows)
    p = multiindex.MultiIndex(members=members, queries=queries)
    got = multiindex.near_vectors(table(spark, rows), p).collect()
    links, component = brute(rows)
    assert len(got) == len(rows) and sum(map(len, links.values())) > 15_000
    for x in got:
        if x.vec_id is None:
            assert (x.n_links, x.component_id, x.kept) == (0, None, True)
        else:
            assert (x.vec_id, x.n_links, x.component_id) == (x.vec_id, len(links.get(x.vec_id, ())), component[x.vec_id])
            assert x.kept == (x.vec_id == x.component_id)
    assert multiindex.near_vectors(table(spark, [])).count() == 0
    assert [tuple(x) for x in multiindex.near_vectors(table(spark, [(1, None, 0)])).collect()] == [(1, 0, 1, True)]


def test_visits_find_neighbours_at_the_threshold():
    r = np.random.default_rng(8)
    x = multiindex._unit(r.standard_normal((3000, 32)))
    g = multiindex.fit_grid(x[:1000], 3000, multiindex.MultiIndex())
    aside = r.standard_normal(x.shape)
    aside = multiindex._unit(aside - (aside * x).sum(axis=1, keepdims=True) * x)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * aside
    reach = sum(d.min(axis=1) for d in g.distances(x)) + g.slack
    d1, d2 = g.distances(x)
    h1, h2 = (d.argmin(axis=1) for d in g.distances(y))
    found = d1[np.arange(len(x)), h1] + d2[np.arange(len(x)), h2] <= reach
    visited = (d1[:, :, None] + d2[:, None, :] <= reach[:, None, None]).mean()
    assert found.mean() > 0.99 and visited < 0.6


def test_components_of_a_hub(spark, monkeypatch):
    """Broadcast or dealt in parts, a hub's neighbours and a chain end at their smallest."""
    edges = [(5, k) for k in range(100, 400)] + [(k, k + 1) for k in range(1000, 1040)] + [(399, 3), (7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    want = {k: 3 for k in [3, 5, *range(100, 400)]} | {k: 1000 for k in range(1000, 1041)}
    for small in (100_000, 0):
        monkeypatch.setattr(graph, "SMALL", small)
        monkeypatch.setattr(graph, "HUB", 50)
        assert {r.node: r.component for r in graph.components(df, Workspace(spark, "hub"), "c").collect()} == want
