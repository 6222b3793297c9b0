"""Recombination from the alignment, against brute force."""

import random
from itertools import permutations
from math import comb

import pytest

from cohortlens.functions import walks
from cohortlens.operators import recombination as R


def falls(steps):
    high = height = out = 0
    for s in steps:
        height += s
        high = max(high, height)
        out = max(out, high - height)
    return out


def orders(m, n):
    from itertools import combinations

    for ups in combinations(range(m + n), m):
        yield [1 if i in ups else -1 for i in range(m + n)]


def test_chance_of_descents():
    for m in range(6):
        for n in range(6):
            seen = [falls(s) for s in orders(m, n)]
            for k in range(8):
                want = sum(x >= k for x in seen) / comb(m + n, m)
                assert walks.descent_chance(m, n, k) == pytest.approx(want, abs=1e-12), (m, n, k)
                if want > 0:
                    assert walks.least_chance(m, n, k) <= __import__("math").log(want) + 1e-9


def triplets(children, parents):
    """All triplets, one column at a time."""
    out, total = {}, 0
    for row, (name, seq) in enumerate(children):
        cases = []
        for (pn, ps), (qn, qs) in permutations(parents, 2):
            if name in (pn, qn) or pn == qn or name is None:
                continue
            total += 1
            steps = []
            for col, (c, p, q) in enumerate(zip((seq or "").upper(), (ps or "").upper(), (qs or "").upper(), strict=False)):
                if {c, p, q} <= set("ACGT") and p != q and c in (p, q):
                    steps.append((1 if c == p else -1, col + 1))
            walk = [s for s, _ in steps]
            m, n, k = walk.count(1), walk.count(-1), falls(walk)
            p = walks.descent_chance(m, n, k)
            cases.append((walks.rank_of(p), pn, qn, m, n, k, p, steps))
        if cases:
            out[row] = (name, len(cases), min(cases, key=lambda x: x[:3]))
    return out, total


@pytest.mark.parametrize("block", [R.BLOCK, 300])
def test_triplets(spark, block):
    r = random.Random(5)
    parents = [(f"p{i}", "".join(r.choices("ACGTN-", weights=[6, 6, 6, 6, 1, 1], k=90))) for i in range(7)] + [("p7", None), ("p0", "ACGT" * 20), ("p8", "")]
    children = [(f"c{i}", "".join(r.choices("acgtACGT", k=r.choice([60, 90, 120])))) for i in range(6)]
    children += [("mosaic", parents[1][1][:40] + parents[4][1][40:]), ("mosaic", parents[1][1][:40] + parents[4][1][40:]), ("p3", parents[3][1]), ("empty", ""), ("none", None)]
    frame = [spark.createDataFrame(x + [(None, "ACGT")], "name string, seq string") for x in (children, parents)]
    got = R.triplet_scan(*frame, block=block).collect()
    want, total = triplets(children, parents)
    key = lambda x: (x[0], x[1], x[2][1:6])
    assert sorted((x.child, x.n_triplets, (x.p_name, x.q_name, x.m, x.n, x.k)) for x in got) == sorted(map(key, want.values()))
    by = {name: case for name, _, case in want.values()}
    for x in got:
        assert x.p == pytest.approx(by[x.child][6], rel=1e-12)
        assert x.p_corrected == pytest.approx(1 - (1 - x.p) ** total, abs=1e-9)
        inside = [s for s, at in by[x.child][7] if x.k and x.from_pos <= at <= x.to_pos]
        assert -sum(inside) == x.k
    planted = next(x for x in got if x.child == "mosaic")
    assert {planted.p_name, planted.q_name} == {"p1", "p4"} and planted.p_corrected < 0.05


def test_no_triplets(spark):
    none = spark.createDataFrame([], "name string, seq string")
    some = spark.createDataFrame([("a", "ACGT"), ("b", "ACGA")], "name string, seq string")
    assert R.triplet_scan(none, some).count() == 0
    assert R.triplet_scan(some, none).count() == 0
    assert R.triplet_scan(some, some).count() == 0


def phi(seqs, window, replicates, seed=42):
    """Mean incompatibility of near sites and the share of orders at or below it, pair by pair."""
    from collections import Counter
    from hashlib import md5

    rows = [(s or "").upper() for s in seqs]
    length = max(map(len, rows))
    cells = {c: [s[c - 1] if c <= len(s) and s[c - 1] in "ACGT" else None for s in rows] for c in range(1, length + 1)}
    sites = [c for c, col in cells.items() if sum(n > 1 for b, n in Counter(col).items() if b) > 1]
    if len(sites) < 2:
        return len(sites), None, None, None, None
    near = min(len(sites) - 1, max(1, window * len(sites) // length))

    def score(i, j):
        edges = {("l" + a, "r" + b) for a, b in zip(cells[i], cells[j], strict=True) if a and b}
        nodes = {x for e in edges for x in e}
        parts = {x: x for x in nodes}
        for _ in nodes:
            for a, b in edges:
                parts[a] = parts[b] = min(parts[a], parts[b])
        return len(edges) - len(nodes) + len(set(parts.values()))

    known = {}

    def total(order):
        out = 0
        for k, i in enumerate(order):
            for j in order[k + 1 : k + 1 + near]:
                pair = (min(i, j), max(i, j))
                known[pair] = known[pair] if pair in known else score(*pair)
                out += known[pair]
        return out

    own = total(sites)
    drawn = [total(sorted(sites, key=lambda c: md5(f"{seed}:{r}:{c}".encode()).digest())) for r in range(1, replicates + 1)]
    pairs = near * len(sites) - near * (near + 1) / 2
    return len(sites), near, own / pairs, sum(drawn) / replicates / pairs, (1 + sum(x <= own for x in drawn)) / (replicates + 1)


def evolved(r, n, columns, split):
    """Sequences on a tree, and on another one from ``split`` on."""
    out = [[] for _ in range(n)]
    trees = [r.sample(range(n), n) for _ in range(2)]
    for c in range(columns):
        order = trees[c >= split]
        a, b = sorted(r.sample(range(n + 1), 2))
        old, new = r.sample("ACGT", 2)
        for k, who in enumerate(order):
            out[who].append(new if a <= k < b else old)
    return ["".join(x) for x in out]


def test_phi(spark):
    r = random.Random(8)
    whole = evolved(r, 10, 220, 220)
    groups = {"tree": whole, "mosaic": evolved(r, 10, 220, 110), "noise": ["".join(r.choices("acgtACGTN-", k=r.choice([150, 180]))) for _ in range(9)]}
    groups |= {"few": ["ACGT", None, ""], "pair": ["AACC", "AACC", "GGCC", "GGCC", "TTT", "TTT"], "twice": whole + whole}
    rows = [(g, s) for g, seqs in groups.items() for s in seqs] + [(None, "ACGT")] * 4
    df = spark.createDataFrame(rows, "candidate string, seq string")
    got = {x.candidate: x for x in R.phi_test(df, window=20, replicates=40).collect()}
    assert set(got) == set(groups)
    for g, seqs in groups.items():
        want = phi(seqs, 20, 40)
        assert tuple(got[g])[1:] == tuple(pytest.approx(x, abs=1e-12) for x in want), g
    assert got["mosaic"].phi_perm_p < 0.05 < got["noise"].phi_perm_p
    assert R.phi_test(df.limit(0)).count() == 0
