"""Ranked lexical search against scores of every document, and on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from tests.llm.conftest import SCHEMA, prose, rows_of

from cohortlens.llm import lexical

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, top=50):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = {}
    for item, text in items:
        found = []
        for i, c in docs:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out[item] = [(k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top])]
    return out


def check(spark, docs, items, p=lexical.Ranking()):
    frame = spark.createDataFrame(rows_of([(i, t, "en", "a") for i, t in docs]), SCHEMA)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in lexical.ranked(frame, asked, p).collect():
        got.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in brute(docs, [x for x in items if x[0] is not None], p.top).items() if v}


@pytest.mark.parametrize("p", [lexical.Ranking(), lexical.Ranking(top=7, shard_bytes=3000, chunk=16, block_terms=40, small=5)])
def test_against_every_document(spark, p):
    r = random.Random(2)
    docs = [(i, prose(i, r.randint(1, 200)) + r.choice(["", " Änderung x86-64", " ÄNDERUNG çà_là", "\x00nul\x7f tab\there"])) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(80)] + [(2000, None), (2001, ""), (2002, " -- !?"), (None, docs[7][1]), (None, docs[9][1]), (3, docs[3][1]), (2003, prose(5, 20_000)), (2004, "rare"), (-9, docs[7][1])]
    items = [(k, prose(k, 30)) for k in range(12)] + [(20, docs[7][1]), (21, "Rare words ÄNDERUNG änderung X86"), (22, None), (23, "?!"), (24, "absent term"), (None, "the of"), (25, "the the of")]
    check(spark, docs, items, p)


def test_empty_sides(spark):
    check(spark, [], [(1, "a")])
    check(spark, [(1, "a b"), (2, None)], [])
    check(spark, [(1, None), (2, "")], [(1, "a")])


def test_bounds_hold_every_posting():
    r = np.random.default_rng(4)
    term, tf, n = np.sort(r.integers(0, 40, 3000)), r.geometric(0.3, 3000), r.integers(1, 500, 3000)
    term[:40] = np.arange(40)
    flat, begin = lexical._bounds(term, tf, n, 40)
    for mean in (1, 30, 2000):
        score = lambda t, k: t / (t + 1 + k / mean)
        for k in range(40):
            mine = term == k
            pairs = flat[begin[k] : begin[k + 1]]
            assert max(score(a, b) for a, b in pairs) == pytest.approx(max(score(a, b) for a, b in zip(tf[mine], n[mine], strict=True)))
