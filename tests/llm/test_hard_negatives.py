"""Hard negatives: packed products against plain integers, rows against brute force."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import hard_negatives as hn

DDL = "vec_id long, embedding array<double>, label long, score string, ab long, part string"


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 9), st.integers(1, 40), st.integers(1, 5), st.sampled_from([1, 8, 20, 26, 40, 52]))
def test_products_are_exact(seed, dim, n, q, bits):
    r = random.Random(seed)
    rows = [[r.randint(-(1 << bits), 1 << bits) for _ in range(dim)] for _ in range(n)]
    anchors = [[r.randint(-(1 << bits), 1 << bits) for _ in range(dim)] for _ in range(q)]
    got = hn.products(np.array(rows, float), np.array(anchors, float))
    assert got.tolist() == [[sum(x * y for x, y in zip(a, b)) for b in rows] for a in anchors]


@pytest.mark.parametrize("rows,anchors", [([[0, 0]], [[0, 0]]), ([[5, 5], [5, 5]], [[-3, 2]]), ([[-7, -7]], [[-1, -1]]),
                                          ([[1 << 80, -1]], [[3, 1 << 70]])])
def test_products_at_the_edges(rows, anchors):
    kind = object if max(map(abs, rows[0])) > 1 << 53 else float
    got = hn.products(np.array(rows, kind), np.array(anchors, kind))
    assert got.tolist() == [[sum(x * y for x, y in zip(a, b)) for b in rows] for a in anchors]


def test_unit_vectors_share_an_integer(monkeypatch):
    """Usual embeddings go two to a lane; the unbounded way is not taken."""
    monkeypatch.setattr(hn, "_unbounded", None)
    fields = []
    lanes = hn._lanes
    monkeypatch.setattr(hn, "_lanes", lambda *a: fields.append(a[-1]) or lanes(*a))
    x = np.random.default_rng(1).normal(size=(50, 64))
    x = hn.whole(x / np.linalg.norm(x, axis=1)[:, None])
    assert (hn.products(x, x) == (x @ x.T).astype(int)).all() and fields == [2]


def brute(rows, every):
    part = [(i, v, lab) for i, v, lab in rows if lab is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(256 * x) if math.isfinite(256 * x) else int(x) * 256 for x in v] for _, v, _ in part]
    last = float("inf")
    out = []
    for a, (aid, _, alab) in enumerate(part):
        if aid is None or aid % every:
            continue
        score = [sum(x * y for x, y in zip(whole[a], w)) for w in whole]
        order = sorted((b for b in range(len(part)) if b != a), key=lambda b: (-score[b], last if part[b][0] is None else part[b][0]))
        for p, b in enumerate([b for b in order if part[b][2] == alab][:5], 1):
            some = [c for c in order if part[c][2] != alab and 50 * score[b] <= 100 * score[c] <= 95 * score[b]][:3]
            out += [(aid, part[b][0], k, part[c][0], score[b], score[c], p) for k, c in enumerate(some, 1)]
    return sorted(out, key=repr)


def run(spark, rows, every):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DDL).repartition(3)
    got = hn.mine(df, F.col("vec_id") % every == 0)
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(hn, "MIN_BLOCK_ROWS", 24)
    monkeypatch.setattr(hn, "ANCHOR_ROWS", 3)
    monkeypatch.setattr(hn, "ANCHORS_AT_ONCE", 2)


def vectors(n, seed, labels=4, dim=6, step=16):
    """Coarse components, so that many scores tie."""
    r = random.Random(seed)
    return [(i, [r.randint(-step // 4, step) / step for _ in range(dim)], r.choice([0] * labels + list(range(labels))))
            for i in range(n)]


def test_rows_equal_brute_force_over_many_blocks(spark, small_blocks):
    rows = vectors(150, 5)
    got = run(spark, rows, 10)
    assert len(got) > 100 and got == brute(rows, 10)


def test_odd_rows(spark, small_blocks):
    rows = vectors(60, 6)
    rows += [(None, rows[3][1], 0), (None, rows[3][1], 0), (10, rows[10][1], rows[10][2]), (10, rows[10][1], rows[10][2]),
             (10, rows[11][1], 1), (20, [0.5], 0), (30, [], 0), (-40, [1.0] * 9, 2), (50, None, 1), (51, [None, 1.0], 1),
             (52, [float("nan")], 1), (53, [float("inf")] * 6, 1), (54, [1.0] * 6, None), (70, [-0.0] * 6, 3)]
    assert run(spark, rows, 10) == brute(rows, 10)


def test_very_large_components(spark, small_blocks):
    rows = vectors(40, 7) + [(100, [3e14, 1.0, 2.0], 0), (101, [2e13, 5e12], 0), (102, [1.2e13, 5.5], 1), (110, [1e9] * 4, 1)]
    want = [r[:4] + tuple(s if abs(s) < 1 << 63 else None for s in r[4:6]) + r[6:] for r in brute(rows, 10)]
    assert run(spark, rows, 10) == sorted(want, key=repr)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 0)], [(10, [1.0], 0)], [(10, [1.0], 0), (11, [1.0], 0)],
                                  [(10, [1.0], 0), (11, [-1.0], 0), (12, [1.0], 1)]])
def test_few_rows(spark, rows):
    assert run(spark, rows, 10) == brute(rows, 10)
