"""Nearest neighbours where a third of the vectors are copies, or lie on one key, at the production window."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import neighbours


def recall(spark, ids, x, k=20):
    got = defaultdict(set)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    for r in neighbours.nearest(rows, lambda i: i % 20 == 0, k).collect():
        got[r.query_id].add(r.vec_id)
    x, shares = x.astype(float), []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((ids, -np.round(s, 9)))[: min(k, len(ids) - 1)]
        shares.append(len(got[int(ids[q])] & set(ids[best].tolist())) / len(best))
    return np.array(shares)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_third_copies(spark, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(2400, 16)).astype(np.float32)
    # A long vector, which half of the others have as their nearest, towards one end of the first curve.
    x[:800] = 5 * x[np.argsort(neighbours.curve_keys(x.astype(float), 0))[100]]
    got = recall(spark, r.permutation(2400), x)
    assert got.mean() > 0.95 and (got == 0).sum() == 0


def test_one_key_is_dealt_out(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(1600, 16)).astype(np.float32)
    x[:600] = x[0] * np.linspace(1, 3, 600, dtype=np.float32)[:, None]  # one direction, so nearly one key on each curve, but no copies
    assert recall(spark, r.permutation(1600), x).mean() > 0.9


def test_few_vectors_are_all_searched(spark):
    r = np.random.default_rng(4)
    assert (recall(spark, np.arange(30), r.normal(size=(30, 64)).astype(np.float32)) == 1).all()


SCHEMA = "vec_id long, embedding array<float>"


def test_ties_repeats_clashes_and_nothing(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(50, 6)).astype(np.float32)
    x[20:40] = x[20]  # ties go to the smaller vec_id
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(7, x[7].tolist())] * 3 + [(None, x[0].tolist()), (60, []), (80, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("score", F.lit(None).cast("string"))
    got = defaultdict(list)
    for q in neighbours.nearest(df, lambda i: i % 20 == 0, 5).collect():
        got[q.query_id].append((q["rank"], q.vec_id, q.score))
    y = x.astype(float)
    assert sorted(got) == [0, 20, 40]
    for q, found in got.items():
        s = (y * y[q]).sum(1)
        want = sorted((-s[k], k) for k in range(50) if k != q)[:5]
        assert [(k, -v) for v, k in want] == [(k, v) for _, k, v in sorted(found)]
    assert neighbours.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0
    assert neighbours.nearest(df, lambda i: i < 0).count() == 0
    assert neighbours.nearest(df.filter("vec_id = 20"), lambda i: i == 20).count() == 0
    wide = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(y)], "vec_id int, embedding array<double>")
    assert neighbours.nearest(wide, lambda i: i == 0, 3).count() == 3


def test_structured_vectors_need_a_narrow_window(spark, monkeypatch):
    """Vectors around many centres: the measured window is a small part of the curves, and its recall holds."""
    seen, fitted = [], neighbours.least_window
    monkeypatch.setattr(neighbours, "RANGE_ROWS", 100)
    monkeypatch.setattr(neighbours, "least_window", lambda *a: seen.append((fitted(*a), a[1])) or fitted(*a))
    r = np.random.default_rng(6)
    centres = r.normal(size=(60, 16))
    x = (centres[r.integers(0, 60, 4000)] + 0.05 * r.normal(size=(4000, 16))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, r.permutation(4000), x).mean() >= 0.9
    (curves, wide), blocks = seen[0]
    assert curves * wide < 0.6 * blocks[0]


def test_least_window_against_trying_each():
    r = np.random.default_rng(9)
    for n in (1, 2, 7, 40):
        pairs = [[int(v) for v in r.integers(0, n, 2)] for _ in range(60)]

        def inside(own, near, wide, n=n):
            first = max(0, min(own - wide // 2, n - wide))
            return first <= near < first + wide

        got = neighbours.least_window(pairs, [n], 0.9)
        want = next(w for w in range(1, n + 1) if sum(inside(*p, w) for p in pairs) >= 54)
        assert got == (1, want)
