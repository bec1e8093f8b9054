"""Whitening against numpy's eigenvectors of the whole covariance, by power passes and in all dimensions, with rows that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=16):
    """{id: x} to n, deviations, whitened rows by component and explained shares."""
    x = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000 for i, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, total = len(fit), fit.sum(0)
    c = (n * fit - total) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, {i: sum(int(t) ** 2 for t in n * y - total) for i, y in x.items()}, {i: (n * y - total) / n @ v / np.sqrt(e) for i, y in x.items()}, e / np.trace(c.T @ c / n)


def held(df, rows, k=16):
    n, deviation, white, explained = plain(rows, k)
    got = df.collect()
    assert sorted(r.vec_id for r in got) == sorted(i for i, _ in rows)
    signs = None
    for r in got:
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-9
        z = np.array(r.whitened)
        if signs is None:
            big = max(white, key=lambda i: np.abs(white[i]).min())
            signs = np.sign(np.array(next(x for x in got if x.vec_id == big).whitened) * white[big])
        assert np.allclose(z * signs, white[r.vec_id], atol=1e-7) and np.allclose(r.explained, explained, rtol=1e-9)


def test_given_vectors(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    held(whitening.whitened(e), [(r.vec_id, r.embedding) for r in e.collect()])


@pytest.mark.parametrize("falls", [0.5, 0.999])
def test_power_passes_or_all_dimensions(spark, falls):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 48)) * 20 * falls ** np.arange(48) @ np.linalg.qr(r.normal(size=(48, 48)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, SCHEMA)
    fit = whitening.gridded(df).select("x").distinct()
    w = whitening.Whitening(fit, 4)
    assert (w.directions < 48) == (falls == 0.5)
    held(whitening.whitened(df, 4), rows, 4)


def test_rows_that_take_no_part(spark):
    r = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(50, 5)).astype(np.float32))]
    rows += [(k, rows[0][1]) for k in (100, 101, 101)]  # copies weigh once, repeated rows are returned
    odd = [(200, None), (201, []), (202, [1.0]), (203, [float("nan")] * 5), (204, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (205, [None, 1.0, 1.0, 1.0, 1.0]), (206, [3e38] * 5)]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumn("n", F.lit("clash")).withColumn("x", F.lit(1))
    held(whitening.whitened(df), rows)
    assert whitening.whitened(df.limit(0)).count() == 0 and whitening.whitened(df.filter("vec_id >= 200 AND vec_id <> 202")).filter("size(whitened) > 0").count() == 0
    same = whitening.whitened(df.filter("vec_id IN (0, 100, 101)")).collect()
    assert len(same) == 4 and all(x.whitened == [] and x.n == 1 for x in same)
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)] + [(None, [1.0, 2.0, 5.0])], SCHEMA)
    assert {len(x.whitened) for x in whitening.whitened(flat).collect()} == {1}


def test_large_numbers_stay_exact():
    x = np.array([[1 << 45, -(1 << 44)], [3, 5]])
    total = x.astype(object).sum(0)
    c = whitening.centred(x, 10**7, total)
    assert whitening.squares(c) == [sum((10**7 * int(a) - int(t)) ** 2 for a, t in zip(row, total, strict=True)) for row in x]
