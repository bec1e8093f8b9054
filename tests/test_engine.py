import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenframe import queries
from lumenframe.functions import bits, color, tone
from lumenframe.plans import views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "events", "documents", "pages", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    cols = sorted(df.columns)
    return sorted(tuple(round(float(v), 9) if hasattr(v, "dtype") and v.dtype.kind in "fiu" or isinstance(v, (int, float)) else v for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", ["tonemap_aces", "tonemap_agx_hdr", "gainmap_encode", "rgbe_encode", "compare_images", "pxr24_undelta", "gen_rainbow", "resize_nearest"])
def test_same_as_sql(spark, duck, name):
    assert plain(queries.QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(queries.ORACLE_SQL[name]).df())


def test_matrix_round_trip():
    import numpy as np

    assert np.allclose(color.matrix("rec709", "rec2020") @ color.matrix("rec2020", "rec709"), np.eye(3))


def test_hostile_values_are_black(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), -0.1)], "r double, g double, b double")
    assert tone.displayed(df).first()[:3] == (0, 0, 0)


def test_grey_stays_grey(spark):
    df = spark.createDataFrame([(v, v, v) for v in (0.0, 0.5, 1.0, 10.0)], "r double, g double, b double")
    for m in tone.MAPPERS:
        for r in tone.mapped(df, mapper=m).collect():
            assert max(r) - min(r) <= 0.05 * max(1e-2, max(r))


def test_half_and_rgbe(spark):
    df = spark.createDataFrame([(1 + 2**-11,), (1.5 * 2**-25,), (2.0**-118,), (70000.0,)], "v double")
    got = [r[0] for r in df.select(bits.half_value(F.col("v"))).collect()]
    assert got == [1 + 2**-10, 0.0, 0.0, 0.0]
    e = spark.createDataFrame([(2.0**k,) for k in range(-20, 20)], "v double").select(bits.exponent(F.col("v"))).collect()
    assert [int(r[0]) for r in e] == list(range(-20, 20))


def test_gradient_ends(spark):
    px = views.gradient(spark, 8, 1, low=0.5, high=2.0).orderBy("x").collect()
    assert math.isclose(px[0].r, 0.5) and math.isclose(px[-1].r, 2.0)
