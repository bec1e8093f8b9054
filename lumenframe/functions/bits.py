"""Shared-exponent, half and 24-bit floats as Column arithmetic on non-negative finite values."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exponent(v: Column) -> Column:
    """floor(log2 v) for v > 0, put right where log2 is inexact at powers of two."""
    e = F.floor(F.log2(v)).cast("double")
    two = lambda n: F.pow(F.lit(2.0), n)
    return F.when(two(e) > v, e - 1).when(two(e + 1) <= v, e + 1).otherwise(e)


def with_rgbe(df: DataFrame, names=("r", "g", "b")) -> DataFrame:
    """The channels as bytes, and e, their shared exponent: at least 128, one more if a byte would pass 255. One select a step, so that nothing is
    written out twice in the plan."""
    top = F.greatest(*(F.col(c) for c in names))
    two = lambda n: F.pow(F.lit(2.0), n)
    df = df.withColumn("_top", F.when(top < 1e-32, 1.0).otherwise(top)).withColumn("_dark", top < 1e-32)
    df = df.withColumn("_e", F.floor(F.log2("_top")).cast("double"))
    # The least power of two that is not below the brightest channel; log2 is inexact at powers of two.
    for _ in range(2):
        df = df.withColumn("_e", F.when(two(F.col("_e")) < F.col("_top"), F.col("_e") + 1).when(two(F.col("_e") - 1) >= F.col("_top"), F.col("_e") - 1).otherwise(F.col("_e")))
    df = df.withColumn("_e", F.least(F.lit(255.0), F.greatest(F.lit(128.0), F.col("_e") + 128)))
    df = df.withColumn("_e", F.when((F.floor(F.col("_top") / two(F.col("_e") - 128) * 255) > 255) & (F.col("_e") < 255), F.col("_e") + 1).otherwise(F.col("_e")))
    df = df.withColumn("_s", two(F.col("_e") - 128))
    byte = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col(c) / F.col("_s") * 255)))
    out = {c: F.when(F.col("_dark"), 0).otherwise(byte(c)).cast("int") for c in names} | {"e": F.when(F.col("_dark"), 0).otherwise(F.col("_e")).cast("int")}
    return df.withColumns(out).drop("_top", "_dark", "_e", "_s")


def cumulative(exposures: Column) -> Column:
    """The product of a header's EXPOSURE values, 1 without any."""
    return F.coalesce(F.aggregate(exposures, F.lit(1.0), lambda a, x: a * x), F.lit(1.0))


def from_rgbe(m: Column, e: Column) -> Column:
    return F.when(e == 0, 0.0).otherwise((m + 0.5) * F.pow(F.lit(2.0), e.cast("double") - 128) / 255)


def half_value(v: Column) -> Column:
    """The value after a half-float store: 10 bits rounded half up, nothing below 2**-24, what overflows is 0 after sanitising."""
    e = exponent(F.when(v >= 2.0**-14, v).otherwise(1.0))
    scale = F.pow(F.lit(2.0), 10 - e)
    out = F.when(v < 2.0**-24, 0.0).when(v < 2.0**-14, F.floor(v * 2.0**24 + 0.5) / 2.0**24).otherwise(F.floor(v * scale + 0.5) / scale)
    return F.when(out >= 65536.0, 0.0).otherwise(out)


def f24_value(v: Column) -> Column:
    """The value after a 24-bit store: 15 bits rounded half up."""
    e = exponent(F.when(v >= 2.0**-126, v).otherwise(1.0))
    scale = F.pow(F.lit(2.0), 15 - e)
    return F.when(v < 2.0**-126, 0.0).otherwise(F.floor(v * scale + 0.5) / scale)
