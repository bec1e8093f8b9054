"""Image statistics and comparison."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RGB = ("r", "g", "b")


def range_metadata(px: DataFrame, *by: str) -> DataFrame:
    """min, max, range and mean of each channel, six decimals."""
    d = {c: F.col(c).cast("double") for c in RGB}
    aggs = []
    for c in RGB:
        aggs += [F.min(d[c]).alias(f"min_{c}"), F.max(d[c]).alias(f"max_{c}"), F.avg(d[c]).alias(f"avg_{c}")]
    out = px.groupBy(*by).agg(*aggs)
    names = [n for c in RGB for n in (f"min_{c}", f"max_{c}", f"avg_{c}")]
    out = out.withColumns({f"range_{c}": F.col(f"max_{c}") - F.col(f"min_{c}") for c in RGB})
    return out.select(*by, *(F.round(F.coalesce(n, F.lit(0.0)), 6).alias(n) for n in [*names, *(f"range_{c}" for c in RGB)]))


def differences(a: DataFrame, b: DataFrame, relative: float = 0.01, absolute: float = 1e-6) -> DataFrame:
    """image_id, p, with per-pixel maxima over RGBA: abs_delta, rel_delta, squares; ok, whether they match; both, whether both images have the pixel.
    A pixel that only one image has matches nothing, and has no deltas."""
    sides = [df.select("image_id", "p", *(F.col(c).cast("double").alias(f"{s}_{c}") for c in (*RGB, "a")), F.lit(True).alias(f"in_{s}")) for s, df in (("x", a), ("y", b))]
    j = sides[0].join(sides[1], ["image_id", "p"], "full").withColumn("both", F.coalesce(F.col("in_x") & F.col("in_y"), F.lit(False)))
    deltas, ok, squares = [], F.col("both"), F.lit(0.0)
    for c in (*RGB, "a"):
        x, y = F.col(f"x_{c}"), F.col(f"y_{c}")
        delta, ref = F.abs(x - y), F.greatest(F.abs(x), F.abs(y))
        deltas.append((delta, F.when(ref > 0, delta / F.when(ref > 0, ref).otherwise(1.0)).otherwise(0.0)))
        ok = ok & F.when(ref < 0.01, delta <= absolute).otherwise(delta <= ref * relative)
        squares = squares + delta * delta
    where = lambda v: F.when(F.col("both"), v)
    return j.select("image_id", "p", where(F.greatest(*(d for d, _ in deltas))).alias("abs_delta"), where(F.greatest(*(r for _, r in deltas))).alias("rel_delta"), squares.alias("squares"),
                    F.coalesce(ok, F.lit(False)).alias("ok"), "both")


def compared(a: DataFrame, b: DataFrame, **tolerance) -> DataFrame:
    """One row an image of either side: match, mismatched pixels, largest deltas, root mean square error over all four channels. Images of different size,
    or that only one side has, do not match, and have no other figures."""
    d = differences(a, b, **tolerance)
    bad = F.sum(F.when(F.col("ok"), 0).otherwise(1))
    same = F.bool_and("both")
    figures = {"mismatched": bad.cast("long"), "max_abs": F.round(F.max("abs_delta"), 6), "max_rel": F.round(F.max("rel_delta"), 6), "rmse": F.round(F.sqrt(F.sum("squares") / (F.count("*") * 4)), 6)}
    return d.groupBy("image_id").agg((same & (bad == 0)).alias("match"), *(F.when(same, v).alias(k) for k, v in figures.items()))


def worst_columns(a: DataFrame, b: DataFrame, width: int, n: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """image_id, x, intensity, worst: of each image the n columns in which red differs most, the leftmost first among equals; intensity is where a
    horizontal gradient from low to high stands there. A column of which one side lacks a pixel is worse than any other, and has no figure."""
    left, right = (df.select("image_id", "p", F.col("r").cast("double").alias(c)) for df, c in ((a, "r"), (b, "other")))
    one = left.join(right, ["image_id", "p"], "full").withColumn("delta", F.abs(F.col("r") - F.col("other")))
    by = one.groupBy("image_id", (F.col("p") % width).cast("int").alias("x")).agg(F.count_if(F.col("delta").isNull()).alias("lacks"), F.round(F.max("delta"), 6).alias("worst"))
    by = by.withColumn("worst", F.when(F.col("lacks") == 0, F.col("worst")))
    t = F.col("x") / (width - 1) if width > 1 else F.lit(0.0)
    k = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc_nulls_first("worst"), "x"))
    return by.withColumn("k", k).filter(F.col("k") <= n).select("image_id", "x", F.round(F.lit(low) + t * (high - low), 6).alias("intensity"), "worst")


def mismatch_samples(a: DataFrame, b: DataFrame, n: int, **tolerance) -> DataFrame:
    """The first n mismatches of each image in pixel order."""
    w = Window.partitionBy("image_id").orderBy("p")
    bad = differences(a, b, **tolerance).filter(~F.col("ok"))
    return bad.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).select("image_id", "p", F.round("abs_delta", 6).alias("abs_delta"))
