"""Values as bytes by planes: each segment's most significant bytes first, then the next ones."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stretches import STRETCH, with_before


def _places(values: DataFrame, stretch: int) -> DataFrame:
    """values with base, n and k: where the segment's bytes begin, its values, and a value's number in it."""
    sizes = values.groupBy("image_id", "segment", "width").agg(F.count("*").alias("n"), F.min("p").alias("_p"))
    sizes = with_before(sizes, {"base": F.col("n") * F.col("width")}, order="segment", stretch=stretch)
    s = sizes.select(F.col("image_id").alias("_i"), F.col("segment").alias("_g"), "n", "base")
    df = with_before(values, {"_all": F.lit(1)}, stretch=stretch)
    first = with_before(sizes, {"_k0": F.col("n")}, order="segment", stretch=stretch).select(F.col("image_id").alias("_i2"), F.col("segment").alias("_g2"), "_k0")
    s = s.join(first, F.col("_i").eqNullSafe(F.col("_i2")) & (F.col("_g") == F.col("_g2")))
    df = df.join(s, df["image_id"].eqNullSafe(F.col("_i")) & (df["segment"] == F.col("_g")))
    return df.withColumn("k", F.col("_all") - F.col("_k0")).drop("_i", "_g", "_i2", "_g2", "_all", "_k0")


def split(values: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """image_id, at, b of values (image_id, segment, p, width, v): v as width bytes. Segments follow each other by number, and p ascends from segment to
    segment; of a segment of n values, byte j of value k stands at j * n + k."""
    df = _places(values, stretch).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    b = F.expr("shiftright(v, 8 * (width - 1 - j)) & 255").cast("int")
    return df.select("image_id", (F.col("base") + F.col("j") * F.col("n") + F.col("k")).alias("at"), b.alias("b"))


def merged(data: DataFrame, values: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """image_id, segment, p, v of bytes by planes (image_id, at, b); values says which there are (image_id, segment, p, width)."""
    df = _places(values.select("image_id", "segment", "p", "width"), stretch).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    df = df.withColumn("_at", F.col("base") + F.col("j") * F.col("n") + F.col("k")).select(F.col("image_id").alias("_i"), "segment", "p", "width", "j", "_at")
    got = data.join(df, data["image_id"].eqNullSafe(F.col("_i")) & (data["at"] == F.col("_at"))).withColumn("_part", F.expr("shiftleft(cast(b as bigint), 8 * (width - 1 - j))"))
    return got.groupBy("image_id", "segment", "p").agg(F.sum("_part").alias("v"))
