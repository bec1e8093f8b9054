"""The tables read as pixels, and generators on spark.range."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_pixels(spark, sf_dir) -> DataFrame:
    """Each vector of 64 floats as a 4x4 RGBA image: image_id, label, p, x, y, r, g, b, a."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    at = lambda k: F.get("embedding", F.col("p") * 4 + k)
    return e.select("image_id", "label", "p", (F.col("p") % 4).alias("x"), F.floor(F.col("p") / 4).cast("int").alias("y"), at(0).alias("r"), at(1).alias("g"), at(2).alias("b"), at(3).alias("a"))


def lineitem_pixels(spark, sf_dir) -> DataFrame:
    """Line items as HDR pixels."""
    f = lambda c: c.cast("float")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image_id"), "l_orderkey", "l_linenumber", f(F.col("l_extendedprice") / 10000).alias("r"), f(F.col("l_quantity") / 10).alias("g"),
        f((F.col("l_discount") + F.col("l_tax")) * 10).alias("b"), f(F.lit(1.0)).alias("a"))


def event_pixels(spark, sf_dir) -> DataFrame:
    """Events as rows of one channel: image_id, p (order), v (0..65535)."""
    v = F.floor(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), F.col("event_id").alias("p"), v.alias("v"), (F.col("value") / 100).alias("r"))


def grid(spark, width: int, height: int) -> DataFrame:
    """p, x, y of an image, generated where it is used."""
    return spark.range(width * height).select(F.col("id").cast("int").alias("p"), (F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))


def places(spark, sf_dir, width: int) -> tuple[DataFrame, int]:
    """p, x, y of an image with a pixel for each event, and its height."""
    p = table(spark, sf_dir, "events").select(F.col("event_id").alias("p"))
    height = (p.agg(F.max("p")).first()[0] or 0) // width + 1
    return p.select("p", (F.col("p") % width).cast("int").alias("x"), F.floor(F.col("p") / width).cast("int").alias("y")), height


def unit(axis: str, size: int):
    return F.col(axis).cast("double") / (size - 1) if size > 1 else F.lit(0.0)


def gradient(spark, width, height, mode="horizontal", low=0.0, high=1.0, channel="rgb", at=None) -> DataFrame:
    """at: places (p, x, y), where not the whole grid is wanted; so below."""
    t = {"horizontal": unit("x", width), "vertical": unit("y", height)}.get(mode)
    if t is None:
        t = (F.col("x") + F.col("y")).cast("double") / (width + height - 2) if width + height > 2 else F.lit(0.0)
    v = (F.lit(low) + t * (high - low)).cast("float")
    pick = lambda c: v if channel in ("rgb", c) else F.lit(0.0).cast("float")
    return (at or grid(spark, width, height)).select("p", "x", "y", *(pick(c).alias(c) for c in "rgb"), F.lit(1.0).cast("float").alias("a"))


def rainbow(spark, width, height, value=1.0, intensity=1.0, at=None) -> DataFrame:
    """Hue by row, saturation by column; a channel falls off with its distance on the hue circle."""
    df = (at or grid(spark, width, height)).withColumn("hue", unit("y", height) * 6).withColumn("s", unit("x", width))

    def channel(n):
        k = (F.col("hue") + n) % 6
        return ((F.lit(value) - F.col("s") * value * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))) * intensity).cast("float")

    return df.select("p", "x", "y", channel(5).alias("r"), channel(3).alias("g"), channel(1).alias("b"), F.lit(1.0).cast("float").alias("a"))


def radial(spark, width, height, at=None) -> DataFrame:
    far = ((width - 1) ** 2 + (height - 1) ** 2) ** 0.5 or 1.0
    x, y = F.col("x").cast("long"), F.col("y").cast("long")  # the square of a line beyond 46,340 is no int
    v = (1 - F.sqrt((x * x + y * y).cast("double")) / far).cast("float")
    return (at or grid(spark, width, height)).select("p", "x", "y", *(v.alias(c) for c in "rgb"), F.lit(1.0).cast("float").alias("a"))


def cie_wedge(spark, width, height, luminance: float = 1.0, channel: str = "rgb", at=None) -> DataFrame:
    """The chromaticity plane up to x 0.735 and y 0.834, y upwards, as linear Rec.2020; channel keeps one of r, g, b."""
    x, y = unit("x", width) * 0.735, (1 - unit("y", height)) * 0.834
    rgb = color.xyy_to_rgb(x, y, F.lit(float(luminance)), "rec2020")
    px = (at or grid(spark, width, height)).select("p", "x", "y", *(F.greatest(F.lit(0.0), v).alias(c) for v, c in zip(rgb, "rgb", strict=True)), F.lit(1.0).cast("float").alias("a"))
    return isolated(px, channel)


def isolated(px: DataFrame, channel: str) -> DataFrame:
    """px with the other channels black; rgb keeps all."""
    return px.withColumns({c: F.lit(0.0).cast(px.schema[c].dataType) for c in "rgb" if channel not in ("rgb", c)})
