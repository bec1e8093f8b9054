"""Codec steps in relational form: deltas, prefix sums, runs, value tables, block layout, resampling."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_LINES = {"none": 1, "rle": 1, "zips": 1, "zip": 16, "piz": 32, "pxr24": 16}


def line(order: str = "p", by: str = "image_id"):
    return Window.partitionBy(by).orderBy(order)


def deltas(px: DataFrame, modulus: int = 65536) -> DataFrame:
    return px.withColumn("d", F.pmod(F.col("v") - F.lag("v", 1, 0).over(line()), F.lit(modulus)))


def undeltas(px: DataFrame, modulus: int = 65536) -> DataFrame:
    return px.withColumn("v", F.pmod(F.sum("d").over(line().rowsBetween(Window.unboundedPreceding, 0)), F.lit(modulus)))


def predicted(px: DataFrame) -> DataFrame:
    """Byte differences with a bias of 128; the first byte stays."""
    before = F.lag("v").over(line())
    return px.withColumn("d", F.when(before.isNull(), F.col("v")).otherwise(F.pmod(F.col("v") - before + 128, F.lit(256))))


def unpredicted(px: DataFrame) -> DataFrame:
    n = F.row_number().over(line())
    total = F.sum("d").over(line().rowsBetween(Window.unboundedPreceding, 0))
    return px.withColumn("v", F.pmod(total - (n - 1) * 128, F.lit(256)))


def runs(px: DataFrame, value: str) -> DataFrame:
    """image_id, run, first p, length, value: gaps and islands."""
    new = F.when(F.lag(value).over(line()).eqNullSafe(F.col(value)), 0).otherwise(1)
    px = px.withColumn("new", new).withColumn("run", F.sum("new").over(line().rowsBetween(Window.unboundedPreceding, 0)))
    return px.groupBy("image_id", "run").agg(F.min("p").alias("first_p"), F.count("*").alias("n"), F.first(value).alias("value"))


def value_ranks(px: DataFrame, value: str) -> DataFrame:
    """Distinct values, 0 always among them, with their dense rank: the forward table."""
    values = px.select(F.col(value).cast("long").alias("v")).union(px.sparkSession.range(1).select(F.col("id"))).distinct()
    # Ranks by the thousand first, so that no task sorts all values: a window sees one thousand's values, or one line a thousand.
    values = values.withColumn("thousand", F.floor(F.col("v") / 1000))
    ahead = values.groupBy("thousand").count().withColumn("ahead", F.coalesce(F.sum("count").over(Window.orderBy("thousand").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("thousand").orderBy("v"))
    return values.withColumn("k", within).join(ahead, "thousand").select("v", (F.col("ahead") + F.col("k") - 1).alias("rank"))


def looked_up(px: DataFrame, table: DataFrame, on: str, most: int = 1 << 17) -> DataFrame:
    """px joined with a table of one row a value; the table is broadcast if it has no more than most rows (a 16-bit channel has 65536 values), else
    both sides meet by value."""
    small = table.limit(most + 1).count() <= most
    return px.join(F.broadcast(table) if small else table, on)


def offsets(blocks: DataFrame, size: str, start: int, by: str, order: str, stretch: int = 4096) -> DataFrame:
    """block and at, where each block begins: a header of start bytes, eight bytes a block, and the blocks before it with their eight-byte heads.
    Blocks follow each other in the order of an integer column. Sums run within stretches of that column and over the totals of stretches, so that one
    file of very many blocks is not one task."""
    df = blocks.withColumn("stretch", F.floor(F.col(order) / stretch))
    before = lambda v, *keys, to: F.coalesce(F.sum(v).over(Window.partitionBy(*keys).orderBy(to).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bytes_of = F.col(size) + 8
    totals = df.groupBy(by, "stretch").agg(F.count("*").alias("n"), F.sum(bytes_of).alias("bytes"))
    whole = F.sum("n").over(Window.partitionBy(by))
    totals = totals.select(by, "stretch", before(F.col("n"), by, to="stretch").alias("blocks_before"), before(F.col("bytes"), by, to="stretch").alias("bytes_before"), whole.alias("blocks"))
    df = df.withColumn("k", F.row_number().over(Window.partitionBy(by, "stretch").orderBy(order)) - 1).withColumn("own", before(bytes_of, by, "stretch", to=order))
    df = df.alias("d").join(totals.alias("t"), F.col(f"d.{by}").eqNullSafe(F.col(f"t.{by}")) & F.col("d.stretch").eqNullSafe(F.col("t.stretch")))
    return df.select("d.*", (F.col("blocks_before") + F.col("k")).alias("block"), (F.lit(start) + F.col("blocks") * 8 + F.col("bytes_before") + F.col("own")).alias("at")).drop("stretch", "k", "own")


def offsets_fixed(images: DataFrame, start: int, pixel_bytes: int = 16) -> DataFrame:
    """images (width, height, codec, and any others) with block, first_y, lines and at: where the blocks of uncompressed lines begin."""
    lines = F.coalesce(*(F.when(F.col("codec") == k, F.lit(v)) for k, v in BLOCK_LINES.items()), F.lit(1))
    df = images.withColumn("_lines", lines).withColumn("_n", F.ceil(F.col("height") / F.col("_lines")))
    df = df.filter("_n > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    at = F.lit(start) + F.col("_n") * 8 + F.col("block") * (8 + F.col("width") * F.col("_lines") * pixel_bytes)
    df = df.withColumns({"first_y": F.col("block") * F.col("_lines"), "at": at})
    return df.withColumn("lines", F.least(F.col("_lines"), F.col("height") - F.col("first_y"))).drop("_lines", "_n")


def old_runs(px: DataFrame) -> DataFrame:
    """Runs (image_id, first_p, n, r, g, b, e) as old run-length pixels: image_id, p (their order), r, g, b, e. A run is its pixel and then markers
    (255, 255, 255, digit) that repeat it, the digits of n - 1 to the base 256, lowest first."""
    highest = F.when(F.col("n") > 1 << 24, 3).when(F.col("n") > 1 << 16, 2).when(F.col("n") > 1 << 8, 1).otherwise(0)
    digit = lambda k: (F.floor((F.col("n") - 1) / F.pow(F.lit(256.0), k)) % 256).cast("int")
    marker = lambda k: F.struct((k + 1).alias("k"), *(F.lit(255).alias(c) for c in "rgb"), digit(k).alias("e"))
    markers = F.when(F.col("n") > 1, F.transform(F.sequence(F.lit(0), highest), marker))
    own = F.array(F.struct(F.lit(0).alias("k"), *(F.col(c).cast("int").alias(c) for c in ("r", "g", "b", "e"))))
    df = px.select("image_id", "first_p", F.explode(F.concat(own, F.coalesce(markers, F.array().cast("array<struct<k:int,r:int,g:int,b:int,e:int>>")))).alias("x"))
    return df.select("image_id", (F.col("first_p") * 8 + F.col("x.k")).alias("p"), "x.r", "x.g", "x.b", "x.e")


def old_runs_expanded(px: DataFrame) -> DataFrame:
    """Old run-length pixels (image_id, p, r, g, b, e) as image_id, at (from 0), r, g, b, e. A marker repeats the last pixel that is none; each marker's
    place among those in a row is the place of its digit."""
    marker = (F.col("r") == 255) & (F.col("g") == 255) & (F.col("b") == 255)
    df = px.withColumn("k", F.row_number().over(line())).withColumn("marker", marker)
    last = F.last(F.when(~F.col("marker"), F.struct("k", "r", "g", "b", "e")), ignorenulls=True).over(line().rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("plain", last).filter("plain IS NOT NULL")
    times = F.when(F.col("marker"), F.col("e") * F.pow(F.lit(256.0), F.col("k") - F.col("plain.k") - 1)).otherwise(1).cast("long")
    df = df.withColumn("times", times)
    df = df.withColumn("before", F.coalesce(F.sum("times").over(line().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("times > 0")
    df = df.select("image_id", "plain", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("times") - 1)).alias("at"))
    return df.select("image_id", "at", "plain.r", "plain.g", "plain.b", "plain.e")


def channel_order(channels: DataFrame) -> DataFrame:
    """channels (image_id, name, bytes a pixel) with place and at, the bytes a pixel of the channels before it: files keep channels sorted by name."""
    by = Window.partitionBy("image_id").orderBy("name")
    return channels.withColumn("place", F.row_number().over(by) - 1).withColumn("at", F.coalesce(F.sum("bytes").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def nearest(src: DataFrame, sw: int, sh: int, dw: int, dh: int) -> DataFrame:
    """Each image resampled by an equi-join on the looked-up coordinate. The grid of looked-up places has dw * dh rows; it is broadcast up to a million
    of them, else both sides meet by coordinate."""
    dst = src.sparkSession.range(dw * dh).select((F.col("id") % dw).cast("int").alias("dx"), F.floor(F.col("id") / dw).cast("int").alias("dy"))
    look = lambda v, s, d: F.least(F.lit(s - 1), F.floor(F.col(v) * s / d)).cast("int")
    dst = dst.withColumn("x", look("dx", sw, dw)).withColumn("y", look("dy", sh, dh))
    return src.join(F.broadcast(dst) if dw * dh <= 1 << 20 else dst, ["x", "y"])
