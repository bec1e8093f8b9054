"""Running sums, neighbours and chains along an integer column, cut into stretches of it, so that one very long image is many tasks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stored import stored

STRETCH = 4096


def with_before(df: DataFrame, sums: dict[str, Column], by: str = "image_id", order: str = "p", stretch: int = STRETCH) -> DataFrame:
    """df with, under each name of sums, the sum of its column over the rows of the same by that come earlier. Within a stretch a window sees its rows;
    across stretches it sees one total each."""
    df = df.withColumn("_s", F.floor(F.col(order) / stretch)).withColumns({f"_v_{n}": c for n, c in sums.items()})
    along = Window.partitionBy(by, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(by, "_s").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    over = Window.partitionBy(by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = totals.select(F.col(by).alias("_b"), F.col("_s").alias("_at"), *(zero(F.sum(f"_t_{n}").over(over)).alias(f"_t_{n}") for n in sums))
    df = df.withColumns({f"_v_{n}": zero(F.sum(f"_v_{n}").over(along)) for n in sums})
    df = df.join(totals, df[by].eqNullSafe(F.col("_b")) & (F.col("_s") == F.col("_at")))
    return df.withColumns({n: F.col(f"_v_{n}") + F.col(f"_t_{n}") for n in sums}).drop("_s", "_b", "_at", *(f"_{k}_{n}" for n in sums for k in "vt"))


def with_previous(df: DataFrame, values: dict[str, Column], by: str = "image_id", order: str = "p", stretch: int = STRETCH) -> DataFrame:
    """df with, under each name of values, that column of the row of the same by that comes just before (null for the first), and _first: whether there
    is none. The first row of a stretch gets the last one of the nearest stretch that has rows."""
    one = F.struct(*(c.alias(n) for n, c in values.items()))
    df = df.withColumn("_s", F.floor(F.col(order) / stretch)).withColumn("_v", one)
    last = df.groupBy(by, "_s").agg(F.max_by("_v", order).alias("_last"))
    last = last.select(F.col(by).alias("_b"), F.col("_s").alias("_at"), F.lag("_last").over(Window.partitionBy(by).orderBy("_s")).alias("_last"))
    df = df.withColumn("_lag", F.lag("_v").over(Window.partitionBy(by, "_s").orderBy(order)))
    df = df.join(last, df[by].eqNullSafe(F.col("_b")) & (F.col("_s") == F.col("_at")))
    df = df.withColumn("_lag", F.coalesce("_lag", "_last")).withColumn("_first", F.col("_lag").isNull())
    return df.withColumns({n: F.col(f"_lag.{n}") for n in values}).drop("_s", "_v", "_b", "_at", "_last", "_lag")


def dense(df: DataFrame, by: str = "image_id", order: str = "p", stretch: int = STRETCH) -> DataFrame:
    """df with its rows numbered from 0 in order, in place of that column."""
    return with_before(df, {"_n": F.lit(1)}, by, order, stretch).withColumn(order, F.col("_n").cast("long")).drop("_n")


def walked(links: DataFrame, tag: str) -> DataFrame:
    """image_id, at, rank of the places that a chain visits. links (image_id, at, next): from each place to the next; a chain begins at 0 and ends where no
    place is. Pointer jumping: of n places, log2 n rounds that double how far each link leads, each two joins, whatever the chain's length."""
    links = stored(links.select("image_id", "at", "next"), tag)
    onto = lambda df: df.select(F.col("image_id").alias("_i"), F.col("at").alias("_a"), *(F.col(c).alias(f"_{c}") for c in df.columns[2:]))
    same = lambda c: F.col("image_id").eqNullSafe(F.col("_i")) & (F.col(c) == F.col("_a"))
    known = links.filter("at = 0").select("image_id", "at", F.lit(0).cast("long").alias("rank"))
    jump, step = stored(links.filter("next > at").join(onto(links.select("image_id", "at")), same("next"), "left_semi"), tag), 1
    while jump.take(1):
        ahead = onto(jump)
        known = stored(known.unionByName(known.join(ahead, same("at")).select("image_id", F.col("_next").alias("at"), (F.col("rank") + step).alias("rank"))), tag)
        jump = stored(jump.join(ahead, same("next")).select("image_id", "at", F.col("_next").alias("next")), tag)
        step *= 2
    return known
