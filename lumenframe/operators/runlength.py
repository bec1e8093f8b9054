"""Run-length packets of byte rows and their bytes, both ways, as joins and running sums.

A packet is a run (count - 1 below 128, then the byte) or literals (256 - count, then the bytes)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored
from .stretches import STRETCH, walked, with_before, with_previous

LEAST_RUN, MOST_RUN, MOST_LITERALS = 3, 128, 127


def maximal_runs(px: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """image_id, start, n, b: gaps and islands of bytes (image_id, p from 0 without gaps, b)."""
    df = with_previous(px.select("image_id", "p", "b"), {"_b0": F.col("b")}, stretch=stretch)
    heads = df.filter(F.col("_first") | ~F.col("b").eqNullSafe(F.col("_b0"))).select("image_id", F.col("p").alias("start"), "b")
    # A run ends where the next begins; looked at backwards, that is the row before.
    size = px.groupBy("image_id").agg((F.max("p") + 1).alias("size"))
    back = heads.withColumn("_r", -F.col("start"))
    back = with_previous(back, {"_end": F.col("start")}, order="_r", stretch=stretch).withColumnRenamed("image_id", "_i")
    ends = back.join(size, F.col("_i").eqNullSafe(size["image_id"]))
    return ends.select(F.col("_i").alias("image_id"), "start", (F.coalesce("_end", "size") - F.col("start")).alias("n"), "b")


def packets(px: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """image_id, start, n, literal, b (of a run). Runs of LEAST_RUN and more are cut into packets of MOST_RUN; what is left of a run, if shorter than
    LEAST_RUN, and shorter runs are literals, which neighbours share up to MOST_LITERALS."""
    runs = stored(maximal_runs(px, stretch), "runs")
    rest = F.when(F.col("n") < LEAST_RUN, F.col("n")).when(F.col("n") % MOST_RUN < LEAST_RUN, F.col("n") % MOST_RUN).otherwise(0)
    runs = runs.withColumn("rest", rest).withColumn("full", F.ceil((F.col("n") - F.col("rest")) / MOST_RUN))
    parts = runs.filter("full > 0").select("image_id", "start", "n", "rest", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("k"))
    coded = parts.select("image_id", (F.col("start") + F.col("k") * MOST_RUN).alias("start"), F.least(F.lit(MOST_RUN), F.col("n") - F.col("rest") - F.col("k") * MOST_RUN).alias("n"), F.lit(False).alias("literal"), "b")
    # Leftovers that touch are one row of literals.
    left = runs.filter("rest > 0").select("image_id", (F.col("start") + F.col("n") - F.col("rest")).alias("start"), F.col("rest").alias("n"))
    left = with_previous(left, {"_end": F.col("start") + F.col("n")}, order="start", stretch=stretch)
    left = left.withColumn("_new", F.when(F.col("_first") | (F.col("_end") != F.col("start")), 1).otherwise(0))
    left = with_before(left, {"_row": F.col("_new")}, order="start", stretch=stretch).withColumn("_row", F.col("_row") + F.col("_new"))
    rows = left.groupBy("image_id", "_row").agg(F.min("start").alias("start"), F.sum("n").alias("n"))
    rows = rows.select("image_id", "start", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / MOST_LITERALS))).alias("k"))
    plain = rows.select("image_id", (F.col("start") + F.col("k") * MOST_LITERALS).alias("start"), F.least(F.lit(MOST_LITERALS), F.col("n") - F.col("k") * MOST_LITERALS).alias("n"), F.lit(True).alias("literal"), F.lit(None).cast(px.schema["b"].dataType).alias("b"))
    return coded.unionByName(plain)


def coded(px: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The packets' bytes: image_id, at, b."""
    size = F.when(F.col("literal"), F.col("n") + 1).otherwise(2)
    packed = stored(with_before(packets(px, stretch).withColumnRenamed("b", "value"), {"at": size}, order="start", stretch=stretch), "packets")
    head = F.when(F.col("literal"), 256 - F.col("n")).otherwise(F.col("n") - 1)
    heads = packed.select("image_id", "at", head.cast("int").alias("b"))
    values = packed.filter("NOT literal").select("image_id", (F.col("at") + 1).alias("at"), F.col("value").cast("int").alias("b"))
    places = packed.filter("literal").select(F.col("image_id").alias("_i"), "at", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    places = places.select("_i", (F.col("start") + F.col("k")).alias("_p"), (F.col("at") + 1 + F.col("k")).alias("at"))
    body = px.select("image_id", "p", "b").join(places, px["image_id"].eqNullSafe(F.col("_i")) & (px["p"] == F.col("_p"))).select("image_id", "at", F.col("b").cast("int").alias("b"))
    return heads.unionByName(values).unionByName(body)


def decoded(data: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """image_id, p, b of packets' bytes (image_id, at, b). Which bytes begin packets is found by jumping pointers, so that one long stream is decoded in
    parallel. A packet that the end cuts off gives what is there."""
    data = stored(data.select("image_id", "at", "b"), "runlength")
    n = F.when(F.col("b") < 128, F.col("b") + 1).otherwise(256 - F.col("b")).cast("long")
    links = data.select("image_id", "at", "b", n.alias("n"), F.when(F.col("b") < 128, F.col("at") + 2).otherwise(F.col("at") + 1 + n).alias("next"))
    starts = walked(links.select("image_id", "at", "next"), "runlength").select(F.col("image_id").alias("_i"), F.col("at").alias("_a"), "rank")
    packed = links.join(starts, links["image_id"].eqNullSafe(F.col("_i")) & (links["at"] == F.col("_a"))).drop("_i", "_a", "next")
    packed = with_before(packed, {"first": F.col("n")}, order="rank", stretch=stretch)
    spread = packed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    source = F.col("at") + 1 + F.when(F.col("b") < 128, 0).otherwise(F.col("k"))
    spread = spread.select(F.col("image_id").alias("_i"), source.alias("_a"), (F.col("first") + F.col("k")).alias("p"))
    return data.join(spread, data["image_id"].eqNullSafe(F.col("_i")) & (data["at"] == F.col("_a"))).select("image_id", "p", "b")
