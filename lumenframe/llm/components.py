"""Connected components by alternating large-star and small-star, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large star: all larger neighbours of a node go to its least neighbour; small star: its smaller neighbours and itself do."""
    sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    out = sides.join(least, "u")
    if large:
        out = out.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """u, v: each node of a component but its least one, and that. edges (a, b) of longs, in any direction; loops and repeats do no harm."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "cc-0")
    state = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == state or not mark[0]:
            return now
        state = mark
        now = written(_stars(written(_stars(now, True), "cc-large"), False), "cc-small")
