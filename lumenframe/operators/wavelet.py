"""The two-dimensional Haar lifting of 16-bit values, level by level: blocks of two by two whose stride doubles."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored

#: Fixed values of the format: 16-bit pairs are lifted modulo 2**16, the first one offset by half of it.
OFFSET, MASK = 1 << 15, (1 << 16) - 1


def _signed(v: Column) -> Column:
    return F.when(v >= OFFSET, v - (MASK + 1)).otherwise(v)


def lifted(a: Column, b: Column, wide: Column) -> tuple[Column, Column]:
    """Mean and difference of a pair of values from 0 to 65535: signed where values stay below 2**14, modulo 2**16 where wide."""
    sa, sb = _signed(a), _signed(b)
    low, high = F.pmod(F.shiftright(sa + sb, 1), F.lit(MASK + 1)), F.pmod(sa - sb, F.lit(MASK + 1))
    moved = F.pmod(a + OFFSET, F.lit(MASK + 1))
    mean, diff = F.shiftright(moved + b, 1), moved - b
    return F.when(wide, F.when(diff < 0, F.pmod(mean + OFFSET, F.lit(MASK + 1))).otherwise(mean)).otherwise(low), F.when(wide, F.pmod(diff, F.lit(MASK + 1))).otherwise(high)


def lowered(low: Column, high: Column, wide: Column) -> tuple[Column, Column]:
    """The pair that lifted gave low and high of."""
    h = _signed(high)
    a = _signed(low) + F.pmod(h, F.lit(2)) + F.shiftright(h, 1)
    b = F.pmod(low - F.shiftright(high, 1), F.lit(MASK + 1))
    first = F.pmod(high + b - OFFSET, F.lit(MASK + 1))
    return F.when(wide, first).otherwise(F.pmod(a, F.lit(MASK + 1))), F.when(wide, b).otherwise(F.pmod(a - h, F.lit(MASK + 1)))


def strides(width: int, height: int) -> list[int]:
    out, p = [], 1
    while 2 * p <= min(width, height):
        out.append(p)
        p *= 2
    return out


def level(px: DataFrame, p: int, width: int, height: int, inverse: bool = False) -> DataFrame:
    """px (image_id, x, y, v, wide) after one level of stride p, of images of width x height. Pixels off the stride are left as they are, and so is a
    corner without neighbours; of an odd line or column, pairs are lifted. One block is one group, so an image of any size is many."""
    edge = lambda c, n: F.col(c) < (n // (2 * p)) * 2 * p
    taking = (F.col("x") % p == 0) & (F.col("y") % p == 0)
    # A lone last line or column takes part only where n has this bit.
    inside = lambda c, n: edge(c, n) | F.lit(bool(n & p)) & (F.col(c) < (n // p) * p)
    taking = taking & inside("x", width) & inside("y", height)
    at = px.filter(taking).withColumns({"_bx": F.floor(F.col("x") / (2 * p)), "_by": F.floor(F.col("y") / (2 * p))})
    corner = lambda i, j: F.max(F.when((F.col("x") % (2 * p) == i * p) & (F.col("y") % (2 * p) == j * p), F.col("v")))
    blocks = at.groupBy("image_id", "wide", "_bx", "_by").agg(*(corner(i, j).alias(f"v{i}{j}") for j in (0, 1) for i in (0, 1)))
    wide, names = F.col("wide"), ("v00", "v10", "v01", "v11")
    step = lowered if inverse else lifted

    def paired(df, a, b):
        """a and b of each block that has both."""
        x, y = step(F.col(a), F.col(b), wide)
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return df.withColumns({a: F.when(both, x).otherwise(F.col(a)), b: F.when(both, y).otherwise(F.col(b))})

    pairs = [("v00", "v10"), ("v01", "v11"), ("v00", "v01"), ("v10", "v11")]
    for a, b in reversed(pairs) if inverse else pairs:
        blocks = paired(blocks, a, b)
    each = F.explode(F.array(*(F.struct((F.col("_bx") * 2 * p + int(n[1]) * p).alias("x"), (F.col("_by") * 2 * p + int(n[2]) * p).alias("y"), F.col(n).alias("v")) for n in names)))
    done = blocks.select("image_id", "wide", each.alias("z")).filter("z.v IS NOT NULL").select("image_id", F.col("z.x").alias("x"), F.col("z.y").alias("y"), F.col("z.v").alias("v"), "wide")
    rest = px.filter(~taking).select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("v").cast("long").alias("v"), "wide")
    return done.unionByName(rest)


def transformed(px: DataFrame, width: int, height: int, inverse: bool = False, levels: int | None = None) -> DataFrame:
    """image_id, x, y, v, wide after all levels, or the first few; inverse undoes them. A level moves only the pixels on its stride, a quarter of those of
    the level before, and is stored, so that the next one does not repeat it."""
    steps = strides(width, height)[:levels]
    px = px.select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("v").cast("long").alias("v"), "wide")
    on = lambda p: (F.col("x") % p == 0) & (F.col("y") % p == 0)
    if not steps:
        return px
    px = stored(px, "wavelet")
    if inverse:
        now = px.filter(on(2 * steps[-1]))
        for p in reversed(steps):
            now = level(stored(now.unionByName(px.filter(on(p) & ~on(2 * p))), "wavelet"), p, width, height, True)
        return now
    now, done = px, []
    for p in steps:
        now = stored(level(now, p, width, height), "wavelet")
        done.append(now.filter(~on(2 * p)))
        now = now.filter(on(2 * p))
    return reduce(DataFrame.unionByName, [*done, now])
