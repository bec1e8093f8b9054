"""Gain maps: boost aggregate, quantised and float encoding, decoding, as Columns and one aggregate an image."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import sanitise, to_display, to_linear, to_u8
from ..functions.tone import mapped

OFFSET = 1 / 64
RGB = ("r", "g", "b")
#: The largest value of a decoded channel: that of a half float.
BRIGHTEST = 65504.0


@dataclass(frozen=True)
class Options:
    """Parameters of a map, those with three values by channel. max_boost None (or 0 and below) is found from the image."""

    offset_sdr: tuple[float, float, float] = (OFFSET,) * 3
    offset_hdr: tuple[float, float, float] = (OFFSET,) * 3
    gamma: tuple[float, float, float] = (1.0,) * 3
    min_boost: float = 1.0
    max_boost: float | None = None


DEFAULT = Options()


def with_tone(px: DataFrame, mapper: str = "aces", exposure: float = 1.0) -> DataFrame:
    """px (image_id, p, r, g, b) with the sanitised channels x_*, the exposed ones h_* and the mapped ones m_*."""
    px = px.withColumns({f"x_{c}": sanitise(F.col(c)) for c in RGB})
    px = px.withColumns({c: F.col(f"x_{c}") for c in RGB} | {f"h_{c}": F.col(f"x_{c}") * exposure for c in RGB})
    m = mapped(px, mapper=mapper, exposure=exposure)
    return m.withColumns({f"m_{c}": F.col(c) for c in RGB})


def ratio(above: Column, below: Column) -> Column:
    """above / below, 1 where below is not positive."""
    return F.when(below > 0, above / F.when(below > 0, below).otherwise(1.0)).otherwise(1.0)


def boosts(toned: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """image_id, max_boost: the largest (exposed + offset) / (mapped + offset), at least the brightest channel of the image before exposure and 1.0001;
    or the one that options set."""
    if options.max_boost is not None and options.max_boost > 0:
        return toned.select("image_id").distinct().withColumn("max_boost", F.lit(max(float(options.max_boost), 1.0001)))
    gains = [ratio(F.col(f"h_{c}") + options.offset_hdr[k], F.col(f"m_{c}") + options.offset_sdr[k]) for k, c in enumerate(RGB)]
    brightest = F.max(F.greatest(*(F.col(f"x_{c}") for c in RGB)))
    return toned.groupBy("image_id").agg(F.greatest(F.max(F.greatest(*gains)), brightest, F.lit(1.0001)).alias("max_boost"))


def log_range(boost: Column, options: Options = DEFAULT) -> tuple[Column, Column]:
    """log2 of the smallest and of the largest boost; the range is never empty."""
    low = F.log2(F.lit(float(options.min_boost)))
    return low, F.when(F.log2(boost) > low, F.log2(boost)).otherwise(low + 1e-6)


def capacity(low: Column, high: Column) -> tuple[Column, Column]:
    """The display capacities from which a map shows and at which it shows whole."""
    return F.greatest(F.lit(0.0), low), F.greatest(F.lit(0.0), high)


def encoded(toned: DataFrame, boost: DataFrame, quantised: bool = True, options: Options = DEFAULT) -> DataFrame:
    """sdr_* and gm_* (0..255, or 0..1 when not quantised), log_min and log_max; the per-image scalars join their pixels. Quantised, the map is the
    ratio to what the 8-bit picture decodes to, else to the mapped channels."""
    low, high = log_range(F.col("max_boost"), options)
    df = toned.join(boost, "image_id").withColumns({"log_min": low, "log_max": high})
    sdr = {f"sdr_{c}": to_display(F.greatest(F.col(f"m_{c}"), F.lit(0.0))) for c in RGB}
    df = df.withColumns({k: to_u8(v) for k, v in sdr.items()} if quantised else sdr)
    gm = {}
    for k, c in enumerate(RGB):
        shown = to_linear(F.col(f"sdr_{c}") / 255.0) if quantised else F.col(f"m_{c}")
        gain = F.log2(ratio(F.col(f"h_{c}") + options.offset_hdr[k], shown + options.offset_sdr[k]))
        part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (gain - F.col("log_min")) / (F.col("log_max") - F.col("log_min"))))
        gm[f"gm_{c}"] = part if options.gamma[k] == 1 else F.pow(part, F.lit(float(options.gamma[k])))
    return df.withColumns({k: to_u8(v) if quantised else v for k, v in gm.items()})


def decoded(df: DataFrame, weight=None, quantised: bool = True, options: Options = DEFAULT) -> DataFrame:
    """r, g, b from sdr_*, gm_*, log_min and log_max at a weight of the map (1: full boost)."""
    scale = 255.0 if quantised else 1.0
    w = F.lit(1.0) if weight is None else weight
    out = {}
    for k, c in enumerate(RGB):
        part = F.col(f"gm_{c}") / scale
        part = part if options.gamma[k] == 1 else F.pow(part, F.lit(1.0 / options.gamma[k]))
        gain = F.pow(F.lit(2.0), w * (F.col("log_min") * (1 - part) + F.col("log_max") * part))
        out[c] = F.least(F.lit(BRIGHTEST), F.greatest(F.lit(0.0), (to_linear(F.col(f"sdr_{c}") / scale) + options.offset_sdr[k]) * gain - options.offset_hdr[k]))
    return df.withColumns(out)


def weight_for(display_boost: float, low: Column, high: Column) -> Column:
    """Share of a map of that range of log2 boosts that a display with display_boost shows."""
    from_, whole = capacity(low, high)
    span = whole - from_
    return F.when(span <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log2(F.lit(float(display_boost))) - from_) / F.when(span > 0, span).otherwise(1.0))))


def joined(sdr: DataFrame, gain_map: DataFrame, metadata: DataFrame) -> DataFrame:
    """A picture (image_id, p, sdr_*), its map (image_id, p, gm_*) of the same size, and the scalars of the image (log_min, log_max) as one table to decode;
    pixels that only one of them has are left out."""
    return sdr.join(gain_map, ["image_id", "p"]).join(metadata, "image_id")


def joined_sizes(sdr: DataFrame, gain_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """joined for a map of another size than its picture: each pixel of the picture takes the nearest one of the map. sizes: image_id, width, height,
    map_width, map_height, log_min, log_max; p counts line by line in either. The place in the map is worked out from the pixel's own, so both sides meet
    by image and place and nothing is multiplied but what the picture repeats of the map."""
    s = sizes.select(F.col("image_id").alias("_i"), "width", "height", "map_width", "map_height", "log_min", "log_max")
    df = sdr.join(s, sdr["image_id"].eqNullSafe(F.col("_i"))).drop("_i")
    near = lambda v, n, m: F.least(F.floor(v * F.col(m) / F.col(n)), F.col(m) - 1)
    at = near(F.floor(F.col("p") / F.col("width")), "height", "map_height") * F.col("map_width") + near(F.col("p") % F.col("width"), "width", "map_width")
    m = gain_map.select(F.col("image_id").alias("_i"), F.col("p").alias("_p"), *(f"gm_{c}" for c in RGB))
    df = df.withColumn("_at", at.cast("long"))
    return df.join(m, df["image_id"].eqNullSafe(F.col("_i")) & (df["_at"] == F.col("_p"))).drop("_i", "_p", "_at", "width", "height", "map_width", "map_height")
