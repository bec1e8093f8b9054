"""Tone mappers as Column builders (three columns in, three out) and the display pipeline."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .color import apply_matrix, convert, sanitise, to_display, to_u8

# Fixed values of the published curves.
ACES_IN = ((0.59719, 0.35458, 0.04823), (0.076, 0.90834, 0.01566), (0.0284, 0.13383, 0.83777))
ACES_OUT = ((1.60475, -0.53108, -0.07367), (-0.10208, 1.10813, -0.00605), (-0.00327, -0.07276, 1.07602))
AGX_IN = ((0.856627153315983, 0.0951212405381588, 0.0482516061458583), (0.137318972929847, 0.761241990602591, 0.101439036467562), (0.11189821299995, 0.0767994186031903, 0.811302368396859))
AGX_OUT = ((1.1271005818144368, -0.11060664309660323, -0.016493938717834573), (-0.1413297634984383, 1.157823702216272, -0.016493938717834257), (-0.14132976349843826, -0.11060664309660294, 1.2519364065950405))
AGX_EV = (-12.47393, 4.026069)
AGX_CURVE = (-0.00232, 0.1191, 0.4298, -6.868, 31.96, -40.14, 15.5)
NEUTRAL_START, NEUTRAL_DESATURATION = 0.8 - 0.04, 0.15


def polynomial(x: Column, coefficients) -> Column:
    """Horner's rule, constant term first."""
    out = F.lit(float(coefficients[-1]))
    for k in reversed(coefficients[:-1]):
        out = out * x + F.lit(float(k))
    return out


# Each mapper is a list of steps, one select each, so that no expression is written out twice in the plan.
def _reinhard():
    return [lambda c: [x / (1 + x) for x in c]]


def _aces():
    fit = lambda v: (v * (v + 0.0245786) - 0.000090537) / (v * (v * 0.983729 + 0.432951) + 0.238081)
    return [lambda c: apply_matrix(ACES_IN, c), lambda c: [fit(x) for x in c], lambda c: apply_matrix(ACES_OUT, c)]


def _neutral():
    def toe(c):
        low = F.least(*c)
        return [x - F.when(low < 0.08, low - low * low * 6.25).otherwise(0.04) for x in c]

    def shoulder(c):
        d, peak = 1 - NEUTRAL_START, F.greatest(*c)
        over = peak >= NEUTRAL_START
        safe = F.when(over, peak).otherwise(1.0)
        new = 1 - F.lit(d * d) / (safe + (d - NEUTRAL_START))
        mix = 1 - 1 / ((safe - new) * NEUTRAL_DESATURATION + 1)
        return [F.when(over, x * new / safe * (1 - mix) + new * mix).otherwise(x) for x in c]

    return [toe, shoulder]


def _agx():
    low, high = AGX_EV
    ev = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log2(F.greatest(x, F.lit(1e-10))) - low) / (high - low)))
    return [
        lambda c: convert(c, "rec709", "rec2020"),
        lambda c: apply_matrix(AGX_IN, c),
        lambda c: [ev(x) for x in c],
        lambda c: [polynomial(x, AGX_CURVE) for x in c],
        lambda c: apply_matrix(AGX_OUT, c),
        lambda c: [F.pow(F.greatest(F.lit(0.0), x), F.lit(2.2)) for x in c],
        lambda c: convert(c, "rec2020", "rec709"),
    ]


MAPPERS = {"reinhard": _reinhard, "aces": _aces, "neutral": _neutral, "agx": _agx}


def stepped(df: DataFrame, steps, names=("r", "g", "b")) -> DataFrame:
    for step in steps:
        df = df.withColumns(dict(zip(names, step([F.col(n) for n in names]), strict=True)))
    return df


def mapped(df: DataFrame, mapper: str = "reinhard", exposure: float = 1.0, space: str = "rec709") -> DataFrame:
    """r, g, b after sanitising, conversion to rec709, exposure and the mapper, with 32-bit stores before and after it."""
    f32 = lambda c: [x.cast("float").cast("double") for x in c]
    steps = [lambda c: [sanitise(x) for x in c], lambda c: convert(c, space, "rec709"), lambda c: f32([x * exposure for x in c]), *MAPPERS[mapper](), f32]
    return stepped(df, steps)


def displayed(df: DataFrame, **options) -> DataFrame:
    """r, g, b as 0..255 display values."""
    df = mapped(df, **options)
    return stepped(df, [lambda c: [to_display(F.greatest(x, F.lit(0.0))) for x in c], lambda c: [to_u8(x) for x in c]])


def hdr_to_ldr(df: DataFrame, file_exposure: Column, mapper: str = "reinhard", exposure: float | None = None) -> DataFrame:
    """Display values of Radiance pixels: at the exposure asked for, else the file's (null: it has none), else 1."""
    e = F.lit(float(exposure)) if exposure is not None else F.coalesce(file_exposure.cast("double"), F.lit(1.0))
    return displayed(df.withColumn("_exposure", e), mapper=mapper, exposure=F.col("_exposure")).drop("_exposure")
