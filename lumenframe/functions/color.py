"""Colour: matrices folded to literals on the driver, transfer curves and space conversions as Columns."""

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# CIE xy of red, green, blue and white.
CHROMATICITIES = {
    "rec709": ((0.64, 0.33), (0.3, 0.6), (0.15, 0.06), (0.3127, 0.329)),
    "p3": ((0.68, 0.32), (0.265, 0.69), (0.15, 0.06), (0.3127, 0.329)),
    "rec2020": ((0.708, 0.292), (0.17, 0.797), (0.131, 0.046), (0.3127, 0.329)),
}
DISPLAY = {"rec709": "srgb", "p3": "display-p3", "rec2020": "rec2020"}


def rgb_to_xyz(space: str) -> np.ndarray:
    """Columns are the primaries, scaled so that equal RGB is the white point."""
    *primaries, white = CHROMATICITIES[space]
    xyz = np.array([[x / y, 1.0, (1 - x - y) / y] for x, y in primaries]).T
    w = np.array([white[0] / white[1], 1.0, (1 - white[0] - white[1]) / white[1]])
    return xyz * np.linalg.solve(xyz, w)


def matrix(source: str, target: str) -> np.ndarray:
    return np.linalg.solve(rgb_to_xyz(target), rgb_to_xyz(source))


def apply_matrix(m, rgb) -> list[Column]:
    return [sum((F.lit(float(k)) * c for k, c in zip(row, rgb, strict=True)), F.lit(0.0)) for row in m]


def convert(rgb, source: str, target: str) -> list[Column]:
    """RGB from one linear space to another; nothing at all between equal ones."""
    return list(rgb) if source == target else apply_matrix(matrix(source, target), rgb)


def to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def to_display(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.lit(1.055) * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def sanitise(c: Column) -> Column:
    """Negative, NaN and infinite become 0."""
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c) | (c < 0) | (c == float("inf")), 0.0).otherwise(c)


def to_u8(c: Column) -> Column:
    """[0, 1] to 0..255, nearest, clamped."""
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), c * 255 + 0.5))).cast("int")


def xyy_to_rgb(x: Column, y: Column, lum: Column, space: str) -> list[Column]:
    dark = y < 1e-6
    div = F.when(dark, 1.0).otherwise(y)
    xyz = [F.when(dark, 0.0).otherwise(v) for v in (x / div * lum, lum, (1 - x - y) / div * lum)]
    return apply_matrix(np.linalg.inv(rgb_to_xyz(space)), xyz)


def space_of(*xy: Column, tolerance: float = 0.01) -> Column:
    """The first known space whose eight chromaticities match; null without one."""
    out = None
    for name, points in CHROMATICITIES.items():
        near = F.lit(True)
        for c, v in zip(xy, [v for p in points for v in p], strict=True):
            near = near & (F.abs(c - v) <= tolerance)
        out = F.when(near, name) if out is None else out.when(near, name)
    return out


# Names of the linear spaces, the display space of each, and the names that a canvas knows.
LINEAR = {"rec709": "linear-rec709", "p3": "linear-p3", "rec2020": "linear-rec2020"}
LINEAR_TO_DISPLAY = {"linear-rec709": "display-srgb", "linear-p3": "display-p3", "linear-rec2020": "display-rec2020"}
DISPLAY_TO_LINEAR = {v: k for k, v in LINEAR_TO_DISPLAY.items()}
DISPLAY_TO_CANVAS = {"display-srgb": "srgb", "display-p3": "display-p3"}


def looked_up(value: Column, names: dict[str, str]) -> Column:
    """names[value]; null for what is not in names."""
    return F.get(F.transform(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in names.items())), lambda x: x.k == value), lambda x: x.v), F.lit(0))


def is_rec709(*xy: Column, tolerance: float = 0.01) -> Column:
    """Whether the eight chromaticities (red, green, blue, white) are those of Rec.709."""
    near = F.lit(True)
    for c, v in zip(xy, [v for p in CHROMATICITIES["rec709"] for v in p], strict=True):
        near = near & (F.abs(c - v) <= tolerance)
    return near


def tone_mapping_problem(*xy: Column, strict: bool = False) -> Column:
    """Why an image must not be tone mapped as it is: its chromaticities are given and not those of Rec.709, or, if strict, not given; else null."""
    none = F.lit(True)
    for c in xy:
        none = none & c.isNull()
    absent = F.lit("no chromaticities") if strict else F.lit(None).cast("string")
    malformed = F.lit(False)
    for c in xy:
        malformed = malformed | c.isNull()
    return F.when(none, absent).when(malformed, F.lit(None).cast("string")).when(~is_rec709(*xy), F.lit("not Rec.709"))


def checked_for_tone_mapping(value: Column, *xy: Column, strict: bool = False) -> Column:
    """value, or an error that ends the query where tone_mapping_problem has one."""
    problem = tone_mapping_problem(*xy, strict=strict)
    return F.when(problem.isNull(), value).otherwise(F.raise_error(F.concat(F.lit("tone mapping needs Rec.709: "), problem)).cast("double"))
