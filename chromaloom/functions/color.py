"""Colour functions as column expressions, all inside whole-stage codegen.

Channels are integers from 0 to 255; Oklab and HSV always read them as c/255.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rgb = Sequence[Column | str]

# The Oklab matrices and the sRGB transfer curve.
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
FROM_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
#: HSV histogram: hue, saturation and value cells; below GREY_S a colour is grey.
HUES, SATS, VALS, GREY_S = 60, 4, 4, 0.08


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _dot(row: Sequence[float], v: Sequence[Column]) -> Column:
    return row[0] * v[0] + row[1] * v[1] + row[2] * v[2]


def channel(x: Column | str) -> Column:
    """Nearest channel value; halves go to the even neighbour."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.rint(_c(x)).cast("int")))


def rgb24(rgb: Rgb = ("r", "g", "b")) -> Column:
    r, g, b = map(_c, rgb)
    return (r * 65536 + g * 256 + b).cast("int")


def unpack(packed: Column | str) -> tuple[Column, Column, Column]:
    p = _c(packed)
    return F.shiftright(p, 16).bitwiseAND(255), F.shiftright(p, 8).bitwiseAND(255), p.bitwiseAND(255)


def hex_of(rgb: Rgb = ("r", "g", "b")) -> Column:
    return F.format_string("#%02X%02X%02X", *map(_c, rgb))


def parse_hex(text: Column | str) -> Column:
    """Packed value of "#RRGGBB" (the sign may be absent); null for anything else."""
    t = F.regexp_extract(_c(text), "^#?([0-9A-Fa-f]{6})$", 1)
    return F.when(t != "", F.conv(t, 16, 10).cast("int"))


def q12(rgb: Rgb = ("r", "g", "b")) -> Column:
    r, g, b = (F.shiftright(_c(x), 4) for x in rgb)
    return (r * 256 + g * 16 + b).cast("int")


def oklab(rgb: Rgb = ("r", "g", "b")) -> tuple[Column, Column, Column]:
    linear = []
    for x in rgb:
        c = _c(x) / F.lit(255.0)
        linear.append(F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))))
    roots = [F.cbrt(_dot(row, linear)) for row in TO_LMS]
    return tuple(_dot(row, roots) for row in TO_LAB)


def from_oklab(lab: Rgb) -> tuple[Column, Column, Column]:
    v = [_c(x) for x in lab]
    lms = [F.pow(_dot(row, v), F.lit(3.0)) for row in FROM_LAB]
    out = []
    for row in FROM_LMS:
        c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(row, lms)))
        out.append(channel(F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055) * 255.0))
    return tuple(out)


def distance(a: Rgb, b: Rgb) -> Column:
    """Euclidean distance of two Oklab colours."""
    return F.sqrt(sum((_c(x) - _c(y)) * (_c(x) - _c(y)) for x, y in zip(a, b)))


def delta_e(a: Rgb, b: Rgb) -> Column:
    """Oklab distance of two RGB colours on a scale of about 0 to 100."""
    return 100.0 * distance(oklab(a), oklab(b))


def hsv(rgb: Rgb = ("r", "g", "b")) -> tuple[Column, Column, Column]:
    """Hue in [0, 1), saturation, value; of equal maxima red counts, then green."""
    r, g, b = (_c(x) / F.lit(255.0) for x in rgb)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    sector = F.when(r == top, F.pmod((g - b) / d, F.lit(6.0))).when(g == top, (b - r) / d + 2).otherwise((r - g) / d + 4)
    hue = F.when(d > 1e-12, F.pmod(sector / 6, F.lit(1.0))).otherwise(0.0)
    return hue, F.when(top > 1e-12, d / top).otherwise(0.0), top


def hsv_bin(rgb: Rgb = ("r", "g", "b")) -> Column:
    """Cell of the HSV histogram: hue*16 + saturation*4 + value, greys from 960 by value."""
    h, s, v = hsv(rgb)
    cell = lambda x, n: F.least((x * n).cast("int"), F.lit(n - 1))
    return F.when(s < GREY_S, HUES * SATS * VALS + cell(v, VALS)).otherwise(cell(h, HUES) * SATS * VALS + cell(s, SATS) * VALS + cell(v, VALS))


def with_hsv_bin(rows: DataFrame, name: str = "bin") -> DataFrame:
    """``rows`` with the HSV cell of r, g, b. The same as hsv_bin(), step by step:
    each step's columns are used several times and so stay columns of their own,
    which keeps the generated code small."""
    keep = rows.columns
    out = rows.withColumns({f"_{c}": F.col(c) / F.lit(255.0) for c in "rgb"})
    out = out.withColumns({"_v": F.greatest("_r", "_g", "_b"), "_d": F.greatest("_r", "_g", "_b") - F.least("_r", "_g", "_b")})
    r, g, b, v, d = (F.col(f"_{c}") for c in "rgbvd")
    sector = F.when(r == v, F.pmod((g - b) / d, F.lit(6.0))).when(g == v, (b - r) / d + 2).otherwise((r - g) / d + 4)
    out = out.withColumns({"_h": F.when(d > 1e-12, F.pmod(sector / 6, F.lit(1.0))).otherwise(0.0), "_s": F.when(v > 1e-12, d / v).otherwise(0.0)})
    cell = lambda x, n: F.least((F.col(x) * n).cast("int"), F.lit(n - 1))
    grey = HUES * SATS * VALS + cell("_v", VALS)
    return out.select(*keep, F.when(F.col("_s") < GREY_S, grey).otherwise(cell("_h", HUES) * SATS * VALS + cell("_s", SATS) * VALS + cell("_v", VALS)).alias(name))


def weight_u16(w: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(65535), F.rint(w * 65535).cast("int")))
