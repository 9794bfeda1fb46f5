"""Deterministic samples: hashed choice, stratified grids, even positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chromaloom.operators.ordering import with_prefix

SAMPLE, COVERAGE, BOX_PIXELS = 64, 4096, 2048
#: Sides of a shrunk image: its short side, and what both are multiples of.
SHORT_SIDE, GRAIN = 256, 16
# An odd multiplier and modulus of the sampling hash.
_MUL, _HALF, _MOD = 2_654_435_761, 2_147_483_648, 4_294_967_296


def hashed_place(idx: Column, crop: Column) -> Column:
    """An arithmetic hash that any SQL engine can repeat, without overflow."""
    start = idx.cast("bigint") + crop.cast("bigint") % _HALF * 7919 + 1
    return (start % _HALF * F.lit(_MUL)) % F.lit(_MOD)


def sample(pixels: DataFrame, count: int = SAMPLE) -> DataFrame:
    """``count`` pixels of each crop (all of a smaller one), by the hash of their
    place. The first of a sorted window: Spark keeps only ``count`` rows a crop
    and task before it shuffles."""
    named = dict(pixels.dtypes)["crop_id"] == "string"
    crop = F.crc32(F.col("crop_id").cast("binary")) if named else F.col("crop_id")
    w = Window.partitionBy("crop_id").orderBy(hashed_place(F.col("idx"), crop), "idx")
    return pixels.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= count).drop("_rank")


def coverage_sample(pixels: DataFrame, count: int = COVERAGE) -> DataFrame:
    """Pixels at ``count`` even positions of the crop's pixels in order; all of
    them where there are no more than that."""
    w = Window.partitionBy("crop_id")
    placed = pixels.withColumn("_at", F.row_number().over(w.orderBy("idx")) - 1).withColumn("_n", F.count("*").over(w))
    # position p is chosen if some i has i*(n-1) div (count-1) = p
    i = F.ceil(F.col("_at").cast("bigint") * (count - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = F.floor(i * (F.col("_n") - 1) / F.lit(count - 1)) == F.col("_at")
    return placed.filter((F.col("_n") <= count) | (hit & (i < count))).drop("_at", "_n")


def grid_shape(w: Column, h: Column, most: int = BOX_PIXELS) -> tuple[Column, Column]:
    """(columns, rows) of the sampling grid of a w x h box."""
    bound = lambda x, hi: F.greatest(F.lit(1), F.least(hi, x))
    cols = bound(F.rint(F.sqrt(most * w / F.greatest(h, F.lit(1)))).cast("int"), w)
    rows = bound(F.floor(F.lit(most) / cols).cast("int"), h)
    fit = F.when(rows * cols > most, F.greatest(F.lit(1), F.floor(F.lit(most) / rows).cast("int"))).otherwise(cols)
    whole = w * h <= most
    return F.when(whole, w).otherwise(fit), F.when(whole, h).otherwise(rows)


def shrunk_size(width: Column, height: Column, short: int = SHORT_SIDE, grain: int = GRAIN) -> tuple[Column, Column]:
    """(width, height) once the short side is ``short`` and both are multiples of
    ``grain``; an image with a side of at most ``short`` keeps its size."""
    least = F.least(width, height)
    fit = lambda x: F.when(least <= short, x).otherwise((F.ceil(F.greatest(F.rint(x * short / least), F.lit(1.0)) / grain) * grain).cast("int"))
    return fit(width), fit(height)


def clamp_boxes(boxes: DataFrame) -> DataFrame:
    """boxes(path, box_index, l, t, r, b, width, height) cut to their image;
    boxes without area go, the others keep their index."""
    cut = lambda x, most: F.least(F.greatest(F.col(x), F.lit(0)), F.col(most))
    out = boxes.select("path", "box_index", *(cut(x, m).alias(x) for x, m in (("l", "width"), ("t", "height"), ("r", "width"), ("b", "height"))))
    return out.filter("r > l and b > t")


def grid(boxes: DataFrame, most: int = BOX_PIXELS) -> DataFrame:
    """The sampled points (path, box_index, at, x, y) of each box."""
    w, h = F.col("r") - F.col("l"), F.col("b") - F.col("t")
    cols, rows = grid_shape(w, h, most)
    shaped = boxes.select("path", "box_index", "l", "t", w.alias("w"), h.alias("h"), cols.alias("cols"), rows.alias("rows"))
    line = shaped.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    point = line.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    step = lambda i, n, size: F.floor(F.col(i) * (F.col(size) - 1) / F.greatest(F.col(n) - 1, F.lit(1))).cast("int")
    return point.select(
        "path", "box_index", (F.col("row") * F.col("cols") + F.col("col")).alias("at"),
        (F.col("l") + step("col", "cols", "w")).alias("x"), (F.col("t") + step("row", "rows", "h")).alias("y"),
    )


def display_ids(ids: DataFrame, count: int) -> DataFrame:
    """ids(crop_id) at ``count`` even places of their order."""
    placed = with_prefix(ids.select("crop_id"), "crop_id", name="at")
    n = F.col("at_total")
    k = F.greatest(F.lit(1), F.least(F.lit(count), n))
    # place p is chosen if the position nearest to it comes back to it
    i = F.rint(F.col("at") * (k - 1) / F.greatest(n - 1, F.lit(1)))
    near = [F.rint((i + d) * (n - 1) / F.greatest(k - 1, F.lit(1))) == F.col("at") for d in (-1, 0, 1)]
    inside = [(i + d >= 0) & (i + d < k) for d in (-1, 0, 1)]
    return placed.filter((near[0] & inside[0]) | (near[1] & inside[1]) | (near[2] & inside[2])).select("crop_id")
