"""Palettes of many boxes of an image: decode once, sample each box, cluster."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.functions import color
from chromaloom.operators import clustering, histogram, observed, sampling

#: Methods of box palettes and the kernels behind them.
METHODS = {"pixelero": "pixelero_rgb_hist", "hsv_pixelero": "hsv_pixelero_kmeans", "octree": "octree", "libimagequant": "liq_like"}

#: Long names, which also tell that clusters are pruned and colours observed.
_LONG = re.compile(r"(?P<base>pixelero|hsv_pixelero|octree|pngquant_liq_speed(?P<speed>[0-9]+))_observed_pruned")


def kernel_of(method: str) -> str:
    """The kernel behind a method by its short or long name. The quantiser's
    speed, 1 to 10, is checked; this kernel works alike at each."""
    name = method
    if m := _LONG.fullmatch(method):
        if m["speed"] and not 1 <= int(m["speed"]) <= 10:
            raise ValueError(f"the speed is 1 to 10, not {m['speed']}")
        name = "libimagequant" if m["speed"] else m["base"]
    if name not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {sorted(METHODS)}")
    return METHODS[name]


def sampled(pixels: DataFrame, boxes: DataFrame, most: int = sampling.BOX_PIXELS) -> DataFrame:
    """The sampled pixels of each box, of pixels(path, x, y, r, g, b) and
    boxes(path, box_index, l, t, r, b, width, height): an equi-join on the places
    of the grids, so an image is read once whatever its boxes. crop_id is
    path#box_index; boxes outside their image have no rows.

    The merge is asked for: by the size of the boxes, Spark would take the points,
    up to ``most`` times as many, for few and gather them in the driver."""
    inside = sampling.clamp_boxes(boxes)
    # images without boxes go before anything shuffles or sorts their pixels
    named = pixels.join(inside.select("path").distinct(), "path", "left_semi")
    met = sampling.grid(inside, most).hint("merge").join(named, ["path", "x", "y"])
    crop = F.concat("path", F.lit("#"), F.col("box_index").cast("string"))
    return met.select(crop.alias("crop_id"), "path", "box_index", F.col("at").alias("idx"), "x", "y", "r", "g", "b", F.lit(1.0).alias("w"))


def histograms(samples: DataFrame) -> DataFrame:
    """hist of sampled boxes. A box has few pixels, so they meet in one shuffle by
    box, which all that reads the histogram shares, whatever columns it takes."""
    return histogram.exact(samples.repartition("crop_id"))


def box_palettes(pixels: DataFrame, boxes: DataFrame, method: str = "libimagequant", k: int = 5, most: int = sampling.BOX_PIXELS) -> DataFrame:
    """path, box_index, rank, r, g, b, weight: observed colours, clusters below
    one percent left out."""
    kernel = kernel_of(method)
    if not 1 <= k <= 32:
        raise ValueError("a box palette has 1 to 32 colours")
    hist = histograms(sampled(pixels, boxes, most))
    return by_box(observed.remap_nearest(clustering.cluster(hist, kernel, k), hist, k))


def by_box(palette: DataFrame) -> DataFrame:
    """Palette rows of crops path#box_index with these two columns instead."""
    where = F.substring_index("crop_id", "#", -1).cast("int")
    return palette.select(F.expr("substring(crop_id, 1, length(crop_id) - length(substring_index(crop_id, '#', -1)) - 1)").alias("path"), where.alias("box_index"), "rank", "r", "g", "b", "weight")


def nested(palettes: DataFrame) -> DataFrame:
    """One row an image: its boxes in order with colours and weights."""
    entry = F.struct("rank", color.hex_of().alias("hex"), F.round("weight", 6).alias("weight"))
    box = palettes.groupBy("path", "box_index").agg(F.sort_array(F.collect_list(entry)).alias("palette"))
    return box.groupBy("path").agg(F.count("*").alias("boxes_n"), F.sort_array(F.collect_list(F.struct("box_index", "palette"))).alias("boxes"))
