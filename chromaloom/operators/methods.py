"""The methods by name: each takes (pixels, k) and returns palette rows.

palette(crop_id, rank, r, g, b, weight); the names with ``observed`` only return
colours that occur in the crop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.operators import adaptive, clustering, histogram, hsv, observed
from chromaloom.sources.scene import visible

Method = Callable[[DataFrame, int], DataFrame]
#: Stride and brightness bound of the median-cut method's sample.
STRIDE, WHITE = 10, 250


def _hist(pixels: DataFrame) -> DataFrame:
    return histogram.exact(visible(pixels))


def _adaptive(pixels: DataFrame, k: int) -> DataFrame:
    seen = visible(pixels)
    found = adaptive.adaptive(pixels, seen, histogram.exact(seen))
    pairs = F.arrays_zip(F.col("palette").alias("c"), F.col("weights").alias("w"))
    rows = found.select("crop_id", F.posexplode(F.slice(pairs, 1, k)).alias("at", "p"))
    return rows.select("crop_id", (F.col("at") + 1).alias("rank"), "p.c.r", "p.c.g", "p.c.b", F.col("p.w").alias("weight"))


def _kernel(name: str) -> Method:
    return lambda pixels, k: clustering.cluster(_hist(pixels), name, k)


def _remapped(palette: Callable[[DataFrame, int], DataFrame]) -> Method:
    def run(pixels: DataFrame, k: int) -> DataFrame:
        hist = _hist(pixels)
        return observed.remap_all(palette(hist, k), hist, k)

    return run


def _median_cut(pixels: DataFrame, k: int) -> DataFrame:
    """Modified median cut of every tenth pixel that isn't nearly white; of all
    of them where nothing else is left."""
    seen = visible(pixels).filter(F.col("idx") % STRIDE == 0)
    white = (F.col("r") > WHITE) & (F.col("g") > WHITE) & (F.col("b") > WHITE)
    some = seen.groupBy("crop_id").agg(F.max(~white).alias("coloured"))
    kept = seen.join(some, "crop_id").filter(~F.col("coloured") | ~white)
    return clustering.cluster(histogram.exact(kept), "mmcq", k)


METHODS: dict[str, Method] = {
    "adaptive_v1": _adaptive,
    "tencent_hsv": lambda pixels, k: hsv.palette(_hist(pixels), k),
    "tencent_hsv_weighted_observed": _remapped(hsv.palette),
    "color_thief_v3": _median_cut,
    "colorpipette_inspired": lambda pixels, k: clustering.salient(visible(pixels), k),
    "pngquant_liq": _kernel("liq_like"),
    "pixelero_rgb_hist": _kernel("pixelero_rgb_hist"),
    "octree": _kernel("octree"),
    "hsv_bins_pixelero_kmeans": _kernel("hsv_pixelero_kmeans"),
    "pixelero_bins_hsv_clustering": _kernel("pixelero_hsv_cluster"),
    "hsv_bins_octree_quantization": _kernel("hsv_octree"),
    "pixelero_weighted_observed": _remapped(lambda h, k: clustering.cluster(h, "pixelero_rgb_hist", k)),
    "octree_weighted_observed": _remapped(lambda h, k: clustering.cluster(h, "octree", k)),
    "hsv_pixelero_weighted_observed": _remapped(lambda h, k: clustering.cluster(h, "hsv_pixelero_kmeans", k)),
    "pixelero_hsv_weighted_observed": _remapped(lambda h, k: clustering.cluster(h, "pixelero_hsv_cluster", k)),
    "hsv_octree_weighted_observed": _remapped(lambda h, k: clustering.cluster(h, "hsv_octree", k)),
}


def extract(pixels: DataFrame, method: str, k: int = histogram.DEFAULT_COLOURS) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {sorted(METHODS)}")
    if not 1 <= k <= 256:
        raise ValueError("a palette has 1 to 256 colours")
    return METHODS[method](pixels, k)
