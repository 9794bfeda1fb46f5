"""The adaptive method: sample statistics choose one of four routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chromaloom.functions import color
from chromaloom.operators import histogram, sampling
from chromaloom.operators.histogram import DEFAULT_COLOURS, PLACES, stable

STOPS, STOP_SEPARATION = 5, 0.015
LAB = ("o1", "o2", "o3")


def _lab(pixels: DataFrame) -> DataFrame:
    l, a, b = color.oklab()
    return pixels.withColumns(dict(zip(LAB, (l, a, b))))


def sample_stats(sample: DataFrame) -> DataFrame:
    """crop_id, n, spread, rgb_std, exact_ratio of a sample: median distance to
    the median Oklab colour, spread of the channels, share of the most frequent
    exact colour."""
    lab = _lab(sample)
    var = lambda c: F.var_pop(F.col(c) / F.lit(255.0))
    centre = lab.groupBy("crop_id").agg(
        *(F.median(c).alias(f"m{c}") for c in LAB),
        F.sqrt((var("r") + var("g") + var("b")) / 3).alias("rgb_std"), F.count("*").alias("n"),
    )
    far = lab.join(centre, "crop_id").withColumn("d", color.distance(LAB, [f"m{c}" for c in LAB]))
    spread = far.groupBy("crop_id").agg(F.median("d").alias("spread"), F.first("rgb_std").alias("rgb_std"), F.first("n").alias("n"))
    most = sample.groupBy("crop_id", color.rgb24().alias("c")).count().groupBy("crop_id").agg(F.max("count").alias("most"))
    return spread.join(most, "crop_id").select("crop_id", "n", "spread", "rgb_std", (F.col("most") / F.col("n")).alias("exact_ratio"))


def extents(pixels: DataFrame) -> DataFrame:
    """Width and height of each crop, of all its pixels."""
    return pixels.groupBy("crop_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def gradient(sample: DataFrame, sizes: DataFrame) -> DataFrame:
    """crop_id, r2, dir_x, dir_y: the share of the Oklab variance that a plane
    over the positions explains, and the direction of its slopes' magnitudes.

    The 2 x 2 normal equations are solved in closed form from covariances; where
    the positions lie on a line, along that line."""
    unit = lambda p, size: F.col(p) / F.greatest(F.col(size) - 1, F.lit(1)) - 0.5
    placed = _lab(sample).join(sizes, "crop_id").withColumns({"u": unit("x", "width"), "v": unit("y", "height")})
    stats = [F.count("*").alias("n"), F.var_pop("u").alias("uu"), F.var_pop("v").alias("vv"), F.covar_pop("u", "v").alias("uv")]
    for c in LAB:
        stats += [F.var_pop(c).alias(f"var{c}"), F.covar_pop("u", c).alias(f"u{c}"), F.covar_pop("v", c).alias(f"v{c}")]
    s = placed.groupBy("crop_id").agg(*stats)
    uu, vv, uv = F.col("uu"), F.col("vv"), F.col("uv")
    det = uu * vv - uv * uv
    flat = det <= 1e-12 * (uu + vv) * (uu + vv)
    line = F.when(uu + vv > 1e-15, uu + vv)
    slopes = {}
    for c in LAB:
        uc, vc = F.col(f"u{c}"), F.col(f"v{c}")
        slopes[c] = (F.coalesce(F.when(flat, uc / line).otherwise((vv * uc - uv * vc) / det), F.lit(0.0)), F.coalesce(F.when(flat, vc / line).otherwise((uu * vc - uv * uc) / det), F.lit(0.0)))
    explained = sum(slopes[c][0] * F.col(f"u{c}") + slopes[c][1] * F.col(f"v{c}") for c in LAB)
    total = sum(F.col(f"var{c}") for c in LAB)
    r2 = F.when((F.col("n") < 8) | (total * F.col("n") <= 1e-12), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), explained / total)))
    sx, sy = (F.sqrt(sum(slopes[c][i] * slopes[c][i] for c in LAB)) for i in (0, 1))
    size = F.sqrt(sx * sx + sy * sy)
    steep = (size > 1e-12) & (F.col("n") >= 8)
    return s.select("crop_id", r2.alias("r2"), F.when(steep, sx / size).otherwise(1.0).alias("dir_x"), F.when(steep, sy / size).otherwise(0.0).alias("dir_y"))


def route(r2: Column, spread: Column, top1: Column, exact_ratio: Column, rgb_std: Column) -> Column:
    """Thresholds compare after rounding, so that engines agree on them."""
    r2, spread, top1, exact_ratio, rgb_std = (F.round(x, PLACES) for x in (r2, spread, top1, exact_ratio, rgb_std))
    return (
        F.when((r2 >= 0.84) & (spread >= 0.035) & (top1 < 0.22), "gradient")
        .when((top1 >= 0.88) | ((top1 >= 0.55) & (exact_ratio >= 0.25)) | (rgb_std < 0.008), "flat")
        .when((spread < 0.105) | (top1 >= 0.35), "mild")
        .otherwise("texture")
    )


def routed(pixels: DataFrame, visible: DataFrame, hist: DataFrame, sample: DataFrame) -> DataFrame:
    """One row a crop with all statistics and the route."""
    top1 = histogram.top(histogram.q12(hist), "q12", 1).select("crop_id", F.col("ratio").alias("top1"))
    met = sample_stats(sample).join(gradient(sample, extents(pixels)), "crop_id").join(top1, "crop_id")
    return met.withColumn("route", route(F.col("r2"), F.col("spread"), F.col("top1"), F.col("exact_ratio"), F.col("rgb_std")))


def gradient_stops(sample: DataFrame, directions: DataFrame) -> DataFrame:
    """crop_id, stops: up to five colours at even places along the direction,
    each far enough from those before it."""
    w = Window.partitionBy("crop_id")
    centred = sample.join(directions.select("crop_id", "dir_x", "dir_y"), "crop_id").withColumns(
        {"cx": F.col("x") - F.avg("x").over(w), "cy": F.col("y") - F.avg("y").over(w)}
    )
    along = F.round(F.col("cx") * F.col("dir_x") + F.col("cy") * F.col("dir_y"), PLACES)
    placed = centred.withColumn("at", F.row_number().over(w.orderBy(along, "idx")) - 1).withColumn("n", F.count("*").over(w))
    # several stops can fall on one pixel of a small sample
    wanted = F.filter(F.array(*(F.struct(F.lit(i + 1).alias("rank"), F.rint(F.lit(float(i)) * (F.col("n") - 1) / (STOPS - 1)).alias("p")) for i in range(STOPS))), lambda s: s["p"] == F.col("at"))
    picked = placed.withColumn("s", F.explode(wanted)).select("crop_id", F.col("s.rank").alias("rank"), "r", "g", "b", F.lit(1.0).alias("ratio"), F.lit(0).alias("key"))
    return histogram.entries(picked, "key").select("crop_id", histogram.separated(F.col("entries"), STOP_SEPARATION, STOPS).alias("stops"))


def sample_centre(sample: DataFrame) -> DataFrame:
    """The observed colour nearest to the sample's median RGB."""
    mid = sample.groupBy("crop_id").agg(*(F.median(c).alias(f"m{c}") for c in "rgb"))
    d = color.distance(color.oklab(), color.oklab(("mr", "mg", "mb")))
    near = sample.join(mid, "crop_id").groupBy("crop_id").agg(F.min(F.struct(F.round(d, PLACES).alias("d"), "idx", "r", "g", "b")).alias("m"))
    return near.select("crop_id", F.struct("m.r", "m.g", "m.b").alias("centre"))


def adaptive(pixels: DataFrame, visible: DataFrame, hist: DataFrame) -> DataFrame:
    """crop_id, route, primary(r, g, b), palette, weights, confidence, observed
    and the statistics behind the route.

    Palette and weights are carried as pairs: a colour that is dropped because
    it is the primary takes its weight with it.
    """
    sample = sampling.sample(visible)
    stats = routed(pixels, visible, hist, sample)
    heavy = histogram.dominant(hist).select("crop_id", F.struct("r", "g", "b").alias("heavy"))
    q = histogram.nest(histogram.q12_palette(hist)).withColumnsRenamed({"palette": "q", "weights": "qw"})
    stops = gradient_stops(sample, stats)
    met = stats.join(heavy, "crop_id").join(q, "crop_id").join(stops, "crop_id").join(sample_centre(sample), "crop_id")
    stop = F.transform("stops", lambda s: F.struct(s["r"].alias("r"), s["g"].alias("g"), s["b"].alias("b")))
    calm = F.greatest(F.lit(0.0), 1.0 - F.col("spread") * 4)
    primary = (
        F.when(F.col("route") == "flat", F.col("heavy"))
        .when(F.col("route") == "mild", F.col("centre"))
        .when(F.col("route") == "gradient", F.element_at(stop, (F.floor(F.size("stops") / 2) + 1).cast("int")))
        .otherwise(F.element_at("q", 1))
    )
    pairs = F.arrays_zip(F.col("q").alias("c"), F.col("qw").alias("w"))
    rest = F.filter(pairs, lambda p: p["c"] != F.col("primary"))
    first = F.array(F.struct(F.col("primary").alias("c"), F.when(F.col("route") == "flat", F.col("top1")).otherwise(calm).alias("w")))
    led = F.slice(F.concat(first, rest), 1, DEFAULT_COLOURS)
    even = F.transform(stop, lambda c: F.struct(c.alias("c"), (1.0 / F.size("stops")).alias("w")))
    chosen = F.when(F.col("route").isin("flat", "mild"), led).when(F.col("route") == "gradient", even).otherwise(pairs)
    total = F.aggregate("qw", F.lit(0.0), lambda t, w: t + w)
    confidence = (
        F.when(F.col("route") == "flat", 0.55 + 0.45 * F.col("top1"))
        .when(F.col("route") == "mild", F.greatest(F.lit(0.25), F.least(F.lit(0.95), 1.0 - F.col("spread") * 4)))
        .when(F.col("route") == "gradient", F.col("r2"))
        .otherwise(F.least(F.lit(0.95), F.greatest(F.lit(0.2), total)))
    )
    out = met.withColumn("primary", primary).withColumn("chosen", chosen)
    return out.select(
        "crop_id", "route", "primary", F.transform("chosen", lambda p: p["c"]).alias("palette"), F.transform("chosen", lambda p: p["w"]).alias("weights"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)).alias("confidence"), F.lit(True).alias("observed"),
        "n", "top1", "spread", "rgb_std", "exact_ratio", "r2",
    )


__all__ = ["adaptive", "extents", "gradient", "gradient_stops", "route", "routed", "sample_centre", "sample_stats", "stable"]
