"""How well palettes describe their crops and agree with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.functions import color


def _nearest(points: DataFrame, palette: DataFrame, by: list[str]) -> DataFrame:
    """Least Oklab distance of each distinct colour of ``points`` to its palette.

    The palette, bounded in size, is one array a crop; no row is multiplied."""
    l, a, b = color.oklab()
    lab = palette.groupBy(*by).agg(F.collect_list(F.struct(l.alias("o1"), a.alias("o2"), b.alias("o3"))).alias("p"))
    met = points.join(lab, by)
    d = F.array_min(F.transform("p", lambda q: color.distance((l, a, b), (q["o1"], q["o2"], q["o3"]))))
    return met.withColumn("d", d).drop("p")


def coverage(sample: DataFrame, palette: DataFrame) -> DataFrame:
    """crop_id, coverage: mean distance x 100 of sampled pixels to the nearest
    palette colour; crops without pixels or palette have none."""
    exact = sample.groupBy("crop_id", "r", "g", "b").count()
    met = _nearest(exact, palette, ["crop_id"])
    return met.groupBy("crop_id").agg((100 * F.sum(F.col("d") * F.col("count")) / F.sum("count")).alias("coverage"))


def assignment_error(weighted: DataFrame, palette: DataFrame) -> DataFrame:
    """crop_id, error: the weighted sum of squared distances to the nearest colour."""
    met = _nearest(weighted, palette, ["crop_id"])
    return met.groupBy("crop_id").agg(F.sum(F.col("mass") * F.col("d") * F.col("d")).alias("error"))


def stability(base: DataFrame, variant: DataFrame) -> DataFrame:
    """crop_id, delta_e between the primaries of a crop and of its variant."""
    other = variant.select("crop_id", *(F.col(c).alias(f"v{c}") for c in "rgb"))
    return base.join(other, "crop_id").select("crop_id", color.delta_e(("r", "g", "b"), ("vr", "vg", "vb")).alias("delta_e"))


def directed(a: DataFrame, b: DataFrame) -> DataFrame:
    """crop_id, distance: mean distance x 100 of the colours of ``a`` to the
    nearest of ``b``, by the weights of ``a``."""
    met = _nearest(a.select("crop_id", "r", "g", "b", "weight"), b, ["crop_id"])
    return met.groupBy("crop_id").agg((100 * F.sum(F.col("d") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1e-12))).alias("distance"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    there = directed(a, b).withColumnRenamed("distance", "forward")
    back = directed(b, a).withColumnRenamed("distance", "backward")
    return there.join(back, "crop_id").withColumn("symmetric", (F.col("forward") + F.col("backward")) / 2)


def difference(primaries: DataFrame) -> DataFrame:
    """crop_id, difference: the RGB distances of all pairs of methods' primaries,
    of primaries(crop_id, method, r, g, b) with a bounded number of methods."""
    other = primaries.select("crop_id", F.col("method").alias("m2"), *(F.col(c).alias(f"{c}2") for c in "rgb"))
    pairs = primaries.join(other, "crop_id").filter("method < m2")
    square = sum((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "rgb")
    return pairs.groupBy("crop_id").agg(F.sum(F.sqrt(square.cast("double"))).alias("difference"))


def decode_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """crop_id, exact_rate and channel_error of two decodings, pixel by pixel."""
    other = b.select("crop_id", "idx", *(F.col(c).alias(f"{c}2") for c in "rgb"))
    met = a.join(other, ["crop_id", "idx"])
    off = [F.abs(F.col(c) - F.col(f"{c}2")) for c in "rgb"]
    same = (off[0] + off[1] + off[2] == 0).cast("double")
    return met.groupBy("crop_id").agg(F.avg(same).alias("exact_rate"), F.avg((off[0] + off[1] + off[2]) / 3).alias("channel_error"))


def visible_palette(entries: DataFrame, k: int = 5) -> DataFrame:
    """Top k of entries(crop_id, rank, r, g, b, a, population) by visible mass,
    weights over what is kept; where nothing is visible by population, and where
    there is no population either, black."""
    from pyspark.sql.window import Window

    from chromaloom.operators.histogram import stable

    w = Window.partitionBy("crop_id")
    mass = F.col("population") * F.col("a") / 255.0
    seen = entries.withColumn("mass", mass).withColumn("any", F.max(F.col("mass") > 1e-12).over(w))
    seen = seen.withColumn("mass", F.when(F.col("any"), F.col("mass")).otherwise(F.col("population").cast("double")))
    some = seen.withColumn("some", F.max(F.col("mass") > 1e-12).over(w)).withColumn("first", F.row_number().over(w.orderBy("rank")))
    kept = some.filter((F.col("mass") > 1e-12) | (~F.col("some") & (F.col("first") == 1)))
    black = lambda c: F.when(F.col("some"), F.col(c)).otherwise(0).alias(c)
    ranked = kept.select("crop_id", "rank", black("r"), black("g"), black("b"), F.when(F.col("some"), F.col("mass")).otherwise(1.0).alias("mass"))
    ranked = ranked.withColumn("place", F.row_number().over(w.orderBy(stable("mass").desc(), "rank"))).filter(F.col("place") <= k)
    return ranked.select("crop_id", F.col("place").alias("rank"), "r", "g", "b", (F.col("mass") / F.sum("mass").over(w)).alias("weight"))
