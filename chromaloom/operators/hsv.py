"""The explainable HSV histogram: winner, palette, weighted bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chromaloom.functions import color
from chromaloom.operators import histogram

GREYS = color.HUES * color.SATS * color.VALS
SEPARATION, CANDIDATES, GREY_FROM = 0.025, 12, 0.5
#: Circular smoothing of the hue histogram, and its centre.
KERNEL = (1, 2, 3, 2, 1)


def bins(hist: DataFrame) -> DataFrame:
    return histogram.by_key(color.with_hsv_bin(hist), F.col("bin"), "bin")


def weighted_bins(hist: DataFrame, places: int | None = None) -> DataFrame:
    """Mass and weighted mean colour of each occupied cell."""
    mean = lambda c: (F.sum(F.col("mass") * F.col(c)) / F.sum("mass")).alias(c)
    out = color.with_hsv_bin(hist).groupBy("crop_id", "bin").agg(F.sum("mass").alias("m"), F.sum("n").alias("n"), mean("r"), mean("g"), mean("b"))
    return out.withColumnRenamed("m", "mass")


def smoothed_hues(binned: DataFrame) -> DataFrame:
    """crop_id, hue, smoothed: chromatic mass by hue, each hue adding to its two
    neighbours on either side of the circle."""
    # greys weigh nothing rather than being filtered: a filter on the cell would
    # be pushed below the aggregation with the cell's whole expression in it
    chromatic = F.when(F.col("bin") < GREYS, F.col("mass")).otherwise(0.0)
    hues = binned.groupBy("crop_id", F.floor(F.col("bin") / 16).cast("int").alias("hue")).agg(F.sum(chromatic).alias("mass"))
    taps = F.array(*(F.struct(F.lit(i - 2).alias("by"), F.lit(float(k)).alias("k")) for i, k in enumerate(KERNEL)))
    spread = hues.withColumn("tap", F.explode(taps))
    return spread.groupBy("crop_id", F.pmod(F.col("hue") + F.col("tap.by"), F.lit(color.HUES)).alias("hue")).agg(F.sum(F.col("mass") * F.col("tap.k")).alias("smoothed")).filter("smoothed > 0")


def winner(hist: DataFrame) -> DataFrame:
    """crop_id, bin, route, share: grey where greys hold half of the mass, else
    the heaviest cell of the best smoothed hue."""
    binned = bins(hist)
    total = binned.groupBy("crop_id").agg(F.sum("mass").alias("total"), F.sum(F.when(F.col("bin") >= GREYS, F.col("mass")).otherwise(0.0)).alias("grey"))
    smooth = smoothed_hues(binned)
    best = smooth.groupBy("crop_id").agg(F.max(F.struct(histogram.stable("smoothed").alias("s"), (-F.col("hue")).alias("h"))).alias("b"), F.sum("smoothed").alias("all"))
    best = best.select("crop_id", (-F.col("b.h")).alias("hue"), (F.col("b.s") / F.greatest(F.col("all"), F.lit(1e-12))).alias("share"))
    met = binned.join(total, "crop_id").join(best, "crop_id", "left")
    is_grey = F.round(F.col("grey") / F.greatest("total", F.lit(1e-12)), histogram.PLACES) >= GREY_FROM
    may = F.when(is_grey, F.col("bin") >= GREYS).otherwise((F.col("bin") < GREYS) & (F.floor(F.col("bin") / 16) == F.col("hue")))
    # a hue can win by its neighbours alone: then any cell may
    keyed = met.withColumn("fits", F.coalesce(may, F.lit(False)))
    pick = F.max(F.struct("fits", histogram.stable("mass").alias("m"), (-F.col("bin")).alias("k"), "ratio")).alias("p")
    out = keyed.groupBy("crop_id").agg(pick, F.first(is_grey).alias("is_grey"), F.first("share").alias("share"))
    return out.select(
        "crop_id", (-F.col("p.k")).alias("bin"), F.when(F.col("is_grey"), "achromatic").otherwise("chromatic").alias("route"),
        F.greatest(F.col("p.ratio"), F.when(F.col("is_grey"), F.lit(0.0)).otherwise(F.coalesce("share", F.lit(0.0)))).alias("share"),
    )


def dominant(hist: DataFrame) -> DataFrame:
    """crop_id, r, g, b, route, confidence: the observed colour nearest to the
    mean of the winning cell."""
    won = winner(hist)
    inside = color.with_hsv_bin(hist).join(won, ["crop_id", "bin"])
    colour = histogram.representative(inside, ("crop_id", "bin", "route", "share"))
    return colour.select("crop_id", "r", "g", "b", "bin", "route", F.least(F.lit(1.0), F.col("share")).alias("confidence"))


def palette(hist: DataFrame, k: int = histogram.DEFAULT_COLOURS) -> DataFrame:
    """The winner's colour, then representatives of the heaviest cells that lie
    far enough from it and from each other."""
    cells = histogram.top(bins(hist), "bin", CANDIDATES).select("crop_id", "bin", "rank", "ratio")
    inside = color.with_hsv_bin(hist)
    colours = histogram.representative(inside.join(cells, ["crop_id", "bin"]), ("crop_id", "bin", "rank", "ratio"))
    first = dominant(hist).join(bins(hist).select("crop_id", "bin", "ratio"), ["crop_id", "bin"])
    both = colours.select("crop_id", "bin", "rank", "ratio", "r", "g", "b").unionByName(first.select("crop_id", "bin", F.lit(0).alias("rank"), "ratio", "r", "g", "b"))
    chosen = histogram.entries(both, "bin").select("crop_id", F.posexplode(histogram.separated(F.col("entries"), SEPARATION, k)).alias("at", "e"))
    return chosen.select("crop_id", (F.col("at") + 1).alias("rank"), "e.r", "e.g", "e.b", F.col("e.ratio").alias("weight"))


def hue_ranks(smooth: DataFrame) -> DataFrame:
    w = Window.partitionBy("crop_id").orderBy(histogram.stable("smoothed").desc(), "hue")
    return smooth.withColumn("rank", F.row_number().over(w))
