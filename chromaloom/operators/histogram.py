"""Histograms of colours and what is picked from them.

One exact-colour histogram per crop, hist(crop_id, r, g, b, rgb24, mass, n,
min_idx), feeds everything that doesn't depend on where a pixel lies. It is
aggregated on the map side first, and its rows are bounded by a crop's distinct
colours. Ties go to the larger mass, then the smaller key, then the smaller
place; masses compare after rounding, so that the order of a sum doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chromaloom.functions import color

PLACES = 9
Q_SEPARATION, DEFAULT_COLOURS = 0.018, 5


def stable(mass: Column | str) -> Column:
    """A sum made comparable."""
    return F.round(mass, PLACES)


def exact(pixels: DataFrame, weight: str = "w") -> DataFrame:
    """hist of weighted pixels."""
    return (
        pixels.groupBy("crop_id", "r", "g", "b")
        .agg(F.sum(weight).alias("mass"), F.count("*").alias("n"), F.min("idx").alias("min_idx"))
        .select("crop_id", "r", "g", "b", color.rgb24().alias("rgb24"), "mass", "n", "min_idx")
    )


def by_key(hist: DataFrame, key: Column, name: str) -> DataFrame:
    """Mass by crop and a key of the colour, with its share of the crop."""
    binned = hist.groupBy("crop_id", key.alias(name)).agg(F.sum("mass").alias("mass"), F.sum("n").alias("n"))
    total = F.sum("mass").over(Window.partitionBy("crop_id"))
    return binned.withColumn("ratio", F.col("mass") / F.greatest(total, F.lit(1e-12)))


def q12(hist: DataFrame) -> DataFrame:
    return by_key(hist, color.q12(), "q12")


def top(binned: DataFrame, key: str, k: int) -> DataFrame:
    """The k heaviest bins of each crop, with their rank from 1."""
    w = Window.partitionBy("crop_id").orderBy(stable("mass").desc(), F.col(key))
    return binned.filter("mass > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def heavy_hitter(hist: DataFrame, by: tuple[str, ...] = ("crop_id",)) -> DataFrame:
    """The heaviest exact colour of each group; of equals the smallest rgb24."""
    best = F.max(F.struct(stable("mass").alias("m"), (-F.col("rgb24")).alias("k"), "r", "g", "b", "mass")).alias("best")
    return hist.groupBy(*by).agg(best).select(*by, "best.r", "best.g", "best.b", "best.mass")


def representative(hist: DataFrame, by: tuple[str, ...] = ("crop_id",)) -> DataFrame:
    """The observed colour nearest in Oklab to the weighted mean RGB of its
    group; of equals the one seen first. Two aggregations, no pixel gathers."""
    mean = lambda c: (F.sum(F.col("mass") * F.col(c)) / F.sum("mass")).alias(f"m{c}")
    centre = hist.groupBy(*by).agg(mean("r"), mean("g"), mean("b"), F.sum("mass").alias("group_mass"))
    met = hist.join(centre, list(by))
    d = color.distance(color.oklab(("r", "g", "b")), color.oklab(("mr", "mg", "mb")))
    near = F.min(F.struct(F.round(d, PLACES).alias("d"), "min_idx", "r", "g", "b")).alias("near")
    return met.groupBy(*by).agg(near, F.first("group_mass").alias("mass")).select(*by, "near.r", "near.g", "near.b", "mass")


def dominant(hist: DataFrame) -> DataFrame:
    """crop_id, hex, top1_ratio, confidence: the heaviest colour within the
    heaviest q12 bin."""
    best = top(q12(hist), "q12", 1).select("crop_id", "q12", F.col("ratio").alias("top1_ratio"))
    inside = hist.withColumn("q12", color.q12()).join(best, ["crop_id", "q12"])
    winner = heavy_hitter(inside, ("crop_id", "q12", "top1_ratio"))
    return winner.select("crop_id", "r", "g", "b", color.hex_of().alias("hex"), "top1_ratio", (0.55 + 0.45 * F.col("top1_ratio")).alias("confidence"))


def entries(colours: DataFrame, key: str) -> DataFrame:
    """Ranked colours (rank, r, g, b, ratio) of each crop as one array with
    Oklab values; at most a few dozen entries."""
    l, a, b = color.oklab()
    entry = F.struct("rank", "r", "g", "b", "ratio", l.alias("o1"), a.alias("o2"), b.alias("o3"), F.col(key).alias("key"))
    return colours.groupBy("crop_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def separated(entries_: Column, least: float, k: int) -> Column:
    """Greedy choice in order: an entry stays if it is at least ``least`` away
    in Oklab from all that stayed before, until k have stayed."""

    def far(kept: Column, e: Column) -> Column:
        return F.forall(kept, lambda o: F.round(color.distance((o["o1"], o["o2"], o["o3"]), (e["o1"], e["o2"], e["o3"])), PLACES) >= least)

    empty = F.slice(entries_, 1, 0)
    return F.aggregate(entries_, empty, lambda kept, e: F.when((F.size(kept) < k) & far(kept, e), F.concat(kept, F.array(e))).otherwise(kept))


def q12_palette(hist: DataFrame, k: int = DEFAULT_COLOURS) -> DataFrame:
    """palette(crop_id, rank, r, g, b, weight, q12): representatives of the 3k
    heaviest bins that lie far enough from each other, the first k of them."""
    bins = top(q12(hist), "q12", 3 * k).select("crop_id", "q12", "rank", "ratio")
    seen = hist.withColumn("q12", color.q12()).join(bins, ["crop_id", "q12"])
    colours = representative(seen, ("crop_id", "q12", "rank", "ratio"))
    chosen = entries(colours, "q12").select("crop_id", F.posexplode(separated(F.col("entries"), Q_SEPARATION, k)).alias("at", "e"))
    return chosen.select("crop_id", (F.col("at") + 1).alias("rank"), "e.r", "e.g", "e.b", F.col("e.ratio").alias("weight"), F.col("e.key").alias("q12"))


def nest(palette: DataFrame) -> DataFrame:
    """One row a crop: colours and weights as arrays in the order of rank."""
    e = F.sort_array(F.collect_list(F.struct("rank", "r", "g", "b", "weight")))
    out = palette.groupBy("crop_id").agg(e.alias("e"))
    return out.select("crop_id", F.transform("e", lambda x: F.struct(x["r"].alias("r"), x["g"].alias("g"), x["b"].alias("b"))).alias("palette"), F.transform("e", lambda x: x["weight"]).alias("weights"))
