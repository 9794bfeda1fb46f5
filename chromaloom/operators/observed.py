"""Observed-colour recovery: palette colours that occur in the crop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chromaloom.functions import color
from chromaloom.operators.histogram import PLACES, stable

NEIGHBOURS, LEAST_RATIO = 64, 0.01


def pruned(palette: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """palette(crop_id, rank, r, g, b, weight) without clusters below ``least`` of
    the crop's weight; the largest one stays where all are below."""
    w = Window.partitionBy("crop_id")
    ratio = F.col("weight") / F.greatest(F.sum("weight").over(w), F.lit(1e-12))
    first = F.row_number().over(w.orderBy(stable("weight").desc(), "rank"))
    out = palette.withColumns({"ratio": ratio, "_first": first}).withColumn("_best", F.max(F.round("ratio", PLACES)).over(w))
    return out.filter((F.round("ratio", PLACES) >= least) | ((F.col("_best") < least) & (F.col("_first") == 1))).drop("_first", "_best")


def _scored(palette: DataFrame, hist: DataFrame, count: str) -> DataFrame:
    """Every palette colour against every distinct colour of its crop."""
    most = hist.groupBy("crop_id").agg(F.max(count).alias("most"))
    l, a, b = color.oklab()
    seen = hist.select("crop_id", "rgb24", F.col(count).alias("seen"), l.alias("L"), a.alias("A"), b.alias("B"))
    pl, pa, pb = color.oklab(("r", "g", "b"))
    want = palette.select("crop_id", "rank", "weight", pl.alias("pL"), pa.alias("pA"), pb.alias("pB"))
    met = seen.join(most, "crop_id").join(want, "crop_id")
    d = color.distance(("L", "A", "B"), ("pL", "pA", "pB"))
    return met.select("crop_id", "rank", "weight", "rgb24", F.round(d, PLACES).alias("d"), F.round(d / (0.25 + 0.75 * F.sqrt(F.col("seen") / F.col("most"))), PLACES).alias("score"))


def _picked(best: DataFrame, k: int, reuse: bool) -> DataFrame:
    """In the order of rank, each palette colour takes its best free candidate.

    Earlier colours can take k-1 at most, so k candidates a colour are enough
    and a crop's array has no more than k*k entries."""
    w = Window.partitionBy("crop_id", "rank").orderBy("score", "rgb24")
    few = best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    row = F.struct("place", "rgb24")
    each = few.groupBy("crop_id", "rank").agg(F.sort_array(F.collect_list(row)).alias("c"), F.first("weight").alias("weight"))
    crop = each.groupBy("crop_id").agg(F.sort_array(F.collect_list(F.struct("rank", "weight", "c"))).alias("wants"))

    def step(taken: Column, want: Column) -> Column:
        free = F.filter(want["c"], lambda c: ~F.exists(taken, lambda t: t["rgb24"] == c["rgb24"]))
        pick = lambda c: F.array(F.struct(want["rank"].alias("rank"), want["weight"].alias("weight"), c["rgb24"].alias("rgb24")))
        none = F.concat(taken, pick(F.get(want["c"], F.lit(0)))) if reuse else taken
        return F.when(F.size(free) > 0, F.concat(taken, pick(F.get(free, F.lit(0))))).otherwise(none)

    empty = F.array().cast("array<struct<rank:int,weight:double,rgb24:int>>")
    out = crop.select("crop_id", F.explode(F.aggregate("wants", empty, step)).alias("p"))
    r, g, b = color.unpack("p.rgb24")
    return out.select("crop_id", "p.rank", r.alias("r"), g.alias("g"), b.alias("b"), "p.weight")


def remap_all(palette: DataFrame, hist: DataFrame, k: int = 5) -> DataFrame:
    """The palette with each colour replaced by an observed one that is near and
    frequent; a colour serves once while others are left."""
    return _picked(_scored(palette, hist, "mass"), k, reuse=True)


def remap_nearest(palette: DataFrame, hist: DataFrame, k: int = 5, neighbours: int = NEIGHBOURS, prune: bool = True) -> DataFrame:
    """The same among the ``neighbours`` nearest colours, by counts; without free
    candidate a colour is left out. Small clusters are pruned before the picks,
    or not at all: then they take their picks, and ``pruned`` may follow."""
    near = Window.partitionBy("crop_id", "rank").orderBy("d", "rgb24")
    scored = _scored(pruned(palette) if prune else palette, hist, "n").withColumn("_near", F.row_number().over(near)).filter(F.col("_near") <= neighbours)
    return _picked(scored, k, reuse=False)


def nearest(palette: DataFrame, hist: DataFrame) -> DataFrame:
    """Plainly the nearest observed colour; doubles go to the first rank."""
    best = _scored(palette, hist, "n").groupBy("crop_id", "rank").agg(F.min(F.struct("d", "rgb24", "weight")).alias("m"))
    first = best.groupBy("crop_id", F.col("m.rgb24").alias("rgb24")).agg(F.min("rank").alias("rank"), F.sum("m.weight").alias("weight"))
    r, g, b = color.unpack("rgb24")
    return first.select("crop_id", "rank", r.alias("r"), g.alias("g"), b.alias("b"), "weight")


def unobserved(palette: DataFrame, hist: DataFrame) -> DataFrame:
    """Palette colours that don't occur in their crop."""
    return palette.join(hist.select("crop_id", "r", "g", "b"), ["crop_id", "r", "g", "b"], "left_anti")
