"""Pixel relations: pixels(crop_id, idx, x, y, r, g, b, a) and what is valid of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Alpha from which a pixel is visible.
VISIBLE = 8
PIXELS = ["crop_id", "idx", "x", "y", "r", "g", "b", "a"]
WIDTH = 25


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic pixel relation made from ``lineitem``: one crop for each
    supplier, by crop_id mod 4 flat, mild, a horizontal ramp or texture."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    idx = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)) - 1
    s = li.select(F.col("l_suppkey").cast("int").alias("crop_id"), idx.alias("idx"), "l_partkey", "l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    crop, x = F.col("crop_id"), F.col("idx") % WIDTH
    q = F.floor("l_quantity").cast("int")
    d, t = F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int")
    noise = F.col("idx") % 16 == 0

    def band(flat: tuple, mild: tuple, ramp: tuple, texture: Column) -> Column:
        kind = crop % 4
        return (
            F.when(kind == 0, F.when(noise, flat[0]).otherwise((crop * flat[1]) % 256))
            .when(kind == 1, mild[0] + (crop * mild[1]) % mild[2] + mild[3])
            .when(kind == 2, ramp[0] + x * ramp[1])
            .otherwise(texture)
            .cast("int")
        )

    pk, ok = F.col("l_partkey"), F.col("l_orderkey")
    return s.select(
        "crop_id", "idx", x.alias("x"), F.floor(F.col("idx") / WIDTH).cast("int").alias("y"),
        band((pk % 256, 37), (60, 7, 120, pk % 7), (20, 9), F.floor(q / 10).cast("int") * 50).alias("r"),
        band((ok % 256, 73), (80, 5, 100, ok % 7), (50, 5), d * 25).alias("g"),
        band(((q * 5) % 256, 151), (90, 3, 100, q % 7), (170, -5), t * 31).alias("b"),
        F.when((F.col("l_returnflag") == "R") & (crop % 5 == 0), 0).when(F.col("l_returnflag") == "A", 128).otherwise(255).alias("a"),
    )


def synthetic_cases(spark: SparkSession, side: int = 256) -> DataFrame:
    """Five closed-form images with known answers, as pixels with case_id for crop_id."""
    i = spark.range(side * side).select(F.col("id").cast("int").alias("idx"))
    i = i.select("idx", (F.col("idx") % side).alias("x"), F.floor(F.col("idx") / side).cast("int").alias("y"))
    x, y = F.col("x"), F.col("y")
    along = x / F.lit(side - 1.0)
    checker = (F.floor(x / 16) + F.floor(y / 16)) % 4
    inside = x.between(side // 8, side - side // 8 - 1) & y.between(side // 8, side - side // 8 - 1)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (checker + 1).cast("int"))
    # The cases' colours.
    cases = {
        "solid": [F.lit(210), F.lit(74), F.lit(67), F.lit(255)],
        "linear_gradient": [*(F.floor(a * (1 - along) + b * along) for a, b in ((25, 241), (71, 176), (164, 55))), F.lit(255)],
        "four_color_texture": [pick((24, 229, 238, 49)), pick((63, 111, 202, 132)), pick((92, 65, 104, 109)), F.lit(255)],
        "transparent_fill": [F.when(inside, v).otherwise(o) for v, o in ((92, 255), (211, 0), (142, 255), (255, 0))],
        "gray_gradient": [*[F.floor(28 + x * 194 / F.lit(side - 1.0))] * 3, F.lit(255)],
    }
    frames = [i.select(F.lit(k).alias("crop_id"), "idx", "x", "y", *(c.cast("int").alias(n) for c, n in zip(v, "rgba"))) for k, v in cases.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def visible(pixels: DataFrame) -> DataFrame:
    """Pixels that count, with weight w: those of alpha >= 8 by alpha; where a
    crop has none, all of them with weight 1. The test for that is an aggregate
    that meets its crop again, so no crop's pixels gather in one task."""
    seen = pixels.groupBy("crop_id").agg(F.max(F.col("a") >= VISIBLE).alias("any_visible"))
    met = pixels.join(seen, "crop_id")
    weight = F.when(F.col("any_visible"), (F.col("a") / F.lit(255.0)).cast("float").cast("double")).otherwise(1.0)
    return met.filter((F.col("a") >= VISIBLE) | ~F.col("any_visible")).select(*PIXELS, weight.alias("w"))
