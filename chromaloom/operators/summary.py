"""Method summaries over observations, capacity planning, browsing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The planning target and the model of its sources.
TARGET_CROPS, SOURCE_IMAGES, SOURCE_MPIX, SOURCE_MB, WORKER_GPIX_S, SAFETY = 100_000_000_000, 5_000_000_000, 1.0, 0.5, 0.5, 1.5
DAYS = (3, 7, 15)
TINY = 1e-12
#: Compact ids of the methods.
METHOD_IDS = {
    "adaptive_v1": 1, "tencent_hsv": 2, "pixelero_rgb_hist": 3, "octree": 4, "pngquant_liq": 5, "colorpipette_inspired": 6,
    "tencent_hsv_weighted_observed": 7, "pixelero_weighted_observed": 8, "octree_weighted_observed": 9, "hsv_bins_pixelero_kmeans": 10,
    "pixelero_bins_hsv_clustering": 11, "hsv_bins_octree_quantization": 12, "hsv_pixelero_weighted_observed": 13,
    "pixelero_hsv_weighted_observed": 14, "hsv_octree_weighted_observed": 15,
}


def _at_least(x: Column) -> Column:
    return F.greatest(x, F.lit(TINY))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observations derived from ``events``: method = event_type, elapsed = value;
    the other measures are closed forms of these, so that results repeat."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.col("value")
    return e.select(
        F.col("user_id").alias("crop_id"), "event_id", F.col("event_type").alias("method"), ms.alias("elapsed_ms"),
        (ms * 0.25).alias("decode_ms"), (ms * 0.75).alias("method_ms"), (F.col("user_id") % 400 + 100).alias("pixels"),
        F.element_at(F.array(*map(F.lit, ("flat", "mild", "gradient", "texture"))), (F.col("event_id") % 4 + 1).cast("int")).alias("route"),
        (F.col("event_id") % 10 != 0).alias("observed"), (F.col("event_id") % 97 / 10.0).alias("coverage"),
        (F.col("event_id") % 53 / 10.0).alias("jpeg60"), (F.col("event_id") % 31 / 10.0).alias("resize50"),
        F.concat(F.lit("b"), (F.col("user_id") % 12).cast("string")).alias("batch"),
    )


def percentiles(column: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> list[Column]:
    """Exact, interpolated linearly."""
    return [F.percentile(column, p).alias(f"{column}_p{round(p * 100)}") for p in at]


def rates(obs: DataFrame) -> DataFrame:
    """Per-row rates with a floor under the times."""
    return obs.withColumns(
        {"mpix_s": F.col("pixels") / 1e6 / _at_least(F.col("method_ms") / 1000), "crops_s": 1.0 / _at_least(F.col("elapsed_ms") / 1000)}
    )


def summarize(obs: DataFrame, provisioned: float) -> DataFrame:
    """One row a method: latency, throughput, quality, observed rate."""
    seconds = _at_least(F.sum("elapsed_ms") / 1000)
    half = F.when(F.count("*") < 2, 0.0).otherwise(1.96 * F.stddev_samp("elapsed_ms") / F.sqrt(F.count("*")))
    crops_s = F.count("*") / seconds
    r = F.round
    return obs.groupBy("method").agg(
        F.count("*").alias("samples"),
        *(r(F.percentile("elapsed_ms", p), 4).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))),
        r(F.avg("elapsed_ms"), 4).alias("mean"),
        r(F.avg("elapsed_ms") - half, 4).alias("ci95_low"),
        r(F.avg("elapsed_ms") + half, 4).alias("ci95_high"),
        r(F.avg("decode_ms"), 4).alias("decode_mean"),
        r(F.avg("method_ms"), 4).alias("method_mean"),
        r(crops_s, 3).alias("crops_s"),
        r(F.sum("pixels") / 1e6 / _at_least(F.sum("method_ms") / 1000), 3).alias("mpix_s"),
        F.ceil(F.lit(provisioned) / _at_least(crops_s)).cast("long").alias("processes"),
        r(1e9 / _at_least(crops_s) / 3600.0, 2).alias("worker_hours_per_1b"),
        r(F.avg("coverage"), 4).alias("coverage_mean"),
        r(F.avg("jpeg60"), 4).alias("jpeg60_mean"),
        r(F.percentile("jpeg60", 0.95), 4).alias("jpeg60_p95"),
        r(F.avg("resize50"), 4).alias("resize50_mean"),
        r(F.percentile("resize50", 0.95), 4).alias("resize50_p95"),
        r(F.avg(F.col("observed").cast("double")), 4).alias("observed_rate"),
    )


def route_share(obs: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    n = obs.groupBy("method", "route").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("method")))


def route_counts(obs: DataFrame) -> DataFrame:
    """method, route_counts: a map in the order of its keys."""
    n = obs.groupBy("method", "route").agg(F.count("*").alias("n"))
    return n.groupBy("method").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("route", "n")))).alias("route_counts"))


def capacity_target(crops: int, days: float, safety: float = SAFETY) -> tuple[float, float]:
    """(required, provisioned) crops a second."""
    if crops <= 0 or days <= 0 or safety < 1:
        raise ValueError("crops and days must be positive and the safety factor at least 1")
    required = crops / (days * 86400)
    return required, required * safety


def capacity(spark: SparkSession, crops: int = TARGET_CROPS, images: int = SOURCE_IMAGES, days: tuple[int, ...] = DAYS) -> DataFrame:
    """One row a completion window: crop rates, and what decoding each source
    image once takes."""
    for d in days:
        capacity_target(crops, d)
    if images <= 0:
        raise ValueError("the number of images must be positive")
    window = spark.createDataFrame([(d,) for d in days], "days int")
    seconds = F.col("days") * 86400.0
    gpix = F.lit(float(images)) * SOURCE_MPIX / seconds / 1000
    return window.select(
        "days",
        (F.lit(float(crops)) / seconds).alias("required_crops_s"),
        (F.lit(float(crops)) / seconds * SAFETY).alias("provisioned_crops_s"),
        (F.lit(float(images)) / seconds).alias("images_s"),
        F.lit(crops / images).alias("crops_per_image"),
        gpix.alias("gpix_s"),
        (F.lit(float(images)) / seconds * SOURCE_MB / 1000).alias("compressed_gb_s"),
        (gpix * 3).alias("decoded_gb_s"),
        F.ceil(gpix / WORKER_GPIX_S * SAFETY).cast("long").alias("fused_workers"),
    )


def scenarios(plan: DataFrame, crop_rates: DataFrame) -> DataFrame:
    """Processes by window and method: a product of a handful of windows with one
    row a method."""
    need = F.ceil(F.col("provisioned_crops_s") / _at_least(F.col("crops_s"))).cast("long")
    return plan.crossJoin(F.broadcast(crop_rates)).select("days", "method", need.alias("processes"))


def rates_of(spark: SparkSession, rates_: Mapping[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in rates_.items()], "method string, crops_s double")


def audit_projection(audits: DataFrame, provisioned: float) -> DataFrame:
    """``audits`` (inference_seconds, ...) with what such a run means for the
    plan: crops a second, processes, and worker hours for a thousand million."""
    rate = 1.0 / _at_least(F.col("inference_seconds"))
    return audits.withColumns({"crops_s": F.round(rate, 6), "processes": F.ceil(F.lit(provisioned) / rate).cast("long"), "hours_1b": F.round(1e9 / rate / 3600, 2)})


def with_audit(methods: DataFrame, audit: DataFrame, name: str) -> DataFrame:
    """Rows of methods and, below them, that of an audited tool; what only one
    side has is null on the other."""
    below = audit.withColumns({"method": F.lit(name), "is_audit": F.lit(True)})
    return methods.withColumn("is_audit", F.lit(False)).unionByName(below, allowMissingColumns=True)


def browse_index(obs: DataFrame) -> DataFrame:
    """One row a crop: its batch, its slowest time, and each method's last
    observation as a map."""
    last = obs.groupBy("crop_id", "batch", "method").agg(F.max(F.struct("event_id", "elapsed_ms", "route", "coverage")).alias("o"))
    entry = F.struct("method", F.struct("o.elapsed_ms", "o.route", "o.coverage").alias("detail"))
    return last.groupBy("crop_id", "batch").agg(
        F.count("*").alias("methods"), F.max("o.elapsed_ms").alias("slowest_ms"), F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("detail")
    )


def page(rows: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """Page ``number`` (from 0) of a total order. Each task keeps the rows of the
    first pages alone."""
    if size < 1 or number < 0:
        raise ValueError("a page has at least one row and a number from 0")
    return rows.orderBy(*order).limit(size * (number + 1)).orderBy(*order).offset(size * number)


def remaining(crops: DataFrame, done: DataFrame) -> DataFrame:
    """Crops without a result yet: what a resumed run has to do."""
    return crops.join(done.select("crop_id").distinct(), "crop_id", "left_anti")


def record(results: DataFrame, method: str) -> DataFrame:
    """Whole results, ready for JSON: colours as triples and in hex, numbers
    rounded to six places, diagnostics as a map. Without palette the primary
    colour is the palette."""
    from chromaloom.functions import color

    p = ("primary.r", "primary.g", "primary.b")
    triple = lambda c: F.array(c["r"], c["g"], c["b"])
    colours = F.when(F.size("palette") > 0, F.col("palette")).otherwise(F.array("primary"))
    known = ("crop_id", "route", "primary", "palette", "weights", "confidence", "observed")
    measures = [x for c in results.columns if c not in known for x in (F.lit(c), F.round(F.col(c).cast("double"), 6))]
    return results.select(
        "crop_id", F.lit(method).alias("method"), triple(F.col("primary")).alias("primary_rgb"), color.rgb24(p).alias("rgb24"), color.hex_of(p).alias("hex"),
        F.transform(colours, triple).alias("palette_rgb"), F.transform(colours, lambda c: color.hex_of((c["r"], c["g"], c["b"]))).alias("palette_hex"),
        F.transform("weights", lambda w: F.round(w, 6)).alias("weights"), F.round("confidence", 6).alias("confidence"), "route", "observed", F.create_map(*measures).alias("diagnostics"),
    )


def compact(results: DataFrame, method: str) -> DataFrame:
    """Compact annotations, schema version 1, of adaptive-like results."""
    from chromaloom.functions import color

    p = ("primary.r", "primary.g", "primary.b")
    packed = F.transform("palette", lambda c: (c["r"] * 65536 + c["g"] * 256 + c["b"]).cast("int"))
    return results.select(
        F.lit(1).alias("schema_version"), F.col("crop_id").alias("id"), color.rgb24(p).alias("rgb24"), color.hex_of(p).alias("hex"),
        F.lit(METHOD_IDS[method]).alias("method_id"), F.lit(method).alias("method"), "route", F.round("confidence", 6).alias("confidence"),
        packed.alias("palette_rgb24"), F.transform("weights", color.weight_u16).alias("palette_weight_u16"), "observed",
    )
