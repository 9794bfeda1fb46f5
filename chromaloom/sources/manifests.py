"""Manifests of boxes and source images, checkpoints in JSON lines, crop geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Anchors of the crop variants: where the centre lies in width and height.
ANCHORS = {"top_left": (0.08, 0.08), "center": (0.5, 0.5), "bottom_right": (0.92, 0.92)}
SIDE, LEAST_SIDE, LEAST_BOX = 0.48, 64, 48
_RECORD = "struct<path:string,bboxes_xyxy:array<array<int>>>"


def roi_boxes(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """path, box_index, l, t, r, b of a JSON manifest: an object with ``records``
    or a bare list. The index is the place in the manifest."""
    text = spark.read.text(path, wholetext=True)
    whole = F.from_json("value", f"struct<records:array<{_RECORD}>>")["records"]
    bare = F.from_json("value", f"array<{_RECORD}>")
    records = text.select(F.explode(F.when(F.ltrim("value").startswith("["), bare).otherwise(whole)).alias("rec"))
    where = F.concat_ws("/", F.lit(root.rstrip("/")), F.col("rec.path")) if root else F.col("rec.path")
    box = records.select(where.alias("path"), F.posexplode("rec.bboxes_xyxy").alias("box_index", "box"))
    return box.select("path", "box_index", *(F.element_at("box", i + 1).alias(c) for i, c in enumerate("ltrb")))


def source_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, batch, variant of a JSON manifest {samples: [...]}: without a batch
    it is unknown, without a variant all anchors are taken."""
    read = spark.read.schema("samples array<struct<file:string,batch:string,variant:string>>").json(path, multiLine=True)
    s = read.select(F.explode("samples").alias("s")).select("s.*")
    every = F.array(*map(F.lit, ANCHORS))
    variants = F.when(F.coalesce(F.length("variant"), F.lit(0)) > 0, F.array("variant")).otherwise(every)
    return s.select("file", F.coalesce("batch", F.lit("unknown")).alias("batch"), F.explode(variants).alias("variant"))


def source_files(paths: DataFrame) -> DataFrame:
    """The same of paths(path): JPEG files, the batch being the start of the name
    up to "_" without a leading b."""
    stem = F.regexp_extract("path", r"([^/]+)\.jpg$", 1)
    named = paths.select(F.col("path").alias("file"), stem.alias("stem")).filter("stem != ''")
    batch = F.regexp_replace(F.element_at(F.split("stem", "_"), 1), "^b", "")
    return named.select("file", batch.alias("batch"), F.explode(F.array(*map(F.lit, ANCHORS))).alias("variant"))


def crop_geometry(crops: DataFrame) -> DataFrame:
    """``crops`` (variant, width, height, ...) with side, left and top."""
    where = F.create_map(*(x for k, (ax, ay) in ANCHORS.items() for x in (F.lit(k), F.array(F.lit(ax), F.lit(ay)))))
    side = F.greatest(F.lit(LEAST_SIDE), F.rint(F.least("width", "height") * SIDE).cast("int"))
    placed = crops.withColumn("_at", F.element_at(where, F.col("variant"))).withColumn("side", side)
    start = lambda i, size: F.rint(F.greatest(F.lit(0.0), F.least(F.element_at("_at", i) * F.col(size) - F.col("side") / 2, F.col(size) - F.col("side")))).cast("int")
    return placed.withColumn("left", start(1, "width")).withColumn("top", start(2, "height")).drop("_at")


def hashed_boxes(images: DataFrame, count: int = 20) -> DataFrame:
    """``count`` object-like boxes for each of images(path, width, height), by
    hashes of path and number: area log-uniform from 1.5 to 32 percent, aspect
    from 0.45 to 2.2, sides of 48 pixels at least."""
    if count < 1:
        raise ValueError("at least one box")
    draw = lambda n: (F.pmod(F.xxhash64("path", "box_index", F.lit(n)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    log_between = lambda n, lo, hi: F.exp(F.log(F.lit(lo)) + draw(n) * (F.log(F.lit(hi)) - F.log(F.lit(lo))))
    each = images.withColumn("box_index", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    each = each.withColumn("_area", F.col("width") * F.col("height") * log_between(1, 0.015, 0.32)).withColumn("_aspect", log_between(2, 0.45, 2.2))
    fit = lambda x, size: F.greatest(F.least(F.lit(LEAST_BOX), F.col(size)), F.least(F.col(size), F.rint(F.sqrt(x)).cast("int")))
    each = each.withColumn("_w", fit(F.col("_area") * F.col("_aspect"), "width")).withColumn("_h", fit(F.col("_area") / F.col("_aspect"), "height"))
    each = each.withColumn("l", F.floor(draw(3) * (F.col("width") - F.col("_w") + 1)).cast("int")).withColumn("t", F.floor(draw(4) * (F.col("height") - F.col("_h") + 1)).cast("int"))
    return each.select("path", "box_index", "l", "t", (F.col("l") + F.col("_w")).alias("r"), (F.col("t") + F.col("_h")).alias("b"), "width", "height")


def checkpoint_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON-lines checkpoint. An append that was cut short may leave
    the last line of the file broken; any other broken line is an error."""
    wanted = T.StructType([*T.DataType.fromDDL(schema).fields]) if isinstance(schema, str) else schema
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at")).filter("trim(value) != ''")
    parsed = lines.withColumn("row", F.from_json("value", T.StructType([*wanted.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"}))
    broken = parsed.filter("row._bad is not null").agg(F.count("*").alias("n"), F.max("at").alias("at")).first()
    last = lines.agg(F.max("at")).first()[0]
    if broken["n"] > 1 or (broken["n"] == 1 and broken["at"] != last):
        raise ValueError(f"{path} has a broken line before its end")
    return parsed.filter("row._bad is null").select(*(F.col(f"row.{f.name}").alias(f.name) for f in wanted.fields))
