"""Images as pixels, through Spark's image source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.session import ship

SUFFIXES = ("avif", "bmp", "gif", "jpeg", "jpg", "png", "tif", "tiff", "webp")
#: Rows of pixels that a kernel sends at once.
SLICE = 65_536
_PIXELS = "crop_id string, idx int, x int, y int, r int, g int, b int, a int"


def expand_inputs(paths: DataFrame) -> DataFrame:
    """Distinct image paths of paths(path), in order, by suffix in any case."""
    named = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return paths.select("path").filter(named.isin(*SUFFIXES)).distinct().orderBy("path")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """crop_id, width, height, channels, data, color_managed of all images below
    ``path``. What can't be decoded is left out. Colour profiles and EXIF
    orientation are not applied: color_managed is false."""
    read = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    i = "image."
    return read.select(
        F.col(i + "origin").alias("crop_id"), F.col(i + "width").alias("width"), F.col(i + "height").alias("height"),
        F.col(i + "nChannels").alias("channels"), F.col(i + "data").alias("data"), F.lit(False).alias("color_managed"),
    )


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            crop, w, h, n, data = (batch.column(c)[row].as_py() for c in ("crop_id", "width", "height", "channels", "data"))
            raw = np.frombuffer(data, np.uint8).reshape(-1, n)
            # stored blue first; one channel is grey, a fourth is alpha
            rgb = raw[:, [2, 1, 0]] if n >= 3 else np.repeat(raw[:, :1], 3, axis=1)
            alpha = raw[:, 3] if n == 4 else np.full(w * h, 255, np.uint8)
            for at in range(0, w * h, SLICE):
                idx = np.arange(at, min(at + SLICE, w * h), dtype=np.int32)
                part = [pa.array([crop] * len(idx), pa.string()), pa.array(idx), pa.array((idx % w).astype(np.int32)), pa.array((idx // w).astype(np.int32))]
                part += [pa.array(rgb[idx, c].astype(np.int32)) for c in range(3)] + [pa.array(alpha[idx].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(part, names=["crop_id", "idx", "x", "y", "r", "g", "b", "a"])


def to_pixels(images: DataFrame) -> DataFrame:
    """pixels(crop_id, idx, x, y, r, g, b, a) of ``read_images``."""
    ship(images.sparkSession)
    return images.select("crop_id", "width", "height", "channels", "data").mapInArrow(_expand, _PIXELS)
