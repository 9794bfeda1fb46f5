"""Kernels as DataFrame operators: one row a crop in, palette rows out.

A crop's histogram is packed into one row by a partial aggregation; the kernels
then run over Arrow batches of many crops, without a Python group per crop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.functions import color
from chromaloom.operators import kernels
from chromaloom.session import ship

#: name -> (kernel, column that weighs the colours)
KERNELS: dict[str, tuple[Callable, str]] = {
    "pixelero_rgb_hist": (kernels.channel_kmeans, "mass"),
    "hsv_pixelero_kmeans": (kernels.hsv_kmeans, "mass"),
    "pixelero_hsv_cluster": (kernels.channel_hsv, "mass"),
    "octree": (kernels.octree, "mass"),
    "hsv_octree": (kernels.hsv_octree, "mass"),
    "liq_like": (kernels.quantise, "n"),
    "oklab_kmeans": (kernels.oklab_kmeans, "n"),
    "mmcq": (kernels.mmcq, "mass"),
}
PALETTE = "rank int, r int, g int, b int, weight double"


def _rows(crops: list, found: list[kernels.Clusters], kind: pa.DataType) -> pa.RecordBatch:
    n = [len(m) for _, m in found]
    rgb = np.clip(np.rint(np.concatenate([c for c, _ in found])), 0, 255).astype(np.int32)
    share = np.concatenate([m / max(m.sum(), 1e-12) for _, m in found])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.arange(len(crops)), n)).cast(pa.int64()), *[pa.array(a, pa.int32()) for a in (np.concatenate([np.arange(1, i + 1) for i in n]), *rgb.T)], pa.array(share)],
        names=["_crop", "rank", "r", "g", "b", "weight"],
    ).set_column(0, pa.field("crop_id", kind), pa.array([c for c, i in zip(crops, n) for _ in range(i)], kind))


def _run(kernel: Callable, k: int, per_crop: Callable[[dict], tuple]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crops, found = batch.column(0).to_pylist(), []
            offsets = batch.column(1).offsets.to_numpy()
            flat = batch.column(1).values
            columns = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)]
            for lo, hi in zip(offsets, offsets[1:]):
                found.append(kernel(*per_crop([c[lo:hi] for c in columns]), k))
            if crops:
                yield _rows(crops, found, batch.schema.field(0).type)

    return run


def _unpacked(columns: list[np.ndarray]) -> tuple:
    packed, weight = columns
    return np.stack([packed >> 16 & 255, packed >> 8 & 255, packed & 255], axis=1).astype(np.int64), weight.astype(np.float64)


def _placed(columns: list[np.ndarray]) -> tuple:
    _, r, g, b, x, y = columns
    return np.stack([r, g, b], axis=1).astype(np.int64), x.astype(np.int64), y.astype(np.int64)


def cluster(hist: DataFrame, method: str, k: int = 5) -> DataFrame:
    """palette(crop_id, rank, r, g, b, weight) of a kernel; colours are centres
    and need not occur in the crop. Crops without colours have no rows."""
    if method not in KERNELS:
        raise ValueError(f"unknown method {method!r}; one of {sorted(KERNELS)}")
    if not 1 <= k <= 256:
        raise ValueError("a palette has 1 to 256 colours")
    ship(hist.sparkSession)
    kernel, weight = KERNELS[method]
    packed = hist.groupBy("crop_id").agg(F.sort_array(F.collect_list(F.struct("rgb24", F.col(weight).cast("double").alias("w")))).alias("colours"))
    return packed.mapInArrow(_run(kernel, k, _unpacked), f"crop_id {hist.schema['crop_id'].dataType.simpleString()}, {PALETTE}")


def salient(pixels: DataFrame, k: int = 5) -> DataFrame:
    """palette of salient regions; the one kernel that needs places."""
    ship(pixels.sparkSession)
    packed = pixels.groupBy("crop_id").agg(F.sort_array(F.collect_list(F.struct("idx", "r", "g", "b", "x", "y"))).alias("pixels"))
    return packed.mapInArrow(_run(kernels.salient, k, _placed), f"crop_id {pixels.schema['crop_id'].dataType.simpleString()}, {PALETTE}")


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        offsets, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values
        columns = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(2)]
        for lo, hi in zip(offsets, offsets[1:]):
            rgb, mass = _unpacked([c[lo:hi] for c in columns])
            found.append([kernels.channel_centres(rgb[:, c], mass, 8).tolist() for c in range(3)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.list_(pa.float64())))], names=["image_id", "centres"])


def shared_centres(boxes: DataFrame) -> DataFrame:
    """image_id, centres by channel, pooled over all boxes of an image, of
    boxes(image_id, box_index, rgb24, n)."""
    ship(boxes.sparkSession)
    pooled = boxes.groupBy("image_id", "rgb24").agg(F.sum("n").cast("double").alias("w"))
    packed = pooled.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("rgb24", "w"))).alias("c"))
    return packed.mapInArrow(_centres, f"image_id {boxes.schema['image_id'].dataType.simpleString()}, centres array<array<double>>")


def bins_with_centres(boxes: DataFrame, centres: DataFrame) -> DataFrame:
    """Bins of each box by its image's centres(image_id, centres): key, mass and
    mean colour. Given centres, all in expressions."""
    met = boxes.join(centres, "image_id")
    rgb = color.unpack("rgb24")

    def near(value, at: int):
        d = F.transform(F.element_at("centres", at + 1), lambda c, i: F.struct(F.abs(value - c).alias("d"), i.alias("i")))
        return F.array_min(d)["i"]

    keyed = met.withColumn("bin", (near(rgb[0], 0) * 64 + near(rgb[1], 1) * 8 + near(rgb[2], 2)).cast("int"))
    mean = lambda c, name: (F.sum(c * F.col("n")) / F.sum("n")).alias(name)
    return keyed.groupBy("image_id", "box_index", "bin").agg(F.sum("n").alias("n"), mean(rgb[0], "r"), mean(rgb[1], "g"), mean(rgb[2], "b"))
