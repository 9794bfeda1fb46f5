"""Command line: annotate images, box palettes, capacity plans."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from chromaloom.operators import adaptive, histogram, methods, roi, summary
from chromaloom.sources import images, manifests
from chromaloom.sources.scene import visible


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chromaloom")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("annotate", help="dominant colour and palette of every image below a path")
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("--method", default="adaptive_v1", choices=sorted(methods.METHODS))
    b = sub.add_parser("boxes", help="palettes of the boxes of a manifest")
    b.add_argument("images")
    b.add_argument("manifest")
    b.add_argument("output")
    b.add_argument("--method", default="libimagequant", choices=sorted(roi.METHODS))
    b.add_argument("--colours", type=int, default=5)
    c = sub.add_parser("capacity", help="crop rates and workers by completion window")
    c.add_argument("--crops", type=int, default=summary.TARGET_CROPS)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("chromaloom").getOrCreate()
    if args.command == "capacity":
        summary.capacity(spark, args.crops).orderBy("days").show(truncate=False)
    elif args.command == "annotate":
        pixels = images.to_pixels(images.read_images(spark, args.input))
        if args.method == "adaptive_v1":
            seen = visible(pixels)
            out = summary.compact(adaptive.adaptive(pixels, seen, histogram.exact(seen)), args.method)
        else:
            out = histogram.nest(methods.extract(pixels, args.method))
        out.write.json(args.output)
    else:
        read = images.read_images(spark, args.images)
        pixels = images.to_pixels(read).withColumnRenamed("crop_id", "path")
        size = read.selectExpr("crop_id as path", "width", "height")
        boxes = manifests.roi_boxes(spark, args.manifest).join(size, "path")
        roi.nested(roi.box_palettes(pixels, boxes, args.method, args.colours)).write.json(args.output)


if __name__ == "__main__":
    main()
