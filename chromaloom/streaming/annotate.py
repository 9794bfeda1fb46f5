"""Resumable annotation: new pixel files in, compact annotations out.

A file holds whole crops, so each micro-batch is complete by itself and no state
or watermark is needed. With ``availableNow`` a run takes what is there and ends;
the checkpoint makes the next run go on where it ended, and the batch number in
the output path makes a repeated batch replace itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from chromaloom.operators import adaptive, histogram, summary
from chromaloom.sources.scene import visible

SCHEMA = "crop_id string, idx int, x int, y int, r int, g int, b int, a int"


def annotate(pixels: DataFrame) -> DataFrame:
    seen = visible(pixels)
    return summary.compact(adaptive.adaptive(pixels, seen, histogram.exact(seen)), "adaptive_v1")


def run(spark: SparkSession, source: str, sink: str, checkpoint: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Annotates the Parquet files below ``source`` that no earlier run has seen."""

    def write(batch: DataFrame, number: int) -> None:
        annotate(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return read.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
