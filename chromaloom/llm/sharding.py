"""Shuffled shards by a two-pass external shuffle, in DataFrame operations alone.

Pass one scatters the records by seeded hashes: the key alone decides the shard
(rendezvous hashing, so one more shard only takes rows for itself), a second
hash of key and text the bucket within the shard, whose number follows the
shard's bytes so that a bucket fits in memory. Pass two shuffles each bucket by
Fisher-Yates (the SQL function ``shuffle``) and writes it; the buckets of a shard
one after another are a uniform random order of its rows.

The seed decides every slot, whatever the input's files and the session's
partitions: each bucket starts from one order of its rows, and buckets are dealt
over as many partitions as there are buckets. Equal copies of a row that overfill
a bucket are counted, numbered and dealt over parts of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chromaloom.llm.common import new_path, stage, table

SHARDS, SEED, BUCKET_BYTES = 24, 20_240_501, 8 << 20
#: A bucket is split from so many times its bytes; copies that one row makes; split buckets that are broadcast at most.
OVERFULL, COPIES, MAX_BROADCAST = 4, 1000, 10_000


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the highest hash of (key, shard, seed)."""
    drawn = [F.struct(F.xxhash64(key, F.lit(i), F.lit(seed)).alias("draw"), F.lit(i).alias("shard")) for i in range(shards)]
    return F.array_max(F.array(*drawn))["shard"]


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, and 8 for the id."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def write_shards(
    spark: SparkSession, docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> None:
    """Writes below ``path`` the rows, as Parquet folders ``shard=N`` with the
    columns bucket, at (place in the bucket) and record (all columns of ``docs``,
    so no name can clash), and an index of the buckets' first slots.

    Law ``key``: doc_id and the number of shards decide a row's shard; rows
    without an id share one. Slots count from 0 without gaps in each shard.
    Repeated rows each get a slot. Null and empty texts count 8 bytes. An empty
    table writes no row. Columns must be comparable (no maps).
    """
    h = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed + 1))
    sized = docs.select(F.struct(*docs.columns).alias("record"), shard_of(F.col("doc_id"), shards, seed).alias("shard"), size_of(F.col("text")).alias("size"), h.alias("h"))
    # one row a shard
    held = {r["shard"]: r["bytes"] for r in sized.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    buckets = [max(1, math.ceil(held.get(i, 0) / bucket_bytes)) for i in range(shards)]
    number = F.element_at(F.array(*map(F.lit, buckets)), F.col("shard") + 1)
    scattered = sized.withColumn("bucket", F.pmod("h", number).cast("int"))
    scattered, more = _parted(spark, scattered, bucket_bytes)

    key = ["shard", "bucket", "part"]
    dealt = scattered.repartition(sum(buckets) + more, *key)
    gathered = dealt.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("h", "copy", "record"))).alias("rows"))
    # the function's seed goes with the partition and the place in it: both are the same in every run
    shuffled = gathered.sortWithinPartitions(*key).select(*key, F.shuffle("rows", F.lit(seed + 2)).alias("rows"))
    spread = shuffled.select(*key, F.posexplode("rows").alias("at", "row"))
    spread.select(*key, "at", "row.record").write.partitionBy("shard").parquet(f"{path}/rows")

    # the first slot of each bucket: the written rows of the earlier buckets of its shard
    counted = _rows(spark, path, docs).groupBy(*key).count()
    earlier = Window.partitionBy("shard").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    counted.select(*key, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("first")).write.parquet(f"{path}/index")


def _parted(spark: SparkSession, rows: DataFrame, bucket_bytes: int) -> tuple[DataFrame, int]:
    """``rows`` with part (of the bucket) and copy, and the number of parts that
    come on top of the buckets.

    Only copies of a row or very long texts overfill a bucket. Rows of such a
    bucket are counted by value, on the map side first; each value then makes
    its copies anew, numbered from 0, in blocks that any task can make, and a
    hash of number and row deals them over the parts.
    """
    zero = F.lit(0).cast("long")
    sums = rows.groupBy("shard", "bucket").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > OVERFULL * bucket_bytes)
    full = stage(spark, sums.select(F.col("shard").alias("_shard"), F.col("bucket").alias("_bucket"), F.ceil(F.col("bytes") / bucket_bytes).cast("int").alias("_parts")), "overfull")
    n, more = full.agg(F.count("*"), F.coalesce(F.sum("_parts"), F.lit(0))).first()
    # no literal: grouping by one would not see that the rows are dealt by it, and shuffle again
    whole = rows.withColumn("part", F.pmod("bucket", F.lit(1))).withColumn("copy", zero)
    columns = ["shard", "bucket", "part", "copy", "h", "record"]
    if not n:
        return whole.select(columns), 0
    met = (F.col("shard") == F.col("_shard")) & (F.col("bucket") == F.col("_bucket"))
    side = F.broadcast(full) if n <= MAX_BROADCAST else full
    values = rows.join(side, met).groupBy("shard", "bucket", "_parts", "h", "record").agg(F.count("*").alias("n"))
    blocks = values.withColumn("block", F.explode(F.sequence(zero, F.floor((F.col("n") - 1) / COPIES)))).repartition("shard", "bucket", "h", "block")
    last = F.least(F.col("n"), (F.col("block") + 1) * COPIES) - 1
    copies = blocks.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES, last)))
    copies = copies.withColumn("part", F.pmod(F.xxhash64("h", "copy"), F.col("_parts")).cast("int"))
    return whole.join(side, met, "left_anti").select(columns).unionByName(copies.select(columns)), int(more)


def _rows(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    record = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("record", docs.schema), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(record).parquet(f"{path}/rows")


def read_shards(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """shard, slot and record of what ``write_shards`` has written."""
    index = spark.read.schema("shard int, bucket int, part int, first long").parquet(f"{path}/index")
    met = _rows(spark, path, docs).join(index, ["shard", "bucket", "part"])
    return met.select("shard", (F.col("first") + F.col("at")).alias("slot"), "record")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = new_path(spark, "shards")
    write_shards(spark, docs, path)
    rows = read_shards(spark, path, docs)
    return rows.select(
        F.col("record.doc_id").alias("doc_id"),
        size_of(F.col("record.text")).alias("size"),
        F.crc32(F.coalesce(F.col("record.text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        shard_of(F.col("record.doc_id"), SHARDS + 1).alias("grown_shard"),
    )
