"""What the training-data operators share: tables, the shared folder, staging."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaloom.session import ship

#: Rows of an Arrow batch where rows hold whole texts.
BATCH_ROWS = 1000

_MADE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder below ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, a laptop) a temporary folder is
    made, which is right in local mode alone.
    """
    ship(spark)
    sc = spark.sparkContext
    if sc.applicationId not in _MADE:
        root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="chromaloom-")
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
        _MADE[sc.applicationId] = f"{root.rstrip('/')}/chromaloom-{sc.applicationId}"
        atexit.register(_clean, spark, _MADE[sc.applicationId])
    return _MADE[sc.applicationId]


def _clean(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: the lineage ends
    there, and a lost executor costs no more than a re-read."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator reads; any others, clashing names included, are
    pruned before the plan starts. A null text is the empty one.

    Texts are long rows: Arrow batches of few rows bound what the JVM and the
    Python worker hold at once. This sets the session's batch size.
    """
    ship(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def schema_with(df: DataFrame, *more: str) -> T.StructType:
    """The schema of ``df`` with further fields, each written "name type"."""
    return T.StructType([*df.schema.fields, *T.DataType.fromDDL(", ".join(more)).fields])


def with_least(rows: DataFrame, key: str, value: str, salts: int = 64) -> DataFrame:
    """``rows`` with _least, the smallest ``value`` of the rows of its ``key``, and
    _rows, their number. A key's rows spread over ``salts`` tasks, so one that
    holds a third of all rows doesn't gather anywhere."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)))
    part = salted.groupBy(key, "_salt").agg(F.min(value).alias("_least"), F.count("*").alias("_rows"))
    whole = part.groupBy(key).agg(F.min("_least").alias("_least"), F.sum("_rows").alias("_rows"))
    return salted.join(part.select(key, "_salt").join(whole, key), [key, "_salt"]).drop("_salt")
