"""Exact deduplication with a two-pass Bloom filter.

Pass one hashes each normalised text and sets the hash in a bounded filter that
counts to two. Pass two tests the hashes: only those that may be repeated
shuffle, 72 bytes a row and never the text; the rest pass straight through.

One filter serves 268 million rows with 4 bits a row or more. Beyond that the
hash space is cut into blocks, and both passes go over the written hashes once a
block, so the rest still passes straight through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.llm import bloom
from chromaloom.llm.common import id_and_text, stage, table, with_least

#: ASCII white space, as one class for every engine.
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of white space as one space; most texts only hold single
    spaces and line ends, which ``translate`` handles without the regex."""
    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.when(flat.contains("  "), F.regexp_replace(flat, " {2,}", " ")).otherwise(flat)


def _tested(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` (written, with the column h) with again: whether h may occur twice."""
    n = rows.count()
    cuts, parts = bloom.blocks(n), []
    for i in range(cuts):
        part = rows if cuts == 1 else rows.filter(F.pmod(F.xxhash64("h"), F.lit(cuts)) == i)
        shape, filled = bloom.build(spark, part.select("h"), n // cuts, repeated=True)
        parts.append(stage(spark, part.withColumn("again", bloom.might_contain("h", shape, filled)), "tested"))
        filled.unpersist()
    return reduce(DataFrame.unionByName, parts)


def duplicate_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per input row.

    * A null text is the empty text, and all empty texts are equal.
    * The smallest doc_id of a group stays; a null doc_id stays only where no
      row of its group has an id.
    * Rows that repeat both doc_id and text are one document: each is counted
      in group_size and each reads kept like its twins (``deduplicated`` leaves
      one of them).
    * An empty table gives an empty result; further columns are not read.
    """
    sha = F.sha2(normalised(F.col("text")), 256)
    rows = stage(spark, id_and_text(docs).select("doc_id", sha.alias("text_sha256")), "digests")
    tested = _tested(spark, rows.withColumn("h", F.xxhash64("text_sha256")))

    alone = tested.filter(~F.col("again")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    again = tested.filter("again").select("doc_id", "text_sha256")
    met = with_least(again, "text_sha256", "doc_id").select(
        "doc_id", F.col("_least").alias("keep_id"), F.col("_rows").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("_least")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(met)


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that
    repeat both doc_id and text one stays. Edge cases as in duplicate_groups.

    Rows whose hash is not repeated never shuffle; a filter of the repeated
    hashes tells (it saturates beyond 268 million of them). The others meet the
    ids to keep on (doc_id, digest), so that a large group of copies spreads evenly.
    """
    sha = F.sha2(normalised(F.coalesce(F.col("text"), F.lit(""))), 256)
    rows = stage(spark, docs.select("doc_id", sha.alias("_sha")).withColumn("h", F.xxhash64("_sha")), "digests")
    twice = stage(spark, _tested(spark, rows).filter("again").groupBy("h").count().filter("count > 1").select("h"), "twice")
    again = bloom.might_contain("h", *bloom.build(spark, twice, twice.count(), repeated=False))
    keep = rows.filter(again).groupBy("_sha").agg(F.min("doc_id").alias("_keep")).withColumnRenamed("_sha", "_sha_keep")
    marked = docs.withColumn("_sha", sha).withColumn("h", F.xxhash64("_sha")).withColumn("_again", again)
    same = (F.col("_sha") == F.col("_sha_keep")) & F.col("doc_id").eqNullSafe(F.col("_keep"))
    met = marked.filter("_again").join(keep, same, "left_semi").dropDuplicates(["doc_id", "_sha"])
    return marked.filter("not _again").unionByName(met).select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(spark, table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with t as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from t group by text_sha256)
select t.doc_id, g.keep_id, g.group_size, t.doc_id is not distinct from g.keep_id as kept, t.text_sha256
from t join g using (text_sha256)
"""
