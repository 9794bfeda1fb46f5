"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Each word trigram of an item is a seed unless it is common in the benchmark
itself: it is left out where more than RARE different items hold it, but every
item keeps its KEPT rarest. Seeds are looked up in every text through a bounded
Bloom filter; what it lets through meets the items in an exact join, in which a
hit so meets few items. One hit makes a candidate of the window around its
diagonal, however many texts hold it and however large the corpus is. A window
whose words bound the score below what counts is dropped; the others are aligned
with the item word by word; edited and paraphrased copies keep a high score.

An item of one or two words is a seed as a whole, and a text holds it where it
has just these words in a row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chromaloom.llm import bloom
from chromaloom.llm.common import id_and_text, schema_with, stage, table
from chromaloom.llm.shingles import WordHashes, gram_hashes

#: Words of a seed and width of a band of diagonals.
SEED_WORDS, BAND = 3, 32
#: Items that may share a seed, seeds that each item keeps whatever they share,
#: and tasks over which the hits of a seed are dealt.
RARE, KEPT, SALTS = 16, 4, 16
#: Alignment scores, and the score from which a text holds the item: that of an
#: exact copy of half of it, or of as many words as ENOUGH points make.
MATCH, MISMATCH, GAP, ENOUGH = 2, -1, -1, 30

_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def enough(item_words: int) -> float:
    """The score from which a text holds an item; a short one must be whole."""
    return min(MATCH * item_words / 2, ENOUGH) if item_words >= SEED_WORDS else MATCH * item_words


def _hashes(text: str, memo: WordHashes, size: int = SEED_WORDS) -> np.ndarray:
    found = words(text)
    if not 0 < size <= len(found):
        return np.empty(0, np.uint64)
    h = np.fromiter((memo[w] for w in found), np.uint64, len(found))
    return gram_hashes(h, size) + np.uint64(SEED_WORDS - size)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds of each item with the hash of all its words and the words of a seed."""
    memo = WordHashes()
    for batch in batches:
        for item, text in zip(batch.column(0), batch.column(1)):
            found = words(text.as_py())
            size = min(SEED_WORDS, len(found))
            h = _hashes(text.as_py(), memo, size).view(np.int64)
            whole = xxhash.xxh3_64_intdigest(" ".join(found).encode("utf-8", "surrogatepass")) >> 1
            columns = [pa.array([item.as_py()] * len(h), batch.schema.field(0).type), pa.array(h), pa.array(np.arange(len(h)), pa.int32())]
            columns += [pa.array(np.full(len(h), whole)), pa.array(np.full(len(h), size), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "seed", "item_at", "whole", "size"])


def _hits(sizes: list[int], shape: bloom.Shape, filled: object) -> Callable:
    """(key, seed, at) of each n-gram of words that may be a seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        held = np.frombuffer(filled.value, np.uint8)
        for batch in batches:
            keys, seeds, at = [], [], []
            for key, text in zip(batch.column(0).to_numpy(), batch.column(1)):
                for size in sizes:
                    h = _hashes(text.as_py(), memo, size)
                    if len(found := np.flatnonzero(bloom.test(held, h, shape))):
                        keys.append(np.full(len(found), key))
                        seeds.append(h[found].view(np.int64))
                        at.append(found)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(seeds)), pa.array(np.concatenate(at), pa.int32())], names=["key", "seed", "at"])

    return run


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int, int]:
    """(best local score, first and end of the passage in the window, matches on
    the way) of two arrays of word numbers. One pass over the item's words; a run
    of gaps along the window is a running maximum."""
    n = len(window)
    place = np.arange(n + 1)
    step = GAP * place
    score, hits, first = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), place
    best, begin, end, matches = 0, 0, 0, 0
    for w in item:
        same = window == w
        diagonal = score[:-1] + np.where(same, MATCH, MISMATCH)
        up = score[1:] + GAP
        new = np.concatenate([[0], np.maximum(np.maximum(diagonal, up), 0)])
        source = np.concatenate([[0], np.where(diagonal >= up, hits[:-1] + same, hits[1:])])
        start = np.concatenate([[0], np.where(diagonal >= up, first[:-1], first[1:])])
        source[new == 0] = 0
        start = np.where(new == 0, place, start)
        # gaps along the window: the best earlier cell less the gap's cost
        flat = new - step
        top = np.maximum.accumulate(flat)
        came = np.maximum.accumulate(np.where(flat == top, place, 0))
        score, hits, first = top + step, source[came], start[came]
        at = int(score.argmax())
        if score[at] > best:
            best, begin, end, matches = int(score[at]), int(first[at]), at, int(hits[at])
    return best, begin, end, matches


def bound(shared: np.ndarray) -> int:
    """No local score is higher, by the words of one side: of each, whether the
    other side has it. The others cost a point at least."""
    total = np.concatenate([[0], np.cumsum(np.where(shared, MATCH, max(MISMATCH, GAP)))])
    return int((total - np.minimum.accumulate(total)).max())


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, items, score, cover, lo, hi = [], [], [], [], [], []
        known: dict = {}
        for row in range(batch.num_rows):
            text = words(batch.column(1)[row].as_py())
            for wanted in batch.column(2)[row].as_py():
                if wanted["item"] not in known:
                    item = words(wanted["item"])
                    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
                    known[wanted["item"]] = number, np.array([number[w] for w in item], np.int64)
                number, item = known[wanted["item"]]
                slack = len(item) // 2 + BAND
                first = max(0, wanted["diagonal"] - slack)
                window = text[first : wanted["diagonal"] + BAND + len(item) + slack]
                ids = np.array([number.get(w, -1) for w in window], np.int64)
                least = enough(len(item))
                if bound(ids >= 0) < least or bound(np.isin(item, ids)) < least:
                    continue
                best, begin, end, matches = align(item, ids)
                if best >= least:
                    keep.append(row)
                    items.append(wanted["item_id"])
                    score.append(best / (MATCH * len(item)))
                    cover.append(matches / len(item))
                    lo.append(first + begin)
                    hi.append(first + end)
        kept = batch.column(0).take(pa.array(keep, pa.int64()))
        item_type = batch.schema.field(2).type.value_type.field("item_id").type
        yield pa.RecordBatch.from_arrays(
            [kept, pa.array(items, item_type), pa.array(score, pa.float64()), pa.array(cover, pa.float64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
            names=["_row", "item_id", "score", "matched", "first_word", "end_word"],
        )


def _seeds(spark: SparkSession, items: DataFrame) -> DataFrame:
    """(item_id, seed, item_at, size): the rare seeds, and of each item the rarest."""
    made = stage(spark, items.mapInArrow(_item_seeds, schema_with(items.select("item_id"), "seed long, item_at int, whole long, size int")), "all_seeds")
    held = made.groupBy("seed").agg(F.count_distinct("whole").alias("items")).withColumnRenamed("seed", "_seed")
    met = made.join(held, F.col("seed") == F.col("_seed"))
    place = F.row_number().over(Window.partitionBy("item_id", "whole").orderBy("items", "seed"))
    rare = met.withColumn("place", place).filter((F.col("items") <= RARE) | (F.col("place") <= KEPT))
    return stage(spark, rare.select("item_id", "seed", "item_at", "size"), "seeds")


def _candidates(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item_id, diagonal) of the windows that hold a seed; key hashes the text."""
    seeds = _seeds(spark, items)
    shape, filled = bloom.build(spark, seeds.select("seed"), seeds.count(), repeated=False)
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # three at most
    texts = docs.select(F.xxhash64("text").alias("key"), "text")
    hits = texts.mapInArrow(_hits(sizes, shape, filled), "key long, seed long, at int").withColumn("salt", F.pmod("key", F.lit(SALTS)))
    dealt = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = hits.join(dealt, ["seed", "salt"]).select("key", "item_id", (F.floor((F.col("at") - F.col("item_at")) / BAND) * BAND).cast("int").alias("diagonal"))
    return stage(spark, met.distinct(), "windows")


def _screened(spark: SparkSession, docs: DataFrame, keys: DataFrame) -> Column:
    """Of rows with the column _key: whether it may be one of ``keys``."""
    return bloom.might_contain("_key", *bloom.build(spark, keys, keys.count(), repeated=False))


def find_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score (share of an exact copy's), matched (share of the
    item's words), first_word and end_word (the aligned passage in the text).

    One row for each document and item: of several passages the best, the first
    of equals. Null texts and items have no seeds and no rows, nor has a passage
    without a rare seed of the item; a null doc_id stays null; repeated rows give
    their rows once; an empty table on either side gives an empty result; further
    columns are not read.
    """
    read = id_and_text(docs)
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    windows = _candidates(spark, read, items)
    keys = windows.select("key").distinct()
    # written, so that no task needs two Python workers
    maybe = stage(spark, read.withColumn("_key", F.xxhash64("text")).filter(_screened(spark, read, keys)), "suspects")
    # a text travels once, with all its windows
    wanted = windows.join(items.withColumnRenamed("text", "item"), "item_id")
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct("item_id", "item", "diagonal")).alias("wanted"))
    met = maybe.join(wanted, F.col("_key") == F.col("key")).select(F.struct("doc_id", "_key", F.xxhash64(F.lit(1), "text").alias("_print")).alias("_row"), "text", "wanted")
    schema = schema_with(met.select("_row", "wanted.item_id"), "score double", "matched double", "first_word int", "end_word int")
    schema["item_id"].dataType = schema["item_id"].dataType.elementType
    best = F.struct("score", "matched", (-F.col("first_word")).alias("f"), "end_word")
    found = met.mapInArrow(_aligned, schema).groupBy("_row", "item_id").agg(F.max(best).alias("b"))
    return found.select("_row.doc_id", "item_id", "b.score", "b.matched", (-F.col("b.f")).alias("first_word"), "b.end_word", F.col("_row._key").alias("text_key"), F.col("_row._print").alias("text_print"))


def decontaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns.
    Rows that no filter suspects don't shuffle."""
    found = find_leaks(spark, docs, items).select(F.col("text_key").alias("_leak"), F.col("text_print").alias("_leak_print"))
    leaks = stage(spark, found.distinct(), "leaks")
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumn("_key", F.xxhash64(text))
    marked = marked.withColumn("_maybe", _screened(spark, docs, leaks.select("_leak")))
    # 128 bits of hash say that two texts are one
    same = (F.col("_key") == F.col("_leak")) & (F.xxhash64(F.lit(1), text) == F.col("_leak_print"))
    held = marked.filter("_maybe").join(leaks, same, "left_anti")
    return marked.filter("not _maybe").unionByName(held).select(*docs.columns)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.drop("text_key", "text_print")


def brute_force(text: str, item: str) -> bool:
    """Whether the whole text aligns with the item; what tests compare with."""
    a, b = words(item), words(text)
    number = {w: i for i, w in enumerate(dict.fromkeys(a))}
    score = align(np.array([number[w] for w in a], np.int64), np.array([number.get(w, -1) for w in b], np.int64))[0]
    return bool(a) and score >= enough(len(a))
