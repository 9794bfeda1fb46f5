"""Quality classification by importance resampling.

Two generative models of hashed byte n-grams, of the target text and of the raw
text, give each document its log importance weight: the sum of its n-grams' log
ratios, divided by the number of n-grams that hold a byte, so that each byte
counts once. A Gumbel top-k draws k documents without replacement, each time in
proportion to exp(weight); k is a parameter. Where it isn't given, it is the
number of documents above the threshold that costs least on held-out labels.

``classify`` is an operator of its own: it draws nothing and compares the mean
log ratio of an n-gram with a threshold.

The raw model counts every n-gram of all documents. The target model and the
thresholds come from a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.llm.common import id_and_text, stage, table
from chromaloom.llm.vectors import vector_sum

#: Labelled documents used at most (about): half for the target model, half for the thresholds.
SAMPLE_DOCS = 20_000
#: n-gram lengths in bytes, hash buckets, and the raw model's share in the target model.
ORDERS, BUCKETS, MIXED = (4, 8), 1 << 17, 0.3
#: The same for ``classify``, as pseudo-counts a bucket.
PRIOR = 0.1
#: What rejecting a good document costs against keeping a bad one.
GOOD_COST, SEED = 4.0, 77
#: Texts that are hashed at once.
ROWS = 100


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes by order and byte, first byte, one past the last byte of each text)."""
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.zeros(at[-1] - at[0] + 8, np.uint8)
    if raw is not None:
        data[:-8] = np.frombuffer(raw, np.uint8)[at[0] : at[-1]]
    at -= at[0]
    eight = np.ndarray(len(data) - 8, "<u8", data, strides=(1,)) if len(data) > 8 else np.empty(0, np.uint64)
    out = np.empty((len(ORDERS), len(eight)), np.int64)
    for i, order in enumerate(ORDERS):
        kept = eight & np.uint64((1 << 8 * order) - 1)
        h = (kept + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[i] = h >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return out, at[:-1], at[1:]


def _string(texts: pa.Array) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    return texts if texts.type == pa.string() else texts.cast(pa.string())


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    for at in range(0, len(texts), ROWS):
        yield _string(texts.slice(at, ROWS))


def _add(batch: pa.RecordBatch, total: np.ndarray) -> None:
    for part in _parts(batch.column(0)):
        _add_part(part, total)


def _add_part(texts: pa.Array, total: np.ndarray) -> None:
    h, lo, hi = _hashes(texts)
    for i, order in enumerate(ORDERS):
        # n-grams that reach into the next text don't count
        inside = np.zeros(h.shape[1] + 1, np.int64)
        np.add.at(inside, lo, 1)
        np.add.at(inside, np.maximum(lo, hi - order + 1), -1)
        total += np.bincount(h[i][np.cumsum(inside[:-1]) > 0], minlength=BUCKETS)


def weights(log_ratio: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the log ratios, number of n-grams) of each text."""
    found = [_weights_part(log_ratio, part) for part in _parts(texts)]
    return tuple(np.concatenate(c) if c else np.zeros(0) for c in ([f[i] for f in found] for i in (0, 1)))


def _weights_part(log_ratio: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h, lo, hi = _hashes(texts)
    total, number = np.zeros(len(lo)), np.zeros(len(lo), np.int64)
    for i, order in enumerate(ORDERS):
        sums = np.concatenate([[0.0], np.cumsum(log_ratio[h[i]], dtype=np.float64)])
        end = np.maximum(lo, hi - order + 1)
        total += sums[end] - sums[lo]
        number += end - lo
    return total, number


@dataclass
class Model:
    """Log ratios by bucket and the threshold, of the draw and of ``classify``."""

    log_ratio: np.ndarray
    threshold: float
    mean_ratio: np.ndarray
    mean_threshold: float


def _scored(held: object) -> Callable[[Column], Column]:
    @F.arrow_udf("struct<total:double,mean:double>")
    def score(texts: pa.Array) -> pa.Array:
        # rounded, so that a text has one weight whatever shares its batch
        total, _ = weights(held.value.log_ratio, texts)
        mean, number = weights(held.value.mean_ratio, texts)
        columns = [np.round(total / sum(ORDERS), 6), np.round(mean / np.maximum(1, number), 9)]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["total", "mean"])

    return score


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model for ``docs`` with ``labels(doc_id, quality, toxic)``.

    Target text is of quality 1 and not toxic. Labels without an id, a quality
    or a document teach nothing; of an id's labels the lowest quality counts.
    Without target labels every weight is 0 and every document passes.
    """
    texts = id_and_text(docs)
    raw = vector_sum(texts.select("text"), _add, BUCKETS).astype(np.float64)
    rows = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id")
    rows = rows.agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    share = sample_docs / max(1, rows.count())
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) / 1e6
    rows = rows.filter(drawn < share).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(2)))
    # about sample_docs rows at most, which is what makes the broadcast safe
    sample = stage(spark, texts.join(F.broadcast(rows), "doc_id"), "labelled")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    target = vector_sum(sample.filter(good & (F.col("half") == 0)).select("text"), _add, BUCKETS).astype(np.float64)
    if not target.sum():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, np.zeros(BUCKETS, np.float32), 0.0)
    p_raw = (raw + 1) / (raw.sum() + BUCKETS)
    mixed = (1 - MIXED) * target / target.sum() + MIXED * p_raw
    smoothed = (target + p_raw * BUCKETS * PRIOR) / (target.sum() + BUCKETS * PRIOR)
    model = Model(np.log(mixed / p_raw).astype(np.float32), 0.0, np.log(smoothed / p_raw).astype(np.float32), 0.0)

    held = spark.sparkContext.broadcast(model)
    known = sample.filter("half = 1").select(_scored(held)(F.col("text")).alias("w"), (F.col("quality") == 1).alias("good")).select("w.*", "good").toPandas()
    good = known["good"].to_numpy(bool)
    model.threshold = _threshold(known["total"].to_numpy(), good)
    model.mean_threshold = _threshold(known["mean"].to_numpy(), good)
    return model


def _threshold(w: np.ndarray, good: np.ndarray) -> float:
    """Where good documents below and bad ones above cost least; half way
    between the two weights beside it. The lowest such place."""
    if good.all():
        return -np.inf
    order = np.argsort(w, kind="stable")
    w, good = w[order], good[order]
    below = np.concatenate([[0], np.cumsum(good)]) * GOOD_COST
    above = (~good).sum() - np.concatenate([[0], np.cumsum(~good)])
    at = int(np.argmin(below + above))
    if at in (0, len(w)):
        return -np.inf if at == 0 else float(w[-1])
    return float((w[at - 1] + w[at]) / 2)


def gumbel(doc_id: Column, text: Column, seed: int | Column = SEED) -> Column:
    """Standard Gumbel noise from a hash of id and text, the same in every run."""
    u = (F.pmod(F.xxhash64(doc_id, text, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, column: str, k: int, fit_in: int = 10_000) -> float:
    """The exact k-th largest value, by ever finer histograms; at most ``fit_in``
    values reach the driver."""
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    if k <= 0 or lo is None:
        return np.inf
    while True:
        inside = rows.filter(F.col(column).between(lo, hi))
        above = rows.filter(F.col(column) > hi).count()
        if lo == hi or inside.limit(fit_in + 1).count() <= fit_in:
            values = sorted((r[0] for r in inside.select(column).collect()), reverse=True) if lo != hi else [lo]
            return values[min(len(values), k - above) - 1]
        width = (hi - lo) / 1024
        place = F.least(F.floor((F.col(column) - lo) / width), F.lit(1023))
        bins = {r["b"]: r for r in inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            if above + bins[b]["n"] >= k:
                lo, hi = bins[b]["lo"], bins[b]["hi"]
                break
            above += bins[b]["n"]


def _with_keys(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with _weight, _mean and _key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    weighed = docs.select(*docs.columns, _scored(spark.sparkContext.broadcast(model))(text).alias("_scored"))
    weighed = weighed.select(*docs.columns, F.col("_scored.total").alias("_weight"), F.col("_scored.mean").alias("_mean"))
    return weighed.withColumn("_key", F.col("_weight") + gumbel(F.col("doc_id"), text))


def _drawn(spark: SparkSession, docs: DataFrame, model: Model, k: int | None) -> tuple[DataFrame, float]:
    """(doc_id, weight, gumbel_key and score of every row; the least key that is drawn)."""
    keyed = _with_keys(spark, id_and_text(docs), model)
    scored = stage(spark, keyed.select("doc_id", F.col("_weight").alias("weight"), F.col("_key").alias("gumbel_key"), F.col("_mean").alias("score")), "scored")
    if k is None:
        k = scored.filter(F.col("weight") >= model.threshold).count()
    return scored, kth_largest(scored, "gumbel_key", k)


def importance(spark: SparkSession, docs: DataFrame, model: Model, k: int | None = None) -> DataFrame:
    """doc_id, weight (log importance), gumbel_key, selected, score (log ratio of
    an n-gram, on average) and accepted (the score reaches its threshold).

    Selected are the k rows with the largest keys, by default as many as reach
    the model's threshold; rows with the k-th key itself are all selected. Null,
    empty and very short texts have weight 0. A null doc_id stays null; repeated
    rows have the same key; an empty table gives an empty result; further columns
    are not read.
    """
    scored, least = _drawn(spark, docs, model, k)
    return scored.withColumn("selected", F.col("gumbel_key") >= least).withColumn("accepted", F.col("score") >= model.mean_threshold)


def selected(spark: SparkSession, docs: DataFrame, model: Model, k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that the draw selects, with all their columns; they
    are weighed once more rather than shuffled."""
    _, least = _drawn(spark, docs, model, k)
    return _with_keys(spark, docs, model).filter(F.col("_key") >= least).select(*docs.columns)


def classify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold; no draw."""
    return _with_keys(spark, docs, model).filter(F.col("_mean") >= model.mean_threshold).select(*docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return importance(spark, docs, fit(spark, docs, table(spark, sf_dir, "labels")))
