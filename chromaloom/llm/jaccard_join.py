"""N-gram Jaccard join with parity sketches.

Two shingle sets with 100*|A & B| >= t*|A | B| differ in at most
D = (|A| + |B|)(100 - t)/(100 + t) shingles. A shingle flips one bit of a
document's sketch, so the Hamming distance of two sketches is at most the size
of the symmetric difference. Per size band there are two of them: a small one
of a few bits a shingle, for Hamming distances, and one of K very wide pieces,
of each of which only the XOR of its bits' 64-bit hashes is kept. At most D
pieces differ, so K - D are equal. Documents join on equal pieces, but

* not on light pieces, which hold fewer than ``weight`` (mostly two) shingles:
  unrelated documents would meet there. Equal pieces weigh the same, so a pair
  still meets if either side has fewer than K - D light ones. A set with more
  is cut anew by a second function, a third and so on, as is every such set, so
  two of them meet in the first that serves either;
* not on as many of its most frequent pieces as a set can spare (the prefix
  filter): of one order of all pieces, what two sets share first is left.

Then

1. equal sets collapse to the one of the smallest id;
2. in each bucket of equal pieces all members are paired with the smallest id
   (never with each other: rows stay in proportion to the pieces), the small
   sketches discard pairs beyond D, the rest are verified on the sets;
3. links become components. Only where a bucket still holds more than one
   component are the sketches of its members compared across components, inside
   the task, block by block; only pairs within D become rows and are verified.

No link between different sets is lost, and no bucket is cut short.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chromaloom.llm import bloom
from chromaloom.llm.bloom import mix
from chromaloom.llm.common import id_and_text, stage, table, with_least
from chromaloom.llm.components import components
from chromaloom.llm.shingles import WordHashes, shingle_set

#: Ratio of successive size bands; members that are compared at once.
GROWTH, BLOCK = 1.5, 4000
#: Bits of the small sketch for each shingle: with few, pairs beyond D look nearer.
BITS = 3
#: Functions that cut a set into pieces, and the share of sets that may need another one.
FUNCTIONS, ANEW = 12, 0.03
#: Documents whose sets are cut at once, and pieces of them.
DOCS, PIECES = 500, 2_000_000


class Band(NamedTuple):
    first: int
    top: int
    #: K, or 0 where only equal sets link
    pieces: int
    #: shingles from which a piece isn't light
    weight: int
    #: words of the small sketch
    folded: int


def differ(a: int, b: int, percent: int) -> int:
    """D: the most shingles in which linked sets of these sizes differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def _light(n: int, pieces: int, weight: int) -> float:
    """Light pieces to expect of n shingles."""
    none = (1 - 1 / pieces) ** n
    one = n / pieces * (1 - 1 / pieces) ** (n - 1) if pieces > 1 else float(n == 1)
    return pieces * sum([none, one][:weight])


def _more_than(mean: float, most: int) -> float:
    """The chance of more than ``most`` (Poisson)."""
    if mean > 200:
        return 0.0 if most >= mean + 3 * math.sqrt(mean) else 1.0
    term = total = math.exp(-mean)
    for i in range(1, most + 1):
        term *= mean / i
        total += term
    return 1 - total


def _cut(top: int, most: int) -> tuple[int, int]:
    """(pieces, weight): the heaviest pieces with which few sets have too many
    light ones, and one piece to spare. Two shingles a piece may cost a quarter
    more pieces; where even one costs too many, all pieces count."""
    for weight, dearest in ((2, most // 4 + 2), (1, 2 * most + 2)):
        spare = 0
        while spare <= dearest:
            pieces = most + 1 + spare
            if _more_than(_light(top, pieces, weight), spare) <= ANEW:
                return pieces + 1, weight
            spare += max(1, spare // 8)
    return most + 1, 0


@lru_cache
def bands(percent: int) -> list[Band]:
    """Band k serves the pairs whose smaller set lies in it; the larger one has at
    most 100/percent times its size and so lies in it or in the next one."""
    out, first = [], 1
    growth = max(GROWTH, 100 / percent)
    while first < 1 << 31:
        after = max(first + 1, int(first * growth), (first - 1) * 100 // percent + 1)
        top = after - 1
        most = differ(top, top * 100 // percent, percent)
        pieces, weight = _cut(top, most) if most else (0, 0)
        out.append(Band(first, top, pieces, weight, math.ceil(BITS * top / 64)))
        first = after
    return out


def _band_of(n: int, percent: int) -> int:
    lo = [b.first for b in bands(percent)]
    return int(np.searchsorted(lo, n, side="right")) - 1


def spare(n: np.ndarray, band: int, percent: int) -> np.ndarray:
    """Pieces beyond the one that sets of n shingles must share with any partner."""
    b = bands(percent)[band]
    # in the band below its own, a set only has smaller partners
    partner = np.where(n <= b.top, n * 100 // percent, b.top)
    return b.pieces - 1 - differ(n, partner, percent)


def sketches(sets: list[np.ndarray], band: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set, join key and tag of each kept piece; the sets' small sketches) in one
    band. A tag tells the function that made the key (bits 16 and above) and how
    many of its keys the set can do without."""
    b = bands(percent)[band]
    k, sizes = b.pieces, np.array([len(s) for s in sets])
    left, todo = spare(sizes, band, percent), np.arange(len(sets))
    of, keys, tags = [], [], []
    folds = np.zeros(len(sets) * b.folded, np.uint64)
    for f in range(FUNCTIONS):
        number = band * FUNCTIONS + f
        owner = np.repeat(np.arange(len(todo)), sizes[todo])
        z = mix(np.concatenate([sets[i] for i in todo]) ^ np.uint64(0xA0761D6478BD642F * (number + 1) % 2**64))
        at = owner * k + ((z >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
        parity = np.zeros(len(todo) * k, np.uint64)
        np.bitwise_xor.at(parity, at, z)
        weight = np.bincount(at, minlength=len(todo) * k).reshape(-1, k)
        if f == 0:
            bit = (z & np.uint64(0xFFFFFFFF)) % np.uint64(64 * b.folded)
            np.bitwise_xor.at(folds, owner * b.folded + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        over = left[todo] - (weight < b.weight).sum(axis=1)
        # a set that no function serves meets its like on all pieces of the last
        kept = weight >= b.weight if f < FUNCTIONS - 1 else (weight >= b.weight) | (over < 0)[:, None]
        row, piece = np.nonzero(kept)
        salt = mix(np.arange(k, dtype=np.uint64) + np.uint64((number << 40) + 1))
        of.append(todo[row])
        keys.append(mix(parity.reshape(-1, k)[row, piece] + salt[piece]))
        tags.append(((number << 16) + np.clip(over, 0, 0xFFFF))[row].astype(np.int32))
        todo = todo[over < 0]
        if not len(todo):
            break
    return np.concatenate(of), np.concatenate(keys), np.concatenate(tags), folds.reshape(-1, b.folded)


_SKETCHED = "doc_id long, n_shingles long, print binary, keys array<long>, tags array<int>, own int, own_fold array<long>, less_fold array<long>"


def _sketches(size: int, percent: int) -> Callable:
    """own_fold is of the band of the set's size, less_fold of the band below it
    where that may hold a smaller partner."""
    names = ["doc_id", "n_shingles", "print", "keys", "tags", "own", "own_fold", "less_fold"]

    def made(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets], np.int64)
        own = np.searchsorted([b.first for b in bands(percent)], n, side="right") - 1
        first = np.array([b.first for b in bands(percent)])[np.maximum(own, 0)]
        folds: list[list] = [[None] * len(sets), [None] * len(sets)]
        of, keys, tags = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int32)]
        for less, band_of in enumerate((own, np.where(-(-n * percent // 100) < first, own - 1, -1))):
            for band in np.unique(band_of[band_of >= 0]):
                if not (k := bands(percent)[band].pieces):
                    continue
                rows = np.flatnonzero(band_of == band)
                step = max(1, PIECES // k)
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    o, k_, t, f = sketches([sets[i] for i in part], int(band), percent)
                    of.append(part[o])
                    keys.append(k_)
                    tags.append(t)
                    for i, fold in zip(part, f.view(np.int64)):
                        folds[less][i] = fold
        order = np.argsort(np.concatenate(of), kind="stable")
        ends = np.searchsorted(np.concatenate(of)[order], np.arange(len(sets) + 1))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x)[order].view(t))) for x, t in ((keys, np.int64), (tags, np.int32))]
        fold_type = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n), pa.array(map(_print, sets), pa.binary()), *lists, pa.array(own.astype(np.int32)), *(pa.array(f, fold_type) for f in folds)], names=names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                texts = batch.column(1).slice(at, DOCS)
                yield made(batch.column(0).slice(at, DOCS), [shingle_set(t.as_py(), size, memo) for t in texts])

    return run


def _print(s: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _sets(size: int, shape: bloom.Shape, filled: object) -> Callable:
    """The sets of the documents that the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        held = np.frombuffer(filled.value, np.uint8)
        for batch in batches:
            batch = batch.filter(pa.array(bloom.test(held, batch.column(0).to_numpy(), shape)))
            for at in range(0, batch.num_rows, 200):
                ids, texts = batch.column(0).slice(at, 200), batch.column(1).slice(at, 200)
                found = [shingle_set(t.as_py(), size, memo).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.binary())], names=["id", "hashes"])

    return run


def _verified(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


_OPEN = ["group", "doc_id", "component", "block", "across", "n_shingles", "own", "own_fold", "less_fold"]


def _across(spark: SparkSession, open_: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in one bucket whose sketches are
    within D. Buckets of more than BLOCK members meet block against block."""
    cuts = F.ceil(F.col("members") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("doc_id"), cuts).cast("int")
    rows = open_.select("key", "doc_id", "component", "members", cuts.alias("cuts"), block.alias("block"))
    small = rows.filter("cuts = 1").select(F.col("key").alias("group"), "doc_id", "component", "block", F.lit(False).alias("across"))
    large = rows.filter("cuts > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    met = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    large = large.select(met.alias("group"), "doc_id", "component", "block", (F.col("block") != F.col("other")).alias("across"))
    folds = heads.select("doc_id", "n_shingles", "own", "own_fold", "less_fold")
    each = small.unionByName(large).join(folds, "doc_id").select(*_OPEN)
    sorted_ = each.repartition("group").sortWithinPartitions("group")
    return sorted_.mapInArrow(_compared(percent), "a long, b long").distinct()


def _compared(percent: int) -> Callable:
    def folds(column: pa.Array, rows: np.ndarray) -> np.ndarray:
        # one band, so one length
        return column.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1)

    def pairs(t: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, comp, block, across, n, own = (t.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "component", "block", "across", "n_shingles", "own"))
        for band in np.unique(own):
            x = np.flatnonzero(own == band)
            for y, column in ((x, "own_fold"), (np.flatnonzero(own == band + 1), "less_fold")):
                if not len(y) or not len(x):
                    continue
                if column == "less_fold":
                    y = y[t.column(column).is_valid().to_numpy(zero_copy_only=False)[y]]
                    if not len(y):
                        continue
                fx, fy = folds(t.column("own_fold"), x), folds(t.column(column), y)
                for at in range(0, len(x), 256):
                    i = x[at : at + 256, None]
                    apart = np.zeros((len(i), len(y)), np.int64)
                    for word in range(fx.shape[1]):
                        apart += np.bitwise_count(fx[at : at + 256, None, word] ^ fy[None, :, word])
                    near = apart * (100 + percent) <= (n[i] + n[y]) * (100 - percent)
                    near &= (comp[i] != comp[y]) & (np.maximum(n[i], n[y]) * percent <= np.minimum(n[i], n[y]) * 100)
                    near &= ~across[i] | (block[i] != block[y])
                    p, q = np.nonzero(near)
                    p, q = ids[i[p, 0]], ids[y[q]]
                    yield np.maximum(p, q), np.minimum(p, q)

    def groups(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = t.column("group").to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        found = [p for lo, hi in zip(edges, edges[1:]) if hi - lo > 1 for p in pairs(t.slice(lo, hi - lo))]
        if found:
            a, b = np.unique(np.stack([np.concatenate(c) for c in zip(*found)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None and held.num_rows:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = batch.column("group").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield from groups(batch.slice(0, cut))
            held = batch.slice(cut)
        if held is not None and held.num_rows:
            yield from groups(held)

    return run


class _Verifier:
    """Tests candidate pairs: sizes, then folded sketches, then the sets."""

    def __init__(self, spark: SparkSession, docs: DataFrame, heads: DataFrame, size: int, percent: int):
        self.spark, self.docs, self.size, self.percent = spark, docs, size, percent
        self.heads = heads.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "own", "own_fold", "less_fold")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that sizes and folded sketches leave."""
        p = self.percent
        side = lambda s: self.heads.select(*(F.col(c).alias(f"{c}_{s}") for c in self.heads.columns))
        met = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
        band = F.least("own_a", "own_b")
        fold: Callable[[str], Column] = lambda s: F.when(F.col(f"own_{s}") == band, F.col(f"own_fold_{s}")).otherwise(F.col(f"less_fold_{s}"))
        apart = F.aggregate(F.zip_with(fold("a"), fold("b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        fits = (F.greatest("n_a", "n_b") * p <= F.least("n_a", "n_b") * 100) & (F.abs(F.col("own_a") - F.col("own_b")) <= 1)
        return met.filter(fits).filter(apart * (100 + p) <= (F.col("n_a") + F.col("n_b")) * (100 - p)).select("a", "b")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sets link. Sets are made anew from the texts of the
        documents in question, which a bounded filter picks without a shuffle."""
        spark = self.spark
        ids = stage(spark, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        n = ids.count()
        if n == 0:
            return pairs
        shape, filled = bloom.build(spark, ids, n, repeated=False)
        texts = self.docs.filter("doc_id is not null").mapInArrow(_sets(self.size, shape, filled), "id long, hashes binary")
        sets = stage(spark, texts.join(ids, "id", "left_semi"), "sets")
        met = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
        met = met.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
        return stage(spark, met.mapInArrow(_verified(self.percent), "a long, b long").distinct(), "links")


def _labelled(pairs: DataFrame, labels: DataFrame, keep: bool = False) -> DataFrame:
    """Pairs whose ends lie in different components; with ``keep``, also which."""
    out = pairs
    for side in ("a", "b"):
        named = labels.select(F.col("id").alias(f"id_{side}"), F.col("component").alias(f"c_{side}"))
        out = out.join(named, F.col(side) == F.col(f"id_{side}"), "left").withColumn(f"c_{side}", F.coalesce(f"c_{side}", side)).drop(f"id_{side}")
    out = out.filter("c_a != c_b")
    return out if keep else out.drop("c_a", "c_b")


def jaccard_components(spark: SparkSession, docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest id of an equal set).

    * A null or empty text, or one of white space, has no shingles and links
      with nothing; fewer words than ``size`` make one shingle.
    * A null doc_id can't name a component: such rows return with null ids.
    * Rows that repeat a doc_id and its text return as often; of a doc_id with
      several texts each row is linked by its own text.
    * An empty table gives an empty result; further columns are not read.
    """
    read = id_and_text(docs)
    made = stage(spark, read.mapInArrow(_sketches(size, percent), _SKETCHED), "sketches")
    # sets that no other row may have pass as they are; the rest meet their class
    full = made.filter("n_shingles > 0 and doc_id is not null").withColumn("h", F.xxhash64("print"))
    shape, filled = bloom.build(spark, full.select("h"), full.count(), repeated=True)
    again = bloom.might_contain("h", shape, filled)
    classes = stage(spark, with_least(full.filter(again).select("doc_id", "print"), "print", "doc_id").select("doc_id", "print", F.col("_least").alias("class_id")).distinct(), "classes")
    sketched = full.filter("size(keys) > 0").withColumn("again", again).drop("h")
    first = classes.filter("doc_id = class_id").select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"))
    met = sketched.filter("again").join(first, (F.col("doc_id") == F.col("_id")) & (F.col("print") == F.col("_print")), "left_semi")
    heads = sketched.filter("not again").unionByName(met.dropDuplicates(["doc_id", "print"])).drop("again")

    # sizes of all buckets, added up before they shuffle; only pieces that occur twice meet them
    pieces = heads.select("doc_id", F.explode(F.arrays_zip("keys", "tags")).alias("p")).select("doc_id", "p.*").withColumnsRenamed({"keys": "key", "tags": "tag"})
    sizes = pieces.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("members")).filter("members > 1")
    sizes = stage(spark, sizes.withColumnRenamed("key", "_key"), "sizes")
    shape, filled = bloom.build(spark, sizes.select("_key"), sizes.count(), repeated=False)
    met = pieces.filter(bloom.might_contain("key", shape, filled)).join(sizes, F.col("key") == F.col("_key"))
    # the most frequent pieces go, as many as the set can spare
    place = F.row_number().over(Window.partitionBy("doc_id", "tag").orderBy(F.desc("members"), "key"))
    met = met.withColumn("place", place).filter(F.col("place") > F.col("tag").bitwiseAND(0xFFFF))
    buckets = stage(spark, met.select("doc_id", "key", "hub", "members"), "buckets")
    hubs = buckets.filter("doc_id != hub").groupBy(F.col("doc_id").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("equal"))

    test = _Verifier(spark, read, heads, size, percent)
    sure = stage(spark, hubs.join(test.near(hubs), ["a", "b"], "left_semi"), "near")
    # the partner with most equal pieces first: most others then lie in the same component
    best = sure.groupBy("a").agg(F.max(F.struct("equal", (-F.col("b")).alias("b"))).alias("m")).select("a", (-F.col("m.b")).alias("b"))
    links = test.links(best)
    one_step = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    rest = stage(spark, _labelled(sure.select("a", "b"), one_step), "rest")
    if rest.limit(1).count():
        links = links.unionByName(test.links(rest))
    labels = stage(spark, components(spark, links), "labels")

    # buckets that still hold several components
    named = labels.select(F.col("id").alias("doc_id"), "component")
    many = buckets.filter("members > 2").join(named, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    split = many.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("key")
    open_ = stage(spark, many.join(split, "key", "left_semi").filter("doc_id != hub").select("key", "doc_id", "component", "members"), "open")
    across = _across(spark, open_, heads, percent)
    more = stage(spark, across, "across")
    if more.limit(1).count():
        # between components found so far
        joined = _labelled(test.links(more), labels, keep=True)
        above = components(spark, joined.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
    else:
        above = labels.limit(0)

    at = lambda df, name: df.select(F.col("id").alias(f"_{name}"), F.col("component").alias(name))
    own = classes.select(F.col("doc_id").alias("_own"), F.col("print").alias("_of"), "class_id")
    found = made.select("doc_id", "n_shingles", "print").join(own, (F.col("doc_id") == F.col("_own")) & (F.col("print") == F.col("_of")), "left")
    found = found.withColumn("class_id", F.coalesce("class_id", "doc_id"))
    found = found.join(at(labels, "c1"), F.col("class_id") == F.col("_c1"), "left").withColumn("c1", F.coalesce("c1", "class_id"))
    found = found.join(at(above, "c2"), F.col("c1") == F.col("_c2"), "left")
    return found.select("doc_id", "n_shingles", F.coalesce("c2", "c1").alias("component_id"), "class_id")


def deduplicated(spark: SparkSession, docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, with
    all their columns. Rows without an id stay, and so do those without words;
    rows of one doc_id stay or go together. Only rows that a bounded filter
    suspects meet the ids to leave out; the others don't shuffle."""
    found = jaccard_components(spark, docs, size, percent)
    gone = stage(spark, found.filter("component_id != doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    shape, filled = bloom.build(spark, gone, gone.count(), repeated=False)
    marked = docs.withColumn("_maybe", F.col("doc_id").isNotNull() & bloom.might_contain("doc_id", shape, filled))
    held = marked.filter("_maybe").join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    return marked.filter("not _maybe").unionByName(held).select(*docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, table(spark, sf_dir, "documents"))


OP10_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) >= 4 then list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
c as (select doc_id, s, len(s) as n, case when len(s) > 0 then min(doc_id) over (partition by s) else doc_id end as class_id from s),
h as (select doc_id, n, unnest(s) as g from c where doc_id = class_id and n > 0),
p as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as both_ from h a join h b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p where 100 * both_ >= 85 * (na + nb - both_)),
e as (select a as x, b as y from l union select b, a from l),
r as (select x, x as y from e union select r.x, e.y from r join e on r.y = e.x),
k as (select x, min(y) as component_id from r group by x)
select c.doc_id, cast(c.n as bigint) as n_shingles, coalesce(k.component_id, c.class_id) as component_id, c.class_id
from c left join k on k.x = c.class_id
"""
