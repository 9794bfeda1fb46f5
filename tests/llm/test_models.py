"""Quality classifier, decontamination, and the pipeline against a slow version."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chromaloom.llm import decontaminate, exact_dedup, jaccard_join, quality
from chromaloom.llm.vectors import vector_sum


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


GOOD = "the good people of the town went to the market and bought bread and wine "
BAD = "zzq## xx$$ vvv%% qq!! kk&& "


def test_ngram_counts_stay_within_texts():
    texts = pa.array(["abcd", "", None, "abcdefgh", "ab", "éé"])
    total = np.zeros(quality.BUCKETS, np.int64)
    quality._add(pa.RecordBatch.from_arrays([texts], names=["t"]), total)
    assert total.sum() == 1 + 5 + 1 + 1  # four-grams of three texts and one eight-gram
    sums, n = quality.weights(np.ones(quality.BUCKETS), texts)
    assert n.tolist() == [1, 0, 0, 6, 0, 1] and sums.tolist() == [1, 0, 0, 6, 0, 1]
    part, m = quality.weights(np.ones(quality.BUCKETS), texts.slice(3, 2))
    assert m.tolist() == [6, 0] and part.tolist() == [6, 0]


def test_vector_sum(spark):
    def add(batch, total):
        np.add.at(total, batch.column(0).to_numpy() % 8192, 1)

    got = vector_sum(spark.range(20_000).repartition(7), add, 8192)
    assert got.sum() == 20_000 and got[0] == 3
    assert vector_sum(spark.range(0), add, 8192).sum() == 0


def test_quality_rejects_junk(spark, documents):
    rng = random.Random(1)
    mixed = lambda s: " ".join(rng.sample(s.split(), len(s.split())) * 3)
    rows = [(i, mixed(GOOD if i % 4 else BAD)) for i in range(400)] + [(None, mixed(GOOD)), (900, None), (901, ""), (902, "ab"), (5, rows0 := mixed(GOOD)), (5, rows0)]
    docs = documents(rows)
    model = quality.fit(spark, docs, labels(spark, [(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0), (3, None, None), (7777, 1, 0)]))
    got = quality.importance(spark, docs, model).toPandas()
    known = got[got.doc_id < 400]
    good = known.doc_id % 4 > 0
    assert known[good].selected.mean() > 0.99 and known[~good].selected.mean() < 0.02
    assert known[good].accepted.mean() > 0.99 and known[~good].accepted.mean() < 0.02
    assert len(got) == len(rows)
    k = int((got.weight >= model.threshold).sum())
    assert got.selected.sum() >= k and (got[got.selected].gumbel_key.min() > got[~got.selected].gumbel_key.max())
    kept = quality.selected(spark, docs, model)
    assert kept.columns == docs.columns and kept.count() == got.selected.sum()
    assert quality.classify(spark, docs, model).count() == got.accepted.sum()
    few = quality.importance(spark, docs, model, k=10).toPandas()
    assert few.selected.sum() == 10 and quality.selected(spark, docs, model, k=10).count() == 10


def slow_ratio(texts, target, share):
    """Log ratio of every n-gram, gram by gram."""

    def counts(of):
        out = {}
        for t in of:
            for g in slow_grams(t):
                out[g] = out.get(g, 0) + 1
        return out

    raw, tgt = counts(texts), counts(target)
    n, m = sum(raw.values()), sum(tgt.values())
    p = lambda g: (raw.get(g, 0) + 1) / (n + quality.BUCKETS)
    return lambda g: np.log(((1 - share) * tgt.get(g, 0) / m + share * p(g)) / p(g))


def slow_grams(text):
    """Buckets of the byte n-grams."""
    raw = text.encode()
    for order in quality.ORDERS:
        for i in range(len(raw) - order + 1):
            h = (int.from_bytes(raw[i : i + order], "little") + order) * 0x9E3779B97F4A7C15 % 2**64
            h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64
            yield h >> 64 - 17


def test_weights_match_brute_force(spark, documents):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["bread", "wine", "zq#", "éé", "a"]) for _ in range(rng.randrange(0, 12)))) for i in range(60)] + [(60, "wine " * 20_000)]
    docs = documents(rows)
    model = quality.fit(spark, docs, labels(spark, [(i, 1, 0) for i in range(60)]))
    half = {r.doc_id for r in docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id, {quality.SEED + 1}), 2) as half").filter("half = 0 and doc_id < 60").collect()}
    ratio = slow_ratio([t for _, t in rows], [t for i, t in rows if i in half], quality.MIXED)
    got = {r.doc_id: r.weight for r in quality.importance(spark, docs, model).collect()}
    for i, t in rows[:60]:
        assert got[i] == pytest.approx(sum(map(ratio, slow_grams(t))) / sum(quality.ORDERS), abs=1e-4)


def test_draws_are_in_proportion_to_the_weights(spark):
    """Shares of many draws of 2 of 5 against the exact chances of drawing
    without replacement in proportion to exp(weight)."""
    from itertools import permutations

    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    w, k, trials = [0.0, 0.5, 1.0, 2.0, -1.0], 2, 20_000
    want = np.zeros(5)
    for first in permutations(range(5), k):
        chance, left = 1.0, sum(np.exp(w))
        for i in first:
            chance *= np.exp(w[i]) / left
            left -= np.exp(w[i])
        want[list(first)] += chance
    rows = spark.range(trials).withColumnRenamed("id", "trial").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    key = F.element_at(F.array(*map(F.lit, w)), F.col("i") + 1) + quality.gumbel(F.col("i"), F.lit("t"), F.col("trial"))
    best = F.row_number().over(Window.partitionBy("trial").orderBy(key.desc()))
    got = rows.withColumn("place", best).filter(f"place <= {k}").groupBy("i").count().toPandas().set_index("i")["count"]
    assert np.allclose([got[i] / trials for i in range(5)], want, atol=0.015)


def test_quality_without_labels_or_rows(spark, documents):
    none = labels(spark, [])
    docs = documents([(1, "text of some length"), (2, None)])
    assert quality.importance(spark, docs, quality.fit(spark, docs, none)).filter("selected").count() == 2
    assert quality.importance(spark, documents([]), quality.fit(spark, documents([]), none)).count() == 0


@pytest.mark.parametrize("k", [0, 1, 7, 500, 1999, 2000])
def test_kth_largest(spark, k):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 1500), np.full(500, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    want = np.inf if k == 0 else np.sort(x)[::-1][k - 1]
    assert quality.kth_largest(df, "x", k, fit_in=20) == want


def test_threshold_weighs_good_documents():
    w = np.array([0.0, 1, 2, 3, 4])
    assert quality._threshold(w, np.array([False, False, True, True, True])) == 1.5
    assert quality._threshold(w, np.array([True] * 5)) == -np.inf


def test_held_out_quality(spark, sf_dir):
    """The classifier on the few labels of the middle tables, and the draw where
    there are enough; what is drawn isn't what lies above the threshold."""
    at = lambda sf, name: spark.read.parquet(f"{sf_dir.replace('sf0.001', sf)}/{name}.parquet")
    got = quality.op2_quality(spark, sf_dir.replace("sf0.001", "sf0.01")).toPandas()
    known = got.merge(at("sf0.01", "labels").toPandas(), on="doc_id")
    assert known[(known.quality == 1) & (known.toxic == 0)].accepted.mean() >= 0.98
    assert known[known.quality == 0].accepted.mean() <= 0.15
    model = quality.fit(spark, at("sf0.1", "documents"), at("sf0.1", "labels"))
    got = quality.importance(spark, at("sf0.1", "documents"), model).toPandas()
    known = got.merge(at("sf0.1", "labels").toPandas(), on="doc_id")
    assert known[(known.quality == 1) & (known.toxic == 0)].selected.mean() >= 0.98
    assert known[known.quality == 0].selected.mean() <= 0.15
    above = got.weight >= model.threshold
    assert got.selected.sum() == above.sum() and 0 < (got.selected != above).sum() < len(got) // 50


WORDS = ["the", "of", "and", "in", "to"] + [f"word{i}" for i in range(600)]


def passage(rng, n):
    return [rng.choice(WORDS[:5]) if rng.random() < 0.4 else rng.choice(WORDS) for _ in range(n)]


def changed(rng, words, share):
    return [rng.choice(WORDS) if rng.random() < share else w for w in words]


def test_leaks_match_brute_force(spark, documents):
    rng = random.Random(8)
    items = [(i, " ".join(passage(rng, rng.randrange(15, 60)))) for i in range(30)] + [(100, None), (101, "of the"), (102, ""), (103, "quixotic"), (104, "Hello, world")]
    rows = []
    for i in range(300):
        text = passage(rng, rng.randrange(5, 300))
        if i % 5 == 0:
            # a passage is held: whole, or with up to a fifth of its words changed
            item = items[rng.randrange(30)][1].split()
            at = rng.randrange(len(text))
            text[at:at] = changed(rng, item, rng.choice([0, 0.05, 0.1, 0.2]))
        rows.append((i, " ".join(text).capitalize() + "."))
    rows += [(1000, None), (1001, ""), (None, items[3][1]), (7, rows[7][1])]
    rows += [(2000, "He said hello world twice"), (2001, "world hello"), (2002, "a QUIXOTIC plan"), (2003, "hello big world"), (2004, "hello")]
    docs = documents(rows)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as score", "'x' as key")
    got = decontaminate.find_leaks(spark, docs, bench).toPandas()
    want = {(i, j) for i, t in rows for j, x in items if decontaminate.brute_force(t or "", x or "")}
    found = {(None if np.isnan(i) else int(i), j) for i, j in zip(got.doc_id, got.item_id)}
    grams = lambda t: {tuple(w[i : i + 3]) for w in [decontaminate.words(t or "")] for i in range(len(w) - 2)}
    held = Counter(g for _, x in items for g in grams(x))
    text, item = dict(rows), dict(items)
    # what is lost has no rare trigram of the item anywhere, and that is little
    assert found <= want and not [p for p in want - found if any(held[g] <= decontaminate.RARE for g in grams(text[p[0]]) & grams(item[p[1]]))]
    assert len(want - found) <= len(want) // 25
    assert {(2000, 104), (2002, 103)} <= found and not {(2001, 104), (2003, 104), (2004, 104)} & found
    assert {(None, 3)} <= found and not got.duplicated(["doc_id", "item_id"]).any()
    left = decontaminate.decontaminated(spark, docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, t in rows if (i, t) and not any(a == i and i is not None for a, _ in found) and i is not None)


def test_common_passages_are_found(spark, documents):
    """A leak that a third of all texts hold is not taken for common language."""
    rng = random.Random(4)
    item = passage(rng, 40)
    rows = [(i, " ".join(passage(rng, 60) + (changed(rng, item, 0.1) if i % 3 == 0 else []))) for i in range(240)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.find_leaks(spark, documents(rows), bench).collect()}
    assert got == {i for i in range(240) if i % 3 == 0}


def test_leaks_do_not_depend_on_corpus_size(spark, documents):
    """Edited passages that a third of the texts share are found, whatever their
    share of the item's trigrams and the number of other texts."""
    rng = random.Random(5)
    item = [f"item{i}" for i in range(59)]
    # four runs of three intact words, then runs of two: four of 57 trigrams
    edited = [f"other{i}" if (i < 16 and i % 4 == 3) or (i >= 16 and i % 3 == 0) else w for i, w in enumerate(item)]
    # runs of two alone: no seed
    paired = [f"other{i}" if i % 3 == 2 else w for i, w in enumerate(item)]
    rows = [(i, " ".join(passage(rng, 60) + (edited if i % 3 == 0 else item[:5] if i % 3 == 1 else []))) for i in range(240)] + [(1000, " ".join(paired))]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    want = {i for i, t in rows if decontaminate.brute_force(t, " ".join(item))}
    assert want == {i for i in range(240) if i % 3 == 0} | {1000}
    more = [(2000 + i, " ".join(passage(rng, 20))) for i in range(2000)]
    for docs in (rows, rows + more):
        got = {r.doc_id for r in decontaminate.find_leaks(spark, documents(docs), bench).collect()}
        # what no trigram points at is out of reach
        assert got == want - {1000}


def test_windows_are_not_bounded_too_low():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = rng.integers(0, 12, rng.integers(1, 20)), rng.integers(0, 30, rng.integers(0, 30))
        best = decontaminate.align(a, b)[0]
        assert best <= decontaminate.bound(np.isin(a, b)) and best <= decontaminate.bound(np.isin(b, a))


def test_no_leaks_in_nothing(spark, documents):
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    assert decontaminate.find_leaks(spark, documents([]), bench).count() == 0
    assert decontaminate.find_leaks(spark, documents([(1, "one two three four five")]), bench.limit(0)).count() == 0
    assert decontaminate.decontaminated(spark, documents([(1, "a b c")]), bench.limit(0)).count() == 1


def slow_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_score():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(0, 30))
        assert decontaminate.align(a, b)[0] == slow_align(a, b)
    assert decontaminate.align(np.arange(5), np.array([9, 0, 1, 2, 3, 4, 9])) == (10, 1, 6, 5)
    # gaps and mismatches inside; the passage starts at its first match
    assert decontaminate.align(np.arange(6), np.array([9, 9, 0, 1, 7, 3, 8, 4, 5, 9])) == (8, 2, 9, 5)


def test_passage_places(spark, documents):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    rows = [(1, "x alpha beta gamma delta epsilon zeta eta theta y"), (2, "one two three alpha beta OTHER delta epsilon zeta eta theta"), (3, "w " * 90_000 + "alpha beta gamma delta epsilon z")]
    got = {r.doc_id: (r.first_word, r.end_word) for r in decontaminate.find_leaks(spark, documents(rows), bench).collect()}
    assert got == {1: (1, 9), 2: (3, 11), 3: (90_000, 90_005)}


def test_common_phrases_are_no_seeds(spark, documents):
    """A phrase of many items joins no text with all of them; each item still is found."""
    items = [(i, f"which of the following is right about subject{i} and matter{i}") for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate._seeds(spark, bench.withColumn("text", bench.text)).count() < 60 * 8
    rows = [(i, f"So: {x}!") for i, x in items] + [(1000, "which of the following is right about nothing")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark, documents(rows), bench).filter("doc_id < 1000 and score > 0.9").collect()}
    assert {(i, i) for i, _ in items} <= got


def test_pipeline_matches_slow_stages(spark, sf_dir):
    import corpus_pipeline
    from chromaloom.llm import bpe
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    kept = corpus_pipeline.keep_quality(spark, docs, sf_dir).toPandas().sort_values("doc_id")
    kept = kept.assign(norm=kept.text.str.replace(r"[\x20\x09-\x0D]+", " ", regex=True)).drop_duplicates("norm")
    from test_dedup import slow_components

    comp = slow_components(list(zip(kept.doc_id, kept.text)), corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILARITY_PERCENT)
    kept = kept[[comp[i][1] == i for i in kept.doc_id]]
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas()
    kept = kept[[not any(decontaminate.brute_force(t, x) for x in items.text) for t in kept.text]]
    tok = Tokenizer.from_file(bpe.default_path())
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in zip(kept.doc_id, kept.text)}
    assert dict(zip(got.doc_id, got.n_tokens)) == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "jaccard_dedup", "decontaminate", "bpe"]


def test_stages_keep_columns(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, sf_dir).columns == docs.columns


def test_filters_are_exact_and_jaccard(spark, documents):
    rows = [(2, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k l"), (3, "a b c d e f g h i j k l m"), (4, "z")]
    docs = documents(rows)
    assert sorted(r.doc_id for r in exact_dedup.deduplicated(spark, docs).collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in jaccard_join.deduplicated(spark, docs, 5, 80).collect()) == [1, 4]


def test_pipeline_on_odd_tables(spark, documents, write_tables):
    """Nulls, empty and very long texts, copies, and no rows at all."""
    import corpus_pipeline

    long = " ".join(f"w{i % 9973}" for i in range(60_000))
    rows = [(1, None), (None, None), (2, ""), (3, long), (4, long + " end"), (5, long), (None, "a text without id"), (6, "a short text"), (6, "a short text"), (7, "holds one two three four five six indeed")]
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, None), (None, "")], "item_id long, text string")
    to = write_tables(documents=documents(rows), benchmark=bench, labels=labels(spark, [(None, 1, 0), (6, None, None)]))
    got = sorted(((r.doc_id or 0), r.n_tokens > 0) for r in corpus_pipeline.run(spark, to).collect())
    assert got == [(0, True), (1, False), (3, True), (6, True)]
    none = write_tables(documents=documents([]), benchmark=bench, labels=labels(spark, []))
    assert corpus_pipeline.run(spark, none).count() == 0
