"""Exact dedup, Bloom filter, components and the Jaccard join against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest

from chromaloom.llm import bloom, exact_dedup, jaccard_join
from chromaloom.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def test_bloom_finds_every_key_and_few_others(spark):
    keys = spark.range(5000).selectExpr("id * 7 as k").union(spark.range(0, 100).selectExpr("id * 7 as k"))
    for repeated, inside in ((False, 5000), (True, 100)):
        bits, held = bloom.build(spark, keys.repartition(7), 5100, repeated)
        asked = spark.range(0, 70_000).withColumnRenamed("id", "k")
        got = {r.k for r in asked.filter(bloom.might_contain("k", bits, held)).collect()}
        assert {i * 7 for i in range(inside)} <= got and len(got) < inside + 700


def test_bloom_of_nothing(spark):
    bits, held = bloom.build(spark, spark.range(0).withColumnRenamed("id", "k"), 0, True)
    assert spark.range(10).withColumnRenamed("id", "k").filter(bloom.might_contain("k", bits, held)).count() == 0


def test_saturated_bloom_still_holds_all(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MAX_BITS", bloom.PAGE)
    monkeypatch.setattr(bloom, "MIN_BITS", bloom.PAGE)
    keys = spark.range(60_000).withColumnRenamed("id", "k")
    bits, held = bloom.build(spark, keys, 60_000, False)
    assert bits == (bloom.PAGE, 1) and keys.filter(~bloom.might_contain("k", bits, held)).count() == 0


def test_blocks_of_the_hash_space(spark, documents, monkeypatch):
    """More rows than one filter serves: blocks, and the same groups."""
    rows = [(i, f"text {i}") for i in range(9000)] + [(20_000 + i, f"text {i}") for i in range(0, 9000, 90)]
    docs = documents(rows)
    want = sorted(map(str, exact_dedup.duplicate_groups(spark, docs).collect()))
    monkeypatch.setattr(bloom, "MAX_BITS", bloom.PAGE // 4 * 4)
    monkeypatch.setattr(bloom, "MIN_BITS", bloom.PAGE)
    assert bloom.blocks(len(rows)) == 2
    digests = docs.selectExpr("doc_id", "xxhash64(text) as h")
    shuffled = exact_dedup._tested(spark, digests).filter("again").count()
    assert 200 <= shuffled < len(rows) // 3
    assert want == sorted(map(str, exact_dedup.duplicate_groups(spark, docs).collect()))
    assert exact_dedup.deduplicated(spark, docs).count() == 9000


def test_filters_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(bloom, "CHUNK", 64)
    keys = spark.range(6000).selectExpr("id % 5000 as k")
    shape, held = bloom.build(spark, keys.repartition(3), 6000, True)
    got = {r.k for r in spark.range(6000).withColumnRenamed("id", "k").filter(bloom.might_contain("k", shape, held)).collect()}
    assert set(range(1000)) <= got and len(got) < 1300


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5200)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.id: r.component for r in components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[x] == find(x) for x in got) and {x for x in parent if find(x) != x} <= set(got)
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


EDGE = [(5, "a  b\tc"), (3, "a b c"), (9, "a b c "), (4, None), (2, ""), (8, " "), (3, "a b c"), (None, "a b c"), (None, "alone"), (1, "x" * 100_000), (6, "x" * 100_000), (7, "ü\x85y\n")]


def slow_groups(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        ids = [j for (j, _), m in zip(rows, norm) if m == n]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(map(repr, out))


def test_exact_groups_match_brute_force(spark, documents):
    got = exact_dedup.duplicate_groups(spark, documents(EDGE)).collect()
    assert sorted(repr(tuple(r)) for r in got) == slow_groups(EDGE)
    assert exact_dedup.duplicate_groups(spark, documents([])).count() == 0


def test_deduplicated_keeps_one_row_and_all_columns(spark, documents):
    docs = documents(EDGE)
    got = exact_dedup.deduplicated(spark, docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in got.collect()) == [(0, 5), (1, 100_000), (2, 0), (3, 5), (7, 4), (8, 1), (9, 6)]


def test_op9_sql(spark, sf_dir, duck):
    from compare import assert_same

    assert_same(exact_dedup.op9_exact_dedup(spark, sf_dir).toPandas(), duck.sql(exact_dedup.OP9_SQL).df())


def slow_components(rows, size, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(WORDS)
    return out


@pytest.mark.parametrize("size, percent, seed", [(4, 85, 1), (4, 85, 2), (5, 80, 3), (2, 50, 4), (1, 95, 5)])
def test_jaccard_components_match_brute_force(spark, documents, size, percent, seed):
    """Sizes from nothing to hundreds of words, pairs on both sides of the bound."""
    rng = random.Random(seed)
    rows = [(1000, None), (1001, ""), (1002, " \t"), (1003, "One"), (1004, "one"), (1005, "two words"), (1006, "Two\nwords"), (1007, "É é"), (1008, "é é")]
    for n in (4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 26, 34, 45, 60, 90, 150, 260, 420):
        base = [rng.choice(WORDS) for _ in range(n)]
        for _ in range(7):
            rows.append((len(rows), " ".join(edited(rng, base, rng.randrange(0, 2 + n // 30)))))
        rows.append((len(rows), " ".join(base[: max(1, n - 1 - n // 12)])))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark, documents(rows), size, percent).collect()}
    assert got == slow_components(rows, size, percent)


def test_chain_and_large_group_of_near_copies(spark, documents, monkeypatch):
    """Links that the first partner doesn't show, in blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(9)
    base = [rng.choice(WORDS) for _ in range(120)]
    rows, cur = [], base
    for i in range(40):
        rows.append((i, " ".join(cur)))
        cur = edited(rng, cur, 1)
    for i in range(100, 160):
        rows.append((i, " ".join(edited(rng, base, rng.randrange(1, 6)))))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark, documents(rows)).collect()}
    assert got == slow_components(rows, 4, 85)


def test_jaccard_edge_cases(spark, documents):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark, documents(rows)).collect())
    assert got == [("1", 3, 1), ("1", 3, 1), ("2", 3, 1), ("3", 0, 3), ("None", 3, None)]
    assert jaccard_join.jaccard_components(spark, documents([])).count() == 0
    kept = jaccard_join.deduplicated(spark, documents(rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "3", "None"] and "shard" in kept.columns


def test_sketch_bounds_the_symmetric_difference():
    rng = np.random.default_rng(1)
    for n in (8, 40, 200, 900):
        band = jaccard_join._band_of(n, 85)
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[: int(n * 0.9)], rng.integers(0, 1 << 60, n // 10).astype(np.uint64)]))
            fa, fb = (sketch(x, band, 85)[2] for x in (a, b))
            assert np.bitwise_count(fa ^ fb).sum() <= len(np.setxor1d(a, b))


def sketch(shingles, band, percent):
    """(keys, tags, small sketch) of one set, cut among others."""
    others = [np.arange(5, dtype=np.uint64), shingles, np.arange(20, dtype=np.uint64)]
    of, keys, tags, folds = jaccard_join.sketches(others, band, percent)
    return keys[of == 1], tags[of == 1], folds[1]


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_linked_sets_share_a_piece(percent):
    """Sets that just link keep a common key, whichever keys are most frequent."""
    rng = np.random.default_rng(percent)
    kept = lambda k, t, order: {x for f in set(t) for x in sorted(k[t == f], key=lambda x: order[x])[f & 0xFFFF :]}
    for n in (3, 6, 7, 9, 12, 14, 20, 33, 50, 90, 170, 400):
        for _ in range(60):
            band = jaccard_join._band_of(n, percent)
            b = jaccard_join.bands(percent)[band]
            m = int(rng.integers(n, n * 100 // percent + 1))
            both = -(-(n + m) * percent // (100 + percent))
            if not b.pieces or both > n:
                continue
            pool = rng.integers(0, 1 << 62, n + m).astype(np.uint64)
            x, y = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : n + m - both]]))
            assert 100 * both >= percent * (n + m - both)
            (kx, tx, _), (ky, ty, _) = (sketch(v, band, percent) for v in (x, y))
            # the keys that both have are the hottest, in any order
            order = {k: rng.random() - (k in set(kx) & set(ky)) for k in {*kx, *ky}}
            assert kept(kx, tx, order) & kept(ky, ty, order)


@pytest.mark.parametrize("percent, n", [(85, 8), (85, 14), (85, 50), (80, 14), (80, 200)])
def test_unrelated_sets_share_no_piece(percent, n):
    """However many there are: no key says that a piece is empty."""
    rng = np.random.default_rng(n)
    band = jaccard_join._band_of(n, percent)
    keys = [set(sketch(np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)), band, percent)[0].tolist()) for _ in range(1500)]
    assert sum(map(len, keys)) == len(set().union(*keys))


def test_sets_that_need_further_functions(monkeypatch):
    """Also where no function serves: all pieces of the last one count."""
    rng = np.random.default_rng(4)
    tried = set()
    for most in (jaccard_join.FUNCTIONS, 2, 1):
        monkeypatch.setattr(jaccard_join, "FUNCTIONS", most)
        for n in [*range(7, 60)] * 8:
            x = np.sort(rng.integers(0, 1 << 62, n).astype(np.uint64))
            y = np.sort(np.concatenate([x[1:], rng.integers(0, 1 << 62, 1).astype(np.uint64)]))
            (kx, tx, _), (ky, _, _) = (sketch(v, jaccard_join._band_of(n, 80), 80) for v in (x, y))
            tried.add((most, len(set(tx >> 16))))
            assert set(kx) & set(ky)
    assert (12, 2) in tried


def test_hot_passages_do_not_hide_links(spark, documents, monkeypatch):
    """A passage that most texts share makes hot pieces; links are found without."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(12)
    passage = [rng.choice(WORDS) for _ in range(50)]
    rows = []
    for i in range(150):
        own = [rng.choice(WORDS) for _ in range(rng.randrange(20, 60))]
        rows.append((10 * i, " ".join(passage + own)))
        if i % 5 == 0:
            rows.append((10 * i + 1, " ".join(edited(rng, passage + own, 1))))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark, documents(rows)).collect()}
    assert got == slow_components(rows, 4, 85)
