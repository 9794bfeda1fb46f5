import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chromaloom.operators import kernels
from chromaloom.operators.clustering import KERNELS

NOISE = np.random.default_rng(11).integers(0, 256, (900, 3))


def histogram(pixels):
    colours, n = np.unique(pixels, axis=0, return_counts=True)
    return colours.astype(np.int64), n.astype(np.float64)


@pytest.mark.parametrize("name", KERNELS)
def test_solid_colour_is_exact(name):
    colours, mass = KERNELS[name][0](np.array([[18, 52, 86]]), np.array([9216.0]), 5)
    assert np.rint(colours).tolist() == [[18, 52, 86]]
    assert mass.tolist() == [9216.0] if name != "hsv_octree" else len(mass) == 1


@pytest.mark.parametrize("name", KERNELS)
@pytest.mark.parametrize("k", [1, 3, 5, 16])
def test_noise_gives_at_most_k(name, k):
    rgb, n = histogram(NOISE)
    colours, mass = KERNELS[name][0](rgb, n, k)
    assert 1 <= len(colours) <= k and len(colours) == len(mass)
    assert (np.diff(mass) <= 1e-9).all()
    if name in ("pixelero_rgb_hist", "liq_like", "oklab_kmeans") and k == 5:
        assert len(colours) == 5
    if name != "hsv_octree" and name != "pixelero_hsv_cluster":
        assert mass.sum() == pytest.approx(n.sum())


@pytest.mark.parametrize("name", KERNELS)
def test_order_of_pixels_is_free(name):
    a = KERNELS[name][0](*histogram(NOISE), 5)
    b = KERNELS[name][0](*histogram(NOISE[::-1]), 5)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def slow_centres(values, mass, k):
    held = np.bincount(values, mass, 256)
    c = np.linspace(0, 255, k)
    for _ in range(32):
        near = [min(range(k), key=lambda i: (abs(v - c[i]), i)) for v in range(256)]
        new = c.copy()
        for i in range(k):
            rows = [v for v in range(256) if near[v] == i]
            if sum(held[rows]) > 0:
                new[i] = sum(v * held[v] for v in rows) / sum(held[rows])
        new.sort()
        if np.abs(new - c).max() < 1e-7:
            return new
        c = new
    return c


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=9, max_size=60, unique=True), st.integers(2, 8))
def test_channel_centres_match_plain_steps(values, k):
    v = np.array(values)
    mass = (v % 7 + 1).astype(float)
    assert np.allclose(kernels.channel_centres(v, mass, k), slow_centres(v, mass, k))


def test_few_channel_values_are_their_own_centres():
    assert kernels.channel_centres(np.array([3, 200, 3]), np.array([1.0, 2.0, 1.0]), 8).tolist() == [3, 200]
    assert kernels.channel_centres(np.array([], int), np.array([]), 8).tolist() == [0]


def test_kmeans_without_points_is_black():
    colours, mass = kernels.kmeans(np.zeros((0, 3)), np.zeros(0), 5)
    assert colours.tolist() == [[0, 0, 0]] and mass.tolist() == [1]


def test_median_cut_separates_two_groups():
    rgb = np.array([[10, 10, 10], [12, 10, 10], [240, 10, 10], [242, 10, 10]])
    colours, mass = kernels.quantise(rgb, np.array([5.0, 5.0, 5.0, 5.0]), 2)
    assert sorted(int(c[0]) > 100 for c in colours) == [False, True] and mass.tolist() == [10, 10]


def test_feedback_does_not_lose_mass():
    rgb, n = histogram(NOISE)
    _, mass = kernels.quantise(rgb, n, 5, feedback=3)
    assert mass.sum() == n.sum()


def test_oklab_round_trip():
    rgb = np.stack(np.meshgrid(*[np.arange(0, 256, 51)] * 3), -1).reshape(-1, 3)
    assert np.array_equal(kernels.from_oklab(kernels.oklab(rgb)), rgb)


def test_harmonise_moves_outliers_to_the_slack():
    lab = np.array([[0.1, 0.1, 0], [0.3, 0.1, 0], [0.9, 0.1, 0], [0.5, 0.6, 0]])
    moved = kernels.harmonise(lab)
    assert moved[3, 1] < lab[3, 1] and np.allclose(kernels.harmonise(lab[:2]), lab[:2])


def test_salient_palette_of_a_flat_image_is_one_colour():
    x, y = (a.ravel() for a in np.meshgrid(np.arange(96), np.arange(96)))
    colours, weight = kernels.salient(np.tile([10, 90, 150], (96 * 96, 1)), x, y, 5)
    assert colours.tolist() == [[10, 90, 150]] and len(weight) == 1


def test_best_cut_matches_all_cuts():
    """The first cut is the one of all that leaves least variance on both sides."""
    rng = np.random.default_rng(7)
    for _ in range(30):
        p, w = rng.integers(0, 9, (12, 3)) / 8, rng.random(12) + 0.1

        def left(rows):
            return float((w[rows][:, None] * (p[rows] - np.average(p[rows], axis=0, weights=w[rows])) ** 2 @ kernels.IMPORTANCE).sum()) if len(rows) else 0.0

        every = np.arange(12)
        best = max(left(every) - left(every[p[:, c] <= v]) - left(every[p[:, c] > v]) for c in range(3) for v in p[:, c])
        gain, above = kernels._halves(p, w)
        assert abs(gain - best) < 1e-9 and abs(left(every) - left(every[above]) - left(every[~above]) - gain) < 1e-9


def test_regions_are_local_and_near():
    """Each pixel has the nearest of the centres around it, also on large crops."""
    import time

    x, y = (a.ravel() for a in np.meshgrid(np.arange(320), np.arange(320)))
    rgb = np.where((x < 160)[:, None], [200, 30, 30], [30, 30, 200])
    start = time.time()
    colours, _ = kernels.salient(rgb, x, y, 5)
    assert time.time() - start < 10 and sorted(colours.tolist()) == [[30, 30, 200], [200, 30, 30]]
    assert len(kernels.shrunk(x, y)) == 256 * 256 and len(kernels.shrunk(x[:50], y[:50])) == 50
    label = kernels.superpixels(kernels.oklab(rgb), x, y, 64)
    assert len(np.unique(label)) == 64 and all(len(np.unique(x[label == i] < 160)) == 1 for i in np.unique(label))


def test_transparent_pixels_are_not_salient(spark):
    from chromaloom.operators import methods

    rows = [(1, i, i % 40, i // 40, *((250, 10, 10, 0) if i % 40 < 10 else (10, 90, 150, 255))) for i in range(1600)]
    px = spark.createDataFrame(rows, "crop_id int, idx int, x int, y int, r int, g int, b int, a int")
    assert [(p.r, p.g, p.b) for p in methods.extract(px, "colorpipette_inspired").collect()] == [(10, 90, 150)]
