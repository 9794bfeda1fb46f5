"""Behaviour on small images, boxes, manifests and plans."""

import json
import struct
import zlib

import numpy as np
import pytest

from chromaloom.functions import color
from chromaloom.operators import adaptive, clustering, histogram, hsv, observed, ordering, roi, sampling, summary
from chromaloom.sources import images, manifests, scene


def pixels(spark, image, crop="c"):
    image = np.asarray(image)
    h, w, n = image.shape
    rows = [(crop, y * w + x, x, y, *map(int, image[y, x][:3]), int(image[y, x][3]) if n == 4 else 255) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "crop_id string, idx int, x int, y int, r int, g int, b int, a int")


def run_adaptive(px):
    vis = scene.visible(px)
    return adaptive.adaptive(px, vis, histogram.exact(vis)).toPandas().iloc[0]


def test_solid_image_is_flat(spark):
    got = run_adaptive(pixels(spark, np.full((24, 24, 3), (18, 52, 86))))
    assert got.route == "flat" and tuple(got.primary) == (18, 52, 86) and got.confidence == 1.0


def test_gradient_has_observed_stops(spark):
    at = np.linspace(0, 1, 48)[None, :, None]
    image = np.floor(np.array([20, 50, 170]) * (1 - at) + np.array([240, 180, 40]) * at).astype(int).repeat(48, axis=0)
    got = run_adaptive(pixels(spark, image))
    known = {tuple(p) for p in image.reshape(-1, 3).tolist()}
    assert got.route == "gradient" and len(got.palette) >= 3 and all(tuple(c) in known for c in got.palette)


def test_transparent_pixels_do_not_count(spark):
    image = np.zeros((32, 32, 4), int)
    image[...] = (255, 0, 255, 0)
    image[8:24, 8:24] = (92, 211, 142, 255)
    px = pixels(spark, image)
    assert tuple(run_adaptive(px).primary) == (92, 211, 142)
    hist = histogram.exact(scene.visible(px))
    for name in clustering.KERNELS:
        got = clustering.cluster(hist, name).toPandas()
        assert got[["r", "g", "b"]].values.tolist() == [[92, 211, 142]], name


def test_wholly_transparent_crop_counts_all(spark):
    px = pixels(spark, np.full((4, 4, 4), (9, 8, 7, 0)))
    assert histogram.exact(scene.visible(px)).first().mass == 16


def test_grey_image_takes_the_achromatic_route(spark):
    got = hsv.dominant(histogram.exact(scene.visible(pixels(spark, np.full((16, 16, 3), 128))))).first()
    assert got.route == "achromatic" and (got.r, got.g, got.b) == (128, 128, 128)


def test_two_colour_box_is_pruned_to_one(spark):
    image = np.full((1, 1000, 3), (200, 30, 30))
    image[0, :5] = (10, 10, 240)
    px = pixels(spark, image).withColumnRenamed("crop_id", "path")
    boxes = spark.createDataFrame([("c", 0, 0, 0, 1000, 1, 1000, 1), ("c", 1, 2000, 0, 2100, 1, 1000, 1)], "path string, box_index int, l int, t int, r int, b int, width int, height int")
    for method in roi.METHODS:
        got = roi.box_palettes(px, boxes, method).toPandas()
        assert got[["path", "box_index", "r", "g", "b"]].values.tolist() == [["c", 0, 200, 30, 30]], method
    with pytest.raises(ValueError):
        roi.box_palettes(px, boxes, "none")


def test_box_methods_by_long_name():
    for name, kernel in (("pngquant_liq_speed7_observed_pruned", "liq_like"), ("octree_observed_pruned", "octree"), ("hsv_pixelero", "hsv_pixelero_kmeans")):
        assert roi.kernel_of(name) == kernel
    for wrong in ("pngquant_liq_speed11_observed_pruned", "pngquant_liq_speed0_observed_pruned", "octree_pruned", "pngquant_liq_speed_observed_pruned"):
        with pytest.raises(ValueError):
            roi.kernel_of(wrong)


def test_shrunk_sizes(spark):
    sizes = spark.createDataFrame([(200, 5000), (256, 256), (512, 300), (300, 1000), (257, 257)], "w int, h int")
    got = sizes.select(*sampling.shrunk_size(sizes.w, sizes.h)).collect()
    assert [tuple(r) for r in got] == [(200, 5000), (256, 256), (448, 256), (256, 864), (256, 256)]


def test_record_without_palette_shows_the_primary(spark):
    entry = "struct<r:int,g:int,b:int>"
    rows = spark.createDataFrame([(1, "flat", (1, 2, 255), [], [], 0.12345678, True, 0.3333333)], f"crop_id int, route string, primary {entry}, palette array<{entry}>, weights array<double>, confidence double, observed boolean, spread double")
    got = summary.record(rows, "octree").first()
    assert got.palette_rgb == [[1, 2, 255]] and got.palette_hex == ["#0102FF"] == [got.hex] and got.confidence == 0.123457 and got.diagnostics == {"spread": 0.333333}


def test_picks_are_not_reused(spark):
    hist = spark.createDataFrame([(1, 10, 10, 10, 657930, 9.0, 9, 0), (1, 250, 250, 250, 16448250, 1.0, 1, 1)], "crop_id int, r int, g int, b int, rgb24 int, mass double, n long, min_idx int")
    palette = spark.createDataFrame([(1, 1, 11, 11, 11, 0.6), (1, 2, 12, 12, 12, 0.4), (1, 3, 9, 9, 9, 0.3)], "crop_id int, rank int, r int, g int, b int, weight double")
    assert [(x.rank, x.r) for x in sorted(observed.remap_nearest(palette, hist).collect(), key=lambda x: x.rank)] == [(1, 10), (2, 250)]
    assert [(x.rank, x.r) for x in sorted(observed.remap_all(palette, hist).collect(), key=lambda x: x.rank)] == [(1, 10), (2, 250), (3, 10)]


def test_prefix_sums(spark):
    df = spark.createDataFrame([(i * i, i) for i in range(200)], "k int, v int")
    got = {r.k: (r.position, r.position_total) for r in ordering.with_prefix(df, "k", "v").collect()}
    assert got == {i * i: (i * (i - 1) // 2, 19900) for i in range(200)}
    assert ordering.with_prefix(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("n, count", [(5, 10), (101, 10), (1000, 7), (3, 1)])
def test_display_ids_are_even(spark, n, count):
    got = sorted(r[0] for r in sampling.display_ids(spark.range(n).withColumnRenamed("id", "crop_id"), count).collect())
    k = max(1, min(count, n))
    assert got == sorted({int(np.rint(i * (n - 1) / max(k - 1, 1))) for i in range(k)})


def test_grid_fits_the_budget(spark):
    boxes = spark.createDataFrame([("p", i, 0, 0, w, h) for i, (w, h) in enumerate([(3, 2), (300, 20), (7, 900), (640, 480), (1, 5000)])], "path string, box_index int, l int, t int, r int, b int")
    got = sampling.grid(boxes, 256).toPandas()
    for i, (w, h) in enumerate([(3, 2), (300, 20), (7, 900), (640, 480), (1, 5000)]):
        part = got[got.box_index == i]
        assert len(part) == w * h if w * h <= 256 else len(part) <= 256
        assert part.x.max() in (0, w - 1) and part.y.max() in (0, h - 1) and not part.duplicated(["x", "y"]).any()


def test_capacity_golden_numbers(spark):
    required, provisioned = summary.capacity_target(100_000_000_000, 3, 1.5)
    assert required == pytest.approx(385_802.469135) and provisioned == pytest.approx(578_703.703703)
    plan = summary.capacity(spark)
    got = {r.days: r for r in plan.collect()}
    assert [got[d].fused_workers for d in (3, 7, 15)] == [58, 25, 12]
    assert got[3].images_s == pytest.approx(19_290.12, abs=0.01) and got[3].decoded_gb_s == pytest.approx(57.87, abs=0.01)
    need = {(r.days, r.method): r.processes for r in summary.scenarios(plan, summary.rates_of(spark, {"fast": 105.089, "slow": 1.913887})).collect()}
    assert need[3, "fast"] == 5507 and need[15, "slow"] == 60475
    with pytest.raises(ValueError):
        summary.capacity_target(0, 3, 1.5)


def test_page_bounds(spark):
    df = spark.range(25)
    assert [r.id for r in summary.page(df, [df.id.desc()], 10, 2).collect()] == [4, 3, 2, 1, 0]
    with pytest.raises(ValueError):
        summary.page(df, [df.id], 0, 0)


def png(path, image):
    image = np.asarray(image, np.uint8)
    h, w = image.shape[:2]
    kind = {2: 0, 3: {3: 2, 4: 6}.get(image.shape[-1])}[image.ndim]
    raw = b"".join(b"\0" + image[y].tobytes() for y in range(h))
    part = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_png_round_trip(spark, tmp_path):
    rng = np.random.default_rng(3)
    (tmp_path / "sub").mkdir()
    made = {"a.png": rng.integers(0, 256, (9, 14, 3)), "sub/b.png": rng.integers(0, 256, (5, 7, 4)), "c.png": rng.integers(0, 256, (6, 6))}
    for name, image in made.items():
        png(tmp_path / name, image)
    (tmp_path / "broken.png").write_bytes(b"no image")
    got = images.to_pixels(images.read_images(spark, str(tmp_path))).toPandas()
    assert got.crop_id.nunique() == 3
    for name, image in made.items():
        part = got[got.crop_id.str.endswith("/" + name)].sort_values("idx")
        want = image if image.ndim == 3 else np.repeat(image[..., None], 3, axis=2)
        assert np.array_equal(part[["r", "g", "b"]].values, want[..., :3].reshape(-1, 3)), name
        assert np.array_equal(part.a.values, want[..., 3].ravel() if want.shape[2] == 4 else np.full(len(part), 255))
    paths = spark.createDataFrame([("/x/a.PNG",), ("/x/a.PNG",), ("/x/b.txt",), ("/w/c.webp",)], "path string")
    assert [r.path for r in images.expand_inputs(paths).collect()] == ["/w/c.webp", "/x/a.PNG"]


def test_manifests(spark, tmp_path):
    records = [{"path": "i.png", "bboxes_xyxy": [[0, 0, 4, 4], [1, 1, 2, 2]]}]
    for body in ({"records": records}, records):
        (tmp_path / "m.json").write_text(json.dumps(body))
        got = manifests.roi_boxes(spark, str(tmp_path / "m.json"), "/root").collect()
        assert [tuple(r) for r in got] == [("/root/i.png", 0, 0, 0, 4, 4), ("/root/i.png", 1, 1, 1, 2, 2)]
    (tmp_path / "s.json").write_text(json.dumps({"samples": [{"file": "a.jpg", "variant": "center", "batch": "7"}, {"file": "b.jpg"}]}))
    got = manifests.source_manifest(spark, str(tmp_path / "s.json")).toPandas()
    assert len(got) == 4 and set(got.batch) == {"7", "unknown"}
    files = manifests.source_files(spark.createDataFrame([("/p/b12_x.jpg",), ("/p/n.png",)], "path string")).toPandas()
    assert len(files) == 3 and set(files.batch) == {"12"}
    crop = manifests.crop_geometry(spark.createDataFrame([("center", 480, 360)], "variant string, width int, height int")).first()
    assert (crop.side, crop.left, crop.top) == (173, 154, 94)
    boxes = manifests.hashed_boxes(spark.createDataFrame([("p", 320, 240)], "path string, width int, height int")).toPandas()
    assert len(boxes) == 20 and (boxes.l >= 0).all() and (boxes.r <= 320).all() and (boxes.b <= 240).all() and ((boxes.r - boxes.l) >= 48).all()


def test_checkpoint_tolerates_only_a_broken_end(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    f.write_text('{"crop_id": "a"}\n\n{"crop_id": "b"}\n{"crop_i')
    assert [r.crop_id for r in manifests.checkpoint_rows(spark, str(f), "crop_id string").collect()] == ["a", "b"]
    f.write_text('{"crop_id": "a"}\n{"crop_i\n{"crop_id": "b"}\n')
    with pytest.raises(ValueError):
        manifests.checkpoint_rows(spark, str(f), "crop_id string")


def test_streaming_resumes(spark, tmp_path):
    from chromaloom.streaming import annotate

    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for i, c in enumerate([(26, 43, 60), (200, 10, 30)]):
        px = pixels(spark, np.full((16, 16, 3), c), f"crop{i}")
        px.coalesce(1).write.mode("append").parquet(src)
        annotate.run(spark, src, out, mark).awaitTermination()
        got = spark.read.parquet(out)
        assert sorted(r.hex for r in got.collect()) == ["#1A2B3C", "#C80A1E"][: i + 1]


def test_compact_schema(spark):
    px = pixels(spark, np.full((16, 16, 3), (26, 43, 60)), "7")
    from chromaloom.streaming.annotate import annotate

    got = annotate(px)
    assert got.columns == ["schema_version", "id", "rgb24", "hex", "method_id", "method", "route", "confidence", "palette_rgb24", "palette_weight_u16", "observed"]
    row = got.first()
    assert (row.hex, row.method_id, row.palette_weight_u16) == ("#1A2B3C", 1, [65535])


def test_rounding_and_parsing(spark):
    df = spark.createDataFrame([(2.5, "#0A0b0C"), (3.5, "zz"), (-4.0, None), (300.0, "FFFFFF")], "x double, h string")
    got = df.select(color.channel("x").alias("c"), color.parse_hex("h").alias("p")).collect()
    assert [r.c for r in got] == [2, 4, 0, 255] and [r.p for r in got] == [0x0A0B0C, None, None, 0xFFFFFF]
    with pytest.raises(ValueError):
        clustering.cluster(df, "none")


def test_coverage_takes_whole_crops(spark, sf_dir):
    from chromaloom.plans import registry

    every = {(r.crop_id, r.idx) for r in scene.visible(scene.scene(spark, sf_dir)).select("crop_id", "idx").collect()}
    got = [(r.crop_id, r.idx) for r in registry.QUERIES["coverage_sample_4096"](spark, sf_dir).collect()]
    assert len(got) == len(every) and set(got) == every


def test_coverage_sample_of_larger_crops(spark):
    sizes = {1: 1, 2: 16, 3: 17, 4: 50, 5: 333}
    px = spark.createDataFrame([(c, 10 * i) for c, n in sizes.items() for i in range(n)], "crop_id int, idx int")
    got = {(r.crop_id, r.idx) for r in sampling.coverage_sample(px, 16).collect()}
    places = {c: range(n) if n <= 16 else [i * (n - 1) // 15 for i in range(16)] for c, n in sizes.items()}
    assert got == {(c, 10 * p) for c, at in places.items() for p in at}
