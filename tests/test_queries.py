import re

import pytest
from compare import assert_same

import __spark_entry__ as entry
from chromaloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(name, spark, sf_dir, duck):
    assert_same(registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_kernel_query_properties(name, spark, sf_dir):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got)
    if name == "shared_channel_centres":
        assert got.centres.map(len).eq(3).all()
        return
    assert got.groupby("crop_id")["rank"].count().between(1, 5).all()
    assert ((got[["r", "g", "b"]] >= 0) & (got[["r", "g", "b"]] <= 255)).all().all()
    total = got.groupby("crop_id").weight.sum()
    assert (total <= 1 + 1e-9).all()
    if name.endswith("_observed"):
        seen = registry.QUERIES["exact_colour_histogram"](spark, sf_dir).toPandas()
        known = set(zip(seen.crop_id, seen.rgb24))
        assert all((c, r * 65536 + g * 256 + b) in known for c, r, g, b in zip(got.crop_id, got.r, got.g, got.b))


def test_partitioning_does_not_change_results(spark, sf_dir):
    from chromaloom.operators import adaptive, histogram
    from chromaloom.sources import scene

    px = scene.scene(spark, sf_dir)
    out = []
    for n in (1, 7):
        p = px.repartition(n, "idx")
        vis = scene.visible(p)
        r = adaptive.adaptive(p, vis, histogram.exact(vis))
        out.append(registry._flat(r).toPandas())
    assert_same(*out)


def test_entry_and_registration(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_compact_numbers_round_as_sql(spark, tmp_path):
    """By the binary value: 1.15 lies below its tie, 1.25 on it."""
    import duckdb

    con, f = duckdb.connect(), str(tmp_path / "events.parquet")
    con.sql(f"copy (select i as event_id, case when i < 120000 then i when i < 121000 then 9223372036854775 - i else i * i * i + 50 end as user_id, 'view' as event_type, 1e0 as value from range(122000) t(i)) to '{f}'")
    con.sql(f"create view events as select * from '{f}'")
    got = registry.QUERIES["compact_numbers"](spark, str(tmp_path)).toPandas()
    assert_same(got, con.sql(registry.ORACLES["compact_numbers"]).df())
    assert got.set_index("event_id").text[[1050, 1150, 1250, 1750, 1950, 99950]].tolist() == ["1.1M", "1.1M", "1.2M", "1.8M", "1.9M", "100.0M"]


def test_box_points_are_merged(spark, sf_dir):
    """By the boxes' size the points look few; gathered in the driver, they aren't."""
    plan = registry.QUERIES["roi_samples"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[path#\d+, x#\d+, y#\d+\]", plan)


@pytest.mark.parametrize("name", ["roi_observed_palettes", "roi_nested_palettes"])
def test_box_pixels_are_sampled_once(name, spark, sf_dir):
    got = registry.QUERIES[name](spark, sf_dir)
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"SortMergeJoin \[path#\d+, x#\d+, y#\d+\]", final)) == 1


def test_weights_of_many_boxes(spark, sf_dir, tmp_path):
    import duckdb

    con, f = duckdb.connect(), str(tmp_path / "customer.parquet")
    con.sql(f"copy (select range as c_custkey from range(20000)) to '{f}'")
    (tmp_path / "lineitem.parquet").symlink_to(f"{sf_dir}/lineitem.parquet")
    for t in ("customer", "lineitem"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    assert_same(registry.QUERIES["roi_nested_palettes"](spark, str(tmp_path)).toPandas(), con.sql(registry.ORACLES["roi_nested_palettes"]).df())
