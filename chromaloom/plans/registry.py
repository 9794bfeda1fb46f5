"""Named queries of the colour engine, each with its SQL for an independent engine.

A query takes (spark, sf_dir). Pixels come from the scene derived from the table
``lineitem``, observations from ``events``, boxes from ``customer``. Doubles are
rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chromaloom.functions import color, numbers
from chromaloom.operators import adaptive, clustering, histogram, hsv, methods, observed, ordering, quality, roi, sampling, summary
from chromaloom.plans import sql
from chromaloom.plans.sql import r6
from chromaloom.sources import manifests, scene

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "adaptive_hex"
PROVISIONED = 578_703.7037037037


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def _r(x: Column | str, name: str) -> Column:
    return (F.round(x, 6) + 0.0).alias(name)


def _px(spark: SparkSession, d: str) -> DataFrame:
    return scene.scene(spark, d)


def _vis(spark: SparkSession, d: str) -> DataFrame:
    return scene.visible(_px(spark, d))


def _hist(spark: SparkSession, d: str) -> DataFrame:
    return histogram.exact(_vis(spark, d))


def _means(hist: DataFrame) -> DataFrame:
    """Rounded means of the five heaviest q12 bins: a palette that need not occur."""
    bins = histogram.top(histogram.q12(hist), "q12", 5).filter("q12 is not null").select(F.col("crop_id").alias("_crop"), F.col("q12").alias("_bin"), "rank", "ratio")
    # a plain = would add "q12 is not null" below the histogram of one side, which then is another and runs twice
    inside = hist.join(bins, (F.col("crop_id") == F.col("_crop")) & color.q12().eqNullSafe(F.col("_bin")))
    mean = lambda c: color.channel(F.sum(F.col("mass") * F.col(c)) / F.sum("mass")).alias(c)
    return inside.groupBy("crop_id", "rank").agg(mean("r"), mean("g"), mean("b"), F.first("ratio").alias("weight"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    left, top = k * 7 % 480 - 20, k * 11 % 360 - 20
    return spark.read.parquet(f"{d}/customer.parquet").select(
        F.concat(F.lit("img"), (k % 50).cast("string")).alias("path"), k.cast("int").alias("box_index"), left.cast("int").alias("l"), top.cast("int").alias("t"),
        (left + k * 13 % 200).cast("int").alias("r"), (top + k * 17 % 150).cast("int").alias("b"), F.lit(480).alias("width"), F.lit(360).alias("height"),
    )


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return summary.observations(spark, d)


# Colour functions


@query("hex_encode", sql.with_(sql.SCENE) + "select crop_id, idx, printf('#%02X%02X%02X', r, g, b) as hex from px")
def _(spark, d):
    return _px(spark, d).select("crop_id", "idx", color.hex_of().alias("hex"))


@query("hex_parse", sql.with_(sql.SCENE) + "select crop_id, idx, r * 65536 + g * 256 + b as rgb24 from px")
def _(spark, d):
    return _px(spark, d).select("crop_id", "idx", color.parse_hex(color.hex_of()).alias("rgb24"))


@query("rgb24_pack_unpack", sql.with_(sql.SCENE) + "select crop_id, idx, r * 65536 + g * 256 + b as rgb24, r as r2, g as g2, b as b2 from px")
def _(spark, d):
    r, g, b = color.unpack("rgb24")
    return _px(spark, d).withColumn("rgb24", color.rgb24()).select("crop_id", "idx", "rgb24", r.alias("r2"), g.alias("g2"), b.alias("b2"))


@query("oklab_convert", sql.with_(sql.SCENE, f"o as (select *, {sql.lab()} from px)") + f"select crop_id, idx, {r6('o1')} as l, {r6('o2')} as a, {r6('o3')} as b from o")
def _(spark, d):
    l, a, b = color.oklab()
    return _px(spark, d).select("crop_id", "idx", _r(l, "l"), _r(a, "a"), _r(b, "b"))


@query(
    "oklab_inverse",
    sql.with_(sql.SCENE, f"o as (select *, {sql.lab()} from px)", "m as (select crop_id, idx, o1 * 0.9e0 + 0.05e0 as o1, o2 * 1.2e0 as o2, o3 * 1.2e0 as o3 from o)", f"i as (select *, {sql.unlab()} from m)")
    + 'select crop_id, idx, "or" as r, og as g, ob as b from i',
)
def _(spark, d):
    l, a, b = color.oklab()
    moved = _px(spark, d).select("crop_id", "idx", (l * 0.9 + 0.05).alias("l"), (a * 1.2).alias("a"), (b * 1.2).alias("b"))
    r, g, b = color.from_oklab(("l", "a", "b"))
    return moved.select("crop_id", "idx", r.alias("r"), g.alias("g"), b.alias("b"))


@query(
    "delta_e",
    sql.with_(sql.SCENE, f"o as (select *, {sql.lab()}, {sql.lab('r // 16 * 16', 'g // 16 * 16', 'b // 16 * 16', 'q')} from px)") + f"select crop_id, idx, {r6('100 * ' + sql.dist('o', 'q'))} as delta_e from o",
)
def _(spark, d):
    coarse = [F.floor(F.col(c) / 16) * 16 for c in "rgb"]
    return _px(spark, d).select("crop_id", "idx", _r(color.delta_e(("r", "g", "b"), coarse), "delta_e"))


@query("hsv_convert", sql.with_(sql.SCENE, sql.hsv("px", "h")) + f"select crop_id, idx, {r6('hue')} as hue, {r6('sat')} as sat, {r6('val')} as val, hbin as bin from h")
def _(spark, d):
    h, s, v = color.hsv()
    return _px(spark, d).select("crop_id", "idx", _r(h, "hue"), _r(s, "sat"), _r(v, "val"), color.hsv_bin().alias("bin"))


# Histograms


@query("visible_pixels", sql.with_(sql.SCENE, sql.VIS) + f"select crop_id, idx, {r6('w')} as w from vis")
def _(spark, d):
    return _vis(spark, d).select("crop_id", "idx", _r("w", "w"))


@query("exact_colour_histogram", sql.with_(sql.BASE) + f"select crop_id, rgb24, {r6('mass')} as mass, n, min_idx from hist")
def _(spark, d):
    return _hist(spark, d).select("crop_id", "rgb24", _r("mass", "mass"), "n", "min_idx")


@query("q12_histogram", sql.with_(sql.BASE, sql.Q12) + f"select crop_id, q12, {r6('mass')} as mass, cast(n as bigint) as n, {r6('ratio')} as ratio from q12b")
def _(spark, d):
    return histogram.q12(_hist(spark, d)).select("crop_id", "q12", _r("mass", "mass"), "n", _r("ratio", "ratio"))


@query("q12_topk", sql.with_(sql.BASE, sql.Q12) + f"select crop_id, rank, q12, {r6('ratio')} as ratio from q12b where rank <= 15")
def _(spark, d):
    return histogram.top(histogram.q12(_hist(spark, d)), "q12", 15).select("crop_id", "rank", "q12", _r("ratio", "ratio"))


@query(
    "heavy_hitter",
    sql.with_(sql.BASE) + f"select crop_id, r, g, b, {r6('mass')} as mass from (select *, row_number() over (partition by crop_id order by round(mass, 9) desc, rgb24) as place from hist) where place = 1",
)
def _(spark, d):
    return histogram.heavy_hitter(_hist(spark, d)).select("crop_id", "r", "g", "b", _r("mass", "mass"))


@query(
    "dominant_colour",
    sql.with_(sql.BASE, sql.Q12, sql.HEAVY_IN_TOP) + f"select crop_id, printf('#%02X%02X%02X', r, g, b) as hex, {r6('ratio')} as top1_ratio, {r6('0.55e0 + 0.45e0 * ratio')} as confidence from heavy",
)
def _(spark, d):
    return histogram.dominant(_hist(spark, d)).select("crop_id", "hex", _r("top1_ratio", "top1_ratio"), _r("confidence", "confidence"))


@query("observed_representative", sql.with_(sql.BASE, sql.nearest("hist", "crop_id", "rep")) + f"select crop_id, r, g, b, {r6('mass')} as mass from rep")
def _(spark, d):
    return histogram.representative(_hist(spark, d)).select("crop_id", "r", "g", "b", _r("mass", "mass"))


@query("q12_palette", sql.with_(sql.BASE, sql.Q12_PALETTE) + f"select crop_id, rank, r, g, b, {r6('weight')} as weight, q12 from qpal")
def _(spark, d):
    return histogram.q12_palette(_hist(spark, d)).select("crop_id", "rank", "r", "g", "b", _r("weight", "weight"), "q12")


# HSV

_HBINS = """hb as (select *, mass / greatest(sum(mass) over (partition by crop_id), 1e-12) as ratio, row_number() over (partition by crop_id order by round(mass, 9) desc, hbin) as rank
  from (select crop_id, hbin, sum(mass) as mass from hh group by all))"""
_SMOOTH = """sm as (select crop_id, (hue + d + 60) % 60 as hue, sum(mass * k) as smoothed
  from (select crop_id, hbin // 16 as hue, sum(mass) as mass from hb where hbin < 960 group by all), (values (-2, 1), (-1, 2), (0, 3), (1, 2), (2, 1)) as t(d, k) group by all)"""
_WINNER = """tot as (select crop_id, sum(mass) as total, coalesce(sum(mass) filter (where hbin >= 960), 0) as grey from hb group by crop_id),
besth as (select crop_id, hue, round(smoothed, 9) / greatest(total_s, 1e-12) as share from (
  select *, row_number() over (partition by crop_id order by round(smoothed, 9) desc, hue) as place, sum(smoothed) over (partition by crop_id) as total_s from sm) where place = 1),
win as (select crop_id, hbin, is_grey, ratio, share from (
  select b.crop_id, b.hbin, b.ratio, s.share, round(t.grey / greatest(t.total, 1e-12), 9) >= 0.5 as is_grey,
    row_number() over (partition by b.crop_id order by coalesce(case when round(t.grey / greatest(t.total, 1e-12), 9) >= 0.5 then b.hbin >= 960 else b.hbin < 960 and b.hbin // 16 = s.hue end, false) desc, round(b.mass, 9) desc, b.hbin) as place
  from hb b join tot t using (crop_id) left join besth s using (crop_id)) where place = 1),
winp as (select *, case when is_grey then 'achromatic' else 'chromatic' end as route, least(1e0, greatest(ratio, case when is_grey then 0e0 else coalesce(share, 0e0) end)) as confidence from win)"""
_HSV = [sql.BASE, sql.hsv("hist", "hh"), _HBINS, _SMOOTH, _WINNER, "win_in as (select h.*, w.route, w.confidence from hh h join winp w using (crop_id, hbin))", sql.nearest("win_in", "crop_id, hbin, route, confidence", "hwin")]


@query("hsv_histogram", sql.with_(*_HSV[:3]) + f"select crop_id, hbin as bin, {r6('mass')} as mass, {r6('ratio')} as ratio from hb")
def _(spark, d):
    return hsv.bins(_hist(spark, d)).select("crop_id", "bin", _r("mass", "mass"), _r("ratio", "ratio"))


@query("hsv_weighted_bins", sql.with_(*_HSV[:2]) + f"select crop_id, hbin as bin, {r6('sum(mass)')} as mass, {r6('sum(mass * r) / sum(mass)')} as r, {r6('sum(mass * g) / sum(mass)')} as g, {r6('sum(mass * b) / sum(mass)')} as b from hh group by crop_id, hbin")
def _(spark, d):
    return hsv.weighted_bins(_hist(spark, d)).select("crop_id", "bin", *(_r(c, c) for c in ("mass", "r", "g", "b")))


@query("hsv_smoothed_hue", sql.with_(*_HSV[:4]) + f"select crop_id, cast(hue as bigint) as hue, {r6('smoothed')} as smoothed from sm")
def _(spark, d):
    return hsv.smoothed_hues(hsv.bins(_hist(spark, d))).select("crop_id", F.col("hue").cast("bigint").alias("hue"), _r("smoothed", "smoothed"))


@query("hsv_dominant", sql.with_(*_HSV) + f"select crop_id, r, g, b, hbin as bin, route, {r6('confidence')} as confidence from hwin")
def _(spark, d):
    return hsv.dominant(_hist(spark, d)).select("crop_id", "r", "g", "b", "bin", "route", _r("confidence", "confidence"))


_HPAL = [
    *_HSV,
    "hp_in as (select h.*, t.rank, t.ratio from hh h join hb t using (crop_id, hbin) where t.rank <= 12 and t.mass > 0)",
    sql.nearest("hp_in", "crop_id, hbin, rank, ratio", "hp_rep"),
    f"hp_cand as (select crop_id, rank, r, g, b, ratio, {sql.lab()} from (select crop_id, rank, r, g, b, ratio from hp_rep union all select w.crop_id, 0, w.r, w.g, w.b, t.ratio from hwin w join hb t using (crop_id, hbin)))",
    sql.greedy("hp_cand", "hp_sel", 0.025, 5),
    "hpal as (select s.crop_id, s.step as rank, c.r, c.g, c.b, c.ratio as weight from hp_sel s join hp_cand c on c.crop_id = s.crop_id and c.rank = s.rank)",
]


@query("hsv_palette", sql.with_(*_HPAL) + f"select crop_id, rank, r, g, b, {r6('weight')} as weight from hpal")
def _(spark, d):
    return hsv.palette(_hist(spark, d)).select("crop_id", "rank", "r", "g", "b", _r("weight", "weight"))


# Quality

_COVER = f"""exact as (select crop_id, r, g, b, count(*) as c from cs group by all),
el as (select *, {sql.lab()} from exact), pl as (select crop_id, {sql.lab("r", "g", "b", "p")} from meanpal),
near as (select e.crop_id, e.r, e.g, e.b, any_value(e.c) as c, min({sql.dist("e.o", "p.p")}) as d from el e join pl p using (crop_id) group by e.crop_id, e.r, e.g, e.b)"""
_CS = """cs as (select * from (select *, row_number() over (partition by crop_id order by idx) - 1 as pos, count(*) over (partition by crop_id) as total from vis)
  where total <= 200 or list_contains(list_transform(range(200), lambda i: i * (total - 1) // 199), pos))"""


@query("coverage_sample", sql.with_(sql.SCENE, sql.VIS, _CS) + "select crop_id, idx from cs")
def _(spark, d):
    return sampling.coverage_sample(_vis(spark, d), 200).select("crop_id", "idx")


@query("palette_coverage", sql.with_(sql.BASE, sql.Q12, sql.MEANS, _CS, _COVER) + f"select crop_id, {r6('100 * sum(d * c) / sum(c)')} as coverage from near group by crop_id")
def _(spark, d):
    vis = _vis(spark, d)
    return quality.coverage(sampling.coverage_sample(vis, 200), _means(histogram.exact(vis))).select("crop_id", _r("coverage", "coverage"))


# The two above measure 200 pixels of a crop; these as many as the operator does.
_CS_4096 = """cs as (select * from (select *, row_number() over (partition by crop_id order by idx) - 1 as pos, count(*) over (partition by crop_id) as total from vis)
  where total <= 4096 or list_contains(list_transform(range(4096), lambda i: i * (total - 1) // 4095), pos))"""


@query("coverage_sample_4096", sql.with_(sql.SCENE, sql.VIS, _CS_4096) + "select crop_id, idx from cs")
def _(spark, d):
    return sampling.coverage_sample(_vis(spark, d)).select("crop_id", "idx")


@query("palette_coverage_4096", sql.with_(sql.BASE, sql.Q12, sql.MEANS, _CS_4096, _COVER) + f"select crop_id, {r6('100 * sum(d * c) / sum(c)')} as coverage from near group by crop_id")
def _(spark, d):
    vis = _vis(spark, d)
    return quality.coverage(sampling.coverage_sample(vis), _means(histogram.exact(vis))).select("crop_id", _r("coverage", "coverage"))


@query(
    "assignment_error",
    sql.with_(sql.BASE, sql.Q12, sql.MEANS, f"hl as (select *, {sql.lab()} from hist), pl as (select crop_id, {sql.lab('r', 'g', 'b', 'p')} from meanpal), near as (select h.crop_id, h.rgb24, any_value(h.mass) as mass, min({sql.dist('h.o', 'p.p')}) as d from hl h join pl p using (crop_id) group by h.crop_id, h.rgb24)")
    + f"select crop_id, {r6('sum(mass * d * d)')} as error from near group by crop_id",
)
def _(spark, d):
    hist = _hist(spark, d)
    return quality.assignment_error(hist, _means(hist)).select("crop_id", _r("error", "error"))


_HEAVY = "select crop_id, r, g, b from (select *, row_number() over (partition by crop_id order by round(mass, 9) desc, rgb24) as place from {}) where place = 1"


@query(
    "stability_delta_e",
    sql.with_(sql.BASE, f"base as ({_HEAVY.format('hist')})", "hist2 as (select crop_id, r, g, b, rgb24, sum(w) as mass from (select *, r * 65536 + g * 256 + b as rgb24 from vis where idx % 2 = 0) group by all)", f"var as ({_HEAVY.format('hist2')})", f"both_ as (select base.crop_id, {sql.lab('base.r', 'base.g', 'base.b', 'o')}, {sql.lab('var.r', 'var.g', 'var.b', 'p')} from base join var using (crop_id))")
    + f"select crop_id, {r6('100 * ' + sql.dist('o', 'p'))} as delta_e from both_",
)
def _(spark, d):
    vis = _vis(spark, d)
    half = histogram.exact(vis.filter("idx % 2 = 0"))
    return quality.stability(histogram.heavy_hitter(histogram.exact(vis)), histogram.heavy_hitter(half)).select("crop_id", _r("delta_e", "delta_e"))


@query(
    "palette_agreement",
    sql.with_(
        sql.BASE, sql.Q12_PALETTE, sql.MEANS,
        f"qa as (select *, {sql.lab()} from qpal), ma as (select *, {sql.lab()} from meanpal)",
        f"f as (select crop_id, 100 * sum(d * weight) / greatest(sum(weight), 1e-12) as forward from (select a.crop_id, a.rank, any_value(a.weight) as weight, min({sql.dist('a.o', 'b.o')}) as d from qa a join ma b using (crop_id) group by a.crop_id, a.rank) group by crop_id)",
        f"g as (select crop_id, 100 * sum(d * weight) / greatest(sum(weight), 1e-12) as backward from (select a.crop_id, a.rank, any_value(a.weight) as weight, min({sql.dist('a.o', 'b.o')}) as d from ma a join qa b using (crop_id) group by a.crop_id, a.rank) group by crop_id)",
    )
    + f"select crop_id, {r6('forward')} as forward, {r6('backward')} as backward, {r6('(forward + backward) / 2')} as symmetric from f join g using (crop_id)",
)
def _(spark, d):
    hist = _hist(spark, d)
    return quality.agreement(histogram.q12_palette(hist), _means(hist)).select("crop_id", *(_r(c, c) for c in ("forward", "backward", "symmetric")))


@query(
    "decode_comparison",
    sql.with_(sql.SCENE) + f"select crop_id, {r6('avg(case when idx % 5 = 0 then 0e0 else 1e0 end)')} as exact_rate, {r6('avg(case when idx % 5 = 0 then 1e0 / 3 else 0e0 end)')} as channel_error from px group by crop_id",
)
def _(spark, d):
    px = _px(spark, d)
    other = px.withColumn("r", F.col("r") + F.when(F.col("idx") % 5 == 0, 1).otherwise(0))
    return quality.decode_comparison(px, other).select("crop_id", _r("exact_rate", "exact_rate"), _r("channel_error", "channel_error"))


@query(
    "pairwise_difference",
    sql.with_(sql.BASE, sql.Q12_PALETTE, sql.MEANS, f"prims as (select crop_id, 'heavy' as m, r, g, b from ({_HEAVY.format('hist')}) union all select crop_id, 'mean', r, g, b from meanpal where rank = 1 union all select crop_id, 'q12', r, g, b from qpal where rank = 1)")
    + f"select a.crop_id, {r6('sum(sqrt(cast((a.r - b.r) * (a.r - b.r) + (a.g - b.g) * (a.g - b.g) + (a.b - b.b) * (a.b - b.b) as double)))')} as difference from prims a join prims b on a.crop_id = b.crop_id and a.m < b.m group by a.crop_id",
)
def _(spark, d):
    hist = _hist(spark, d)
    part = lambda df, m: df.select("crop_id", F.lit(m).alias("method"), "r", "g", "b")
    heavy = part(histogram.heavy_hitter(hist), "heavy")
    return quality.difference(heavy.unionByName(part(_means(hist).filter("rank = 1"), "mean")).unionByName(part(histogram.q12_palette(hist).filter("rank = 1"), "q12"))).select("crop_id", _r("difference", "difference"))


@query(
    "visible_palette",
    sql.with_(sql.SCENE, "e as (select crop_id, cast(row_number() over (partition by crop_id order by q) as int) as rank, q, n, (q >> 8) * 17 as r, ((q >> 4) & 15) * 17 as g, (q & 15) * 17 as b, a from (select crop_id, (r >> 4) * 256 + (g >> 4) * 16 + (b >> 4) as q, min(a) as a, count(*) as n from px group by all))",
              "m as (select *, case when max(n * a / 255e0 > 1e-12) over (partition by crop_id) then n * a / 255e0 else cast(n as double) end as mass from e)",
              "k as (select *, row_number() over (partition by crop_id order by round(mass, 9) desc, rank) as place from m where mass > 1e-12)")
    + f"select crop_id, place as rank, r, g, b, {r6('mass / sum(mass) over (partition by crop_id)')} as weight from k where place <= 5",
)
def _(spark, d):
    q = _px(spark, d).groupBy("crop_id", color.q12().alias("q")).agg(F.min("a").alias("a"), F.count("*").alias("population"))
    rank = F.row_number().over(Window.partitionBy("crop_id").orderBy("q"))
    up = lambda c: c.bitwiseAND(15) * 17
    e = q.select("crop_id", rank.alias("rank"), up(F.shiftright("q", 8)).alias("r"), up(F.shiftright("q", 4)).alias("g"), up(F.col("q")).alias("b"), "a", "population")
    return quality.visible_palette(e).select("crop_id", "rank", "r", "g", "b", _r("weight", "weight"))


# Observed colours


_SCORED = f"""hl as (select *, {sql.lab()} from hist), pl as (select *, {sql.lab("r", "g", "b", "p")} from {{pal}}),
mx as (select crop_id, max({{by}}) as most from hist group by crop_id),
sc as (select h.crop_id, p.rank, p.weight, h.rgb24, round({sql.dist("h.o", "p.p")}, 9) as d, round({sql.dist("h.o", "p.p")} / (0.25e0 + 0.75e0 * sqrt(h.{{by}} / cast(m.most as double))), 9) as score
  from hl h join pl p using (crop_id) join mx m using (crop_id))"""
_PRUNED = """pruned as (select * from (select *, weight / greatest(sum(weight) over (partition by crop_id), 1e-12) as share, row_number() over (partition by crop_id order by round(weight, 9) desc, rank) as place from meanpal)
  qualify round(share, 9) >= 0.01e0 or (max(round(share, 9)) over (partition by crop_id) < 0.01e0 and place = 1))"""
_UNPACK = f"select crop_id, cast(rank as int) as rank, rgb24 >> 16 as r, (rgb24 >> 8) & 255 as g, rgb24 & 255 as b, {r6('weight')} as weight from pk"


@query("observed_remap_all", sql.with_(sql.BASE, sql.Q12, sql.MEANS, _SCORED.format(pal="meanpal", by="mass"), sql.picks("sc", "pk", 5, True)) + _UNPACK)
def _(spark, d):
    hist = _hist(spark, d)
    return observed.remap_all(_means(hist), hist).select("crop_id", "rank", "r", "g", "b", _r("weight", "weight"))


@query(
    "observed_remap_knn64",
    sql.with_(sql.BASE, sql.Q12, sql.MEANS, _PRUNED, _SCORED.format(pal="pruned", by="n"), "sc64 as (select * from sc qualify row_number() over (partition by crop_id, rank order by d, rgb24) <= 64)", sql.picks("sc64", "pk", 5, False)) + _UNPACK,
)
def _(spark, d):
    hist = _hist(spark, d)
    return observed.remap_nearest(_means(hist), hist).select("crop_id", "rank", "r", "g", "b", _r("weight", "weight"))


@query(
    "observed_nearest",
    sql.with_(sql.BASE, sql.Q12, sql.MEANS, _SCORED.format(pal="meanpal", by="n"), "b1 as (select * from sc qualify row_number() over (partition by crop_id, rank order by d, rgb24) = 1)")
    + f"select crop_id, cast(min(rank) as int) as rank, rgb24 >> 16 as r, (rgb24 >> 8) & 255 as g, rgb24 & 255 as b, {r6('sum(weight)')} as weight from b1 group by crop_id, rgb24",
)
def _(spark, d):
    hist = _hist(spark, d)
    return observed.nearest(_means(hist), hist).select("crop_id", "rank", "r", "g", "b", _r("weight", "weight"))


@query("observed_check_anti_join", sql.with_(sql.BASE, sql.Q12, sql.MEANS) + "select crop_id, cast(rank as int) as rank, r, g, b from meanpal p where not exists (select 1 from hist h where h.crop_id = p.crop_id and h.r = p.r and h.g = p.g and h.b = p.b)")
def _(spark, d):
    hist = _hist(spark, d)
    return observed.unobserved(_means(hist), hist).select("crop_id", "rank", "r", "g", "b")


@query("cluster_prune", sql.with_(sql.BASE, sql.Q12, sql.MEANS, _PRUNED) + f"select crop_id, cast(rank as int) as rank, {r6('share')} as ratio from pruned")
def _(spark, d):
    return observed.pruned(_means(_hist(spark, d))).select("crop_id", "rank", _r("ratio", "ratio"))


@query("palette_tencent_hsv_weighted_observed", sql.with_(*_HPAL, _SCORED.format(pal="hpal", by="mass"), sql.picks("sc", "pk", 5, True)) + _UNPACK)
def _(spark, d):
    return methods.extract(_px(spark, d), "tencent_hsv_weighted_observed").select("crop_id", "rank", "r", "g", "b", _r("weight", "weight"))


# Adaptive method


@query("sample_stats", sql.with_(sql.SCENE, sql.VIS, sql.SAMPLE, sql.STATS) + f"select crop_id, n, {r6('spread')} as spread, {r6('rgb_std')} as rgb_std, {r6('exact_ratio')} as exact_ratio from stats")
def _(spark, d):
    return adaptive.sample_stats(sampling.sample(_vis(spark, d))).select("crop_id", "n", *(_r(c, c) for c in ("spread", "rgb_std", "exact_ratio")))


@query("gradient_r2", sql.with_(sql.SCENE, sql.VIS, sql.SAMPLE, sql.STATS, sql.GRADIENT) + f"select crop_id, {r6('r2')} as r2, {r6('dir_x')} as dir_x, {r6('dir_y')} as dir_y from grad")
def _(spark, d):
    px = _px(spark, d)
    return adaptive.gradient(sampling.sample(scene.visible(px)), adaptive.extents(px)).select("crop_id", *(_r(c, c) for c in ("r2", "dir_x", "dir_y")))


@query("adaptive_route", sql.with_(sql.BASE, sql.Q12, sql.SAMPLE, sql.STATS, sql.GRADIENT, sql.ROUTED) + f"select crop_id, route, {r6('top1')} as top1 from routed")
def _(spark, d):
    px = _px(spark, d)
    vis = scene.visible(px)
    return adaptive.routed(px, vis, histogram.exact(vis), sampling.sample(vis)).select("crop_id", "route", _r("top1", "top1"))


@query("gradient_stops", sql.with_(sql.SCENE, sql.VIS, sql.SAMPLE, sql.STATS, sql.GRADIENT, sql.STOPS) + "select crop_id, step as rank, r, g, b from stops")
def _(spark, d):
    px = _px(spark, d)
    sample = sampling.sample(scene.visible(px))
    stops = adaptive.gradient_stops(sample, adaptive.gradient(sample, adaptive.extents(px)))
    return stops.select("crop_id", F.posexplode("stops").alias("at", "s")).select("crop_id", (F.col("at") + 1).alias("rank"), "s.r", "s.g", "s.b")


def _adaptive(spark: SparkSession, d: str) -> DataFrame:
    px = _px(spark, d)
    vis = scene.visible(px)
    return adaptive.adaptive(px, vis, histogram.exact(vis))


def _flat(results: DataFrame) -> DataFrame:
    hexes = F.transform("palette", lambda c: color.hex_of((c["r"], c["g"], c["b"])))
    weights = F.transform("weights", lambda w: color.weight_u16(w).cast("string"))
    return results.select(
        "crop_id", "route", color.hex_of(("primary.r", "primary.g", "primary.b")).alias("hex"), F.array_join(hexes, " ").alias("palette"), F.array_join(weights, " ").alias("weights"),
        _r("confidence", "confidence"), "n", *(_r(c, c) for c in ("top1", "spread", "rgb_std", "exact_ratio", "r2")),
    )


@query(
    "adaptive_hex",
    sql.with_(sql.ADAPTIVE)
    + f"select crop_id, route, printf('#%02X%02X%02X', r, g, b) as hex, palette, weights, {r6('confidence')} as confidence, n, {r6('top1')} as top1, {r6('spread')} as spread, {r6('rgb_std')} as rgb_std, {r6('exact_ratio')} as exact_ratio, {r6('r2')} as r2 from adaptive",
)
def _(spark, d):
    return _flat(_adaptive(spark, d))


@query(
    "compact_annotation",
    sql.with_(sql.ADAPTIVE)
    + f"select 1 as schema_version, crop_id as id, r * 65536 + g * 256 + b as rgb24, printf('#%02X%02X%02X', r, g, b) as hex, 1 as method_id, 'adaptive_v1' as method, route, {r6('confidence')} as confidence, weights as palette_weight_u16, true as observed from adaptive",
)
def _(spark, d):
    out = summary.compact(_adaptive(spark, d), "adaptive_v1")
    return out.withColumn("palette_weight_u16", F.array_join(F.transform("palette_weight_u16", lambda w: w.cast("string")), " ")).withColumn("confidence", F.col("confidence") + 0.0).drop("palette_rgb24")


@query(
    "result_record",
    sql.with_(sql.ADAPTIVE, """pal as (select a.crop_id, string_agg(printf('%d,%d,%d', c.r, c.g, c.b), ' ' order by c.place) as palette_rgb, string_agg(printf('#%02X%02X%02X', c.r, c.g, c.b), ' ' order by c.place) as palette_hex,
      count(*) as n_weights, sum(round(c.weight, 6)) as weight from adaptive a join chosen c using (crop_id) group by a.crop_id)""")
    + f"select crop_id, 'adaptive_v1' as method, printf('%d,%d,%d', r, g, b) as primary_rgb, r * 65536 + g * 256 + b as rgb24, printf('#%02X%02X%02X', r, g, b) as hex, palette_rgb, palette_hex, cast(n_weights as int) as n_weights, {r6('weight')} as weight, {r6('confidence')} as confidence, route, true as observed, cast(n as double) as n, {r6('spread')} as spread, {r6('r2')} as r2 from adaptive join pal using (crop_id)",
)
def _(spark, d):
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    full = summary.record(_adaptive(spark, d), "adaptive_v1")
    out = full.withColumns({"primary_rgb": text(F.col("primary_rgb")), "palette_rgb": F.array_join(F.transform("palette_rgb", text), " "), "palette_hex": F.array_join("palette_hex", " ")})
    out = out.withColumns({"n_weights": F.size("weights"), "weight": F.round(F.aggregate("weights", F.lit(0.0), lambda t, w: t + w), 6) + 0.0, "confidence": F.col("confidence") + 0.0})
    return out.withColumns({c: F.element_at("diagnostics", c) + 0.0 for c in ("n", "spread", "r2")}).drop("weights", "diagnostics")


@query(
    "synthetic_eval",
    sql.with_(sql.SYNTHETIC, sql.VIS, sql.HIST, sql.Q12, sql.SAMPLE.replace("cast(crop_id as bigint) %", "length(crop_id) %"), sql.STATS, sql.GRADIENT, sql.ROUTED, sql.HEAVY_IN_TOP,
              "want as (select * from (values ('solid', 210, 74, 67, 'flat'), ('linear_gradient', 133, 123, 109, 'gradient'), ('four_color_texture', null, null, null, 'texture'), ('transparent_fill', 92, 211, 142, 'flat'), ('gray_gradient', 125, 125, 125, 'gradient')) as t(crop_id, wr, wg, wb, wroute))".replace("null, null, null", "cast(null as int), cast(null as int), cast(null as int)"),
              f"ev as (select w.crop_id, w.wr, t.route, w.wroute, h.r, h.g, h.b, {sql.lab('h.r', 'h.g', 'h.b', 'o')}, {sql.lab('w.wr', 'w.wg', 'w.wb', 'p')} from want w join routed t using (crop_id) join heavy h using (crop_id))").replace("cast(crop_id as bigint) %", "length(crop_id) %")
    + f"select crop_id, route, route = wroute as route_match, case when wr is not null and route = 'flat' then {r6('100 * ' + sql.dist('o', 'p'))} end as delta_e from ev",
)
def _(spark, d):
    px = scene.synthetic_cases(spark)
    vis = scene.visible(px)
    # the case's name is text: its length stands for the crop in the sampling hash
    order = sampling.hashed_place(F.col("idx"), F.length("crop_id"))
    sample = vis.withColumn("_rank", F.row_number().over(Window.partitionBy("crop_id").orderBy(order, "idx"))).filter("_rank <= 64")
    hist = histogram.exact(vis)
    want = spark.createDataFrame(
        [("solid", 210, 74, 67, "flat"), ("linear_gradient", 133, 123, 109, "gradient"), ("four_color_texture", None, None, None, "texture"), ("transparent_fill", 92, 211, 142, "flat"), ("gray_gradient", 125, 125, 125, "gradient")],
        "crop_id string, wr int, wg int, wb int, wroute string",
    )
    met = adaptive.routed(px, vis, hist, sample).join(want, "crop_id").join(histogram.dominant(hist).select("crop_id", "r", "g", "b"), "crop_id")
    off = F.when(F.col("wr").isNotNull() & (F.col("route") == "flat"), F.round(color.delta_e(("r", "g", "b"), ("wr", "wg", "wb")), 6) + 0.0)
    return met.select("crop_id", "route", (F.col("route") == F.col("wroute")).alias("route_match"), off.alias("delta_e"))


# Boxes


@query("box_clamp", sql.with_(sql.BOXES) + "select * from clamped")
def _(spark, d):
    return sampling.clamp_boxes(_boxes(spark, d))


@query(
    "stratified_grid",
    sql.with_(
        sql.BOXES,
        "s as (select path, box_index, l, t, r - l as w, b - t as h from clamped)",
        "c1 as (select *, greatest(1, least(w, cast(round_even(sqrt(64 * w / cast(greatest(h, 1) as double)), 0) as int))) as c0, greatest(1, least(h, 64 // c0)) as r0 from s)",
        "c2 as (select path, box_index, l, t, w, h, case when w * h <= 64 then w when r0 * c0 > 64 then greatest(1, 64 // r0) else c0 end as cols, case when w * h <= 64 then h else r0 end as rows_ from c1)",
    )
    + "select path, box_index, cast(i * cols + j as int) as at, cast(l + j * (w - 1) // greatest(cols - 1, 1) as int) as x, cast(t + i * (h - 1) // greatest(rows_ - 1, 1) as int) as y from c2, range(64) as a(i), range(64) as b(j) where i < rows_ and j < cols",
)
def _(spark, d):
    return sampling.grid(sampling.clamp_boxes(_boxes(spark, d)), 64).select("path", "box_index", F.col("at").cast("int").alias("at"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


@query("roi_nested_output", sql.with_(sql.BOXES) + "select path, count(*) as n, string_agg(box_index || ':' || l || ',' || t || ',' || r || ',' || b, ';' order by box_index) as boxes from clamped group by path")
def _(spark, d):
    boxes = sampling.clamp_boxes(_boxes(spark, d))
    text = F.concat(F.col("box_index"), F.lit(":"), F.concat_ws(",", "l", "t", "r", "b"))
    nested = F.sort_array(F.collect_list(F.struct("box_index", text.alias("s"))))
    return boxes.groupBy("path").agg(F.count("*").alias("n"), F.array_join(F.transform(nested, lambda x: x["s"]), ";").alias("boxes"))


@query(
    "display_sample",
    sql.with_(sql.SCENE, "ids as (select crop_id, row_number() over (order by crop_id) - 1 as pos, count(*) over () as n from (select distinct crop_id from px))")
    + "select crop_id from ids where pos in (select round_even(i * (n - 1) / cast(greatest(least(10, n) - 1, 1) as double), 0) from range(10) as t(i), (select any_value(n) as n from ids) where i < least(10, n))",
)
def _(spark, d):
    return sampling.display_ids(_px(spark, d).select("crop_id").distinct(), 10)


@query("batch_prefix_sum", sql.with_(sql.SCENE, "c as (select crop_id, count(*) as n from px group by crop_id)") + "select crop_id, n, cast(coalesce(sum(n) over (order by crop_id rows between unbounded preceding and 1 preceding), 0) as bigint) as csr_offset from c")
def _(spark, d):
    n = _px(spark, d).groupBy("crop_id").agg(F.count("*").alias("n"))
    return ordering.with_prefix(n, "crop_id", "n", "csr_offset").select("crop_id", "n", "csr_offset")


@query(
    "shared_centre_bins",
    sql.with_(sql.BASE, "cen as (select crop_id // 4 as image_id, list_transform(range(8), lambda i: 16e0 + 32 * i) as c from px group by 1)",
              "kb as (select crop_id // 4 as image_id, crop_id as box_index, least(7, cast(ceil((r - 32) / 32e0) as int)) as kr, least(7, cast(ceil((g - 32) / 32e0) as int)) as kg, least(7, cast(ceil((b - 32) / 32e0) as int)) as kb, r, g, b, n from hist)")
    + f"select image_id, box_index, greatest(kr, 0) * 64 + greatest(kg, 0) * 8 + greatest(kb, 0) as bin, cast(sum(n) as bigint) as n, {r6('sum(r * n) / sum(n)')} as r, {r6('sum(g * n) / sum(n)')} as g, {r6('sum(b * n) / sum(n)')} as b from kb group by 1, 2, 3",
)
def _(spark, d):
    image = F.floor(F.col("crop_id") / 4).cast("int").alias("image_id")
    boxes = _hist(spark, d).select(image, F.col("crop_id").alias("box_index"), "rgb24", "n")
    even = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: 16.0 + 32.0 * i)
    centres = boxes.select("image_id").distinct().withColumn("centres", F.array(even, even, even))
    return clustering.bins_with_centres(boxes, centres).select("image_id", "box_index", "bin", "n", _r("r", "r"), _r("g", "g"), _r("b", "b"))


# Summaries, capacity, browsing


@query(
    "method_summary",
    sql.with_(sql.OBSERVATIONS, "s as (select method, count(*) as samples, avg(elapsed_ms) as m, coalesce(1.96e0 * stddev_samp(elapsed_ms) / sqrt(count(*)), 0e0) as half, count(*) / greatest(sum(elapsed_ms) / 1000, 1e-12) as cs, * exclude (method) from (select method, elapsed_ms, decode_ms, method_ms, pixels, coverage, jpeg60, resize50, observed from obs) group by all)".split("s as")[0].rstrip(", \n"))
    + """select method, count(*) as samples, round(quantile_cont(elapsed_ms, 0.5), 4) as p50, round(quantile_cont(elapsed_ms, 0.95), 4) as p95, round(quantile_cont(elapsed_ms, 0.99), 4) as p99,
  round(avg(elapsed_ms), 4) as mean, round(avg(elapsed_ms) - coalesce(1.96e0 * stddev_samp(elapsed_ms) / sqrt(count(*)), 0), 4) as ci95_low, round(avg(elapsed_ms) + coalesce(1.96e0 * stddev_samp(elapsed_ms) / sqrt(count(*)), 0), 4) as ci95_high,
  round(avg(decode_ms), 4) as decode_mean, round(avg(method_ms), 4) as method_mean, round(count(*) / greatest(sum(elapsed_ms) / 1000, 1e-12), 3) as crops_s,
  round(sum(pixels) / 1e6 / greatest(sum(method_ms) / 1000, 1e-12), 3) as mpix_s, cast(ceil(578703.7037037037e0 / greatest(count(*) / greatest(sum(elapsed_ms) / 1000, 1e-12), 1e-12)) as bigint) as processes,
  round(1e9 / greatest(count(*) / greatest(sum(elapsed_ms) / 1000, 1e-12), 1e-12) / 3600e0, 2) as worker_hours_per_1b, round(avg(coverage), 4) as coverage_mean, round(avg(jpeg60), 4) as jpeg60_mean,
  round(quantile_cont(jpeg60, 0.95), 4) as jpeg60_p95, round(avg(resize50), 4) as resize50_mean, round(quantile_cont(resize50, 0.95), 4) as resize50_p95, round(avg(case when observed then 1e0 else 0e0 end), 4) as observed_rate
from obs group by method""",
)
def _(spark, d):
    return summary.summarize(_obs(spark, d), PROVISIONED)


@query("latency_percentiles", sql.with_(sql.OBSERVATIONS) + f"select batch, {r6('quantile_cont(elapsed_ms, 0.5)')} as elapsed_ms_p50, {r6('quantile_cont(elapsed_ms, 0.95)')} as elapsed_ms_p95, {r6('quantile_cont(elapsed_ms, 0.99)')} as elapsed_ms_p99 from obs group by batch")
def _(spark, d):
    out = _obs(spark, d).groupBy("batch").agg(*summary.percentiles("elapsed_ms"))
    return out.select("batch", *(_r(c, c) for c in out.columns[1:]))


@query("row_rates", sql.with_(sql.OBSERVATIONS) + f"select event_id, {r6('pixels / 1e6 / greatest(method_ms / 1000, 1e-12)')} as mpix_s, {r6('1e0 / greatest(elapsed_ms / 1000, 1e-12)')} as crops_s from obs where elapsed_ms > 0")
def _(spark, d):
    return summary.rates(_obs(spark, d).filter("elapsed_ms > 0")).select("event_id", _r("mpix_s", "mpix_s"), _r("crops_s", "crops_s"))


@query("route_share", sql.with_(sql.OBSERVATIONS) + f"select method, route, count(*) as n, {r6('count(*) / cast(sum(count(*)) over (partition by method) as double)')} as share from obs group by method, route")
def _(spark, d):
    return summary.route_share(_obs(spark, d)).select("method", "route", "n", _r("share", "share"))


@query("route_counts_map", sql.with_(sql.OBSERVATIONS) + "select method, string_agg(route || '=' || n, ',' order by route) as route_counts from (select method, route, count(*) as n from obs group by all) group by method")
def _(spark, d):
    entries = F.transform(F.map_entries("route_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return summary.route_counts(_obs(spark, d)).select("method", F.array_join(entries, ",").alias("route_counts"))


@query("method_route_cube", sql.with_(sql.OBSERVATIONS) + "select method, route, count(*) as n, count(distinct crop_id) as crops from obs group by cube (method, route)")
def _(spark, d):
    return _obs(spark, d).cube("method", "route").agg(F.count("*").alias("n"), F.count_distinct("crop_id").alias("crops"))


_PLAN = """plan as (select days, 1e11 / (days * 86400e0) as required, 1e11 / (days * 86400e0) * 1.5e0 as provisioned, 5e9 / (days * 86400e0) as images_s, 5e9 / (days * 86400e0) / 1000 as gpix from (values (3), (7), (15)) as t(days))"""


@query("capacity_target", sql.with_(_PLAN) + f"select days, {r6('required')} as required_crops_s, {r6('provisioned')} as provisioned_crops_s from plan")
def _(spark, d):
    return summary.capacity(spark).select("days", _r("required_crops_s", "required_crops_s"), _r("provisioned_crops_s", "provisioned_crops_s"))


@query("decode_once_capacity", sql.with_(_PLAN) + f"select days, {r6('images_s')} as images_s, 20e0 as crops_per_image, {r6('gpix')} as gpix_s, {r6('images_s * 0.5e0 / 1000')} as compressed_gb_s, {r6('gpix * 3')} as decoded_gb_s, cast(ceil(gpix / 0.5e0 * 1.5e0) as bigint) as fused_workers from plan")
def _(spark, d):
    return summary.capacity(spark).select("days", _r("images_s", "images_s"), "crops_per_image", _r("gpix_s", "gpix_s"), _r("compressed_gb_s", "compressed_gb_s"), _r("decoded_gb_s", "decoded_gb_s"), "fused_workers")


@query("capacity_scenarios", sql.with_(sql.OBSERVATIONS, _PLAN, "rates as (select method, round(count(*) / greatest(sum(elapsed_ms) / 1000, 1e-12), 3) as cs from obs group by method)") + "select days, method, cast(ceil(provisioned / greatest(cs, 1e-12)) as bigint) as processes from plan, rates")
def _(spark, d):
    return summary.scenarios(summary.capacity(spark), summary.summarize(_obs(spark, d), PROVISIONED).select("method", "crops_s"))


@query("audit_projection", sql.with_(sql.OBSERVATIONS, f"a as (select event_id, greatest(elapsed_ms / 1000, 1e-12) as s from obs)") + f"select event_id, round(1 / s, 6) + 0e0 as crops_s, cast(ceil({PROVISIONED!r}e0 / (1 / s)) as bigint) as processes, round(1e9 / (1 / s) / 3600, 2) + 0e0 as hours_1b from a")
def _(spark, d):
    """Every observation taken for the audit of one crop."""
    audits = _obs(spark, d).select("event_id", (F.col("elapsed_ms") / 1000).alias("inference_seconds"))
    return summary.audit_projection(audits, PROVISIONED).drop("inference_seconds")


_RATES = f"rates as (select method, round(count(*) / greatest(sum(elapsed_ms) / 1000, 1e-12), 3) as crops_s, false as is_audit, cast(ceil({PROVISIONED!r}e0 / (count(*) / greatest(sum(elapsed_ms) / 1000, 1e-12))) as bigint) as processes, round(1e9 / (count(*) / greatest(sum(elapsed_ms) / 1000, 1e-12)) / 3600, 2) as hours_1b from obs group by method)"
_AUDIT = f"slow as (select max(elapsed_ms) / 1000 as s from obs), below as (select 'audited' as method, round(1 / s, 6) as crops_s, true as is_audit, cast(ceil({PROVISIONED!r}e0 / (1 / s)) as bigint) as processes, round(1e9 / (1 / s) / 3600, 2) as hours_1b from slow)"


@query("methods_with_audit", sql.with_(sql.OBSERVATIONS, _RATES, _AUDIT) + "select * from rates union all select * from below")
def _(spark, d):
    obs = _obs(spark, d)
    audit = summary.audit_projection(obs.agg((F.max("elapsed_ms") / 1000).alias("inference_seconds")), PROVISIONED).drop("inference_seconds")
    return summary.with_audit(summary.summarize(obs, PROVISIONED).select("method", "crops_s", "processes", F.col("worker_hours_per_1b").alias("hours_1b")), audit, "audited")


@query("worker_mean", sql.with_(sql.OBSERVATIONS) + "select batch, round(avg(elapsed_ms), 4) + 0e0 as mean_ms from obs group by batch")
def _(spark, d):
    return _obs(spark, d).groupBy("batch").agg((F.round(F.avg("elapsed_ms"), 4) + 0.0).alias("mean_ms"))


@query("ci95", sql.with_(sql.OBSERVATIONS) + f"select method, {r6('coalesce(1.96e0 * stddev_samp(elapsed_ms) / sqrt(count(*)), 0)')} as half from obs group by method")
def _(spark, d):
    s = F.when(F.count("*") < 2, 0.0).otherwise(1.96 * F.stddev_samp("elapsed_ms") / F.sqrt(F.count("*")))
    return _obs(spark, d).groupBy("method").agg(_r(s, "half"))


_LAST = """last_ as (select crop_id, batch, method, event_id, elapsed_ms, route from obs qualify row_number() over (partition by crop_id, batch, method order by event_id desc) = 1),
idx as (select crop_id, batch, count(*) as methods, max(elapsed_ms) as slowest_ms, string_agg(method || ':' || route, ',' order by method) as detail from last_ group by crop_id, batch)"""


def _index(spark: SparkSession, d: str) -> DataFrame:
    entries = F.transform(F.map_entries("detail"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["route"]))
    return summary.browse_index(_obs(spark, d)).withColumn("detail", F.array_join(entries, ",")).withColumn("slowest_ms", F.round("slowest_ms", 6) + 0.0)


@query("browse_index", sql.with_(sql.OBSERVATIONS, _LAST) + f"select crop_id, batch, methods, {r6('slowest_ms')} as slowest_ms, detail from idx")
def _(spark, d):
    return _index(spark, d).select("crop_id", "batch", "methods", "slowest_ms", "detail")


@query("browse_filter_sort_page", sql.with_(sql.OBSERVATIONS, _LAST) + f"select crop_id, batch, {r6('slowest_ms')} as slowest_ms from idx where batch like 'b1%' and contains(lower(detail), 'flat') order by round(slowest_ms, 6) desc, crop_id limit 10 offset 10")
def _(spark, d):
    kept = _index(spark, d).filter(F.col("batch").startswith("b1") & F.lower("detail").contains("flat"))
    return summary.page(kept.select("crop_id", "batch", "slowest_ms"), [F.col("slowest_ms").desc(), F.col("crop_id")], 10, 1)


@query("browse_counts", sql.with_(sql.OBSERVATIONS, _LAST) + "select count(*) as total, count(*) filter (where contains(detail, 'flat')) as kept from idx")
def _(spark, d):
    return _index(spark, d).agg(F.count("*").alias("total"), F.count(F.when(F.col("detail").contains("flat"), 1)).alias("kept"))


@query("batches_distinct", sql.with_(sql.OBSERVATIONS) + "select distinct batch, cast(substr(batch, 2) as int) as number from obs")
def _(spark, d):
    return _obs(spark, d).select("batch", F.substring("batch", 2, 9).cast("int").alias("number")).distinct()


@query("resume_anti_join", sql.with_(sql.OBSERVATIONS) + "select distinct crop_id from obs where crop_id not in (select crop_id from obs where event_id % 150 = 0)")
def _(spark, d):
    obs = _obs(spark, d)
    return summary.remaining(obs.select("crop_id").distinct(), obs.filter("event_id % 150 = 0"))


@query("palette_bars", sql.with_(sql.BASE, sql.Q12) + f"select crop_id, rank, {r6('greatest(8e0, 100 * ratio / max(ratio) over (partition by crop_id))')} as width from q12b where rank <= 3")
def _(spark, d):
    top = histogram.top(histogram.q12(_hist(spark, d)), "q12", 3)
    width = F.greatest(F.lit(8.0), 100 * F.col("ratio") / F.max("ratio").over(Window.partitionBy("crop_id")))
    return top.select("crop_id", "rank", _r(width, "width"))


# Smaller operators


@query("gamma_transform", sql.with_(sql.SCENE) + f"select crop_id, idx, {r6('pow(r / 255e0, 0.5499e0 / 0.45455e0)')} as forward, cast(least(255, floor(pow(r / 255e0, 0.45455e0 / 0.5499e0) * 256)) as int) as backward from px")
def _(spark, d):
    gamma = 0.5499 / 0.45455
    c = F.col("r") / 255.0
    back = F.least(F.lit(255), F.floor(F.pow(c, F.lit(1 / gamma)) * 256)).cast("int")
    return _px(spark, d).select("crop_id", "idx", _r(F.pow(c, F.lit(gamma)), "forward"), back.alias("backward"))


@query("compact_numbers", sql.with_(sql.OBSERVATIONS) + "select event_id, case when crop_id * 1000 >= 1000000 then printf('%.1fM', crop_id * 1000 / 1e6) when crop_id * 1000 >= 1000 then printf('%.1fK', crop_id * 1000 / 1e3) else cast(crop_id * 1000 as varchar) end as text from obs")
def _(spark, d):
    n = F.col("crop_id") * 1000
    text = F.when(n >= 1_000_000, F.concat(numbers.tenths(n / 1e6), F.lit("M"))).when(n >= 1000, F.concat(numbers.tenths(n / 1e3), F.lit("K"))).otherwise(n.cast("string"))
    return _obs(spark, d).select("event_id", text.alias("text"))


@query("palette_defaults", sql.with_(sql.OBSERVATIONS) + f"select event_id, case when event_id % 7 = 0 then '#000000' else '#102030' end as hex, case when event_id % 7 = 0 then 1e0 when event_id % 5 = 0 then 0.5e0 else 0.75e0 end as weight from obs")
def _(spark, d):
    # an empty palette is black, weights that don't fit are even
    colours = F.when(F.col("event_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("#102030"), F.lit("#405060")))
    weights = F.when(F.col("event_id") % 5 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(0.75), F.lit(0.25)))
    e = _obs(spark, d).select("event_id", colours.alias("p"), weights.alias("w"))
    full = F.when(F.size("p") == 0, F.array(F.lit("#000000"))).otherwise(F.col("p"))
    e = e.select("event_id", full.alias("p"), "w")
    even = F.transform("p", lambda _: 1.0 / F.size("p"))
    return e.select("event_id", F.get("p", F.lit(0)).alias("hex"), F.get(F.when(F.size("w") == F.size("p"), F.col("w")).otherwise(even), F.lit(0)).alias("weight"))


@query("every_fifth", sql.with_(sql.SCENE, "ids as (select crop_id, row_number() over (order by crop_id) - 1 as pos from (select distinct crop_id from px))") + "select crop_id from ids where pos % 5 = 0 and pos < 50")
def _(spark, d):
    placed = ordering.with_prefix(_px(spark, d).select("crop_id").distinct(), "crop_id", name="pos")
    return placed.filter("pos % 5 = 0 and pos < 50").select("crop_id")


@query("display_subset", sql.with_(sql.SCENE) + "select crop_id, count(*) as n from px where crop_id in (select distinct cast(s_suppkey as int) from supplier where s_suppkey % 3 = 0) group by crop_id")
def _(spark, d):
    shown = spark.read.parquet(f"{d}/supplier.parquet").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").cast("int").alias("crop_id"))
    return _px(spark, d).join(shown, "crop_id", "left_semi").groupBy("crop_id").agg(F.count("*").alias("n"))


@query("stride_sample", sql.with_(sql.SCENE) + "select crop_id, count(*) as n, cast(sum(r) as bigint) as r from px where idx % 10 = 0 group by crop_id")
def _(spark, d):
    return _px(spark, d).filter("idx % 10 = 0").groupBy("crop_id").agg(F.count("*").alias("n"), F.sum("r").alias("r"))


@query(
    "anchor_crops",
    sql.with_("i as (select c_custkey as id, cast(200 + c_custkey * 37 % 900 as int) as width, cast(150 + c_custkey * 53 % 700 as int) as height from customer), v as (select * from (values ('top_left', 0.08e0), ('center', 0.5e0), ('bottom_right', 0.92e0)) as t(variant, pos)), s as (select *, greatest(64, cast(round_even(least(width, height) * 0.48e0, 0) as int)) as side from i, v)")
    + "select id, variant, side, cast(round_even(greatest(0, least(pos * width - side / 2e0, width - side)), 0) as int) as left_, cast(round_even(greatest(0, least(pos * height - side / 2e0, height - side)), 0) as int) as top_ from s",
)
def _(spark, d):
    k = F.col("c_custkey")
    i = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), (200 + k * 37 % 900).cast("int").alias("width"), (150 + k * 53 % 700).cast("int").alias("height"))
    every = i.withColumn("variant", F.explode(F.array(*map(F.lit, manifests.ANCHORS))))
    return manifests.crop_geometry(every).select("id", "variant", "side", F.col("left").alias("left_"), F.col("top").alias("top_"))


_GRID = """c1 as (select path, box_index, l, t, r - l as w, b - t as h, greatest(1, least(r - l, cast(round_even(sqrt(64 * (r - l) / cast(greatest(b - t, 1) as double)), 0) as int))) as c0 from clamped),
c2 as (select *, greatest(1, least(h, 64 // c0)) as r0 from c1),
c3 as (select path, box_index, l, t, w, h, case when w * h <= 64 then w when r0 * c0 > 64 then greatest(1, 64 // r0) else c0 end as cols, case when w * h <= 64 then h else r0 end as rows_ from c2),
pt as (select path, box_index, i * cols + j as idx, l + j * (w - 1) // greatest(cols - 1, 1) as x, t + i * (h - 1) // greatest(rows_ - 1, 1) as y from c3, range(64) as a(i), range(64) as b(j) where i < rows_ and j < cols)"""
_CROP_BOXES = """boxes as (select cast(c_custkey % 50 as varchar) as path, cast(c_custkey as int) as box_index, cast(c_custkey * 7 % 25 - 2 as int) as l, cast(c_custkey * 11 % 24 - 2 as int) as t,
  cast(c_custkey * 7 % 25 + 1 + c_custkey * 13 % 15 as int) as r, cast(c_custkey * 11 % 24 + 1 + c_custkey * 17 % 12 as int) as b from customer),
clamped as (select * from (select path, box_index, greatest(l, 0) as l, greatest(t, 0) as t, least(r, 25) as r, least(b, 24) as b from boxes) where r > l and b > t)"""
#: The pixels that boxes sample, each box a crop path#box_index.
_ROI = [sql.SCENE, _CROP_BOXES, _GRID, "vis as (select pt.path || '#' || pt.box_index as crop_id, pt.path, pt.box_index, pt.idx, pt.x, pt.y, px.r, px.g, px.b, 1e0 as w from pt join px on cast(px.crop_id as varchar) = pt.path and px.x = pt.x and px.y = pt.y)"]
_ROI_PAL = [*_ROI, sql.HIST, sql.Q12, sql.MEANS, _PRUNED, _SCORED.format(pal="pruned", by="n"), "sc64 as (select * from sc qualify row_number() over (partition by crop_id, rank order by d, rgb24) <= 64)"]
_ROI_PAL += [sql.picks("sc64", "pk", 5, False).replace("cast(null as int) as crop_id", "cast(null as varchar) as crop_id")]


def _roi_samples(spark: SparkSession, d: str) -> DataFrame:
    """Boxes from ``customer`` in the scene's crops, which stand for the images."""
    k = F.col("c_custkey")
    left, top = k * 7 % 25 - 2, k * 11 % 24 - 2
    boxes = spark.read.parquet(f"{d}/customer.parquet").select(
        (k % 50).cast("string").alias("path"), k.cast("int").alias("box_index"), left.cast("int").alias("l"), top.cast("int").alias("t"),
        (left + 3 + k * 13 % 15).cast("int").alias("r"), (top + 3 + k * 17 % 12).cast("int").alias("b"), F.lit(25).alias("width"), F.lit(24).alias("height"),
    )
    images_ = _px(spark, d).select(F.col("crop_id").cast("string").alias("path"), "x", "y", "r", "g", "b")
    return roi.sampled(images_, boxes, 64)


def _roi_palettes(spark: SparkSession, d: str) -> DataFrame:
    hist = roi.histograms(_roi_samples(spark, d))
    return roi.by_box(observed.remap_nearest(_means(hist), hist))


@query("roi_samples", sql.with_(*_ROI) + "select crop_id, path, box_index, cast(idx as int) as idx, cast(x as int) as x, cast(y as int) as y, r, g, b from vis")
def _(spark, d):
    return _roi_samples(spark, d).select("crop_id", "path", "box_index", F.col("idx").cast("int").alias("idx"), "x", "y", "r", "g", "b")


@query("roi_observed_palettes", sql.with_(*_ROI_PAL) + f"select split_part(crop_id, '#', 1) as path, cast(split_part(crop_id, '#', 2) as int) as box_index, cast(rank as int) as rank, rgb24 >> 16 as r, (rgb24 >> 8) & 255 as g, rgb24 & 255 as b, {r6('weight')} as weight from pk")
def _(spark, d):
    return _roi_palettes(spark, d).withColumn("weight", _r("weight", "weight"))


@query(
    "roi_nested_palettes",
    sql.with_(*_ROI_PAL, "bp as (select split_part(crop_id, '#', 1) as path, cast(split_part(crop_id, '#', 2) as int) as box_index, string_agg(printf('#%06X', rgb24), ' ' order by rank) as colours, round(sum(round(weight, 6)), 5) as weight from pk group by crop_id)")
    + "select path, count(*) as boxes_n, string_agg(box_index || ': ' || colours, ', ' order by box_index) as boxes, round(sum(weight), 3) + 0e0 as weight from bp group by path",
)
def _(spark, d):
    box = lambda b: F.concat(b["box_index"].cast("string"), F.lit(": "), F.array_join(F.transform(b["palette"], lambda e: e["hex"]), " "))
    # as the SQL: each box's sum at five places, a half of the binary value up
    of_box = lambda b: F.round(F.aggregate(b["palette"], F.lit(0.0), lambda t, e: t + e["weight"]) * 1e5, 0) / 1e5
    mass = F.aggregate("boxes", F.lit(0.0), lambda t, b: t + of_box(b))
    return roi.nested(_roi_palettes(spark, d)).select("path", "boxes_n", F.array_join(F.transform("boxes", box), ", ").alias("boxes"), (F.round(mass, 3) + 0.0).alias("weight"))


@query("resize_geometry", "with i as (select c_custkey as id, cast(100 + c_custkey * 37 % 1900 as int) as w, cast(90 + c_custkey * 53 % 1400 as int) as h from customer) select id, w as width, h as height, case when least(w, h) <= 256 then w else cast(ceil(greatest(round_even(w * 256 / cast(least(w, h) as double), 0), 1) / 16) * 16 as int) end as new_width, case when least(w, h) <= 256 then h else cast(ceil(greatest(round_even(h * 256 / cast(least(w, h) as double), 0), 1) / 16) * 16 as int) end as new_height from i")
def _(spark, d):
    k = F.col("c_custkey")
    i = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), (100 + k * 37 % 1900).cast("int").alias("width"), (90 + k * 53 % 1400).cast("int").alias("height"))
    w, h = sampling.shrunk_size(F.col("width"), F.col("height"))
    return i.withColumns({"new_width": w, "new_height": h})


@query("box_stats", sql.with_(sql.BOXES, "n as (select path, count(*) as n from clamped group by path)") + f"select count(*) as images, {r6('avg(n)')} as mean, {r6('quantile_cont(cast(n as double), 0.5)')} as p50, {r6('quantile_cont(cast(n as double), 0.95)')} as p95, min(n) as least, max(n) as most from n")
def _(spark, d):
    n = sampling.clamp_boxes(_boxes(spark, d)).groupBy("path").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("images"), _r(F.avg("n"), "mean"), _r(F.percentile("n", 0.5), "p50"), _r(F.percentile("n", 0.95), "p95"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("small_palettes", sql.with_(sql.BASE, sql.Q12_PALETTE, "n as (select crop_id, count(*) as n from qpal group by crop_id)") + f"select {r6('avg(case when n < 5 then 1e0 else 0e0 end)')} as below_five, {r6('avg(n)')} as mean_size from n")
def _(spark, d):
    n = histogram.q12_palette(_hist(spark, d)).groupBy("crop_id").agg(F.count("*").alias("n"))
    return n.agg(_r(F.avg((F.col("n") < 5).cast("double")), "below_five"), _r(F.avg("n"), "mean_size"))


@query("throughput_trials", sql.with_(sql.OBSERVATIONS, "t as (select method, event_id % 5 as trial, count(*) / greatest(sum(elapsed_ms) / 1000, 1e-12) as rate from obs group by all)") + "select method, round(avg(rate), 4) as mean, round(quantile_cont(rate, 0.5), 4) as p50, round(quantile_cont(rate, 0.95), 4) as p95 from t group by method")
def _(spark, d):
    rate = F.count("*") / F.greatest(F.sum("elapsed_ms") / 1000, F.lit(1e-12))
    t = _obs(spark, d).groupBy("method", (F.col("event_id") % 5).alias("trial")).agg(rate.alias("rate"))
    return t.groupBy("method").agg(F.round(F.avg("rate"), 4).alias("mean"), F.round(F.percentile("rate", 0.5), 4).alias("p50"), F.round(F.percentile("rate", 0.95), 4).alias("p95"))


@query("latency_bars", sql.with_(sql.OBSERVATIONS, "p as (select method, quantile_cont(elapsed_ms, 0.95) as p95, count(distinct crop_id) as crops, max(elapsed_ms) as slowest from obs group by method)") + f"select method, {r6('p95 / max(p95) over ()')} as bar, crops, {r6('slowest')} as slowest from p")
def _(spark, d):
    p = _obs(spark, d).groupBy("method").agg(F.percentile("elapsed_ms", 0.95).alias("p95"), F.count_distinct("crop_id").alias("crops"), F.max("elapsed_ms").alias("slowest"))
    top = p.agg(F.max("p95").alias("top"))
    return p.crossJoin(F.broadcast(top)).select("method", _r(F.col("p95") / F.col("top"), "bar"), "crops", _r("slowest", "slowest"))


@query("segment_means", sql.with_(sql.SCENE) + f"select crop_id, x // 5 + 5 * (y // 5) as segment, count(*) as n, {r6('avg(r)')} as r, {r6('avg(g)')} as g, {r6('avg(b)')} as b from px group by all")
def _(spark, d):
    segment = (F.floor(F.col("x") / 5) + 5 * F.floor(F.col("y") / 5)).cast("int")
    return _px(spark, d).groupBy("crop_id", segment.alias("segment")).agg(F.count("*").alias("n"), *(_r(F.avg(c), c) for c in "rgb"))


@query("lockstep_mismatch", sql.with_(sql.OBSERVATIONS, "a as (select distinct crop_id from obs where method = 'view'), b as (select distinct crop_id from obs where method = 'purchase')") + "select coalesce(a.crop_id, b.crop_id) as crop_id, a.crop_id is null as missing_left, b.crop_id is null as missing_right from a full join b on a.crop_id = b.crop_id where a.crop_id is null or b.crop_id is null")
def _(spark, d):
    """Crops that one of two methods has observed and the other hasn't."""
    ids = lambda method: _obs(spark, d).filter(F.col("method") == method).select("crop_id").distinct()
    a, b = ids("view").withColumn("l", F.lit(True)), ids("purchase").withColumn("r", F.lit(True))
    met = a.join(b, "crop_id", "full").filter("l is null or r is null")
    return met.select("crop_id", F.col("l").isNull().alias("missing_left"), F.col("r").isNull().alias("missing_right"))


@query("external_results_join", sql.with_(sql.OBSERVATIONS, "x as (select event_id, route as kind, crop_id as id, coverage from obs), o as (select route as kind, crop_id as id, max(elapsed_ms) as slowest from obs group by all)") + f"select event_id, kind, id, {r6('slowest')} as slowest from x join o using (kind, id)")
def _(spark, d):
    obs = _obs(spark, d).withColumnsRenamed({"route": "kind", "crop_id": "id"})
    slow = obs.groupBy("kind", "id").agg(F.max("elapsed_ms").alias("slowest"))
    return obs.select("event_id", "kind", "id").join(slow, ["kind", "id"]).select("event_id", "kind", "id", _r("slowest", "slowest"))


@query("method_set_operations", sql.with_(sql.OBSERVATIONS, "a as (select crop_id from obs where route = 'flat'), b as (select crop_id from obs where route = 'texture')") + "select 'both' as side, count(*) as n from (select * from a intersect select * from b) union all select 'flat only', count(*) from (select * from a except select * from b) union all select 'any', count(*) from (select * from a union select * from b)")
def _(spark, d):
    obs = _obs(spark, d)
    a, b = (obs.filter(F.col("route") == r).select("crop_id") for r in ("flat", "texture"))
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "flat only")).unionByName(count(a.union(b).distinct(), "any"))


@query("method_order", sql.with_(sql.OBSERVATIONS) + "select method, row_number() over (order by list_position(['view', 'click', 'purchase', 'signup', 'logout'], method) nulls last, method) as place from (select distinct method from obs)")
def _(spark, d):
    known = F.array(*map(F.lit, ("view", "click", "purchase", "signup", "logout")))
    place = F.nullif(F.array_position(known, F.col("method")), F.lit(0))
    # a handful of methods
    w = Window.orderBy(place.asc_nulls_last(), "method")
    return _obs(spark, d).select("method").distinct().select("method", F.row_number().over(w).alias("place"))


# Kernels: checked by properties, not by SQL


def _method(name: str) -> Query:
    return lambda spark, d: methods.extract(_px(spark, d), name)


for _name in methods.METHODS:
    if _name not in ("adaptive_v1", "tencent_hsv", "tencent_hsv_weighted_observed"):
        QUERIES[f"palette_{_name}"] = _method(_name)


@query("palette_oklab_kmeans")
def _(spark, d):
    return clustering.cluster(_hist(spark, d), "oklab_kmeans")


@query("palette_liq_like_observed")
def _(spark, d):
    hist = _hist(spark, d)
    return observed.pruned(observed.remap_nearest(clustering.cluster(hist, "liq_like"), hist, prune=False))


@query("palette_oklab_kmeans_observed")
def _(spark, d):
    hist = _hist(spark, d)
    return observed.nearest(clustering.cluster(hist, "oklab_kmeans"), hist)


@query("shared_channel_centres")
def _(spark, d):
    image = F.floor(F.col("crop_id") / 4).cast("int").alias("image_id")
    return clustering.shared_centres(_hist(spark, d).select(image, F.col("crop_id").alias("box_index"), "rgb24", "n"))
