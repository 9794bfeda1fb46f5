"""SQL of the colour queries for an independent engine.

Written apart from the DataFrame operators, as common table expressions that
build on each other: px (pixels), vis (visible, with weight), hist, and so on.
"""

from __future__ import annotations

from chromaloom.functions.color import FROM_LAB, FROM_LMS, TO_LAB, TO_LMS

SCENE = """px as (
  with o as (
    select l_suppkey as crop_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity,
        l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 as idx,
      l_partkey as pk, l_orderkey as ok, cast(floor(l_quantity) as int) as q, cast(round(l_discount * 100) as int) as d,
      cast(round(l_tax * 100) as int) as t, l_returnflag as f
    from lineitem),
  g as (select *, cast(idx % 25 as int) as x, cast(floor(idx / 25) as int) as y from o)
  select cast(crop_id as int) as crop_id, cast(idx as int) as idx, x, y,
    cast(case crop_id % 4 when 0 then case when idx % 16 = 0 then pk % 256 else (crop_id * 37) % 256 end
      when 1 then 60 + (crop_id * 7) % 120 + pk % 7 when 2 then 20 + x * 9 else cast(floor(q / 10) as int) * 50 end as int) as r,
    cast(case crop_id % 4 when 0 then case when idx % 16 = 0 then ok % 256 else (crop_id * 73) % 256 end
      when 1 then 80 + (crop_id * 5) % 100 + ok % 7 when 2 then 50 + x * 5 else d * 25 end as int) as g,
    cast(case crop_id % 4 when 0 then case when idx % 16 = 0 then (q * 5) % 256 else (crop_id * 151) % 256 end
      when 1 then 90 + (crop_id * 3) % 100 + q % 7 when 2 then 170 - x * 5 else t * 31 end as int) as b,
    case when f = 'R' and crop_id % 5 = 0 then 0 when f = 'A' then 128 else 255 end as a
  from g)"""

SYNTHETIC = """px as (
  with i as (select cast(range as int) as idx, cast(range % 256 as int) as x, cast(range // 256 as int) as y from range(65536)),
  k as (select *, (x // 16 + y // 16) % 4 as c, x between 32 and 223 and y between 32 and 223 as inside, x / 255e0 as z from i)
  select 'solid' as crop_id, idx, x, y, 210 as r, 74 as g, 67 as b, 255 as a from k
  union all select 'linear_gradient', idx, x, y, cast(floor(25 * (1 - z) + 241 * z) as int), cast(floor(71 * (1 - z) + 176 * z) as int), cast(floor(164 * (1 - z) + 55 * z) as int), 255 from k
  union all select 'four_color_texture', idx, x, y, [24, 229, 238, 49][c + 1], [63, 111, 202, 132][c + 1], [92, 65, 104, 109][c + 1], 255 from k
  union all select 'transparent_fill', idx, x, y, if(inside, 92, 255), if(inside, 211, 0), if(inside, 142, 255), if(inside, 255, 0) from k
  union all select 'gray_gradient', idx, x, y, cast(floor(28 + x * 194 / 255e0) as int), cast(floor(28 + x * 194 / 255e0) as int), cast(floor(28 + x * 194 / 255e0) as int), 255 from k)"""

VIS = """vis as (
  select crop_id, idx, x, y, r, g, b, a, case when seen then cast(cast(a / 255e0 as float) as double) else 1e0 end as w
  from (select *, bool_or(a >= 8) over (partition by crop_id) as seen from px) where a >= 8 or not seen)"""
HIST = """hist as (
  select crop_id, r, g, b, r * 65536 + g * 256 + b as rgb24, sum(w) as mass, count(*) as n, min(idx) as min_idx from vis group by all)"""
BASE = f"{SCENE},\n{VIS},\n{HIST}"
Q12 = """q12b as (
  select *, mass / greatest(sum(mass) over (partition by crop_id), 1e-12) as ratio, row_number() over (partition by crop_id order by round(mass, 9) desc, q12) as rank
  from (select crop_id, (r >> 4) * 256 + (g >> 4) * 16 + (b >> 4) as q12, sum(mass) as mass, sum(n) as n from hist group by all))"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0e0"


def lab(r: str = "r", g: str = "g", b: str = "b", p: str = "o") -> str:
    """Select items {p}1, {p}2, {p}3: Oklab of a colour."""
    c = [f"{x} / 255e0" for x in (r, g, b)]
    lin = ", ".join(f"case when {x} <= 0.04045e0 then {x} / 12.92e0 else pow(({x} + 0.055e0) / 1.055e0, 2.4e0) end as {p}_c{i}" for i, x in enumerate(c))
    dot = lambda row, n: " + ".join(f"({v!r}e0) * {p}_{n}{i}" for i, v in enumerate(row))
    root = ", ".join(f"cbrt({dot(row, 'c')}) as {p}_r{i}" for i, row in enumerate(TO_LMS))
    out = ", ".join(f"{dot(row, 'r')} as {p}{i + 1}" for i, row in enumerate(TO_LAB))
    return f"{lin}, {root}, {out}"


def unlab(p: str = "o") -> str:
    """Select items {p}r, {p}g, {p}b: RGB of an Oklab colour {p}1..3."""
    dot = lambda row, n: " + ".join(f"({float(v)!r}e0) * {n}{i}" for i, v in enumerate(row))
    lms = ", ".join(f"pow({' + '.join(f'({float(v)!r}e0) * {p}{i + 1}' for i, v in enumerate(row))}, 3e0) as {p}_m{i}" for i, row in enumerate(FROM_LAB))
    lin = ", ".join(f"greatest(0e0, least(1e0, {dot(row, f'{p}_m')})) as {p}_n{i}" for i, row in enumerate(FROM_LMS))
    out = ", ".join(f"cast(round_even((case when {p}_n{i} <= 0.0031308e0 then 12.92e0 * {p}_n{i} else 1.055e0 * pow({p}_n{i}, 1 / 2.4e0) - 0.055e0 end) * 255, 0) as int) as {p}{c}" for i, c in enumerate("rgb"))
    return f"{lms}, {lin}, {out}"


def dist(a: str, b: str) -> str:
    """Oklab distance of two prefixes such as ``t.o`` and ``u.o``."""
    return "sqrt(" + " + ".join(f"({a}{i} - {b}{i}) * ({a}{i} - {b}{i})" for i in (1, 2, 3)) + ")"


def hsv(source: str, out: str) -> str:
    """A CTE ``out``: ``source`` with hue, sat, val and hbin."""
    return f"""{out} as (
  select *, case when sat < 0.08e0 then 960 + least(cast(floor(val * 4) as int), 3)
    else least(cast(floor(hue * 60) as int), 59) * 16 + least(cast(floor(sat * 4) as int), 3) * 4 + least(cast(floor(val * 4) as int), 3) end as hbin
  from (select * exclude (rr, gg, bb, lo, sector), case when val - lo > 1e-12 then (sector / 6) - floor(sector / 6) else 0e0 end as hue,
      case when val > 1e-12 then (val - lo) / val else 0e0 end as sat
    from (select *, case when val - lo <= 1e-12 then 0e0 when rr = val then ((gg - bb) / (val - lo)) - 6 * floor((gg - bb) / (val - lo) / 6)
          when gg = val then (bb - rr) / (val - lo) + 2 else (rr - gg) / (val - lo) + 4 end as sector
      from (select *, r / 255e0 as rr, g / 255e0 as gg, b / 255e0 as bb, greatest(rr, gg, bb) as val, least(rr, gg, bb) as lo from {source}))))"""


def nearest(source: str, by: str, out: str) -> str:
    """A CTE ``out``: of each group of ``source`` the observed colour nearest to
    the weighted mean. ``source`` has r, g, b, mass and min_idx."""
    return f"""{out} as (
  with m as (select {by}, sum(mass * r) / sum(mass) as mr, sum(mass * g) / sum(mass) as mg, sum(mass * b) / sum(mass) as mb, sum(mass) as group_mass from {source} group by {by}),
  l as (select *, {lab("mr", "mg", "mb", "m_")} from m),
  s as (select *, {lab()} from {source}),
  d as (select s.*, l.group_mass, row_number() over (partition by {", ".join("s." + x.strip() for x in by.split(","))} order by round({dist("s.o", "l.m_")}, 9), min_idx, s.r, s.g, s.b) as place
    from s join l using ({by}))
  select {by}, r, g, b, group_mass as mass from d where place = 1)"""


def greedy(cand: str, out: str, least: float, k: int) -> str:
    """CTEs for the greedy choice from ``cand(crop_id, rank, ..., o1, o2, o3)``;
    ``out(crop_id, step, rank)``."""
    parts = [f"{out}_1 as (select crop_id, 1 as step, min(rank) as rank from {cand} group by crop_id)"]
    for i in range(2, k + 1):
        p = f"{out}_{i - 1}"
        parts.append(f"""{out}_{i} as (select * from {p} union all
  select c.crop_id, {i}, min(c.rank) from {cand} c join (select crop_id, max(rank) as top, count(*) as n from {p} group by crop_id) m using (crop_id)
  where m.n = {i - 1} and c.rank > m.top and not exists (
    select 1 from {p} s join {cand} e on e.crop_id = s.crop_id and e.rank = s.rank where s.crop_id = c.crop_id and round({dist("e.o", "c.o")}, 9) < {least}e0)
  group by c.crop_id)""")
    parts.append(f"{out} as (select * from {out}_{k})")
    return ",\n".join(parts)


def picks(scored: str, out: str, k: int, reuse: bool) -> str:
    """CTEs for picks without reuse from ``scored(crop_id, rank, weight, rgb24,
    score)``; ``out(crop_id, rank, rgb24, weight)``."""
    parts = [f"{out}_0 as (select cast(null as int) as crop_id, 0 as rank, cast(null as int) as rgb24, 0e0 as weight where false)"]
    for i in range(1, k + 1):
        p = f"{out}_{i - 1}"
        taken = f"exists (select 1 from {p} t where t.crop_id = s.crop_id and t.rgb24 = s.rgb24)"
        parts.append(f"""{out}_{i} as (select * from {p} union all
  select crop_id, rank, rgb24, weight from (
    select *, row_number() over (partition by crop_id order by {"taken, " if reuse else ""}score, rgb24) as place
    from (select s.*, {taken} as taken from {scored} s where s.rank = {i}) {"" if reuse else "where not taken"}) where place = 1)""")
    parts.append(f"{out} as (select * from {out}_{k})")
    return ",\n".join(parts)


Q12_PALETTE = ",\n".join(
    [
        Q12,
        "q_in as (select h.*, t.q12, t.rank, t.ratio from hist h join q12b t on h.crop_id = t.crop_id and t.q12 = (h.r >> 4) * 256 + (h.g >> 4) * 16 + (h.b >> 4) where t.rank <= 15 and t.mass > 0)",
        nearest("q_in", "crop_id, q12, rank, ratio", "q_rep"),
        f"q_cand as (select *, {lab()} from q_rep)",
        greedy("q_cand", "q_sel", 0.018, 5),
        "qpal as (select c.crop_id, s.step as rank, c.r, c.g, c.b, c.ratio as weight, c.q12 from q_sel s join q_cand c on c.crop_id = s.crop_id and c.rank = s.rank)",
    ]
)
#: Means of the five heaviest q12 bins: a palette that is not observed.
MEANS = """meanpal as (
  select t.crop_id, t.rank, cast(round_even(sum(h.mass * h.r) / sum(h.mass), 0) as int) as r, cast(round_even(sum(h.mass * h.g) / sum(h.mass), 0) as int) as g,
    cast(round_even(sum(h.mass * h.b) / sum(h.mass), 0) as int) as b, any_value(t.ratio) as weight
  from hist h join q12b t on h.crop_id = t.crop_id and t.q12 = (h.r >> 4) * 256 + (h.g >> 4) * 16 + (h.b >> 4) where t.rank <= 5 group by t.crop_id, t.rank)"""
SAMPLE = """sam as (
  select * exclude (place) from (select *, row_number() over (partition by crop_id order by ((cast(idx as bigint) + cast(crop_id as bigint) % 2147483648 * 7919 + 1) % 2147483648 * 2654435761) % 4294967296, idx) as place from vis)
  where place <= 64)"""
STATS = f"""slab as (select *, {lab()} from sam),
smid as (select crop_id, median(o1) as m1, median(o2) as m2, median(o3) as m3, count(*) as n,
  sqrt((var_pop(r / 255e0) + var_pop(g / 255e0) + var_pop(b / 255e0)) / 3) as rgb_std from slab group by crop_id),
sspread as (select crop_id, median({dist("s.o", "m.m")}) as spread from slab s join smid m using (crop_id) group by crop_id),
smost as (select crop_id, max(c) as most from (select crop_id, count(*) as c from sam group by crop_id, r, g, b) group by crop_id),
stats as (select m.crop_id, m.n, s.spread, m.rgb_std, t.most / cast(m.n as double) as exact_ratio from smid m join sspread s using (crop_id) join smost t using (crop_id))"""
GRADIENT = """ext as (select crop_id, max(x) + 1 as width, max(y) + 1 as height from px group by crop_id),
gpos as (select s.*, s.x / cast(greatest(e.width - 1, 1) as double) - 0.5e0 as u, s.y / cast(greatest(e.height - 1, 1) as double) - 0.5e0 as v from slab s join ext e using (crop_id)),
gcov as (select crop_id, count(*) as n, var_pop(u) as uu, var_pop(v) as vv, covar_pop(u, v) as uv,
  var_pop(o1) as v1, var_pop(o2) as v2, var_pop(o3) as v3, covar_pop(u, o1) as u_1, covar_pop(u, o2) as u_2, covar_pop(u, o3) as u_3,
  covar_pop(v, o1) as v_1, covar_pop(v, o2) as v_2, covar_pop(v, o3) as v_3 from gpos group by crop_id),
gslope as (select *, uu * vv - uv * uv as det, det <= 1e-12 * (uu + vv) * (uu + vv) as flat, """ + ", ".join(
    f"coalesce(case when flat then u_{i} / nullif(uu + vv, 0) else (vv * u_{i} - uv * v_{i}) / det end, 0e0) as bx{i}, coalesce(case when flat then v_{i} / nullif(uu + vv, 0) else (uu * v_{i} - uv * u_{i}) / det end, 0e0) as by{i}"
    for i in (1, 2, 3)
) + """ from gcov),
grad as (select crop_id, case when n < 8 or (v1 + v2 + v3) * n <= 1e-12 then 0e0
    else least(1e0, greatest(0e0, (bx1 * u_1 + by1 * v_1 + bx2 * u_2 + by2 * v_2 + bx3 * u_3 + by3 * v_3) / (v1 + v2 + v3))) end as r2,
  sqrt(bx1 * bx1 + bx2 * bx2 + bx3 * bx3) as sx, sqrt(by1 * by1 + by2 * by2 + by3 * by3) as sy, sqrt(sx * sx + sy * sy) as size,
  case when size > 1e-12 and n >= 8 then sx / size else 1e0 end as dir_x, case when size > 1e-12 and n >= 8 then sy / size else 0e0 end as dir_y from gslope)"""
ROUTED = """routed as (
  select s.*, g.r2, g.dir_x, g.dir_y, t.ratio as top1,
    case when round(g.r2, 9) >= 0.84e0 and round(s.spread, 9) >= 0.035e0 and round(t.ratio, 9) < 0.22e0 then 'gradient'
      when round(t.ratio, 9) >= 0.88e0 or (round(t.ratio, 9) >= 0.55e0 and round(s.exact_ratio, 9) >= 0.25e0) or round(s.rgb_std, 9) < 0.008e0 then 'flat'
      when round(s.spread, 9) < 0.105e0 or round(t.ratio, 9) >= 0.35e0 then 'mild' else 'texture' end as route
  from stats s join grad g using (crop_id) join q12b t on t.crop_id = s.crop_id and t.rank = 1)"""
STOPS = ",\n".join(
    [
        """st_at as (select *, row_number() over (partition by crop_id order by round(cx * dir_x + cy * dir_y, 9), idx) - 1 as at, count(*) over (partition by crop_id) as total from (
  select s.crop_id, s.idx, s.r, s.g, s.b, g.dir_x, g.dir_y, s.x - avg(s.x) over (partition by s.crop_id) as cx, s.y - avg(s.y) over (partition by s.crop_id) as cy from sam s join grad g using (crop_id)))""",
        f"st_cand as (select t.crop_id, i + 1 as rank, t.r, t.g, t.b, {lab('t.r', 't.g', 't.b')} from st_at t, range(5) as k(i) where t.at = round_even(i * (t.total - 1) / 4e0, 0))",
        greedy("st_cand", "st_sel", 0.015, 5),
        "stops as (select s.crop_id, s.step, c.r, c.g, c.b from st_sel s join st_cand c on c.crop_id = s.crop_id and c.rank = s.rank)",
    ]
)
HEAVY_IN_TOP = """heavy as (
  select crop_id, r, g, b, ratio from (
    select h.crop_id, h.r, h.g, h.b, t.ratio, row_number() over (partition by h.crop_id order by round(h.mass, 9) desc, h.rgb24) as place
    from hist h join q12b t on h.crop_id = t.crop_id and t.rank = 1 and t.q12 = (h.r >> 4) * 256 + (h.g >> 4) * 16 + (h.b >> 4)) where place = 1)"""
CENTRE = f"""centre as (
  with m as (select crop_id, median(r) as mr, median(g) as mg, median(b) as mb from sam group by crop_id),
  l as (select *, {lab("mr", "mg", "mb", "m_")} from m)
  select crop_id, r, g, b from (select s.crop_id, s.r, s.g, s.b, row_number() over (partition by s.crop_id order by round({dist("s.o", "l.m_")}, 9), s.idx) as place from slab s join l using (crop_id)) where place = 1)"""
ADAPTIVE = ",\n".join(
    [
        BASE, Q12_PALETTE, SAMPLE, STATS, GRADIENT, ROUTED, STOPS, HEAVY_IN_TOP, CENTRE,
        """prim as (
  select t.*, case route when 'flat' then {'r': h.r, 'g': h.g, 'b': h.b} when 'mild' then {'r': c.r, 'g': c.g, 'b': c.b}
      when 'gradient' then {'r': s.r, 'g': s.g, 'b': s.b} else {'r': q.r, 'g': q.g, 'b': q.b} end as p, k.n as n_stops
  from routed t join heavy h using (crop_id) join centre c using (crop_id)
    join (select crop_id, count(*) as n from stops group by crop_id) k using (crop_id)
    join stops s on s.crop_id = t.crop_id and s.step = k.n // 2 + 1 join qpal q on q.crop_id = t.crop_id and q.rank = 1)""",
        """entries as (
  select crop_id, 0 as rank, p.r as r, p.g as g, p.b as b, case when route = 'flat' then top1 else greatest(0e0, 1 - spread * 4) end as weight from prim where route in ('flat', 'mild')
  union all select q.crop_id, q.rank, q.r, q.g, q.b, q.weight from qpal q join prim t using (crop_id) where route in ('flat', 'mild') and not (q.r = t.p.r and q.g = t.p.g and q.b = t.p.b)
  union all select q.crop_id, q.rank, q.r, q.g, q.b, q.weight from qpal q join prim t using (crop_id) where route = 'texture'
  union all select s.crop_id, s.step, s.r, s.g, s.b, 1e0 / t.n_stops from stops s join prim t using (crop_id) where route = 'gradient')""",
        """chosen as (select * from (select *, row_number() over (partition by crop_id order by rank) as place from entries) where place <= 5)""",
        """adaptive as (
  select t.crop_id, t.route, t.p.r as r, t.p.g as g, t.p.b as b, t.n, t.top1, t.spread, t.rgb_std, t.exact_ratio, t.r2,
    least(1e0, greatest(0e0, case t.route when 'flat' then 0.55e0 + 0.45e0 * t.top1 when 'mild' then greatest(0.25e0, least(0.95e0, 1 - t.spread * 4)) when 'gradient' then t.r2
      else least(0.95e0, greatest(0.2e0, (select sum(weight) from qpal q where q.crop_id = t.crop_id))) end)) as confidence,
    (select string_agg(printf('#%02X%02X%02X', c.r, c.g, c.b), ' ' order by c.place) from chosen c where c.crop_id = t.crop_id) as palette,
    (select string_agg(cast(greatest(0, least(65535, cast(round_even(c.weight * 65535, 0) as int))) as varchar), ' ' order by c.place) from chosen c where c.crop_id = t.crop_id) as weights
  from prim t)""",
    ]
)
OBSERVATIONS = """obs as (
  select user_id as crop_id, event_id, event_type as method, value as elapsed_ms, value * 0.25e0 as decode_ms, value * 0.75e0 as method_ms, user_id % 400 + 100 as pixels,
    ['flat', 'mild', 'gradient', 'texture'][event_id % 4 + 1] as route, event_id % 10 != 0 as observed, event_id % 97 / 10e0 as coverage, event_id % 53 / 10e0 as jpeg60,
    event_id % 31 / 10e0 as resize50, 'b' || cast(user_id % 12 as varchar) as batch from events)"""
BOXES = """boxes as (
  select 'img' || cast(c_custkey % 50 as varchar) as path, cast(c_custkey as int) as box_index, cast(c_custkey * 7 % 480 - 20 as int) as l, cast(c_custkey * 11 % 360 - 20 as int) as t,
    cast(c_custkey * 7 % 480 - 20 + c_custkey * 13 % 200 as int) as r, cast(c_custkey * 11 % 360 - 20 + c_custkey * 17 % 150 as int) as b, 480 as width, 360 as height from customer),
clamped as (select * from (select path, box_index, least(greatest(l, 0), width) as l, least(greatest(t, 0), height) as t, least(greatest(r, 0), width) as r, least(greatest(b, 0), height) as b from boxes) where r > l and b > t)"""
