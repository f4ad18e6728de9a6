"""DuckDB SQL that gives the same rows as the catalogue's queries."""

PIXELS = "px as (select l_orderkey, l_linenumber, l_extendedprice / 150000 as rho_toa, l_tax as rho_atm, l_discount as sph_alb from lineitem)"
STATES = "st as (select event_id, round(value / 50, 1) as aot, cast(user_id % 5 as double) as h from events)"
RASTER = """raster as (
  select cast(vec_id // 64 as int) as band, cast(vec_id % 64 as int) as iy, cast(p - 1 as int) as ix, (p - 1) - 31.5e0 as x, (vec_id % 64) - 31.5e0 as y, cast(embedding[p] as double) as v
  from (select vec_id, embedding, unnest(range(1, 65)) as p from embeddings))"""


def radial(source: str, keys: str, value: str, prefix: str = "") -> str:
    """CTEs ctr, rad, binned, sums, bins and prof of a table."""
    return f"""
ctr as (select {keys}, avg(x) as cx, avg(y) as cy, min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy, count(distinct ix) as nx, count(distinct iy) as ny from {source} group by {keys}),
far as (select *, greatest(abs(hx - cx), abs(lx - cx)) as fx, greatest(abs(hy - cy), abs(ly - cy)) as fy from ctr),
rad as (select {source}.*, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) as r, sqrt(fx * fx + fy * fy) as r_max, greatest(2, cast(floor((least(nx, ny) - 1) / sqrt(2e0)) as int) - 1) as npix from {source} join far using ({keys})),
binned as (select *, greatest(0, least(npix - 1, cast(ceil(r / (r_max / npix)) as int) - 1)) as bin from rad),
sums as (select {keys}, bin, count({value}) as n, avg({value}) as mean, stddev_pop({value}) as std from binned group by {keys}, bin),
bins as (select {keys}, r_max, npix, cast(unnest(range(npix)) as int) as bin from (select distinct {keys}, r_max, npix from rad)),
prof as (select {keys}, bin, case when bin = 0 then 0e0 else (bin + 0.5e0) * r_max / npix end as r, coalesce(n, 0) as n, mean, std from bins left join sums using ({keys}, bin))"""


def cdf(keys: str) -> str:
    return f"""
edge as (select *, lag(r) over w as rb, lead(r) over w as ra from prof window w as (partition by {keys} order by r)),
energy as (select *, case when mean is not null then greatest(mean, 0e0) end * pi() * (power(coalesce((r + ra) / 2, r + (r - rb) / 2), 2) - power(coalesce((rb + r) / 2, r - (ra - r) / 2), 2)) as e from edge),
run as (select *, case when sum(case when e is null then 1 else 0 end) over w = 0 then sum(e) over w end as c, case when sum(case when e is null then 1 else 0 end) over k = 0 then sum(e) over k end as total
  from energy window w as (partition by {keys} order by r rows unbounded preceding), k as (partition by {keys})),
cdf as (select *, case when total > 0 then c / total else c end as cdf from run)"""


R = f"with {RASTER}"
RR = f"{R}, {radial('raster', 'band', 'v')}"
SEGS = """segs as (select band, row_number() over w - 1 as seg, count(*) over (partition by band) - 1 as n_seg, r as x0, lead(r) over w as x1, mean as y0, lead(mean) over w as y1
  from prof where mean is not null window w as (partition by band order by r))"""
MASK = """weighed as (select *, case when sum(abs(resid)) over (partition by band order by r, iy, ix rows unbounded preceding) <= 0.99e0 * sum(abs(resid)) over (partition by band) then 1 else 0 end as mask,
  1 / (2 * pi() * greatest(r, min(case when r > 1e-3 then r end) over (partition by band))) as wr from resid)"""
METRICS = f"""{RR}, pairs as (select rad.*, n.v as t from rad join raster n on n.band = rad.band + 1 and n.iy = rad.iy and n.ix = rad.ix),
resid as (select *, (v - t) / greatest(max(abs(v)) over (partition by band), max(abs(t)) over (partition by band), 1.1920928955078125e-07) as resid from pairs), {MASK},
met as (select band, sum(mask * abs(resid)) / sum(mask) as mae, sum(mask * resid * resid) / sum(mask) as mse, sum(wr * abs(resid)) / sum(wr) as mae_rad, sum(wr * resid * resid) / sum(wr) as mse_rad from weighed group by band)"""
NATION = "par as (select n_nationkey, 0.5e0 + n_nationkey * 0.25e0 as sigma, 0.5e0 + n_nationkey * 0.1e0 as gamma, 1e0 + n_nationkey * 0.2e0 as alpha, 0.8e0 + n_nationkey * 0.05e0 as beta, 0.1e0 + n_nationkey * 0.01e0 as n from nation)"


def kernel(formula: str, lateral: str = "") -> str:
    return f"""with {NATION}, clamped as (select n_nationkey, sigma, gamma, alpha, beta, n{lateral} from par),
grid as (select *, sqrt(dx * dx + dy * dy) as r from clamped, (select cast(unnest(range(-5, 6)) as int) as dy), (select cast(unnest(range(-5, 6)) as int) as dx)),
k as (select n_nationkey, dy, dx, {formula} as k from grid)
select n_nationkey, dy, dx, round(k / sum(k) over (partition by n_nationkey), 9) as w from k"""


GAUSS5 = "kern as (select dy, dx, k / sum(k) over () as w from (select dy, dx, exp(-(dx * dx + dy * dy) / 2e0) as k from (select cast(unnest(range(-2, 3)) as int) as dy), (select cast(unnest(range(-2, 3)) as int) as dx)))"
BAND_VALUES = "(0, 'B01', 443e0), (1, 'B02', 490e0), (2, 'B03', 560e0), (3, 'B04', 665e0), (4, 'B05', 705e0), (5, 'B06', 740e0), (6, 'B07', 783e0), (7, 'B08', 842e0), (8, 'B8A', 865e0), (9, 'B09', 945e0), (10, 'B10', 1375e0), (11, 'B11', 1610e0), (12, 'B12', 2190e0)"
INV = "(rho_toa - rho_atm) / (sph_alb * (rho_toa - rho_atm) + 0.7e0 * 0.8e0)"
RADIATIVE = """
od as (select *, 0.008569e0 * pow(wl / 1000, -2) * pow(wl / 1000, -2) * (1 + 0.0113e0 * pow(wl / 1000, -2) + 0.00013e0 * pow(wl / 1000, -2) * pow(wl / 1000, -2)) * pow(1 - 6.5e0 * h / 288.15e0, 5.255e0) as ray, aot * pow(wl / 560e0, -1.3e0) as aer from grid),
g as (select *, ray + aer as od, 0.7e0 * aer / (ray + aer) as g, cos(radians(sza)) as mus, cos(radians(vza)) as muv from od),
rt as (select *, exp(-od / mus) as tdir_down, exp(-od / muv) as tdir_up,
  greatest(0, 1 / (1 + (1 - g) * (od / mus) * 0.75e0) * (1 - 0.02e0 * od / mus) - exp(-od / mus)) as tdif_down,
  greatest(0, 1 / (1 + (1 - g) * (od / muv) * 0.75e0) * (1 - 0.02e0 * od / muv) - exp(-od / muv)) as tdif_up,
  1 - 1 / (1 + (1 - g) * od * 0.75e0) as sph_alb,
  (1 - exp(-od * (1 / mus + 1 / muv))) / (4 * (mus + muv)) * (1 - g) as rho_atm from g)"""

SQL = {
    "five_s_inverse": f"with {PIXELS} select l_orderkey, l_linenumber, round({INV}, 6) as rho_unif from px",
    "five_s_forward": f"with {PIXELS} select l_orderkey, l_linenumber, round(rho_atm + 0.7e0 * 0.8e0 * rho_toa / (1 - sph_alb * rho_toa), 6) as rho from px",
    "five_s_roundtrip": f"with {PIXELS}, b as (select l_orderkey, l_linenumber, rho_toa as t, rho_atm + 0.7e0 * 0.8e0 * ({INV}) / (1 - sph_alb * ({INV})) as back from px) select l_orderkey, l_linenumber, abs(back - t) < 1e-9 as same, round(back, 6) as rho_toa from b",
    "direct_transmittance_sweep": f"with {PIXELS} select aot, sza, round(avg(rho_toa * exp(-aot / cos(radians(sza)))), 6) as mean_rho, count(*) as n from px, (values (0.05e0), (0.1e0), (0.3e0)) a(aot), (values (0e0), (30e0), (60e0)) s(sza) group by aot, sza",
    "surface_pressure": f"with {STATES} select event_id, round(1013.25e0 * pow(1 - 6.5e0 * h / 288.15e0, 5.255e0), 6) as pressure from st",
    "surface_recovery": f"""{R}, env as (select a.band, a.iy, a.ix, a.v, sum(b.v) / 9 as env from raster a join raster b on a.band = b.band and abs(a.iy - b.iy) <= 1 and abs(a.ix - b.ix) <= 1 group by all)
select band, iy, ix, round((v * 0.7e0 * (1 - env * 0.1e0) / (1 - v * 0.1e0) - env * 0.1e0) / 0.6e0, 6) as rho_s from env""",
    "digitize_levels": "with s as (select min(value) as lo, max(value) as hi from events) select event_id, round(lo + (hi - lo) / 7 * least(7, floor((value - lo) / ((hi - lo) / 7) + 0.5e0)), 6) as level from events, s",
    "albedo_quantize": f"""{R}, s as (select band, greatest(0, min(v)) as lo, max(v) as hi, max(iy) as my, max(ix) as mx from raster group by band),
l as (select band, iy, ix, lo, (hi - lo) / 39e0 as step, v from raster join s using (band)),
inner_ as (select band, iy, ix, cast(greatest(0, least(39, round_even((v - lo) / step, 0))) as int) as level, lo, step from l)
select band, iy, ix, level, round_even(lo + step * level, 4) as albedo from inner_
union all select band, cast(unnest(range(-1, my + 1)) as int), -1, -1, null from s
union all select band, -1, cast(unnest(range(0, mx + 1)) as int), -1, null from s""",
    "species_normalize": "with n as (select p_brand, p_type, cast(count(*) as double) as n from part group by all), t as (select *, sum(n) over (partition by p_brand) as t from n) select p_brand, p_type as species, round(case when abs(t - 1) > 1e-2 then n / t else n end, 6) as share from t",
    "sat_position": "select s_suppkey, round(round_even(700 * tan(radians(s_suppkey % 60)) * cos(radians(180e0 - s_suppkey % 360)), 4), 3) as dx, round(round_even(700 * tan(radians(s_suppkey % 60)) * sin(radians(180e0 - s_suppkey % 360)), 4), 3) as dy from supplier",
    "sensor_grid": """with s as (select n_nationkey, n_nationkey * 2e0 as vza, n_nationkey * 14e0 as vaa, iy, ix, (ix - 2) * 0.5e0 as x, (iy - 2) * 0.5e0 as y from nation, (select cast(unnest(range(5)) as int) as iy), (select cast(unnest(range(5)) as int) as ix))
select n_nationkey, iy, ix, round(x + 700 * tan(radians(vza)) * cos(radians(vaa)), 6) as pos_x, round(y + 700 * tan(radians(vza)) * sin(radians(vaa)), 6) as pos_y, 700e0 as pos_z, 180 - vza as th_deg, (vaa + 180) % 360 as ph_deg from s""",
    "radial_sensors": """with s as (select n_nationkey, n_nationkey * 2e0 as vza, n_nationkey * 14e0 as vaa, j, j * 0.25e0 as r from nation, (select cast(unnest(range(10)) as int) as j))
select n_nationkey, j, round(-r * sin(radians(vaa)) + 700 * tan(radians(vza)) * cos(radians(vaa)), 6) as pos_x, round(r * cos(radians(vaa)) + 700 * tan(radians(vza)) * sin(radians(vaa)), 6) as pos_y, 700e0 as pos_z, 180 - vza as th_deg, (vaa + 180) % 360 as ph_deg from s""",
    "gaussian_scene": """with g as (select r_regionkey as band, iy, ix, (ix - 7.5e0) * 0.5e0 as x, (iy - 7.5e0) * 0.5e0 as y from region, (select cast(unnest(range(16)) as int) as iy), (select cast(unnest(range(16)) as int) as ix))
select band, iy, ix, round(cast(cast(0.2e0 + (0.8e0 - 0.2e0) * exp(-(x * x + y * y) / 18) as float) as double), 5) as rho_s from g""",
    "disk_scene": """with g as (select r_regionkey as band, iy, ix, (ix - 8) * 0.5e0 as x, (iy - 8) * 0.5e0 as y from region, (select cast(unnest(range(17)) as int) as iy), (select cast(unnest(range(17)) as int) as ix))
select band, iy, ix, case when x * x + y * y <= 4 then 0.75e0 else 0.25e0 end as rho_s from g""",
    "npy_export_names": f"with {STATES} select distinct 'rho_s__aot=' || cast(aot as varchar) || '__h=' || cast(h as varchar) || '__S2Band.B02.npy' as name from st",
    "dedup_index": f"with {STATES}, u as (select distinct aot, h from st) select aot, h, row_number() over (order by aot nulls first, h nulls first) - 1 as state from u",
    "dedup_expand": f"with {STATES} select event_id, aot, h, round(1013.25e0 * pow(1 - 6.5e0 * h / 288.15e0, 5.255e0) * exp(-aot), 6) as pressure from st",
    "sel_label": f"{R} select band, ix, round(v, 6) as v from raster where iy = 3",
    "isel_slice": f"{R} select band, iy, ix, round(v, 6) as v from raster where iy >= 4 and iy < 9 and ix >= 10 and ix < 20",
    "nearest_label": f"with {STATES}, u as (select distinct h, aot from st), n as (select *, row_number() over (partition by h order by abs(aot - 0.53e0), aot) as k from u) select h, aot from n where k = 1",
    "reindex_grid": f"{R} select band, iy, ix, round(case when v > 0 then v end, 6) as v from raster",
    "valid_mask": f"{R} select band, iy, ix, iy between 5 and 24 and ix between 7 and 36 as valid from raster",
    "nearest_band": f"with b(n, band_id, wl_nm) as (values {BAND_VALUES}), d as (select p_partkey, band_id, wl_nm, row_number() over (partition by p_partkey order by abs(p_retailprice - wl_nm), n) as k from part, b) select p_partkey, band_id, wl_nm from d where k = 1",
    "sweep_union": f"with {STATES}, u as (select distinct aot, h from st) select aot, h, round(case when aot < 1 then exp(-aot) * (1 + h) else exp(-aot) end, 6) as value from u",
    "chunked_sweep": f"with {STATES}, u as (select distinct aot, h from st), c as (select aot, cast((row_number() over (order by aot) - 1) // 4 as int) as chunk from (select distinct aot from u)) select chunk, round(sum(exp(-aot)), 6) as total, count(*) as n from u join c using (aot) group by chunk",
    "block_reduce": f"{R}, s as (select band, max(iy) + 1 as ny, max(ix) + 1 as nx from raster group by band) select band, cast(iy // 3 as int) as by, cast(ix // 3 as int) as bx, round(avg(v), 6) as v from raster join s using (band) where iy < ny - ny % 3 and ix < nx - nx % 3 group by all",
    "best_step": "with o as (select user_id, value, event_id, row_number() over (partition by user_id order by value nulls first, event_id) as k from events) select user_id, round(value, 6) as loss, event_id from o where k = 1",
    "radial_mean": f"{RR} select band, bin, round(r, 6) as r, n, round(mean, 6) as mean from prof",
    "radial_std": f"{RR} select band, bin, round(std, 6) as std from prof",
    "radial_cdf": f"{RR}, {cdf('band')} select band, bin, round(cdf, 6) as cdf from cdf",
    "energy_mask": f"""{RR}, m as (select band, case when sum(abs(v)) over (partition by band order by r, iy, ix rows unbounded preceding) <= 0.99e0 * sum(abs(v)) over (partition by band) then 1 else 0 end as mask from rad)
select band, cast(sum(mask) as bigint) as kept, count(*) as n from m group by band""",
    "encircled_energy": f"""with {NATION}, grid as (select n_nationkey, dy + 20 as iy, dx + 20 as ix, cast(dy as double) as y, cast(dx as double) as x, exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)) as k from par, (select cast(unnest(range(-20, 21)) as int) as dy), (select cast(unnest(range(-20, 21)) as int) as dx)),
raster as (select *, k / sum(k) over (partition by n_nationkey) as w from grid), {radial('raster', 'n_nationkey', 'w')}, {cdf('n_nationkey')}
select n_nationkey, round(coalesce(min(case when cdf >= 0.1e0 then r end), max(r)), 6) as r_10, round(coalesce(min(case when cdf >= 0.5e0 then r end), max(r)), 6) as r_50, round(coalesce(min(case when cdf >= 0.99e0 then r end), max(r)), 6) as r_99 from cdf group by n_nationkey""",
    "linear_interp": f"""{RR}, {SEGS}, q as (select band, cast(k as int) as k, least(greatest(k * 0.75e0, lo), hi) as q from (select band, min(r) as lo, max(r) as hi from prof where mean is not null group by band), (select unnest(range(61)) as k))
select q.band, k, round(y0 + (y1 - y0) * (q - x0) / (x1 - x0), 6) as v from q join segs s on s.band = q.band and x1 is not null and (q >= x0 or seg = 0) and (q < x1 or seg = n_seg - 1)""",
    "adaptive_radii": f"""{RR}, p as (select band, r, mean as v, lag(r) over w as rb, lead(r) over w as ra, lag(mean) over w as vb, lead(mean) over w as va from prof where mean is not null window w as (partition by band order by r)),
g as (select band, r, abs(coalesce(-(ra - r) / ((r - rb) * (ra - rb)) * vb + (ra - 2 * r + rb) / ((r - rb) * (ra - r)) * v + (r - rb) / ((ra - r) * (ra - rb)) * va, (va - v) / (ra - r), (v - vb) / (r - rb))) as d from p),
s as (select band, r, coalesce((lag(d) over w + d) / 2 * (r - lag(r) over w), 0) as s from g window w as (partition by band order by r)),
c as (select band, r, sum(s) over (partition by band order by r rows unbounded preceding) / sum(s) over (partition by band) as c from s),
u as (select band, c, max(r) as r from c group by band, c),
seg as (select band, c as x0, r as y0, lead(c) over w as x1, lead(r) over w as y1, row_number() over w - 1 as seg, count(*) over (partition by band) - 1 as n_seg from u window w as (partition by band order by c)),
q as (select band, cast(j as int) as j, least(greatest(j / 11e0, lo), hi) as q from (select band, min(c) as lo, max(c) as hi from u group by band), (select unnest(range(12)) as j))
select q.band, j, round(y0 + (y1 - y0) * (q - x0) / (x1 - x0), 5) as radius from q join seg on seg.band = q.band and x1 is not null and (q >= x0 or seg = 0) and (q < x1 or seg = n_seg - 1)""",
    "gap_fill": f"""{RR}, g as (select band, r, lead(r) over (partition by band order by r) - r as gap from prof), k as (select *, case when gap > 0.4e0 then cast(ceil(gap / 0.4e0) as int) else 1 end as parts from g)
select band, round(r + coalesce(gap, 0) * i / parts, 6) as r from (select *, unnest(range(parts)) as i from k)""",
    "pchip_field": f"""{RR}, {SEGS}, h as (select *, x1 - x0 as h, (y1 - y0) / (x1 - x0) as d from segs where x1 is not null),
nb as (select *, lag(h) over w as hb, lag(d) over w as db, lead(h) over w as ha, lead(d) over w as da from h window w as (partition by band order by x0)),
e as (select *, ((2 * h + ha) * d - h * da) / (h + ha) as e0, ((2 * h + hb) * d - h * db) / (h + hb) as e1 from nb),
m as (select *,
  case when hb is not null then case when db * d <= 0 then 0 else (3 * h + 3 * hb) / ((2 * h + hb) / db + (h + 2 * hb) / d) end
       when ha is not null then case when sign(e0) <> sign(d) then 0 when sign(d) <> sign(da) and abs(e0) > 3 * abs(d) then 3 * d else e0 end else d end as m0,
  case when ha is not null then case when d * da <= 0 then 0 else (3 * ha + 3 * h) / ((2 * ha + h) / d + (ha + 2 * h) / da) end
       when hb is not null then case when sign(e1) <> sign(d) then 0 when sign(d) <> sign(db) and abs(e1) > 3 * abs(d) then 3 * d else e1 end else d end as m1 from e),
t as (select rad.band, iy, ix, (r - x0) / h as t, m.* exclude (band) from rad join m on m.band = rad.band and (r >= x0 or seg = 0) and (r < x1 or seg = n_seg - 1))
select band, iy, ix, round((2 * t * t * t - 3 * t * t + 1) * y0 + (t * t * t - 2 * t * t + t) * h * m0 + (3 * t * t - 2 * t * t * t) * y1 + (t * t * t - t * t) * h * m1, 6) as v from t""",
    "transect": f"""{R}, e as (select band, avg(x) as cx, min(x) as lx, max(x) as hx, avg(y) as cy, min(y) as ly, max(y) as hy, max(ix) as mx, max(iy) as my from raster group by band),
r as (select *, least(hx - cx, cx - lx, hy - cy, cy - ly) as rm from e), l as (select *, -rm + 2 * rm * j / 20 as s from r, (select cast(unnest(range(21)) as int) as j)),
p as (select *, (cx + s * cos(radians(30e0)) - lx) / ((hx - lx) / mx) as px, (cy + s * sin(radians(30e0)) - ly) / ((hy - ly) / my) as py from l),
k as (select *, greatest(0, least(mx - 1, cast(floor(px) as int))) as kx, greatest(0, least(my - 1, cast(floor(py) as int))) as ky from p),
c as (select band, j, s, ky + a as iy, kx + b as ix, (case when a = 1 then py - ky else 1 - (py - ky) end) * (case when b = 1 then px - kx else 1 - (px - kx) end) as w from k, (values (0), (1)) i(a), (values (0), (1)) o(b))
select band, j, round(s, 6) as s, round(case when count(v) = 4 then sum(v * w) end, 6) as v from c left join raster using (band, iy, ix) group by band, j, s""",
    "psf_conv_small": f"{R}, {GAUSS5} select a.band, a.iy, a.ix, round(sum(b.v * w), 6) as v_conv from raster a join kern on true join raster b on b.band = a.band and b.iy = a.iy - dy and b.ix = a.ix - dx group by all",
    "residual_metrics": f"{METRICS} select band, round(mae, 6) as mae, round(mse, 6) as mse, round(sqrt(mse), 6) as rmse, round(mae_rad, 6) as mae_rad, round(mse_rad, 6) as mse_rad, round(sqrt(mse_rad), 6) as rmse_rad from met",
    "weighted_loss": f"{METRICS} select cast(band % 2 as int) as half, round(sum(mse_rad / (band + 1)), 6) as loss from met group by 1",
    "forward_pipeline": f"""{R}, grid as (select 490e0 as wl, aot, 0e0 as h, 30e0 as sza, 5e0 as vza from (values (0.1e0), (0.2e0), (0.4e0)) a(aot)), {RADIATIVE},
toa as (select band, aot, iy, ix, x, y, rho_atm + (tdir_up + tdif_up) * (tdir_down + tdif_down) * (0.3e0 + 0.05e0 * v) / (1 - sph_alb * (0.3e0 + 0.05e0 * v)) as rho_toa from raster, rt), {radial('toa', 'band, aot', 'rho_toa')}
select band, aot, bin, n, round(mean, 6) as mean from prof""",
    "psf_gaussian": kernel("exp(-r * r / (2 * sigma * sigma))"),
    "psf_generalized_gaussian": kernel("exp(-pow(r / least(sigma, 1), n))"),
    "psf_king": kernel("pow(1 + r * r / (2 * sigma * sigma * gamma), -gamma)"),
    "psf_moffat": kernel("pow(1 + pow(r / alpha, 2 * beta), -gamma)"),
    "psf_voigt": kernel(
        "eta / (1 + (r / gamma) * (r / gamma)) + (1 - eta) * exp(-r * r / (2 * sigma * sigma))",
        """, 2 * sqrt(2 * ln(2)) * sigma as fg, 2 * gamma as fl, greatest(0, least(1, fl / pow(pow(fg, 5) + 2.69269e0 * pow(fg, 4) * fl + 2.42843e0 * pow(fg, 3) * fl * fl + 4.47163e0 * fg * fg * pow(fl, 3) + 0.07842e0 * fg * pow(fl, 4) + pow(fl, 5), 0.2e0))) as yy,
  greatest(0, least(1, 1.36603e0 * yy - 0.47719e0 * yy * yy + 0.11116e0 * yy * yy * yy)) as eta""",
    ),
}
