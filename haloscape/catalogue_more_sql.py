"""DuckDB SQL that gives the same rows as the further queries."""

from .catalogue_sql import RADIATIVE, RASTER, RR, SEGS, STATES, R


def line(side: int, sigma: str) -> str:
    """A Gaussian's weights along one axis; on a square grid its kernel is the product of two."""
    half = side // 2
    return f"(select d, g / sum(g) over () as g from (select d, exp(-d * d / (2 * {sigma} * {sigma})) as g from (select unnest(range(-{half}, {half + 1})) as d)))"


def appended(source: str, keys: str, value: str, side: int, sigma: str, n: int = 64, tail: str = "v") -> str:
    """CTEs ty and conv: a Gaussian convolution whose reflected padding stands on the far side only, so what lies before the first pixel wraps into it; in x a column of zeros follows if the
    length is odd."""
    ext = n + side - 1
    wide = ext + ext % 2
    at = lambda i, length: f"(({i} - d) % {length} + {length}) % {length}"
    mapped = lambda i, length: f"case when {at(i, length)} < {n} then {at(i, length)} when {at(i, length)} < {ext} then {2 * n - 2} - {at(i, length)} end"
    same = lambda k: " and ".join(f"s.{c.strip()} = r.{c.strip()}" for c in k.split(","))
    cols = lambda k: ", ".join(f"r.{c.strip()}" for c in k.split(","))
    return f"""
wy as (select {cols(keys)}, r.iy, r.ix, g, {mapped('r.iy', ext)} as at from {source} r, {line(side, sigma)}),
ty as (select {cols(keys)}, r.iy, r.ix, coalesce(sum(s.{value} * r.g), 0) as {tail} from wy r left join {source} s on {same(keys)} and s.ix = r.ix and s.iy = r.at group by all),
wx as (select {cols(keys)}, r.iy, r.ix, g, {mapped('r.ix', wide)} as at from {source} r, {line(side, sigma)}),
conv as (select {cols(keys)}, r.iy, r.ix, coalesce(sum(s.{tail} * r.g), 0) as env from wx r left join ty s on {same(keys)} and s.iy = r.iy and s.ix = r.at group by all)"""


UNIF = "u as (select band, iy, ix, 0.3e0 + 0.05e0 * v as v from raster)"

SQL = {
    "scene_info": f"with {RASTER} select band, max(case when ix = 1 then x end) - max(case when ix = 0 then x end) as res, count(distinct ix) as n from raster group by band",
    "band_replace": f"with {RASTER} select cast(band % 4 as varchar) as band, cast(band // 4 * 64 + iy as int) as iy, ix, round(case when band % 4 = 3 then v * 2 else v end, 6) as v from raster",
    "scene_table": f"with {RASTER} select cast(band % 4 as varchar) as band, cast(k as int) as k, round(avg(v * (0.5e0 * k + band % 4)), 6) as mean, count(*) as n from raster, (values (1), (2)) t(k) group by band % 4, k",
    "normalise_output": f"with {RASTER} select band, iy, ix, round(v, 6) as rho, 490e0 as wl from raster",
    "unflatten_sensors": f"with {RASTER} select band, cast((iy * 64 + ix) // 16 as int) as iy, cast((iy * 64 + ix) % 16 as int) as ix, round(v, 6) as v from raster",
    "pixel_rows": f"with {RASTER} select band, iy, count(*)::int as n, round(sum(v), 4) as total, round(max(case when ix = 5 then v end), 5) as sixth from raster group by band, iy",
    "misaligned_pixels": f"with {RASTER} select iy, ix, band, count(distinct band % 3) as images from raster where iy + band >= 3 group by iy, ix, band having count(distinct band % 3) < 3",
    "species_split": f"with {STATES} select event_id, aerosol, round(aot * share, 6) as tau_ref from st, (values ('dust', 0.25e0), ('sulphate', 0.75e0)) m(aerosol, share)",
    "vertical_grids": """with base as (select i, 10e0 - i * 0.25e0 as z from (select unnest(range(41)) as i))
select r_regionkey as band, grid, cast(level as int) as level, z from region, (
  select 'scalar' as grid, i as level, 100e0 - i as z from (select unnest(range(90)) as i) union all select 'scalar', 90 + i, z from base
  union all select 'phase', 0, 100e0 union all select 'phase', 1, 20e0 union all select 'phase', 2 + i, z from base)""",
    "atmospheres": f"""with {STATES}, u as (select distinct aot, h, 490e0 as wl from st)
select aot, h, round(1013.25e0 * pow(1 - 6.5e0 * h / 288.15e0, 5.255e0), 6) as pressure, round(0.008569e0 * pow(wl / 1000, -2) * pow(wl / 1000, -2) * (1 + 0.0113e0 * pow(wl / 1000, -2) + 0.00013e0 * pow(wl / 1000, -2) * pow(wl / 1000, -2)) * pow(1 - 6.5e0 * h / 288.15e0, 5.255e0), 6) as tau_rayleigh, round(aot * pow(wl / 560e0, -1.3e0), 6) as tau_aerosol from u""",
    "surface_background": f"""with {RASTER}, s as (select band, avg(v) as mean, min(v) as least from raster group by band)
select band, chosen, round(case chosen when 'mean' then mean when 'min' then least when 'float' then 0.25e0 when 'analytical' then 0.8e0 else 0e0 end, 6) as albedo from s, (values ('mean'), ('min'), ('zero'), ('float'), ('other'), ('analytical')) c(chosen)""",
    "angle_sensors": "select n_nationkey, cast(sensor as int) as sensor, th_deg, n_nationkey * 14e0 as ph_deg, 700e0 as pos_z, 'ATMOS' as place from nation, (values (0, 0e0), (1, 15e0), (2, 45e0)) a(sensor, th_deg)",
    "extend_analytical": """with g as (select r_regionkey as band, iy, ix, (ix - 10) * 0.5e0 as x, (iy - 10) * 0.5e0 as y from region, (select cast(unnest(range(21)) as int) as iy), (select cast(unnest(range(21)) as int) as ix))
select 'disk' as model, band, iy, ix, case when x * x + y * y <= 4 then 0.75e0 else 0.25e0 end as rho_s from g
union all select 'gauss', band, iy, ix, round(cast(cast(0.2e0 + (0.8e0 - 0.2e0) * exp(-(x * x + y * y) / 18) as float) as double), 5) from g""",
    "radial_upsampled": f"""{RR}, {SEGS}, ends as (select band, count(*) as n, min(r) as lo, max(r) as hi from prof group by band),
held as (select band, min(r) as lo, max(r) as hi from prof where mean is not null group by band),
q as (select e.band, cast(bin as int) as bin, e.lo + (e.hi - e.lo) * bin / 99e0 as r, least(greatest(e.lo + (e.hi - e.lo) * bin / 99e0, h.lo), h.hi) as q from ends e join held h using (band), (select unnest(range(100)) as bin))
select q.band, bin, round(r, 6) as r, round(y0 + (y1 - y0) * (q - x0) / (x1 - x0), 6) as mean from q join segs s on s.band = q.band and x1 is not null and (q >= x0 or seg = 0) and (q < x1 or seg = n_seg - 1)""",
    "masked_metrics": f"""{RR}, pairs as (select rad.*, n.v as t from rad join raster n on n.band = rad.band + 1 and n.iy = rad.iy and n.ix = rad.ix),
resid as (select *, (v - t) / greatest(max(abs(v)) over (partition by band), max(abs(t)) over (partition by band), 1.1920928955078125e-07) as resid from pairs),
w as (select *, case when sum(abs(v)) over (partition by band order by r, iy, ix rows unbounded preceding) <= 0.99e0 * sum(abs(v)) over (partition by band) then 1 else 0 end / (2 * pi() * greatest(r, min(case when r > 1e-3 then r end) over (partition by band))) as w from resid)
select band, round(sum(w * abs(resid)) / sum(w), 6) as mae_rad, round(sum(w * resid * resid) / sum(w), 6) as mse_rad, round(sqrt(sum(w * resid * resid) / sum(w)), 6) as rmse_rad from w group by band""",
    "transect_default": f"""{R}, e as (select band, avg(x) as cx, min(x) as lx, max(x) as hx, avg(y) as cy, min(y) as ly, max(y) as hy, max(ix) as mx, max(iy) as my from raster group by band),
r as (select *, least(hx - cx, cx - lx, hy - cy, cy - ly) as rm from e), m as (select *, greatest(3, cast(round_even(2 * rm / ((hx - lx) / mx), 0) + 1 as int)) as many from r),
l as (select * exclude (j), cast(j as int) as j, -rm + 2 * rm * j / (many - 1) as s from (select *, unnest(range(many)) as j from m)),
p as (select *, (cx + s * cos(radians(75e0)) - lx) / ((hx - lx) / mx) as px, (cy + s * sin(radians(75e0)) - ly) / ((hy - ly) / my) as py from l),
k as (select *, greatest(0, least(mx - 1, cast(floor(px) as int))) as kx, greatest(0, least(my - 1, cast(floor(py) as int))) as ky from p),
c as (select band, j, s, ky + a as iy, kx + b as ix, (case when a = 1 then py - ky else 1 - (py - ky) end) * (case when b = 1 then px - kx else 1 - (px - kx) end) as w from k, (values (0), (1)) i(a), (values (0), (1)) o(b))
select band, j, round(s, 6) as s, round(case when count(v) = 4 then sum(v * w) end, 6) as v from c left join raster using (band, iy, ix) group by band, j, s""",
    "psf_conv_tiled": f"""{R}, size as (select band, max(iy) + 1 as ny, max(ix) + 1 as nx from raster group by band),
wy as (select r.band, r.iy, r.ix, g, case when r.iy - d < 0 then d - r.iy when r.iy - d > ny - 1 then 2 * (ny - 1) - (r.iy - d) else r.iy - d end as at from raster r join size using (band), {line(9, '2e0')}),
ty as (select r.band, r.iy, r.ix, sum(s.v * g) as v from wy r join raster s on s.band = r.band and s.ix = r.ix and s.iy = r.at group by all),
wx as (select r.band, r.iy, r.ix, g, case when r.ix - d < 0 then d - r.ix when r.ix - d > nx - 1 then 2 * (nx - 1) - (r.ix - d) else r.ix - d end as at from raster r join size using (band), {line(9, '2e0')})
select r.band, r.iy, r.ix, round(sum(s.v * g), 6) as v_conv from wx r join ty s on s.band = r.band and s.iy = r.iy and s.ix = r.at group by all""",
    "psf_conv_states": " union all ".join(f"(with {RASTER}, {appended('raster', 'band', 'v', 9, s)} select {s} as sigma, band, iy, ix, round(env, 6) as v_conv from conv)" for s in ("1e0", "2e0")),
    "psf_conv_fft": f"{R}, {appended('raster', 'band', 'v', 33, '4e0')} select band, iy, ix, round(env, 6) as v_conv from conv",
    "unif_to_surface": f"""{R}, {UNIF}, {appended('u', 'band', 'v', 9, '2e0')}
select band, iy, ix, round((u.v * 0.7e0 * (1 - env * 0.1e0) / (1 - u.v * 0.1e0) - env * 0.1e0) / 0.6e0, 6) as rho_s from u join conv using (band, iy, ix)""",
    "rho_toa_full": f"""{R}, u as (select band, iy, ix, 0.3e0 + 0.05e0 * v as v from raster), {appended('u', 'band', 'v', 9, '2e0')},
grid as (select 490e0 as wl, aot, 0e0 as h, 30e0 as sza, 5e0 as vza from (values (0.1e0), (0.3e0)) a(aot)), {RADIATIVE}
select band, aot, iy, ix, round(case when iy between 1 and 6 and ix between 7 and 36 then rho_atm + (tdir_down + tdif_down) * (tdir_up * u.v + tdif_up * env) / (1 - sph_alb * env) end, 6) as rho_toa, iy between 1 and 6 and ix between 7 and 36 as rho_toa_valid
from u join conv using (band, iy, ix), rt""",
    "product_metadata": """select s_suppkey, case when s_suppkey % 3 = 0 then 50e0 else s_suppkey % 100 end as rh, s_suppkey % 80 + 0.25e0 as sza, s_suppkey % 360 + 0.5e0 as saa, case when s_suppkey % 5 = 0 then 0e0 else s_suppkey % 40 + 0.5e0 end as vza, 100e0 as vaa,
round(case when s_suppkey % 4 + s_suppkey % 3 in (0, 1) then cast(s_suppkey % 4 as double) else (s_suppkey % 4) / cast(s_suppkey % 4 + s_suppkey % 3 as double) end, 6) as dust, cast(2 as int) as n_species from supplier""",
}
