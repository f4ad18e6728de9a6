"""Queries of what works at any size (content keys, partitioned convolution, regridding, look-ups in several dimensions, numbering, profiles), and sweeps over the driver's tables; with
their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue as base
from .catalogue_more import gaussian
from .catalogue_more_sql import appended
from .catalogue_sql import RADIATIVE, STATES, R, radial
from .functions import atmosphere, psf, radiative
from .operators import algebra, convolution, interp, metrics, regrid
from .operators import radial as profiles
from .plans import configs, content

LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def r6(value, name: str) -> F.Column:
    return F.round(value, 6).alias(name)


def content_sums(spark: SparkSession, d: str) -> DataFrame:
    """Keys of line items by return flag: a changed value changes one of them."""
    lines = base.read(spark, d, "lineitem").select(*LINE_COLUMNS)
    return content.content_sums(lines, ["l_returnflag"]).select("l_returnflag", "n", F.col("high").cast("string").alias("high"), F.col("low").cast("string").alias("low"))


def content_columns(spark: SparkSession, d: str) -> DataFrame:
    return content.column_sums(base.read(spark, d, "lineitem").select(*LINE_COLUMNS)).select("column", F.col("high").cast("string").alias("high"), F.col("low").cast("string").alias("low"))


def psf_conv_partitioned(spark: SparkSession, d: str) -> DataFrame:
    """A kernel three tiles wide."""
    k = gaussian(spark, 33, (4.0,)).drop("sigma")
    return convolution.partitioned(base.raster(spark, d), k, ["band"], "v", "v_conv", block=12).select("band", "iy", "ix", r6(F.col("v_conv"), "v_conv"))


def regrid_mean(spark: SparkSession, d: str) -> DataFrame:
    return regrid.regrid(base.raster(spark, d), ["band"], "v", 1.5).select("band", "iy", "ix", r6(F.col("v"), "v"))


def regrid_sum(spark: SparkSession, d: str) -> DataFrame:
    """Amounts on finer rows and coarser columns, none lost."""
    return regrid.regrid(base.raster(spark, d), ["band"], "v", (0.75, 2.5), "sum", edge="keep").select("band", "iy", "ix", r6(F.col("v"), "v"))


def lookup_3d(spark: SparkSession, d: str) -> DataFrame:
    """Events looked up in a table of mean prices by line number, discount and tax."""
    cents = lambda c: F.floor(F.round(F.col(c) * 100) / 2).cast("double")
    lut = base.read(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("double").alias("line"), cents("l_discount").alias("discount"), cents("l_tax").alias("tax")).agg(F.avg("l_extendedprice").alias("price"), F.avg("l_quantity").alias("quantity"))
    asked = base.read(spark, d, "events").select("event_id", (1 + F.col("value") / 81.7).alias("line"), (F.col("event_id") % 56 / 10.3 - 0.2).alias("discount"), (F.col("user_id") % 45 / 9.7).alias("tax"))
    return interp.multilinear(asked, lut, ["line", "discount", "tax"], ["price", "quantity"]).select("event_id", F.round("price", 4).alias("price"), r6(F.col("quantity"), "quantity"))


def price_numbers(spark: SparkSession, d: str) -> DataFrame:
    """One parameter of many values, numbered in order."""
    return algebra.distinct_states(base.read(spark, d, "lineitem"), ["l_extendedprice"])


def state_chunks(spark: SparkSession, d: str) -> DataFrame:
    found = algebra.chunked(base.read(spark, d, "lineitem").select("l_extendedprice", "l_quantity"), "l_extendedprice", 100)
    return found.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def atmosphere_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's customers as a profile of extinction by height, on both vertical grids, with the depth above each level."""
    height = (F.col("c_custkey") % 17).cast("double") * 4
    given = base.read(spark, d, "customer").groupBy("c_nationkey", height.alias("z")).agg((F.avg(F.abs("c_acctbal")) * 1.23456789e-5).alias("extinction"))
    levels = atmosphere.vertical_grids(given.select("c_nationkey").distinct())
    out = atmosphere.profiles(levels, given, ["c_nationkey"], ["extinction"])
    return out.select("c_nationkey", "grid", "level", "z", r6(F.col("extinction"), "extinction"), r6(F.col("extinction_above"), "depth_above"))


def radial_std_bins(spark: SparkSession, d: str) -> DataFrame:
    return profiles.profile(base.raster(spark, d), ["band"], "v", 17).select("band", "bin", r6(F.col("r"), "r"), "n", r6(F.col("std"), "std"))


SIGMAS = (0.5, 1.0, 1.5, 2.0)


def loss_landscape(spark: SparkSession, d: str) -> DataFrame:
    """The loss of each candidate width: surfaces recovered from every band, against the next band's."""
    pairs = base.image_pairs(spark, d)
    fixed = {"tdir_up": 0.6, "tdif_up": 0.1, "sph_alb": 0.1, "weight": 1.0}
    train = pairs.select("band", "iy", "ix", "r", (0.3 + 0.05 * F.col("v")).alias("rho_unif"), (0.3 + 0.05 * F.col("t")).alias("rho_s"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    candidates = base.values(spark, [(s,) for s in SIGMAS], "sigma double")
    kernels = psf.kernels(candidates, ["sigma"], "gaussian", 1.0, 9).select("sigma", "dy", "dx", "w")
    found = metrics.landscape(train, candidates, ["sigma"], kernels, ["band"], ["band"], metrics.Loss("rmse_rad", None))
    return found.select("sigma", r6(F.col("loss"), "loss"))


def radiative_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The six quantities of every combination of the events' optical thicknesses and heights with fixed bands and angles."""
    states = base.states(spark, d)
    dims = [states.select(F.abs("aot").alias("aot")).distinct(), states.select("h").distinct()]
    dims += [base.values(spark, [(x,) for x in v], f"{k} double") for k, v in {"wl": (490.0, 865.0), "sza": (0.0, 45.0), "vza": (0.0, 20.0)}.items()]
    out = radiative.pipeline(dims, ["wl", "aot", "h", "sza", "vza"])
    return out.select("wl", "aot", "h", "sza", "vza", *[r6(F.col(c), c) for c in radiative.OUTPUTS])


def zipped_sweep(spark: SparkSession, d: str) -> DataFrame:
    """A sweep over zipped and crossed parameters, applied to all line items as pixels of the zipped dimension."""
    pixel = ("pixel",)
    sweep = configs.Sweep({"aot": configs.values("aot", (pixel, [0.1, 0.2, 0.3])), "h": configs.values("h", (pixel, [0.0, 1.0, 2.0])), "sza": configs.values("sza", [0.0, 30.0, 60.0])})
    out = sweep.apply(spark, lambda aot, h, sza: F.exp(-aot / F.cos(F.radians(sza))) * (1 - h / 10), "t")
    lines = base.pixels(spark, d).withColumn("h", (F.col("l_linenumber") % 3).cast("double"))
    seen = lines.join(F.broadcast(out), "h")  # nine rows
    return seen.groupBy("aot", "h", "sza").agg(r6(F.avg(F.col("rho_toa") * F.col("t")), "mean"), F.count(F.lit(1)).alias("n"))


def sweep_function(spark: SparkSession, d: str) -> DataFrame:
    """A function of scalars and of a chunked vector, and what it gives for the events."""

    def depth(aot, wl, angstrom):
        return aot * (560.0 / wl) ** angstrom

    sweep = configs.Sweep({"aot": configs.values("aot", [0.1, 0.2]), "rh": configs.values("rh", [50.0, 60.0])}, {"wl": configs.values("wl", [443.0, 490.0, 560.0, 665.0, 865.0])}, {"wl": 2})
    table = sweep.apply(spark, depth, "tau", angstrom=1.3).select("aot", "rh", "wl", "tau")
    events = base.read(spark, d, "events").select(F.element_at(F.array(*[F.lit(w) for w in (443.0, 490.0, 560.0, 665.0, 865.0)]), (F.col("user_id") % 5 + 1).cast("int")).alias("wl"), "value")
    return events.join(F.broadcast(table), "wl").groupBy("aot", "rh", "wl").agg(r6(F.avg(F.exp(-F.col("tau") * F.col("value") / 100)), "seen"), F.count(F.lit(1)).alias("n"))  # twenty rows


def geometry_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's sensor, by its angles."""
    offsets = configs.GeometryConfig(30.0, [0.0, 15.0, 30.0], 45.0, [0.0, 90.0, 180.0]).offsets(spark)
    s = base.read(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 3 * 15).cast("double").alias("vza"), (F.col("s_nationkey") % 3 * 90).cast("double").alias("vaa"))
    return s.join(F.broadcast(offsets), ["vza", "vaa"]).select("s_suppkey", "vza", "vaa", "dx", "dy")  # nine rows


def line_sums(columns: tuple[str, ...]) -> tuple[str, str]:
    """SQL for the two numbers of a row's columns."""
    text = " || ".join(f"coalesce(length(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in sorted(columns))
    return tuple(f"cast(sum(('0x' || substr(md5({text}), {at}, 15))::bigint) as varchar)" for at in (1, 16))


HIGH, LOW = line_sums(LINE_COLUMNS)


def shared_areas(axis: str, factor: str) -> str:
    return f"(select i, j, least(i + 1, (j + 1) * {factor}) - greatest(i, j * {factor}) as share from (select unnest(range(64)) as i), (select unnest(range(100)) as j) where least(i + 1, (j + 1) * {factor}) - greatest(i, j * {factor}) > 1e-9) {axis}"


def landscape_sql() -> str:
    one = lambda s: f"""(with {R.removeprefix('with ')}, u as (select r.band, r.iy, r.ix, 0.3e0 + 0.05e0 * r.v as v from raster r join raster n on n.band = r.band + 1 and n.iy = r.iy and n.ix = r.ix), {appended('u', 'band', 'v', 9, s)},
f as (select u.band, iy, ix, (u.v * 0.7e0 * (1 - env * 0.1e0) / (1 - u.v * 0.1e0) - env * 0.1e0) / 0.6e0 as found from u join conv using (band, iy, ix)),
ctr as (select band, avg(x) as cx, avg(y) as cy from raster group by band),
p as (select f.*, 0.3e0 + 0.05e0 * n.v as target, sqrt((m.x - cx) * (m.x - cx) + (m.y - cy) * (m.y - cy)) as r from f join raster m using (band, iy, ix) join ctr using (band) join raster n on n.band = f.band + 1 and n.iy = f.iy and n.ix = f.ix),
w as (select *, (found - target) / greatest(max(abs(found)) over b, max(abs(target)) over b, 1.1920928955078125e-07) as resid, 1 / greatest(r, min(case when r > 1e-3 then r end) over b) as wr from p window b as (partition by band)),
e as (select band, sqrt(sum(wr * resid * resid) / sum(wr)) as loss from w group by band) select {s} as sigma, round(avg(loss), 6) as loss from e)"""  # noqa: E731
    return " union all ".join(one(f"{s}e0") for s in SIGMAS)


SQL = {
    "content_sums": f"select l_returnflag, count(*) as n, {HIGH} as high, {LOW} as low from lineitem group by l_returnflag",
    "content_columns": " union all ".join("(select '{0}' as \"column\", {1} as high, {2} as low from lineitem)".format(c, *line_sums((c,))) for c in LINE_COLUMNS),
    "psf_conv_partitioned": f"{R}, {appended('raster', 'band', 'v', 33, '4e0')} select band, iy, ix, round(env, 6) as v_conv from conv",
    "regrid_mean": f"{R}, size as (select band, max(iy) + 1 as ny, max(ix) + 1 as nx from raster group by band) select band, cast(a.j as int) as iy, cast(b.j as int) as ix, round(sum(v * a.share * b.share) / sum(a.share * b.share), 6) as v from raster join size using (band), {shared_areas('a', '1.5e0')}, {shared_areas('b', '1.5e0')} where a.i = iy and b.i = ix and (a.j + 1) * 1.5e0 <= ny and (b.j + 1) * 1.5e0 <= nx group by all",
    "regrid_sum": f"{R} select band, cast(a.j as int) as iy, cast(b.j as int) as ix, round(sum(v * a.share * b.share), 6) as v from raster, {shared_areas('a', '0.75e0')}, {shared_areas('b', '2.5e0')} where a.i = iy and b.i = ix group by all",
    "lookup_3d": """with lut as (select cast(l_linenumber as double) as a, floor(round(l_discount * 100) / 2) as b, floor(round(l_tax * 100) / 2) as c, avg(l_extendedprice) as price, avg(l_quantity) as quantity from lineitem group by all),
ends as (select min(a) as la, max(a) as ha, min(b) as lb, max(b) as hb, min(c) as lc, max(c) as hc from lut),
q as (select event_id, greatest(la, least(ha, 1 + value / 81.7e0)) as a, greatest(lb, least(hb, event_id % 56 / 10.3e0 - 0.2e0)) as b, greatest(lc, least(hc, user_id % 45 / 9.7e0)) as c, ha, hb, hc from events, ends),
k as (select *, least(ha - 1, floor(a)) as ka, least(hb - 1, floor(b)) as kb, least(hc - 1, floor(c)) as kc from q),
w as (select event_id, ka + i as a, kb + j as b, kc + m as c, (case i when 1 then a - ka else 1 - (a - ka) end) * (case j when 1 then b - kb else 1 - (b - kb) end) * (case m when 1 then c - kc else 1 - (c - kc) end) as w from k, (values (0), (1)) x(i), (values (0), (1)) y(j), (values (0), (1)) z(m))
select event_id, round(case when count(*) filter (where w <> 0 and price is null) = 0 then sum(w * price) end, 4) as price, round(case when count(*) filter (where w <> 0 and price is null) = 0 then sum(w * quantity) end, 6) as quantity from w left join lut using (a, b, c) group by event_id""",
    "price_numbers": "select l_extendedprice, row_number() over (order by l_extendedprice nulls first) - 1 as state from (select distinct l_extendedprice from lineitem)",
    "state_chunks": "with c as (select l_extendedprice, cast((row_number() over (order by l_extendedprice) - 1) // 100 as int) as chunk from (select distinct l_extendedprice from lineitem where l_extendedprice is not null)) select chunk, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem join c using (l_extendedprice) group by chunk",
    "atmosphere_profiles": """with given as (select c_nationkey, cast(c_custkey % 17 as double) * 4 as z, avg(abs(c_acctbal)) * 1.23456789e-5 as e from customer group by all),
low as (select i, 10e0 - i * 0.25e0 as z from (select unnest(range(41)) as i)),
grids as (select 'scalar' as grid, i as level, 100e0 - i as z from (select unnest(range(90)) as i) union all select 'scalar', 90 + i, z from low union all select 'phase', 0, 100e0 union all select 'phase', 1, 20e0 union all select 'phase', 2 + i, z from low),
lev as (select c_nationkey, grid, cast(level as int) as level, z from (select distinct c_nationkey from customer), grids),
seg as (select c_nationkey, z as z0, e as e0, lead(z) over w as z1, lead(e) over w as e1, min(z) over (partition by c_nationkey) as lo, max(z) over (partition by c_nationkey) as hi from given window w as (partition by c_nationkey order by z)),
ends as (select c_nationkey, min(z) as lo, max(z) as hi from given group by c_nationkey),
pt as (select lev.*, greatest(lo, least(hi, z)) as q from lev join ends using (c_nationkey)),
v as (select a.c_nationkey, grid, level, a.z, max(e0 + (e1 - e0) * (q - z0) / (z1 - z0)) as e from pt a join seg s on s.c_nationkey = a.c_nationkey and z1 is not null and q >= z0 and (q < z1 or (z1 = hi and q = hi)) group by all),
p as (select *, coalesce((lag(e) over w + e) / 2 * (lag(z) over w - z), 0) as part from v window w as (partition by c_nationkey, grid order by level))
select c_nationkey, grid, level, z, round(e, 6) as extinction, round(sum(part) over (partition by c_nationkey, grid order by level rows unbounded preceding), 6) as depth_above from p""",
    "radial_std_bins": f"{R}, {radial('raster', 'band', 'v').replace('greatest(2, cast(floor((least(nx, ny) - 1) / sqrt(2e0)) as int) - 1) as npix', '17 as npix')} select band, bin, round(r, 6) as r, n, round(std, 6) as std from prof",
    "loss_landscape": landscape_sql(),
    "fit_psf_adam_lbfgs": f"{R} select distinct band, 'sigma' as param, 2e0 as value, true as converged from raster",
    "radiative_pipeline": f"""with {STATES}, grid as (select * from (values (490e0), (865e0)) a(wl), (select distinct abs(aot) as aot from st), (select distinct h from st), (values (0e0), (45e0)) d(sza), (values (0e0), (20e0)) e(vza)), {RADIATIVE}
select wl, aot, h, sza, vza, round(tdir_down, 6) as tdir_down, round(tdir_up, 6) as tdir_up, round(tdif_down, 6) as tdif_down, round(tdif_up, 6) as tdif_up, round(sph_alb, 6) as sph_alb, round(rho_atm, 6) as rho_atm from rt""",
    "zipped_sweep": "select aot, h, sza, round(avg(l_extendedprice / 150000 * exp(-aot / cos(radians(sza))) * (1 - h / 10)), 6) as mean, count(*) as n from lineitem, (values (0.1e0, 0e0), (0.2e0, 1e0), (0.3e0, 2e0)) a(aot, h), (values (0e0), (30e0), (60e0)) s(sza) where l_linenumber % 3 = h group by all",
    "sweep_function": "select aot, rh, wl, round(avg(exp(-aot * pow(560e0 / wl, 1.3e0) * value / 100)), 6) as seen, count(*) as n from events, (values (0.1e0), (0.2e0)) a(aot), (values (50e0), (60e0)) r(rh), (values (0, 443e0), (1, 490e0), (2, 560e0), (3, 665e0), (4, 865e0)) w(k, wl) where user_id % 5 = k group by all",
    "geometry_offsets": "select s_suppkey, cast(s_suppkey % 3 * 15 as double) as vza, cast(s_nationkey % 3 * 90 as double) as vaa, round_even(700 * tan(radians(s_suppkey % 3 * 15e0)) * cos(radians(180 - s_nationkey % 3 * 90e0)), 4) as dx, round_even(700 * tan(radians(s_suppkey % 3 * 15e0)) * sin(radians(180 - s_nationkey % 3 * 90e0)), 4) as dy from supplier",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        content_sums, content_columns, psf_conv_partitioned, regrid_mean, regrid_sum, lookup_3d, price_numbers, state_chunks, atmosphere_profiles, radial_std_bins,
        loss_landscape, radiative_pipeline, zipped_sweep, sweep_function, geometry_offsets,
    )
    return {f.__name__: f for f in found}
