"""The queries over the driver's tables.  Adapters: the embeddings are a raster (64 vectors of 64 values make a band), line items are
pixels with reflectances, events are a map of atmospheric parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bands
from .fit import optimize
from .functions import atmosphere, five_s, psf, radiative
from .operators import algebra, convolution, interp, metrics, radial
from .plans.modules import Module, Pipeline
from .sources import generators, product, sinks

T_UP, T_DOWN, TDIR, TDIF = 0.7, 0.8, 0.6, 0.1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A literal table in the plan: it takes no tasks of its own, and products of such tables stay in one partition."""
    fields = [f.split() for f in schema.split(", ")]
    said = ", ".join("(" + ", ".join(f"cast('{v!r}' as {kind})" for v, (_, kind) in zip(row, fields, strict=True)) + ")" for row in rows)
    return spark.sql(f"select * from values {said} as t({', '.join(name for name, _ in fields)})")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).cast("int").alias("band"), (F.col("vec_id") % 64).cast("int").alias("iy"), F.posexplode("embedding").alias("ix", "f"))
    return e.select("band", "iy", "ix", (F.col("ix") - 31.5).alias("x"), (F.col("iy") - 31.5).alias("y"), F.col("f").cast("double").alias("v"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_extendedprice") / 150000).alias("rho_toa"), c("l_tax").alias("rho_atm"), c("l_discount").alias("sph_alb"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.round(F.col("value") / 50, 1).alias("aot"), (F.col("user_id") % 5).cast("double").alias("h"))


def r6(name: str) -> F.Column:
    return F.round(F.col(name), 6).alias(name)


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radial.profile(raster(spark, sf_dir), ["band"], "v")


# ---- formulas


def five_s_inverse(spark, d):
    rho = five_s.inverse(F.col("rho_toa"), F.col("rho_atm"), F.lit(T_UP), F.lit(T_DOWN), F.col("sph_alb"))
    return pixels(spark, d).select("l_orderkey", "l_linenumber", F.round(rho, 6).alias("rho_unif"))


def five_s_forward(spark, d):
    rho = five_s.forward(F.col("rho_toa"), F.col("rho_atm"), F.lit(T_UP), F.lit(T_DOWN), F.col("sph_alb"))
    return pixels(spark, d).select("l_orderkey", "l_linenumber", F.round(rho, 6).alias("rho"))


def five_s_roundtrip(spark, d):
    args = (F.col("rho_atm"), F.lit(T_UP), F.lit(T_DOWN), F.col("sph_alb"))
    back = five_s.forward(five_s.inverse(F.col("rho_toa"), *args), *args)
    return pixels(spark, d).select("l_orderkey", "l_linenumber", (F.abs(back - F.col("rho_toa")) < 1e-9).alias("same"), F.round(back, 6).alias("rho_toa"))


def direct_transmittance_sweep(spark, d):
    sweep = algebra.product([values(spark, [(a,) for a in (0.05, 0.1, 0.3)], "aot double"), values(spark, [(a,) for a in (0.0, 30.0, 60.0)], "sza double")])
    t = sweep.withColumn("tdir", five_s.direct_transmittance(F.col("aot"), F.col("sza")))
    rows = algebra.natural_join(pixels(spark, d).select("l_orderkey", "rho_toa"), t, ["aot", "sza"])
    return rows.groupBy("aot", "sza").agg(F.round(F.avg(F.col("rho_toa") * F.col("tdir")), 6).alias("mean_rho"), F.count(F.lit(1)).alias("n"))


def surface_pressure(spark, d):
    return states(spark, d).select("event_id", F.round(five_s.surface_pressure(F.col("h")), 6).alias("pressure"))


def surface_recovery(spark, d):
    env = convolution.small(raster(spark, d), box(spark), ["band"], "v", "env").join(raster(spark, d), ["band", "iy", "ix"])
    rho = five_s.surface(F.col("v"), F.col("env"), F.lit(TDIR), F.lit(TDIF), F.lit(0.1))
    return env.select("band", "iy", "ix", F.round(rho, 6).alias("rho_s"))


def digitize_levels(spark, d):
    e = read(spark, d, "events").select("event_id", "value")
    span = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.crossJoin(span).select("event_id", F.round(five_s.digitize(F.col("value"), F.col("lo"), F.col("hi"), 8), 6).alias("level"))


def albedo_quantize(spark, d):
    return atmosphere.albedo_levels(raster(spark, d), ["band"], "v", 40)


def species_normalize(spark, d):
    total = read(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    shares = total.groupBy("p_brand").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("p_type", F.col("n").cast("double"))))).alias("m"))
    return shares.select("p_brand", F.explode(product.normalized(F.col("m"))).alias("species", "share")).select("p_brand", "species", r6("share"))


def sat_position(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 60).cast("double").alias("vza"), (F.col("s_suppkey") % 360).cast("double").alias("vaa"))
    dx, dy = five_s.satellite_offset(F.lit(700.0), F.col("vza"), F.col("vaa"))
    return s.select("s_suppkey", F.round(dx, 3).alias("dx"), F.round(dy, 3).alias("dy"))


def sensor_grid(spark, d):
    s = read(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 2.0).alias("vza"), (F.col("n_nationkey") * 14.0).alias("vaa"))
    g = generators.grid(s, 5, 0.5)
    made = five_s.sensor(F.col("x"), F.col("y"), F.col("vza"), F.col("vaa"), F.lit(700.0))
    return g.select("n_nationkey", "iy", "ix", *[F.round(v, 6).alias(k) for k, v in made.items()])


def radial_sensors(spark, d):
    s = read(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 2.0).alias("vza"), (F.col("n_nationkey") * 14.0).alias("vaa"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("j"))
    made = five_s.radial_sensor(F.col("j") * 0.25, F.col("vza"), F.col("vaa"), F.lit(700.0))
    return s.select("n_nationkey", "j", *[F.round(v, 6).alias(k) for k, v in made.items()])


# ---- sources


def scene_bands(spark, d):
    return read(spark, d, "region").select(F.col("r_regionkey").alias("band"))


def gaussian_scene(spark, d):
    return generators.gaussian_scene(scene_bands(spark, d), 3.0, 0.5, n=16, low=0.2, high=0.8).select("band", "iy", "ix", F.round(F.col("rho_s").cast("double"), 5).alias("rho_s"))


def disk_scene(spark, d):
    return generators.disk_scene(scene_bands(spark, d), 2.0, 0.5, n=17, low=0.25, high=0.75).select("band", "iy", "ix", F.col("rho_s").cast("double").alias("rho_s"))


def random_scene(spark, d):
    return generators.random_scene(scene_bands(spark, d), ["rho_s", "rho_toa"], 0.5, 7, n=16)


def npy_export_names(spark, d):
    rows = states(spark, d).select("aot", "h").distinct().withColumn("band", F.lit("B02"))
    return rows.select(sinks.export_name("rho_s", ["aot", "h"], F.col("band")).alias("name"))


# ---- algebra


def dedup_index(spark, d):
    return algebra.distinct_states(states(spark, d), ["aot", "h"])


def dedup_expand(spark, d):
    def compute(u):
        return u.withColumn("pressure", F.round(five_s.surface_pressure(F.col("h")) * F.exp(-F.col("aot")), 6))

    return algebra.dedup_apply(states(spark, d), ["aot", "h"], compute)


def sel_label(spark, d):
    return algebra.select_label(raster(spark, d), iy=3, wl=490.0).select("band", "ix", r6("v"))


def isel_slice(spark, d):
    return algebra.select_slice(raster(spark, d), iy=(4, 9), ix=(10, 20)).select("band", "iy", "ix", r6("v"))


def nearest_label(spark, d):
    found = algebra.select_nearest(states(spark, d).select("h", "aot").distinct(), ["h"], "aot", 0.53)
    return found.select("h", "aot")


def reindex_grid(spark, d):
    px = raster(spark, d)
    return algebra.reindex(px, px.where(F.col("v") > 0), ["band", "iy", "ix"]).select("band", "iy", "ix", r6("v"))


def valid_mask(spark, d):
    return raster(spark, d).select("band", "iy", "ix", algebra.window_mask(F.col("iy"), F.col("ix"), 5, 7, 20, 30).alias("valid"))


def nearest_band(spark, d):
    n = bands.nearest(F.col("p_retailprice"))
    return read(spark, d, "part").select("p_partkey", n["band_id"].alias("band_id"), n["wl_nm"].alias("wl_nm"))


def sweep_union(spark, d):
    p = states(spark, d).select("aot", "h").distinct()
    low = algebra.sweep(p.where("aot < 1"), lambda aot, h: F.round(F.exp(-aot) * (1 + h), 6), "value")
    high = algebra.sweep(p.where("aot >= 1 or aot is null"), lambda aot: F.round(F.exp(-aot), 6), "value")
    return algebra.concat([low, high])


def chunked_sweep(spark, d):
    p = algebra.chunked(states(spark, d).select("aot", "h").distinct(), "aot", 4)
    return p.groupBy("chunk").agg(F.round(F.sum(F.exp(-F.col("aot"))), 6).alias("total"), F.count(F.lit(1)).alias("n"))


def block_reduce(spark, d):
    return algebra.block_reduce(raster(spark, d), ["band"], "v", 3).select("band", "by", "bx", r6("v"))


def best_step(spark, d):
    h = read(spark, d, "events").select("user_id", F.col("value").alias("loss"), "event_id")
    return algebra.best_step(h, ["user_id"], "loss", ["event_id"]).select("user_id", r6("loss"), "event_id")


# ---- radial


def radial_mean(spark, d):
    return profile(spark, d).select("band", "bin", r6("r"), "n", r6("mean"))


def radial_std(spark, d):
    return profile(spark, d).select("band", "bin", r6("std"))


def radial_cdf(spark, d):
    return radial.cumulative(profile(spark, d), ["band"]).select("band", "bin", r6("cdf"))


def energy_mask(spark, d):
    px = radial.with_radius(raster(spark, d), ["band"])
    return radial.energy_mask(px, ["band"], "v").groupBy("band").agg(F.sum("mask").alias("kept"), F.count(F.lit(1)).alias("n"))


def nation_params(spark, d):
    k = F.col("n_nationkey")
    return read(spark, d, "nation").select("n_nationkey", (0.5 + k * 0.25).alias("sigma"), (0.5 + k * 0.1).alias("gamma"), (1 + k * 0.2).alias("alpha"), (0.8 + k * 0.05).alias("beta"), (0.1 + k * 0.01).alias("n"))


def kernel_query(model: str) -> Callable:
    def query(spark, d):
        return psf.kernels(nation_params(spark, d), ["n_nationkey"], model, 1.0, 11).select("n_nationkey", "dy", "dx", F.round("w", 9).alias("w"))

    return query


def encircled_energy(spark, d):
    k = psf.kernels(nation_params(spark, d), ["n_nationkey"], "gaussian", 1.0, 41)
    grid = k.select("n_nationkey", (F.col("dy") + 20).alias("iy"), (F.col("dx") + 20).alias("ix"), F.col("dy").cast("double").alias("y"), F.col("dx").cast("double").alias("x"), "w")
    cdf = radial.cumulative(radial.profile(grid, ["n_nationkey"], "w"), ["n_nationkey"], fill_empty=True)
    return radial.energy_radius(cdf, ["n_nationkey"]).select("n_nationkey", r6("r_10"), r6("r_50"), r6("r_99"))


# ---- interpolation


def linear_interp(spark, d):
    q = raster(spark, d).select("band").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(60)))).withColumn("q", F.col("k") * 0.75)
    return interp.linear(profile(spark, d).where("mean is not null"), q, ["band"], "r", "mean", "q", "v").select("band", "k", r6("v"))


def adaptive_radii(spark, d):
    return interp.adaptive_radii(profile(spark, d).where("mean is not null"), ["band"], "r", "mean", 12).select("band", "j", F.round("radius", 5).alias("radius"))


def gap_fill(spark, d):
    filled = interp.fill_gaps(profile(spark, d).select("band", "r"), ["band"], "r", 0.4)
    return filled.select("band", r6("r"))


def pchip_field(spark, d):
    px = radial.with_radius(raster(spark, d), ["band"]).select("band", "iy", "ix", "r")
    return interp.pchip(profile(spark, d).where("mean is not null").select("band", F.col("r").alias("pr"), "mean"), px, ["band"], "pr", "mean", "r", "v").select("band", "iy", "ix", r6("v"))


def transect(spark, d):
    return interp.transect(raster(spark, d), ["band"], "v", 30.0, 21).select("band", "j", r6("s"), r6("v"))


# ---- convolution, metrics, fits


def box(spark):
    return values(spark, [(y, x, 1 / 9) for y in (-1, 0, 1) for x in (-1, 0, 1)], "dy int, dx int, w double")


def psf_conv_small(spark, d):
    k = psf.kernels(values(spark, [(0, 1.0)], "k int, sigma double"), ["k"], "gaussian", 1.0, 5).select("dy", "dx", "w")
    return convolution.small(raster(spark, d), k, ["band"], "v", "v_conv").select("band", "iy", "ix", r6("v_conv"))


def psf_conv_fft(spark, d):
    k = psf.kernels(values(spark, [(0, 4.0)], "k int, sigma double"), ["k"], "gaussian", 1.0, 33).select("dy", "dx", "w")
    return convolution.fft(raster(spark, d), k, ["band"], "v", "v_conv").select("band", "iy", "ix", r6("v_conv"))


def image_pairs(spark, d):
    px = raster(spark, d)
    nxt = px.select((F.col("band") - 1).alias("band"), "iy", "ix", F.col("v").alias("t"))
    return radial.with_radius(px, ["band"]).join(nxt, ["band", "iy", "ix"])


def residual_metrics(spark, d):
    found = metrics.metrics(image_pairs(spark, d), ["band"], "v", "t")
    return found.select("band", *[r6(m) for m in metrics.METRICS])


def weighted_loss(spark, d):
    found = metrics.metrics(image_pairs(spark, d), ["band"], "v", "t").withColumn("half", F.col("band") % 2).withColumn("weight", 1 / (F.col("band") + 1))
    return metrics.weighted_loss(found, ["half"], "mse_rad", "weight").select("half", r6("loss"))


def training_set(spark, d):
    """Each band as a uniform-surface field, and as its target the surface under a known point spread function."""
    px = raster(spark, d).withColumn("rho_unif", 0.3 + 0.05 * F.col("v"))
    k = psf.kernels(values(spark, [(0, 2.0)], "k int, sigma double"), ["k"], "gaussian", 1.0, 15).select("dy", "dx", "w")
    env = convolution.fft(px, k, ["band"], "rho_unif", "env").join(px.select("band", "iy", "ix", "rho_unif"), ["band", "iy", "ix"])
    target = five_s.surface(F.col("rho_unif"), F.col("env"), F.lit(TDIR), F.lit(TDIF), F.lit(0.1))
    return env.select("band", "iy", "ix", "rho_unif", target.alias("rho_s"), F.lit(TDIR).alias("tdir_up"), F.lit(TDIF).alias("tdif_up"), F.lit(0.1).alias("sph_alb"))


def fit_psf_adam_lbfgs(spark, d):
    return optimize.fit_psf(training_set(spark, d), ["band"], "gaussian", [1.0], 1.0, 15).select("band", "param", F.round("value", 3).alias("value"), (F.col("loss") < 1e-6).alias("converged"))


# ---- radiatives and the whole chain


def forward_modules(spark) -> Pipeline:
    def with_radiatives(df):
        p = values(spark, [(490.0, a, 0.0, 30.0, 5.0) for a in (0.1, 0.2, 0.4)], "wl double, aot double, h double, sza double, vza double")
        return algebra.natural_join(df, radiative.analytic(p), ["aot"])

    def to_toa(df):
        c = F.col
        return df.withColumn("rho_toa", five_s.forward(c("rho_s"), c("rho_atm"), c("tdir_up") + c("tdif_up"), c("tdir_down") + c("tdif_down"), c("sph_alb")))

    return Pipeline([
        Module("radiatives", ("rho_s",), ("rho_s", "aot", *radiative.OUTPUTS), with_radiatives, {"wl": 490.0}),
        Module("unif2toa", ("rho_s", *radiative.OUTPUTS), ("rho_toa",), to_toa),
    ], given=("band", "iy", "ix", "x", "y", "rho_s"))


def forward_pipeline(spark, d):
    """What the satellite sees: the raster as a surface, under three states, as radial means."""
    surface = raster(spark, d).withColumn("rho_s", 0.3 + 0.05 * F.col("v"))
    toa = forward_modules(spark)(surface).select("band", "aot", "iy", "ix", "x", "y", "rho_toa")
    return radial.profile(toa, ["band", "aot"], "rho_toa").select("band", "aot", "bin", "n", r6("mean"))


flagship = forward_pipeline


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        five_s_inverse, five_s_forward, five_s_roundtrip, direct_transmittance_sweep, surface_pressure, surface_recovery, digitize_levels, albedo_quantize,
        species_normalize, sat_position, sensor_grid, radial_sensors, gaussian_scene, disk_scene, random_scene, npy_export_names, dedup_index, dedup_expand,
        sel_label, isel_slice, nearest_label, reindex_grid, valid_mask, nearest_band, sweep_union, chunked_sweep, block_reduce, best_step, radial_mean, radial_std,
        radial_cdf, energy_mask, encircled_energy, linear_interp, adaptive_radii, gap_fill, pchip_field, transect, psf_conv_small, psf_conv_fft, residual_metrics,
        weighted_loss, fit_psf_adam_lbfgs, forward_pipeline,
    )
    from . import catalogue_more, catalogue_scale

    return {f.__name__: f for f in plain} | {f"psf_{m}": kernel_query(m) for m in psf.MODELS} | catalogue_more.queries() | catalogue_scale.queries()


def oracle_sql() -> dict[str, str]:
    from . import catalogue_more, catalogue_scale
    from .catalogue_sql import SQL

    return SQL | catalogue_more.oracle_sql() | catalogue_scale.SQL
