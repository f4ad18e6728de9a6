"""Further queries over the driver's tables: scenes, sweeps, metadata, surfaces, convolutions with boundaries, and what the satellite sees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue as base
from . import scene as scenes
from .functions import atmosphere, psf, radiative
from .operators import convolution, forward, interp, metrics, radial
from .sources import generators, product


def r6(value, name: str) -> F.Column:
    return F.round(value, 6).alias(name)


def gaussian(spark: SparkSession, side: int, sigmas: tuple[float, ...]) -> DataFrame:
    given = base.values(spark, [(s,) for s in sigmas], "sigma double")
    return psf.kernels(given, ["sigma"], "gaussian", 1.0, side).select("sigma", "dy", "dx", "w")


def named_scene(spark, d) -> scenes.Scene:
    """All of the raster as four bands, whose fields stand one below the other."""
    px = base.raster(spark, d).select((F.col("band") % 4).cast("string").alias("band"), (F.floor(F.col("band") / 4) * 64 + F.col("iy")).cast("int").alias("iy"), "ix", "v")
    return scenes.source(["0", "1", "2", "3"]).enrich("v", px, meta=scenes.Meta(kind="arbitrary"))


def scene_info(spark, d):
    return scenes.grid_info(base.raster(spark, d), ["band"])


def band_replace(spark, d):
    scene = named_scene(spark, d)
    doubled = scene.band("3")["v"].withColumn("v", F.col("v") * 2)
    return scene.put("3", "v", doubled)["v"].select("band", "iy", "ix", r6(F.col("v"), "v"))


def scene_table(spark, d):
    scene = named_scene(spark, d)
    gains = base.values(spark, [(b, k, 0.5 * k + b) for b in range(4) for k in (1, 2)], "band int, k int, gain double").withColumn("band", F.col("band").cast("string"))
    both = scene.enrich("gain", gains).require(["v", "gain"]).table(["v", "gain"])
    return both.groupBy("band", "k").agg(r6(F.avg(F.col("v") * F.col("gain")), "mean"), F.count(F.lit(1)).alias("n"))


def normalise_output(spark, d):
    px = base.raster(spark, d).select("band", "iy", "ix", r6(F.col("v"), "v")).withColumn("angles", F.lit(0))
    return scenes.normalise(px, ["angles", "absent"], {"v": "rho", "absent": "other"}, {"wl": 490.0, "band": 1.0})


def unflatten_sensors(spark, d):
    px = base.raster(spark, d).select("band", (F.col("iy") * 64 + F.col("ix")).alias("sensor"), r6(F.col("v"), "v"))
    return scenes.unflatten(px, "sensor", 16)


def pixel_rows(spark, d):
    rows = scenes.rows_as_arrays(base.raster(spark, d), ["band"], "v")
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("band", "iy", F.size("v").alias("n"), F.round(total, 4).alias("total"), F.round(F.get("v", 5).cast("double"), 5).alias("sixth"))


def misaligned_pixels(spark, d):
    px = base.raster(spark, d)
    last = px.select("band", "iy", "ix").where(F.col("iy") + F.col("band") >= 3)  # the first bands lack rows
    return scenes.misaligned([last.where(F.col("band") % 3 == k) for k in range(3)], ["iy", "ix", "band"])


def species_split(spark, d):
    mix = F.create_map(F.lit("dust"), F.lit(0.25), F.lit("sulphate"), F.lit(0.75))
    return atmosphere.species_depths(base.states(spark, d).select("event_id", "aot").withColumn("species", mix)).select("event_id", "aerosol", r6(F.col("tau_ref"), "tau_ref"))


def vertical_grids(spark, d):
    return atmosphere.vertical_grids(base.scene_bands(spark, d))


def atmospheres(spark, d):
    states = base.states(spark, d).select("aot", "h").distinct().withColumn("wl", F.lit(490.0))
    return atmosphere.atmosphere(states).select("aot", "h", *[r6(F.col(c), c) for c in ("pressure", "tau_rayleigh", "tau_aerosol")])


def surface_background(spark, d):
    px = base.raster(spark, d)
    kinds = {"mean": "mean", "min": "min", "zero": "zero", "float": 0.25, "other": "unknown"}
    parts = [atmosphere.background(px, ["band"], "v", "arbitrary", chosen=given).select("band", F.lit(name).alias("chosen"), r6(F.col("albedo"), "albedo")) for name, given in kinds.items()]
    parts.append(atmosphere.background(px, ["band"], "v", "analytical", {"rho_max": 0.8}).select("band", F.lit("analytical").alias("chosen"), r6(F.col("albedo"), "albedo")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def angle_sensors(spark, d):
    s = base.read(spark, d, "nation").select("n_nationkey")
    return atmosphere.angle_sensors(s, (0.0, 15.0, 45.0), (F.col("n_nationkey") * 14.0), F.lit(700.0))


def extend_analytical(spark, d):
    disk = generators.extended(base.scene_bands(spark, d), "disk", {"radius": 2.0, "rho_min": 0.25, "rho_max": 0.75}, 0.5, 21).withColumn("model", F.lit("disk"))
    gauss = generators.extended(base.scene_bands(spark, d), "gauss", {"sigma": 3.0, "rho_min": 0.2, "rho_max": 0.8}, 0.5, 21).withColumn("model", F.lit("gauss"))
    return disk.unionByName(gauss).select("model", "band", "iy", "ix", F.round(F.col("rho_s").cast("double"), 5).alias("rho_s"))


def radial_upsampled(spark, d):
    return radial.upsampled(base.profile(spark, d), ["band"], 100).select("band", "bin", r6(F.col("r"), "r"), r6(F.col("mean"), "mean"))


def masked_metrics(spark, d):
    found = metrics.metrics(base.image_pairs(spark, d), ["band"], "v", "t", "v", ("mae_rad", "mse_rad", "rmse_rad"))
    return found.select("band", *[r6(F.col(c), c) for c in ("mae_rad", "mse_rad", "rmse_rad")])


def transect_default(spark, d):
    return interp.transect(base.raster(spark, d), ["band"], "v", 75.0).select("band", "j", r6(F.col("s"), "s"), r6(F.col("v"), "v"))


def psf_conv_tiled(spark, d):
    k = gaussian(spark, 9, (2.0,)).drop("sigma")
    return convolution.tiled(base.raster(spark, d), k, ["band"], "v", "v_conv", tile=24).select("band", "iy", "ix", r6(F.col("v_conv"), "v_conv"))


def psf_conv_states(spark, d):
    sigmas = (1.0, 2.0)
    px = base.raster(spark, d).select("band", "iy", "ix", "v").crossJoin(base.values(spark, [(s,) for s in sigmas], "sigma double"))
    return convolution.fft(px, gaussian(spark, 9, sigmas), ["sigma", "band"], "v", "v_conv").select("sigma", "band", "iy", "ix", r6(F.col("v_conv"), "v_conv"))


def unif_to_surface(spark, d):
    px = base.raster(spark, d).select("band", "iy", "ix", (0.3 + 0.05 * F.col("v")).alias("rho_unif"), F.lit(0.6).alias("tdir_up"), F.lit(0.1).alias("tdif_up"), F.lit(0.1).alias("sph_alb"))
    return convolution.unif2surface(px, gaussian(spark, 9, (2.0,)).drop("sigma"), ["band"]).select("band", "iy", "ix", r6(F.col("rho_s"), "rho_s"))


def two_states(spark) -> DataFrame:
    return radiative.analytic(base.values(spark, [(490.0, a, 0.0, 30.0, 5.0) for a in (0.1, 0.3)], "wl double, aot double, h double, sza double, vza double"))


def rho_toa_full(spark, d):
    px = base.raster(spark, d).select("band", "iy", "ix", (0.3 + 0.05 * F.col("v")).alias("rho_s"))
    seen = forward.full(px, two_states(spark), ["band"], ["aot"], gaussian(spark, 9, (2.0,)).drop("sigma"), "arbitrary", (1, 7, 6, 30))  # rows that the last band has too
    return seen.select("band", "aot", "iy", "ix", r6(F.col("rho_toa"), "rho_toa"), "rho_toa_valid")


def rho_toa_symmetric(spark, d):
    disk = generators.disk_scene(base.scene_bands(spark, d), 2.0, 0.5, n=17, low=0.25, high=0.75).select("band", "iy", "ix", "x", "y", F.col("rho_s").cast("double").alias("rho_s"))
    return forward.symmetric(disk, two_states(spark), ["band"], ["aot"], 0.5, 17, "analytical", nr=20, max_gap=0.5).select("band", "aot", "iy", "ix", r6(F.col("rho_toa"), "rho_toa"))


def product_metadata(spark, d):
    """A metadata document for each supplier: some without humidity, some with an empty angle, shares that don't sum to one."""
    k = F.col("s_suppkey")
    part = lambda form, *args: F.format_string(form, *args)
    humid = F.when(k % 3 == 0, F.lit("")).otherwise(part("<Relative_Humidity>%d</Relative_Humidity>", k % 100))
    angle = F.when(k % 5 == 0, F.lit("")).otherwise(part("%d.5", k % 40))
    xml = F.concat(
        F.lit("<Doc><Product_Quality>"), humid, F.lit("</Product_Quality><Sun_Angles><ZENITH_ANGLE>"), part("%d.25", k % 80), F.lit("</ZENITH_ANGLE><AZIMUTH_ANGLE>"), part("%d.5", k % 360), F.lit("</AZIMUTH_ANGLE></Sun_Angles>"),
        F.lit("<Mean_Viewing_Incidence_Angle band_id='B2'><ZENITH_ANGLE>"), angle, F.lit("</ZENITH_ANGLE><AZIMUTH_ANGLE>100.0</AZIMUTH_ANGLE></Mean_Viewing_Incidence_Angle><Models><Model name='dust'>"),
        part("%d", k % 4), F.lit("</Model><Model name='sulphate'>"), part("%d", k % 3), F.lit("</Model></Models></Doc>"),
    )
    # documents cost far more than their bytes tell, so a file's rows are dealt to many tasks
    rows = base.read(spark, d, "supplier").select("s_suppkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey").select("s_suppkey", product.fields(xml, product.asked("B2")).alias("found"))
    read = rows.select("s_suppkey", *[v.alias(n) for n, v in product.metadata(F.col("found"), "B2").items()]).withColumnRenamed("species", "m")
    return read.select("s_suppkey", "rh", "sza", "saa", "vza", "vaa", r6(F.try_element_at("m", F.lit("dust")), "dust"), F.size("m").alias("n_species"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        scene_info, band_replace, scene_table, normalise_output, unflatten_sensors, pixel_rows, misaligned_pixels, species_split, vertical_grids, atmospheres,
        surface_background, angle_sensors, extend_analytical, radial_upsampled, masked_metrics, transect_default, psf_conv_tiled, psf_conv_states, unif_to_surface, rho_toa_full, rho_toa_symmetric, product_metadata,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .catalogue_more_sql import SQL

    return dict(SQL)
