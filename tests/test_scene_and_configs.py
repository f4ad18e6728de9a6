"""Scenes, configurations, sweeps, product folders, collections of point spread functions, samplers and facades."""

import logging
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from haloscape import api
from haloscape import scene as scenes
from haloscape.fit import optimize
from haloscape.fit.collection import Model, PsfCollection, fixed_kernel
from haloscape.functions import atmosphere, psf, radiative
from haloscape.log import Multiline
from haloscape.operators import convolution, forward, metrics, radial
from haloscape.operators.algebra import MissingVariableError, batches
from haloscape.plans import configs
from haloscape.sources import generators, product, tiff


def long(spark, image, band="B02", name="v"):
    return spark.createDataFrame([(band, y, x, float(x), float(y), float(image[y, x])) for y in range(image.shape[0]) for x in range(image.shape[1])], f"band string, iy int, ix int, x double, y double, {name} double")


def dense(rows, name, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r.iy, r.ix] = r[name]
    return out


def test_scene(spark):
    v = long(spark, np.ones((2, 2)), "B8A").unionByName(long(spark, np.ones((2, 2)), "B12"))
    scene = scenes.source(["B8A", "B12"]).enrich("v", v, meta=scenes.Meta("analytical", "gauss", {"sigma": 1.5}))
    assert scene.bands == ["B12", "B8A"] and scene.has("v") and "B12" in scene and scene.variables("B12") == ["v"]
    assert scene.about("v", "B12").is_analytical and scene.about("v", "B12").params == {"sigma": 1.5} and scene.about("w", "B12").kind is None
    with pytest.raises(MissingVariableError):
        scene.require(["v", "w"])
    with pytest.raises(MissingVariableError):
        scene["w"]
    one = scene.band("B12").put("B03", "w", spark.createDataFrame([("B03", 1.0)], "band string, w double"))
    assert one.bands == ["B03", "B12"] and not one.has("v") and scene.bands == ["B12", "B8A"]
    stamped = scene.stamp(["v"], "module", "key")
    assert stamped.about("v", "B8A").made_by == ("module", "key") and scene.about("v", "B8A").made_by is None and "B12: ['v']" in repr(scene)
    again = scenes.source(["B01"], scene)
    assert again.bands == ["B01", "B12", "B8A"] and not again.has("v")
    with pytest.raises(ValueError, match="lacks"):
        scenes.misaligned([v, v.drop("ix")], ["iy", "ix"])
    assert scenes.misaligned([v, v], ["iy", "ix"]).count() == 0


def test_configs(spark):
    pixel = ("pixel",)
    cfg = configs.AtmosphereConfig(configs.values("aot", (pixel, [0.1, 0.2, 0.1, 0.2])), configs.values("h", (pixel, [0.0] * 4)), 50.0, 2.0, {"sulphate": 1.0})
    assert [len(list(cfg.iter(n, "pixel"))) for n in (1, 2, 4, 100)] == [4, 2, 1, 1] and len(list(cfg.iter(1, "absent"))) == 1
    parts = list(cfg.iter(2, "pixel"))
    assert [p.aot.data for p in parts] == [(0.1, 0.2), (0.1, 0.2)] and parts[0].rh.data == (50.0,) and parts[0].species == {"sulphate": 1.0}
    distinct, number = cfg.unique(["pixel"])
    assert [distinct[i] for i in number] == [(0.1, 0.0), (0.2, 0.0)] * 2 and len(distinct) == 2
    out = cfg.run(lambda c: c.table(spark), 2, "pixel")
    assert sorted(r.aot for r in out.collect()) == [0.1, 0.1, 0.2, 0.2]
    for bad in ({"aot": -0.1}, {"h": 11.0}, {"rh": 101.0}, {"href": 0.0}, {"species": {"dust": 0.5}}):
        with pytest.raises(ValueError):
            configs.AtmosphereConfig(**{"aot": 0.2, "h": 0.5, "rh": 50.0, "href": 2.0, "species": {"sulphate": 1.0}, **bad})
    geo = configs.GeometryConfig(30.0, [0.0, 15.0], 45.0, 180.0)
    assert geo.sun == {"th_deg": (30.0,), "phi_deg": (45.0,)} and geo.satellite["phi_deg"] == (45.0,)
    assert {(r.vza, r.dx, r.dy) for r in geo.offsets(spark).collect()} == {(0.0, 0.0, 0.0), (15.0, round(700 * math.tan(math.radians(15)), 4), 0.0)}
    assert configs.SpectralConfig([492.0, 10_000.0]).bands == ["B02", "B12"] and configs.SpectralConfig.from_bands(["B04"]).wl.data == (665.0,)
    with pytest.raises(ValueError):
        configs.values("aot", [[0.1], [0.2]])
    arrays, others = configs.aggregate([cfg, geo], ["aot", "sza"])
    assert arrays["sza"].data == (30.0,) and others["sat_height"] == 700.0
    with pytest.raises(configs.ConfigurationError):
        configs.aggregate([cfg], ["wl"])
    rows = configs.one_dimension({k: configs.values(k, (pixel, [1.0, 2.0])) for k in ("aot", "rh", "wl", "href", "h")})
    assert len(rows) == 2 and rows[1]["wl"] == 2.0
    with pytest.raises(ValueError):
        configs.one_dimension({"aot": configs.values("aot", [1.0]), "rh": configs.values("rh", [1.0]), "wl": configs.values("wl", [1.0]), "href": configs.values("href", [1.0]), "h": configs.values("h", [1.0])})
    assert cfg.stable["aot"] == [["pixel"], [0.1, 0.2, 0.1, 0.2]]
    assert len(batches(spark.range(5).toDF("k"), "k", 2)) == 3 and len(batches(spark.range(5).toDF("k"), "z", 2)) == 1


def test_sweep(spark):
    with pytest.raises(ValueError, match="dimensions"):
        configs.Sweep({"aot": configs.values("aot", (("a", "b"), [[1.0], [2.0]]))})
    with pytest.raises(ValueError, match="repeated"):
        configs.Sweep({"aot": configs.values("aot", [0.1, 0.1])})
    sweep = configs.Sweep({"aot": configs.values("aot", [0.1, 0.2])}, {"wl": configs.values("wl", [400.0, 500.0, 600.0])}, {"wl": 2})
    assert sorted((r.aot, r.wl, r.chunk) for r in sweep.table(spark).collect()) == [(a, w, int(w == 600.0)) for a in (0.1, 0.2) for w in (400.0, 500.0, 600.0)]
    seen = sweep.apply(spark, lambda aot, wl: float(len(wl)) + 0 * np.asarray(wl) + aot, "n", as_columns=False).collect()
    assert {(r.wl, r.n) for r in seen if r.aot == 0.1} == {(400.0, 2.1), (500.0, 2.1), (600.0, 1.1)}


def write_tiff(path, layers, dtype, compress, tiled, scale=10.0, origin=(300000.0, 5000000.0)):
    image = np.asarray(layers, dtype)
    n, h, w = image.shape
    code = {"u": 1, "i": 2, "f": 3}[np.dtype(dtype).kind]
    th, tw = (16, 16) if tiled else (3, w)
    blocks = []
    for y in range(0, h, th):
        for x in range(0, w, tw):
            block = np.zeros((th if tiled else min(th, h - y), tw, n), dtype)
            part = image[:, y : y + th, x : x + tw].transpose(1, 2, 0)
            block[: part.shape[0], : part.shape[1]] = part
            blocks.append(zlib.compress(block.tobytes()) if compress else block.tobytes())
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [np.dtype(dtype).itemsize * 8] * n), (259, 3, [8 if compress else 1]), (277, 3, [n]), (284, 3, [1])]
    tags += [(322, 4, [16]), (323, 4, [16]), (324, 4, None), (325, 4, [len(b) for b in blocks])] if tiled else [(273, 4, None), (278, 4, [3]), (279, 4, [len(b) for b in blocks])]
    tags += [(339, 3, [code] * n), (33550, 12, [scale, scale, 0.0]), (33922, 12, [0.0, 0.0, 0.0, *origin, 0.0])]
    tags.sort()
    at = 8 + 2 + 12 * len(tags) + 4
    extra, entries = b"", b""
    sizes = {3: "H", 4: "I", 12: "d"}
    data_at = at + sum(len(v) * struct.calcsize(sizes[k]) for _, k, v in [(t, k, v if v is not None else [0] * len(blocks)) for t, k, v in tags] if len(v) * struct.calcsize(sizes[k]) > 4)
    offsets = [data_at + sum(map(len, blocks[:i])) for i in range(len(blocks))]
    for tag, kind, v in tags:
        v = offsets if v is None else v
        raw = struct.pack("<" + sizes[kind] * len(v), *v)
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, kind, len(v), at + len(extra))
            extra += raw
        else:
            entries += struct.pack("<HHI", tag, kind, len(v)) + raw.ljust(4, b"\0")
    path.write_bytes(b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra + b"".join(blocks))


def product_folder(tmp_path, rng):
    folder = tmp_path / "SENTINEL2B_20180616-102816-151_L2A_T32TMR_C_V1-0"
    folder.mkdir()
    rho = rng.random((12, 20))
    write_tiff(folder / "SENTINEL2B_SRE_B2.tif", [rho], np.float32, True, True)
    write_tiff(folder / "SENTINEL2B_SRE_B3.tif", [rho * 2], np.float64, False, False)
    write_tiff(folder / "SENTINEL2B_ATB_R2.tif", [np.zeros((6, 10)), np.full((6, 10), 40)], np.uint8, False, False, 20.0)
    (folder / "S2__32TMR_x.DBL.DIR").mkdir()
    np.save(folder / "S2__32TMR_x.DBL.DIR" / "S2__32TMR_ALT_R2.npy", np.arange(60.0).reshape(6, 10) * 100)
    angles = "<Mean_Viewing_Incidence_Angle band_id='{}'><ZENITH_ANGLE>{}</ZENITH_ANGLE><AZIMUTH_ANGLE>100.126</AZIMUTH_ANGLE></Mean_Viewing_Incidence_Angle>"
    (folder / "META.xml").write_text(
        "<Doc><Product_Quality><Relative_Humidity>61.5</Relative_Humidity></Product_Quality><Sun_Angles><ZENITH_ANGLE>30.128</ZENITH_ANGLE><AZIMUTH_ANGLE>150</AZIMUTH_ANGLE></Sun_Angles>"
        + angles.format("B2", "5.5") + angles.format("B3", "") + "<M><Model name='sulphate'>0.4</Model><Model name='dust'>0.4</Model></M></Doc>"
    )
    return folder, rho


def test_product_loader(spark, tmp_path):
    folder, rho = product_folder(tmp_path, np.random.default_rng(1))
    loader = product.ProductLoader(spark, str(folder), ["B02", "B03"], [0.02, 0.02], True, (product.GEOMETRY, product.ATMOSPHERE, product.ELEVATION))
    assert loader.metadata["sensor"] == "SENTINEL2B" and loader.metadata["date"] == "2018061" and loader.metadata["tile"] == "32TMR"
    assert loader.outputs == ("rho_s", "vza", "vaa", "sza", "saa", "aot", "rh", "href", "h")
    scene = loader.scene()
    want = rho.reshape(6, 2, 10, 2).mean((1, 3))
    rows = scene["rho_s"].where("band = 'B02'").collect()
    assert np.allclose(dense(rows, "rho_s", (6, 10)), want, atol=1e-6)
    first = next(r for r in rows if r.iy == 0 and r.ix == 0)
    assert (first.x, first.y) == pytest.approx((300.01, 4999.99)) and scenes.grid_info(scene["rho_s"], ["band"]).first().res == pytest.approx(0.02)
    assert np.allclose(dense(scene["rho_s"].where("band = 'B03'").collect(), "rho_s", (6, 10)), want * 2)
    assert {(r.band, r.vza) for r in scene["vza"].collect()} == {("B02", 5.5), ("B03", 0.0)} and {r.sza for r in scene["sza"].collect()} == {30.13} and {r.rh for r in scene["rh"].collect()} == {61.5}
    assert {r.aot for r in scene["aot"].collect()} == {0.2} and np.allclose(dense(scene["h"].where("band = 'B02'").collect(), "h", (6, 10)), np.arange(60.0).reshape(6, 10) / 10)
    assert loader.species().first().species == {"dust": 0.5, "sulphate": 0.5}
    flat = api.load_product(spark, str(folder), ["B02"], 0.02)
    assert flat["h"].first().h == pytest.approx(2.95) and flat["aot"].count() == 1
    with_states = api.load_product(spark, str(folder), ["B02"], 0.02, as_map=True, compute_radiatives=True, n_bins=5)
    assert with_states["tdir_up"].count() == 60 and with_states["tdir_up"].select("tdir_up").distinct().count() <= 5
    with pytest.raises(ValueError):
        product.ProductLoader(spark, str(tmp_path), ["B02"], 0.02)
    with pytest.raises(configs.ConfigurationError):
        product.resolutions(["B02"], [0.01, 0.02])
    with pytest.raises(Exception, match="no sun angles"):
        spark.range(1).select(product.sun_angles(F.lit("<Doc/>"))["sza"]).collect()
    assert spark.range(1).select(product.species(F.lit("<D><Model name='dust'>0</Model></D>")).alias("m")).first().m == {"dust": 0.0}
    table = tmp_path / "r.parquet"
    spark.createDataFrame([(0, 0, 1.0, 2), (0, 0, 5.0, 1)], "iy int, ix int, value double, layer int").write.parquet(str(table))
    assert tiff.raster_table(spark, str(table), 2).first().value == 1.0


def test_psf_collection(spark):
    made = PsfCollection.start(spark, {"B03": (1.0, 5), "B02": (1.0, 7)}, "gaussian", {"sigma": 1.0})
    assert made.bands == ["B02", "B03"] and made.is_trainable and "B02" in made and made.model("B02").n == 7
    with pytest.raises(RuntimeError):
        made.kernel("B02")
    frozen = made.frozen()
    assert not frozen.is_trainable and frozen.frozen() is frozen and frozen.kernel("B02").count() == 49
    assert frozen.kernel("B03").agg(F.sum("w")).first()[0] == pytest.approx(1.0) and frozen.params("B02").first().value == 1.0
    with pytest.raises(RuntimeError):
        frozen.model("B02")
    by_band = PsfCollection.start(spark, {"B03": (1.0, 5), "B02": (1.0, 7)}, "gaussian", {"B02": {"sigma": 1.0}, "B03": {"sigma": 2.0}})
    assert by_band.model("B03").params == {"sigma": 2.0}
    with pytest.raises(ValueError):
        Model("gaussian", {"gamma": 1.0}, 1.0, 5)
    with pytest.raises(ValueError):
        PsfCollection.start(spark, {"B03": (1.0, 5)}, "gaussian", {"B02": {"sigma": 1.0}})
    k = fixed_kernel(spark, np.ones((3, 3)), 3)
    assert k.count() == 9 and k.agg(F.sum("w")).first()[0] == pytest.approx(1.0, abs=1e-6)
    assert PsfCollection.from_kernels(k.withColumn("band", F.lit("B02")), ["B02"]).params("B02") is None
    with pytest.raises(ValueError):
        fixed_kernel(spark, np.ones((3, 5)), 3)


def test_kernels_equal_their_numpy_twins(spark):
    starts = {"gaussian": (1.5,), "generalized_gaussian": (0.5, 0.3), "voigt": (1.2, 0.8), "king": (2.0, 1.5), "moffat": (1.5, 1.1, 2.0)}
    for model, params in starts.items():
        given = spark.range(1).select(F.lit(0).alias("k"), *[F.lit(v).alias(n) for n, v in zip(psf.BOUNDS[model], params, strict=True)])
        got = np.zeros((9, 9))
        for r in psf.kernels(given, ["k"], model, 0.5, 9).collect():
            got[r.dy + 4, r.dx + 4] = r.w
        assert np.allclose(got, optimize.kernel(model, params, 0.5, 9))


def test_tiles_equal_whole_fields(spark):
    rng = np.random.default_rng(3)
    image, weights = rng.random((23, 23)), rng.random((7, 7))
    df = long(spark, image)
    k = spark.createDataFrame([(y - 3, x - 3, float(weights[y, x])) for y in range(7) for x in range(7)], "dy int, dx int, w double")
    for boundary, padded in (("mirror", np.pad(image, 3, mode="reflect")), ("zero", np.pad(image, 3))):
        want = sum(weights[a, b] * padded[6 - a : 6 - a + 23, 6 - b : 6 - b + 23] for a in range(7) for b in range(7))
        assert np.allclose(dense(convolution.tiled(df, k, ["band"], "v", "c", 8, boundary).collect(), "c", image.shape), want)
    whole = convolution.fft(df, k, ["band"], "v", "c", boundary="mirror")
    assert np.allclose(dense(whole.collect(), "c", image.shape), dense(convolution.tiled(df, k, ["band"], "v", "c", 8).collect(), "c", image.shape))


def test_samplers(spark):
    bands = spark.createDataFrame([("B02",)], "band string")
    disk = generators.disk_scene(bands, 1.0, 0.1, n=41, low=0.1, high=0.6).select("band", "iy", "ix", "x", "y", F.col("rho_s").cast("double").alias("rho_s"))
    rads = radiative.analytic(spark.createDataFrame([(490.0, 0.2, 0.0, 30.0, 5.0)], "wl double, aot double, h double, sza double, vza double"))
    got = forward.symmetric(disk, rads, ["band"], ["aot"], 0.1, 41, "analytical", 60)
    kernel = forward.approximate_kernel(disk, 0.1, 41)
    whole = forward.full(disk.select("band", "iy", "ix", "rho_s"), rads, ["band"], ["aot"], kernel, "arbitrary", (0, 0, 41, 41))
    a, b = (dense(x.collect(), "rho_toa", (41, 41)) for x in (got, whole))
    assert np.isfinite(a).all() and np.median(np.abs(a - b)[4:-4, 4:-4]) < 0.01 and a[20, 20] > a[0, 20]
    part = forward.full(disk.select("band", "iy", "ix", "rho_s"), rads, ["band"], ["aot"], kernel, "arbitrary", (3, 4, 5, 6)).collect()
    assert sum(r.rho_toa_valid for r in part) == 30 and all((r.rho_toa is None) != r.rho_toa_valid for r in part) and len(part) == 41 * 41
    with pytest.raises(ValueError):
        forward.symmetric(disk, rads, ["band"], ["aot"], 0.1, 41, "arbitrary")
    with pytest.raises(ValueError):
        forward.full(disk, rads, ["band"], ["aot"], kernel, "analytical", (0, 0, 1, 1))
    with pytest.raises(ValueError, match="leaves"):
        forward.full(disk, rads, ["band"], ["aot"], kernel, "arbitrary", (40, 0, 5, 1))


def test_forward_facade(spark):
    bands = spark.createDataFrame([("B02",), ("B03",)], "band string")
    rho = generators.gaussian_scene(bands, 0.5, 0.1, n=21, low=0.1, high=0.5).select("band", "iy", "ix", "x", "y", F.col("rho_s").cast("double").alias("rho_s"))
    scene = scenes.source(["B02", "B03"]).enrich("rho_s", rho, meta=scenes.Meta("analytical", "gauss", {"sigma": 0.5, "rho_max": 0.5}))
    out = api.forward_pipeline(spark, scene, api.atmosphere_config([0.1, 0.2]), api.geometry_config(30.0, 5.0), 0.1, 21, 20)
    assert out.has("rho_toa") and out["rho_unif"].count() == 2 * 2 * 441 and out["tdir_up"].count() == 4
    with pytest.raises(MissingVariableError):
        api.config_from_scene(out)
    traced = api.psf_of_atmosphere(spark, api.atmosphere_config(0.3), api.geometry_config(30.0, [0.0, 40.0], 0.0, 0.0), 490.0, 1.0, 21, 4000)
    totals = {r.vza: r.w for r in traced.groupBy("vza").agg(F.sum("w").alias("w")).collect()}
    assert set(totals) == {0.0, 40.0} and all(v == pytest.approx(1.0) for v in totals.values())
    radii = api.energy_radius_landscape(spark.createDataFrame([(1.0,), (2.0,)], "sigma double"), ["sigma"], "gaussian", 1.0, 31).collect()
    assert {r.sigma: r.r_50 for r in radii}[1.0] < {r.sigma: r.r_50 for r in radii}[2.0]
    table = api.lookup_table(spark.createDataFrame([(0.2, 665.0, 1.0), (0.1, 490.0, 2.0)], "aot double, wl double, sigma double"), ["sigma"])
    assert table.columns == ["wl", "aot", "sigma"] and table.first().wl == 490.0


def test_fit_and_transform(spark):
    k = psf.kernels(spark.createDataFrame([(0, 1.5)], "k int, sigma double"), ["k"], "gaussian", 1.0, 9).select("dy", "dx", "w")
    rng = np.random.default_rng(2)
    base = long(spark, 0.2 + 0.3 * rng.random((20, 20)), name="rho_unif").select("band", "iy", "ix", "rho_unif", F.lit(0.6).alias("tdir_up"), F.lit(0.1).alias("tdif_up"), F.lit(0.1).alias("sph_alb"))
    train = convolution.unif2surface(base, k, ["band"])
    model = api.PsfFit("gaussian", [1.0], 1.0, 9).fit(train, ["band"])
    assert model.params.first().value == pytest.approx(1.5, abs=0.02)
    back = model.transform(train.drop("rho_s")).collect()
    assert np.allclose(dense(back, "rho_s", (20, 20)), dense(train.collect(), "rho_s", (20, 20)), atol=1e-4)
    history = optimize.fit_history(train, ["band"], "gaussian", [1.0], 1.0, 9).collect()
    assert {r.stage for r in history} == {"adam", "lbfgs"} and history[-1].loss < history[0].loss
    two = train.withColumn("image", F.lit(0)).unionByName(train.withColumn("image", F.lit(1))).withColumn("weight", F.lit(0.5))
    assert optimize.fit_psf(two, ["band"], "gaussian", [1.0], 1.0, 9).first().value == pytest.approx(1.5, abs=0.02)
    names = ["sigma"]
    candidates = spark.createDataFrame([(1.0,), (1.5,), (2.5,)], "sigma double")
    placed = radial.with_radius(train.withColumn("x", F.col("ix").cast("double")).withColumn("y", F.col("iy").cast("double")), ["band"]).drop("r_max", "npix").withColumn("weight", F.lit(1.0))
    found = metrics.landscape(placed, candidates, names, psf.kernels(candidates, names, "gaussian", 1.0, 9).select("sigma", "dy", "dx", "w"), ["band"], ["band"], metrics.Loss("rmse_rad")).collect()
    losses = {r.sigma: r.loss for r in found}
    assert losses[1.5] == pytest.approx(0, abs=1e-9) and losses[1.0] > 1e-4 and losses[2.5] > 1e-4
    with pytest.raises(ValueError):
        metrics.Loss("rmse_rad", "rho_s")


def test_wolfe_conditions():
    for f, d in ((lambda t: (t - 3) ** 2, lambda t: 2 * (t - 3)), (lambda t: (t - 0.01) ** 2, lambda t: 2 * (t - 0.01))):
        t = optimize.wolfe(lambda t, f=f, d=d: (f(t), d(t)), f(0), d(0))
        assert f(t) <= f(0) + 1e-4 * t * d(0) and abs(d(t)) <= 0.9 * abs(d(0))


def test_transforms_and_surfaces():
    for t in (atmosphere.Transform(), atmosphere.Transform("exp"), atmosphere.Transform("sigmoid", 0.1, 0.4)):
        assert t.value(t.free(0.25)) == pytest.approx(0.25)
    p = atmosphere.BoundedParameter(0.25, 0.1, 0.4, atmosphere.Transform("sigmoid", 0.1, 0.4))
    assert p.at(p.free) == pytest.approx(0.25) and p.at(1e9) <= 0.4
    with pytest.raises(ValueError):
        atmosphere.BoundedParameter(1.0, 0.1, 0.4)
    assert atmosphere.analytical_environment("gauss", {"sigma": 3.0, "rho_min": 0.1}) == {"env": 2, "size": 18.0, "albedo": 0.1}
    assert atmosphere.analytical_environment("disk", {"radius": 3.0, "rho_min": 0.1})["size"] == 3.0
    with pytest.raises(NotImplementedError):
        atmosphere.analytical_environment("ring", {})
    assert generators.resolve_bands({"B01": 0.06, "B02": 0.01}, ["B01", "B02"], extent_km=1.0) == {"B01": 17, "B02": 100}
    with pytest.raises(ValueError):
        generators.resolve_bands({"B01": 0.06}, ["B02"], n=3)


def test_empty_bins_poison_what_follows(spark):
    prof = spark.createDataFrame([(0, 0.0, 1.0), (0, 1.0, 2.0), (0, 2.0, None), (0, 3.0, 1.0), (1, 0.0, 1.0), (1, 1.0, 1.0)], "k int, r double, mean double")
    got = {(r.k, r.r): r.cdf for r in radial.cumulative(prof, ["k"]).collect()}
    assert got[0, 0.0] == 0 and got[0, 1.0] > 1 and got[0, 2.0] is None and got[0, 3.0] is None and got[1, 1.0] == 1
    filled = {(r.k, r.r): r.cdf for r in radial.cumulative(prof, ["k"], fill_empty=True).collect()}
    assert filled[0, 2.0] == filled[0, 1.0] and filled[0, 3.0] == 1


def test_log_lines():
    record = logging.LogRecord("x", logging.INFO, "f", 1, "loaded", (), None)
    record.fields = {"band": "B02", "path": "p" * 300}
    lines = Multiline(40).format(record).split("\n")
    assert lines[0].endswith("loaded") and lines[1] == "    band: B02" and "..." in lines[2] and len(lines[2]) < 60
