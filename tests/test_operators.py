import numpy as np
import pytest
from pyspark.sql import functions as F

from haloscape.fit import optimize
from haloscape.functions import psf, radiative
from haloscape.operators import algebra, convolution, interp, radial
from haloscape.plans.modules import Cache, Module, Pipeline
from haloscape.sources import generators, product, sinks


@pytest.fixture(scope="module")
def disk(spark):
    return generators.disk_scene(spark.createDataFrame([("B02",)], "band string"), 10.0, 1.0, n=51, low=0.1, high=0.8).cache()


def test_resolve_n():
    assert generators.resolve_n(0.06, extent_km=6.0) == 100
    with pytest.raises(ValueError):
        generators.resolve_n(0.06)
    with pytest.raises(ValueError):
        generators.resolve_n(0.06, 3, 1.0)


def test_random_scene_repeats_itself(spark):
    b = spark.createDataFrame([("B02",)], "band string")
    a, same, other = (sorted(map(tuple, generators.random_scene(b, ["v"], 0.01, s, n=8).collect())) for s in (0, 0, 1))
    assert a == same != other


def test_profile_of_a_disk(disk):
    p = radial.profile(disk, ["band"], "rho_s").orderBy("bin").collect()
    assert p[0].r == 0 and p[0].mean == pytest.approx(0.8, abs=1e-6) and p[-1].mean == pytest.approx(0.1, abs=1e-6)
    assert sum(r.n for r in p) == 51 * 51
    c = [r.cdf for r in radial.cumulative(radial.profile(disk, ["band"], "rho_s"), ["band"]).orderBy("bin").collect()]
    assert c == sorted(c) and c[-1] == pytest.approx(1)


def test_pchip_keeps_monotone_data_and_reproduces_nodes(spark):
    x, y = [0.0, 1.0, 2.5, 3.0, 5.0], [0.0, 1.0, 1.0, 4.0, 4.5]
    prof = spark.createDataFrame([("k", a, b) for a, b in zip(x, y, strict=True)], "k string, r double, v double")
    q = spark.createDataFrame([("k", float(a)) for a in [*x, *np.linspace(0, 5, 41)]], "k string, at double")
    got = {r["at"]: r.out for r in interp.pchip(prof, q, ["k"], "r", "v", "at", "out").collect()}
    assert all(got[a] == pytest.approx(b) for a, b in zip(x, y, strict=True))
    line = [got[a] for a in sorted(got)]
    assert all(b >= a - 1e-12 for a, b in zip(line, line[1:], strict=False))


def test_transect_of_a_plane(spark):
    g = generators.grid(spark.createDataFrame([("B02",)], "band string"), 21, 1.0).withColumn("v", 2 * F.col("x") - F.col("y"))
    for r in interp.transect(g, ["band"], "v", 30.0, 9).collect():
        assert r.v == pytest.approx(r.s * (2 * np.cos(np.pi / 6) - np.sin(np.pi / 6)), abs=1e-9)


def test_gaps_are_filled(spark):
    d = spark.createDataFrame([(0, 0.0), (0, 1.0), (0, 1.2)], "k int, r double")
    assert sorted(r.r for r in interp.fill_gaps(d, ["k"], "r", 0.3).collect()) == pytest.approx([0, 0.25, 0.5, 0.75, 1, 1.2])


@pytest.mark.parametrize(("n", "k"), [(8, 3), (10, 3), (16, 5), (8, 4)])
def test_convolution_matches_the_direct_sum(n, k):
    rng = np.random.default_rng(0)
    image, kernel = rng.random((n, n)), rng.random((k, k))
    direct = np.array([[(image[i : i + k, j : j + k] * kernel[::-1, ::-1]).sum() for j in range(n - k + 1)] for i in range(n - k + 1)])
    assert convolution.convolve(image, kernel, kind="valid") == pytest.approx(direct)
    same = convolution.convolve(image, kernel, "constant")
    assert same.shape == image.shape
    lead = k - 1 - (k - 1) // 2
    assert same[lead : lead + n - k + 1, lead : lead + n - k + 1] == pytest.approx(direct)
    with pytest.raises(ValueError):
        convolution.convolve(image, kernel, kind="full")


def test_offset_join_equals_the_transform(spark):
    g = generators.random_scene(spark.createDataFrame([("B02",)], "band string"), ["v"], 1.0, 3, n=12)
    k = psf.kernels(spark.createDataFrame([(0, 1.0)], "one int, sigma double"), ["one"], "gaussian", 1.0, 5).select("dy", "dx", "w")
    a = {(r.iy, r.ix): r.o for r in convolution.small(g, k, ["band"], "v", "o").collect()}
    b = {(r.iy, r.ix): r.o for r in convolution.fft(g, k, ["band"], "v", "o", "constant").collect()}
    assert a.keys() == b.keys() and all(a[c] == pytest.approx(b[c], abs=1e-9) for c in a)


@pytest.mark.parametrize("model", sorted(psf.MODELS))
def test_kernels_sum_to_one_and_peak_in_the_centre(spark, model):
    p = spark.createDataFrame([(0, 0.9, 1.0, 1.0, 1.0, 0.3)], "one int, sigma double, gamma double, alpha double, beta double, n double")
    rows = psf.kernels(p, ["one"], model, 0.01, 11).collect()
    assert sum(r.w for r in rows) == pytest.approx(1) and min(r.w for r in rows) >= 0
    assert max(rows, key=lambda r: r.w)[1:3] == (0, 0)
    with pytest.raises(ValueError):
        psf.check_grid(0.01, 10)


def test_dedup_equals_direct_computation(spark):
    px = spark.range(10_000).select("id", (F.col("id") % 5 / 10).alias("aot"), (F.col("id") % 4 * 10.0).alias("sza"))
    calls = algebra.distinct_states(px, ["aot", "sza"]).collect()
    assert len(calls) == 20 and [r.state for r in sorted(calls, key=lambda r: (r.aot, r.sza))] == list(range(20))
    out = algebra.dedup_apply(px, ["aot", "sza"], lambda u: u.withColumn("t", F.exp(-F.col("aot")) * F.col("sza")))
    assert out.where(F.abs(F.col("t") - F.exp(-F.col("aot")) * F.col("sza")) > 1e-12).count() == 0 and out.count() == 10_000


def test_natural_join_crosses_what_is_not_shared(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "aot int, v double")
    b = spark.createDataFrame([(1, 30, 5.0), (1, 45, 6.0)], "aot int, sza int, w double")
    assert algebra.natural_join(a, b, ["aot", "sza"]).count() == 2
    assert algebra.natural_join(a, b.drop("aot"), ["aot", "sza"]).count() == 4
    with pytest.raises(algebra.MissingVariableError):
        algebra.require(a, ["rho_s"])


def test_block_reduce_cuts_off_the_rest_and_skips_nan(spark):
    rows = [(0, i, j, float("nan") if (i, j) == (0, 0) else 1.0 * (i * 7 + j)) for i in range(5) for j in range(7)]
    got = {(r.by, r.bx): r.v for r in algebra.block_reduce(spark.createDataFrame(rows, "b int, iy int, ix int, v double"), ["b"], "v", 2).collect()}
    assert len(got) == 6 and got[0, 0] == pytest.approx((1 + 7 + 8) / 3)
    with pytest.raises(ValueError):
        algebra.downsample_factor(0.05, 0.02)


def test_fit_finds_the_width(spark):
    rng = np.random.default_rng(1)
    t = {"tdir_up": 0.6, "tdif_up": 0.1, "sph_alb": 0.1}
    rows = []
    for combo, sigma in ((0, 0.8), (1, 2.0)):
        unif = 0.3 + 0.1 * rng.random((32, 32))
        target = optimize.recovered(unif, optimize.kernel("gaussian", [sigma], 1.0, 9), t)
        rows += [(combo, i, j, float(unif[i, j]), float(target[i, j]), *t.values()) for i in range(32) for j in range(32)]
    train = spark.createDataFrame(rows, "combo int, iy int, ix int, rho_unif double, rho_s double, tdir_up double, tdif_up double, sph_alb double")
    got = {r.combo: r.value for r in optimize.fit_psf(train, ["combo"], "gaussian", [1.2], 1.0, 9).collect()}
    assert got[0] == pytest.approx(0.8, rel=1e-2) and got[1] == pytest.approx(2.0, rel=1e-2)


def test_monte_carlo_agrees_with_beer_lambert(spark):
    s = spark.createDataFrame([(1, 0.3, 0.0), (2, 1.0, 60.0)], "state long, od double, sza double")
    for r in radiative.monte_carlo(s, 40_000).collect():
        want = np.exp(-0.3) if r.state == 1 else np.exp(-1 / 0.5)
        assert r.tdir == pytest.approx(want, abs=0.01) and r.tdir + r.tdif + r.reflected == pytest.approx(1)


def test_pipeline_checks_and_caches(spark, tmp_path):
    calls = []

    def compute(df):
        calls.append(1)
        return df.withColumn("b", F.col("a") + 1)

    plus = Module("plus", ("a",), ("b",), compute, {"by": 1})
    with pytest.raises(algebra.MissingVariableError):
        Pipeline([plus], given=["c"])
    df, cache = spark.createDataFrame([(1,), (2,)], "a int"), Cache(spark, f"file://{tmp_path}/cache")
    first = Pipeline([plus])(df, cache, "v1").collect()
    again = Pipeline([plus])(df, cache, "v1").collect()
    assert sorted(first) == sorted(again) and len(calls) == 1
    Pipeline([plus])(df, cache, "v2")
    cache.clear("plus")
    Pipeline([plus])(df, cache, "v1")
    assert len(calls) == 3


def test_product_metadata(spark):
    xml = "<P><Product_Quality/><Sun_Angles><ZENITH_ANGLE>31.256</ZENITH_ANGLE><AZIMUTH_ANGLE>140.004</AZIMUTH_ANGLE></Sun_Angles><L><Mean_Viewing_Incidence_Angle band_id='B2'><ZENITH_ANGLE>5.126</ZENITH_ANGLE><AZIMUTH_ANGLE/></Mean_Viewing_Incidence_Angle></L><Models><Model name='dust'>1</Model><Model name='sulphate'>3</Model></Models></P>"
    df = spark.createDataFrame([(xml, "SENTINEL2B_20180616-102816-151_L2A_T32TMR_C_V1-0")], "x string, n string")
    x = F.col("x")
    cols = {"rh": product.humidity(x), **product.sun_angles(x), **product.view_angles(x, "B2"), "sp": product.species(x), **product.folder_parts(F.col("n"))}
    r = df.select(*[v.alias(k) for k, v in cols.items()]).first()
    assert (r.rh, r.sza, r.saa, r.vza, r.vaa, r.tile, r.date) == (50.0, 31.26, 140.0, 5.13, 0.0, "32TMR", "2018061")
    assert r.sp["dust"] == 0.25 and r.sp["sulphate"] == 0.75


def test_metadata_is_parsed_few_times(spark):
    """Three XPath evaluations a document for all of its values."""
    xml = "<P><Sun_Angles><ZENITH_ANGLE>31.256</ZENITH_ANGLE><AZIMUTH_ANGLE>1.5</AZIMUTH_ANGLE></Sun_Angles><Mean_Viewing_Incidence_Angle band_id='B2'><ZENITH_ANGLE/></Mean_Viewing_Incidence_Angle><Model name='dust'>x</Model></P>"
    rows = spark.range(3).select(F.when(F.col("id") < 2, F.lit(xml)).alias("x")).repartition(2).where("x is not null")
    read = rows.select(product.fields(F.col("x"), product.asked("B2")).alias("f")).select(*[v.alias(n) for n, v in product.metadata(F.col("f"), "B2").items()])
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("xpath_string") + plan.count("XPathString") == 3
    for r in read.collect():
        assert (r.rh, r.sza, r.saa, r.vza, r.vaa, list(r.species)) == (50.0, 31.26, 1.5, 0.0, 0.0, ["dust"]) and np.isnan(r.species["dust"])


def test_arrays_are_written(spark, tmp_path):
    df = spark.createDataFrame([("B02", i, j, float(i * 3 + j)) for i in range(2) for j in range(3)], "band string, iy int, ix int, v double").withColumn("name", sinks.export_name("rho_s", [], F.col("band")))
    (path,) = [r.path for r in sinks.write_arrays(df, str(tmp_path), ["band"], "v", "name").collect()]
    assert path.endswith("rho_s__S2Band.B02.npy") and np.load(path).tolist() == [[0, 1, 2], [3, 4, 5]]
