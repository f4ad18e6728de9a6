"""What works at any size: content keys and the cache, partitioned convolution, regridding, look-ups, numbering, profiles, slopes, writers and streams."""

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from haloscape import api
from haloscape import scene as scenes
from haloscape.fit import optimize
from haloscape.functions import atmosphere, psf
from haloscape.operators import algebra, convolution, interp, radial, regrid
from haloscape.plans import content
from haloscape.plans.modules import Cache, Module, Pipeline
from haloscape.sources import npy, sinks
from haloscape.streaming import folders


def long(spark, image, key="B", name="v"):
    return spark.createDataFrame([(key, i, j, float(v)) for (i, j), v in np.ndenumerate(image)], f"band string, iy int, ix int, {name} double")


def weights(spark, image):
    half = image.shape[0] // 2
    return spark.createDataFrame([(i - half, j - half, float(v)) for (i, j), v in np.ndenumerate(image)], "dy int, dx int, w double")


@pytest.fixture(scope="module")
def pixels(spark):
    return long(spark, np.arange(30.0).reshape(5, 6))


def test_content_keys(spark, pixels):
    key = content.content_key(pixels)
    assert key == content.content_key(pixels.repartition(7).orderBy(F.desc("v")).select("v", "ix", "iy", "band"))
    changed = pixels.withColumn("v", F.when((F.col("iy") == 2) & (F.col("ix") == 3), 1e-9).otherwise(F.col("v")))
    swapped = pixels.withColumn("v", F.when(F.col("v") == 1, 2.0).when(F.col("v") == 2, 1.0).otherwise(F.col("v")))
    twice = pixels.unionByName(pixels.limit(1))
    others = [changed, swapped, twice, pixels.limit(29), pixels.withColumnRenamed("v", "w"), pixels.withColumn("v", F.col("v").cast("float")), pixels.limit(0)]
    keys = [content.content_key(df) for df in others]
    assert len({key, *keys}) == len(others) + 1
    assert content.changed_columns(pixels, changed) == ["v"] and content.changed_columns(pixels, swapped) == []
    assert content.changed_columns(pixels, pixels.withColumnRenamed("v", "w")) == ["v", "w"]


def test_content_of_any_type(spark):
    schema = "a string, b string, m map<string,int>, s struct<x:int,y:array<double>>, n binary"
    rows = [("1", None, {"p": 1, "q": 2}, (None, [1.0]), b"a"), (None, "1", None, None, None), ("", "", {}, (1, []), b"")]
    df = spark.createDataFrame(rows, schema)
    other = spark.createDataFrame([("1", None, {"q": 2, "p": 1}, (None, [1.0]), b"a"), *rows[1:]], schema)
    assert content.content_key(df) == content.content_key(other)
    for k, row in enumerate([("1", None, {"p": 2, "q": 1}, (None, [1.0]), b"a"), (None, "1", {}, None, None), ("", "", {}, None, b"")]):
        assert content.content_key(df) != content.content_key(spark.createDataFrame([*rows[:k], row, *rows[k + 1 :]], schema)), k
    both = spark.createDataFrame([("1", "2"), ("12", "")], "a string, b string")
    assert content.content_key(both.limit(1)) != content.content_key(both.select(F.lit("12").alias("a"), F.lit("").alias("b")).limit(1))


def counted(calls, factor=2.0):
    def compute(df):
        calls.append(1)
        return df.withColumn("w", F.col("v") * factor)

    return Module("double", ("v",), ("w",), compute, {"factor": factor})


def test_pipeline_cache_follows_content(spark, pixels, tmp_path):
    calls, cache = [], Cache(spark, str(tmp_path))
    pipe = Pipeline([counted(calls)])
    first = pipe(pixels, cache)
    assert content.marks(first)["w"][0] == "double"
    again = pipe(pixels.orderBy(F.rand(3)), cache)
    assert len(calls) == 1 and content.marks(again) == content.marks(first)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    pipe(pixels.withColumn("v", F.col("v") + (F.col("ix") == 5).cast("double")), cache)  # changed pixels miss
    assert len(calls) == 2
    Pipeline([counted(calls, 3.0)])(pixels, cache)
    assert len(calls) == 3
    assert content.input_key(first, ["w"]) == content.marks(first)["w"][1]


def test_modules_stamp_scenes(spark, pixels, tmp_path):
    calls, cache = [], Cache(spark, str(tmp_path))
    scene = scenes.source(["B"]).enrich("v", pixels)
    out = counted(calls).on(scene, cache)
    made = out.about("w", "B").made_by
    assert made[0] == "double" and out["w"].columns == ["band", "iy", "ix", "w"]
    assert counted(calls).on(scene, cache).about("w", "B").made_by == made and len(calls) == 1
    follower = Module("half", ("w",), ("u",), lambda df: df.withColumn("u", F.col("w") / 2))
    a = follower.on(out).about("u", "B").made_by
    assert a == follower.on(out).about("u", "B").made_by  # the stamp of w stands for what w holds
    other = scenes.source(["B"]).enrich("v", pixels.withColumn("v", F.col("v") + 1))
    assert counted(calls).on(other, cache).about("w", "B").made_by != made
    with pytest.raises(algebra.MissingVariableError):
        follower.on(scene)


def test_cache_commits_whole_results(spark, pixels, tmp_path):
    cache = Cache(spark, str(tmp_path))
    cache.save("m", "k", pixels)
    other = cache.save("m", "k", pixels.withColumn("v", F.lit(0.0)))  # the later writer reads what the first one wrote
    assert other.agg(F.sum("v")).first()[0] == 435
    failing = pixels.withColumn("v", F.when(F.col("ix") == 5, F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("double"))
    for key in ("k", "new"):
        with pytest.raises(Exception, match="no"):
            cache.save("m", key, failing)
    assert cache.load("m", "k", ["v"]).count() == 30 and cache.load("m", "new", ["v"]) is None
    assert os.listdir(tmp_path / "m") == ["k"]


@pytest.mark.parametrize(("n", "k", "block"), [(20, 15, 6), (21, 15, 6), (21, 21, 8), (16, 3, 5)])
def test_partitioned_convolution(spark, n, k, block):
    rng = np.random.default_rng(n)
    df, kernel = long(spark, rng.random((n, n))).unionByName(long(spark, rng.random((n, n)), "C")), weights(spark, rng.random((k, k)))
    for boundary in ("wrap", "mirror"):
        want = {(r.band, r.iy, r.ix): r.o for r in convolution.fft(df, kernel, ["band"], "v", "o", boundary=boundary).collect()}
        got = {(r.band, r.iy, r.ix): r.o for r in convolution.partitioned(df, kernel, ["band"], "v", "o", block, boundary).collect()}
        assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)


def test_partitioned_kernels_by_key(spark):
    rng = np.random.default_rng(1)
    df = long(spark, rng.random((14, 14))).unionByName(long(spark, rng.random((14, 14)), "C"))
    kernel = weights(spark, rng.random((5, 5))).withColumn("band", F.lit("B")).unionByName(weights(spark, rng.random((5, 5))).withColumn("band", F.lit("C")))
    zero = {(r.band, r.iy, r.ix): r.o for r in convolution.partitioned(df, kernel, ["band"], "v", "o", 4, "zero").collect()}
    want = {(r.band, r.iy, r.ix): r.o for r in convolution.small(df, kernel, ["band"], "v", "o").collect()}
    assert zero.keys() == want.keys() and all(zero[p] == pytest.approx(want[p]) for p in want)
    chosen = convolution.whole_or_parts(df, kernel, ["band"], "v", "o", most=8).collect()
    whole = {(r.band, r.iy, r.ix): r.o for r in convolution.whole_or_parts(df, kernel, ["band"], "v", "o").collect()}
    assert all(r.o == pytest.approx(whole[r.band, r.iy, r.ix]) for r in chosen)
    with pytest.raises(ValueError, match="too wide"):
        convolution.partitioned(df, weights(spark, np.ones((17, 17))), ["band"], "v", "o")


def brute_regrid(image, fy, fx):
    out = {}
    for (i, j), v in np.ndenumerate(image):
        for a in range(int(i // fy), int(np.ceil((i + 1) / fy))):
            for b in range(int(j // fx), int(np.ceil((j + 1) / fx))):
                w = (min(i + 1, (a + 1) * fy) - max(i, a * fy)) * (min(j + 1, (b + 1) * fx) - max(j, b * fx))
                if w > 1e-12 and not np.isnan(v):
                    total, area = out.get((a, b), (0.0, 0.0))
                    out[a, b] = (total + w * v, area + w)
    return out


@pytest.mark.parametrize("factor", [1.5, 2.0, 0.4, (2.5, 0.75)])
def test_regrid(spark, factor):
    image = np.random.default_rng(4).random((9, 10))
    image[2, 3] = np.nan
    df, (fy, fx) = long(spark, image), factor if isinstance(factor, tuple) else (factor, factor)
    want = brute_regrid(image, fy, fx)
    kept = {(r.iy, r.ix): r.v for r in regrid.regrid(df, ["band"], "v", factor, edge="keep").collect()}
    assert {p for p, v in kept.items() if v is not None} == want.keys() and all(kept[p] == pytest.approx(t / a) for p, (t, a) in want.items())
    sums = regrid.regrid(df, ["band"], "v", factor, "sum", edge="keep").agg(F.sum("v")).first()[0]
    assert sums == pytest.approx(np.nansum(image))
    cut = {(r.iy, r.ix) for r in regrid.regrid(df, ["band"], "v", factor).collect()}
    assert cut == {p for p in kept if (p[0] + 1) * fy <= 9 + 1e-9 and (p[1] + 1) * fx <= 10 + 1e-9}
    if factor == 2.0:
        blocks = {(r.by, r.bx): r.v for r in algebra.block_reduce(df, ["band"], "v", 2).collect()}
        assert all(v == pytest.approx(kept[p]) for p, v in blocks.items())
    with pytest.raises(ValueError):
        regrid.regrid(df, ["band"], "v", 0.0)


def test_multilinear(spark):
    xs, ys, zs = [0.0, 1.0, 4.0], [-1.0, 2.0], [5.0, 6.0, 6.5, 10.0]
    f = lambda x, y, z: 2 * x - 3 * y + z + x * y - 0.5 * y * z
    lut = spark.createDataFrame([(x, y, z, f(x, y, z), 1.0) for x in xs for y in ys for z in zs], "x double, y double, z double, f double, one double")
    rng = np.random.default_rng(2)
    asked = [(i, *map(float, p)) for i, p in enumerate(rng.uniform([-1, -2, 4], [5, 3, 11], (60, 3)))] + [(100, 1.0, 2.0, 6.5), (101, None, 0.0, 6.0)]
    df = spark.createDataFrame(asked, "i int, x double, y double, z double")
    got = {r.i: r for r in interp.multilinear(df, lut, ["x", "y", "z"], ["f", "one"]).collect()}
    clamp = lambda v, a: min(max(v, a[0]), a[-1])
    for i, x, y, z in asked[:-1]:
        # multilinear in a cell, so the function's own products are met exactly
        assert got[i].f == pytest.approx(f(clamp(x, xs), clamp(y, ys), clamp(z, zs))) and got[i].one == pytest.approx(1.0)
    assert got[101].f is None
    holed = {r.i: r.f for r in interp.multilinear(df, lut.where("not (x = 1 and y = 2 and z = 6.5)"), ["x", "y", "z"], ["f"]).collect()}
    assert holed[100] is None and any(v is not None for v in holed.values())
    keyed = lut.withColumn("k", F.lit("a")).unionByName(lut.withColumn("k", F.lit("b")).withColumn("f", F.col("f") * 2))
    two = interp.multilinear(df.withColumn("k", F.lit("b")), keyed, ["x", "y", "z"], ["f"], ["k"]).collect()
    assert all(r.f is None or r.f == pytest.approx(2 * got[r.i].f) for r in two) and len(two) == len(asked)


def test_long_profiles_are_looked_up(spark):
    """More knots than 16 bits count."""
    prof = spark.range(70_000).select(F.lit(0).alias("k"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    q = spark.createDataFrame([(0, 69_000.25), (0, 3.5), (0, 1e9), (0, -5.0)], "k int, at double")
    assert [r.o for r in interp.linear(prof, q, ["k"], "x", "y", "at", "o").orderBy("at").collect()] == [0.0, 7.0, 138_000.5, 139_998.0]


def test_numbering(spark):
    rng = np.random.default_rng(5)
    rows = sorted({(int(a), float(b)) for a, b in zip(rng.integers(0, 4, 3000), rng.random(3000).round(3), strict=True)})
    df = spark.createDataFrame([*rows, (None, 1.0), (None, None)], "a int, b double").repartition(5)
    got = [tuple(r)[:2] for r in algebra.numbered(df, ["a", "b"], "i", 16).orderBy("i").collect()]
    assert got == [(None, None), (None, 1.0), *rows]
    plan = algebra.distinct_states(df, ["b"])._jdf.queryExecution().toString()
    assert "windowspecdefinition(b" not in plan and "windowspecdefinition(_range" in plan
    assert algebra.distinct_states(df.limit(0), ["a"]).count() == 0
    sizes = algebra.ranged(df, ["a", "b"], "q", 16).groupBy("q").count().collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 2 * len(rows) / 16
    chunks = algebra.chunked(df, "b", 10).select("b", "chunk").distinct().orderBy("b").collect()
    assert [r.chunk for r in chunks] == [i // 10 for i in range(len(chunks))]


def test_ranges_are_found_by_compiled_steps(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("a"))
    held = algebra.ranged(df, ["a"], "q", 50)
    assert "lambda" not in held._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted((r.a, r.q) for r in held.collect())
    assert [q for _, q in rows] == sorted(q for _, q in rows) and {q for _, q in rows} == set(range(50))


def test_profiles(spark):
    levels = atmosphere.vertical_grids(spark.createDataFrame([("a",), ("b",)], "k string"))
    given = spark.createDataFrame([("a", 0.0, 1.0), ("a", 100.0, 1.0), ("b", 0.0, 2.0), ("b", 10.0, 0.0)], "k string, z double, ext double")
    out = {(r.k, r.grid, r.z): r for r in atmosphere.profiles(levels, given, ["k"], ["ext"]).collect()}
    assert out["a", "scalar", 0.0].ext_above == pytest.approx(100.0) and out["a", "phase", 20.0].ext_above == pytest.approx(80.0)
    assert out["b", "scalar", 50.0].ext == 0 and out["b", "scalar", 0.0].ext_above == pytest.approx(10.0) and out["b", "scalar", 5.0].ext == pytest.approx(1.0)
    parts = spark.createDataFrame([("a", "dust", "g", 0, 1.0, 2.0), ("a", "soot", "g", 0, 1.0, 4.0)], "k string, aerosol string, grid string, level int, z double, ext double")
    shares = spark.createDataFrame([("a", "dust", 0.25), ("a", "soot", 0.75)], "k string, aerosol string, share double")
    assert atmosphere.merged_profiles(parts, shares, ["k"], ["ext"]).first().ext == pytest.approx(3.5)


def test_std_with_bins(spark):
    df = long(spark, np.random.default_rng(0).random((12, 12))).withColumn("x", F.col("ix") - 5.5).withColumn("y", F.col("iy") - 5.5)
    assert radial.profile(df, ["band"], "v", 20).count() == 20
    assert radial.profile(df.withColumn("v", F.lit(1.0)), ["band"], "v", 9).agg(F.max("std")).first()[0] == 0


@pytest.mark.parametrize("model", list(psf.BOUNDS))
def test_adjoint_slopes(model):
    rng = np.random.default_rng(3)

    def image(n):
        held = rng.random(n * n) < 0.8
        iy, ix = (a.ravel()[held] for a in np.mgrid[0:n, 0:n])
        return 0.2 + 0.4 * rng.random((n, n)), 0.2 + 0.4 * rng.random(held.sum()), iy, ix, {"tdir_up": 0.6, "tdif_up": 0.15, "sph_alb": 0.1}, 0.7

    start = np.log([(lo * hi) ** 0.5 for lo, hi in psf.BOUNDS[model].values()])
    loss, slope = optimize.loss_and_slope([image(20), image(25)], lambda x: optimize.kernel(model, np.exp(x), 1.0, 9), 9)
    assert np.allclose(slope(start), optimize.differences(loss, start - 1, start + 1)(start), atol=1e-6, rtol=1e-5)


def test_transforms_in_fits(spark):
    k = psf.kernels(spark.createDataFrame([(0, 1.5)], "k int, sigma double"), ["k"], "gaussian", 1.0, 9).select("dy", "dx", "w")
    image = 0.2 + 0.3 * np.random.default_rng(2).random((20, 20))
    base = long(spark, image, name="rho_unif").withColumns({"tdir_up": F.lit(0.6), "tdif_up": F.lit(0.1), "sph_alb": F.lit(0.1)})
    train = convolution.unif2surface(base, k, ["band"])
    for move in (atmosphere.Transform("sigmoid", 1e-3, 50.0), atmosphere.Transform()):
        found = api.PsfFit("gaussian", [1.0], 1.0, 9, moves={"sigma": move}).fit(train, ["band"])
        assert found.params.first().value == pytest.approx(1.5, abs=0.02)
    module = api.PsfFit("gaussian", [1.0], 1.0, 9).as_module(["band"])
    assert Pipeline([module])(train).first().value == pytest.approx(1.5, abs=0.02)
    assert module.key("x") != api.PsfFit("gaussian", [1.1], 1.0, 9).as_module(["band"]).key("x")


def test_npy_writer(spark, tmp_path):
    image = np.arange(12.0).reshape(3, 4)
    df = long(spark, image).unionByName(long(spark, image * 2, "C").where("ix < 2"))
    paths = sorted(r.path for r in sinks.write_arrays(df.withColumn("name", F.concat(F.lit("v__"), "band", F.lit(".npy"))), str(tmp_path), ["band"], "v", "name").collect())
    assert [os.path.basename(p) for p in paths] == sorted(os.listdir(tmp_path)) == ["v__B.npy", "v__C.npy"]
    assert np.array_equal(np.load(paths[0]), image.astype(np.float32)) and np.load(paths[1]).shape == (3, 2)
    failing = df.withColumn("v", F.when(F.col("band") == "C", F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("double"))
    with pytest.raises(Exception, match="no"):
        npy.write_rasters(failing, str(tmp_path / "other"), F.concat(F.col("band"), F.lit(".npy")), "v")
    assert not [f for f in os.listdir(tmp_path / "other") if f.endswith(".npy")] if (tmp_path / "other").exists() else True


def test_folder_stream(spark, tmp_path):
    root, sink, state = tmp_path / "drops", tmp_path / "out", tmp_path / "state"
    root.mkdir()

    def drop(name):
        aside = tmp_path / "aside"
        aside.mkdir()
        (aside / "meta.xml").write_text(f"<d>{name}</d>")
        (aside / "band.bin").write_bytes(b"12345")
        shutil.move(aside, root / name)

    def run():
        query = folders.process(spark, str(root), lambda df: df.where("file like '%.bin'").select("product", "tile", "size", "xml"), str(sink), str(state))
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted(tuple(r) for r in spark.read.parquet(str(sink) + "/*").collect()) if sink.exists() else []

    drop("S_20200101-x_L_T31TCJ_C_V1")
    (root / "empty").mkdir()
    assert run() == [("S_20200101-x_L_T31TCJ_C_V1", "31TCJ", 5, "<d>S_20200101-x_L_T31TCJ_C_V1</d>")]
    drop("A_20200102-x_L_T31TCK_C_V1")  # sorts before by name, comes later
    assert [r[1] for r in run()] == ["31TCK", "31TCJ"]
    assert len(run()) == 2  # nothing is read twice
