"""Short ways to common runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bands import WAVELENGTHS
from .fit import optimize
from .fit.collection import PsfCollection
from .functions import psf, radiative
from .functions.atmosphere import Transform
from .functions.five_s import digitize
from .operators import forward, radial
from .operators.algebra import dedup_apply
from .operators.convolution import unif2surface
from .plans.configs import AtmosphereConfig, GeometryConfig, SpectralConfig, Sweep
from .plans.modules import Module
from .scene import Scene
from .sources.product import ATMOSPHERE, ELEVATION, GEOMETRY, ProductLoader

#: What the analytic provider of radiative quantities depends on.
RADIATIVE_PARAMS = ("wl", "aot", "h", "sza", "vza")


def atmosphere_config(aot, h=0.0, rh=50.0, href=2.0, species: Mapping[str, float] | None = None) -> AtmosphereConfig:
    return AtmosphereConfig(aot, h, rh, href, dict(species or {"sulphate": 1.0}))


def geometry_config(sza, vza, saa=0.0, vaa=0.0, sat_height: float = 700.0) -> GeometryConfig:
    return GeometryConfig(sza, vza, saa, vaa, sat_height)


def spectral_config(bands: Sequence[str]) -> SpectralConfig:
    return SpectralConfig.from_bands(bands)


def radiatives(spark: SparkSession, atmosphere: AtmosphereConfig, geometry: GeometryConfig, spectrum: SpectralConfig) -> DataFrame:
    """All combinations of the configurations' values with the six radiative quantities."""
    return radiative.analytic(Sweep.from_configs([atmosphere, geometry, spectrum], RADIATIVE_PARAMS).table(spark).drop("chunk"))


def config_from_scene(scene: Scene, names: Sequence[str] = ("aot", "h", "rh", "href", "sza", "vza", "saa", "vaa")) -> DataFrame:
    """The parameters that a scene's variables give, side by side; those that it lacks are an error."""
    return scene.require(names).table(names)


def radiatives_from_scene(scene: Scene, n_bins: int | None = None) -> Scene:
    """Adds the six quantities to a scene that has the parameters as maps or values.  Each distinct state is computed once; ``n_bins`` levels of each map first bring
    their number down."""
    params = scene.require(("aot", "h", "sza", "vza")).table(("aot", "h", "sza", "vza"))
    wavelengths = F.create_map(*[F.lit(x) for b, wl in WAVELENGTHS.items() for x in (b, wl)])
    rows = params.withColumn("wl", F.try_element_at(wavelengths, F.col("band")))
    if n_bins:
        span = rows.groupBy("band").agg(*[f(c).alias(f"{n}_{c}") for c in ("aot", "h") for n, f in (("lo", F.min), ("hi", F.max))])
        levels = {c: digitize(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), n_bins) for c in ("aot", "h")}
        rows = rows.join(span, "band").withColumns(levels).select(*rows.columns)
    made = dedup_apply(rows, list(RADIATIVE_PARAMS), radiative.analytic)
    dims = [c for c in ("band", "iy", "ix") if c in made.columns]
    out = scene
    for name in radiative.OUTPUTS:
        out = out.enrich(name, made.select(*dims, name))
    return out


def load_product(spark: SparkSession, folder: str, bands: Sequence[str], res: float | Sequence[float], as_map: bool = False, elevation_folder: str | None = None, href: float = 2.0, compute_radiatives: bool = False, n_bins: int | None = None) -> Scene:
    """A product's scene and, if asked for, the radiative quantities of its states."""
    loader = ProductLoader(spark, folder, bands, res, as_map, (GEOMETRY, ATMOSPHERE, ELEVATION), elevation_folder, href)
    scene = loader.scene()
    return radiatives_from_scene(scene, n_bins) if compute_radiatives else scene


def forward_pipeline(spark: SparkSession, scene: Scene, atmosphere: AtmosphereConfig, geometry: GeometryConfig, res: float, n: int, nr: int = 100) -> Scene:
    """Adds rho_toa and rho_unif to a scene of analytical surfaces: what the satellite sees, and the uniform surface that would look alike."""
    from .functions import five_s

    states = ("aot", "h", "sza", "vza")
    kinds = {scene.about("rho_s", b).kind for b in scene.bands}
    kind = kinds.pop() if len(kinds) == 1 else "mixed"
    by_band = spark.createDataFrame([(b, WAVELENGTHS[b]) for b in scene.bands], "band string, wl double")
    rads = radiatives(spark, atmosphere, geometry, spectral_config(scene.bands)).join(by_band, "wl").drop("wl")
    toa = forward.symmetric(scene["rho_s"], rads, ["band"], states, res, n, kind, nr)
    rows = toa.join(rads, ["band", *states])
    c = F.col
    unif = five_s.inverse(c("rho_toa"), c("rho_atm"), c("tdir_up") + c("tdif_up"), c("tdir_down") + c("tdif_down"), c("sph_alb"))
    out = scene.enrich("rho_toa", toa)
    for name in radiative.OUTPUTS:
        out = out.enrich(name, rads.select("band", *states, name))
    return out.enrich("rho_unif", rows.select("band", *states, "iy", "ix", unif.alias("rho_unif")))


def make_model(spark: SparkSession, bands: Sequence[str], model: str, params: Mapping, res: float, n: int) -> PsfCollection:
    return PsfCollection.start(spark, {b: (res, n) for b in bands}, model, params)


def psf_of_atmosphere(spark: SparkSession, atmosphere: AtmosphereConfig, geometry: GeometryConfig, wl: float, res: float, n: int, photons: int = 20_000) -> DataFrame:
    """(aot, h, vza, vaa, iy, ix, w) of each state, by tracing photons."""
    states = Sweep.from_configs([atmosphere, geometry], ("aot", "h", "href", "vza", "vaa")).table(spark).drop("chunk").withColumn("wl", F.lit(wl)).withColumn("sza", F.lit(0.0))
    depth = radiative.analytic(states).select(*states.columns, "od").withColumn("height", F.lit(8.0))
    numbered = depth.withColumn("state", F.pmod(F.xxhash64("aot", "h", "href", "vza", "vaa"), F.lit(1 << 62)))
    traced = radiative.psf_atm(numbered, res, n, photons)
    return traced.join(numbered.select("state", "aot", "h", "vza", "vaa"), "state").drop("state")


class FittedPsf:
    """Recovers surfaces with the kernels of a fit."""

    def __init__(self, kernels: DataFrame, params: DataFrame, combo: Sequence[str]):
        self.kernels, self.params, self.combo = kernels, params, list(combo)

    def transform(self, df: DataFrame) -> DataFrame:
        return unif2surface(df, self.kernels, self.combo)


class PsfFit:
    """A point spread function to be fitted: ``fit`` gives what recovers surfaces."""

    def __init__(self, model: str, start: Sequence[float], res: float, n: int, stages=(("adam", optimize.ADAM), ("lbfgs", optimize.LBFGS)), moves: Mapping[str, Transform] | None = None):
        self.model, self.start, self.res, self.n, self.stages, self.moves = model, list(start), res, n, stages, dict(moves or {})

    @property
    def config(self) -> dict:
        """All that a fit depends on besides its training data."""
        return {"model": self.model, "start": self.start, "res": self.res, "n": self.n, "stages": [[k, vars(s)] for k, s in self.stages], "moves": {k: vars(t) for k, t in sorted(self.moves.items())}}

    def as_module(self, combo: Sequence[str], name: str = "psf_fit") -> Module:
        """The fit as a module of a pipeline, with its contract and cache key: from the training columns to (combo, param, value, loss)."""
        needs = ("iy", "ix", "rho_unif", "rho_s", "tdir_up", "tdif_up", "sph_alb")
        fit = lambda df: optimize.fit_psf(df, combo, self.model, self.start, self.res, self.n, self.stages, self.moves)
        return Module(name, (*combo, *needs), (*combo, "param", "value", "loss"), fit, {**self.config, "combo": list(combo)})

    def fit(self, train: DataFrame, combo: Sequence[str]) -> FittedPsf:
        found = optimize.fit_psf(train, combo, self.model, self.start, self.res, self.n, self.stages, self.moves)
        return FittedPsf(optimize.fitted_kernels(found, combo, self.model, self.res, self.n), found, combo)


def energy_radius_landscape(candidates: DataFrame, names: Sequence[str], model: str, res: float, n: int, fractions: Sequence[float] = (0.1, 0.5, 0.99)) -> DataFrame:
    """(names, a radius for each fraction) of candidate point spread functions."""
    k = psf.kernels(candidates, list(names), model, res, n)
    half = n // 2
    cells = k.select(*names, (F.col("dy") + half).alias("iy"), (F.col("dx") + half).alias("ix"), (F.col("dy") * res).alias("y"), (F.col("dx") * res).alias("x"), "w")
    cdf = radial.cumulative(radial.profile(cells, names, "w"), names, fill_empty=True)
    return radial.energy_radius(cdf, names, fractions)


def lookup_table(states: DataFrame, outputs: Sequence[str], path: str | None = None) -> DataFrame:
    """States and outputs in order of wavelength, then of the other parameters; written once if a path is given."""
    from .sources.sinks import write_table

    params = [c for c in states.columns if c not in outputs]
    order = sorted(params, key=lambda c: c not in ("wl", "wl_nm", "band"))
    table = states.select(*order, *outputs).orderBy(*order)
    if path:
        write_table(table, path)
        return states.sparkSession.read.parquet(path)
    return table


def by_band(scene: Scene, names: Sequence[str]) -> DataFrame:
    """Variables side by side, bands in order."""
    return scene.table(names).orderBy("band")

