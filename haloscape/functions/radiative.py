"""Providers of the six radiative quantities with one schema: analytic, table, and Monte Carlo."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.algebra import natural_join
from ..operators.interp import linear
from . import five_s

OUTPUTS = ("tdir_down", "tdir_up", "tdif_down", "tdif_up", "sph_alb", "rho_atm")
ANGSTROM, ASYMMETRY, ABSORBED = 1.3, 0.7, 0.02


def analytic(params: DataFrame) -> DataFrame:
    """Adds the six quantities to rows of (wl, aot, h, sza, vza): Beer-Lambert for direct light, two-stream closed forms for the rest."""
    c = F.col
    rayleigh = five_s.rayleigh_depth(c("wl"), five_s.surface_pressure(c("h")))
    aerosol = five_s.aerosol_depth(c("aot"), c("wl"), F.lit(ANGSTROM))
    df = params.withColumn("od", rayleigh + aerosol).withColumn("g", ASYMMETRY * aerosol / (rayleigh + aerosol))
    for name, angle in (("down", "sza"), ("up", "vza")):
        slant = c("od") / F.cos(F.radians(angle))
        df = df.withColumn(f"tdir_{name}", five_s.direct_transmittance(c("od"), c(angle)))
        df = df.withColumn(f"tdif_{name}", F.greatest(F.lit(0.0), five_s.two_stream(slant, c("g")) * (1 - ABSORBED * slant) - c(f"tdir_{name}")))
    df = df.withColumn("sph_alb", 1 - five_s.two_stream(c("od"), c("g")))
    mu_s, mu_v = F.cos(F.radians("sza")), F.cos(F.radians("vza"))
    single = (1 - F.exp(-c("od") * (1 / mu_s + 1 / mu_v))) / (4 * (mu_s + mu_v))
    return df.withColumn("rho_atm", single * (1 - c("g"))).drop("g")


def table_lookup(params: DataFrame, lut: DataFrame, dim: str, keys: Sequence[str], outputs: Sequence[str] = OUTPUTS) -> DataFrame:
    """Linear interpolation along one dimension of a table; call it for each dimension in turn."""
    out = params
    for name in outputs:
        out = linear(lut.select(*keys, dim, name), out, keys, dim, name, dim, name)
    return out


def pipeline(dims: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """All combinations of one-column tables with their six quantities."""
    grid = dims[0]
    for d in dims[1:]:
        grid = natural_join(grid, d, names)
    return analytic(grid)


def monte_carlo(states: DataFrame, photons: int = 20_000, seed: int = 1) -> DataFrame:
    """(state, od, tdir, tdif, reflected) of a plane layer lit under ``sza``, by tracing photons; each state has its own seed, so a task
    run again gives the same result."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            rows = []
            for row in batch.itertuples():
                rng = np.random.Generator(np.random.PCG64([seed, int(row.state)]))
                tau, mu = np.zeros(photons), np.full(photons, np.cos(np.deg2rad(row.sza)))
                fate, hits = np.zeros(photons, int), np.zeros(photons, int)
                alive = np.arange(photons)
                while len(alive):
                    tau[alive] += mu[alive] * rng.exponential(size=len(alive))
                    out_low, out_top = tau[alive] >= row.od, tau[alive] < 0
                    fate[alive[out_low]] = np.where(hits[alive[out_low]] == 0, 1, 2)
                    fate[alive[out_top]] = 3
                    alive = alive[~(out_low | out_top)]
                    hits[alive] += 1
                    mu[alive] = 2 * rng.random(len(alive)) - 1
                rows.append((row.state, row.od, *((fate == k).mean() for k in (1, 2, 3))))
            yield pd.DataFrame(rows, columns=["state", "od", "tdir", "tdif", "reflected"])

    return states.select("state", "od", "sza").mapInPandas(run, "state bigint, od double, tdir double, tdif double, reflected double")


def psf_atm(states: DataFrame, res: float, n: int, photons: int = 20_000, seed: int = 2) -> DataFrame:
    """(state, iy, ix, w): where light that a sensor sees coming from the grid's centre meets the ground after scattering in a layer of depth ``od`` and height
    ``height``; weights sum to one over the n x n grid, whose side is odd.  Columns ``vza`` and ``vaa`` (degrees) say where the sensor stands, else it looks straight down; ``g`` is
    the scattering's asymmetry (Henyey and Greenstein), else it is the same in all directions."""
    if n % 2 == 0:
        raise ValueError("the grid's side must be odd")
    given = states.select("state", "od", "height", *[(F.col(c) if c in states.columns else F.lit(0.0)).cast("double").alias(c) for c in ("vza", "vaa", "g")])

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for row in batch.itertuples():
                rng = np.random.Generator(np.random.PCG64([seed, int(row.state) % (1 << 63)]))
                tilt, turn = np.deg2rad(row.vza), np.deg2rad(row.vaa)
                start = np.array([np.sin(tilt) * np.cos(turn), np.sin(tilt) * np.sin(turn), np.cos(tilt)])
                at = np.tile(start * row.height / start[2], (photons, 1))
                way = np.tile(-start, (photons, 1))
                alive, landed = np.arange(photons), np.zeros(photons, bool)
                while len(alive):
                    step = rng.exponential(size=len(alive)) * row.height / max(row.od, 1e-12)
                    down = way[alive, 2] < 0
                    floor = np.where(down, at[alive, 2] / np.maximum(-way[alive, 2], 1e-12), np.inf)
                    lands = floor <= step
                    at[alive] += way[alive] * np.minimum(step, floor)[:, None]
                    landed[alive[lands]] = True
                    alive = alive[~lands & (at[alive, 2] < row.height)]
                    way[alive] = scattered(way[alive], row.g, rng)
                ix, iy = (np.floor(at[landed, d] / res + n / 2).astype(int) for d in (0, 1))
                inside = (ix >= 0) & (ix < n) & (iy >= 0) & (iy < n)
                hits = np.bincount(iy[inside] * n + ix[inside], minlength=n * n)
                cells = hits.nonzero()[0]
                yield pd.DataFrame({"state": row.state, "iy": (cells // n).astype("int32"), "ix": (cells % n).astype("int32"), "w": hits[cells] / max(1, hits.sum())})

    return given.mapInPandas(run, "state bigint, iy int, ix int, w double")


def scattered(way, g: float, rng):
    """numpy: new directions after scattering with asymmetry ``g``."""
    import numpy as np

    u = rng.random(len(way))
    cos = 2 * u - 1 if abs(g) < 1e-9 else (1 + g * g - ((1 - g * g) / (1 - g + 2 * g * u)) ** 2) / (2 * g)
    sin, turn = np.sqrt(np.maximum(0, 1 - cos * cos)), 2 * np.pi * rng.random(len(way))
    helper = np.where(np.abs(way[:, 2:]) < 0.9, [[0.0, 0.0, 1.0]], [[1.0, 0.0, 0.0]])
    a = np.cross(way, helper)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = np.cross(way, a)
    return cos[:, None] * way + sin[:, None] * (np.cos(turn)[:, None] * a + np.sin(turn)[:, None] * b)
