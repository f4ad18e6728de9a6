"""What the satellite sees of a surface: the 5S model with the environment's share, radially or pixel by pixel.

The photon kernels that these samplers would run aren't available; the full 5S formula, with the environment that a point spread function makes, takes their place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import five_s, psf
from ..functions.radiative import OUTPUTS
from . import interp, radial
from .algebra import natural_join, reindex, window_mask
from .convolution import fft

#: The approximate point spread function that says where a radial field is steep.
APPROXIMATE = {"sigma": 5e-5, "n": 0.2}
MAX_GAP_KM = 0.1


def approximate_kernel(df: DataFrame, res: float, n: int) -> DataFrame:
    """(dy, dx, w) on an odd grid of ``n`` or one less."""
    n = n - 1 if n % 2 == 0 else n
    params = df.sparkSession.range(1).select(F.lit(0).alias("k"), *[F.lit(v).alias(name) for name, v in APPROXIMATE.items()])
    return psf.kernels(params, ["k"], "generalized_gaussian", res, n).select("dy", "dx", "w")


def seen(df: DataFrame, rho_s: str = "rho_s", rho_env: str = "rho_env") -> DataFrame:
    """Adds ``rho_toa`` to rows with surface, environment and the six radiative quantities."""
    c = F.col
    return df.withColumn("rho_toa", five_s.toa_with_environment(c(rho_s), c(rho_env), c("rho_atm"), c("tdir_down") + c("tdif_down"), c("tdir_up"), c("tdif_up"), c("sph_alb")))


def symmetric(scene: DataFrame, radiatives: DataFrame, keys: Sequence[str], states: Sequence[str], res: float, n: int, kind: str, nr: int = 100, max_gap: float = MAX_GAP_KM) -> DataFrame:
    """(keys, states, iy, ix, rho_toa) of analytical, radially symmetric fields (keys, iy, ix, x, y, rho_s).  One value a radius: radii are dense where the field under an
    approximate point spread function is steep, at most ``max_gap`` apart; values in between by monotone cubics."""
    if kind != "analytical":
        raise ValueError(f"a radial sampler needs an analytical surface, not {kind}; use the full one")
    spread = fft(scene, approximate_kernel(scene, res, n), keys, "rho_s", "rho_env").join(scene.select(*keys, "iy", "ix", "x", "y", "rho_s"), [*keys, "iy", "ix"])
    env = radial.profile(spread, keys, "rho_env").where("mean is not null").select(*keys, "r", "mean")
    own = radial.profile(spread, keys, "rho_s").where("mean is not null").select(*keys, "r", "mean")
    radii = interp.fill_gaps(interp.adaptive_radii(env, keys, "r", "mean", nr).select(*keys, F.col("radius").alias("r")), keys, "r", max_gap).distinct()
    sampled = interp.linear(env, radii, keys, "r", "mean", "r", "rho_env")
    sampled = interp.linear(own, sampled, keys, "r", "mean", "r", "rho_s")
    values = seen(natural_join(sampled, radiatives.select(*[s for s in radiatives.columns if s in (*keys, *states)], *OUTPUTS), [*keys, *states]))
    pixels = scene.select(*keys, "iy", "ix", "x", "y").join(values.select(*keys, *states).distinct(), list(keys))
    return interp.to_field(values.select(*keys, *states, "r", "rho_toa"), pixels, [*keys, *states], "r", "rho_toa", "rho_toa").select(*keys, *states, "iy", "ix", "rho_toa")


def full(scene: DataFrame, radiatives: DataFrame, keys: Sequence[str], states: Sequence[str], kernel: DataFrame, kind: str, window: tuple[int, int, int, int]) -> DataFrame:
    """(keys, states, iy, ix, rho_toa, rho_toa_valid) of arbitrary fields: pixels of the window (top, left, rows, columns) are seen, the others are null."""
    if kind != "arbitrary":
        raise ValueError(f"the full sampler needs an arbitrary surface, not {kind}; use the radial one")
    top, left, ny, nx = window
    size = scene.groupBy(*keys).agg(F.max("iy").alias("my"), F.max("ix").alias("mx"))
    outside = size.where((F.col("my") < top + ny - 1) | (F.col("mx") < left + nx - 1) | F.lit(min(window) < 0 or not ny or not nx)).limit(1).count()
    if outside:
        raise ValueError(f"the window {window} leaves the field")
    inside = window_mask(F.col("iy"), F.col("ix"), top, left, ny, nx)
    env = fft(scene, kernel, keys, "rho_s", "rho_env").where(inside)
    values = seen(natural_join(env.join(scene.select(*keys, "iy", "ix", "rho_s"), [*keys, "iy", "ix"]), radiatives.select(*[s for s in radiatives.columns if s in (*keys, *states)], *OUTPUTS), [*keys, *states]))
    whole = natural_join(scene.select(*keys, "iy", "ix"), radiatives.select(*[s for s in radiatives.columns if s in (*keys, *states)]).distinct(), [*keys, *states])
    return reindex(whole, values.select(*keys, *states, "iy", "ix", "rho_toa"), [*keys, *states, "iy", "ix"]).withColumn("rho_toa_valid", inside)
