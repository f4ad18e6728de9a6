"""Point spread functions as unnormalised Columns of the radius, and their bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FWHM = 2.0 * math.sqrt(2.0 * math.log(2.0))
#: Parameter -> (least, greatest) by model.
BOUNDS = {
    "gaussian": {"sigma": (1e-3, 50.0)},
    "generalized_gaussian": {"sigma": (1e-6, 1.0), "n": (0.1, 0.4)},
    "voigt": {"sigma": (1e-3, 50.0), "gamma": (1e-3, 50.0)},
    "king": {"sigma": (1e-3, 100.0), "gamma": (0.1, 10.0)},
    "moffat": {"alpha": (1e-3, 50.0), "beta": (1e-3, 50.0), "gamma": (1e-3, 50.0)},
}
#: Coefficients of the pseudo-Voigt width (by powers of the Gaussian width, falling) and mixing (by rising powers).
WIDTH = (1.0, 2.69269, 2.42843, 4.47163, 0.07842, 1.0)
MIXING = (1.36603, -0.47719, 0.11116)


def gaussian(r: Column, sigma: Column) -> Column:
    return F.exp(-(r * r) / (2 * sigma * sigma))


def generalized_gaussian(r: Column, sigma: Column, n: Column) -> Column:
    return F.exp(-F.pow(r / sigma, n))


def voigt_mixing(sigma: Column, gamma: Column) -> Column:
    g, lo = FWHM * sigma, 2 * gamma
    total = sum((c * F.pow(g, F.lit(float(5 - i))) * F.pow(lo, F.lit(float(i))) for i, c in enumerate(WIDTH)), F.lit(0.0))
    y = F.greatest(F.lit(0.0), F.least(F.lit(1.0), lo / F.pow(total, F.lit(0.2))))
    eta = sum((c * F.pow(y, F.lit(float(i + 1))) for i, c in enumerate(MIXING)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), eta))


def voigt(r: Column, sigma: Column, gamma: Column) -> Column:
    eta = voigt_mixing(sigma, gamma)
    return eta / (1 + F.pow(r / gamma, F.lit(2.0))) + (1 - eta) * gaussian(r, sigma)


def king(r: Column, sigma: Column, gamma: Column) -> Column:
    return F.pow(1 + r * r / (2 * sigma * sigma * gamma), -gamma)


def moffat(r: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    return F.pow(1 + F.pow(r / alpha, 2 * beta), -gamma)


MODELS = {"gaussian": gaussian, "generalized_gaussian": generalized_gaussian, "voigt": voigt, "king": king, "moffat": moffat}


def check_grid(res: float, n: int) -> None:
    if n < 3 or n % 2 == 0 or res <= 0:
        raise ValueError(f"a kernel needs an odd side of 3 or more and a positive resolution, not {n} and {res}")


def kernel_grid(params: DataFrame, res: float, n: int) -> DataFrame:
    """Each row of ``params`` with the offsets (dy, dx) of an n x n kernel and their radius."""
    check_grid(res, n)
    side = F.sequence(F.lit(-(n // 2)), F.lit(n // 2))
    offsets = params.withColumn("dy", F.explode(side)).withColumn("dx", F.explode(side))
    return offsets.withColumn("r", F.sqrt(F.pow(F.col("dx") * res, F.lit(2.0)) + F.pow(F.col("dy") * res, F.lit(2.0))))


def kernels(params: DataFrame, keys: list[str], model: str, res: float, n: int) -> DataFrame:
    """(keys, dy, dx, r, w): kernels that sum to one, from columns named like the model's parameters clamped to their bounds."""
    args = [F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(name))) for name, (lo, hi) in BOUNDS[model].items()]
    raw = kernel_grid(params, res, n).withColumn("_raw", MODELS[model](F.col("r"), *args))
    return raw.withColumn("w", F.col("_raw") / F.sum("_raw").over(Window.partitionBy(*keys))).select(*keys, "dy", "dx", "r", "w")
