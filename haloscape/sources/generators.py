"""Synthetic scenes in long format: (band, iy, ix, y, x, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_n(res_km: float, n: int | None = None, extent_km: float | None = None) -> int:
    """Pixels a side from exactly one of the two."""
    if (n is None) == (extent_km is None):
        raise ValueError("give exactly one of n and extent_km")
    return n if n is not None else round(extent_km / res_km)


def resolve_bands(res_km: float | dict[str, float], bands: list[str], n: int | dict[str, int] | None = None, extent_km: float | dict[str, float] | None = None) -> dict[str, int]:
    """Pixels a side of each band; each argument is one for all bands, or by band, all of which it must then have."""

    def of(given, band):
        if isinstance(given, dict):
            if band not in given:
                raise ValueError(f"nothing given for {band}")
            return given[band]
        return given

    return {b: resolve_n(of(res_km, b), of(n, b), of(extent_km, b)) for b in bands}


def extended(bands: DataFrame, model: str, params: dict[str, float], res: float, n: int) -> DataFrame:
    """An analytical field anew on a grid of another size."""
    low, high = params["rho_min"], params["rho_max"]
    if model in ("gauss", "gaussian"):
        return gaussian_scene(bands, params["sigma"], res, n=n, low=low, high=high)
    if model == "disk":
        return disk_scene(bands, params["radius"], res, n=n, low=low, high=high)
    raise ValueError(f"no analytical field of model {model}")


def grid(bands: DataFrame, n: int, res: float) -> DataFrame:
    """``bands`` crossed with an n x n grid centred on 0."""
    side = F.sequence(F.lit(0), F.lit(n - 1))
    cells = bands.withColumn("iy", F.explode(side)).withColumn("ix", F.explode(side))
    at = lambda i: (F.col(i) - (n - 1) / 2) * res
    return cells.withColumn("y", at("iy")).withColumn("x", at("ix"))


def gaussian_field(x: Column, y: Column, sigma: Column, low: Column, high: Column) -> Column:
    return low + (high - low) * F.exp(-(x * x + y * y) / (2 * sigma * sigma))


def disk_field(x: Column, y: Column, radius: Column, low: Column, high: Column) -> Column:
    return F.when(x * x + y * y <= radius * radius, high).otherwise(low)


def gaussian_scene(bands: DataFrame, sigma: float, res: float, n: int | None = None, extent_km: float | None = None, low: float = 0.0, high: float = 1.0) -> DataFrame:
    cells = grid(bands, resolve_n(res, n, extent_km), res)
    return cells.withColumn("rho_s", gaussian_field(F.col("x"), F.col("y"), F.lit(sigma), F.lit(low), F.lit(high)).cast("float"))


def disk_scene(bands: DataFrame, radius: float, res: float, n: int | None = None, extent_km: float | None = None, low: float = 0.0, high: float = 1.0) -> DataFrame:
    cells = grid(bands, resolve_n(res, n, extent_km), res)
    return cells.withColumn("rho_s", disk_field(F.col("x"), F.col("y"), F.lit(radius), F.lit(low), F.lit(high)).cast("float"))


def random_scene(bands: DataFrame, variables: list[str], res: float, seed: int, n: int | None = None, extent_km: float | None = None) -> DataFrame:
    """Uniform values in [0, 1) that depend on seed, variable, band and pixel only, so that any task can be run again."""
    keys = [c for c in bands.columns]
    cells = grid(bands, resolve_n(res, n, extent_km), res)
    top = float(1 << 24)
    draw = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), *keys, "iy", "ix"), F.lit(1 << 24).cast("bigint")) / top).cast("float")
    return cells.withColumns({v: draw(i) for i, v in enumerate(variables)})
