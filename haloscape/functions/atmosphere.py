"""Atmosphere, surface and environment descriptions, and parameters that move within bounds."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import five_s

#: Fixed value: the wavelength that aerosol optical thickness refers to, in nm.
REFERENCE_NM = 560.0


def vertical_grids(df: DataFrame) -> DataFrame:
    """Each row with (grid, z): heights in km, falling.  ``scalar``: 90 from 100 to 11, then steps of 0.25 from 10 to 0; ``phase``: 100, 20, then the
    same steps."""
    base = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: 10.0 - i * 0.25)
    high = F.transform(F.sequence(F.lit(0), F.lit(89)), lambda i: 100.0 - i * 1.0)
    scalar, phase = F.concat(high, base), F.concat(F.array(F.lit(100.0), F.lit(20.0)), base)
    both = F.array(F.struct(F.lit("scalar").alias("grid"), scalar.alias("zs")), F.struct(F.lit("phase").alias("grid"), phase.alias("zs")))
    return df.withColumn("g", F.explode(both)).select(*df.columns, "g.grid", F.posexplode("g.zs").alias("level", "z"))


def species_depths(df: DataFrame, species: str = "species", aot: str = "aot") -> DataFrame:
    """A row for each species with ``tau_ref``, its share of the optical thickness at ``REFERENCE_NM``."""
    return df.select("*", F.explode(species).alias("aerosol", "share")).withColumn("tau_ref", F.col(aot) * F.col("share")).drop(species, "share")


def atmosphere(states: DataFrame, remove_rayleigh: bool = False) -> DataFrame:
    """(wl, aot, rh, href, h, ...) with ``pressure``, ``tau_rayleigh`` (0 if it is removed) and ``tau_aerosol``."""
    pressure = five_s.surface_pressure(F.col("h"))
    rayleigh = F.lit(0.0) if remove_rayleigh else five_s.rayleigh_depth(F.col("wl"), pressure)
    return states.withColumns({"pressure": pressure, "tau_rayleigh": rayleigh, "tau_aerosol": five_s.aerosol_depth(F.col("aot"), F.col("wl"), F.lit(1.3))})


def profiles(levels: DataFrame, given: DataFrame, keys: Sequence[str], values: Sequence[str], height: str = "z") -> DataFrame:
    """Several given profiles on vertical grids: ``levels`` (keys, grid, level, z; heights falling) with ``values`` interpolated in height, constant beyond a profile's ends, and for each value its
    ``<value>_above``: the integral from the top of the grid down to the level, by trapezoids.

    Each profile has few heights and is one array, in which a level finds its place; profiles of other keys never meet.  The running sum goes along one grid of one profile."""
    from ..operators.interp import linear

    out = levels
    for v in values:
        out = linear(given.select(*keys, F.col(height).alias("_h"), F.col(v).alias("_v")), out, keys, "_h", "_v", height, v)
    down = Window.partitionBy(*keys, "grid").orderBy("level")
    step = F.lag(height).over(down) - F.col(height)
    parts = out.withColumns({f"_{v}": F.coalesce((F.lag(v).over(down) + F.col(v)) / 2 * step, F.lit(0.0)) for v in values})
    sums = {f"{v}_above": F.sum(f"_{v}").over(down.rowsBetween(Window.unboundedPreceding, 0)) for v in values}
    return parts.withColumns(sums).drop(*[f"_{v}" for v in values])


def merged_profiles(profile: DataFrame, shares: DataFrame, keys: Sequence[str], values: Sequence[str], part: str = "aerosol", share: str = "share") -> DataFrame:
    """(keys, grid, level, z, values): the profiles of several components on one grid, weighed by their shares; components without a share don't count."""
    both = profile.join(shares.select(*keys, part, share), [*keys, part])
    return both.groupBy(*keys, "grid", "level", "z").agg(*[F.sum(F.col(v) * F.col(share)).alias(v) for v in values])


def background(df: DataFrame, keys: Sequence[str], value: str, kind: str, params: Mapping[str, float] | None = None, chosen: float | str = "zero") -> DataFrame:
    """(keys, albedo) of the surface under everything: an analytical field's greatest value; of others a float, the mean, the least value, or 0 (also for
    anything else)."""
    if kind not in ("analytical", "arbitrary"):
        raise ValueError(f"no surface of kind {kind}")
    if kind == "analytical":
        albedo = F.lit(float((params or {})["rho_max"]))
    elif isinstance(chosen, float):
        albedo = F.lit(chosen)
    else:
        albedo = {"mean": F.avg(value), "min": F.min(value)}.get(chosen, F.lit(0.0)) if isinstance(chosen, str) else F.lit(0.0)
    return df.groupBy(*keys).agg(F.max(F.lit(1)).alias("one"), albedo.alias("albedo") if kind == "arbitrary" and chosen in ("mean", "min") else F.max(albedo).alias("albedo")).drop("one")


#: Model of an analytical field -> the environment's number.
ENVIRONMENTS = {"disk": 1, "gauss": 2}


def analytical_environment(model: str, params: Mapping[str, float]) -> dict[str, float]:
    """Number, size and albedo of the environment around an analytical field: twice the variance of a Gaussian, a disk's radius."""
    model = {"gaussian": "gauss"}.get(model, model)
    if model not in ENVIRONMENTS:
        raise NotImplementedError(f"no environment for {model}")
    size = 2 * params["sigma"] ** 2 if model == "gauss" else params["radius"]
    return {"env": ENVIRONMENTS[model], "size": size, "albedo": params["rho_min"]}


def albedo_levels(df: DataFrame, keys: Sequence[str], value: str, levels: int = 1000) -> DataFrame:
    """(keys, iy, ix, level, albedo): each pixel's nearest of ``levels`` equidistant values from the least (0 at least) to the greatest, half to even;
    the level's value to four decimals.  A row and a column before the first are outside: level -1, no albedo."""
    span = df.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.min(value)).alias("lo"), F.max(value).alias("hi"), F.max("iy").alias("my"), F.max("ix").alias("mx"))
    step = F.when(F.lit(levels) > 1, (F.col("hi") - F.col("lo")) / max(1, levels - 1)).otherwise(1.0)
    place = F.when(step == 0, F.lit(0.0)).otherwise(F.rint((F.col(value) - F.col("lo")) / step))
    level = F.greatest(F.lit(0.0), F.least(F.lit(float(levels - 1)), place)).cast("int")
    inside = df.join(span.select(*keys, "lo", "hi"), list(keys)).withColumn("step", step).withColumn("level", level)
    inside = inside.select(*keys, "iy", "ix", "level", F.bround(F.col("lo") + F.col("step") * F.col("level"), 4).alias("albedo"))
    down = span.select(*keys, F.explode(F.sequence(F.lit(-1), F.col("my"))).alias("iy"), F.lit(-1).alias("ix"))
    along = span.select(*keys, F.lit(-1).alias("iy"), F.explode(F.sequence(F.lit(0), F.col("mx"))).alias("ix"))
    border = down.unionByName(along).select(*keys, F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix"), F.lit(-1).alias("level"), F.lit(None).cast("double").alias("albedo"))
    return inside.unionByName(border)


def angle_sensors(df: DataFrame, angles: Sequence[float], phi: Column, height: Column, place: str = "ATMOS") -> DataFrame:
    """A sensor for each zenith angle, all with one azimuth."""
    made = F.array(*[F.struct(F.lit(n).alias("sensor"), F.lit(float(a)).alias("th_deg")) for n, a in enumerate(angles)])
    rows = df.withColumn("s", F.explode(made))
    return rows.select(*df.columns, "s.sensor", "s.th_deg", phi.alias("ph_deg"), height.alias("pos_z"), F.lit(place).alias("place"))


@dataclass(frozen=True)
class Transform:
    """A map of a parameter to the line on which it moves, and back.  ``edge`` keeps it off the ends."""

    name: str = "identity"
    lo: float = 0.0
    hi: float = 1.0
    edge: float = 1e-6

    def free(self, value: float) -> float:
        if self.name == "exp":
            return math.log(max(value, self.edge))
        if self.name == "sigmoid":
            share = min(1 - self.edge, max(self.edge, (value - self.lo) / (self.hi - self.lo)))
            return math.log(share / (1 - share))
        return value

    def value(self, free: float) -> float:
        if self.name == "exp":
            return math.exp(free)
        if self.name == "sigmoid":
            return self.lo + (self.hi - self.lo) / (1 + math.exp(-free))
        return free


@dataclass(frozen=True)
class BoundedParameter:
    """A start value between bounds, and how it moves; ``at`` clamps."""

    start: float
    lo: float
    hi: float
    transform: Transform = Transform("exp")

    def __post_init__(self) -> None:
        if not self.lo <= self.start <= self.hi:
            raise ValueError(f"{self.start} isn't between {self.lo} and {self.hi}")

    @property
    def free(self) -> float:
        return self.transform.free(self.start)

    def at(self, free: float) -> float:
        return min(self.hi, max(self.lo, self.transform.value(free)))
