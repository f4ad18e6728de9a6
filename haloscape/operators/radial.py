"""Radial statistics of gridded fields: profiles, cumulative energy, masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_bins(nx: Column, ny: Column) -> Column:
    return F.greatest(F.lit(2), F.floor((F.least(nx, ny) - 1) / F.sqrt(F.lit(2.0))).cast("int") - 1)


def with_radius(df: DataFrame, keys: Sequence[str], centre: tuple[float, float] | None = None) -> DataFrame:
    """Adds r, r_max and npix.  The centre is the mean of the coordinates unless given."""
    c = df.groupBy(*keys).agg(*[f(d).alias(f"{n}_{d}") for d in ("x", "y") for n, f in (("mean", F.avg), ("lo", F.min), ("hi", F.max))], F.countDistinct("ix").alias("nx"), F.countDistinct("iy").alias("ny"))
    if centre:
        c = c.withColumns({"mean_x": F.lit(centre[0]), "mean_y": F.lit(centre[1])})
    far = lambda d: F.greatest(F.abs(F.col(f"hi_{d}") - F.col(f"mean_{d}")), F.abs(F.col(f"lo_{d}") - F.col(f"mean_{d}")))
    c = c.select(*keys, F.col("mean_x").alias("cx"), F.col("mean_y").alias("cy"), F.sqrt(far("x") * far("x") + far("y") * far("y")).alias("r_max"), natural_bins(F.col("nx"), F.col("ny")).alias("npix"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return df.join(c, list(keys)).withColumn("r", F.sqrt(dx * dx + dy * dy)).drop("cx", "cy")


def radial_bin(r: Column, r_max: Column, npix: Column) -> Column:
    """Right-closed bins; 0 falls into the first."""
    return F.greatest(F.lit(0), F.least(npix - 1, F.ceil(r / (r_max / npix)).cast("int") - 1))


def profile(df: DataFrame, keys: Sequence[str], value: str, n_bins: int | None = None) -> DataFrame:
    """(keys, bin, r, n, mean, std): all bins, ``n_bins`` or the grid's natural number; null where a bin is empty."""
    placed = with_radius(df, keys)
    placed = placed.withColumn("npix", F.lit(n_bins)) if n_bins else placed
    binned = placed.withColumn("bin", radial_bin(F.col("r"), F.col("r_max"), F.col("npix")))
    sums = binned.groupBy(*keys, "bin").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.first("r_max").alias("r_max"), F.first("npix").alias("npix"))
    full = sums.groupBy(*keys).agg(F.first("r_max").alias("r_max"), F.first("npix").alias("npix")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("npix") - 1)))
    centre = F.when(F.col("bin") == 0, 0.0).otherwise((F.col("bin") + 0.5) * F.col("r_max") / F.col("npix"))
    return full.withColumn("r", centre).join(sums.drop("r_max", "npix"), [*keys, "bin"], "left").select(*keys, "bin", "r", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std")


def annulus(order: Window) -> Column:
    """Area between the midpoints to the neighbouring radii; the first is 0, as its edges lie symmetrically about the centre."""
    r, before, after = F.col("r"), F.lag("r").over(order), F.lead("r").over(order)
    hi = F.coalesce((r + after) / 2, r + (r - before) / 2)
    lo = F.coalesce((before + r) / 2, r - (after - r) / 2)
    return F.pi() * (hi * hi - lo * lo)


def cumulative(prof: DataFrame, keys: Sequence[str], value: str = "mean", normalize: bool = True, fill_empty: bool = False) -> DataFrame:
    """Adds ``cdf``, the area-weighted running sum of a profile, as a share of its total if that is positive.  An empty bin poisons what follows: from
    it on ``cdf`` is null, and as the total is unknown the sums before it aren't divided; ``fill_empty`` counts it as 0 instead, as encircled energy does."""
    order = Window.partitionBy(*keys).orderBy("r")
    here = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.greatest(F.col(value), F.lit(0.0)))
    if fill_empty:
        here = F.coalesce(here, F.lit(0.0))
    energy = prof.withColumn("e", here * annulus(order))
    so_far, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    poisoned = lambda w: F.sum(F.col("e").isNull().cast("int")).over(w) > 0
    run = energy.withColumn("cdf", F.when(~poisoned(so_far), F.sum("e").over(so_far)))
    if normalize:
        total = F.when(~poisoned(whole), F.sum("e").over(whole))
        # an unknown last value can't be compared: the sums stay as they are
        run = run.withColumn("cdf", F.when(total > 0, F.col("cdf") / total).otherwise(F.col("cdf")))
    return run.drop("e")


def energy_radius(cdf: DataFrame, keys: Sequence[str], fractions: Sequence[float] = (0.1, 0.5, 0.99)) -> DataFrame:
    """The smallest radius whose running share reaches each fraction, else the last radius."""
    reach = [F.coalesce(F.min(F.when(F.col("cdf") >= f, F.col("r"))), F.max("r")).alias(f"r_{round(f * 100)}") for f in fractions]
    return cdf.groupBy(*keys).agg(*reach)


def upsampled(prof: DataFrame, keys: Sequence[str], n_bins: int, value: str = "mean") -> DataFrame:
    """(keys, bin, r, value) at ``n_bins`` equidistant radii if the profile has fewer bins, by linear interpolation; else the profile as it is."""
    from .interp import linear

    ends = prof.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_old"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    more = ends.where(F.col("n_old") < n_bins).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    more = more.select(*keys, "bin", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / (n_bins - 1)).alias("r"))
    drawn = linear(prof.where(F.col(value).isNotNull()), more, keys, "r", value, "r", value)
    kept = prof.join(ends.where(F.col("n_old") >= n_bins).select(*keys), list(keys), "left_semi")
    return drawn.select(*keys, "bin", "r", value).unionByName(kept.select(*keys, "bin", "r", value))


#: Rings that a field is cut to before pixels of one ring are put in order.
RINGS = 1024


def energy_mask(df: DataFrame, keys: Sequence[str], value: str, fraction: float = 0.99) -> DataFrame:
    """Adds ``mask``: 1 while the running sum of |value| by (r, iy, ix) stays within the fraction.  Sums run over rings first, then over the pixels of each
    ring, so no task orders a whole field."""
    far = df.groupBy(*keys).agg(F.max("r").alias("far"), F.sum(F.abs(value)).alias("total"))
    ring = F.when(F.col("far") > 0, F.floor(F.col("r") / F.col("far") * RINGS)).otherwise(0)
    held = df.join(far, list(keys)).withColumn("ring", ring)
    sums = held.groupBy(*keys, "ring").agg(F.sum(F.abs(value)).alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy(*keys).orderBy("ring").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).drop("s")
    order = Window.partitionBy(*keys, "ring").orderBy("r", "iy", "ix").rowsBetween(Window.unboundedPreceding, 0)
    inside = (F.col("before") + F.sum(F.abs(value)).over(order)) <= fraction * F.col("total")
    return held.join(before, [*keys, "ring"]).withColumn("mask", inside.cast("int")).select(*df.columns, "mask")
