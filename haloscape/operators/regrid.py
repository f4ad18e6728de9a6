"""Rasters on other grids, by the areas that cells share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that share less of a side than this touch only by rounding.
TOUCH = 1e-9


def shares(at: str, factor: float, offset: float) -> Column:
    """An array of (cell, share): the target's cells along an axis that source cell ``at`` overlaps, and by how much of the source's side.  Target cell j reaches from
    ``offset + j * factor`` to ``offset + (j + 1) * factor`` in source cells."""
    low, high = F.col(at) - offset, F.col(at) - offset + 1
    first, last = F.floor(low / factor + TOUCH).cast("int"), F.ceil(high / factor - TOUCH).cast("int") - 1
    overlap = lambda j: F.least(high, (j + 1) * factor) - F.greatest(low, j * factor)
    return F.transform(F.sequence(first, F.greatest(first, last)), lambda j: F.struct(j.alias("cell"), overlap(j).alias("share")))


def regrid(df: DataFrame, keys: Sequence[str], value: str, factor: float | tuple[float, float], how: str = "mean", offset: tuple[float, float] = (0.0, 0.0), edge: str = "cut") -> DataFrame:
    """(keys, iy, ix, value) on cells of ``factor`` source cells' sides (of y and x, or one for both; under 1 for finer grids), weighted by shared areas.

    ``mean`` is the mean over a target cell's area, ``sum`` spreads each source cell's amount over the cells that it overlaps, so that totals stay.  Nulls and NaN don't
    count; a cell that only they cover is null.  ``edge``: target cells that reach beyond the source's grid are ``cut`` away, or ``keep`` what lies inside; only then does
    ``sum`` keep all of the total.  A source cell makes a row for each target cell that it overlaps, and sums are made in each task before the one shuffle."""
    if how not in ("mean", "sum") or edge not in ("cut", "keep"):
        raise ValueError(f"no regridding by {how} with edges to {edge}")
    fy, fx = factor if isinstance(factor, tuple) else (factor, factor)
    if min(fy, fx) <= 0:
        raise ValueError("cells need a positive size")
    known = df.select(*keys, "iy", "ix", F.when(~F.isnan(value), F.col(value).cast("double")).alias("v"))
    spread = known.withColumn("sy", F.explode(shares("iy", fy, offset[0]))).withColumn("sx", F.explode(shares("ix", fx, offset[1])))
    area = F.when(F.col("v").isNotNull(), F.col("sy.share") * F.col("sx.share"))
    sums = spread.groupBy(*keys, F.col("sy.cell").alias("iy"), F.col("sx.cell").alias("ix")).agg(F.sum(area * F.col("v")).alias("total"), F.sum(area).alias("area"))
    if edge == "cut":
        size = df.groupBy(*keys).agg((F.max("iy") + 1).alias("ny"), (F.max("ix") + 1).alias("nx"))
        inside = lambda i, f, o, n: (F.col(i) * f + o >= -TOUCH) & ((F.col(i) + 1) * f + o <= F.col(n) + TOUCH)
        sums = sums.join(size, list(keys)).where(inside("iy", fy, offset[0], "ny") & inside("ix", fx, offset[1], "nx"))
    return sums.select(*keys, "iy", "ix", (F.col("total") / F.col("area") if how == "mean" else F.col("total")).alias(value))
