"""Residual metrics, weighted losses and landscapes over (keys, iy, ix) fields."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .radial import energy_mask

EPS32 = 1.1920928955078125e-07


def residuals(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Adds ``resid``: the difference over the larger of both sides' greatest magnitude."""
    scale = df.groupBy(*keys).agg(F.greatest(F.max(F.abs(a)), F.max(F.abs(b)), F.lit(EPS32)).alias("scale"))
    return df.join(scale, list(keys)).withColumn("resid", (F.col(a) - F.col(b)) / F.col("scale")).drop("scale")


def weighed(df: DataFrame, keys: Sequence[str], a: str, b: str, mask_on: str | None = None) -> DataFrame:
    """Adds ``resid``; ``mask``, the residual's own energy mask; ``wr``, the radial weight, 0 outside the energy mask of ``mask_on``.  Needs r."""
    held = energy_mask(residuals(df, keys, a, b), keys, "resid")
    least = df.groupBy(*keys).agg(F.min(F.when(F.col("r") > 1e-3, F.col("r"))).alias("r_min"))
    checked = F.coalesce(F.col("r_min"), F.raise_error(F.lit("no pixel lies off the centre")).cast("double"))
    held = held.join(least, list(keys)).withColumn("wr", 1 / (2 * F.pi() * F.greatest(checked, F.col("r"))))
    if mask_on:
        outer = energy_mask(held.withColumnRenamed("mask", "own_mask"), keys, mask_on)
        held = outer.withColumn("wr", F.col("wr") * F.col("mask")).drop("mask").withColumnRenamed("own_mask", "mask")
    return held.drop("r_min")


def mean(value: Column, weight: Column) -> Column:
    return F.sum(weight * value) / F.sum(weight)


#: Name -> a weighted mean over the columns of ``weighed``.  The plain ones weigh by the residual's energy mask, the radial ones by 1 / (2 pi r).
REGISTRY = {
    "mae": lambda: mean(F.abs("resid"), F.col("mask")),
    "mse": lambda: mean(F.col("resid") * F.col("resid"), F.col("mask")),
    "rmse": lambda: F.sqrt(mean(F.col("resid") * F.col("resid"), F.col("mask"))),
    "mae_rad": lambda: mean(F.abs("resid"), F.col("wr")),
    "mse_rad": lambda: mean(F.col("resid") * F.col("resid"), F.col("wr")),
    "rmse_rad": lambda: F.sqrt(mean(F.col("resid") * F.col("resid"), F.col("wr"))),
}
METRICS = tuple(REGISTRY)


def metrics(df: DataFrame, keys: Sequence[str], a: str, b: str, mask_on: str | None = None, names: Sequence[str] = METRICS) -> DataFrame:
    """(keys, the named metrics).  Needs r.  ``mask_on`` cuts the radial ones to the energy mask of that column; the plain ones ignore it."""
    if unknown := [n for n in names if n not in REGISTRY]:
        raise ValueError(f"no metrics {unknown}")
    return weighed(df, keys, a, b, mask_on).groupBy(*keys).agg(*[REGISTRY[n]().alias(n) for n in names])


def weighted_loss(values: DataFrame, combo: Sequence[str], metric: str, weight: str) -> DataFrame:
    """Total over images and bands of a state."""
    return values.groupBy(*combo).agg(F.sum(F.col(metric) * F.col(weight)).alias("loss"))


@dataclass(frozen=True)
class Loss:
    """A metric, weighted and summed over images and bands; ``mask_on``: rho_unif or None."""

    metric: str
    mask_on: str | None = "rho_unif"

    def __post_init__(self) -> None:
        if self.metric not in REGISTRY or self.mask_on not in (None, "rho_unif"):
            raise ValueError(f"no loss of {self.metric} on {self.mask_on}")

    def __call__(self, df: DataFrame, samples: Sequence[str], combo: Sequence[str], predicted: str, target: str, weight: str = "weight") -> DataFrame:
        """(combo, loss).  ``df``: (samples, iy, ix, r, predicted, target, weight and ``mask_on``)."""
        each = metrics(df, [*samples, weight], predicted, target, self.mask_on if self.metric.endswith("_rad") else None, [self.metric])
        return weighted_loss(each, combo, self.metric, weight)


def landscape(train: DataFrame, candidates: DataFrame, names: Sequence[str], kernels: DataFrame, samples: Sequence[str], states: Sequence[str], loss: Loss) -> DataFrame:
    """(names, loss): for each candidate point spread function the mean over states of the loss of the surface recovered with it.  ``train``: (samples, iy, ix, r, rho_unif, rho_s,
    tdir_up, tdif_up, sph_alb, weight), with ``states`` among the samples' keys; ``candidates``: (names); ``kernels``: (names, dy, dx, w)."""
    from .convolution import unif2surface

    fields = train.withColumnRenamed("rho_s", "target").crossJoin(candidates.select(*names))
    found = unif2surface(fields, kernels, [*samples, *names])
    each = loss(found, [*samples, *names], [*states, *names], "rho_s", "target")
    return each.groupBy(*names).agg(F.avg("loss").alias("loss"))
