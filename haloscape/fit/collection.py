"""Point spread functions by band: models whose parameters may still move, or kernels that stand."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import psf
from ..scene import band_order


@dataclass(frozen=True)
class Model:
    """A point spread function on a grid: its name, its parameters, the grid's resolution and odd side."""

    name: str
    params: Mapping[str, float]
    res: float
    n: int

    def __post_init__(self) -> None:
        psf.check_grid(self.res, self.n)
        if self.name not in psf.MODELS or set(self.params) != set(psf.BOUNDS[self.name]):
            raise ValueError(f"{self.name} doesn't take {sorted(self.params)}")


def fixed_kernel(spark: SparkSession, weights: Sequence[Sequence[float]], n: int) -> DataFrame:
    """(dy, dx, w) of given weights, as float32 values that sum to one; their shape must be the grid's."""
    import numpy as np

    image = np.asarray(weights, np.float32)
    if image.shape != (n, n):
        raise ValueError(f"weights of {image.shape} on a grid of {n} x {n}")
    image = image / image.sum()
    half = n // 2
    return spark.createDataFrame([(y - half, x - half, float(image[y, x])) for y in range(n) for x in range(n)], "dy int, dx int, w double")


class PsfCollection:
    """Either ``models`` (band -> Model), or a table of kernels (band, states, dy, dx, w) with, if known, their parameters (band, states, param, value)."""

    def __init__(self, spark: SparkSession, models: Mapping[str, Model] | None = None, kernels: DataFrame | None = None, parameters: DataFrame | None = None, bands: Sequence[str] = ()):
        self.spark, self.models, self.kernels, self.parameters = spark, dict(models) if models is not None else None, kernels, parameters
        self._bands = list(bands)

    @classmethod
    def from_models(cls, spark: SparkSession, models: Mapping[str, Model]) -> PsfCollection:
        return cls(spark, models=models)

    @classmethod
    def from_kernels(cls, kernels: DataFrame, bands: Sequence[str], parameters: DataFrame | None = None) -> PsfCollection:
        return cls(kernels.sparkSession, kernels=kernels, parameters=parameters, bands=bands)

    @classmethod
    def start(cls, spark: SparkSession, grids: Mapping[str, tuple[float, int]], model: str, params: Mapping) -> PsfCollection:
        """``grids``: band -> (res, n); ``params``: the same for all bands, or by band."""
        by_band = bool(params) and all(isinstance(v, Mapping) for v in params.values())
        if by_band and (missing := sorted(set(grids) - set(params))):
            raise ValueError(f"no parameters for {missing}")
        return cls.from_models(spark, {b: Model(model, params[b] if by_band else params, res, n) for b, (res, n) in grids.items()})

    @property
    def is_trainable(self) -> bool:
        return self.models is not None

    @property
    def bands(self) -> list[str]:
        return band_order(self.models if self.models is not None else self._bands)

    def __contains__(self, band: str) -> bool:
        return band in self.bands

    def __repr__(self) -> str:
        return f"PsfCollection(bands={self.bands}, trainable={self.is_trainable})"

    def model(self, band: str) -> Model:
        if self.models is None:
            raise RuntimeError("kernels that stand have no models")
        return self.models[band]

    def frozen(self) -> PsfCollection:
        """The models' present kernels; what stands already is itself."""
        if self.models is None:
            return self
        parts, rows = [], []
        for band, m in self.models.items():
            given = self.spark.range(1).select(F.lit(band).alias("band"), *[F.lit(float(v)).alias(k) for k, v in m.params.items()])
            parts.append(psf.kernels(given, ["band"], m.name, m.res, m.n).select("band", "dy", "dx", "w"))
            rows += [(band, k, float(v)) for k, v in m.params.items()]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return PsfCollection.from_kernels(whole, self.bands, self.spark.createDataFrame(rows, "band string, param string, value double"))

    def kernel(self, band: str) -> DataFrame:
        if self.kernels is None:
            raise RuntimeError("models have no kernels yet; freeze them first")
        return self.kernels.where(F.col("band") == band).drop("band")

    def params(self, band: str) -> DataFrame | None:
        """(states, param, value), or None where no parameters are known."""
        if self.parameters is None:
            return None
        return self.parameters.where(F.col("band") == band).drop("band")
