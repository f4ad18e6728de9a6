"""Scenes: named variables in long format, with the bands that have them and what is known about each.

A variable is a table with ``band``, its own dimensions and one column named like itself.  Scenes never change: each method gives a new one,
so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.algebra import MissingVariableError, natural_join

SPATIAL = ("iy", "ix", "y", "x")


@dataclass(frozen=True)
class Meta:
    """``kind``: "analytical" or "arbitrary"; ``model`` and ``params`` of an analytical field; ``made_by``: module and key of its cache entry."""

    kind: str | None = None
    model: str | None = None
    params: Mapping[str, float] | None = None
    made_by: tuple[str, str] | None = None

    @property
    def is_analytical(self) -> bool:
        return self.kind == "analytical"


def band_order(bands: Sequence[str]) -> list[str]:
    """By id as text, so B8A comes after B12."""
    return sorted(bands)


@dataclass(frozen=True)
class Scene:
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    #: variable -> bands that have it
    held: Mapping[str, frozenset[str]] = field(default_factory=dict)
    meta: Mapping[tuple[str, str], Meta] = field(default_factory=dict)
    band_ids: tuple[str, ...] = ()

    @property
    def bands(self) -> list[str]:
        return band_order({*self.band_ids, *(b for bands in self.held.values() for b in bands)})

    def variables(self, band: str) -> list[str]:
        return sorted(v for v, bands in self.held.items() if band in bands)

    def has(self, variable: str) -> bool:
        """In all bands."""
        return variable in self.held and set(self.bands) <= self.held[variable]

    def require(self, variables: Sequence[str]) -> Scene:
        if missing := [v for v in variables if not self.has(v)]:
            raise MissingVariableError(", ".join(missing))
        return self

    def __contains__(self, band: str) -> bool:
        return band in self.bands

    def __getitem__(self, variable: str) -> DataFrame:
        if variable not in self.tables:
            raise MissingVariableError(variable)
        return self.tables[variable]

    def __repr__(self) -> str:
        return f"Scene(bands={self.bands}, variables={{{'; '.join(f'{b}: {self.variables(b)}' for b in self.bands)}}})"

    def enrich(self, variable: str, table: DataFrame, bands: Sequence[str] | None = None, meta: Meta | None = None) -> Scene:
        """Adds or replaces a variable for all its bands."""
        of = frozenset(bands or self.bands)
        known = {**self.meta, **{(b, variable): meta for b in of if meta}}
        return replace(self, tables={**self.tables, variable: table}, held={**self.held, variable: of}, meta=known)

    def band(self, band: str) -> Scene:
        """Only one band."""
        held = {v: frozenset([band]) for v, bands in self.held.items() if band in bands}
        return Scene({v: self.tables[v].where(F.col("band") == band) for v in held}, held, {k: m for k, m in self.meta.items() if k[0] == band}, (band,))

    def put(self, band: str, variable: str, table: DataFrame, meta: Meta | None = None) -> Scene:
        """Replaces one band's rows of a variable; the others stay."""
        rest = [self.tables[variable].where(F.col("band") != band)] if variable in self.tables else []
        whole = rest[0].unionByName(table) if rest else table
        out = self.enrich(variable, whole, [*self.held.get(variable, ()), band])
        return replace(out, meta={**out.meta, **({(band, variable): meta} if meta else {})}, band_ids=tuple({*self.band_ids, band}))

    def about(self, variable: str, band: str) -> Meta:
        return self.meta.get((band, variable), Meta())

    def stamp(self, variables: Sequence[str], module: str, key: str) -> Scene:
        """Marks variables with the module and the key that they were made under."""
        new = {(b, v): replace(self.about(v, b), made_by=(module, key)) for v in variables for b in self.held.get(v, ())}
        return replace(self, meta={**self.meta, **new})

    def table(self, variables: Sequence[str]) -> DataFrame:
        """The variables side by side: joined on the dimensions that they share, crossed on the others."""
        first, *rest = [self[v] for v in variables]
        for v, other in zip(variables[1:], rest, strict=True):
            first = natural_join(first, other, [c for c in other.columns if c != v])
        return first


def source(bands: Sequence[str], scene: Scene | None = None) -> Scene:
    """A scene to read into: the one given, or an empty one of these bands."""
    return replace(scene, band_ids=tuple({*scene.band_ids, *bands})) if scene else Scene(band_ids=tuple(bands))


def grid_info(table: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """(keys, res, n): the step between the first two columns, and the number of columns."""
    first = lambda i: F.max(F.when(F.col("ix") == i, F.col(x)))
    return table.groupBy(*keys).agg((first(1) - first(0)).alias("res"), F.count_distinct("ix").alias("n"))


def rows_as_arrays(table: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, iy, v): each row of pixels as an array of floats in the order of ix; a row is what one group holds."""
    cells = F.sort_array(F.collect_list(F.struct("ix", F.col(value).cast("float").alias("v"))))
    return table.groupBy(*keys, "iy").agg(F.transform(cells, lambda c: c["v"]).alias("v"))


def misaligned(images: Sequence[DataFrame], dims: Sequence[str]) -> DataFrame:
    """Labels of ``dims`` that some of the images lack; empty if all have the same.  Images without spatial dimensions, or with others than the
    first has, are an error."""
    for n, image in enumerate(images):
        if missing := [d for d in dims if d not in image.columns]:
            raise ValueError(f"image {n} lacks the dimensions {missing}")
    if not {"iy", "ix"} <= set(dims):
        raise ValueError("dimensions must hold iy and ix")
    labels = images[0].select(*dims).distinct().withColumn("image", F.lit(0))
    for n, image in enumerate(images[1:], 1):
        labels = labels.unionByName(image.select(*dims).distinct().withColumn("image", F.lit(n)))
    return labels.groupBy(*dims).agg(F.count(F.lit(1)).alias("images")).where(F.col("images") < len(images))


def normalise(table: DataFrame, squeeze: Sequence[str] = (), rename: Mapping[str, str] | None = None, expand: Mapping[str, float] | None = None) -> DataFrame:
    """Drops dimensions, renames and adds others, each only where it applies."""
    table = table.drop(*[d for d in squeeze if d in table.columns])
    table = table.withColumnsRenamed({a: b for a, b in (rename or {}).items() if a in table.columns})
    return table.withColumns({d: F.lit(v) for d, v in (expand or {}).items() if d not in table.columns}) if expand else table


def unflatten(table: DataFrame, index: str, nx: int) -> DataFrame:
    """The row and the column of a flat sensor number, counted row by row."""
    return table.withColumn("iy", F.floor(F.col(index) / nx).cast("int")).withColumn("ix", (F.col(index) % nx).cast("int")).drop(index)
